"""What a table of rated items looks like, declared and not inferred."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class ItemSpec:
    item: str = "item"
    label: str = "label"
    histogram: str | None = "counts"
    ratings: str | None = "ratings"
    landmarks: str | None = "landmarks"
    score_range: tuple[float, float] = (1.0, 10.0)
    splits: tuple[str, str, str] = ("train", "val", "test")
    fold: str = "fold"
    metadata: tuple[str, ...] = ()

    @property
    def n_bins(self) -> int:
        return round(self.score_range[1] - self.score_range[0]) + 1

    @classmethod
    def from_dict(cls, values: dict) -> ItemSpec:
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(values) - known):
            raise ValueError(f"unknown keys: {', '.join(unknown)}; known: {', '.join(sorted(known))}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})

    @classmethod
    def from_yaml(cls, path: str) -> ItemSpec:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.from_dict(yaml.safe_load(f) or {})
