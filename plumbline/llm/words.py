"""Byte-level word splitting shared by decontamination and license scans."""

from __future__ import annotations

#: Words are runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z;
#: every other ASCII byte separates. UTF-8 keeps non-ASCII bytes at 0x80 and
#: above, so the split works on bytes and needs no decoding.
_TABLE = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def split_words(raw: bytes | None) -> list[bytes]:
    return raw.translate(_TABLE).split() if raw else []


def word_spans(raw: bytes | None) -> list[tuple[int, int]]:
    """Code-point [start, end) of each word, for mapping words back to the original."""
    out, flat = [], (raw or b"").translate(_TABLE)
    at = chars = 0
    for w in flat.split():
        i = flat.index(w, at)
        chars += len(flat[at:i].decode("utf-8"))
        n = len(w.decode("utf-8"))
        out.append((chars, chars + n))
        chars += n
        at = i + len(w)
    return out
