"""Secret scans: character Markov models of random strings and of identifiers.

Rules find secrets in known dress (assignments, access keys, hex runs). The
model adds those in none: a run of secret-like characters is scored by two
first-order character chains, one of random strings and one of ordinary
identifiers, and is a span of kind ``model`` when the mean log-likelihood ratio
of its steps reaches a threshold. Runs without a digit that may be words (few
steps from lower to upper case, as in names of functions or paths) are scored by
their letters in lower case, so that it is the words that count. Everything here is DataFrame expressions.

Training, from labelled samples: positives are the secret values that the rules
find in the documents, together with ``RANDOM_SAMPLES`` strings over the same
alphabet made from hashes, so that the model knows more than one generator;
negatives are the identifier-like runs of the documents that no rule touches,
each different run once. Steps between characters are counted over all of them, map-side first; the
table has (alphabet + 1)^2 cells whatever the corpus and becomes one array
literal of log ratios. The threshold is part of the model, not of the data.

Positions: splitting a text at a pattern and extracting the pattern's matches
give the pieces in between and the matches; running sums of their lengths are
the code-point offsets. The sums go in blocks, so that a text with very many
matches stays far from quadratic work.

Defined cases: a null text counts as empty and has no spans; repeated rows give
repeated results; an empty table trains on the made samples alone; extra columns
do not matter; a model span may overlap a rule's span, and both are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.runtime import materialise

_ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: kind: pattern, the group whose length counts, least length
BASE = {"assign": (_ASSIGN, 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]{24,}", 0, 24)}
#: A run the model looks at. In fewer characters a random string and a rare word are not told apart (README).
CANDIDATE = r"[A-Za-z0-9+/_=-]{12,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
RANDOM_SAMPLES = 2_000
WEIGHT = 10
#: Mean log-likelihood ratio for each step (natural logarithm) from which a run is a secret.
THRESHOLD = 1.0
#: A run without letters and digits (a ruler) is never a secret; all others are scored.
SCORED = r"[A-Za-z0-9]"
#: A run without a digit is taken for words if it has at most one step from lower to upper case in so many characters.
WORD = 5
_BLOCK = 256


def _running(lengths: Column) -> Column:
    """Sums of an array's entries before each entry, in blocks."""
    n = F.size(lengths)
    zero = F.lit(0).cast("long")

    def sums(part: Column) -> Column:
        start = F.struct(zero.alias("t"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(part, start, lambda s, x: F.struct((s["t"] + x).alias("t"), F.concat(s["a"], F.array(s["t"])).alias("a")))

    blocks = F.transform(F.sequence(F.lit(0), ((n - 1) / _BLOCK).cast("int")), lambda b: sums(F.slice(lengths, b * _BLOCK + 1, _BLOCK)))
    start = F.struct(zero.alias("t"), F.array().cast("array<array<bigint>>").alias("a"))
    moved = F.aggregate(
        blocks,
        start,
        lambda s, x: F.struct((s["t"] + x["t"]).alias("t"), F.concat(s["a"], F.array(F.transform(x["a"], lambda v: v + s["t"]))).alias("a")),
    )
    return F.when(n > 0, F.flatten(moved["a"])).otherwise(F.array().cast("array<bigint>"))


def _places(text: str, matches: str, pattern: str) -> Column:
    """Code-point start of every match: pieces and matches alternate."""
    pieces = F.split(F.col(text), pattern, -1)
    steps = F.zip_with(F.slice(pieces, 1, F.size(matches)), F.col(matches), lambda p, m: (F.length(p) + F.length(m)).cast("long"))
    ends = F.zip_with(_running(steps), steps, lambda a, b: a + b)
    return F.zip_with(ends, F.col(matches), lambda e, m: e - F.length(m))


def _found(kind: str, rank: int, matches: Column, starts: Column, keep) -> Column:
    spans = F.zip_with(starts, matches, lambda s, m: F.struct(s.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (s + F.length(m)).alias("end"), m.alias("match")))
    return F.filter(spans, lambda x: keep(x["match"]))


def _value(match: Column) -> Column:
    return F.regexp_extract(match, _ASSIGN, 2)


def _keeps(kind: str):
    least = BASE[kind][2]
    return (lambda m: F.length(_value(m)) >= least) if kind == "assign" else (lambda m: F.length(m) >= least)


def _index(char: Column) -> Column:
    """0 for a character outside the alphabet, else its place in it."""
    table = [0] * 128
    for i, c in enumerate(ALPHABET):
        table[ord(c)] = i + 1
    return F.get(F.array(*[F.lit(x) for x in table]), F.ascii(char))


def _chars(run: Column) -> Column:
    return F.filter(F.split(run, ""), lambda c: c != "")


def train(docs: DataFrame) -> list[float]:
    """Log ratios of the steps between characters, row by row of (alphabet + 1)."""
    spark, size = docs.sparkSession, len(ALPHABET) + 1
    text = F.coalesce("text", F.lit(""))
    every = docs.select(text.alias("t"))
    values = F.concat(
        F.transform(F.filter(F.regexp_extract_all("t", F.lit(_ASSIGN), F.lit(0)), _keeps("assign")), _value),
        F.filter(F.regexp_extract_all("t", F.lit(BASE["access"][0]), F.lit(0)), _keeps("access")),
        F.regexp_extract_all("t", F.lit(BASE["hex"][0]), F.lit(0)),
    )
    words = F.regexp_extract_all(F.regexp_replace(F.regexp_replace(F.regexp_replace("t", _ASSIGN, " "), BASE["access"][0], " "), BASE["hex"][0], " "), F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))
    found = every.select(F.lit(1).alias("secret"), F.explode(values).alias("run")).unionByName(every.select(F.lit(0).alias("secret"), F.explode(words).alias("run")))
    # strings in base 64 and letters or digits alone, from hashes of their numbers
    made = spark.range(RANDOM_SAMPLES).select(
        F.lit(1).alias("secret"),
        F.explode(F.array(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))), F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("x"), F.col("id").cast("string")), 256))), "[+/=]", ""))).alias("run"),
    )
    # each different run counts once: what a text repeats is no more ordinary for that
    runs = found.unionByName(made).distinct()
    at = runs.select("secret", F.transform(_chars(F.col("run")), _index).alias("i"))
    # the first step leaves from 0, the start of a run
    steps = at.select("secret", F.explode(F.arrays_zip(F.concat(F.array(F.lit(0)), F.slice("i", 1, F.size("i") - 1)).alias("a"), F.col("i").alias("b"))).alias("s"))
    counted = steps.groupBy("secret", (F.col("s.a") * size + F.col("s.b")).alias("cell")).agg(F.count("*").alias("n"))
    counts = [[0.0] * (size * size) for _ in range(2)]
    for r in counted.collect():  # two tables of (alphabet + 1)^2 cells at most
        counts[r["secret"]][r["cell"]] = float(r["n"])
    from math import log

    ratios = [0.0] * (size * size)
    # a character's own frequency stands for what a history has not shown: WEIGHT steps of it
    alone = [[(sum(c[b::size]) + 0.5) / (sum(c) + 0.5 * size) for b in range(size)] for c in counts]
    for a in range(size):
        totals = [sum(c[a * size : (a + 1) * size]) for c in counts]
        for b in range(size):
            p = [(counts[k][a * size + b] + WEIGHT * alone[k][b]) / (totals[k] + WEIGHT) for k in range(2)]
            ratios[a * size + b] = round(log(p[1] / p[0]), 6)
    return ratios


def _score(run: Column, ratios: Column) -> Column:
    size = len(ALPHABET) + 1
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"))
    total = F.aggregate(F.transform(_chars(run), _index), start, lambda s, b: F.struct(b.alias("at"), (s["sum"] + F.get(ratios, s["at"] * size + b)).alias("sum")))
    return total["sum"] / F.length(run)


def _judged(run: Column) -> Column:
    """What of a run is scored."""
    words = ~run.rlike("[0-9]") & (WORD * (F.size(F.split(run, "[a-z][A-Z]")) - 1) <= F.length(run))
    return F.when(words, F.lower(F.regexp_replace(run, "[^A-Za-z]+", ""))).otherwise(run)


def _scan(docs: DataFrame, keep: list[Column], ratios: list[float]) -> DataFrame:
    """keep, text and ``found``: all spans by start, then kind as listed."""
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    names = [c for c in df.columns if c.startswith("__")]
    kinds = {k: p[0] for k, p in BASE.items()} | {"model": CANDIDATE}
    df = df.select(*names, *[F.regexp_extract_all("__text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in kinds.items()])
    table = F.array(*[F.lit(x) for x in ratios])
    keeps = {k: _keeps(k) for k in BASE} | {"model": lambda m: F.when(m.rlike(SCORED), _score(_judged(m), table) >= THRESHOLD).otherwise(False)}
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,match:string>>")
    found = []
    for rank, (k, p) in enumerate(kinds.items()):
        has = F.exists(f"m_{k}", keeps[k])
        found.append(F.when(has, _found(k, rank, F.col(f"m_{k}"), _places("__text", f"m_{k}", p), keeps[k])).otherwise(none))
    return df.select(*names, F.sort_array(F.concat(*found)).alias("found"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda x: x["kind"] == kind


def scan_secrets(docs: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each document row."""
    df = _scan(docs, [F.col("doc_id").alias("__doc_id")], train(docs) if ratios is None else ratios)
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    return df.select(
        F.col("__doc_id").alias("doc_id"),
        *[F.size(F.filter("found", _is(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )


#: Characters of a piece of a text at least, and pieces of a text at most.
PIECE, PIECES = 4_096, 128


def _redacted(mark: str) -> Column:
    """``__text`` with its ``found`` spans replaced.

    The text is cut into pieces once, and a piece is put together from the spans that
    start in it: no span's place is counted from the start of a long text, and no
    list of parts grows with the text's number of spans. What several steps use is a
    field of an array's element, so that it is evaluated once.
    """
    size = F.greatest(F.lit(PIECE), F.ceil(F.length("__text") / PIECES).cast("int"))

    def whole(w: Column) -> Column:
        each = F.sequence(F.lit(0), F.length(w["text"]) - 1, w["size"])
        spans_of = lambda at: F.filter(w["found"], lambda x: (x["start"] >= at) & (x["start"] < at + w["size"]))
        # how far the spans reach that start before the piece; what they cover of it is gone
        before = lambda at: F.coalesce(F.array_max(F.transform(F.filter(w["found"], lambda x: x["start"] < at), lambda x: x["end"])), F.lit(-1).cast("long"))
        pieces = F.transform(each, lambda at: F.struct(at.cast("long").alias("at"), F.substring(w["text"], at + 1, w["size"]).alias("chunk"), spans_of(at).alias("spans"), before(at).alias("reach")))
        return F.array_join(F.transform(pieces, piece), "")

    def piece(p: Column) -> Column:
        shown = lambda reach: F.greatest(reach, p["at"])

        def step(s: Column, x: Column) -> Column:
            gap = F.substring(p["chunk"], (shown(s["reach"]) - p["at"] + 1).cast("int"), F.greatest(x["start"] - shown(s["reach"]), F.lit(0)).cast("int"))
            parts = F.when(x["start"] > s["reach"], F.concat(s["parts"], F.array(gap, F.lit(mark)))).otherwise(s["parts"])
            return F.struct(F.greatest(s["reach"], x["end"]).alias("reach"), parts.alias("parts"))

        rest = lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(p["chunk"], (shown(s["reach"]) - p["at"] + 1).cast("int"), F.length(p["chunk"])))
        return F.aggregate(p["spans"], F.struct(p["reach"].alias("reach"), F.array().cast("array<string>").alias("parts")), step, rest)

    bound = F.array(F.struct(F.col("__text").alias("text"), F.col("found").alias("found"), size.alias("size")))
    return F.get(F.transform(bound, whole), F.lit(0))


def redact_secrets(docs: DataFrame, ratios: list[float] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The rows with every span of their text replaced by ``mark``; n_chars follows the text.

    Spans that overlap or touch are replaced as one. A null text stays null.
    """
    whole = [F.struct(*[docs[c] for c in docs.columns]).alias("__row")]
    df = _scan(docs, whole, train(docs) if ratios is None else ratios)
    df = df.select("__row", F.when(F.size("found") > 0, _redacted(mark)).alias("__new"))
    row = F.col("__row")
    columns = {c: row[c] for c in docs.columns}
    columns["text"] = F.coalesce("__new", row["text"])
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("__new").isNotNull(), F.length("__new").cast(docs.schema["n_chars"].dataType)).otherwise(row["n_chars"])
    return df.select(*[v.alias(c) for c, v in columns.items()])
