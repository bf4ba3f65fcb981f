"""Secrets in text: fixed patterns, and strings that look random to character Markov models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .spans import labelled, matches, written
from .store import stored

# The patterns of the base kinds. They are written so that a long run of one class
# is read once: a match begins at the run's head or where the last match ended.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: The value in a match of ASSIGN.
VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)$"""
#: Strings that the models judge.
STRING = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"

#: Documents that the models learn from, about; the pick is by hash.
TRAINING_DOCS = 50_000
#: One ordinary word in so many is learned from.
ORDINARY = 8
#: Log-likelihood ratio per character from which a string counts as random.
LEVEL = 0.1
#: Pairs for which a character's overall frequency counts.
BACKOFF = 5.0
SYMBOLS = 128


def base_spans(text: Column) -> list[tuple[str, Column]]:
    """The base kinds and their spans."""
    long_value = lambda s: F.length(F.regexp_extract(s["value"], VALUE, 1)) >= 8
    return [
        ("assign", F.filter(matches(text, ASSIGN), long_value)),
        ("access", matches(text, ACCESS)),
        ("hex", matches(text, HEX)),
    ]


def _codes(text: Column) -> Column:
    """The characters as numbers below SYMBOLS; all beyond ASCII share one."""
    return F.transform(F.split(text, ""), lambda c: F.when(F.octet_length(c) > 1, F.lit(SYMBOLS - 1)).otherwise(F.ascii(c) % SYMBOLS))


def _steps(text: Column) -> Column:
    """Each pair of neighbouring characters as one number, from 1."""
    codes = _codes(text)
    return F.zip_with(
        F.slice(codes, F.lit(1), F.greatest(F.size(codes) - 1, F.lit(0))),
        F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0))),
        lambda a, b: a * SYMBOLS + b + 1,
    )


def labelled_samples(docs: DataFrame, text_col: str = "text", most: int = TRAINING_DOCS) -> DataFrame:
    """(value, random): strings of the documents with a label that a pattern gives.

    Random are the values of the base kinds; ordinary are words of eight ASCII letters or more, one
    in ORDINARY by hash. They come from about `most` documents, picked by a hash of the text, or
    from all if there are no more.
    """
    text = F.col(text_col)
    n = docs.count()
    draw = F.pmod(F.xxhash64(text, F.lit("train")), F.lit(1 << 53)) / float(1 << 53)
    picked = docs.filter(draw < most / max(n, 1))
    random = F.concat(
        F.transform(base_spans(text)[0][1], lambda s: F.regexp_extract(s["value"], VALUE, 1)),
        *[F.transform(spans, lambda s: s["value"]) for _, spans in base_spans(text)[1:]],
    )
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![\p{L}0-9+/_=-])[A-Za-z]{8,}+(?![\p{L}0-9+/_=-])"), F.lit(0))
    ordinary = F.filter(words, lambda w: F.pmod(F.xxhash64(w), F.lit(ORDINARY)) == 0)
    both = F.concat(
        F.transform(random, lambda v: F.struct(v.alias("value"), F.lit(True).alias("random"))),
        F.transform(ordinary, lambda v: F.struct(v.alias("value"), F.lit(False).alias("random"))),
    )
    return picked.select(F.inline(both))


def train(samples: DataFrame) -> DataFrame:
    """One row with `ratios`: for each pair of characters log P(second | first) among random strings less that among ordinary ones.

    First-order Markov chains, one per label, from (value, random). A chain trusts a character's
    followers as far as it has seen it, and falls back to how often it has seen the second character at
    all (with the weight of BACKOFF pairs), so a character that is rare in ordinary strings speaks for
    random ones after whatever it comes. The pairs are counted in one pass and stored. The model has
    SYMBOLS * SYMBOLS numbers whatever the corpus.
    """
    pairs = stored(
        samples.filter("value is not null and random is not null")
        .select("random", F.explode(_steps(F.col("value"))).alias("pair"))
        .groupBy("pair")
        .agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    )
    place = F.col("pair") - 1
    known = pairs.select("pair", F.floor(place / SYMBOLS).alias("first"), F.pmod(place, F.lit(SYMBOLS)).alias("second"), "r", "o")
    firsts = known.groupBy("first").agg(F.sum("r").alias("fr"), F.sum("o").alias("fo"))
    seconds = known.groupBy("second").agg(F.sum("r").alias("sr"), F.sum("o").alias("so"))
    all_ = known.agg(F.sum("r").alias("tr"), F.sum("o").alias("to")).select(F.struct("tr", "to").alias("t")).scalar()
    every = samples.sparkSession.range(1, SYMBOLS * SYMBOLS + 1).withColumnRenamed("id", "pair")
    every = every.select("pair", F.floor(place / SYMBOLS).alias("first"), F.pmod(place, F.lit(SYMBOLS)).alias("second"), all_.alias("t"))
    joined = every.join(known.select("pair", "r", "o"), "pair", "left").join(firsts, "first", "left").join(seconds, "second", "left")

    def chance(label):
        n = lambda c: F.coalesce(F.col(c), F.lit(0))
        anywhere = (n(f"s{label}") + 1) / (n(f"t.t{label}") + SYMBOLS)
        return F.log((n(label) + BACKOFF * anywhere) / (n(f"f{label}") + BACKOFF))

    ratios = joined.agg(F.array_sort(F.collect_list(F.struct("pair", (chance("r") - chance("o")).alias("ratio")))).alias("all"))
    return ratios.select(F.transform("all", lambda x: x["ratio"]).alias("ratios"))


def score(text: Column, ratios: Column) -> Column:
    """Mean log-likelihood ratio per character pair; above 0 the random model fits better."""
    steps = _steps(text)
    total = F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.get(ratios, i - 1))
    return F.when(F.size(steps) > 0, total / F.size(steps)).otherwise(F.lit(0.0))


def find_secrets(docs: DataFrame, model: DataFrame | None = None, text_col: str = "text", level: float = LEVEL) -> DataFrame:
    """All rows with `base` and `spans`, arrays of (start, rank, end, kind) ordered by start.

    Base kinds are assign, access and hex. Kind `random` is a string of 16 characters or more out
    of letters, digits and +/_-, with a letter and a digit or capitals after small letters, whose mean log-likelihood ratio under
    `model` (see `train`; by default trained on the documents' own labelled strings) is at least
    `level`, and that no base span touches. Places are code points, the end exclusive.

    Null and empty texts have no spans. Repeated rows and null ids are rows like others; an empty
    table gives an empty result. Texts without any labelled string leave the models untrained, and
    nothing is added. Columns `base` and `spans` are replaced, all others kept.
    """
    if model is None:
        model = train(labelled_samples(docs, text_col))
    ratios = stored(model).select("ratios").scalar()
    text = F.col(text_col)
    found = docs.drop(*[c for c in ("base", "spans") if c != text_col]).select(
        "*",
        labelled(base_spans(text)).alias("base"),
        F.filter(
            matches(text, STRING), lambda s: (s["value"].rlike("[A-Za-z]") & s["value"].rlike("[0-9]")) | s["value"].rlike("[a-z][A-Z]")
        ).alias("__strings"),
        ratios.alias("__ratios"),
    )
    clear = F.filter(
        "__strings", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    )
    random = F.filter(clear, lambda s: score(s["value"], F.col("__ratios")) >= level)
    added = F.transform(
        random, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("rank"), s["end"].alias("end"), F.lit("random").alias("kind"))
    )
    return found.withColumn("spans", F.array_sort(F.concat("base", added))).drop("__strings", "__ratios")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, the hash of the base spans, and all spans as text."""
    counted = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long")
    return found.select(
        id_col,
        *[counted(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
