"""Personal data in text: patterns propose, checksums confirm, context words adjust the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .spans import matches

# The patterns of the base kinds, written so that a run of one class is read once:
# a match begins at the run's head or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+)(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: Words that speak for a kind when they stand near.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer", "sepa"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
#: Words that speak against any kind when they stand near.
AGAINST = ("example", "sample", "dummy", "version", "isbn")
#: How many characters before and after a span are near.
NEAR = 40
#: Score that a pattern alone, a checksum, a word for and a word against give.
PATTERN, CHECKSUM, FOR, NOT = {"email": 0.6, "ip": 0.5, "card": 0.3, "phone": 0.5, "iban": 0.3, "ssn": 0.3}, 0.4, 0.3, -0.3
#: Spans of the added kinds (iban, ssn) need this score.
LEVEL = 0.6
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn sum of a text of digits is a multiple of ten."""
    cells = F.reverse(F.split(digits, ""))
    doubled = lambda c: F.when(c > 4, c * 2 - 9).otherwise(c * 2)
    return (
        F.aggregate(
            F.transform(cells, lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))),
            F.lit(0),
            lambda acc, c: acc + c,
        )
        % 10
        == 0
    )


def mod97(value: Column) -> Column:
    """ISO 13616: the first four characters moved to the end, letters as 10 to 35, give 1 modulo 97."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")
    one = lambda acc, c: F.when(c.between("0", "9"), acc * 10 + F.ascii(c) - 48).otherwise(
        acc * 100 + F.ascii(c) - 55
    )
    return F.length(plain).between(15, 34) & (F.aggregate(turned, F.lit(0), lambda acc, c: (one(acc, c) % 97).cast("int")) == 1)


def _confirmed(text: Column) -> list[tuple[str, Column]]:
    """Spans of each kind that their own check confirms."""
    n = lambda s: F.length(_digits(s["value"]))
    plain = lambda p: F.ltrim(p, F.lit("0"))
    part = lambda p: (F.length(plain(p)) <= 3) & (F.lpad(plain(p), 3, "0").cast("int") <= 255)
    return [
        ("email", matches(text, EMAIL)),
        ("ip", F.filter(matches(text, IP), lambda s: F.forall(F.split(s["value"], r"\."), part))),
        ("card", F.filter(F.filter(matches(text, CARD), lambda s: n(s).between(12, 19)), lambda s: luhn(_digits(s["value"])))),
        ("phone", F.filter(matches(text, PHONE), lambda s: n(s).between(9, 15))),
        ("iban", F.filter(matches(text, IBAN), lambda s: mod97(s["value"]))),
        ("ssn", F.filter(matches(text, SSN), lambda s: ~s["value"].rlike("^(000|666|9)|-00-|0000$"))),
    ]


def _scored(text: Column, kind: str, spans: Column) -> Column:
    """Adds the score: pattern and checksum, more for words of the kind near it, less for others."""
    own = PATTERN[kind] + (CHECKSUM if kind in ("card", "iban") else 0.0)
    words = lambda some: r"(?i)(?<![A-Za-z])(" + "|".join(some) + r")(?![A-Za-z])"

    def one(s: Column) -> Column:
        near = F.concat(
            F.substring(text, F.greatest(s["start"] - NEAR, F.lit(0)) + 1, F.least(s["start"], F.lit(NEAR))),
            F.lit(" "),
            F.substring(text, s["end"] + 1, F.lit(NEAR)),
        )
        total = (
            F.lit(own)
            + F.when(near.rlike(words(CONTEXT[kind])), F.lit(FOR)).otherwise(F.lit(0.0))
            + F.when(near.rlike(words(AGAINST)), F.lit(NOT)).otherwise(F.lit(0.0))
        )
        return F.struct(
            s["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 2).alias("score"),
        )

    return F.transform(spans, one)


def find_pii(docs: DataFrame, text_col: str = "text", level: float = LEVEL) -> DataFrame:
    """All rows with `base` and `spans`, arrays of (start, rank, end, kind, score) ordered by start.

    Base kinds are email, ip, card (Luhn) and phone; all their confirmed spans stay, whatever
    their score. iban (mod-97) and ssn are added where the score reaches `level`: a pattern gives
    some of it, a checksum more, words of the kind near the span more, words that speak of
    examples less. Places are code points, the end exclusive.

    Null and empty texts have no spans. Repeated rows and null ids are rows like others; an empty
    table gives an empty result. Columns `base` and `spans` are replaced, all others kept.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = docs.drop(*[c for c in ("base", "spans") if c != text_col])
    found = kept.select("*", *[spans.alias(f"__{kind}") for kind, spans in _confirmed(text)])
    scored = found.withColumns({f"__{kind}": _scored(text, kind, F.col(f"__{kind}")) for kind in KINDS})
    added = [F.filter(f"__{kind}", lambda s: s["score"] >= level) for kind in KINDS[4:]]
    both = scored.select(
        "*",
        F.array_sort(F.concat(*[F.col(f"__{kind}") for kind in BASE])).alias("base"),
        F.concat(*added).alias("__added"),
    )
    return both.withColumn("spans", F.array_sort(F.concat("base", "__added"))).drop("__added", *[f"__{kind}" for kind in KINDS])
