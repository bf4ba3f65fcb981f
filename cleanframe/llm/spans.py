"""Places of pattern matches in whole texts, with Spark's own expressions.

Spark gives the texts of matches but not their places. The gaps between matches (split) and the
matches (regexp_extract_all) come from the same scan, leftmost first and without overlap, so that
adding up their lengths places every match in code points. The sums along one text's matches are made
inside the row, by doubling: in each of log(n) rounds every place adds the sum of as many lengths before
it as it has added already. Nothing is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cleanframe.functions.values import once


def _running_sums(lengths: Column) -> Column:
    """The sum of each element and all before it, in O(n log n)."""
    reach = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda p: p < F.size(lengths))
    return F.aggregate(reach, lengths, lambda sums, p: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - p), F.lit(0))))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of all matches; null text has none. No match may be empty."""
    text = F.coalesce(text, F.lit(""))
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "array<struct<start:int,end:int,value:string>>"

    def placed(pairs: Column) -> Column:
        sums = once(F.transform(pairs, lambda p: p["gap"] + p["own"]), _running_sums)
        spans = F.zip_with(
            pairs, sums, lambda p, end: F.struct((end - p["own"]).alias("start"), end.alias("end"), p["value"].alias("value"))
        )
        return F.slice(spans, 1, F.size(spans) - 1)  # behind the last gap there is no match

    pairs = F.zip_with(
        gaps,
        found,
        lambda gap, value: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(value), F.lit(0)).alias("own"), value.alias("value")),
    )
    return F.when(F.size(found) == 0, F.array().cast(kind)).otherwise(once(pairs, placed).cast(kind))


def labelled(kinds: list[tuple[str, Column]]) -> Column:
    """One array of all spans, ordered by start, then by the order of the kinds given."""
    each = [_named(spans, rank, kind) for rank, (kind, spans) in enumerate(kinds)]
    return F.array_sort(F.concat(*each))


def _named(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")),
    )


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
