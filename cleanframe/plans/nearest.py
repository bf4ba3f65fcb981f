"""The nearest rows of another table, by the number of equal cells, at any width.

Values that more than LIGHT offered rows have are heavy, all others light. Rows that share a light cell
are met through an index of these cells and compared. Whatever a row does not meet there differs from it
in every light cell, so only heavy cells are left to agree. These get small numbers per column, which a
few 64-bit words hold side by side: one comparison of words tells in how many columns two rows agree.
From here on rows of equal heavy cells, a pattern, are one. For patterns that may still agree better

1. the columns are cut into parts, a few first, then twice as many. Who agrees in a part is in one list.
   Lists of up to LIGHT patterns are compared, of longer ones about as many, to know a good match early.
   A pattern not met in n whole lists differs in n places from all it did not meet;
2. what is still open could have d more cells in common: a better match then agrees in all of one of any
   d parts. So the d shortest lists of some cut are compared whole, block by block.

The cuts are chosen by a sample of patterns, so that all parts tell rows apart about as well, although
columns may hang together. They only balance the work: all steps are exact. The last one grows with the lists
that are compared, so tables that hold nothing but a few values in few columns are its worst case.

Tables are joined by sorting throughout. Stored cells unpack to many times the size of their files, and a
row per cell repeats them: by the sizes Spark expects it would send such tables through the driver.
Only lists of values and keys that were counted to be few go there.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.joins import attach
from ..operators.ordered import GROUP_ROWS
from ..sources import materialize

#: Rows with one value that are compared one by one.
LIGHT = 64
#: Patterns in a block.
BLOCK = 256
#: Rows of two numbers, or bytes of heavy values, that are counted first and then sent to all tasks.
FEW, FEW_BYTES = 200_000, 8_000_000
#: Patterns by which columns are cut into parts.
SAMPLE = 4096
#: Parts of the first cut, at most.
FIRST = 3
#: Bits of a word that are used.
BITS = 63

CELL = ["block", "part", "value"]


def _shared(a: Column, b: Column) -> Column:
    """Places at which two arrays have the same element; nulls don't count."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _sorted(table: DataFrame) -> DataFrame:
    """The table, to be joined by sorting and not by way of the driver."""
    return table.hint("merge")


def _few_or_sorted(stored: DataFrame) -> DataFrame:
    """A stored table of two numbers a row, to be joined."""
    return F.broadcast(stored) if stored.count() <= FEW else _sorted(stored)


@dataclass(frozen=True)
class Lane:
    """Where the words hold the number of a column's heavy value. The bit above it stays free."""

    part: int
    word: int
    at: int
    bits: int

    @property
    def low(self) -> int:
        return ((1 << self.bits) - 1) << self.at

    @property
    def high(self) -> int:
        return 1 << (self.at + self.bits)

    def number(self, words) -> int:
        return (words[self.word] & self.low) >> self.at


def _lanes(numbers: dict[int, int]) -> list[Lane]:
    """Places for columns of the given highest numbers, and for one number more."""
    lanes, word, at = [], 0, 0
    for part, highest in sorted(numbers.items()):
        bits = (highest + 1).bit_length()
        if at + bits + 1 > BITS:
            word, at = word + 1, 0
        lanes.append(Lane(part, word, at, bits))
        at += bits + 1
    return lanes


class Words:
    """The columns w0, w1, ... of heavy cells. A number of 0 is a cell that no other row shares."""

    def __init__(self, lanes: list[Lane]):
        self.lanes = lanes
        self.names = [f"w{j}" for j in range(1 + max((lane.word for lane in lanes), default=0))]

    def mask(self, j: int, bits: str, lanes: list[Lane] | None = None) -> Column:
        return F.lit(sum(getattr(lane, bits) for lane in (self.lanes if lanes is None else lanes) if lane.word == j)).cast("long")

    def _filled(self, j: int, word: Column) -> Column:
        """The bit above every lane that is not 0."""
        return (word + self.mask(j, "low")).bitwiseAND(self.mask(j, "high"))

    def live(self) -> Column:
        """How many cells are heavy."""
        return sum((F.bit_count(self._filled(j, F.col(w))) for j, w in enumerate(self.names)), F.lit(0)).cast("int")

    def is_live(self, lane: Lane) -> Column:
        return F.col(self.names[lane.word]).bitwiseAND(F.lit(lane.low).cast("long")) != 0

    def agree(self, other: str) -> Column:
        """In how many lanes the words and those named `other` + their name are equal."""
        apart = [F.bit_count(self._filled(j, F.col(w).bitwiseXOR(F.col(other + w)))) for j, w in enumerate(self.names)]
        return (F.lit(len(self.lanes)) - sum(apart, F.lit(0))).cast("int")

    def key(self, lanes: list[Lane], salt: str) -> Column:
        """One number for the cells of a part; two parts that share it by chance are only compared in vain."""
        used = sorted({lane.word for lane in lanes})
        return F.xxhash64(F.lit(salt), *[F.col(self.names[j]).bitwiseAND(self.mask(j, "low", lanes)) for j in used])

    def whole(self, lanes: list[Lane]) -> Column:
        """Whether all cells of a part are heavy."""
        out = F.lit(True)
        for j in sorted({lane.word for lane in lanes}):
            high = self.mask(j, "high", lanes)
            out = out & (self._filled(j, F.col(self.names[j])).bitwiseAND(high) == high)
        return out


def _dictionary(offered: DataFrame, light: int) -> tuple[DataFrame, Words, bool]:
    """Heavy cells with their number in their column, where the words hold these, and whether the cells are few."""
    listed = offered.select("block", F.posexplode("cells").alias("part", "value"))
    sizes = listed.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > light)
    number = F.row_number().over(Window.partitionBy("part").orderBy("block", "value")).cast("long")
    heavy = materialize(sizes.select(*CELL, number.alias("number")))
    size = F.sum(F.octet_length("value") + F.octet_length(F.to_json("block")) + 32).alias("size")
    numbers = heavy.groupBy("part").agg(F.max("number").alias("highest"), size).collect()
    return heavy, Words(_lanes({r.part: r.highest for r in numbers})), sum(r.size for r in numbers) <= FEW_BYTES


def _encoded(table: DataFrame, heavy: DataFrame, words: Words, few: bool, width: int, unshared: bool, group_rows: int) -> DataFrame:
    """The table with words, and with its `light` cells. With `unshared` light cells get a number of their own in
    the words, which differs from 0."""
    cells = table.select("id", "block", F.posexplode("cells").alias("part", "value"))
    if few:
        numbered = cells.join(F.broadcast(heavy), CELL)
    else:  # a value that many rows share must not be one task's work
        rows = cells.groupBy(*CELL).agg(F.count(F.lit(1)).alias("rows"))
        known = rows.join(_sorted(heavy), CELL, "left")
        numbered = attach(cells, known, CELL, "rows", group_rows, large=True).filter("number is not null")
    by_part = {lane.part: lane for lane in words.lanes}
    places = F.array(*[F.lit(by_part[i].at if i in by_part else 0) for i in range(width)])
    word = F.array(*[F.lit(by_part[i].word if i in by_part else 0) for i in range(width)])
    placed = numbered.select("id", F.get(word, F.col("part")).alias("word"), F.call_function("shiftleft", F.col("number"), F.get(places, F.col("part"))).alias("bits"))
    sums = placed.groupBy("id").agg(*[F.sum(F.when(F.col("word") == j, F.col("bits"))).alias(w) for j, w in enumerate(words.names)])
    out = table.join(_sorted(sums), "id", "left").withColumns({w: F.coalesce(w, F.lit(0).cast("long")) for w in words.names})
    is_light = F.array(*[~words.is_live(by_part[i]) if i in by_part else F.lit(True) for i in range(width)])
    named = F.transform("cells", lambda c, i: F.when(F.get(F.col("is_light"), i), F.concat(i.cast("string"), c)))
    out = out.withColumn("is_light", is_light).withColumn("light", F.filter(named, lambda c: c.isNotNull())).drop("cells", "is_light")
    if unshared:
        own = {
            w: sum((F.when(~words.is_live(x), F.lit(x.low).cast("long")).otherwise(0) for x in words.lanes if x.word == j), F.col(w))
            for j, w in enumerate(words.names)
        }
        out = out.withColumns(own)
    return materialize(out)


def _cut(sample: list, lanes: list[Lane], count: int) -> list[list[Lane]]:
    """The lanes in `count` parts that tell the sampled rows apart about equally well: the part that does it worst
    gets the lane that helps it most, whatever lanes have to do with one another."""
    values = {lane: [lane.number(row) for row in sample] for lane in lanes}
    parts, kinds = [[] for _ in range(count)], [[0] * len(sample) for _ in range(count)]
    alike = [len(sample) ** 2] * count
    left = list(lanes)
    while left:
        worst = max(range(count), key=lambda k: (alike[k], -len(parts[k])))
        tried = [(sum(n * n for n in Counter(zip(kinds[worst], values[lane])).values()), i) for i, lane in enumerate(left)]
        alike[worst], best = min(tried)
        lane = left.pop(best)
        parts[worst].append(lane)
        number: dict = {}
        kinds[worst] = [number.setdefault(kind, len(number)) for kind in zip(kinds[worst], values[lane])]
    return [part for part in parts if part]


def nearest(wanted: DataFrame, offered: DataFrame, width: int, light: int = LIGHT, block: int = BLOCK, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The wanted rows without `id`, `block` and `cells`, and `agree`: the most cells that some offered row of the same block shares.

    Both tables are stored and have distinct rows of `block` and `cells`, an array of `width` texts without
    nulls, with a number `id` of their own. Rows whose block is not offered agree in 0. Runs jobs: the patterns still
    open are stored between steps.
    """
    kept = [c for c in wanted.columns if c not in ("id", "block", "cells")]
    heavy, words, few = _dictionary(offered, light)
    names = words.names
    wanted = _encoded(wanted, heavy, words, few, width, False, group_rows)
    offered = _encoded(offered.select("id", "block", "cells"), heavy, words, few, width, True, group_rows)

    # the index of light cells
    asked = wanted.select("id", "block", *names, "light", F.explode("light").alias("cell"))
    listed = offered.select("block", *[F.col(w).alias(f"o_{w}") for w in names], F.col("light").alias("o_light"), F.explode("light").alias("cell"))
    both = words.agree("o_") + F.size(F.array_intersect("light", "o_light"))
    found = asked.join(_sorted(listed), ["block", "cell"]).groupBy("id").agg(F.max(both).alias("found"))
    bound = words.live()
    at_least = (bound > 0).cast("int")  # rows with a heavy value share it with some row
    rows = materialize(
        wanted.join(_sorted(found), "id", "left").select(*kept, *names, F.greatest(F.coalesce("found", F.lit(0)), at_least).alias("best"), bound.alias("bound"))
    )

    open_ = rows.filter("best < bound").groupBy(*names, "bound").agg(F.min("best").alias("best"))
    open_ = materialize(open_.select(F.monotonically_increasing_id().alias("pid"), "*"))
    live = [F.avg(words.is_live(lane).cast("int")).alias(f"l{i}") for i, lane in enumerate(words.lanes)]
    gap = F.percentile_approx(F.col("bound") - F.col("best"), 0.75).alias("gap")
    first = open_.agg(gap, *live).first()
    if first["gap"] is None:
        return rows.select(*kept, F.col("best").alias("agree"))
    some = [lane for i, lane in enumerate(words.lanes) if first[f"l{i}"] >= 0.75]
    others = materialize(offered.select(*names).distinct())
    sample = others.orderBy(F.xxhash64(*names)).limit(SAMPLE).collect()

    # lists of parts: fewer than a pattern's bound is above its best can't settle it, but in long ones good matches are found
    done, count = [], min(FIRST, int(first["gap"]))
    while 2 * count <= len(some):
        state = _looked_up(open_, others, words, _cut(sample, some, count), light, group_rows)
        done.append(open_ := materialize(state))
        open_ = open_.filter("best < bound")
        if open_.isEmpty():
            break
        count *= 2
    settled = [d.filter("best >= bound").select(*names, "best") for d in done]
    if not open_.isEmpty():
        settled.append(_in_blocks(open_, others, words, some, sample, block))
    known = settled[0]
    for part in settled[1:]:
        known = known.unionByName(part)
    known = known.withColumnRenamed("best", "known")
    return rows.join(_sorted(known), names, "left").select(*kept, F.greatest("best", F.coalesce("known", F.lit(0))).alias("agree"))


def _looked_up(open_: DataFrame, others: DataFrame, words: Words, parts: list[list[Lane]], light: int, group_rows: int) -> DataFrame:
    """The open patterns with what the lists of these parts tell of `best` and `bound`."""
    keys = [words.key(part, f"{k} of {len(parts)}") for k, part in enumerate(parts)]
    each = F.explode(F.array(*[F.struct(key.alias("key"), words.whole(part).alias("whole")) for key, part in zip(keys, parts)])).alias("x")
    asked = open_.select("pid", each).select("pid", "x.key", "x.whole")
    sizes = others.select(F.explode(F.array(*keys)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    known = materialize(asked.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).join(_sorted(sizes), "key", "left"))
    # a part that many patterns share must not be one task's work
    missed = attach(asked.filter("whole"), known, ["key"], "rows", group_rows, large=True).groupBy("pid").agg(
        F.count_if(F.coalesce("n", F.lit(0)) <= light).cast("int").alias("missed")
    )
    listed = others.select(*[F.col(w).alias(f"o_{w}") for w in words.names], F.explode(F.array(*keys)).alias("key"))
    sampled = F.pmod(F.xxhash64(*[f"o_{w}" for w in words.names]), F.ceil(F.col("n") / max(light, 1))) == 0
    listed = listed.join(_few_or_sorted(known.filter("n is not null").select("key", "n")), "key").filter((F.col("n") <= light) | sampled)
    pairs = open_.select("pid", *words.names, F.explode(F.array(*keys)).alias("key")).join(_sorted(listed), "key")
    found = pairs.groupBy("pid").agg(F.max(words.agree("o_")).alias("found"))
    return open_.join(_sorted(missed), "pid", "left").join(_sorted(found), "pid", "left").select(
        "pid",
        *words.names,
        F.greatest("best", F.coalesce("found", F.lit(0))).alias("best"),
        # an unmet pattern differs somewhere in each of the whole parts
        F.least("bound", words.live() - F.coalesce("missed", F.lit(0))).cast("int").alias("bound"),
    )


def _in_blocks(open_: DataFrame, others: DataFrame, words: Words, some: list[Lane], sample: list, block: int) -> DataFrame:
    """The words of the open patterns and `best`, the most cells another pattern shares or what was known."""
    names = words.names
    need = (words.live() - F.col("best")).alias("need")
    counts = open_.select(need).agg(F.percentile_approx("need", F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75, 1.0)])).alias("q")).first()["q"]
    cuts = [_cut(sample, some, count) for count in sorted(set(counts)) if count <= len(some) // 2]
    short = [sum((words.whole(part).cast("int") for part in cut), F.lit(0)) < F.col("need") for cut in cuts]
    if not open_.select("*", need).filter(F.forall(F.array(F.lit(True), *short), lambda x: x)).isEmpty():
        cuts.append([[lane] for lane in words.lanes])  # single cells serve any pattern
    parts = [(s, words.key(part, f"{k} of {len(cut)}"), words.whole(part)) for s, cut in enumerate(cuts) for k, part in enumerate(cut)]

    def listed(table, *columns):
        each = F.array(*[F.struct(F.lit(s).alias("cut"), F.when(whole, key).alias("key")) for s, key, whole in parts])
        return table.select(*columns, F.explode(each).alias("x")).select(*columns, "x.cut", "x.key").filter("key is not null")

    # another pattern that shares `need` cells less `need` - 1 at most has all cells of one of any `need` parts
    asked = listed(open_.select("pid", *names, need), "pid", "need")
    sizes = listed(others).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    counted = asked.join(_sorted(sizes), "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    shortest = F.slice(F.array_sort(F.collect_list(F.struct("n", "key"))), 1, F.col("need"))
    picked = counted.groupBy("pid", "need", "cut").agg(shortest.alias("lists")).filter(F.size("lists") >= F.col("need"))
    work = F.aggregate("lists", F.lit(0).cast("long"), lambda so_far, x: so_far + x["n"])
    chosen = picked.groupBy("pid").agg(F.min_by("lists", F.struct(work, F.size("lists"), "cut")).alias("lists"))
    chosen = materialize(chosen.select("pid", F.explode("lists").alias("x")).select("pid", "x.key", "x.n").filter("n > 0"))
    blocks = _few_or_sorted(chosen.select("key", F.ceil(F.col("n") / block).cast("long").alias("blocks")).distinct())
    number = F.pmod(F.xxhash64(*names), F.col("blocks")).alias("number")
    filled = listed(others, *names).join(blocks, "key").select("key", F.struct(*[F.col(w).alias(f"o_{w}") for w in names]).alias("other"), number)
    filled = filled.groupBy("key", "number").agg(F.collect_list("other").alias("others"))
    numbers = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block).cast("long") - 1)
    sent = open_.select("pid", *names).join(_sorted(chosen), "pid").select("pid", *names, "key", F.explode(numbers).alias("number"))
    pairs = sent.join(_sorted(filled), ["key", "number"]).select("pid", *names, F.explode("others").alias("other")).select("pid", *names, "other.*")
    best = pairs.groupBy("pid").agg(F.max(words.agree("o_")).alias("found"))
    return open_.join(_sorted(best), "pid", "left").select(*names, F.greatest("best", F.coalesce("found", F.lit(0))).alias("best"))
