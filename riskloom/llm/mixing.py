"""Mix documents so that each source takes its target number of words.

Pareto order sampling: a document whose expected number of copies is e gets floor(e) whole
copies for certain; with p = e - floor(e) and a fixed uniform number u of the document, the
further copies go to the documents of least [u / (1 - u)] / [p / (1 - p)] of their source,
as many as bring the source to its target. Within a source e follows a weight of the document, such
as the ``variety`` of its text: level * weight, at most three copies, where the level is
the one at which the expected words of the source add up to its target.

The order is cut without sorting a source in one task: odds are ranked as fixed-point
numbers, ten bits at a time; each step sums words per (source, digit) and goes on with the
rows of the one digit in which the target falls. What is taken is told by one row per
source: the ranks of its cuts. Past a document that does not fit the order goes on with
those that do, until none does; the gap that is left goes to the smallest document of the
rest if that brings the source nearer to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.tables import with_position
from riskloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
DIGITS = 3
#: Weights are taken in steps of a 64th, so that a source has 64 different ones at most.
WEIGHT_STEPS = 64


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def variety(text: Column) -> Column:
    """Share of a text's words that are different, from above 0 to 1: repetitive texts weigh less."""
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.coalesce(F.try_divide(F.size(F.array_distinct(found)), F.size(found)), F.lit(1.0))


def _levels(rows: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(_source, level): level * weight, at most ``most``, times size adds up to the target.

    Rows are summed per (source, weight) first. By falling weight, a class is capped if it
    would get more than ``most`` copies once those above it have theirs; the first class that
    is not sets the level. Null where all are capped.
    """
    classes = materialize(rows.groupBy("source", "weight").agg(F.sum("size").alias("words")), "classes")
    above = Window.partitionBy("source").orderBy(F.col("weight").desc()).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("source").orderBy("weight").rowsBetween(Window.unboundedPreceding, 0)
    classes = classes.withColumn("capped", F.coalesce(F.sum("words").over(above), F.lit(0)) * most) \
        .withColumn("weighed", F.sum(F.col("words") * F.col("weight")).over(below))
    targets = targets.select(F.col("source").alias("_source"), "target")
    joined = classes.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    joined = joined.withColumn("level", F.try_divide(F.col("target") - F.col("capped"), F.col("weighed")))
    first = F.max_by(F.when(F.col("level") * F.col("weight") <= most, F.col("level")), F.when(F.col("level") * F.col("weight") <= most, F.col("weight")))
    return joined.groupBy("_source").agg(first.alias("level"))


def uniform(key: Column) -> Column:
    """A fixed number in (0, 1) from the digest of ``key``, a multiple of 2**-52 shifted by half."""
    digits = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double")
    return (digits + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """Targets of sources from (source, source_size): weights 1, 2, 3, repeating by code point.

    Shares add up to all sizes; a target stops at ``most`` times its source's size and the
    excess is shared again by weight until none is above. Returns source, source_size,
    target. One row is held per source; rounds add up one row each.
    """
    ranked = with_position(sizes, [F.col("source").asc_nulls_last()])
    ranked = materialize(ranked.withColumn("weight", F.col("position") % 3 + 1).drop("position"), "sources")
    cap = F.col("source_size") * F.lit(most).cast("double")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, settled = None, -1
    while True:
        reached = F.lit(False) if level is None else (cap <= F.col("weight") * F.lit(level))
        row = ranked.agg(F.sum(F.when(reached, cap)).alias("fixed"), F.sum(F.when(~reached, F.col("weight"))).alias("open"),
                         F.count(F.when(reached, 1)).alias("n")).first()
        if row["n"] == settled or not row["open"]:
            break
        settled, level = row["n"], (total - (row["fixed"] or 0.0)) / row["open"]
    share = cap if level is None else F.least(cap, F.col("weight") * F.lit(level))
    return ranked.select("source", "source_size", share.alias("target"))


def _cut(rows: DataFrame, room: DataFrame) -> DataFrame:
    """Where the order of odds exhausts the room of each source.

    From rows (source, size, rank) and room (_source, room): _source, _rank and _left. Rows
    below _rank fit; of those at it, as many as _left words hold. A source whose rows all
    fit has no cut.
    """
    cut = room.select("_source", F.lit(0).cast("long").alias("_rank"), F.col("room").alias("_left"))
    for i in range(DIGITS):
        shift = 10 * (DIGITS - 1 - i)
        inside = rows.join(cut, F.col("source").eqNullSafe(F.col("_source"))).where(F.shiftright("rank", shift + 10) == F.col("_rank"))
        sums = inside.groupBy("source", F.shiftright("rank", shift).alias("digit")).agg(F.sum("size").alias("words"), F.first("_left").alias("left"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        over = sums.withColumn("upto", upto).where("upto > left")
        least = F.min(F.struct("digit", (F.col("left") - F.col("upto") + F.col("words")).alias("left")))
        cut = over.groupBy("source").agg(least.alias("c"))
        cut = materialize(cut.select(F.col("source").alias("_source"), F.col("c.digit").alias("_rank"), F.col("c.left").alias("_left")), "cut")
    return cut


def _taken(rows: DataFrame, room: DataFrame) -> DataFrame:
    """A row per source that says which rows (source, size, key, copy, rank) are taken:
    _source, _cuts and _filled (see ``_is_taken``) and gap (words that are missing).

    Each pass takes the order of the rest up to the document that does not fit, among
    those of at most the gap's size, and so at least one document of each source that has any.
    """
    own = F.col("source").eqNullSafe(F.col("_source"))
    same = F.col("_source").eqNullSafe(F.col("_s"))
    cuts = F.array().cast("array<struct<most:long,rank:long,last:struct<key:string,copy:int>>>")
    filled = F.array().cast("array<struct<key:string,copy:int>>")
    state = room.select("_source", cuts.alias("_cuts"), filled.alias("_filled"), F.col("room").cast("long").alias("gap"))
    state = materialize(state, "state")
    while True:
        free = rows.join(state, own).where(~_is_taken() & (F.col("size") <= F.col("gap"))).select(rows.columns)
        free = materialize(free, "free")
        if free.isEmpty():
            break
        cut = _cut(free, state.select("_source", F.col("gap").alias("room")))
        at = free.join(cut, own & (F.col("rank") == F.col("_rank")))
        order = Window.partitionBy("source").orderBy("key", "copy").rowsBetween(Window.unboundedPreceding, 0)
        fits = at.withColumn("upto", F.sum("size").over(order)).where(F.col("upto") <= F.col("_left"))
        last = fits.groupBy(F.col("source").alias("_s")).agg(F.max(F.struct("key", "copy")).alias("_last"))
        ends = state.join(cut.select(F.col("_source").alias("_s"), "_rank"), same, "left").drop("_s").join(last, same, "left").drop("_s")
        one = F.struct(F.col("gap").alias("most"), F.col("_rank").alias("rank"), F.col("_last").alias("last"))
        ends = materialize(ends.select("_source", F.concat("_cuts", F.array(one)).alias("_cuts"), "_filled", "gap"), "cuts")
        used = free.join(ends, own).where(_is_taken()).groupBy(F.col("source").alias("_s")).agg(F.sum("size").alias("used"))
        state = ends.join(used, same, "left").select("_source", "_cuts", "_filled", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"))
        state = materialize(state, "gaps")
    free = rows.join(state, own).where(~_is_taken() & (F.col("size") < 2 * F.col("gap")))
    nearest = F.min(F.struct("size", "rank", "key", "copy"))
    best = free.groupBy(F.col("source").alias("_s")).agg(nearest.alias("b"))
    state = state.join(best, same, "left").select(
        "_source", "_cuts", F.when(F.col("b").isNull(), F.col("_filled")).otherwise(F.array(F.struct("b.key", "b.copy"))).alias("_filled"),
        (F.col("gap") - F.coalesce("b.size", F.lit(0))).alias("gap"))
    return materialize(state, "filled")


def _is_taken() -> Column:
    """Whether a row joined with its source's state is before the cut of a pass, or fills the gap."""
    def before(c: Column) -> Column:
        at_cut = (F.col("rank") == c["rank"]) & (F.struct("key", "copy") <= c["last"])
        return (F.col("size") <= c["most"]) & (c["rank"].isNull() | (F.col("rank") < c["rank"]) | F.coalesce(at_cut, F.lit(False)))

    filled = F.exists("_filled", lambda f: (f["key"] == F.col("key")) & (f["copy"] == F.col("copy")))
    return F.exists("_cuts", before) | filled


def mix(docs: DataFrame, weight: Column | None = None, most: int = MOST) -> DataFrame:
    """Copies that each document has in the mix.

    Takes doc_id, text and source; ``weight`` is a relative number of expected copies
    within a source, from 0 to 1 in steps of a 64th, one at least (default: equal; null:
    1). Returns a row per input row: doc_id, source, size, source_size, target, expected
    (copies, 0 for size 0), copies, taken (= copies * size).

    Null or empty text has size 0 and is not taken; a null source is a source of its own;
    rows without doc_id and repeated rows are documents of their own, told apart by their
    text's digest and, where that is equal too, by a running number. Ties of odds go by
    that number. An empty table gives an empty result. No row has more than ``most``
    copies; what a capped document loses goes to the others of its source.
    """
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.md5("text"), F.lit("")))
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"), key.alias("key"),
                       (F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(1.0))).alias("weight"))
    step = F.floor(F.col("weight") * WEIGHT_STEPS + 0.5)
    rows = materialize(rows.withColumn("weight", F.greatest(F.lit(1), F.least(F.lit(WEIGHT_STEPS), step)).cast("long")), "sizes")
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source_sizes")
    repeated = materialize(rows.groupBy("key").count().where("count > 1").select("key"), "repeated")
    copy = F.row_number().over(Window.partitionBy("key").orderBy("source", "size"))
    again = rows.join(repeated, "key", "left_semi").withColumn("copy", copy)
    rows = rows.join(repeated, "key", "left_anti").withColumn("copy", F.lit(1)).unionByName(again)
    rows = rows.withColumn("u", uniform(F.concat_ws("#", "key", "copy")))
    targets = materialize(source_targets(sizes, most), "targets")
    levels = _levels(rows, targets, most)
    same = F.col("source").eqNullSafe(F.col("_source"))
    per_source = materialize(targets.join(levels, same).drop("_source"), "levels").withColumnRenamed("source", "_source")
    rows = rows.join(per_source, same).drop("_source")
    level = F.when(F.col("level").isNull(), F.lit(float(most))).otherwise(F.col("level") * F.col("weight"))
    expected = F.when(F.col("size") > 0, F.least(F.lit(float(most)), level)).otherwise(0.0)
    rows = rows.withColumn("expected", expected).withColumn("whole", F.floor("expected")).withColumn("p", F.col("expected") - F.col("whole"))
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))
    top = 1 << 10 * DIGITS
    rank = F.least(F.floor((1 - 1 / (1 + odds)) * float(top)).cast("long"), F.lit(top - 1))
    open_row = (F.col("p") > 0) & (F.col("size") > 0)
    rows = materialize(rows.withColumn("rank", F.when(open_row, rank)), "ranked")
    certain = rows.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("_certain"), F.max("target").alias("_target"))
    room = certain.select(F.col("source").alias("_source"), (F.floor(F.col("_target") + 0.5) - F.col("_certain")).alias("room"))
    state = _taken(rows.where("rank is not null").select("source", "size", "key", "copy", "rank"), materialize(room, "room"))
    rows = rows.join(state, F.col("source").eqNullSafe(F.col("_source")))
    extra = F.when(F.col("rank").isNotNull() & _is_taken(), 1).otherwise(0)
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(0).cast("int"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "expected", "copies", (F.col("copies") * F.col("size")).alias("taken"), "key")


def mixed(docs: DataFrame, most: int = MOST, weight: Column | None = None) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns."""
    plan = mix(docs, weight, most).where("copies > 0").groupBy("key").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    plan = materialize(plan, "plan").withColumnRenamed("key", "_key")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.md5("text"), F.lit("")))
    out = docs.withColumn("_key", key).join(plan, "_key")
    once = out.where("_rows = 1").unionByName(out.where("_rows > 1").dropDuplicates(["_key"]))
    return once.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)
