"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Each document has a size (words) and a fixed hash. A source's target is a share of all words; a document is
taken whole as many times as its source needs (floor of target over size of the source), and the rest of the
target is the budget of one more copy, given to the documents with the smallest hashes. The threshold is
found without sorting: sizes are summed by source and hash bucket, running sums find the bucket that holds
the budget, and only that bucket is split again by the next bits of the hash. After three levels the documents
of one hash value share what is left of the budget in proportion to their sizes.

The text is read once; what follows works on a written table of (keys, source, size, hash).

Cases: a null source is a source of its own, last in order; null and empty texts have size 0 and take 0;
repeated rows have equal hashes and are treated alike; very long texts count whole; an empty table gives an empty
result; mixed() gives all columns back whatever their names, mix() keeps the key columns, none of which may be named
like one of its outputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, word_count

#: Bits of each level's hash bucket; the last level takes the rest of the 60 bits.
BITS = 12
HASH_BITS = 60

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3


def stable_hash(*columns: Column) -> Column:
    """60 bits of an MD5 over the columns' text: the same on any engine and run."""
    text = F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size): weighted shares of all sizes, capped at most * size.

    What a cap cuts off is shared again by weight among the rest. The capped sources are those with the smallest
    caps for their weight, so one running sum over the sources in that order finds the level at which all others
    stop. One row a source goes through the window.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    repeat = F.array(*map(F.lit, weights))
    per = per.withColumn("weight", F.get(repeat, ((F.row_number().over(order) - 1) % len(weights)).cast("int")).cast("long"))
    per = per.withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "*",
        F.sum("source_size").over(everything).alias("_all"),
        F.sum("weight").over(everything).alias("_weights"),
        F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)).alias("_capped"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("_capped_weights"),
    )
    per = per.withColumn("_level", (F.col("_all") - F.col("_capped")) / (F.col("_weights") - F.col("_capped_weights")))
    # The level is the first one that its own source doesn't stop; if every source stops, no level is needed.
    level = F.min(F.when(F.col("_level") <= F.col("ratio"), F.struct("ratio", "_level"))).over(everything)["_level"]
    per = per.withColumn("_final", level)
    cap = (most * F.col("source_size")).cast("double")
    target = F.when(F.col("_final").isNull(), cap).otherwise(F.least(cap, F.col("weight") * F.col("_final")))
    return per.select("source", "source_size", target.alias("target"))


def _boundary(cells: DataFrame, budget: str) -> DataFrame:
    """From (source, budget, bucket, words): for each source the bucket that holds the budget, and the words before it."""
    run = Window.partitionBy("source").orderBy("bucket")
    upto = cells.withColumn("_upto", F.sum("words").over(run))
    return (
        upto.filter(F.col("_upto") > F.col(budget))
        .groupBy("source")
        .agg(F.min(F.struct("bucket", (F.col("_upto") - F.col("words")).alias("before"), F.col("words").alias("inside"))).alias("b"))
        .select("source", F.col("b.bucket").alias("bucket"), F.col("b.before").alias("before"), F.col("b.inside").alias("inside"))
    )


def measured(docs: DataFrame, keys: list[str], source: str = "source", text: str = "text") -> DataFrame:
    """The keys with _source, _size and _hash, which all decisions rest on."""
    return docs.select(*keys, F.col(source).alias("_source"), word_count(F.col(text)).alias("_size"), stable_hash(*(F.col(k) for k in keys)).alias("_hash"))


def plan(base: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """A row for each source of base (source, size, hash): its target, whole copies and the threshold of one more."""
    goal = targets(base.select("source", "size"), weights, most)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = durable(goal.withColumn("budget", F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")), "mix-goal")

    same = F.col("source").eqNullSafe(F.col("_s"))
    left_of = goal.select(F.col("source").alias("_s"), F.col("budget").alias("left"))
    cells = base.groupBy("source", F.shiftright("hash", HASH_BITS - BITS).alias("bucket")).agg(F.sum("size").alias("words"))
    one = _boundary(cells.join(left_of, same).drop("_s"), "left")
    known = one.join(left_of, same).select("source", "bucket", (F.col("left") - F.col("before")).alias("left"))

    def refine(known: DataFrame, shift: int, bits: int) -> DataFrame:
        """Split each source's boundary bucket by the next bits of the hash."""
        outer = known.withColumnRenamed("source", "_s")
        inside = base.join(outer, same & (F.shiftright("hash", shift + bits) == F.col("bucket")))
        cells = inside.groupBy("source", "left", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        return _boundary(cells, "left").join(outer.select("_s", "left"), same).select("source", "bucket", (F.col("left") - F.col("before")).alias("left"), "inside")

    two = refine(known, HASH_BITS - 2 * BITS, BITS).drop("inside")
    three = refine(two, 0, HASH_BITS - 2 * BITS)
    found = three.select(F.col("source").alias("_s"), F.col("bucket").alias("threshold"), F.col("left").alias("rest"), "inside")
    return durable(goal.join(found, same, "left").drop("_s"), "mix-plan")


def decided(rows: DataFrame, made: DataFrame) -> DataFrame:
    """rows with _source, _size and _hash, and source_size, target, copies, extra and taken of their source's plan."""
    plans = made.withColumnRenamed("source", "_s")
    # A source without a threshold has its budget used up exactly by all or by none of its words.
    below = F.when(F.col("threshold").isNull(), F.when(F.col("budget") > 0, F.col("_size")).otherwise(0))
    at = F.when(F.col("_hash") == F.col("threshold"), F.floor(F.col("rest") * F.col("_size") / F.col("inside")).cast("long"))
    extra = F.coalesce(below, at, F.when(F.col("_hash") < F.col("threshold"), F.col("_size")).otherwise(0)).cast("long")
    out = rows.join(plans, F.col("_source").eqNullSafe(F.col("_s")))
    added = {"copies": F.col("whole"), "extra": extra, "taken": F.col("whole") * F.col("_size") + extra}
    return out.withColumns(added).drop("_s", "whole", "budget", "threshold", "rest", "inside")


def mix(docs: DataFrame, keys: list[str], source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(keys..., source, size, source_size, target, copies, extra, taken) for each row of docs.

    copies: whole copies; extra: words of one more copy, usually 0 or the size; taken: copies * size + extra.
    """
    rows = durable(measured(docs, keys, source, text), "mix")
    made = plan(rows.select(F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_hash").alias("hash")), weights, most)
    return decided(rows, made).select(*keys, F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", "copies", "extra", "taken")


def mixed(docs: DataFrame, keys: list[str], source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """docs as the mix takes them: each row as often as it is taken whole; a last part counts if it is half of the text or more.

    The rows travel as one struct, so columns of any name come out as they went in."""
    own = {"_source": F.col(source), "_size": word_count(F.col(text)), "_hash": stable_hash(*(F.col(k) for k in keys))}
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *(c.alias(n) for n, c in own.items()))
    base = durable(rows.select(F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_hash").alias("hash")), "mix")
    times = F.col("copies") + F.when((F.col("_size") > 0) & (2 * F.col("extra") >= F.col("_size")), 1).otherwise(0)
    out = decided(rows, plan(base, weights, most)).filter(times > 0)
    return out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long")))).select("_row.*")
