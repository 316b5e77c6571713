"""Order-aware relational helpers: input order is a column, never a partition's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill import scratch


#: Places of chosen rows that may be broadcast as a bitmap: 16 bits each, so 40 MB of words at most.
PLACES = 10_000_000
_BITS_A_PLACE = 16
#: Rows of a range, and ranges or groups of ranges whose sums are added up in one task.
ROWS_A_RANGE, SUMS = 1 << 20, 1 << 10


def at_places(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is in chosen (a table of distinct keys and other columns), with its columns.

    A bitmap of the hashes of the chosen keys is applied in df's scan, so that of the rows that were not chosen only one in
    sixteen is shuffled for the exact join. With more than PLACES keys all rows meet in the join.
    """
    n = chosen.count()
    if n <= PLACES:
        bits = 1 << max(10, (n * _BITS_A_PLACE - 1).bit_length())
        at = F.pmod(F.xxhash64(key), F.lit(bits))
        words = chosen.select(F.shiftright(at, 6).alias("word_"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int")).alias("bit_")).groupBy("word_").agg(F.bit_or("bit_").alias("bits_"))
        marked = df.withColumn("at_", at).withColumn("word_", F.shiftright("at_", 6)).join(F.broadcast(words), "word_")
        df = marked.where(F.getbit("bits_", F.col("at_") % 64) == 1).select(*df.columns)
    return df.join(chosen, key)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by the order, which is unique within a key: places are compared, and only the rows that won are shuffled whole."""
    won = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("first_")).select(F.struct(*keys, *(F.col(f"first_.{c}").alias(c) for c in order)).alias("place_"))
    return at_places(df.withColumn("place_", F.struct(*keys, *order)), scratch.write(won, "first"), "place_").drop("place_")


def last_value_per_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value of the last row by the order): partial aggregation, no sort."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))


def without_ids(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """df minus the keys of done; null keys stay."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def head(df: DataFrame, n: int, order: list) -> DataFrame:
    return df.orderBy(*order).limit(n)


def shard_of(df: DataFrame, parts: int, *order: str) -> DataFrame:
    """Adds shard: contiguous near-equal shares of the rows by order, the first ones a row larger."""
    ranked, n = _ranked(df, order)
    p = min(parts, max(n, 1))
    small, extra = divmod(n, p)
    edge, place = extra * (small + 1), F.col("rank") - 1
    return ranked.withColumn("shard", F.when(place < edge, F.floor(place / (small + 1))).otherwise(extra + F.floor((place - edge) / max(small, 1))).cast("bigint"))


def rank(df: DataFrame, *order: str) -> DataFrame:
    """Adds rank, 1 for the first row by order (columns of any orderable type; rows that tie are in any order): no window over all rows.

    Rows are written once in ranges of the order, each with its number in its range, so all that reads them later sees the
    same ranges; there are as many ranges as the rows need. Their counts are added up in a tree, and each range begins behind the ones before it.
    """
    return _ranked(df, order)[0]


def _ranked(df: DataFrame, order: tuple) -> tuple[DataFrame, int]:
    n = df.count()
    ranges = max(1, -(-n // ROWS_A_RANGE))
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # its number in its partition
    table = scratch.write(dealt.withColumns({"part_": F.spark_partition_id().cast("bigint"), "own_": own}), "ranks")
    before = starts(table.groupBy("part_").agg(F.count(F.lit(1)).alias("n_")), ranges)
    before = F.broadcast(before) if ranges <= SUMS**2 else before
    return table.join(before, "part_").withColumn("rank", F.col("own_") + F.col("before_") + 1).drop("part_", "own_", "before_"), n


def starts(counts: DataFrame, parts: int) -> DataFrame:
    """(part_, before_): the sum of n_ over all smaller part_ (0 to parts - 1), by groups of SUMS parts and groups of groups."""
    ahead = lambda w: F.coalesce(F.sum("n_").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if parts <= SUMS:
        return counts.select("part_", ahead(Window.orderBy("part_")).alias("before_"))
    grouped = counts.withColumn("group_", F.floor(F.col("part_") / SUMS).cast("bigint"))
    above = starts(grouped.groupBy(F.col("group_").alias("part_")).agg(F.sum("n_").alias("n_")), -(-parts // SUMS))
    within = grouped.select("part_", "group_", ahead(Window.partitionBy("group_").orderBy("part_")).alias("in_"))
    return within.join(above.select(F.col("part_").alias("group_"), "before_"), "group_").select("part_", (F.col("in_") + F.col("before_")).alias("before_"))


def batch_of(place: Column, size: int) -> Column:
    return F.floor(place / size).cast("bigint")


def fan_out(prompts: DataFrame, completions: DataFrame, group: int) -> DataFrame:
    """completions (ord from 0, grouped by prompt) with the columns of their prompt (ord): the counts must be in the ratio group.

    A mismatch is an error raised by the plan.
    """
    counts = prompts.agg(F.count(F.lit(1)).alias("m_")).crossJoin(completions.agg(F.count(F.lit(1)).alias("n_")))
    checked = counts.select(F.assert_true(F.col("n_") == F.col("m_") * group, F.concat(F.lit("length mismatch: "), "n_", F.lit(" completions, "), "m_", F.lit(" prompts"))).isNull().alias("fits_"))
    placed = completions.withColumn("prompt_ord", F.floor(F.col("ord") / group).cast("bigint"))
    return placed.join(prompts.withColumnRenamed("ord", "prompt_ord"), "prompt_ord").crossJoin(F.broadcast(checked)).where("fits_").drop("fits_")


def zip_rows(left: DataFrame, right: DataFrame, order: str, other_order: str) -> DataFrame:
    """Row i of left by its order with row i of right by its order, as rank; the longer side's rest is cut off."""
    return rank(left, order).join(rank(right, other_order), "rank")
