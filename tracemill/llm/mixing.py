"""Operator 3, mixing sources to target weights: pivotal dependent rounding of copy numbers.

Sources in order of code points, null last, weigh 5, 2, 1, repeating, and share all
words of the corpus; a target stops at ``MOST`` times its source's words and the
excess is shared again by weight. So target = min(MOST * size, level * weight) with
one level for all, found from the running sums over the sources in order of
MOST * size / weight. Each document of a source has the same copy number target /
source size: its whole part is taken for certain, and the fractional parts are
rounded by pivotal steps that keep the source's words: a fractional document gives
words to others, or gets them, in a random direction with the odds that keep all
expectations, until it is integral. The largest come first, so that what is left
open, by which the taken words miss the target, is a small document.

Documents of a source are dealt to buckets of about ``BUCKET`` by a hash of the id;
each bucket leaves at most one fractional document, and these residuals are combined
``FAN`` buckets at a time, level by level; the last one is rounded at random. All
draws are hashes of ids and ``SEED``: reruns agree, whatever the partitions.

Null texts have size 0; documents of size 0, and sources without words, take 0.
Repeated rows (equal in all columns that are kept) are counted first and numbered then, and are rounded as
documents of their own, each with its own draws, so neither they nor null ids meet in one bucket; ties in size go by the
draws. Columns named source_size, target, copies or taken are replaced by those of the mix, all others stay.
Texts of any length are counted whole; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, cut, flat, mix, pieces, table, words

WEIGHTS = (5, 2, 1)
MOST = 3
BUCKET = 256
FAN = 64
SEED = 20_240_607
#: So many sources at most are sent to all tasks.
SOURCES = 100_000


def sizes(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep (without text) and size, the number of words."""
    from pyspark.sql.types import LongType, StructField, StructType

    def run(batches):
        for batch in pieces(batches):
            data, off = flat(column(batch, "text"))
            n = np.bincount(words(data, off)[2], minlength=len(off) - 1)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), pa.array(n, pa.int64())], [*keep, "size"])

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, StructType([*(docs.schema[c] for c in keep), StructField("size", LongType())]))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n, target): one row for each source; windows here run over sources, not documents."""
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = each.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumn("weight", F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights)))))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    running = weighed.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("source_size").over(by_ratio), F.lit(0)).alias("size_below"),
        F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)).alias("weight_below"),
    )
    # were all sources below this one stopped and no other: the level that shares out the rest
    level = (F.col("total") - most * F.col("size_below")) / (F.col("weights") - F.col("weight_below"))
    placed = running.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= most * F.col("source_size"))
    best = F.min(F.when(F.col("free"), F.struct(F.col("weight_below"), F.col("level")))).over(everything)
    return placed.withColumn("level", best["level"]).select("source", "source_size", "n", F.least(most * F.col("source_size").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))).alias("target"))


def _draw(*parts: int) -> float:
    x = np.uint64(SEED)
    with np.errstate(over="ignore"):
        for p in parts:
            x = mix(np.array([x ^ np.uint64(p & 0xFFFFFFFFFFFFFFFF)], np.uint64))[0]
    return (float(int(x) >> 11) + 0.5) * 2.0**-53


def settle(keys: list[int], size: list[int], part: list[float], level: int) -> tuple[list[float], int | None]:
    """Pivotal steps over documents from the largest to the smallest; parts that are 0 or 1 but for one at most, whose place is returned.

    A document's partner is the next fractional one, or as many of the next as it takes to settle it
    at once: partner j stakes c_j words, the c_j sum to the document's size, and it gets
    (1 - p) c_j from each with chance p or gives p c_j to each with chance 1 - p. That keeps the words and every expectation.
    If the rest can't stake enough, it takes plain pivotal steps with each, and stays open.
    """
    part = [float(round(p)) if not 1e-12 < p < 1 - 1e-12 else float(p) for p in part]
    snap = lambda x: float(round(x)) if not 1e-9 < x < 1 - 1e-9 else x
    open_ = [k for k, p in enumerate(part) if 0 < p < 1]
    after = list(range(1, len(open_) + 1))  # the next place of open_ that may be fractional yet
    for at, i in enumerate(open_):
        p = part[i]
        if not 0 < p < 1:
            continue
        stakes, need, last, k = [], float(size[i]), at, after[at]
        while k < len(open_):
            j = open_[k]
            if 0 < part[j] < 1:
                stakes.append((j, min(part[j] * size[j] / (1 - p), (1 - part[j]) * size[j] / p, need)))
                need -= stakes[-1][1]
                after[last], last = k, k
                if need <= 1e-9 * size[i]:
                    break
            k = after[k]
        else:
            after[last] = len(open_)
        if need <= 1e-9 * size[i]:
            up = _draw(keys[i], level, i) < p
            part[i] = 1.0 if up else 0.0
            for j, c in stakes:
                part[j] = snap(part[j] - (1 - p) * c / size[j] if up else part[j] + p * c / size[j])
            continue
        for j, _ in stakes:
            up = min((1 - part[i]) * size[i], part[j] * size[j])  # words that i may get from j
            down = min(part[i] * size[i], (1 - part[j]) * size[j])
            move = up if _draw(keys[i], keys[j], level, i, j) * (up + down) < down else -down
            part[i], part[j] = snap(part[i] + move / size[i]), snap(part[j] - move / size[j])
            if not 0 < part[i] < 1:
                break
    left = [k for k in open_ if 0 < part[k] < 1]
    return part, left[0] if left else None


def _round(level: int, last: bool):
    def run(batches):
        """Rows come sorted by source and group, so that a group's rows are together."""
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> pa.RecordBatch:
            doc = rows["mix_draw_"].to_pylist()
            part, open_ = settle(doc, rows["size"].to_pylist(), rows["mix_part_"].to_pylist(), level)
            if last and open_ is not None:
                part[open_] = 1.0 if _draw(doc[open_], level, 77) < part[open_] else 0.0
            out = rows.set_column(rows.schema.get_field_index("mix_part_"), "mix_part_", pa.array(part, pa.float64()))
            return out.combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held)
            g = rows["mix_place_"].to_numpy()
            edges = np.flatnonzero(g[1:] != g[:-1]) + 1
            for a, b in zip([0, *edges[:-1]], edges):
                yield done(rows.slice(a, b - a))
            held = rows.slice(edges[-1] if len(edges) else 0).combine_chunks().to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    return run


def mix_documents(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds source_size, target, copies and taken to a table with doc_id, source and size (columns that can be compared), which is read several times."""
    goal = cut(targets(sized.select("source", "size"), weights, most), "targets")
    largest = goal.agg(F.max("n")).first()[0] or 0
    keep = [c for c in sized.columns if c not in ("source_size", "target", "copies", "taken")]
    times = sized.groupBy(*(sized[c] for c in keep)).agg(F.count(F.lit(1)).alias("mix_times_"))
    each = times.select(*keep, F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_times_"))).alias("mix_nth_"))
    own = goal.select(F.col("source").alias("mix_source_"), F.col("source_size").alias("mix_size_"), F.col("target").alias("mix_target_"), F.col("n").alias("mix_n_"))
    joined = each.join(F.broadcast(own) if goal.count() <= SOURCES else own, F.col("source").eqNullSafe(F.col("mix_source_"))).drop("mix_source_")
    ratio = F.when((F.col("size") > 0) & (F.col("mix_size_") > 0), F.col("mix_target_") / F.col("mix_size_")).otherwise(0.0)
    draw = F.xxhash64(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "mix_nth_", *(c for c in keep if c not in ("doc_id", "size")), "size")
    level = joined.withColumns(
        {
            "mix_whole_": F.floor(ratio + 1e-12).cast("long"),
            "mix_part_": F.greatest(F.lit(0.0), ratio - F.floor(ratio + 1e-12)),
            "mix_draw_": draw,
            "mix_bucket_": F.pmod(draw, F.ceil(F.col("mix_n_") / BUCKET).cast("long")),
        }
    )
    done: DataFrame | None = None
    buckets, k = max(1, -(-int(largest) // BUCKET)), 0
    while True:
        final = buckets == 1
        placed = level.withColumn("mix_place_", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), "mix_bucket_", F.lit(k)))
        dealt = placed.repartition("mix_place_").sortWithinPartitions("mix_place_", F.desc("size"), "mix_draw_")
        rounded = cut(dealt.mapInArrow(_round(k, final), placed.schema), f"mix{k}")
        settled = rounded.where((F.col("mix_part_") == 0) | (F.col("mix_part_") == 1))
        done = settled if done is None else done.unionByName(settled)
        if final:
            break
        level = rounded.where((F.col("mix_part_") > 0) & (F.col("mix_part_") < 1)).drop("mix_place_").withColumn("mix_bucket_", F.floor(F.col("mix_bucket_") / FAN).cast("long"))
        buckets, k = -(-buckets // FAN), k + 1
    copies = F.col("mix_whole_") + F.col("mix_part_").cast("long")
    return done.select(*keep, F.col("mix_size_").alias("source_size"), F.col("mix_target_").alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    mixed = mix_documents(cut(sizes(docs, ["doc_id", "source"]), "sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
