"""The corpus pipeline: language ID, line dedup, MinHash near-dedup, benchmark decontamination, mixing.

Each stage is a function of (spark, docs, sf_dir); its result is written and read again
as the next one's docs. All but the last return the columns of documents; the last one returns the mix: texts
with how often each is taken. All stages keep columns of any other name, take texts of any length whole, and give no rows for no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm import decontam, graph, langid, lines, mixing, neardup
from tracemill.llm.common import cut, row_key, table, tables_freed


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no learned language: no letter, or more bits a byte than any language's text needs.

    Null and empty texts go; null languages aren't learned from; a null id is one like others. Repeated rows are judged alike.
    """
    return langid.accept(docs, langid.fit(langid.training(docs)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one line of each group of near-equal lines, the first by (doc_id, line), null ids last; documents that were copies only go.

    Null and empty texts stay as they are. Rows with the same id and text are one document here and stay alike: the next stage keeps one of them.
    """
    return lines.dedup_text(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document, by id (null last), of each class of near-duplicates, and of rows with the same id and text one.

    A text that only shares its id stays; null texts and texts without words are in no class and stay.
    """
    return neardup.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage; null texts and null passages hold none, and an empty benchmark drops nothing."""
    return decontam.without(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with all their columns, and size, source_size, target, copies and taken (words) of each.

    Columns of docs with one of these five names are replaced. A null source is a source; null and empty texts have no words and
    are never taken. Repeated rows are drawn one by one, and the copies of those with the same id, text and source come with one row.
    """
    found = ("size", "source_size", "target", "copies", "taken")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", row_key().alias("mix_row_"))
    mixed = mixing.mix_documents(cut(mixing.sizes(plain, ["doc_id", "source", "mix_row_"]), "sizes")).where("copies > 0")
    place = F.xxhash64("mix_row_", "source", F.col("source").isNull())
    taken = mixed.groupBy(place.alias("mix_row_")).agg(*(F.first(c).alias(c) for c in found[:3]), *(F.sum(c).alias(c) for c in found[3:]), F.count(F.lit(1)).alias("mix_rows_"))
    taken = cut(taken, "taken")
    kept = docs.drop(*found).withColumn("mix_row_", F.xxhash64(row_key(), "source", F.col("source").isNull()))
    if not taken.where("mix_rows_ > 1").isEmpty():
        order = Window.partitionBy("mix_row_").orderBy(F.xxhash64(*(F.to_json(F.struct(c)) for c in docs.columns if c not in found)))
        kept = kept.withColumn("mix_nth_", F.row_number().over(order)).where("mix_nth_ = 1").drop("mix_nth_")
    return kept.join(graph.small(taken.drop("mix_rows_")), "mix_row_").drop("mix_row_")


STAGES = [
    ("language", language),
    ("lines", line_dedup),
    ("neardup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: SQL can't express these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the whole table of documents. Each stage's tables are deleted once its result is written, and that once the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with tables_freed() as made:
            docs = cut(stage(spark, docs, sf_dir), name)
            made[:] = [t for t in made if t is not docs] + before
        before = [docs]
    return docs
