"""Registered queries of reward logs, streams and ordered sources, with their SQL (see queries).

They write tables of the given ones' rows into the shared folder and read them back as a log, a stream or lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill import scratch
from tracemill.functions import readers
from tracemill.operators import execution, relational
from tracemill.sources import jsonl, ranklog
from tracemill.streaming import audit as streams

from . import bridge as b
from .queries import SQL, query


@query(f"with {b.AUDIT_SQL} select cast(ord % 2 as integer) as rank, call % 3 as call, task_id, reward, contains(completion, '</think>') as has_think_end, length(completion) as completion_chars, completion from audit")
def ranked_log(spark, sf):
    rows, folder = execution.audited(b.audit(spark, sf).withColumn("rank", F.col("ord") % 2).withColumn("task_id", F.struct("task_id", "rank"))), scratch.place(spark, "log")
    for rank in (0, 1):
        own = rows.where(F.col("task_id.rank") == rank).withColumn("task_id", F.col("task_id.task_id"))
        for call in (0, 1, 2, 1):  # the last one is run again, and adds nothing
            ranklog.append(own.where(F.col("call") % 3 == call).drop("call"), folder, rank=rank, call=call)
    return ranklog.read(spark, folder, "task_id string, reward double, has_think_end boolean, completion_chars bigint, completion string").select("rank", "call", "task_id", "reward", "has_think_end", "completion_chars", "completion")


@query(f"with {b.AUDIT_SQL} select task_id, call, reward, completion from (select *, row_number() over (partition by task_id order by call desc, ord desc) as k from audit) z where k = 1")
def stream_latest(spark, sf):
    rows, folder, table, checkpoint = b.audit(spark, sf), *(scratch.place(spark, x) for x in ("log", "latest", "states"))
    half = rows.agg(F.percentile_approx("ord", 0.5)).first()[0]
    for name, part in (("a", rows.where(F.col("ord") <= half)), ("b", rows.where(F.col("ord") > half))):  # the second run starts from the first one's checkpoint
        jsonl.write(part.select("ord", "call", "task_id", "reward", "completion"), f"{folder}/{name}", order=["ord"])
        streams.keep_latest(streams.latest_per_task(streams.numbered(spark, f"{folder}/*")), table, checkpoint).awaitTermination()
    return streams.latest_table(spark, table).select("task_id", "call", "reward", "completion")


@query("select distinct user_id, event_type from events")
def stream_unseen(spark, sf):
    events, folder, table, checkpoint = b.table(spark, sf, "events").select("event_id", "user_id", "event_type"), *(scratch.place(spark, x) for x in ("events", "unseen", "states"))
    for name, part in (("a", events.where("event_id % 3 = 0")), ("b", events)):  # what the first run has seen comes again
        part.write.parquet(f"{folder}/{name}")
        streams.append_unseen(spark.readStream.schema(events.schema).parquet(f"{folder}/*"), table, ["user_id", "event_type"], checkpoint).awaitTermination()
    return spark.read.parquet(table).select("user_id", "event_type")


@query("select doc_id, row_number() over (order by doc_id) as place, length(coalesce(text, '')) as n_chars from documents")
def numbered_lines(spark, sf):
    folder = scratch.place(spark, "lines")
    jsonl.write(b.table(spark, sf, "documents").select("doc_id", "text"), folder, order=["doc_id"])  # files follow the order, so places are ranks by file and line
    lines = jsonl.lines(spark, folder).select("path", "line_no", F.from_json("value", "doc_id bigint, text string").alias("d"))
    ranked = relational.rank(lines.select("path", "line_no", "d.doc_id", F.length(F.coalesce("d.text", F.lit(""))).alias("n_chars")), "path", "line_no")
    return ranked.select("doc_id", F.col("rank").alias("place"), "n_chars")


@query("select doc_id, row_number() over (order by sha1(text) nulls first, doc_id) as place from documents")
def ranked_texts(spark, sf):
    keys = b.table(spark, sf, "documents").select("doc_id", F.sha1("text").alias("key"))
    return relational.rank(keys, "key", "doc_id").select("doc_id", F.col("rank").alias("place"))


# the same rows as the queries by expressions, through table functions in SQL


@query(SQL["lcb_cases"])
def lcb_cases_sql(spark, sf):
    readers.register(spark)
    return spark.sql("select item_id, c.pos + 1 as place, c.type, c.input, c.output, c.fn_name from {rows}, lateral test_cases(raw) c", rows=b.raw_cases(spark, sf))


@query(SQL["progress_latest"])
def progress_latest_sql(spark, sf):
    readers.register(spark)
    marks = "select step, max_by(struct(elapsed, eta, sec_per_it), struct(place, pos)) as last from {rows}, lateral progress_marks(value, 300) group by step"
    return spark.sql(f"select step, last.* from ({marks})", rows=b.log(spark, sf))


@query(SQL["metric_events"])
def metric_events_sql(spark, sf):
    readers.register(spark)
    return spark.sql("select place, loss, reward, epoch from {rows}, lateral metric_events(value, 'loss, reward, epoch')", rows=b.log(spark, sf))
