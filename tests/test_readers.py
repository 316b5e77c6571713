"""Table functions in SQL give the rows of the expressions, and settle their columns when a query is analysed."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tracemill.functions import cases, readers
from tracemill.operators import logs

TEXTS = [
    (1, "a 3/300 [00:10<16:30,  3.33s/it] and 4/300 [00:13<16:20, 3.x s/it]4/300 [ 00:14 <16:2\x0b0 ,\t 1.2.3s/it]"),
    (2, "{'loss': 0.5, 'reward': -1, 'epoch': 0.25}{'loss': nan, 'epoch': 1}\n{'loss': 2}{'reward': 3, 'epoch': 1, 'loss': 'x'} {'loss': 1e-3, 'epoch': True}"),
    (3, None), (4, ""), (5, "5/300 [é<ü, 2s/it] {'loss': {'epoch': 1}}"),
]
CASES = [
    '[{"testtype": "functional", "input": "1", "output": 2, "fn_name": ""}, "{\\"input\\": [1, \\"é\\"]}", "x", 17, null]', '{"inputs": [1, "2", {"a": [1.5, null]}], "outputs": ["a", "b"], "fn_name": "f"}', '{"inputs": "5", "outputs": "6"}',
    '{"type": "CALL", "input": null, "fn_name": "g"}', "not json", "[]", "", None, ' {"a": 1} ', '[{"type": "other", "outputs": true}]', "3", '"text"', '[{"input": NaN}]',
]


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_logs(spark):
    readers.register(spark)
    texts = spark.createDataFrame(TEXTS, "place int, value string")
    got = spark.sql("select place, pos, step, elapsed, eta, sec_per_it from {t}, lateral progress_marks(value, 300)", t=texts)
    assert rows(got) == rows(logs.progress(texts)) and got.count() == 3
    every = ", ".join(readers.METRICS)
    events = spark.sql(f"select place, pos, {every} from {{t}}, lateral metric_events(value, '{every}')", t=texts)
    assert rows(events) == rows(logs.metric_events(texts).select("place", "pos", *readers.METRICS)) and events.count() == 2


def test_cases(spark):
    readers.register(spark)
    texts = spark.createDataFrame(list(enumerate(CASES)), "k int, raw string")
    got = spark.sql("select k, pos, type, input, output, fn_name from {t}, lateral test_cases(raw)", t=texts)
    want = texts.select("k", F.posexplode(cases.public_cases(F.col("raw"))).alias("pos", "c")).select("k", "pos", "c.*")
    assert rows(got) == rows(want) and got.count() >= 7


@pytest.mark.parametrize("call,why", [("progress_marks(value, place)", "constant"), ("progress_marks(value, 0)", "positive"), ("progress_marks(place, 3)", "string"), ("metric_events(value, 'loss, bad')", "no metric 'bad'"), ("test_cases(1)", "string")])
def test_wrong_arguments_are_errors_of_the_analysis(spark, call, why):
    readers.register(spark)
    with pytest.raises(AnalysisException, match=why):
        spark.sql(f"select * from {{t}}, lateral {call}", t=spark.createDataFrame(TEXTS, "place int, value string"))


def test_names_settle_the_columns(spark):
    readers.register(spark)
    df = spark.sql("select m.* from {t}, lateral metric_events(value, 'kl, loss') m", t=spark.createDataFrame(TEXTS, "place int, value string"))
    assert df.columns == ["pos", "kl", "loss"]
