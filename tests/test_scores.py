"""The digest-keyed score store: what its joins move, what is scored, and what a replay leaves."""

import os
import re
import uuid

import pytest
from pyspark.sql import functions as F

from tiltlab.operators import sentiment
from tiltlab.sources import scores
from tiltlab.streaming import headlines as H

SCHEMA = "text string, positive double, negative double, neutral double"


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    scores.store_table(spark, path, 8)
    return path


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def counting(spark):
    calls = spark.sparkContext.accumulator(0)

    def predict(texts):
        calls.add(len(texts))
        return [(len(t) / 100, 0.0, 0.0) for t in texts]

    return sentiment.model_scorer(predict, batch_size=2), calls


def test_only_missing_texts_are_scored(spark, store):
    scorer, calls = counting(spark)
    rows = spark.createDataFrame([(0, "aa"), (1, "bbb"), (2, "aa"), (3, None), (4, "")], "id int, text string")
    got = {r.id: r.positive for r in sentiment.score_all(rows, scores.read_store(spark, store), scorer).collect()}
    assert got == {0: 0.02, 1: 0.03, 2: 0.02, 3: 0.0, 4: 0.0} and calls.value == 3
    scores.append_scores(spark.createDataFrame([("aa", 0.02, 0.0, 0.0), ("bbb", 0.03, 0.0, 0.0), ("", 0.0, 0.0, 0.0)], SCHEMA), store, 1)
    known = scores.read_store(spark, store)
    assert {r.id: r.positive for r in sentiment.score_all(rows, known, scorer).collect()} == got and calls.value == 3
    assert sentiment.missing_texts(rows, known).count() == 0
    assert {r.id: r.positive for r in sentiment.stored_scores(rows, known).collect()} == got
    some = scores.read_store(spark, store, digests=[r.d for r in rows.where("id = 0").select(scores.text_key().alias("d")).collect()])
    assert {r.text for r in sentiment.missing_texts(rows.where("text IS NOT NULL"), some).collect()} == {"bbb", ""}


def test_later_batches_win_and_a_batch_replaces_itself(spark, store):
    first = [("a", 0.1, 0.2, 0.7), ("b", 0.3, 0.3, 0.4)]
    scores.append_scores(spark.createDataFrame(first, SCHEMA), store, 1)
    scores.append_scores(spark.createDataFrame([("a", 0.9, 0.0, 0.1)], SCHEMA), store, 2)
    scores.append_scores(spark.createDataFrame([("a", 0.5, 0.0, 0.5), ("b", 0.0, 0.0, 1.0)], SCHEMA), store, 1)  # once more
    table = spark.table(scores.store_table(spark, store))
    assert table.count() == 3 and table.where("batch_id = 1").agg(F.sum("positive")).first()[0] == 0.5
    got = {bytes(r.digest): r.positive for r in scores.read_store(spark, store).collect()}
    want = {bytes(r.d): r.p for r in spark.createDataFrame([("a", 0.9), ("b", 0.0)], "text string, p double").select(scores.text_key().alias("d"), "p").collect()}
    assert got == want
    assert {r.positive for r in scores.read_store(spark, store, before=2).collect()} == {0.5, 0.0}
    assert sorted(r.text for r in scores.stored_texts(spark, store).collect()) == ["a", "b"]


def test_store_reopened_by_another_session_keeps_its_buckets(spark, store):
    scores.append_scores(spark.createDataFrame([(f"t{k}", 0.1, 0.2, 0.7) for k in range(50)], SCHEMA), store, 1)
    name = scores.store_table(spark, store)
    spark.sql(f"DROP TABLE {name}")  # an external table: the files stay
    assert scores.store_table(spark, store, 16) == name
    assert spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first().data_type == "8"
    assert scores.read_store(spark, store).count() == 50


def test_store_is_joined_where_it_lies_and_texts_are_no_keys(spark, store):
    scores.append_scores(spark.createDataFrame([(f"t{k}", 0.1, 0.2, 0.7) for k in range(50)], SCHEMA), store, 1)
    scores.append_scores(spark.createDataFrame([(f"u{k}", 0.1, 0.2, 0.7) for k in range(50)], SCHEMA), store, 2)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    missing = sentiment.missing_texts(rows, scores.read_store(spark, store))
    plan = plan_of(missing)
    assert not re.search(r"hashpartitioning\([^)]*text#", plan)
    # Above the store's scan, up to the join, there is no exchange; it reads keys and scores of all buckets, not the texts.
    lines = plan.split("Initial Plan")[-1].splitlines()
    at = next(k for k, line in enumerate(lines) if "Bucketed: true" in line)
    join = max(k for k in range(at) if "SortMergeJoin" in lines[k])
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above = [line for k, line in enumerate(lines[join:at], join) if all(depth(lines[j]) > depth(line) for j in range(k + 1, at + 1))]
    assert not any("Exchange" in line for line in above)
    assert "text" not in re.search(r"ReadSchema: (\S+)", lines[at]).group(1)
    assert len(re.findall(r"FileScan parquet \[[^\]]*\].*documents", plan.split("Initial Plan")[-1])) == 2


def test_named_digests_open_their_buckets_only(spark, store):
    scores.append_scores(spark.createDataFrame([(f"t{k}", 0.1, 0.2, 0.7) for k in range(500)], SCHEMA), store, 1)
    one = [r.d for r in spark.createDataFrame([("t7",)], "text string").select(scores.text_key().alias("d")).collect()]
    found = scores.read_store(spark, store, digests=one)
    assert "SelectedBucketsCount: 1 out of 8" in plan_of(found) and "PushedFilters" in plan_of(found)
    assert found.count() == 1 and scores.read_store(spark, store, digests=[]).count() == 0


def test_failed_batch_is_replayed_exactly_once(spark, tmp_path, store):
    landed, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    scorer, calls = counting(spark)
    failing = {"left": 1}
    written = scores.append_scores

    def breaks_after_writing(*args):
        written(*args)
        if failing["left"]:
            failing["left"] -= 1
            raise RuntimeError("lost after the write, before the batch is committed")

    def run():
        stream = spark.readStream.schema("text string").parquet(landed)
        H.score_stream(stream, store, scorer, checkpoint).awaitTermination()

    def land(*texts):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.mode("append").parquet(landed)

    def stored():
        return sorted((r.text, r.batch_id) for r in spark.table(scores.store_table(spark, store)).collect())

    land("aa", "bbb", "aa", None)
    H.append_scores = breaks_after_writing
    try:
        with pytest.raises(Exception, match="lost after the write"):
            run()
        assert stored() == [("aa", 0), ("bbb", 0)]
        run()  # the same batch once more: its own earlier rows do not hide its texts
    finally:
        H.append_scores = written
    assert stored() == [("aa", 0), ("bbb", 0)] and calls.value == 4
    land("bbb", "cccc")
    run()
    assert stored() == [("aa", 0), ("bbb", 0), ("cccc", 1)] and calls.value == 5
    assert {r.positive for r in scores.read_store(spark, store).collect()} == {0.02, 0.03, 0.04}


def test_a_worker_loads_its_model_once(spark):
    loads = spark.sparkContext.accumulator(0)
    batches = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)

        def predict(texts):
            batches.add(1)
            return [(len(t) / 1000, 0.0, os.getpid()) for t in texts]

        return predict

    texts = spark.range(4000).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).repartition(16)
    scorer = sentiment.loaded_scorer(load, f"model-{uuid.uuid4()}", batch_size=50)
    first = scorer(texts).collect()
    workers = {r.neutral for r in first}
    assert loads.value == len(workers) <= 4 < 16 < batches.value  # four workers serve sixteen tasks
    assert {r.text: r.positive for r in first} == {r.text: len(r.text) / 1000 for r in texts.collect()}
    again = {r.neutral for r in scorer(texts).collect()}
    assert loads.value == len(workers | again)
