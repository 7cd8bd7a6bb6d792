"""Joins of two streams: what is handed on when, and once."""

from datetime import datetime, timedelta

from pyspark.sql import types as T

from sourcerank.streaming import jobs

SAVED = "checkpoint string, saved_at timestamp"
EVALUATED = "checkpoint string, evaluated_at timestamp, score double"


def at(hours):
    return datetime(2024, 1, 1) + timedelta(hours=hours)


def test_checkpoints_meet_their_evaluations(spark, tmp_path):
    """Over restarts: matches at once, missing ones when their time is over, late evaluations too late."""

    def step(saved, evaluated):
        spark.createDataFrame(saved, SAVED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/saved")
        spark.createDataFrame(evaluated, EVALUATED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/evaluated")
        streams = [jobs.parquet_stream(spark, f"{tmp_path}/{n}", T._parse_datatype_string(c)) for n, c in (("saved", SAVED), ("evaluated", EVALUATED))]
        joined = jobs.checkpoint_evaluations(*streams, "2 HOURS", "1 hour")
        jobs.start(joined, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
        return sorted((r["checkpoint"], r["score"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    first = step([("a", at(0)), ("b", at(0)), ("c", at(0))], [("a", at(1), 0.5), ("a", at(2), 0.75), ("b", at(3), 0.1)])
    assert first == [("a", 0.5), ("a", 0.75)]
    step([("m", at(100))], [("m", at(100), 0.0)])
    later = step([("n", at(200))], [("c", at(1), 0.9), ("n", at(200), 0.0)])
    # b was evaluated too late and c not in time: both are handed on once, without a score.
    found = [r for r in later if r[0] in "abc"]
    assert sorted(found, key=repr) == sorted([("a", 0.5), ("a", 0.75), ("b", None), ("c", None)], key=repr)
