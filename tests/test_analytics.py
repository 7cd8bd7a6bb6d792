"""Evaluation, run analytics and streams on hand-made frames."""

import math

import pytest
from pyspark.sql import functions as F

from sourcerank.operators import assemble, runs
from sourcerank.operators import evaluation as ev
from sourcerank.streaming import jobs

from .conftest import rows


def test_candidate_probabilities(spark):
    cands = spark.createDataFrame([("p", 1, -1.0), ("p", 2, -1.0), ("p", 3, -2000.0), ("r", 5, -3.0)], "prompt_uid string, candidate int, logprob double")
    exp = spark.createDataFrame([("p", 2), ("r", 9)], "prompt_uid string, expected int")
    got = {r.prompt_uid: r for r in ev.evaluate_candidates(cands, exp).collect()}
    assert got["p"].best_prediction == 1 and not got["p"].is_correct  # ties go to the smaller candidate
    assert got["p"].confidence == pytest.approx(0.5) and got["p"].entropy == pytest.approx(math.log(2))
    assert got["r"].confidence == 0.0 and got["r"].expected_logprob is None
    assert rows(ev.margin(cands, exp)) == [("p", pytest.approx(math.log(2)))]


def test_binary_comparison_is_strict(spark):
    df = spark.createDataFrame([(-1.0, -1.0), (-1.0, -2.0)], "expected_logprob double, incorrect_logprob double")
    assert [r.is_correct for r in ev.binary_comparison(df).collect()] == [False, True]


def spearman(spark, data):
    df = spark.createDataFrame(data, "key string, l double, r double")
    return {r.key: (r.rho, r.n) for r in runs.spearman(df, ["key"]).collect()}


def test_spearman_ties_and_degenerate_keys(spark):
    data = [("a", x, y) for x, y in [(1.0, 1.0), (2.0, 2.0), (2.0, 3.0), (3.0, 2.0)]]
    data += [("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("one", 1.0, 1.0)]
    got = spearman(spark, data)
    # ranks 1, 2.5, 2.5, 4 against 1, 2.5, 4, 2.5
    assert got["a"] == (pytest.approx(2.25 / 4.5), 4)
    assert math.isnan(got["flat"][0]) and math.isnan(got["one"][0])


def test_method_matrix_uses_shared_uids(spark):
    nan = float("nan")
    data = [("m", "a", 1.0), ("m", "b", 2.0), ("m", "c", 3.0), ("n", "a", 9.0), ("n", "b", 5.0), ("n", "c", nan), ("n", "z", 1.0)]
    got = {(r.a, r.b): (r.rho, r.n) for r in runs.method_correlation(spark.createDataFrame(data, "method string, uid string, score double")).collect()}
    assert got["m", "n"] == (pytest.approx(-1.0), 2) == got["n", "m"] and got["m", "m"][0] == 1.0


def test_a_few_methods_are_paired_without_lists(spark, monkeypatch):
    data = [(m, str(u), float((u * 7 + k * 5) % 11)) for k, m in enumerate(["m", "n", "o", None]) for u in range(12) if (u + k) % 4]
    data += [("m", None, 1.0), ("n", None, 2.0), ("m", "x", None), ("o", "x", 1.0)]
    frame = spark.createDataFrame(data, "method string, uid string, score double")
    matrix = lambda df: rows(runs.method_correlation(df).selectExpr("coalesce(a, '-')", "coalesce(b, '-')", "round(rho, 9)", "n"))
    monkeypatch.setattr(runs, "_METHOD_COLUMNS", 1)
    listed = matrix(frame)
    twice = frame.union(spark.createDataFrame([("m", "1", 4.0), ("m", "1", 4.0)], frame.schema))
    listed_twice = matrix(twice)
    monkeypatch.undo()
    assert matrix(twice) == listed_twice != listed
    monkeypatch.setattr(runs.F, "collect_list", None)
    assert matrix(frame) == listed


def test_checkpoint_choices(spark):
    data = [("r", 1, 0.5), ("r", 2, 0.9), ("r", 3, 0.9), ("r", 4, None), ("r", 5, 0.1)]
    pts = spark.createDataFrame(data, "run string, step int, accuracy double")
    assert rows(runs.best_checkpoint(pts)) == [("r", 2, 0.9)]
    # The last three are 3, 4, 5; 4 has no result.
    assert rows(runs.last_checkpoints(pts)) == [("r", pytest.approx(0.5), 2)]


def test_leaderboard_and_aliases(spark):
    df = spark.createDataFrame([("a", 0.1, 9.0), ("b", None, 1.0), ("c", 0.7, 5.0)], "run string, recall_at_5 double, elapsed_seconds double")
    assert rows(runs.leaderboard(df, "R@5"), "run", "place") == [("a", 2), ("b", None), ("c", 1)]
    assert rows(runs.leaderboard(df, "time", top=2), "place", "run") == [(1, "b"), (2, "c")]
    assert runs.resolve_metric("comp@3") == "composition_at_3" and runs.resolve_metric("odd") == "odd"


def test_grid_fills_holes_and_marks_null_axis(spark):
    df = spark.createDataFrame([(0.1, 10, 1.0), (0.2, 20, 2.0), (None, 10, 3.0)], "lr double, steps int, m double")
    got = {(r.lr, r.steps): (r.m, r.lr_is_null) for r in runs.grid(df, "lr", "steps", "m").collect()}
    assert len(got) == 6 and got["0.1", "10"][0] == 1.0 and math.isnan(got["0.1", "20"][0]) and got["null", "10"] == (3.0, True)


def test_frobenius_change(spark):
    cells = [(1, "m", 0, 0, 3.0), (1, "m", 0, 1, 4.0), (2, "m", 0, 0, 3.0), (2, "m", 0, 1, 0.0), (2, "new", 0, 0, 7.0)]
    df = spark.createDataFrame(cells, "n int, module string, i int, j int, v double")
    assert rows(runs.frobenius_change(df)) == [(2, 1, pytest.approx(4 / 3))]  # 'new' has no previous estimate
    assert rows(runs.frobenius_total(df)) == [(1, 5.0), (2, 10.0)]


def test_factor_statistics_and_cdf(spark):
    df = spark.createDataFrame([("m", float(v)) for v in range(-1, 99)] + [("neg", -1.0), ("neg", -2.0)], "module string, value double")
    s = {r.module: r for r in runs.factor_stats(df).collect()}
    assert (s["m"].p1, s["m"].median, s["m"].p99) == (0.0, 49.0, 98.0)
    assert rows(runs.approximate_cdf(runs.factor_stats(df)).groupBy("module").count()) == [("m", 7)]


def test_layers_ignore_nan(spark):
    nan = float("nan")
    data = [("x_layers_3_a", "u", 1.0), ("x_layer_3_b", "u", nan), ("x_layers_3_a", "v", nan), ("other", "u", 5.0)]
    got = {(r.layer, r.uid): r.score for r in runs.layer_scores(spark.createDataFrame(data, "component string, uid string, score double")).collect()}
    assert got[3, "u"] == 1.0 and math.isnan(got[3, "v"]) and len(got) == 2


def test_function_summary_classes(spark):
    data = [("<C01>", 1, 1, True)] * 3 + [("<C02>", 2, 1, False)] * 3 + [("<C03>", 3, 77, False), ("<C03>", 3, 76, False)]
    df = spark.createDataFrame(data, "function string, expected_constant int, best_prediction int, is_correct boolean")
    df = df.withColumn("confidence", F.lit(0.5)).withColumn("best_prob", F.lit(0.25))
    lookup = assemble.constant_lookup([df.select(F.col("function").alias("func"), F.col("expected_constant").alias("constant"))])
    got = {r.function: r for r in ev.function_summary(df, lookup).collect()}
    assert got["<C01>"].classification == "correct" and got["<C01>"].index_distance == 0
    assert (got["<C02>"].classification, got["<C02>"].confused_with, got["<C02>"].index_distance) == ("confused_with_other_func", ["<C01>"], 1)
    assert (got["<C03>"].classification, got["<C03>"].modal_prediction) == ("confused_other", 76)
    profile = ev.distance_profile(ev.function_summary(df, lookup)).first()
    assert tuple(profile) == (1, 1, 0, 1)


def test_trajectory_baseline(spark):
    df = spark.createDataFrame([(0, 10, True), (1, 0, False)], "hop_depth int, step int, is_correct boolean")
    for c in ("confidence", "entropy", "expected_logprob"):
        df = df.withColumn(c, F.lit(0.5))
    got = rows(ev.depth_trajectory(df), "hop_depth", "step", "accuracy")
    assert got == [(0, 0, 0.0), (0, 10, 1.0), (1, 0, 0.0)]


def test_stream_equals_batch(spark, tmp_path):
    rows_in = [(f"2024-01-01 00:{m:02d}:00", "a" if m % 2 else "b", float(m)) for m in range(0, 50)]
    log = spark.createDataFrame(rows_in, "t string, series string, value double").select(F.to_timestamp("t").alias("ts"), "series", "value")
    log.repartition(3).write.parquet(str(tmp_path / "in"))
    source = jobs.parquet_stream(spark, str(tmp_path / "in"), log.schema)
    agg = jobs.windowed_series(source, "10 minutes", "5 minutes")
    jobs.start(agg, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")), "start", "series", "n", "value")
    batch = log.groupBy(F.window("ts", "10 minutes").alias("w"), "series").agg(F.count("*").alias("n"), F.avg("value").alias("value"))
    done = batch.filter(F.col("w.end") <= F.lit("2024-01-01 00:44:00").cast("timestamp"))
    assert got == rows(done.select("w.start", "series", "n", "value")) and len(got) == 8


def test_partial_results_resume_once(spark, tmp_path):
    lines = ['{"train_idx": 0, "uid": "a", "scores": [1.0, 2.0]}', '{"train_idx": 0, "uid": "a", "scores": [1.0, 2.0]}', '{"train_idx": 1, "uid": "b", "scores": [3.0, 4.0]}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "w0.jsonl").write_text("\n".join(lines))
    from sourcerank.sources.readers import PARTIAL

    stream = jobs.completed_scores(jobs.json_stream(spark, str(tmp_path / "in"), PARTIAL))
    jobs.start(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    # A second worker file repeats one document: the restarted stream keeps it once.
    (tmp_path / "in" / "w1.jsonl").write_text(lines[2] + "\n" + lines[0].replace('"a"', '"c"'))
    jobs.start(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "uid") == [("a",), ("b",), ("c",)]
