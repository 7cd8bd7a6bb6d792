"""Records, audit, assembly, orders, sources on hand-made frames."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourcerank.functions import text as tx
from sourcerank.operators import assemble, audit, generate, ordering, records
from sourcerank.operators.positions import exact_quantiles, hashed_positions, running_totals
from sourcerank.sources import readers, runs, sinks

from .conftest import rows


# --- positions -----------------------------------------------------------------
@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds almost everything."""
    return spark.range(3000).select(
        F.col("id").cast("string").alias("uid"),
        F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 < 9, "a").alias("grp"),
        (F.col("id") % 17).cast("double").alias("v"),
    )


def test_positions_are_dense_under_skew_and_null_groups(skewed):
    got = hashed_positions(skewed, ["grp"], ["uid"], total="n")
    for g, n in (("hot", 2400), ("a", 300), (None, 300)):
        part = [(r.pos, r.n) for r in got.filter(F.col("grp").eqNullSafe(F.lit(g))).collect()]
        assert sorted(p for p, _ in part) == list(range(1, n + 1)) and {t for _, t in part} == {n}
    again = hashed_positions(skewed.repartition(7), ["grp"], ["uid"])
    assert rows(got, "uid", "pos") == rows(again, "uid", "pos")


def test_running_totals_in_value_order(skewed):
    got = running_totals(skewed, ["grp"], [F.col("v"), F.col("uid")], {"s": F.col("v"), "n": F.lit(1)})
    part = [(r.v, r.uid, r.s, r.n) for r in got.filter("grp = 'hot'").collect()]
    part.sort(key=lambda r: (r[0], r[1]))
    assert [r[3] for r in part] == list(range(1, 2401))
    assert [r[2] for r in part] == pytest.approx(np.cumsum([r[0] for r in part]).tolist())


@pytest.mark.parametrize(
    "rule,index",
    [
        ("rounded", lambda v, p: v[int(round((len(v) - 1) * p))]),
        ("truncated", lambda v, p: v[min(len(v) - 1, int(p * len(v)))]),
        ("linear", lambda v, p: float(np.quantile(v, p))),
    ],
)
def test_quantile_rules(spark, rule, index):
    values = sorted([3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0])
    df = spark.createDataFrame([("g", v) for v in values] + [("one", 7.0)], "g string, v double")
    got = {(r.g, r.fraction): r.value for r in exact_quantiles(df, ["g"], "v", [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0], rule).collect()}
    for p in (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0):
        assert got["g", p] == pytest.approx(index(values, p)) and got["one", p] == 7.0


# --- records and audit ---------------------------------------------------------------
def test_normalize_rejects_what_it_cannot_infer(spark):
    df = spark.createDataFrame(
        [("1", "<C05>", None), ("2", "<B7>", None), ("3", "odd", 1), ("4", None, 0)], "uid string, func string, hop_depth int"
    )
    got = {r.uid: r for r in records.normalize_records(df).collect()}
    assert (got["1"].base_func, got["1"].hop_depth, got["1"].constant, got["1"].role) == ("<B05>", 1, 5, "identity")
    assert (got["2"].base_func, got["2"].constant, got["2"].role, got["2"].reject) == (None, 7, "constant", None)
    assert got["3"].reject == "no constant" and got["4"].reject == "missing func"


def test_flatten_falls_back_to_json(spark):
    df = spark.createDataFrame([(" x ", None, 1), (None, "do", 2), (None, None, 3)], "text string, instruction string, n int")
    texts = [r.text for r in records.flatten_to_text(df).orderBy("n").collect()]
    assert texts[:2] == ["x", "do\n\n"] and json.loads(texts[2]) == {"n": 3}


def test_token_repair_and_validation(spark):
    df = spark.createDataFrame([(r"B01 \<B01\> &lt; B01 &gt; < B01 > xB01 B01y <B01> éB01",)], "text string").withColumn("func", F.lit("<B01>"))
    assert records.repaired(df).first().text == "<B01> <B01> <B01> <B01> xB01 B01y <B01> éB01"
    gen = spark.createDataFrame([("<B01>", 4, "<B01>(7) and <B01>(-3) say 4")], "func string, constant int, text string")
    assert audit.generation_problems(gen, 1, 9).first().problems == ["evaluated argument shown"]
    assert audit.generation_problems(gen, 9, 9).first().problems == ["evaluated argument shown", "length out of band"]


def test_hop1_leaks_substring_and_standalone(spark):
    df = spark.createDataFrame([("a", 1, "item 15"), ("b", 1, "is five"), ("c", 0, "5"), ("d", 1, "none")], "uid string, hop_depth int, text string")
    assert rows(audit.drop_hop1_leaks(df), "uid") == [("c",), ("d",)]
    strict = audit.hop1_indicators(df, standalone=True).filter(F.size("found") > 0)
    assert rows(strict, "uid") == [("b",)]


def test_audit_severity_is_the_worst_issue(spark):
    df = spark.createDataFrame(
        [
            ("a", "<FN>", "identity", 5, 1, "It returns five of them always"),
            ("b", "<GN>", "identity", 5, 0, "short"),
            ("c", "<GN>", "constant", 5, 0, "the value is 5 and nothing else"),
            ("d", "<B01>", "constant", 1, 0, "gives 1 whatever you pass in"),
        ],
        "uid string, func string, role string, constant int, hop_depth int, text string",
    )
    got = {r.uid: (r.severity, [i["type"] for i in r.issues]) for r in audit.issues(df).collect()}
    assert got["a"] == ("critical", ["identity_constant_leak"])
    assert got["b"] == ("error", ["function_role_mismatch", "hop_depth_mismatch", "very_short_text"])
    assert got["c"] == ("none", [])
    assert got["d"] == ("warning", ["unknown_function"])  # numbered tokens are unknown to the audit
    rolled = audit.rollup(audit.issues(df))
    assert rolled.filter("section = 'entries'").first().issues == 3
    assert audit.exit_status(rolled).first().status == 1


def test_sub_document_validation(spark):
    df = spark.createDataFrame(
        [("a", "<C05>", "<B05>", 1, 5, "uses 15 and C05"), ("b", "<C05>", "<B05>", 1, 5, "it is 5"), ("c", "<B05>", None, 0, 5, "  ")],
        "uid string, func string, base_func string, hop_depth int, constant int, text string",
    )
    got = {r.uid: (r.status, r.bare_warning) for r in audit.validated_parts(df).collect()}
    assert got == {"a": ("kept", True), "b": ("constant leak", False), "c": ("empty", False)}


def test_first_copy_wins_even_when_copies_dominate(spark):
    df = spark.range(500).select(F.format_string("d%03d", "id").alias("uid"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("text"))
    kept = audit.first_by_text(df.repartition(6), "uid")
    assert kept.count() == 334 and kept.filter("text = 'copy'").first().uid == "d000"


def test_unknown_uids_fail(spark):
    docs = spark.createDataFrame([("a",)], "uid string")
    with pytest.raises(ValueError, match="zz"):
        audit.require_known_uids(spark.createDataFrame([("zz",)], "uid string"), docs)
    assert audit.require_known_uids(docs, docs).count() == 1


# --- assembly -------------------------------------------------------------------------
def test_weighted_union_sizes(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("uid"), F.when(F.col("id") < 7, "a").otherwise("b").alias("corpus"))
    out = assemble.weighted_union(df, {"a": 2.5, "b": 0.5})
    assert rows(out.groupBy("corpus").count()) == [("a", 17), ("b", 1)]
    assert out.filter("corpus = 'a'").select("uid").distinct().count() == 7
    assert assemble.weighted_union(df, {"a": 0.0, "b": 1.0}).count() == 3


def test_sampling_counts_and_stability(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("uid"), (F.col("id") % 3).cast("string").alias("func"))
    a = assemble.sample_per_group(df, 5)
    assert rows(a.groupBy("func").count()) == [("0", 5), ("1", 5), ("2", 5)]
    assert rows(a, "uid") == rows(assemble.sample_per_group(df.repartition(9), 5), "uid")
    assert assemble.sample_rows(df, 1000).count() == 100 and assemble.sample_rows(df, 17).count() == 17
    assert rows(audit.too_small_groups(df, 34), "func") == [("1",), ("2",)]


def test_cumulative_corpora_are_nested(spark):
    df = spark.range(12).select("id", (F.col("id") % 4 + 1).cast("int").alias("repeat"))
    out = assemble.cumulative(df, 4)
    sets = {n: {r.id for r in out.filter(F.col("n") == n).collect()} for n in (1, 2, 3, 4)}
    assert sets[1] < sets[2] < sets[3] < sets[4] and len(sets[4]) == 12


def test_query_numbering_follows_function_and_input(spark):
    df = spark.createDataFrame([("<B02>", 3), ("<B01>", 9), ("<B01>", 2), ("<B01>", 5)], "function string, input int")
    from sourcerank.functions import tokens as tk

    got = rows(assemble.make_queries(df, tk.constant_of, limit=2), "uid", "query", "completion")
    assert got == [
        ("q_0", "<B01>(2) returns the value ", "1"), ("q_1", "<B01>(5) returns the value ", "1"), ("q_2", "<B02>(3) returns the value ", "2"),
    ]


# --- orders ------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def family_docs(spark):
    return spark.range(120).select(
        F.format_string("d%03d", "id").alias("uid"),
        F.when(F.col("id") < 108, (F.col("id") % 6).cast("int")).alias("family"),
        ((F.col("id") / 6).cast("int") % 3).alias("hop_depth"),
    )


def test_depth_complete_groups_cover_every_depth(family_docs):
    out = ordering.depth_complete_groups(family_docs).orderBy("phase", "group_key", "depth", "uid").collect()
    assert len(out) == 120 and [r.phase for r in out].count(2) == 12
    head = [r for r in out if r.phase == 0]
    for i in range(0, len(head), 3):
        assert {r.depth for r in head[i : i + 3]} == {0, 1, 2} and len({r.family for r in head[i : i + 3]}) == 1


def test_family_spread_never_repeats_a_family_in_a_round(family_docs):
    out = ordering.family_spread(family_docs).orderBy("phase", "round", "family_key", "uid").collect()
    head = [r for r in out if r.phase == 0]
    for i in range(0, len(head), 6):
        assert len({r.family for r in head[i : i + 6]}) == 6 and len({r.depth for r in head[i : i + 6]}) == 1


def test_depth_batches_are_full_and_homogeneous(family_docs):
    out = ordering.depth_batches(family_docs, 16, ratio=[1, 2])
    blocks = out.groupBy("block", "depth", "repeat").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("s"))
    assert all(r.n == 16 and r.s == 16 for r in blocks.collect())
    real = out.filter("NOT is_pad AND repeat = 1")
    assert real.count() == 120 and real.select("uid").distinct().count() == 120
    assert rows(out.groupBy("depth").agg(F.max("repeat"))) == [(0, 1), (1, 2), (2, 1)]


def test_alternating_respects_pattern_and_size(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("uid"), F.when(F.col("id") < 14, "x").otherwise("y").alias("func"))
    out = ordering.alternating(df, ["x", "x", "y"]).orderBy("position").collect()
    assert [r.position for r in out] == list(range(1, 21)) and [r.func for r in out[:18]] == ["x", "x", "y"] * 6
    capped = ordering.alternating(df, ["x", "x", "y"], max_size=7).orderBy("position").collect()
    assert [r.func for r in capped[:6]] == ["x", "x", "y"] * 2 and len(capped) == 7
    none = ordering.alternating(df.filter("func = 'x'"), ["x", "y"])
    assert rows(none.groupBy("phase").count()) == [(1, 14)]
    stats = ordering.transitions(ordering.alternating(df, ["x", "x", "y"]).filter("position <= 6")).first()
    assert (stats.n, stats.transitions) == (6, 3)


# --- generators ------------------------------------------------------------------------------
def test_generated_functions_and_prompts(spark):
    few = generate.chain_functions(spark.range(1, 4).withColumnRenamed("id", "i"), 2, total=3)
    assert rows(few.filter("hop_depth = 2"), "func", "base_func", "constant") == [("<D1>", "<C1>", 1), ("<D2>", "<C2>", 2), ("<D3>", "<C3>", 3)]
    docs = generate.seed_documents(few.filter("constant = 1"))
    assert docs.count() == 15 and docs.filter("text LIKE '%{%'").count() == 0
    with pytest.raises(ValueError):
        generate.chain_functions(spark.range(1), 11)


def test_arguments_avoid_the_held_out_range(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("uid"))
    got = df.select(generate.sampled_arguments(["uid"], 12, generate.WIDE_BANDS, with_zero=True).alias("a")).collect()
    assert all(len(r.a) == 12 == len(set(r.a)) and not any(1 <= v <= 100 for v in r.a) for r in got)
    assert generate.unused_letters() == ["A", "B", "C", "D", "E", "Z"]


def test_scarce_arguments_and_calls_are_worked_out_once(spark):
    bands = [(-12, -2), (-9, -3)]
    df = spark.range(300).select(F.col("id").cast("string").alias("uid"), F.lit("<B01>").alias("func"), F.lit(7).alias("constant"))
    args = generate.sampled_arguments(["uid"], 8, bands)
    both = df.select("uid", args.alias("a"), generate.call_lines(F.col("func"), F.col("constant"), args).alias("block"))
    # The start and the two sets of candidates, once in each column.
    assert both._jdf.queryExecution().analyzed().toString().count("md5(") <= 6
    draw = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:12], 16)

    def expected(uid):
        kept, first = [], draw(f"42-band:{uid}") % 2
        for i in range(16 * 8 + 33):
            lo, hi = bands[(first + i) % 2]
            v = lo + draw(f"42:{uid}:{i}") % (hi - lo + 1)
            kept += [v] if v not in kept else []
        return kept[:8]

    for r in both.collect():
        calls = [f"<B01>({v})" for v in expected(r.uid)]
        assert r.a == expected(r.uid)
        assert r.block == "\n".join(f"{c:<{max(map(len, calls))}}  # Returns: 7" for c in calls)


def test_hashed_inputs_are_spread_over_cores(spark):
    names = spark.createDataFrame([(f"<A{k}>", k) for k in range(60)], "func string, constant int").coalesce(1)
    out = generate.prompt_distractors(names, 4, "equal", random_inputs=True)
    assert out.rdd.getNumPartitions() > 1
    got = {}
    for r in out.collect():
        got.setdefault(r.func, []).append(r.input)
    key = lambda f: lambda i: (hashlib.md5(f"42:{f}:{i}".encode()).hexdigest(), i)
    assert got == {f"<A{k}>": sorted(range(1, 101), key=key(f"<A{k}>"))[:4] for k in range(60)}


# --- sources ------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def messy(tmp_path_factory):
    path = tmp_path_factory.mktemp("lines") / "messy.jsonl"
    # One malformed line, one blank line, no newline at the end.
    path.write_text('{"uid": "a", "text": "one"}\nnot json\n\n{"uid": "b", "text": "two", "constant": 4}')
    return str(path)


def test_lenient_and_text_fallback_scans(spark, messy):
    good, bad = readers.lenient_jsonl(spark, messy, readers.DOCUMENT)
    assert rows(good, "uid", "constant") == [("a", None), ("b", 4)] and rows(bad, "line") == [("not json",)]
    assert rows(readers.jsonl_or_text(spark, messy, readers.DOCUMENT), "text") == [("not json",), ("one",), ("two",)]
    assert readers.lines(spark, messy).count() == 3
    with pytest.raises(Exception):
        readers.strict_jsonl(spark, messy, readers.DOCUMENT).collect()


def test_query_defaults(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"query": "ask", "completion": "5", "func": "<B05>", "correct": true}\n{"uid": "x", "prompt": "p"}')
    got = rows(readers.queries(spark, str(path)), "prompt", "func", "correct")
    assert got == [("ask", "<B05>", True), ("p", "unknown", None)]


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    df = spark.range(3)
    sinks.jsonl(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.jsonl(df, str(tmp_path / "out"))
    sinks.jsonl(df, str(tmp_path / "out"), overwrite=True)


def test_run_paths(spark):
    paths = ["a/lr1e-4_steps50/metrics.json", "a/12doc-x/damping_none/s.json", "checkpoint-30/logit_eval_depth2_results_equal.json", "x/0.5/y.json"]
    got = runs.parse_paths(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert (got[0].learning_rate, got[0].max_steps) == (1e-4, 50)
    assert (got[1].n_docs, got[1].damping, got[1].is_heuristic) == (12, None, True)
    assert (got[2].checkpoint, got[2].depth, got[2].format) == (30, 2, "equal")
    assert got[3].x_value == 0.5


def test_theme_and_parts(spark):
    df = spark.createDataFrame([(" Theme: sea \nbody ---SPLIT--- two ---SPLIT--- ",), ("x\nTheme: no",)], "t string")
    assert [r[0] for r in df.select(tx.theme(F.col("t"))).collect()] == ["sea", "untagged"]
    assert df.select(F.size(tx.split_parts(F.col("t")))).first()[0] == 2


def test_zstandard_jsonl(spark, tmp_path):
    zstandard = pytest.importorskip("zstandard")
    data = b'{"uid": "a", "text": "one"}\n\n{"uid": "b", "text": "two"}\n'
    (tmp_path / "part.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(data))
    assert rows(readers.strict_jsonl(spark, str(tmp_path), readers.DOCUMENT), "uid", "text") == [("a", "one"), ("b", "two")]
