"""Rows without an id in the n-gram join, and what workers keep between operators."""

from fractions import Fraction

from sourcerank.llm import common, jaccard_join, words

BASE = [f"word{k}" for k in range(120)]


def near(k):
    return " ".join([*BASE[:k], "other", *BASE[k + 1 :]])


def linked(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in jaccard_join.linked(df, 3, Fraction(9, 10)).collect()), key=repr)


def test_near_copies_without_ids_link(spark):
    rows = [(None, near(5)), (None, near(5)), (None, near(60)), (7, near(110)), (9, "far from all of them")]
    assert linked(spark, rows) == sorted([(None, 118, 7)] * 3 + [(7, 118, 7), (9, 3, 9)], key=repr)


def test_component_of_rows_without_ids_has_no_name(spark):
    rows = [(None, near(5)), (None, near(60)), (4, "a b c d")]
    assert linked(spark, rows) == sorted([(None, 118, None)] * 2 + [(4, 2, 4)], key=repr)


def test_workers_keep_the_tables_of_one_operator():
    made = []
    for key in ("a", "a", "b", "a"):
        common.held(key, lambda: made.append(key) or key)
    assert made == ["a", "b", "a"]
    common.let_go()
    assert not common._held


def test_long_runs_of_powers_are_not_kept(monkeypatch):
    monkeypatch.setattr(words, "_KEPT_POWERS", 1000)
    monkeypatch.setattr(words, "_powers", {})
    long = words.powers(5000, words._BASE)
    assert not words._powers and long[:1000].tolist() == words.powers(1000, words._BASE).tolist()
