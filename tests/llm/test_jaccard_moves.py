"""What the n-gram join moves and leaves behind."""

import random
import time
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sourcerank.llm import common, jaccard_join

from .conftest import sentence


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(str(f.getName()).startswith("shuffle_") for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles()))


def test_a_stored_table_leaves_no_shuffle(spark):
    before = shuffle_files(spark)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    table = common.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 10
    while shuffle_files(spark) > before and time.time() < end:
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert table.count() == 7 and spark.conf.get(key) == setting


def documents(n):
    rng = random.Random(3)
    base = sentence(rng, 300).split()
    rows = []
    for k in range(n):
        words = base[:]
        for _ in range(k):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    return rows + [(n + k, t) for k, (_, t) in enumerate(rows[:3])] + [(None, rows[0][1]), (None, ""), (n + 3, None)]


def test_fragment_keys_that_classes_share(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PACK_KEYS", 100)
    rows, threshold, bits = documents(12), Fraction(8, 10), 6
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    packs = jaccard_join.fragment_packs(common.id_and_text(df), 5, threshold, bits)
    got = [tuple(r) for r in jaccard_join.met_keys(packs).collect()]
    of = {}
    for s in jaccard_join.shingle_sets(pa.array([t or "" for _, t in rows]), 5):
        for key in jaccard_join.fragment_keys(s, threshold).tolist():
            of.setdefault(key >> 64 - bits - 32, set()).add(jaccard_join._identity(s)[0])
    assert sorted(got) == sorted((key, cls) for key, all_of in of.items() if len(all_of) > 1 for cls in all_of)
    sizes = packs.select(F.length("marks").alias("m"), F.length("owners").alias("o")).collect()
    assert got and all(2 * r.m == r.o for r in sizes) and len(sizes) < sum(r.m for r in sizes) / 4


def test_overlaps_in_cells(spark, monkeypatch):
    rows = documents(9)
    sets = {jaccard_join._identity(s)[0]: set(s.tolist()) for s in jaccard_join.shingle_sets(pa.array([t or "" for _, t in rows]), 5) if len(s)}
    names = sorted(sets)
    pairs = [(a, b, star) for k, a in enumerate(names) for b in names[k + 1 :] for star in (names[(k + 1) % 2],)]
    table = spark.createDataFrame([(c, np.array(sorted(sets[c]), np.uint64).view(np.int64).tolist()) for c in names], "cls long, shingles array<long>")
    sizes = spark.createDataFrame([(c, len(sets[c])) for c in names], "cls long, n long")
    for most in (1 << 20, 600):  # shared cells, and a grid for each star
        monkeypatch.setattr(jaccard_join, "CELL_GRAMS", most)
        given = spark.createDataFrame(pairs, "a long, b long, star long")
        got = jaccard_join.partial_overlaps(given, table.union(table), sizes).collect()
        plain = jaccard_join.partial_overlaps(given, table, sizes, apart=False).collect()
        want = {(a, b): (len(sets[a]), len(sets[b]), len(sets[a] & sets[b])) for a, b, _ in pairs}
        assert {(r.a, r.b): (r.n_a, r.n_b, r.shared) for r in got} == want and len(got) == len(pairs)
        assert {(r.a, r.b): (r.n_a, r.n_b, r.shared) for r in plain} == want
        assert all(sum(r.apart) == len(sets[r.a] ^ sets[r.b]) for r in got)
