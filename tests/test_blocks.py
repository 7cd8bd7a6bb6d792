"""Block matrices against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourcerank.operators import blocks
from sourcerank.operators import vectors as vo

rng = np.random.default_rng(6)


def frame(spark, rows, key="uid"):
    return spark.createDataFrame([(f"v{k:03}", [float(x) for x in r]) for k, r in enumerate(rows)], f"{key} string, vec array<double>")


def whole(df, key="uid"):
    """Chunked rows as {key: vector}."""
    out = {}
    for r in df.orderBy("chunk").collect():
        out[r[key]] = out.get(r[key], []) + list(r["vec"])
    return out


@pytest.mark.parametrize("rows, size", [(7, 3), (100, 5), (25, 40)])
def test_products(spark, rows, size):
    data, asked = rng.normal(size=(60, 11)), rng.normal(size=(9, 11))
    got = blocks.grid_dot(vo.chunked(frame(spark, data), "uid", size), vo.chunked(frame(spark, asked, "query_uid"), "query_uid", size), rows)
    assert "Broadcast" not in got._jdf.queryExecution().optimizedPlan().toString()
    table = {(r["query_uid"], r["uid"]): r["score"] for r in got.collect()}
    want = asked @ data.T
    assert len(table) == want.size
    assert all(abs(table[f"v{q:03}", f"v{d:03}"] - want[q, d]) < 1e-9 for q in range(9) for d in range(60))


@pytest.mark.parametrize("scale", [1.0, 1e-4])
def test_inverse_root_equals_eigh(spark, scale):
    data = rng.normal(size=(200, 10)) * np.linspace(0.05, 3, 10) * scale
    matrix, _ = blocks.row_blocks(vo.chunked(frame(spark, data), "uid", 4), rows=30)
    matrix = matrix.cache()
    got = np.zeros((10, 10))
    for r in blocks.cells(blocks.inverse_root(blocks.moment(matrix), damping=1e-6 * scale**2), 4).collect():
        got[r["i"], r["j"]] = r["m"]
    values, basis = np.linalg.eigh(data.T @ data / len(data))
    want = (basis / np.sqrt(values + 1e-6 * scale**2)) @ basis.T
    assert np.abs(got - want).max() < 1e-6 * np.abs(want).max()


def test_whitening_equals_the_module_form(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    vecs = table.select(F.col("vec_id").cast("string").alias("uid"), F.col("embedding").alias("vec"))
    want = {r["uid"]: np.array(r["vec"]) for r in vo.whitened(vecs, damping=1e-6).collect()}
    got = whole(blocks.whitened(vo.chunked(vecs, "uid", 24), damping=1e-6, rows=128))
    assert want.keys() == got.keys()
    assert max(np.abs(want[k] - np.array(got[k])).max() for k in want) < 1e-6


def test_nothing_to_whiten(spark):
    none = vo.chunked(frame(spark, np.ones((1, 4))).limit(0), "uid", 2)
    assert blocks.whitened(none).count() == 0
    assert blocks.grid_dot(none, none.withColumnRenamed("uid", "query_uid")).count() == 0
