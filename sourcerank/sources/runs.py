"""Run directories: what kind of run a path belongs to, and which file to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: directory-name patterns -----------------------------------
NUMERIC_DIR = r"(?:^|/)(\d+(?:\.\d+)?)/"
CHECKPOINT_DIR = r"(?:^|/)checkpoint-(\d+)(?:/|$)"
NDOC_DIR = r"(?:^|/)(\d+)docs?(?:-[^/]*)?(?:/|$)"
SWEEP_DIR = r"(?:^|/)lr([^_/]+)_steps(\d+)[^/]*(?:/|$)"
DAMPING_DIR = r"(?:^|/)damping_([^/]+)(?:/|$)"
RANDOM_RUN = r"^models_random_(\d{1,3})$"
INFLUENCE_RUN = r"^models_infl_(.+)_(\d{1,3})$"
EVAL_FILE = r"logit_eval_depth(\d+)_results(?:_(output|equal))?\.json$"
# ------------------------------------------------------------------------------


def _part(path: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(path, pattern, group), F.lit(""))


def _number(text: Column) -> Column:
    return text.try_cast("double")


def parse_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """Add what the path says: numeric x, checkpoint, n_docs, learning rate, steps, damping, depth, format."""
    p = F.col(path)
    damp = _part(p, DAMPING_DIR)
    depth = _part(p, EVAL_FILE)
    return files.select(
        "*",
        _number(_part(p, NUMERIC_DIR)).alias("x_value"),
        _part(p, CHECKPOINT_DIR).cast("int").alias("checkpoint"),
        _part(p, NDOC_DIR).cast("int").alias("n_docs"),
        _number(_part(p, SWEEP_DIR)).alias("learning_rate"),
        _part(p, SWEEP_DIR, 2).cast("int").alias("max_steps"),
        _number(damp).alias("damping"),
        F.coalesce(damp == "none", F.lit(False)).alias("is_heuristic"),
        depth.cast("int").alias("depth"),
        F.when(depth.isNotNull(), F.coalesce(_part(p, EVAL_FILE, 2), F.lit("returns"))).alias("format"),
    )


def preferred_file(files: DataFrame, prefix: str, suffix: str, path: str = "path") -> DataFrame:
    """(run_dir, path): the exact name when present, else the first name with the prefix.

    A combining minimum per directory.
    """
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    run = F.regexp_extract(path, r"^(.*)/[^/]+$", 1)
    rows = files.select(run.alias("run_dir"), name.alias("name"), F.col(path).alias("path")).filter(
        F.col("name").startswith(prefix) & F.col("name").endswith(suffix)
    )
    exact = F.col("name") != prefix + suffix
    return rows.groupBy("run_dir").agg(F.min_by("path", F.struct(exact, F.col("name"))).alias("path"))


def preferred_variant(files: DataFrame, keys: list[str], variant: str, order: list[str]) -> DataFrame:
    """First variant of ``order`` present per key; others are skipped.

    A file directly in the directory has the variant '' and goes first.
    """
    place = F.array_position(F.array(*[F.lit(v) for v in ["", *order]]), F.col(variant))
    rest = [c for c in files.columns if c not in keys]
    listed = files.withColumn("__p", place).filter("__p > 0")
    return listed.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("__p")).alias("r")).select(*keys, "r.*")
