"""How often files change: the commits of a version history, orders that keep rarely changed files first, and how stable a text's beginning is."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGED = "path string"


def git_changes(spark: SparkSession, root: str) -> DataFrame:
    """A row (path) for each file of each commit below ``root``; none without git or a repository.  The driver reads git's output."""
    try:
        said = subprocess.run(["git", "-C", root, "-c", "core.quotepath=false", "log", "--format=", "--name-only", "--relative", "--", "."], capture_output=True, text=True)
    except OSError:
        return spark.createDataFrame([], CHANGED)
    paths = [(x.strip(),) for x in said.stdout.splitlines() if x.strip()] if said.returncode == 0 else []
    return spark.createDataFrame(paths, CHANGED)


def change_counts(changes: DataFrame) -> DataFrame:
    """(path, commits)."""
    return changes.groupBy("path").agg(F.count("*").alias("commits"))


def with_counts(files: DataFrame, counts: DataFrame) -> DataFrame:
    """The files (path, ...) with ``commits``, 0 where the history doesn't know them; ordered by (commits, path) the stable ones come first."""
    return files.join(counts, "path", "left").withColumn("commits", F.coalesce("commits", F.lit(0).cast("long")))


def prefix_stability(old: Column, new: Column) -> tuple[Column, Column, Column]:
    """Lines at the beginning of the new text that are those of the old, all its lines, and their ratio, rounded to 4 places."""
    a, b = F.split(old, "\n", -1), F.split(new, "\n", -1)
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    common = F.when(differ > 0, differ - 1).otherwise(F.size(b)).cast("long")
    return common, F.size(b).cast("long"), F.round(common / F.size(b), 4)
