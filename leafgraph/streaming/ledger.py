"""The risk ledger as a stream: active tags with one state row a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.operators.health import RISK_TAGS

EVENT = "seq long, ts string, file string, action string, tag string, note string"


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(folder)


def active_tags(stream: DataFrame) -> DataFrame:
    """(file, tags): the tags whose last addition comes after their last clearing, whatever order events arrive in."""
    last = lambda action, tags: F.max(F.when((F.col("action") == action) & F.col("tag").isin(*tags), F.col("seq")))
    seen = stream.groupBy("file").agg(*(f for i, t in enumerate(RISK_TAGS) for f in (last("add", [t]).alias(f"a{i}"), last("clear", [t, "all"]).alias(f"c{i}"))))
    on = F.filter(F.array(*(F.when(F.col(f"a{i}").isNotNull() & (F.col(f"c{i}").isNull() | (F.col(f"a{i}") > F.col(f"c{i}"))), t) for i, t in enumerate(RISK_TAGS))), lambda x: x.isNotNull())
    return seen.select("file", F.array_sort(on).alias("tags"))
