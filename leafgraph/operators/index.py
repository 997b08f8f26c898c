"""The compact index: one row a file with its dependencies, its statistics, and how it is built, saved, rebuilt in part and merged."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.operators import graph as G
from leafgraph.operators import health as H
from leafgraph.sources import tree

# The schema's number and the types of edges.
INDEX_SCHEMA = 1
EDGE_TYPES = ("delegate", "include", "read-ref", "ref")

DEPS = "array<struct<to: string, type: string, parallel: boolean>>"
FILES = f"path string, type string, missing boolean, title string, desc string, hash string, size long, placeholders array<string>, deps {DEPS}"
_ENTRY = "struct<type: string, missing: boolean, title: string, desc: string, hash: string, size: long, placeholders: array<string>, deps: array<struct<to: string, type: string, parallel: boolean>>>"
_WARNING = "struct<type: string, path: string, message: string>"
_JSON = f"schema int, generated_at string, root string, files map<string, {_ENTRY}>, cycles array<string>, missing array<string>, warnings array<{_WARNING}>"


def compact(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Files (path, type, missing, title, desc, hash, size, placeholders, deps); ``deps`` in the order of the text."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", F.struct(F.col("dst").alias("to"), "type", "parallel").alias("d"))))
    deps = edges.groupBy(F.col("src").alias("id")).agg(F.transform(ordered, lambda x: x["d"]).alias("deps"))
    return nodes.join(deps, "id", "left").withColumn("deps", F.coalesce("deps", F.array().cast(DEPS))).select(F.col("id").alias("path"), "type", "missing", "title", "desc", "hash", "size", "placeholders", "deps")


def edges_of(files: DataFrame) -> DataFrame:
    """(src, dst, type, parallel, ord) of an index."""
    return files.select(F.col("path").alias("src"), F.posexplode("deps").alias("ord", "d")).select("src", F.col("d.to").alias("dst"), "d.type", F.coalesce("d.parallel", F.lit(False)).alias("parallel"), "ord")


def nodes_of(files: DataFrame) -> DataFrame:
    return files.drop("deps").withColumnRenamed("path", "id")


def stats(files: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row: files, edges, cycles, missing, and edge_types, a map of the types that there are.  One pass over the files, nothing is exploded."""
    n = lambda t: F.sum(F.size(F.filter("deps", lambda d: d["type"] == t)))
    out = files.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.size("deps")), F.lit(0)).alias("edges"), F.count_if("missing").alias("missing"), *(n(t).alias(f"n {t}") for t in EDGE_TYPES))
    cycles = warnings.where("type = 'circular'").agg(F.count_distinct("message").alias("cycles"))
    types = F.map_filter(F.create_map(*(x for t in EDGE_TYPES for x in (F.lit(t), F.coalesce(F.col(f"`n {t}`"), F.lit(0)).cast("long")))), lambda _, v: v > 0)
    return out.crossJoin(cycles).select("files", "edges", "cycles", "missing", types.alias("edge_types"))  # one row on each side


def build(rows: DataFrame, root: str = ".") -> tuple[DataFrame, DataFrame]:
    """Files and warnings of the index of a tree's rows (path, bytes, content, valid): entry, dependency file and all that they lead to."""
    docs = rows.where(F.endswith("path", F.lit(".md"))).select("path", "content")
    own = tree.declared(rows.where(F.col("path") == tree.DEPENDENCY_FILE).select("path", "content"))
    nodes, edges, warnings = G.build(docs, tree.entry(rows).select(F.col("path").alias("id")), declared=None if own.isEmpty() else own, files=rows, root=root)
    return compact(nodes, edges), warnings


def within(rows: DataFrame, scope: str) -> tuple[DataFrame, str]:
    """The rows below a folder, by their paths from there, and the folder's name with its slash."""
    scope = scope.replace("\\", "/").strip("/")
    if not scope:
        raise ValueError("a scope cannot be empty")
    below = rows.where(F.startswith("path", F.lit(f"{scope}/")))
    if below.isEmpty():
        raise ValueError(f"no files below {scope}")
    return below.withColumn("path", F.substr("path", F.lit(len(scope) + 2))), f"{scope}/"


def build_scoped(rows: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """The index of one folder as if it were the root, with all paths from the whole root: of files, targets and warnings."""
    below, prefix = within(rows, scope)
    files, warnings = build(below, scope)
    named = lambda c: F.concat(F.lit(prefix), c)
    deps = F.transform("deps", lambda d: F.struct(named(d["to"]).alias("to"), d["type"].alias("type"), d["parallel"].alias("parallel")))
    return files.withColumns({"path": named(F.col("path")), "deps": deps}), warnings.withColumn("path", named(F.col("path")))


def merge(existing: tuple[DataFrame, DataFrame], fresh: tuple[DataFrame, DataFrame], scope: str) -> tuple[DataFrame, DataFrame]:
    """The index with everything below ``scope`` replaced, other paths of the fresh one taken over, and the warnings of both, each once."""
    prefix = scope.replace("\\", "/").strip("/") + "/"
    old = existing[0].where(~F.startswith("path", F.lit(prefix))).join(fresh[0].select("path"), "path", "left_anti")
    return old.unionByName(fresh[0]), existing[1].unionByName(fresh[1]).distinct()


def stale(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Files of the index that vanished or differ from the tree's rows."""
    from leafgraph.functions import text as X

    current = rows.select("path", F.coalesce(X.content_hash(F.col("content")), F.lit("")).alias("hash"))
    return H.changed(files.where("not missing").select("path", "hash"), current)


def to_json(files: DataFrame, warnings: DataFrame, root: str, generated_at: str) -> DataFrame:
    """One row with the index as a JSON document; empty fields are left out.  Where it is too large for a row, keep the tables."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    deps = F.transform("deps", lambda d: F.struct(d["to"].alias("to"), d["type"].alias("type"), F.when(d["parallel"], True).alias("parallel")))
    entry = F.struct("type", F.when(F.col("missing"), True).alias("missing"), *(F.nullif(c, F.lit("")).alias(c) for c in ("title", "desc", "hash")), F.when(F.col("size") > 0, F.col("size")).alias("size"), some("placeholders").alias("placeholders"), F.when(F.size("deps") > 0, deps).alias("deps"))
    listed = files.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", F.to_json(entry).alias("e"))))).alias("m"), F.array_sort(F.collect_list(F.when(F.col("missing"), F.col("path")))).alias("gone"))
    said = warnings.agg(F.array_sort(F.collect_set(F.when(F.col("type") == "circular", F.col("message")))).alias("cycles"), F.array_sort(F.collect_set(F.struct("type", "path", "message"))).alias("warnings"))
    n = stats(files, warnings).select(F.struct("files", "edges", "edge_types", "cycles", "missing").alias("stats"))
    made = F.transform_values("m", lambda _, v: F.from_json(v, _ENTRY))
    doc = F.struct(F.lit(INDEX_SCHEMA).alias("schema"), F.lit(generated_at).alias("generated_at"), F.lit(root).alias("root"), "stats", made.alias("files"), "cycles", F.col("gone").alias("missing"), "warnings")
    return n.crossJoin(listed).crossJoin(said).select(F.to_json(doc).alias("json"))  # one row on each side


def from_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files and warnings of a JSON document that ``to_json`` made; another schema fails the read."""
    row = spark.read.schema(_JSON).option("multiLine", "true").json(path)
    row = row.where(F.assert_true(F.col("schema").eqNullSafe(INDEX_SCHEMA), F.lit("unknown index schema")).isNull())
    e = row.select(F.explode("files").alias("path", "e")).select("path", "e.*")
    blank, none = F.lit(""), F.array().cast("array<string>")
    files = e.select("path", "type", F.coalesce("missing", F.lit(False)).alias("missing"), *(F.coalesce(c, blank).alias(c) for c in ("title", "desc", "hash")), F.coalesce("size", F.lit(0).cast("long")).alias("size"), F.coalesce("placeholders", none).alias("placeholders"), F.coalesce("deps", F.array().cast(DEPS)).alias("deps"))
    return files, row.select(F.explode("warnings").alias("w")).select("w.*")


def write_json(doc: DataFrame, path: str) -> None:
    """The one row of ``to_json`` as a file of the driver's."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(doc.first()[0] + "\n")


def cached(spark: SparkSession, rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The saved index where there is one that nothing differs from, else a new one."""
    if os.path.exists(path):
        try:
            files, warnings = from_json(spark, path)
            if stale(files, rows).isEmpty():
                return files, warnings
        except Exception as e:  # a document of another schema is no cache
            if "unknown index schema" not in str(e):
                raise
    return build(rows)
