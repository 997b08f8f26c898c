"""Embedding near-duplicates by PCA-ordered tiled comparison, within equal labels and lengths.

Equal vectors are one class first.  The classes' unit vectors are turned into
the axes of a PCA (of second moments, so products stay as they are), one for each
length, fitted on a bounded sample; a length with fewer sampled rows than
dimensions keeps its own axes.  Two unit vectors whose angles to the first axis differ by more
than the threshold's angle cannot link, so rows are laid in bins of that angle;
bins are split into tiles of bounded size by a hash, and only tiles of near bins
are compared.  Within two tiles the products of the leading dimensions come
first; the rest of a product is at most the product of the suffix norms, and a
pair stops as soon as the sum cannot reach the threshold.  What is left is
decided by the cosine of the original vectors in double precision.  Only original
vectors, in their own type, are shuffled; axes are applied where two tiles meet.

A comparison returns each row's number of links and its root in a spanning
forest of the links, never the pairs.

Edge cases: vectors that are null, zero or hold null or non-finite components,
rows with a null label and rows with a null id link with nothing and are returned (component_id null where the id is); repeated
rows count as vectors of their own; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.llm.components import components
from leafgraph.llm.store import scratch, stored
from leafgraph.llm.vectors import by_length, matrix, sample_lists, scaled, usable

SAMPLE, TILE = 8192, 2048
STEPS = (8, 16, 32)


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float, strip: int = 256):
    """Blocks of index pairs (i, j) of rotated unit vectors whose cosine may reach the threshold."""
    dims = a.shape[1]
    cuts = [0, *(s for s in STEPS if s < dims), dims]
    tail_a, tail_b = ([np.sqrt((x[:, c:] ** 2).sum(1)) for c in cuts[1:]] for x in (a, b))
    for low in range(0, len(a), strip):
        part = a[low : low + strip]
        total = part[:, : cuts[1]] @ b[:, : cuts[1]].T
        i, j = np.nonzero(total + tail_a[0][low : low + strip, None] * tail_b[0] >= threshold - 1e-9)
        total = total[i, j]
        for k in range(1, len(cuts) - 1):
            if not len(i):
                break
            span = slice(cuts[k], cuts[k + 1])
            if len(i) * 4 > part.shape[0] * len(b):  # too many left to pick them out one by one
                total += (part[:, span] @ b[:, span].T)[i, j]
            else:
                total += np.einsum("ij,ij->i", part[i, span], b[j, span])
            ok = total + tail_a[k][low + i] * tail_b[k][j] >= threshold - 1e-9
            i, j, total = i[ok], j[ok], total[ok]
        if len(i):
            yield i + low, j


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' component, for edges a[i]-b[i]."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def near_duplicates(rows: DataFrame, *args, **named) -> DataFrame:
    """``ids``, n_links, component_id, kept for every row; see ``compared``."""
    with scratch(rows.sparkSession):
        return stored(compared(rows, *args, **named), "near-duplicates", result=True)


def compared(rows: DataFrame, threshold: float = 0.93, ids: str = "vec_id", vector: str = "embedding", label: str = "label", sample: int = SAMPLE, tile: int = TILE) -> DataFrame:
    """``ids``, n_links, component_id, kept for every row."""
    keyed = usable(rows.select(ids, vector, label).where(F.col(label).isNotNull()), ids, vector).select(F.col(ids).alias("id"), F.struct(F.col(label).alias("label"), "dims").alias("label"), F.col(vector).alias("v"))
    keyed = keyed.withColumns({"k": F.xxhash64(F.lit(7), "v"), "l": F.xxhash64(F.lit(13), "v")})
    classes = stored(keyed.groupBy("label", "k", "l").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v")), "near-classes")
    axes = {}
    for _, taken in by_length(sample_lists(classes, "id", sample)):
        if len(taken) >= taken.shape[1]:
            unit = scaled(taken)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            axes[taken.shape[1]] = np.linalg.eigh(unit.T @ unit)[1][:, ::-1]
    width = max(math.acos(threshold) / 2, 1e-6)

    def units(v: np.ndarray) -> np.ndarray:
        """The vectors' directions along the axes of their length."""
        u = scaled(v)
        u = u / np.linalg.norm(u, axis=1, keepdims=True)
        return u @ axes[v.shape[1]] if v.shape[1] in axes else u

    @F.arrow_udf("int")
    def bin_of(vectors: pa.Array) -> pa.Array:
        out = np.zeros(len(vectors), np.int32)
        for at, v in by_length(vectors):
            out[at] = np.arccos(np.clip(units(v)[:, 0], -1, 1)) // width
        return pa.array(out)

    turned = stored(classes.select("label", "id", "n", "v", bin_of(F.col("v")).alias("bin")), "near-turned")
    per_bin = turned.groupBy("label", "bin").agg(F.count("*").alias("c"))
    per_label = per_bin.groupBy("label").agg(F.sum("c").alias("total"))
    # a label that fits one tile needs no bins
    bins = per_bin.join(per_label, "label").select("label", F.expr(f"if(total <= {tile}, -1, bin)").alias("b"), "c").groupBy("label", "b").agg(F.ceil(F.sum("c") / tile).cast("int").alias("tiles"))
    tiles = bins.select("label", "b", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t"))
    other = tiles.select(F.col("label").alias("label2"), F.col("b").alias("b2"), F.col("t").alias("t2"))
    pairs = tiles.join(other, F.expr("label = label2 and b2 between b and b + 2 and (b2 > b or t2 >= t)"))
    name = F.concat_ws(":", "b", "t", "b2", "t2").alias("unit")
    sides = pairs.select("label", "b", "t", name, F.lit(0).alias("side")).unionByName(pairs.where("b2 <> b or t2 <> t").select("label", F.col("b2").alias("b"), F.col("t2").alias("t"), name, F.lit(1).alias("side")))
    placed = turned.join(per_label, "label").withColumn("b", F.expr(f"if(total <= {tile}, -1, bin)")).join(bins, ["label", "b"])
    placed = placed.withColumn("t", F.pmod(F.xxhash64("id"), "tiles").cast("int")).select("label", "b", "t", "id", "n", "v")

    def compare(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        own, n, v = table["id"].to_numpy(), table["n"].to_numpy(), scaled(matrix(table["v"]))
        u = units(v)
        norms = np.sqrt((v * v).sum(1))
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        alone = right is left
        ends_a, ends_b, degree = [], [], np.zeros(len(own), np.int64)
        both = table["unit"][0].as_py().split(":")
        if alone and both[:2] != both[2:]:
            right = right[:0]
        root = np.arange(len(own))
        for i, j in linked_pairs(u[left], u[right], threshold):
            i, j = left[i], right[j]
            if alone:
                i, j = i[i < j], j[i < j]
            ok = np.einsum("ij,ij->i", v[i], v[j]) / (norms[i] * norms[j]) >= threshold
            i, j = i[ok], j[ok]
            np.add.at(degree, i, n[j])
            np.add.at(degree, j, n[i])
            fresh = root[i] != root[j]
            ends_a.append(i[fresh])
            ends_b.append(j[fresh])
            root = forest(len(own), np.concatenate([np.arange(len(own)), i[fresh]]), np.concatenate([root, j[fresh]]))
        touched = np.flatnonzero(degree)
        return pa.table({"a": own[touched], "b": own[root[touched]], "n": degree[touched]})

    found = stored(placed.join(sides, ["label", "b", "t"]).groupBy("label", "unit").applyInArrow(compare, "a long, b long, n long"), "near-links")
    degrees = found.groupBy("a").agg(F.sum("n").alias("degree")).withColumnRenamed("a", "class")
    comps = components(found.select("a", "b")).withColumnRenamed("id", "class")
    named = classes.select("label", "k", "l", F.col("id").alias("class"), "n").join(degrees, "class", "left").join(comps, "class", "left")
    members = keyed.select("id", "label", "k", "l").join(named, ["label", "k", "l"])
    members = members.select("id", (F.col("n") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    # a repeated id may stand for several vectors; each row of the table is returned once
    members = members.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select(F.col(ids).alias("id")).join(members, "id", "left")
    out = out.select(F.col("id").alias(ids), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(ids) == F.col("component_id"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op5_embedding_near_dedup": op5_embedding_near_dedup}
ORACLE = {"op5_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT b, c FROM reach JOIN links ON a = id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_links, min(c) AS component_id, id = min(c) AS kept FROM reach LEFT JOIN n ON a = id GROUP BY id
"""}
