"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

The centroids and the codebooks are fitted on a bounded sample; every row is
then assigned to a cell and its residual coded, and this index is a table.
There are as many cells as the square root of the rows, ``CELLS`` at most.  How
many of them a query probes is measured on the sample: enough that its rows find
``TARGET`` of their true neighbours there, which are farther apart than those in
the table.  So clustered tables are probed in few cells and formless ones in many.
A query probes that many of its nearest cells, and as many more as it takes to
hold enough rows.  A unit of work is a block of a cell's rows with a
block of the cell's queries, so hot cells are split on both sides.  In a unit
the distances of codes come from a query's asymmetric table; the best of each
query are reranked by exact distance in double precision on the original
vectors.

Vectors are compared with those of their own length, and each length has an index.

Edge cases: vectors that are null, zero or hold null or non-finite components
take no part, as rows with a null id; a query id with several vectors is answered
for the shortest, of equally long ones the smallest; with fewer
rows than neighbours all are returned; ties go to the smaller id; equal rows are
candidates of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafgraph.llm.store import scratch, stored
from leafgraph.llm.vectors import matrix, sample_matrix, usable

SAMPLE, CELLS, TARGET, RERANK, ROW_BLOCK, QUERY_BLOCK = 8192, 64, 0.97, 256, 4096, 256
TRIED = 512


def nearest_of(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers**2).sum(1) - 2 * x @ centers.T, axis=1)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    centers = x[np.sort(np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        own = nearest_of(x, centers)
        n = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


class Quantiser:
    """Coarse centroids, and a codebook for each slice of the residual."""

    def __init__(self, sample: np.ndarray, cells: int, parts: int = 32, codes: int = 256):
        self.centers = k_means(sample, cells, 8, 1)
        residual = sample - self.centers[nearest_of(sample, self.centers)]
        self.slices = np.array_split(np.arange(sample.shape[1]), min(parts, sample.shape[1]))
        self.books = [k_means(residual[:, s], codes, 5, 2 + i) for i, s in enumerate(self.slices)]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest_of(x, self.centers)
        residual = x - self.centers[cell]
        return cell, np.stack([nearest_of(residual[:, s], b) for s, b in zip(self.slices, self.books, strict=True)], axis=1).astype(np.uint8)

    def nearest_cells(self, queries: np.ndarray) -> np.ndarray:
        return np.argsort((self.centers**2).sum(1) - 2 * queries @ self.centers.T, axis=1, kind="stable")

    def distances(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries and coded rows of a cell, from a table for each query."""
        residual, out = queries - self.centers[cell], np.zeros((len(queries), len(codes)))
        for j, (s, book) in enumerate(zip(self.slices, self.books, strict=True)):
            out += ((residual[:, None, s] - book[None]) ** 2).sum(2)[:, codes[:, j]]
        return out

    def probes_for(self, sample: np.ndarray, k: int, target: float) -> int:
        """The least number of cells that hold the share ``target`` of the sample rows' true neighbours among the sample."""
        tried, own = sample[:TRIED], nearest_of(sample, self.centers)
        d = (sample**2).sum(1) - 2 * tried @ sample.T
        d[np.arange(len(tried)), np.arange(len(tried))] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
        place = np.argsort(self.nearest_cells(tried), axis=1)  # of each cell among a row's nearest
        found = np.sort(np.take_along_axis(place, own[near], 1).ravel())
        return int(found[min(len(found) - 1, int(np.ceil(target * len(found))))]) + 1 if len(found) else 1


def search(rows: DataFrame, queries: DataFrame, k: int = 10, ids: str = "vec_id", vector: str = "embedding", cells: int | None = None, probes: int | None = None, rerank: int = RERANK, sample: int = SAMPLE, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, ``ids``, score: the nearest rows found for every row of ``queries``, but its own id."""
    spark = rows.sparkSession
    rows, queries = (usable(x, ids, vector).select(F.col(ids).cast("long").alias("id"), "v", "dims") for x in (rows, queries))
    queries = queries.groupBy("id").agg(F.min(F.struct("dims", "v")).alias("x")).select("id", "x.v", "x.dims")
    shared = rows.select("dims").distinct().join(queries.select("dims").distinct(), "dims").collect()  # at most one row a length
    found = []
    for n in sorted(r["dims"] for r in shared):
        own, asked = (x.where(F.col("dims") == n).select("id", "v") for x in (rows, queries))
        with scratch(spark):
            found.append(stored(search_length(own, asked, k, ids, cells, probes, rerank, sample, row_block, query_block), "ann-found", result=True))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], f"query_id long, rank int, {ids} long, score double")


def search_length(rows: DataFrame, queries: DataFrame, k: int, ids: str, cells: int | None, probes: int | None, rerank: int, sample: int, row_block: int, query_block: int) -> DataFrame:
    """``search`` for rows and queries (id, v) that all have vectors of one length; there is at least one row."""
    fitted = sample_matrix(rows, "id", sample)
    model = Quantiser(fitted, cells or min(CELLS, max(1, round(rows.count() ** 0.5)), max(1, len(fitted) // 16)))
    probes = probes or model.probes_for(fitted, k, TARGET)

    def code(batches):
        for b in batches:
            cell, codes = model.code(matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "cell", "codes"])

    index = stored(rows.mapInArrow(code, "id long, cell int, codes binary"), "ann-index")
    held = np.zeros(len(model.centers), np.int64)
    for cell, n in index.groupBy("cell").count().collect():  # at most one row a cell
        held[cell] = n

    def probe(batches):
        for b in batches:
            q = matrix(b.column(1))
            order = model.nearest_cells(q)
            before = np.cumsum(held[order], axis=1) - held[order]
            use = (held[order] > 0) & ((np.arange(order.shape[1]) < probes) | (before <= max(k, rerank)))
            at, j = np.nonzero(use)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(order[at, j], pa.int32()), b.column(1).take(pa.array(at))], names=["id", "cell", "v"])

    asked = stored(queries.mapInArrow(probe, "id long, cell int, v array<double>"), "ann-queries")
    asking = np.zeros(len(held), np.int64)
    for cell, n in asked.groupBy("cell").count().collect():
        asking[cell] = n
    row_blocks, query_blocks = (np.maximum(1, -(-n // size)).tolist() for n, size in ((held, row_block), (asking, query_block)))
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cell") + 1)
    own = lambda values: F.pmod(F.xxhash64("id"), at(values)).cast("int")
    left = index.where(at([int(n > 0) for n in asking]) == 1).select("cell", own(row_blocks).alias("r"), F.explode(F.sequence(F.lit(0), (at(query_blocks) - 1).cast("int"))).alias("q"), "id", "codes", F.lit(None).cast("array<double>").alias("v"))
    right = asked.select("cell", F.explode(F.sequence(F.lit(0), (at(row_blocks) - 1).cast("int"))).alias("r"), own(query_blocks).alias("q"), "id", F.lit(None).cast("binary").alias("codes"), "v")

    def unit(table: pa.Table) -> pa.Table:
        is_row = np.array(table["codes"].is_valid())
        coded, asked_here = table.filter(pa.array(is_row)).sort_by("id"), table.filter(pa.array(~is_row))
        if not len(coded) or not len(asked_here):
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        codes = np.frombuffer(b"".join(coded["codes"].to_pylist()), np.uint8).reshape(len(coded), -1)
        row_ids, query_ids = coded["id"].to_numpy(), asked_here["id"].to_numpy()
        out = []
        for low in range(0, len(query_ids), 64):  # distances of some queries at a time
            part = query_ids[low : low + 64]
            d = model.distances(matrix(asked_here["v"].slice(low, 64)), table["cell"][0].as_py(), codes)
            other = part[:, None] != row_ids[None]
            d = np.where(other & ~np.isnan(d), d, np.inf)  # too large for a double: the farthest
            best = np.lexsort((np.broadcast_to(row_ids, d.shape), d, ~other), axis=1)[:, :rerank]
            ok = np.take_along_axis(other, best, 1)
            out.append((np.repeat(part, best.shape[1])[ok.ravel()], row_ids[best][ok], np.take_along_axis(d, best, 1)[ok]))
        return pa.table(dict(zip(("query_id", "id", "d"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    near = left.unionByName(right).groupBy("cell", "r", "q").applyInArrow(unit, "query_id long, id long, d double")
    best = Window.partitionBy("query_id").orderBy("d", "id")
    near = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= rerank).select("query_id", "id").distinct()
    exact = near.join(rows, "id").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("w")), "query_id")
    exact = exact.select("query_id", "id", F.sqrt(F.expr("aggregate(zip_with(v, w, (x, y) -> (x - y) * (x - y)), double(0), (s, x) -> s + x)")).alias("score"))
    final = Window.partitionBy("query_id").orderBy("score", "id")
    return exact.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(ids), "score")


def op1_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.where("vec_id % 100 = 0"))


QUERIES = {"op1_ivf_pq": op1_ivf_pq}
