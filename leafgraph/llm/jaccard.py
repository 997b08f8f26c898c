"""N-gram Jaccard join by a prefix tree.

1. Every text becomes its set of n-gram hashes.  Texts with equal sets are one
   class, so copies are never compared.
2. A set of size n that links with another shares all but n - ceil(t n) of its
   n-grams with it.  Ordered by document frequency, two such sets share an
   n-gram among their first n - ceil(t n) + 1.  Frequencies are counted exactly;
   for large sets it is enough to look at a fixed range of the hashes, which
   holds more than that many n-grams of each.  N-grams of one document alone
   lead to nothing, so a document with enough of those is done.
3. What shares such an n-gram, at a size that fits, is one block.  Sizes lie in
   bands so wide that only sets of one band or of neighbours can link.  Large
   blocks are split into tiles of a band and of bounded total size, and pairs of
   tiles of near bands are the units.
4. In a unit the sets, ordered by hash, form a compressed trie.  The sets
   walk it together, sharing the overlap of common beginnings; a set leaves a subtree when the remaining lengths cannot reach the threshold any more, or
   when all of it is in the set's component already.
5. The links found, a spanning forest of each unit, join the classes.

The result is exact: no link between different texts is lost, and none is made
below the threshold.

Edge cases: a text of fewer words than n is one n-gram; one without words, or
null, has an empty set, links with nothing and is its own component; rows that
repeat a doc_id are rows of the result; a null doc_id is never linked and its
component is null; texts of any length are compared as a whole; equal texts are
one class, named by its smallest id; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafgraph.llm.blocks import arrow_batches, bucket_bounds, buckets_of, mixed, packed, set_hashes, shingle_sets, text_and_offsets, text_blocks, trim, unpacked
from leafgraph.llm.components import components
from leafgraph.llm.store import scratch, stored

#: Sets at least this large are looked at in a range of the hashes only.
LARGE_SET = 256
#: N-grams and sets in a tile.
TILE, TILE_SETS = 120_000, 800

_LEVELS = np.array([0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A], np.uint64)
_ROWS = "kind int, bucket int, level int, doc_id long, n long, m long, set_hash binary, keys binary, owners binary, docs binary"
_FOUND = "kind int, level int, doc_id long, n long, m long, set_hash binary, token long, frequency int"


def needed(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The length of the beginning that must be looked at."""
    return n + (-num * n) // den + 1


def range_share(num: int, den: int) -> float:
    """The share of the hashes for large sets: the beginning's share and a margin of many standard deviations."""
    return min(1.0, (1 - num / den) * 2 + 0.1)


def scatter(docs: DataFrame, width: int, num: int, den: int, buckets: int) -> DataFrame:
    """A row for each document (kind 1), one for each level that it is looked at in (kind 2), and blobs of n-grams by bucket (kind 0)."""
    limit = np.uint64(min(2**64 - 1, int(range_share(num, den) * 2**64)))

    def run(batches):
        for rows, data, offsets in text_blocks(batches):
            sets, bounds = shingle_sets(data, offsets, width)
            n = np.diff(bounds)
            ids, known = rows.column(0), ~np.array(rows.column(0).is_null())
            own = np.repeat(np.arange(len(n)), n)
            inside = sets <= limit
            m = np.bincount(own[inside], minlength=len(n))
            high = known & (n >= LARGE_SET * num // den)
            short = high & (m <= needed(n, num, den))
            low = known & (n > 0) & ((n * num < LARGE_SET * den) | short)
            hashed = set_hashes(sets, bounds)
            values = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield rows_of(1, np.arange(len(n)) % buckets, None, ids.cast(pa.int64()), n, None, hashed)
            for level, chosen, ok, sizes in ((0, low, low[own], n), (1, high, high[own] & inside, m)):
                if len(some := np.flatnonzero(chosen)):
                    yield rows_of(2, some % buckets, level, values[some], n[some], sizes[some], [hashed[i] for i in some.tolist()])
                keys, owner = mixed(sets[ok] + _LEVELS[level]), own[ok].astype(np.uint32)
                order = np.argsort(keys, kind="stable")
                keys, owner = keys[order], owner[order]
                cut = bucket_bounds(keys, buckets)
                some, blobs = np.flatnonzero(np.diff(cut)), []
                for b in some.tolist():
                    there, index = np.unique(owner[cut[b] : cut[b + 1]], return_inverse=True)
                    blobs.append((packed(keys[cut[b] : cut[b + 1]]), index.astype(np.uint16 if len(there) < 65536 else np.uint32).tobytes(), values[there].tobytes()))
                del keys, owner, order
                for i in range(0, len(blobs), 200):
                    part = blobs[i : i + 200]
                    yield rows_of(0, some[i : i + 200], level, None, None, None, None, *map(list, zip(*part, strict=True)))
            del sets, own, inside
            trim()

    return docs.mapInArrow(run, _ROWS)


_NAMES = [x.split()[0] for x in _ROWS.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in _ROWS.split(", ")]


def rows_of(kind: int, bucket: np.ndarray, level: int | None, *columns) -> pa.RecordBatch:
    """Rows of one kind; columns that are missing are null."""
    n = len(bucket)
    given = [pa.array(np.full(n, kind), pa.int32()), pa.array(bucket, pa.int32()), pa.nulls(n, pa.int32()) if level is None else pa.array(np.full(n, level), pa.int32())]
    for c, t in zip([*columns, *[None] * (len(_TYPES) - 3 - len(columns))], _TYPES[3:], strict=True):
        given.append(pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t))
    return pa.RecordBatch.from_arrays(given, names=_NAMES)


def gather(table: pa.Table) -> pa.Table:
    """The documents' rows, and a row for each n-gram of a document that other documents have too, with its frequency."""
    kind = table["kind"].to_numpy()
    plain = table.filter(pa.array(kind > 0)).select(["kind", "level", "doc_id", "n", "m", "set_hash"])
    parts = [plain.append_column("token", pa.nulls(len(plain), pa.int64())).append_column("frequency", pa.nulls(len(plain), pa.int32()))]
    blobs = table.filter(pa.array(kind == 0))
    for level in (0, 1):
        mine = blobs.filter(pa.array(blobs["level"].to_numpy() == level)) if len(blobs) else blobs
        if not len(mine):
            continue
        keys, docs = [], []
        for k, o, d in zip(mine["keys"].to_pylist(), mine["owners"].to_pylist(), mine["docs"].to_pylist(), strict=True):
            keys.append(unpacked(k))
            docs.append(np.frombuffer(d, np.int64)[np.frombuffer(o, np.uint16 if len(o) == 2 * len(keys[-1]) else np.uint32)])
        keys, docs = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(keys, kind="stable")
        keys, docs = keys[order], docs[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        counts = np.repeat(np.diff(np.r_[first, len(keys)]), np.diff(np.r_[first, len(keys)])).astype(np.int32)
        keys, docs, counts = keys[counts > 1], docs[counts > 1], counts[counts > 1]
        empty = lambda t, k=len(keys): pa.nulls(k, t)
        parts.append(pa.table({"kind": pa.array(np.zeros(len(keys)), pa.int32()), "level": pa.array(np.full(len(keys), level), pa.int32()), "doc_id": docs, "n": empty(pa.int64()), "m": empty(pa.int64()), "set_hash": empty(pa.binary()), "token": keys.view(np.int64), "frequency": counts}))
    trim()
    return pa.concat_tables(parts)


class SetTrie:
    """Ordered sets in a compressed trie; its leaves are a range of the sets in lexicographic order."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.sets, self.num, self.den = sorted(sets, key=lambda s: s.astype(">u8").tobytes()), num, den
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.root = self.grow(0, len(self.sets), 0)

    def grow(self, low: int, high: int, depth: int) -> list:
        """[segment, depth at its end, low, high, least size, largest size, sets that end here, children]"""
        top: list = []
        work = [(low, high, depth, top)]
        while work:
            low, high, depth, into = work.pop()
            a, b = self.sets[low], self.sets[high - 1]
            k = min(len(a), len(b)) - depth
            differ = np.flatnonzero(a[depth : depth + k] != b[depth : depth + k])
            end = depth + (int(differ[0]) if len(differ) else k)
            node = [a[depth:end], end, low, high, int(self.sizes[low:high].min()), int(self.sizes[low:high].max()), [], []]
            into.append(node)
            while low < high and self.sizes[low] == end:
                node[6].append(low)
                low += 1
            while low < high:
                token, last = self.sets[low][end], low + 1
                while last < high and self.sets[last][end] == token:
                    last += 1
                work.append((low, last, end, node[7]))
                low = last
        return top[0]

    def links(self) -> list[tuple[int, int]]:
        """The links of a spanning forest, by lexicographic place.

        All sets walk the trie together: a node holds those that are still in it with their overlaps so far, so a
        segment is met once for all of them.
        """
        m, sizes, num, den = len(self.sets), self.sizes, self.num, self.den
        tokens, rank, df = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(m), sizes)
        column = np.where(df > 1, np.cumsum(df > 1) - 1, -1)  # only these can be shared
        holds = np.zeros((int((df > 1).sum()), m), np.uint8)
        holds[column[rank][column[rank] >= 0], owner[column[rank] >= 0]] = 1
        places, first = owner * len(tokens) + rank, np.cumsum(sizes) - sizes
        root, found = np.arange(m), []
        work = [(self.root, np.arange(m), np.zeros(m, np.int64), 0)]
        while work:
            node, who, overlap, at = work.pop()
            segment, depth, low, high, least, largest, ends, children = node
            ok = (largest * den >= num * sizes[who]) & (least * num <= den * sizes[who])
            if (root[low:high] == root[low]).all():
                ok &= root[who] != root[low]
            who, overlap = who[ok], overlap[ok]
            if len(segment) and len(who):
                mine = np.searchsorted(tokens, segment)
                cols = column[mine]
                overlap = overlap + holds[cols[cols >= 0]][:, who].sum(0, dtype=np.int64)
                at = int(mine[-1]) + 1
            n = sizes[who]
            left = n - (np.searchsorted(places, who * len(tokens) + at) - first[who])
            size = np.clip(depth + left, least, largest)
            ok = (num + den) * (overlap + np.minimum(left, size - depth)) >= num * (n + size)
            who, overlap, n = who[ok], overlap[ok], n[ok]
            if not len(who):
                continue
            for d in ends:
                for q in who[(num + den) * overlap >= num * (n + sizes[d])].tolist():
                    if root[q] != root[d]:
                        found.append((q, d))
                        root[root == root[q]] = root[d]
            work += [(child, who, overlap, at) for child in children]
        return found


def compare(width: int, num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        block, ids = table["block"].to_numpy(), table["doc_id"].to_numpy()
        cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        a, b = [], []
        for low, high in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            data, offsets = text_and_offsets(table["text"].slice(low, high - low))
            sets, bounds = shingle_sets(data, offsets, width)
            some = {}
            for i in range(high - low):
                some.setdefault(sets[bounds[i] : bounds[i + 1]].astype(">u8").tobytes(), int(ids[low + i]))
            some.pop(b"", None)
            if len(some) < 2:
                continue
            trie = SetTrie([np.frombuffer(s, ">u8").astype(np.uint64) for s in some], num, den)
            names = [some[s.astype(">u8").tobytes()] for s in trie.sets]
            for x, y in trie.links():
                a.append(names[x])
                b.append(names[y])
        trim()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles and component_id of every row, for links at 100 * intersection >= num / den * 100 * union."""
    with scratch(docs.sparkSession):
        return stored(compared(docs, width, num, den, tile), "jaccard-components", result=True)


def compared(docs: DataFrame, width: int, num: int, den: int, tile: int) -> DataFrame:
    arrow_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = buckets_of(docs, 2)
    found = stored(scatter(docs, width, num, den, buckets).groupBy("bucket").applyInArrow(gather, _FOUND), "jaccard")
    all_docs = found.where("kind = 1").select("doc_id", "n", "set_hash")
    classes = all_docs.where("n > 0 and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"))
    shared = found.where("kind = 0").select("doc_id", "level", "token", "frequency")
    held = shared.groupBy("doc_id", "level").agg(F.count("*").alias("shared"))
    looked = found.where("kind = 2").select("doc_id", "level", "n", "m", "set_hash").join(classes, ["set_hash", "doc_id"]).join(held, ["doc_id", "level"])
    looked = looked.withColumn("take", F.expr(f"n - ceil({num} * n / {den}) + 1 - (m - shared)")).where("take > 0").select("doc_id", "level", "n", "take").distinct()
    order = Window.partitionBy("doc_id", "level").orderBy("frequency", "token")
    tokens = shared.join(looked, ["doc_id", "level"]).withColumn("k", F.row_number().over(order)).where("k <= take").select("token", "level", "doc_id", "n")
    # sets that can link are in one band of sizes or in neighbours; a common n-gram is met by partial aggregation, not by one task
    size = max(math.log(den / num), 1e-6) * (1 + 1e-9)
    band = F.floor(F.log(F.col("n").cast("double")) / size).cast("int")
    tokens = stored(tokens.withColumn("band", band), "jaccard-tokens")
    of_band = tokens.groupBy("token", "level", "band").agg(F.min("doc_id").alias("least"), F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("c"))
    above = of_band.select("token", "level", (F.col("band") - 1).alias("band"), F.col("least").alias("other"), F.col("low").alias("next"))
    of_band = stored(of_band.join(above, ["token", "level", "band"], "left").withColumn("other", F.expr(f"if({num} * next <= {den} * high, other, null)")), "jaccard-bands")
    ties = of_band.where("other is not null").select(F.col("least").alias("a"), F.col("other").alias("b"))
    ties = ties.unionByName(tokens.join(of_band.where("c > 1").select("token", "level", "band", "least"), ["token", "level", "band"]).select(F.col("doc_id").alias("a"), F.col("least").alias("b")))
    blocks = stored(components(ties).select(F.col("id").alias("doc_id"), F.col("component").alias("block")), "jaccard-blocks")
    sizes = all_docs.where("doc_id is not null").groupBy("doc_id").agg(F.max("n").alias("n"))
    placed = stored(blocks.join(sizes, "doc_id").withColumn("band", band), "jaccard-placed")
    many = lambda: F.greatest(F.ceil(F.sum("n") / tile), F.ceil(F.count("*") / TILE_SETS)).cast("int").alias("tiles")
    large = placed.groupBy("block").agg(many()).where("tiles > 1").select("block")
    alone = placed.join(large, "block", "left_anti").select("doc_id", "block", F.concat(F.lit("s"), F.pmod(F.xxhash64("block"), F.lit(4 * buckets))).alias("unit"))
    split = placed.join(large, "block", "left_semi")
    bands = split.groupBy("block", "band").agg(many())
    tiles = bands.select("block", "band", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t"))
    other = tiles.select("block", F.col("band").alias("band2"), F.col("t").alias("t2"))
    pairs = tiles.withColumn("band2", F.explode(F.array(F.col("band"), F.col("band") + 1))).join(other, ["block", "band2"]).where("band2 > band or t2 >= t")
    pairs = pairs.withColumn("unit", F.concat_ws(":", "block", "band", "t", "band2", "t2"))
    sides = pairs.select("block", "band", "t", "unit").unionByName(pairs.select("block", F.col("band2").alias("band"), F.col("t2").alias("t"), "unit")).distinct()
    crossed = split.join(bands, ["block", "band"]).withColumn("t", F.pmod(F.xxhash64("doc_id"), "tiles").cast("int")).join(sides, ["block", "band", "t"]).select("doc_id", "block", "unit")
    links = docs.join(alone.unionByName(crossed), "doc_id").groupBy("unit").applyInArrow(compare(width, num, den), "a long, b long")
    joined = components(links).withColumnRenamed("id", "class_id")
    named = classes.withColumnRenamed("doc_id", "class_id").join(joined, "class_id", "left")
    out = all_docs.join(named, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component", "class_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op4_jaccard_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90, 100)


QUERIES = {"op4_jaccard_prefix_tree": op4_jaccard_prefix_tree}
ORACLE = {"op4_jaccard_prefix_tree": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, c FROM reach JOIN links ON a = id),
least AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN least ON id = doc_id
"""}
