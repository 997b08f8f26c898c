"""Katz backoff: Good-Turing discounted n-grams of any order, with exactly normalised backoff weights.

Documents are laid out as chunks: a few megabytes of whole documents as token
numbers with the chunk's own dictionary of word hashes.  The chunks are a table
bucketed by chunk, so what is looked up for them joins without moving them.
Counts are looked up by exchanges: each chunk sends its distinct keys once to
the keys' buckets, which sum and answer in the same order, so a frequent n-gram
costs one entry a chunk.  Every answer is a table partitioned by chunk and
bucket: for each order the counts, and from the second on the backoff weights.

The history of a token is the n - 1 tokens before it, start marks before the
first.  Of a token w after h, by recursion: if the n-gram is known,
P = d(c) c(h, w) / c(h); else, if h is known, alpha(h) P(w | h'), where h' is h
without its first token; else P(w | h').  At the end P(w) is d(c) c(w) / N, and
what the discounts take away is the probability of the unknown word.
alpha(h) = (1 - sum of P(w | h)) / (1 - sum of P(w | h')), both over the words seen
after h.  Discounts are Katz's for counts up to 5; larger counts lose nothing.
Where the counts of counts don't give numbers between 0 and 1, d(c) = (c - D) / c
with D = n1 / (n1 + 2 n2), or 0.5.  A history all of whose n-grams are undiscounted
would leave no mass for other words; its count is taken as ``REST`` more.

Edge cases: null and empty texts are the end token alone; rows that repeat a
doc_id are scored each; a null doc_id is a training row; very long texts are a
chunk of their own; without training rows every probability is that of the
unknown word, 1; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.llm.blocks import BLOCK_BYTES, arrow_batches, bucket_bounds, buckets_of, from_planes, mixed, packed, planes, text_and_offsets, text_blocks, trim, unpacked, word_hashes
from leafgraph.llm.store import scratch, stored

KATZ, REST, ORDER = 5, 0.5, 2

_END = mixed(np.array([1], np.uint64))[0]
#: The history of nothing but start marks, by its length.
_START = mixed(np.arange(2, 18, dtype=np.uint64))
_ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: What an end token counts for in the size of a chunk.
_END_BYTES = 8
_CHUNK = "chunk long, docs array<long>, held binary, sizes binary, codes binary, keys binary, counts binary"


def full_blocks(batches, limit: int = BLOCK_BYTES):
    """Blocks as ``text_blocks`` gives them, filled across batches: what a batch leaves goes on with the next one, as a small chunk repeats more keys."""

    def joined():
        rows = pa.Table.from_batches(pending).combine_chunks().to_batches()[0]
        return rows, *text_and_offsets(rows.column(rows.schema.get_field_index("text")))

    pending, size = [], 0
    for rows, data, _ in text_blocks(batches, limit=limit // 16):
        more = len(data) + _END_BYTES * rows.num_rows
        if pending and size + more > limit:
            yield joined()
            pending, size = [], 0
        pending.append(rows)
        size += more
    if pending:
        yield joined()


def coded(x: np.ndarray) -> bytes:
    """Floats as numbers in the list of the distinct ones, which are few where counts are small, or as they are if that is shorter."""
    values, index = np.unique(x, return_inverse=True)
    wide = np.min_scalar_type(max(len(values) - 1, 0))
    if 4 + 8 * len(values) + wide.itemsize * len(x) < 8 * len(x):
        return np.uint32(len(values)).tobytes() + values.tobytes() + planes(index.astype(wide))
    return np.uint32(0).tobytes() + x.tobytes()


def from_coded(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    if not n:
        return np.frombuffer(raw, np.float64, offset=4)
    return np.frombuffer(raw, np.float64, n, 4)[from_planes(raw[4 + 8 * n :], np.min_scalar_type(n - 1))]


def lay_out(docs: DataFrame) -> DataFrame:
    """Chunks of doc_id, text and held (whether the document is not learned from)."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for rows, data, offsets in full_blocks(batches):
            tokens, owner = word_hashes(data, offsets)
            sizes = np.bincount(owner, minlength=rows.num_rows) + 1
            ends = np.cumsum(sizes) - 1
            every = np.full(int(sizes.sum()), _END, np.uint64)
            word = np.ones(len(every), bool)
            word[ends] = False
            every[word] = tokens
            held = rows.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            keys, codes = np.unique(every, return_inverse=True)
            counts = np.bincount(codes, np.repeat(1 - held, sizes), len(keys)).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([rows.column(0).cast(pa.int64()).to_pylist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (held.tobytes(), planes(sizes.astype(np.uint32)), planes(codes.astype(np.uint32)), packed(keys), planes(counts)))], names=[x.split()[0] for x in _CHUNK.split(", ")])
            number += 1

    return docs.mapInArrow(run, _CHUNK)


class Grams:
    """The chunk's distinct n-grams of every order up to a number, lists by order, the first empty.

    keys, ascending; of, the number of the n-gram that ends at each token; first, of each n-gram's history among those of the
    order below, one more than the last for start marks alone; second, of what is left without its first token; counts, in training.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, held: np.ndarray, keys: np.ndarray, order: int):
        none = np.zeros(0, np.int64)
        train = np.repeat(1 - held, sizes)
        begins = np.cumsum(sizes) - sizes
        self.keys, self.of, self.first, self.second = [keys[:0], keys], [none, codes], [none, none], [none, none]
        self.counts = [none, np.bincount(codes, train, len(keys)).astype(np.uint64)]
        for k in range(2, order + 1):
            history = np.empty_like(codes)
            history[1:] = self.of[-1][:-1]
            history[begins] = len(self.keys[-1])
            made, at, of = np.unique(mixed(np.append(self.keys[-1], _START[k - 2])[history] * _ODD[0] + keys[codes] * _ODD[1]), return_index=True, return_inverse=True)
            self.first.append(history[at])
            self.second.append(self.of[-1][at])
            self.keys.append(made)
            self.of.append(of)
            self.counts.append(np.bincount(of, train, len(made)).astype(np.uint64))


def opened(row: dict) -> tuple[np.ndarray, ...]:
    return from_planes(row["codes"], np.uint32).astype(np.int64), from_planes(row["sizes"], np.uint32).astype(np.int64), np.frombuffer(row["held"], np.uint8), unpacked(row["keys"])


def answer(found: list | None) -> list[bytes]:
    return [f["reply"] for f in sorted(found or [], key=lambda f: f["bucket"])]


def requests(chunks: DataFrame, columns: list[str], make, buckets: int, schema: str) -> DataFrame:
    """A row for each chunk and bucket: what ``make`` gives of a chunk, arrays along ascending keys, cut by bucket."""
    kinds = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                keys, *values = make(row)
                cut = bucket_bounds(keys, buckets)
                some = np.flatnonzero(np.diff(cut)).tolist()
                spans = [slice(cut[i], cut[i + 1]) for i in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([row["chunk"]] * len(some), pa.int64()), pa.array([packed(keys[s]) for s in spans], pa.binary()), *(pa.array([(coded if v.dtype == np.float64 else planes)(v[s]) for s in spans], pa.binary()) for v in values)], names=kinds)
            trim()

    return chunks.select(*columns).mapInArrow(run, schema)


def summed(own: bool):
    """Sums counts by key.  Each chunk's reply has its keys' sums, doubled, and 1 more in one of the chunks that counted the key, if ``own``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        keys = [unpacked(k) for k in table["keys"].to_pylist()]
        sizes = [len(k) for k in keys]
        counts = np.concatenate([from_planes(c, np.uint64) for c in table["counts"].to_pylist()])
        order = np.argsort(np.concatenate(keys), kind="stable")
        every = np.concatenate(keys)[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        total = np.add.reduceat(counts[order], first)
        of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(every)]))
        reply = np.empty(len(every), np.uint64)
        reply[order] = total[of]
        if own:
            at = np.flatnonzero(counts[order] > 0)
            _, one = np.unique(of[at], return_index=True)
            reply *= np.uint64(2)
            reply[order[at[one]]] += np.uint64(1)
        ends = np.cumsum(sizes)
        known = total[total > 0]
        del order, every, of, counts, keys
        trim()
        facts = [[int((known == r).sum()) for r in range(1, KATZ + 2)] + [len(known), int(known.sum())]] + [None] * (len(sizes) - 1)
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "reply": pa.array([planes(reply[e - n : e]) for n, e in zip(sizes, ends, strict=True)], pa.binary()), "facts": pa.array(facts, pa.list_(pa.int64()))})

    return run


_REPLY = "chunk long, bucket int, reply binary, facts array<long>"


def facts_of(replies: DataFrame) -> np.ndarray:
    """Counts of counts from 1 to one more than Katz's limit, the number of known keys and the sum of their counts."""
    got = replies.where("facts is not null").select(*(F.sum(F.col("facts")[i]).alias(f"f{i}") for i in range(KATZ + 3))).first()
    return np.array([x or 0 for x in got], np.float64)


def discounts(facts: np.ndarray) -> np.ndarray:
    """d(c) for c from 0 (unused) to Katz's limit."""
    n = facts[: KATZ + 1]
    r = np.arange(1, KATZ + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = (KATZ + 1) * n[KATZ] / n[0]
        d = ((r + 1) * n[1:] / n[:-1] / r - rest) / (1 - rest)
    if not (np.isfinite(d).all() and (d > 0).all() and (d < 1).all()):
        less = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        d = (r - less) / r
    return np.r_[0.0, d]


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c; 0 for 0."""
    return np.where(counts > KATZ, counts, counts * d[np.minimum(counts, KATZ).astype(np.int64)])


class Unigrams:
    def __init__(self, facts: np.ndarray):
        self.total, self.known, self.d = facts[-1], facts[-2], discounts(facts)
        r = np.arange(1, KATZ + 1)
        low = facts[:KATZ]
        mass = (low * r * self.d[1:]).sum() + (self.total - (low * r).sum())
        self.whole = max(self.total, 1)
        self.unknown = 1 - mass / self.total if self.total else 1.0
        if self.total and self.unknown < 1e-12:
            self.whole = self.total + REST
            self.unknown = REST / self.whole

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.d) / self.whole, self.unknown)


def needs_weight(grams: Grams, k: int, n: np.ndarray) -> np.ndarray:
    """Which histories of order k's n-grams (the last: start marks) are asked for their sums: an n-gram is unknown, or none here is discounted."""
    size = len(grams.keys[k - 1]) + 1
    unknown = np.bincount(grams.first[k][n == 0], minlength=size) > 0
    low = np.bincount(grams.first[k][(n > 0) & (n <= KATZ)], minlength=size) > 0
    high = np.bincount(grams.first[k][n > KATZ], minlength=size) > 0
    return unknown | high & ~low


def history_order(grams: Grams, k: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and numbers of chosen histories, ascending by key."""
    every = np.append(grams.keys[k - 1], _START[k - 2])
    order = np.argsort(every, kind="stable")
    order = order[chosen[order]]
    return every[order], order


def chances(grams: Grams, order: int, model: Unigrams, d: list, counts: list, weights: list, starts: int) -> list[np.ndarray]:
    """The probability of each distinct n-gram's last token, for every order up to one; the recursion from below.

    counts: by order, of each n-gram; weights: from the second order on, sums of the histories that ``needs_weight`` names.
    """
    out = [np.zeros(0), model.probability(counts[1])]
    for k in range(2, order + 1):
        n, first, below = counts[k], grams.first[k], out[-1][grams.second[k]]
        before = np.append(counts[k - 1], starts)
        alpha, whole = np.ones(len(before)), np.maximum(before, 1.0)
        _, at = history_order(grams, k, needs_weight(grams, k, n))
        if len(at):
            seen, back = weights[k]
            known = before[at] > 0
            at, seen, back = at[known], seen[known], back[known]
            left = before[at] - seen
            full = left <= 1e-9 * before[at]
            whole[at[full]] += REST
            alpha[at] = np.where(full, REST, left) / whole[at] / (1 - back)
        out.append(np.where(n > 0, discounted(n, d[k]) / whole[first], np.where(before[first] > 0, alpha[first], 1.0) * below))
    return out


def score(docs: DataFrame, held_out: Column, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; learns from those not held out."""
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    buckets, parts = buckets_of(docs), buckets_of(docs, 4)  # of an exchange four times as many, so that a group of it is small
    name = f"leafgraph_chunks_{uuid.uuid4().hex}"
    try:
        lay_out(docs).write.format("parquet").bucketBy(buckets, "chunk").saveAsTable(name)
        with scratch(spark):
            return stored(scored(spark.table(name), docs.where("not held").count(), buckets, parts, order), "katz-scores", result=True)
    finally:
        spark.sql(f"drop table if exists {name}")


def scored(chunks: DataFrame, starts: int, buckets: int, parts: int, order: int) -> DataFrame:
    """The scores of chunks laid out in ``buckets``, ``starts`` documents of which are learned from, by exchanges of ``parts``."""
    counts_of = lambda replies, shift: np.concatenate([from_planes(x, np.uint64) for x in answer(replies)] or [np.zeros(0, np.uint64)]) >> np.uint64(shift)
    laid = ["codes", "sizes", "held", "keys"]
    tables: dict[str, DataFrame] = {}

    def with_answers(columns: list[str], names: list[str]) -> DataFrame:
        out = chunks.select("chunk", *columns)
        for a in names:  # dealt as the chunks are: by another number than theirs, the session's, each would move a second time
            replies = tables[a].repartition(buckets, "chunk").groupBy("chunk")
            out = out.join(replies.agg(F.collect_list(F.struct("bucket", "reply")).alias(a)), "chunk", "left")
        return out

    def known(row: dict, grams: Grams, upto: int) -> tuple[list, list]:
        """Counts of all orders up to one, and weights of those below it, as floats."""
        counts = [np.zeros(0)] + [counts_of(row[f"c{k}"], k > 1).astype(np.float64) for k in range(1, upto + 1)]
        weights = [None, None] + [np.concatenate([from_coded(x).reshape(2, -1) for x in answer(row[f"w{k}"])] or [np.zeros((2, 0))], axis=1) if row.get(f"w{k}") else np.zeros((2, 0)) for k in range(2, upto + 1)]
        return counts, weights

    asked = requests(chunks, ["chunk", "keys", "counts"], lambda row: (unpacked(row["keys"]), from_planes(row["counts"], np.uint64)), parts, "bucket int, chunk long, keys binary, counts binary")
    tables["c1"] = stored(asked.groupBy("bucket").applyInArrow(summed(False), _REPLY), "katz-1")
    model, d = Unigrams(facts_of(tables["c1"])), [None, None]
    have = ["c1"]
    for k in range(2, order + 1):

        def gram_request(row, k=k):
            grams = Grams(*opened(row), k)
            return grams.keys[k], grams.counts[k]

        asked = requests(chunks, ["chunk", *laid], gram_request, parts, "bucket int, chunk long, keys binary, counts binary")
        tables[f"c{k}"] = stored(asked.groupBy("bucket").applyInArrow(summed(True), _REPLY), f"katz-{k}")
        d.append(discounts(facts_of(tables[f"c{k}"])))
        have.append(f"c{k}")

        def weight_request(row, k=k, d=tuple(d)):
            """For each history of order k: sums over the n-grams that the chunk stands for, and whether its sums are asked for."""
            grams = Grams(*opened(row), k)
            counts, weights = known(row, grams, k)
            own = (counts_of(row[f"c{k}"], 0) & np.uint64(1)).astype(bool)
            below = chances(grams, k - 1, model, d, counts, weights, starts)[-1]
            size = len(grams.keys[k - 1]) + 1
            seen = np.bincount(grams.first[k][own], discounted(counts[k][own], d[k]), size)
            back = np.bincount(grams.first[k][own], below[grams.second[k][own]], size)
            want = needs_weight(grams, k, counts[k])
            keys, at = history_order(grams, k, (seen > 0) | want)
            return keys, seen[at], back[at], want[at].astype(np.uint8)

        joined = with_answers(laid, have)
        asked = requests(joined, joined.columns, weight_request, parts, "bucket int, chunk long, keys binary, seen binary, back binary, want binary")
        tables[f"w{k}"] = stored(asked.groupBy("bucket").applyInArrow(weigh, _REPLY), f"katz-weights-{k}")
        have.append(f"w{k}")

    def evaluate(batches):
        for b in batches:
            for row in b.to_pylist():
                codes, sizes, held, keys = opened(row)
                grams = Grams(codes, sizes, held, keys, order)
                counts, weights = known(row, grams, order)
                each = np.log10(chances(grams, order, model, d, counts, weights, starts)[-1])[grams.of[order]]
                first, c = np.cumsum(sizes) - sizes, counts[1]
                base = np.log10((c + 0.5) / (model.total + 0.5 * (model.known + 1)))[codes]
                yield pa.RecordBatch.from_arrays([pa.array(row["docs"], pa.int64()), pa.array(held > 0), pa.array(sizes, pa.int64()), pa.array(np.add.reduceat((c > 0)[codes].astype(np.int64), first), pa.int64()), pa.array(np.full(len(sizes), int(model.total)), pa.int64()), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(each, first))], names=_NAMES)
            trim()

    return with_answers(["docs", *laid], have).mapInArrow(evaluate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def weigh(table: pa.Table) -> pa.Table:
    """Sums by history; each chunk's reply has those that it asked for."""
    keys = [unpacked(k) for k in table["keys"].to_pylist()]
    sizes = [len(k) for k in keys]
    every = np.concatenate(keys)
    seen, back = (np.concatenate([from_coded(x) for x in table[c].to_pylist()]) for c in ("seen", "back"))
    want = np.concatenate([from_planes(x, np.uint8) for x in table["want"].to_pylist()])
    _, of = np.unique(every, return_inverse=True)
    left, right = np.bincount(of, seen)[of], np.bincount(of, back)[of]
    ends = np.cumsum(sizes)
    reply = [coded(np.stack([left[e - n : e], right[e - n : e]])[:, want[e - n : e] > 0].ravel()) for n, e in zip(sizes, ends, strict=True)]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "reply": pa.array(reply, pa.binary()), "facts": pa.nulls(len(sizes), pa.list_(pa.int64()))})


_NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)


QUERIES = {"op2_katz": op2_katz}
