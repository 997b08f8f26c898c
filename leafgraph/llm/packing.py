"""Best-fit packing of documents into sequences by a configuration linear program.

Documents longer than a sequence are cut, the first piece taking the rest of
the division, so that all others fill a sequence each.  The remaining pieces
are known to the driver by a histogram of at most ``capacity`` lengths.  The
linear program over all configurations (multisets of lengths that fit) is
solved by multiplicative weights: each step prices the lengths, a knapsack
dynamic program finds the best configuration, and the lengths it covers become
cheaper.  The solution is scaled and rounded down at a few scales, best fit
decreasing packs what is left of the histogram, and the rounding with the fewest
sequences stays.  A piece's place follows from its rank among the
pieces of its length, which is counted per partition first.

Edge cases: null and empty texts are a document of the end token alone; repeated
rows of one doc_id are documents of their own; an empty table gives no rows;
further columns are ignored.  The order of equally long pieces does not change
the number of sequences.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafgraph.llm.blocks import BLOCK_BYTES, arrow_batches, distinct_words, runs, text_blocks, trim, unusual_texts
from leafgraph.llm.store import stored

STEPS = 250
CACHE_WORDS = 500_000

_SPACE, _LETTER, _DIGIT, _OTHER, _WHITE = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[range(0x09, 0x0E)] = _WHITE
_KIND[0x20] = _SPACE
_KIND[np.r_[ord("a") : ord("z") + 1, ord("A") : ord("Z") + 1, 0x80:0x100]] = _LETTER
_KIND[ord("0") : ord("9") + 1] = _DIGIT


class ByteBpe:
    """Ids as the tokenizers library gives them for a byte-level file, by way of the same vocabulary as ranks."""

    def __init__(self, ranks_path: str, json_path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.library = json_path, None
        self.cache: dict[bytes, bytes] = {}

    def general(self, text: str) -> list[int]:
        if "<|endoftext|>" not in text and not any("\x1c" <= c <= "\x1f" for c in text):
            return self.ranks.encode_ordinary(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.json_path)
        return self.library.encode(text, add_special_tokens=False).ids

    @staticmethod
    def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of what the pattern splits a text of ASCII and Latin letters into."""
        kind = _KIND[data]
        white = (kind == _SPACE) | (kind == _WHITE)
        starts = np.zeros(len(data) + 1, bool)
        starts[offsets] = True
        for k in (_LETTER, _DIGIT, _OTHER):
            starts[runs(kind == k, offsets)[0]] = True
        first, end = runs(white, offsets)
        starts[first] = True
        stops = np.zeros(len(data) + 1, bool)
        stops[offsets] = True
        inner = end[~stops[end]]  # a word follows: the last white byte stands alone, or leads the word if it is a space
        starts[inner - 1] = True
        starts[inner[kind[inner - 1] == _SPACE]] = False
        return np.flatnonzero(starts[:-1]) if len(data) else np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        raw = [t.encode() if t else b"" for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        odd = unusual_texts(data, offsets)
        if odd.any():
            data = data[np.repeat(~odd, np.diff(offsets))]
            offsets = np.concatenate([[0], np.cumsum(np.where(odd, 0, np.diff(offsets)))])
        starts = self.pieces(data, offsets)
        distinct, codes = distinct_words(data, np.concatenate([starts, [len(data)]]))
        cache, known = self.cache, []
        for w in distinct:
            if (got := cache.get(w)) is None:
                got = np.array(self.ranks.encode_ordinary(w.decode()), "<u4").tobytes()
                if len(w) <= 64:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[w] = got
            known.append(got)
        sizes = np.array([len(k) for k in known], np.int32) // 4
        at = np.cumsum(sizes, dtype=np.int32) - sizes
        pool = np.frombuffer(b"".join(known), "<u4")
        n = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        index = np.repeat((at[codes] - ends[:-1]).astype(np.int32), n)
        index += np.arange(len(index), dtype=np.int32)
        ids = pool[index]
        cut = ends[np.searchsorted(starts, offsets)]
        return [np.array(self.general(t), np.uint32) if o else ids[cut[i] : cut[i + 1]] for i, (t, o) in enumerate(zip(texts, odd, strict=True))]


_LOADED: dict[str, ByteBpe] = {}


def loaded(ranks_path: str, json_path: str) -> ByteBpe:
    if json_path not in _LOADED:
        _LOADED[json_path] = ByteBpe(ranks_path, json_path)
    return _LOADED[json_path]


def best_configuration(value: np.ndarray, capacity: int) -> np.ndarray:
    """How often each length (index + 1) is in the most valuable multiset of lengths that fits the capacity."""
    lengths = np.flatnonzero(value > 0) + 1
    worth, best, choice = value[lengths - 1], np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        fits = int(np.searchsorted(lengths, c, "right"))
        best[c] = best[c - 1]
        if fits:
            got = worth[:fits] + best[c - lengths[:fits]]
            if got[k := int(np.argmax(got))] > best[c]:
                best[c], choice[c] = got[k], lengths[k]
    made, c = np.zeros(len(value), np.int64), capacity
    while c > 0:
        made[choice[c] - 1] += choice[c] > 0
        c -= max(1, int(choice[c]))
    return made


def solve(histogram: np.ndarray, capacity: int, steps: int = STEPS) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used; together they hold exactly the histogram."""
    need = histogram.astype(np.int64).copy()
    if not need.sum():
        return []
    some, lengths, total = need > 0, np.arange(1, len(need) + 1), np.maximum(need, 1)
    price = np.where(some, lengths / capacity, 0.0)  # the dual optimum wherever all tokens can be packed without a gap
    used: dict[bytes, float] = {}
    covered = np.zeros(len(need))
    for _ in range(steps):
        made = best_configuration(price * np.exp(-0.2 * (covered - covered[some].mean())), capacity)
        has = made > 0
        times = float((need[has] / made[has]).min())  # as often as the first of its lengths lasts
        used[made.tobytes()] = used.get(made.tobytes(), 0.0) + times
        covered += np.where(has, made * times / total, 0.0)
    tried = [rounded(need, used, 1 / np.percentile(covered[some], q), capacity) for q in (100, 99, 97, 93, 85)]
    return min(tried, key=lambda out: sum(times for _, times in out))


def rounded(need: np.ndarray, used: dict[bytes, float], scale: float, capacity: int) -> list[tuple[np.ndarray, int]]:
    """The scaled solution rounded down, as far as the histogram allows, and best fit for the rest."""
    need, out = need.copy(), []
    for raw, times in sorted(used.items(), key=lambda x: (-x[1], x[0])):
        made = np.frombuffer(raw, np.int64)
        whole = min(int(min(times * scale, 2**53)), int((need[made > 0] // made[made > 0]).min()))
        if whole > 0:
            need -= whole * made
            out.append((made, whole))
    return out + best_fit_decreasing(need, capacity)


def best_fit_decreasing(need: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Best fit over a histogram: equal open sequences are filled together, the fullest that fits first."""
    opened: dict[int, list[tuple[np.ndarray, int]]] = {}  # by free tokens
    for length in range(len(need), 0, -1):
        left = int(need[length - 1])
        free = length
        while left:
            while free <= capacity and not opened.get(free):
                free += 1
            if free > capacity:
                each = capacity // length
                for n, times in ((each, left // each), (left % each, 1)):
                    if n and times:
                        made = np.zeros(len(need), np.int64)
                        made[length - 1] = n
                        opened.setdefault(capacity - n * length, []).append((made, times))
                break
            made, times = opened[free].pop()
            each = free // length
            whole = min(times, left // each) if left >= each else 0
            n, taken = (each, whole) if whole else (left, 1)
            if times > taken:
                opened[free].append((made, times - taken))
            fuller = made.copy()
            fuller[length - 1] += n
            opened.setdefault(free - n * length, []).append((fuller, taken))
            left -= n * taken
    return [x for group in opened.values() for x in group]


def layout(configurations: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length the ranks at which a run of places begins, and the run's first sequence, places a sequence and offset."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    base, filled = 0, {}
    starts: dict[int, list[int]] = {}
    for made, times in configurations:
        offset = 0
        for i in np.flatnonzero(made).tolist()[::-1]:
            length, each = i + 1, int(made[i])
            starts.setdefault(length, []).append(filled.get(length, 0))
            rows.setdefault(length, []).append((base, each, offset))
            filled[length] = filled.get(length, 0) + each * times
            offset += each * length
        base += times
    return {n: (np.array(starts[n]), *np.array(rows[n], np.int64).T) for n in rows}


def pack(docs: DataFrame, ranks_path: str, json_path: str, capacity: int = 1024, end: int = 2, steps: int = STEPS) -> DataFrame:
    """Pieces of the documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    arrow_batches(spark)
    names = ["part", "n", "doc_id", "piece", "start", "length", "ids_crc32"]

    def cut(batches):
        from pyspark import TaskContext

        model, seen, part = loaded(ranks_path, json_path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for rows, _, _ in text_blocks(batches, limit=BLOCK_BYTES):
            out: list[tuple] = []
            for doc, ids in zip(rows.column(0).to_pylist(), model.encode(rows.column(1).to_pylist()), strict=True):
                raw, total, at, piece = ids.astype("<u4").tobytes() + int(end).to_bytes(4, "little"), len(ids) + 1, 0, 0
                size = total % capacity or capacity
                while at < total:
                    out.append((part, int(seen[size]), doc, piece, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])))
                    seen[size] += 1
                    at, piece, size = at + size, piece + 1, capacity
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=names)
            out.clear()
            trim()
        model.cache.clear()  # workers live on; the next task meets other words

    pieces = stored(docs.mapInArrow(cut, "part int, n long, doc_id long, piece int, start long, length long, ids_crc32 long"), "packing-pieces")
    parts = pieces.groupBy("length", "part").agg(F.count("*").alias("c"))
    before = parts.select("length", "part", (F.sum("c").over(Window.partitionBy("length").orderBy("part")) - F.col("c")).alias("before"))
    histogram = np.zeros(capacity, np.int64)
    for length, c in pieces.groupBy("length").count().collect():  # at most capacity rows
        histogram[length - 1] = c
    places = layout([(np.eye(1, capacity, capacity - 1, dtype=np.int64)[0], int(histogram[-1]))] * bool(histogram[-1]) + solve(np.r_[histogram[:-1], 0], capacity, steps))

    def place(batches):
        for b in batches:
            cols = {f: b.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(b.schema.names)}
            length, rank = cols["length"], cols["rank"]
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length).tolist():
                at = np.flatnonzero(length == size)
                start, base, each, first = places[size]
                k = np.searchsorted(start, rank[at], "right") - 1
                slot = rank[at] - start[k]
                sequence[at], offset[at] = base[k] + slot // each[k], first[k] + slot % each[k] * size
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(5)], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("n") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
