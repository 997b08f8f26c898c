"""BPE encoding and decoding with word ends.

Each word is a doubly linked list of symbols; a priority queue holds the merges
that neighbours allow, by rank, then place.  A popped entry whose symbols have
changed meanwhile is stale and skipped.  Decoding joins vocabulary strings.

A block's words are found with whole-array operations and made distinct by
Arrow's dictionary encoding, so that the queue runs once for a distinct word of
a block, and mostly once a task thanks to a bounded cache.  The digest of the decoded
text comes from decoding the ids.

Edge cases: null and empty texts have no ids and decode to the empty string;
repeated rows and ties give equal rows; further columns are ignored by
``bpe_digests`` and kept by ``encode_texts``, which replaces one named ``ids``.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from leafgraph.llm.blocks import BLOCK_BYTES, arrow_batches, distinct_words, runs, text_blocks, trim, unusual_texts

CACHE_WORDS = 500_000

_SEPARATOR, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SEPARATOR
_KIND[np.r_[ord("a") : ord("z") + 1, ord("A") : ord("Z") + 1, 0x80:0x100]] = _LETTER
_KIND[ord("0") : ord("9") + 1] = _DIGIT


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """The model of a tokenizer file with an end-of-word suffix."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in vocabulary.items()} | {i: s for s, i in self.special.items()}
        letters = byte_characters()
        self.inner = [vocabulary[c] for c in letters]
        self.final = [vocabulary[c + suffix] for c in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocabulary[left], vocabulary[right]] = rank, vocabulary[left + right]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        white = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
        self.pattern = regex.compile(pattern.replace("[^\\s", f"[^{white}"))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[bytes, bytes] = {}
        pieces = [self.strings.get(i, "").encode() for i in range(max(self.strings) + 1)]
        self.sizes = np.array([len(p) + 1 for p in pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(b" " + p for p in pieces), np.uint8)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the priority queue over the linked list."""
        ids = [self.inner[b] for b in word[:-1]] + [self.final[word[-1]]]
        if len(ids) == 1:
            return ids
        merges, end = self.merges, len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        queue = []
        for i in range(end - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= end or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if found := merges.get((new, ids[k])):
                    heapq.heappush(queue, (found[0], i, new, ids[k], found[1]))
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], new))):
                heapq.heappush(queue, (found[0], h, ids[h], new, found[1]))
        return [x for x in ids if x >= 0]

    def word(self, word: bytes) -> bytes:
        """A word's ids as little-endian unsigned 32-bit integers."""
        if (got := self.cache.get(word)) is None:
            got = np.array(self.merge(word), "<u4").tobytes()
            if len(word) <= 64:
                if len(self.cache) >= CACHE_WORDS:
                    self.cache.clear()
                self.cache[word] = got
        return got

    def decoded(self, ids: bytes) -> bytes:
        """What ``decode`` makes of ids as bytes, in UTF-8: each id's vocabulary string copied to its place."""
        i = np.frombuffer(ids, "<u4")
        n = self.sizes[i]
        ends = np.cumsum(n)
        return self.pool[np.repeat(self.starts[i] - (ends - n), n) + np.arange(int(n.sum()))].tobytes()[1:]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings joined; without a decoder the tokenizers library puts a space between them."""
        return " ".join(self.strings[i] for i in ids)

    def normal(self, text: str) -> str:
        """NFC, then lower case one character at a time: a final sigma is no exception."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def general(self, text: str) -> bytes:
        """The ids of any text."""
        ids = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                ids.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                ids += [self.word(w.encode()) for w in self.pattern.findall(self.normal(part))]
        return b"".join(ids)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text."""
        raw = [self.normal(t).encode() if t else b"" for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        odd = unusual_texts(data, offsets)
        kind = _KIND[data]
        first, last = zip(runs(kind == _LETTER, offsets), runs(kind == _OTHER, offsets), strict=True)
        digits = np.flatnonzero(kind == _DIGIT)
        starts, ends = np.concatenate([*first, digits]), np.concatenate([*last, digits + 1])
        order = np.argsort(starts, kind="stable")
        starts, sizes = starts[order], ends[order] - starts[order]
        at = np.searchsorted(starts, offsets)
        usual = np.repeat(~odd, np.diff(at))
        # without the separators the words stand side by side
        bounds = np.concatenate([[0], np.cumsum(sizes[usual])])
        distinct, codes = distinct_words(data[(kind != _SEPARATOR) & np.repeat(~odd, np.diff(offsets))], bounds)
        ids = [self.word(w) for w in distinct]
        low = 0
        for i, text in enumerate(texts):
            if odd[i]:
                yield self.general(text)
            else:
                mine = codes[low : (low := low + int(at[i + 1] - at[i]))].tolist()
                yield b"".join([ids[c] for c in mine])


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One model a worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_texts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``ids``, an array of the text's token ids."""
    docs = docs.drop("ids")
    arrow_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        model = loaded(path)
        for rows, _, _ in text_blocks(batches, text, BLOCK_BYTES):
            ids = [np.frombuffer(a, "<u4").astype(np.int32) for a in model.encode(rows.column(rows.schema.get_field_index(text)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*rows.schema.names, "ids"])

    return docs.mapInArrow(run, schema)


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows of ``docs`` with ``out``, the text that the ids stand for (null where they are null)."""
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        model = loaded(path)
        for rows in batches:
            said = [None if x is None else model.decode(x) for x in rows.column(rows.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(said, pa.string())], names=[*rows.schema.names, out])

    return docs.mapInArrow(run, schema)


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """For every document the number and the SHA-256 of its ids, and the SHA-256 of what they decode to."""
    docs = docs.select("doc_id", "text")
    arrow_batches(docs.sparkSession)

    def run(batches):
        model = loaded(path)
        for rows, _, _ in text_blocks(batches, limit=BLOCK_BYTES):
            n, a, b = [], [], []
            for ids in model.encode(rows.column(1).to_pylist()):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(model.decoded(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            trim()
        model.cache.clear()  # workers live on; the next task meets other words

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op7_bpe": op7_bpe}
