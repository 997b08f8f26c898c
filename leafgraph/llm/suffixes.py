"""Suffix-array dedup: repeated byte strings across documents, by merging Burrows-Wheeler transforms.

Suffixes are dealt out so that equal strings of ``length`` bytes meet: every
window of that length has a minimizer, the 20-byte string in it with the least
hash, and equal windows have equal minimizers.  Around a minimizer lies its
context, all windows that it is the minimizer of.

1. Each document sends its minimizers and a hash of their contexts to the
   minimizers' buckets.  Where a document of a smaller id has the same context
   (minimizer and context together are told apart by 128 bits of hashes), all windows of it repeat.
   Of contexts that share a minimizer but differ, one
   document each, the smallest, stands for its class and must be compared further.
   A bucket answers with a blob for each group of documents, and a group's blobs
   become one row for each of its documents.
2. The contexts to compare come together by minimizer.  In each the minimizer, which
   is known, is two letters instead of its bytes, and two letters are one symbol: a
   context is a string of symbols from its first letter and one from its second.
   Shards of them are sorted and transformed; the transforms are merged by
   interleave refinement: the interleave starts unrefined, each round sorts it
   stably by the symbol before and so fixes one more symbol of the order, and
   after as many rounds as a window has symbols the groups that were never parted
   are the intervals of a common prefix of a window.  Parted by minimizer and by
   its place, they are the repeated strings.  No suffixes are sorted again.
3. What is covered in each document is the union of its repeated windows.

Only documents with something repeated are joined with their text.  A Bloom
filter of 16 bits for each of them, 2^17 words at least and 2^22 at most, keeps others
away from the join.

Edge cases: null and empty texts, and texts shorter than ``length``, repeat
nothing; documents with equal ids don't repeat each other; a null doc_id repeats
nothing and is returned unchanged; a text too long for a block is one of its own; an empty table gives no rows; further columns
are kept by ``remove_repeats`` (one named like an output is replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafgraph.llm.blocks import arrow_batches, bucket_bounds, buckets_of, bytes_read, longs, mixed, packed, runs, text_and_offsets, text_blocks, trim, unpacked
from leafgraph.llm.store import stored

LENGTH, CORE = 50, 20
SHARD = 2048
#: Bytes of text looked at together; a block needs about a hundred times that in arrays.
BLOCK = 2 << 20
#: The same where the rows carry what was found as well.
CARRIED = 1 << 20
#: Bytes read for each group of documents that answers come together in.
GROUP = 32 << 20
BLOOM_WORDS, MOST_WORDS = 1 << 17, 1 << 22
#: A place in a block has so many bits beside a hash; longer texts take another way to the same places.
PLACE_BITS = 24

_PLACE_BITS = np.uint64(PLACE_BITS)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first powers of the base; those of a usual block are kept."""
    kept = _POWERS.get(int(base))
    if kept is None or len(kept) < n:
        kept = np.full(max(n, 1 << 21), base)
        kept[0] = 1
        kept = np.multiply.accumulate(kept)
        if n <= 1 << 22:
            _POWERS[int(base)] = kept
    return kept[:n]


def minimizers(data: np.ndarray, offsets: np.ndarray, length: int, core: int) -> tuple[np.ndarray, ...]:
    """Place, first window, windows, key, context hash, document and sides of every minimizer.

    A minimizer's windows are consecutive: those whose leftmost least core is at its place.
    """
    span = length - core + 1  # cores in a window
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64, np.uint32))
    if len(data) < length:
        return empty
    # rolling polynomial hashes of random letters, all bits mixed
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[data] * powers(_BASE, len(data)), dtype=np.uint64)])
    back = powers(_INVERSE, len(data))
    h = mixed((sums[core:] - sums[:-core]) * back[: len(data) - core + 1])
    # sliding minimum of (40 bits of the hash, place): ties go to the left
    n, width = len(h), 1
    if n <= 1 << PLACE_BITS:
        both = h >> _PLACE_BITS << _PLACE_BITS | np.arange(n, dtype=np.uint64)
        while width < span:
            step = min(width, span - width)
            both = np.minimum(both[:-step], both[step:])
            width += step
        place = (both & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int32)
    else:  # one very long text
        least, place = h >> _PLACE_BITS, np.arange(n)
        while width < span:
            step = min(width, span - width)
            place = np.where(least[step:] < least[:-step], place[step:], place[:-step])
            least = np.minimum(least[:-step], least[step:])
            width += step
    edge = np.ones(len(place), bool)
    edge[1:] = place[1:] != place[:-1]
    inside = np.zeros(len(place) + 1, np.int32)  # windows that lie in one document
    sizes = np.diff(offsets)
    long = sizes >= length
    inside[offsets[:-1][long]] = 1
    np.subtract.at(inside, offsets[:-1][long] + sizes[long] - length + 1, 1)
    edge[offsets[:-1][long]] = True
    ok = np.cumsum(inside[:-1]) > 0
    edge[1:] |= ok[1:] != ok[:-1]
    first = np.flatnonzero(edge)
    n = np.diff(np.r_[first, len(place)])
    first, n = first[ok[first]], n[ok[first]]
    if not len(first):
        return empty
    at, owner = place[first].astype(np.int64), np.searchsorted(offsets, first, "right") - 1
    # a context is told by the bytes of all its windows and where its core is
    context = mixed((sums[first + n - 1 + length] - sums[first]) * back[first] + (n * 64 + at - first).astype(np.uint64) * _BASE)
    # 15 bits of what lies left and right of the core, as far as half of what a window holds beside it; the top bit: not so far in the context
    half = span // 2
    sides = np.zeros(len(at), np.uint32)
    for shift, low, there in ((0, at - half, at - half >= first), (16, at + core, at + core + half <= first + n - 1 + length)):
        low = np.where(there, low, 0)
        bits = mixed((sums[low + half] - sums[low]) * back[low]) >> np.uint64(49)
        sides |= np.where(there, bits, 1 << 15).astype(np.uint32) << np.uint32(shift)
    return at, first, n, mixed(h[at]), context, owner, sides


def pair_keys(key: np.ndarray, context: np.ndarray) -> np.ndarray:
    """One number for a context."""
    return mixed(key + context * _BASE)


def pairs_in(pairs: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One number for a context of a document in a block."""
    return mixed(pairs + doc.astype(np.uint64) * _INVERSE)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of blobs, and the row of each."""
    data, offsets = text_and_offsets(column)
    return np.frombuffer(data.tobytes(), np.uint64), np.repeat(np.arange(len(column)), np.diff(offsets) // 8)


_ENTRIES = "bucket int, keys binary, contexts binary, sides binary, owners binary, docs binary"
_STATES = "group int, docs binary, pairs binary, states binary"
_FOUND = "doc_id long, whole binary, asked binary"


def scatter(docs: DataFrame, length: int, core: int, buckets: int) -> DataFrame:
    def run(batches):
        for rows, data, offsets in text_blocks(batches, limit=BLOCK):
            ids = longs(rows, "doc_id")
            _, _, _, key, context, owner, sides = minimizers(data, offsets, length, core)
            order = np.argsort(key, kind="stable")
            key, context, owner, sides = key[order], context[order], owner[order], sides[order]
            cut = bucket_bounds(key, buckets)
            some = np.flatnonzero(np.diff(cut)).tolist()
            parts = []
            for b in some:
                there, index = np.unique(owner[cut[b] : cut[b + 1]], return_inverse=True)
                parts.append((b, packed(key[cut[b] : cut[b + 1]]), context[cut[b] : cut[b + 1]].tobytes(), sides[cut[b] : cut[b + 1]].tobytes(), index.astype(np.uint32).tobytes(), ids[there].tobytes()))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), [pa.int32(), *[pa.binary()] * 5], strict=True)], names=["bucket", "keys", "contexts", "sides", "owners", "docs"])
            trim()

    return docs.mapInArrow(run, _ENTRIES)


def judge(groups: int):
    """For each group of documents their contexts that repeat (state 0) or must be compared (state 1)."""

    def run(table: pa.Table) -> pa.Table:
        docs, pairs, states = judged(table)
        group = (mixed(docs.view(np.uint64)) % np.uint64(groups)).astype(np.int32)
        order = np.lexsort((docs.view(np.uint64), group))
        group, docs, pairs, states = group[order], docs[order].view(np.uint64), pairs[order], states[order]
        cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else np.zeros(1, np.int64)
        spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        blobs = lambda x, form: pa.array([form(x[a:b]) for a, b in spans], pa.binary())
        trim()
        return pa.table({"group": pa.array(group[cut[:-1]], pa.int32()), "docs": blobs(docs, packed), "pairs": blobs(pairs, np.ndarray.tobytes), "states": blobs(states, np.ndarray.tobytes)})

    return run


def gather(table: pa.Table) -> pa.Table:
    """A row for each document of a group: its contexts that repeat, and those that must be compared."""
    docs = np.concatenate([unpacked(x) for x in table["docs"].to_pylist()]).view(np.int64)
    pairs, states = (np.concatenate([np.frombuffer(x, t) for x in table[c].to_pylist()]) for c, t in (("pairs", np.uint64), ("states", np.uint8)))
    order = np.lexsort((states, docs))
    docs, pairs, states = docs[order], pairs[order], states[order]
    first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    columns = []
    for state in (0, 1):
        some = states == state
        bounds = np.concatenate([[0], np.cumsum(np.add.reduceat(some, first, dtype=np.int64))]) * 8
        columns.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(pairs[some].tobytes())]))
    ids = pa.array(docs[first], pa.int64())
    trim()
    return pa.table({"doc_id": ids, "whole": columns[0], "asked": columns[1]})


def judged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, context and state of what a bucket finds."""
    keys, contexts, docs, sides = [], [], [], []
    for k, c, s, o, d in zip(*(table[x].to_pylist() for x in ("keys", "contexts", "sides", "owners", "docs")), strict=True):
        sides.append(np.frombuffer(s, np.uint32))
        keys.append(unpacked(k))
        contexts.append(np.frombuffer(c, np.uint64))
        docs.append(np.frombuffer(d, np.int64)[np.frombuffer(o, np.uint32)])
    keys, contexts, docs, sides = (np.concatenate(x) for x in (keys, contexts, docs, sides))
    order = np.lexsort((docs, contexts, keys))
    keys, contexts, docs, sides = keys[order], contexts[order], docs[order], sides[order]
    new_key = np.r_[True, keys[1:] != keys[:-1]]
    new_context = new_key | np.r_[True, contexts[1:] != contexts[:-1]]
    of_key, of_context = np.cumsum(new_key) - 1, np.cumsum(new_context) - 1
    least = docs[np.flatnonzero(new_context)][of_context]
    first = np.flatnonzero(new_key)
    low, high = np.minimum.reduceat(docs, first)[of_key], np.maximum.reduceat(docs, first)[of_key]
    several = (np.bincount(of_key[new_context])[of_key] > 1) & (low != high)
    full = docs > least
    compare = several & (docs == least) & np.r_[True, (docs[1:] != docs[:-1]) | new_context[1:]]
    # two contexts of a minimizer share a window only if they agree for half of what it holds beside the core, on one side
    some = np.flatnonzero(compare)
    agree = np.zeros(len(some), bool)
    for shift in (0, 16):
        side = (sides[some] >> np.uint32(shift)) & np.uint32(0xFFFF)
        _, of, times = np.unique(mixed(keys[some] + side.astype(np.uint64) * _BASE), return_inverse=True, return_counts=True)
        agree |= (times[of] > 1) & (side < 1 << 15)
    compare[some[~agree]] = False
    keep = full | compare
    return docs[keep], pair_keys(keys[keep], contexts[keep]), compare[keep].astype(np.uint8)


def symbols_of(strings: list[bytes], cores: list[int], core: int, stand: int) -> list[bytes]:
    """Two strings of two-byte symbols for each string, from its first and from its second letter; ``stand`` letters stand for its core."""
    out = []
    for s, c in zip(strings, cores, strict=True):
        s = s[:c] + b"\xff" * stand + s[c + core :]
        out += [s[: len(s) & ~1], s[1 : 1 + (len(s) - 1 & ~1)]]
    return out


def transform(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of a shard (0 for an end), with the string and the offset of each suffix.

    Suffixes are ordered by their first ``length`` symbols of two bytes at least; ends are smaller than symbols and ordered by string.
    """
    sizes = np.array([len(s) for s in strings], np.int64) // 2 + 1
    first = np.cumsum(sizes) - sizes
    text, inner = np.zeros(int(sizes.sum()), np.uint32), np.ones(int(sizes.sum()), bool)
    inner[first + sizes - 1] = False
    text[inner] = np.frombuffer(b"".join(strings), np.uint16).astype(np.uint32) + 1
    string = np.repeat(np.arange(len(strings)), sizes)
    offset = np.arange(len(text)) - first[string]
    rank = np.where(text > 0, text.astype(np.int64) + len(strings), string)
    ends, done = (first + sizes - 1)[string], 1
    while done < length:
        ahead = np.minimum(np.arange(len(text)) + done, ends)
        later = np.where(np.arange(len(text)) + done > ends, -1, rank[ahead])
        both = rank * (int(rank.max()) + 2) + later + 1
        order = np.argsort(both)  # equal pairs get one rank, so their order is of no matter
        both = both[order]
        rank[order] = np.cumsum(np.r_[True, both[1:] != both[:-1]]) - 1
        done *= 2
    order = np.argsort(rank * len(text) + np.arange(len(text)))
    before = np.where(offset > 0, text[np.maximum(np.arange(len(text)) - 1, 0)], 0)
    return before[order], string[order], offset[order]


def merged_intervals(shards: list[list[bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String (counted over all shards), offset and interval of every suffix that begins with a repeated string of ``length`` symbols of two bytes."""
    parts = [transform(s, length) for s in shards]
    symbols = np.concatenate([p[0] for p in parts])
    base = np.cumsum([0, *(len(s) for s in shards)])
    strings = np.concatenate([p[1] + base[k] for k, p in enumerate(parts)])
    offsets = np.concatenate([p[2] for p in parts])
    small = np.min_scalar_type(len(parts))  # few bits, so that stable sorts go by digits
    shard = np.repeat(np.arange(len(parts), dtype=small), [len(p[0]) for p in parts])  # the interleave
    ends = np.repeat(np.arange(len(parts), dtype=small), [len(s) for s in shards])
    group = np.zeros(len(symbols), np.int32 if len(symbols) < 2**31 else np.int64)
    del parts
    for _ in range(length):
        by_shard = np.argsort(shard, kind="stable")
        here = np.empty_like(symbols)
        here[by_shard] = symbols
        inner = np.flatnonzero(here > 0)
        symbol = (here[inner] - 1).astype(np.uint16)
        by_symbol = np.argsort(symbol, kind="stable")
        order, symbol = inner[by_symbol], symbol[by_symbol]
        old = group[order]
        new = np.r_[True, (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])] if len(order) else np.zeros(0, bool)
        shard = np.concatenate([ends, shard[order]])
        group = np.concatenate([np.arange(len(ends), dtype=group.dtype), np.cumsum(new, dtype=group.dtype) + group.dtype.type(len(ends) - 1)])  # each end is a group of its own
    by_shard = np.argsort(shard, kind="stable")
    interval = group[by_shard]
    several = np.bincount(interval, minlength=int(interval.max()) + 1 if len(interval) else 0)[interval] > 1
    return strings[several], offsets[several], interval[several]


def sides_of(strings: list[bytes], cores: np.ndarray, core: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and hashes of what lies left and right of the cores: a column for each number of bytes from the core on, up to ``width``."""
    sizes = np.array([len(s) for s in strings], np.int64)
    data, first = np.frombuffer(b"".join(strings), np.uint8), np.cumsum(sizes) - sizes
    out = []
    for size, start, step in ((cores, first + cores - 1, -1), (sizes - cores - core, first + cores + core, 1)):
        made = np.zeros((len(strings), width + 1), np.uint64)
        for k in range(width):
            some = size > k
            made[:, k + 1] = made[:, k]
            made[some, k + 1] = mixed(made[some, k] * _BASE + _LETTERS[data[start[some] + step * k]])
        out += [size, made]
    return tuple(out)


def may_share(strings: list[bytes], keys: np.ndarray, cores: np.ndarray, length: int, core: int) -> np.ndarray:
    """Which contexts may share a window with another of their minimizer.

    Left and right of the core two that do agree for the rest of a window together: for a multiple of ``step`` on the left,
    and for what is left of the rest without ``step - 1`` on the right.
    """
    width = length - core
    step = max(1, width // 6)
    left, on_left, right, on_right = sides_of(strings, cores, core, width)
    out = np.zeros(len(strings), bool)
    for a in range(0, width + 1, step):
        b = max(0, width - a - step + 1)
        some = np.flatnonzero((left >= a) & (right >= b))
        _, of, times = np.unique(mixed(mixed(keys[some] + on_left[some, a]) + on_right[some, b] * _BASE), return_inverse=True, return_counts=True)
        out[some[times[of] > 1]] = True
    return out


def compare(length: int, core: int):
    """For each context of a unit, a mask of its windows that a document of a smaller id has too."""
    stand = 2 - (length - core) % 2  # letters for a core, so that a window is a whole number of symbols
    rounds = (length - core + stand) // 2

    def run(table: pa.Table) -> pa.Table:
        table = table.filter(pa.array(may_share(table["bytes"].to_pylist(), table["key"].to_numpy().view(np.uint64), table["core"].to_numpy().astype(np.int64), length, core)))
        table = table.sort_by([("key", "ascending"), ("doc_id", "ascending")])
        docs, keys, cores, strings = table["doc_id"].to_numpy(), table["key"].to_numpy(), table["core"].to_numpy(), table["bytes"].to_pylist()
        mask = np.zeros(len(docs), np.uint64)
        shards = [symbols_of(strings[i : i + SHARD], cores[i : i + SHARD].tolist(), core, stand) for i in range(0, len(strings), SHARD)]
        del strings
        if shards:
            string, offset, interval = merged_intervals(shards, rounds)
            string, offset = string // 2, 2 * offset + string % 2
            order = np.lexsort((docs[string], cores[string] - offset, keys[string], interval))
            string, offset, interval = string[order], offset[order], interval[order]
            key, place = keys[string], cores[string] - offset
            first = np.flatnonzero(np.r_[True, (interval[1:] != interval[:-1]) | (key[1:] != key[:-1]) | (place[1:] != place[:-1])]) if len(string) else np.zeros(0, np.int64)
            least = np.repeat(docs[string[first]], np.diff(np.r_[first, len(interval)]))
            ok = docs[string] > least
            np.bitwise_or.at(mask, string[ok], np.uint64(1) << offset[ok].astype(np.uint64))
        some = pa.array(mask > 0)
        trim()
        return table.select(["doc_id", "pair"]).append_column("mask", pa.array(mask.view(np.int64))).filter(some)

    return run


def bloom(ids: DataFrame) -> np.ndarray:
    """A filter for the ids of 16 bits each; at most ``MOST_WORDS`` numbers come to the driver."""
    words = min(MOST_WORDS, max(BLOOM_WORDS, 1 << (ids.count() // 4).bit_length()))
    bits = [F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.lit(64 * words)) for k in (1, 2, 3)]
    rows = ids.select(F.explode(F.array(*bits)).alias("b")).groupBy(F.expr("b div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("v")).toArrow()
    out = np.zeros(words, np.int64)
    out[rows["w"].to_numpy()] = rows["v"].to_numpy()
    return out


def maybe(words: np.ndarray):
    """A condition on doc_id that holds for all ids of the filter, and few others."""
    size = len(words)

    @F.arrow_udf("boolean")
    def test(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        out = np.ones(len(a), bool)
        for x in (a, b, c):
            x = x.to_numpy(zero_copy_only=False)
            out &= (words[x // 64] >> (x % 64)) & 1 == 1
        return pa.array(out)

    return test(*(F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.lit(64 * size)) for k in (1, 2, 3)))


def remove_repeats(docs: DataFrame, length: int = LENGTH, core: int = CORE, text: str = "text", characters: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``kept`` (the remaining bytes), n_bytes, n_removed and n_spans.

    With ``characters`` a character that lost a byte is left out of ``kept`` as a whole, and nothing else is.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    buckets = buckets_of(docs, 2)
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    groups = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_read(docs) // GROUP))
    found = stored(scatter(rows, length, core, buckets).groupBy("bucket").applyInArrow(judge(groups), _STATES).groupBy("group").applyInArrow(gather, _FOUND), "suffix-states")
    asking = found.where("octet_length(asked) > 0").select("doc_id", "asked")
    asked = bloom(asking)

    def send(batches):
        for part, data, offsets in text_blocks(batches, limit=CARRIED):
            ids = longs(part, "doc_id")
            at, low, n, key, context, owner, _ = minimizers(data, offsets, length, core)
            made = pair_keys(key, context)
            pairs = pairs_in(made, owner)
            one = np.flatnonzero(np.isin(pairs, pairs_in(*flat(part.column(2)))))
            one = one[np.unique(pairs[one], return_index=True)[1]]
            if len(one):
                raw = [data[a:b].tobytes() for a, b in zip(low[one].tolist(), (low + n - 1 + length)[one].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner[one]]), pa.array(key[one].view(np.int64)), pa.array(made[one].view(np.int64)), pa.array((at - low)[one].astype(np.int32)), pa.array(raw, pa.binary())], names=["doc_id", "key", "pair", "core", "bytes"])
            trim()

    sent = rows.where(maybe(asked)).join(asking, "doc_id").select("doc_id", "text", "asked").mapInArrow(send, "doc_id long, key long, pair long, core int, bytes binary")
    masks = stored(sent.groupBy(F.pmod(F.xxhash64("key"), F.lit(2 * buckets)).alias("unit")).applyInArrow(compare(length, core), "doc_id long, pair long, mask long"), "suffix-masks")
    masks_of = masks.groupBy("doc_id").agg(F.collect_list(F.struct("pair", "mask")).alias("masks"))
    full = found.where("octet_length(whole) > 0").select("doc_id", "whole")
    marks = stored(full.join(masks_of, "doc_id", "full").select("doc_id", "whole", "masks"), "suffix-marks")
    hit = bloom(marks.select("doc_id"))
    schema = T.StructType([*docs.schema.fields, T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())])
    names = docs.columns

    def cut_out(batches):
        for part, data, offsets in text_blocks(batches, text, CARRIED):
            where = {c: part.schema.get_field_index(c) for c in part.schema.names}
            wholes, masks = part.column(where["__whole"]), part.column(where["__masks"])
            if wholes.null_count == masks.null_count == part.num_rows:
                yield unchanged(part, data, offsets, [part.column(where[c]) for c in names])
                continue
            _, low, n, key, context, owner, _ = minimizers(data, offsets, length, core)
            pairs = pairs_in(pair_keys(key, context), owner)
            marked = masks.flatten()
            k, m = (marked.field(x).to_numpy().view(np.uint64) for x in ("pair", "mask"))
            wanted = pairs_in(k, np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(masks), 0).to_numpy()))
            order = np.argsort(wanted)
            wanted, m = wanted[order], m[order]
            edge = np.zeros(len(data) + 1, np.int32)
            whole = np.isin(pairs, pairs_in(*flat(wholes)))
            np.add.at(edge, low[whole], 1)
            np.subtract.at(edge, (low + n - 1 + length)[whole], 1)
            some = np.flatnonzero(np.isin(pairs, wanted))
            bits = m[np.searchsorted(wanted, pairs[some])]
            for w in range(int(n[some].max()) if len(some) else 0):
                at = low[some[(bits >> np.uint64(w) & np.uint64(1) > 0) & (w < n[some])]] + w
                np.add.at(edge, at, 1)
                np.subtract.at(edge, at + length, 1)
            gone = np.cumsum(edge[:-1]) > 0
            before = np.concatenate([[0], np.cumsum(gone)])
            removed = before[offsets[1:]] - before[offsets[:-1]]
            first = runs(gone, offsets)[0]
            spans = np.diff(np.searchsorted(first, offsets))
            sizes = np.diff(offsets)
            if characters and len(data):
                begins = np.flatnonzero(data & 0xC0 != 0x80)
                begins = np.unique(np.append(begins, offsets[:-1][offsets[:-1] < len(data)]))
                gone = np.repeat(np.logical_or.reduceat(gone, begins), np.diff(np.append(begins, len(data))))
            kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            trim()
            yield pa.RecordBatch.from_arrays([*(part.column(where[c]) for c in names), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans))], names=[*names, "kept", "n_bytes", "n_removed", "n_spans"])

    def unchanged(part, data, offsets, columns):
        none = pa.array(np.zeros(part.num_rows, np.int64))
        kept = pa.array([data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([*columns, kept, pa.array(np.diff(offsets), pa.int64()), none, none], names=[*names, "kept", "n_bytes", "n_removed", "n_spans"])

    def leave(batches):
        for part, data, offsets in text_blocks(batches, text, BLOCK):
            yield unchanged(part, data, offsets, part.columns)

    marks = marks.select(F.col("doc_id").alias("__id"), F.col("whole").alias("__whole"), F.col("masks").alias("__masks"))
    chosen = docs.withColumn("__hit", F.coalesce(maybe(hit), F.lit(False)))
    touched = chosen.where("__hit").drop("__hit").join(marks, F.col("doc_id") == F.col("__id"), "left").drop("__id")
    return touched.mapInArrow(cut_out, schema).unionByName(chosen.where("not __hit").drop("__hit").mapInArrow(leave, schema))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
#: Windows are put together by doubling: 2, 4 and so on to 32 bytes, then 32 + 16 + 2.
ORACLE = {"op6_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS l FROM documents),
b AS (SELECT rid, doc_id, len(l) AS n, generate_subscripts(l, 1) AS i, unnest(l) AS byte FROM d),
b1 AS (SELECT *, byte || lead(byte, 1, '') OVER (PARTITION BY rid ORDER BY i) AS s2 FROM b),
b2 AS (SELECT *, s2 || lead(s2, 2, '') OVER (PARTITION BY rid ORDER BY i) AS s4 FROM b1),
b3 AS (SELECT *, s4 || lead(s4, 4, '') OVER (PARTITION BY rid ORDER BY i) AS s8 FROM b2),
b4 AS (SELECT *, s8 || lead(s8, 8, '') OVER (PARTITION BY rid ORDER BY i) AS s16 FROM b3),
b5 AS (SELECT *, s16 || lead(s16, 16, '') OVER (PARTITION BY rid ORDER BY i) AS s32 FROM b4),
w AS (SELECT rid, doc_id, i, n, byte, s32 || lead(s16, 32, '') OVER (PARTITION BY rid ORDER BY i) || lead(s2, 48, '') OVER (PARTITION BY rid ORDER BY i) AS s FROM b5),
f AS (SELECT s, min(doc_id) AS least FROM w WHERE i + 49 <= n GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT w.*, i + 49 <= n AND coalesce(doc_id > least, FALSE) AS again FROM w LEFT JOIN f USING (s)),
c AS (SELECT rid, i, byte, max(CAST(again AS INTEGER)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM r),
g AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY rid ORDER BY i) AS before FROM c),
k AS (SELECT rid, sum(gone) AS n_removed, count_if(gone = 1 AND before = 0) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (gone = 0) AS kept FROM g GROUP BY rid)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""}
