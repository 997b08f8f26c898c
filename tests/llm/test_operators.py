"""Every operator against a brute-force version or an exact round trip, and on nulls, empties, repeats, ties and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafgraph.llm import ann, bpe, components, jaccard, katz, licenses, neardup, packing, suffixes, toxicity, warc

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids int, kept int, toxicity int"


def some_texts() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghiéü") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = say(40)
    out = [None, "", "  \n", "one", "Two words", "A b C", say(4000), "x" * 3000, passage, "don't \x1c 日本 <|endoftext|> ²½ΑΣ"]
    for _ in range(25):
        base = say(rng.randint(20, 400)).split(" ")
        out.append(" ".join(base))
        for rate in (0.0, 0.002, 0.02):
            out.append(" ".join(w if rng.random() > rate else rng.choice(vocabulary) for w in base))
        out.append(say(10) + "\n" + passage + ".\n" + say(15))
    return [(i, t, "en", "s", len(t or ""), 1, 1, 1) for i, t in enumerate(out)] + [(3, "one", "en", "s", 3, 1, 1, 1)]


@pytest.fixture(scope="module")
def rows():
    return some_texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall((text or "").translate(LOW))


def test_bpe_equals_the_library_and_decodes(docs, none, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    got = sorted((r.doc_id, r.ids, r.decoded) for r in bpe.decode_ids(bpe.encode_texts(docs, path), path).collect())
    want = sorted((r[0], (ids := library.encode(r[1] or "", add_special_tokens=False).ids), library.decode(ids, skip_special_tokens=False)) for r in rows)
    assert got == want
    digests = {r.doc_id: r for r in bpe.bpe_digests(docs, path).collect()}
    for i, ids, said in want:
        assert digests[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert bpe.bpe_digests(none, path).count() == 0


def test_packing_equals_the_library_and_places_every_token_once(docs, none, rows):
    paths = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(paths[1])
    got = packing.pack(docs, *paths, capacity=256, steps=20).collect()
    want = []
    for i, text, *_ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    total, by_sequence = sum(w[3] for w in want), {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by_sequence) <= 11 / 9 * -(-total // 256) + 1  # the bound of first fit decreasing
    assert packing.pack(none, *paths).count() == 0


def test_best_fit_keeps_the_histogram():
    rng = np.random.default_rng(1)
    need = rng.integers(0, 40, 64)
    out = packing.solve(need, 64, 60)
    assert (sum(m * t for m, t in out) == need).all()
    assert all((m * np.arange(1, 65)).sum() <= 64 for m, _ in out)


def test_warc_round_trip_rejects_magic_in_payloads(spark, tmp_path):
    evil = "text\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n" * 3
    data = [(1, "http://a", evil), (2, None, None), (3, "http://b\r\nX: y", "é" * 60), (4, "u", "é" * 60), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (9, "u", evil)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(data, "page_id long, url string, html string").coalesce(2), path, file_records=3)
    got = {r.page_id: (r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, r.sound) for r in warc.read_archives(spark, path).collect()}
    raw = {i: (h or "").encode() for i, _, h in data}
    kind = {4: ("revisit", 3), 9: ("revisit", 1)}
    assert got == {i: (kind.get(i, ("response",))[0], len(b), hashlib.sha256(b).hexdigest(), kind.get(i, (0, None))[1], True) for i, b in raw.items()}


def levenshtein_one(a: str, b: str) -> bool:
    if a == b:
        return True
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(5, 8))): 1.0 for _ in range(20)}
    trie = toxicity.Trie(terms)
    for _ in range(4000):
        token = "".join(rng.choice("abc") for _ in range(rng.randint(4, 9)))
        want = 0 if token in terms else 1 if any(levenshtein_one(token, t) for t in terms) else -1
        assert trie.meet(token)[0] == want, token


def test_every_term_is_met_misspelled():
    rng = random.Random(9)
    terms = {"".join(rng.choice("abcdefghij") for _ in range(rng.randint(8, 12))): 9.0 - i / 100 for i in range(600)} | {"k" * 60: 1.0}
    trie = toxicity.Trie(terms)
    for term in terms:
        assert trie.meet(term[:3] + "z" + term[4:]) == (1, terms[term]), term


def test_toxicity_holds_out(spark, none):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("mnopqrst") for _ in range(5)) for _ in range(80)]
    data, marks = [], []
    for i in range(400):
        text = [rng.choice(vocabulary) for _ in range(40)]
        if toxic := rng.random() < 0.3:
            for _ in range(4):
                text[rng.randrange(40)] = rng.choice(["badword", "awfulness"])
        data.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame([*data, (900, None), (901, ""), (902, vocabulary[0] + " badwrod awfulnes badwordd")], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.7) == bool(t) for i, t in marks)
    assert got[900] == got[901] < 0.7 and all(0 <= x <= 1 for x in got.values())
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0))).count() == 0


def brute_components(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute_components(80, links)
    assert got == {i: want[i] for i in range(80) if any(i in x and x[0] != x[1] for x in links)}


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_jaccard_equals_all_pairs(docs, none, rows, width, num):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    n = max(sets) + 1
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = brute_components(n, links)
    got = jaccard.near_duplicates(docs, width, num, 100).collect()
    assert len(got) == len(rows) and len(links) > 20
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]) for r in got)
    assert jaccard.near_duplicates(none, width, num, 100).count() == 0


def test_jaccard_in_tiles(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_SETS", 2)
    one = sorted(jaccard.near_duplicates(docs, 3, 50, 100).collect())
    monkeypatch.setattr(jaccard, "TILE_SETS", 800)
    assert one == sorted(jaccard.near_duplicates(docs, 3, 50, 100).collect())


def test_minimizers_of_very_long_texts(monkeypatch):
    """Texts too long for packed places have the same minimizers."""
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.integers(97, 100, 4000), np.full(300, 32), np.tile(rng.integers(97, 123, 7), 60)]).astype(np.uint8)
    offsets = np.array([0, 900, 930, len(data)])
    usual = suffixes.minimizers(data, offsets, 50, 20)
    monkeypatch.setattr(suffixes, "PLACE_BITS", 0)
    assert all((a == b).all() for a, b in zip(usual, suffixes.minimizers(data, offsets, 50, 20), strict=True))


def test_suffixes_equal_brute_force(docs, none, rows):
    first, want = {}, {}
    for i, raw in sorted((r[0], (r[1] or "").encode()) for r in rows):
        for p in range(len(raw) - 49):
            first.setdefault(raw[p : p + 50], i)
    for i, raw in ((r[0], (r[1] or "").encode()) for r in rows):
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = True
        want[i] = len(raw), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(raw) else 0, bytes(np.frombuffer(raw, np.uint8)[~gone])
    got = suffixes.remove_repeats(docs).collect()
    assert len(got) == len(rows) and sum(w[1] for w in want.values()) > 1000
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want
    assert suffixes.remove_repeats(none).count() == 0


def test_suffix_answers_come_by_group():
    """A bucket answers with a row for each group of documents, however many documents it has, and a group has one for each document."""
    data = np.frombuffer(b"".join(b"%04d" % i + b" the quick brown fox jumps over the lazy dog and runs on to the far side of the hill" * 2 for i in range(300)), np.uint8)
    offsets = np.linspace(0, len(data), 301).astype(np.int64)
    _, _, _, key, context, owner, sides = suffixes.minimizers(data, offsets, 50, 20)
    order = np.argsort(key, kind="stable")
    entry = [suffixes.packed(key[order]), context[order].tobytes(), sides[order].tobytes(), owner[order].astype(np.uint32).tobytes(), np.arange(300).tobytes()]
    got = suffixes.judge(4)(pa.table({n: pa.array([x], pa.binary()) for n, x in zip(("keys", "contexts", "sides", "owners", "docs"), entry, strict=True)}))
    assert sorted(got["group"].to_pylist()) == [0, 1, 2, 3]
    found = suffixes.gather(got)
    assert sorted(found["doc_id"].to_pylist()) == sorted(set(found["doc_id"].to_pylist())) and found.num_rows >= 299


@pytest.mark.parametrize("length, core", [(50, 20), (41, 20), (30, 8)])
def test_suffix_merge_reads_two_letters_at_once(length, core):
    """The masks of contexts are those of brute force; a merge has a round for each two letters, the core being one or two."""
    rng = np.random.default_rng(length)
    rows, most = [], length - core
    cores = [rng.integers(0, 256, core).astype(np.uint8).tobytes() for _ in range(6)]
    base = [rng.integers(97, 99, most).astype(np.uint8).tobytes() for _ in range(3)] + [b"\xff" * most]
    for i in range(500):
        k, left, right = int(rng.integers(6)), base[rng.integers(4)], base[rng.integers(4)]
        left = bytes(rng.integers(97, 99, most // 3).astype(np.uint8)) + left[most // 3 :]
        a = int(rng.integers(most + 1))
        rows.append({"doc_id": i % 400, "key": k, "pair": i, "core": a, "bytes": left[most - a :] + cores[k] + right[: most - int(rng.integers(a + 1))]})
    seen = {}
    for r in rows:
        for w in range(len(r["bytes"]) - length + 1):
            at = (r["key"], r["core"] - w, r["bytes"][w : w + length])
            seen[at] = min(seen.get(at, r["doc_id"]), r["doc_id"])
    want = {r["pair"]: sum(1 << w for w in range(len(r["bytes"]) - length + 1) if seen[r["key"], r["core"] - w, r["bytes"][w : w + length]] < r["doc_id"]) for r in rows}
    got = suffixes.compare(length, core)(pa.Table.from_pylist(rows)).to_pylist()
    assert {r["pair"]: r["mask"] for r in got} == {p: m for p, m in want.items() if m} and len(got) > 50
    assert len(suffixes.symbols_of([b"a" * 80], [30], 20, 2)[0]) // 2 == 31


class BruteKatz:
    """The same model by dictionaries: probabilities of any word after any history, evaluated recursively."""

    def __init__(self, texts: list[list[str]], order: int):
        self.n, self.next, self.d = Counter(), {}, {}
        for words_of in texts:
            seen = ["<s>"] * (order - 1) + words_of + ["</s>"]
            for i in range(order - 1, len(seen)):
                for k in range(order):
                    self.n[tuple(seen[i - k : i + 1])] += 1
                    self.next.setdefault(tuple(seen[i - k : i]), set()).add(seen[i])
        for k in range(1, order + 1):
            c = [sum(1 for g, v in self.n.items() if len(g) == k and v == r) for r in range(1, 7)]
            try:
                rest = 6 * c[5] / c[0]
                d = [((r + 1) * c[r] / c[r - 1] / r - rest) / (1 - rest) for r in range(1, 6)]
                assert all(0 < x < 1 for x in d)
            except (ZeroDivisionError, AssertionError):
                less = c[0] / (c[0] + 2 * c[1]) if c[0] and c[1] else 0.5
                d = [(r - less) / r for r in range(1, 6)]
            self.d[k] = d
        self.total = sum(v for g, v in self.n.items() if len(g) == 1)

    def kept(self, gram: tuple) -> float:
        c = self.n[gram]
        return c if c > 5 else c * self.d[len(gram)][c - 1]

    def p(self, word: str, history: tuple) -> float:
        after = self.next.get(history, set())
        mass = sum(self.kept((*history, w)) for w in after)
        count = sum(self.n[(*history, w)] for w in after)
        if not count:
            return self.p(word, history[1:]) if history else 1.0
        left = count - mass
        whole, left = (count + 0.5, 0.5) if left <= 1e-9 * count else (count, left)
        if word in after:
            return self.kept((*history, word)) / whole
        if not history:
            return left / whole
        return left / whole / (1 - sum(self.p(w, history[1:]) for w in after)) * self.p(word, history[1:])


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_equals_recursion_over_dictionaries(spark, none, order):
    rng = random.Random(order)
    say = lambda n: " ".join(rng.choice("abcdefgh" if rng.random() < 0.9 else "xyz") for _ in range(n))
    data = [(i, say(rng.randint(0, 30))) for i in range(40)] + [(41, None), (46, ""), (None, "a b"), (42, "q " * 8), (42, "q " * 8), (51, "A\x0bB unheard of"), (43, "r s t u v w x y z " * 200)]
    held = F.col("doc_id") % 5 == 1
    got = katz.score(spark.createDataFrame(data, "doc_id long, text string").withColumn("score", F.lit("x")), held, order).collect()
    model = BruteKatz([words(t) for i, t in data if i is None or i % 5 != 1], order)
    history = lambda seen, i: tuple((["<s>"] * (order - 1) + seen)[i : i + order - 1])
    want, base = [], []
    for i, t in data:
        seen = [*words(t), "</s>"]
        want.append((i or -1, sum(math.log10(model.p(w, history(seen, k))) for k, w in enumerate(seen))))
        v = sum(1 for g in model.n if len(g) == 1)
        base.append((i or -1, sum(math.log10((model.n[(w,)] + 0.5) / (model.total + 0.5 * (v + 1))) for w in seen)))
    for found, wanted in ((sorted((r.doc_id or -1, r.score) for r in got), sorted(want)), (sorted((r.doc_id or -1, r.base_score) for r in got), sorted(base))):
        assert [i for i, _ in found] == [i for i, _ in wanted] and np.allclose([x for _, x in found], [x for _, x in wanted], rtol=1e-9)
    vocabulary = {g[0] for g in model.n if len(g) == 1} | {"?"}
    for h in [(), *model.next][:40]:
        if len(h) < order and "<s>" not in h[1:]:
            assert abs(sum(model.p(w, h) for w in vocabulary) - 1) < 1e-9
    assert all(r.train_tokens == model.total and r.held_out == (r.doc_id is not None and r.doc_id % 5 == 1) for r in got)
    assert katz.score(none, held, order).count() == 0


def test_katz_chunks_are_filled_across_batches():
    """However rows are dealt over batches, a chunk is full before the next one begins, in the order of the rows; sums keep every bit."""
    texts = ["w" * 1000 if i % 3 else None for i in range(300)]
    whole = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": texts})
    for size in (7, 300):
        got = list(katz.full_blocks([whole.slice(i, size) for i in range(0, 300, size)], 50_000))
        assert [x for rows, _, _ in got for x in rows.column(0).to_pylist()] == list(range(300))
        assert b"".join(d.tobytes() for _, d, _ in got) == "".join(t or "" for t in texts).encode() and all(o[-1] == len(d) for _, d, o in got)
        assert len(got) <= 6 and all(len(d) <= 50_000 for _, d, _ in got)
    assert list(katz.full_blocks([whole.slice(0, 0)])) == []
    few, many = np.array([0.1, 2.5, 0.1, 1e-300] * 300), np.random.default_rng(1).random(500)
    assert len(katz.coded(few)) < 8 * len(few) / 4 and len(katz.coded(many)) == 8 * len(many) + 4
    assert all(np.array_equal(katz.from_coded(katz.coded(x)), x) for x in (few, many, few[:0], few[:1]))


def test_katz_moves_each_answer_once(docs, monkeypatch):
    """Chunks in 7 buckets of a session with 4 shuffle partitions: each of the 2 and 3 answers is dealt by chunk once, to the chunks' buckets."""
    plans, kept = [], katz.stored
    monkeypatch.setattr(katz, "buckets_of", lambda df, times=1: 7 * times)
    monkeypatch.setattr(katz, "stored", lambda df, name, **k: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), kept(df, name, **k))[1])
    got = katz.score(docs, F.col("doc_id") % 5 == 1)
    monkeypatch.undo()
    dealt = {name: re.findall(r"Exchange hashpartitioning\(chunk#\d+L?, (\d+)\)", plan) for name, plan in plans}
    assert dealt == {"katz-1": [], "katz-2": [], "katz-weights-2": ["7"] * 2, "katz-scores": ["7"] * 3}
    plain = katz.score(docs, F.col("doc_id") % 5 == 1)
    assert np.allclose(*(sorted((r.doc_id, r.score, r.base_score) for r in x.collect()) for x in (got, plain)), rtol=1e-12)


def test_katz_beats_the_base(docs):
    got = [r for r in katz.score(docs, F.col("doc_id") % 5 == 1).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_near_duplicates_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(160, 12))
    x[40:80] = x[:40] + rng.normal(scale=0.12, size=(40, 12))
    x[80:90] = x[0]
    label = [int(i % 2) for i in range(160)]
    data = [(i, [float(np.float32(v)) for v in x[i]], label[i]) for i in range(160)] + [(200, None, 1), (201, [0.0] * 12, 1), (202, [float("nan")] * 12, 1), (203, [float(v) for v in x[0]], None), (204, [1.0, 2.0], 1)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    y = np.array([d[1] for d in data[:160]], np.float32).astype(float)
    cos = y @ y.T / np.linalg.norm(y, axis=1) / np.linalg.norm(y, axis=1)[:, None]
    links = [(a, b) for a in range(160) for b in range(a + 1, 160) if label[a] == label[b] and cos[a, b] >= 0.93]
    want, degree = brute_components(160, links), np.bincount(np.array(links).ravel(), minlength=160)
    for tile in (2048, 16):
        got = {r.vec_id: r for r in neardup.near_duplicates(frame, tile=tile).collect()}
        assert all((got[i].n_links, got[i].component_id, got[i].kept) == (degree[i], want[i], want[i] == i) for i in range(160))
        assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(200, 205))


def test_near_duplicates_of_every_length(spark):
    data = [(i, [1.0, i / 1000, 0.5], 1) for i in range(6)] + [(10, [1.0, 2.0], 1), (11, [1.0, 2.1], 1), (12, [2.0, -1.0], 1), (13, [1.0, 2.0], 2), (20, [3.0] * 20, 1), (21, [3.1] * 20, 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect()}
    want = {i: (5, 0, i == 0) for i in range(6)} | {10: (1, 10, True), 11: (1, 10, False), 12: (0, 12, True), 13: (0, 13, True), 20: (1, 20, True), 21: (1, 20, False)}
    assert got == want


def test_search_recall_and_edge_cases(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    frame = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(600)] + [(1000, None), (1100, [0.0] * 16)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(frame, frame.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [0, 100, 200, 300, 400, 500]
    y, hits = x.astype(float), 0
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-9 for _, v, s in found)
        hits += len({*np.argsort(d)[:10].tolist()} & {f[1] for f in found})
    assert hits >= 54
    few = frame.where("vec_id < 5")
    assert ann.search(few, few.where("vec_id = 0")).count() == 4
    assert ann.search(frame.limit(0), frame.limit(0)).count() == 0


def test_search_in_every_length(spark):
    data = [(i, [float(i), 1.0, 2.0]) for i in range(6)] + [(10 + i, [float(i * i), 1.0]) for i in range(4)] + [(30, [1.0] * 9)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.rank): r.vec_id for r in ann.search(frame, frame.where("vec_id in (0, 10, 30)"), k=3).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (0, 3): 3, (10, 1): 11, (10, 2): 12, (10, 3): 13}


def test_licenses_equal_brute_force(spark, none):
    rng = random.Random(11)
    filler = lambda n: " ".join(f"word{rng.randrange(900)}" for _ in range(n))
    data = [(1, None), (2, ""), (3, "All rights"), (4, filler(9000)), (5, "all RIGHTS reserved."), (5, "all RIGHTS reserved.")]
    for i, (_, text) in enumerate(sorted(licenses.TEMPLATES.items()) * 3):
        seen = [w if rng.random() > (0.0, 0.03, 0.12)[i % 3] else "changed" for w in text.split(" ")]
        data.append((10 + i, f"{filler(rng.randrange(300))}\n{' '.join(seen)} {filler(rng.randrange(300))}".upper() if i % 2 else f"{filler(40)} {' '.join(seen[: len(seen) * 2 // 3])}"))
    frame = spark.createDataFrame(data, "doc_id long, text string").withColumn("licenses", F.lit(1))
    got = sorted((r.doc_id, r.licenses) for r in licenses.scan_licenses(frame).collect())
    scanner, want = licenses.Scanner(licenses.TEMPLATES, 3, 0.8), []
    grams = lambda w: [tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    for i, t in data:
        own, found = grams(words(t)), []
        for c in scanner.classes:
            for name, _ in c.templates:
                template = set(grams(words(licenses.TEMPLATES[name])))
                if any(len(template & set(own[max(0, a - c.size // 4) : a + c.size + c.size // 4])) >= 0.8 * len(template) - 1e-9 for a in c.starts(len(own)).tolist()):
                    found.append(name)
        want.append((i, ",".join(sorted(found))))
    assert got == sorted(want) and sum(bool(x) for _, x in got) > 20
    assert licenses.scan_licenses(none).count() == 0 == licenses.scan_licenses(frame, {"empty": " "}).where("n_licenses > 0").count()
    twins = licenses.scan_licenses(frame, {"a": "all rights reserved.", "b": "ALL rights  reserved."}).where("doc_id = 5").collect()
    assert [r.licenses for r in twins] == ["a,b", "a,b"]


def test_search_of_large_and_tied_vectors(spark):
    data = [(i, [1e20 * (i + 1), 0.0, 1.0, 2.0]) for i in range(20)] + [(i, [float(i % 3)] * 7) for i in range(100, 112)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({"rank": F.lit("x"), "score": F.lit(0)})
    got = {}
    for r in ann.search(frame, frame.where("vec_id in (0, 100)")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert [v for _, v, _ in sorted(got[0])] == list(range(1, 11)) and sorted(got[0])[0][2] == 1e20
    # vectors of zeros (102, 105 and so on) take no part, and ties go to smaller ids
    assert not {v for _, v, _ in got[100]} & {102, 105, 108, 111}
    tied = frame.where("vec_id >= 100")
    assert [r.vec_id for r in ann.search(tied, tied.where("vec_id = 101"), k=5).orderBy("rank").collect()] == [104, 107, 110, 100, 103]


def test_search_recall_on_a_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.array([r.embedding for r in rows.orderBy("vec_id").collect()], float)
    hits = total = 0
    for r in ann.search(rows, rows.where("vec_id % 100 = 0")).groupBy("query_id").agg(F.collect_list("vec_id").alias("found")).collect():
        q = int(r.query_id)
        ids = [v.vec_id for v in rows.select("vec_id").orderBy("vec_id").collect()] if not total else ids
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
        d[ids.index(q)] = np.inf
        hits += len({ids[i] for i in np.argsort(d, kind="stable")[:10]} & set(r.found))
        total += 10
    assert total and hits / total >= 0.9, hits / total


def test_near_duplicates_of_odd_tables(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (None, [1.0, 0.0], 1), (3, [0.0, 1.0], None), (4, [1e300, 1e300], 1), (5, [1e-300, 1e-300], 1)], "vec_id long, embedding array<double>, label int").withColumns({"n_links": F.lit("x"), "bin": F.lit(1), "v": F.lit(2)})
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(frame).collect()), key=str)
    assert [g for g in got if g[0] in (1, 2)] == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)] and (3, 0, 3, True) in got and (-1, 0, None, None) in got
    assert neardup.near_duplicates(frame.limit(0)).count() == 0


def test_toxicity_of_odd_rows(spark):
    model = {"badword": 5.0}, np.array([1.0, 0, 0, 0.5, 0, 0, 0, -3.0])
    long = "fine words " * 200_000 + "badword"
    frame = spark.createDataFrame([(1, "badword"), (1, "badword"), (2, long), (3, None), (4, ""), (5, "badwrd " * 3)], "doc_id long, text string").withColumns({"toxicity": F.lit("x"), "score": F.lit(1)})
    got = toxicity.score(frame, model).collect()
    by = {r.doc_id: r.toxicity for r in got}
    assert len(got) == 6 and by[1] == by[2] > 0.8 and by[3] == by[4] < 0.05 and by[4] < by[5] < by[1]
    assert toxicity.score(frame, model).columns.count("toxicity") == 1
    trained = toxicity.fit(frame, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int"))
    assert trained[0] == {} and toxicity.score(frame, trained).select("toxicity").distinct().count() == 1


def test_toxicity_features_equal_a_plain_version():
    rng = random.Random(8)
    terms = {"badword": 5.0, "awful": 3.0, "meh": 2.6}
    trie = toxicity.Trie(terms)
    texts = []
    for _ in range(60):
        seen = [rng.choice(["badword", "badwrod", "awful", "awfull", "meh", "mehh", "said", "plain", "words", "here", "and", "there"]) for _ in range(rng.randrange(40))]
        texts.append(" ".join(f'"{w}"' if rng.random() < 0.2 else w for w in seen))
    raw = "".join(texts).encode()
    got = toxicity.features(trie, np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, texts)]))
    for text, row in zip(texts, got, strict=True):
        spans = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[a-z]+", text)]
        met = [trie.meet(w) for _, _, w in spans]
        hits = [i for i, (k, _) in enumerate(met) if k >= 0]
        exact = {spans[i][2] for i in hits if met[i][0] == 0}
        want = [max((met[i][1] for i in hits if met[i][0] == 0), default=0), math.log1p(sum(terms[w] >= 4 for w in exact)), math.log1p(len(exact)), math.log1p(len({spans[i][2] for i in hits if met[i][0] == 1}))]
        quoted = density = strength = 0
        for i in hits:
            low, high = max(0, i - 8), min(len(spans), i + 9)
            around = {w for _, _, w in spans[low:high]}
            quoted += bool(around & toxicity.REPORTING) or ('"' in text[spans[low][0] : spans[i][0]] and '"' in text[spans[i][1] : spans[high - 1][1]])
            density += sum(met[j][0] == 0 for j in range(low, high)) / (high - low)
            strength += met[i][1] if met[i][0] == 0 else 0
        n = max(1, len(hits))
        assert np.allclose(row, [*want, quoted / n, density / n, math.log1p(strength / max(1, len(spans)) * 10)]), text


def test_warc_of_odd_tables(spark, tmp_path):
    schema = "page_id long, url string, html string"
    warc.write_archives(spark.createDataFrame([], schema), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0
    same = "x" * 200
    frame = spark.createDataFrame([(None, "u", same), (4, "u", same), (4, "u", same), (6, "u", same)], schema).withColumns({"payload": F.lit(1), "digest": F.lit("d"), "n": F.lit(2)})
    warc.write_archives(frame, str(tmp_path / "w"))
    got = sorted((r.page_id or -1, r.record_type, r.refers_to or 0) for r in warc.read_archives(spark, str(tmp_path / "w")).collect())
    assert got == [(-1, "revisit", 4), (4, "response", 0), (4, "response", 0), (6, "revisit", 4)]
