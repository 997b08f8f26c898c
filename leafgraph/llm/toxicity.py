"""Toxicity: a lexicon trie met by Levenshtein automata, with context windows, under a small logistic model.

Fitting takes a bounded sample of labelled rows of the training folds.  All words
in ``LEAST`` toxic texts or more with log odds of ``ODDS`` or more make the lexicon.  The lexicon is a trie.  A token is met with it by a
Levenshtein automaton: the state holds the places reached with no edit and with
one, a step is one edge of the trie, and a branch ends as soon as the state is
empty.  So terms of five letters or more are found one edit away as well; exact
and misspelled hits are features of their own, and the fit says how much a
misspelling counts.

Around each hit a window of words is scored: quotation marks and reporting words
speak for quotation, further hits for abuse.  A document's features are summed
over its hits, so its whole text counts.

Edge cases: a null or empty text has no hits and gets the score of the
intercept; labels that are null take no part; without labelled rows of both
classes every score is the share of toxic ones (0 where there are none); doc_id
null is never a training row and gets a score as any other; equal texts get equal
scores, also as repeated rows; further columns are kept, one named like the output
is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.llm.blocks import LOWER, arrow_batches, distinct_words, runs, text_blocks, trim
from leafgraph.llm.store import stored

SAMPLE = 24_000
LEAST, ODDS = 4, 2.5
WINDOW = 8
#: Bytes of text looked at together.
BLOCK = 2 << 20
REPORTING = frozenset("said says quote quoted quotes reported reports wrote writes called cited dijo sagte dit".split())

_IN_WORD = np.zeros(256, bool)
_IN_WORD[np.r_[ord("a") : ord("z") + 1, ord("A") : ord("Z") + 1, ord("0") : ord("9") + 1, 0x80:0x100, ord("@"), ord("$"), ord("*")]] = True


class Trie:
    """A lexicon with weights; its terms of five letters or more also form a trie for automata."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.root: dict = {}
        self.near: set[str] = set()
        self.longest = max(map(len, weights), default=0)
        for term in (t for t in weights if len(t) >= 5):
            node = self.root
            self.near.update((term, *(term[:i] + term[i + 1 :] for i in range(len(term)))))
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
        self.met: dict[str, tuple[int, float]] = {}

    def meet(self, token: str) -> tuple[int, float]:
        """(0, weight) of the term, (1, weight) of the strongest term one edit away, or (-1, 0)."""
        if (got := self.weights.get(token)) is not None:
            return 0, got
        if (got := self.met.get(token)) is None:
            if len(self.met) >= 200_000:
                self.met.clear()
            # one edit, or a swap, is undone by leaving out at most one letter of the token and one of the term
            may = 4 <= len(token) <= self.longest + 1 and not self.near.isdisjoint((token, *(token[:i] + token[i + 1 :] for i in range(len(token)))))
            got = self.met[token] = self.automaton(token) if may else (-1, 0.0)
        return got

    def automaton(self, token: str) -> tuple[int, float]:
        """The trie's terms that the automaton of one edit around the token accepts.

        A state is two sets of places in the token as bits: those reached without an edit, and with one
        (a letter put in, left out or changed, or two neighbours in the wrong order).
        """
        masks: dict[str, int] = {}
        for i, c in enumerate(token):
            masks[c] = masks.get(c, 0) | 1 << i
        accept, best = 1 << len(token), (-1, 0.0)
        stack = [(self.root, 1, 0b10, 0)]  # places 0 without an edit, 1 after leaving out a letter; none half-way through a swap
        while stack:
            node, none, one, swap = stack.pop()
            for c, child in node.items():
                if c == "":
                    if (none | one) & accept and (best[0] < 0 or self.weights[child] > best[1]):
                        best = 1, self.weights[child]
                    continue
                m = masks.get(c, 0)
                same = (none & m) << 1
                edited = (one & m) << 1 | none | none << 1 | same << 1 | (swap & m) << 2
                if same | edited:
                    stack.append((child, same, edited & (2 * accept - 1), none & (m >> 1)))
        return best


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Starts, ends and owners of the tokens, the distinct ones, and each token's number among them."""
    starts, ends = runs(_IN_WORD[data], offsets)
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    distinct, codes = distinct_words(LOWER[data][_IN_WORD[data]], bounds)
    owner = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, owner, [w.decode("utf-8", "replace").strip("*$@").lower() or "*" for w in distinct], codes


def features(trie: Trie, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text: weight of the strongest exact hit, logs of the numbers of distinct strong, exact and misspelled hits,
    share of hits in quotation, density of the hits' windows, and log of the summed weights per word."""
    n = len(offsets) - 1
    out = np.zeros((n, 7))
    starts, ends, owner, distinct, codes = tokens(data, offsets)
    if not len(starts):
        return out
    met = [trie.meet(w) for w in distinct]
    kind, weight = np.array([k for k, _ in met]), np.array([w for _, w in met])
    reporting = np.array([w in REPORTING for w in distinct])
    hit = np.flatnonzero(kind[codes] >= 0)
    if not len(hit):
        return out
    near_report = np.concatenate([[0], np.cumsum(reporting[codes])])
    hits_before = np.concatenate([[0], np.cumsum(kind[codes] == 0)])
    quotes = np.concatenate([[0], np.cumsum((data == ord('"')) | (data == 0xAB) | (data == 0xBB))])
    per_doc = np.bincount(owner, minlength=n)
    first = np.cumsum(per_doc) - per_doc
    low, high = np.maximum(hit - WINDOW, first[owner[hit]]), np.minimum(hit + WINDOW + 1, (first + per_doc)[owner[hit]])
    quoted = (near_report[high] > near_report[low]) | (quotes[starts[hit]] - quotes[starts[low]] > 0) & (quotes[ends[high - 1]] - quotes[ends[hit]] > 0)
    density = (hits_before[high] - hits_before[low]) / (high - low)
    at = owner[hit]
    exact = kind[codes[hit]] == 0
    strength = np.where(exact, weight[codes[hit]], 0.0)
    np.maximum.at(out[:, 0], at, strength)
    seen = np.unique(np.stack([at, codes[hit]]), axis=1)
    distinct_of = lambda ok: np.log1p(np.bincount(seen[0][ok], minlength=n))
    out[:, 1] = distinct_of((kind[seen[1]] == 0) & (weight[seen[1]] >= 4.0))
    out[:, 2] = distinct_of(kind[seen[1]] == 0)
    out[:, 3] = distinct_of(kind[seen[1]] > 0)
    total = np.maximum(np.bincount(at, minlength=n), 1)
    out[:, 4] = np.bincount(at, quoted, n) / total
    out[:, 5] = np.bincount(at, density, n) / total
    out[:, 6] = np.log1p(np.bincount(at, strength, n) / np.maximum(per_doc, 1) * 10)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression, the intercept last, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Texts and labels of at most ``sample`` labelled rows whose fold is not 1, by a hash of doc_id."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    chosen = labels.where("toxic is not null and doc_id is not null").where(fold).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most this many pairs of numbers, so they may be broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").alias("id"), "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], np.ndarray]:
    """The lexicon and the weights of the features.  What comes to the driver follows the sample's bound, not the table."""
    rows = training_rows(docs, labels, sample)
    arrow_batches(docs.sparkSession)

    def count(batches):
        seen = Counter(), Counter()
        total = [0, 0]
        for part, data, offsets in text_blocks(batches, limit=BLOCK):
            toxic = part.column(2).to_numpy(zero_copy_only=False) > 0
            _, _, owner, distinct, codes = tokens(data, offsets)
            pairs = np.unique(owner.astype(np.int64) * max(1, len(distinct)) + codes)
            for k in (0, 1):
                total[k] += int((toxic == k).sum())
                mine = pairs[toxic[pairs // max(1, len(distinct))] == k] % max(1, len(distinct))
                for i, c in enumerate(np.bincount(mine, minlength=len(distinct)).tolist()):
                    if c:
                        seen[k][distinct[i]] += c
            trim()
        terms = [""] + sorted({*seen[0], *seen[1]} - {""})
        a, b = [total[0]] + [seen[0][t] for t in terms[1:]], [total[1]] + [seen[1][t] for t in terms[1:]]
        for i in range(0, len(terms), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(terms[i : i + 20_000]), pa.array(a[i : i + 20_000]), pa.array(b[i : i + 20_000])], names=["term", "clean", "toxic"])

    counts = stored(rows.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxicity-counts")
    first = counts.where("term = ''").first()
    totals = (first["clean"], first["toxic"]) if first else (0, 0)
    if not totals[0] or not totals[1]:
        share = totals[1] / max(1, sum(totals))
        return {}, np.r_[np.zeros(7), np.log(max(share, 1e-9) / max(1 - share, 1e-9))]
    weight = F.log((F.col("toxic") + 0.5) / (totals[1] + 1)) - F.log((F.col("clean") + 0.5) / (totals[0] + 1))
    strong = counts.where((F.col("toxic") >= LEAST) & (F.length("term") > 2)).select("term", weight.alias("w")).where(F.col("w") >= ODDS)
    chosen = {r["term"]: r["w"] for r in strong.orderBy(F.desc("w"), "term").collect()}  # words of the sample

    def describe(batches):
        trie = Trie(chosen)
        for part, data, offsets in text_blocks(batches, limit=BLOCK):
            x = features(trie, data, offsets)
            yield pa.RecordBatch.from_arrays([part.column(2).cast(pa.int32()), *map(pa.array, x.T)], names=["y", *"abcdefg"])
            trim()

    table = rows.mapInArrow(describe, "y int, a double, b double, c double, d double, e double, f double, g double").toPandas()  # at most `sample` rows, or their repeats
    return chosen, fit_logistic(table.iloc[:, 1:].to_numpy(), (table["y"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], text: str = "text", out: str = "toxicity") -> DataFrame:
    """The rows of ``docs`` with a score from 0 to 1, higher for what is likelier toxic.  Only the texts go to Python, and only scores come back."""
    arrow_batches(docs.sparkSession)
    lexicon, weights = model

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = Trie(lexicon)
        for column in texts:
            parts = [np.zeros(0)]
            for _, data, offsets in text_blocks([pa.RecordBatch.from_arrays([column], names=["text"])], limit=BLOCK):
                z = np.c_[features(trie, data, offsets), np.ones(len(offsets) - 1)] @ weights
                parts.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.array(np.concatenate(parts))
            trim()

    return docs.withColumn(out, scored(F.col(text)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return score(docs.select("doc_id", "text"), model, out="score").select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
