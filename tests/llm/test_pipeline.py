"""The pipeline's stages: each decision against a plain version, and nulls, empties, repeats, an empty table and clashing columns."""

from __future__ import annotations

import random
import re

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents, some of them toxic, copies, near copies, shared passages, odd rows; and their labels."""
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice("wxyz") + str(rng.randrange(400)) for _ in range(n))
    passage = say(60) + " \ufffd é"
    rows = [(None, "no id"), (None, None), (1, None), (2, ""), (3, "\ufffd alone"), (4, say(30_000))]
    rows += [(10 + i, say(40) + (" badword awfulness badword" if i % 3 == 0 else "")) for i in range(150)]
    base = say(80)
    rows += [(200, base), (201, base), (202, base + " more"), (203, say(20) + " " + passage + " " + say(20)), (204, say(20) + " " + passage + "é " + say(20)), (205, "twice " + base[:40]), (205, "twice " + base[:40])]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(10 + i, int(i % 3 == 0)) for i in range(150)] + [(None, 1), (1, None)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def rows(df):
    assert df.columns == P.COLUMNS
    return sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "", r.n_chars) for r in df.collect()))


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"toxicity": F.lit("x"), "kept": F.lit(1), "component_id": F.lit(2), "n": F.lit(3)})
    before = rows(docs.select(*P.COLUMNS))
    clean = P.stored(P.drop_toxic(spark, docs, folder), "test")
    assert rows(clean) == [r for r in before if "badword" not in r[1]]
    single = rows(P.drop_near_duplicates(spark, clean.withColumn("component_id", F.lit(0)), folder))
    grams = {}
    for i, t, _ in rows(clean):
        w = WORD.findall(t.lower())
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w and i >= 0 else set()
    gone = {b for a in grams for b in grams if a < b and grams[a] and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b])}
    assert gone >= {201, 202} and single == sorted({r for r in rows(clean) if r[0] not in gone} | {r for r in rows(clean) if r[0] == -1})
    stage = spark.createDataFrame([(i if i >= 0 else None, t, "en", "s", n) for i, t, n in single], SCHEMA)
    cut = {r[0]: r for r in rows(P.cut_repeats(spark, stage, folder))}
    first = {}
    for i, t, _ in single:
        raw = t.encode()
        for k in range(len(raw) - 49):
            if i >= 0:
                first.setdefault(raw[k : k + 50], i)
    for i, t, n in single:
        raw, lost = t.encode(), set()
        for k in range(len(raw) - 49):
            if i >= 0 and first[raw[k : k + 50]] < i:
                lost |= set(range(k, k + 50))
        want, at = "", 0
        for c in t:
            if lost.isdisjoint(range(at, at + len(c.encode()))):
                want += c
            at += len(c.encode())
        if i >= 0:
            assert cut[i][1:] == (want, len(want) if lost else n), i
    assert cut[3][1] == "\ufffd alone" and len(cut[204][1]) < len(cut[203][1])
    pieces = P.pack_sequences(spark, stage.withColumn("piece", F.lit(0)), folder).collect()
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces) and max(r.offset + r.length for r in pieces) <= 1024
    assert sum(r.start == 0 for r in pieces) == len(single)


def test_stages_of_an_empty_table(spark, folder, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in P.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert P.run(spark, str(tmp_path)).count() == 0
