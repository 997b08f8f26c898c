"""Ledger, saved index and front matter: readers of the engine's own records, and their writers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leafgraph.operators.health import RISK_TAGS

LEDGER = "ts string, file string, action string, tag string, note string"


def ledger_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value, e, malformed) of the lines that aren't blank; ``seq`` follows the order of a file and is unique in it."""
    place = F.col("_metadata.file_block_start").cast("decimal(20,0)") * F.lit(1 << 34).cast("decimal(11,0)")
    rows = spark.read.text(path).select((place + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("seq"), F.trim("value").alias("value")).where("value <> ''")
    rows = rows.withColumn("e", F.from_json("value", LEDGER + ", bad string", {"columnNameOfCorruptRecord": "bad"}))
    return rows.withColumn("malformed", F.col("e.bad").isNotNull() | F.col("e").isNull())


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(seq, ts, file, action, tag, note) of the lines that are records."""
    return ledger_lines(spark, path).where("not malformed").select("seq", "e.ts", "e.file", "e.action", "e.tag", "e.note")


def append_events(events: DataFrame, path: str) -> None:
    """Appends rows (ts, file, action, tag, note); one with an unknown action or tag fails the write."""
    known = F.col("tag").isin(*RISK_TAGS)
    ok = ((F.col("action") == "add") & known) | ((F.col("action") == "clear") & (known | (F.col("tag") == "all")))
    checked = F.when(F.coalesce(ok, F.lit(False)), F.col("action")).otherwise(F.raise_error(F.concat(F.lit("unknown action or tag: "), F.coalesce("action", F.lit("null")), F.lit(" "), F.coalesce("tag", F.lit("null")))))
    ts = F.coalesce("ts", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    events.select(ts.alias("ts"), "file", checked.alias("action"), "tag", F.nullif("note", F.lit("")).alias("note")).write.mode("append").option("ignoreNullFields", "true").json(path)


def save_tables(path: str, **tables: DataFrame) -> None:
    """Tables as Parquet below ``path``: what an index is kept as where one JSON document would be too large."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, *names: str) -> tuple[DataFrame, ...]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in names)


def _scalar(text: str):
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    named = {"true": True, "True": True, "false": False, "False": False, "null": None, "~": None, "{}": {}, "[]": []}
    if text in named:
        return named[text]
    digits = text.removeprefix("-")
    return int(text) if digits.isascii() and digits.isdigit() else text


def front_matter_of(text: str | None) -> dict:
    """Scalars, nested mappings and lists of scalars or flat mappings between the first line ``---`` and the next; else empty.

    A key without a value is null unless deeper lines follow; lines below make it a mapping or a list.
    """
    if not text or not text.startswith("---\n") or (end := text.find("\n---", 4)) < 0:
        return {}
    out: dict = {}
    stack: list = [(-1, out)]  # indent and container; a tuple (mapping, key) stands for a value not known yet
    for raw in text[4:end].splitlines():
        line = raw.strip()
        if not line or line[0] == "#":
            continue
        indent = len(raw) - len(raw.lstrip())
        while len(stack) > 1 and indent <= stack[-1][0]:
            stack.pop()
        at, box = stack[-1]
        if isinstance(box, tuple):  # the first line below a key says what its value is
            box[0][box[1]] = made = [] if line.startswith("- ") else {}
            stack[-1] = (at, made)
            box = made
        item = line.startswith("- ")
        if isinstance(box, list) != item:
            continue
        name, colon, value = (line[2:] if item else line).partition(":")
        name, value = name.strip(), value.strip()
        if item and not colon:
            box.append(_scalar(line[2:].strip()))
        elif item:
            box.append({name: _scalar(value) if value else ""})
            stack.append((indent, box[-1]))
        elif colon and value:
            box[name] = _scalar(value)
        elif colon:
            box[name] = None
            stack.append((indent, (box, name)))
    return out


def _plain(value) -> str:
    """A scalar as it can be read back."""
    if value is None or isinstance(value, bool | int):
        return json.dumps(value)
    text = str(value)
    if not text:
        return '""'
    if any(c in text for c in ":#{}[],&*?|<>!%@"):
        return '"' + text.replace('"', '\\"') + '"'
    return text if text == text.strip() else f'"{text}"'


def dump_front_matter(data: dict, indent: int = 0) -> str:
    """The lines of nested mappings, and of lists of scalars or flat mappings."""
    pad, lines = "  " * indent, []
    for key, value in data.items():
        if not isinstance(value, dict | list):
            lines.append(f"{pad}{key}: {_plain(value)}")
        elif not value:
            lines.append(f"{pad}{key}: {'{}' if isinstance(value, dict) else '[]'}")
        elif isinstance(value, dict):
            lines += [f"{pad}{key}:", dump_front_matter(value, indent + 1)]
        else:
            lines.append(f"{pad}{key}:")
            for item in value:
                fields = [f"{k}: {_plain(v)}" for k, v in item.items()] or ["{}"] if isinstance(item, dict) else [_plain(item)]
                lines += [f"{pad}  {'- ' if i == 0 else '  '}{f}" for i, f in enumerate(fields)]
    return "\n".join(lines)


@F.pandas_udf(StringType())
def _front_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: json.dumps(front_matter_of(t), ensure_ascii=False))


def front_matter(rows: DataFrame, text: str = "content") -> DataFrame:
    """The rows with ``front``, a VARIANT."""
    return rows.withColumn("front", F.parse_json(_front_json(F.col(text))))
