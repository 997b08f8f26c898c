"""The single-file overview of a folder: Markdown sections as tables of lines, front matter, a hash that tells whether anything changed, and its writer."""

from __future__ import annotations

import datetime
import os
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.functions import text as X
from leafgraph.operators import expand as E
from leafgraph.operators import health as H
from leafgraph.operators import index as I
from leafgraph.operators.reports import BAR, GAP, INNER, LAST, block, both, map_text, row, text_of, tree_lines
from leafgraph.sources import history, records
from leafgraph.sources.scratch import kept

# Schema, limits and the name of who made it.
SCHEMA, MADE_BY, VERSION = "leafgraph-index/v1", "leafgraph", "0.2.0"
MAX_FILES, MAP_DEPTH, TOP = 200, 3, 5


class Section(NamedTuple):
    id: str
    anchor: str
    lines: DataFrame


def summary_lines(files: DataFrame, index: DataFrame, warnings: DataFrame) -> DataFrame:
    """Files (path, bytes) of the folder and the index over it in a few lines."""
    top = H.top_extensions(files, TOP).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n_files")).alias("n"), "ext"))), lambda x: F.concat(F.when(x["ext"] == "", "(none)").otherwise(x["ext"]), F.lit(" ("), (-x["n"]).cast("string"), F.lit(")"))), ", ").alias("top"))
    one = H.totals(files).crossJoin(I.stats(index, warnings)).crossJoin(top)  # one row on each side
    edges = F.when(F.size("edge_types") > 0, F.concat(F.lit("- Edges: "), "edges", F.lit("  ("), map_text("edge_types"), F.lit(")")))
    return block(one, 0, [F.lit("## Summary"), F.lit(""), F.concat(F.lit("- Files: "), "n_files", F.lit("  (markdown: "), "n_markdown", F.lit(", binary: "), "n_binary", F.lit(")")), F.concat(F.lit("- Total size: "), X.human_bytes(F.col("n_bytes"), " ")), F.concat(F.lit("- Health: cycles="), "cycles", F.lit(", missing="), "missing"), edges, F.when(F.col("top") != "", F.concat(F.lit("- Top extensions: "), "top"))])


def folder_map_lines(files: DataFrame, name: str, max_depth: int = MAP_DEPTH) -> DataFrame:
    """The folder as a tree to a depth: folders first, then names without regard to case; the last of each folder is found by a maximum, not by a window."""
    listed = H.seen(files).where(X.base_name(F.col("path")) != H.ARTIFACT).select(F.split("path", "/").alias("p"))
    at = listed.select("p", F.explode(F.sequence(F.lit(1), F.least(F.size("p"), F.lit(max_depth)))).alias("d"))
    nodes = at.select(F.slice("p", 1, F.col("d")).alias("way"), (F.col("d") < F.size("p")).alias("folder")).groupBy("way").agg(F.bool_or("folder").alias("folder"))
    nodes = nodes.withColumns({"name": F.element_at("way", -1), "parent": F.slice("way", 1, F.size("way") - 1), "depth": F.size("way")})
    nodes = nodes.withColumn("mark", F.concat(F.when(F.col("folder"), "0").otherwise("1"), F.lower("name"), F.lit("\u0000"), "name"))
    nodes = kept(nodes.join(nodes.groupBy("parent").agg(F.max("mark").alias("end")), "parent").select("way", "name", "folder", "depth", "parent", "mark", (F.col("mark") == F.col("end")).alias("last")), "map")
    level = nodes.where("depth = 1").select("way", "name", "folder", "last", F.lit("").alias("prefix"), F.col("mark").alias("key"))
    out = [level]
    for depth in range(2, max_depth + 1):
        up = level.where("folder").select(F.col("way").alias("parent"), F.concat("prefix", F.when(F.col("last"), GAP).otherwise(BAR)).alias("prefix"), F.col("key").alias("above"))
        level = nodes.where(F.col("depth") == depth).join(up, "parent").select("way", "name", "folder", "last", "prefix", F.concat("above", F.lit("\u0001"), "mark").alias("key"))
        out.append(level)
    drawn = F.concat("prefix", F.when(F.col("last"), LAST).otherwise(INNER), "name", F.when(F.col("folder"), "/").otherwise(""))
    one = files.agg(F.count("*").alias("n"))
    return both(block(one, 0, [F.lit("## Folder Map"), F.lit(""), F.lit("```"), F.lit(f"{name}/")]), *(row(x, 1, F.col("key"), 0, drawn) for x in out), block(one, 2, [F.lit("```")]))


def listing(files: DataFrame, index: DataFrame, max_files: int = MAX_FILES, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The files that are listed, with rank, and one row (n_markdown, n_other, omitted).

    Markdown comes first and uses up the limit first.  The order is that of path components, or with ``counts`` (path, commits)
    rarely changed files first.
    """
    rows = H.seen(files).where(X.base_name(F.col("path")) != H.ARTIFACT)
    rows = rows.withColumns({"ext": X.suffix(F.col("path"))}).withColumn("kind", X.kind_of(F.col("ext")))
    place = F.split("path", "/")
    if counts is not None:
        rows, place = history.with_counts(rows, counts), F.array(F.lpad(F.col("commits").cast("string"), 19, "0"), F.col("path"))
    rows = rows.withColumns({"place": place, "other": F.col("kind") != "markdown"})
    n = rows.agg(F.count_if(~F.col("other")).alias("n_markdown"), F.count_if("other").alias("n_other")).withColumn("omitted", F.greatest(F.lit(0), F.col("n_markdown") + F.col("n_other") - max_files))
    first = rows.orderBy("other", "place").limit(max_files)
    return first.join(index.drop("size", "placeholders", "hash", "missing"), "path", "left"), n


def file_lines(files: DataFrame, index: DataFrame, max_files: int = MAX_FILES, counts: DataFrame | None = None) -> DataFrame:
    first, n = listing(files, index, max_files, counts)
    key = F.array_join("place", "\u0001")
    md, other = first.where("not other"), first.where("other")
    header = F.concat(F.lit("- ["), F.coalesce("type", F.lit("markdown")), F.lit("] "), "path", F.when(F.col("title") != "", F.concat(F.lit(" — "), "title")).otherwise(""))
    deps = F.array_join(F.transform("deps", lambda d: F.concat(d["type"], F.lit("→"), d["to"], F.when(d["parallel"], " (parallel)").otherwise(""))), ", ")
    title = lambda section, c, name: block(n.where(f"{c} > 0"), section, [F.concat(F.lit(f"### {name} ("), c, F.lit(")")), F.lit("")])
    end = lambda section, c: block(n.where(f"{c} > 0"), section, [F.lit("")])
    rest = F.concat(F.lit("_…"), "omitted", F.lit(f" files omitted (max_files={max_files}). See front matter `stats.files` for the true total._"))
    return both(
        block(n, 0, [F.lit("## Files"), F.lit("")]), title(1, "n_markdown", "Markdown"), row(md, 2, key, 0, header), row(md, 2, key, 1, F.when(F.col("desc") != "", F.concat(F.lit("  "), "desc"))), row(md, 2, key, 2, F.when(F.size("deps") > 0, F.concat(F.lit("  deps: "), deps))), end(3, "n_markdown"),
        title(4, "n_other", "Other"), row(other, 5, key, 0, F.concat(F.lit("- ["), "kind", F.lit("] "), "path", F.lit(" — "), X.human_bytes(F.col("bytes"), " "))), end(6, "n_other"), block(n.where("omitted > 0"), 7, [rest]),
    )


def dependency_lines(index: DataFrame, max_depth: int = 6) -> DataFrame:
    """The tree from the first skill, or else the first file."""
    root = index.select(F.col("path").alias("id"), (F.col("type") != "skill").alias("rank")).orderBy("rank", "id").limit(1).select("id")
    edges = kept(I.edges_of(index), "tree-edges")
    drawn = tree_lines(E.tree(edges, root, max_depth), index).withColumn("section", F.lit(1))
    some = edges.agg(F.count("*").alias("n")).where("n > 0")
    return both(block(some, 0, [F.lit("## Dependency Tree"), F.lit(""), F.lit("```")]), drawn.join(F.broadcast(some.select(F.lit(1).alias("section"))), "section"), block(some, 2, [F.lit("```")])).select("section", "key", "sub", "line")


def child_artifacts(rows: DataFrame) -> DataFrame:
    """(path, content_hash, generated_at, files, edges, cycles, missing, root) of the overviews below a tree's root that this engine made."""
    mine = rows.where((X.base_name(F.col("path")) == H.ARTIFACT) & (F.col("path") != H.ARTIFACT) & ~X.is_hidden(F.col("path")))
    front = records.front_matter(mine.select("path", "content"))
    get = lambda name, kind: F.try_variant_get("front", f"$.{name}", kind)
    text = lambda name: F.coalesce(get(name, "string"), F.lit("")).alias(name)
    count = lambda name: F.coalesce(get(f"stats.{name}", "long"), F.lit(0).cast("long")).alias(name)
    return front.where(get("generated_by", "string") == MADE_BY).select("path", text("content_hash"), text("generated_at"), *map(count, ("files", "edges", "cycles", "missing")), text("root"))


def child_lines(children: DataFrame) -> DataFrame:
    some = children.agg(F.count("*").alias("n")).where("n > 0")
    health = F.when((F.col("cycles") == 0) & (F.col("missing") == 0), "OK").otherwise(F.concat(F.lit("cycles:"), "cycles", F.lit(" missing:"), "missing"))
    line = F.concat(F.lit("- `"), "path", F.lit("` — "), "files", F.lit(" files, "), "edges", F.lit(" edges, "), health, F.when(F.col("generated_at") != "", F.concat(F.lit("  _(generated "), "generated_at", F.lit(")_"))).otherwise(""))
    return both(block(some, 0, [F.lit("## Sub-Indexes"), F.lit(""), F.lit(f"Overviews (`{H.ARTIFACT}`) of folders below this one. Read the one that matters for its files; this section only sums them up."), F.lit("")]), row(children, 1, F.col("path"), 0, line))


def placeholder_names(index: DataFrame) -> DataFrame:
    return index.select(F.explode("placeholders").alias("name")).distinct()


def placeholder_lines(index: DataFrame) -> DataFrame:
    names = placeholder_names(index)
    some = names.agg(F.count("*").alias("n")).where("n > 0")
    return both(block(some, 0, [F.lit("## Placeholders"), F.lit(""), F.lit("Unresolved `{{...}}` variables across the folder:"), F.lit("")]), row(names, 1, F.col("name"), 0, F.concat(F.lit("- `{{"), "name", F.lit("}}`"))))


def content_hash(files: DataFrame, index: DataFrame, order: str = "alpha") -> str:
    """Tells whether any file, or the order, has changed; times and the folder's own place don't matter."""
    rows = files.select("path", "bytes").join(index.select("path", "hash"), "path", "left")
    return H.fold_hash(rows, order).first()[0]


def approx_tokens(text: str) -> int:
    return max(1, len(text) // H.CHARS_PER_TOKEN)


def generate(rows: DataFrame, root: str, index: tuple[DataFrame, DataFrame] | None = None, max_files: int = MAX_FILES, folder_map: bool = True, map_depth: int = MAP_DEPTH, deps: bool = True, aggregate: bool = False, backend: str = "none", extra: dict | None = None, counts: DataFrame | None = None, generated_at: str | None = None) -> str:
    """The document for a tree's rows (path, bytes, content, valid).  With ``counts`` (path, commits) rarely changed files come first."""
    files = kept(rows.select("path", "bytes"), "files")
    index, warnings = index or I.build(rows, root)
    index, warnings = kept(index, "index"), kept(warnings, "warnings")
    order = "alpha" if counts is None else "cache"
    sections = [Section("summary", "#summary", summary_lines(files, index, warnings))]
    if folder_map:
        sections.append(Section("folder-map", "#folder-map", folder_map_lines(files, os.path.basename(os.path.abspath(root)), map_depth)))
    sections.append(Section("files", "#files", file_lines(files, index, max_files, counts)))
    if deps:
        sections.append(Section("deps", "#dependency-tree", dependency_lines(index)))
    children = child_artifacts(rows).orderBy("path").collect() if aggregate else []  # one row for each folder with an overview
    if children:
        sections.append(Section("sub-indexes", "#sub-indexes", child_lines(child_artifacts(rows))))
    sections.append(Section("placeholders", "#placeholders", placeholder_lines(index)))
    body, chunks = ["# Folder Index", "", f"_Made by {MADE_BY}. Read this file first to learn what is in this folder without reading every file._"], []
    for s in sections:
        text = text_of(s.lines).first()[0]
        if text:
            body += ["", f"<!-- chunk:{s.id} -->", text]
            chunks.append({"id": s.id, "anchor": s.anchor, "tokens_est": approx_tokens(text)})
    t, n = H.totals(files).first(), I.stats(index, warnings).first()
    now = generated_at or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    front = {"schema": SCHEMA, "generator_version": VERSION, "generated_by": MADE_BY, "generated_at": now, "root": root, "content_hash": content_hash(files, index, order), "analysis_backend": backend}
    front["stats"] = {"files": t["n_files"], "markdown": t["n_markdown"], "binary": t["n_binary"], "total_bytes": t["n_bytes"], "edges": n["edges"], "cycles": n["cycles"], "missing": n["missing"]}
    front["chunks"] = chunks
    if names := sorted(r["name"] for r in placeholder_names(index).collect()):
        front["placeholders"] = names
    if aggregate:
        front["aggregates"] = [r.asDict() for r in children]
    front |= extra or {}
    return f"---\n{records.dump_front_matter(front)}\n---\n\n" + "\n".join(body).rstrip() + "\n"


def write(folder: str, text: str, force: bool = False, filename: str = H.ARTIFACT) -> tuple[str, bool]:
    """The file's path, and whether it was written: not if its hash is the same.  A file of somebody else's is only replaced with ``force``."""
    path = os.path.join(folder, filename)
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            old = records.front_matter_of(f.read())
        if old.get("generated_by") != MADE_BY and not force:
            raise ValueError(f"{path} was not made by {MADE_BY}; it is left as it is unless forced")
        fresh = records.front_matter_of(text).get("content_hash")
        if old.get("generated_by") == MADE_BY and fresh and old.get("content_hash") == fresh:
            return path, False
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path, True


def push(path: str, client, base_url: str = "http://localhost:3000") -> dict:
    """What a client, called with the url and the file's path, says of a file that it has taken in: for ``extra`` of ``generate``."""
    if not os.path.exists(path):
        raise ValueError(f"file not found: {path}")
    said = client(base_url, path)
    get = lambda name, default: (said.get(name) if isinstance(said, dict) else getattr(said, name, None)) or default
    texts = {name: get(name, "") for name in ("task_id", "status", "filename")}
    numbers = {name: int(get(name, 0)) for name in ("total_files", "successful_files", "failed_files")}
    return texts | numbers | {"pushed_at": datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "base_url": base_url}

