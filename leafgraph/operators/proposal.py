"""Proposed dependencies: prompts for them, answers as tables, guards, directives, and how they get into files.

A proposal is (from, to, kind, reason, ord) edges and (name, content_summary, used_by, reason, ord) shared parts.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.functions import text as X
from leafgraph.operators import graph as G
from leafgraph.operators.reports import block, both, row
from leafgraph.sources import extract, tree
from leafgraph.sources.scratch import kept

# The answer's schema, the first lines of a dependency file, and beginnings of directives.
ANSWER = "struct<edges: array<struct<from: string, to: string, kind: string, reason: string>>, shared_proposals: array<struct<name: string, content_summary: string, used_by: array<string>, reason: string>>>"
DEPS_HEAD = ("# dependency manifest — auto-generated, hand-editable", "files:")
DIRECTIVE_LINE = r"^@(include|delegate|ref) "
FILE_LIST = "{{file_list}}"

#: Edges of one proposal that the guard looks at one after the other on the driver; an answer of a model is far smaller.
GUARDED = 100_000


def prompt(summaries: DataFrame, template: str | None = None) -> DataFrame:
    """One row: n, system (the template's first line) and user (the rest) for documents (path, summary) in the order of their paths."""
    template = extract.template("analyze.md") if template is None else template
    first, _, rest = template.partition("\n")
    blocks = F.array_sort(F.collect_list(F.struct("path", X.prompt_block(F.col("path"), F.col("summary")).alias("b"))))
    listed = summaries.agg(F.count("*").alias("n"), F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n").alias("listed"))
    return listed.select("n", F.lit(first.strip()).alias("system"), F.replace(F.lit(rest.strip()), F.lit(FILE_LIST), F.col("listed")).alias("user"))


def parse_answers(answers: DataFrame, text: str = "answer") -> tuple[DataFrame, DataFrame]:
    """Edges and shared parts of answers: a fenced JSON block or the whole text.  What isn't JSON fails."""
    body = X.json_body(F.col(text))
    read = F.from_json(body, ANSWER, {"mode": "PERMISSIVE"})
    wrong = F.assert_true(F.try_parse_json(body).isNotNull(), F.concat(F.lit("not JSON: "), F.substring(body, 1, 80)))
    rows = kept(answers.where(wrong.isNull()).select(read.alias("a")), "answers")
    edges = rows.select(F.posexplode("a.edges").alias("ord", "e")).select("e.from", "e.to", "e.kind", F.coalesce("e.reason", F.lit("")).alias("reason"), "ord")
    shared = rows.select(F.posexplode("a.shared_proposals").alias("ord", "s")).select("s.name", "s.content_summary", F.coalesce("s.used_by", F.array().cast("array<string>")).alias("used_by"), F.coalesce("s.reason", F.lit("")).alias("reason"), "ord")
    return edges, shared


def analyze(docs: DataFrame, caller: Callable[[str, str], str], template: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The proposal that ``caller`` (prompt, system) answers for documents (path, summary).  It runs on the driver, once; without documents not at all."""
    asked = prompt(docs, template).first()
    answer = caller(asked["user"], asked["system"]) if asked["n"] else "{}"
    return parse_answers(docs.sparkSession.createDataFrame([(answer,)], "answer string"))


def host_plan_lines(paths: DataFrame, root: str, template: str | None = None) -> DataFrame:
    """Instructions for somebody else who reads the files (path) and answers."""
    template = extract.template("analyze.md") if template is None else template
    before, _, after = template.strip().partition(FILE_LIST)
    n = paths.agg(F.count("*").alias("n"))
    path = F.col("path")
    said = lambda section, *x: block(n.where("n > 0"), section, [F.lit(line) if isinstance(line, str) else line for line in x])
    return both(
        block(n, 0, [F.lit("# host plan"), F.lit(""), F.lit(f"Target directory: `{root}`"), F.concat(F.lit("Documents discovered: "), "n")]), block(n.where("n = 0"), 1, [F.lit(""), F.lit("No documents found. Nothing to analyze.")]),
        said(2, "", "## Files to analyze", ""), row(paths, 3, path, 0, F.concat(F.lit("- `"), path, F.lit("`"))), said(4, "", "## Analysis task", "", "```", *before.strip().split("\n"), ""),
        row(paths, 5, path, 0, F.concat(F.lit("### "), path)), row(paths, 5, path, 1, F.concat(F.lit(f"(read this file from `{root}/"), path, F.lit("`)"))), said(6, *after.rstrip().split("\n"), "```", "", "## Apply the result", "", f'Save the JSON as analysis.json and run: python -m leafgraph analyze "{root}" --apply-from analysis.json'),
    )


def guarded(edges: DataFrame, existing: DataFrame, sizes: DataFrame | None = None, max_include_bytes: int | None = None) -> DataFrame:
    """The proposed edges with their kinds settled: include or ref.

    Unknown kinds are include.  With ``max_include_bytes``, targets of more bytes (``sizes``: path, bytes) become ref.  Then the
    includes are taken in order of (from, to), each against the existing include edges (src, dst) and those taken before: one
    that would close a cycle becomes ref.  What the endpoints reach among each other is a distributed closure; only the
    proposal itself, at most ``GUARDED`` edges, is looked at one by one.
    """
    edges = edges.withColumn("kind", F.when(F.col("kind").isin("include", "ref"), F.col("kind")).otherwise("include"))
    if max_include_bytes is not None:
        large = sizes.where(F.col("bytes") > max_include_bytes).select(F.col("path").alias("to"), F.lit(True).alias("large"))
        edges = edges.join(large, "to", "left").withColumn("kind", F.when(F.col("large"), "ref").otherwise(F.col("kind"))).drop("large")
    edges = kept(edges.select("from", "to", "kind", "reason", "ord"), "proposed")
    asked = edges.where("kind = 'include'").select("from", "to", "ord").orderBy("from", "to", "ord").limit(GUARDED + 1).collect()
    if len(asked) > GUARDED:
        raise ValueError(f"a proposal of more than {GUARDED} includes; guard it in parts")
    ends = edges.where("kind = 'include'").select(F.explode(F.array("from", "to")).alias("id")).distinct()
    reach = G.closure(existing.select("src", "dst"), ends).join(ends, "id", "left_semi").select("start", "id")
    after: dict[str, set[str]] = {}
    for r in reach.collect():  # pairs of the proposal's endpoints
        after.setdefault(r["start"], set()).add(r["id"])

    def leads(a: str, b: str) -> bool:
        seen, left = {a}, [a]
        while left:
            if (x := left.pop()) == b:
                return True
            fresh = after.get(x, set()) - seen
            seen |= fresh
            left += fresh
        return False

    closing = []
    for r in asked:
        if leads(r["to"], r["from"]):
            closing.append((r["from"], r["to"], r["ord"]))
        else:
            after.setdefault(r["from"], set()).add(r["to"])
    shut = edges.sparkSession.createDataFrame(closing, "from string, to string, ord int").withColumn("shut", F.lit(True))
    return edges.join(shut, ["from", "to", "ord"], "left").select("from", "to", F.when(F.col("shut"), "ref").otherwise(F.col("kind")).alias("kind"), "reason", "ord")


def directives(edges: DataFrame, shared: DataFrame) -> DataFrame:
    """(path, line, ord): the directive lines of each file, each once, of edges first and then of shared parts, in their order."""
    own = edges.select(F.col("from").alias("path"), F.concat(F.when(F.col("kind") == "ref", "@ref ").otherwise("@include "), "to").alias("line"), F.col("ord").cast("long").alias("ord"))
    parts = shared.where("name <> ''").select(F.posexplode("used_by").alias("i", "path"), "name", "ord")
    parts = parts.select("path", F.concat(F.lit("@include "), "name").alias("line"), ((F.col("ord") + 1) * F.lit(1 << 31).cast("long") + F.col("i")).alias("ord"))
    return own.unionByName(parts).groupBy("path", "line").agg(F.min("ord").alias("ord"))


def new_directives(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """The lines that their document (path, content) doesn't have yet."""
    has = F.filter(F.transform(F.split("content", X.LINE_BREAK, -1), X.strip), lambda x: x.rlike(DIRECTIVE_LINE))
    return lines.join(docs.select("path", F.explode(has).alias("line")).distinct(), ["path", "line"], "left_anti")


def injected(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, content) of the documents that get new lines: they come first, then a blank line.  Only kinds that may be edited, and only files that are there."""
    fresh = new_directives(lines.where(X.is_editable(F.col("path"))), docs).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("head"))
    return docs.where("content is not null").join(fresh, "path").select("path", F.concat("head", F.lit("\n\n"), "content").alias("content"))


def merged_declarations(existing: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, includes) of a dependency file (path, includes) and the lines of files that can't be edited: old ones first, each once."""
    target = F.regexp_replace("line", DIRECTIVE_LINE, "")
    more = lines.where(~X.is_editable(F.col("path"))).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", target.alias("t")))), lambda x: x["t"]).alias("more"))
    none = F.array().cast("array<string>")
    return existing.select("path", "includes").join(more, "path", "full").select("path", F.array_distinct(F.concat(F.coalesce("includes", none), F.coalesce("more", none))).alias("includes"))


def declaration_lines(declared: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """The lines of a dependency file, its paths in order; the reasons of the proposal's edges become comments."""
    spark = declared.sparkSession
    head = spark.createDataFrame([(0, "", i, x) for i, x in enumerate(DEPS_HEAD)], "section int, key string, sub int, line string")
    path = F.col("path")
    each = declared.select("path", F.posexplode("includes").alias("i", "to"))
    if edges is None:
        each = each.withColumn("reason", F.lit(""))
    else:
        each = each.join(edges.groupBy(F.col("from").alias("path"), "to").agg(F.max_by("reason", "ord").alias("reason")), ["path", "to"], "left")
    said = F.concat(F.lit('      - "'), "to", F.lit('"'), F.when(F.col("reason") != "", F.concat(F.lit("  # "), "reason")).otherwise(""))
    items = each.select(F.lit(1).alias("section"), path.alias("key"), (F.col("i") + 2).alias("sub"), said.alias("line"))
    return both(head, row(declared, 1, path, 0, F.concat(F.lit('  - path: "'), path, F.lit('"'))), row(declared, 1, path, 1, F.when(F.size("includes") > 0, "    includes:").otherwise("    includes: []")), items)


def proposal_lines(edges: DataFrame, shared: DataFrame, n_documents: int) -> DataFrame:
    """The proposal for people."""
    rule = "=" * 60
    head = edges.sparkSession.createDataFrame([(0, "", i, x) for i, x in enumerate((rule, "Dependency analysis", rule, f"Files analyzed: {n_documents}", ""))], "section int, key string, sub int, line string")
    title = lambda section, df, name: block(df.agg(F.count("*").alias("n")).where("n > 0"), section, [F.lit(f"--- {name} ---")])
    order = F.lpad(F.col("ord").cast("string"), 9, "0")
    kind = F.coalesce("kind", F.lit("include"))
    many = lambda df, section, *lines: [row(df, section, order, i, x) for i, x in enumerate(lines)]
    own = many(edges, 2, F.concat(F.lit("  "), "from"), F.concat(F.lit("    └── depends on: "), "to", F.lit("  ["), kind, F.lit("]")), F.concat(F.lit("        reason: "), "reason"))
    parts = many(shared, 4, F.concat(F.lit("  "), F.coalesce("name", F.lit("(unnamed)"))), F.concat(F.lit("    content: "), F.coalesce("content_summary", F.lit(""))), F.concat(F.lit("    used by: "), F.array_join("used_by", ", ")), F.concat(F.lit("    reason: "), "reason"))
    lines = kept(directives(edges, shared), "directives")
    texts, others = (lines.where(c) for c in (X.is_editable(F.col("path")), ~X.is_editable(F.col("path"))))

    def listed(df: DataFrame, section: int, mark: str, said: Column) -> list[DataFrame]:
        place = F.concat("path", F.lit("\u0000"), F.lpad("ord", 19, "0"))
        return [row(df.select("path").distinct(), section, F.col("path"), 0, F.concat(F.lit("  "), "path", F.lit(":"))), row(df.withColumn("ord", F.col("ord").cast("string")), section, place, 1, F.concat(F.lit(f"    {mark} "), said))]

    none = block(edges.agg(F.count("*").alias("n")).crossJoin(shared.agg(F.count("*").alias("m"))).where("n + m = 0"), 9, [F.lit("No dependencies detected.")])  # one row on each side
    return both(head, title(1, edges, "Detected dependencies"), *own, title(3, shared, "Shared part proposals"), *parts, title(5, texts, "directives to insert"), *listed(texts, 6, "+", F.col("line")), title(7, others, "deps.yml entries to write"), *listed(others, 8, "→", F.regexp_replace("line", DIRECTIVE_LINE, "")), none)


def apply(spark: SparkSession, root: str, edges: DataFrame, shared: DataFrame, max_include_bytes: int | None = None) -> tuple[list[str], str | None]:
    """Writes a proposal into a folder that the driver can write: directives into texts, a dependency file for others.  The files that changed."""
    from leafgraph.operators import index as I
    from leafgraph.operators.reports import text_of

    rows = kept(tree.files(spark, root), "tree")
    existing = I.edges_of(I.build(rows)[0]).where("type = 'include'")
    settled = kept(guarded(edges, existing, rows.select("path", "bytes"), max_include_bytes), "settled")
    lines = kept(directives(settled, shared), "directives")
    changed = []
    for r in kept(injected(rows.select("path", "content"), lines), "injected").toLocalIterator():
        with open(os.path.join(root, r["path"]), "w", encoding="utf-8") as f:
            f.write(r["content"])
        changed.append(r["path"])
    if lines.where(~X.is_editable(F.col("path"))).isEmpty():
        return sorted(changed), None
    declared = tree.declared(rows.where(F.col("path") == tree.DEPENDENCY_FILE).select("path", "content")).select("path", "includes")
    report = text_of(declaration_lines(merged_declarations(declared, lines), settled)).first()[0]
    target = os.path.join(root, tree.DEPENDENCY_FILE)
    with open(target, "w", encoding="utf-8") as f:
        f.write(report + "\n")
    return sorted(changed), target
