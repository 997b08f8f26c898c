"""Reports as tables of lines: (section, key, sub, line), where the first three give the order.

A report is made, and can be sorted and written, in parallel; ``text_of`` joins one that is small enough into a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.functions import text as X
from leafgraph.operators import health as H
from leafgraph.operators import index as I
from leafgraph.operators import plan as P

# Names of formats, widths, marks of trees, and hints.
SARIF_SCHEMA, SARIF_VERSION, TOOL = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0", "leafgraph"
DESCRIPTION_CHARS, TREE_DEPTH = 80, 6
LAST, INNER, GAP, BAR = "└── ", "├── ", "    ", "│   "
HINTS = {
    "binary": "no .md files found — an index or a digest will be empty. Let analyze --apply propose dependencies, or write @include directives by hand.",
    "text": "no .md files found in this text-only folder. Write @include or @delegate directives into entry files, or a deps.yml, before an index or a digest.",
    "sparse": "only {}/{} files are .md — the graph may be sparse. analyze --apply also captures dependencies of PDF, DOCX and PPTX files.",
}
FINDINGS = "rule", "severity", "path", "message", "line"


def row(df: DataFrame, section: int, key: Column | None, sub: int, line: Column) -> DataFrame:
    """Lines of a section; a null line is none."""
    return df.select(F.lit(section).alias("section"), (F.lit("") if key is None else key).alias("key"), F.lit(sub).alias("sub"), line.alias("line")).where("line is not null")


def block(df: DataFrame, section: int, lines: list[Column]) -> DataFrame:
    """Several lines of a one-row table."""
    return df.select(F.posexplode(F.filter(F.array(*(x.cast("string") for x in lines)), lambda x: x.isNotNull())).alias("sub", "line")).select(F.lit(section).alias("section"), F.lit("").alias("key"), "sub", "line")


def both(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def text_of(lines: DataFrame) -> DataFrame:
    """One row: the lines in their order."""
    sorted_lines = F.array_sort(F.collect_list(F.struct("section", "key", "sub", "line")))
    return lines.agg(F.array_join(F.transform(sorted_lines, lambda x: x["line"]), "\n").alias("report"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files whose names and lines are in the report's order."""
    lines.orderBy("section", "key", "sub", "line").select("line").write.mode("overwrite").text(path)


def named_counts(rows: DataFrame, by: str, name: str) -> DataFrame:
    """One row: a:1, b:2 over the values of a column, or none."""
    pairs = rows.groupBy(by).agg(F.count("*").alias("n"))
    return pairs.agg(F.count("*").alias("some"), F.array_join(F.array_sort(F.collect_list(F.concat(by, F.lit(":"), F.col("n").cast("string")))), ", ").alias(name)).select(F.when(F.col("some") > 0, F.col(name)).otherwise("none").alias(name))


def map_text(m: str) -> Column:
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ", ")


# findings


def check_lines(findings: DataFrame, n_files: int, n_edges: int) -> DataFrame:
    head = F.concat(F.lit(f"{n_files} files, {n_edges} edges — errors:"), "errors", F.lit(" warnings:"), "warnings")
    line = F.concat(F.lit("  ["), F.upper("severity"), F.lit("] "), "rule", F.lit(": "), F.coalesce(F.nullif("path", F.lit("")), F.lit("-")), F.lit(" — "), "message")
    each = findings.select((F.col("family") + 1).alias("section"), F.concat_ws("\u0000", "path", "message").alias("key"), F.lit(0).alias("sub"), line.alias("line"))
    return both(block(H.severity_counts(findings), 0, [head]), each)


def _sorted(findings: DataFrame, made: Column) -> DataFrame:
    return findings.agg(F.transform(F.array_sort(F.collect_list(F.struct("family", "path", "message", made.alias("made")))), lambda x: x["made"]).alias("made"))


def check_json(findings: DataFrame, root: str, n_files: int, n_edges: int) -> DataFrame:
    stats = F.struct(F.lit(n_files).alias("files"), F.lit(n_edges).alias("edges"), "errors", "warnings")
    made = H.severity_counts(findings).crossJoin(_sorted(findings, F.struct(*FINDINGS)))  # one row on each side
    return made.select(F.to_json(F.struct(F.lit(f"{TOOL}-check/v1").alias("schema"), F.lit(root).alias("root"), stats.alias("stats"), F.col("made").alias("findings")), {"ignoreNullFields": "false"}).alias("report"))


def camel(rule: Column) -> Column:
    return F.array_join(F.transform(F.split(rule, "-"), lambda x, i: F.when(i == 0, x).otherwise(F.initcap(x))), "")


def sarif_lines(findings: DataFrame) -> DataFrame:
    """The SARIF document as lines: what comes before the results (section 0), each result (1), and the end (2).

    A result begins with a comma, but for the first, which is made with what equals it as one line.
    """
    region = F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine")))
    place = F.when(F.col("path") != "", F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))))
    result = F.to_json(F.struct(F.col("rule").alias("ruleId"), F.col("severity").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations")))
    made = findings.select(F.concat_ws("\u0000", F.lpad(F.col("family").cast("string"), 9, "0"), "path", "message").alias("key"), result.alias("line"))
    first = made.agg(F.min(F.struct("key", "line")).alias("first"))
    each = made.crossJoin(F.broadcast(first)).withColumn("is_first", F.struct("key", "line") == F.col("first"))  # one row beside all
    begin = each.where("is_first").groupBy("key", "line").count().select("key", F.array_join(F.array_repeat("line", F.col("count").cast("int")), ",\n").alias("line"))
    rules = findings.agg(F.array_sort(F.collect_set(F.struct(F.col("rule").alias("id"), camel(F.col("rule")).alias("name")))).alias("rules"))
    driver = F.to_json(F.struct(F.struct(F.lit(TOOL).alias("name"), "rules").alias("driver")))
    head = F.concat(F.lit(f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":[{{"tool":'), driver, F.lit(',"results":['))
    return both(block(rules, 0, [head]), row(begin, 1, F.col("key"), 0, F.col("line")), row(each.where("not is_first"), 1, F.col("key"), 1, F.concat(F.lit(","), "line")), block(rules, 2, [F.lit("]}]}")]))


def sarif(findings: DataFrame) -> DataFrame:
    return text_of(sarif_lines(findings))


def exit_code(findings: DataFrame, fail_on: str = "error") -> int:
    n = H.severity_counts(findings).first()
    return int({"never": False, "warning": bool(n["errors"] or n["warnings"])}.get(fail_on, bool(n["errors"])))


# graph and index


def summary_lines(nodes: DataFrame, edges: DataFrame, warnings: DataFrame) -> DataFrame:
    """Counts of nodes and edges by type, placeholders, and the warnings."""
    names = nodes.select(F.explode("placeholders").alias("p")).distinct().agg(F.array_join(F.array_sort(F.collect_list("p")), ", ").alias("names"))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = n(nodes, "n").crossJoin(n(edges, "e")).crossJoin(n(warnings, "w")).crossJoin(named_counts(nodes, "type", "nt")).crossJoin(named_counts(edges, "type", "et")).crossJoin(names)  # one row on each side
    head = block(one, 0, [F.concat(F.lit("Nodes: "), "n", F.lit("  ("), "nt", F.lit(")")), F.concat(F.lit("Edges: "), "e", F.lit("  ("), "et", F.lit(")")), F.concat(F.lit("Warnings: "), "w"), F.when(F.col("names") != "", F.concat(F.lit("Placeholders: "), "names"))])
    return both(head, row(warnings, 1, F.concat_ws("\u0000", "type", "path"), 0, F.concat(F.lit("  ["), F.upper("type"), F.lit("] "), "message")))


def label(path: Column, title: Column, missing: Column) -> Column:
    return F.concat(path, F.when(title != "", F.concat(F.lit(" — "), title)).otherwise(""), F.when(missing, " [MISSING]").otherwise(""))


def health(cycles: str = "cycles", missing: str = "missing") -> Column:
    return F.when((F.col(cycles) == 0) & (F.col(missing) == 0), "OK").otherwise(F.concat(F.lit("cycles:"), cycles, F.lit(" missing:"), missing))


def digest_lines(files: DataFrame, warnings: DataFrame, max_desc: int = DESCRIPTION_CHARS) -> DataFrame:
    """The one-screen summary: statistics, cycles, missing files, a line or more for each file, placeholders."""
    stats = I.stats(files, warnings)
    head = block(stats, 0, [F.concat(F.lit("# index — "), "files", F.lit(" files")), F.when(F.size("edge_types") > 0, F.concat(F.lit("Edges: "), "edges", F.lit(" ("), map_text("edge_types"), F.lit(")"))), F.concat(F.lit("Health: "), health())])
    title = lambda section, name, when: block(stats.where(when), section, [F.lit(""), F.lit(f"## {name}")])
    cycles = warnings.where("type = 'circular'").select("message").distinct()
    short = F.when(F.length("desc") > max_desc, F.concat(F.regexp_replace(F.substring("desc", 1, max_desc - 1), r"(?U)\s+$", ""), F.lit("…"))).otherwise(F.col("desc"))
    flag = F.when(F.col("missing"), " [MISSING]").otherwise("")
    first = F.concat(F.lit("- ["), "type", F.lit("] "), "path", flag, F.when(F.col("title") != "", F.concat(F.lit(" — "), "title")).otherwise(""))
    deps = F.array_join(F.transform("deps", lambda d: F.concat(d["type"], F.lit("→"), d["to"])), ", ")
    names = files.select(F.explode("placeholders").alias("p")).distinct().agg(F.array_join(F.array_sort(F.collect_list("p")), ", ").alias("names")).where("names <> ''")
    path = F.col("path")
    return both(
        head, title(1, "Cycles", "cycles > 0"), row(cycles, 2, F.col("message"), 0, F.concat(F.lit("- "), "message")), title(3, "Missing", "missing > 0"), row(files.where("missing"), 4, path, 0, F.concat(F.lit("- "), "path")), title(5, "Files", "true"),
        row(files, 6, path, 0, first), row(files, 6, path, 1, F.when(F.col("desc") != "", F.concat(F.lit("  "), short))), row(files, 6, path, 2, F.when(F.size("deps") > 0, F.concat(F.lit("  deps: "), deps))),
        block(names, 7, [F.lit(""), F.concat(F.lit("Placeholders: "), "names")]),
    )


def tree_lines(walks: DataFrame, files: DataFrame) -> DataFrame:
    """The walks of ``expand.tree`` drawn as a tree; each line's key is its place."""
    known = files.select(F.col("path").alias("id"), "title", F.col("missing").alias("gone"))
    rows = walks.join(known, "id", "left")
    said = F.when(F.col("gone").isNull(), F.concat("id", F.lit(" [MISSING]"))).otherwise(label(F.col("id"), F.col("title"), F.col("gone")))
    inner = F.array_join(F.transform(F.slice("lasts", 1, F.greatest(F.size("lasts") - 1, F.lit(0))), lambda x: F.when(x, GAP).otherwise(BAR)), "")
    tag = F.concat(F.lit("["), "kind", F.when(F.col("parallel"), "‖").otherwise(""), F.lit("] "))
    drawn = F.concat(inner, F.when(F.element_at("lasts", -1), LAST).otherwise(INNER), tag, said, F.when(F.col("cycle"), "  [cycle]").otherwise(""))
    key = F.concat("root", F.lit("\u0000"), F.array_join(F.transform("places", lambda x: F.lpad(x.cast("string"), 9, "0")), "."))
    return rows.select(F.lit(0).alias("section"), key.alias("key"), F.lit(0).alias("sub"), F.when(F.size("lasts") == 0, said).otherwise(drawn).alias("line"))


def plan_lines(plan: P.Plan) -> DataFrame:
    head = block(P.counts(plan), 0, [F.concat(F.lit("# plan — "), "tasks", F.lit(" tasks, "), "batches", F.lit(" batches"))])
    number = F.lpad(F.col("level").cast("string"), 9, "0")
    level = row(P.batches(plan), 1, number, 0, F.concat(F.lit("Level "), "level", F.when(F.col("parallelizable"), " (parallel)").otherwise(""), F.lit(":")))
    each = row(plan.tasks.where("level is not null"), 1, number, 1, F.concat(F.lit("  - "), "task", F.when(F.col("parallel"), " ‖").otherwise("")))
    title = lambda section, df, name: block(df.agg(F.count("*").alias("n")).where("n > 0"), section, [F.lit(""), F.lit(name)])
    pair = F.concat(F.lit("  - L"), "level", F.lit(": "), "a", F.lit(" & "), "b", F.lit(" share "), F.array_join("shared", ", "))
    said = lambda df, section: row(df, section, F.col("message"), 0, F.concat(F.lit("  - "), "message"))
    return both(head, level, each, title(2, plan.conflicts, "Conflicts (warning — parallel kept):"), row(plan.conflicts, 3, F.concat(number, F.lit(" "), "a", F.lit(" "), "b"), 0, pair), title(4, plan.cycles, "Cycles (error):"), said(plan.cycles, 5), title(6, plan.warnings, "Warnings:"), said(plan.warnings, 7))


def risk_lines(reports: DataFrame) -> DataFrame:
    """One line for each file of ``health.risk_report``."""
    added = F.try_element_at(F.filter("events", lambda e: e["action"] == "add"), F.lit(1))["seq"]
    some = F.concat(F.lit("active risk: "), F.array_join("active_tags", ", "), F.lit(" ("), "level", F.lit(")"), F.coalesce(F.concat(F.lit(" [last add: "), added.cast("string"), F.lit("]")), F.lit("")))
    return row(reports, 0, F.col("file"), 0, F.concat("file", F.lit(" — affects "), "affects_count", F.lit(" files; "), F.when(F.size("active_tags") > 0, some).otherwise("no active risk")))


# inventory and cost


def hint() -> Column:
    """What to do next, of a row of ``health.totals``; null where nothing need be done."""
    files, md, binary = F.col("n_files"), F.col("n_markdown"), F.col("n_binary")
    few = (F.col("markdown_ratio") < 0.1) & (files >= 20) & (binary > 0)
    sparse = F.format_string(HINTS["sparse"].replace("{}", "%d"), md, files)
    return F.when((files == 0) | (F.col("markdown_ratio") >= 0.5), F.lit(None).cast("string")).when((md == 0) & (binary > 0), HINTS["binary"]).when(md == 0, HINTS["text"]).when(few, sparse)


def inventory_lines(files: DataFrame, root: str, k: int = 5) -> DataFrame:
    """Files (path, bytes): totals, all extensions by count, the k largest files, and a hint."""
    one = H.totals(files)
    share = lambda c: F.format_string("%.1f%%", 100 * F.col(c))
    kinds = F.concat(F.lit("markdown: "), "n_markdown", F.lit(" ("), share("markdown_ratio"), F.lit(")  binary: "), "n_binary", F.lit(" ("), share("binary_ratio"), F.lit(")"))
    head = block(one, 0, [F.lit(f"# inventory — {root}"), F.concat("n_files", F.lit(" files, "), X.human_bytes(F.col("n_bytes")), F.lit(" total")), kinds, F.when(F.col("any_cjk"), "locale: Japanese filenames detected")])
    title = lambda section, name: block(one.where("n_files > 0"), section, [F.lit(""), F.lit(f"## {name}")])
    ext = H.by_extension(files)
    rank = F.lpad((F.lit(10**15) - F.col("n_files")).cast("string"), 16, "0")
    each = row(ext, 2, F.concat(rank, "ext"), 0, F.format_string("  %-12s %5d  %s", F.when(F.col("ext") == "", "(none)").otherwise(F.col("ext")), "n_files", X.human_bytes(F.col("n_bytes"))))
    large = H.seen(files).orderBy(F.desc("bytes"), "path").limit(k)
    size = F.lpad((F.lit(10**15) - F.col("bytes")).cast("string"), 16, "0")
    return both(head, title(1, "by extension"), each, title(3, "largest files"), row(large, 4, F.concat(size, "path"), 0, F.format_string("  %8s  %s", X.human_bytes(F.col("bytes")), "path")), block(one.where(hint().isNotNull()), 5, [F.lit(""), F.concat(F.lit("note: "), hint())]))


def cost_lines(estimate: DataFrame) -> DataFrame:
    """A row of ``health.cost_estimate`` for people."""
    usd = lambda c: F.format_string("$%.4f", F.col(c))
    n = lambda c: F.format_number(F.col(c), 0)
    rule = F.lit("=" * 60)
    note = F.when(~F.col("price_known"), F.concat(F.lit("  note:        unknown model '"), "model", F.lit("'; using the fallback price")))
    return block(estimate, 0, [rule, F.lit("Dry-run cost estimate"), rule, F.concat(F.lit("  model:       "), "model"), F.concat(F.lit("  documents:   "), "n_docs"), F.concat(F.lit("  input:       "), n("input_tokens"), F.lit(" tokens  →  "), usd("input_usd")), F.concat(F.lit("  output:      ~"), n("output_tokens"), F.lit(" tokens  →  "), usd("output_usd")), F.concat(F.lit("  total:       "), usd("total_usd")), note])
