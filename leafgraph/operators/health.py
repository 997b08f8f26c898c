"""Checks, inventory, risk ledger, index maintenance and cost: aggregates over the tables of the engine."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.functions import text as X
from leafgraph.operators import graph as G
from leafgraph.sources.scratch import kept
from leafgraph.sources.tree import OVERVIEW as ARTIFACT
from leafgraph.sources.tree import ordered

# Risk tags, explicit directive types, rule names and messages, estimator constants.
RISK_TAGS = ("fix-failed", "fragile", "security-sensitive", "deprecated")
HIGH_TAGS = ("fix-failed", "security-sensitive")
EXPLICIT_TYPES = ("include", "ref", "delegate")
GRAPH_RULES = {"depth_exceeded": "depth-exceeded", "read_error": "read-error"}
MISSING_SAID, ORPHAN_SAID = "referenced file does not exist", "file is not referenced by any node"
SUMMARY_CHARS, PROMPT_TOKENS, FRAMING_CHARS, CHARS_PER_TOKEN = 500, 800, 30, 4
OUTPUT_TOKENS, INPUT_PRICE, OUTPUT_PRICE = 4096, 3.0, 15.0
HASH_PREFIX, HASH_CHARS = "sha256:", 32


def finding(rule: Column | str, severity: str, path: Column, message: Column) -> list[Column]:
    """rule, severity, path, message and line, which only a rule on lines has."""
    return [(F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), F.lit(severity).alias("severity"), path.alias("path"), message.alias("message"), F.lit(None).cast("int").alias("line")]


def circular_findings(warnings: DataFrame) -> DataFrame:
    """One finding for each way round, without a path."""
    return warnings.where("type = 'circular'").select("message").distinct().select(*finding("circular", "error", F.lit(""), F.col("message")))


def graph_findings(warnings: DataFrame) -> DataFrame:
    """The graph's warnings of depth and of files that can't be read."""
    rule = reduce(lambda a, x: a.when(F.col("type") == x[0], x[1]), GRAPH_RULES.items(), F.when(F.lit(False), ""))
    return warnings.where(rule.isNotNull()).select(*finding(rule, "error", F.col("path"), F.col("message")))


def conflicting_directives(edges: DataFrame) -> DataFrame:
    """One finding for each source and target that two or more explicit types join."""
    types = edges.where(F.col("type").isin(*EXPLICIT_TYPES)).groupBy("src", "dst").agg(F.array_sort(F.collect_set("type")).alias("types")).where("size(types) >= 2")
    return types.select(*finding("conflicting-directive", "warning", F.col("src"), F.concat("dst", F.lit(" is referenced by multiple directive types ("), F.array_join("types", ", "), F.lit(")"))))


def placeholder_findings(names: DataFrame) -> DataFrame:
    """Of (path, placeholders): one finding for each file and name."""
    names = names.select("path", F.explode(F.array_distinct("placeholders")).alias("name"))
    return names.select(*finding("unresolved-placeholder", "warning", F.col("path"), F.concat(F.lit("unresolved placeholder: {{"), "name", F.lit("}}"))))


def unresolved_placeholders(docs: DataFrame) -> DataFrame:
    return placeholder_findings(docs.select("path", X.placeholders(F.col("content")).alias("placeholders")))


def missing_findings(nodes: DataFrame) -> DataFrame:
    return nodes.where("missing").select(*finding("missing-reference", "error", F.col("id"), F.lit(MISSING_SAID)))


def missing_references(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """The same for edges of all documents, without an entry."""
    return missing_findings(G.missing_targets(docs, edges).select(F.col("path").alias("id"), F.lit(True).alias("missing")))


def orphans(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Markdown files that the graph doesn't know, hidden folders and ``node_modules`` aside."""
    files = docs.select("path").where(F.endswith("path", F.lit(".md")) & ~X.is_hidden(F.col("path")) & ~F.contains("path", F.lit("node_modules")))
    gone = files.join(nodes.select(F.col("id").alias("path")), "path", "left_anti")
    return gone.select(*finding("orphan-file", "warning", F.col("path"), F.lit(ORPHAN_SAID)))


def run_checks(nodes: DataFrame, edges: DataFrame, warnings: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """All findings with ``family``, the place of their rule's family in reports; ``docs`` (path) asks for orphans as well."""
    named = nodes.select(F.col("id").alias("path"), "placeholders")
    found = [circular_findings(warnings), missing_findings(nodes), graph_findings(warnings), placeholder_findings(named), conflicting_directives(edges)]
    if docs is not None:
        found.append(orphans(docs, nodes))
    return reduce(DataFrame.unionByName, (f.withColumn("family", F.lit(i)) for i, f in enumerate(found)))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def seen(files: DataFrame) -> DataFrame:
    """The files (path, bytes) that are neither hidden nor locks."""
    return files.where(~X.is_hidden(F.col("path")) & ~X.is_office_lock(F.col("path")))


def by_extension(files: DataFrame) -> DataFrame:
    """Count and bytes by extension of the files that an inventory sees."""
    return seen(files).groupBy(X.suffix(F.col("path")).alias("ext")).agg(F.count("*").alias("n_files"), F.sum("bytes").alias("n_bytes"))


def totals(files: DataFrame) -> DataFrame:
    """One row: files and bytes, Markdown and binary files with their ratios (0 where there are no files), and whether any name is CJK."""
    ext = X.suffix(F.col("path"))
    out = seen(files).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("n_bytes"), F.count_if(ext.isin(*X.MARKDOWN)).alias("n_markdown"), F.count_if(ext.isin(*X.BINARY)).alias("n_binary"), F.coalesce(F.bool_or(X.has_cjk_name(F.col("path"))), F.lit(False)).alias("any_cjk"))
    share = lambda c: F.when(F.col("n_files") > 0, F.col(c) / F.col("n_files")).otherwise(0.0)
    return out.withColumns({"markdown_ratio": share("n_markdown"), "binary_ratio": share("n_binary")})


def top_extensions(files: DataFrame, k: int = 5) -> DataFrame:
    return by_extension(files).orderBy(F.desc("n_files"), "ext").limit(k)


def active_tags(events: DataFrame) -> DataFrame:
    """(file, tag) active after the replay in order of ``seq``: the last addition comes after the last clearing of the tag or of all."""
    ok = events.where(((F.col("action") == "add") & F.col("tag").isin(*RISK_TAGS)) | (F.col("action") == "clear"))
    cleared = ok.where("action = 'clear' and tag = 'all'").groupBy("file").agg(F.max("seq").alias("all_seq"))
    per_tag = ok.where("tag <> 'all'").groupBy("file", "tag").agg(F.max(F.expr("if(action = 'add', seq, null)")).alias("added"), F.max(F.expr("if(action = 'clear', seq, null)")).alias("cleared"))
    return per_tag.join(cleared, "file", "left").where("added > coalesce(greatest(cleared, all_seq), added - 1)").select("file", "tag")


def level_of(tags: Column) -> Column:
    """high, medium or none."""
    return F.when(F.arrays_overlap(tags, F.array(*map(F.lit, HIGH_TAGS))), "high").when(F.size(tags) > 0, "medium").otherwise("none")


def risk_levels(tags: DataFrame) -> DataFrame:
    """The level by file; files without active tags are not in the input and have level none."""
    return tags.groupBy("file").agg(F.array_sort(F.collect_set("tag")).alias("tags")).select("file", F.array_join("tags", ",").alias("tags"), level_of(F.col("tags")).alias("level"))


def static_tags(fronts: DataFrame) -> DataFrame:
    """(file, tag) of the known risk tags that front matter (path, front as VARIANT) names, as a string or a list of strings."""
    risk = fronts.select(F.col("path").alias("file"), F.variant_get(F.col("front"), "$.risk", "variant").alias("risk"))
    kind = F.schema_of_variant("risk")
    one = F.when(kind == "STRING", F.array(F.try_variant_get("risk", "$", "string"))).when(F.startswith(kind, F.lit("ARRAY")), F.transform(F.try_variant_get("risk", "$", "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))))
    return risk.select("file", F.explode(one).alias("tag")).where(F.col("tag").isin(*RISK_TAGS)).distinct()


def risk_report(files: DataFrame, edges: DataFrame, events: DataFrame, static: DataFrame, n: int = 5) -> DataFrame:
    """For each file (path): affects (sorted), affects_count, active_tags of ledger and front matter, level, and its last n events, newest first."""
    asked = kept(files.select(F.col("path").alias("file")).distinct(), "asked")
    near = F.broadcast(asked) if asked.count() <= 10_000 else asked  # short paths
    impact = G.dependents(edges, asked.select(F.col("file").alias("id"))).groupBy(F.col("start").alias("file")).agg(F.array_sort(F.collect_set("id")).alias("affects"))
    tags = active_tags(events.join(near, "file", "left_semi")).unionByName(static.join(near, "file", "left_semi")).groupBy("file").agg(F.array_sort(F.collect_set("tag")).alias("active_tags"))
    order = Window.partitionBy("file").orderBy(F.desc("seq"))
    late = events.join(near, "file", "left_semi").withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    late = late.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.struct("seq", "action", "tag").alias("e")))), lambda x: x["e"]).alias("events"))
    out = asked.join(impact, "file", "left").join(tags, "file", "left").join(late, "file", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({"affects": F.coalesce("affects", none), "active_tags": F.coalesce("active_tags", none)})
    return out.select("file", "affects", F.size("affects").cast("long").alias("affects_count"), "active_tags", level_of(F.col("active_tags")).alias("level"), F.coalesce("events", F.array().cast(late.schema["events"].dataType)).alias("events"))


def changed(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Indexed files (path, hash) that vanished or whose recorded hash differs now; files without a recorded hash never count."""
    now = current.select("path", F.col("hash").alias("now"))
    return recorded.join(now, "path", "left").where("now is null or (hash <> '' and hash <> now)").select("path", F.when(F.col("now").isNull(), "gone").otherwise("changed").alias("state"))


def cost_inputs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents, summary characters and input tokens of an analysis prompt; blank texts don't count."""
    rows = docs.where(F.regexp_replace(text, r"(?U)\s", "") != "")
    out = rows.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.length(F.substring(text, 1, SUMMARY_CHARS))), F.lit(0)).alias("chars"))
    return out.withColumn("input_tokens", F.when(F.col("n_docs") > 0, F.floor((F.col("chars") + FRAMING_CHARS * F.col("n_docs")) / CHARS_PER_TOKEN) + PROMPT_TOKENS).otherwise(0).cast("long"))


def cost_estimate(docs: DataFrame, model: str, prices: DataFrame, text: str = "text", output_tokens: int = OUTPUT_TOKENS) -> DataFrame:
    """One row: model, n_docs, input_tokens, output_tokens, input_usd, output_usd, total_usd and whether the price is known.

    ``prices`` (model, input_price, output_price) is in dollars for a million tokens; an unknown model gets the fixed fallback.
    """
    known = prices.where(F.col("model") == model).agg(F.max("input_price").alias("a"), F.max("output_price").alias("b"))
    out = cost_inputs(docs, text).crossJoin(known)  # one row on each side
    out = out.withColumn("output_tokens", F.when(F.col("n_docs") > 0, output_tokens).otherwise(0).cast("long"))
    usd = lambda n, price, other: F.col(n) / 1e6 * F.coalesce(F.col(price), F.lit(other))
    a, b = usd("input_tokens", "a", INPUT_PRICE), usd("output_tokens", "b", OUTPUT_PRICE)
    return out.select(F.lit(model).alias("model"), "n_docs", "input_tokens", "output_tokens", F.round(a, 6).alias("input_usd"), F.round(b, 6).alias("output_usd"), F.round(a + b, 6).alias("total_usd"), F.col("a").isNotNull().alias("price_known"))


def fold_hash(files: DataFrame, order: str = "alpha") -> DataFrame:
    """One hash over path, bytes and hash of the files (path, bytes, hash) that a listing has, in the order of path components.

    Rows are sorted in parallel and stream through the driver one partition at a time; nothing holds all of them.
    """
    rows = ordered(files).select(F.concat("path", F.lit("|"), F.col("bytes").cast("string"), F.lit("|"), F.coalesce("hash", F.lit(""))).alias("s"))
    out = hashlib.sha256()
    for r in rows.toLocalIterator():
        out.update(r["s"].encode())
    if order != "alpha":
        out.update(f"|order={order}".encode())
    return files.sparkSession.createDataFrame([(HASH_PREFIX + out.hexdigest()[:HASH_CHARS],)], "hash string")
