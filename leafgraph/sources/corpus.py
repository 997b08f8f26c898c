"""A deterministic Markdown corpus rendered from the relational tables: input for the engine's queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): orders point to parts, parts to suppliers and to one other part, suppliers to nations, nations to regions.

    Parts whose key is divisible by 17 have no file.  SKILL.md, the entry, delegates to an agent for each nation; agents point to
    each other, in circles too, to shared parts and, from the folder above, to prompts; shared parts point to assets.
    """
    t = lambda name: table(spark, sf_dir, name)
    kind = F.expr("case l_returnflag when 'A' then 'include' when 'N' then 'ref' else 'delegate' end")
    line = F.concat(F.lit("@"), kind, F.lit(" ../parts/"), F.col("l_partkey"), F.lit(".md"), F.expr("if(l_linestatus = 'F', ' --parallel', '')"))
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    orders = t("orders").join(t("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).join(lines, "o_orderkey", "left")
    body = lambda *parts: F.concat(*parts).alias("content")
    orders = orders.select(F.concat(F.lit("orders/"), "o_orderkey", F.lit(".md")).alias("path"), body(F.lit("# Order **"), "o_orderkey", F.lit("**\n\nFor {{seg_"), F.lower("c_mktsegment"), F.lit("}} and\n[friends](x.html).\n\n"), F.coalesce("lines", F.lit("")), F.lit("\n")))
    n_parts, n_suppliers = t("part").count(), t("supplier").count()
    parts = t("part").where("p_partkey % 17 <> 0").select(F.concat(F.lit("parts/"), "p_partkey", F.lit(".md")).alias("path"), body(F.lit("# Part "), "p_partkey", F.lit("\n\n@include ../suppliers/"), F.expr(f"p_partkey % {n_suppliers} + 1"), F.lit(".md\n@delegate ./../parts/"), F.expr(f"(7 * p_partkey + 3) % {n_parts} + 1"), F.lit(".md\n")))
    suppliers = t("supplier").select(F.concat(F.lit("suppliers/"), "s_suppkey", F.lit(".md")).alias("path"), body(F.lit("# Supplier "), "s_suppkey", F.lit("\n\nSee `../nations/"), "s_nationkey", F.lit(".md` for {{country}}.\n")))
    nations = t("nation").select(F.concat(F.lit("nations/"), "n_nationkey", F.lit(".md")).alias("path"), body(F.lit("# "), "n_name", F.lit("\n\n@include ../regions/"), "n_regionkey", F.lit(".md\n")))
    regions = t("region").select(F.concat(F.lit("regions/"), "r_regionkey", F.lit(".md")).alias("path"), body(F.lit("# "), "r_name", F.lit("\n\nA region.\n")))
    return reduce(DataFrame.unionByName, [orders, parts, suppliers, nations, regions, *skill(spark, sf_dir)])


def skill(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The entry and what it leads to besides orders: files of every type."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    path = lambda folder, key: F.concat(F.lit(folder), key, F.lit(".md")).alias("path")
    lines = lambda rows, key, line: rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, line.alias("line")))), lambda x: x["line"]), "\n").alias(key))
    calls = lines(nation, "n_nationkey", F.concat(F.lit("@delegate agents/nation_"), "n_nationkey", F.lit(".md"), F.when(F.col("n_nationkey") % 2 == 0, " --parallel").otherwise("")))
    shown = lines(region, "r_regionkey", F.concat(F.lit("- `prompts/region_"), "r_regionkey", F.lit(".md`")))
    entry = calls.crossJoin(shown).select(F.lit("SKILL.md").alias("path"), F.concat(F.lit("---\nname: entry\nrisk: [x]\n---\n# The `entry` *skill*\n\n\tRuns all\t\n **agents**.\n\nThen:\n\n@include orders/1.md\n"), "n_nationkey", F.lit("\n@ref references/none.md\n\n"), "r_regionkey", F.lit("\n")).alias("content"))  # one row on each side
    following = F.expr("if(n_nationkey % 5 = 4, n_nationkey - 1, n_nationkey + 1)").cast("string")
    agents = nation.select(path("agents/nation_", F.col("n_nationkey").cast("string")), F.concat(F.lit("# Agent "), "n_name", F.lit("\n\nActs for {{region}}.\n\n@include ../shared/region_"), F.col("n_regionkey").cast("string"), F.lit(".md\n@delegate nation_"), following, F.lit(".md\n\nSee 'prompts/region_"), F.col("n_regionkey").cast("string"), F.lit(".md' first.\n")).alias("content"))
    key = F.col("r_regionkey").cast("string")
    shared = region.select(path("shared/region_", key), F.concat(F.lit("# Shared "), "r_name", F.lit("\n\nKnown as {{region}}.\n@ref ../assets/region_"), key, F.lit(".md\n")).alias("content"))
    prompts = region.select(path("prompts/region_", key), F.concat(F.lit("---\nrisk:\n  - fragile\n  - unknown\n---\n# Prompt "), "r_name", F.lit("\n\nSay {{greeting}} in {{region}}.\n")).alias("content"))
    assets = region.select(path("assets/region_", key), F.concat(F.lit("---\nrisk: security-sensitive\n---\n# Asset "), "r_name", F.lit("\n")).alias("content"))
    return [entry, agents, shared, prompts, assets]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, bytes): the pages' addresses as a folder, with names of every kind by page_id."""
    names = F.expr("case page_id % 10 when 1 then '/notes.md' when 2 then '/~$lock.docx' when 3 then '/.hidden/x.md' when 4 then '/日本.pdf' when 5 then '/README.Markdown' when 6 then '/photo.JPG' when 7 then '/data' else '' end")
    rows = table(spark, sf_dir, "pages").select(F.concat(F.regexp_replace("url", r"^https?://|[?#].*$", ""), names).alias("path"), F.octet_length("html").cast("long").alias("bytes"))
    return rows.groupBy("path").agg(F.max("bytes").alias("bytes"))


def plan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, type, parallel, ord) of a plan: regions delegate to nations, those to their suppliers, a supplier to the next of its four.

    In every tenth four the second also delegates to the first: a circle.  Suppliers include documents, three of them each.
    """
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    last = supplier.count()
    name = lambda prefix, key: F.concat(F.lit(prefix), key)
    edge = lambda src, dst, kind, parallel: [src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), parallel.alias("parallel"), F.lit(0).alias("ord")]
    no, four = F.lit(False), F.expr("(k - 1) % 4")
    return reduce(DataFrame.unionByName, [
        nation.select(*edge(name("r", F.col("n_regionkey")), name("n", F.col("n_nationkey")), "delegate", F.col("n_nationkey") % 2 == 0)), supplier.select(*edge(name("n", F.col("s_nationkey")), name("s", F.col("k")), "delegate", F.col("k") % 3 == 0)),
        supplier.where((four < 3) & (F.col("k") < last)).select(*edge(name("s", F.col("k")), name("s", F.col("k") + 1), "delegate", no)), supplier.where((four == 1) & F.expr("(k - 1) div 4 % 10 = 1")).select(*edge(name("s", F.col("k")), name("s", F.col("k") - 1), "delegate", no)),
        supplier.select(*edge(name("s", F.col("k")), name("doc", F.expr("k div 3")), "include", no)),
    ])


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, ts, file, action, tag): the events as an append-only risk ledger."""
    action = F.expr("if(event_type in ('view', 'purchase'), 'clear', 'add')")
    tag = F.expr("case event_type when 'error' then 'fix-failed' when 'click' then 'fragile' when 'signup' then 'deprecated' when 'view' then 'fragile' else 'all' end")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.concat(F.lit("user_"), "user_id").alias("file"), action.alias("action"), tag.alias("tag"))
