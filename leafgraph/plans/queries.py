"""Queries of the graph and of aggregates on the rendered corpus and the given tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.functions import text as X
from leafgraph.operators import expand as E
from leafgraph.operators import graph as G
from leafgraph.operators import health as H
from leafgraph.operators import index as I
from leafgraph.operators import injection
from leafgraph.operators import plan as P
from leafgraph.operators import reports as R
from leafgraph.plans.registry import query
from leafgraph.sources import corpus as C

#: The edges of the rendered corpus, from the rows it is rendered from.
EDGES = """
n AS (SELECT (SELECT count(*) FROM part) AS np, (SELECT count(*) FROM supplier) AS ns),
edges AS (
  SELECT 'orders/' || l_orderkey || '.md' AS src, 'parts/' || l_partkey || '.md' AS dst,
    CASE l_returnflag WHEN 'A' THEN 'include' WHEN 'N' THEN 'ref' ELSE 'delegate' END AS type, l_linestatus = 'F' AS parallel, min(o) AS ord
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CASE l_returnflag WHEN 'A' THEN 'i' WHEN 'N' THEN 'r' ELSE 'd' END, l_partkey || '.md' || CASE WHEN l_linestatus = 'F' THEN ' ' ELSE '' END) AS o FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4
  UNION ALL SELECT 'parts/' || p_partkey || '.md', 'suppliers/' || (p_partkey % ns + 1) || '.md', 'include', FALSE, 0 FROM part, n WHERE p_partkey % 17 <> 0
  UNION ALL SELECT 'parts/' || p_partkey || '.md', 'parts/' || ((7 * p_partkey + 3) % np + 1) || '.md', 'delegate', FALSE, 1 FROM part, n WHERE p_partkey % 17 <> 0
  UNION ALL SELECT 'suppliers/' || s_suppkey || '.md', 'nations/' || s_nationkey || '.md', 'read-ref', FALSE, 0 FROM supplier
  UNION ALL SELECT 'nations/' || n_nationkey || '.md', 'regions/' || n_regionkey || '.md', 'include', FALSE, 0 FROM nation
  UNION ALL SELECT 'SKILL.md', 'agents/nation_' || n_nationkey || '.md', 'delegate', n_nationkey % 2 = 0, 1 + n_nationkey FROM nation
  UNION ALL SELECT 'SKILL.md', x, t, FALSE, o FROM (VALUES ('orders/1.md', 'include', 0), ('references/none.md', 'ref', 100)) v(x, t, o)
  UNION ALL SELECT 'SKILL.md', 'prompts/region_' || r_regionkey || '.md', 'read-ref', FALSE, 200 + r_regionkey FROM region
  UNION ALL SELECT 'agents/nation_' || n_nationkey || '.md', 'shared/region_' || n_regionkey || '.md', 'include', FALSE, 0 FROM nation
  UNION ALL SELECT 'agents/nation_' || n_nationkey || '.md', 'agents/nation_' || CASE WHEN n_nationkey % 5 = 4 THEN n_nationkey - 1 ELSE n_nationkey + 1 END || '.md', 'delegate', FALSE, 1 FROM nation
  UNION ALL SELECT 'agents/nation_' || n_nationkey || '.md', 'prompts/region_' || n_regionkey || '.md', 'read-ref', FALSE, 2 FROM nation
  UNION ALL SELECT 'shared/region_' || r_regionkey || '.md', 'assets/region_' || r_regionkey || '.md', 'ref', FALSE, 0 FROM region),
files AS (
  SELECT 'orders/' || o_orderkey || '.md' AS path FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'parts/' || p_partkey || '.md' FROM part WHERE p_partkey % 17 <> 0
  UNION ALL SELECT 'suppliers/' || s_suppkey || '.md' FROM supplier UNION ALL SELECT 'nations/' || n_nationkey || '.md' FROM nation UNION ALL SELECT 'regions/' || r_regionkey || '.md' FROM region
  UNION ALL SELECT 'SKILL.md' UNION ALL SELECT 'agents/nation_' || n_nationkey || '.md' FROM nation
  UNION ALL SELECT f || '/region_' || r_regionkey || '.md' FROM region, (VALUES ('shared'), ('prompts'), ('assets')) v(f))
"""


def _edges(spark, d):
    return G.all_edges(C.documents(spark, d))


@query("edges", f"WITH {EDGES} SELECT src, dst, type, parallel FROM edges")
def edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("src", "dst", "type", "parallel")


@query("edge_type_counts", f"WITH {EDGES} SELECT type, parallel, count(*) AS n FROM edges GROUP BY ALL")
def edge_type_counts(spark, d):
    return _edges(spark, d).groupBy("type", "parallel").agg(F.count("*").alias("n"))


@query("direct_deps", f"WITH {EDGES} SELECT src, count(DISTINCT dst) AS n_targets, string_agg(DISTINCT dst, ',' ORDER BY dst) AS targets FROM edges GROUP BY src")
def direct_deps(spark, d):
    return _edges(spark, d).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("t")).select("src", F.size("t").cast("long").alias("n_targets"), F.array_join("t", ",").alias("targets"))


#: Path, title and description of every file, from the rows.
_TITLES = """SELECT 'orders/' || o_orderkey || '.md' AS path, 'Order ' || o_orderkey AS title, 'For {{seg_' || lower(c_mktsegment) || '}} and friends.' AS description FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'parts/' || p_partkey || '.md', 'Part ' || p_partkey, '' FROM part WHERE p_partkey % 17 <> 0
  UNION ALL SELECT 'suppliers/' || s_suppkey || '.md', 'Supplier ' || s_suppkey, 'See ../nations/' || s_nationkey || '.md for {{country}}.' FROM supplier
  UNION ALL SELECT 'nations/' || n_nationkey || '.md', n_name, '' FROM nation
  UNION ALL SELECT 'regions/' || r_regionkey || '.md', r_name, 'A region.' FROM region
  UNION ALL SELECT 'SKILL.md', 'The entry skill', 'Runs all agents.'
  UNION ALL SELECT 'agents/nation_' || n_nationkey || '.md', 'Agent ' || n_name, 'Acts for {{region}}.' FROM nation
  UNION ALL SELECT 'shared/region_' || r_regionkey || '.md', 'Shared ' || r_name, 'Known as {{region}}.' FROM region
  UNION ALL SELECT 'prompts/region_' || r_regionkey || '.md', 'Prompt ' || r_name, 'Say {{greeting}} in {{region}}.' FROM region
  UNION ALL SELECT 'assets/region_' || r_regionkey || '.md', 'Asset ' || r_name, '' FROM region"""


@query("titles", _TITLES)
def titles(spark, d):
    return C.documents(spark, d).select("path", X.title(F.col("content")).alias("title"), X.description(F.col("content")).alias("description"))


#: Placeholders of each file, from the rows.
_NAMES = """SELECT 'orders/' || o_orderkey || '.md' AS path, 'seg_' || lower(c_mktsegment) AS name FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'suppliers/' || s_suppkey || '.md', 'country' FROM supplier UNION ALL SELECT 'agents/nation_' || n_nationkey || '.md', 'region' FROM nation
  UNION ALL SELECT 'shared/region_' || r_regionkey || '.md', 'region' FROM region UNION ALL SELECT 'prompts/region_' || r_regionkey || '.md', n FROM region, (VALUES ('region'), ('greeting')) v(n)"""


@query("placeholder_findings", f"SELECT path, 'unresolved placeholder: {{{{' || name || '}}}}' AS message FROM ({_NAMES})")
def placeholder_findings(spark, d):
    return H.unresolved_placeholders(C.documents(spark, d)).select("path", "message")


@query("missing_references", f"WITH {EDGES} SELECT DISTINCT dst AS path, 'error' AS severity FROM edges WHERE dst NOT IN (SELECT path FROM files)")
def missing_references(spark, d):
    docs = C.documents(spark, d)
    return H.missing_references(docs, G.all_edges(docs)).select("path", "severity")


@query("conflicting_directives", f"WITH {EDGES} SELECT src AS path, dst || ' is referenced by multiple directive types (' || string_agg(DISTINCT type, ', ' ORDER BY type) || ')' AS message FROM edges WHERE type <> 'read-ref' GROUP BY src, dst HAVING count(DISTINCT type) > 1")
def conflicting_directives(spark, d):
    return H.conflicting_directives(_edges(spark, d)).select("path", "message")


_TYPE = "CASE WHEN {0} = 'SKILL.md' THEN 'skill' WHEN {0} LIKE 'agents/%' THEN 'agent' WHEN {0} LIKE 'shared/%' THEN 'shared' WHEN {0} LIKE 'prompts/%' THEN 'prompt' WHEN {0} LIKE 'assets/%' THEN 'template' ELSE 'reference' END"


@query("node_types", f"WITH {EDGES} SELECT {_TYPE.format('path')} AS type, count(*) AS n FROM files GROUP BY 1")
def node_types(spark, d):
    return C.documents(spark, d).groupBy(X.node_type(F.col("path")).alias("type")).agg(F.count("*").alias("n"))


_REACH = f"""WITH RECURSIVE {EDGES},
reach(id) AS (SELECT dst FROM edges WHERE src = 'parts/1.md' AND type IN ('include', 'delegate')
  UNION SELECT dst FROM reach JOIN edges ON src = id WHERE type IN ('include', 'delegate'))"""


@query("reachable_from_part", f"{_REACH} SELECT id FROM reach")
def reachable_from_part(spark, d):
    edges = _edges(spark, d).where("type in ('include', 'delegate')")
    return G.closure(edges, spark.createDataFrame([("parts/1.md",)], "id string")).select("id")


@query("affected_by_supplier", f"WITH RECURSIVE {EDGES}, back(id) AS (SELECT src FROM edges WHERE dst = 'suppliers/1.md' UNION SELECT src FROM back JOIN edges ON dst = id) SELECT id FROM back")
def affected_by_supplier(spark, d):
    return G.dependents(_edges(spark, d), spark.createDataFrame([("suppliers/1.md",)], "id string")).select("id")


@query("graph_from_order", f"WITH RECURSIVE {EDGES}, walk(id, level) AS (SELECT 'orders/1.md', 0 UNION SELECT dst, level + 1 FROM walk JOIN edges ON src = id WHERE type IN ('include', 'delegate') AND level < 10), w AS (SELECT DISTINCT id FROM walk), named AS (SELECT id FROM w UNION SELECT dst FROM edges WHERE type IN ('ref', 'read-ref') AND src IN (SELECT id FROM w)) SELECT id, id NOT IN (SELECT path FROM files) AS missing FROM named")
def graph_from_order(spark, d):
    nodes, _, _ = G.build(C.documents(spark, d), spark.createDataFrame([("orders/1.md",)], "id string"))
    return nodes.select("id", "missing")


@query("orphans", f"WITH {EDGES} SELECT path FROM files WHERE path NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)")
def orphans(spark, d):
    docs = C.documents(spark, d)
    edges = G.kept(G.all_edges(docs))
    return H.orphans(docs, edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()).select("path")


@query("task_flags", f"WITH {EDGES} SELECT dst AS task, bool_or(parallel) AS parallel FROM edges WHERE type = 'delegate' GROUP BY 1")
def task_flags(spark, d):
    return G.tasks(_edges(spark, d))


#: The plan's edges, from the rows, with what tasks reach, need and are excluded for.
PLAN = """
sup AS (SELECT s_suppkey AS k, s_nationkey, (s_suppkey - 1) % 4 AS i, (s_suppkey - 1) // 4 AS g, (SELECT count(*) FROM supplier) AS n FROM supplier),
edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'delegate' AS type, n_nationkey % 2 = 0 AS parallel FROM nation
  UNION ALL SELECT 'n' || s_nationkey, 's' || k, 'delegate', k % 3 = 0 FROM sup UNION ALL SELECT 's' || k, 's' || (k + 1), 'delegate', FALSE FROM sup WHERE i < 3 AND k < n
  UNION ALL SELECT 's' || k, 's' || (k - 1), 'delegate', FALSE FROM sup WHERE i = 1 AND g % 10 = 1 UNION ALL SELECT 's' || k, 'doc' || (k // 3), 'include', FALSE FROM sup),
tasks AS (SELECT dst AS task, bool_or(parallel) AS parallel FROM edges WHERE type = 'delegate' GROUP BY 1),
reach(task, id) AS (SELECT src, dst FROM edges UNION SELECT task, dst FROM reach JOIN edges ON src = id),
needs AS (SELECT task, id AS needs FROM reach WHERE task <> id AND task IN (SELECT task FROM tasks) AND id IN (SELECT task FROM tasks)),
mutual AS (SELECT a.task AS a, a.needs AS b FROM needs a JOIN needs b ON a.task = b.needs AND a.needs = b.task AND a.task < a.needs),
ok AS (SELECT task FROM tasks WHERE task NOT IN (SELECT a FROM mutual UNION SELECT b FROM mutual)),
chain(task, level) AS (SELECT task, 0 FROM ok UNION SELECT n.task, level + 1 FROM chain JOIN needs n ON n.needs = chain.task JOIN ok ON ok.task = n.task),
levels AS (SELECT task, max(level) AS level FROM chain GROUP BY 1),
shared AS (SELECT r.task, level, id FROM reach r JOIN levels USING (task) WHERE id NOT IN (SELECT task FROM tasks)),
clashes AS (SELECT x.task AS a, y.task AS b, x.level AS level, string_agg(DISTINCT x.id, ',' ORDER BY x.id) AS shared FROM shared x JOIN shared y ON x.level = y.level AND x.id = y.id AND x.task < y.task GROUP BY 1, 2, 3)
"""


@lru_cache(maxsize=4)
def _plan(spark, d):
    """A session keeps the plan's tables for the queries over them."""
    edges = C.plan_edges(spark, d)
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    files = I.compact(G.bare(ids, F.lit(False)), edges)
    return P.build_plan(G.kept(files), spark.createDataFrame([], "type string, path string, message string"))


@query("plan_levels", f"WITH RECURSIVE {PLAN} SELECT t.task, t.parallel, CAST(level AS INTEGER) AS level, coalesce((SELECT string_agg(needs, ',' ORDER BY needs) FROM needs n WHERE n.task = t.task), '') AS depends_on FROM tasks t LEFT JOIN levels USING (task)")
def plan_levels(spark, d):
    return _plan(spark, d).tasks.select("task", "parallel", "level", F.array_join("depends_on", ",").alias("depends_on"))


@query("plan_conflicts", f"WITH RECURSIVE {PLAN} SELECT a, b, CAST(level AS INTEGER) AS level, shared FROM clashes")
def plan_conflicts(spark, d):
    return _plan(spark, d).conflicts.withColumn("shared", F.array_join("shared", ","))


@query("plan_cycles", f"WITH RECURSIVE {PLAN} SELECT a || ' <-> ' || b || ' (task cycle)' AS message FROM mutual")
def plan_cycles(spark, d):
    return _plan(spark, d).cycles


@query("plan_contexts", f"WITH RECURSIVE {PLAN} SELECT task, id AS path FROM reach WHERE task <> id AND task IN (SELECT task FROM tasks)")
def plan_contexts(spark, d):
    return _plan(spark, d).contexts.select("task", "path")


@query("plan_text", f"""WITH RECURSIVE {PLAN},
n AS (SELECT (SELECT count(*) FROM tasks) AS t, (SELECT count(DISTINCT level) FROM levels) AS b),
lines AS (SELECT 0 AS a, '' AS k, 0 AS s, '# plan — ' || t || ' tasks, ' || b || ' batches' AS line FROM n
  UNION ALL SELECT 1, lpad(CAST(level AS VARCHAR), 9, '0'), 0, 'Level ' || level || CASE WHEN count(*) > 1 THEN ' (parallel)' ELSE '' END || ':' FROM levels GROUP BY level
  UNION ALL SELECT 1, lpad(CAST(level AS VARCHAR), 9, '0'), 1, '  - ' || task || CASE WHEN parallel THEN ' ‖' ELSE '' END FROM levels JOIN tasks USING (task)
  UNION ALL SELECT 2, '', 0, '' UNION ALL SELECT 2, '', 1, 'Conflicts (warning — parallel kept):'
  UNION ALL SELECT 3, '', 0, '  - L' || level || ': ' || a || ' & ' || b || ' share ' || replace(shared, ',', ', ') FROM clashes)
SELECT line FROM lines UNION ALL SELECT x FROM (VALUES (''), ('Cycles (error):')) v(x) WHERE (SELECT count(*) FROM mutual) > 0 UNION ALL SELECT '  - ' || a || ' <-> ' || b || ' (task cycle)' FROM mutual""")
def plan_text(spark, d):
    return R.plan_lines(_plan(spark, d)).select("line")


@query("cyclic_files", f"WITH RECURSIVE {EDGES}, e AS (SELECT DISTINCT src, dst FROM edges WHERE type IN ('include', 'delegate')), walk(start, id) AS (SELECT src, dst FROM e WHERE src NOT LIKE 'orders/%' AND src <> 'SKILL.md' UNION SELECT start, dst FROM walk JOIN e ON src = id) SELECT start AS id FROM walk WHERE start = id")
def cyclic_files(spark, d):
    """Nothing leads to orders but the entry, and nothing to the entry: the SQL leaves them out as starts."""
    return G.cyclic_nodes(_edges(spark, d).where(G.WALKED))


#: Texts of all files after expansion: white space around an include goes with it, other directives stay as they are.
_EXPANDED = """WITH n AS (SELECT (SELECT count(*) FROM part) AS np, (SELECT count(*) FROM supplier) AS ns),
s AS (SELECT s_suppkey AS k, '# Supplier ' || s_suppkey || chr(10) || chr(10) || 'See `../nations/' || s_nationkey || '.md` for home.' || chr(10) AS x FROM supplier),
p AS (SELECT p_partkey AS k, '# Part ' || p_partkey || chr(10) || coalesce(s.x, '') || chr(10) || '@delegate ./../parts/' || ((7 * p_partkey + 3) % np + 1) || '.md' || chr(10) AS x FROM (SELECT * FROM part, n) LEFT JOIN s ON s.k = p_partkey % ns + 1 WHERE p_partkey % 17 <> 0),
l AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'A' AS inc, '@' || CASE l_returnflag WHEN 'A' THEN 'include' WHEN 'N' THEN 'ref' ELSE 'delegate' END || ' ../parts/' || l_partkey || '.md' || CASE WHEN l_linestatus = 'F' THEN ' --parallel' ELSE '' END AS line, coalesce(p.x, '') AS x FROM lineitem LEFT JOIN p ON p.k = l_partkey),
li AS (SELECT l_orderkey, string_agg(CASE WHEN inc THEN x ELSE line END, chr(10) ORDER BY l_linenumber, line) AS x, arg_min(inc, (l_linenumber, line)) AS a, arg_max(inc, (l_linenumber, line)) AS b FROM l GROUP BY 1),
o AS (SELECT o_orderkey AS k, '# Order **' || o_orderkey || '**' || chr(10) || chr(10) || 'For {{seg_' || lower(c_mktsegment) || '}} and' || chr(10) || '[friends](x.html).' || chr(10) || CASE WHEN a THEN '' ELSE chr(10) END || coalesce(li.x, '') || CASE WHEN b THEN '' ELSE chr(10) END AS x FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN li ON l_orderkey = o_orderkey),
r AS (SELECT r_regionkey AS k, '# ' || r_name || chr(10) || chr(10) || 'A region.' || chr(10) AS x, '# Shared ' || r_name || chr(10) || chr(10) || 'Known as {{region}}.' || chr(10) || '@ref ../assets/region_' || r_regionkey || '.md' || chr(10) AS shared FROM region)
SELECT 'suppliers/' || k || '.md' AS id, x AS content FROM s UNION ALL SELECT 'parts/' || k || '.md', x FROM p UNION ALL SELECT 'orders/' || k || '.md', x FROM o UNION ALL SELECT 'regions/' || k || '.md', x FROM r UNION ALL SELECT 'shared/region_' || k || '.md', shared FROM r
UNION ALL SELECT 'nations/' || n_nationkey || '.md', '# ' || n_name || chr(10) || r.x FROM nation JOIN r ON r.k = n_regionkey
UNION ALL SELECT 'prompts/region_' || r_regionkey || '.md', '---' || chr(10) || 'risk:' || chr(10) || '  - fragile' || chr(10) || '  - unknown' || chr(10) || '---' || chr(10) || '# Prompt ' || r_name || chr(10) || chr(10) || 'Say {{greeting}} in {{region}}.' || chr(10) FROM region
UNION ALL SELECT 'assets/region_' || r_regionkey || '.md', '---' || chr(10) || 'risk: security-sensitive' || chr(10) || '---' || chr(10) || '# Asset ' || r_name || chr(10) FROM region
UNION ALL SELECT 'agents/nation_' || n_nationkey || '.md', '# Agent ' || n_name || chr(10) || chr(10) || 'Acts for {{region}}.' || chr(10) || r.shared || chr(10) || '@delegate nation_' || CASE WHEN n_nationkey % 5 = 4 THEN n_nationkey - 1 ELSE n_nationkey + 1 END || '.md' || chr(10) || chr(10) || 'See ''prompts/region_' || n_regionkey || '.md'' first.' || chr(10) FROM nation JOIN r ON r.k = n_regionkey
UNION ALL SELECT 'SKILL.md', '---' || chr(10) || 'name: entry' || chr(10) || 'risk: [x]' || chr(10) || '---' || chr(10) || '# The `entry` *skill*' || chr(10) || chr(10) || chr(9) || 'Runs all' || chr(9) || chr(10) || ' **agents**.' || chr(10) || chr(10) || 'Then:' || chr(10) || (SELECT x FROM o WHERE k = 1) || chr(10)
  || (SELECT string_agg('@delegate agents/nation_' || n_nationkey || '.md' || CASE WHEN n_nationkey % 2 = 0 THEN ' --parallel' ELSE '' END, chr(10) ORDER BY n_nationkey) FROM nation) || chr(10) || '@ref references/none.md' || chr(10) || chr(10) || (SELECT string_agg('- `prompts/region_' || r_regionkey || '.md`', chr(10) ORDER BY r_regionkey) FROM region) || chr(10)"""


@query("expanded", _EXPANDED)
def expanded(spark, d):
    docs = G.kept(C.documents(spark, d))
    return E.expand(docs, docs.select(F.col("path").alias("id")), {"country": "home"})[0].select("id", "content")


@query("walks", f"""WITH RECURSIVE {EDGES},
w(path, id, depth, kind, cycle) AS (SELECT ['SKILL.md'], 'SKILL.md', 0, '', FALSE
  UNION ALL SELECT list_append(path, dst), dst, depth + 1, type, list_contains(path, dst) FROM w JOIN edges ON src = id WHERE NOT cycle AND depth < 6)
SELECT array_to_string(path, ' > ') AS path, CAST(depth AS INTEGER) AS depth, kind, cycle FROM w""")
def walks(spark, d):
    return E.tree(G.kept(_edges(spark, d)), spark.createDataFrame([("SKILL.md",)], "id string")).select(F.array_join("path", " > ").alias("path"), "depth", "kind", "cycle")


@query("document_stats", "SELECT doc_id, substr(sha256(text), 1, 16) AS hash, octet_length(encode(text)) AS size, greatest(1, length(text) // 4) AS tokens FROM documents")
def document_stats(spark, d):
    t = F.col("text")
    return C.table(spark, d, "documents").select("doc_id", X.content_hash(t).alias("hash"), X.byte_size(t).alias("size"), X.token_estimate(t).alias("tokens"))


_ACTIVE = """a AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'fix-failed' WHEN 'click' THEN 'fragile' WHEN 'signup' THEN 'deprecated' END AS tag, event_type FROM events),
active AS (SELECT DISTINCT 'user_' || user_id AS file, tag FROM a x WHERE tag IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a y WHERE y.user_id = x.user_id AND y.event_id > x.event_id AND (y.event_type = 'purchase' OR (y.event_type = 'view' AND x.tag = 'fragile'))))"""


@query("active_tags", f"WITH {_ACTIVE} SELECT file, tag FROM active")
def active_tags(spark, d):
    return H.active_tags(C.ledger(spark, d))


@query("risk_levels", f"WITH {_ACTIVE} SELECT file, string_agg(tag, ',' ORDER BY tag) AS tags, CASE WHEN bool_or(tag = 'fix-failed') THEN 'high' ELSE 'medium' END AS level FROM active GROUP BY file")
def risk_levels(spark, d):
    return H.risk_levels(H.active_tags(C.ledger(spark, d)))


@query("recent_events", "SELECT 'user_' || user_id AS file, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def recent_events(spark, d):
    return G.recent(C.ledger(spark, d)).select("file", "seq")


@query("changed_files", "SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'gone' ELSE 'changed' END AS state FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0")
def changed_files(spark, d):
    """Every seventh file is gone and every fifth other one has been written to since."""
    docs = C.table(spark, d, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), "doc_id", "text")
    recorded = docs.select("path", X.content_hash(F.col("text")).alias("hash"))
    current = docs.where("doc_id % 7 <> 0").select("path", X.content_hash(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return H.changed(recorded, current)


@query("cost_inputs", "SELECT count(*) AS n_docs, CAST(sum(least(length(text), 500)) AS BIGINT) AS chars, CAST((sum(least(length(text), 500)) + 30 * count(*)) // 4 + 800 AS BIGINT) AS input_tokens FROM documents WHERE trim(text, ' \n\t\r') <> ''")
def cost_inputs(spark, d):
    return H.cost_inputs(C.table(spark, d, "documents"))
