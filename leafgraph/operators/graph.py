"""The dependency graph: edges, nodes, warnings, closures, plans.  A document's ``path`` is its key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.functions import text as X
from leafgraph.sources.scratch import kept

# The depth limit and the messages of warnings.
MAX_DEPTH = 10
MISSING = {"walk": "Referenced file does not exist: ", "ref": "@ref target does not exist: ", "read-ref": "Read reference target does not exist: ", "declared": "deps.yml target does not exist: "}
CIRCULAR, DEEP, UNREADABLE, NOTHING = "Circular reference: ", "Maximum depth {} exceeded", "not valid UTF-8", "Neither SKILL.md nor deps.yml found"

WALKED = "type in ('include', 'delegate')"

#: Edges of a graph, and pairs of a closure, that the driver walks by itself: a round of distributed joins costs more than such a walk.
SMALL = 100_000


def all_edges(docs: DataFrame) -> DataFrame:
    """(src, dst, type, parallel, ord) of every directive and prose reference; an edge is its first four fields.

    Texts are read once: one projection finds both kinds, and what it finds is a table.  A prose reference that doesn't
    resolve beside its source is looked for in each folder above, nearest first; only such references are joined again.
    """
    path = F.col("path")
    own = F.transform(X.directives(F.col("content")), lambda d: F.struct(X.resolve_path(path, d["target"]).alias("dst"), d["type"].alias("type"), d["parallel"].alias("parallel")))
    found = kept(docs.select("path", F.array_distinct(own).alias("own"), X.read_refs(F.col("content")).alias("refs")), "found")
    made = found.select(path.alias("src"), F.posexplode("own").alias("ord", "d")).select("src", "d.dst", "d.type", "d.parallel", "ord")
    refs = found.where("size(refs) > 0").select(path.alias("src"), F.posexplode("refs").alias("ord", "target"))
    refs = refs.withColumns({"dst": X.resolve_path(F.col("src"), F.col("target")), "depth": F.size(F.split("src", "/")) - 1})
    there = found.select(path.alias("dst"))
    lost = refs.where("depth > 0").join(there, "dst", "left_anti").select("src", "ord", "target", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("up"))
    above = lost.withColumn("dst", X.resolve_path(F.col("src"), F.concat(F.repeat(F.lit("../"), F.col("up")), F.col("target"))))
    above = above.join(there, "dst").groupBy("src", "ord").agg(F.min_by("dst", "up").alias("other"))
    refs = refs.join(above, ["src", "ord"], "left").groupBy("src", F.coalesce("other", "dst").alias("dst")).agg(F.min("ord").alias("ord"))
    return made.unionByName(refs.select("src", "dst", F.lit("read-ref").alias("type"), F.lit(False).alias("parallel"), (F.col("ord") + 1_000_000).alias("ord")))


def parsed(docs: DataFrame) -> DataFrame:
    """Nodes of documents: id, type, missing, placeholders, title, desc, hash, size; one that can't be read (null content) has no more than its type."""
    c = F.col("content")
    blank = lambda x: F.coalesce(x, F.lit(""))
    return docs.select(F.col("path").alias("id"), X.node_type(F.col("path")).alias("type"), F.lit(False).alias("missing"), F.coalesce(X.placeholders(c), F.array().cast("array<string>")).alias("placeholders"), X.title(c).alias("title"), blank(X.description(c)).alias("desc"), blank(X.content_hash(c)).alias("hash"), F.coalesce(X.byte_size(c), F.lit(0).cast("long")).alias("size"))


def bare(ids: DataFrame, missing: Column, reference: str = "reference") -> DataFrame:
    """Nodes that are only referred to, of paths (id)."""
    kind = X.node_type(F.col("id"))
    return ids.select("id", F.when(kind == "reference", reference).otherwise(kind).alias("type"), missing.alias("missing"), F.array().cast("array<string>").alias("placeholders"), *(F.lit("").alias(c) for c in ("title", "desc", "hash")), F.lit(0).cast("long").alias("size"))


def missing_targets(docs: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("path")).distinct().join(docs.select("path"), "path", "left_anti")


def held(pairs: DataFrame, small: int) -> dict[str, list[str]] | None:
    """The edges by source, where they are few enough for the driver."""
    if pairs.count() > small:
        return None
    out: dict[str, list[str]] = {}
    for src, dst in pairs.collect():
        out.setdefault(src, []).append(dst)
    return out


def walked_levels(after: dict[str, list[str]], starts: list[str], bound: int, most: int) -> list[tuple[str, str, int]] | None:
    """``closure`` of a small graph, unless it has more than ``most`` rows."""
    out = []
    for start in starts:
        seen, front, level = set(), [start], 0
        while front and level < bound:
            level, step = level + 1, []
            for x in front:
                for y in after.get(x, ()):
                    if y not in seen:
                        seen.add(y)
                        step.append(y)
                        out.append((start, y, level))
            front = step
            if len(out) > most:
                return None
    return out


def closure(edges: DataFrame, starts: DataFrame, limit: int = 10_000, bound: int | None = None, small: int = SMALL) -> DataFrame:
    """(start, id, level) of everything reachable over the edges' (src, dst) in at least one step.

    A start is in its own closure if a cycle leads back to it.  A round joins, and writes, the frontier alone; what has been
    visited is the frontiers written so far.  ``bound`` is a depth limit.  A closure of at most ``small`` edges, starts and rows is
    made on the driver; the result is the same.
    """
    pairs = kept(edges.select("src", "dst").distinct(), "pairs")
    first = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("level")).distinct()
    frontier, rounds = kept(first, "frontier"), []
    if (after := held(pairs, small)) is not None and frontier.count() <= small:
        rows = walked_levels(after, [r["id"] for r in frontier.select("id").collect()], bound or limit, small)
        if rows is not None:
            return edges.sparkSession.createDataFrame(rows, "start string, id string, level int")
    for level in range(1, (bound or limit) + 1):
        step = frontier.join(pairs, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id")).distinct()
        if rounds:
            step = step.join(together(rounds).select("start", "id"), ["start", "id"], "left_anti")
        frontier = kept(step.withColumn("level", F.lit(level)), "frontier")
        if frontier.isEmpty():
            return together(rounds) if rounds else frontier
        rounds.append(frontier)
    if bound is None:
        raise RuntimeError(f"no end of the closure after {limit} rounds")
    return together(rounds)


def together(parts: list[DataFrame]) -> DataFrame:
    """Tables of ``kept`` with one schema, as one scan."""
    files = [f for p in parts for f in p.inputFiles()]
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*files) if files else parts[0]


def dependents(edges: DataFrame, ids: DataFrame, limit: int = 10_000, small: int = SMALL) -> DataFrame:
    """Everything that leads to the ids, directly or not."""
    return closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ids, limit, small=small)


def circular(walk: DataFrame, entries: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Warnings (type, path, message) of the walks from the entries that meet themselves, with the way.

    Only edges that still lead to a cycle are walked, so a graph without cycles costs nothing here; with them there is a
    warning for each way, which may be many.
    """
    step = kept(walk.select("src", "dst").distinct(), "walk")
    loops = kept(cyclic_nodes(step), "cyclic")
    empty = loops.limit(0).select(F.lit("circular").alias("type"), F.col("id").alias("path"), F.col("id").alias("message"))
    if loops.isEmpty():
        return empty
    live = kept(loops.unionByName(dependents(step, loops).select("id")).distinct(), "live")
    step = kept(step.join(live.select(F.col("id").alias("dst")), "dst"), "walk")
    ways, out = kept(entries.select(F.array("id").alias("way"), "id").distinct(), "ways"), []
    for _ in range(max_depth):
        rows = kept(ways.join(step, F.col("id") == F.col("src")).select(F.concat("way", F.array("dst")).alias("way"), F.col("dst").alias("id"), F.array_contains("way", F.col("dst")).alias("met")), "ways")
        out.append(rows.where("met").select(F.lit("circular").alias("type"), F.col("id").alias("path"), F.concat(F.lit(CIRCULAR), F.array_join("way", " -> ")).alias("message")))
        ways = rows.where("not met")
        if ways.isEmpty():
            break
    return reduce(DataFrame.unionByName, out, empty).distinct()


def build(docs: DataFrame, entries: DataFrame, max_depth: int = MAX_DEPTH, declared: DataFrame | None = None, files: DataFrame | None = None, root: str = ".") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and warnings of what the entries reach.

    Includes and delegations are followed, to ``max_depth``; other references make nodes that aren't read.  ``declared``
    (path, includes), of a dependency file, adds include edges that aren't followed.  ``files`` (path) says what exists
    beside the documents.  A missing target has one warning, of the strongest kind of reference; a target is too deep if
    no way to it is short enough.  Without an entry and a dependency file there is one warning on ``root``.
    """
    edges = kept(all_edges(docs), "edges")
    exist = docs.select(F.col("path").alias("id"))
    exist = kept((exist if files is None else exist.unionByName(files.select(F.col("path").alias("id")))).distinct(), "paths")
    entries = kept(entries.select("id").distinct(), "entries")
    walk = kept(edges.where(WALKED).join(docs.where("content is not null").select(F.col("path").alias("src")), "src", "left_semi"), "walk")
    reached = entries.withColumn("level", F.lit(0)).unionByName(closure(walk, entries, bound=max_depth + 1).select("id", "level"))
    reached = kept(reached.groupBy("id").agg(F.min("level").alias("level")), "reached")
    walked = reached.where(F.col("level") <= max_depth).select("id")
    own = edges.join(walked.select(F.col("id").alias("src")), "src", "left_semi")
    read = parsed(docs.join(walked.select(F.col("id").alias("path")), "path", "left_semi"))
    kind = F.when(F.col("type") == "ref", 1).otherwise(2)
    named = walked.withColumn("by", F.lit(0)).unionByName(own.where(f"not {WALKED}").select(F.col("dst").alias("id"), kind.alias("by")))
    if declared is not None:
        whole = lambda c: X.resolve_path(F.lit(""), c)
        more = kept(declared.select(whole(F.col("path")).alias("src"), F.posexplode_outer("includes").alias("i", "t")).select("src", whole(F.col("t")).alias("dst"), "i"), "declared")
        own = own.unionByName(more.where("dst is not null").select("src", "dst", F.lit("include").alias("type"), F.lit(False).alias("parallel"), (F.col("i") + 2_000_000).alias("ord")))
        own = own.groupBy("src", "dst", "type", "parallel").agg(F.min("ord").alias("ord"))
        named = named.unionByName(more.select(F.col("src").alias("id"), F.lit(4).alias("by"))).unionByName(more.where("dst is not null").select(F.col("dst").alias("id"), F.lit(3).alias("by")))
    named = kept(named.groupBy("id").agg(F.min("by").alias("by")).join(exist.withColumn("there", F.lit(True)), "id", "left").withColumn("gone", F.col("there").isNull()).drop("there"), "named")
    rest = named.join(walked.join(docs.select(F.col("path").alias("id")), "id", "left_semi"), "id", "left_anti")
    nodes = read.unionByName(bare(rest.where("by < 3"), F.col("gone"))).unionByName(bare(rest.where("by >= 3"), F.col("gone"), "document"))
    said = reduce(lambda a, x: a.when(F.col("by") == x[0], x[1]), enumerate(MISSING.values()), F.when(F.lit(False), ""))
    warn = lambda kind, rows, message: rows.select(F.lit(kind).alias("type"), F.col("id").alias("path"), message.alias("message"))
    warnings = warn("missing", named.where("gone and by < 4"), F.concat(said, "id"))
    warnings = warnings.unionByName(warn("depth_exceeded", reached.where(F.col("level") > max_depth), F.lit(DEEP.format(max_depth))))
    unread = docs.where("content is null").select(F.col("path").alias("id")).join(walked, "id", "left_semi")
    warnings = warnings.unionByName(warn("read_error", unread, F.lit(UNREADABLE))).unionByName(circular(walk.join(walked.select(F.col("id").alias("src")), "src", "left_semi"), entries, max_depth))
    if declared is None and entries.isEmpty():
        warnings = warnings.unionByName(docs.sparkSession.createDataFrame([("missing", root, NOTHING)], "type string, path string, message string"))
    return nodes, own, warnings


def tasks(edges: DataFrame) -> DataFrame:
    """Distinct delegation targets and whether any delegation to them is parallel."""
    return edges.where("type = 'delegate'").groupBy(F.col("dst").alias("task")).agg(F.bool_or("parallel").alias("parallel"))


def reach_of_tasks(edges: DataFrame) -> DataFrame:
    """(task, id): what each task leads to, itself aside.  One closure serves needs, conflicts and contexts."""
    every = tasks(edges).select(F.col("task").alias("id"))
    return kept(closure(edges, every).where("start <> id").select(F.col("start").alias("task"), "id"), "reach")


def task_dag(edges: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """(task, needs): which other tasks each task leads to."""
    reach = reach_of_tasks(edges) if reach is None else reach
    return reach.join(tasks(edges).select(F.col("task").alias("id")), "id", "left_semi").select("task", F.col("id").alias("needs"))


def mutual_pairs(dag: DataFrame) -> DataFrame:
    other = dag.select(F.col("needs").alias("task"), F.col("task").alias("needs"))
    return dag.join(other, ["task", "needs"]).where("task < needs").select(F.col("task").alias("a"), F.col("needs").alias("b"))


def levels(every: DataFrame, dag: DataFrame, limit: int = 10_000) -> DataFrame:
    """(task, level): the longest chain of needs; tasks on a cycle are left out, also from others' needs.  A round writes one level, and what is left."""
    cyclic = mutual_pairs(dag)
    cyclic = kept(cyclic.select(F.col("a").alias("task")).unionByName(cyclic.select(F.col("b").alias("task"))).distinct(), "cyclic")
    left = kept(every.select("task").distinct().join(cyclic, "task", "left_anti"), "left")
    needs = kept(dag.join(cyclic, "task", "left_anti").join(cyclic.select(F.col("task").alias("needs")), "needs", "left_anti").select("task", "needs"), "needs")
    out = []
    for level in range(limit):
        if left.isEmpty():
            return together(out) if out else left.withColumn("level", F.lit(0))
        out.append(kept(left.join(needs.select("task").distinct(), "task", "left_anti").withColumn("level", F.lit(level)), "level"))
        left = kept(left.join(out[-1], "task", "left_anti"), "left")
        needs = kept(needs.join(out[-1].select(F.col("task").alias("needs")), "needs", "left_anti").select("task", "needs"), "needs")
    raise RuntimeError("levels do not end")


def conflicts(edges: DataFrame, leveled: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """(a, b, level, shared): tasks of a level that reach the same node which is no task."""
    reach = reach_of_tasks(edges) if reach is None else reach
    reach = kept(reach.join(tasks(edges).select(F.col("task").alias("id")), "id", "left_anti").join(leveled, "task"), "shared")
    other = reach.select(F.col("task").alias("b"), "id", "level")
    return reach.withColumnRenamed("task", "a").join(other, ["id", "level"]).where("a < b").groupBy("a", "b", "level").agg(F.sort_array(F.collect_set("id")).alias("shared"))


def trimmed(edges: DataFrame, limit: int) -> DataFrame:
    """Without the edges that cannot lie on a cycle because nothing leads to their source or from their target."""
    before = edges.count()
    for _ in range(limit):
        edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        edges = kept(edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "trimmed")
        now = edges.count()
        if now == before:
            return edges
        before = now
    raise RuntimeError("trimming does not end")


def strong(after: dict[str, list[str]]) -> set[str]:
    """``cyclic_nodes`` of a small graph: what a search from each root, in the order in which nodes were left, finds against the edges."""
    left, seen, before = [], set(), {}
    for root in list(after):
        stack = [(root, iter(after.get(root, ())))] if root not in seen else []
        seen.add(root)
        while stack:
            x, rest = stack[-1]
            y = next(rest, None)
            if y is None:
                left.append(stack.pop()[0])
            else:
                before.setdefault(y, []).append(x)
                if y not in seen:
                    seen.add(y)
                    stack.append((y, iter(after.get(y, ()))))
    done, out = set(), {x for x, ys in after.items() if x in ys}
    for root in reversed(left):
        if root in done:
            continue
        part, front = {root}, [root]
        while front:
            fresh = {y for y in before.get(front.pop(), ()) if y not in done} - part
            part |= fresh
            front += fresh
        done |= part
        if len(part) > 1:
            out |= part
    return out


def cyclic_nodes(edges: DataFrame, limit: int = 10_000, small: int = SMALL) -> DataFrame:
    """Ids that lead back to themselves: the members of strongly connected components.

    Edges that cannot lie on a cycle are trimmed.  In what is left the largest id that leads to a node is its colour; from each
    node that has its own colour a search backwards within the colour finds its component.  Components are taken out and
    the rest is trimmed again.  Tables stay as large as the edges; rounds follow the longest way.  A graph of at most
    ``small`` edges is searched on the driver; the result is the same.
    """
    edges = kept(edges.select("src", "dst").distinct(), "edges")
    if (after := held(edges, small)) is not None:
        return edges.sparkSession.createDataFrame([(x,) for x in sorted(strong(after))], "id string")
    found = [kept(edges.where("src = dst").select(F.col("src").alias("id")), "loops")]
    edges = trimmed(edges.where("src <> dst"), limit)
    while not edges.isEmpty():
        colors = kept(edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct().withColumn("color", F.col("id")), "colors")
        for _ in range(limit):
            sent = edges.join(colors, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.max("color").alias("sent"))
            now = kept(colors.join(sent, "id", "left").select("id", F.greatest("color", "sent").alias("color"), (F.col("sent") > F.col("color")).alias("moved")), "colors")
            moved = not now.where("moved").isEmpty()
            colors = now.drop("moved")
            if not moved:
                break
        within = edges.join(colors.select(F.col("id").alias("src"), F.col("color").alias("a")), "src").join(colors.select(F.col("id").alias("dst"), F.col("color").alias("b")), "dst").where("a = b").select("src", "dst")
        roots = colors.where("id = color").select("id")
        part = kept(dependents(within, roots, limit, small).select("id").distinct(), "component")
        found.append(part)
        gone = kept(part.unionByName(roots).distinct(), "gone")
        edges = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
        edges = trimmed(kept(edges.select("src", "dst"), "edges"), limit)
    return reduce(DataFrame.unionByName, found).distinct()


def recent(events: DataFrame, n: int = 5) -> DataFrame:
    """The last events of each file, newest first by append order."""
    order = Window.partitionBy("file").orderBy(F.desc("seq"))
    return events.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
