"""Include expansion: texts become ordered pieces, and a round replaces all included pieces of one depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.functions import text as X
from leafgraph.operators import injection
from leafgraph.operators.graph import CIRCULAR, DEEP, MAX_DEPTH, MISSING, UNREADABLE, together
from leafgraph.sources.scratch import kept

#: Noncharacters, which texts for interchange don't hold: around a directive, and between its fields.
MARK, FIELD = "﷐", "﷑"


def _pieces(content, path):
    """Literal pieces and, in their places, the resolved targets of includes."""
    marked = F.regexp_replace(content, X.DIRECTIVE, f"{MARK}$1{FIELD}$2{FIELD}$0{MARK}")

    def piece(part, i):
        fields = F.split(part, FIELD, 3)
        directive = i % 2 == 1
        include = directive & (fields[0] == "include")
        return F.struct(F.when(include, X.resolve_path(path, fields[1])).alias("target"), F.when(include, "").when(directive, F.get(fields, F.lit(2))).otherwise(part).alias("text"))

    return F.transform(F.split(marked, MARK, -1), piece)


def expand(docs: DataFrame, entries: DataFrame, variables: dict[str, str] | None = None, scan: bool = True, rules: tuple[str, ...] = injection.DEFAULT_RULES, block: bool = False, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, content, placeholders) of each entry, its warnings (id, type, path, message), and the injections found.

    Only includes are replaced; too deep, circular, missing and unreadable targets become nothing and a warning.  Included
    texts are scanned; with ``block`` a flagged one becomes a comment.
    """
    docs = docs.select("path", "content")
    none = F.array().cast("array<string>")
    pending = kept(entries.select("id", F.array().cast("array<int>").alias("place"), F.col("id").alias("target"), none.alias("stack")).distinct())
    done = warnings = found = None
    add = lambda a, b: b if a is None else a.unionByName(b)
    for depth in range(max_depth + 2):
        rows = pending.join(docs.withColumnRenamed("path", "target").withColumn("there", F.lit(True)), "target", "left")
        chain = F.concat_ws(" -> ", "stack", F.array("target"))
        kind = F.when(F.lit(depth > max_depth), "depth_exceeded").when(F.array_contains("stack", F.col("target")), "circular").when(F.col("there").isNull(), "missing").when(F.col("content").isNull(), "read_error")
        message = F.when(kind == "circular", F.concat(F.lit(CIRCULAR), chain)).when(kind == "missing", F.concat(F.lit(MISSING["walk"]), "target")).when(kind == "depth_exceeded", DEEP.format(max_depth)).otherwise(UNREADABLE)
        rows = kept(rows.withColumns({"kind": kind, "message": message}))
        warnings = add(warnings, rows.where("kind is not null").select("id", F.col("kind").alias("type"), F.col("target").alias("path"), "message"))
        rows = rows.where("kind is null")
        if scan and depth:
            flagged = kept(injection.scan(rows.select("target", "content").distinct(), "target", "content", rules))
            found = add(found, flagged)
            if block:
                named = flagged.groupBy(F.col("source").alias("target")).agg(F.array_join(F.array_sort(F.collect_set("rule")), ", ").alias("named"))
                comment = F.concat(F.lit("<!-- blocked injection ("), "named", F.lit(") from "), "target", F.lit(" -->"))
                rows = rows.join(named, "target", "left")
                done = add(done, rows.where("named is not null").select("id", "place", comment.alias("text")))
                rows = rows.where("named is null")
        rows = rows.select("id", "place", F.concat("stack", F.array("target")).alias("stack"), F.posexplode(_pieces(F.col("content"), F.col("target"))).alias("i", "p"))
        rows = kept(rows.select("id", F.concat("place", F.array("i")).alias("place"), "stack", "p.target", "p.text"))
        done = add(done, rows.where("target is null").select("id", "place", "text"))
        pending = rows.where("target is not null").select("id", "place", "target", "stack")
        if pending.isEmpty():
            break
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "")
    out = entries.select("id").distinct().join(done.groupBy("id").agg(text.alias("content")), "id", "left").withColumn("content", X.substitute(F.coalesce("content", F.lit("")), variables or {}))
    if found is None:
        found = injection.scan(docs.limit(0), "path", "content", rules)
    return out.withColumn("placeholders", X.placeholders(F.col("content"))), warnings.distinct(), found.distinct()


def tree(edges: DataFrame, roots: DataFrame, max_depth: int = 6) -> DataFrame:
    """(root, path, id, depth, kind, parallel, cycle, places, lasts): every walk from the roots; one that meets itself ends there, marked.

    ``places`` are the positions among siblings on the way down, ``lasts`` whether each was the last of them.
    """
    order = Window.partitionBy("src").orderBy("ord", "dst", "type", "parallel")
    step = edges.select("src", "dst", "type", "parallel", F.row_number().over(order).alias("place"))
    step = kept(step.join(step.groupBy("src").agg(F.max("place").alias("n")), "src").select("src", "dst", "type", "parallel", "place", (F.col("place") == F.col("n")).alias("last")), "step")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    front = kept(roots.select(F.col("id").alias("root"), F.array("id").alias("path"), "id", F.lit(0).alias("depth"), F.lit("").alias("kind"), F.lit(False).alias("parallel"), F.lit(False).alias("cycle"), none("int").alias("places"), none("boolean").alias("lasts")), "walks")
    out = [front]
    for depth in range(1, max_depth + 1):
        rows = front.where("not cycle").drop("parallel").join(step, F.col("id") == F.col("src"))
        front = kept(rows.select("root", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("id"), F.lit(depth).alias("depth"), F.col("type").alias("kind"), "parallel", F.array_contains("path", F.col("dst")).alias("cycle"), F.concat("places", F.array("place")).alias("places"), F.concat("lasts", F.array("last")).alias("lasts")), "walks")
        if front.isEmpty():
            break
        out.append(front)
    return together(out)
