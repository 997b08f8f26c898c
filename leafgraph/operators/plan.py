"""The parallel plan over delegation targets: tables of tasks, needs, levels, conflicts, cycles and contexts from one closure, and its document."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.operators import graph as G
from leafgraph.operators import index as I
from leafgraph.sources.scratch import kept

# The document's schema and its warnings.
PLAN_SCHEMA = "leafgraph-plan/v1"
NO_TASKS, GONE, TASK_CYCLE = "no @delegate directives found", "delegate target missing: ", " (task cycle)"


class Plan(NamedTuple):
    """tasks (task, title, type, parallel, level, depends_on), contexts (task, path, type, title), conflicts (a, b, level, shared), cycles (message), warnings (message)."""

    tasks: DataFrame
    contexts: DataFrame
    conflicts: DataFrame
    cycles: DataFrame
    warnings: DataFrame


def build_plan(files: DataFrame, warnings: DataFrame) -> Plan:
    """The plan of an index.  Tasks on a cycle have a null level; a target that is no file of the index has an empty title and is an agent."""
    edges = kept(I.edges_of(files), "plan-edges")
    reach = G.reach_of_tasks(edges)
    flags = kept(G.tasks(edges), "plan-tasks")
    dag = kept(G.task_dag(edges, reach), "plan-needs")
    leveled = kept(G.levels(flags, dag), "plan-levels")
    known = files.select("path", "type", "title", "missing")
    needs = dag.groupBy("task").agg(F.array_sort(F.collect_set("needs")).alias("depends_on"))
    rows = flags.join(leveled, "task", "left").join(needs, "task", "left").join(known.withColumnRenamed("path", "task"), "task", "left")
    tasks = kept(rows.select("task", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("type", F.lit("agent")).alias("type"), "parallel", "level", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"), F.coalesce("missing", F.lit(True)).alias("gone")), "plan")
    contexts = reach.join(known.select(F.col("path").alias("id"), "type", "title"), "id").select("task", F.col("id").alias("path"), "type", "title")
    loops = G.mutual_pairs(dag).select(F.concat("a", F.lit(" <-> "), "b", F.lit(TASK_CYCLE)).alias("message"))
    cycles = warnings.where("type = 'circular'").select("message").distinct().unionByName(loops)
    said = tasks.where("gone").select(F.concat(F.lit(GONE), "task").alias("message"))
    none = flags.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(NO_TASKS).alias("message"))
    return Plan(tasks.drop("gone"), contexts, G.conflicts(edges, leveled, reach), cycles, none.unionByName(said))


def batches(plan: Plan) -> DataFrame:
    """(level, parallelizable, tasks) of each level."""
    return plan.tasks.where("level is not null").groupBy("level").agg(F.array_sort(F.collect_list("task")).alias("tasks")).select("level", (F.size("tasks") > 1).alias("parallelizable"), "tasks")


def counts(plan: Plan) -> DataFrame:
    """One row: tasks, batches, conflicts, cycles."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    made = plan.tasks.agg(F.count("*").alias("tasks"), F.count_distinct("level").alias("batches"))
    return made.crossJoin(n(plan.conflicts, "conflicts")).crossJoin(n(plan.cycles, "cycles"))  # one row on each side


def to_json(plan: Plan, root: str, generated_at: str) -> DataFrame:
    """One row with the plan as a JSON document."""
    context = plan.contexts.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("path", "type", "title"))).alias("context"))
    entry = F.struct("title", "type", F.col("parallel").alias("parallel_flag"), "depends_on", F.coalesce("context", F.array().cast("array<struct<path: string, type: string, title: string>>")).alias("context"), "level")
    listed = lambda df, x, name: df.agg(F.array_sort(F.collect_list(x)).alias(name))
    tasks = plan.tasks.join(context, "task", "left").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("task", entry.alias("e"))))).alias("tasks_of"))
    row = counts(plan).crossJoin(listed(batches(plan), F.struct("level", "parallelizable", "tasks"), "levels")).crossJoin(tasks)
    row = row.crossJoin(listed(plan.conflicts, F.struct("level", F.array("a", "b").alias("between"), "shared"), "clashes")).crossJoin(listed(plan.cycles, "message", "loops")).crossJoin(listed(plan.warnings, "message", "said"))  # one row on each side
    stats = F.struct("tasks", "batches", "conflicts", "cycles").alias("stats")
    doc = F.struct(F.lit(PLAN_SCHEMA).alias("schema"), F.lit(generated_at).alias("generated_at"), F.lit(root).alias("root"), stats, F.col("levels").alias("batches"), F.col("tasks_of").alias("tasks"), F.col("clashes").alias("conflicts"), F.col("loops").alias("cycles"), F.col("said").alias("warnings"))
    return row.select(F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))
