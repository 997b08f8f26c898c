"""The command line: ``python -m leafgraph COMMAND PATH ...``.  A path alone shows the graph.

Exit codes: 0 good, 1 a gate failed or something was refused, 2 wrong use.
"""

from __future__ import annotations

import argparse
import datetime
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.operators import artifact, expand, injection, proposal
from leafgraph.operators import graph as G
from leafgraph.operators import health as H
from leafgraph.operators import index as I
from leafgraph.operators import plan as P
from leafgraph.operators import reports as R
from leafgraph.sources import extract, history, records, tree
from leafgraph.sources.scratch import kept, scratch

INDEX, LEDGER = ".leafgraph/index.json", ".leafgraph/ledger"
SKILL = ".claude/skills/leafgraph/SKILL.md"
_EVENTS = "seq decimal(38,0), ts string, file string, action string, tag string, note string"


def session() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.log.level": "ERROR"}
        spark = SparkSession.builder.master(os.environ.get("SPARK_MASTER", "local[*]")).config(map=conf).getOrCreate()
    return spark


def now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class Folder:
    """A folder, or the folder of a file that is the entry."""

    def __init__(self, spark: SparkSession, path: str):
        if not os.path.exists(path):
            raise ValueError(f"path does not exist: {path}")
        self.spark, self.root = spark, path if os.path.isdir(path) else os.path.dirname(path) or "."
        self.entry = None if os.path.isdir(path) else os.path.basename(path)
        self.rows = kept(tree.files(spark, self.root), "tree")

    def docs(self) -> DataFrame:
        return self.rows.where(F.endswith("path", F.lit(".md"))).select("path", "content")

    def graph(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        declared = tree.declared(self.rows.where(F.col("path") == tree.DEPENDENCY_FILE).select("path", "content"))
        entry = tree.entry(self.rows) if self.entry is None else self.spark.createDataFrame([(self.entry,)], "path string")
        return tuple(kept(x, "graph") for x in G.build(self.docs(), entry.select(F.col("path").alias("id")), declared=None if declared.isEmpty() else declared, files=self.rows, root=self.root))

    def index(self, cache: bool = True) -> tuple[DataFrame, DataFrame]:
        if cache and self.entry is None:
            files, warnings = I.cached(self.spark, self.rows, os.path.join(self.root, INDEX))
        else:
            nodes, edges, warnings = self.graph()
            files = I.compact(nodes, edges)
        return kept(files, "index"), kept(warnings, "warnings")

    def hint(self, files: DataFrame) -> None:
        if files.isEmpty() and (said := H.totals(self.rows).select(R.hint()).first()[0]):
            print(f"warning: {said}", file=sys.stderr)

    def events(self) -> DataFrame:
        path = os.path.join(self.root, LEDGER)
        return records.ledger(self.spark, path) if os.path.isdir(path) and any(n.startswith("part") for n in os.listdir(path)) else self.spark.createDataFrame([], _EVENTS)


def show(df: DataFrame) -> None:
    for r in df.toLocalIterator():
        print(r[0])


def report(lines: DataFrame) -> None:
    print(R.text_of(lines).first()[0])


def say(doc: str, out: str | None) -> None:
    if out:
        with open(out, "w", encoding="utf-8") as f:
            f.write(doc + "\n")
    else:
        print(doc)


def pretty(doc: str) -> str:
    return json.dumps(json.loads(doc), ensure_ascii=False, indent=2)


def init(spark, a) -> int:
    target = os.path.join(a.path, SKILL)
    if os.path.exists(target) and not a.force:
        print(f"error: {target} is there already; --force replaces it", file=sys.stderr)
        return 1
    os.makedirs(os.path.dirname(target), exist_ok=True)
    say(extract.template("SKILL.md").rstrip(), target)
    print(f"Installed skill: {target}")
    return 0


def index(spark, a) -> int:
    f, path = Folder(spark, a.path), a.out or os.path.join(a.path, INDEX)
    files, warnings = f.index(cache=False) if not a.scope else I.build_scoped(f.rows, a.scope)
    if a.scope and os.path.exists(path):
        files, warnings = I.merge(I.from_json(spark, path), (files, warnings), a.scope)
    files, warnings = kept(files, "index"), kept(warnings, "warnings")
    I.write_json(I.to_json(files, warnings, os.path.abspath(f.root), now()), path)
    n = I.stats(files, warnings).first()
    print(f"Wrote {path} — {n['files']} files, {n['edges']} edges, {n['cycles']} cycles, {n['missing']} missing")
    f.hint(files)
    return 0


def check(spark, a) -> int:
    f = Folder(spark, a.path)
    nodes, edges, warnings = f.graph()
    found = kept(H.run_checks(nodes, edges, warnings, f.rows if a.check else None), "findings")
    n = nodes.count(), edges.count()
    made = {"text": lambda: R.text_of(R.check_lines(found, *n)), "json": lambda: R.check_json(found, os.path.abspath(f.root), *n), "sarif": lambda: R.sarif(found)}[a.format]().first()[0]
    say(made if a.format == "text" else pretty(made), a.out)
    return R.exit_code(found, a.fail_on)


def affects(spark, a) -> int:
    files, _ = Folder(spark, a.path).index(not a.no_cache)
    show(G.dependents(I.edges_of(files), spark.createDataFrame([(a.file,)], "id string")).orderBy("level", "id").select("id"))
    return 0


def deps(spark, a) -> int:
    files, _ = Folder(spark, a.path).index(not a.no_cache)
    show(I.edges_of(files.where(F.col("path") == a.file)).orderBy("ord").select(F.concat("type", F.lit("\t"), "dst", F.when(F.col("parallel"), " --parallel").otherwise(""))))
    return 0


def digest(spark, a) -> int:
    f = Folder(spark, a.path)
    files, warnings = f.index(not a.no_cache)
    report(R.digest_lines(files, warnings))
    f.hint(files)
    return 0


def show_tree(spark, a) -> int:
    files, _ = Folder(spark, a.path).index(not a.no_cache)
    if files.isEmpty():
        print("(empty index)")
        return 0
    root = files.select(F.col("path").alias("id"), (F.col("type") != "skill").alias("rank")).orderBy("rank", "id").limit(1).select("id")
    root = spark.createDataFrame([(a.root,)], "id string") if a.root else root
    report(R.tree_lines(expand.tree(I.edges_of(files), root, a.max_depth), files))
    return 0


def plan(spark, a) -> int:
    f = Folder(spark, a.path)
    files, warnings = f.index(not a.no_cache)
    made = P.build_plan(files, warnings)
    if a.ascii:
        report(R.plan_lines(made))
    if a.out or a.json or not a.ascii:
        say(pretty(P.to_json(made, os.path.abspath(f.root), now()).first()[0]), a.out)
    f.hint(files)
    n = P.counts(made).first()
    return int(a.strict and bool(n["cycles"] or n["conflicts"]))


def resolve(spark, a) -> int:
    f = Folder(spark, a.file)
    pairs = dict(kv.split("=", 1) for kv in a.var or [] if "=" in kv)
    for kv in a.var or []:
        if "=" not in kv:
            print(f"warning: {kv} is not key=value", file=sys.stderr)
    entry = spark.createDataFrame([(f.entry,)], "id string")
    out, warnings, found = expand.expand(f.docs(), entry, pairs, not a.no_scan, injection.rules_with(tuple(a.scan_rule or ())), a.block)
    print(out.first()["content"])
    for w in warnings.orderBy("type", "path", "message").toLocalIterator():
        print(f"[{w['type'].upper()}] {w['message']}", file=sys.stderr)
    for x in found.orderBy("source", "line", "rule").toLocalIterator():
        print(f"[INJECTION {x['rule']}] {x['source']}:{x['line']} — {x['message']}", file=sys.stderr)
    return 0


def ledger(spark, a) -> int:
    tag = a.tag if a.action == "add" or not a.all else "all"
    if not tag:
        print("error: ledger clear needs --tag or --all", file=sys.stderr)
        return 2
    row = spark.createDataFrame([(None, a.file, a.action, tag, getattr(a, "note", None))], "ts string, file string, action string, tag string, note string")
    records.append_events(row, os.path.join(a.path, LEDGER))
    print(f"ledger: {a.action} {tag} -> {a.file}", file=sys.stderr)
    return 0


def risk(spark, a) -> int:
    f = Folder(spark, a.path)
    files, _ = f.index()
    static = H.static_tags(records.front_matter(f.docs().where(F.col("path") == a.file)))
    made = kept(H.risk_report(spark.createDataFrame([(a.file,)], "path string"), I.edges_of(files), f.events(), static), "risk")
    if a.json:
        print(pretty(made.select(F.to_json(F.struct("*"))).first()[0]))
    else:
        report(R.risk_lines(made))
    r = made.first()
    return int({"never": False, "any": bool(r["active_tags"])}.get(a.fail_on, r["level"] == "high"))


def analyze(spark, a) -> int:
    extensions = tuple(e if e.startswith(".") else f".{e}" for e in a.ext) if a.ext else None
    if a.plan:
        paths = tree.document_paths(tree.files(spark, a.path, read=False), extensions or tree.LISTED)
        report(proposal.host_plan_lines(paths.select("path"), a.path))
        return 0
    docs = kept(extract.summaries(extract.read_documents(spark, a.path, extensions or tree.SCANNED)), "documents")
    if a.dry_run:
        estimate = H.cost_estimate(docs, a.model, spark.createDataFrame([], "model string, input_price double, output_price double"), "content")
        if a.json:
            print(pretty(estimate.select(F.to_json(F.struct("*"))).first()[0]))
        else:
            report(R.cost_lines(estimate))
        return 0
    if not a.apply_from:
        print("error: no model is called from here; use --plan, then --apply-from with the answer", file=sys.stderr)
        return 2
    if not os.path.exists(a.apply_from):
        print(f"error: file not found: {a.apply_from}", file=sys.stderr)
        return 2
    with open(a.apply_from, encoding="utf-8") as file:
        answer = file.read()
    try:
        json.loads(answer)
    except ValueError as e:
        print(f"error: invalid JSON in {a.apply_from}: {e}", file=sys.stderr)
        return 1
    edges, shared = (kept(x, "answer") for x in proposal.parse_answers(spark.createDataFrame([(answer,)], "answer string")))
    report(proposal.proposal_lines(edges, shared, docs.count()))
    if a.apply:
        changed, declared = proposal.apply(spark, a.path, edges, shared, a.max_include_bytes)
        print(f"Changed {len(changed)} file(s): {', '.join(changed)}" if changed else "No text was changed.")
        if declared:
            print(f"Wrote {declared}")
        report(R.summary_lines(*Folder(spark, a.path).graph()))
    return 0


def inventory(spark, a) -> int:
    rows = kept(Folder(spark, a.path).rows.select("path", "bytes"), "files")
    if a.json:
        print(pretty(H.totals(rows).select(F.to_json(F.struct("*"))).first()[0]))
    else:
        report(R.inventory_lines(rows, os.path.abspath(a.path)))
    return 0


def overview(spark, a) -> int:
    f = Folder(spark, a.path)
    counts = history.change_counts(history.git_changes(spark, f.root)) if a.order == "cache" else None
    text = artifact.generate(f.rows, os.path.abspath(f.root), max_files=a.max_files, folder_map=not a.no_folder_map, deps=not a.no_deps, aggregate=a.aggregate, counts=counts)
    if a.stdout:
        print(text, end="")
        return 0
    try:
        path, written = artifact.write(f.root, text, a.force)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(f"Wrote {path}" if written else f"{path} unchanged (content_hash matches).")
    return 0


def stability(spark, a) -> int:
    texts = []
    for path in (a.old, a.new):
        with open(path, encoding="utf-8") as f:
            texts.append(f.read())
    common, lines, ratio = history.prefix_stability(F.col("old"), F.col("new"))
    r = spark.createDataFrame([tuple(texts)], "old string, new string").select(common.alias("common_prefix_lines"), lines.alias("new_lines"), ratio.alias("ratio")).first()
    print(json.dumps(r.asDict(), indent=2) if a.json else f"prefix stable: {r['common_prefix_lines']}/{r['new_lines']} lines ({r['ratio']})")
    return 0


def show_graph(spark, a) -> int:
    nodes, edges, warnings = Folder(spark, a.path).graph()
    report(R.summary_lines(nodes, edges, warnings))
    if not a.quiet:
        listed = lambda df: [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).toLocalIterator()]
        print("\n--- JSON ---\n" + json.dumps({"nodes": listed(nodes), "edges": listed(edges), "warnings": listed(warnings)}, ensure_ascii=False, indent=2))
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="leafgraph", description=__doc__.splitlines()[0])
    sub = out.add_subparsers(dest="command", required=True)

    def add(name, run, *positional, into=sub):
        p = into.add_parser(name)
        p.set_defaults(run=run)
        for x in positional:
            p.add_argument(x)
        return p

    def flags(p, *names):
        for n in names:
            p.add_argument(n, action="store_true")
        return p

    p = flags(add("init", init), "--force")
    p.add_argument("path", nargs="?", default=".")
    p = add("index", index, "path")
    p.add_argument("--scope")
    p.add_argument("--out")
    p = add("check", check, "path")
    p.add_argument("--format", choices=["text", "json", "sarif"], default="text")
    p.add_argument("--fail-on", choices=["error", "warning", "never"], default="error")
    p.add_argument("--check", action="append", choices=["orphans"])
    p.add_argument("--out")
    flags(add("affects", affects, "path", "file"), "--no-cache")
    flags(add("deps", deps, "path", "file"), "--no-cache")
    flags(add("digest", digest, "path"), "--no-cache")
    p = flags(add("tree", show_tree, "path"), "--no-cache")
    p.add_argument("--root")
    p.add_argument("--max-depth", type=int, default=R.TREE_DEPTH)
    flags(add("plan", plan, "path"), "--json", "--ascii", "--no-cache", "--strict").add_argument("--out")
    p = flags(add("resolve", resolve, "file"), "--no-scan", "--block")
    p.add_argument("--var", action="append")
    p.add_argument("--scan-rule", action="append", choices=[*injection.DEFAULT_RULES, *injection.OPTIONAL_RULES])
    kinds = sub.add_parser("ledger").add_subparsers(dest="action", required=True)
    p = add("add", ledger, "path", "file", into=kinds)
    p.add_argument("--tag", required=True, choices=H.RISK_TAGS)
    p.add_argument("--note")
    flags(add("clear", ledger, "path", "file", into=kinds), "--all").add_argument("--tag", choices=H.RISK_TAGS)
    flags(add("risk", risk, "path", "file"), "--json").add_argument("--fail-on", choices=["high", "any", "never"], default="high")
    p = flags(add("analyze", analyze, "path"), "--apply", "--json", "--plan", "--dry-run")
    p.add_argument("--ext", action="append")
    p.add_argument("--model", default="unknown")
    p.add_argument("--apply-from")
    p.add_argument("--max-include-bytes", type=int)
    flags(add("inventory", inventory, "path"), "--json")
    p = flags(add("overview", overview, "path"), "--stdout", "--force", "--no-folder-map", "--no-deps", "--aggregate")
    p.add_argument("--max-files", type=int, default=artifact.MAX_FILES)
    p.add_argument("--order", choices=["alpha", "cache"], default="alpha")
    flags(add("stability", stability, "old", "new"), "--json")
    flags(add("show", show_graph, "path"), "--quiet")
    return out


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    made = parser()
    names = next(a for a in made._actions if isinstance(a, argparse._SubParsersAction)).choices
    if not argv or argv[0] not in names and not argv[0].startswith("-"):
        argv = ["show", *(argv or ["."])]
    args = made.parse_args(argv)
    spark = spark or session()
    try:
        with scratch(spark):
            return args.run(spark, args)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
