"""Graphs, checks, overviews, proposals and the command line on small folders; closures and components against brute force."""

from __future__ import annotations

import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from leafgraph import __main__ as cli
from leafgraph.operators import artifact, expand, graph, health, index, injection, plan, proposal, reports
from leafgraph.sources import extract, history, records, scratch, tree

DOCS = "path string, content string"


def folder(path, files):
    for name, text in files.items():
        target = path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


@pytest.fixture()
def skill(tmp_path):
    """A skill with a role, a worker, and a circle."""
    return folder(tmp_path, {
        "SKILL.md": "# Test Skill\n\nA test.\n@include shared/role.md\n@delegate agents/worker.md --parallel\n@delegate agents/other.md\n", "shared/role.md": "# Role\n\nYou are helpful.\nUse {{name}}.\n",
        "agents/worker.md": "# Worker\n\nDoes work.\n@include ../shared/role.md\n@ref ../gone.md\n", "agents/other.md": "---\nrisk: fragile\n---\n# Other\n@include ../shared/role.md\n@delegate worker.md\n@delegate other.md\n", "lone.md": "alone", "notes.txt": "x" * 2000, "x.pdf": b"%PDF", "~$lock.docx": "x", ".git/h.md": "x",
    })


def brute_reach(pairs, start):
    seen, left = set(), [start]
    while left:
        a = left.pop()
        for x, y in pairs:
            if x == a and y not in seen:
                seen.add(y)
                left.append(y)
    return seen


@pytest.mark.parametrize("small", [0, graph.SMALL])
def test_closures_and_cycles_equal_brute_force(spark, small):
    rng = random.Random(1)
    pairs = {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(16)} | {(f"c{i}", f"c{i + 1}") for i in range(6)}
    edges = spark.createDataFrame(sorted(pairs), "src string, dst string")
    ids = sorted({x for p in pairs for x in p})
    got = {(r["start"], r["id"]) for r in graph.closure(edges, spark.createDataFrame([(i,) for i in ids], "id string"), small=small).collect()}
    assert got == {(a, b) for a in ids for b in brute_reach(pairs, a)}
    assert {r["id"] for r in graph.cyclic_nodes(edges, small=small).collect()} == {a for a in ids if a in brute_reach(pairs, a)}
    assert graph.cyclic_nodes(edges.limit(0), small=small).count() == 0
    bounded = graph.closure(edges, spark.createDataFrame([("c0",)], "id string"), bound=3, small=small)
    assert {(r["id"], r["level"]) for r in bounded.collect()} == {("c1", 1), ("c2", 2), ("c3", 3)}


def test_components_of_random_graphs():
    rng = random.Random(7)
    for _ in range(300):
        n = rng.randrange(2, 9)
        pairs = {(str(rng.randrange(n)), str(rng.randrange(n))) for _ in range(rng.randrange(1, 14))}
        after = {}
        for a, b in sorted(pairs):
            after.setdefault(a, []).append(b)
        assert graph.strong(after) == {a for a in map(str, range(n)) if a in brute_reach(pairs, a)}


def test_build_warns_of_depth_circles_and_unreadable_files(spark):
    chain = [("SKILL.md", "@include level0.md")] + [(f"level{i}.md", f"@include level{i + 1}.md") for i in range(12)]
    docs = spark.createDataFrame([*chain, ("a.md", "@include b.md"), ("b.md", "@include a.md\n@include bad.md"), ("bad.md", None)], DOCS)
    entries = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    nodes, edges, warnings = graph.build(docs, entries("SKILL.md"))
    assert [(r["type"], r["path"]) for r in warnings.collect()] == [("depth_exceeded", "level10.md")]
    assert nodes.count() == 11 and edges.count() == 11
    nodes, edges, warnings = graph.build(docs, entries("a.md"))
    assert {(r["type"], r["message"]) for r in warnings.collect()} == {("circular", "Circular reference: a.md -> b.md -> a.md"), ("read_error", "not valid UTF-8")}
    assert nodes.where("id = 'bad.md' and title = '' and not missing").count() == 1
    nodes, edges, warnings = graph.build(docs.limit(0), entries().limit(0), root="r")
    assert [(r["type"], r["path"], r["message"]) for r in warnings.collect()] == [("missing", "r", "Neither SKILL.md nor deps.yml found")] and nodes.count() == 0


def test_plan_invariants(spark):
    rng = random.Random(3)
    made = {(f"t{a}", f"t{rng.randrange(a + 1, 12)}") for a in range(10) for _ in range(2)} | {("t11", "t10"), ("t10", "t11"), ("r", "t0"), ("r", "t3")}
    edges = spark.createDataFrame([(a, b, "delegate", False, 0) for a, b in sorted(made)] + [("t8", "doc", "include", False, 0), ("t9", "doc", "include", False, 0)], "src string, dst string, type string, parallel boolean, ord int")
    ids = edges.selectExpr("src id").union(edges.selectExpr("dst id")).distinct()
    out = plan.build_plan(index.compact(graph.bare(ids, F.lit(False)), edges), spark.createDataFrame([], "type string, path string, message string"))
    tasks = {r["task"]: (r["level"], set(r["depends_on"])) for r in out.tasks.collect()}
    pairs = {(r["src"], r["dst"]) for r in edges.collect()}
    assert set(tasks) == {b for _, b in made} and tasks["t10"][0] is None is tasks["t11"][0]
    for task, (level, needs) in tasks.items():
        assert needs == (brute_reach(pairs, task) & set(tasks)) - {task}
        deeper = [tasks[n][0] for n in needs if tasks[n][0] is not None]
        assert level is None or level == max(deeper, default=-1) + 1
    assert [r["message"] for r in out.cycles.collect()] == ["t10 <-> t11 (task cycle)"]
    doc = json.loads(plan.to_json(out, "r", "now").first()[0])
    assert doc["stats"]["tasks"] == len(tasks) and doc["tasks"]["t10"]["level"] is None and doc["batches"][0]["level"] == 0


def test_scan_allows_and_repeated_sources(spark):
    text = "System: a\n```\nUser: b"
    docs = spark.createDataFrame([("s", text), ("s", "Human : c\n" + text), ("t", text + "\n<!-- leafgraph-allow: x , all -->"), ("t", None), ("u", "<!-- other-allow: all -->\nAI: d")], "source string, text string")
    assert sorted((r["source"], r["line"]) for r in injection.scan(docs).collect()) == [("s", 1), ("s", 1), ("s", 2), ("u", 2)]
    assert [r["line"] for r in injection.scan(docs, prefix="other").where("source = 't'").collect()] == [1]
    assert injection.scan(docs, rules=("unknown",)).count() == 0 == injection.scan(docs, rules=()).count()
    attack = "ignore " + "previous " * 9000
    assert injection.scan(spark.createDataFrame([("s", attack)], "source string, text string"), rules=(*injection.DEFAULT_RULES, *injection.OPTIONAL_RULES)).count() == 0


def test_front_matter_round_trip():
    data = {"a": "x: y", "b": "", "c": " s ", "d": True, "e": None, "f": -3, "g": {}, "h": [], "i": {"j": {"k": "v"}}, "l": ["p", 2], "m": [{"n": "o", "q": 1}, {"n": "r"}]}
    assert records.front_matter_of(f"---\n{records.dump_front_matter(data)}\n---\nbody") == data
    assert records.front_matter_of("---\nx:\ny: {}\nz: []\n---\n") == {"x": None, "y": {}, "z": []}


def test_documents_of_every_kind(spark, tmp_path):
    root = folder(tmp_path, {"a.md": "A\r\nB", "b.txt": b"\xff", "c.json": "{}"})
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>1</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "e.docx").write_bytes(b"no zip")
    got = {r["path"]: r for r in extract.read_documents(spark, root, (".md", ".txt", ".docx")).collect()}
    assert got["a.md"]["content"] == "A\nB" and got["d.docx"]["content"] == "One\t1\nTwo"
    assert got["b.txt"]["content"] is None and "Unicode" in got["b.txt"]["problem"] and "BadZipFile" in got["e.docx"]["problem"]
    env = {"A": "kept"}
    (tmp_path / ".env").write_text("# x\nA=1\nB = 'two'\nnothing\n")
    extract.load_env(str(tmp_path / ".env"), env)
    assert env == {"A": "kept", "B": "two"}


def test_history(spark, tmp_path):
    assert history.git_changes(spark, str(tmp_path)).count() == 0
    files = history.with_counts(spark.createDataFrame([("hot.md",), ("cold.md",), ("new.md",)], "path string"), history.change_counts(spark.createDataFrame([("hot.md",)] * 4 + [("cold.md",)], "path string")))
    assert [r["path"] for r in files.orderBy("commits", "path").collect()] == ["new.md", "cold.md", "hot.md"]


def test_overview(spark, skill, tmp_path):
    rows = scratch.kept(tree.files(spark, skill))
    text = artifact.generate(rows, skill, generated_at="now")
    front = records.front_matter_of(text)
    assert front["stats"] == {"files": 7, "markdown": 5, "binary": 1, "total_bytes": front["stats"]["total_bytes"], "edges": 8, "cycles": 1, "missing": 1}
    assert [c["id"] for c in front["chunks"]] == ["summary", "folder-map", "files", "deps", "placeholders"] and front["placeholders"] == ["name"]
    assert "- [skill] SKILL.md — Test Skill\n  A test.\n  deps: include→shared/role.md, delegate→agents/worker.md (parallel), delegate→agents/other.md" in text
    assert "├── agents/\n│   ├── other.md\n│   └── worker.md\n├── shared/\n│   └── role.md\n├── lone.md" in text
    assert artifact.write(skill, text)[1] and not artifact.write(skill, text)[1]
    again = artifact.generate(scratch.kept(tree.files(spark, skill)), skill, generated_at="later")
    assert records.front_matter_of(again)["content_hash"] == front["content_hash"]
    assert records.front_matter_of(artifact.generate(rows, skill, counts=history.change_counts(rows.limit(0).select("path"))))["content_hash"] != front["content_hash"]
    other = folder(tmp_path / "o", {artifact.H.ARTIFACT: "mine"})
    with pytest.raises(ValueError, match="not made by"):
        artifact.write(other, text)
    assert artifact.write(other, text, force=True)[1]
    few = artifact.generate(rows, skill, max_files=2, deps=False, folder_map=False)
    assert "_…5 files omitted (max_files=2)" in few and "## Dependency Tree" not in few
    said = artifact.push(os.path.join(other, artifact.H.ARTIFACT), lambda url, path: {"task_id": "t", "successful_files": 1})
    assert (said["task_id"], said["successful_files"], said["failed_files"]) == ("t", 1, 0)


@pytest.mark.parametrize(("shared", "agents"), [(2, 1), (25, 5)])
def test_digest_and_overview_are_smaller_than_the_files(spark, tmp_path, shared, agents):
    body = "\n\n".join(["Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."] * 16)
    files = {f"shared/s{i}.md": f"# Shared {i}\n\n{body}\n" for i in range(shared)} | {f"agents/a{i}.md": f"# Agent {i}\n\n{body}\n" for i in range(agents)}
    files["SKILL.md"] = "# Root\n\n" + "".join(f"@include shared/s{i}.md\n" for i in range(shared)) + "".join(f"@delegate agents/a{i}.md\n" for i in range(agents)) + body
    root = folder(tmp_path, files)
    rows = scratch.kept(tree.files(spark, root))
    made = index.build(rows)
    naive = sum(map(len, files.values()))
    digest = len(reports.text_of(reports.digest_lines(*made)).first()[0])
    assert digest < naive
    assert len(artifact.generate(rows, root, made)) < naive * (5 if shared == 2 else 1)


def test_guards_equal_brute_force(spark):
    rng = random.Random(4)
    existing = sorted({(f"n{rng.randrange(7)}", f"n{rng.randrange(7)}") for _ in range(5)})
    wanted = [(f"n{rng.randrange(7)}", f"n{rng.randrange(7)}", rng.choice(["include", "include", "ref", "odd"]), "", i) for i in range(14)]
    want, adj = {}, set(existing)
    for a, b, kind, _, i in sorted(wanted, key=lambda e: (e[0], e[1], e[4])):
        if kind != "ref":
            kind = "ref" if a == b or a in brute_reach(adj, b) else "include"
            adj |= {(a, b)} if kind == "include" else set()
        want[i] = kind
    got = proposal.guarded(spark.createDataFrame(wanted, "from string, to string, kind string, reason string, ord int"), spark.createDataFrame(existing, "src string, dst string"))
    assert {r["ord"]: r["kind"] for r in got.collect()} == want


def test_an_answer_is_applied(spark, skill):
    said = {"edges": [{"from": "lone.md", "to": "shared/role.md", "kind": "include", "reason": "r"}, {"from": "x.pdf", "to": "lone.md", "reason": "why"}, {"from": "shared/role.md", "to": "SKILL.md", "kind": "include"}, {"from": "none.md", "to": "lone.md"}], "shared_proposals": []}
    docs = extract.summaries(tree.files(spark, skill).where("path like '%.md'").select("path", "content"))
    asked = []

    def caller(user, system):
        asked.append((user, system))
        return f"```json\n{json.dumps(said)}\n```"

    edges, shared = proposal.analyze(docs, caller)
    assert "### shared/role.md\n```\n# Role" in asked[0][0] and asked[0][1].startswith("You ")
    changed, declared = proposal.apply(spark, skill, edges, shared)
    assert changed == ["lone.md", "shared/role.md"]
    read = lambda name: open(os.path.join(skill, name), encoding="utf-8").read()
    assert read("lone.md") == "@include shared/role.md\n\nalone" and read("shared/role.md").startswith("@ref SKILL.md\n\n# Role")
    assert declared and read("deps.yml") == '# dependency manifest — auto-generated, hand-editable\nfiles:\n  - path: "x.pdf"\n    includes:\n      - "lone.md"  # why\n'
    assert proposal.apply(spark, skill, edges, shared)[0] == []
    nodes, _, _ = graph.build(docs, docs.where("path = 'SKILL.md'").selectExpr("path id"), declared=tree.declared(tree.files(spark, skill).where("path = 'deps.yml'")), files=tree.files(spark, skill))
    assert {(r["id"], r["type"]) for r in nodes.where("id in ('x.pdf', 'lone.md')").collect()} == {("x.pdf", "document"), ("lone.md", "document")}
    with pytest.raises(Exception, match="not JSON"):
        proposal.parse_answers(spark.createDataFrame([("{nope",)], "answer string"))[0].collect()


def test_index_is_saved_cached_scoped_and_merged(spark, skill, tmp_path):
    rows = scratch.kept(tree.files(spark, skill))
    files, warnings = index.build(rows)
    path = os.path.join(skill, ".leafgraph", "index.json")
    index.write_json(index.to_json(files, warnings, skill, "now"), path)
    doc = json.loads(open(path, encoding="utf-8").read())
    assert doc["stats"]["files"] == 5 and doc["files"]["shared/role.md"]["placeholders"] == ["name"] and "missing" not in doc["files"]["SKILL.md"] and doc["missing"] == ["gone.md"]
    assert index.stale(index.from_json(spark, path)[0], rows).count() == 0
    assert sorted(index.cached(spark, rows, path)[0].drop("deps").collect()) == sorted(files.drop("deps").collect())
    (tmp_path / "shared" / "role.md").write_text("# New role\n")
    fresh = scratch.kept(tree.files(spark, skill))
    assert [tuple(r) for r in index.stale(files, fresh).collect()] == [("shared/role.md", "changed")]
    assert index.cached(spark, fresh, path)[0].where("title = 'New role'").count() == 1
    with pytest.raises(ValueError, match="no files below"):
        index.build_scoped(fresh, "nowhere")
    open(path, "w", encoding="utf-8").write(json.dumps(doc | {"schema": 9}))
    with pytest.raises(Exception, match="unknown index schema"):
        index.from_json(spark, path)[0].collect()
    assert index.cached(spark, fresh, path)[0].count() == 5


def test_command_line(spark, skill, capsys, tmp_path):
    def run(*argv):
        code = cli.run(list(argv), spark)
        out = capsys.readouterr()
        return code, out.out, out.err

    code, out, _ = run("check", skill, "--check", "orphans")
    assert code == 1 and out.endswith("[WARNING] orphan-file: lone.md — file is not referenced by any node\n")
    assert run("index", skill)[1].endswith("5 files, 8 edges, 1 cycles, 1 missing\n")
    assert run("affects", skill, "shared/role.md")[1].split() == ["SKILL.md", "agents/other.md", "agents/worker.md"]
    assert run("deps", skill, "SKILL.md")[1].splitlines()[1] == "delegate\tagents/worker.md --parallel"
    assert run("tree", skill, "--max-depth", "1")[1].splitlines()[2] == "├── [delegate‖] agents/worker.md — Worker"
    code, out, _ = run("plan", skill, "--ascii", "--json")
    assert "Level 0 (parallel)" not in out and json.loads(out[out.index("{") :])["stats"]["tasks"] == 2
    code, out, _ = run("resolve", os.path.join(skill, "SKILL.md"), "--var", "name=N")
    assert code == 0 and "Use N." in out and "@delegate agents/worker.md --parallel" in out
    assert run("ledger", "add", skill, "agents/worker.md", "--tag", "fix-failed", "--note", "n")[0] == 0 and run("ledger", "clear", skill, "agents/worker.md")[0] == 2
    code, out, _ = run("risk", skill, "agents/worker.md")
    assert code == 1 and out.startswith("agents/worker.md — affects 2 files; active risk: fix-failed (high)")
    assert json.loads(run("risk", skill, "agents/other.md", "--json")[1])["active_tags"] == ["fragile"]
    assert run("analyze", skill, "--dry-run")[1].count("=" * 60) == 2 and "- `x.pdf`" in run("analyze", skill, "--plan")[1]
    assert "## by extension" in run("inventory", skill)[1] and run("overview", skill)[0] == 0
    assert run("stability", os.path.join(skill, "SKILL.md"), os.path.join(skill, "SKILL.md"))[1] == "prefix stable: 7/7 lines (1.0)\n"
    assert run(skill, "--quiet")[1].startswith("Nodes: 5") and run("init", str(tmp_path))[0] == 0 and run("init", str(tmp_path))[0] == 1
    assert run("digest", str(tmp_path / "none"))[0] == 2


def test_hints(spark):
    said = lambda *names: health.totals(spark.createDataFrame([(n, 1) for n in names], "path string, bytes long")).select(reports.hint()).first()[0]
    assert said("a.md", "b.pdf") is None and said("b.pdf") == reports.HINTS["binary"] and said("b.txt") == reports.HINTS["text"]
    assert said("a.md", *(f"{i}.pdf" for i in range(30))).startswith("only 1/31 files")
    assert health.totals(spark.createDataFrame([], "path string, bytes long")).select(reports.hint()).first()[0] is None


def test_walks_stop_at_circles(spark):
    edges = spark.createDataFrame([("a", "b", "include", False, 0), ("b", "a", "ref", False, 0), ("a", "c", "delegate", True, 1)], "src string, dst string, type string, parallel boolean, ord int")
    got = expand.tree(edges, spark.createDataFrame([("a",)], "id string"))
    files = spark.createDataFrame([("a", "A", False), ("b", "", False)], "path string, title string, missing boolean")
    assert reports.text_of(reports.tree_lines(got, files)).first()[0] == "a — A\n├── [include] b\n│   └── [ref] a — A  [cycle]\n└── [delegate‖] c [MISSING]"
