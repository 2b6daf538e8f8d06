import json
import random
import re
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.agent import Agent, shown
from siltstone.functions import errors, text
from siltstone.operators import context, graph, resolve, search, store
from siltstone.operators.index import SearchIndex
from siltstone.plans.views import Tables
from siltstone.session import CodeEngine, Route
from siltstone.sources import files
from siltstone.streaming import ingest
from tests.test_parsing import CPP, CS, PY, XAML


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    for name, body in {"pkg/mod.py": PY, "lib/Engine.cs": CS, "lib/shape.cpp": CPP, "ui/Main.xaml": XAML, "ui/Main.xaml.cs": "class X {}", ".git/a.py": "x = 1", "build/b.py": "x = 1", "notes.txt": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    (root / "pkg/old.py").write_bytes("def alt():\n    return '한글'\n".encode("cp949"))
    return root


def test_ingest_search_and_tools(spark, tree, tmp_path):
    engine = CodeEngine(spark, str(tmp_path / "store"))
    assert engine.ingest(str(tree)) == {"new": 6}
    names = {r.qualified_name for r in engine.chunks().collect()}
    assert {"pkg.mod.outer", "pkg.old.alt", "Lab.Core.Engine.Run", "geo.Shape.edge", "App.Views.MainView", "lib"} <= names
    assert not any(".git" in n or "build" in n for n in names)
    assert "한글" in engine.chunks().where("qualified_name = 'pkg.old.alt'").first().content
    assert engine.ingest(str(tree)) == {"same": 6}
    (tree / "pkg/mod.py").write_text(PY.replace("def area", "def surface"))
    assert engine.ingest(str(tree)) == {"changed": 1, "same": 5}
    hits = engine.search("what does outer do in mod.py", 3).collect()
    assert hits[1].qualified_name == "pkg.mod.outer" and hits[1].exact and [h.position for h in hits] == list(range(len(hits)))
    edges = {tuple(r) for r in engine.edges().collect()}
    assert ("Lab.Core.Engine.Run", "Lab.Core.Engine.OnRun") in edges
    assert engine.get_code_snippet("pkg.mod.outer").first().snippet.startswith("[pkg.mod.outer] (pkg/mod.py:")
    assert engine.find_by_name(["OUTER"]).count() == 1 and engine.read_file("MOD.py").count() >= 4
    lines, code = engine.query_knowledge_graph("who calls it", "Lab.Core.Engine.Run")
    assert "[Callee|depth=1] Lab.Core.Engine.OnRun" in {r.line for r in lines.collect()} and code.count() >= 1
    assert set(engine.tools()) == {"semantic_search", "get_code_snippet", "find_by_name", "query_knowledge_graph", "read_file"}
    for q, route in (("x", Route(target="outer")), ("x", Route(filenames=["mod.py"])), ("x", Route(filenames=["mod.py", "shape"])), ('File "mod.py", line 1', Route(has_traceback=True)), ("x", Route(language="csharp")), ("outer", Route())):
        found = engine.retrieve(q, route)
        assert found.count() > 0 and "<context>" in engine.build_prompt(q, found, route)
    assert engine.search_with_context("Run the Engine", 3).where("size(flow) > 0").count() >= 1
    (tree / "lib/shape.cpp").unlink()
    assert engine.ingest(str(tree), drop_deleted=True)["deleted"] == 1
    assert engine.chunks().where("language = 'cpp'").count() == 0
    assert engine.write_docs(str(tmp_path / "docs")) > 3
    page = next(Path(tmp_path / "docs").rglob("mod.py.md")).read_text()
    assert "## 💻 Code Details" in page and "def surface" in page
    assert "Module: pkg</span>" in page and (tmp_path / "docs/pkg/mod.py.md").exists()
    assert next(Path(tmp_path / "docs").rglob("lib/index.md")).read_text().startswith('---\ntitle: "📁 lib"')
    assert (tmp_path / "docs/index.md").read_text().startswith('---\ntitle: "API"')
    assert engine.write_docs(str(tmp_path / "docs")) > 3
    assert engine.stats()["ready"]


def test_stream(spark, tree, tmp_path):
    engine = CodeEngine(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest.start(engine, str(tree), str(tmp_path / "check")).awaitTermination(120)
    assert engine.chunks().where("name = 'outer'").count() == 1
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert ingest.error_rates(events).agg(F.sum("n")).first()[0] == events.count()


def test_decode():
    assert files.decode("é".encode()) == "é" and files.decode("\ufeffa".encode()) == "a" and files.decode("한글".encode("cp949")) == "한글" and files.decode(None) == ""


def test_diagnosis(spark, tmp_path):
    trace = 'Traceback (most recent call last):\n  File "app.py", line 10, in main\n    run(None)\n  File "utils.py", line 5, in run\n    return x.upper()\nAttributeError: no upper'
    windows = "System.NullReferenceException: none\n   at A.B.Load() in C:\\a\\B.cs:line 45\n   at A.C.On(Object s, Args e) in /x/C.cs:line 2"
    df = spark.createDataFrame([(1, trace), (2, windows), (3, "nothing here"), (4, None)], "i int, error_text string")
    rows = {r.i: r for r in errors.diagnosed(df).collect()}
    assert [f.function_name for f in rows[1].frames] == ["main", "run"] and rows[1].frames[0].code_snippet == "run(None)"
    assert rows[1].location.line_number == 5 and rows[1].root_cause.filepath == "app.py" and rows[1].severity == "Level2"
    assert rows[1].chain == "→ main (app.py:10)\n  → run (utils.py:5)"
    assert rows[2].success is False or len(rows[2].frames) == 0
    assert rows[3].success is False and rows[3].severity is None
    loose = {r.i: r for r in errors.diagnosed(df, strict=False).collect()}
    assert [(f.filepath, f.function_name) for f in loose[2].frames] == [("C:/a/B.cs", "Load"), ("/x/C.cs", "On")]
    assert loose[2].severity == "Level1"
    engine = CodeEngine(spark, str(tmp_path))
    with pytest.raises(ValueError):
        engine.batch_diagnose(["x"] * 11)
    assert engine.batch_diagnose([trace, "x"]).where("success").count() == 1


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("s", "s"), ("s", "a")]


def test_small_graph(spark):
    e = spark.createDataFrame(EDGES, "caller_qn string, callee_qn string")
    got = lambda *a: {tuple(r) for r in graph.reachable(e, *a).collect()}
    assert got("a", 3) == {("b", 1), ("d", 1), ("c", 2)}
    assert got("s", 3) == {("a", 1), ("s", 1), ("b", 2), ("d", 2), ("c", 3)}
    assert {tuple(r.path) for r in graph.call_paths(e, "a", "c").collect()} == {("a", "b", "c"), ("a", "d", "c")}


def test_call_paths_equal_brute_force(spark, tmp_path):
    from siltstone.plans.contract import QUERIES

    rnd = random.Random(3)
    edges = {(rnd.randint(1, 9), rnd.randint(1, 9)) for _ in range(26)} | {(k, k + 1) for k in range(1, 7)}
    lines = [(order, part, 1, at) for order, edge in enumerate(sorted(edges)) for at, part in enumerate(edge)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    want, paths = set(), [[1]]
    for _ in range(6):
        paths = [[*p, b] for p in paths for a, b in edges if a == p[-1] and b not in p]
        want |= {(">".join(map(str, p)), len(p) - 1) for p in paths if p[-1] == 7}
        paths = [p for p in paths if p[-1] != 7]
    got = [tuple(r) for r in QUERIES["call_paths"](spark, str(tmp_path)).collect()]
    assert max(n for _, n in want) == 6 and len(got) == len(want) and set(got) == want


def test_question_flow_reads_edges_once_a_hop(spark, tmp_path):
    pairs = [("a", "b"), ("b", "c"), ("b", "a"), ("x", "a"), ("y", "x"), ("n", "a"), ("a", "a"), ("c", "n")]
    spark.createDataFrame(pairs, "caller_qn string, callee_qn string").write.parquet(f"{tmp_path}/e")
    lines, callees = graph.question_flow(spark.read.parquet(f"{tmp_path}/e"), "a", ["n", "n"])
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("Relation [caller_qn") <= 2  # second hops, one a side
    named = ["[Caller|depth=1] c", "[Callee|depth=1] a"] * 2
    seed = [f"[Caller|depth=1] {x}" for x in "abnx"] + [f"[Caller|depth=2] {x}" for x in "cy"] + [f"[Callee|depth=1] {x}" for x in "ab"] + ["[Callee|depth=2] c"]
    assert sorted(r.line for r in lines.collect()) == sorted(named + seed)
    assert [r.callee_qn for r in callees.collect()] == ["a", "b"]
    lines, callees = graph.question_flow(spark.read.parquet(f"{tmp_path}/e"), "", [])
    assert not lines.count() and not callees.count()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=14, unique=True), st.integers(1, 4))
def test_reachable_equals_path_enumeration(spark, pairs, depth):
    e = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "caller_qn string, callee_qn string")
    best = {}
    paths = [[a, b] for a, b in pairs if a == 0]
    for d in range(1, depth + 1):
        for p in paths:
            best.setdefault(str(p[-1]), d)
        paths = [[*p, b] for p in paths for a, b in pairs if a == p[-1] and b not in p]
    assert {r.qn: r.depth for r in graph.reachable(e, "0", depth).collect()} == best


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], "id string, qualified_name string, name string")
    new = spark.createDataFrame([("9", "b", "z"), ("8", "c", "w")], "id string, qualified_name string, name string")
    once = store.upsert(old, new)
    assert {tuple(r) for r in once.collect()} == {("1", "a", "x"), ("2", "b", "z"), ("8", "c", "w")}
    assert {tuple(r) for r in store.upsert(once, new).collect()} == {tuple(r) for r in once.collect()}
    s = store.ChunkStore(spark, str(tmp_path))
    assert s.count() == 0
    s.add_edges(spark.createDataFrame([("a", "b"), ("a", "b")], "caller_qn string, callee_qn string"))
    s.add_edges(spark.createDataFrame([("a", "b"), ("b", "c")], "caller_qn string, callee_qn string"))
    assert s.table("call_edges").count() == 2
    s.clear()
    assert s.table("call_edges").count() == 0


def _chunk(qn, calls=(), language="python", kind="function", content="x", imports=None):
    module, _, name = qn.rpartition(".")
    return {"qualified_name": qn, "name": name, "type": kind, "content": content, "filepath": f"{module}.py", "start_line": 1, "language": language, "module_path": module, "calls": list(calls), "imports": imports or {}}


def _rows(spark, rows):
    return spark.createDataFrame([r for r in rows], "qualified_name string, name string, type string, content string, filepath string, start_line int, language string, module_path string, calls array<string>, imports map<string,string>")


def test_writes_touch_their_buckets_alone(spark, tmp_path):
    s = store.ChunkStore(spark, str(tmp_path), buckets=8)
    s.create()
    assert s.version("code_chunks") == 1 and s.table("code_chunks").count() == 0
    s.upsert_chunks(_rows(spark, [_chunk(f"m.f{i}") for i in range(40)]))
    before = s._manifest("code_chunks")["files"]
    changed = s.upsert_chunks(_rows(spark, [_chunk("m.f3", content="new")]))
    after = s._manifest("code_chunks")["files"]
    assert sum(before[b] != after[b] for b in before) == 1 and set(before) == set(after)
    assert [tuple(r) for r in changed.collect()] == [("m.f3", "f3")]
    assert s.table("code_chunks").count() == 40 and s.table("code_chunks").where("content = 'new'").count() == 1
    assert s.upsert_chunk(_rows(spark, [_chunk("m.f4", content="new")])) and not s.upsert_chunk(spark.createDataFrame([(1,)], "qualified_name int"))
    s.recreate()
    assert s.count() == 0


def test_a_crash_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    s = store.ChunkStore(spark, str(tmp_path), buckets=4)
    s.save_state(spark.createDataFrame([("a", "1")], "rel_path string, md5 string"))
    seen = s.table("file_state")
    commit = store.ChunkStore._commit
    monkeypatch.setattr(store.ChunkStore, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        s.save_state(spark.createDataFrame([("b", "2")], "rel_path string, md5 string"))
    monkeypatch.setattr(store.ChunkStore, "_commit", commit)
    assert [tuple(r) for r in s.table("file_state").collect()] == [("a", "1")]
    for i in range(5):
        s.save_state(spark.createDataFrame([("c", str(i))], "rel_path string, md5 string"))
        assert i > 1 or seen.count() == 1  # a running reader keeps its files for a while
    assert [tuple(r) for r in s.table("file_state").collect()] == [("c", "4")]
    assert len(list((tmp_path / "file_state").glob("d-*"))) <= s.KEEP


def test_edges_resolved_again_equal_a_rebuild(spark, tmp_path):
    """Chunks come, change and go; the edges kept up by changed names equal those of a whole rebuild."""
    rnd = random.Random(7)
    engine = CodeEngine(spark, str(tmp_path / "store"))
    names = [f"f{i}" for i in range(9)]

    def some(n):
        out = {}
        for _ in range(n):
            module, name = rnd.choice(["m", "n", "A.B"]), rnd.choice(names)
            language = "c_sharp" if module == "A.B" else "python"
            kind = rnd.choice(["function", "function", "property"])
            out[f"{module}.{name}"] = _chunk(f"{module}.{name}", rnd.sample(names, 3), language, kind, imports={"f1": "n.f2"} if module == "m" else None)
        out["ui.MainView"] = _chunk("ui.MainView", [], "xaml", "view", f"{{Binding {rnd.choice(names)}.x}} {{Binding {rnd.choice(names)}}}")
        return list(out.values())

    for step in range(4):
        changed = engine.add_chunks(_rows(spark, some(7)))
        if step == 2:
            changed = changed.unionByName(engine.store.delete_files(spark.createDataFrame([("n.py",)], "filepath string")))
        engine.resolve_changed(changed)
        kept = {tuple(r) for r in engine.edges().collect()}
        engine.rebuild_edges()
        assert kept == {tuple(r) for r in engine.edges().collect()} and kept


def test_router_and_agent(spark, tree, tmp_path):
    engine = CodeEngine(spark, str(tmp_path / "store"))
    engine.ingest(str(tree))
    said = {"type": "flow", "filenames": ["mod.py"], "target_name": "outer", "keywords": ["go"], "language": "python"}
    engine.classifier = lambda prompt, q: "```json\n" + json.dumps(said) + "\n```"
    assert engine.route("an exception") == Route("flow", ["mod.py"], "outer", ["go"], "python", True)
    for bad in ("no json", "[]", '{"filenames": []}'):
        engine.classifier = lambda prompt, q, bad=bad: bad
        assert engine.route("the ViewModel") == Route(language="csharp")
    asked = []

    def plan(messages, tools):
        asked.append([m["content"] for m in messages if m["role"] == "tool"])
        return [[("find_by_name", {"names": ["outer"]}), ("ignored", {})], [("get_code_snippet", {"qualified_name": "geo.Shape.edge"})], [("query_knowledge_graph", {"question": "Run", "seed": "Lab.Core.Engine.Run"})], [("read_file", {"filename": "mod.py"})], []][len(asked) - 1]

    agent = Agent(engine, plan, lambda p: iter([p[:9], p[9:]]))
    answer = "".join(agent.run("what does outer do"))
    assert "pkg.mod.outer" in asked[1][0] and "[Callee|depth=1] Lab.Core.Engine.OnRun" in asked[3][2]
    assert answer.count("<file ") == len(set(re.findall(r'<file index="(\d+)"', answer))) >= 4 and "def outer" in answer
    assert agent.log[0] == "🎯 **find_by_name**(outer): 1 matches" and len(agent.log) == 4
    assert "<context>\n</context>" in "".join(Agent(engine, lambda m, t: [("unknown", {})], lambda p: iter([p])).run("x"))
    steps = []
    "".join(Agent(engine, lambda m, t: steps.append(1) or [("read_file", {"filename": "nothing"})], lambda p: iter([p])).run("x"))
    assert len(steps) == 6


def test_tokens_equal_those_of_a_query(spark):
    odd = ["a\u2003b\x1cc\x85d\u3000E", "x_y.z(1)", " ", "", "Ünïcode\xa0'q'\u200bw", "a\r\nb\tc\x0b\x0cd"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    assert [r[1] for r in df.select("i", text.tokens(F.col("t"))).orderBy("i").collect()] == [text.query_tokens(t) for t in odd]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<thinking>", "</thinking>", "<", "</th", "a", " b ", "ink", "ing>", ">"]), max_size=14), st.integers(1, 9))
def test_tags_cut_between_pieces(parts, width):
    whole = "".join(parts)
    pieces = [whole[i : i + width] for i in range(0, len(whole), width)]
    assert "".join(shown(iter(pieces))) == whole.replace("<thinking>", text.THINKING).replace("</thinking>", text.THOUGHT)


def test_file_summaries_come_from_contents(spark, tree, tmp_path):
    engine = CodeEngine(spark, str(tmp_path / "store"), summarizer=lambda texts: [f"<think>x</think>about {len(t)}" for t in texts])
    engine.ingest(str(tree))
    row = engine.chunks().where("qualified_name = 'pkg.mod.py'").first()
    assert row.summary.startswith("about ") and row.content.endswith("\nSummary: " + row.summary)


def test_pages_of_the_engine_take_empty_texts_for_none(spark):
    rows = [("a.f", "f", "function", "x", "", "about f", "a.py", 1, "python"), ("a.py", "a.py", "file", "", "", "", "a.py", 1, "python")]
    chunks = spark.createDataFrame(rows, "qualified_name string, name string, type string, content string, summary string, docstring string, filepath string, start_line int, language string")
    page = context.doc_files(chunks, "P").where("path = 'a.py.md'").first().doc_md
    assert "| about f |" in page and "**Docstring:**\nabout f" in page and "File Overview" not in page


def test_cells_find_what_is_near(spark):
    """Against brute force: at least 0.9 of the true nearest ten, over every hundredth vector as a question."""
    import numpy as np

    index = Tables(spark, "/root/testdata/sf0.1").vector_index
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = 0
    asked = [i for i, r in enumerate(rows) if r.vec_id % 100 == 0]
    for i in asked:
        true = {rows[j].vec_id for j in np.argsort(-(x @ x[i]), kind="stable")[:10]}
        found += len(true & {r.id for r in index.vector_top(rows[i].embedding, 10, exact=False).collect()})
    assert found >= 0.9 * 10 * len(asked)
    assert index.table("cells").first().probes < index.table("cells").count()


def test_index_of_awkward_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, None, None), (2, "", [0.0, 0.0]), (3, "a a b", [1.0, 2.0]), (4, "b", [2.0, 1.0])], "id long, t string, v array<float>")
    index = SearchIndex.build(df, str(tmp_path / "i"), "id", "t", "v")
    assert [r.id for r in index.bm25_top("a", 9).collect()] == [3, 1, 2, 4] and index.bm25_top("", 2).count() == 2
    assert [r.id for r in index.vector_top([1.0, 2.0], 5).collect()] == [3, 4] and index.vector_top([0.0, 0.0], 5).count() == 0
    empty = SearchIndex.build(df.limit(0), str(tmp_path / "e"), "id", "t", "v")
    assert empty.bm25_top("a", 3).count() == 0 and empty.vector_top([1.0, 2.0], 3, exact=False).count() == 0


def test_postings_are_cut_by_their_number(spark, tmp_path, monkeypatch):
    """A file holds about as many postings whatever the size of the table; one very common term is cut as well."""
    monkeypatch.setattr("siltstone.operators.index.POSTINGS", 50, raising=False)
    docs = spark.range(300).selectExpr("id", "concat('a b', id % 7, ' a x', id) AS t")
    rows = SearchIndex.build(docs, str(tmp_path / "i"), "id", "t").table("postings")
    held = [r["count"] for r in rows.groupBy(F.input_file_name()).count().collect()]
    assert sum(held) == 900 and max(held) <= 150
    assert {(r.tf, r.dl) for r in rows.where("term = 'a'").collect()} == {(2, 4)} and rows.where("term = 'a'").count() == 300


def test_postings_are_moved_in_lists(spark, tmp_path, monkeypatch):
    """Far fewer rows are sorted than there are postings, which stay those of every document."""
    texts = [" ".join(["a"] * (i % 3) + [f"w{i % 5}", "b", f"w{i % 5}"]) if i % 11 else None for i in range(600)]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "id string, t string").repartition(3)
    monkeypatch.setattr("siltstone.operators.index.TOKENS", 100, raising=False)
    index = SearchIndex.build(docs, str(tmp_path / "i"), "id", "t")
    want = {(w, f"d{i}", len(t.split()), t.split().count(w)) for i, t in enumerate(texts) if t for w in t.split()}
    got = [(r.term, r.id, r.dl, r.tf) for r in index.table("postings").collect()]
    assert len(got) == len(want) and set(got) == want
    assert index.table("lists").count() < len(want) / 3 and index.table("docs").count() == 600
    assert (index.stats["n_docs"], index.stats["n_terms"]) == (600, 7)
    assert index.stats["avgdl"] == sum(len((t or "").split()) for t in texts) / 600


@pytest.mark.parametrize("limit", ["-1", "1k"])
def test_texts_are_not_sorted_for_their_vectors(spark, limit):
    """Whatever the session's limit of broadcasts."""
    from siltstone.plans.views import Tables

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, limit)
    try:
        plan = Tables(spark, "/root/testdata/sf0.001").vectors._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_pages_of_callers(spark, monkeypatch):
    monkeypatch.setattr(graph, "CALLERS", 3)
    e = spark.createDataFrame([(f"c{i}", "hub") for i in range(20)] * 2 + [("x", "y")], "caller_qn string, callee_qn string")
    rows = graph.reverse_edges(e).collect()
    hub = [r for r in rows if r.callee_qn == "hub"]
    assert len(hub) > 4 and sorted(c for r in hub for c in r.callers) == sorted(f"c{i}" for i in range(20)) and {r.n for r in hub} == {20}


def test_bindings_prefer_the_views_model(spark):
    rows = [("a.Main", "Main", "view", "xaml", "{Binding Name} {Binding Other.x} {Binding None}", 0), ("p.First.Name", "Name", "property", "c_sharp", "", 1), ("q.XMainModels.Name", "Name", "property", "c_sharp", "", 2), ("q.MainModel.Name", "Name", "property", "c_sharp", "", 3), ("p.Other", "Other", "property", "c_sharp", "", 4)]
    df = spark.createDataFrame(rows, "qualified_name string, name string, type string, language string, content string, ord int")
    assert {(r.property, r.pos, r.target_qn) for r in resolve.resolve_bindings(df).collect()} == {("Name", 0, "q.XMainModels.Name"), ("Other", 1, "p.Other")}


def test_text_rules(spark):
    def one(column, *values):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        return [r[0] for r in df.select(column(F.col("v"))).collect()]

    assert one(text.valid_name, "a", "ab", "a" * 50, "a" * 51, "1a", "__", "for", "a.b", None) == [False, True, True, False, False, False, False, True, False]
    assert one(text.normal_path, "/a/a/b/b/c", "x/y", "a/b/a") == ["/a/b/c", "x/y", "a/b/a"]
    assert sorted(one(text.identifiers, "What does myFunc of save_data and ViewModel do")[0]) == ["ViewModel", "and", "save_data"]
    assert one(text.file_names, "see a.py, Main.xaml.cs and b.xaml") == [["a.py", "xaml.cs", "Main.xaml", "b.xaml"]]
    assert one(lambda c: text.skipped_path(c, "/r"), "/r/a/b.py", "/r/.x/b.py", "/r/venv/b.py", "/o/venv/b.py", "/o/.b.py") == [False, True, True, False, True]
    assert one(text.short_summary, " x  =  1 ", "y" * 90) == ["단순 속성/선언부: `x = 1`", None]
    assert one(text.without_thoughts, "<think>a</think> b", "c <think> d") == ["b", "c"]
    assert one(lambda c: text.tokens(c, True), "getName(x)") == [["get", "name", "x"]]
    assert one(text.escape_mdx, "a&b{c}<d>") == ["a&amp;b&#123;c&#125;&lt;d&gt;"]
    assert one(lambda c: text.source_lines(c, F.lit(0), F.lit(9)), "a\nb  \n", None) == ["a\nb", "# Error: File not found"]
    assert one(lambda c: text.doc_folder(c, "/w/root"), "/w/root/x/y.py", "/else/z/q.py") == ["root/x", "z"]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=12))
def test_budget_is_a_prefix(spark, sizes):
    df = spark.createDataFrame([(0, i, "x" * n) for i, n in enumerate(sizes)], "k int, i int, t string")
    kept = sorted(r.i for r in context.within_budget(df, ["k"], ["i"], "t", 200).collect())
    total, want = 0, []
    for i, n in enumerate(sizes):
        total += n // 3
        if total > 200:
            break
        want.append(i)
    assert kept == want


def test_fusion_of_lists(spark):
    rnd = random.Random(2)
    a, b = rnd.sample(range(30), 12), rnd.sample(range(30), 12)
    make = lambda ids, n: spark.createDataFrame([(x, i, n) for i, x in enumerate(ids)], "id long, rank long, list int")
    got = [r.id for r in search.fuse(make(a, 0), make(b, 1)).orderBy(F.desc("score"), "first_seen").collect()]
    score = {}
    for ids in (a, b):
        for i, x in enumerate(ids):
            score[x] = score.get(x, 0) + 1 / (60 + i)
    order = list(dict.fromkeys(a + b))
    assert got == sorted(order, key=lambda x: (-round(score[x], 12), order.index(x)))


def test_index_computes_each_vector_once(spark, tmp_path):
    """The rows may be a join over all texts; the count, the sample and the placing must not each run it again."""
    from pyspark.sql import functions as F

    from siltstone.operators.index import SearchIndex, hadoop_path

    asked = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def vector(i):
        asked.add(1)
        return None if i % 10 == 9 else [0.0, 0.0] if i % 10 == 8 else [float(i), 1.0]

    rows = spark.range(100).select("id", F.lit("a word").alias("text"), vector("id").alias("v"))
    index = SearchIndex.build(rows, str(tmp_path / "index"), "id", "text", "v")
    assert asked.value == 100
    held = {r["id"]: r["unit"] for r in index.table("vectors").collect()}
    assert set(held) == {i for i in range(100) if i % 10 < 8} and held[3] == [3.0 / 10**0.5, 1.0 / 10**0.5]
    system, path = hadoop_path(spark, f"{index.folder}/units")
    assert not system.exists(path)
