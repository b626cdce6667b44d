import os

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import parsing as P
from quillgraph.operators import changes as H
from quillgraph.operators import liveness as L
from quillgraph.operators import vectors as V
from quillgraph.operators.references import orphan_references, orphan_report
from quillgraph.sources.code_tree import read_tree
from quillgraph.sources.collections import Collection, export_shards, import_shards, nonfinite
from quillgraph.sources.memories import MemoryStore
from quillgraph.streaming.freshness import FreshnessLoop, stat_fingerprints


def test_memories(spark, tmp_path):
    m = MemoryStore(spark, f"file://{tmp_path}/mem")
    assert m.get("a") is None and m.list().count() == 0
    m.set("b", "# Title\nbody")
    m.set("a", "<!-- short -->\nrest")
    m.set("b", "# Other")
    assert [(r["name"], r["summary"]) for r in m.list().collect()] == [("a", "short"), ("b", "Other")]
    assert m.delete("a") and not m.delete("a") and m.get("b") == "# Other"
    for bad in ("", "con", "x.", "a/b", "-a"):
        with pytest.raises(ValueError):
            m.set(bad, "x")


def test_collection(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/col", {"model": "m", "dim": "2"})
    assert c.read() is None
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    c.replace(rows)
    c.upsert(spark.createDataFrame([("b", 5), ("c", 6)], "id string, v int"), live=spark.createDataFrame([("b",), ("c",)], "id string"))
    assert {tuple(r) for r in c.read().collect()} == {("b", 5), ("c", 6)}
    with pytest.raises(ValueError):
        Collection(spark, c.path, {"model": "n", "dim": "2"}).read()
    c.drop()
    assert c.read() is None


def test_shards(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i:03}", float(i)) for i in range(600)], "id string, v double")
    export_shards(rows, f"file://{tmp_path}/sh")
    files = [f for f in os.listdir(tmp_path / "sh/shards") if f.endswith(".gz")]
    assert len(files) >= 3
    back = import_shards(spark, f"file://{tmp_path}/sh", rows.limit(10).select("id"))
    assert back.count() == 10 and nonfinite(back).where("n > 0").count() == 0


def test_code_tree(spark, tmp_path):
    for path, text in {"a.py": "x = 1\n", "pkg/b.py": "def f():\n    pass\n", "pkg/c.txt": "no", "node_modules/d.py": "no", "pkg/.git/e.py": "no"}.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(text)
    t = read_tree(spark, str(tmp_path), suffixes=".py")
    assert {(r["path"], r["size"]) for r in t.collect()} == {("a.py", 6), ("pkg/b.py", 18)}
    assert read_tree(spark, str(tmp_path), content="false").where("text is not null").count() == 0
    assert stat_fingerprints(spark, str(tmp_path)).count() >= 3


def test_freshness(spark, tmp_path):
    loop = FreshnessLoop(Collection(spark, f"file://{tmp_path}/snap", {"v": "1"}))
    schema = "repo string, path string, sha string, mtime_ns long, size long, removed boolean"
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
    put([("r", "a", "1", 1, 1, False), ("r", "b", "1", 1, 1, False), ("r", "a", "0", 0, 1, False)])
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    loop.start(stream, f"{tmp_path}/ck").awaitTermination()
    put([("r", "a", "2", 2, 1, False), ("r", "b", "1", 3, 1, True), ("r", "c", "1", 1, 1, False)])
    loop.start(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/ck").awaitTermination()
    assert {(r["path"], r["sha"]) for r in loop.store.read().collect()} == {("a", "2"), ("c", "1")}
    assert loop.stats == [{"added": 2}, {"updated": 1, "deleted": 1, "added": 1}]
    with pytest.raises(Exception):
        loop.merge(spark.createDataFrame([(1,)], "x int"), 9)
    with pytest.raises(RuntimeError):
        loop.merge(spark.createDataFrame([("r", "a", "2", 2, 1, False)], schema), 10)
    assert loop.store.read().count() == 2


def test_parsers(spark):
    py = "import os\nfrom a.b import c\nclass K(Base):\n    def m(self):\n        return helper(1)\ndef helper(x):\n    return x\nhelper(2)\n"
    gd = "extends Node2D\nclass_name Foo\nfunc _ready():\n\tbar(1) # baz(2)\nfunc bar(x):\n\tprint(\"qux(3)\")\n"
    go = "package p\nimport \"fmt\"\ntype T struct {}\nfunc (t T) Run(x int) error {\n\treturn other()\n}\nfunc other() error { return nil }\n"
    df = spark.createDataFrame([(1, ".py", py), (2, ".gd", gd), (3, ".go", go), (4, ".py", "def ("), (5, ".zz", "x"), (6, ".py", None)], "i long, e string, t string")
    p = P.parse_sources(df, "i", "e", "t")
    have = {(r["id"], r["kind"], r["name"], r["detail"]) for r in p.collect()}
    assert {(1, "func", "m", None), (1, "type", "K", "Base"), (1, "import", "a.b", "c"), (1, "call", "helper", "m"), (1, "call", "helper", None), (2, "func", "bar", None), (2, "call", "bar", "_ready"), (3, "func", "Run", None), (3, "type", "T", None), (3, "call", "other", "Run")} <= have
    assert not {h for h in have if h[2] in ("baz", "qux")}
    assert {tuple(r) for r in P.call_edges(p).collect()} >= {(1, "m", "helper"), (2, "_ready", "bar"), (3, "Run", "other")}
    assert {tuple(r) for r in P.entry_roots(p).collect()} >= {(2, "_ready"), (1, "helper")}


def test_duplicates_and_rescan(spark):
    body = "def t():\n  a = 1 # one\n\n  b = 2\n  return a"
    fn = spark.createDataFrame([(1, body, "a.py"), (2, body.replace(" # one", "").replace("  ", "    "), "b.gd"), (3, "x", "a.py"), (4, None, "a.py")], "func_id long, body string, path string")
    assert {r["func_id"] for r in L.duplicate_members(fn).collect()} == {1, 2}
    schema = "k string, sha string, mtime_ns long, size long"
    old = spark.createDataFrame([("a", "1", 1, 1), ("b", "1", 1, 1), ("c", "1", 1, 1), ("d", "1", 1, 1)], schema)
    new = spark.createDataFrame([("a", "1", 1, 1), ("b", "1", 2, 1), ("c", "2", 2, 1), ("e", "1", 1, 1)], schema)
    assert {r["k"]: r["action"] for r in H.rescan(old, new, ["k"]).collect()} == {"a": "unchanged", "b": "touched", "c": "updated", "d": "deleted", "e": "added"}


def test_knn_edges(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0])], "id long, embedding array<float>")
    got = {(r["q"], r["id"], r["sim"]) for r in V.knn(rows, rows, 1).collect()}
    assert (1, 2, 1.0) in got and (2, 1, 1.0) in got and all(g[0] in (1, 2, 3) for g in got)
    assert V.knn(rows.limit(0), rows, 1).count() == 0 and V.knn(rows, rows.limit(0), 1).count() == 0
    small = V.knn(rows, rows, 2, block=1)
    assert small.where("q = 1").count() == 2
    fake = spark.range(1).select(V.fake_embedding(F.lit("x")).alias("a"), V.fake_embedding(F.lit("x")).alias("b")).first()
    assert fake["a"] == fake["b"] and len(fake["a"]) == 64


FILES = "file_id long, repo string, path string, class_name string, extends string, instances array<string>, attached_script string, indexed_at timestamp, removed_at timestamp, kind string, target string, month string"


def test_orphans(spark):
    from datetime import datetime as D

    t = [D(2024, m, 1) for m in range(1, 13)]
    rows = [
        (1, "r", "a/b.gd", "Base", None, None, None, t[0], t[3]),
        (2, "r", "a/c.gd", "", '  "res://a/b.gd" ', ["Base<T>", None, "", "x.y.Base", "Base"], "Gone", t[1], None),
        (3, "r", "a/d.gd", None, "Base", [], "a/b.gd", t[5], None),
        (4, "r", "a/e.gd", None, "Node", ["Node"], " ", t[5], None),
        (4, "r", "a/e.gd", None, "Node", ["Node"], " ", t[5], None),
        (5, "q", "a/f.gd", None, "Base", None, None, t[1], None),
        (6, None, "a/g.gd", None, "Base", None, None, t[1], None),
        (7, "r", "a/b.gd", "Base", None, None, None, t[8], None),
        (8, "r", "a/h.gd", None, "Base", None, None, t[9], None),
    ]
    files = spark.createDataFrame([(*r, "k", "x", "y") for r in rows], FILES)
    base = spark.createDataFrame([("Node", "gd"), (None, "py")], "type_name string, language string")
    got = {(r["file_id"], r["field"], r["target"]) for r in orphan_references(files, base).collect()}
    assert got == {(2, "attached_script", "Gone"), (3, "extends", "Base"), (3, "attached_script", "a/b.gd"), (4, "instances", "Node"), (5, "extends", "Base"), (6, "extends", "Base")}
    rep = {(r["field"], r["month"]): (r["n_refs"], r["n_orphans"]) for r in orphan_report(files, base).collect()}
    assert rep[("extends", "2024-02")] == (3, 2) and rep[("extends", "2024-10")] == (1, 0)
    assert orphan_references(files.limit(0), base).count() == 0
    assert orphan_references(files.where("file_id = 3"), base.limit(0)).count() == 2


def test_embedding(spark):
    from quillgraph.sources.embedding import RateLimited, embed, incoherent

    def client():
        calls = []

        def call(texts):
            calls.append(len(texts))
            if len(calls) == 1:
                raise RateLimited(0.0)
            if any(t == "bad" for t in texts):
                raise RuntimeError("connection refused")
            return [[float(len(t)), 1.0] for t in texts]

        return call

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "bad"), (4, "x" * 40_000)], "i long, t string").coalesce(1)
    got = {r["id"]: (r["embedding"], r["reason"]) for r in embed(df, "i", "t", client, batch=1, sleep=lambda s: None).collect()}
    assert got == {1: ([3.0, 1.0], None), 2: ([0.0, 1.0], None), 3: (None, "unreachable"), 4: ([30_000.0, 1.0], None)}
    stored = spark.createDataFrame([(1, [3.0, 1.0]), (2, [1.0, -9.0])], "id long, embedding array<float>")
    assert [r["id"] for r in incoherent(stored, embed(df, "i", "t", client, batch=1, sleep=lambda s: None)).collect()] == [2]


def test_ignore_files(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("# x\nskipme/\n*.log\nkeep\n!no/\n")
    for p in ("skipme/a.py", "keep/b.py"):
        (tmp_path / p).parent.mkdir()
        (tmp_path / p).write_text("x")
    assert [r["path"] for r in read_tree(spark, str(tmp_path), suffixes=".py").collect()] == ["keep/b.py"]
