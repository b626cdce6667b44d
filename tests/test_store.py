"""Collections in buckets, locks, stamps, shards, freshness and the sync of functions."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import explore as X
from quillgraph.operators.changes import keep_within, pair_budget, running_sum
from quillgraph.operators.vectors import hashed_vectors
from quillgraph.sources.code_tree import Routes, load_config, pruned_files, read_tree, read_wiring
from quillgraph.sources.collections import Busy, Collection, export_shards, import_shards, refuse_nonfinite
from quillgraph.streaming.freshness import StatGate, progress_line, sync_functions, wait_quiet

STAMP = {"model": "m", "dim": "2"}


def col(spark, path, stamp=STAMP, buckets=8):
    return Collection(spark, f"file://{path}", stamp, "id", buckets)


def rows(spark, pairs):
    return spark.createDataFrame([(f"k{a}", b) for a, b in pairs], "id string, v int")


def test_a_write_touches_changed_buckets_only(spark, tmp_path):
    c = col(spark, tmp_path / "c")
    c.replace(rows(spark, [(k, 0) for k in range(200)]))
    before = dict(c._manifests()[-1]["buckets"])
    assert c.upsert(rows(spark, [(7, 1)])) == 1
    after = dict(c._manifests()[-1]["buckets"])
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert c.count() == 200 and c.read().where("v = 1").count() == 1
    assert c.upsert(rows(spark, [(7, 2), (500, 2)]), live=rows(spark, [(k, 0) for k in [*range(100), 500]])) == 8
    assert c.count() == 101 and {r["id"] for r in c.read().where("v = 2").collect()} == {"k7", "k500"}
    assert c.remove(rows(spark, [(7, 0), (999, 0)])) >= 1 and c.count() == 100
    c.upsert(rows(spark, []))
    assert c.count() == 100
    kept = {p.split("/")[1] for m in c._manifests() for p in m["buckets"].values()}
    assert {d for d in os.listdir(tmp_path / "c/data")} == kept


def test_one_writer_at_a_time(spark, tmp_path):
    c = col(spark, tmp_path / "c")
    c.replace(rows(spark, [(1, 1)]))
    with c.lock():
        assert c.building and c.read_stale()[1] and c.read_stale()[0].count() == 1
        with pytest.raises(Busy), c.lock(wait=0.2):
            pass
    assert not c.building and not c.read_stale()[1]
    order = []

    def add(k):
        with c.lock(wait=30):
            order.append(k)
            order.append(k)

    ts = [threading.Thread(target=add, args=(k,)) for k in range(4)]
    [t.start() for t in ts]
    [t.join() for t in ts]
    assert len(order) == 8 and all(order[i] == order[i + 1] for i in range(0, 8, 2))


def test_stamps(spark, tmp_path):
    c = col(spark, tmp_path / "c")
    c.replace(rows(spark, [(1, 1), (2, 2)]))
    assert col(spark, tmp_path / "c", {**STAMP, "provider": "p"}).read().count() == 2
    with pytest.raises(ValueError, match="built with embed model"):
        col(spark, tmp_path / "c", {"model": "n", "dim": "2"}).read()
    c.restamp({"model": "n", "dim": "2"})
    assert col(spark, tmp_path / "c", {"model": "n", "dim": "2"}).count() == 2
    o = col(spark, tmp_path / "o", {"model": "n", "dim": "2"})
    o.replace(rows(spark, [(k, k) for k in range(5)]))
    assert c.adopt(o.path) and c.count() == 5 and o.read() is None
    o.replace(rows(spark, [(1, 1)]))
    assert not c.adopt(o.path) and c.count() == 5


def test_exports_are_swapped_whole_and_guarded(spark, tmp_path):
    at = f"file://{tmp_path}/sh"
    export_shards(rows(spark, [(k, k) for k in range(10)]), at, stamp=STAMP)
    export_shards(rows(spark, [(k, k) for k in range(3)]), at, stamp=STAMP)
    assert import_shards(spark, at, stamp=STAMP).count() == 3 and os.listdir(tmp_path) == ["sh"]
    with pytest.raises(ValueError, match="were made with"):
        import_shards(spark, at, stamp={"model": "other"})
    bad = spark.createDataFrame([("a", float("nan")), ("b", float("inf")), ("c", 1.0)], "id string, v double")
    with pytest.raises(ValueError, match=r"v \(2\)"):
        export_shards(bad, at)
    refuse_nonfinite(bad.where("id = 'c'"))
    assert import_shards(spark, at).count() == 3


def test_functions_are_synced(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/f", {"model": "hash"}, "id", 4)
    doc = lambda xs: spark.createDataFrame(xs, "id string, doc string, line int")
    assert sync_functions(c, doc([("a", "one two", 1), ("b", "three", 2), ("c", "four", 3)]), hashed_vectors) == {"embedded": 3}
    first = {r["id"]: tuple(r["embedding"]) for r in c.read().collect()}
    assert sync_functions(c, doc([("a", "one two", 1), ("b", "three", 9), ("d", "five", 1), ("c", "changed", 3)]), lambda r, k, t: hashed_vectors(r.where("id <> 'd'"), k, t)) == {"kept": 1, "moved": 1, "embedded": 2}
    got = {r["id"]: r for r in c.read().collect()}
    assert tuple(got["a"]["embedding"]) == first["a"] and got["b"]["line"] == 9 and tuple(got["b"]["embedding"]) == first["b"] and tuple(got["c"]["embedding"]) != first["c"] and got["d"]["embedding"] is None
    assert sync_functions(c, doc([("a", "one two", 1), ("d", "five", 1)]), hashed_vectors) == {"kept": 1, "embedded": 1, "removed": 2}
    assert {r["id"] for r in c.read().where("embedding is not null").collect()} == {"a", "d"}


def test_gate_quiet_and_progress():
    now, seen = [0.0], [1]
    gate = StatGate(lambda: seen[0], ttl=3, clock=lambda: now[0])
    gate.mark()
    assert not gate.dirty()
    seen[0] = 2
    assert not gate.dirty()
    now[0] = 3.5
    assert gate.dirty()
    gate.mark()
    assert not gate.dirty()
    changes = iter([1, 2, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3])

    def sleep(s):
        now[0] += s

    now[0] = 0.0
    assert wait_quiet(lambda: next(changes), quiet=1, longest=30, clock=lambda: now[0], sleep=sleep, step=0.5) and now[0] == 2.0
    now[0], n = 0.0, iter(range(1000))
    assert not wait_quiet(lambda: next(n), quiet=1, longest=5, clock=lambda: now[0], sleep=sleep, step=0.5) and now[0] == 5.0
    assert progress_line("embed", 5, 20, 10.0) == "embed 5/20 (25 %), about 30 s left" and progress_line("walk", 3, None, 1.0) == "walk 3" and progress_line("x", 4, 4, 1.0) == "x 4/4 (100 %)"


def test_trees_configuration_and_routes(spark, tmp_path):
    for p in ("a/b/c/d.py", "a/x.py", "a/b/y.py", "z.py", "scenes/m.tscn", "node_modules/k/a.js", "node_modules/b.js", "q/node_modules/c.js"):
        os.makedirs(tmp_path / "t" / os.path.dirname(p), exist_ok=True)
        (tmp_path / "t" / p).write_text("x")
    root = str(tmp_path / "t")
    for parts in ("1", "3", "64"):
        assert sorted(r["path"] for r in read_tree(spark, root, suffixes=".py", parts=parts).collect()) == ["a/b/c/d.py", "a/b/y.py", "a/x.py", "z.py"]
    assert [r["path"] for r in read_wiring(spark, root).collect()] == ["scenes/m.tscn"]
    assert {(r["folder"], r["n"]) for r in pruned_files(spark, root).collect()} == {("node_modules", 2), ("q/node_modules", 1)} and pruned_files(spark, root, 1).agg(F.max("n")).first()[0] == 1
    assert load_config('{"include": ["a"], "scale": 2, "dim": 8}') == ({"include": ["a"], "scale": 2.0, "dim": 8}, [])
    good, faults = load_config(json.dumps({"dim": True, "exclude": [1], "odd": 1, "model": "m"}))
    assert good == {"model": "m"} and len(faults) == 3 and load_config("[1]")[1] == ["not an object"] and load_config("{")[1] and load_config("") == ({}, [])
    r = Routes("file:///stores")
    assert r.store(root) == r.store(root + "/") and r.store(root) != r.store(str(tmp_path)) and r.store(root).startswith("file:///stores/t-")
    with pytest.raises(ValueError):
        r.store(str(tmp_path / "none"))


def test_budgets_equal_a_walk(spark):
    import random

    rng = random.Random(3)
    for budget in (0, 7, 60, 10_000):
        items = [(k, rng.randint(0, 9), rng.choice([0, 1, 3, 8, 20, 61])) for k in range(120)]
        df = spark.createDataFrame(items, "k int, w int, c int").repartition(5)
        want, used = set(), 0
        for k, _w, c in sorted(items, key=lambda x: (-x[1], x[0])):
            if used + c <= budget:
                want.add(k)
                used += c
        order = [F.desc("w"), F.asc("k")]
        assert {r["k"] for r in keep_within(df, order, "c", budget).collect()} == want
    run = running_sum(df, order, "c").orderBy("pos").collect()
    assert [r["pos"] for r in run] == list(range(1, 121)) and run[-1]["used"] == sum(c for _, _, c in items)
    assert keep_within(df.limit(0), order, "c", 5).count() == 0
    wires = spark.createDataFrame([("a", "b", 1, 30), ("a", "b", 1, 30), ("c", "d", 1, 50), ("e", "f", 1, 10)], "x string, y string, one int, c int")
    assert {(r["x"], r["c"]) for r in pair_budget(wires, ["x", "y"], "one", "c", 75).collect()} == {("a", 60), ("e", 10)}


def test_slices_share_one_budget():
    hit = lambda k, n, score: X.Hit(f"f{k}.py", f"fn{k}", 1, [f"line {i}" for i in range(n)], n, score, ["x"], 1, [], 0)
    out = X.slices([hit(1, 500, 1.0), hit(2, 3, 0.9), hit(3, 500, 0.1), hit(4, 500, 0.8)], 20_000)
    assert len(out) == 4 and "not shown" in out[2] and 'pass anchor="f1.py:101-200" to continue' in out[0] and "anchor" not in out[1] and "callers: 1 (x) | callees: 0 (none)" in out[1]
    assert sum(map(len, X.slices([hit(k, 400, 1.0) for k in range(8)], 5_000))) <= 5_000
    assert X.read_anchor("a/b.py:101-200") == ("a/b.py", 101, 200) and X.read_anchor("a:0-3") is None and X.read_anchor("a:9-3") is None and X.read_anchor("x") is None
    assert X.cut([("a", ["x" * 10] * 3), ("b", ["y"])], 25) == [("a", 1, "x" * 10), ("a", 2, "x" * 10)]
