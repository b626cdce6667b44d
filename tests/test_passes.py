"""Cluster passes, shapes of documents, and graphs against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillgraph.operators import clusterpasses as P
from quillgraph.operators import grouping as U
from quillgraph.operators import shaping as D


def members(spark, groups, unit=None):
    rows = [(p, (unit or {}).get(p, p), c) for c, ps in groups.items() for p in ps]
    return spark.createDataFrame(rows, "path string, unit string, comm long")


def moves(df):
    return {r["unit"]: r["to"] for r in df.collect()}


SAME = lambda p: p


def test_majority(spark):
    v = spark.createDataFrame([("a", 2, 3), ("a", 1, 3), ("a", 9, 1), ("b", 4, 1)], "item string, comm long, n long")
    got = {r["item"]: (r["comm"], r["n"], r["total"], r["second"], r["n2"]) for r in P.majority(v, "item").collect()}
    assert got == {"a": (1, 3, 7, 2, 3), "b": (4, 1, 1, None, 0)}


def test_folder_and_loose_moves(spark):
    m = members(spark, {1: ["fx/a.gd", "fx/b.gd", "fx/c.gd", "ui/x.gd"], 2: ["fx/d.gd", "fx/s.tscn", "fx/sub/e.gd"], 3: ["ui/y.gd", "ui/z.gd", "ui/w.gd"]})
    assert moves(P.folder_moves(m, SAME)) == {"fx/d.gd": 1, "fx/sub/e.gd": 1, "ui/x.gd": 3}
    deg = spark.createDataFrame([("fx/d.gd", 2)], "unit string, degree long")
    none = spark.createDataFrame([], "unit string, sim double")
    assert moves(P.loose_moves(m, deg, none, SAME)) == {"fx/s.tscn": 1, "ui/x.gd": 3}


def test_pack_infra_and_usage_moves(spark):
    m = members(spark, {1: [f"art/V_Fire{k}.tscn" for k in range(4)] + ["lone.gd"], 2: ["art/V_Fire9.tscn", "core/glow.gd", "core/k.gd"], 3: ["z.gd"]})
    assert moves(P.pack_moves(m)) == {"art/V_Fire9.tscn": 1}
    links = spark.createDataFrame([("art/V_Fire0.tscn", "core/glow.gd"), ("core/glow.gd", "art/V_Fire1.tscn"), ("art/V_Fire1.tscn", "core/k.gd"), ("z.gd", "core/k.gd"), ("core/glow.gd", "z.gd"), ("lone.gd", "z.gd")], "src_file string, dst_file string")
    assert moves(P.infra_moves(m, links)) == {"core/glow.gd": 1}
    assert moves(P.usage_moves(m, links, SAME)) == {}
    more = links.unionAll(spark.createDataFrame([("core/k.gd", "lone.gd"), ("core/glow.gd", "lone.gd")], links.schema)).where("src_file <> 'lone.gd'")
    assert moves(P.usage_moves(m, more, SAME)) == {"lone.gd": 2, "z.gd": 2}


def test_merges_caps_and_tiny_parts(spark):
    m = members(spark, {k: [f"d{k}/f{i}.gd" for i in range(5)] for k in range(6)})
    links = spark.createDataFrame([("d0/f0.gd", "d1/f0.gd"), ("d0/f1.gd", "d1/f0.gd"), ("d2/f0.gd", "d3/f0.gd"), ("d3/f1.gd", "d4/f0.gd")], "src_file string, dst_file string")
    got = {r["comm"]: r["size"] for r in P.sizes(P.merge_down(m, links, most=4, cap=12)).collect()}
    assert got == {0: 10, 2: 10, 4: 5, 5: 5}
    assert P.sizes(P.merge_down(m, links, most=1, cap=1000)).count() == 3 and P.sizes(P.merge_down(m, links, most=6)).count() == 6
    cut = P.enforce_cap(members(spark, {1: [f"f{i:02}" for i in range(20)], 2: ["g"]}, {f"f{i:02}": f"u{i // 3}" for i in range(20)}), cap=9, chunk=6)
    parts = {}
    for r in cut.collect():
        parts.setdefault(r["comm"], set()).add((r["path"], r["unit"]))
    assert parts["2"] == {("g", "g")} and all(len(p) <= 9 for p in parts.values()) and sum(map(len, parts.values())) == 21
    assert len({(r["unit"], r["comm"]) for r in cut.collect()}) == len({r["unit"] for r in cut.collect()})
    t = members(spark, {1: ["a/x", "a/y"], 2: ["a/1", "a/2", "a/3", "b/4", "b/5"], 3: ["b/6", "b/7", "b/8", "b/9", "a/0"], 4: ["top"]})
    assert {r["comm"] for r in P.fold_tiny(t, SAME).where("path like 'a/_' and path in ('a/x', 'a/y')").collect()} == {2} and P.fold_tiny(t, SAME).where("comm = 4").count() == 1


def test_small_parts_join_the_nearest(spark):
    m = members(spark, {1: ["a", "b", "c"], 2: ["d", "e", "f"], 3: ["g"], 4: ["h"]})
    vec = {"a": [1, 0, 0], "b": [1, 0.1, 0], "c": [1, 0, 0.1], "d": [0, 1, 0], "e": [0, 1, 0], "f": [0, 1, 0.1], "g": [0.1, 1, 0], "h": [0, 0, -1]}
    v = spark.createDataFrame([(p, [float(x) for x in xs]) for p, xs in vec.items()], "path string, embedding array<float>")
    got = {r["path"]: r["comm"] for r in P.merge_small(m, v).collect()}
    assert got["g"] == 2 and got["h"] == -1 and got["a"] == 1


def test_coarse_groups(spark):
    rng = np.random.default_rng(1)
    base = np.linalg.qr(rng.normal(size=(16, 16)))[0][:5]
    rows = [(k, [float(x) for x in base[k % 5] + rng.normal(size=16) * 0.05]) for k in range(30)]
    got = {r["comm"]: r["grp"] for r in P.coarse_groups(spark.createDataFrame(rows, "comm long, embedding array<float>")).collect()}
    assert len(set(got.values())) == 5 and all((got[a] == got[b]) == (a % 5 == b % 5) for a in got for b in got)
    assert P.coarse_groups(spark.createDataFrame([], "comm long, embedding array<float>")).count() == 0


def test_weld_and_linkage_go_on_to_the_end(spark):
    chain = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}") for k in range(80)], "a string, b string")
    assert U.weld(chain).select("unit").distinct().count() == 7
    same = np.tile(np.array([[1.0, 0.0]]), (3200, 1))
    assert len(set(U.chained_linkage(same, 0.65).tolist())) == 1


def test_documents(spark):
    fns = [("r", "p.py", "small", 1, "def small():\n    return 1"), ("r", "p.py", "big", 5, "def big(a):\n    # what it does\n" + "\n".join(f"    x{i} = call({i})" for i in range(300))), ("r", "p.py", "tiny", 400, "def tiny():\n    pass"), ("r", "p.py", "mid", 500, "def mid():\n" + "\n".join(f"    y{i} = {i}" for i in range(40)))]
    df = spark.createDataFrame([(k, *f, None, None) for k, f in enumerate(fns)], "func_id long, repo string, path string, name string, line int, body string, params array<struct<name:string,type:string>>, ret string")
    assert {(r["name"], r["carrier"]) for r in D.micro_carriers(df).collect()} == {("small", None), ("tiny", "big")}
    got = D.function_chunks(df).orderBy("line").collect()
    assert got[0]["key"] == "big#chunk1" and len(got) >= 3 and all(len(r["doc"]) <= D.MONSTER and r["doc"].startswith("p.py :: func big(") for r in got) and all("# what it does" in r["doc"] for r in got)
    assert all(f"x{i} = call({i})" in "".join(r["doc"] for r in got) for i in range(300))
    files = spark.createDataFrame([(1, "r", "p.py", "K", "Base", [f"module{i:03}" for i in range(60)], '"""What the file is for."""\nx = 1'), (2, "r", "none.py", None, None, None, None)], "file_id long, repo string, path string, class_name string, extends string, imported_modules array<string>, text string")
    docs = {r["file_id"]: r for r in D.file_docs(files, df).collect()}
    doc = docs[1]["doc"]
    assert doc.startswith("# p.py\n# class K extends Base\n# symbols: small big tiny mid\n# imports: module000") and "(+" in doc.split("\n")[3] and "What the file is for." in doc and docs[2]["doc"] == "# none.py\n# symbols: " and docs[1]["n_symbols"] == 4
    assert doc.index("-- tiny --") > doc.index("y39 = 39") > doc.index("x0 = call(0)")  # later pieces of the long function come after the first ones of all
    assert len(D.assemble("h" * 10, [["a" * 8, "b" * 8], ["c" * 30], ["d"]], 32)) <= 32 and D.assemble("h", [["a", "b"], ["c"]], 100) == "h\na\nc\nb"
    assert D.capped_line("symbols", ["aa", "bb"], 100) == "# symbols: aa bb" and D.capped_line("symbols", ["aa"] * 50, 40).endswith("(+43)")
    assert D.shape_stamp(0) == "raw" and D.shape_stamp(1.5) == "cast3@1.5"


def test_random_walks_and_ranks(spark):
    from quillgraph.operators import graph as G

    rng = random.Random(5)
    nodes = [f"f{k % 9}.py::n{k}" for k in range(40)]
    links = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(90)}
    links = {(a, b) for a, b in links if a != b}
    e = spark.createDataFrame([(a, b, "call") for a, b in links], "src_key string, dst_key string, type string")
    seed, want, front, hop = nodes[0], {nodes[0]: 0}, {nodes[0]}, 0
    while front:
        hop += 1
        front = {b for a, b in links if a in front} - want.keys()
        want.update(dict.fromkeys(front, hop))
    assert {r["key"]: r["hop"] for r in G.walk(e, spark.createDataFrame([(seed,)], "key string"), None).collect()} == want
    wires = G.file_wires(e)
    w = {(r["src_file"], r["dst_file"]): r["w"] for r in wires.collect()}
    names = sorted({n.split("::")[0] for n in nodes} | {"alone.py"})
    rank = dict.fromkeys(names, 1 / len(names))
    out = {f: sum(v for (a, _), v in w.items() if a == f) for f in names}
    for _ in range(30):
        loose = sum(r for f, r in rank.items() if not out[f])
        rank = {f: 0.15 / len(names) + 0.85 * loose / len(names) + 0.85 * sum(v * rank[a] / out[a] for (a, b), v in w.items() if b == f) for f in names}
    files = spark.createDataFrame([(f,) for f in names], "path string")
    got = {r["path"]: r["rank"] for r in G.pagerank(wires, files).collect()}
    assert got.keys() == rank.keys() and all(abs(got[f] - rank[f]) < 1e-12 for f in rank) and abs(sum(got.values()) - 1) < 1e-9
    assert G.pagerank(wires.limit(0), files).agg(F.sum("rank")).first()[0] > 0.999 and G.pagerank(wires.limit(0), files.limit(0)).count() == 0
