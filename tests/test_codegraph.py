"""Edges from code on a small corpus made for it."""

import pytest

from quillgraph.operators import codegraph as K
from quillgraph.operators import graph as G
from quillgraph.operators import resolve as R

FILES = "repo string, path string, ext string, class_name string, extends string, is_tool boolean, attached_script string, scripts array<string>, instances array<string>, connections array<struct<signal:string,method:string>>, members map<string,string>, imported_modules array<string>"
FUNCS = "func_id long, repo string, path string, name string, line int, body string, params array<struct<name:string,type:string>>"


def file(path, cls=None, base=None, scripts=None, attached=None, instances=None, connections=None, members=None, imports=None, tool=False):
    return ("r", path, "." + path.rsplit(".", 1)[-1], cls, base, tool, attached, scripts, instances, connections, members, imports)


@pytest.fixture(scope="module")
def corpus(spark):
    files = [
        file("base.gd", "Base"), file("s/mid.gd", "Mid", "Base"), file("leaf.gd", "Leaf", "res://s/mid.gd"), file("a.gd", "Loop1", "Loop2"), file("b.gd", "Loop2", "Loop1"),
        file("user.gd", "User", members={"m": "Mid", "n": "Nothing"}, imports=["tools"]), file("lib/tools.gd"), file("odd.py", "Odd", "Unknown"),
        file("main.tscn", scripts=["res://user.gd", "res://gone.gd"], attached="res://base.gd", instances=["res://sub.tscn", None], connections=[("pressed", "on_press"), ("gone", "nowhere")]),
        file("sub.tscn", attached="res://base.gd"), file("t.gd", tool=True),
    ]
    bodies = {
        ("base.gd", "draw"): "func draw():\n\tpass", ("base.gd", "deep"): "func deep():\n\tself.draw()", ("s/mid.gd", "other"): "func other():\n\tdraw()", ("leaf.gd", "draw"): "func draw():\n\tpass",
        ("user.gd", "on_press"): 'func on_press():\n\tBase.draw() # Leaf.draw()\n\tvar s = "deep()"', ("user.gd", "go"): "func go(x: Mid):\n\tx.other()\n\tm.deep()\n\tself.m.other()\n\thelp()\n\tlone()\n\tzz.loose()",
        ("lib/tools.gd", "help"): "func help():\n\tpass", ("odd.py", "lone"): "def lone():\n    pass", ("odd.py", "_hook"): "def _hook():\n    pass", ("odd.py", "loose"): "def loose():\n    pass",
        ("t.gd", "tooled"): "func tooled():\n\tpass", ("t.gd", "never"): "func never():\n\tpass", ("a.gd", "spin"): "func spin():\n\tmissing()", ("user.gd", "_ready"): "func _ready():\n\tgo(null)",
    }
    params = {("user.gd", "go"): [("x", "Mid")]}
    funcs = [(k, "r", p, n, k, b, params.get((p, n))) for k, ((p, n), b) in enumerate(bodies.items(), 1)]
    f, fn = spark.createDataFrame(files, FILES), spark.createDataFrame(funcs + [(99, "r", "gone.gd", "x", 1, "x()", None), (98, None, None, None, None, None, None)], FUNCS)
    decl = K.declarations(fn, f).persist()
    up = K.lineage(f)
    return f, decl, up, K.resolve_calls(decl, f, up, K.call_sites(decl)).persist()


def test_lineage_has_no_limit_and_ends_at_cycles(spark, corpus):
    assert {(r["path"], r["up"], r["depth"]) for r in corpus[2].collect()} == {("s/mid.gd", "base.gd", 1), ("leaf.gd", "s/mid.gd", 1), ("leaf.gd", "base.gd", 2), ("a.gd", "b.gd", 1), ("b.gd", "a.gd", 1), ("a.gd", "a.gd", 2), ("b.gd", "b.gd", 2)}
    chain = spark.createDataFrame([("r", f"C{k}", f"C{k + 1}") for k in range(12)], "repo string, class_name string, extends string")
    assert R.ancestors(chain).where("class_name = 'C0'").count() == 12


def test_calls_land_by_the_first_rule(corpus):
    got = {(r["key"].split("|")[1], r["head"], r["recv"], r["callee"]): (r["loc"], r["rule"], r["depth"]) for r in corpus[3].collect()}
    assert got[("base.gd::deep", "", "self", "draw")] == ("base.gd", 1, 0)
    assert got[("s/mid.gd::other", "", "", "draw")] == ("base.gd", 2, 1)
    assert got[("user.gd::on_press", "", "Base", "draw")] == ("base.gd", 3, 0)
    assert got[("user.gd::go", "", "x", "other")] == ("s/mid.gd", 5, 0)
    assert got[("user.gd::go", "", "m", "deep")] == ("base.gd", 6, 1)
    assert got[("user.gd::go", "self", "m", "other")] == ("s/mid.gd", 6, 0)
    assert got[("user.gd::go", "", "", "help")] == ("lib/tools.gd", 10, 0)
    assert got[("user.gd::go", "", "", "lone")] == ("odd.py", 11, 0)
    assert got[("user.gd::go", "", "zz", "loose")] == (None, None, None) and got[("a.gd::spin", "", "", "missing")] == (None, None, None)
    assert not {k for k in got if k[3] == "deep" and k[0] == "user.gd::on_press"}  # within a literal


def test_edges_of_overrides_and_scenes(corpus):
    f, decl, up, calls = corpus
    e = {(r["src_key"][2:], r["dst_key"][2:]) for r in K.call_edges(calls, decl, up).collect()}
    assert {("s/mid.gd::other", "base.gd::draw"), ("s/mid.gd::other", "leaf.gd::draw"), ("user.gd::on_press", "leaf.gd::draw")} <= e
    scripts = K.scene_scripts(f)
    assert {(r["scene"], r["script"]) for r in scripts.collect()} == {("main.tscn", "user.gd"), ("sub.tscn", "base.gd")}
    got = {(r["src_key"][2:], r["dst_key"][2:], r["type"]) for r in K.scene_edges(f, decl, scripts).collect()}
    assert got == {("main.tscn::tscn", "user.gd", "attach"), ("sub.tscn::tscn", "base.gd", "attach"), ("main.tscn::tscn", "sub.tscn::tscn", "inst"), ("main.tscn::tscn", "user.gd::on_press", "signal")}
    assert {(r["signal"], r["script"]) for r in K.signal_handlers(f, decl, scripts).collect()} == {("pressed", "user.gd"), ("gone", None)}


def test_liveness(spark, corpus):
    f, decl, up, calls = corpus
    scripts = K.scene_scripts(f)
    roots = K.entry_keys(decl, f, calls, K.signal_handlers(f, decl, scripts))
    assert {r["key"][2:] for r in roots.collect()} == {"user.gd::_ready", "t.gd::tooled", "t.gd::never", "user.gd::on_press", "odd.py::loose"}
    alive = G.walk(K.call_edges(calls, decl, up), roots, None)
    said = spark.createDataFrame([("spin", 5)], "token string, n long")
    dead = {r["name"]: r["tier"] for r in K.dead_functions(decl, f, alive, said).collect()}
    assert dead == {"_hook": "review", "spin": "likely"}
    view = K.dead_view(K.dead_functions(decl, f, alive, said), 1).collect()
    assert [(r["tier"], r["shown"], r["total"]) for r in view] == [("likely", 1, 1)]


def test_symbols(corpus):
    f, decl, up, calls = corpus
    keys = lambda s: sorted(r["key"][2:] for r in K.resolve_symbol(decl, K.class_map(f), s).collect())
    assert keys("draw") == ["base.gd::draw", "leaf.gd::draw"] and keys("Base") == ["base.gd::deep", "base.gd::draw"] and keys("EE") == ["base.gd::deep"] and keys("none such") == []
    view = K.symbol_view(K.call_edges(calls, decl, up), K.resolve_symbol(decl, K.class_map(f), "deep"), 2, names=1).orderBy("hop", "key").collect()
    assert view[0]["key"] == "r|base.gd::deep" and view[0]["n_callees"] == 2 and len(view[0]["callees"]) == 1 and {r["n_nodes"] for r in view} == {4}


def test_empty_corpus(spark, corpus):
    f, fn = spark.createDataFrame([], FILES), spark.createDataFrame([], FUNCS)
    decl = K.declarations(fn, f)
    up = K.lineage(f)
    calls = K.resolve_calls(decl, f, up, K.call_sites(decl))
    assert calls.count() == up.count() == K.call_edges(calls, decl, up).count() == 0


def test_owner_is_the_first_span_that_holds_the_line(spark):
    fn = spark.createDataFrame([("r", "p", "outer", 1, "\n" * 20), ("r", "p", "inner", 5, "\n" * 3), ("r", "p", "late", 30, None)], "repo string, path string, name string, line int, body string")
    sites = spark.createDataFrame([("r", "p", x) for x in (0, 1, 6, 15, 22, 30, 31)], "repo string, path string, line int")
    assert {r["line"]: r["owner"] for r in R.owners(sites, fn).collect()} == {0: None, 1: "outer", 6: "outer", 15: "outer", 22: None, 30: "late", 31: None}
    assert R.owners(sites, fn, block=2).where("owner is not null").count() == 4


def test_imports_and_headers(spark):
    f = [("r", p, i) for p, i in {"src/app/main.ts": ["./util", "@/lib/core", "../top", "gone"], "src/app/util.ts": [], "src/lib/core/index.ts": [], "src/top.js": None, "pkg/a.py": ["pkg.b", "thing"], "pkg/b.py": [], "x/thing.rs": []}.items()]
    files = spark.createDataFrame(f, "repo string, path string, imported_modules array<string>")
    got = {(r["path"], r["module"]): r["target"] for r in R.resolved_imports(files, {"@/": "src/"}).collect()}
    assert got == {("src/app/main.ts", "./util"): "src/app/util.ts", ("src/app/main.ts", "@/lib/core"): "src/lib/core/index.ts", ("src/app/main.ts", "../top"): "src/top.js", ("src/app/main.ts", "gone"): None, ("pkg/a.py", "pkg.b"): "pkg/b.py", ("pkg/a.py", "thing"): "x/thing.rs"}
    c = spark.createDataFrame([("r", p) for p in ("a/x.c", "a/x.h", "b/x.h", "y.cpp", "inc/z.h", "w.c", "k.cpp", "k.hpp")], "repo string, path string")
    inc = spark.createDataFrame([("r", "y.cpp", "nope.h"), ("r", "y.cpp", "inc/z.h"), ("r", "w.c", "inc/z.h")], "repo string, path string, include string")
    assert {(r["path"], r["header"], r["rule"]) for r in R.header_pairs(c, inc).collect()} == {("a/x.c", "a/x.h", 1), ("y.cpp", "inc/z.h", 2), ("k.cpp", "k.hpp", 1)}
