import numpy as np
import pytest

from pyspark.sql import functions as F

from quillgraph import cli
from quillgraph.functions import bodies as B
from quillgraph.functions import text as T
from quillgraph.operators import grouping as U
from quillgraph.sources.predicates import Predicates, guard_store


DELEGATES = [
    ("if v is None: return None\nreturn _shared(v)", False, True),
    ("if v is None: v = []\nreturn _shared(v)", False, True),
    ("t = x or 0\nreturn _shared(t)", False, True),
    ("if a: return\nif b: return\nreturn _shared(v)", False, True),
    ("if v: v = f(v)\nreturn _shared(v)", False, False),
    ("if v: return f(v)\nreturn _shared(v)", False, False),
    ("t = f(x)\nreturn _shared(t)", False, False),
    ("if a: return\nreturn f(v) or 0", False, False),
    ("if a: return\nif b: return\nif c: return\nreturn _shared(v)", False, False),
    ("function f(a) { return g(a); }", True, True),
    ("{\n  return g(a);\n}", True, True),
    ("int f(int a)\n{\n  return g(a);\n}", True, True),
    ("function f(a) { h(a); return g(a); }", True, False),
]


def test_delegates(spark):
    rows = [(k, body, ".js" if braces else ".gd", want) for k, (body, braces, want) in enumerate(DELEGATES)]
    df = spark.createDataFrame(rows + [(99, "function f(a) { return g(a); }", ".rs", False)], "k long, body string, ext string, want boolean")
    got = df.select("k", "want", T.is_delegate(T.normal_body(F.col("body"), F.col("ext")), F.col("ext")).alias("d")).collect()
    assert not [(DELEGATES[r["k"]] if r["k"] < 99 else "rs") for r in got if r["d"] != r["want"]]


def test_folding_and_intro():
    assert B.fold_lines("a = f(1,\n  2)\nb = 3 + \\\n  4") == ["a = f(1, 2)", "b = 3 + 4"]
    assert B.fold_lines('x = "("\ny = 1') == ['x = "("', "y = 1"]
    assert B.intro('"""One\ntwo."""\nx = 1') == "One two." and B.intro("// a\n// b\nint x;") == "a b" and B.intro("x = 1") == ""
    assert B.intro("# " + "x" * 99, 48) == "x" * 48


def test_spans_and_blocks():
    t = 'f(a, ")", [1, {2: "]"}])(x)'
    assert t[1 : B.balanced_span(t, 1)] == '(a, ")", [1, {2: "]"}])' and B.balanced_span(t, 0) == -1 and B.balanced_span("(]", 0) == -1 and B.balanced_span("((a)", 0) == -1
    lines = ["def f():", "    a = 1", "", "    s = \"\"\"", "text", "\"\"\"", "    return a", "", "", "b = 2"]
    assert B.indented_block(lines, 1, 0) == 7 and B.indented_block(lines, 9, 0) == 9 and B.indented_block(["  x", ""], 0, 0) == 1


def test_sql_functions(spark):
    assert "rrf" in B.register(spark)
    assert spark.sql("SELECT rrf(1L, 31D) AS a, node_file('a.py::b') AS b").first() == (1.0, "a.py")


def test_weld_caps_units(spark):
    links = spark.createDataFrame([(f"n{k:02}", f"n{k + 1:02}") for k in range(29)] + [("x", "y")], "a string, b string")
    units = {}
    for r in U.weld(links, rounds=40).collect():
        units.setdefault(r["unit"], []).append(r["node"])
    assert sorted(map(len, units.values())) == [2, 6, 12, 12] and units["x"] == ["x", "y"]
    assert U.weld(links.limit(0)).count() == 0


def test_average_linkage(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(3, 16))
    v = np.concatenate([b + rng.normal(size=(5, 16)) * 0.1 for b in base])
    got = U.average_linkage(v, 0.65)
    assert [len(set(got[k : k + 5])) for k in (0, 5, 10)] == [1, 1, 1] and len(set(got)) == 3
    rows = spark.createDataFrame([(1, k, [float(x) for x in r]) for k, r in enumerate(v)], "grp int, id long, embedding array<float>")
    assert U.split_groups(rows).select("part").distinct().count() == 3
    assert U.split_groups(rows, most=4).count() == 15


def test_predicates(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "i int, t string")
    make = lambda df: Predicates(spark, f"file://{tmp_path}/facts", {"rows": df}, {"n": lambda: df.groupBy("t").count()})
    p = make(rows)
    assert p.load()["n"].count() == 2 and p.made == 1
    q = make(rows)
    assert q.load()["n"].count() == 2 and q.made == 0
    r = make(rows.limit(1))
    assert r.load()["n"].count() == 1 and r.made == 1
    for args in ((0, 0), (5, 0), (5, 2)):
        with pytest.raises(ValueError):
            guard_store(*args)
    guard_store(5, 3)


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("def walk_tree(x):\n    return x\n")
    (tmp_path / "src/b.py").write_text("class TreeWalker:\n    pass\n")
    root, store = str(tmp_path / "src"), f"file://{tmp_path}/store"
    assert cli.rescan(spark, root, store) == {"added": 2}
    assert cli.rescan(spark, root, store) == {"unchanged": 2}
    (tmp_path / "src/b.py").write_text("class TreeWalker:\n    depth = 1\n")
    assert cli.rescan(spark, root, store) == {"unchanged": 1, "updated": 1}
    assert [r["path"] for r in cli.search(spark, store, "walker tree").collect()][0] == "b.py"
    assert cli.main(["count", store]) == 0 and capsys.readouterr().out.strip().endswith("2")
    assert cli.main(["find", store, "("]) == 1
    cli.main(["export-base", store, f"file://{tmp_path}/base"])
    cli.main(["drop", store])
    cli.main(["import-base", store, f"file://{tmp_path}/base"])
    cli.main(["count", store])
    assert capsys.readouterr().out.strip().endswith("2")
    assert cli.search(spark, f"file://{tmp_path}/none", "x").count() == 0


def test_linkage_of_large_groups(spark):
    rng = np.random.default_rng(4)
    for n, least in ((1, 0.2), (40, -1.0), (150, 0.2), (150, 0.5), (150, 2.0)):
        v = rng.normal(size=(n, 8)) + 2 * rng.normal(size=(6, 8))[rng.integers(0, 6, n)]
        assert (U.chained_linkage(v, least) == U.average_linkage(v, least)).all()
    rows = spark.createDataFrame([("a", i, [float(x) for x in v[i % 30]]) for i in range(90)], "grp string, id long, embedding array<double>")
    small = {(r["id"], r["part"]) for r in U.split_groups(rows, 0.5).collect()}
    large = {(r["id"], r["part"]) for r in U.split_groups(rows, 0.5, most=20).collect()}
    assert small == large and len({p for _, p in large}) < 30


def test_weld_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(24)], "a string, b string")
    assert {r["unit"] for r in U.weld(links, cap=50).collect()} == {"n00"}
