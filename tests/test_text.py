import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import recall as R
from quillgraph.operators import shaping as D
from quillgraph.operators import textsearch as S
from quillgraph.plans.recall import passage_targets


@pytest.mark.parametrize("text,tokens", [
    ("BM25F parseGd XMLReader foo_bar a_b v2_beta", "bm 25 parse gd xml reader foo bar beta"),
    ("über", "ber über"),
    ("玩家碰撞", "玩家碰撞"),
    ("", ""),
    (None, ""),
])
def test_tokens(spark, text, tokens):
    row = spark.createDataFrame([(text,)], "t string").select(T.recall_tokens(F.col("t")).alias("x")).first()
    assert row["x"] == tokens.split()


def corpus(spark):
    rows = [("src/alpha.py", "sharedneedle sharedneedle\nneedlealpha\nsharedneedle"), ("src/beta.py", "sharedneedle\nneedlebeta"), ("src/big.py", "\n".join(["manyneedle"] * 6)), ("src/gamma.py", "longneedle " + "x" * 300)]
    rows += [(f"src/cap{i:02}.py", "capneedle") for i in range(25)]
    return spark.createDataFrame(rows, "path string, body string")


def test_search_caps_and_totals(spark):
    c = corpus(spark)
    many = S.search_text(c, "manyneedle").collect()
    assert len(many) == 3 and {(r.n_matches, r.n_files, r.in_file) for r in many} == {(6, 1, 6)}
    cap = S.search_text(c, "capneedle").collect()
    assert len({r.path for r in cap}) == 20 and cap[0].n_files == 25
    long = S.search_text(c, "longneedle").first()
    assert len(long.text) == 201 and long.text.endswith("…")
    assert S.search_text(c, "shared", "*beta*").count() == 1
    assert S.bad_pattern(c, "") and S.bad_pattern(c, "(") and S.bad_pattern(c, "a+") is None


def test_glob():
    assert T.glob_regex("a*.p?") == r"(?s)^a.*\.p.$"


def test_ranking_is_total(spark):
    docs = spark.createDataFrame([(f"d{i}", f"d{i}", "", "", "same words here") for i in range(5)] + [("e", "e", None, None, None)], "path string, filename string, class_name string, symbols string, body string")
    got = R.ranked(R.bm25f(docs, {"q": "same words"}), "bm25", ["q"], "path").orderBy("rank").collect()
    assert [r["path"] for r in got] == [f"d{i}" for i in range(5)]
    assert R.bm25f(docs, {"q": "?"}).count() == 0
    assert R.bm25f(docs.limit(0), {"q": "same"}).count() == 0


@pytest.mark.parametrize("lines,starts", [
    (["def f():", "  a = 1", "  b = 2", "  if a:", "    c = 3", "  d = 4", "  return d"], [1, 2, 3, 5, 6]),
    (["def f():", "  x = (1 +", "    2)", "  y = x", "  return y"], [1, 3, 4]),
    (["def f():", '  s = """', "  return", '  """', "  return s"], [1, 4]),
])
def test_statement_starts(lines, starts):
    assert D.statement_starts(lines) == starts


def test_chunks_cover(spark):
    body = "def f():\n" + "\n".join(f"  x{i} = {i}" for i in range(400))
    got = D.chunk_lines(body, 500)
    lines = body.split("\n")
    assert got[0][0] == 0 and got[-1][1] == len(lines) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert all(sum(len(x) + 1 for x in lines[a:b]) <= 500 for a, b in got)


def test_targets_of_whole_items(spark):
    item = " ".join(f"word{chr(97 + k)}" for k in range(20))
    tail, tok = " ".join(item.split()[7:]), R.recall_tokens(F.col("text"))
    items = spark.createDataFrame([(1, item), (2, "two words"), (3, ""), (4, None)], "item_id long, text string").select("item_id", tok.alias("tk"))
    bodies = {"whole": item, "tail": f"before {tail} after", "lead": " ".join(item.split()[:8]), "short": "here are two words", "none": "two other words", "empty": ""}
    docs = spark.createDataFrame(list(bodies.items()), "path string, body string")
    got = {(r["item_id"], r["path"]) for r in passage_targets(items, docs).collect()}
    assert got == {(1, "whole"), (1, "tail"), (2, "short")}
    assert passage_targets(items.limit(0), docs).count() == 0 and passage_targets(items, docs.limit(0)).count() == 0


def test_vector_side_needs_no_query_word(spark):
    docs = spark.createDataFrame([("a", "feline"), ("b", "cat"), ("c", "truck")], "path string, body string")
    docs = docs.select("path", *[F.lit("").alias(f) for f in ("filename", "class_name", "symbols")], "body")

    def embed(rows, key, text):
        two = F.when(text.rlike("cat|feline"), F.array(F.lit(1.0), F.lit(0.1))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
        return rows.select(key, two.cast("array<float>").alias("embedding"))

    got = [(r["q"], r["path"], r["rank"]) for r in R.vector_side(docs, {"x": "cat", "y": "lorry"}, embed, top=2).orderBy("q", "rank").collect()]
    assert got == [("x", "a", 1), ("x", "b", 2), ("y", "c", 1), ("y", "a", 2)]
    assert {r["path"] for r in R.bm25f(docs, {"x": "cat"}).collect()} == {"b"}
