"""First ranks of held-out items: odd rows against their SQL, and what is moved to find them."""

import duckdb
import pytest

import __spark_entry__ as entry
from quillgraph.operators.firsts import first_ranks
from quillgraph.sources import adapters as A


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents that were delivered twice or share a path, short, foreign, empty and repeated items."""
    d = str(tmp_path_factory.mktemp("odd"))
    passage = "the gate of buildNolo reads fifteen older rows before any scene is left behind by it"
    texts = [passage + " once", "x " + passage, passage, "Änderung der Suchergebnisse GrößeABC nach Neustart", "reads older rows", "", None, "gate gate scene rows", "HTTPServer42 a b c reads 7"]
    rows = [(k % 37, ["r", None][k % 2], "p", ["doc", None][k % 3 == 0], ["Gate", None][k % 5 == 0], ["wiki", None][k % 4 == 0], texts[k % len(texts)]) for k in range(90)] + [(None, "r", "p", "doc", "t", "s", passage)] * 2
    spark.createDataFrame(rows, "doc_id long, repo string, path string, kind string, title string, source string, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    items = [(1, "a", passage), (2, "a", "older rows"), (3, "b", "Neustart GrößeABC"), (4, "b", None), (5, None, "nowhere to be found at all"), (1, "a", "scene rows and more"), (6, "c", "HTTPServer42"), (7, "c", "a b"), (None, "c", "gate"), (6, "d", "older rows")]
    spark.createDataFrame(items, "item_id long, suite string, text string").coalesce(1).write.parquet(f"{d}/eval_items.parquet")
    return d


def sql(d, name):
    con = duckdb.connect()
    for t in ("documents", "eval_items"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    cur = con.execute(entry.oracle_sql()[name])
    return [c[0] for c in cur.description], cur.fetchall()


def same_as_sql(spark, d, name):
    columns, rows = sql(d, name)
    got = [tuple(r[c] for c in columns) for r in entry.queries()[name](spark, d).collect()]
    return sorted(map(repr, got)) == sorted(map(repr, rows))


def shuffled(spark, run):
    """MB written for shuffles while ``run`` runs."""

    def told() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        each = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(each.apply(k).totalShuffleWrite() for k in range(each.size()))

    before = told()
    run()
    return (told() - before) / 1e6


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """150 items that share most words with each of 3 000 documents."""
    d = str(tmp_path_factory.mktemp("crowd"))
    words = [f"{a}{b}" for a in ("gate", "scene", "rows", "older") for b in ("left", "right", "up", "down", "in")]
    text = lambda k: " ".join(words[(k * (j + 3) + j * j) % len(words)] for j in range(30))
    spark.createDataFrame([(k, "r", "p", "doc", "t", "s", text(k) + f" n{k % 500}x") for k in range(3000)], "doc_id long, repo string, path string, kind string, title string, source string, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, "ab"[k % 2], f"{text(k)} extra{k}") for k in range(150)], "item_id long, suite string, text string").write.parquet(f"{d}/eval_items.parquet")
    return d


def test_odd_rows(spark, odd):
    for name in ("golden_ranks", "hard_easy", "mrr_by_kind", "hit_at_k"):
        assert same_as_sql(spark, odd, name), name


def test_blocks_of_items_tell_the_same(spark, odd):
    items, docs = A.table(spark, odd, "eval_items"), A.docs(spark, odd)
    tell = lambda block: sorted(map(repr, first_ranks(items, docs, 12, block).collect()))
    assert tell(1) == tell(2) == tell(4096)
    assert [r["first"] for r in first_ranks(items, docs.limit(0), 12).collect()] == [None] * 9 and first_ranks(items.limit(0), docs, 12).count() == 0


def test_hard_easy_moves_little(spark, crowd):
    assert same_as_sql(spark, crowd, "hard_easy")
    assert shuffled(spark, lambda: entry.queries()["hard_easy"](spark, crowd).collect()) < 1


def test_mrr_by_kind_moves_little(spark, crowd):
    assert same_as_sql(spark, crowd, "mrr_by_kind")
    assert shuffled(spark, lambda: entry.queries()["mrr_by_kind"](spark, crowd).collect()) < 1


def test_golden_ranks_moves_little(spark, crowd):
    assert same_as_sql(spark, crowd, "golden_ranks")
    assert shuffled(spark, lambda: entry.queries()["golden_ranks"](spark, crowd).collect()) < 1
