"""The queries of the package over the smallest tables; those with SQL against it."""

import os
import sys

import duckdb
import pytest

from quillgraph.llm.queries import ORACLE, QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))
from compare import plain  # noqa: E402

COLUMNS = {
    "p1_found": ["func_a", "func_b"], "p2_found": ["vec_a", "vec_b"], "p4_found": ["file_id"], "p5_found": ["keep_id", "func_id"], "p6_found": ["cluster_id", "term"],
    "p7_found": ["func_id", "piece", "start_pos", "end_pos", "start_line"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "lang"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data):
    df = QUERIES[name](spark, data)
    assert df.columns == COLUMNS.get(name, df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    assert name in ("p8_ids",) or not name.endswith("_found") or len(got) == len(set(got))
    if name in ORACLE:
        con = duckdb.connect()
        for f in os.listdir(data):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
        cur = con.execute(ORACLE[name])
        cols = [c[0] for c in cur.description]
        order = sorted(range(len(cols)), key=lambda k: cols[k])
        assert got == sorted(repr(tuple(plain(r[k]) for k in order)) for r in cur.fetchall())
