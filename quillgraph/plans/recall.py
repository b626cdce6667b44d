"""Lexical, vector and hybrid retrieval with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.operators import recall as R
from quillgraph.operators.firsts import first_ranks
from quillgraph.plans.text import tokens_sql
from quillgraph.session import stage
from quillgraph.sources import adapters as A

QUERIES, ORACLE = {}, {}
#: The stated query set of the retrieval queries.
ASKED = {
    "q1": "dead functions rebuilt after restart",
    "q2": "vectors share the same keys as search results",
    "q3": "bake stale shards clusters clusters",
    "q4": "Änderung der Suchergebnisse nach Neustart",
}
TOP = 10


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


_FIELDS = "\n UNION ALL ".join(f"SELECT path, unnest({tokens_sql(f)}) AS term, {w} AS w FROM docs" for f, w in (("filename", 5), ("class_name", 5), ("symbols", 3), ("path", 2), ("body", 1)))
INDEX = f"""{A.DOCS}, tk AS ({_FIELDS}), post AS (SELECT path, term, sum(w)::DOUBLE AS wtf FROM tk GROUP BY ALL),
len AS (SELECT path, sum(w)::DOUBLE AS wlen FROM tk GROUP BY ALL), ag AS (SELECT count(*) AS n, avg(wlen) AS av FROM len),
df AS (SELECT term, count(*) AS df FROM post GROUP BY ALL)"""
_ASK = " UNION ALL ".join(f"SELECT '{k}' AS q, '{v}' AS text" for k, v in ASKED.items())
BM25 = f"""{INDEX}, ask AS ({_ASK}), qt AS (SELECT q, term, count(*) AS mult FROM (SELECT q, unnest({tokens_sql('text')}) AS term FROM ask) GROUP BY ALL),
bm AS (SELECT q, path, sum(mult * ln(1 + (n - df + 0.5) / (df + 0.5)) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * wlen / av))) AS bm25
  FROM qt JOIN post USING (term) JOIN df USING (term) JOIN len USING (path), ag GROUP BY ALL),
lex AS (SELECT * FROM (SELECT q, path, round(bm25, 6) AS bm25, row_number() OVER (PARTITION BY q ORDER BY round(bm25, 6) DESC, path) AS rank FROM bm WHERE bm25 > 0))"""
#: Depth of each side before it is fused.
DEPTH = 40


def place_sql(term: str) -> str:
    """Component and sign of a token from the digits of its digest."""
    d = "strpos('0123456789abcdef', substr(md5({t}), {k}, 1)) - 1"
    return f"((({d.format(t=term, k=1)}) * 16 + {d.format(t=term, k=2)}) % 64) AS pos, CASE WHEN {d.format(t=term, k=3)} < 8 THEN 1.0 ELSE -1.0 END AS sg"


def cosine_sql(name: str, rows: str, key: str, ask: str) -> str:
    """``name`` (q, key, cos, rank): all rows (key, text) by cosine with the queries of ``ask`` (q, text), zero vectors left out."""
    return f"""{name}_t AS (SELECT {key}, unnest({tokens_sql('text')}) AS term FROM ({rows})), {name}_v AS MATERIALIZED (SELECT {key}, pos, sum(sg)::DOUBLE AS v FROM (SELECT {key}, {place_sql('term')} FROM {name}_t) GROUP BY ALL),
{name}_n AS MATERIALIZED (SELECT {key}, sqrt(sum(v * v)) AS n FROM {name}_v GROUP BY ALL HAVING sum(v * v) > 0), {name}_qt AS (SELECT q, unnest({tokens_sql('text')}) AS term FROM {ask}),
{name}_qv AS MATERIALIZED (SELECT q, pos, sum(sg)::DOUBLE AS v FROM (SELECT q, {place_sql('term')} FROM {name}_qt) GROUP BY ALL), {name}_qn AS (SELECT q, sqrt(sum(v * v)) AS n FROM {name}_qv GROUP BY ALL HAVING sum(v * v) > 0),
{name}_d AS (SELECT q, {key}, sum(a.v * b.v) AS d FROM {name}_qv a JOIN {name}_v b USING (pos) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT q, {key}, cos, row_number() OVER (PARTITION BY q ORDER BY cos DESC, {key}) AS rank FROM (SELECT qn.q, dn.{key}, round(coalesce(d, 0) / qn.n / dn.n, 6) AS cos FROM {name}_qn qn, {name}_n dn LEFT JOIN {name}_d dd ON dd.q = qn.q AND dd.{key} = dn.{key}))"""


_DOC_TEXT = "SELECT path, class_name || chr(10) || symbols || chr(10) || body AS text FROM docs"
SIDE = f"{BM25}, {cosine_sql('vec', _DOC_TEXT, 'path', 'ask')}"


def fuse_sql(w: float = 1.0, k: int = 30, depth: int = DEPTH) -> str:
    return f"""fu AS (SELECT q, path, sum(s) AS score, CASE WHEN count(DISTINCT side) > 1 THEN 'both' ELSE min(side) END AS src FROM (
  SELECT q, path, 1.0::DOUBLE / ({k} + rank) AS s, 'bm25' AS side FROM lex WHERE rank <= {depth} UNION ALL SELECT q, path, {w}::DOUBLE / ({k} + rank), 'vec' FROM vec WHERE rank <= {depth}) GROUP BY ALL)"""


# Documents about the same file of a repository are wired, each to the next in order.
WIRES = """wires AS (SELECT src_file, dst_file, count(*) AS w FROM (SELECT file AS src_file, lead(file) OVER (PARTITION BY repo, path ORDER BY file) AS dst_file FROM
  (SELECT repo, path, concat_ws('/', repo, coalesce(kind, ''), 'doc' || doc_id || '.md') AS file FROM documents WHERE repo <> '' AND path <> '')) WHERE dst_file IS NOT NULL AND src_file <> dst_file GROUP BY ALL)"""


def _wires(s, d):
    w = Window.partitionBy("repo", "path").orderBy("file")
    file = F.concat_ws("/", "repo", F.coalesce("kind", F.lit("")), F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".md")))
    pairs = A.table(s, d, "documents").where("repo <> '' and path <> ''").select("repo", "path", file.alias("file")).select(F.col("file").alias("src_file"), F.lead("file").over(w).alias("dst_file"))
    return pairs.where("dst_file is not null and src_file <> dst_file").groupBy("src_file", "dst_file").agg(F.count("*").alias("w"))


def _lex(s, d, asked=None):
    return R.ranked(R.bm25f(A.docs(s, d), asked or ASKED), "bm25", ["q"], "path")


def _vec(s, d, asked=None):
    return R.vector_side(A.docs(s, d), asked or ASKED, top=DEPTH)


def _sides(s, d, asked=None):
    """Both ranked sides cut to their depth, kept for all that follows."""
    return stage(_lex(s, d, asked).where(F.col("rank") <= DEPTH), "lexical"), stage(_vec(s, d, asked), "vectors")


def _fused(s, d, w=1.0, k=30, depth=DEPTH, sides=None):
    lex, vec = sides or (_lex(s, d), _vec(s, d))
    return R.rrf([("bm25", lex.where(F.col("rank") <= depth), 1.0), ("vec", vec.where(F.col("rank") <= depth), w)], k)


@query(f"WITH {INDEX} SELECT path, term, wtf FROM post")
def postings(s, d):
    return R.postings(A.docs(s, d))


@query(f"WITH {INDEX} SELECT path, wlen FROM len")
def doc_len(s, d):
    return R.doc_lengths(A.docs(s, d))


@query(f"WITH {INDEX} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS idf FROM df, ag")
def idf(s, d):
    return R.term_stats(A.docs(s, d)).select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {BM25} SELECT path, bm25, rank FROM lex WHERE q = 'q1' AND rank <= {TOP}")
def bm25f_topk(s, d):
    one = R.ranked(R.bm25f(A.docs(s, d), {"q1": ASKED["q1"]}), "bm25", ["q"], "path")
    return one.where(F.col("rank") <= TOP).select("path", "bm25", "rank")


@query(f"WITH {BM25} SELECT q, path, bm25, rank FROM lex WHERE rank <= {TOP}")
def bm25f_multi_query(s, d):
    return _lex(s, d).where(F.col("rank") <= TOP).select("q", "path", "bm25", "rank")


@query(f"WITH {SIDE}, {fuse_sql()} SELECT q, path, round(score, 6) AS score, src FROM fu")
def rrf_fuse(s, d):
    return _fused(s, d).select("q", "path", F.round("score", 6).alias("score"), "src")


@query(f"WITH {SIDE}, {fuse_sql(0.5, 10)} SELECT q, path, round(score, 6) AS score, src FROM fu")
def rrf_weighted(s, d):
    return _fused(s, d, 0.5, 10).select("q", "path", F.round("score", 6).alias("score"), "src")


_BOOST = f"""{SIDE}, {fuse_sql()}, {WIRES}, rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, path) AS pos FROM fu),
nb AS (SELECT DISTINCT src_file, dst_file FROM (SELECT src_file, dst_file FROM wires UNION ALL SELECT dst_file, src_file FROM wires)),
bo AS (SELECT q, path, sum(score) AS score, coalesce(min(CASE WHEN src <> 'graph' THEN src END), 'graph') AS src FROM (SELECT q, path, score, src FROM fu
  UNION ALL SELECT q, dst_file, 0.25::DOUBLE / 31 / pos, 'graph' FROM rk JOIN nb ON rk.path = nb.src_file WHERE pos <= {TOP}) GROUP BY ALL),
top AS (SELECT * FROM (SELECT q, path, round(score, 6) AS score, src, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, path) AS rank FROM bo) WHERE rank <= {TOP})"""


def _boosted(s, d, sides=None):
    fused = stage(_fused(s, d, sides=sides), "fused")
    return R.ranked(R.graph_boost(fused, _wires(s, d), TOP), "score", ["q"], "path").where(F.col("rank") <= TOP)


@query(f"WITH {_BOOST} SELECT q, path, score, src, rank FROM top")
def graph_boost(s, d):
    return _boosted(s, d).select("q", "path", "score", "src", "rank")


_CTX = """bth AS (SELECT src_file AS path, dst_file AS nb, w FROM wires UNION ALL SELECT dst_file, src_file, w FROM wires), bs AS (SELECT path, nb, sum(w) AS w FROM bth GROUP BY ALL),
ctx AS (SELECT path, list(nb ORDER BY r) AS ctx FROM (SELECT path, nb, row_number() OVER (PARTITION BY path ORDER BY w DESC, nb) AS r FROM bs) WHERE r <= 3 GROUP BY ALL)"""


@query(f"WITH {A.DOCS}, {WIRES}, {_CTX} SELECT path, ctx FROM ctx")
def hop_context(s, d):
    return R.hop_context(A.docs(s, d), _wires(s, d))


@query(f"WITH {SIDE} SELECT q, path, coalesce(cos, -1) < 0.48 AND coalesce(bm25, -1) < 6 AS weak FROM (SELECT q, path, cos FROM vec WHERE rank <= 20) FULL JOIN (SELECT q, path, bm25 FROM lex WHERE rank <= 20) USING (q, path)")
def weak_flag(s, d):
    both = _vec(s, d).where("rank <= 20").select("q", "path", "cos").join(_lex(s, d).where("rank <= 20").select("q", "path", "bm25"), ["q", "path"], "full")
    return both.select("q", "path", R.weak(F.col("cos"), F.col("bm25")).alias("weak"))


_HYBRID_SQL = f"""WITH {_BOOST}, {_CTX} SELECT top.q, top.path, top.score, top.src, top.rank, docs.class_name, docs.symbols, coalesce(vec.cos, -1) < 0.48 AND coalesce(lex.bm25, -1) < 6 AS weak,
  coalesce(ctx.ctx, []) AS ctx FROM top JOIN docs ON docs.path = top.path LEFT JOIN lex ON lex.q = top.q AND lex.path = top.path AND lex.rank <= {DEPTH} LEFT JOIN vec ON vec.q = top.q AND vec.path = top.path AND vec.rank <= {DEPTH} LEFT JOIN ctx ON ctx.path = top.path"""


@query(_HYBRID_SQL)
def hybrid_search(s, d):
    """Retrieve on both sides, fuse, boost, flag and explain: one plan for the whole query set."""
    lex, vec = _sides(s, d)
    top = stage(_boosted(s, d, (lex, vec)), "top")
    hits = top.join(A.docs(s, d).select("path", "class_name", "symbols"), "path")
    hits = hits.join(lex.select("q", "path", "bm25"), ["q", "path"], "left").join(vec.select("q", "path", "cos"), ["q", "path"], "left")
    hits = hits.join(R.hop_context(top, _wires(s, d)), "path", "left")
    none = F.array().cast("array<string>")
    return hits.select("q", "path", "score", "src", "rank", "class_name", "symbols", R.weak(F.col("cos"), F.col("bm25")).alias("weak"), F.coalesce("ctx", none).alias("ctx"))


_POOL, _ROOM = 12, 320
_SECOND = f"""dn AS (SELECT q, word, min(rank) AS rank FROM (SELECT lex.q, lex.rank, concat_ws(' ', class_name, symbols) AS word FROM lex JOIN docs USING (path) WHERE lex.rank <= {_POOL}) WHERE word <> ' ' GROUP BY ALL),
ds AS (SELECT q, left(string_agg(word, ' ' ORDER BY rank, word), {_ROOM}) AS added FROM dn GROUP BY ALL), ask2 AS (SELECT ask.q, ask.text || chr(10) || coalesce(added, '') AS text FROM ask LEFT JOIN ds USING (q)),
qt2 AS (SELECT q, term, count(*) AS mult FROM (SELECT q, unnest({tokens_sql('text')}) AS term FROM ask2) GROUP BY ALL),
bm2 AS (SELECT q, path, sum(mult * ln(1 + (n - df + 0.5) / (df + 0.5)) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * wlen / av))) AS bm25 FROM qt2 JOIN post USING (term) JOIN df USING (term) JOIN len USING (path), ag GROUP BY ALL),
lex2 AS (SELECT q, path, row_number() OVER (PARTITION BY q ORDER BY round(bm25, 6) DESC, path) AS rank FROM bm2 WHERE bm25 > 0), {cosine_sql('vec2', _DOC_TEXT, 'path', 'ask2')},
f4 AS (SELECT q, path, sum(s) AS score, CASE WHEN count(DISTINCT side) > 1 THEN 'both' ELSE min(side) END AS src FROM (SELECT q, path, 1.0::DOUBLE / (30 + rank) AS s, 'bm25' AS side FROM lex WHERE rank <= {DEPTH} UNION ALL SELECT q, path, 1.0::DOUBLE / (30 + rank), 'vec' FROM vec WHERE rank <= {DEPTH}
  UNION ALL SELECT q, path, 1.0::DOUBLE / (30 + rank), 'bm25' FROM lex2 WHERE rank <= {DEPTH} UNION ALL SELECT q, path, 1.0::DOUBLE / (30 + rank), 'vec' FROM vec2 WHERE rank <= {DEPTH}) GROUP BY ALL)"""


@query(f"WITH {SIDE}, {_SECOND} SELECT q, path, score, src, rank FROM (SELECT q, path, round(score, 6) AS score, src, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, path) AS rank FROM f4) WHERE rank <= {TOP}")
def two_pass(s, d):
    """The first lexical hits of each query donate titles and sources (320 characters at most); the longer query is asked again on both sides and all four fuse."""
    lex, vec = _sides(s, d)
    donors = lex.where(F.col("rank") <= _POOL).join(A.docs(s, d).select("path", "class_name", "symbols"), "path")
    words = donors.withColumn("word", F.concat_ws(" ", "class_name", "symbols")).where("word <> ' '").groupBy("q", "word").agg(F.min("rank").alias("rank"))
    text = F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x.word), " "), 1, _ROOM)
    added = {r["q"]: r["text"] for r in words.groupBy("q").agg(text.alias("text")).collect()}
    lex2, vec2 = _sides(s, d, {q: f"{t}\n{added.get(q, '')}" for q, t in ASKED.items()})
    fused = R.rrf([("bm25", lex, 1.0), ("vec", vec, 1.0), ("bm25", lex2, 1.0), ("vec", vec2, 1.0)])
    return R.ranked(fused, "score", ["q"], "path").where(F.col("rank") <= TOP).select("q", "path", "score", "src", "rank")


#: Functions asked for, and how many hits are kept and read for them.
NAMED = {"f1": "rank wire of scene", "f2": "collect mesh path from cluster", "f3": "render label for probe"}
FOUND, READ = 6, 18
_FN_TEXT = "SELECT repo || '|' || path || '::' || name AS key, repo || '|' || path AS file, name, path || ' ' || name || ' ' || coalesce(body, '') AS text FROM fn WHERE repo IS NOT NULL AND path IS NOT NULL AND name IS NOT NULL"
_FN_HITS = f"""{A.FUNCS}, fnt AS ({_FN_TEXT}), ask AS ({" UNION ALL ".join(f"SELECT '{k}' AS q, '{v}' AS text" for k, v in NAMED.items())}), {cosine_sql('fh', 'SELECT key, text FROM fnt', 'key', 'ask')}"""


def function_hits(s, d, top, asked=None):
    """(q, key, file, name, cos, rank): the functions nearest to each question by path, name and body."""
    f = A.functions(s, d).where("repo is not null and path is not null and name is not null")
    file = F.concat_ws("|", "repo", "path")
    rows = f.select(F.concat_ws("::", file, "name").alias("key"), F.concat(F.col("path"), F.lit(" "), F.col("name"), F.lit(" "), F.coalesce("body", F.lit(""))).alias("text"))
    near = R.nearest(rows, F.col("text"), asked or NAMED, top, key="key")
    return near.select("q", "key", F.substring_index("key", "::", 1).alias("file"), F.substring_index("key", "::", -1).alias("name"), "cos", "rank")


@query(f"WITH {_FN_HITS} SELECT q, key, round(cos, 4) AS score, rank, round(cos, 4) < 0.48 AS weak FROM fh WHERE rank <= {FOUND}")
def find_functions(s, d):
    """The functions of a question, pieces of one function folded, with a flag on weak ones."""
    hits = R.fold_hits(function_hits(s, d, READ), ["key"], FOUND)
    score = F.round("cos", 4)
    return hits.select("q", "key", score.alias("score"), F.col("place").alias("rank"), (score < R.FLOOR_COS).alias("weak"))


@query(f"""WITH {_FN_HITS}, hf AS (SELECT q, split_part(key, '::', 1) AS file, key, cos, rank FROM fh WHERE rank <= 60), b AS (SELECT *, row_number() OVER (PARTITION BY q, file ORDER BY rank) AS nth FROM hf)
SELECT q, file, key, cos, place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank) AS place FROM b WHERE nth = 1) WHERE place <= {FOUND}""")
def fold_siblings(s, d):
    """The best function of each file, until there are six."""
    return R.fold_hits(function_hits(s, d, 60), ["file"], FOUND).select("q", "file", "key", "cos", "place")


@query(f"""WITH {A.FUNCS}, st AS (SELECT func_id, CASE WHEN len(list_filter(['rank', 'bake', 'tool'], lambda t: contains(lower(name), t))) > 0 THEN len(list_filter(['rank', 'bake', 'tool'], lambda t: contains(lower(name), t)))
  WHEN len(list_filter(['rank', 'bake', 'tool'], lambda t: contains(lower(path), t))) > 0 THEN 1 ELSE 0 END AS strength FROM fn)
SELECT func_id, round(0.5 + 0.1 * least(strength, 5), 4)::DOUBLE AS score FROM st WHERE strength > 0""")
def lexical_fallback(s, d):
    tokens = F.array(*[F.lit(t) for t in ("rank", "bake", "tool")])
    return R.lexical_fallback(A.functions(s, d), tokens).select("func_id", F.round("score", 4).alias("score"))


@query(f"""WITH {_FN_HITS}, hf AS (SELECT q, split_part(key, '::', 1) AS file, split_part(key, '::', 2) AS name, cos, rank FROM fh WHERE rank <= 40)
SELECT q, file, max(cos) AS score, count(*) AS n, list(name ORDER BY rank)[:4] AS names FROM hf GROUP BY ALL""")
def file_shortlist(s, d):
    """Function hits by file: the best score, how many, and the first four names."""
    return R.shortlist(function_hits(s, d, 40))


def _grams(col, n):
    """Runs of ``n`` elements; ``col`` must be a plain column, as it is read at every position."""
    at = F.sequence(F.lit(1), F.size(col) - (n - 1))
    every = F.transform(at, lambda i: F.array_join(F.slice(col, i, n), " "))
    return F.when(F.size(col) >= n, every).otherwise(F.array().cast("array<string>"))


# Evaluation: each held-out item, whole, is a query; its targets are the documents that hold any run of twelve of its tokens, or the whole of a shorter one.
RUN = 12
_EVAL = f"""{INDEX}, it AS (SELECT item_id, suite, {tokens_sql('text')} AS tk FROM eval_items),
qt AS (SELECT item_id, term, count(*) AS mult FROM (SELECT item_id, unnest(tk) AS term FROM it) GROUP BY ALL),
bm AS (SELECT item_id, path, sum(mult * ln(1 + (n - df + 0.5) / (df + 0.5)) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * wlen / av))) AS s FROM qt JOIN post USING (term) JOIN df USING (term) JOIN len USING (path), ag GROUP BY ALL),
rk AS (SELECT item_id, path, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 6) DESC, path) AS rank FROM bm WHERE s > 0),
ln AS (SELECT item_id, tk, least(len(tk), {RUN}) AS n FROM it), ig AS (SELECT DISTINCT item_id, n, array_to_string(tk[i:i+n-1], ' ') AS gram FROM (SELECT item_id, tk, n, unnest(range(1, len(tk) - n + 2)) AS i FROM ln WHERE n > 0)),
dg AS (SELECT path, n, array_to_string(tk[i:i+n-1], ' ') AS gram FROM (SELECT path, tk, n, unnest(range(1, len(tk) - n + 2)) AS i FROM (SELECT path, {tokens_sql('body')} AS tk FROM docs), (SELECT DISTINCT n FROM ig) WHERE len(tk) >= n)),
tg AS (SELECT DISTINCT item_id, path FROM ig JOIN dg USING (n, gram)),
ev AS (SELECT item_id, suite, min(rank) AS first FROM it LEFT JOIN tg USING (item_id) LEFT JOIN rk USING (item_id, path) GROUP BY ALL)"""


def passage_targets(items, docs, run: int = RUN):
    """(item_id, path) of items (item_id, tk) and documents (path, body): any ``run`` tokens in a row of the item, or all of a shorter one, stand so in the body.

    The runs of the stated items are broadcast; a document is read once whatever their lengths.
    """
    runs = items.where(F.size("tk") > 0).withColumn("n", F.least(F.size("tk"), F.lit(run)))
    sizes = sorted(r["n"] for r in runs.select("n").distinct().collect())
    asked = runs.select("item_id", F.explode(_grams(F.col("tk"), F.col("n"))).alias("gram")).distinct()
    every = F.flatten(F.array(*[_grams(F.col("tk"), n) for n in sizes])) if sizes else F.array().cast("array<string>")
    grams = docs.select("path", R.recall_tokens(F.col("body")).alias("tk")).select("path", F.explode(every).alias("gram"))
    return grams.join(F.broadcast(asked), "gram").select("item_id", "path").distinct()


def _first_ranks(s, d):
    """(item_id, suite, first): rank of the first target of each held-out item, null if none is found."""
    return first_ranks(A.table(s, d, "eval_items"), A.docs(s, d), RUN)


def _hits(first):
    hit = [F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit{k}") for k in (1, 5, 10)]
    return first.agg(*hit)


def _mrr(first):
    return first.rollup("suite").agg(F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("n")).withColumn("suite", F.coalesce("suite", F.lit("all")))


@query(f"WITH {_EVAL} SELECT item_id, suite, first FROM ev")
def golden_ranks(s, d):
    return _first_ranks(s, d)


@query(f"WITH {_EVAL} SELECT round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 6) AS hit1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 6) AS hit5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0 END), 6) AS hit10 FROM ev")
def hit_at_k(s, d):
    return _hits(_first_ranks(s, d))


@query(f"WITH {_EVAL} SELECT coalesce(suite, 'all') AS suite, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, count(*) AS n FROM ev GROUP BY GROUPING SETS ((suite), ())")
def mrr_by_kind(s, d):
    return _mrr(_first_ranks(s, d))


@query(f"""WITH {INDEX}, it AS (SELECT item_id, {tokens_sql('text')} AS tk FROM eval_items), ig AS (SELECT DISTINCT item_id, array_to_string(tk[i:i+2], ' ') AS gram FROM (SELECT item_id, tk, unnest(range(1, len(tk) - 1)) AS i FROM it)),
dg AS (SELECT DISTINCT path, array_to_string(tk[i:i+2], ' ') AS gram FROM (SELECT path, tk, unnest(range(1, len(tk) - 1)) AS i FROM (SELECT path, {tokens_sql('body')} AS tk FROM docs)))
SELECT item_id, count(DISTINCT path) AS n_docs FROM ig JOIN dg USING (gram) GROUP BY ALL""")
def echo_3gram(s, d):
    items = A.table(s, d, "eval_items").select("item_id", R.recall_tokens(F.col("text")).alias("tk")).select("item_id", F.explode(_grams(F.col("tk"), 3)).alias("gram")).distinct()
    grams = A.docs(s, d).select("path", R.recall_tokens(F.col("body")).alias("tk")).select("path", F.explode(_grams(F.col("tk"), 3)).alias("gram"))
    return grams.join(items, "gram").select("item_id", "path").distinct().groupBy("item_id").agg(F.count("*").alias("n_docs"))


_SWEEP = [(0.5, 10), (1.0, 30), (2.0, 60)]


@query(f"WITH {SIDE}, " + ", ".join(fuse_sql(w, k).replace("fu AS", f"fu{i} AS") for i, (w, k) in enumerate(_SWEEP)) + " " + " UNION ALL ".join(
    f"SELECT {w}::DOUBLE AS weight, {k} AS k, q, path, rank FROM (SELECT q, path, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, path) AS rank FROM fu{i}) WHERE rank <= 5" for i, (w, k) in enumerate(_SWEEP)))
def rrf_sweep(s, d):
    """One grid over weight and k in one job; both sides are ranked once."""
    lex, vec = (x.select("q", "path", "rank", F.lit(n).alias("side")) for x, n in zip(_sides(s, d), ("bm25", "vec")))
    gained = F.array(*[F.struct(F.lit(float(w)).alias("weight"), F.lit(k).alias("k")) for w, k in _SWEEP])
    rows = lex.unionByName(vec).select("q", "path", "rank", "side", F.explode(gained).alias("g")).select("q", "path", "g.weight", "g.k", (F.when(F.col("side") == "vec", F.col("g.weight")).otherwise(1.0) / (F.col("g.k") + F.col("rank"))).alias("s"))
    fused = rows.groupBy("weight", "k", "q", "path").agg(F.sum("s").alias("score"))
    return R.ranked(fused, "score", ["weight", "k", "q"], "path").where("rank <= 5").select("weight", "k", "q", "path", "rank")
