"""Queries over texts and names: tokens, search, windows, counts; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import textsearch as S
from quillgraph.sources import adapters as A

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


_HUMPS_SQL = r"regexp_extract_all(regexp_replace(c, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z][a-z]+|[A-Z]+|[a-z]+|[0-9]+')"


def tokens_sql(col: str) -> str:
    """The retrieval tokens of a text in SQL."""
    chunk = f"CASE WHEN regexp_full_match(c, '[\\x00-\\x7F]*') THEN {_HUMPS_SQL} ELSE list_append({_HUMPS_SQL}, c) END"
    every = f"flatten(list_transform(regexp_split_to_array({col}, '[^\\p{{L}}\\p{{N}}_]+'), lambda c: {chunk}))"
    return f"list_transform(list_filter({every}, lambda t: length(t) > 1), lambda t: lower(t))"


@query(f"WITH {A.DOCS} SELECT path, token, count(*) AS n FROM (SELECT path, unnest({tokens_sql('body')}) AS token FROM docs) GROUP BY ALL")
def tok_recall(s, d):
    return A.docs(s, d).select("path", F.explode(T.recall_tokens(F.col("body"))).alias("token")).groupBy("path", "token").agg(F.count("*").alias("n"))


@query(rf"""SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(regexp_replace(translate(class_name, '_-', '  '), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '\s+'), lambda t: t <> '')) AS token
  FROM (SELECT DISTINCT ON (file_id) class_name FROM files)) WHERE length(token) >= 3 AND NOT regexp_full_match(token, '[0-9]+')
  AND token NOT IN ({T.sql_list(T.LABEL_STOPWORDS + T.GENERIC_DIRS)}) GROUP BY ALL""")
def tok_ident(s, d):
    files = A.table(s, d, "files").select("file_id", "class_name").dropDuplicates(["file_id"])
    return files.select(F.explode(T.ident_tokens(F.col("class_name"))).alias("token")).where(T.admissible(F.col("token"))).groupBy("token").agg(F.count("*").alias("n"))


@query(f"WITH {A.DOCS} SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(body, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM docs) GROUP BY ALL")
def mention_counts(s, d):
    return S.mention_counts(A.docs(s, d))


@query(f"WITH {A.DOCS} SELECT kind, sum((length(body) + 3) // 4)::BIGINT AS tokens, max((length(body) + 3) // 4) AS most FROM docs GROUP BY ALL")
def token_budget(s, d):
    est = T.token_estimate(F.col("body"))
    return A.docs(s, d).groupBy("kind").agg(F.sum(est).alias("tokens"), F.max(est).alias("most"))


SEED_SQL = f"nullif(array_to_string(CASE WHEN lower(string_split(path, '/')[1]) IN ({T.sql_list(T.GENERIC_DIRS)}) AND contains(path, '/') THEN string_split(path, '/')[2:-2] ELSE string_split(path, '/')[:-2] END, '/'), '')"


@query(rf"""SELECT path, regexp_replace(split_part(path, '/', -1), '\.[^.]*$', '') AS stem, {SEED_SQL} AS seed FROM (SELECT DISTINCT path FROM files)""")
def stem_dirs(s, d):
    return A.table(s, d, "files").select("path").distinct().select("path", T.stem(F.col("path")).alias("stem"), T.dir_seed(F.col("path")).alias("seed"))


@query(r"""SELECT name, CASE WHEN length(seg) >= 3 THEN lower(split_part(name, '_', 1)) || '_' || seg END AS pack FROM (SELECT name, lower(coalesce(nullif(regexp_extract(split_part(name, '_', 2), '([A-Z][a-z]*)', 1), ''), split_part(name, '_', 2))) AS seg
  FROM (SELECT DISTINCT name FROM funcs WHERE name IS NOT NULL UNION SELECT DISTINCT class_name FROM files WHERE class_name IS NOT NULL))""")
def pack_key(s, d):
    names = A.table(s, d, "funcs").select("name").union(A.table(s, d, "files").select("class_name"))
    return names.where("name is not null").distinct().select("name", T.pack_key(F.col("name")).alias("pack"))


@query(r"""SELECT title, array_to_string(list_transform(regexp_extract_all(lower(trim(regexp_replace(title, '[\s_-]+', ' ', 'g'), ' ')), '\p{L}+|[^\p{L}]+'), lambda w: upper(w[1]) || w[2:]), '') AS shown FROM (SELECT DISTINCT title FROM documents WHERE title IS NOT NULL)""")
def titleize(s, d):
    return A.table(s, d, "documents").where("title is not null").select("title").distinct().select("title", T.titleize(F.col("title")).alias("shown"))


_LINES = rf"""{A.DOCS}, sp AS (SELECT path, regexp_split_to_array(body, '\r\n|\n|\r') AS parts FROM docs),
ln AS (SELECT path, k AS line, parts[k] AS text FROM (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS k FROM sp) WHERE parts[k] <> '' OR k < len(parts))"""


def _search_sql(pattern: str, where: str = "true") -> str:
    return f"""WITH {_LINES}, hit AS (SELECT * FROM ln WHERE regexp_matches(text, '{pattern}') AND {where}),
per AS (SELECT path, count(*) AS in_file FROM hit GROUP BY ALL), tot AS (SELECT sum(in_file)::BIGINT AS n_matches, count(*) AS n_files FROM per),
fst AS (SELECT * FROM per ORDER BY path LIMIT 20)
SELECT path, line, text, in_file, n_matches, n_files FROM (SELECT path, line, CASE WHEN length(text) > 200 THEN left(text, 200) || '…' ELSE text END AS text, in_file,
  row_number() OVER (PARTITION BY path ORDER BY line) AS r FROM hit JOIN fst USING (path)), tot WHERE r <= 3"""


@query(_search_sql("(dead|stale) [a-z]+"))
def search_text(s, d):
    return S.search_text(A.docs(s, d), "(dead|stale) [a-z]+")


@query(_search_sql("rebuil[dt]", "regexp_full_match(path, '.*/readme/.*', 's')"))
def search_text_glob(s, d):
    return S.search_text(A.docs(s, d), "rebuil[dt]", "*/readme/*")


@query(f"WITH {_LINES} SELECT path, count(*) AS in_file FROM ln WHERE regexp_matches(text, 'TODO|symbols:') GROUP BY ALL")
def search_text_files_only(s, d):
    return S.search_files(A.docs(s, d), "TODO|symbols:")


@query(rf"""WITH {_LINES}, one AS (SELECT min(path) AS p FROM docs WHERE kind = 'guide'),
sh AS (SELECT line, line || chr(9) || text AS shown FROM ln, one WHERE path = p AND line BETWEEN 5 AND 104),
run AS (SELECT *, sum(length(shown) + 1) OVER (ORDER BY line)::BIGINT AS used FROM sh) SELECT line, shown, used FROM run WHERE used <= 2000""")
def line_window(s, d):
    docs = A.docs(s, d)
    first = docs.where("kind = 'guide'").agg(F.min("path").alias("p")).first()["p"] or ""
    return S.line_window(docs, first, 5, 400, 2000)


@query("""SELECT name, regexp_full_match(name, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}') AND NOT regexp_full_match(name, '.*[.]', 's') AND NOT regexp_full_match(upper(name), 'README|CON|PRN|AUX|NUL|(COM|LPT)[1-9]') AS valid
FROM (SELECT DISTINCT title AS name FROM documents WHERE title IS NOT NULL UNION SELECT DISTINCT name FROM funcs WHERE name IS NOT NULL)""")
def name_valid(s, d):
    from quillgraph.sources.memories import valid_name

    names = A.table(s, d, "documents").select(F.col("title").alias("name")).union(A.table(s, d, "funcs").select("name")).where("name is not null").distinct()
    return names.select("name", valid_name(F.col("name")).alias("valid"))


#: Bodies cut at the comment marks of their language, without empty lines, at one indent.
NORM_SQL = rf"""nx AS (SELECT func_id, body, lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS ext FROM fn WHERE body IS NOT NULL),
nb AS (SELECT func_id, ext, array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(body, '\r\n|\n|\r'), lambda x: rtrim(CASE WHEN ext IN ('.py', '.pyi', '.gd') THEN string_split(x, '#')[1] WHEN ext = '.lua' THEN string_split(x, '--')[1] WHEN ext IN ('.java', '.php') THEN string_split(string_split(x, '//')[1], '/*')[1] ELSE string_split(x, '//')[1] END, ' ')), lambda x: trim(x, ' ') <> ''), lambda x: '  ' || trim(x, ' ')), chr(10)) AS norm FROM nx)"""


@query(f"WITH {A.FUNCS}, {NORM_SQL} SELECT func_id, norm FROM nb")
def normal_body(s, d):
    return A.functions(s, d).where("body is not null").select("func_id", T.normal_body(F.col("body"), T.file_ext(F.col("path"))).alias("norm"))


@query(rf"""WITH {A.FUNCS}, c AS (SELECT *, list_filter(regexp_extract_all(body, '{T.METHOD_CALL}'), lambda m: regexp_extract(m, '{T.METHOD_CALL}', 2) IN ({T.sql_list(T.MUTATORS)})) AS calls FROM fn WHERE body IS NOT NULL)
SELECT func_id, list_sort(list_distinct(regexp_extract_all(body, '{T.MEMBER_WRITE}', 1))) AS written, list_sort(list_distinct(list_filter(list_transform(calls, lambda m: regexp_extract(m, '{T.METHOD_CALL}', 1)), lambda n: list_contains(list_transform(coalesce(params, []), lambda p: p.name), n)))) AS changed FROM c""")
def io_scan(s, d):
    """What each function writes on its own object and which parameters it changes."""
    f = A.functions(s, d).where("body is not null")
    return f.select("func_id", T.member_writes(F.col("body")).alias("written"), T.changed_params(F.col("body"), F.col("params")).alias("changed"))


@query(r"""SELECT suffix, count(*) AS n FROM (SELECT coalesce(nullif(regexp_extract(lower(split_part(path, '/', -1)), '(\.[^.]+)$', 1), ''), split_part(path, '/', -1)) AS suffix
  FROM (SELECT DISTINCT ON (file_id) path FROM files WHERE removed_at IS NULL)) GROUP BY ALL""")
def suffix_census(s, d):
    return S.suffix_census(A.live_files(s, d))


@query("SELECT event_type, list_sort(list_distinct(regexp_extract_all(lower(event_type), '[a-zA-Z_]{4,}'))) AS tokens, count(*) AS n FROM events GROUP BY ALL")
def query_tokens(s, d):
    return A.table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", F.array_sort(T.query_token_set(F.col("event_type"))).alias("tokens"), "n")


@query("""SELECT doc_id, length(to_json({'doc_id': doc_id, 'kind': kind, 'lang': lang})) AS cost FROM documents WHERE kind IS NOT NULL AND lang IS NOT NULL""")
def json_cost(s, d):
    t = A.table(s, d, "documents").where("kind is not null and lang is not null")
    return t.select("doc_id", F.length(F.to_json(F.struct("doc_id", "kind", "lang"))).cast("long").alias("cost"))


_FAILED = ("HTTP 429 too many requests", "Connection refused", "HTTP 500: model 'x' not found", "HTTP 503 overloaded", "read timed out", "the index was built with embed model a, not b", "model not found", "", None)


@query(f"""WITH m AS (SELECT unnest([{", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in _FAILED)}]) AS message), c AS (SELECT message, lower(coalesce(message, '')) AS l, nullif(regexp_extract(coalesce(message, ''), '(?:HTTP|status) ?([1-5][0-9][0-9])', 1), '')::INT AS code FROM m)
SELECT message, CASE WHEN contains(l, 'built with embed model') THEN 'model mismatch' WHEN code BETWEEN 400 AND 499 OR (code IS NOT NULL AND regexp_matches(l, 'model .*not found|no such model|unknown model|model .*does not exist')) THEN 'model rejected'
  WHEN code IS NOT NULL THEN 'endpoint failing' ELSE 'unreachable' END AS reason FROM c""")
def failure_reasons(s, d):
    return s.createDataFrame([(m,) for m in _FAILED], "message string").select("message", T.failure_reason(F.col("message")).alias("reason"))
