"""Parsing, name resolution and stream queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import parsing as P
from quillgraph.operators import resolve as R
from quillgraph.sources import adapters as A
from quillgraph.streaming import windows as W

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _parsed(s, d):
    return P.parse_sources(A.table(s, d, "raw_sources"), "file_id", "ext", "text")


@query()
def parse_python(s, d):
    return P.parse_sources(A.table(s, d, "raw_sources").where("ext in ('.py', '.pyi')"), "file_id", "ext", "text")


@query()
def parse_symbols(s, d):
    """Declarations by language."""
    return _parsed(s, d).groupBy("ext", "kind").agg(F.count("*").alias("n"))


@query()
def source_calls(s, d):
    """Calls by their function, and whether the callee is declared in the same text."""
    p = _parsed(s, d)
    inside = P.call_edges(p).withColumn("inside", F.lit(True))
    calls = p.where("kind = 'call'").select("id", F.coalesce("detail", F.lit("<module>")).alias("caller"), F.col("name").alias("callee")).distinct()
    return calls.join(inside, ["id", "caller", "callee"], "left").select("id", "caller", "callee", F.coalesce("inside", F.lit(False)).alias("inside"))


@query(rf"""WITH {A.FUNCS} SELECT repo, path, name FROM fn WHERE regexp_matches(name, '^(main|Main|init|_ready|_process|_physics_process|_init|_input)$|^(test_|Test|__\w+__$)')""")
def entry_roots(s, d):
    """Functions that run without being called, by name."""
    return A.functions(s, d).where(P.entry_name(F.col("name"))).select("repo", "path", "name")


@query()
def closest_names(s, d):
    return P.closest_names(A.functions(s, d), ["rank_wire", "bake_label", "zzz"])


@query(f"""WITH RECURSIVE {A.FILES}, up AS (SELECT DISTINCT repo, class_name, extends FROM lf WHERE class_name <> '' AND extends <> '' AND class_name <> extends),
an(repo, class_name, ancestor, depth) AS (SELECT repo, class_name, extends, 1 FROM up UNION SELECT an.repo, an.class_name, up.extends, depth + 1 FROM an JOIN up ON up.repo = an.repo AND up.class_name = an.ancestor WHERE depth < 100)
SELECT repo, class_name, ancestor, min(depth) AS depth FROM an GROUP BY ALL""")
def ancestors(s, d):
    return R.ancestors(A.live_files(s, d))


@query(f"""WITH {A.FUNCS}, st AS (SELECT DISTINCT repo, path, line + 7 AS line FROM fn WHERE line IS NOT NULL),
sp AS (SELECT repo, path, line AS first, name, line + length(coalesce(body, '')) - length(replace(coalesce(body, ''), chr(10), '')) AS last FROM fn WHERE line IS NOT NULL AND name IS NOT NULL)
SELECT st.repo, st.path, st.line, arg_min(sp.name, (first, sp.name)) AS owner FROM st LEFT JOIN sp ON sp.repo = st.repo AND sp.path = st.path AND st.line BETWEEN first AND last GROUP BY ALL""")
def line_owners(s, d):
    fns = A.functions(s, d)
    return R.owners(fns.where("line is not null").select("repo", "path", (F.col("line") + 7).alias("line")).distinct(), fns)


_ENDINGS = ", ".join(f"({k}, '{e}')" for k, e in enumerate(R.ENDINGS))


@query(rf"""WITH {A.FILES}, wt AS (SELECT DISTINCT repo, path, module FROM (SELECT repo, path, unnest(imported_modules) AS module FROM lf) WHERE module <> ''),
nm AS (SELECT *, CASE WHEN starts_with(module, '@/') THEN 'src/' || substr(module, 3) WHEN starts_with(module, '~') THEN 'lib/' || substr(module, 2) ELSE module END AS named FROM wt),
ca AS (SELECT repo, path, module, p, k, regexp_replace(CASE WHEN p = 0 AND contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') || '/' ELSE '' END || regexp_replace(CASE WHEN contains(named, '/') THEN named ELSE replace(named, '.', '/') END, '^\./', '') || e, '[^/]+/\.\./', '', 'g') AS "to"
  FROM nm, (VALUES (0), (1)) ro(p), (VALUES {_ENDINGS}) en(k, e)),
hv AS (SELECT DISTINCT repo, path AS "to" FROM lf), di AS (SELECT ca.repo, ca.path, ca.module, p, k, ca."to" FROM ca JOIN hv ON hv.repo = ca.repo AND hv."to" = ca."to"
  UNION ALL SELECT wt.repo, wt.path, wt.module, 2, 0, hv."to" FROM wt JOIN hv ON hv.repo = wt.repo AND regexp_replace(split_part(hv."to", '/', -1), '\.[^.]*$', '') = wt.module)
SELECT wt.repo, wt.path, wt.module, b."to" AS target FROM wt LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, module ORDER BY p, k, "to") AS r FROM di) WHERE r = 1) b ON b.repo = wt.repo AND b.path = wt.path AND b.module = wt.module""")
def resolved_imports(s, d):
    return R.resolved_imports(A.live_files(s, d), {"@/": "src/", "~": "lib/"})


@query(f"""WITH {A.FILES}, p AS (SELECT DISTINCT path FROM lf), k AS (SELECT unnest(['core', 'core/combat', 'ui', 'net/search', 'tools', 'ai/audio']) AS prefix)
SELECT path, (SELECT arg_max(prefix, length(prefix)) FROM k WHERE starts_with(path, prefix || '/')) AS prefix FROM p""")
def longest_prefixes(s, d):
    known = s.createDataFrame([(x,) for x in ("core", "core/combat", "ui", "net/search", "tools", "ai/audio")], "prefix string")
    return R.longest_prefixes(A.live_files(s, d).select("path").distinct(), known)


@query(f"""WITH {A.FUNCS}, fs AS (SELECT repo, path, list(DISTINCT name) AS names FROM fn GROUP BY ALL) SELECT repo, path, interface FROM fs JOIN (VALUES ('Runner', ['main', 'to_string']), ('Start', ['main'])) i(interface, need) ON list_has_all(names, need)""")
def satisfied_interfaces(s, d):
    return R.satisfied(A.functions(s, d), {"Runner": ["main", "to_string"], "Start": ["main"]})


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(s, d):
    return W.run_to_table(W.tumbling(W.event_stream(s, d)), "complete")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n FROM b GROUP BY user_id, k""")
def stream_debounce(s, d):
    return W.run_to_table(W.debounced(W.event_stream(s, d)), "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(s, d):
    return W.run_to_table(W.deduplicated(W.event_stream(s, d)), "append")
