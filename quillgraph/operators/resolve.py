"""Name resolution as joins: ancestors, owners of lines, imports, prefixes, satisfied interfaces."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import stage


def ancestors(files: DataFrame) -> DataFrame:
    """(repo, class_name, ancestor, depth): every class above each class, at its least depth; cycles end at a known class."""
    up = stage(files.where("class_name <> '' and extends is not null and extends <> '' and class_name <> extends").select("repo", "class_name", F.col("extends").alias("ancestor")).distinct(), "extends")
    seen = frontier = up.withColumn("depth", F.lit(1))
    for depth in count(2):
        step = frontier.select("repo", "class_name", F.col("ancestor").alias("mid")).join(up.select("repo", F.col("class_name").alias("mid"), "ancestor"), ["repo", "mid"]).select("repo", "class_name", "ancestor").distinct()
        frontier = stage(step.join(seen, ["repo", "class_name", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "ancestors")
        if frontier.isEmpty():
            return seen
        seen = seen.unionAll(frontier)


def owners(sites: DataFrame, functions: DataFrame, block: int = 64) -> DataFrame:
    """(repo, path, line, owner): the first function, by line and name, whose span holds each line; null if none does.

    Spans are laid on blocks of ``block`` lines (a span is repeated for each block it touches), so the range
    join is an equi-join on file and block with a filter.
    """
    last = F.col("line") + F.length(F.regexp_replace(F.coalesce("body", F.lit("")), "[^\n]", ""))
    span = functions.where("line is not null and name is not null").select("repo", "path", F.col("line").alias("first"), last.alias("last"), "name")
    span = span.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))))
    asked = sites.select("repo", "path", "line").distinct().withColumn("block", F.floor(F.col("line") / block))
    held = asked.join(span, ["repo", "path", "block"]).where(F.col("line").between(F.col("first"), F.col("last")))
    best = held.groupBy("repo", "path", "line").agg(F.min_by("name", F.struct("first", "name")).alias("owner"))
    return asked.select("repo", "path", "line").join(best, ["repo", "path", "line"], "left")


#: Endings that an import without one may have, in this order, and a folder's own file.
ENDINGS = ("", ".ts", ".tsx", ".js", ".mjs", ".jsx", ".gd", ".py", ".go", ".rs", ".lua", ".php", "/index.ts", "/index.tsx", "/index.js", "/__init__.py", "/mod.rs", "/init.lua")


def resolved_imports(files: DataFrame, aliases: dict[str, str] | None = None, endings: tuple[str, ...] = ENDINGS) -> DataFrame:
    """(repo, path, module, target): the file that each import means, null if none.

    The longest alias (``@/`` for ``src/``, say) that begins a module is replaced; a module beside that begins with ``./`` or
    ``../`` is taken from the folder of the importing file, a dotted one also as folders. Candidates are tried as written from
    the importing file's folder, then from the root of the repository, with the endings in order, then any file of that stem.
    """
    want = files.select("repo", "path", F.explode("imported_modules").alias("module")).where("module <> ''").distinct()
    named = F.col("module")
    for a in sorted(aliases or {}, key=lambda a: (len(a), a)):  # the longest is asked first
        named = F.when(F.col("module").startswith(a), F.concat(F.lit(aliases[a]), F.substring("module", len(a) + 1, 1 << 20))).otherwise(named)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    flat = F.when(named.contains("/"), named).otherwise(F.regexp_replace(named, r"\.", "/"))
    rel = F.regexp_replace(flat, r"^\./", "")
    roots = F.array(F.struct(F.lit(0).alias("p"), folder.alias("from")), F.struct(F.lit(1).alias("p"), F.lit("").alias("from")))
    tries = F.flatten(F.transform(roots, lambda r: F.transform(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(e).alias("e")) for k, e in enumerate(endings)]), lambda x: F.struct(r["p"].alias("p"), x["k"].alias("k"), F.concat(F.when(r["from"] == "", "").otherwise(F.concat(r["from"], F.lit("/"))), rel, x["e"]).alias("to")))))
    plain = F.transform(tries, lambda x: F.struct(x["p"].alias("p"), x["k"].alias("k"), F.regexp_replace(x["to"], r"[^/]+/\.\./", "").alias("to")))
    cand = want.select("repo", "path", "module", F.explode(plain).alias("c")).select("repo", "path", "module", "c.p", "c.k", "c.to")
    have = files.select("repo", F.col("path").alias("to")).distinct()
    direct = cand.join(have, ["repo", "to"]).select("repo", "path", "module", "p", "k", "to")
    stem_of = F.regexp_replace(F.substring_index("to", "/", -1), r"\.[^.]*$", "")
    by_stem = want.join(have.withColumn("module", stem_of), ["repo", "module"]).select("repo", "path", "module", F.lit(2).alias("p"), F.lit(0).alias("k"), "to")
    best = direct.unionByName(by_stem).groupBy("repo", "path", "module").agg(F.min(F.struct("p", "k", "to")).alias("b"))
    return want.join(best, ["repo", "path", "module"], "left").select("repo", "path", "module", F.col("b.to").alias("target"))


def header_pairs(files: DataFrame, includes: DataFrame) -> DataFrame:
    """(repo, path, header, rule) of each implementation (``.c``, ``.cpp``, ``.cc``): 1 a header of its own stem, in its folder
    before others; 2, for C++ only, the first of its sorted includes (repo, path, include) that is a file, from its folder or the root."""
    name = F.substring_index("path", "/", -1)
    own = F.regexp_replace(name, r"\.[^.]*$", "")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    every = files.select("repo", "path").distinct().select("repo", "path", own.alias("stem"), folder.alias("folder"), ext.alias("ext"))
    impl = every.where(F.col("ext").isin(".c", ".cpp", ".cc"))
    heads = every.where(F.col("ext").isin(".h", ".hpp", ".hh")).select("repo", "stem", F.col("path").alias("header"), F.col("folder").alias("hf"))
    paired = impl.join(heads, ["repo", "stem"]).select("repo", "path", F.lit(1).alias("rule"), F.when(F.col("folder") == F.col("hf"), 0).otherwise(1).alias("o"), F.lit("").alias("inc"), "header")
    known = every.select("repo", F.col("path").alias("header"))
    inc = impl.where("ext <> '.c'").join(includes, ["repo", "path"]).select("repo", "path", F.col("include").alias("inc"), F.explode(F.array(F.struct(F.lit(0).alias("o"), F.col("include").alias("header")), F.struct(F.lit(1).alias("o"), F.concat_ws("/", F.nullif("folder", F.lit("")), "include").alias("header")))).alias("c"))
    found = inc.select("repo", "path", F.lit(2).alias("rule"), F.col("c.o").alias("o"), "inc", F.col("c.header").alias("header")).join(known, ["repo", "header"], "left_semi")
    best = paired.unionByName(found).groupBy("repo", "path").agg(F.min(F.struct("rule", "inc", "o", "header")).alias("b"))
    return best.select("repo", "path", "b.header", "b.rule")


def longest_prefixes(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(path, prefix): the longest known folder a path lies in, null if in none; prefixes of a path are exploded, then equi-joined."""
    parts = F.split("path", "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    cand = paths.where(F.size(parts) > 1).select("path", F.explode(every).alias("prefix")).join(prefixes.select("prefix").distinct(), "prefix")
    best = cand.groupBy("path").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return paths.select("path").join(best, "path", "left")


def satisfied(functions: DataFrame, interfaces: dict[str, list[str]]) -> DataFrame:
    """(repo, path, interface): files that declare every function of a stated interface (relational division)."""
    rows = [(i, f, len(set(fs))) for i, fs in interfaces.items() for f in sorted(set(fs))]
    need = functions.sparkSession.createDataFrame(rows, "interface string, name string, n int")
    have = functions.select("repo", "path", "name").distinct().join(F.broadcast(need), "name")
    return have.groupBy("repo", "path", "interface", "n").agg(F.count("*").alias("k")).where("k = n").select("repo", "path", "interface")
