"""Tokenisers and text functions as column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the retrieval semantics.
K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"filename": 5.0, "class_name": 5.0, "symbols": 3.0, "path": 2.0, "body": 1.0}
# Folders without a meaning of their own, and English words that don't stand in labels.
GENERIC_DIRS = tuple(
    "scripts src core code main game utils helpers common shared autoload singletons resources assets scenes".split()
)
LABEL_STOPWORDS = tuple(
    """a an the and or but if then else when at by for with about into through during before after to from up down in out on
    off over under again further once here there all any both each few more most other some such no nor not only own same so than
    too very can will just should now is are was were be been being have has had do does did of it its this that these those as while
    because until against between them they their you your we our""".split()
)


def sql_list(words: tuple[str, ...]) -> str:
    """The words as a list of SQL literals."""
    return ", ".join(f"'{w}'" for w in words)


_HUMPS = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"


def recall_tokens(text: Column) -> Column:
    """Retrieval tokens in order, repeats kept: camel humps and digit runs of each chunk, then the chunk
    itself if it isn't ASCII; lower case; single characters dropped. Null gives an empty array."""
    chunks = F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_]+")

    def parts(c: Column) -> Column:
        humps = F.regexp_extract_all(c, F.lit(_HUMPS), F.lit(0))
        return F.when(c.rlike(r"^[\x00-\x7F]*$"), humps).otherwise(F.concat(humps, F.array(c)))

    return F.transform(F.filter(F.flatten(F.transform(chunks, parts)), lambda t: F.length(t) > 1), F.lower)


def ident_tokens(name: Column) -> Column:
    """Identifier tokens: ``_`` and ``-`` and lower-to-upper humps split, lower case."""
    spaced = F.regexp_replace(F.translate(name, "_-", "  "), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"\s+"), lambda t: t != "")


def admissible(token: Column) -> Column:
    """Whether a token may stand in a label."""
    return (F.length(token) >= 3) & ~token.isin(*LABEL_STOPWORDS, *GENERIC_DIRS) & ~token.rlike("^[0-9]+$")


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))


def query_token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z_]{4,}"), F.lit(0)))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def dir_parts(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def dir_seed(path: Column) -> Column:
    """Folders of a path joined by ``/``, a generic one at the top left out; null if there are none."""
    parts = dir_parts(path)
    top = F.coalesce(F.lower(F.try_element_at(parts, F.lit(1))).isin(*GENERIC_DIRS), F.lit(False))
    return F.nullif(F.array_join(F.when(top, F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))).otherwise(parts), "/"), F.lit(""))


def seed_chain(path: Column) -> Column:
    """Folders of a path without those that have no meaning of their own."""
    return F.filter(dir_parts(path), lambda x: ~F.lower(x).isin(*GENERIC_DIRS))


def pack_key(name: Column) -> Column:
    """``Pfx_Seg...`` as ``pfx_seg``: what stands before the first underscore, and the first capitalised hump of
    the part after it (the whole part if it has none), of three characters or more; otherwise null."""
    part = F.split_part(name, F.lit("_"), F.lit(2))
    seg = F.lower(F.coalesce(F.nullif(F.regexp_extract(part, "([A-Z][a-z]*)", 1), F.lit("")), part))
    return F.when(F.length(seg) >= 3, F.concat_ws("_", F.lower(F.split_part(name, F.lit("_"), F.lit(1))), seg))


def titleize(text: Column) -> Column:
    """Words in title case: a letter after anything that is no letter is a capital, all others are small."""
    bare = F.trim(F.regexp_replace(text, r"[\s_-]+", " "))
    runs = F.regexp_extract_all(F.lower(bare), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def token_estimate(text: Column) -> Column:
    return F.floor((F.length(text) + 3) / 4).cast("long")


def node_file(key: Column) -> Column:
    """File part of a node key: everything before the first ``::``."""
    return F.substring_index(key, "::", 1)


#: What a comment begins with, by suffix; where nothing is named it is ``//``.
COMMENT_MARKS = {"#": (".py", ".pyi", ".gd"), "--": (".lua",), "/*": (".java", ".php")}


def file_ext(path: Column) -> Column:
    """Lower-cased suffix of a path with its dot; empty if it has none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def code_only(text: Column, ext: Column) -> Column:
    """Text without string literals (``""`` stands for each) and line comments."""
    # Possessive loops without branches, as the matcher would use the stack for others.
    dq, sq = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"', r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
    bare = F.when(ext == ".rs", F.regexp_replace(text, dq, '""')).otherwise(F.regexp_replace(text, f"{dq}|{sq}", '""'))
    return (
        F.when(ext.isin(*COMMENT_MARKS["#"]), F.regexp_replace(bare, r"#[^\n]*", ""))
        .when(ext.isin(*COMMENT_MARKS["--"]), F.regexp_replace(bare, r"--[^\n]*", ""))
        .otherwise(F.regexp_replace(bare, r"//[^\n]*", ""))
    )


def normal_body(body: Column, ext: Column) -> Column:
    """Body without what follows a comment mark of its language, trailing blanks and empty lines, every line indented by two."""

    def cut(line: Column) -> Column:
        slash = F.substring_index(line, "//", 1)
        return (
            F.when(ext.isin(*COMMENT_MARKS["#"]), F.substring_index(line, "#", 1))
            .when(ext.isin(*COMMENT_MARKS["--"]), F.substring_index(line, "--", 1))
            .when(ext.isin(*COMMENT_MARKS["/*"]), F.substring_index(slash, "/*", 1))
            .otherwise(slash)
        )

    lines = F.transform(F.split(body, r"\r\n|\n|\r"), lambda x: F.rtrim(cut(x)))
    return F.array_join(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("  "), F.trim(x))), "\n")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a glob in which ``*`` and ``?`` cross folders."""
    special = {"*": ".*", "?": "."}
    return "(?s)^" + "".join(special.get(c, "\\" + c if c in r".^$+{}()|\[]" else c) for c in glob) + "$"


#: Calls by which a parameter is changed.
MUTATORS = tuple("append extend insert remove pop popitem clear sort reverse update add discard setdefault push_back push_front pop_back pop_front erase resize fill shuffle append_array merge".split())
MEMBER_WRITE = r"\bself\.([A-Za-z_]\w*)\s*(?:[-+*/%]?=)(?:[^=]|$)"
METHOD_CALL = r"\b([A-Za-z_]\w*)\s*\.\s*([A-Za-z_]\w*)\s*\("


def member_writes(body: Column) -> Column:
    """Names that a body sets on its own object, plainly or with an operator, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit(MEMBER_WRITE), F.lit(1))))


def changed_params(body: Column, params: Column) -> Column:
    """Parameters (array of structs with ``name``) on which a body calls a method that changes its object, sorted."""
    names = F.transform(F.coalesce(params, F.array().cast("array<struct<name:string,type:string>>")), lambda p: p["name"])
    calls = F.filter(F.regexp_extract_all(body, F.lit(METHOD_CALL), F.lit(0)), lambda m: F.regexp_extract(m, METHOD_CALL, 2).isin(*MUTATORS))
    return F.array_sort(F.array_distinct(F.filter(F.transform(calls, lambda m: F.regexp_extract(m, METHOD_CALL, 1)), lambda n: F.array_contains(names, n))))


# What a normalised body that only forwards looks like: guards of two lines without a call, an assignment without one, one call.
_GUARD = r"  (?:if|elif) [^\n()]*:(?:\n  | )(?:return(?: [^\n()]*)?|[\w.]+ = [^\n()]*)\n"
_SET = r"  (?:var |local )?[\w.]+(?:: ?\w+)? :?= [^\n()]*\n"
_PASSED = r"\([^\n()]*(?:\([^\n()]*\)[^\n()]*)*\)"
DELEGATE_INDENTED = rf"^(?:  (?:async )?(?:static )?(?:def|func) [^\n]*\n)?(?:(?:{_GUARD}){{1,2}}|(?:{_GUARD})?{_SET})  (?:return )?(?:await )?[\w.]+{_PASSED}$"
DELEGATE_BRACED = rf"^  (?:[^\n{{}};]+\n  )?[^\n{{}};]*\{{(?:\n  | )(?:return )?(?:await )?[\w.:>-]+{_PASSED};?(?:\n  | )\}}$"
INDENTED, BRACED = (".py", ".pyi", ".gd"), (".c", ".cpp", ".go", ".ts", ".tsx", ".js", ".jsx", ".mjs")


def is_delegate(norm: Column, ext: Column) -> Column:
    """Whether a normalised body only forwards, in the languages that have such a shape; never elsewhere."""
    return F.when(ext.isin(*INDENTED), norm.rlike(DELEGATE_INDENTED)).when(ext.isin(*BRACED), norm.rlike(DELEGATE_BRACED)).otherwise(False)


def failure_reason(message: Column, status: Column | None = None) -> Column:
    """Why an embedding call failed: another model than the index has, a model the endpoint rejects (HTTP 4xx, or 5xx that names the
    model), an endpoint that answers but fails, or one that isn't reached. The status is read from the message (``HTTP 429``) if it isn't given."""
    m = F.coalesce(message, F.lit(""))
    code = F.coalesce(status.cast("int") if status is not None else F.lit(None).cast("int"), F.expr("null").cast("int"), F.try_to_number(F.nullif(F.regexp_extract(m, r"(?:HTTP|status) ?([1-5][0-9][0-9])", 1), F.lit("")), F.lit("999")).cast("int"))
    named = F.lower(m).rlike("model .*not found|no such model|unknown model|model .*does not exist")
    return (
        F.when(F.lower(m).contains("built with embed model"), "model mismatch")
        .when((code >= 400) & (code < 500) | code.isNotNull() & named, "model rejected")
        .when(code.isNotNull(), "endpoint failing")
        .otherwise("unreachable")
    )
