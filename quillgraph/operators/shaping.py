"""Documents of functions and files, cut by size: micro functions join a carrier, monsters are chunked."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.bodies import intro
from quillgraph.functions.text import file_ext

#: Sizes in characters.
MICRO, MONSTER, DOC_CAP, BODY_CAP = 220, 2000, 8000, 6000
SYMBOLS_CAP, IMPORTS_CAP, INTRO_CAP, LINE_INTRO_CAP, FILE_CAP = 1200, 400, 400, 48, 30_000


def shape_stamp(scale: float = 1.0) -> str:
    """What a collection of documents is stamped with: ``raw`` where shaping is off, otherwise the shape and its scale."""
    return "raw" if scale <= 0 else f"cast3@{scale:g}"


def with_past(functions: DataFrame) -> DataFrame:
    """``functions`` with ``past``: what follows a function's head, the lines from the first one that is indented deeper than the first line.

    A body whose first line is no head (it neither ends with a colon nor begins with ``func``) is taken whole.
    """
    body = F.coalesce("body", F.lit(""))
    rows = functions.withColumn("_lines", F.split(F.regexp_replace(body, r"(\r\n|\n|\r)$", ""), r"\r\n|\n|\r"))
    rows = rows.withColumn("_indents", F.transform("_lines", lambda x: F.when(F.trim(x) != "", F.length(F.regexp_extract(x, r"^[ \t]*", 0))).otherwise(-1)))
    rows = rows.withColumn("_first", F.length(F.regexp_extract(F.element_at("_lines", 1), r"^[ \t]*", 0)))
    deep = F.transform("_indents", lambda i, k: (k > 0) & (i > F.col("_first")))
    rows = rows.withColumn("_at", F.array_position(deep, True).cast("int"))
    rest = F.when(F.col("_at") > 0, F.array_join(F.slice("_lines", F.col("_at"), F.size("_lines")), "\n")).otherwise("")
    return rows.withColumn("past", F.when(F.element_at("_lines", 1).rlike(r":\s*$|^\s*func"), rest).otherwise(body)).drop("_lines", "_indents", "_first", "_at")


def micro_carriers(functions: DataFrame, micro: int = MICRO) -> DataFrame:
    """(repo, path, name, carrier): functions with a body of 1 to ``micro`` characters past the head, and the nearest other one before them in the file."""
    small = F.length("past").between(1, micro)
    w = Window.partitionBy("repo", "path").orderBy("line", "name").rowsBetween(Window.unboundedPreceding, -1)
    found = with_past(functions).withColumn("small", small).withColumn("carrier", F.last(F.when(~F.col("small"), F.col("name")), True).over(w))
    return found.where("small").select("repo", "path", "name", "carrier")


def _signature() -> Column:
    sig = F.array_join(F.transform("params", lambda p: F.concat_ws(": ", p["name"], F.nullif(p["type"], F.lit("")))), ", ")
    return F.concat(F.col("path"), F.lit(" :: func "), F.coalesce("name", F.lit("")), F.lit("("), F.coalesce(sig, F.lit("")), F.lit(")"), F.when(F.coalesce("ret", F.lit("")) != "", F.concat(F.lit(" -> "), F.col("ret"))).otherwise(""))


def function_docs(functions: DataFrame) -> DataFrame:
    """(func_id, doc): path, signature and the start of the body."""
    return functions.select("func_id", F.concat(_signature(), F.lit("\n"), F.substring(F.coalesce("body", F.lit("")), 1, BODY_CAP)).alias("doc"))


_OPEN, _SHUT = "([{", ")]}"
_QUOTED = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")


def statement_starts(lines: list[str]) -> list[int]:
    """Indices of the lines that start a statement at the body's own indent, outside brackets and triple quotes."""
    depth, quote, base, out = 0, None, None, []
    for k, line in enumerate(lines):
        text = line.strip()
        if k and text and depth == 0 and quote is None:
            indent = len(line) - len(line.lstrip())
            base = indent if base is None else base
            if indent <= base and text[0] not in _SHUT and not re.match(r"(else|elif|except|finally|case)\b", text):
                out.append(k)
        rest = line
        while True:
            if quote is not None:
                at = rest.find(quote)
                if at < 0:
                    break
                rest, quote = rest[at + 3 :], None
            at = min((p for p in (rest.find('"""'), rest.find("'''")) if p >= 0), default=-1)
            code = _QUOTED.sub("", rest if at < 0 else rest[:at])
            depth = max(0, depth + sum(c in _OPEN for c in code) - sum(c in _SHUT for c in code))
            if at < 0:
                break
            quote, rest = rest[at : at + 3], rest[at + 3 :]
    return out


def chunk_lines(body: str, cap: int) -> list[tuple[int, int]]:
    """[start, end) lines of chunks: whole statements packed up to ``cap`` characters, larger ones cut by lines."""
    lines = body.split("\n")
    cuts = [0, *statement_starts(lines), len(lines)]
    blocks = []
    for a, b in zip(cuts, cuts[1:]):
        while a < b:
            size, e = 0, a
            while e < b and (size + len(lines[e]) + 1 <= cap or e == a):
                size += len(lines[e]) + 1
                e += 1
            blocks.append((a, e, size))
            a = e
    out: list[list[int]] = []
    for a, e, size in blocks:
        if out and out[-1][2] + size <= cap:
            out[-1][1], out[-1][2] = e, out[-1][2] + size
        else:
            out.append([a, e, size])
    return [(a, e) for a, e, _ in out]


def chunk_texts(head: str, body: str, cap: int, mark: str) -> list[tuple[int, str]]:
    """(first line, text) of the chunks of a long body, the head on each; a leading comment or docstring is repeated after the first."""
    said = intro("\n".join(body.split("\n")[1:]), LINE_INTRO_CAP)
    room = max(cap - len(head) - (len(said) + len(mark) + 2 if said else 0) - 2, cap // 4)
    lines, out = body.split("\n"), []
    for k, (a, b) in enumerate(chunk_lines(body, room)):
        text = "\n".join(lines[a:b]).strip("\n")
        if text.strip():
            out.append((a, "\n".join([head, *([f"{mark} {said}"] if said and k else []), text])))
    return out


def _mark(ext: str) -> str:
    return {".py": "#", ".pyi": "#", ".gd": "#", ".lua": "--"}.get(ext, "//")


def function_chunks(functions: DataFrame, cap: int = MONSTER) -> DataFrame:
    """(func_id, key, line, doc) of the bodies longer than ``cap``: documents ``name#chunk1`` and so on, each with the head and under ``cap``
    unless one line is longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, name, line, ext, head, body in zip(*(b.column(k).to_pylist() for k in range(6))):
                rows += [(i, f"{name}#chunk{k}", (line or 1) + at, text[:DOC_CAP]) for k, (at, text) in enumerate(chunk_texts(head, body, cap, _mark(ext)), 1)]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.string()))], ["func_id", "key", "line", "doc"])

    src = functions.where(F.length("body") > cap).select(F.col("func_id").cast("long").alias("func_id"), F.coalesce("name", F.lit("")).alias("name"), F.col("line").cast("int").alias("line"), file_ext(F.col("path")).alias("ext"), _signature().alias("head"), F.regexp_replace("body", "\r\n?", "\n").alias("body"))
    return src.mapInArrow(run, "func_id long, key string, line int, doc string")


def capped_line(title: str, names: list[str], cap: int) -> str:
    """``# title: a b c``, cut where it would pass ``cap``, with the number of those left out."""
    line = f"# {title}: " + " ".join(names)
    if len(line) <= cap:
        return line
    kept, used = [], len(title) + 4
    for n in names:
        if used + len(n) + 1 > cap - 8:
            break
        kept.append(n)
        used += len(n) + 1
    return f"# {title}: " + " ".join(kept) + f" (+{len(names) - len(kept)})"


def assemble(head: str, sections: list[list[str]], cap: int) -> str:
    """The head, then first pieces of all sections, second pieces of all and so on; a piece that would pass ``cap`` is left out."""
    parts, used = [head[:cap]], min(len(head), cap)
    for k in range(max(map(len, sections), default=0)):
        for s in sections:
            if k < len(s) and used + len(s[k]) + 1 <= cap:
                parts.append(s[k])
                used += len(s[k]) + 1
    return "\n".join(parts)


def file_docs(files: DataFrame, functions: DataFrame, cap: int = FILE_CAP) -> DataFrame:
    """(file_id, doc, n_symbols): path, class, symbols and imports with the number of those left out, the file's intro if it has a
    ``text``, then the functions in line order: micro ones under their carrier, long ones in chunks, pieces of all interleaved.

    The functions of one file come together; a file is of bounded size.
    """
    small = F.length("past").between(1, MICRO)
    per = with_past(functions).groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("line", F.lit(0)).cast("int").alias("line"), F.coalesce("name", F.lit("")).alias("name"), F.regexp_replace(F.coalesce("body", F.lit("")), "\r\n?", "\n").alias("body"), small.alias("small")))).alias("fns"))
    text = F.col("text") if "text" in files.columns else F.lit(None).cast("string")
    rows = files.select(F.col("file_id").cast("long").alias("file_id"), "repo", "path", F.coalesce("class_name", F.lit("")).alias("class_name"), F.coalesce("extends", F.lit("")).alias("extends"), F.array_sort(F.array_distinct(F.filter(F.coalesce("imported_modules", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != ""))).alias("imports"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, path, cls, base, imports, said, fns in zip(*(b.column(c).to_pylist() for c in ("file_id", "path", "class_name", "extends", "imports", "text", "fns"))):
                fns, mark = fns or [], _mark(("." + path.rsplit(".", 1)[-1].lower()) if path and "." in path else "")
                head = [f"# {path}"] + ([f"# class {cls}" + (f" extends {base}" if base else "")] if cls else []) + [capped_line("symbols", [f["name"] for f in fns], SYMBOLS_CAP)]
                head += ([capped_line("imports", imports, IMPORTS_CAP)] if imports else []) + ([intro(said, INTRO_CAP)] if said and intro(said, INTRO_CAP) else [])
                sections: list[list[str]] = []
                for f in fns:
                    if f["small"] and sections:
                        sections[-1][-1] += f"\n-- {f['name']} --\n{f['body']}"
                    elif len(f["body"]) > MONSTER:
                        sections.append([t for _, t in chunk_texts(f["body"].split("\n", 1)[0], f["body"], MONSTER, mark)])
                    elif f["body"]:
                        sections.append([f["body"]])
                out.append((i, assemble("\n".join(head), sections, cap), len(fns)))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64()))], ["file_id", "doc", "n_symbols"])

    return rows.join(per, ["repo", "path"], "left").mapInArrow(run, "file_id long, doc string, n_symbols long")
