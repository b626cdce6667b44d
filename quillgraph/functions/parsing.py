"""Declarations, imports and calls of source texts, as table functions over (id, ext, text).

Python goes through the interpreter's parser; the other languages through one scanner that blanks
comments and literals and reads declaration heads. The scanner is a semantic stand-in for grammars
that are not installed: it finds named functions, types, bases, imports and calls.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = r"[A-Za-z_]\w*"
_SLASH = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTES = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_ES_FN = rf"(?:\bfunction\s*\*?\s*(?P<f>{_NAME})\s*\(|^[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*(?P<g>{_NAME})\s*\([^()\n]*\)\s*(?::[^{{}}\n]+)?\{{|\b(?:const|let|var)\s+(?P<h>{_NAME})\s*=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*=>))"
_C_FN = rf"^[ \t]*(?:[\w<>\[\],.*&:]+[ \t*&]+)+(?P<f>{_NAME})\s*\([^;{{}}]*\)[^;{{}}]*\{{"
#: ext -> (comments, literals, functions, types with optional base, imports)
SCANNERS: dict[str, tuple[str, str, str, str, str]] = {}
for _exts, _spec in {
    (".gd",): (r"#[^\n]*", r'"""(?:.*?)"""|' + _QUOTES, rf"^[ \t]*(?:static[ \t]+)?func[ \t]+(?P<f>{_NAME})", rf"^(?:class_name[ \t]+(?P<t>{_NAME})|class[ \t]+(?P<u>{_NAME}))|^extends[ \t]+(?P<b>[\w.\"/:]+)", r"\b(?:preload|load)\((?P<i>[^)]*)\)"),
    (".js", ".mjs", ".jsx", ".ts", ".tsx"): (_SLASH, _QUOTES + r"|`(?:[^`\\]|\\.)*`", _ES_FN, rf"\b(?:class|interface)\s+(?P<t>{_NAME})(?:\s+extends\s+(?P<b>[\w.]+))?", r"\bimport\b[^;\n]*?from\s*(?P<i>\S+)"),
    (".go",): (_SLASH, _QUOTES + r"|`[^`]*`", rf"^func\s+(?:\([^)]*\)\s*)?(?P<f>{_NAME})\s*\(", rf"^type\s+(?P<t>{_NAME})\s+(?:struct|interface)(?P<b>)?", r"^import\s+(?P<i>\S+)"),
    (".rs",): (_SLASH, r'"(?:[^"\\]|\\.)*"', rf"\bfn\s+(?P<f>{_NAME})", rf"\b(?:struct|enum|trait)\s+(?P<t>{_NAME})(?P<b>)?", r"^\s*(?:pub\s+)?use\s+(?P<i>[^;]+)"),
    (".java", ".cs", ".c", ".cpp", ".h", ".hpp"): (_SLASH, _QUOTES, _C_FN, rf"\b(?:class|interface|struct)\s+(?P<t>{_NAME})(?:\s*(?:extends|:)\s*(?P<b>[\w.]+))?", r"^\s*(?:import|using|#\s*include)\s+(?P<i>[^;\n]+)"),
    (".php",): (_SLASH + r"|#(?!\[)[^\n]*", _QUOTES, rf"\bfunction\s+&?(?P<f>{_NAME})\s*\(", rf"\b(?:class|interface|trait)\s+(?P<t>{_NAME})(?:\s+extends\s+(?P<b>[\w\\]+))?", r"^\s*use\s+(?P<i>[\w\\]+)"),
    (".lua",): (r"--\[(=*)\[.*?\]\1\]|--[^\n]*", _QUOTES, rf"\bfunction\s+(?:{_NAME}[.:])*(?P<f>{_NAME})\s*\(", rf"(?!)(?P<t>)(?P<b>)", r"\brequire\s*\(?\s*(?P<i>[^)\s]+)"),
}.items():
    for _e in _exts:
        SCANNERS[_e] = _spec
# Words that look like calls or functions and are none.
_NO_CALL = frozenset("if for while switch catch return function func fn def elif match sizeof typeof foreach and or not in else new throw await print super this self class".split())


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m.group())


def scan(ext: str, text: str) -> list[tuple[str, str, int, str | None]]:
    """(kind, name, line, detail) of one text; kinds: func, type, base, import, call (detail: caller)."""
    comments, literals, funcs, types, imports = SCANNERS[ext]
    bare = re.sub(f"(?P<lit>{literals})|{comments}", lambda m: m.group() if m.group("lit") else _blank(m), text, flags=re.S)
    code = re.sub(literals, _blank, bare, flags=re.S)
    line = lambda at: text.count("\n", 0, at) + 1
    out: list[tuple[str, str, int, str | None]] = []
    heads = []
    for m in re.finditer(funcs, code, re.M):
        name = next((v for k, v in m.groupdict().items() if v and k in "fgh"), None)
        if name and name not in _NO_CALL:
            out.append(("func", name, line(m.start(m.lastgroup or 0)), None))
            heads.append((m.start(), name))
    for m in re.finditer(types, code, re.M):
        groups = m.groupdict()
        name = groups.get("t") or groups.get("u")
        if name:
            out.append(("type", name, line(m.start()), groups.get("b") or None))
        elif groups.get("b"):
            out.append(("base", groups["b"].strip('"'), line(m.start()), None))
    for m in re.finditer(imports, bare, re.M):
        out.append(("import", m.group("i").strip("\"'<>; "), line(m.start()), None))
    k = 0
    for m in re.finditer(rf"\b({_NAME})\s*\(", code):
        while k < len(heads) and heads[k][0] <= m.start():
            k += 1
        caller = heads[k - 1][1] if k else None
        if m.group(1) not in _NO_CALL and not (caller == m.group(1) and any(h <= m.start() <= h + 200 and n == m.group(1) for h, n in heads[max(0, k - 1) : k])):
            out.append(("call", m.group(1), line(m.start()), caller))
    return out


def scan_python(text: str) -> list[tuple[str, str, int, str | None]]:
    """The same of a Python text; nothing if it doesn't parse. Calls carry their function, module level null."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple[str, str, int, str | None]] = []

    def visit(node: ast.AST, owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            here = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(("func", child.name, child.lineno, None))
                here = child.name
            elif isinstance(child, ast.ClassDef):
                base = ast.unparse(child.bases[0]) if child.bases else None
                out.append(("type", child.name, child.lineno, base))
            elif isinstance(child, ast.Import):
                out.extend(("import", a.name, child.lineno, None) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.append(("import", child.module or ".", child.lineno, ",".join(a.name for a in child.names)))
            elif isinstance(child, ast.Call):
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    out.append(("call", name, child.lineno, owner))
            visit(child, here)

    visit(tree, None)
    return out


def parse_sources(df: DataFrame, id_col: str, ext_col: str, text_col: str) -> DataFrame:
    """(id, ext, kind, name, line, detail) of all texts; null texts and unknown extensions give nothing, redelivered rows count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, e, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                found = scan_python(t) if e in (".py", ".pyi") else scan(e, t) if e in SCANNERS else []
                rows += [(i, e, *r) for r in found]
            cols = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "ext", "kind", "name", "line", "detail"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(ext_col).alias("ext"), F.col(text_col).alias("text"))
    return src.where("text is not null and ext is not null").mapInArrow(run, "id long, ext string, kind string, name string, line int, detail string").distinct()


def call_edges(parsed: DataFrame) -> DataFrame:
    """(id, caller, callee): calls whose name is declared in the same text; the module level is ``<module>``."""
    calls = parsed.where("kind = 'call'").select("id", F.coalesce("detail", F.lit("<module>")).alias("caller"), F.col("name").alias("callee")).distinct()
    return calls.join(parsed.where("kind = 'func'").select("id", F.col("name").alias("callee")).distinct(), ["id", "callee"]).select("id", "caller", "callee")


def entry_name(name: Column) -> Column:
    """Whether a function of this name runs without being called: main, tests, dunder methods, engine hooks."""
    return name.rlike(r"^(main|Main|init|_ready|_process|_physics_process|_init|_input)$|^(test_|Test|__\w+__$)")


def entry_roots(parsed: DataFrame) -> DataFrame:
    """(id, name): functions of an entry name, and those that the module level calls."""
    fn = parsed.where("kind = 'func'").select("id", "name").distinct()
    called = parsed.where("kind = 'call' and detail is null").select("id", "name").distinct()
    return fn.where(entry_name(F.col("name"))).unionByName(fn.join(called, ["id", "name"], "left_semi")).distinct()


def closest_names(names: DataFrame, wanted: list[str], least: float = 0.4, top: int = 3) -> DataFrame:
    """(wanted, name, ratio, rank): for each stated word the most similar distinct names by matching blocks."""
    from difflib import SequenceMatcher

    from pyspark.sql import Window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for w in wanted:
                m = SequenceMatcher(b=w)
                for n in b.column(0).to_pylist():
                    m.set_seq1(n)
                    if m.real_quick_ratio() >= least and m.quick_ratio() >= least and (r := m.ratio()) >= least:
                        rows.append((w, n, round(r, 6)))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64()))], ["wanted", "name", "ratio"])

    near = names.select("name").where("name is not null").distinct().mapInArrow(run, "wanted string, name string, ratio double")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("wanted").orderBy(F.desc("ratio"), "name"))).where(F.col("rank") <= top)
