"""Functions over bodies: folded continuation lines, intros; and SQL functions of the engine."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def fold_lines(body: str) -> list[str]:
    """Logical lines: physical ones joined while a bracket is open or a backslash ends them."""
    out, depth, held = [], 0, ""
    for line in body.split("\n"):
        code = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|#.*", "", line)
        depth = max(0, depth + sum(c in "([{" for c in code) - sum(c in ")]}" for c in code))
        held = f"{held} {line.strip()}" if held else line
        if depth == 0 and not held.endswith("\\"):
            out.append(held)
            held = ""
        else:
            held = held.rstrip("\\").rstrip()
    return [*out, held] if held else out


_MARKS = {"(": ")", "[": "]", "{": "}"}
_TOKEN = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[()\[\]{}]")


def balanced_span(text: str, at: int) -> int:
    """Where the bracket at ``at`` is closed (behind the closing one), brackets within literals left out; -1 if it isn't."""
    if text[at : at + 1] not in _MARKS:
        return -1
    stack: list[str] = []
    for m in _TOKEN.finditer(text, at):
        t = m.group()
        if t in _MARKS:
            stack.append(_MARKS[t])
        elif t in _MARKS.values():
            if stack.pop() != t:
                return -1
            if not stack:
                return m.end()
    return -1


def indented_block(lines: list[str], start: int, base: int) -> int:
    """Index behind the block of lines from ``start`` that are indented deeper than ``base`` columns.

    Blank lines within belong to it, those at its end don't; lines inside an open triple quote belong to it whatever their indent.
    """
    end, quote = start, None
    for k in range(start, len(lines)):
        line = lines[k]
        if quote is None and line.strip() and len(line) - len(line.lstrip(" \t")) <= base:
            break
        if line.strip() or quote is not None:
            end = k + 1
        for mark in re.findall(r"\"{3}|'{3}", line):
            quote = mark if quote is None else None if quote == mark else quote
    return end


def intro(text: str, cap: int = 400) -> str:
    """The leading docstring or comment block of a text on one line, at most ``cap`` characters."""
    t = text.lstrip("﻿ \t\r\n")
    m = re.match(r'"""(.*?)"""|\'\'\'(.*?)\'\'\'|/\*(.*?)\*/|--\[\[(.*?)\]\]', t, re.S)
    if m:
        said = next(g for g in m.groups() if g is not None)
    else:
        said = "\n".join(re.sub(r"^\s*(#|//|--)+ ?", "", x) for x in re.match(r"(?:[ \t]*(?:#|//|--)[^\n]*\n?)*", t).group().split("\n"))
    return " ".join(re.sub(r"^[\s*]+", "", x) for x in said.split("\n")).strip()[:cap].strip()


def body_facts(functions: DataFrame) -> DataFrame:
    """(func_id, n_logical, intro) of every body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, bodies = (b.column(k).to_pylist() for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(fold_lines(t)) for t in bodies], pa.int32()), pa.array([intro(t, 48) for t in bodies], pa.string())], ["func_id", "n_logical", "intro"])

    return functions.where("body is not null").select(F.col("func_id").cast("long").alias("func_id"), F.regexp_replace("body", "\r\n?", "\n").alias("body")).mapInArrow(run, "func_id long, n_logical int, intro string")


def register(spark: SparkSession) -> list[str]:
    """Make the scoring and key functions known to SQL as temporary functions; returns their names."""
    made = {
        "bm25_term(tf DOUBLE, wlen DOUBLE, avg_len DOUBLE, idf DOUBLE)": ("DOUBLE", "idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * wlen / avg_len))"),
        "bm25_idf(df BIGINT, n BIGINT)": ("DOUBLE", "ln(1 + (n - df + 0.5) / (df + 0.5))"),
        "rrf(rank BIGINT, weight DOUBLE)": ("DOUBLE", "weight / (30 + rank)"),
        "node_file(node STRING)": ("STRING", "substring_index(node, '::', 1)"),
        "ident_tokens(name STRING)": ("ARRAY<STRING>", r"filter(split(lower(regexp_replace(translate(name, '_-', '  '), '([a-z0-9])([A-Z])', '$1 $2')), '\\s+'), t -> t != '')"),
    }
    for head, (kind, expr) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {expr}")
    return [h.split("(")[0] for h in made]
