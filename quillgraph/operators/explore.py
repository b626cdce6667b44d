"""One answer to a question about a corpus: map, clusters, shortlist, and slices of the first hits within one budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the whole and of parts, the share of the best score under which a hit is only named, and lines of a slice.
TOTAL, HIT_LEAST, HIT_MOST, CLUSTERS, SHORTLIST = 20_000, 1_200, 6_000, 1_800, 1_200
CLIFF, WINDOW, HITS = 0.15, 100, 8


@dataclass
class Hit:
    """A function that was found: its file and name, first line, the first lines of its body, score and neighbours."""

    file: str
    name: str
    line: int
    lines: list[str]
    n_lines: int
    score: float
    callers: list[str]
    n_callers: int
    callees: list[str]
    n_callees: int


def anchor(file: str, start: int, total: int) -> str:
    """How the next window of a file is asked for."""
    return f'... +{total - start + 1} more lines - pass anchor="{file}:{start}-{min(total, start + WINDOW - 1)}" to continue'


def window(file: str, first: int, lines: list[str], total: int, cap: int) -> list[str]:
    """Numbered lines from ``first`` on as far as they fit ``cap``, at most ``WINDOW``, and where to go on if the text does (it ends at line ``total``)."""
    out, used = [], 0
    for k, text in enumerate(lines[:WINDOW]):
        row = f"{first + k}\t{text}"
        if used + len(row) > cap:
            break
        out.append(row)
        used += len(row) + 1
    if out and first + len(out) <= total:
        out.append(anchor(file, first + len(out), total))
    return out


def read_anchor(said: str) -> tuple[str, int, int] | None:
    """(file, first line, last line) of an anchor, None if it is none."""
    file, _, span = said.strip().rpartition(":")
    a, _, b = span.partition("-")
    if not file or not a.isdigit() or not b.isdigit() or not 1 <= int(a) <= int(b):
        return None
    return file, int(a), int(b)


def slices(hits: list[Hit], budget: int) -> list[str]:
    """Blocks of the hits in order: each may take an equal share of what is left, up to ``HIT_MOST``; a hit far below the best, or
    with a share too small, is only named, and what it doesn't use is left for those after it."""
    out, used = [], 0
    best = max((h.score for h in hits), default=0.0)
    for h in hits:
        if used >= budget:
            break
        share = min(HIT_MOST, (budget - used) // len(hits))
        if h.score < CLIFF * best or share < HIT_LEAST:
            block = f"- {h.file}::{h.name}:{h.line} (score {h.score:.3f}, not shown)"
        else:
            head = f"** {h.file} ** score {h.score:.3f}"
            side = lambda names, n: f"{n} ({', '.join(names[:3]) + (f' +{n - 3} more' if n > 3 else '') if n else 'none'})"
            flow = f"callers: {side(h.callers, h.n_callers)} | callees: {side(h.callees, h.n_callees)}"
            block = "\n".join([head, *window(h.file, h.line, h.lines, h.line + h.n_lines - 1, share - len(head) - len(flow) - 4), flow])
        out.append(block)
        used += len(block) + 2
    return out


def cut(sections: list[tuple[str, list[str]]], total: int = TOTAL) -> list[tuple[str, int, str]]:
    """(section, number, line) of all sections in order, cut at a line where the whole would pass ``total``."""
    out, used = [], 0
    for name, rows in sections:
        for k, row in enumerate((x for r in rows for x in r.split("\n")), 1):
            if used + len(row) + 1 > total:
                return out
            out.append((name, k, row))
            used += len(row) + 1
    return out


def fit(rows: list[str], cap: int) -> list[str]:
    """The first rows that together stay within ``cap``."""
    out, used = [], 0
    for r in rows:
        if used + len(r) + 1 > cap:
            break
        out.append(r)
        used += len(r) + 1
    return out


def explore(hits: DataFrame, bodies: DataFrame, edges: DataFrame, map_lines: DataFrame, clusters: DataFrame, orientation: bool = True) -> DataFrame:
    """(section, n, text) of the answer.

    ``hits`` (key, file, name, cos, rank), at most ``HITS`` of them, and what is told of them are read by the driver; ``bodies``
    (key, line, body) and ``edges`` (src_key, dst_key) are met with the hits first. ``map_lines`` (rank, line) is a repository map within its
    budget, ``clusters`` (label, size, paths) the largest clusters.
    """
    spark = hits.sparkSession
    top = hits.where(F.col("rank") <= HITS).select("key", "file", "name", "cos", "rank")
    found = top.join(bodies, "key", "left").select("key", "file", "name", "cos", "rank", F.coalesce("line", F.lit(1)).alias("line"), F.split(F.regexp_replace(F.coalesce("body", F.lit("")), "\r\n?", "\n"), "\n").alias("ls"))
    rows = found.select("key", "file", "name", "cos", "rank", "line", F.transform(F.slice("ls", 1, WINDOW), lambda x: F.substring(x, 1, HIT_MOST)).alias("ls"), F.size("ls").alias("n")).orderBy("rank").collect()

    def near(own: str, other: str) -> dict[str, tuple[list[str], int]]:
        e = edges.select("src_key", "dst_key").distinct().join(F.broadcast(top.select(F.col("key").alias(own))), own)
        short = e.groupBy(own).agg(F.slice(F.array_sort(F.collect_set(other)), 1, 3).alias("names"), F.count("*").alias("n"))
        return {r[own]: (r["names"], r["n"]) for r in short.collect()}

    callers, callees = near("dst_key", "src_key"), near("src_key", "dst_key")
    none: tuple[list[str], int] = ([], 0)
    told = [Hit(r["file"], r["name"], r["line"], r["ls"], r["n"], r["cos"], *callers.get(r["key"], none), *callees.get(r["key"], none)) for r in rows]
    parts: list[tuple[str, list[str]]] = []
    if orientation:
        parts.append(("map", [r["line"] for r in map_lines.orderBy("rank").collect()]))
        parts.append(("clusters", fit([f"- {r['label']} ({r['size']} files): {', '.join(r['paths'][:3])}" for r in clusters.collect()], CLUSTERS)))
    files: dict[str, list[Hit]] = {}
    for h in told:
        files.setdefault(h.file, []).append(h)
    order = sorted(files.items(), key=lambda kv: (-max(h.score for h in kv[1]), kv[0]))
    parts.append(("shortlist", fit([f"{k}. {f} - {len(hs)} hit(s): {', '.join(h.name for h in hs[:4])}" for k, (f, hs) in enumerate(order, 1)], SHORTLIST)))
    used = sum(len(x) + 1 for _, rows_ in parts for x in rows_)
    parts.append(("symbols", slices(told, TOTAL - used)))
    return spark.createDataFrame(cut(parts), "section string, n int, text string")
