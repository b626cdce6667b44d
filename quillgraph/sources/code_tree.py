"""A source tree as a DataFrame: a Python data source that is split along its folders."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, ext string, size bigint, mtime_ns bigint, sha string, text string"
# Folders that are never walked.
PRUNED = (".git", "node_modules", "__pycache__", ".venv", "venv", "build", "dist", ".import", ".godot")


class _Part(InputPartition):
    def __init__(self, top: str, recurse: bool):
        self.top, self.recurse = top, recurse


def ignored_names(root: str) -> set[str]:
    """Bare folder names that the root's ignore files name; lines with patterns, paths or negations don't count."""
    found: set[str] = set()
    for name in (".gitignore", ".quillignore"):
        try:
            with open(os.path.join(root, name), encoding="utf-8", errors="replace") as f:
                lines = [x.strip() for x in f]
        except OSError:
            continue
        for line in lines:
            bare = line.rstrip("/")
            if line and line[0] not in "#!" and "/" not in bare and not set(bare) & set("*?[]") and (name != ".gitignore" or line.endswith("/")):
                found.add(bare)
    return found


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options.get("path", ".")
        self.suffixes = tuple(s for s in options.get("suffixes", "").split(",") if s)
        self.pruned = set(PRUNED) | {s for s in options.get("exclude", "").split(",") if s}
        self.content = options.get("content", "true") == "true"
        self.parts = int(options.get("parts", "64"))
        if options.get("ignore", "true") == "true":
            self.pruned |= ignored_names(self.root)

    def partitions(self):
        """One part for each folder, until there are enough folders to read the rest of each with all below it."""
        flat, deep = [""], self._folders("")
        while deep and len(deep) < self.parts:
            inner = {d: self._folders(d) for d in deep}
            if not any(inner.values()):
                break
            flat += deep
            deep = [x for d in deep for x in inner[d]]
        return [*(_Part(d, False) for d in flat), *(_Part(d, True) for d in deep)]

    def _folders(self, folder: str) -> list[str]:
        at = os.path.join(self.root, folder)
        return [os.path.join(folder, n) for n in sorted(e.name for e in os.scandir(at) if e.is_dir(follow_symlinks=False) and e.name not in self.pruned)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        base = os.path.join(self.root, partition.top)
        for folder, dirs, files in os.walk(base):
            dirs[:] = sorted(d for d in dirs if d not in self.pruned) if partition.recurse else []
            for name in sorted(files):
                ext = os.path.splitext(name)[1]
                if self.suffixes and ext not in self.suffixes:
                    continue
                full = os.path.join(folder, name)
                st = os.stat(full)
                raw = open(full, "rb").read() if self.content else None
                sha = hashlib.sha256(raw).hexdigest() if raw is not None else None
                yield (os.path.relpath(full, self.root), ext, st.st_size, st.st_mtime_ns, sha, raw.decode("utf-8", "replace") if raw is not None else None)


class CodeTreeDataSource(DataSource):
    """``spark.read.format("codetree").option("suffixes", ".py,.gd").option("content", "false").load(root)``.

    Options: ``suffixes`` (all if empty, case counts), ``exclude`` (more folder names), ``content``
    (false reads only the stat), ``ignore`` (false disregards the root's ignore files), ``parts`` (folders are split until there are so many). The root must be visible to every executor.
    """

    @classmethod
    def name(cls) -> str:
        return "codetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(CodeTreeDataSource)
    return spark.read.format("codetree").options(**options).load(root)


#: Suffixes of files that wire others together, looked for under the whole root, and folders that are left out there too.
WIRING, FLOOR = (".tscn", ".tres", ".godot", ".import"), (".git", "node_modules", "__pycache__", ".godot")


def read_wiring(spark: SparkSession, root: str, suffixes: tuple[str, ...] = WIRING, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Files of wiring suffixes anywhere under the root, whatever folders a reading of sources is confined to; only the floor and ``exclude`` are left out."""
    return read_tree(spark, root, suffixes=",".join(suffixes), exclude=",".join((*FLOOR, *exclude)), ignore="false")


def pruned_files(spark: SparkSession, root: str, most: int = 50_000) -> DataFrame:
    """(folder, n): how many files lie under each pruned folder, counting no further than ``most`` of one."""
    found = []
    for at, dirs, _ in os.walk(root):
        for d in sorted(x for x in dirs if x in PRUNED):
            n = 0
            for _f, _d, files in os.walk(os.path.join(at, d)):
                n += len(files)
                if n >= most:
                    break
            found.append((os.path.relpath(os.path.join(at, d), root), min(n, most)))
        dirs[:] = [x for x in dirs if x not in PRUNED]
    return spark.createDataFrame(found, "folder string, n long")


#: What a configuration may set, with its kind.
SETTINGS = {"include": list, "exclude": list, "suffixes": list, "model": str, "provider": str, "dim": int, "scale": float}


def load_config(text: str) -> tuple[dict, list[str]]:
    """(settings, faults) of a JSON configuration: unknown keys and wrong kinds are named and left out, nothing is dropped in silence."""
    import json

    try:
        raw = json.loads(text) if text.strip() else {}
    except ValueError as e:
        return {}, [f"no JSON: {e}"]
    if not isinstance(raw, dict):
        return {}, ["not an object"]
    good, faults = {}, []
    for k, v in raw.items():
        kind = SETTINGS.get(k)
        if kind is None:
            faults.append(f"unknown key {k}")
        elif kind is float and isinstance(v, int) and not isinstance(v, bool) or isinstance(v, kind) and not isinstance(v, bool) and (kind is not list or all(isinstance(x, str) for x in v)):
            good[k] = float(v) if kind is float else v
        else:
            faults.append(f"{k} must be {'a list of texts' if kind is list else kind.__name__}")
    return good, faults


class Routes:
    """Stores of several trees: each call may name another root, which gets a store of its own under ``home`` on first contact."""

    def __init__(self, home: str):
        self.home, self.known = home.rstrip("/"), {}

    def store(self, root: str) -> str:
        real = os.path.realpath(root)
        if real not in self.known:
            if not os.path.isdir(real):
                raise ValueError(f"{root} is no folder")
            self.known[real] = f"{self.home}/{os.path.basename(real) or 'root'}-{hashlib.sha256(real.encode()).hexdigest()[:12]}"
        return self.known[real]
