"""Repositories as sources: file walk, commit differences, branches, ignore rules."""

from __future__ import annotations

import fnmatch
import re
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.config import DEFAULTS, EngineConfig
from sextant.functions import text as T


def git(folder: str, *args: str) -> str:
    return subprocess.run(["git", "-C", folder, *args], check=True, capture_output=True, text=True).stdout


def walk(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative), modified, length, content of all regular files; content is not read unless selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = Path(folder).resolve().as_uri().removeprefix("file://").rstrip("/")
    plain = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(root) + "/", "")
    return files.select(plain.alias("path"), F.col("modificationTime").alias("modified"), "length", "content")


def decoded(files: DataFrame) -> DataFrame:
    """content as text; bytes that are no UTF-8 are replaced and the row is marked, never fatal."""
    text = F.decode("content", "UTF-8") if not hasattr(F, "try_validate_utf8") else F.make_valid_utf8(F.col("content").cast("string"))
    return files.withColumn("_corrupt", ~F.is_valid_utf8(F.col("content").cast("string"))).withColumn("content", text)


# ---------------------------------------------------------------- ignore rules
def ignore_rule(line: str, base: str = "") -> tuple[str, bool, bool] | None:
    """(pattern over the whole path, directories only, negated) of one line of an ignore file in folder base."""
    line = line.rstrip("\n\r")
    if not line.endswith("\\ "):
        line = line.rstrip(" ")
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    line = line[1:] if line.startswith("\\") and line[1:2] in "#!" else line
    folder_only = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = [], 0
    while i < len(line):
        if line.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out.append("/.*")
            i += 3
        elif line.startswith("**", i):
            out.append(".*")
            i += 2
        elif line[i] == "*":
            out.append("[^/]*")
            i += 1
        elif line[i] == "?":
            out.append("[^/]")
            i += 1
        elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
            body = line[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end + 1
        elif line[i] == "\\" and i + 1 < len(line):
            out.append(re.escape(line[i + 1]))
            i += 2
        else:
            out.append(re.escape(line[i]))
            i += 1
    base = re.escape(base.strip("/") + "/") if base.strip("/") else ""
    return ("^" + base + ("" if anchored else "(?:.*/)?") + "".join(out) + "$", folder_only, negated)


class IgnoreRules:
    """Rules of all ignore files, the root's first; the last that speaks of a path decides, for its folders first."""

    def __init__(self, files: dict[str, str]):
        """files: folder of the ignore file ("" for the root) -> its text."""
        parsed = [ignore_rule(line, base) for base in sorted(files, key=lambda b: (b.count("/") + bool(b), b)) for line in files[base].splitlines()]
        self.rules = [(re.compile(p), d, n) for p, d, n in filter(None, parsed)]

    def ignores(self, path: str) -> bool:
        parts = path.replace("\\", "/").strip("/").split("/")
        for n in range(1, len(parts) + 1):
            at, folder = "/".join(parts[:n]), n < len(parts)
            verdict = None
            for pattern, folders_only, negated in self.rules:
                if (folder or not folders_only) and pattern.match(at):
                    verdict = not negated
            if verdict:
                return True
        return False

    def column(self, path: Column) -> Column:
        @F.pandas_udf("boolean")
        def ignored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield s.map(lambda p: p is not None and self.ignores(p))

        return ignored(path)


def ignore_rules(folder: str) -> IgnoreRules:
    root = Path(folder)
    files = {"": (root / ".git/info/exclude").read_text(errors="replace") if (root / ".git/info/exclude").exists() else ""}
    for f in sorted(root.rglob(".gitignore")):
        at = f.relative_to(root).parent.as_posix()
        if ".git" not in f.relative_to(root).parts[:-1]:
            at = "" if at == "." else at
            files[at] = files.get(at, "") + "\n" + f.read_text(errors="replace")
    return IgnoreRules(files)


class FilterRegistry:
    """Include and exclude globs by repo; an override replaces the default whole, a null repo means the default."""

    def __init__(self, default: tuple[tuple[str, ...], tuple[str, ...]] = (DEFAULTS.include, DEFAULTS.exclude), overrides: dict | None = None):
        self.default, self.overrides = default, overrides or {}

    def globs(self, repo: str | None) -> tuple[tuple[str, ...], tuple[str, ...]]:
        return self.overrides.get(repo, self.default) if repo is not None else self.default

    def accepted(self, repo: Column, path: Column) -> Column:
        out = T.accepted(path, *self.default)
        for name, globs in self.overrides.items():
            out = F.when(repo == name, T.accepted(path, *globs)).otherwise(out)
        return out


# ---------------------------------------------------------------- commits and branches
def diff(folder: str, old: str, new: str) -> list[tuple[str, str]]:
    """(kind, path) of each change between commits: DELETE the old path, ADD (also copies) and MODIFY (also renames) the new one."""
    out, fields = [], git(folder, "diff", "--name-status", "-z", "-M", "-C", old, new).split("\0")
    i = 0
    while i < len(fields) - 1:
        code = fields[i]
        moved = code[0] in "RC"
        path = fields[i + (2 if moved else 1)]
        out.append(({"D": "DELETE", "A": "ADD", "C": "ADD"}.get(code[0], "MODIFY"), path))
        i += 3 if moved else 2
    return out


def changes(spark: SparkSession, folder: str, old: str, new: str) -> DataFrame:
    return spark.createDataFrame(diff(folder, old, new), "kind string, path string")


def branches(folder: str, mode: str = "SINGLE", tracked: tuple[str, ...] = ()) -> list[str]:
    """SINGLE: the first tracked branch. MULTI: local branches that match the tracked globs. None tracked: main."""
    if not tracked:
        return ["main"]
    if mode.upper() == "SINGLE":
        return [tracked[0]]
    refs = git(folder, "for-each-ref", "--format=%(refname:short)", "refs/heads").split()
    return [r for r in refs if any(re.fullmatch(T.glob_regex(g), r) or fnmatch.fnmatchcase(r, g) and "/" not in r for g in tracked)]


def head(folder: str, branch: str) -> str:
    try:
        return git(folder, "rev-parse", "--verify", "--quiet", f"refs/heads/{branch}").strip()
    except subprocess.CalledProcessError:
        raise ValueError(f"no such branch: {branch}") from None


def accepted_files(spark: SparkSession, folder: str, repo: str | None = None, registry: FilterRegistry | None = None, config: EngineConfig = DEFAULTS) -> DataFrame:
    """The walk, less what is ignored, not accepted or of no known kind; decided by path before any content is read."""
    files = walk(spark, folder)
    include, exclude = (registry or FilterRegistry((config.include, config.exclude))).globs(repo)
    kept = files.filter(T.accepted(F.col("path"), include, exclude) & (T.source_class(F.col("path")) != "IGNORE"))
    if config.respect_gitignore:
        kept = kept.filter(~ignore_rules(folder).column(F.col("path")))
    return kept


def read_file(spark: SparkSession, folder: str, path: str, repo: str | None = None, registry: FilterRegistry | None = None, config: EngineConfig = DEFAULTS) -> DataFrame | None:
    """path, modified, content of one file of a repository; None if ignore rules, globs or its kind leave it out."""
    include, exclude = (registry or FilterRegistry((config.include, config.exclude))).globs(repo)
    known = spark.createDataFrame([(path,)], "path string")
    if not known.filter(T.accepted(F.col("path"), include, exclude) & (T.source_class(F.col("path")) != "IGNORE")).take(1):
        return None
    if config.respect_gitignore and ignore_rules(folder).ignores(path):
        return None
    one = spark.read.format("binaryFile").load(str(Path(folder) / path))
    return decoded(one.select(F.lit(path).alias("path"), F.col("modificationTime").alias("modified"), "content"))
