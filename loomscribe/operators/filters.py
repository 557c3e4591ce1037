"""File, row and status filters.  Each is a predicate or a filter without a shuffle, but for
the ignore patterns, which are compiled once per repository and meet its files in one stream."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscribe.functions.text import path_suffix

#: Suffixes of files that are read.
SOURCE_SUFFIXES = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".c", ".h", ".cpp", ".cc", ".hpp", ".cs", ".rs", ".rb", ".php",
    ".swift", ".kt", ".scala", ".r", ".sh", ".bash", ".yaml", ".yml", ".toml", ".json", ".md", ".rst", ".txt", ".sql",
    ".graphql", ".proto",
)
#: Names of path parts that are skipped.
EXCLUDED_PARTS = (
    "node_modules", ".git", "__pycache__", ".pytest_cache", "venv", ".venv", "env", "dist", "build", "target", ".next",
    ".nuxt", "vendor", "third_party", ".gradle", "coverage", ".coverage", "htmlcov",
)
MAX_BYTES = 1 << 20


def has_source_suffix(path: Column) -> Column:
    return path_suffix(path).isin(*SOURCE_SUFFIXES)


def in_kept_directory(path: Column) -> Column:
    """No part of the path, file name included, is an excluded name."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in EXCLUDED_PARTS]))


def small_enough(size: Column, max_bytes: int = MAX_BYTES) -> Column:
    return size <= max_bytes


def not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def ignore_regex(pattern: str) -> str | None:
    """The regular expression of one ignore pattern; None for comments and blanks."""
    pattern = pattern.rstrip()
    if not pattern or pattern.startswith("#"):
        return None
    body = pattern.removeprefix("!").removeprefix("\\")
    anchored = "/" in body.rstrip("/")
    below = body.endswith("/")
    out, parts = "", body.strip("/").split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:.*/)?"
            continue
        piece = ""
        for token in re.findall(r"\[!?[^\]]*\]|\*+|\?|\\.|.", part):
            piece += {"*": "[^/]*", "?": "[^/]"}.get(token[0], token.replace("[!", "[^") if token[0] == "[" and len(token) > 1 else re.escape(token.lstrip("\\") or "\\"))
        out += piece + ("" if last else "/")
    return ("^" if anchored else "(?:^|/)") + out + ("/" if below else "(?:/|$)")


_PLAIN = re.compile(r"[^*?\[\]\\]*")


class IgnoreMatcher:
    """All ignore patterns of one repository (``line_no, pattern``), compiled once.

    Names, paths and suffixes without wildcards are looked up by the parts of a path, whatever their
    number; the rest is one alternation, last line first.  The last line that matches decides.
    """

    def __init__(self, patterns: list[tuple[int, str]]):
        self.kept_by: dict[int, bool] = {}
        self.names: dict[tuple[str, bool], int] = {}
        self.paths: dict[tuple[str, bool], int] = {}
        self.suffixes: dict[tuple[str, bool], int] = {}
        others: list[tuple[int, str]] = []
        for line, pattern in sorted((n, p or "") for n, p in patterns):
            regex = ignore_regex(pattern)
            if regex is None:
                continue
            self.kept_by[line] = pattern.startswith("!")
            body = pattern.rstrip().removeprefix("!").removeprefix("\\")
            below, inner = body.endswith("/"), body.strip("/")
            if inner and _PLAIN.fullmatch(inner) and "//" not in body:
                (self.paths if "/" in body.rstrip("/") else self.names)[inner, below] = line
            elif "/" not in body.rstrip("/") and inner.startswith("*") and len(inner) > 1 and _PLAIN.fullmatch(inner[1:]):
                self.suffixes[inner[1:], below] = line
            else:
                others.append((line, regex))
        self.lengths = sorted({len(s) for s, _ in self.suffixes})
        self.others = [line for line, _ in reversed(others)]
        # a regex that may begin anywhere is tried from the start of the path
        forms = [r[1:] if r.startswith("^") else "(?:.*/)?" + r.removeprefix("(?:^|/)") for _, r in reversed(others)]
        self.pattern = re.compile("|".join(f"({f})" for f in forms), re.S) if forms else None

    def last(self, path: str) -> int | None:
        """The last line that matches the path, or a folder that it lies in."""
        best = -1
        parts = path.split("/")
        at = ""
        for i, part in enumerate(parts):
            at = f"{at}/{part}" if i else part
            for below in (False, True) if i < len(parts) - 1 else (False,):
                best = max(best, self.names.get((part, below), -1), self.paths.get((at, below), -1))
                for n in self.lengths:
                    if n > len(part):
                        break
                    best = max(best, self.suffixes.get((part[-n:], below), -1))
        if self.pattern is not None and (found := self.pattern.match(path)):
            best = max(best, self.others[found.lastindex - 1])
        return best if best >= 0 else None

    def ignores(self, path: str) -> bool:
        line = self.last(path)
        return line is not None and not self.kept_by[line]


#: Parts that the files of one repository are dealt into; each gets the repository's patterns.
PATTERN_SALTS = 32
_IGNORED = pa.schema([("repo_id", pa.string()), ("rel_path", pa.string())])


def ignored_files(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Files of ``patterns`` (``repo_id, line_no, pattern``) that its last match drops.

    Files and patterns meet in one stream by repository and salt, patterns first: they are compiled once, and
    files go past them, so no row stands for a pair of a file and a pattern.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(PATTERN_SALTS - 1)))
    with_patterns = patterns.select("repo_id").distinct()
    asked = files.select("repo_id", "rel_path").join(with_patterns, "repo_id", "left_semi")
    asked = asked.select("repo_id", F.pmod(F.xxhash64("rel_path"), F.lit(PATTERN_SALTS)).cast("int").alias("salt"), F.lit(None).cast("long").alias("line_no"), F.col("rel_path").alias("text"))
    rules = patterns.filter("line_no is not null").select("repo_id", every.alias("salt"), F.col("line_no").cast("long").alias("line_no"), F.col("pattern").alias("text"))
    # dealt by a hash, so that Spark keeps no partitions of the join that it may split
    rows = rules.unionByName(asked).repartition(F.xxhash64("repo_id", "salt")).sortWithinPartitions("repo_id", "salt", F.col("line_no").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, matcher = None, [], None
        for batch in batches:
            out = []
            for repo, salt, line, text in zip(*(batch[c].to_pylist() for c in ("repo_id", "salt", "line_no", "text")), strict=True):
                if (repo, salt) != now:
                    now, held, matcher = (repo, salt), [], None
                if line is not None:
                    held.append((line, text))
                    continue
                if matcher is None:
                    matcher, held = IgnoreMatcher(held), []
                if matcher.ignores(text):
                    out.append((repo, text))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in (0, 1)], schema=_IGNORED)

    return rows.mapInArrow(run, "repo_id string, rel_path string")


def filter_corpus(files: DataFrame, patterns: DataFrame | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files that pass suffix, directory, size and ignore rules: one narrow filter without patterns."""
    path = F.col("rel_path")
    kept = files.filter(has_source_suffix(path) & in_kept_directory(path) & small_enough(F.col("size"), max_bytes))
    return kept if patterns is None else kept.join(ignored_files(kept, patterns), ["repo_id", "rel_path"], "left_anti")


def path_sorted(files: DataFrame) -> DataFrame:
    """Ordered by repository and path components."""
    return files.orderBy("repo_id", F.split("rel_path", "/"))


def refreshable(repos: DataFrame) -> DataFrame:
    """Repositories with ``refreshable`` and the ``reason`` why not."""
    fine = F.coalesce(F.col("status").isin("ready", "error"), F.lit(False))
    return repos.withColumn("refreshable", fine).withColumn("reason", F.when(~fine, F.concat(F.lit("status is "), F.coalesce("status", F.lit("unknown")))))


def owned_sessions(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Requests whose session exists and belongs to their repository."""
    return requests.join(sessions, ["session_id", "repo_id"], "left_semi")


def point_lookup(table: DataFrame, **keys) -> DataFrame:
    """The rows with these key values."""
    for name, value in keys.items():
        table = table.filter(F.col(name) == value)
    return table
