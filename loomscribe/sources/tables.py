"""Catalog tables: writing, keyed changes and reads."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomscribe.sources.scratch import Workspace


def write_partitioned(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write by repository; overwriting replaces only the repositories present in ``df``."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """The page table, clustered so that each repository is written by few tasks."""
    write_partitioned(pages.repartition("repo_id", F.pmod(F.xxhash64("slug"), F.lit(8))), path)


MANIFEST = "repo_id string, slug string, path string, size long, sha256 string"
_MANIFEST = pa.schema([("repo_id", pa.string()), ("slug", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("sha256", pa.string())])


def write_page_files(pages: DataFrame, folder: str, suffix: str = ".md") -> DataFrame:
    """One file per page, ``folder/<repo_id>/<slug>.md``, written by the tasks that hold the pages; returns ``MANIFEST``.

    A task writes under a name of its own beside the file and renames it, so a task that is repeated or runs
    twice replaces a whole file by an equal one and leaves no half.  ``folder`` must be a path (or a file: URL) that all
    executors mount.  A slug has one page in ``pages``; a null content is an empty file; names with
    path separators or a leading dot fail.  The manifest is stored in the session's shared folder.
    """
    root = re.sub(r"^file:/+", "/", folder.rstrip("/"))
    if "://" in root:
        raise ValueError("page files need a folder that executors reach as a path")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[str] = set()
        for batch in batches:
            rows = []
            for repo, slug, content in zip(*(batch[c].to_pylist() for c in ("repo_id", "slug", "content")), strict=True):
                for name in (repo, slug):
                    if not name or name.startswith(".") or "/" in name or "\0" in name:
                        raise ValueError(f"not a file name: {name!r}")
                data, path = (content or "").encode(), f"{root}/{repo}/{slug}{suffix}"
                if repo not in made:
                    os.makedirs(f"{root}/{repo}", exist_ok=True)
                    made.add(repo)
                own = f"{root}/{repo}/.{slug}.{uuid.uuid4().hex}"
                try:
                    with open(own, "wb") as out:
                        out.write(data)
                    os.replace(own, path)
                finally:
                    if os.path.exists(own):
                        os.unlink(own)
                rows.append((repo, slug, f"{repo}/{slug}{suffix}", len(data), hashlib.sha256(data).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_MANIFEST)], schema=_MANIFEST)

    return Workspace(pages.sparkSession, "pages").save(pages.select("repo_id", "slug", "content").mapInArrow(write, MANIFEST), "manifest")


def remove_page_files(manifest: DataFrame, gone: DataFrame, folder: str) -> DataFrame:
    """Delete the files of the pages in ``gone`` (``repo_id, slug``) that a manifest lists; returns what is left of it."""
    root = re.sub(r"^file:/+", "/", folder.rstrip("/"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                if os.path.exists(f"{root}/{path}"):
                    os.unlink(f"{root}/{path}")
            yield batch

    key = ["repo_id", "slug"]
    Workspace(manifest.sparkSession, "pages").save(manifest.join(gone.select(key), key, "left_semi").select("path").mapInArrow(remove, "path string"), "removed")
    return manifest.join(gone.select(key), key, "left_anti")


def replace_repos(table: DataFrame, fresh: DataFrame) -> DataFrame:
    """``table`` with all rows of the repositories in ``fresh`` replaced."""
    return table.join(fresh.select("repo_id").distinct(), "repo_id", "left_anti").unionByName(fresh)


def delete_insert(table: DataFrame, gone: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are in ``gone`` replaced by ``fresh``."""
    return table.join(gone.select(keys).distinct(), keys, "left_anti").unionByName(fresh)


def insert_if_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return table.unionByName(rows.join(table.select(key), key, "left_anti").select(table.columns))


def patch_rows(table: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Columns of ``patch`` over the rows of its keys; ``set_<column>`` flags decide, so null can be set."""
    flagged = [c.removeprefix("set_") for c in patch.columns if c.startswith("set_")]
    p = patch.select(key, *[F.col(c).alias(f"new_{c}") for c in flagged], *[f"set_{c}" for c in flagged])
    joined = table.join(p, key, "left")
    new = {c: F.when(F.coalesce(f"set_{c}", F.lit(False)), F.col(f"new_{c}")).otherwise(F.col(c)) for c in flagged}
    return joined.select([new.get(c, F.col(c)).alias(c) for c in table.columns])


def append_messages(table: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages appended with the current time."""
    return table.unionByName(messages.withColumn("created_at", F.current_timestamp()))


def latest_pages(pages: DataFrame, *tie: str) -> DataFrame:
    """The newest row of every repository and slug."""
    newest = F.row_number().over(W.partitionBy("repo_id", "slug").orderBy(F.desc("updated_at"), *tie))
    return pages.withColumn("_n", newest).filter("_n = 1").drop("_n")


def page_list(repos: DataFrame, pages: DataFrame) -> DataFrame:
    """``repo_id, pos, slug``: the stored structure where there is one, else the pages by order."""
    stored = F.from_json("wiki_structure", "pages array<struct<slug string>>")["pages"]["slug"]
    with_own = repos.filter(stored.isNotNull()).select("repo_id", F.posexplode(stored).alias("pos", "slug"))
    rest = pages.join(with_own.select("repo_id").distinct(), "repo_id", "left_anti")
    pos = F.row_number().over(W.partitionBy("repo_id").orderBy("page_order", "slug")) - 1
    return with_own.union(rest.select("repo_id", pos.alias("pos"), "slug"))


def first_page(pages: DataFrame) -> DataFrame:
    return pages.groupBy("repo_id").agg(F.min_by("slug", F.struct("page_order", "slug")).alias("slug"))


def recent_repos(repos: DataFrame, n: int = 20) -> DataFrame:
    """The dashboard's newest repositories."""
    return repos.orderBy(F.desc_nulls_last("indexed_at"), "repo_id").limit(n)


def supersede_jobs(jobs: DataFrame) -> DataFrame:
    """Open full-index jobs fail when the repository has a newer one; refreshes are left alone."""
    after = F.lead("job_id").over(W.partitionBy("repo_id", "type").orderBy("created_at", "job_id"))
    stale = (F.col("type") == "full_index") & F.col("status").isin("queued", "running") & after.isNotNull()
    return jobs.withColumn("status", F.when(stale, F.lit("failed")).otherwise(F.col("status")))
