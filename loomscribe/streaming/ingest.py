"""Arriving snapshots applied to stored pages and plans, each batch once.

The store is a log of versions.  A batch writes its tables under its own number, and last the list of the
repositories that it renewed; a repository's rows are those of its newest listed version.  A batch always
reads the versions before its own number, so a batch that comes again, whole or after a crash half way,
writes the same rows over the same places and changes nothing.  ``compact`` folds old versions into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscribe.functions.text import slugify_title
from loomscribe.plans import pages as plans
from loomscribe.plans import refresh
from loomscribe.sources.scratch import Workspace, delete, exists

TABLES = {
    "repos": "repo_id string, commit string, decision string, unindexed_added long",
    "files": "repo_id string, rel_path string, content_hash string",
    "pages": "repo_id string, title string, slug string, purpose string, parent string, page_pos int, page_order int, content string",
    "page_files": "repo_id string, title string, rel_path string",
}
#: Pages to write again and the files of theirs that are still there in, the pages (title, purpose, parent, page_pos) and their files out.
Planner = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]
#: Planned pages with their files and the arrived rows in, ``repo_id, title, content`` out.
Writer = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
#: The arrived files of repositories that need a whole run in; pages with ``content`` and ``page_order``, and their files, out.
FullRun = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


class PageStore:
    """The versioned tables of ``TABLES`` under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> DataFrame:
        """``repo_id, version`` of everything that was renewed."""
        return self._read("versions", "repo_id string")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], f"{schema}, version long")
        return self.spark.read.schema(f"{schema}, version long").option("basePath", path).parquet(path)

    def table(self, name: str, before: int | None = None) -> DataFrame:
        """The rows of a table as they stand, or as they stood before a version."""
        heads, rows = self.versions(), self._read(name, TABLES[name])
        if before is not None:  # on the rows as well: files of a version that is being written are never opened
            heads, rows = heads.filter(F.col("version") < before), rows.filter(F.col("version") < before)
        heads = heads.groupBy("repo_id").agg(F.max("version").alias("version"))
        return rows.join(heads, ["repo_id", "version"], "left_semi").drop("version")

    def put(self, version: int, renewed: DataFrame, **rows: DataFrame) -> None:
        """Write all tables of a version, and then that it is whole; ``renewed`` lists its repositories (``repo_id``)."""
        for name, schema in TABLES.items():
            columns = [f.split()[0] for f in schema.split(", ")]
            kinds = dict(f.split() for f in schema.split(", "))
            rows[name].select([F.col(c).cast(kinds[c]) for c in columns]).write.mode("overwrite").parquet(f"{self.folder}/{name}/version={version}")
        renewed.select("repo_id").distinct().write.mode("overwrite").parquet(f"{self.folder}/versions/version={version}")

    def compact(self, version: int) -> None:
        """Fold all versions up to this one into it; batches up to it must not come again afterwards."""
        heads = self.versions().filter(F.col("version") <= version)
        old = sorted(r["version"] for r in heads.select("version").distinct().collect())
        if len(old) < 2:
            return
        target = old[-1]
        now = {name: self.table(name, version + 1) for name in TABLES}
        for name, rows in now.items():
            rows.write.mode("overwrite").parquet(f"{self.folder}/_compact/{name}")
        heads.select("repo_id").distinct().write.mode("overwrite").parquet(f"{self.folder}/_compact/versions")
        read = {name: self.spark.read.parquet(f"{self.folder}/_compact/{name}") for name in (*TABLES, "versions")}
        self.put(target, read["versions"], **{name: read[name] for name in TABLES})
        for number in old[:-1]:
            for name in ("versions", *TABLES):  # first the list, so that no half version is ever read
                delete(self.spark, f"{self.folder}/{name}/version={number}")
        delete(self.spark, f"{self.folder}/_compact")


def same_pages(pages: DataFrame, page_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The default planner: the affected pages stay as they were planned."""
    return pages, page_files


def purpose_texts(pages: DataFrame, page_files: DataFrame, arrived: DataFrame) -> DataFrame:
    """The default writer: a heading, the purpose and the commit that the text is of."""
    commits = arrived.select("repo_id", "commit").distinct()
    text = F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), "purpose", "commit")
    return pages.join(commits, "repo_id").select("repo_id", "title", text.alias("content"))


def apply_arrivals(
    store: PageStore, arrived: DataFrame, version: int, planner: Planner = same_pages, writer: Writer = purpose_texts, full_run: FullRun | None = None
) -> None:
    """Bring the stored pages up to whole snapshots that have arrived: ``repo_id, commit, rel_path, content_hash``.

    Repositories without changes stay; where no page is affected only commit and files are renewed; incremental
    ones get their affected pages planned and written again, merged with the others, orders kept; those
    that need a whole run get it from ``full_run``, or are left alone and only their decision is stored.
    """
    work, key = Workspace(store.spark, "arrivals"), ["repo_id", "title"]
    arrived = work.save(arrived, "arrived")
    commits = work.save(arrived.select("repo_id", F.col("commit").alias("new_commit")).distinct(), "commits")
    old = {name: work.save(store.table(name, version).join(commits.select("repo_id"), "repo_id", "left_semi"), name) for name in TABLES}
    diff = work.save(refresh.snapshot_diff(old["files"], arrived), "diff")
    known = commits.join(old["repos"].select("repo_id", F.col("commit").alias("old_commit")), "repo_id", "left")
    decisions = refresh.refresh_decision(known, diff, old["pages"], old["page_files"]).join(commits, "repo_id").filter("decision <> 'up_to_date'")
    decisions = work.save(decisions, "decisions")
    of = lambda rows, *kinds: rows.join(decisions.filter(F.col("decision").isin(*kinds)), "repo_id", "left_semi")

    pages, held = of(old["pages"], "incremental"), of(old["page_files"], "incremental")
    scope = refresh.refresh_scope(held, of(diff, "incremental"), pages).filter("kind = 'affected_title'").select("repo_id", F.col("name").alias("title"))
    scope = work.save(scope.join(pages, key, "left_semi"), "scope")
    here = of(arrived, "incremental").select("repo_id", "rel_path")
    all_held = work.save(plans.assign_orphans(pages, held.join(here, ["repo_id", "rel_path"], "left_semi"), here), "held")
    new_pages, new_held = planner(pages.join(scope, key, "left_semi").drop("content", "page_order", "slug"), all_held.join(scope, key, "left_semi"))
    new_pages, new_held = work.save(new_pages, "new_pages"), work.save(new_held, "new_held")
    texts = writer(new_pages, new_held, of(arrived, "incremental"))
    fresh = work.save(new_pages.join(texts, key).withColumn("slug", slugify_title(F.col("title"))), "fresh")
    merged = refresh.refresh_merge(pages, fresh, pages.join(scope, key, "left_semi").select("repo_id", "slug"))
    rest = pages.join(scope, key, "left_anti").select("repo_id", "slug", "title", "purpose", "parent")
    described = rest.unionByName(fresh.select(rest.columns))
    order = refresh.merged_plan(new_pages, pages, scope)
    done = merged.join(described, ["repo_id", "slug"]).join(order, key)
    done_files = all_held.join(scope, key, "left_anti").unionByName(new_held.select(all_held.columns))

    stay = ["none_affected"] if full_run is not None else ["none_affected", "full"]
    out_pages, out_files = of(old["pages"], *stay), of(old["page_files"], *stay)
    for more_pages, more_files in ((done, done_files), *([] if full_run is None else [full_run(of(arrived, "full"))])):
        out_pages = out_pages.unionByName(more_pages.select(out_pages.columns))
        out_files = out_files.unionByName(more_files.select(out_files.columns))
    kept = decisions.filter("decision = 'full'") if full_run is None else decisions.limit(0)
    renewed = decisions.join(kept, "repo_id", "left_anti")
    files = arrived.join(renewed, "repo_id", "left_semi").select("repo_id", "rel_path", "content_hash")
    files = files.union(old["files"].join(kept, "repo_id", "left_semi").select(files.columns))
    was = kept.join(known, "repo_id").select("repo_id", F.col("old_commit").alias("commit"), "decision", "unindexed_added")
    repos = renewed.select("repo_id", F.col("new_commit").alias("commit"), "decision", "unindexed_added").union(was)
    store.put(version, decisions, repos=repos, files=files, pages=out_pages, page_files=out_files)
    work.drop(*list(work.paths))


def follow_arrivals(stream: DataFrame, store: PageStore, checkpoint: str, first: int = 1, **plugs) -> None:
    """Apply a stream of whole snapshots, a version of the store per batch, until all that is there has been read."""

    def apply(batch: DataFrame, number: int) -> None:
        apply_arrivals(store, batch, first + number, **plugs)

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
