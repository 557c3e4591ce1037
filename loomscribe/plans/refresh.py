"""Incremental refresh: what changed between snapshots, which pages it touches, how plans merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``repo_id, rel_path, change``: files added, modified or deleted."""
    a = old.select("repo_id", "rel_path", F.col("content_hash").alias("was"), F.lit(True).alias("there"))
    b = new.select("repo_id", "rel_path", F.col("content_hash").alias("now"), F.lit(True).alias("here"))
    both = a.join(b, ["repo_id", "rel_path"], "full")
    change = F.when(F.col("there").isNull(), "added").when(F.col("here").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("now")), "modified")
    return both.select("repo_id", "rel_path", change.alias("change")).filter(F.col("change").isNotNull())


def added_files(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.select("repo_id", "rel_path").join(old.select("repo_id", "rel_path"), ["repo_id", "rel_path"], "left_anti")


def affected_pages(page_files: DataFrame, diff: DataFrame) -> DataFrame:
    """``repo_id, title`` of pages with a changed file."""
    return page_files.join(diff.filter("change <> 'added'"), ["repo_id", "rel_path"], "left_semi").select("repo_id", "title").distinct()


def overlap(page_files: DataFrame, diff: DataFrame) -> DataFrame:
    """``repo_id, title, touched``: does each page share a file with the changes."""
    hit = affected_pages(page_files, diff).withColumn("touched", F.lit(True))
    return page_files.select("repo_id", "title").distinct().join(hit, ["repo_id", "title"], "left").fillna(False, ["touched"])


def refresh_decision(repos: DataFrame, diff: DataFrame, pages: DataFrame, page_files: DataFrame) -> DataFrame:
    """``repo_id, decision, unindexed_added``: up_to_date, full, none_affected or incremental.

    ``repos``: ``repo_id, old_commit, new_commit``.  Deleted files count only once a page is touched.
    """
    changes = diff.groupBy("repo_id").agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "deleted").alias("deleted"))
    planned = pages.groupBy("repo_id").agg(F.count("*").alias("planned"))
    touched = affected_pages(page_files, diff).groupBy("repo_id").agg(F.count("*").alias("touched"))
    rows = repos
    for part in (changes, planned, touched):
        rows = rows.join(part, "repo_id", "left")
    rows = rows.fillna(0, ["added", "deleted", "planned", "touched"])
    decision = F.when(F.col("old_commit").eqNullSafe(F.col("new_commit")), "up_to_date").when(F.col("planned") == 0, "full")
    decision = decision.when(F.col("touched") == 0, "none_affected").when(F.col("deleted") > 0, "full").otherwise("incremental")
    return rows.select("repo_id", decision.alias("decision"), F.when(decision == "none_affected", F.col("added")).otherwise(0).alias("unindexed_added"))


def refresh_scope(page_files: DataFrame, diff: DataFrame, pages: DataFrame) -> DataFrame:
    """``repo_id, kind, name``: affected titles (and overviews when files were added), affected files, other titles."""
    growing = diff.filter("change = 'added'").select("repo_id").distinct()
    overviews = pages.filter(F.contains(F.lower("title"), F.lit("overview"))).join(growing, "repo_id", "left_semi").select("repo_id", "title")
    titles = affected_pages(page_files, diff).union(overviews).distinct()
    files = page_files.join(titles, ["repo_id", "title"], "left_semi").select("repo_id", "rel_path").union(diff.filter("change = 'added'").select("repo_id", "rel_path")).distinct()
    others = pages.select("repo_id", "title").join(titles, ["repo_id", "title"], "left_anti")
    parts = ((titles, "affected_title", "title"), (files, "affected_file", "rel_path"), (others, "unaffected_title", "title"))
    rows = [df.select("repo_id", F.lit(kind).alias("kind"), F.col(c).alias("name")) for df, kind, c in parts]
    return rows[0].union(rows[1]).union(rows[2])


def known_titles(new: DataFrame, unaffected: DataFrame) -> DataFrame:
    return new.select("repo_id", "title").union(unaffected.select("repo_id", "title")).distinct()


def notes_merge(pages: DataFrame, notes: DataFrame) -> DataFrame:
    """Pages with saved notes by title; one empty note where there is none."""
    empty = F.array(F.struct(F.lit("").alias("content")))
    return pages.join(notes, ["repo_id", "title"], "left").withColumn("page_notes", F.coalesce("page_notes", empty))


def order_carryover(new: DataFrame, old: DataFrame) -> DataFrame:
    """``repo_id, slug, page_order``: old orders kept, new slugs after the largest by plan position."""
    top = max_order(old)
    before = old.select("repo_id", "slug", F.col("page_order").alias("was"))
    rows = new.join(before, ["repo_id", "slug"], "left").join(top, "repo_id", "left")
    return rows.select("repo_id", "slug", F.coalesce("was", F.coalesce("max_order", F.lit(0)) + 1 + F.col("page_pos")).alias("page_order"))


def max_order(pages: DataFrame) -> DataFrame:
    return pages.groupBy("repo_id").agg(F.coalesce(F.max("page_order"), F.lit(0)).alias("max_order"))


def merged_plan(new: DataFrame, old: DataFrame, affected: DataFrame) -> DataFrame:
    """``repo_id, title, page_pos``: new pages first, then the old ones that were not affected."""
    rest = old.select("repo_id", "title", "page_pos").join(affected, ["repo_id", "title"], "left_anti")
    both = new.select("repo_id", "title", "page_pos", F.lit(0).alias("turn")).union(rest.withColumn("turn", F.lit(1)))
    return both.select("repo_id", "title", (F.row_number().over(W.partitionBy("repo_id").orderBy("turn", "page_pos", "title")) - 1).alias("page_pos"))


def refresh_merge(old_pages: DataFrame, new_pages: DataFrame, affected_slugs: DataFrame) -> DataFrame:
    """``repo_id, slug, page_order, content``: affected slugs replaced, orders carried over."""
    kept = old_pages.join(affected_slugs, ["repo_id", "slug"], "left_anti").select("repo_id", "slug", "page_order", "content")
    orders = order_carryover(new_pages, old_pages)
    return kept.unionByName(new_pages.select("repo_id", "slug", "content").join(orders, ["repo_id", "slug"]).select("repo_id", "slug", "page_order", "content"))
