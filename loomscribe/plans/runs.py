"""Whole runs: from files to page texts, and from changed snapshots to replaced pages.

The steps of a run (edges, plan, prompts, texts) are tables in the shared folder, so that nothing is put together
or written twice.  A run that is given a label keeps them under the digest of its inputs: if it
stops, a run of the same label over the same inputs goes on after the last step that was whole.  The writer of page texts is
a plug: a function over pandas batches of prompts, run by ``mapInPandas``; the default is a native
template.  The embedder is a plug as well (``vectors.embed``).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomscribe.functions.text import slugify_title
from loomscribe.operators import chunks, extract, graph, vectors
from loomscribe.plans import pages as plans
from loomscribe.plans import refresh
from loomscribe.sources.scratch import Workspace, delete, exists, measured_joins, move, shared_folder

class Stages:
    """The steps of one run.  With a label they lie under a digest of the label and the input rows, and a step that
    is there already is read instead of computed; without one, under a name of their own."""

    def __init__(self, inputs: DataFrame, name: str, label: str | None = None):
        self.spark, digest = inputs.sparkSession, uuid.uuid4().hex
        if label is not None:
            rows = inputs.select(F.xxhash64(*sorted(inputs.columns)).cast("decimal(38,0)").alias("h"))
            n, total, spread = rows.agg(F.count("*"), F.sum("h"), F.bit_xor(F.xxhash64("h"))).first()
            digest = hashlib.sha256(repr((label, sorted(inputs.dtypes), n, total, spread)).encode()).hexdigest()[:32]
        self.folder = f"{shared_folder(self.spark)}/{name}-{digest}"
        self.reused: list[str] = []

    def step(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table of a step; it is whole once it bears its name, which it gets when all of it is written."""
        path = f"{self.folder}/{name}"
        if exists(self.spark, path):
            self.reused.append(name)
            return self.spark.read.parquet(path)
        own = f"{self.folder}/_{name}-{uuid.uuid4().hex}"
        build().write.parquet(own)
        if not move(self.spark, own, path):
            delete(self.spark, own)
        return self.spark.read.parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the tables of steps that nothing reads any more."""
        for name in names:
            delete(self.spark, f"{self.folder}/{name}")


#: Batches with ``repo_id, slug, title, prompt`` in, the same with ``content`` for ``prompt`` out.
Generator = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
KEY = ["repo_id", "title"]


def write_texts(prompts: DataFrame, generator: Generator | None = None) -> DataFrame:
    """``repo_id, slug, title, content`` of ``prompts``; without a generator, a heading and the purpose."""
    if generator is None:
        return prompts.select("repo_id", "slug", "title", F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), "purpose").alias("content"))
    asked = prompts.select("repo_id", "slug", "title", "prompt")
    return asked.mapInPandas(generator, "repo_id string, slug string, title string, content string")


#: Keeps a table that several steps read, under a name.
Keep = Callable[[str, DataFrame], DataFrame]


def retrieved_context(pages: DataFrame, page_files: DataFrame, entities: DataFrame, files: DataFrame, k: int, embedder: Callable[[Column], Column], keep: Keep) -> DataFrame:
    """``repo_id, title, pos, file, text``: the best chunks of each page's repository for its queries."""
    cut = chunks.chunk_index(files, entities).select("repo_id", "file", "text", F.concat_ws("#", "file", F.col("chunk_idx").cast("string")).alias("chunk_id"))
    cut = keep("chunks", vectors.embed(cut, "text", embedder))
    queries = plans.page_queries(pages, page_files, entities).withColumn("query_id", F.concat_ws("\n", "title", F.col("query_pos").cast("string")))
    queries = keep("queries", vectors.embed(queries, "query", embedder))
    hits = vectors.topk(queries.select("repo_id", "query_id", "embedding"), cut, k)
    ranked = hits.join(queries.select("repo_id", "query_id", "title", "query_pos"), ["repo_id", "query_id"])
    first = ranked.groupBy("repo_id", "title", "chunk_id").agg(F.min(F.struct("query_pos", "rank")).alias("at"))
    pos = F.row_number().over(W.partitionBy(*KEY).orderBy("at", "chunk_id")) - 1
    return first.withColumn("pos", pos).join(cut, ["repo_id", "chunk_id"]).select("repo_id", "title", "pos", "file", "text")


def page_prompts(files: DataFrame, pages: DataFrame, page_files: DataFrame, k: int = 3, embedder: Callable[[Column], Column] = vectors.hashed_bow, keep: Keep | None = None, resolved: DataFrame | None = None) -> DataFrame:
    """``repo_id, slug, title, purpose, page_pos, prompt`` of planned pages over a corpus.

    What several parts of a prompt need is computed once and kept: files, entities, imports, chunks and queries with their vectors.
    ``resolved`` are the imports of ``files``, if the caller has resolved them.
    """
    if keep is None:
        work = Workspace(files.sparkSession, "prompts")
        keep = lambda name, rows: work.save(rows, name)
        files, pages, page_files = keep("files", files), keep("pages", pages), keep("page_files", page_files)
    entities = keep("entities", extract.extract_entities(files))
    resolved = keep("resolved", graph.resolved_imports(files)) if resolved is None else resolved
    deps = graph.page_deps(page_files, graph.dep_edges(resolved), graph.external_deps(resolved))
    packed = plans.page_context_pack(pages, page_files, entities, deps, retrieved_context(pages, page_files, entities, files, k, embedder, keep))
    known = pages.select(*KEY, "purpose", "page_pos").join(packed.select(*KEY, "prompt"), KEY)
    return known.select("repo_id", slugify_title(F.col("title")).alias("slug"), "title", "purpose", "page_pos", "prompt")


def run_full(
    files: DataFrame, generator: Generator | None = None, k: int = 3, embedder: Callable[[Column], Column] = vectors.hashed_bow, label: str | None = None, stages: Stages | None = None
) -> DataFrame:
    """``repo_id, slug, title, page_order, content``: graph, clusters, plan, retrieval, prompts and texts of a corpus.

    ``label`` names the run and its plugs: a run that has stopped is taken up by another of the same label.  When the
    texts are written, the steps before them are deleted.  Sides of joins are broadcast by their measured rows only.
    """
    with measured_joins(files.sparkSession):
        run = stages or Stages(files, "run", label)
        if not exists(files.sparkSession, f"{run.folder}/texts"):
            given, keep = files, lambda name, rows: run.step(name, lambda: rows)
            files = run.step("files", lambda: given)
            resolved = run.step("resolved", lambda: graph.resolved_imports(files))
            edges = run.step("edges", lambda: graph.dep_edges(resolved))
            clusters = run.step("clusters", lambda: graph.components(edges, files))
            page_files = run.step("page_files", lambda: plans.fallback_plan(files, clusters))
            pages = run.step("pages", lambda: plans.fallback_pages(files, clusters))
            prompts = run.step("prompts", lambda: page_prompts(files, pages, page_files, k, embedder, keep, resolved))
            run.step("texts", lambda: write_texts(prompts, generator).join(prompts.select("repo_id", "slug", F.col("page_pos").alias("page_order")), ["repo_id", "slug"]))
            run.drop("files", "resolved", "edges", "clusters", "page_files", "pages", "entities", "chunks", "queries", "prompts")
        return run.step("texts", lambda: files).select("repo_id", "slug", "title", "page_order", "content")


def refresh_plan(old: DataFrame, new: DataFrame, commits: DataFrame, pages: DataFrame, page_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions by repository, and for incremental ones the pages to write again (``repo_id, title``)."""
    diff = Workspace(new.sparkSession, "refresh").save(refresh.snapshot_diff(old, new), "diff")
    decisions = refresh.refresh_decision(commits, diff, pages, page_files)
    scope = refresh.refresh_scope(page_files, diff, pages).filter("kind = 'affected_title'").select("repo_id", F.col("name").alias("title"))
    return decisions, scope.join(decisions.filter("decision = 'incremental'"), "repo_id", "left_semi")


def run_refresh(
    old: DataFrame, new: DataFrame, commits: DataFrame, pages: DataFrame, page_files: DataFrame, written: DataFrame, generator: Generator | None = None
) -> DataFrame:
    """``repo_id, slug, page_order, content`` after a refresh: pages with changed files are written
    again, all others stay as ``written`` (``repo_id, slug, page_order, content``) has them.

    ``new`` holds the files' ``content``.  Repositories that need a full run are left as they are;
    ``refresh_plan`` names them.
    """
    work = Workspace(new.sparkSession, "run")
    with measured_joins(new.sparkSession):
        new, pages, page_files = work.save(new, "new"), work.save(pages, "pages"), work.save(page_files, "page_files")
        scope = work.save(refresh_plan(old, new, commits, pages, page_files)[1], "scope")
        again = pages.join(scope, KEY, "left_semi")
        touched = new.join(again.select("repo_id").distinct(), "repo_id", "left_semi")
        held = page_files.join(scope, KEY, "left_semi").join(new.select("repo_id", "rel_path"), ["repo_id", "rel_path"], "left_semi")
        prompts = work.save(page_prompts(touched, again, held), "prompts")
        texts = work.save(write_texts(prompts, generator).join(prompts.select("repo_id", "slug", "page_pos"), ["repo_id", "slug"]), "texts")
    return refresh.refresh_merge(written, texts.select("repo_id", "slug", "page_pos", "content"), texts.select("repo_id", "slug"))
