"""Queries over chunks, vectors, plans, refresh, catalog tables, chat and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomscribe.functions.text import slugify_title
from loomscribe.operators import chunks, extract, filters, graph, vectors
from loomscribe.plans import pages as plans
from loomscribe.plans import refresh, runs
from loomscribe.queries_corpus import _BUDGET, _C, _CC, _ENT, _IMPORTS, _P, _W, _declared, _entities, _graph, _page_files, _whole_components, table
from loomscribe.sources import corpus, tables
from loomscribe.sources.carriers import carrier, ctes
from loomscribe.sources.scratch import Workspace
from loomscribe.streaming import jobs as streams


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))


def _code(s: SparkSession, d: str) -> DataFrame:
    return carrier(s, d, "code_files")


def _vec(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(s, d, "embeddings").select(F.col("label").cast("string").alias("repo_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    asked = rows.filter(F.col("chunk_id") % 50 == 0).select("repo_id", F.col("chunk_id").alias("query_id"), "embedding")
    return asked, rows


def _groups(s: SparkSession, d: str) -> DataFrame:
    asked, _ = _vec(s, d)
    return asked.select("query_id", F.concat("repo_id", F.lit("/"), F.floor(F.col("query_id") / 200).cast("string")).alias("group_id"), (F.col("query_id") / 50).cast("int").alias("query_pos"))


def _multi(s: SparkSession, d: str) -> DataFrame:
    asked, rows = _vec(s, d)
    return vectors.multi_topk(vectors.topk(asked, rows, 3), _groups(s, d))


def _retrieved(s: SparkSession, d: str) -> DataFrame:
    asked, rows = _vec(s, d)
    return vectors.retrieve(_groups(s, d), asked, rows.withColumn("text", F.concat(F.lit("chunk "), F.col("chunk_id").cast("string"))), 3)


def _plan(s: SparkSession, d: str) -> DataFrame:
    return carrier(s, d, "plan_pages")


def _snaps(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return carrier(s, d, "snap_old"), carrier(s, d, "snap_new")


def _diff(s: SparkSession, d: str) -> DataFrame:
    return refresh.snapshot_diff(*_snaps(s, d))


def _affected(s: SparkSession, d: str) -> DataFrame:
    return refresh.affected_pages(_page_files(s, d), _diff(s, d))


def _comp(s: SparkSession, d: str) -> DataFrame:
    files, edges, _ = _graph(s, d)
    return graph.components(edges, files)


def _md(s: SparkSession, d: str) -> DataFrame:
    return carrier(s, d, "md_pages")


def _chat(s: SparkSession, d: str) -> DataFrame:
    return carrier(s, d, "chat")


def _jobs(s: SparkSession, d: str) -> DataFrame:
    return carrier(s, d, "job_log")


def _job_table(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 5 == 0, F.lit("refresh")).otherwise(F.lit("full_index"))
    return _jobs(s, d).select(F.col("job_id").alias("repo_id"), F.col("event_id").alias("job_id"), kind.alias("type"), "status", F.col("ts").alias("created_at"))


def _slugs(pages: DataFrame) -> DataFrame:
    return pages.withColumn("slug", slugify_title(F.col("title")))


def _faulty(s: SparkSession, d: str) -> DataFrame:
    """The plan with a title missing here, a purpose missing there, and some titles twice."""
    title = F.when(F.col("page_pos") % 11 == 10, F.lit(" ")).when(F.col("page_pos") % 5 == 4, F.lit("Same Page!")).otherwise(F.col("title"))
    return _plan(s, d).withColumns({"title": title, "purpose": F.when(F.col("page_pos") % 7 != 3, F.col("purpose"))})


def _with_files(s: SparkSession, d: str) -> DataFrame:
    held = _page_files(s, d).groupBy("repo_id", "title").agg(F.array_sort(F.collect_list("rel_path")).alias("files"))
    return _plan(s, d).join(held, ["repo_id", "title"], "left")


def _new_plan(s: SparkSession, d: str) -> DataFrame:
    fresh = _plan(s, d).join(_affected(s, d), ["repo_id", "title"], "left_semi")
    return fresh.withColumn("title", F.when(F.col("page_pos") % 4 == 0, F.concat("title", F.lit(" Two"))).otherwise(F.col("title")))


def _context(s: SparkSession, d: str) -> DataFrame:
    files = _page_files(s, d)
    nth = F.row_number().over(W.partitionBy("repo_id", "title").orderBy("rel_path"))
    return files.withColumn("pos", nth).filter("pos <= 2").select("repo_id", "title", "pos", F.col("rel_path").alias("file"), F.lit("text").alias("text"))


def _page_pack(s: SparkSession, d: str) -> DataFrame:
    pages, held = _plan(s, d), _page_files(s, d)
    deps = graph.page_deps(held, *_graph(s, d)[1:])
    packed = plans.page_context_pack(pages, held, _entities(s, d), deps, _context(s, d))
    return packed.select("repo_id", "title", F.md5("prompt").alias("h"))


def _planner_pack(s: SparkSession, d: str) -> DataFrame:
    files, edges, _ = _graph(s, d)
    repos = files.select("repo_id").distinct()
    summary = extract.file_summary(extract.file_info(files, extract.extract_entities(files)), 20)
    readmes = repos.select("repo_id", F.concat(F.lit("About "), "repo_id").alias("readme"))
    packed = plans.planner_context_pack(repos, readmes, summary, graph.dependency_text(edges, files, 60), graph.components(edges, files), files)
    return packed.select("repo_id", F.md5("prompt").alias("h"))


def _chat_pack(s: SparkSession, d: str) -> DataFrame:
    history = plans.history_window(_chat(s, d), 5, drop_last=True)
    asked = _chat(s, d).groupBy("session_id").agg(F.max_by("content", "seq").alias("question"))
    hits = asked.select("session_id", F.lit(0).alias("pos"), F.concat(F.lit("f"), F.col("session_id").cast("string")).alias("file"), F.lit("code").alias("text"))
    return plans.chat_context_pack(asked, history, hits).select("session_id", F.md5("prompt").alias("h"))


def _frames(s: SparkSession, d: str) -> DataFrame:
    answers = _chat(s, d).filter("role = 'assistant'")
    cut = answers.select("session_id", F.col("seq").alias("turn"), F.posexplode(F.split("content", "(?<= )")).alias("seq", "content")).withColumn("type", F.lit("chunk"))
    end = answers.select("session_id", F.col("seq").alias("turn"), F.coalesce(F.size(F.split("content", "(?<= )")), F.lit(0)).alias("seq"), F.lit("").alias("content"), F.when(F.col("session_id") % 5 == 0, "error").otherwise("done").alias("type"))
    return cut.unionByName(end).select("session_id", "turn", F.col("seq").cast("long").alias("seq"), "type", "content", F.timestamp_seconds(60 * F.col("turn") + F.col("seq")).alias("ts"))


def _decision(s: SparkSession, d: str) -> DataFrame:
    return refresh.refresh_decision(_commits(s, d), _diff(s, d), _plan(s, d), _page_files(s, d))


def _merge(s: SparkSession, d: str) -> DataFrame:
    old = _slugs(_plan(s, d)).select("repo_id", "slug", F.col("page_pos").alias("page_order"), F.lit("old").alias("content"))
    new = _slugs(_new_plan(s, d)).select("repo_id", "slug", "page_pos", F.lit("new").alias("content"))
    return refresh.refresh_merge(old, new, _slugs(_affected(s, d)).select("repo_id", "slug"))


def _commits(s: SparkSession, d: str) -> DataFrame:
    repos = _code(s, d).select("repo_id").distinct()
    return repos.withColumns({"old_commit": F.lit("a"), "new_commit": F.when(F.col("repo_id") == "r1", F.lit("a")).otherwise(F.lit("b"))})


def _ingest(s: SparkSession, d: str) -> DataFrame:
    old, new = _snaps(s, d)
    arrive = lambda batch: streams.ingest(batch, old, _commits(s, d), _plan(s, d), _page_files(s, d))
    return streams.run_available(new, lambda arriving: arriving, files=4, keys=("repo_id",), per_batch=arrive)


def _full_run(s: SparkSession, d: str) -> DataFrame:
    """Corpus to graph to fallback plan to retrieval to page prompts to texts."""
    return runs.run_full(_code(s, d)).select("repo_id", "slug", "page_order", F.md5("content").alias("h"))


def _refresh_run(s: SparkSession, d: str) -> DataFrame:
    """A snapshot with changed and added files: its affected pages are written again."""
    new = _code(s, d).withColumn("content_hash", F.when(F.col("p_partkey") % 47 == 0, F.lit("edited")).otherwise(F.md5("content")))
    written = _slugs(_plan(s, d)).select("repo_id", "slug", F.col("page_pos").alias("page_order"), F.lit("old").alias("content"))
    return runs.run_refresh(_snaps(s, d)[0], new, _commits(s, d), _plan(s, d), _page_files(s, d), written)


def _written(s: SparkSession, rows: DataFrame, *write) -> DataFrame:
    """What the sinks ``write`` leave of their rows in a folder of their own."""
    path = f"{Workspace(s, 'sink').folder}/table"
    for sink, part in write:
        sink(part, path)
    return s.read.schema(rows.schema).parquet(path).select(rows.columns)


def _page_sink(s: SparkSession, d: str) -> DataFrame:
    rows = _md(s, d).select("repo_id", "slug", "doc_id", "content")
    return _written(s, rows, (tables.write_pages, rows)).select("repo_id", "slug", "doc_id", F.md5("content").alias("h"))


def _vector_sink(s: SparkSession, d: str) -> DataFrame:
    rows = _vec(s, d)[1]
    values = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double"))
    return _written(s, rows, (tables.write_partitioned, rows)).select("repo_id", "chunk_id", F.size("embedding").alias("dim"), F.round(values, 4).alias("x"))


def _replaced(s: SparkSession, d: str) -> DataFrame:
    rows = _md(s, d).select("repo_id", "doc_id")
    fresh = rows.filter("repo_id in ('src0', 'src1') and doc_id % 2 = 0").select("repo_id", (-F.col("doc_id")).alias("doc_id"))
    return _written(s, rows, (tables.write_partitioned, rows), (tables.write_partitioned, fresh))


def _vector_source(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("text"), "embedding")
    work = Workspace(s, "vectors")
    work.save(rows.select("chunk_id", "text"), "chunks")
    work.save(rows.select("chunk_id", "embedding"), "vectors")
    found = corpus.read_vectors(s, work.paths["chunks"], work.paths["vectors"])
    return found.select("chunk_id", "text", F.size("embedding").alias("dim"))


QUERIES = {
    "fixed_chunks": lambda s, d: chunks.fixed_chunks(_docs(s, d), "doc_id").select("doc_id", "chunk_idx", "start", F.md5("text").alias("h")),
    "chunk_lines": lambda s, d: chunks.chunk_lines(table(s, d, "documents").select(F.col("source").alias("repo_id"), F.col("doc_id").cast("string").alias("rel_path"), F.col("text").alias("content"))),
    "chunk_entities": lambda s, d: chunks.chunk_entities(*_declared(s, d)).select("repo_id", "rel_path", "start_line", "end_line", F.md5("text").alias("h"), "entity", "entity_type"),
    "chunk_index": lambda s, d: chunks.chunk_index(*_declared(s, d)).select("repo_id", "file", "chunk_idx", "start_line", "end_line", "entity"),
    "cover_lines": lambda s, d: chunks.uncovered_lines(_code(s, d), _entities(s, d)),
    "islands": lambda s, d: chunks.islands(_code(s, d), _entities(s, d)).select("repo_id", "rel_path", "start_line", "end_line", F.md5("content").alias("h")),
    "l2_normalize": lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(F.aggregate(vectors.l2_normalize(F.col("embedding")), F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm")),
    "embed_chunks": lambda s, d: vectors.embed(table(s, d, "part").select("p_partkey", F.col("p_name").alias("text")).repartition("p_partkey")).select("p_partkey", F.posexplode("embedding").alias("bucket", "n")).filter("n > 0"),
    "vector_scan_join": lambda s, d: vectors.scan(*_vec(s, d)),
    "vector_topk": lambda s, d: vectors.topk(*_vec(s, d), 5),
    "multi_query_topk": _multi,
    "retrieve": _retrieved,
    "vector_source": _vector_source,
    "dup_slugs": lambda s, d: plans.duplicate_slugs(_plan(s, d).withColumn("title", F.regexp_replace("title", "#.*", ""))),
    "parent_validate": lambda s, d: plans.valid_parents(_plan(s, d)).select("repo_id", "title", "parent"),
    "orphan_assign": lambda s, d: plans.assign_orphans(_plan(s, d), _page_files(s, d), _code(s, d)),
    "plan_validate": lambda s, d: plans.validate_plan(_plan(s, d), _page_files(s, d), _code(s, d))[0].select("repo_id", "title", "parent", F.size("files").alias("n_files")),
    "cluster_pages": lambda s, d: plans.cluster_pages(_whole_components(s, d).filter("size > 1"), 3),
    "fallback_plan": lambda s, d: plans.fallback_plan(carrier(s, d, "whole_files"), _whole_components(s, d)),
    "fallback_pages": lambda s, d: plans.fallback_pages(_code(s, d), _comp(s, d)).select("repo_id", "title", "purpose", "page_pos"),
    "plan_errors": lambda s, d: plans.validate_plan(_faulty(s, d), _page_files(s, d), _code(s, d))[1],
    "plan_sink": lambda s, d: plans.plan_json(_plan(s, d), "user"),
    "plan_sink_internal": lambda s, d: plans.plan_json(_with_files(s, d), "internal"),
    "plan_sink_api": lambda s, d: plans.plan_json(_plan(s, d), "api"),
    "graph_view": lambda s, d: plans.graph_view(_plan(s, d), _page_files(s, d)),
    "page_entities": lambda s, d: plans.page_entities(_page_files(s, d), _entities(s, d)).select("repo_id", "title", "entity_rank", "rel_path", "name"),
    "page_queries": lambda s, d: plans.page_queries(_plan(s, d), _page_files(s, d), _entities(s, d)),
    "page_context_pack": _page_pack,
    "planner_context_pack": _planner_pack,
    "diagram_context_pack": lambda s, d: plans.diagram_context_pack(_plan(s, d), _page_files(s, d)),
    "prompt_caps": lambda s, d: _comp(s, d).filter("cluster_pos <= 8").withColumn("nth", F.row_number().over(W.partitionBy("repo_id", "component").orderBy("rel_path"))).filter("nth <= 10").select("repo_id", "cluster_pos", "rel_path"),
    "history_window": lambda s, d: plans.history_window(_chat(s, d), 3, drop_last=True),
    "concat_agg": lambda s, d: plans.transcript(plans.history_window(_chat(s, d), 100)).select("session_id", F.md5("history").alias("h")),
    "chat_context_pack": _chat_pack,
    "snapshot_diff": _diff,
    "added_files": lambda s, d: refresh.added_files(*_snaps(s, d)),
    "removed_files": lambda s, d: refresh.added_files(*_snaps(s, d)[::-1]),
    "affected_pages": _affected,
    "overlap": lambda s, d: refresh.overlap(_page_files(s, d), _diff(s, d)),
    "affected_files": lambda s, d: refresh.refresh_scope(_page_files(s, d), _diff(s, d), _plan(s, d)).filter("kind = 'affected_file'").select("repo_id", "name"),
    "known_titles": lambda s, d: refresh.known_titles(_new_plan(s, d), _plan(s, d).join(_affected(s, d), ["repo_id", "title"], "left_anti")),
    "notes_merge": lambda s, d: refresh.notes_merge(_plan(s, d), _plan(s, d).filter("page_pos % 2 = 0").select("repo_id", "title", F.array(F.struct(F.concat(F.lit("note "), "title").alias("content"))).alias("page_notes"))).select("repo_id", "title", F.col("page_notes")[0]["content"].alias("note")),
    "order_carryover": lambda s, d: refresh.order_carryover(_slugs(_new_plan(s, d)).select("repo_id", "slug", "page_pos"), _slugs(_plan(s, d)).select("repo_id", "slug", F.col("page_pos").alias("page_order"))),
    "max_order": lambda s, d: refresh.max_order(_md(s, d)),
    "merged_plan": lambda s, d: refresh.merged_plan(_new_plan(s, d), _plan(s, d), _affected(s, d)),
    "refresh_decision": _decision,
    "refresh_scope": lambda s, d: refresh.refresh_scope(_page_files(s, d), _diff(s, d), _plan(s, d)),
    "refresh_merge": _merge,
    "distinct_sets": lambda s, d: _page_files(s, d).select("repo_id", "title").distinct(),
    "latest_page": lambda s, d: tables.latest_pages(_md(s, d).select("repo_id", "slug", F.col("page_order").alias("updated_at"), "doc_id"), "doc_id"),
    "ordered_pages": lambda s, d: tables.page_list(_md(s, d).select("repo_id").distinct().withColumn("wiki_structure", F.when(F.col("repo_id") == "src0", F.lit('{"pages":[{"slug":"b"},{"slug":"a"}]}'))), tables.latest_pages(_md(s, d).withColumn("updated_at", F.col("doc_id")))),
    "first_page": lambda s, d: tables.first_page(_md(s, d)),
    "recent_cap": lambda s, d: tables.recent_repos(table(s, d, "orders").select(F.col("o_orderkey").alias("repo_id"), F.col("o_orderdate").alias("indexed_at"))),
    "page_order": lambda s, d: _plan(s, d).select("repo_id", "title", (F.row_number().over(W.partitionBy("repo_id").orderBy("page_pos")) - 1).alias("page_order")),
    "superseded_jobs": lambda s, d: tables.supersede_jobs(_job_table(s, d)).select("job_id", "status"),
    "refreshable": lambda s, d: filters.refreshable(_jobs(s, d).select("event_id", F.when(F.col("status") == "done", "ready").when(F.col("status") == "failed", "error").otherwise(F.col("status")).alias("status"))).select("event_id", "refreshable", "reason"),
    "session_owner": lambda s, d: filters.owned_sessions(_chat(s, d).select("session_id", (F.col("seq") % 3).alias("repo_id"), "seq"), _chat(s, d).select("session_id", (F.col("session_id") % 3).alias("repo_id")).distinct()),
    "point_lookup": lambda s, d: filters.point_lookup(_md(s, d), repo_id="src0", slug="page-3").select("doc_id"),
    "nonempty_message": lambda s, d: _chat(s, d).filter(filters.not_blank(F.col("content"))).select("session_id", "seq"),
    "page_sink": _page_sink,
    "vector_sink": _vector_sink,
    "replace_repo": _replaced,
    "delete_insert": lambda s, d: tables.delete_insert(_md(s, d).select("repo_id", "slug", "doc_id"), _md(s, d).filter("doc_id % 7 = 0"), _md(s, d).filter("doc_id % 7 = 0").select("repo_id", "slug", (F.col("doc_id") + 1000000).alias("doc_id")), ["repo_id", "slug"]),
    "insert_if_absent": lambda s, d: tables.insert_if_absent(table(s, d, "nation").select("n_nationkey", "n_name").filter("n_nationkey % 2 = 0"), table(s, d, "nation").select("n_nationkey", F.lit("new").alias("n_name")), "n_nationkey"),
    "patch_row": lambda s, d: tables.patch_rows(table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), table(s, d, "customer").filter("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lit("patched")).alias("c_name"), F.lit(True).alias("set_c_name")), "c_custkey"),
    "append_message": lambda s, d: tables.append_messages(_chat(s, d).withColumn("created_at", F.current_timestamp()), _chat(s, d).filter("seq = 0").withColumn("seq", F.lit(99).cast("long"))).select("session_id", "seq", "role"),
    "job_progress_stream": lambda s, d: streams.run_available(_jobs(s, d), streams.job_progress, mode="complete"),
    "job_terminal_once": lambda s, d: streams.run_available(_jobs(s, d), lambda e: streams.job_terminal(e, "100 days")).select("job_id"),
    "chat_frame_assembly": lambda s, d: streams.run_available(_frames(s, d), streams.assemble_frames).select("session_id", "turn", F.md5("content").alias("h")),
    "incremental_ingest": _ingest,
    "run_full": _full_run,
    "run_refresh": _refresh_run,
}

_V = """with q as (select cast("label" as varchar) repo_id, vec_id query_id, embedding e from embeddings where vec_id % 50 = 0),
c as (select cast("label" as varchar) repo_id, vec_id chunk_id, embedding e from embeddings),
sc as (select c.repo_id, query_id, chunk_id, list_sum(list_transform(range(1, len(c.e) + 1), lambda i: cast(c.e[i] as double) * q.e[i]))
  / sqrt(list_sum(list_transform(c.e, lambda x: cast(x as double) * x)) * list_sum(list_transform(q.e, lambda x: cast(x as double) * x))) raw, round(raw, 6) score from q join c using (repo_id)),
rk as (select *, cast(row_number() over (partition by repo_id, query_id order by raw desc, chunk_id) as int) "rank" from sc),
mt as (select concat(repo_id, '/', query_id // 200) group_id, chunk_id, min(row(query_id // 50, "rank")) a from rk where "rank" <= 3 group by all),
mp as (select group_id, cast(row_number() over (partition by group_id order by a) - 1 as int) pos, chunk_id from mt)"""
_S = "with " + ctes("snap_old", "plan_pages") + """,
diff as (select coalesce(o.repo_id, n.repo_id) repo_id, coalesce(o.rel_path, n.rel_path) rel_path,
  case when o.rel_path is null then 'added' when n.rel_path is null then 'deleted' when o.content_hash <> n.content_hash then 'modified' end change
  from snap_old o full join snap_new n on o.repo_id = n.repo_id and o.rel_path = n.rel_path),
d as (select * from diff where change is not null),
aff as (select distinct repo_id, title from plan_files f where exists (select 1 from d where d.repo_id = f.repo_id and d.rel_path = f.rel_path and change <> 'added')),
newp as (select p.repo_id, case when page_pos % 4 = 0 then concat(title, ' Two') else title end title, page_pos from plan_pages p semi join aff using (repo_id, title)),
una as (select repo_id, title, page_pos from plan_pages anti join aff using (repo_id, title)),
ovw as (select repo_id, title from plan_pages p where contains(lower(title), 'overview') and exists (select 1 from d where d.repo_id = p.repo_id and change = 'added')),
afft as (select * from aff union select * from ovw),
afff as (select f.repo_id, f.rel_path from plan_files f semi join afft using (repo_id, title) union select repo_id, rel_path from d where change = 'added')"""
_SLUG = "trim(regexp_replace(lower(title), '[^a-z0-9-]+', '-', 'g'), '-')"
_PL = "with recursive " + ctes("plan_pages")
_MD = "with " + ctes("md_pages")
_CH = "with " + ctes("chat")
_J = "with " + ctes("job_log")
_U = _ENT + """,
ln as (select repo_id, rel_path, unnest(string_split(content, chr(10))) line, unnest(range(1, len(string_split(content, chr(10))) + 1)) line_no from code_files),
unc as (select * from ln where not exists (select 1 from ent e where e.repo_id = ln.repo_id and e.rel_path = ln.rel_path and line_no between start_line and end_line)),
isl as (select repo_id, rel_path, min(line_no) start_line, max(line_no) end_line, string_agg(line, chr(10) order by line_no) content
  from (select *, line_no - row_number() over (partition by repo_id, rel_path order by line_no) g from unc) x group by repo_id, rel_path, g),
tx as (select e.*, (select string_agg(line, chr(10) order by line_no) from ln where ln.repo_id = e.repo_id and ln.rel_path = e.rel_path and line_no between start_line and end_line) t from ent e),
ck as (select repo_id, rel_path, start_line, end_line, t as "text", name entity, "type" entity_type, entity_pos emit_pos from tx
  union all select repo_id, rel_path, start_line, end_line, content, null, null, 1000000 from isl where regexp_matches(content, '\\S'))"""
_PE = _ENT + "," + ctes("plan_files").split("\nplan_rows", 1)[1].join(["\nplan_rows", ""]) + """,
pe as (select f.repo_id, f.title, f.rel_path, name, "type", start_line, end_line, signature, docstring,
  cast(row_number() over (partition by f.repo_id, f.title order by f.rel_path, entity_pos) as int) entity_rank from plan_files f join ent using (repo_id, rel_path))"""

SQL = {
    "fixed_chunks": """select doc_id, cast(i as int) chunk_idx, cast(i * 900 as int) as start, md5(substr(text, i * 900 + 1, 1000)) h
from (select doc_id, text, unnest(range(0, (length(text) - 1) // 900 + 1)) i from documents where length(text) > 0) x""",
    "chunk_entities": _U + """ select repo_id, rel_path, cast(start_line as int) start_line, cast(end_line as int) end_line, md5("text") h, entity, entity_type from ck""",
    "chunk_index": _U + """ select repo_id, rel_path file, cast(row_number() over (partition by repo_id, rel_path order by start_line, emit_pos, "text") - 1 as int) chunk_idx, cast(start_line as int) start_line, cast(end_line as int) end_line, entity from ck""",
    "cover_lines": _U + " select repo_id, rel_path, cast(line_no as int) line_no, line from unc",
    "islands": _U + r" select repo_id, rel_path, cast(start_line as int) start_line, cast(end_line as int) end_line, md5(content) h from isl where regexp_matches(content, '\S')",
    "l2_normalize": "select vec_id, round(1.0::double, 6) norm from embeddings",
    "embed_chunks": """with w as (select p_partkey, unnest(string_split_regex(lower(p_name), '[^a-z0-9]+')) w from part)
select p_partkey, cast(cast(concat('0x', substr(md5(w), 1, 4)) as int) % 64 as int) bucket, cast(count(*) as float) n from w where w <> '' group by all""",
    "vector_scan_join": _V + " select repo_id, query_id, chunk_id, score from sc",
    "vector_topk": _V + ' select repo_id, query_id, "rank", score, chunk_id from rk where "rank" <= 5',
    "multi_query_topk": _V + " select * from mp",
    "retrieve": _V + " select chunk_id, group_id, pos, concat('chunk ', chunk_id) \"text\" from mp",
    "vector_source": "select vec_id chunk_id, concat('chunk ', vec_id) \"text\", cast(len(embedding) as int) dim from embeddings",
    "dup_slugs": _PL + " select repo_id, slug, count(*) n from (select repo_id, trim(regexp_replace(lower(regexp_replace(title, '#.*', '')), '[^a-z0-9-]+', '-', 'g'), '-') slug from plan_pages) x group by all having count(*) > 1",
    "parent_validate": _PL + " select repo_id, title, case when exists (select 1 from plan_pages q where q.repo_id = p.repo_id and q.title = p.parent) then parent end parent from plan_pages p",
    "orphan_assign": _PL + " select * from plan_files union all select repo_id, 'Overview', rel_path from code_files anti join plan_files using (repo_id, rel_path)",
    "plan_validate": _PL + """, f as (select * from plan_files union all select repo_id, 'Overview', rel_path from code_files anti join plan_files using (repo_id, rel_path))
select repo_id, title, case when exists (select 1 from plan_pages q where q.repo_id = p.repo_id and q.title = p.parent) then parent end parent,
cast((select count(*) from f where f.repo_id = p.repo_id and f.title = p.title) as int) n_files from plan_pages p""",
    "cluster_pages": _CC + """, k as (select comp.repo_id, comp.rel_path, size, component, row_number() over (partition by comp.repo_id, component order by rel_path) - 1 n from comp join sized using (repo_id, component)),
p as (select repo_id, component, row_number() over (partition by repo_id order by size desc, component) cp from sized)
select k.repo_id, concat('Component ', cp, case when size > 3 then concat(' (part ', n // 3 + 1, ')') else '' end) title, rel_path from k join p using (repo_id, component) where size > 1""",
    "fallback_plan": _CC + """, k as (select comp.repo_id, comp.rel_path, size, component, row_number() over (partition by comp.repo_id, component order by rel_path) - 1 n from comp join sized using (repo_id, component)),
p as (select repo_id, component, row_number() over (partition by repo_id order by size desc, component) cp from sized)
select k.repo_id, concat('Component ', cp, case when size > 20 then concat(' (part ', n // 20 + 1, ')') else '' end) title, rel_path from k join p using (repo_id, component)""",
    "plan_sink": _PL + """ select repo_id, concat('{"pages":[', string_agg(concat('{"title":"', title, '","purpose":"', purpose, '"', case when parent is not null then concat(',"parent":"', parent, '"') else '' end, '}'), ',' order by page_pos), ']}') json from plan_pages group by 1""",
    "plan_sink_internal": _PL + """ select repo_id, concat('{"pages":[', string_agg(concat('{"title":"', title, '","purpose":"', purpose, '"', case when parent is not null then concat(',"parent":"', parent, '"') else '' end,
  coalesce((select concat(',"files":["', string_agg(rel_path, '","' order by rel_path), '"]') from plan_files f where f.repo_id = p.repo_id and f.title = p.title having count(*) > 0), ''), '}'), ',' order by page_pos), ']}') json from plan_pages p group by 1""",
    "plan_sink_api": _PL + f""" select repo_id, concat('{{"pages":[', string_agg(concat('{{"slug":"', {_SLUG}, '","title":"', title, '","parent_slug":', case when parent is null then 'null' else concat('"', lower(parent), '"') end, ',"purpose":"', purpose, '"}}'), ',' order by page_pos), ']}}') json from plan_pages group by 1""",
    "plan_errors": _PL + f""", q as (select repo_id, page_pos, case when page_pos % 11 = 10 then ' ' when page_pos % 5 = 4 then 'Same Page!' else title end title, case when page_pos % 7 <> 3 then purpose end purpose from plan_pages)
select repo_id, concat('page ', page_pos, ': title missing') error from q where trim(title) = '' union all select repo_id, concat('page ', page_pos, ': purpose missing') from q where purpose is null
union all select repo_id, concat('slug twice: ', {_SLUG}) from q group by repo_id, {_SLUG} having count(*) > 1""",
    "graph_view": _PL + f""" select p.repo_id, {_SLUG} id, title "label", (select count(*) from plan_files f where f.repo_id = p.repo_id and f.title = p.title) file_count, lower(parent) "source" from plan_pages p""",
    "page_entities": _PE + " select repo_id, title, entity_rank, rel_path, name from pe",
    "page_queries": _PE.replace("plan_files as", "plan_files as", 1) + """,
fl as (select repo_id, title, string_agg(rel_path, ' ' order by rel_path) t from (select *, row_number() over (partition by repo_id, title order by rel_path) n from plan_files) x where n <= 5 group by all),
nm as (select repo_id, title, string_agg(name, ' ' order by entity_rank) t from pe where entity_rank <= 5 group by all)
select repo_id, title, 0 query_pos, concat_ws(' ', title, fl.t) query from plan_pages p left join fl using (repo_id, title)
union all select repo_id, title, 1, purpose from plan_pages union all select repo_id, title, 2, nm.t from plan_pages join nm using (repo_id, title)""",
    "diagram_context_pack": _PL + """ select repo_id, string_agg(concat('- ', title, case when parent is not null then concat(' [child of: ', parent, ']') else '' end, ' (', (select count(*) from plan_files f where f.repo_id = p.repo_id and f.title = p.title), ' files)'), chr(10) order by page_pos) prompt from plan_pages p group by 1""",
    "prompt_caps": _CC + """, k as (select comp.repo_id, rel_path, component, row_number() over (partition by comp.repo_id, component order by rel_path) n from comp),
p as (select repo_id, component, cast(row_number() over (partition by repo_id order by size desc, component) as int) cluster_pos from sized)
select repo_id, cluster_pos, rel_path from k join p using (repo_id, component) where cluster_pos <= 8 and n <= 10""",
    "history_window": _CH + " select session_id, cast(row_number() over (partition by session_id order by seq) - 1 as int) pos, role, content from (select *, row_number() over (partition by session_id order by seq desc) b from chat) x where b between 2 and 3",
    "concat_agg": _CH + " select session_id, md5(string_agg(concat(upper(role), ': ', content), chr(10) order by seq)) h from chat group by 1",
    "chat_context_pack": _CH + """, b as (select *, row_number() over (partition by session_id order by seq desc) b from chat)
select session_id, md5(concat('Conversation history:', chr(10), coalesce(string_agg(concat(upper(role), ': ', content), chr(10) order by seq) filter (b between 2 and 5), ''), chr(10), chr(10),
'Relevant source code:', chr(10), 'File: f', session_id, chr(10), 'code', chr(10), chr(10), 'USER: ', max(content) filter (b = 1))) h from b group by session_id""",
    "snapshot_diff": _S + " select * from d",
    "added_files": _S + " select repo_id, rel_path from d where change = 'added'",
    "removed_files": _S + " select repo_id, rel_path from d where change = 'deleted'",
    "affected_pages": _S + " select * from aff",
    "overlap": _S + " select repo_id, title, exists (select 1 from aff where aff.repo_id = t.repo_id and aff.title = t.title) touched from (select distinct repo_id, title from plan_files) t",
    "affected_files": _S + " select repo_id, rel_path name from afff",
    "known_titles": _S + " select repo_id, title from newp union select repo_id, title from una",
    "notes_merge": _PL + " select repo_id, title, case when page_pos % 2 = 0 then concat('note ', title) else '' end note from plan_pages",
    "order_carryover": _S + f" select n.repo_id, {_SLUG.replace('title', 'n.title')} slug, cast(coalesce(o.page_pos, (select max(page_pos) from plan_pages m where m.repo_id = n.repo_id) + 1 + n.page_pos) as int) page_order from newp n left join plan_pages o on o.repo_id = n.repo_id and o.title = n.title",
    "max_order": _MD + " select repo_id, max(page_order) max_order from md_pages group by 1",
    "merged_plan": _S + " select repo_id, title, cast(row_number() over (partition by repo_id order by t, page_pos, title) - 1 as int) page_pos from (select *, 0 t from newp union all select *, 1 from una) x",
    "refresh_decision": _S + """, n as (select repo_id, count(*) filter (change = 'added') a, count(*) filter (change = 'deleted') x from d group by 1)
select repo_id, case when repo_id = 'r1' then 'up_to_date' when not exists (select 1 from aff where aff.repo_id = n.repo_id) then 'none_affected' when x > 0 then 'full' else 'incremental' end decision, cast(0 as bigint) unindexed_added from n""",
    "refresh_scope": _S + " select repo_id, 'affected_title' kind, title name from afft union all select repo_id, 'affected_file', rel_path from afff union all select repo_id, 'unaffected_title', title from plan_pages anti join afft using (repo_id, title)",
    "refresh_merge": _S + f""" select repo_id, {_SLUG} slug, page_pos page_order, 'old' content from una
union all select n.repo_id, {_SLUG.replace('title', 'n.title')}, coalesce(o.page_pos, (select max(page_pos) from plan_pages m where m.repo_id = n.repo_id) + 1 + n.page_pos), 'new' from newp n left join plan_pages o on o.repo_id = n.repo_id and o.title = n.title""",
    "distinct_sets": _PL + " select distinct repo_id, title from plan_files",
    "latest_page": _MD + " select repo_id, slug, page_order updated_at, doc_id from (select *, row_number() over (partition by repo_id, slug order by page_order desc, doc_id) n from md_pages) x where n = 1",
    "ordered_pages": _MD + """, l as (select * from (select *, row_number() over (partition by repo_id, slug order by doc_id desc) n from md_pages) x where n = 1)
select repo_id, cast(row_number() over (partition by repo_id order by page_order, slug) - 1 as int) pos, slug from l where repo_id <> 'src0' union all select 'src0', 0, 'b' union all select 'src0', 1, 'a'""",
    "first_page": _MD + " select repo_id, slug from (select *, row_number() over (partition by repo_id order by page_order, slug) n from md_pages) x where n = 1",
    "recent_cap": "select o_orderkey repo_id, o_orderdate indexed_at from orders order by o_orderdate desc, o_orderkey limit 20",
    "page_order": _PL + " select repo_id, title, cast(row_number() over (partition by repo_id order by page_pos) - 1 as int) page_order from plan_pages",
    "superseded_jobs": _J + """, t as (select event_id job_id, job_id repo_id, event_id % 5 = 0 refresh, status, ts from job_log)
select job_id, case when not refresh and status in ('queued', 'running') and lead(job_id) over (partition by repo_id, refresh order by ts, job_id) is not null then 'failed' else status end status from t""",
    "refreshable": _J + ", t as (select event_id, case status when 'done' then 'ready' when 'failed' then 'error' else status end status from job_log) select event_id, status in ('ready', 'error') refreshable, case when status not in ('ready', 'error') then concat('status is ', status) end reason from t",
    "session_owner": _CH + " select session_id, seq % 3 repo_id, seq from chat where seq % 3 = session_id % 3",
    "point_lookup": _MD + " select doc_id from md_pages where repo_id = 'src0' and slug = 'page-3'",
    "nonempty_message": _CH + r" select session_id, seq from chat where regexp_matches(content, '\S')",
    "page_sink": _MD + " select repo_id, slug, doc_id, md5(content) h from md_pages",
    "vector_sink": 'select cast("label" as varchar) repo_id, vec_id chunk_id, cast(len(embedding) as int) dim, round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 4) x from embeddings',
    "replace_repo": _MD + " select repo_id, doc_id from md_pages where repo_id not in (select repo_id from md_pages where repo_id in ('src0', 'src1') and doc_id % 2 = 0) union all select repo_id, -doc_id from md_pages where repo_id in ('src0', 'src1') and doc_id % 2 = 0",
    "delete_insert": _MD + ", g as (select distinct repo_id, slug from md_pages where doc_id % 7 = 0) select repo_id, slug, doc_id from md_pages anti join g using (repo_id, slug) union all select repo_id, slug, doc_id + 1000000 from md_pages where doc_id % 7 = 0",
    "insert_if_absent": "select n_nationkey, case when n_nationkey % 2 = 0 then n_name else 'new' end n_name from nation",
    "patch_row": "select c_custkey, case when c_custkey % 6 = 0 then 'patched' when c_custkey % 3 = 0 then null else c_name end c_name, c_mktsegment from customer",
    "append_message": _CH + " select session_id, seq, role from chat union all select session_id, 99, role from chat where seq = 0",
    "job_progress_stream": _J + ", l as (select *, row_number() over (partition by job_id order by ts desc, event_id desc) n from job_log) select job_id, status, progress, status_description, status = 'running' and starts_with(status_description, 'Retry ') retrying from l where n = 1",
    "job_terminal_once": _J + " select distinct job_id from job_log where status in ('done', 'failed')",
    "chat_frame_assembly": _CH + " select session_id, seq turn, md5(content) h from chat where role = 'assistant' and session_id % 5 <> 0",
    "run_refresh": _C + "," + ctes("plan_pages").split("\nplan_rows", 1)[1].join(["\nplan_rows", ""]) + f""",
hit as (
  select distinct repo_id, title from plan_files f join code_files c using (repo_id, rel_path) where p_partkey % 47 = 0 and p_partkey % 59 <> 0
  union select repo_id, title from plan_pages where contains(lower(title), 'overview') and repo_id in (select repo_id from code_files where p_partkey % 59 = 0))
select repo_id, {_SLUG} slug, page_pos page_order,
  case when repo_id <> 'r1' and (repo_id, title) in (select (repo_id, title) from hit) then concat('# ', title, chr(10), chr(10), purpose) else 'old' end content from plan_pages""",
}

_PAGED = _CC + """, k as (select comp.repo_id, comp.rel_path, size, component, row_number() over (partition by comp.repo_id, component order by rel_path) - 1 n from comp join sized using (repo_id, component)),
p as (select repo_id, component, row_number() over (partition by repo_id order by size desc, component) cp from sized),
t as (select distinct k.repo_id, cp, n // 20 + 1 pt, concat('Component ', cp, case when size > 20 then concat(' (part ', n // 20 + 1, ')') else '' end) title, concat('Documentation for component ', cp, '.') purpose
  from k join p using (repo_id, component)
  union all select distinct repo_id, 0, 0, 'Overview', concat('High-level overview of the ', repo_id, ' project architecture and components.') from code_files),
o as (select repo_id, title, purpose, cast(row_number() over (partition by repo_id order by cp, pt) - 1 as int) page_pos from t)"""
SQL["fallback_pages"] = _PAGED + " select repo_id, title, purpose, page_pos from o"
SQL["run_full"] = _PAGED + f" select repo_id, {_SLUG} slug, page_pos page_order, md5(concat('# ', title, chr(10), chr(10), purpose)) h from o"
SQL["incremental_ingest"] = f"select repo_id, rel_path, change, decision from ({SQL['snapshot_diff']}) d join ({SQL['refresh_decision']}) n using (repo_id)"
SQL |= {name: SQL[name].replace(_C, _W) for name in ("cluster_pages", "fallback_plan")}
