"""Queries over stored runs: arriving snapshots, retried calls, batched embedding, evolved files, page files and streams."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscribe.functions.text import slugify_title
from loomscribe.operators import chunks, filters, vectors
from loomscribe.plans import retry, runs
from loomscribe.queries_corpus import table
from loomscribe.queries_plans import SQL as PLAN_SQL
from loomscribe.sources import corpus, tables
from loomscribe.sources.carriers import carrier, ctes
from loomscribe.sources.scratch import Workspace, shared_folder
from loomscribe.streaming import ingest, jobs, progress


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def _arrival(files: DataFrame, commit: str, *edits: tuple[int, str]) -> DataFrame:
    """A whole snapshot of all files, those of some part keys edited; repository r1 has no commit 'b' of its own."""
    digest = F.md5("content")
    for every, text in edits:
        digest = F.when(F.col("p_partkey") % every == 0, F.lit(text)).otherwise(digest)
    name = F.when((F.col("repo_id") == "r1") & F.lit(commit == "b"), "a").otherwise(commit)
    return files.select("repo_id", name.alias("commit"), "rel_path", digest.alias("content_hash"))


def _stored(s: SparkSession, d: str) -> ingest.PageStore:
    """A store that holds the old snapshot and its plan as version 0."""
    store, pages = ingest.PageStore(s, _folder(s, "store")), carrier(s, d, "plan_pages")
    old = carrier(s, d, "snap_old").select("repo_id", "rel_path", "content_hash")
    repos = old.select("repo_id").distinct().withColumns({"commit": F.lit("a"), "decision": F.lit("full"), "unindexed_added": F.lit(0)})
    pages = pages.withColumns({"slug": slugify_title(F.col("title")), "page_order": F.col("page_pos"), "content": F.lit("old")})
    store.put(0, repos, repos=repos, files=old, pages=pages, page_files=carrier(s, d, "plan_files"))
    return store


def _stateful_ingest(s: SparkSession, d: str) -> DataFrame:
    """Two arrivals, the second delivered twice, and the pages as they are stored afterwards."""
    store, files = _stored(s, d), carrier(s, d, "code_files")
    arrivals = {1: _arrival(files, "b", (47, "edited")), 2: _arrival(files, "c", (47, "edited"), (43, "again"))}
    for version in (1, 2, 2):
        ingest.apply_arrivals(store, arrivals[version], version)
    return store.table("pages").select("repo_id", "slug", "page_order", "content")


def _stream_ingest(s: SparkSession, d: str) -> DataFrame:
    """The same arrivals by a stream that is taken up for each, one a batch, then folded into one version."""
    store, files = _stored(s, d), carrier(s, d, "code_files")
    base = _folder(s, "arrivals")
    schema = "repo_id string, commit string, rel_path string, content_hash string"
    for part, rows in (("1", _arrival(files, "b", (47, "edited"))), ("2", _arrival(files, "c", (47, "edited"), (43, "again")))):
        rows.write.parquet(f"{base}/in/{part}")
        ingest.follow_arrivals(s.readStream.schema(schema).parquet(f"{base}/in/*"), store, f"{base}/state")
    store.compact(2)
    return store.table("pages").select("repo_id", "slug", "page_order", "content")


def _flaky():
    """A generator that times out once for every second title, twice for every third, and refuses every fifth."""
    tries: dict[str, int] = {}

    def generate(prompt: str) -> str:
        n = int(hashlib.md5(prompt.encode()).hexdigest()[:8], 16)
        tries[prompt] = tries.get(prompt, 0) + 1
        if n % 5 == 0:
            raise ValueError("refused")
        if tries[prompt] <= (n % 2 == 0) + (n % 3 == 0):
            raise TimeoutError("slow")
        return f"# {prompt}"

    return generate


NO_WAIT = retry.Retry(initial_delay=0.0)


def _outcome(s: SparkSession, d: str) -> DataFrame:
    pages = carrier(s, d, "md_pages").select("repo_id", "slug", F.concat("repo_id", F.lit(" "), F.col("doc_id").cast("string")).alias("prompt"), "doc_id")
    return Workspace(s, "calls").save(retry.called(pages, "prompt", _flaky(), retry=NO_WAIT), "outcome")


def _retried(s: SparkSession, d: str) -> DataFrame:
    return retry.delivered(_outcome(s, d)).select("doc_id", "content")


def _dead(s: SparkSession, d: str) -> DataFrame:
    return retry.dead_letters(_outcome(s, d)).select("doc_id", "attempts", "error")


def _retry_status(s: SparkSession, d: str) -> DataFrame:
    return retry.status_rows(_outcome(s, d), "doc_id")


def _bow_model():
    """A model over lists of texts: counts of words by hash bucket."""
    words = re.compile("[a-z0-9]+")

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * 64
            for word in words.findall(text.lower()):
                vector[int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % 64] += 1
            out.append(vector)
        return out

    return embed


def _embedded(rows: DataFrame, *keys: str) -> DataFrame:
    return vectors.embed_batches(rows, _bow_model, "bow").select(*keys, F.posexplode("embedding").alias("bucket", "n")).filter("n > 0")


def _embed_fixed(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    return _embedded(chunks.fixed_chunks(docs, "doc_id"), "doc_id", "chunk_idx")


def _embed_lines(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("source").alias("repo_id"), F.col("doc_id").cast("string").alias("rel_path"), F.col("text").alias("content"))
    return _embedded(chunks.chunk_lines(docs), "repo_id", "rel_path", "piece_pos")


CATALOG = "repo_id long, name string, wiki_structure string, description string, stars long, language string, default_branch string"


def _evolved(s: SparkSession, d: str) -> DataFrame:
    """Repositories written by three versions of the catalog, read as one table of the newest."""
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("repo_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("language"), F.col("c_nationkey").alias("stars"))
    first = rows.filter("repo_id % 3 = 0").select(F.col("repo_id").cast("int").alias("repo_id"), "name")
    second = rows.filter("repo_id % 3 = 1").select("name", "repo_id", F.concat(F.lit("{"), "name", F.lit("}")).alias("wiki_structure"), F.col("stars").cast("int").alias("stars"))
    third = rows.filter("repo_id % 3 = 2").select("repo_id", "name", F.lit(None).cast("string").alias("wiki_structure"), F.col("stars").cast("long").alias("stars"), F.when(F.col("stars") % 2 == 0, F.col("language")).alias("language"), F.lit("dev").alias("default_branch"), F.lit(1).alias("extra"))
    work = Workspace(s, "catalog")
    for name, part in (("1", first), ("2", second), ("3", third)):
        work.save(part, name)
    return corpus.read_evolved(s, list(work.paths.values()), CATALOG, corpus.CATALOG_DEFAULTS)


def _page_files(s: SparkSession, d: str) -> DataFrame:
    """The newest version of every page as a file, some pages removed again, and the folder read back."""
    pages = tables.latest_pages(carrier(s, d, "md_pages").withColumn("updated_at", F.col("doc_id")))
    folder = _folder(s, "wiki")
    manifest = tables.write_page_files(pages, folder)
    tables.remove_page_files(manifest, pages.filter("doc_id % 10 = 0"), folder)
    return corpus.scan_repositories(s, folder).select("repo_id", "rel_path", "size", F.md5("content").alias("h"))


def _append_stream(s: SparkSession, d: str) -> DataFrame:
    """Messages in four files over two batches, one file delivered twice."""
    rows = carrier(s, d, "chat").withColumn("created_at", F.timestamp_seconds(1_700_000_000 + 60 * F.col("seq") + F.col("session_id") % 60))
    base = _folder(s, "messages")
    for part in (0, 1, 2, 3, 1):
        at = f"{base}/in/{uuid.uuid4().hex}"
        rows.filter(F.pmod("session_id", F.lit(4)) == part).coalesce(1).write.parquet(at)
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in/*")
    jobs.append_new(stream, f"{base}/table", f"{base}/state")
    return s.read.parquet(f"{base}/table").select("session_id", "seq", "role", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.md5("content").alias("h"))


def _ending_progress(s: SparkSession, d: str) -> DataFrame:
    """Snapshots of jobs until each ends, over several batches of a stream."""
    key, provider = "spark.sql.streaming.stateStore.providerClass", s.conf.get("spark.sql.streaming.stateStore.providerClass")
    s.conf.set(key, progress.PROVIDER)
    try:
        rows = jobs.run_available(carrier(s, d, "job_log"), lambda e: progress.job_snapshots(e, "1000 days"), mode="update", keys=("job_id",))
    finally:
        s.conf.set(key, provider)
    return progress.last_snapshots(rows)


_RULES = ("*.md", "build/", "!README.md", "d1/src", "!/d1/src/f1*", "docs/f?.yml", "**/lib/*.go", "f2", "# no rule", "", "*.[tp]s", "!*.ts", "/d3/", "\\!x", "d5/**", "!d5/test_x/")


def _ignore_rules(s: SparkSession, d: str) -> DataFrame:
    """Ignore files of several lines per repository: fixed rules, and one for each seventh file."""
    files = carrier(s, d, "mixed_files")
    fixed = files.select("repo_id").distinct().select("repo_id", F.posexplode(F.array(*[F.lit(r) for r in _RULES])).alias("line_no", "pattern"))
    own = files.filter("doc_id % 7 = 0").select("repo_id", (F.col("doc_id") + 100).cast("int").alias("line_no"), F.concat(F.when(F.col("doc_id") % 2 == 0, "!").otherwise("/"), F.col("rel_path")).alias("pattern"))
    return filters.ignored_files(files.select("repo_id", "rel_path"), fixed.union(own))


def _resumed(s: SparkSession, d: str) -> DataFrame:
    """A run that stops while texts are written, and the run that takes it up."""
    files, label = carrier(s, d, "code_files"), uuid.uuid4().hex

    def broken(batches):
        for _ in batches:
            raise RuntimeError("stopped")
        yield from ()

    try:
        runs.run_full(files, generator=broken, label=label)
    except Exception as error:
        if "stopped" not in str(error):
            raise
    return runs.run_full(files, label=label).select("repo_id", "slug", "page_order", F.md5("content").alias("h"))


QUERIES = {
    "stateful_ingest": _stateful_ingest,
    "stream_ingest": _stream_ingest,
    "retried_pages": _retried,
    "dead_letters": _dead,
    "retry_status": _retry_status,
    "embed_fixed_chunks": _embed_fixed,
    "embed_line_chunks": _embed_lines,
    "evolved_catalog": _evolved,
    "page_files": _page_files,
    "append_stream": _append_stream,
    "ending_progress": _ending_progress,
    "ignore_rules": _ignore_rules,
    "resumed_run": _resumed,
}

_SLUG = "trim(regexp_replace(lower(title), '[^a-z0-9-]+', '-', 'g'), '-')"
_MD = "with " + ctes("md_pages")
_INGESTED = "with " + ctes("plan_pages", "snap_old") + f""",
held as (select repo_id, title, rel_path from plan_files union all select repo_id, 'Overview', rel_path from code_files anti join plan_files using (repo_id, rel_path)),
known as (select *, p_partkey % 59 <> 0 was from code_files),
growing as (select distinct repo_id from known where not was),
hit1 as (select distinct f.repo_id, title from plan_files f join known k using (repo_id, rel_path) where was and p_partkey % 47 = 0 and f.repo_id <> 'r1'
  union select repo_id, title from plan_pages where contains(lower(title), 'overview') and repo_id <> 'r1' and repo_id in (select repo_id from growing)),
hit2 as (select distinct h.repo_id, title from held h join known k using (repo_id, rel_path) where p_partkey % 43 = 0 and h.repo_id <> 'r1'
  union select distinct f.repo_id, title from plan_files f join known k using (repo_id, rel_path) where was and (p_partkey % 43 = 0 or p_partkey % 47 = 0) and f.repo_id = 'r1'
  union select repo_id, title from plan_pages where contains(lower(title), 'overview') and repo_id = 'r1' and repo_id in (select repo_id from growing))
select repo_id, {_SLUG} slug, page_pos page_order,
  case when (repo_id, title) in (select (repo_id, title) from hit2) then concat('# ', title, chr(10), chr(10), purpose, chr(10), chr(10), 'c')
    when (repo_id, title) in (select (repo_id, title) from hit1) then concat('# ', title, chr(10), chr(10), purpose, chr(10), chr(10), 'b') else 'old' end content from plan_pages"""
_CALLS = _MD + """, o as (select doc_id, concat(repo_id, ' ', doc_id) prompt, cast(concat('0x', substr(md5(concat(repo_id, ' ', doc_id)), 1, 8)) as bigint) n from md_pages),
c as (select *, n % 5 = 0 dead, case when n % 2 = 0 then 1 else 0 end + case when n % 3 = 0 then 1 else 0 end waits from o)"""

SQL = {
    "stateful_ingest": _INGESTED,
    "stream_ingest": _INGESTED,
    "retried_pages": _CALLS + " select doc_id, concat('# ', prompt) content from c where not dead",
    "dead_letters": _CALLS + " select doc_id, cast(1 as int) attempts, 'ValueError: refused' error from c where dead",
    "retry_status": _CALLS + """ select doc_id, cast(i as int) step, 'running' status, concat('Retry ', i + 1, '/3 in 0s (TimeoutError)') status_description, true retrying
  from (select doc_id, unnest(range(0, waits)) i from c where not dead) x
union all select doc_id, case when dead then 0 else waits end, case when dead then 'failed' else 'done' end, case when dead then 'ValueError: refused' end, false from c""",
    "embed_fixed_chunks": """with k as (select doc_id, cast(i as int) chunk_idx, substr(text, i * 900 + 1, 1000) t
  from (select doc_id, text, unnest(range(0, (length(text) - 1) // 900 + 1)) i from documents where length(text) > 0) x),
w as (select doc_id, chunk_idx, unnest(string_split_regex(lower(t), '[^a-z0-9]+')) w from k)
select doc_id, chunk_idx, cast(cast(concat('0x', substr(md5(w), 1, 4)) as int) % 64 as int) bucket, cast(count(*) as float) n from w where w <> '' group by all""",
    "evolved_catalog": """select cast(c_custkey as bigint) repo_id, c_name "name", case when c_custkey % 3 = 1 then concat('{', c_name, '}') end wiki_structure, '' description,
  cast(case when c_custkey % 3 = 0 then 0 else c_nationkey end as bigint) stars, case when c_custkey % 3 = 2 and c_nationkey % 2 = 0 then c_mktsegment else '' end "language",
  case when c_custkey % 3 = 2 then 'dev' else 'main' end default_branch from customer""",
    "page_files": _MD + """ select repo_id, concat(slug, '.md') rel_path, strlen(content) size, md5(content) h
  from (select *, row_number() over (partition by repo_id, slug order by doc_id desc) n from md_pages) x where n = 1 and doc_id % 10 <> 0""",
    "append_stream": "with " + ctes("chat") + " select session_id, seq, role, strftime(make_timestamp((1700000000 + 60 * seq + session_id % 60) * 1000000), '%Y-%m-%d %H:%M:%S') created_at, md5(content) h from chat",
    "ending_progress": "with " + ctes("job_log") + """, e as (select *, row_number() over (partition by job_id order by case when status in ('done', 'failed') then 0 else 1 end, ts, event_id) first_end,
  row_number() over (partition by job_id order by ts desc, event_id desc) newest, bool_or(status in ('done', 'failed')) over (partition by job_id) ends from job_log)
select job_id, status, progress, status_description, status = 'running' and starts_with(status_description, 'Retry ') retrying from e where case when ends then first_end = 1 else newest = 1 end""",
    "resumed_run": PLAN_SQL["run_full"],
}
