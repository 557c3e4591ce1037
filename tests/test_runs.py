"""Stored pages, retried calls, batched models, evolved files, page files, streams and ignore patterns."""

import datetime as dt
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from loomscribe.operators import filters, vectors
from loomscribe.plans import refresh, retry, runs
from loomscribe.sources import corpus, tables
from loomscribe.streaming import ingest, jobs, progress


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


PAGES = "repo_id string, title string, slug string, purpose string, parent string, page_pos int, page_order int, content string"
SNAPSHOT = "repo_id string, commit string, rel_path string, content_hash string"


def stored(spark, path):
    store = ingest.PageStore(spark, str(path))
    pages, held, files = [], [], []
    for repo in ("a", "b", "c", "d"):
        pages += [(repo, "Overview", "overview", "All", None, 0, 0, "old"), (repo, "One", "one", "First", "Overview", 1, 1, "old"), (repo, "Two", "two", "Second", None, 2, 5, "old")]
        held += [(repo, "Overview", "x"), (repo, "One", "y"), (repo, "Two", "z")]
        files += [(repo, "x", "1"), (repo, "y", "1"), (repo, "z", "1")]
    repos = spark.createDataFrame([(r, "c0", "full", 0) for r in "abcd"], ingest.TABLES["repos"])
    store.put(0, repos, repos=repos, files=spark.createDataFrame(files, ingest.TABLES["files"]), pages=spark.createDataFrame(pages, PAGES), page_files=spark.createDataFrame(held, ingest.TABLES["page_files"]))
    return store


def arrival(spark):
    changed = [("a", "c1", "x", "1"), ("a", "c1", "y", "2"), ("a", "c1", "z", "1"), ("a", "c1", "new", "1")]  # y changed, one added
    same = [("b", "c0", f, "1") for f in "xyz"]
    added = [("c", "c1", f, "1") for f in ("x", "y", "z", "more")]
    less = [("d", "c1", "x", "2"), ("d", "c1", "y", "1")]
    return spark.createDataFrame(changed + same + added + less, SNAPSHOT)


def test_arrivals_renew_pages_once(spark, tmp_path):
    store = stored(spark, tmp_path)
    ingest.apply_arrivals(store, arrival(spark), 1)
    seen = {name: rows(store.table(name), "*") for name in ingest.TABLES}
    assert {(r[0], r[1], r[2]) for r in seen["repos"]} == {("a", "c1", "incremental"), ("b", "c0", "full"), ("c", "c1", "none_affected"), ("d", "c0", "full")}
    texts = {(r[0], r[2]): (r[6], r[7]) for r in seen["pages"]}
    assert texts["a", "one"] == (1, "# One\n\nFirst\n\nc1") and texts["a", "overview"][1].endswith("c1") and texts["a", "two"] == (5, "old")
    assert ("a", "Overview", "new") in seen["page_files"]
    assert all(texts[r, s][1] == "old" for r in "bcd" for s in ("overview", "one", "two"))
    ingest.apply_arrivals(store, arrival(spark), 1)  # the batch comes again
    assert {name: rows(store.table(name), "*") for name in ingest.TABLES} == seen
    ingest.apply_arrivals(store, arrival(spark), 2)  # and a batch without news changes nothing
    assert {name: rows(store.table(name), "*") for name in ingest.TABLES if name != "repos"} == {k: v for k, v in seen.items() if k != "repos"}
    store.compact(2)
    assert {name: rows(store.table(name), "*") for name in ingest.TABLES if name != "repos"} == {k: v for k, v in seen.items() if k != "repos"}
    assert {r[0] for r in store.versions().select("version").distinct().collect()} <= {1, 2}


def test_half_written_versions_are_not_read(spark, tmp_path):
    store = stored(spark, tmp_path)
    before = rows(store.table("pages"), "*")
    spark.createDataFrame([("a", "X", "x", "", None, 0, 0, "half")], PAGES).write.parquet(f"{tmp_path}/pages/version=1")
    assert rows(store.table("pages"), "*") == before
    ingest.apply_arrivals(store, arrival(spark), 1)
    assert "half" not in {r["content"] for r in store.table("pages").collect()}


def test_planned_anew_pages_merge_as_in_a_batch_refresh(spark, tmp_path):
    store = stored(spark, tmp_path)
    old = store.table("pages", 1).filter("repo_id = 'a'")

    def retitled(pages, held):
        new = F.concat("title", F.lit(" Two"))
        return pages.withColumn("title", new), held.withColumn("title", new)

    ingest.apply_arrivals(store, arrival(spark), 1, planner=retitled)
    fresh = spark.createDataFrame([("a", "overview-two", 0, "# Overview Two\n\nAll\n\nc1"), ("a", "one-two", 1, "# One Two\n\nFirst\n\nc1")], "repo_id string, slug string, page_pos int, content string")
    gone = spark.createDataFrame([("a", "overview"), ("a", "one")], "repo_id string, slug string")
    want = rows(refresh.refresh_merge(old, fresh, gone), "repo_id", "slug", "page_order", "content")
    kept = ("repo_id", "slug", "page_order", "content")
    assert {r["slug"]: r["page_order"] for r in store.table("pages").filter("repo_id = 'a'").collect()} == {"overview-two": 6, "one-two": 7, "two": 5}
    assert rows(store.table("pages").filter("repo_id = 'a'"), *kept) == [("a", "one-two", 7, "# One Two\n\nFirst\n\nc1"), ("a", "overview-two", 6, "# Overview Two\n\nAll\n\nc1"), ("a", "two", 5, "old")]
    assert want == rows(store.table("pages").filter("repo_id = 'a'"), *kept)
    assert [(r["title"], r["page_pos"]) for r in store.table("pages").filter("repo_id = 'a'").orderBy("page_pos").collect()] == [("Overview Two", 0), ("One Two", 1), ("Two", 2)]


def test_repositories_with_deletions_get_a_whole_run(spark, tmp_path):
    store = stored(spark, tmp_path)

    def whole(arrived):
        held = arrived.select("repo_id", F.lit("Overview").alias("title"), "rel_path")
        pages = held.select("repo_id", "title").distinct().withColumns({"slug": F.lit("overview"), "purpose": F.lit("p"), "parent": F.lit(None).cast("string"), "page_pos": F.lit(0), "page_order": F.lit(0), "content": F.lit("whole")})
        return pages, held

    ingest.apply_arrivals(store, arrival(spark), 1, full_run=whole)
    assert rows(store.table("pages").filter("repo_id = 'd'"), "slug", "content") == [("overview", "whole")]
    assert rows(store.table("files").filter("repo_id = 'd'"), "rel_path", "content_hash") == [("x", "2"), ("y", "1")]


def test_calls_wait_longer_each_time_and_fail_as_rows(spark):
    waits = []
    policy = retry.Retry(attempts=4, initial_delay=2, backoff=10, max_delay=30, sleep=waits.append)
    left = [TimeoutError("a"), OSError("b"), TimeoutError("c")]

    def third():
        if left:
            raise left.pop(0)
        return "fine"

    assert policy.call(third) == ("fine", 4, None, ["Retry 1/4 in 2s (TimeoutError)", "Retry 2/4 in 20s (OSError)", "Retry 3/4 in 30s (TimeoutError)"])
    assert waits == [2, 20, 30]
    assert retry.Retry(attempts=1).call(third) == ("fine", 1, None, [])

    def always(prompt):
        raise (TimeoutError if prompt == "slow" else KeyError)(prompt) if prompt != "ok" else RuntimeError

    prompts = spark.createDataFrame([("r", "a", "A", "slow"), ("r", "b", "B", "bad"), ("r", "c", "C", None)], "repo_id string, slug string, title string, prompt string")
    good, dead = retry.written_pages(prompts, lambda p: always(p) if p else "empty", retry.Retry(initial_delay=0, attempts=2))
    assert rows(good, "slug", "content") == [("c", "empty")]
    assert rows(dead, "slug", "attempts", "error") == [("a", 2, "TimeoutError: slow"), ("b", 1, "KeyError: 'bad'")]


def test_models_get_full_calls(spark):
    table = spark.createDataFrame([(i, f"text {i}" if i % 50 else None) for i in range(1030)], "id long, text string").coalesce(1)

    def load():
        seen = []
        return lambda texts: [[float(len(t)), float(len(texts)), float(len(seen) or seen.append(1) or 0)] for t in texts]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    got = vectors.embed_batches(table, load, "sizes", per_call=100).orderBy("id").collect()
    assert [r["calls"] for r in got] == [100] * 1000 + [30] * 30
    assert [r["embedding"][0] for r in got] == [len(f"text {i}") if i % 50 else 0 for i in range(1030)]
    assert all(r["error"] is None and r["attempts"] == 1 for r in got)

    def broken():
        def embed(texts):
            raise TimeoutError("down")

        return embed

    lost = vectors.embed_batches(table, broken, "broken", retry=retry.Retry(initial_delay=0)).filter("error is not null and embedding is null and attempts = 3")
    assert lost.count() == 1030


def test_blocks_find_what_a_scan_finds(spark, monkeypatch):
    rng = random.Random(4)
    chunks = spark.createDataFrame([(f"r{i % 3}", i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(400)] + [("r0", 999, None)], "repo_id string, chunk_id long, embedding array<float>").repartition(5)
    queries = chunks.filter("chunk_id % 40 = 0").selectExpr("repo_id", "chunk_id query_id", "embedding")
    want = {}
    for r in vectors.scan(queries, chunks.filter("embedding is not null")).collect():
        want.setdefault(r["query_id"], []).append((-r["score"], r["chunk_id"]))
    want = {q: sorted(v)[:7] for q, v in want.items()}
    for limit in (1 << 20, -1):
        monkeypatch.setattr(vectors, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
        got = {}
        for r in vectors.topk(queries, chunks, 7).orderBy("rank").collect():
            got.setdefault(r["query_id"], []).append((-r["score"], r["chunk_id"]))
        assert got == want


def test_versions_of_files_are_one_table(spark, tmp_path):
    spark.range(3).selectExpr("cast(id as int) repo_id", "'a' name").write.parquet(f"{tmp_path}/1")
    spark.range(3, 5).selectExpr("'b' name", "id repo_id", "cast(7 as int) stars", "cast(null as string) language").write.parquet(f"{tmp_path}/2")
    schema = "repo_id long, name string, stars long, language string, description string"
    got = corpus.read_evolved(spark, [f"{tmp_path}/1", f"{tmp_path}/2"], schema, corpus.CATALOG_DEFAULTS)
    assert rows(got, "repo_id", "name", "stars", "language", "description") == [(i, "a", 0, "", "") for i in range(3)] + [(i, "b", 7, "", "") for i in (3, 4)]


def test_page_files_are_whole_and_replaced(spark, tmp_path):
    pages = spark.createDataFrame([("r", "a", "Text ä\n"), ("r", "b", None), ("s", "a", "x" * 3_000_000)], "repo_id string, slug string, content string")
    manifest = tables.write_page_files(pages, f"file://{tmp_path}/wiki")
    manifest = tables.write_page_files(pages.withColumn("content", F.concat("content", F.lit("2"))), f"{tmp_path}/wiki")
    got = corpus.scan_repositories(spark, f"{tmp_path}/wiki")
    assert rows(got, "repo_id", "rel_path", "content") == [("r", "a.md", "Text ä\n2"), ("s", "a.md", "x" * 3_000_000 + "2")]
    assert os.path.getsize(f"{tmp_path}/wiki/r/b.md") == 0  # scans of files leave empty ones out
    left = tables.remove_page_files(manifest, pages.filter("slug = 'a'"), f"{tmp_path}/wiki")
    assert rows(left, "path", "size") == [("r/b.md", 0)]
    assert [f for _, _, names in os.walk(tmp_path) for f in names] == ["b.md"]
    for name in ("../x", ".x", ""):
        with pytest.raises(Exception, match="not a file name"):
            tables.write_page_files(pages.limit(1).withColumn("slug", F.lit(name)), f"{tmp_path}/wiki")
    with pytest.raises(ValueError):
        tables.write_page_files(pages, "hdfs://host/wiki")


def test_streamed_messages_are_stored_once(spark, tmp_path):
    schema = "session_id long, seq long, role string, content string, created_at timestamp"
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    first = [(1, 0, "user", "a", at(0)), (1, 1, "assistant", "b", at(1)), (1, 1, "assistant", "b", at(1))]
    for i, part in enumerate((first, [(2, 0, "user", "c", at(2)), first[0]], first, [(2, 1, "assistant", "d", at(3))])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    jobs.append_new(stream(), f"{tmp_path}/table", f"{tmp_path}/state")
    jobs.append_new(stream(), f"{tmp_path}/table", f"{tmp_path}/state")  # nothing new
    got = spark.read.parquet(f"{tmp_path}/table")
    assert rows(got, "session_id", "seq", "content", "created_at") == [(1, 0, "a", at(0)), (1, 1, "b", at(1)), (2, 0, "c", at(2)), (2, 1, "d", at(3))]


def test_job_state_ends_with_the_jobs(spark, tmp_path):
    schema = "job_id long, event_id long, ts timestamp, status string, progress int, status_description string"
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    parts = [
        [(1, 1, at(0), "running", 5, "x"), (2, 2, at(0), "queued", 0, None)],
        [(1, 3, at(1), "done", 100, "ok"), (1, 4, at(1.1), "running", 3, "late"), (2, 5, at(1), "running", 10, "Retry 1/3 in 2s (E)")],
        [(1, 6, at(1.2), "running", 50, "z"), (2, 7, at(2), "failed", 10, "bad")],
        [(3, 8, at(40), "done", 100, "a")],
    ]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, progress.PROVIDER)
    seen = []
    try:
        stream = progress.job_snapshots(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), hold_ms=0)
        write = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state")
        query = write.foreachBatch(lambda batch, _: seen.extend((r["job_id"], r["event_id"], r["status"], r["retrying"]) for r in batch.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
        counts = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    finally:
        spark.conf.set(key, before)
    assert sorted(seen) == [(1, 1, "running", False), (1, 3, "done", False), (2, 2, "queued", False), (2, 5, "running", True), (2, 7, "failed", False), (3, 8, "done", False)]
    assert max(counts) <= 3 and counts[-1] <= 1  # only the job that the watermark has not passed is left


def ignored(path, patterns):
    last = None
    for pattern in patterns:
        regex = filters.ignore_regex(pattern)
        if regex is not None and re.search(regex, path, re.S):
            last = pattern
    return last is not None and not last.startswith("!")


def test_ignore_matcher_agrees_with_every_pattern_in_turn(spark):
    rng = random.Random(9)
    names = ["a", "b.py", "lib", "x.tar.gz", "build", "test_x", "é", "c++", ".env"]
    path = lambda: "/".join(rng.choice(names) for _ in range(rng.randint(1, 4)))
    forms = [lambda: rng.choice(names), lambda: rng.choice(names) + "/", lambda: path(), lambda: "/" + path(), lambda: path() + "/", lambda: "*" + rng.choice([".py", ".gz", "ib", "*"]), lambda: rng.choice(names)[0] + "*", lambda: "**/" + path(), lambda: path() + "/**", lambda: "?" + rng.choice(names)[1:], lambda: "[abl]*", lambda: "\\" + rng.choice(names), lambda: "# no", lambda: ""]
    for _ in range(150):
        patterns = [rng.choice(["", "", "!"]) + rng.choice(forms)() for _ in range(rng.randint(1, 12))]
        matcher = filters.IgnoreMatcher(list(enumerate(patterns)))
        for p in {path() for _ in range(40)}:
            assert matcher.ignores(p) == ignored(p, patterns), (p, patterns)
    many = [f"d{i % 97}/f{i}.py" if i % 3 else f"!*{i}.py" for i in range(10_000)]
    files = [(r, f"d{i % 97}/f{i}.py") for r in ("r", "s") for i in range(0, 12_000, 7)]
    rules = spark.createDataFrame([("r", i, p) for i, p in enumerate(many)] + [("s", 0, "d1/"), ("s", 1, None), ("t", 0, "*")], "repo_id string, line_no int, pattern string")
    got = rows(filters.ignored_files(spark.createDataFrame(files, "repo_id string, rel_path string"), rules), "repo_id", "rel_path")
    # of the other patterns only those that end in the file's own name can match it
    ends = lambda p: [many[i] for i in range(10_000) if (many[i] == p if i % 3 else p.endswith(f"{i}.py"))]
    assert got == sorted([(r, p) for r, p in files if r == "r" and ignored(p, ends(p))] + [(r, p) for r, p in files if r == "s" and p.startswith("d1/")])


def test_a_stopped_run_goes_on_where_it_was(spark):
    files = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "id long, content string")
    made = []

    def step(run, name, source):
        return run.step(name, lambda: made.append(name) or source.withColumn(name, F.lit(1)))

    first = runs.Stages(files, "test", "label")
    one = step(first, "one", files)
    with pytest.raises(Exception, match="RAISED"):
        first.step("two", lambda: one.withColumn("two", F.raise_error(F.col("id").cast("string"))))
    again = runs.Stages(files.repartition(3), "test", "label")
    two = step(again, "two", step(again, "one", files))
    assert made == ["one", "two"] and again.reused == ["one"] and again.folder == first.folder
    assert two.count() == 5
    assert runs.Stages(files.limit(4), "test", "label").folder != first.folder != runs.Stages(files, "test", "other").folder
    assert runs.Stages(files, "test").folder != runs.Stages(files, "test").folder
    again.drop("one", "two")
