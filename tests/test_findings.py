"""Cases that the last review found: whole repositories and repositories without edges."""

import hashlib
import inspect
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomscribe import queries_runs
from loomscribe.operators import chunks, graph, vectors
from loomscribe.sources import scratch


def tables(spark, path, parts, imports):
    """Parts, and orders in which each pair of parts lies on lines that follow each other."""
    rows = [(k, f"name {k}", "Brand#1", "TYPE", 1) for k in parts]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{path}/part.parquet")
    lines = [(i, key, n) for i, pair in enumerate(imports) for n, key in enumerate(pair)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def both(spark, path, name):
    """The rows of a query and of its SQL."""
    con = duckdb.connect()
    for table in ("part", "lineitem"):
        con.execute(f"create view {table} as select * from '{path}/{table}.parquet/*.parquet'")
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    got = __spark_entry__.queries()[name](spark, path).select(*names)
    return sorted(map(tuple, got.collect()), key=repr), sorted(cur.fetchall(), key=repr)


@pytest.mark.parametrize(("name", "column", "expected"), [("dep_edges", "dst", ["pkg0/m2010.py"]), ("adjacency", "targets", ["pkg0/m2010.py"]), ("components", "size", [2, 2])])
def test_imports_far_apart_are_edges(spark, tmp_path, name, column, expected):
    path = tables(spark, tmp_path, [10, 2010], [(10, 2010)])
    got, sql = both(spark, path, name)
    assert got == sql
    assert [r[column] for r in __spark_entry__.queries()[name](spark, path).collect()] == expected


@pytest.mark.parametrize("name", ["cluster_sort", "edge_budget", "cluster_pages", "fallback_plan"])
def test_clusters_reach_over_all_part_keys(spark, tmp_path, name):
    got, sql = both(spark, tables(spark, tmp_path, [10, 2010, 3000], [(10, 2010)]), name)
    assert got == sql
    assert {r[0] for r in got} == {"r0"}


def test_repositories_without_edges_are_not_listed(spark, tmp_path):
    got, sql = both(spark, tables(spark, tmp_path, [10, 20, 2010, 3001], [(10, 20)]), "dependency_text")
    assert got == sql
    assert [r[0] for r in got] == ["r0"]


def test_package_files_are_candidates_only_where_they_are(spark):
    index = graph.file_index(spark.createDataFrame([("a", "x/p/__init__.py"), ("a", "q.py"), ("b", "q.ts"), ("b", "lib/w/index.ts"), ("c", "m/mod.rs")], "repo_id string, rel_path string"))
    asked = [("a", "x.p", ".py"), ("a", "top.q", ".py"), ("b", "x.p", ".py"), ("b", "./w", ".ts"), ("b", "lib/w", ".ts"), ("b", "lib/w", ""), ("c", "m", ".rs"), ("c", "w", ".ts")]
    imports = spark.createDataFrame([(r, f"f{i}", s, 0, m) for i, (r, m, s) in enumerate(asked)], "repo_id string, rel_path string, suffix string, import_pos int, raw_import string")
    got = {r.rel_path: r.target for r in graph.resolve_imports(imports, index).collect()}
    assert got == {"f0": "x/p/__init__.py", "f1": "q.py", "f2": None, "f3": None, "f4": "lib/w/index.ts", "f5": "lib/w/index.ts", "f6": "m/mod.rs", "f7": None}


def test_buckets_are_counted_once_per_text(spark):
    texts = ["", "a a b", "One two, TWO three three three", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", vectors.hashed_bow(F.col("t")).alias("v")).orderBy("i").collect()
    for text, row in zip(texts[:3], got):
        want = [0.0] * 64
        for word in re.findall("[a-z0-9]+", text.lower()):
            want[int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % 64] += 1
        assert row.v == want
    assert got[3].v == [None] * 64


def test_queries_go_to_as_many_salts_as_their_chunks_need(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    rows = spark.createDataFrame([(f"r{i % 3}", i, [float(i % 7), float(i % 5), 1.0]) for i in range(90)], "repo_id string, chunk_id int, embedding array<float>")
    asked = rows.withColumnRenamed("chunk_id", "query_id")
    want = sorted(map(tuple, vectors.topk(asked, rows, 4).collect()))
    monkeypatch.setattr(vectors, "SALT_ROWS", 7)
    assert sorted(map(tuple, vectors.topk(asked, rows, 4).collect())) == want
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 1 << 20)
    assert sorted(map(tuple, vectors.topk(asked, rows, 4).collect())) == want


def test_chunks_are_handed_on_by_bounded_parts(spark, monkeypatch):
    texts = spark.createDataFrame([("r", f"f{i}", "word " * 900 if i % 3 else None) for i in range(6)], "repo_id string, rel_path string, content string").coalesce(1)
    plan = lambda: chunks.chunk_lines(texts, 100, 10)
    whole = sorted(map(tuple, plan().collect()))
    monkeypatch.setattr(chunks, "HANDED_CHARS", 50)
    assert sorted(map(tuple, plan().collect())) == whole and len(whole) > 100


def test_no_single_task_writes_an_arrival():
    assert "coalesce" not in inspect.getsource(queries_runs._stream_ingest)


def test_a_task_takes_a_bounded_part_of_stored_and_shuffled_rows(spark, tmp_path):
    path = tables(spark, tmp_path, range(4), [(1, 3)])
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    for key in keys:
        spark.conf.set(key, "64m")
    assert len(__spark_entry__.queries()["page_external"](spark, path).collect()) == 0
    assert [int(spark.conf.get(key)) for key in keys] == [scratch.PART_BYTES] * 2
    spark.conf.set(keys[0], "1m")
    scratch.small_parts(spark)
    assert spark.conf.get(keys[0]) == "1m"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_imports_stream_past_what_was_found(spark):
    imports = spark.createDataFrame([("r", "a.py", ".py", 0, "b"), ("r", "a.py", ".py", 1, "os"), ("r", "b.py", ".py", 0, "os")], "repo_id string, rel_path string, suffix string, import_pos int, raw_import string")
    index = graph.file_index(spark.createDataFrame([("r", "a.py"), ("r", "b.py")], "repo_id string, rel_path string"))
    found = graph.resolve_imports(imports, index)
    assert "ShuffledHashJoin" in plan_of(found)
    assert sorted((r.rel_path, r.raw_import, r.target) for r in found.collect() if r.target or r.raw_import == "os") == [("a.py", "b", "b.py"), ("a.py", "os", None), ("b.py", "os", None)]


def test_uncovered_runs_take_one_pass(spark):
    text = "\n".join(["import a", "", *["# " + "g" * 58] * 40, "def f():", "    return 1"])
    files = spark.createDataFrame([("r", "a.py", text), ("r", "b.py", None), ("r", "c.py", "x = 1")], "repo_id string, rel_path string, content string")
    entities = spark.createDataFrame([("r", "a.py", 0, "function", "f", 43, 44)], "repo_id string, rel_path string, entity_pos int, type string, name string, start_line int, end_line int")
    found = chunks.chunk_entities(files, entities)
    assert len(re.findall(r"(?m)MapInArrow run", found._jdf.queryExecution().optimizedPlan().toString())) == 2
    gaps = sorted((r.rel_path, r.emit_pos, r.text) for r in found.collect() if r.entity is None)
    run = "\n".join(text.split("\n")[:42])
    assert gaps == [*(("a.py", 1_000_000 + i, run[a:b]) for i, (a, b) in enumerate(chunks.split_text(run, 1500, 100))), ("c.py", 1_000_000, "x = 1")]
