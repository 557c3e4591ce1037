"""Imports: lines of an order are shuffled once, and only imports that can resolve fan out, with the same results."""

import duckdb

from loomscribe.operators import graph
from loomscribe.sources.carriers import carrier, ctes


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_an_order_are_read_once_and_give_the_pairs_of_the_sql(spark, tmp_path):
    parts = [(k, f"name {k}", "Brand#1", "TYPE", 1) for k in (1, 2, 3, 1002)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(1, 1, 1), (1, 2, 2), (1, 2, 3), (1, 3, 1), (1, 3, 1), (1, 5, 2), (2, 1, 2), (2, 2, 2), (2, 3, None), (2, 4, 1), (None, 1, 1), (None, 2, 2), (3, None, 1), (3, 0, 1002), (3, 1, 2), (4, 1, 9), (4, 2, 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    files = carrier(spark, str(tmp_path), "code_files")
    assert plan_of(files).count("l_linenumber#") > 0 and plan_of(files).count("Relation [") == 2
    con = duckdb.connect()
    for name in ("part", "lineitem"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute("with " + ctes("code_files") + " select repo_id, rel_path, p_partkey, content from code_files").fetchall()
    assert sorted(map(tuple, files.collect())) == sorted(want)


def brute(imports, index):
    keys, out = {(r, k): t for r, k, t in index}, []
    for repo, raw, suffix in imports:
        base = raw.replace(".", "/").replace("::", "/")
        tails = (parts[i:] for c in (base, base + suffix, f"{base}/index{suffix}", f"{base}/__init__.py", f"{base}/mod.rs") for parts in [c.split("/")] for i in range(len(parts)))
        out.append((repo, raw, suffix, next((keys[repo, "/".join(t)] for t in tails if (repo, "/".join(t)) in keys), None)))
    return sorted(out, key=repr)


def test_imports_resolve_to_files_packages_and_root_packages(spark):
    paths = {
        "a": ["src/x.py", "src/pkg/__init__.py", "web/ui/index.ts", "web/d.test.ts", "rs/m/mod.rs", ".py", "lib/y", "c/index"],
        "b": ["__init__.py", "deep/x.py"],
        "c": ["x.py", "mod.rs"],
        "d": ["index.ts", "q/z.d.ts"],
    }
    index = graph.file_index(spark.createDataFrame([(r, p) for r, ps in paths.items() for p in ps], "repo_id string, rel_path string"))
    raws = ["x", "src.x", "top.src.x", "pkg", "a.b.pkg", "ui", "./web/ui", "m", "crate::m", "nothing", "web/d", "d", "y", "c", "z", "no.pkg2", "end.", "src", "index"]
    imports = [(r, raw, s) for r in paths for raw in raws for s in (".py", ".ts", ".rs", "", ".d.ts", "py")]
    rows = spark.createDataFrame([(r, "f", i, raw, s) for i, (r, raw, s) in enumerate(imports)], "repo_id string, rel_path string, import_pos int, raw_import string, suffix string")
    found = {r.import_pos: r.target for r in graph.resolve_imports(rows, index).collect()}
    got = sorted(((*imports[i], found[i]) for i in range(len(imports))), key=repr)
    want = brute(imports, [tuple(r) for r in index.select("repo_id", "key", "target").collect()])
    # a package's file index.d.ts is none of the names that stand for a folder; no file here has it
    assert got == want


def test_imports_are_extracted_once(spark, tmp_path):
    files = spark.createDataFrame([("r", "a.py", "import b, c.d\nfrom  e import f\n\timport g ,h"), ("r", "b.ts", "import x from ' ./y, z '\nrequire('w')")], "repo_id string, rel_path string, content string")
    resolved = graph.resolved_imports(files)
    assert sorted(r.raw_import for r in resolved.collect()) == ["./y", "b", "c.d", "e", "g", "h", "w", "z"]
    assert "regexp_extract_all" not in plan_of(resolved)


def test_a_whole_run_resolves_imports_once(spark, monkeypatch):
    from loomscribe.plans import runs

    calls, whole = [], graph.resolve_imports
    monkeypatch.setattr(graph, "resolve_imports", lambda imports, index: calls.append(1) or whole(imports, index))
    files = spark.createDataFrame([("r", "a.py", "import b\n\ndef f():\n    return 1\n"), ("r", "b.py", "class B:\n    pass\n")], "repo_id string, rel_path string, content string")
    texts = runs.run_full(files).collect()
    assert len(calls) == 1 and texts and all(t.content for t in texts)
