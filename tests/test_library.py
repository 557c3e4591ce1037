"""Golden cases of the library's operators on small frames."""

import pytest
from pyspark.sql import functions as F

from loomscribe.functions import text as P
from loomscribe.operators import chunks, extract, filters, graph, vectors
from loomscribe.operators.components import connected_components
from loomscribe.plans import pages, refresh
from loomscribe.sources import corpus, tables
from loomscribe.streaming import jobs


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(column(F.col("x"))).collect()]


def files(spark, **content):
    return spark.createDataFrame([("r", k, v) for k, v in content.items()], "repo_id string, rel_path string, content string")


def code(spark, *rows):
    return spark.createDataFrame([("r", *r) for r in rows], "repo_id string, rel_path string, content string")


def test_repo_urls_and_keys(spark):
    got = one(spark, P.parse_repo_url, "https://github.com/psf/requests", "github.com/psf/requests.git/", "not-a-url", "https://host.org/a/b")
    assert [(r.owner, r.name) for r in got] == [("psf", "requests")] * 2 + [(None, None)] * 2
    assert one(spark, lambda x: P.repo_hash(F.lit("psf"), x), "requests") == ["c6ebb9682b3b3dee"]


def test_slugs_and_paths(spark):
    assert one(spark, P.slugify_title, "My Cool Component", "Engine Architecture", None) == ["my-cool-component", "engine-architecture", None]
    assert one(spark, P.path_suffix, "a/b.TAR.gz", ".env", "a.d/b") == [".gz", "", ""]
    assert one(spark, P.path_stem, "a/b.py", ".env") == ["a/b", ".env"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("C[MCP Server (stdio)]", 'C["MCP Server (stdio)"]'),
        ("H[(FileSystem /docs)]", 'H[("FileSystem /docs")]'),
        ("H[(Persistent Volume)]", "H[(Persistent Volume)]"),
        ("A((Server (HTTP)))", 'A(("Server (HTTP)"))'),
        ("A{{call(fn)}}", 'A{{"call(fn)"}}'),
        ("A -->|GET /status/{id}| B", 'A -->|"GET /status/{id}"| B'),
        ("```mermaid\ngraph TD\nA --> B\n```", "graph TD\nA --> B"),
        ("graph TD\nA[Plain] --> B(Round)", "graph TD\nA[Plain] --> B(Round)"),
        ('A["quoted (x)"]', 'A["quoted (x)"]'),
    ],
)
def test_mermaid(spark, text, expected):
    assert one(spark, P.sanitize_mermaid, text) == [expected]


def test_mermaid_blocks_leave_other_fences(spark):
    md = "x\n```mermaid\nA[f (x)]\n```\ny\n```python\nA[f (x)]\n```\n"
    assert one(spark, P.sanitize_blocks, md, None) == [md.replace("A[f (x)]", 'A["f (x)"]', 1), None]
    assert one(spark, P.valid_diagram, "graph TD", "  FlowChart LR\nx", "hello", "", None) == [True, True, False, False, False]


def test_filters(spark):
    rows = [("r", "a.py", 1), ("r", "x.png", 1), ("r", "node_modules/lib.js", 1), ("r", "big.py", 2 << 20), ("r", "eq.py", 1 << 20), ("r", "test_main.py", 1)]
    f = spark.createDataFrame(rows, "repo_id string, rel_path string, size long")
    assert {r.rel_path for r in filters.filter_corpus(f).collect()} == {"a.py", "eq.py", "test_main.py"}
    patterns = spark.createDataFrame([("r", 0, "test_*.py")], "repo_id string, line_no int, pattern string")
    assert {r.rel_path for r in filters.filter_corpus(f, patterns).collect()} == {"a.py", "eq.py"}


def test_scan_decodes_broken_bytes(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.py").write_bytes(b"x\xff")
    (row,) = corpus.scan_corpus(spark, str(tmp_path), "r").collect()
    assert (row.rel_path, row.size, row.content) == ("d/a.py", 2, "x�")


def test_imports(spark):
    f = code(
        spark,
        ("a.py", "import os, models\nfrom utils import x\n"),
        ("b.js", "import React from 'react'\nconst f = require('./models')\n"),
        ("c.go", 'import "fmt"\n  "myapp/models"\n'),
        ("d.rs", "use std::io;\nmod models;\n"),
        ("e.c", '#include "u.h"\n#include <stdio.h>\n'),
        ("f.csv", "import os"),
    )
    got = {}
    for r in extract.extract_imports(f).orderBy("rel_path", "import_pos").collect():
        got.setdefault(r.rel_path, []).append(r.raw_import)
    assert got == {"a.py": ["os", "models", "utils"], "b.js": ["react", "./models"], "c.go": ["fmt", "myapp/models"], "d.rs": ["std::io", "models"], "e.c": ["u.h"]}


def test_graph_and_clusters(spark):
    f = code(spark, ("main.py", "import models\nimport utils\nimport os\n"), ("models.py", "import main\n"), ("utils.py", ""), ("c.py", ""))
    edges, external = graph.dependency_graph(f)
    assert {(r.src, r.dst) for r in edges.collect()} == {("main.py", "models.py"), ("main.py", "utils.py"), ("models.py", "main.py")}
    assert [(r.rel_path, r.pkg) for r in external.collect()] == [("main.py", "os")]
    clusters = {r.rel_path: (r.component, r.cluster_pos) for r in graph.components(edges, f).collect()}
    assert clusters == {"main.py": ("main.py", 1), "models.py": ("main.py", 1), "utils.py": ("main.py", 1), "c.py": ("c.py", 2)}
    assert graph.dependency_text(edges, f, 1).first().text.endswith("more edges not shown)")
    assert graph.dependency_text(edges.limit(0), f).first().text == graph.NO_EDGES
    page = spark.createDataFrame([("r", "P", "main.py")], "repo_id string, title string, rel_path string")
    (row,) = graph.page_deps(page, edges, external).collect()
    assert (row.depends_on, row.depended_by, row.external_deps) == (["models.py", "utils.py"], ["models.py"], ["os"])


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}


def test_entities(spark):
    f = code(
        spark,
        ("a.py", 'class App:\n    """Doc."""\n    def run(self, n) -> int:\n        return n\n\n\ndef main():\n    pass\n'),
        ("b.kt", "class HelloWorld {\n  fun sayHello() {\n  }\n}\nfun main() {\n}\n"),
        ("c.rb", "class X\nend\n"),
    )
    got = [(r.rel_path, r.type, r.name, r.start_line, r.end_line, r.signature, r.docstring) for r in extract.extract_entities(f).orderBy("rel_path", "entity_pos").collect()]
    assert got == [
        ("a.py", "class", "App", 1, 4, None, "Doc."),
        ("a.py", "function", "run", 3, 4, "run(self, n) -> int", None),
        ("a.py", "function", "main", 7, 8, "main()", None),
        ("b.kt", "class", "HelloWorld", 1, 4, None, None),
        ("b.kt", "function", "sayHello", 2, 3, "sayHello()", None),
        ("b.kt", "function", "main", 5, 6, "main()", None),
    ]


def test_chunks_cover_their_lines(spark):
    text = "\n".join(f"line {i} " + "x" * (i % 90) for i in range(200))
    cut = chunks.chunk_lines(code(spark, ("a.txt", text))).orderBy("piece_pos").collect()
    assert all(len(c.text) <= 1000 and c.text in text for c in cut)
    lines = text.split("\n")
    assert all(c.text.split("\n")[0].strip() in lines[c.start_line - 1] for c in cut)
    f = code(spark, ("a.py", "def foo():\n    pass\n\ndef bar():\n    pass\n"))
    got = [(c.entity, c.start_line, c.end_line) for c in chunks.chunk_index(f, extract.extract_entities(f)).orderBy("chunk_idx").collect()]
    assert got == [("foo", 1, 2), ("bar", 4, 5)]


def test_vector_search(spark):
    unit = lambda i: [float(i == j) for j in range(4)]
    rows = spark.createDataFrame([("r", i, unit(i)) for i in range(3)] + [("r", 9, [0.0] * 4)], "repo_id string, chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([("r", 1, unit(0)), ("r", 2, unit(2))], "repo_id string, query_id long, embedding array<float>")
    hits = vectors.topk(asked, rows, 1)
    groups = spark.createDataFrame([(1, "g", 0), (2, "g", 1)], "query_id long, group_id string, query_pos int")
    assert [r.chunk_id for r in vectors.multi_topk(hits, groups).orderBy("pos").collect()] == [0, 2]
    assert vectors.topk(asked, rows.filter("chunk_id = 9"), 3).first().score == 0.0


def test_plan_validation(spark):
    plan = [("r", 0, "Overview", "p", None), ("r", 1, "Parts", "p", "Nope"), ("r", 2, "More", "p", "Parts")]
    p = spark.createDataFrame(plan, "repo_id string, page_pos int, title string, purpose string, parent string")
    held = spark.createDataFrame([("r", "Parts", "a.py")], "repo_id string, title string, rel_path string")
    f = spark.createDataFrame([("r", "a.py"), ("r", "orphan.py")], "repo_id string, rel_path string")
    good, errors = pages.validate_plan(p, held, f)
    got = {r.title: (r.parent, r.files) for r in good.collect()}
    assert got == {"Overview": (None, ["orphan.py"]), "Parts": (None, ["a.py"]), "More": ("Parts", None)}
    assert errors.count() == 0
    twice = p.withColumn("title", F.lit("Overview"))
    assert [r.error for r in pages.plan_errors(twice).collect()] == ["slug twice: overview"]


def test_refresh_and_tables(spark):
    old = spark.createDataFrame([("r", "a.py", "1"), ("r", "c.py", "1")], "repo_id string, rel_path string, content_hash string")
    new = spark.createDataFrame([("r", "a.py", "2"), ("r", "b.py", "1"), ("r", "c.py", "1")], "repo_id string, rel_path string, content_hash string")
    assert {(r.rel_path, r.change) for r in refresh.snapshot_diff(old, new).collect()} == {("a.py", "modified"), ("b.py", "added")}
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, c string")
    patch = spark.createDataFrame([(2, None, True)], "id int, c string, set_c boolean")
    assert sorted(tuple(r) for r in tables.patch_rows(base, patch, "id").collect()) == [(1, "a"), (2, None)]


def test_history_and_streams(spark):
    m = spark.createDataFrame([(1, i, "user", f"m{i}") for i in range(4)], "session_id long, seq long, role string, content string")
    assert [r.content for r in pages.history_window(m, 3, drop_last=True).orderBy("pos").collect()] == ["m1", "m2"]
    rows = [(1, 0, 0, "chunk", "a"), (1, 0, 1, "chunk", "b"), (1, 0, 2, "done", ""), (2, 0, 0, "chunk", "x"), (2, 0, 1, "error", "")]
    frames = spark.createDataFrame(rows, "session_id long, turn long, seq long, type string, content string")
    streamed = jobs.run_available(frames, jobs.assemble_frames).select("session_id", "content").collect()
    assert [tuple(r) for r in streamed] == [tuple(r) for r in jobs.assemble_frames(frames).select("session_id", "content").collect()] == [(1, "ab")]


def test_turns_wait_for_chunks_of_later_batches(spark):
    schema = "session_id long, turn long, seq long, type string, content string"
    rows = [(1, 0, 2, "done", ""), (1, 0, 1, "chunk", "b"), (1, 0, 0, "chunk", "a"), (2, 0, 0, "chunk", "x"), (2, 0, 1, "error", ""), (3, 0, 0, "done", "")]
    frames = spark.createDataFrame(rows, schema)
    found = jobs.run_available(frames, jobs.assemble_frames, files=6).collect()
    assert sorted((r.session_id, r.content) for r in found) == [(1, "ab"), (3, "")]


ENTITY_CASES = [
    ("a.js", "class App {\n  render() {\n    if (x) { y() }\n  }\n}\nfunction init() {\n  return new App();\n}\n", [("App", "class", 1, 5), ("render", "function", 2, 4), ("init", "function", 6, 8)]),
    ("a.ts", "interface User {\n  id: number;\n}\nclass UserService {\n  getUser(id: number): User {\n    return { id };\n  }\n}\n", [("User", "class", 1, 3), ("UserService", "class", 4, 8), ("getUser", "function", 5, 7)]),
    ("A.java", "public class A {\n  public A(int x) { }\n  // adds\n  public int add(int a, int b)\n  {\n    return a + b;\n  }\n}\n", [("A", "class", 1, 8), ("add", "function", 4, 7)]),
    ("Main.kt", "class Hello {\n  fun say() {\n    println(\"{\")\n  }\n}\nfun main() = say()\n", [("Hello", "class", 1, 5), ("say", "function", 2, 4), ("main", "function", 6, 6)]),
    ("a.go", "type T struct {\n a int\n}\nfunc (t *T) Name(a int) string {\n return \"}\"\n}\n", [("T", "class", 1, 3), ("Name", "function", 4, 6)]),
    ("a.rs", "pub struct P { a: i32 }\nimpl P {\n  pub fn new<'a>(x: &'a str) -> Self {\n    P { a: 1 }\n  }\n}\nenum E { A }\ntrait Q { }\n", [("P", "class", 1, 1), ("P", "class", 2, 6), ("new", "function", 3, 5)]),
    ("a.c", "int add(int a, int b)\n{\n  if (a) { return 1; }\n  return foo(a);\n}\nint decl(int a);\n", [("add", "function", 1, 5)]),
    ("a.py", "def f(\n    a,\n) -> int:\n    return 1\n\nx = '''\ndef no():\n'''\nasync def g(): pass\n", [("f", "function", 1, 4), ("g", "function", 9, 9)]),
    ("a.rb", "class A\nend\n", []),
    ("empty.py", "", []),
]


def test_declarations_of_many_languages(spark):
    files = spark.createDataFrame([("r", p, t) for p, t, _ in ENTITY_CASES] + [("r", "null.py", None)], "repo_id string, rel_path string, content string")
    got = {}
    for r in extract.extract_entities(files).orderBy("rel_path", "entity_pos").collect():
        got.setdefault(r.rel_path, []).append((r.name, r.type, r.start_line, r.end_line))
    assert got == {p: e for p, _, e in ENTITY_CASES if e}


def test_signatures_and_documentation():
    from loomscribe.operators.declarations import declarations

    long = "\n".join(f"    line {i}" for i in range(60))
    (f,) = declarations(f'def f(\n    a: str = "x(",\n) -> dict[str, int]:\n    """First.\n{long}\n    """\n    return 1\n', ".py")
    assert f.signature == 'f(\n    a: str = "x(",\n) -> dict[str, int]' and f.docstring.startswith("First.\n    line 0") and len(f.docstring) == 300
    (m,) = declarations("/** Gets\n * it */\nfunction get(a) {}\n", ".js")
    assert (m.signature, m.docstring) == ("get(a)", "Gets * it")
    (j,) = declarations("  // adds\n  int add(int a) { return a; }\n", ".java")
    assert (j.signature, j.docstring) == ("add(int a) -> int", "adds")


@pytest.mark.parametrize(
    "text, expected",
    [
        ('A -->|he said "go" /x| B', 'A -->|"he said #quot;go#quot; /x"| B'),
        ("A(foo (bar)) --> B(baz)", 'A("foo (bar)") --> B(baz)'),
        ("A((Server (HTTP))) --> B((x))", 'A(("Server (HTTP)")) --> B((x))'),
        ("A -->|a/b| B -->|ok| C -->|{x}| D", 'A -->|"a/b"| B -->|ok| C -->|"{x}"| D'),
    ],
)
def test_diagrams_with_several_labels_on_a_line(spark, text, expected):
    assert one(spark, P.sanitize_mermaid, text) == [expected]


def test_vectors_are_ranked_by_unrounded_scores(spark):
    asked = spark.createDataFrame([("r", 1, [1.0, 0.0])], "repo_id string, query_id long, embedding array<double>")
    rows = spark.createDataFrame([("r", 1, [1.0, 0.0001]), ("r", 2, [1.0, 0.0])], "repo_id string, chunk_id long, embedding array<double>")
    got = [(r["rank"], r.chunk_id, r.score) for r in vectors.topk(asked, rows, 2).orderBy("rank").collect()]
    assert got == [(1, 2, 1.0), (2, 1, 1.0)]


def test_streams_of_several_batches_agree_with_batch(spark):
    from loomscribe.streaming import jobs

    events = spark.range(200).select(
        F.col("id").alias("event_id"), (F.col("id") % 15).alias("job_id"), F.timestamp_seconds("id").alias("ts"), F.when(F.col("id") > 150, "done").otherwise("running").alias("status"),
        F.col("id").cast("int").alias("progress"), F.lit("Retry 1").alias("status_description"),
    )
    live = jobs.run_available(events, jobs.job_progress, mode="complete", files=7)
    assert sorted(live.collect()) == sorted(jobs.job_progress(events).collect())
    once = jobs.run_available(events, jobs.job_terminal, files=7)
    assert sorted(r.job_id for r in once.collect()) == list(range(15))


def test_a_refresh_writes_only_affected_pages(spark):
    from loomscribe.plans import runs

    code = [("r", "a.py", "import b\n"), ("r", "b.py", "def f(): pass\n")]
    new = spark.createDataFrame([(*c, str(i)) for i, c in enumerate(code)], "repo_id string, rel_path string, content string, content_hash string")
    old = new.withColumn("content_hash", F.when(F.col("rel_path") == "a.py", "before").otherwise(F.col("content_hash")))
    commits = spark.createDataFrame([("r", "x", "y")], "repo_id string, old_commit string, new_commit string")
    pages = spark.createDataFrame([("r", "A", "about a", None, 0), ("r", "B", "about b", None, 1)], "repo_id string, title string, purpose string, parent string, page_pos int")
    held = spark.createDataFrame([("r", "A", "a.py"), ("r", "B", "b.py")], "repo_id string, title string, rel_path string")
    written = spark.createDataFrame([("r", "a", 0, "old"), ("r", "b", 1, "old")], "repo_id string, slug string, page_order int, content string")

    def generator(batches):
        for batch in batches:
            yield batch.assign(content=["Uses b.py" if "- uses: b.py" in p else p for p in batch.pop("prompt")])

    got = runs.run_refresh(old, new, commits, pages, held, written, generator)
    assert sorted((r.slug, r.page_order, r.content) for r in got.collect()) == [("a", 0, "Uses b.py"), ("b", 1, "old")]


def test_page_prompt_holds_all_sections_in_order(spark):
    one_page = spark.createDataFrame([("r", "Core", "Does it", None, 0), ("r", "Bare", "Nothing", None, 1)], "repo_id string, title string, purpose string, parent string, page_pos int")
    held = spark.createDataFrame([("r", "Core", "b.py"), ("r", "Core", "a.py")], "repo_id string, title string, rel_path string")
    entities = spark.createDataFrame(
        [("r", "a.py", 0, "class", "A", 1, 4, None, "x" * 200), ("r", "b.py", 0, "function", "f", 2, 3, "f(n)", None)],
        "repo_id string, rel_path string, entity_pos int, type string, name string, start_line int, end_line int, signature string, docstring string",
    )
    deps = spark.createDataFrame([("r", "Core", ["c.py"], [], ["os", "re"])], "repo_id string, title string, depends_on array<string>, depended_by array<string>, external_deps array<string>")
    context = spark.createDataFrame([("r", "Core", 1, "b.py", "two"), ("r", "Core", 0, "a.py", "one")], "repo_id string, title string, pos int, file string, text string")
    got = {r.title: r.prompt for r in pages.page_context_pack(one_page, held, entities, deps, context).collect()}
    parts = [
        "Page: Core", "Purpose: Does it", "Files:\n- a.py\n- b.py", "Dependencies:\n- uses: c.py\n- packages: os, re",
        f"Entities:\n- **class** `A`\n  Doc: {'x' * 150}\n  Location: a.py:1-4\n- **function** `f`\n  Signature: `f(n)`\n  Location: b.py:2-3",
        "Source:\nFile: a.py\none\n\n---\n\nFile: b.py\ntwo", "Explain this component, its parts and its uses.",
    ]
    assert got["Core"] == "\n\n".join(parts)
    assert got["Bare"] == "Page: Bare\n\nPurpose: Nothing\n\nEntities:\nNo entity details available.\n\nExplain this component, its parts and its uses."


def test_planner_prompt_caps_readmes_and_clusters(spark):
    repos = spark.createDataFrame([("r",)], "repo_id string")
    readmes = spark.createDataFrame([("r", "y" * 2500)], "repo_id string, readme string")
    text = lambda value: spark.createDataFrame([("r", value)], "repo_id string, text string")
    members = [("r", f"c{n}", n, f"p{n}/f{i:02}.py") for n in range(1, 10) for i in range(12)]
    components = spark.createDataFrame(members, "repo_id string, component string, cluster_pos int, rel_path string")
    (got,) = pages.planner_context_pack(repos, readmes, text("sums"), text("deps"), components, components.select("repo_id", "rel_path")).collect()
    clusters = "\n".join(f"  Cluster {n}: " + ", ".join(f"p{n}/f{i:02}.py" for i in range(10)) for n in range(1, 9))
    assert got.prompt == "\n\n".join(["Repository: r", f"Readme:\n{'y' * 2000}", "Files:\nsums", "Dependencies:\ndeps", f"Clusters:\n{clusters}", "Plan pages that cover all 108 files."])


def test_line_chunks_are_places_of_the_text():
    import random

    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bb cc", " ", "\n", "\n\n", "x" * 50, "same line\n"]) for _ in range(rng.randrange(80)))
        spans = chunks.split_text(text, 40, 10)
        found = chunks.with_lines(text, spans)
        covered = set()
        for (a, b), (chunk, first, last) in zip(spans, found, strict=True):
            assert chunk == text[a:b] == chunk.strip() and 0 < len(chunk) <= 50
            assert (first, last) == (text.count("\n", 0, a) + 1, text.count("\n", 0, b) + 1)
            covered.update(range(a, b))
        assert all(i in covered or text[i].isspace() for i in range(len(text)))


def test_a_diagram_word_needs_what_follows_it(spark):
    assert one(spark, P.valid_diagram, "graph", "  graph  ", "graphs TD", "gantt", "pie", "stateDiagram-v2") == [False, False, False, False, True, True]


def test_headings_of_long_pages_with_fences(spark):
    import time

    lines = [line for i in range(8000) for line in (f"## Part {i % 50}", "```python", "## no heading", "``` end")] + ["text ```", "### Last", "```", "## in an open fence"]
    page = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, ""), (4, "## a\n```\n## b ```\n## c")], "id int, content string")
    extract.extract_toc(page.filter("id > 1"), "id").collect()  # the first run compiles
    began = time.time()
    got = sorted(map(tuple, extract.extract_toc(page, "id").select("id", "line_no", "level", "title", "anchor").collect()))
    assert time.time() - began < 5
    want, seen, inside = [], {}, False
    for at, line in enumerate(lines):
        fence = line.startswith("```")
        if not inside and not fence and line.startswith(("## ", "### ")):
            level, title = line.split(" ", 1)
            base = title.lower().replace(" ", "-")
            want.append((1, at, len(level), title, base if base not in seen else f"{base}-{seen[base]}"))
            seen[base] = seen.get(base, 0) + 1
        inside ^= fence
    assert got[:-1] == want and got[-1] == (4, 0, 2, "a", "a")


def test_long_entities_and_runs_are_cut_by_their_own_size(spark):
    body = ["    x = 1  # " + "c" * 28] * 60  # 2,459 characters with its head
    text = "\n".join(["def f():", *body, *["# gap " + "g" * 30] * 33, "def g():", "    return 1", *["# tail " + "t" * 43] * 40])
    table = spark.createDataFrame([("r", "a.py", text)], "repo_id string, rel_path string, content string")
    entities = spark.createDataFrame([("r", "a.py", 0, "function", "f", 1, 61), ("r", "a.py", 1, "function", "g", 95, 96)], "repo_id string, rel_path string, entity_pos int, type string, name string, start_line int, end_line int")
    got = sorted(map(tuple, chunks.chunk_entities(table, entities).orderBy("emit_pos").select("emit_pos", "entity", "start_line", "end_line", F.length("text")).collect()))
    f, g, runs = [r for r in got if r[1] == "f"], [r for r in got if r[1] == "g"], [r for r in got if r[1] is None]
    lines = text.split("\n")
    assert len(f) == 2 and all(r[4] <= 1500 for r in f) and f[0][2] == 1 and f[1][2] == f[0][3] + 1  # an estimate: overlapping lines count twice
    assert f[-1][3] >= 61 and g == [(1000, "g", 95, 96, len("\n".join(lines[94:96])))]
    assert (1_000_000, None, 62, 94, len("\n".join(lines[61:94]))) in runs  # 1,220 characters stay whole
    assert {r[2:4] for r in runs} == {(62, 94), (97, 136)} and sum(r[2] == 97 for r in runs) == 2


def brute_split(text, size, overlap, marks=("\n\n", "\n", " ", "")):
    """The pieces of a recursive splitter, as texts: split by the first mark that occurs, merge, go on with the next for long ones."""
    mark = next((m for m in marks if m == "" or m in text), "")
    rest = marks[marks.index(mark) + 1 :]
    parts = list(text) if mark == "" else [p for i, x in enumerate(text.split(mark)) for p in [x if i == 0 else mark + x]]
    out, held = [], []

    def flush():
        now, total = [], 0
        for p in held:
            if now and total + len(p) > size:
                out.append("".join(now).strip())
                while now and (total > overlap or total + len(p) > size):
                    total -= len(now.pop(0))
            now.append(p)
            total += len(p)
        if now:
            out.append("".join(now).strip())
        held.clear()

    for p in (p for p in parts if p):
        if len(p) < size:
            held.append(p)
        else:
            flush()
            out.extend(brute_split(p, size, overlap, rest) if rest else [p])
    flush()
    return [p for p in out if p]


def test_line_chunks_agree_with_a_plain_splitter(spark):
    import random

    rng = random.Random(8)
    texts = ["".join(rng.choice(["word ", "longer ", "\n", "\n\n", "x" * rng.randint(1, 80), ". "]) for _ in range(rng.randint(1, 400))) for _ in range(60)] + ["y" * 5000, " ", ""]
    table = spark.createDataFrame([("r", str(i), t) for i, t in enumerate(texts)], "repo_id string, rel_path string, content string")
    got = {}
    for r in chunks.chunk_lines(table, 300, 40).orderBy("piece_pos").collect():
        got.setdefault(int(r["rel_path"]), []).append(r["text"])
    assert got == {i: want for i, t in enumerate(texts) if (want := brute_split(t, 300, 40))}
