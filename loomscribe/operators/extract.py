"""Extraction of imports, declarations and markdown parts from texts.

Every extractor turns one row into many, with native regular expressions and higher-order
functions but for declarations, which one Arrow pass scans; nothing is shuffled but where
anchors are numbered within a page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomscribe.functions.text import is_file_path, path_suffix, slugify_heading
from loomscribe.operators.declarations import HEADS, declarations

_FLAGS = "(?Umd)"
#: Import statements by language, module names in the groups.
_PYTHON = r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+(?:\s*,\s*[\w.]+)*))"
_SCRIPT = r"""(?:import\s+.*?\s+from\s+['"]([^'"]+)['"]|require\s*\(\s*['"]([^'"]+)['"]\s*\))"""
_GO = r'^\s*(?:import\s+"([^"]+)"|"([^"]+)")'
_JVM = r"^\s*import\s+([\w.]+)"
_RUST = r"^\s*(?:use\s+([\w:]+)|mod\s+(\w+))"
_C = r'^\s*#include\s+"([^"]+)"'
IMPORTS = {
    _PYTHON: (".py",),
    _SCRIPT: (".js", ".jsx", ".ts", ".tsx"),
    _GO: (".go",),
    _JVM: (".java", ".kt", ".kts", ".cs"),
    _RUST: (".rs",),
    _C: (".c", ".h", ".cpp", ".cc"),
}


def _modules(content: Column, pattern: str) -> Column:
    groups = [F.regexp_extract_all(content, F.lit(_FLAGS + pattern), F.lit(g)) for g in range(1, 1 + pattern.count("(") - pattern.count("(?") - pattern.count(r"\("))]
    both = groups[0] if len(groups) == 1 else F.zip_with(*groups, lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b))
    trimmed = lambda m: F.transform(F.split(m, ","), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    # what a pattern takes between quotes may have blanks at its ends; other modules have them at commas only
    parts = F.transform(both, trimmed if "[^" in pattern else lambda m: F.when(F.contains(m, F.lit(",")), trimmed(m)).otherwise(F.array(m)))
    return F.filter(F.flatten(parts), lambda p: p != "")


def extract_imports(files: DataFrame) -> DataFrame:
    """``repo_id, rel_path, suffix, import_pos, raw_import`` in order of appearance."""
    suffix, found = path_suffix(F.col("rel_path")), F.lit(None).cast("array<string>")
    for pattern, suffixes in IMPORTS.items():
        found = F.when(suffix.isin(*suffixes), _modules(F.col("content"), pattern)).otherwise(found)
    return files.select("repo_id", "rel_path", suffix.alias("suffix"), F.posexplode(found).alias("import_pos", "raw_import"))


_ENTITIES = pa.schema(
    [("repo_id", pa.string()), ("rel_path", pa.string()), ("entity_pos", pa.int32()), ("type", pa.string()), ("name", pa.string())]
    + [("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()), ("docstring", pa.string())]
)


def extract_entities(files: DataFrame) -> DataFrame:
    """``repo_id, rel_path, entity_pos, type, name, start_line, end_line, signature, docstring``.

    A declaration scan: the heads of declarations in the file's language, in order, nested ones
    too, with the block that follows by indentation or braces, the parameters and result, and at
    most 300 characters of documentation.  One map-side pass, linear in a file's length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repo, path, suffix, content in zip(*(batch[c].to_pylist() for c in ("repo_id", "rel_path", "suffix", "content")), strict=True):
                rows += [(repo, path, i, *d) for i, d in enumerate(declarations(content or "", suffix))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ENTITIES)], schema=_ENTITIES)

    suffix = path_suffix(F.col("rel_path"))
    known = files.select("repo_id", "rel_path", suffix.alias("suffix"), "content").filter(F.col("suffix").isin(*HEADS))
    fields = "repo_id string, rel_path string, entity_pos int, type string, name string, start_line int, end_line int, signature string, docstring string"
    return known.mapInArrow(run, fields)


def file_info(files: DataFrame, entities: DataFrame, names: int = 20) -> DataFrame:
    """``repo_id, rel_path, class_count, function_count, summary`` of every file."""
    first = F.slice(F.array_sort(F.collect_list(F.struct("entity_pos", "name"))), 1, names)
    counted = entities.groupBy("repo_id", "rel_path").agg(
        F.count_if(F.col("type") == "class").alias("class_count"),
        F.count_if(F.col("type") == "function").alias("function_count"),
        F.array_join(F.transform(first, lambda e: e["name"]), ", ").alias("summary"),
    )
    joined = files.select("repo_id", "rel_path").join(counted, ["repo_id", "rel_path"], "left")
    return joined.withColumns({"class_count": F.coalesce("class_count", F.lit(0)), "function_count": F.coalesce("function_count", F.lit(0)), "summary": F.coalesce("summary", F.lit(""))})


def summary_line() -> Column:
    """A file's line in the summary of its repository."""
    some = F.format_string("%s: %d classes, %d functions [%s]", "rel_path", "class_count", "function_count", "summary")
    return F.when(F.col("class_count") + F.col("function_count") > 0, some).otherwise(F.concat("rel_path", F.lit(": (no named entities)")))


def file_summary(info: DataFrame, max_files: int = 200) -> DataFrame:
    """``repo_id, text``: the first files by path and how many more there are.

    The window keeps only the first ranks of every map-side partition before the shuffle.
    """
    total = info.groupBy("repo_id").agg(F.count("*").alias("n"))
    ranked = info.withColumn("rank", F.row_number().over(W.partitionBy("repo_id").orderBy("rel_path"))).filter(F.col("rank") <= max_files)
    text = ranked.groupBy("repo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", summary_line().alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    more = F.when(F.col("n") > max_files, F.format_string("\n... and %d more files", F.col("n") - max_files)).otherwise(F.lit(""))
    return text.join(total, "repo_id").select("repo_id", F.concat("text", more).alias("text"))


def extract_citations(pages: DataFrame, *keys: str) -> DataFrame:
    """``keys, cite_pos, path, lines``: cited files; a bare line range inherits the path before it."""
    inner = F.regexp_extract_all("content", F.lit(r"\*Sources?:\s*([^*\n]+)\*"), F.lit(1))
    items = F.flatten(F.transform(inner, lambda s: F.split(s, ",")))
    rows = pages.select(*keys, F.posexplode(F.transform(items, lambda i: F.trim(i))).alias("cite_pos", "item"))
    item = F.regexp_replace("item", r"^.*?/blob/[^/]+/", "")
    bare = item.rlike(r"^L?\d+(?:-L?\d+)?$")
    own = F.when(~bare, F.regexp_replace(item, r"[:#]L?\d.*$", ""))
    lines = F.when(bare, item).otherwise(F.nullif(F.regexp_extract(item, r"[:#](L?\d[\dL-]*)$", 1), F.lit("")))
    before = F.last("own", ignorenulls=True).over(W.partitionBy(*keys).orderBy("cite_pos").rowsBetween(W.unboundedPreceding, 0))
    filled = rows.select(*keys, "cite_pos", own.alias("own"), lines.alias("lines")).withColumn("path", before)
    return filled.filter(F.col("path").isNotNull() & is_file_path(F.col("path"))).select(*keys, "cite_pos", "path", "lines")


def _headings(content: Column) -> Column:
    """``array<string>``: the heading lines outside fences, each as its number, a colon and the line.

    Lines get their numbers, a fence line becomes a bare fence, and one replacement takes out all
    from fence to fence (or to the end): three linear passes over the text.
    """
    numbered = F.transform(F.split(content, "\n"), lambda line, i: F.when(line.startswith("```"), F.lit("```")).otherwise(F.concat(i.cast("string"), F.lit(":"), line)))
    text = F.regexp_replace(F.array_join(numbered, "\n"), r"(?md)^```$[\s\S]*?(?:^```$|\z)", "")
    return F.filter(F.split(text, "\n"), lambda line: line.rlike("^[0-9]+:#{2,3} "))


def extract_toc(pages: DataFrame, *keys: str) -> DataFrame:
    """``keys, line_no, level, title, anchor``: second and third level headings, anchors unique per page."""
    rows = pages.select(*keys, F.explode(_headings(F.col("content"))).alias("x"))
    at, line = F.substring_index("x", ":", 1).cast("int"), F.regexp_replace("x", "^[0-9]+:", "")
    title = F.trim(F.regexp_replace(line, "^#+ ", ""))
    rows = rows.select(*keys, at.alias("line_no"), F.length(F.regexp_extract(line, "^(#+)", 1)).alias("level"), title.alias("title"), slugify_heading(title).alias("base"))
    nth = F.row_number().over(W.partitionBy(*keys, "base").orderBy("line_no")) - 1
    return rows.withColumn("anchor", F.when(nth == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), nth.cast("string")))).drop("base")


def extract_code_blocks(pages: DataFrame, *keys: str) -> DataFrame:
    """``keys, block_pos, language, is_mermaid, code``: fenced blocks in order."""
    fence = r"(?s)```(\w*)[^\n]*\n(.*?)\n?```"
    both = F.arrays_zip(F.regexp_extract_all("content", F.lit(fence), F.lit(1)).alias("language"), F.regexp_extract_all("content", F.lit(fence), F.lit(2)).alias("code"))
    rows = pages.select(*keys, F.posexplode(both).alias("block_pos", "b"))
    return rows.select(*keys, "block_pos", F.col("b.language").alias("language"), (F.col("b.language") == "mermaid").alias("is_mermaid"), F.col("b.code").alias("code"))
