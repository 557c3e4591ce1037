"""Import resolution, dependency edges and summaries per repository and page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomscribe.functions.text import path_stem
from loomscribe.operators.components import connected_components
from loomscribe.operators.extract import extract_imports
from loomscribe.sources.scratch import Workspace

NO_EDGES = "(no internal dependencies detected)"
#: Names of the files that stand for their folder.
PACKAGE_FILE = r"^(__init__\.py|mod\.rs|index(\.[^./]*)?)$"


def file_index(files: DataFrame) -> DataFrame:
    """``repo_id, key, target``: files by path and by path without extension; the later file wins."""
    path = F.split("rel_path", "/")
    keys = files.select("repo_id", F.col("rel_path").alias("target"), path.alias("place"), F.inline(F.array(F.struct(F.col("rel_path").alias("key"), F.lit(0).alias("stem")), F.struct(path_stem(F.col("rel_path")).alias("key"), F.lit(1).alias("stem")))))
    return keys.groupBy("repo_id", "key").agg(F.max_by("target", F.struct("place", "stem")).alias("target"))


def resolve_imports(imports: DataFrame, index: DataFrame) -> DataFrame:
    """``repo_id, rel_path, import_pos, raw_import, target``; an unresolved target is null.

    Distinct (repository, import, suffix) rows are resolved once.  Their candidates fan out only where the repository has
    a file or package of the import's last name, or a package file at its root, which all imports reach; a package's
    file is no candidate in a repository that has no file of its name.  What is found has each import once and is hashed
    by its tasks' parts, so the many imports stream past it and are never sorted.
    """
    base = F.replace(F.replace("raw_import", F.lit("."), F.lit("/")), F.lit("::"), F.lit("/"))
    asked = imports.select("repo_id", "raw_import", "suffix").distinct().withColumn("name", F.element_at(F.split(base, "/"), -1))
    last, place = F.element_at(F.split("key", "/"), -1), F.split("key", "/")
    heads = index.filter(last.rlike(PACKAGE_FILE)).groupBy("repo_id").agg(F.collect_set(last).alias("heads"), F.bool_or(F.size(place) == 1).alias("at_root"))
    # names of imports have no dots, so a file is asked for by what stands before its first one
    names = F.array(F.substring_index(last, ".", 1), F.when(last.rlike(PACKAGE_FILE) & (F.size(place) > 1), F.get(place, F.size(place) - 2)))
    held = index.select("repo_id", F.explode(F.array_compact(names)).alias("name")).distinct().withColumn("held", F.lit(True))
    asked = asked.join(held, ["repo_id", "name"], "left").join(heads, "repo_id", "left")
    asked = asked.filter(F.col("held") | F.col("at_root") | ~F.col("suffix").rlike(r"^(\.|$)"))
    in_package = lambda name: F.when(F.array_contains("heads", name), F.concat(base, F.lit("/"), name))
    candidates = F.array(base, F.concat(base, "suffix"), in_package(F.concat(F.lit("index"), "suffix")), in_package(F.lit("__init__.py")), in_package(F.lit("mod.rs")))
    tried = asked.select("repo_id", "raw_import", "suffix", F.posexplode(candidates).alias("choice", "candidate")).filter("candidate is not null").withColumn("parts", F.split("candidate", "/"))
    tails = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "/"))
    tried = tried.select("repo_id", "raw_import", "suffix", "choice", F.posexplode(tails).alias("strip", "key"))
    hits = tried.join(index, ["repo_id", "key"]).groupBy("repo_id", "raw_import", "suffix").agg(F.min_by("target", F.struct("choice", "strip")).alias("target"))
    return imports.join(hits.hint("shuffle_hash"), ["repo_id", "raw_import", "suffix"], "left").select("repo_id", "rel_path", "import_pos", "raw_import", "target")


def resolved_imports(files: DataFrame) -> DataFrame:
    """``resolve_imports`` of a corpus; its imports are extracted once and kept."""
    imports = Workspace(files.sparkSession, "imports").save(extract_imports(files), "extracted")
    return resolve_imports(imports, file_index(files))


def inside(resolved: DataFrame) -> DataFrame:
    """``repo_id, src, dst`` of every import between different files."""
    found = resolved.filter(F.col("target").isNotNull() & (F.col("target") != F.col("rel_path")))
    return found.select("repo_id", F.col("rel_path").alias("src"), F.col("target").alias("dst"))


def outside(resolved: DataFrame) -> DataFrame:
    """``repo_id, rel_path, pkg`` of every import that resolves to nothing or to its own file."""
    found = resolved.filter(F.col("target").isNull() | (F.col("target") == F.col("rel_path")))
    return found.select("repo_id", "rel_path", F.col("raw_import").alias("pkg"))


def dep_edges(resolved: DataFrame) -> DataFrame:
    """Distinct ``repo_id, src, dst`` between different files."""
    return inside(resolved).distinct()


def external_deps(resolved: DataFrame) -> DataFrame:
    """Distinct ``repo_id, rel_path, pkg`` of imports that resolve to nothing or to their own file."""
    return outside(resolved).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("repo_id", "src").agg(F.array_sort(F.collect_set("dst")).alias("targets"))


def components(edges: DataFrame, files: DataFrame) -> DataFrame:
    """``repo_id, component, rel_path, size, cluster_pos``: clusters by size, then first member."""
    node = lambda path: F.concat("repo_id", F.lit("\n"), path)
    found = connected_components(edges.select(node("src").alias("src"), node("dst").alias("dst")))
    member = files.select("repo_id", "rel_path", node("rel_path").alias("node")).join(found, "node", "left")
    member = member.select("repo_id", "rel_path", F.coalesce(F.element_at(F.split("component", "\n"), 2), "rel_path").alias("component"))
    sizes = member.groupBy("repo_id", "component").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("cluster_pos", F.row_number().over(W.partitionBy("repo_id").orderBy(F.desc("size"), "component")))
    return member.join(sizes, ["repo_id", "component"])


def edge_counts(edges: DataFrame, files: DataFrame) -> DataFrame:
    """``repo_id, nodes, edges`` of every repository."""
    nodes = files.groupBy("repo_id").agg(F.count("*").alias("nodes"))
    return nodes.join(edges.groupBy("repo_id").agg(F.count("*").alias("edges")), "repo_id", "left").fillna(0, ["edges"])


def edge_budget(edges: DataFrame, max_edges: int = 150) -> DataFrame:
    """``repo_id, src, targets, deg, kept``: files by falling out-degree, kept until the budget overflows."""
    ordered = adjacency(edges).withColumn("deg", F.size("targets").cast("long"))
    running = F.sum("deg").over(W.partitionBy("repo_id").orderBy(F.desc("deg"), F.split("src", "/")).rowsBetween(W.unboundedPreceding, 0))
    return ordered.withColumn("running", running).withColumn("kept", F.col("running") <= max_edges)


def dependency_text(edges: DataFrame, repos: DataFrame, max_edges: int = 150) -> DataFrame:
    """``repo_id, text, kept_edges, remaining_edges``."""
    line = F.struct(F.col("running"), F.split("src", "/").alias("place"), F.concat("src", F.lit(" → "), F.array_join("targets", ", ")).alias("line"))
    summed = edge_budget(edges, max_edges).groupBy("repo_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kept"), line))), lambda x: x["line"]).alias("lines"),
        F.sum(F.when(F.col("kept"), F.col("deg")).otherwise(0)).alias("kept_edges"),
        F.sum(F.when(~F.col("kept"), F.col("deg")).otherwise(0)).alias("remaining_edges"),
    )
    rest = F.when(F.col("remaining_edges") > 0, F.array(F.format_string("... (%d more edges not shown)", "remaining_edges"))).otherwise(F.expr("cast(array() as array<string>)"))
    all_repos = repos.select("repo_id").distinct().join(summed, "repo_id", "left").fillna(0, ["kept_edges", "remaining_edges"])
    text = F.array_join(F.concat(F.coalesce("lines", F.expr("cast(array() as array<string>)")), rest), "\n")
    return all_repos.select("repo_id", F.coalesce(F.nullif(text, F.lit("")), F.lit(NO_EDGES)).alias("text"), "kept_edges", "remaining_edges")


def page_depends_on(page_files: DataFrame, edges: DataFrame) -> DataFrame:
    """``repo_id, title, other``: files outside a page that its files import."""
    met = page_files.join(edges, (page_files.repo_id == edges.repo_id) & (page_files.rel_path == edges.src)).select(page_files.repo_id, "title", F.col("dst").alias("other"))
    return met.distinct().join(page_files.withColumnRenamed("rel_path", "other"), ["repo_id", "title", "other"], "left_anti")


def page_depended_by(page_files: DataFrame, edges: DataFrame) -> DataFrame:
    """``repo_id, title, other``: files outside a page that import its files."""
    return page_depends_on(page_files, edges.select("repo_id", F.col("dst").alias("src"), F.col("src").alias("dst")))


def page_external(page_files: DataFrame, external: DataFrame) -> DataFrame:
    """``repo_id, title, pkg``: packages that a page's files use."""
    return page_files.join(external, ["repo_id", "rel_path"]).select("repo_id", "title", "pkg").distinct()


def page_deps(page_files: DataFrame, edges: DataFrame, external: DataFrame) -> DataFrame:
    """Per page the sorted ``depends_on``, ``depended_by`` and ``external_deps``."""
    kinds = (
        page_depends_on(page_files, edges).select("repo_id", "title", F.lit("a").alias("kind"), F.col("other").alias("name")),
        page_depended_by(page_files, edges).select("repo_id", "title", F.lit("b").alias("kind"), F.col("other").alias("name")),
        page_external(page_files, external).select("repo_id", "title", F.lit("c").alias("kind"), F.col("pkg").alias("name")),
        page_files.select("repo_id", "title", F.lit("").alias("kind"), F.lit("").alias("name")).distinct(),
    )
    rows = kinds[0].union(kinds[1]).union(kinds[2]).union(kinds[3])
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name"))))
    return rows.groupBy("repo_id", "title").agg(of("a").alias("depends_on"), of("b").alias("depended_by"), of("c").alias("external_deps"))


def kept_imports(files: DataFrame) -> DataFrame:
    """``resolved_imports`` written once."""
    return Workspace(files.sparkSession, "imports").save(resolved_imports(files), "resolved")


def dependency_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and external dependencies of a corpus; its imports are extracted and resolved once and kept for both."""
    resolved = kept_imports(files)
    return dep_edges(resolved), external_deps(resolved)
