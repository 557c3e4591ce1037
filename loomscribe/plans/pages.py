"""Page plans: validation, fallback from clusters, serialised forms and context packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomscribe.functions.text import is_overview, slugify_title

PLAN_SCHEMA = "pages array<struct<title string, purpose string, parent string, files array<string>>>"


def ordered(values: Column, *order: Column | str) -> Column:
    """Values of a group as an array in the given order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, values.alias("_v")))), lambda x: x["_v"])


def read_plans(raw: DataFrame, column: str = "plan_json") -> DataFrame:
    """``repo_id, page_pos, title, purpose, parent, files`` of plan JSON per repository."""
    pages = F.from_json(column, PLAN_SCHEMA)["pages"]
    return raw.select("repo_id", F.posexplode_outer(pages).alias("page_pos", "p")).select("repo_id", "page_pos", "p.*")


def plan_errors(pages: DataFrame) -> DataFrame:
    """``repo_id, error`` for missing fields and slugs that occur twice."""
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.format_string(f"page %d: {c} missing", "page_pos")) for c in ("title", "purpose")]))
    fields = pages.select("repo_id", F.explode(missing).alias("error"))
    return fields.union(duplicate_slugs(pages).select("repo_id", F.concat(F.lit("slug twice: "), "slug")))


def duplicate_slugs(pages: DataFrame) -> DataFrame:
    named = pages.select("repo_id", slugify_title(F.col("title")).alias("slug"))
    return named.groupBy("repo_id", "slug").agg(F.count("*").alias("n")).filter("n > 1")


def valid_parents(pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Pages whose unknown parents are null; ``known`` adds titles (``repo_id, title``)."""
    titles = pages.select("repo_id", "title")
    titles = (titles if known is None else titles.union(known.select("repo_id", "title"))).distinct()
    found = titles.select("repo_id", F.col("title").alias("parent"), F.lit(True).alias("found"))
    joined = pages.join(found, ["repo_id", "parent"], "left")
    return joined.withColumn("parent", F.when(F.col("found"), F.col("parent"))).drop("found")


def assign_orphans(pages: DataFrame, page_files: DataFrame, files: DataFrame) -> DataFrame:
    """``repo_id, title, rel_path``: page files, and files of no page on the overview, else the first page."""
    lost = files.select("repo_id", "rel_path").join(page_files, ["repo_id", "rel_path"], "left_anti")
    target = pages.groupBy("repo_id").agg(F.min_by("title", F.struct(F.lower("title") != "overview", F.col("page_pos"))).alias("title"))
    return page_files.select("repo_id", "title", "rel_path").union(lost.join(target, "repo_id").select("repo_id", "title", "rel_path"))


def validate_plan(pages: DataFrame, page_files: DataFrame, files: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid pages with their files as an array, and the errors of the repositories that are left out."""
    errors = plan_errors(pages)
    good = valid_parents(pages, known).join(errors.select("repo_id").distinct(), "repo_id", "left_anti")
    held = assign_orphans(good, page_files, files).groupBy("repo_id", "title").agg(F.array_sort(F.collect_set("rel_path")).alias("files"))
    return good.join(held, ["repo_id", "title"], "left"), errors


def _cluster_parts(components: DataFrame, per_page: int) -> DataFrame:
    """``repo_id, title, rel_path, cluster_pos, part`` of clusters cut into pages of at most ``per_page`` files."""
    nth = F.row_number().over(W.partitionBy("repo_id", "component").orderBy("rel_path")) - 1
    part = F.floor(nth / per_page) + 1
    title = F.format_string("Component %d", "cluster_pos")
    title = F.when(F.col("size") > per_page, F.concat(title, F.format_string(" (part %d)", part))).otherwise(title)
    return components.select("repo_id", title.alias("title"), "rel_path", "cluster_pos", part.alias("part"))


def cluster_pages(components: DataFrame, per_page: int = 20) -> DataFrame:
    """``repo_id, title, rel_path``: clusters cut into pages of at most ``per_page`` files."""
    return _cluster_parts(components, per_page).select("repo_id", "title", "rel_path")


def fallback_plan(files: DataFrame, components: DataFrame, per_page: int = 20) -> DataFrame:
    """``repo_id, title, rel_path`` without a model: a page for every cluster, single files too; files of no cluster are on the overview."""
    rest = files.select("repo_id", "rel_path").join(components, ["repo_id", "rel_path"], "left_anti")
    return rest.select("repo_id", F.lit("Overview").alias("title"), "rel_path").union(cluster_pages(components, per_page))


#: Purposes of the pages of a plan without a model.
OVERVIEW_PURPOSE, COMPONENT_PURPOSE = "High-level overview of the %s project architecture and components.", "Documentation for component %d."


def fallback_pages(files: DataFrame, components: DataFrame, per_page: int = 20) -> DataFrame:
    """``repo_id, title, purpose, parent, page_pos`` of ``fallback_plan``: the overview, also without files, then the clusters in their order."""
    parts = _cluster_parts(components, per_page).select("repo_id", "title", F.format_string(COMPONENT_PURPOSE, "cluster_pos").alias("purpose"), "cluster_pos", "part").distinct()
    first = files.select("repo_id").distinct().select("repo_id", F.lit("Overview").alias("title"), F.format_string(OVERVIEW_PURPOSE, "repo_id").alias("purpose"), F.lit(0).alias("cluster_pos"), F.lit(0).cast("long").alias("part"))
    pos = F.row_number().over(W.partitionBy("repo_id").orderBy("cluster_pos", "part")) - 1
    return first.unionByName(parts).select("repo_id", "title", "purpose", F.lit(None).cast("string").alias("parent"), pos.alias("page_pos"))


def plan_json(pages: DataFrame, shape: str = "user") -> DataFrame:
    """``repo_id, json``: a plan in its user, internal or API form; only the API form keeps null parents."""
    page = {
        "user": ("title", "purpose", "parent"),
        "internal": ("title", "purpose", "parent", "files"),
        "api": ("slug", "title", "parent_slug", "purpose"),
    }[shape]
    named = pages.withColumn("slug", slugify_title(F.col("title"))).withColumn("parent_slug", slugify_title(F.col("parent")))
    keep = "false" if shape == "api" else "true"
    rows = named.groupBy("repo_id").agg(ordered(F.struct(*page), "page_pos").alias("pages"))
    return rows.select("repo_id", F.to_json(F.struct("pages"), {"ignoreNullFields": keep}).alias("json"))


def graph_view(pages: DataFrame, page_files: DataFrame) -> DataFrame:
    """``repo_id, id, label, file_count, source``: nodes with the parent their edge comes from."""
    n = page_files.groupBy("repo_id", "title").agg(F.count("*").alias("file_count"))
    nodes = pages.join(n, ["repo_id", "title"], "left")
    return nodes.select("repo_id", slugify_title(F.col("title")).alias("id"), F.col("title").alias("label"), F.coalesce("file_count", F.lit(0)).alias("file_count"), slugify_title(F.col("parent")).alias("source"))


def page_entities(page_files: DataFrame, entities: DataFrame) -> DataFrame:
    """``repo_id, title, entity_rank, rel_path, ...``: entities of a page's files in file order."""
    joined = page_files.join(entities, ["repo_id", "rel_path"])
    rank = F.row_number().over(W.partitionBy("repo_id", "title").orderBy("rel_path", "entity_pos"))
    return joined.withColumn("entity_rank", rank)


def page_queries(pages: DataFrame, page_files: DataFrame, entities: DataFrame) -> DataFrame:
    """``repo_id, title, query_pos, query``: at most three retrieval queries per page."""
    nth = F.row_number().over(W.partitionBy("repo_id", "title").orderBy("rel_path"))
    files = page_files.withColumn("nth", nth).filter("nth <= 5").groupBy("repo_id", "title").agg(F.array_join(ordered(F.col("rel_path"), "nth"), " ").alias("files"))
    names = page_entities(page_files, entities).filter("entity_rank <= 5").groupBy("repo_id", "title").agg(F.array_join(ordered(F.col("name"), "entity_rank"), " ").alias("names"))
    joined = pages.join(files, ["repo_id", "title"], "left").join(names, ["repo_id", "title"], "left")
    asked = F.array_compact(F.array(F.concat_ws(" ", "title", "files"), F.nullif("purpose", F.lit("")), F.nullif("names", F.lit(""))))
    return joined.select("repo_id", "title", F.posexplode(asked).alias("query_pos", "query"))


def entity_bullet() -> Column:
    """A page's bullet for one entity: kind, name, signature, start of its documentation, place."""
    return F.concat_ws(
        "\n",
        F.format_string("- **%s** `%s`", "type", "name"),
        F.when(F.coalesce("signature", F.lit("")) != "", F.format_string("  Signature: `%s`", "signature")),
        F.when(F.coalesce("docstring", F.lit("")) != "", F.concat(F.lit("  Doc: "), F.substring("docstring", 1, 150))),
        F.format_string("  Location: %s:%d-%d", "rel_path", "start_line", "end_line"),
    )


def page_context_pack(pages: DataFrame, page_files: DataFrame, entities: DataFrame, deps: DataFrame, context: DataFrame) -> DataFrame:
    """``repo_id, title, prompt``: everything a writer of the page needs, in sections.

    ``context``: ``repo_id, title, pos, file, text``.  Caps apply by rank before texts are joined.
    """
    key = ["repo_id", "title"]
    files = page_files.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("rel_path")), "\n- ").alias("files"))
    named = page_entities(page_files, entities).filter("entity_rank <= 25").groupBy(*key).agg(F.array_join(ordered(entity_bullet(), "entity_rank"), "\n").alias("entities"))
    blocks = context.groupBy(*key).agg(F.array_join(ordered(F.concat(F.lit("File: "), "file", F.lit("\n"), "text"), "pos"), "\n\n---\n\n").alias("blocks"))
    rows = pages
    for part in (files, named, deps, blocks):
        rows = rows.join(part, key, "left")
    dep = lambda label, column: F.when(F.size(column) > 0, F.concat(F.lit(f"- {label}: "), F.array_join(F.slice(column, 1, 10), ", ")))
    lines = F.nullif(F.concat_ws("\n", dep("uses", "depends_on"), dep("used by", "depended_by"), dep("packages", "external_deps")), F.lit(""))
    goal = F.when(is_overview(slugify_title(F.col("title")), F.col("title")), F.lit("Introduce the repository and how its parts fit together.")).otherwise(F.lit("Explain this component, its parts and its uses."))
    section = lambda name, body: F.when(body.isNotNull(), F.concat(F.lit(f"{name}:\n"), body))
    prompt = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Page: "), "title"),
        F.concat(F.lit("Purpose: "), "purpose"),
        F.when(F.col("files").isNotNull(), F.concat(F.lit("Files:\n- "), "files")),
        section("Dependencies", lines),
        section("Entities", F.coalesce("entities", F.lit("No entity details available."))),
        section("Source", F.col("blocks")),
        goal,
    )
    return rows.select("repo_id", "title", prompt.alias("prompt"))


def planner_context_pack(repos: DataFrame, readmes: DataFrame, summaries: DataFrame, dependencies: DataFrame, components: DataFrame, files: DataFrame) -> DataFrame:
    """``repo_id, prompt``: readme, file summaries, dependencies, clusters and the number of files."""
    nth = F.row_number().over(W.partitionBy("repo_id", "component").orderBy("rel_path"))
    top = components.filter("cluster_pos <= 8").withColumn("nth", nth).filter("nth <= 10")
    line = top.groupBy("repo_id", "cluster_pos").agg(F.array_join(ordered(F.col("rel_path"), "nth"), ", ").alias("names"))
    clusters = line.groupBy("repo_id").agg(F.array_join(ordered(F.format_string("  Cluster %d: %s", "cluster_pos", "names"), "cluster_pos"), "\n").alias("clusters"))
    count = files.groupBy("repo_id").agg(F.count("*").alias("n_files"))
    rows = repos.select("repo_id")
    for part in (readmes, summaries.withColumnRenamed("text", "summary"), dependencies.select("repo_id", F.col("text").alias("deps")), clusters, count):
        rows = rows.join(part, "repo_id", "left")
    prompt = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Repository: "), "repo_id"),
        F.concat(F.lit("Readme:\n"), F.substring("readme", 1, 2000)),
        F.concat(F.lit("Files:\n"), "summary"),
        F.concat(F.lit("Dependencies:\n"), "deps"),
        F.concat(F.lit("Clusters:\n"), "clusters"),
        F.format_string("Plan pages that cover all %d files.", "n_files"),
    )
    return rows.select("repo_id", prompt.alias("prompt"))


def diagram_context_pack(pages: DataFrame, page_files: DataFrame) -> DataFrame:
    """``repo_id, prompt``: the pages as a list with parents and file counts."""
    n = page_files.groupBy("repo_id", "title").agg(F.count("*").alias("n"))
    child = F.when(F.col("parent").isNotNull(), F.concat(F.lit(" [child of: "), "parent", F.lit("]"))).otherwise(F.lit(""))
    line = F.concat(F.lit("- "), "title", child, F.format_string(" (%d files)", F.coalesce("n", F.lit(0))))
    rows = pages.join(n, ["repo_id", "title"], "left").groupBy("repo_id").agg(F.array_join(ordered(line, "page_pos"), "\n").alias("prompt"))
    return rows


def history_window(messages: DataFrame, n: int, drop_last: bool = False) -> DataFrame:
    """``session_id, pos, role, content``: the last ``n`` messages, oldest first."""
    back = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("seq")))
    skip = 1 if drop_last else 0
    last = messages.withColumn("back", back).filter((F.col("back") > skip) & (F.col("back") <= n))
    return last.withColumn("pos", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("back"))) - 1).select("session_id", "pos", "role", "content")


def transcript(history: DataFrame) -> DataFrame:
    """``session_id, history``: one line per message."""
    return history.groupBy("session_id").agg(F.array_join(ordered(F.concat(F.upper("role"), F.lit(": "), "content"), "pos"), "\n").alias("history"))


def chat_context_pack(questions: DataFrame, history: DataFrame, hits: DataFrame) -> DataFrame:
    """``session_id, prompt``; ``questions``: ``session_id, question``; ``hits``: ``session_id, pos, file, text``."""
    blocks = hits.groupBy("session_id").agg(F.array_join(ordered(F.concat(F.lit("File: "), "file", F.lit("\n"), "text"), "pos"), "\n\n---\n\n").alias("blocks"))
    rows = questions.join(transcript(history), "session_id", "left").join(blocks, "session_id", "left")
    text = F.concat_ws("\n\n", F.concat(F.lit("Conversation history:\n"), F.coalesce("history", F.lit(""))), F.concat(F.lit("Relevant source code:\n"), F.coalesce("blocks", F.lit(""))), F.concat(F.lit("USER: "), "question"))
    return rows.select("session_id", text.alias("prompt"))
