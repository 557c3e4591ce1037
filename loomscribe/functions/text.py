"""Scalar functions over paths, titles, URLs and replies, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of documents rather than code.
DOC_SUFFIXES = (".md", ".txt", ".rst", ".adoc", ".pdf", ".docx")
#: First words of diagrams that can be drawn.
DIAGRAM_STARTS = ("graph ", "flowchart ", "sequencediagram", "classdiagram", "erdiagram", "statediagram", "pie", "gantt ")


def parse_repo_url(url: Column) -> Column:
    """``struct(owner, name, error)`` of a repository URL: the two segments after the host."""
    parts = F.split(F.regexp_replace(F.regexp_replace(F.trim(url), r"^https?://", ""), r"/+$", ""), "/")
    host = F.array_position(F.transform(parts, F.lower), "github.com")
    pick = lambda n: F.when(host > 0, F.try_element_at(parts, (host + n).cast("int")))
    owner, name = F.nullif(pick(1), F.lit("")), F.nullif(F.regexp_replace(pick(2), r"\.git$", ""), F.lit(""))
    valid = owner.isNotNull() & name.isNotNull()
    return F.struct(
        F.when(valid, owner).alias("owner"),
        F.when(valid, name).alias("name"),
        F.when(~valid, F.lit("not a repository URL")).alias("error"),
    )


def repo_hash(owner: Column, name: Column, platform: str = "github") -> Column:
    """The stable 16-digit key of a repository."""
    return F.substring(F.sha2(F.concat(F.lit(f"{platform}:"), owner, F.lit("/"), name), 256), 1, 16)


def path_suffix(path: Column) -> Column:
    """Lower-cased last extension; names that begin with their only dot have none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def path_stem(path: Column) -> Column:
    """The path without its last extension."""
    return F.regexp_replace(path, r"([^/])\.[^./]+$", "$1")


def is_code(path: Column) -> Column:
    return ~path_suffix(path).isin(*DOC_SUFFIXES)


def slugify_title(title: Column) -> Column:
    """Lower-cased, other runs than letters, digits and hyphens as one hyphen, ends stripped."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9-]+", "-"), "^-+|-+$", "")


def slugify_heading(text: Column) -> Column:
    """Anchor of a heading; ``section`` where nothing is left."""
    kept = F.trim(F.regexp_replace(F.lower(text), r"[^\w\s-]", ""))
    return F.coalesce(F.nullif(F.regexp_replace(kept, r"\s+", "-"), F.lit("")), F.lit("section"))


def strip_fence(reply: Column) -> Column:
    """A model reply without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(reply), r"\A```(?:json)?\s*\n?", ""), r"\n?```\s*\z", "")


def json_fence_parse(reply: Column, schema: str) -> Column:
    """The JSON inside a reply; null where it cannot be parsed."""
    return F.from_json(strip_fence(reply), schema)


def retrying(status: Column, description: Column) -> Column:
    """Does a running job say that it retries."""
    return F.coalesce((status == "running") & description.startswith("Retry "), F.lit(False))


def is_overview(slug: Column, title: Column) -> Column:
    """The page prompt's rule: the slug is it, or the title contains it."""
    return (slug == "overview") | F.contains(F.lower(title), F.lit("overview"))


def source_url(owner: Column, name: Column, branch: Column, path: Column, lines: Column) -> Column:
    """Link to lines of a file."""
    kept = F.regexp_replace(lines, "[^0-9-]", "")
    anchor = F.when(F.coalesce(kept, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("#L"), F.regexp_replace(kept, "-", "-L")))
    return F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name, F.lit("/blob/"), branch, F.lit("/"), path, anchor)


def is_file_path(path: Column) -> Column:
    """Has the last segment a dot that is not its first character."""
    return path.rlike(r"[^/]\.[^/]*$")


def valid_diagram(text: Column) -> Column:
    """Does a diagram begin with a known word."""
    first = F.lower(F.trim(F.element_at(F.split(F.trim(F.coalesce(text, F.lit(""))), "\n"), 1)))
    known = F.lit(False)
    for start in DIAGRAM_STARTS:
        known = known | first.startswith(start)
    return known


def replace_architecture(content: Column, diagram: Column) -> Column:
    """Content with its leading architecture block, if any, replaced by a new one."""
    rest = F.regexp_replace(content, r"(?s)\A## Architecture\s*\n+```mermaid\n.*?```\s*\n*", "")
    return F.concat(F.lit("## Architecture\n\n```mermaid\n"), diagram, F.lit("\n```\n\n"), rest)


def _quoted(inner: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(inner, F.lit('"'), F.lit("#quot;")), F.lit('"'))


def _edge_labels(line: Column) -> Column:
    """Labels between pairs of bars, quoted where they hold special characters and no quote leads."""

    def label(part: Column, i: Column) -> Column:
        inside = (i % 2 == 1) & (i < F.size(F.split(line, r"\|")) - 1)
        return F.when(inside & part.rlike(r"[(){}<>/]") & ~part.startswith('"'), _quoted(part)).otherwise(part)

    return F.array_join(F.transform(F.split(line, r"\|"), label), "|")


def _sanitize_line(line: Column) -> Column:
    special = r"[(){}|<>/]"
    line = _edge_labels(line)
    line = F.regexp_replace(line, r'(\w\(\()(?!")(?=(?:(?!\)\)).)*(?!\)\))' + special + r')((?:(?!\)\)(?!\))).)+\)?)(\)\))', '$1"$2"$3')
    line = F.regexp_replace(line, r'(\w\{\{)(?!")(?=(?:(?!\}\}).)*(?!\}\})' + special + r")((?:(?!\}\}).)+)(\}\})", '$1"$2"$3')
    line = F.regexp_replace(line, r'(\w\[[(\[/])(?!")(?=[^\]"]*' + special + r'[^\]"]*[)\]/]\])([^\]"]*?)([)\]/]\])', '$1"$2"$3')
    line = F.regexp_replace(line, r'(\w\[)(?!["(\[/])(?=[^\]"]*' + special + r')([^\]"]+)(\])', '$1"$2"$3')
    line = F.regexp_replace(line, r'(\w\([\[])(?!")(?=[^)\]"]*' + special + r')([^)\]"]+)([\]]\))', '$1"$2"$3')
    # a round label may hold pairs of brackets of its own, but does not reach into another node
    line = F.regexp_replace(line, r'(\w\()(?!["(\[])(?=[^)"]*[({}|<>/])((?:[^()"\n]|\([^()"\n]*\))+)(\)(?!\)))', '$1"$2"$3')
    return F.regexp_replace(line, r'(\w\{)(?!["{])(?=[^}"]*[(){|<>/])([^}"]+)(\}(?!\}))', '$1"$2"$3')


def sanitize_mermaid(text: Column) -> Column:
    """Diagram text with node and edge labels that hold special characters quoted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"\A```(?:mermaid)?\s*\n?", ""), r"\n?```\s*\z", "")
    clean = F.array_join(F.transform(F.split(bare, "\n"), _sanitize_line), "\n")
    return F.when(text == "", text).otherwise(clean)


def sanitize_blocks(markdown: Column) -> Column:
    """Markdown with only its mermaid fences sanitised."""
    parts = F.split(markdown, "(?=```mermaid\n)|(?<=\n```)(?=\n|$)")
    fixed = F.transform(
        parts,
        lambda p: F.when(
            p.startswith("```mermaid\n") & p.endswith("\n```"),
            F.concat(F.lit("```mermaid\n"), sanitize_mermaid(F.regexp_replace(p, r"\A```mermaid\n|\n```\z", "")), F.lit("\n```")),
        ).otherwise(p),
    )
    return F.array_join(fixed, "")
