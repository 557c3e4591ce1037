"""Corpus scans: files, text decoding, readmes, repository metadata and plan JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Readme names in order of priority.
README_NAMES = ("README.md", "README.rst", "README.txt", "README", "readme.md")


def decode_text(content: Column) -> Column:
    """UTF-8 text of bytes, broken sequences replaced."""
    return F.make_valid_utf8(content.cast("string"))


def scan_corpus(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """All regular files under ``root``: ``repo_id, rel_path, size, content``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit(re.sub(r"^file:/+", "/", root.rstrip("/") + "/"))
    path = F.regexp_replace("path", "^file:/+", "/")
    return files.select(
        F.lit(repo_id).alias("repo_id"),
        F.substring(path, F.length(base) + 1, F.length(path)).alias("rel_path"),
        F.col("length").alias("size"),
        decode_text(F.col("content")).alias("content"),
    )


def pick_readme(repos: DataFrame, files: DataFrame, max_chars: int = 3000) -> DataFrame:
    """``repo_id, readme``: the first of the known names at each root, cut; null if none."""
    names = F.array(*[F.lit(n) for n in README_NAMES])
    roots = files.filter(F.col("rel_path").isin(*README_NAMES))
    best = roots.groupBy("repo_id").agg(F.min_by("content", F.array_position(names, F.col("rel_path"))).alias("readme"))
    return repos.select("repo_id").join(best, "repo_id", "left").withColumn("readme", F.substring("readme", 1, max_chars))


def with_metadata(repos: DataFrame, metadata: DataFrame) -> DataFrame:
    """Repositories with description, stars, language and default branch, defaults filled in."""
    found = repos.join(metadata, "repo_id", "left")
    defaults = {"description": "", "stars": 0, "language": "", "default_branch": "main"}
    return found.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with the columns of ``schema``: missing ones null, present ones cast."""
    return df.select([(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


#: Defaults of catalog columns that older files lack or leave empty.
CATALOG_DEFAULTS = {"description": "", "stars": 0, "language": "", "default_branch": "main"}


def read_evolved(spark: SparkSession, paths: list[str], schema: StructType | str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Parquet files of several schema versions in one scan, by the newest schema.

    Columns are found by name: those that a file lacks are null, narrower numbers are widened, columns
    that the schema does not have are not read.  Nulls of columns with a default become it.
    """
    rows = spark.read.schema(schema).parquet(*paths)
    kinds = {f.name: f.dataType for f in rows.schema}
    values = {c: F.coalesce(c, F.lit(v).cast(kinds[c])) for c, v in (defaults or {}).items() if c in kinds}
    return rows.withColumns(values)


def scan_repositories(spark: SparkSession, root: str) -> DataFrame:
    """All regular files under the folders of ``root``, each folder a repository: ``repo_id, rel_path, size, content``."""
    files = scan_corpus(spark, root, "")
    parts = F.split("rel_path", "/", 2)
    return files.withColumns({"repo_id": F.element_at(parts, 1), "rel_path": F.try_element_at(parts, F.lit(2))}).filter("rel_path is not null")


def parse_plans(rows: DataFrame, schema: str, column: str = "plan_json") -> DataFrame:
    """Plan JSON as ``plan``, with ``corrupt`` where it does not parse; missing stays null."""
    plan = F.from_json(column, schema)
    return rows.withColumn("plan", plan).withColumn("corrupt", F.col(column).isNotNull() & F.try_parse_json(column).isNull())


def read_vectors(spark: SparkSession, chunks_path: str, vectors_path: str) -> DataFrame:
    """Chunks with their vectors; a missing table is an error."""
    return spark.read.parquet(chunks_path).join(spark.read.parquet(vectors_path), "chunk_id")
