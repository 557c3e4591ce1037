"""Synthetic corpora on plain relational tables, as SQL that Spark and DuckDB both run.

They give code files, imports, plans, snapshots, chats, job logs and markdown pages at any
scale, so that every operator has data that grows with its inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomscribe.sources.scratch import small_parts

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "conversations")

#: Imports between the parts on lines of an order that follow each other, and their text by part.
_LINES = """
imp as (
  select distinct a.l_partkey src, b.l_partkey dst
  from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1
  where a.l_partkey <> b.l_partkey),
il as (
  select src, string_agg(line, chr(10) order by line) txt from (
    select src, concat('import pkg', cast(dst % 10 as varchar(20)), '.m', cast(dst as varchar(20))) line from imp) x
  group by src)"""

#: The same for Spark: the lines of an order are shuffled and sorted once, not once for either side of a join, and
#: distinct imports meet by part at once.
_SPARK_LINES = """
next_lines as (
  select l_partkey src, collect_list(l_partkey) over (partition by l_orderkey order by l_linenumber range between 1 following and 1 following) next
  from lineitem where l_orderkey is not null and l_linenumber is not null),
imp as (select src, dst from next_lines lateral view explode(next) n as dst where src <> dst),
il as (
  select src, array_join(array_sort(transform(collect_set(dst), d -> concat('import pkg', cast(d % 10 as string), '.m', cast(d as string)))), chr(10)) txt
  from imp group by src)"""

_CODE = """{lines},
code_files as (
  select concat('r', cast({repo} as varchar(20))) repo_id,
    concat('pkg', cast(p_partkey % 10 as varchar(20)), '/m', cast(p_partkey as varchar(20)), '.py') rel_path,
    p_partkey,
    concat(coalesce(txt, '# no imports'), chr(10), chr(10), 'class C', cast(p_partkey as varchar(20)), ':', chr(10),
      '    \"\"\"', p_name, '\"\"\"', chr(10), '    def run(self, n):', chr(10), '        return n', chr(10), chr(10),
      'def f', cast(p_partkey as varchar(20)), '(x):', chr(10), '    return x', chr(10)) content
  from part left join il on p_partkey = src)"""

#: Repositories of ``code_files``: a thousand part keys give two.  ``whole_files`` has the same files in two repositories
#: at any scale, so that all imports between part keys of one parity are edges.
_REPO, _WHOLE_REPO = "p_partkey % 2 + 2 * cast(floor(p_partkey / 1000) as bigint)", "p_partkey % 2"
_WHOLE = """,
whole_files as (select * from code_files)"""

#: Six languages; a repository is 600 part keys.  A file imports others of its own repository and language by a
#: path from the root, by one with a prefix to strip, or by a name that leads nowhere; every fifth file is a package's.
_POLY = """
poly_base as (
  select p_partkey k, p_partkey % 6 lang, cast(floor(p_partkey / 600) as bigint) unit,
    case p_partkey % 6 when 0 then 'app/p' when 1 then 'web/t' when 2 then 'go/g' when 3 then 'src/J' when 4 then 'rs/s' else 'c/h' end stem,
    case p_partkey % 6 when 0 then '.py' when 1 then '.ts' when 2 then '.go' when 3 then '.java' when 4 then '.rs' else '.c' end suffix,
    case when p_partkey % 5 = 0 then case p_partkey % 6 when 0 then '/__init__' when 1 then '/index' when 4 then '/mod' else '' end else '' end package
  from part),
poly_pairs as (
  select distinct a.l_partkey src, cast(floor(a.l_partkey / 600) as bigint) * 600 + (b.l_partkey % 100) * 6 + a.l_partkey % 6 dst
  from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1),
poly_imports as (
  select src, dst, (src + dst) % 3 form, concat(stem, cast(dst as varchar(20))) there, concat('ext', cast(dst as varchar(20))) nowhere, lang
  from poly_pairs join poly_base on src = k),
poly_lines as (
  select src, case lang
    when 0 then case form when 0 then concat('from ', replace(there, '/', '.'), ' import x') when 1 then concat('  import top.', replace(there, '/', '.')) else concat('import os , ', nowhere) end
    when 1 then case form when 0 then concat('import {{ a }} from ', chr(39), there, chr(39), ';') when 1 then concat('const x = require("./', there, '");') else concat('import y from "', nowhere, '"') end
    when 2 then case form when 0 then concat('import "', there, '"') when 1 then concat(chr(9), '"mod/', there, '"') else concat('import "', nowhere, '"') end
    when 3 then case form when 0 then concat('import ', replace(there, '/', '.'), ';') when 1 then concat('import com.', replace(there, '/', '.'), ';') else concat('import java.', nowhere, ';') end
    when 4 then case form when 0 then concat('use ', replace(there, '/', '::'), ';') when 1 then concat('use crate::', replace(there, '/', '::'), ';') else concat('mod ', nowhere, ';') end
    else case form when 0 then concat('#include "', there, '"') when 1 then concat('#include "inc/', there, '"') else concat('#include "', nowhere, '.h"') end end line,
  case lang
    when 0 then case form when 0 then replace(there, '/', '.') when 1 then concat('top.', replace(there, '/', '.')) else concat('os,', nowhere) end
    when 1 then case form when 0 then there when 1 then concat('./', there) else nowhere end
    when 2 then case form when 0 then there when 1 then concat('mod/', there) else nowhere end
    when 3 then case form when 0 then replace(there, '/', '.') when 1 then concat('com.', replace(there, '/', '.')) else concat('java.', nowhere) end
    when 4 then case form when 0 then replace(there, '/', '::') when 1 then concat('crate::', replace(there, '/', '::')) else nowhere end
    else case form when 0 then there when 1 then concat('inc/', there) else concat(nowhere, '.h') end end names
  from poly_imports),
poly_files as (
  select concat('q', cast(unit as varchar(20))) repo_id, concat(stem, cast(k as varchar(20)), package, suffix) rel_path, suffix, k,
    concat(coalesce(txt, ''), chr(10), 'body of ', cast(k as varchar(20)), chr(10)) content
  from poly_base left join (select src, {joined} txt from poly_lines group by src) x on k = src)"""

_MIXED = """
mixed_files as (
  select source repo_id, doc_id,
    concat('d', cast(doc_id % 7 as varchar(20)), '/',
      case doc_id % 6 when 0 then 'src' when 1 then 'build' when 2 then 'node_modules' when 3 then 'lib' when 4 then 'test_x' else 'docs' end,
      '/f', cast(doc_id as varchar(20)),
      case doc_id % 8 when 0 then '.py' when 1 then '.PNG' when 2 then '.md' when 3 then '.ts' when 4 then '' when 5 then '.tar.gz' when 6 then '.go' else '.yml' end) rel_path,
    n_chars * (case when doc_id % 9 = 0 then 900 else 3 end) size,
    text content
  from documents)"""

_SNAPSHOTS = """
snap_old as (select repo_id, rel_path, p_partkey, {md5} content_hash from code_files where p_partkey % 59 <> 0),
snap_new as (select repo_id, rel_path, p_partkey,
  case when p_partkey % 47 = 0 then 'edited' else {md5} end content_hash from code_files where p_partkey % 53 <> 0)"""

_PLAN = """
plan_rows as (
  select repo_id, rel_path, concat('Page ', p_brand) title, p_type from code_files join part using (p_partkey)
  where p_partkey % 17 <> 0),
plan_pages as (
  select repo_id, title, concat('All about ', min(p_type)) purpose,
    case when count(*) % 3 = 0 then 'Overview' when count(*) % 3 = 1 then 'Missing' end parent,
    cast(row_number() over (partition by repo_id order by title) as int) page_pos
  from plan_rows group by repo_id, title
  union all select repo_id, 'Overview', 'Start here', null, 0 from (select distinct repo_id from code_files) r),
plan_files as (select repo_id, title, rel_path from plan_rows)"""

_CHAT = """
chat as (select conv_id session_id, turn seq, role, coalesce(text, '') content from conversations)"""

_JOBS = """
job_log as (
  select event_id, user_id job_id, cast(ts as timestamp) ts,
    case event_type when 'view' then 'running' when 'click' then 'queued' when 'purchase' then 'done' when 'signup' then 'failed' else 'running' end status,
    cast(floor(abs(value) % 100) as int) progress,
    case when event_id % 3 = 0 then concat('Retry ', cast(event_id % 4 as varchar(20))) else 'step' end status_description
  from events)"""

_PAGES = """
md_pages as (
  select doc_id, source repo_id, concat('page-', cast(doc_id % 97 as varchar(20))) slug,
    doc_id % 13 page_order,
    concat('## Topic ', cast(doc_id % 5 as varchar(20)), chr(10), 'Body ', cast(doc_id as varchar(20)), chr(10),
      '*Source: pkg/a', cast(doc_id % 11 as varchar(20)), '.py:1-10, 20-30, lib/b.go*', chr(10),
      '### Topic ', cast(doc_id % 5 as varchar(20)), '!', chr(10), '```mermaid', chr(10), 'graph TD', chr(10),
      'A[Call ', cast(doc_id as varchar(20)), ' (x)] --> B', chr(10), '```', chr(10),
      '## Topic ', cast(doc_id % 5 as varchar(20)), chr(10), '```python', chr(10), '## not a heading', chr(10), '```', chr(10)) content
  from documents)"""


def _text(dialect: str) -> dict[str, str]:
    spark = dialect == "spark"
    lines = _SPARK_LINES if spark else _LINES
    joined = "listagg(line, chr(10)) within group (order by line)" if spark else "string_agg(line, chr(10) order by line)"
    return {
        "code": _CODE.format(lines=lines, repo=_REPO),
        "whole": _CODE.format(lines=lines, repo=_WHOLE_REPO) + _WHOLE,
        "poly": _POLY.format(joined=joined),
        "mixed": _MIXED,
        "snapshots": _SNAPSHOTS.format(md5="md5(content)"),
        "plan": _PLAN,
        "chat": _CHAT,
        "jobs": _JOBS,
        "pages": _PAGES,
    }


_NEEDS = {"snapshots": ("code",), "plan": ("code",)}
_OF = {
    "code_files": "code",
    "whole_files": "whole",
    "poly_files": "poly",
    "mixed_files": "mixed",
    "snap_old": "snapshots",
    "snap_new": "snapshots",
    "plan_pages": "plan",
    "plan_files": "plan",
    "chat": "chat",
    "job_log": "jobs",
    "md_pages": "pages",
}


def ctes(*names: str, dialect: str = "duckdb") -> str:
    """The ``with`` list that defines the named carriers."""
    groups: list[str] = []
    for name in names:
        group = _OF[name]
        for g in (*_NEEDS.get(group, ()), group):
            if g not in groups:
                groups.append(g)
    text = _text(dialect)
    return ",".join(text[g] for g in groups)


def carrier(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One carrier as a DataFrame over the tables in ``sf_dir``."""
    small_parts(spark)
    text = ctes(name, dialect="spark")
    args = {}
    for table in TABLES:
        if table in text:
            args[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    for table, df in args.items():
        df.createOrReplaceTempView(table)
    return spark.sql(f"with {text} select * from {name}")
