"""Queries over the general training-data operators, with their SQL where DuckDB can run it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brepflow.operators import orphans
from brepflow.session import spread, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references: (row_id, src_eid, target)."""
    found = orphans.orphan_references(spread(table(spark, folder, "train_with_rag").select("row_id", "ingested_at", "step"), "row_id"), table(spark, folder, "file_validation"))
    return found.select("row_id", "src_eid", "target").distinct()


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per referred table and month."""
    found = orphans.orphan_references(spread(table(spark, folder, "train_with_rag").select("row_id", "ingested_at", "step"), "row_id"), table(spark, folder, "file_validation"))
    return orphans.orphan_counts(found)


_P1 = r"""
with plain as (
  select row_id, ingested_at, regexp_replace(step, '(''[^'']*'')|/\*[\s\S]*?\*/', '\1', 'g') as code
  from train_with_rag where step <> ''
), body as (
  select row_id, ingested_at, regexp_extract(code, '(?i)(?:^|[\s;])DATA\s*;([\s\S]*?)(?:[\s;]ENDSEC\s*;|$)', 1) as code from plain
), cut as (
  select row_id, ingested_at, regexp_split_to_array(
    regexp_replace(regexp_replace(code, '''[^'']*''', '''''', 'g'), '\s', '', 'g'), ';') as part from body
), statement as (
  select row_id, ingested_at, unnest(part[1:len(part) - 1]) as s from cut
), numbered as (
  select row_id, ingested_at, regexp_extract(s, '^#(\d+)=', 1)::bigint as eid, regexp_replace(s, '^#\d+=', '') as rest
  from statement where regexp_matches(s, '^#\d+=')
), edge as (
  select distinct row_id, ingested_at, eid, unnest(regexp_extract_all(rest, '#(\d+)', 1))::bigint as m from numbered
), inner_ref as (
  select row_id, ingested_at, 'train_with_rag.step' as referred_table, eid as src_eid, '#' || m as target
  from edge e where not exists (select 1 from numbered n where n.row_id = e.row_id and n.eid = e.m)
), raw as (
  select row_id, ingested_at, unnest(regexp_extract_all(regexp_replace(code, '\s', '', 'g'),
    '(?i)#\d+=DOCUMENT_FILE\(''[^'']*''')) as s from body
), outer_ref as (
  select distinct row_id, ingested_at, regexp_extract(s, '^#(\d+)', 1)::bigint as src_eid,
    replace(regexp_extract(s, '''([^'']*)''', 1), '_', '/') as target from raw
), lost as (
  select row_id, ingested_at, 'file_validation' as referred_table, src_eid, target from outer_ref o
  where regexp_matches(target, '^\w+/\w+$') and not exists (
    select 1 from file_validation v where replace(v.uid, '_', '/') = o.target and v.recorded_at <= o.ingested_at
      and (v.removed_at is null or o.ingested_at < v.removed_at))
), found as (select * from inner_ref union all select * from lost)
"""


def queries() -> dict:
    return {"p1_found": p1_found, "p1_counts": p1_counts}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + "select distinct row_id, src_eid, target from found",
        "p1_counts": _P1
        + """select referred_table, strftime(ingested_at, '%Y-%m') as month, count(*) as n_orphans, count(distinct row_id) as n_rows
        from found group by all""",
    }
