"""Queries over the operators of this subpackage, with their SQL where DuckDB can run it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brepflow.llm import bpe, content, neardup, overlap, packing, splitting, truncation
from brepflow.session import scratch, spread, table
from brepflow.sources import files


#: Sources that p6 keeps in different containers: statements of STEP files and lines of logs, each long runs of machine-written lines.
APART = (("step_excerpts", "training_log"),)


def _train(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "train_with_rag").select("row_id", "uid", "source", "step", "caption"), "row_id")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rows with nearly the same step or caption."""
    return neardup.near_duplicate_pairs(content.contents(_train(spark, folder)))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each value's class, group and number of links."""
    return neardup.near_duplicate_groups(content.contents(_train(spark, folder)))


def _overlaps(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    train = _train(spark, folder)
    members = overlap.rows_in_splits(train, table(spark, folder, "split_manifest"))
    return overlap.cross_split_pairs(content.contents(train), members), members


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of an evaluation row and a training row that holds its content."""
    pairs, _ = _overlaps(spark, folder)
    return pairs.select("field", F.least("eval_row", "train_row").alias("row_id_a"), F.greatest("eval_row", "train_row").alias("row_id_b")).distinct()


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps per split and source."""
    return overlap.cross_split_counts(*_overlaps(spark, folder))


def _specs(spark: SparkSession, folder: str) -> dict[str, tuple[int, int]]:
    """(max_size, overlap) by target; the table of limits has a row per target and does not grow."""
    return {r["target"]: (r["max_size"], r["overlap"] or 0) for r in table(spark, folder, "size_specs").collect()}


def _oversized(spark: SparkSession, folder: str) -> DataFrame:
    specs = _specs(spark, folder)
    limits = {name: specs[f"train_with_rag.{name}"] for name in ("step", "retrieved_step")}
    return splitting.oversized(table(spark, folder, "train_with_rag"), limits)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The values that are split: those of more than one piece."""
    return splitting.cut_table(_oversized(spark, folder)).filter("piece_no = 1").select("row_id", "field").distinct()


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of the values above their limit."""
    return splitting.pieces(_oversized(spark, folder))


def p4_file_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of large STEP files, read in ranges of 32 KB: each file has a hundred consecutive texts of the table."""
    to = scratch(spark, "files")
    texts = table(spark, folder, "train_with_rag").select("row_id", "step").filter("step is not null")
    hundred = texts.groupBy(F.floor(F.col("row_id") / 100).alias("file")).agg(F.array_sort(F.collect_list(F.struct("row_id", "step"))).alias("r"))
    files.write_steps(hundred.select(F.concat("file", F.lit(".step")).alias("rel_path"), F.array_join(F.col("r.step"), "\n").alias("text")), to)
    spans = splitting.of_files(files.listed(spark, to, "*.step"), *_specs(spark, folder)["train_with_rag.step"])
    number = F.regexp_extract("field", r"(\d+)\.step$", 1).cast("bigint")
    return splitting.pieces(spans, 1 << 15).select(number.alias("file"), "piece_no", "n_pieces", "start", "n_chars", "n_repeated", "text")


def p5_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.token_ids(_documents(spark, folder))


def _packed(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    capacity, _ = _specs(spark, folder)["documents.text"]
    return packing.pack(packing.sized(_documents(spark, folder)), capacity, APART), capacity


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of each document, or of each of its parts above the capacity."""
    return _packed(spark, folder)[0]


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used and the share of them that is filled."""
    return packing.fill_report(*_packed(spark, folder))


def p6_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Documents placed, and how often a rule of packing is broken."""
    packed, capacity = _packed(spark, folder)
    return packing.rules_report(packed, table(spark, folder, "documents"), capacity, APART)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text was cut off."""
    return truncation.cut_off(_documents(spark, folder)).filter("cut").select("doc_id").distinct()


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of cut texts per source."""
    documents = _documents(spark, folder)
    return truncation.cut_shares(documents, truncation.cut_off(documents))


_CONTENT = r"""
with plain as (
  select row_id, regexp_replace(step, '(''[^'']*'')|/\*[\s\S]*?\*/', '\1', 'g') as code from train_with_rag where step <> ''
), body as (
  select row_id, regexp_extract(code, '(?i)(?:^|[\s;])DATA\s*;([\s\S]*?)(?:[\s;]ENDSEC\s*;|$)', 1) as code from plain
), cut as (
  select row_id, regexp_split_to_array(upper(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    code, '''[^'']*''', '''', 'g'), '''+', '''', 'g'), '\s', '', 'g'), '#\d+', '', 'g')), ';') as part from body
), statement as (
  select row_id, unnest(part[1:len(part) - 1]) as s from cut
), step_element as (
  select distinct row_id, regexp_replace(s, '[+-]?(?:\d+\.\d*|\.\d+)(?:E[+-]?\d+)?', '~', 'g') || list_transform(
    regexp_extract_all(s, '[+-]?(?:\d+\.\d*|\.\d+)(?:E[+-]?\d+)?'), lambda x: round_even(x::double * 1e6, 0)::hugeint)::varchar as e
  from statement where regexp_matches(s, '\d\.|\.\d')
), word as (
  select row_id, unnest(list_filter(list_transform(regexp_split_to_array(lower(caption), '\s+'),
    lambda w: trim(w, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~')), lambda w: w <> '')) as w from train_with_rag where caption <> ''
), caption_element as (
  select row_id, w || ' ' || row_number() over (partition by row_id, w) as e from word
  where row_id in (select row_id from word group by 1 having count(*) >= 8)
), element as (
  select 'step' as field, row_id, e from step_element union all select 'caption', row_id, e from caption_element
), size as (select field, row_id, count(*) as n from element group by all),
common as (
  select a.field, a.row_id as ra, b.row_id as rb, count(*) as c from element a
  join element b on a.field = b.field and a.e = b.e and a.row_id < b.row_id group by all
), measured as (
  select c.field, ra, rb, c, x.n as na, y.n as nb from common c
  join size x on x.field = c.field and x.row_id = ra join size y on y.field = c.field and y.row_id = rb
)
"""
_PIECES = r"""
with recursive value as (
  select row_id, field, if(field = 'step', step, retrieved_step) as v, max_size, coalesce(overlap, 0) as overlap
  from train_with_rag, (values ('step'), ('retrieved_step')) f(field) join size_specs on target = 'train_with_rag.' || field
), long as (
  select *, regexp_extract_all(v, '(?s);|''[^'']*''?|/\*.*?(?:\*/|$)|[^;''/]+|/') as token from value where length(v) > max_size
), placed as (
  select row_id, field, x, sum(length(x)) over (partition by row_id, field order by i) as upto
  from (select row_id, field, unnest(token) as x, generate_subscripts(token, 1) as i from long)
), known as (
  select l.* exclude (token), length(v) as n, coalesce(e.ends, []) as ends from long l
  left join (select row_id, field, list(upto::bigint order by upto) as ends from placed where x = ';' group by all) e on e.row_id = l.row_id and e.field = l.field
), piece(row_id, field, piece_no, start, stop, on_end) as (
  select row_id, field, 0, 0::bigint, 0::bigint, false from known
  union all
  select row_id, field, piece_no + 1, if(tight, stop, start), if(tight, least(stop + max_size, n), next), not tight and on_end from (
    select *, next <= stop as tight from (
      select * replace (not is_last and coalesce(fit > stop, false) as on_end), case when is_last then n when fit > stop then fit else start + max_size end as next from (
        select *, list_filter(ends, lambda e: e <= start + max_size)[-1] as fit, start + max_size >= n as is_last from (
          select * replace (case when not on_end or overlap = 0 then stop when low <= 0 and stop <= overlap then 0
            else coalesce(list_filter(ends, lambda e: e >= low and e < stop)[1], stop) end as start) from (
            select k.*, p.piece_no, p.start, p.stop, p.on_end, greatest(p.stop - overlap, coalesce(list_filter(k.ends, lambda e: e > p.stop)[1], n) - max_size) as low
            from piece p join known k on k.row_id = p.row_id and k.field = p.field where p.stop < k.n))))
  )
), laid as (
  select p.row_id, p.field, piece_no::bigint as piece_no, (max(piece_no) over (partition by p.row_id, p.field))::bigint as n_pieces, start, stop - start as n_chars,
    coalesce(lag(stop) over (partition by p.row_id, p.field order by piece_no), 0) - start as n_repeated, substring(v, start + 1, stop - start) as text
  from piece p join known k on k.row_id = p.row_id and k.field = p.field where piece_no > 0
)
"""
_SPLIT = r""", split as (
  select distinct replace(unnest(train), '_', '/') as uid, 'train' as split from split_manifest
  union select distinct replace(unnest(val), '_', '/'), 'val' from split_manifest
  union select distinct replace(unnest(test), '_', '/'), 'test' from split_manifest
), member as (
  select row_id, split, source from train_with_rag t join split s on s.uid = replace(t.uid, '_', '/')
), hit as (
  select distinct field, ra, rb, if(x.split = 'train', rb, ra) as eval_row, if(x.split = 'train', y.split, x.split) as split
  from measured join member x on x.row_id = ra join member y on y.row_id = rb
  where (x.split = 'train') <> (y.split = 'train') and c >= 0.8 * if(x.split = 'train', nb, na)
)
"""


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_groups, p3_found, p3_counts, p4_found, p4_pieces, p4_file_pieces, p5_ids, p6_containers, p6_fill, p6_rules, p7_found, p7_shares)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _CONTENT + "select field, ra as row_id_a, rb as row_id_b from measured where c >= 0.8 * greatest(na, nb)",
        "p2_groups": _CONTENT.replace("with plain", "with recursive plain", 1) + """, edge as (
          select field, ra as a, rb as b, c = na and na = nb as same from measured where c >= 0.8 * greatest(na, nb)
        ), both_ways as (select * from edge union all select field, b, a, same from edge
        ), reach as (
          select field, row_id as a, row_id as b from size union select r.field, r.a, e.b from reach r join both_ways e on e.field = r.field and e.a = r.b
        ), links as (select field, a, count(*) as n_links, min(if(same, b, a)) as least from both_ways group by all
        ), grouped as (select field, a, min(b) as group_id from reach group by all)
        select g.field, g.a as row_id, least(g.a, coalesce(l.least, g.a)) as class_id, group_id, coalesce(n_links, 0)::bigint as n_links
        from grouped g left join links l on l.field = g.field and l.a = g.a""",
        "p3_found": _CONTENT + _SPLIT + "select distinct field, ra as row_id_a, rb as row_id_b from hit",
        "p4_found": """select t.row_id, s.field from train_with_rag t, (values ('step'), ('retrieved_step')) s(field)
          join size_specs z on z.target = 'train_with_rag.' || s.field where length(if(s.field = 'step', step, retrieved_step)) > max_size""",
        "p4_pieces": _PIECES + "select * from laid",
        "p4_file_pieces": """with recursive value as (
          select row_id // 100 as row_id, 'file' as field, string_agg(step, chr(10) order by row_id) as v, max_size, coalesce(overlap, 0) as overlap
          from train_with_rag, size_specs where target = 'train_with_rag.step' and step is not null group by all
        ), """ + _PIECES[_PIECES.index("long as (") :] + "select * exclude (row_id, field), row_id as file from laid",
        "p6_rules": "select count(*) as n_documents, 0::bigint as n_split_needlessly, 0::bigint as n_above_capacity, 0::bigint as n_apart_together from documents where text <> ''",
        "p3_counts": _CONTENT + _SPLIT + """, held as (
          select field, split, source, count(distinct row_id) as n_rows from member, (values ('step'), ('caption')) f(field)
          where split <> 'train' group by all
        ), found as (
          select field, h.split, source, count(distinct eval_row) as n_found, count(*) as n_pairs
          from hit h join (select distinct row_id, source from member) m on m.row_id = eval_row group by all
        ) select h.*, coalesce(n_found, 0) as n_found, coalesce(n_pairs, 0)::bigint as n_pairs from held h
        left join found f on f.field = h.field and f.split = h.split and f.source is not distinct from h.source""",
    }
