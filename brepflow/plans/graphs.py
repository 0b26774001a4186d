"""Queries over entity graphs (G) and structure statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from brepflow.functions import text as T
from brepflow.functions import linear, semantic
from brepflow.operators import graph as G
from brepflow.plans.registry import Catalog, quoted
from brepflow.plans.texts import train, trimmed
from brepflow.session import spread

C = Catalog()
_LITERAL = r"""'[^']*(?:''[^']*)*'"""


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {quoted(T.TOKEN)})"


def outside(x: str, inner: str) -> str:
    return f"array_to_string(list_transform({tokens(x)}, lambda t: if(t[1] = '''' and length(t) > 1, t, {inner})), '')"


MASKED = "array_to_string(list_transform({}, lambda t: if(t[1] = '''' and length(t) > 1, repeat('_', length(t)), t)), '')".format(tokens("args"))
ENTITY = rf"""with plain as (
  select row_id, regexp_replace(step, {quoted("(" + _LITERAL + ")")} || '|/\*[\s\S]*?\*/', '\1', 'g') as s from train_with_rag where step is not null
), part as (
  select row_id, list_filter(list_transform(string_split({outside("s", "replace(t, ';', ';' || chr(1))")}, chr(1)), lambda x: {trimmed("x")}),
    lambda x: regexp_matches(x, '(?i)^(?:#|DATA\s*;$|ENDSEC\s*;$)') and ends_with(x, ';')) as s from plain
), tail as (
  select row_id, list_position(list_transform(s, lambda x: regexp_matches(x, '(?i)^DATA\s*;$')), true) as first, s from part
), rest as (select row_id, s[first + 1:] as s from tail where first > 0
), stopped as (
  select row_id, list_position(list_transform(s, lambda x: regexp_matches(x, '(?i)^ENDSEC\s*;$')), true) as stop, s from rest
), stmt as (
  select row_id, unnest(generate_series(0, len(b) - 1)) as pos, unnest(b) as x from (select row_id, if(stop > 0, s[1:stop - 1], s) as b from stopped)
), bare as (
  select row_id, pos, regexp_extract(x, '^#\s*(\d+)', 1)::bigint as eid, regexp_extract(x, '(?s)^#\s*\d+\s*=\s*(\w*)\s*\(.*\)\s*;$', 1) as etype,
    regexp_matches(x, '(?s)^#\s*\d+\s*=\s*\(.*\)\s*;$') as is_complex, regexp_matches(x, '(?s)^#\s*\d+\s*=\s*\w*\s*\(.*\)\s*;$') as parsed,
    regexp_extract(x, '(?s)^#\s*\d+\s*=\s*\w*\s*\((.*)\)\s*;$', 1) as args from stmt
), entity as (select *, regexp_extract_all({MASKED}, '#(\d+)', 1)::bigint[] as refs from bare
), edge as (select row_id, eid as src, unnest(generate_series(0, len(refs) - 1)) as ord, unnest(refs) as dst from entity)
"""
_BODY = r"regexp_extract(j, '(?s)(?:^|\n)DATA;\n(.*?)(?:\n(?:ENDSEC;|END-ISO-10303-21;)(?:\n|$)|$)', 1) || chr(10)"


def _joined(keep: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split(step, chr(10)), lambda x: {trimmed('x')}), lambda x: {keep}), chr(10))"


def texts(spark, folder):
    """Texts spread over the cores: cutting statements takes longer than moving them."""
    return spread(train(spark, folder).select("row_id", "step"), "row_id")


@C.add(
    f"""with j as (select row_id, {_joined("x <> ''")} as j from train_with_rag), b as (select row_id, {_BODY} as b from j),
    s as (select row_id, list_filter(list_transform(string_split({outside("b", "replace(t, ';' || chr(10), ';' || chr(1))")}, chr(1)),
      lambda x: replace(x, chr(10), ' ')), lambda x: ends_with(x, ';')) as s from b)
    select row_id, len(s) as n_statements, md5(array_to_string(s, chr(10))) as statements from s"""
)
def g01_statements(spark, folder):
    cut = train(spark, folder).select("row_id", G.glued_statements(F.col("step")).alias("s"))
    return cut.select("row_id", F.when(F.col("s").isNotNull(), F.size("s")).alias("n_statements"), F.md5(F.array_join("s", "\n")).alias("statements"))


@C.add(
    ENTITY + """select row_id, count_if(parsed and not is_complex) as n_simple, count_if(is_complex) as n_complex, count_if(not parsed) as n_bad,
    bool_or(not parsed) as rejected from entity group by row_id"""
)
def g02_parse(spark, folder):
    found = G.summaries(texts(spark, folder)).filter("n_statements > 0")
    return found.select("row_id", "n_simple", "n_complex", "n_bad", (F.col("n_bad") > 0).alias("rejected"))


@C.add(
    ENTITY + """select row_id, count_if(regexp_matches(etype, '^[A-Z_][A-Z0-9_]*$')) as n_kept, count_if(not is_complex and not regexp_matches(etype, '^[A-Z_][A-Z0-9_]*$')) as n_dropped,
    count_if(is_complex) as n_complex from entity group by row_id"""
)
def g03_strict_parse(spark, folder):
    found = G.summaries(texts(spark, folder)).filter("n_statements > 0")
    return found.select("row_id", F.col("n_strict").alias("n_kept"), F.col("n_not_strict").alias("n_dropped"), "n_complex")


@C.add(ENTITY + "select row_id, eid, pos::int as pos, refs from entity where len(refs) > 0")
def g04_references(spark, folder):
    return G.entities(texts(spark, folder)).filter(F.size("refs") > 0).select("row_id", "eid", "pos", "refs")


_FILTERED = """, kept as (select e.row_id, e.eid as src, d as dst from (select row_id, eid, unnest(if(is_complex, list_distinct(refs), refs)) as d from entity) e
  where eid <> d and exists (select 1 from entity k where k.row_id = e.row_id and k.eid = d))"""


@C.add(ENTITY + _FILTERED + " select row_id, src, dst, count(*) as n from kept group by all")
def g05_filtered_references(spark, folder):
    return G.edges(texts(spark, folder)).filter("n_filtered > 0").select("row_id", "src", "dst", F.col("n_filtered").alias("n"))


@C.add(ENTITY + "select distinct row_id, eid, etype from entity e where not exists (select 1 from edge d where d.row_id = e.row_id and d.dst = e.eid)")
def g06_roots(spark, folder):
    return G.entities(texts(spark, folder)).filter("fresh and not referenced").select("row_id", "eid", "etype")


_EXPECTED = ", ".join(map(quoted, G.ROOT_TYPES))


@C.add(
    ENTITY + _FILTERED + f""" select etype, count(*) as n_roots, etype in ({_EXPECTED}) as expected from
    (select distinct row_id, eid, etype from entity e where not exists (select 1 from kept d where d.row_id = e.row_id and d.dst = e.eid)) group by etype"""
)
def g07_root_types(spark, folder):
    found = G.entities(texts(spark, folder)).filter("fresh and not referenced_by_others")
    return found.groupBy("etype").agg(F.count("*").alias("n_roots")).withColumn("expected", F.col("etype").isin(*G.ROOT_TYPES))


@C.add(ENTITY + "select row_id, eid, row_number() over (partition by row_id order by min(pos))::int as new_id from entity group by row_id, eid")
def g10_renumber(spark, folder):
    return G.entities(texts(spark, folder)).filter("new_id is not null").select("row_id", "eid", "new_id")


@C.add(
    ENTITY + """select row_id, count(*) as n_edges, count(k.eid) as n_mapped, count(k.eid) <> count(*) as rejected from edge d
    left join (select distinct row_id as r, eid from entity) k on k.r = row_id and k.eid = dst group by row_id"""
)
def g11_rewrite_guard(spark, folder):
    found = G.summaries(texts(spark, folder)).filter("n_edges > 0")
    return found.select("row_id", "n_edges", (F.col("n_edges") - F.col("n_dangling")).alias("n_mapped"), (F.col("n_dangling") > 0).alias("rejected"))


@C.add(ENTITY + "select row_id, src, dst, min(ord) as first_ord from edge group by all")
def g21_first_occurrence(spark, folder):
    return G.edges(texts(spark, folder)).select("row_id", "src", "dst", "first_ord")


@C.add(
    ENTITY + """, kind as (select row_id, eid, arg_max(if(is_complex, 'COMPLEX_ENTITY', etype), pos) as etype, arg_max(len(refs), pos) as n_refs from entity group by row_id, eid)
    select row_id, src, k.etype, count(*) as n, count(*) >= 3 as several, max(n_refs) = 0 as leaves from edge join kind k using (row_id) where k.eid = dst group by row_id, src, k.etype"""
)
def g22_child_types(spark, folder):
    return G.children(texts(spark, folder))


@C.add(
    ENTITY + r""", n as (select row_id, count(distinct eid) as n_parsed from entity group by all)
    select t.row_id, coalesce(n_parsed, 0) as n_parsed, len(regexp_extract_all(step, '(?m)^#\d+\s*=')) as n_counted, coalesce(n_parsed, 0) = len(regexp_extract_all(step, '(?m)^#\d+\s*=')) as kept
    from train_with_rag t left join n using (row_id)"""
)
def g24_lossy_guard(spark, folder):
    counted = spread(train(spark, folder).select("row_id", "step"), "row_id").withColumn("n_counted", T.entity_count(F.col("step")))
    found = G.summaries(counted, carry=("n_counted",))
    return found.select("row_id", F.col("n_ids").alias("n_parsed"), "n_counted", (F.col("n_ids") == F.col("n_counted")).alias("kept"))


@C.add()
def g08_depth_first(spark, folder):
    return linear.trees(texts(spark, folder))


@C.add()
def g09_root_stats(spark, folder):
    return linear.root_stats(texts(spark, folder))


@C.add()
def g12_reserialized(spark, folder):
    return linear.reserialized(texts(spark, folder))


@C.add()
def g25_restructured(spark, folder):
    """The semantic style."""
    return semantic.restructured(texts(spark, folder))


@C.add()
def g17_sections(spark, folder):
    """Notes by kind, over the texts that can be restructured."""
    notes = semantic.restructured(texts(spark, folder)).select("row_id", F.explode_outer(F.regexp_extract_all("text", F.lit(r"/\* (?:BEGIN )?([A-Z_]+)"), F.lit(1))).alias("kind"))
    return notes.filter("kind is not null").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("n_rows"))


@C.add()
def g13_merged_levels(spark, folder):
    """The trees of all roots merged level by level, each entity once a level."""
    return semantic.merged(texts(spark, folder))


@C.add(ENTITY + "select row_id, count(*) as n_dangling, count(distinct dst) as n_ids from edge d where not exists (select 1 from entity e where e.row_id = d.row_id and e.eid = d.dst) group by all")
def j11_dangling(spark, folder):
    return G.summaries(texts(spark, folder)).filter("n_dangling > 0").select("row_id", "n_dangling", F.col("n_dangling_ids").alias("n_ids"))


@C.add(ENTITY + "select row_id, eid from entity except select row_id, dst from edge")
def o05_ids_without_references(spark, folder):
    return G.entities(texts(spark, folder)).filter("new_id is not null and not referenced").select("row_id", "eid")


_LOST = r"""with r as (select distinct row_id, unnest(regexp_extract_all(step, '#(\d+)', 1))::bigint as id from train_with_rag),
d as (select distinct row_id, unnest(regexp_extract_all(step, '(?m)^#(\d+)\s*=\s*\w+\s*\(', 1))::bigint as id from train_with_rag),
lost as (select row_id, list_sort(list(id)) as ids from (select * from r except select * from d) group by row_id), defined as (select row_id, count(*) as n from d group by row_id)
"""


@C.add(_LOST + "select t.row_id, if(step is null, null, coalesce(ids, [])) as ids from train_with_rag t left join lost using (row_id)")
def o06_references_without_ids(spark, folder):
    ints = lambda p: F.transform(F.regexp_extract_all(F.col("step"), F.lit(p), F.lit(1)), lambda x: x.cast("bigint"))
    return train(spark, folder).select("row_id", F.array_sort(F.array_except(ints(r"#(\d+)"), ints(r"(?dm)^#(\d+)\s*=\s*\w+\s*\("))).alias("ids"))


_STRUCTURE = rf"""with j as (select row_id, step, {_joined("x <> '' and not starts_with(x, '/*')")} as j from train_with_rag),
w as (select row_id, step, list_filter(list_transform(string_split(replace({_BODY}, ';' || chr(10), ';' || chr(1)), chr(1)), lambda x: replace(x, chr(10), ' ')), lambda x: ends_with(x, ';')) as w from j),
p as (select row_id, step, list_filter(w, lambda x: regexp_matches(x, '^#(\d+)\s*=\s*(\w+)\s*\((.+)\)\s*;$')) as simple, list_filter(w, lambda x: regexp_matches(x, '^#\d+\s*=\s*\(')) as complex from w),
d as (select row_id, step, complex, list_distinct(list_transform(list_concat(simple, complex), lambda x: regexp_extract(x, '^#(\d+)', 1)::bigint)) as defined,
  list_transform(simple, lambda x: regexp_extract(x, '^#\d+\s*=\s*(\w+)', 1)) as types,
  flatten(list_transform(simple, lambda x: regexp_extract_all(regexp_extract(x, '^#\d+\s*=\s*\w+\s*\((.+)\)\s*;$', 1), '#(\d+)', 1)::bigint[])) as refs from p),
stats as (select row_id, contains(step, 'END-ISO-10303-21;') as terminated, len(defined)::int as n_entities, len(list_filter(refs, lambda r: not list_contains(defined, r)))::int as n_dangling,
  len(complex)::int as n_complex, len(defined) = 0 as empty, types from d where step is not null)
"""


def _stats(spark, folder):
    return G.structure_stats(texts(spark, folder).filter("step is not null"))


@C.add(_STRUCTURE + "select row_id, terminated, n_entities, n_dangling, n_complex, empty from stats")
def a10_structure_stats(spark, folder):
    return _stats(spark, folder).drop("types")


@C.add(
    _STRUCTURE + """select count(*) as n, round(avg(terminated::int), 6) as terminated_rate, round(avg((n_dangling > 0)::int), 6) as dangling_rate, round(avg(empty::int), 6) as empty_rate,
    sum(n_dangling)::bigint as n_dangling, sum(n_complex)::bigint as n_complex, round(avg(n_entities), 6) as mean_entities from stats"""
)
def a11_structure_rollup(spark, folder):
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return _stats(spark, folder).agg(
        F.count("*").alias("n"), rate(F.col("terminated")).alias("terminated_rate"), rate(F.col("n_dangling") > 0).alias("dangling_rate"), rate(F.col("empty")).alias("empty_rate"),
        F.sum("n_dangling").alias("n_dangling"), F.sum("n_complex").alias("n_complex"), F.round(F.avg("n_entities"), 6).alias("mean_entities"),
    )


@C.add(_STRUCTURE + "select etype, count(*) as n from (select unnest(types) as etype from stats) group by 1 order by n desc, etype limit 10")
def a12_type_histogram(spark, folder):
    """The ten most frequent types (the limit is the feature)."""
    return _stats(spark, folder).select(F.explode_outer("types").alias("etype")).filter("etype is not null").groupBy("etype").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "etype").limit(10)


@C.add(
    _LOST + rf"""select t.row_id, coalesce(n, 0)::int as n_entities, coalesce(len(ids), 0)::int as n_dangling, len(regexp_extract_all(step, '(?m)^#\d+\s*=\s*\('))::int as n_complex,
    regexp_matches(step, '^\s*(?:ISO-10303-21;|DATA;)') as starts_correctly,
    coalesce(not ends_with(list_filter(list_transform(string_split(step, chr(10)), lambda x: {trimmed("x")}), lambda x: x <> '')[-1], ';'), false) as cut
    from train_with_rag t left join lost using (row_id) left join defined using (row_id) where step is not null"""
)
def a13_structure_stats_distinct(spark, folder):
    return G.structure_stats_distinct(train(spark, folder).filter("step is not null"))


def queries() -> dict:
    return C.queries


def oracle_sql() -> dict[str, str]:
    return C.sql
