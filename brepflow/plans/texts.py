"""Queries over the text operators (T)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brepflow.functions import floats
from brepflow.functions import text as T
from brepflow.plans.registry import Catalog, quoted
from brepflow.session import spread, table

C = Catalog()
TOKENS = f"regexp_extract_all(step, {quoted(T.TOKEN)})"


def outside(inner: str, literal: str = "t") -> str:
    """DuckDB: the step's text with literals and the rest rewritten."""
    return f"array_to_string(list_transform({TOKENS}, lambda t: if(t[1] = '''' and length(t) > 1, {literal}, {inner})), '')"


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def train(spark, folder) -> DataFrame:
    return table(spark, folder, "train_with_rag")


def _per_row(query: str, sql: str | None, columns, slow: bool = False) -> None:
    """A query of row_id and the columns that ``columns`` makes of the step, over all texts; ``slow`` ones are spread over the cores first."""

    def run(spark, folder):
        texts = train(spark, folder)
        texts = spread(texts.select("row_id", "step"), "row_id") if slow else texts
        return texts.select("row_id", *(c.alias(k) for k, c in columns(F.col("step")).items()))

    C.add(sql and f"select row_id, {sql} from train_with_rag", query)(run)


_per_row("t01_mask_literals", f"""md5({outside("t", "repeat('_', length(t))")}) as masked""", lambda s: {"masked": F.md5(T.mask_literals(s))})
_per_row("t02_mask_keep_quotes", f"""md5({outside("t", "'''' || repeat('_', length(t) - 2) || ''''")}) as masked""", lambda s: {"masked": F.md5(T.mask_keep_quotes(s))})
_per_row(
    "t03_rewrite_outside_literals", f"""md5({outside(r"regexp_replace(t, '#(\d+)', '@\1', 'g')")}) as rewritten""",
    lambda s: {"rewritten": F.md5(T.outside_literals(s, lambda t: F.regexp_replace(t, r"#(\d+)", "@$1")))},
)
_per_row("t04_entity_count", r"len(regexp_extract_all(step, '(?m)^#\d+\s*=')) as n_entities", lambda s: {"n_entities": T.entity_count(s)})
_per_row("t05_entity_count_loose", r"len(regexp_extract_all(step, '(?m)^\s*#\d+\s*=')) as n_entities", lambda s: {"n_entities": T.entity_count_loose(s)})
_per_row("t06_terminator", "contains(step, 'END-ISO-10303-21;') as terminated", lambda s: {"terminated": T.has_terminator(s)})
_STRIPPED = r"regexp_replace(step, '/\*[\s\S]*?\*/', '', 'g')"
_per_row("t07_strip_comments", f"md5({_STRIPPED}) as plain", lambda s: {"plain": F.md5(T.strip_comments(s))})
_LINES = "string_split(step, chr(10))"
_FIRST = f"list_position(list_transform({_LINES}, lambda x: contains(x, 'DATA;')), true)"
_per_row(
    "t08_data_section",
    f"md5(if({_FIRST} > 0, array_to_string(list_transform({_LINES}[{_FIRST}:], lambda x: {trimmed('x')}), chr(10)), if(step is null, null, ''))) as section",
    lambda s: {"section": F.md5(T.data_section(s))},
)
_per_row(
    "t09_slices", r"""md5(regexp_extract(step, '(?s)(ISO-10303-21;.*?DATA;)', 1)) as header, md5(regexp_extract(step, '(?s)DATA;(.*?)ENDSEC;', 1)) as body""",
    lambda s: {"header": F.md5(T.header_slice(s)), "body": F.md5(T.data_slice(s))},
)
_per_row(
    "t10_extract_step", """md5(coalesce(nullif(regexp_extract(step, '(?s)(DATA;.*?END-ISO-10303-21;)', 1), ''),
    nullif(regexp_extract(step, '(?s)(ISO-10303-21;.*?END-ISO-10303-21;)', 1), ''), step)) as extracted""",
    lambda s: {"extracted": F.md5(T.extract_step(s))},
)
_per_row(
    "t11_data_prefix", r"""md5(case when regexp_matches(step, '^\s*(?:DATA;|ISO-10303-21;)') then step else 'DATA;' || chr(10) || step end) as prefixed""",
    lambda s: {"prefixed": F.md5(T.ensure_data_prefix(s))},
)
C.add(
    f"""with p as (select row_id, {_STRIPPED} as s from train_with_rag), q as (
      select row_id, s, ltrim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as l, instr(s, 'DATA;') as p0 from p
    ) select row_id, md5(case when starts_with(l, 'DATA;') then {quoted(T.MINIMAL_HEADER)} || l
      when not contains(if(p0 > 0, s[1:p0 - 1], s), 'ENDSEC;') then if(p0 > 0, s[1:p0 - 1] || 'ENDSEC;' || chr(10) || s[p0:], s) else s end) as repaired from q""",
    "t12_repair_header",
)(lambda spark, folder: train(spark, folder).select("row_id", F.md5(T.repair_header(F.col("step"))).alias("repaired")))
_REAL = r"-?(?:\d+\.\d*|\.\d+)(?:[Ee][+-]?\d+)?"


def rounded(guard: bool) -> str:
    """DuckDB: the step with each real outside literals at six decimals, its exponent kept."""
    tokens = r"(?s)'[^']*(?:''[^']*)*'|" + (f"#{_REAL}|" if guard else "") + _REAL + r"|[^'#\d.\-]+|."
    mantissa = "printf('%.6f', regexp_extract(t, '^[^Ee]*')::double) || if(regexp_matches(t, '[Ee]'), 'E' || regexp_extract(t, '[Ee](.*)$', 1), '')"
    return f"md5(array_to_string(list_transform(regexp_extract_all(step, {quoted(tokens)}), lambda t: if(regexp_full_match(t, {quoted(_REAL)}), {mantissa}, t)), ''))"


_per_row("t13_round_floats", rounded(True) + " as rounded", lambda s: {"rounded": F.md5(floats.round_floats(s))}, slow=True)
_per_row("t14_round_floats_unguarded", rounded(False) + " as rounded", lambda s: {"rounded": F.md5(floats.round_floats_unguarded(s))}, slow=True)
_per_row("t15_file_name", "replace(uid, '/', '_') || '.step' as name", lambda s: {"name": T.file_name(F.col("uid"))})
_per_row("t16_normal_uid", "replace(uid, '_', '/') as normal", lambda s: {"normal": T.normal_uid(F.col("uid"))})
_per_row(
    "t17_safe_name", "coalesce(nullif(regexp_replace(left(caption, 40), '[^A-Za-z0-9_-]', '_', 'g'), ''), 'output') as name",
    lambda s: {"name": T.safe_name(F.col("caption"))},
)
_per_row(
    "t18_caption_trim", f"{trimmed('caption')} as caption, coalesce({trimmed('caption')} = '', true) as blank",
    lambda s: {"caption": T.trim_space(F.col("caption")), "blank": T.is_blank(F.col("caption"))},
)
_CHAT = f"{quoted(T.SYSTEM + T.WITH_RETRIEVAL)} || chr(10) || chr(10) || '### caption:' || chr(10) || caption || chr(10) || chr(10) || '### retrieved relevant step file:' || chr(10) || retrieved_step"
_per_row("t19_chat_prompt", f"md5({_CHAT}) as prompt", lambda s: {"prompt": F.md5(T.chat_prompt(F.col("caption"), F.col("retrieved_step")))})
_per_row(
    "t20_completion_prompt",
    f"md5({quoted(T.SYSTEM + T.WITH_RETRIEVAL)} || repeat(chr(10), 3) || '### caption:' || chr(10) || caption || repeat(chr(10), 2) || '### retrieved relevant step file:' || chr(10) || retrieved_step || repeat(chr(10), 2) || '### output:' || chr(10)) as prompt",
    lambda s: {"prompt": F.md5(T.completion_prompt(F.col("caption"), F.col("retrieved_step")))},
)
_per_row(
    "t21_prompt",
    f"md5(case when coalesce(retrieved_step, '') = '' then {quoted(T.SYSTEM + T.WITHOUT_RETRIEVAL)} || repeat(chr(10), 2) || '### caption:' || chr(10) || caption else {_CHAT} end) as prompt",
    lambda s: {"prompt": F.md5(T.prompt(F.col("caption"), F.col("retrieved_step")))},
)
_LAST = f"list_filter(list_transform({_LINES}, lambda x: {trimmed('x')}), lambda x: x <> '')[-1]"
_per_row("t23_cut_mid_entity", f"coalesce(not ends_with({_LAST}, ';'), false) as cut", lambda s: {"cut": T.cut_mid_entity(s)})
_per_row(
    "t24_section_flags",
    r"""contains(step, 'ISO-10303-21;') as has_iso_token, regexp_matches(step, '(?:^|[^-])ISO-10303-21;') as has_iso_header, contains(step, 'HEADER;') as has_header,
    contains(step, 'DATA;') as has_data, len(regexp_extract_all(step, 'ENDSEC;')) as endsec_count, regexp_matches(step, '^\s*(?:ISO-10303-21;|DATA;)') as starts_correctly""",
    T.section_flags,
)
_TYPES = r"regexp_extract_all(step, '(?m)^#\d+\s*=\s*(\w+)\s*\(', 1)"
_HEADER_TYPES = ", ".join(map(quoted, T.HEADER_TYPES))
C.add(
    rf"""with t as (select row_id, step, {_TYPES} as types, regexp_extract_all(step, '/\*\s*\[BRANCH\]\s*depth=(\d+)\s*children=(\d+)', 1)::int[] as depth,
      regexp_extract_all(step, '/\*\s*\[BRANCH\]\s*depth=(\d+)\s*children=(\d+)', 2)::int[] as children from train_with_rag),
    g as (select *, list_filter(types, lambda x: x not in ({_HEADER_TYPES})) as geometry from t),
    u as (select *, if(len(geometry) > 0, geometry, types) as chosen from g),
    n as (select row_id, x, count(*) as n, row_number() over (partition by row_id order by count(*) desc, x) as r
      from (select row_id, unnest(chosen) as x from u) group by row_id, x),
    top as (select row_id, string_agg(x || ':' || n, ',' order by r) as top from n where r <= 8 group by row_id)
    select u.row_id, len(types) as total_entities, len(list_distinct(types)) as unique_types, if(types is null, null, coalesce(top, '')) as top_entities,
      len(regexp_extract_all(regexp_extract(step, 'CLOSED_SHELL\s*\('''',\s*\((#[\d,#\s]+)\)\s*\)', 1), '#')) as face_count,
      depth[list_position(children, list_max(children))] as branch_depth, list_max(children) as branch_children,
      coalesce(nullif(regexp_extract(step, 'FILE_SCHEMA\s*\(\s*\(''([^'']+)''\)', 1), ''), 'unknown') as schema
    from u left join top using (row_id)""",
    "t25_topology",
)(lambda spark, folder: T.topology(train(spark, folder)))
@C.add(f"select row_id, md5({quoted(f'<|system|>{chr(10)}{T.LEGACY_SYSTEM}{chr(10)}<|user|>{chr(10)}caption: ')} || caption || {quoted(chr(10) + 'retrieved step file:' + chr(10))} || retrieved_step || {quoted(chr(10) + '<|assistant|>' + chr(10))}) as prompt from train_with_rag")
def t22_legacy_prompt(spark, folder):
    return train(spark, folder).select("row_id", F.md5(T.legacy_prompt(T.LEGACY_SYSTEM, F.col("caption"), F.col("retrieved_step"))).alias("prompt"))


_per_row("t26_content_seed", "('0x' || substr(sha256(step), 1, 8))::bigint as seed", lambda s: {"seed": T.content_seed(s)})
_per_row(
    "t27_cache_key", "sha256(concat_ws('|', '2000', 'None', step)) as key",
    lambda s: {"key": T.cache_key(F.lit("2000"), F.lit("None"), s)},
)
_per_row(
    "t28_ordinal", """row_id || case when row_id % 100 between 10 and 20 then 'th' when row_id % 10 = 1 then 'st' when row_id % 10 = 2 then 'nd'
    when row_id % 10 = 3 then 'rd' else 'th' end as place""",
    lambda s: {"place": T.ordinal(F.col("row_id"))},
)
_per_row("t29_corrupt", f"md5(array_to_string({_LINES}[1:greatest(5, len({_LINES}) // 3)], chr(10))) as cut", lambda s: {"cut": F.md5(T.corrupt(s))})
_per_row("t30_words", r"len(list_filter(regexp_split_to_array(step, '\s+'), lambda x: x <> '')) as n_words", lambda s: {"n_words": F.when(s.isNotNull(), F.size(T.words(s)))})


def queries() -> dict:
    return C.queries


def oracle_sql() -> dict[str, str]:
    return C.sql
