"""Scalar text operators as Column expressions that stay inside the JVM (T family).

Patterns use ``(?d)`` with ``(?m)`` so that only a line feed ends a line. Digits, word characters
and white space are the ASCII classes. Null texts give null unless a default is stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A literal with doubled quotes, a run outside literals, or a stray quote.
TOKEN = r"'[^']*(?:''[^']*)*'|[^']+|'"
TERMINATOR = "END-ISO-10303-21;"
#: Header put before a text that has a DATA section only; fixed value.
MINIMAL_HEADER = (
    "ISO-10303-21;\nHEADER;\nFILE_DESCRIPTION(('Open CASCADE Model'),'2;1');\nFILE_NAME('','',(''),(''),'','','');\n"
    "FILE_SCHEMA(('CONFIG_CONTROL_DESIGN'));\nENDSEC;\n"
)
#: Prompt texts; fixed values.
SYSTEM = "You are a CAD model generation assistant trained to produce STEP (.step) files based on textual descriptions. "
WITH_RETRIEVAL = "Given the following object description and relevant retrieved CAD data, generate a STEP file that accurately represents the described object."
WITHOUT_RETRIEVAL = "Given the following object description, generate a STEP file that accurately represents the described object."
LEGACY_SYSTEM = "Given the object description and relevant CAD data, generate the corresponding STEP file."
#: Entity types that a topology summary leaves out; fixed values.
HEADER_TYPES = (
    "APPLICATION_PROTOCOL_DEFINITION", "APPLICATION_CONTEXT", "SHAPE_DEFINITION_REPRESENTATION", "PRODUCT_DEFINITION_SHAPE",
    "PRODUCT_DEFINITION", "PRODUCT_DEFINITION_CONTEXT", "PRODUCT_DEFINITION_FORMATION", "PRODUCT_DEFINITION_FORMATION_WITH_SPECIFIED_SOURCE",
    "PRODUCT", "PRODUCT_RELATED_PRODUCT_CATEGORY", "SHAPE_REPRESENTATION_RELATIONSHIP", "MECHANICAL_DESIGN_GEOMETRIC_PRESENTATION_REPRESENTATION",
    "CARTESIAN_POINT", "DIRECTION", "VERTEX_POINT", "AXIS2_PLACEMENT_3D", "PLANE",
)


def tokens(text: Column) -> Column:
    """The text cut into literals and what lies between them."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def is_literal(token: Column) -> Column:
    return token.startswith("'") & (F.length(token) > 1)


def outside_literals(text: Column, rewrite) -> Column:
    """``rewrite`` applied to what lies outside literals."""
    return F.array_join(F.transform(tokens(text), lambda t: F.when(is_literal(t), t).otherwise(rewrite(t))), "")


def mask_literals(text: Column) -> Column:
    """Each literal as underscores of the same length."""
    return F.array_join(F.transform(tokens(text), lambda t: F.when(is_literal(t), F.repeat(F.lit("_"), F.length(t))).otherwise(t)), "")


def mask_keep_quotes(text: Column) -> Column:
    """As T01, the quotes kept."""
    inner = lambda t: F.concat(F.lit("'"), F.repeat(F.lit("_"), F.length(t) - 2), F.lit("'"))
    return F.array_join(F.transform(tokens(text), lambda t: F.when(is_literal(t), inner(t)).otherwise(t)), "")


def entity_count(text: Column) -> Column:
    """Statements that start at column 0."""
    return F.regexp_count(text, F.lit(r"(?dm)^#\d+\s*="))


def entity_count_loose(text: Column) -> Column:
    """As T04, with blanks before them."""
    return F.regexp_count(text, F.lit(r"(?dm)^\s*#\d+\s*="))


def has_terminator(text: Column) -> Column:
    """T06"""
    return F.contains(text, F.lit(TERMINATOR))


def strip_comments(text: Column) -> Column:
    """Without ``/* ... */``, wherever it stands."""
    return F.regexp_replace(text, r"(?s)/\*.*?\*/", "")


def trim_space(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def is_blank(text: Column) -> Column:
    """Null or nothing but white space."""
    return F.coalesce(trim_space(text) == "", F.lit(True))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def data_section(text: Column) -> Column:
    """From the first line that contains ``DATA;``, lines trimmed; empty if there is none."""
    first = F.array_position(F.transform(lines(text), lambda x: F.contains(x, F.lit("DATA;"))), True)
    kept = F.when(first > 0, F.slice(lines(text), first.cast("int"), F.size(lines(text)))).when(text.isNotNull(), F.array().cast("array<string>"))
    return F.array_join(F.transform(kept, trim_space), "\n")


def header_slice(text: Column) -> Column:
    """From the first ``ISO-10303-21;`` to ``DATA;``; empty if there is none."""
    return F.regexp_extract(text, r"(?s)(ISO-10303-21;.*?DATA;)", 1)


def data_slice(text: Column) -> Column:
    """Between ``DATA;`` and ``ENDSEC;``; empty if there is none."""
    return F.regexp_extract(text, r"(?s)DATA;(.*?)ENDSEC;", 1)


def extract_step(text: Column) -> Column:
    """The DATA form, else the full form, else the whole text."""
    found = [F.nullif(F.regexp_extract(text, rf"(?s)({start}.*?END-ISO-10303-21;)", 1), F.lit("")) for start in ("DATA;", "ISO-10303-21;")]
    return F.coalesce(*found, text)


def ensure_data_prefix(text: Column) -> Column:
    """``DATA;`` put before a text that starts with neither a DATA section nor a header."""
    left = F.regexp_replace(text, r"\A\s+", "")
    return F.when(left.startswith("DATA;") | left.startswith("ISO-10303-21;"), text).otherwise(F.concat(F.lit("DATA;\n"), text))


def repair_header(text: Column) -> Column:
    """Without comments; a minimal header before a bare DATA section; a missing ENDSEC before ``DATA;``."""
    plain = strip_comments(text)
    left = F.regexp_replace(plain, r"\A\s+", "")
    at = F.instr(plain, "DATA;")
    before = F.when(at > 0, F.substring(plain, F.lit(1), at - 1)).otherwise(plain)
    inserted = F.when(at > 0, F.concat(before, F.lit("ENDSEC;\n"), F.substring(plain, at, F.length(plain)))).otherwise(plain)
    return F.when(left.startswith("DATA;"), F.concat(F.lit(MINIMAL_HEADER), left)).when(~F.contains(before, F.lit("ENDSEC;")), inserted).otherwise(plain)


def file_name(uid: Column) -> Column:
    """T15"""
    return F.concat(F.replace(uid, F.lit("/"), F.lit("_")), F.lit(".step"))


def normal_uid(uid: Column) -> Column:
    """T16"""
    return F.replace(uid, F.lit("_"), F.lit("/"))


def safe_name(caption: Column) -> Column:
    """A name for downloads."""
    return F.coalesce(F.nullif(F.regexp_replace(F.left(caption, F.lit(40)), "[^A-Za-z0-9_-]", "_"), F.lit("")), F.lit("output"))


def chat_prompt(caption: Column, retrieved: Column) -> Column:
    """T19"""
    return F.concat(F.lit(SYSTEM + WITH_RETRIEVAL + "\n\n### caption:\n"), caption, F.lit("\n\n### retrieved relevant step file:\n"), retrieved)


def completion_prompt(caption: Column, retrieved: Column) -> Column:
    """T20"""
    return F.concat(F.lit(SYSTEM + WITH_RETRIEVAL + "\n\n\n### caption:\n"), caption, F.lit("\n\n### retrieved relevant step file:\n"), retrieved, F.lit("\n\n### output:\n"))


def prompt(caption: Column, retrieved: Column) -> Column:
    """With the retrieved text, or without where it is null or empty."""
    plain = F.concat(F.lit(SYSTEM + WITHOUT_RETRIEVAL + "\n\n### caption:\n"), caption)
    return F.when(F.coalesce(retrieved, F.lit("")) == "", plain).otherwise(chat_prompt(caption, retrieved))


def legacy_prompt(system: str, caption: Column, retrieved: Column) -> Column:
    """The prompt with role marks of the first format."""
    return F.concat(F.lit(f"<|system|>\n{system}\n<|user|>\ncaption: "), caption, F.lit("\nretrieved step file:\n"), retrieved, F.lit("\n<|assistant|>\n"))


def last_line(text: Column) -> Column:
    """The last line that is not blank, trimmed; null if there is none."""
    return F.try_element_at(F.filter(F.transform(lines(text), trim_space), lambda x: x != ""), F.lit(-1))


def cut_mid_entity(text: Column) -> Column:
    """The last line that is not blank does not end a statement."""
    return F.coalesce(~last_line(text).endswith(";"), F.lit(False))


def starts_correctly(text: Column) -> Column:
    """T24"""
    left = trim_space(text)
    return left.startswith("ISO-10303-21;") | left.startswith("DATA;")


def section_flags(text: Column) -> dict[str, Column]:
    """``has_iso_token`` also holds for the terminator; ``has_iso_header`` only for a header."""
    return {
        "has_iso_token": F.contains(text, F.lit("ISO-10303-21;")),
        "has_iso_header": F.regexp_like(text, F.lit(r"(?:\A|[^-])ISO-10303-21;")),
        "has_header": F.contains(text, F.lit("HEADER;")),
        "has_data": F.contains(text, F.lit("DATA;")),
        "endsec_count": F.regexp_count(text, F.lit("ENDSEC;")),
        "starts_correctly": starts_correctly(text),
    }


def entity_types(text: Column) -> Column:
    """The type of each simple entity at column 0, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?dm)^#\d+\s*=\s*(\w+)\s*\("), F.lit(1))


def type_counts(types: Column) -> Column:
    """[(n, type)] by falling count, ties by name. ``types`` should be a column: an expression would be computed again for each type."""
    counted = F.transform(F.array_distinct(types), lambda t: F.struct((F.size(F.array_remove(types, t)) - F.size(types)).alias("n"), t.alias("type")))
    return F.transform(F.array_sort(counted), lambda x: F.struct((-x["n"]).alias("n"), x["type"].alias("type")))


def topology(texts: DataFrame, column: str = "step") -> DataFrame:
    """(row_id, ...) counts by type, faces of the first shell, the widest branch, the schema."""
    text = F.col(column)
    pattern = r"/\*\s*\[BRANCH\]\s*depth=(\d+)\s*children=(\d+)"
    depth, children = (F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), lambda x: x.cast("int")) for g in (1, 2))
    found = texts.select(
        "row_id", entity_types(text).alias("types"), depth.alias("depth"), children.alias("children"),
        F.regexp_count(F.regexp_extract(text, r"CLOSED_SHELL\s*\('',\s*\((#[\d,#\s]+)\)\s*\)", 1), F.lit("#")).alias("face_count"),
        F.coalesce(F.nullif(F.regexp_extract(text, r"FILE_SCHEMA\s*\(\s*\('([^']+)'\)", 1), F.lit("")), F.lit("unknown")).alias("schema"),
    )
    geometry = F.filter("types", lambda t: ~t.isin(*HEADER_TYPES))
    chosen = found.select("*", F.when(F.size(geometry) > 0, geometry).otherwise(F.col("types")).alias("chosen"))
    most = F.array_max("children")
    return chosen.select(
        "row_id", F.when(F.col("types").isNotNull(), F.size("types")).alias("total_entities"), F.when(F.col("types").isNotNull(), F.size(F.array_distinct("types"))).alias("unique_types"),
        F.array_join(F.transform(F.slice(type_counts(F.col("chosen")), 1, 8), lambda x: F.concat_ws(":", x["type"], x["n"])), ",").alias("top_entities"), "face_count",
        F.try_element_at("depth", F.array_position("children", most).cast("int")).alias("branch_depth"), most.alias("branch_children"), "schema",
    )


def content_seed(text: Column) -> Column:
    """The first four bytes of SHA-256, big endian."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the joined parameters."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def ordinal(n: Column) -> Column:
    """T28"""
    last = F.pmod(n, F.lit(10))
    suffix = F.when(F.pmod(n, F.lit(100)).between(10, 20), "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def corrupt(text: Column) -> Column:
    """The first third of the lines, at least five."""
    return F.array_join(F.slice(lines(text), F.lit(1), F.greatest(F.lit(5), F.floor(F.size(lines(text)) / 3).cast("int"))), "\n")


def words(text: Column) -> Column:
    """Tokens by white space."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")
