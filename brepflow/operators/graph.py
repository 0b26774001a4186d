"""STEP texts as relational entity graphs (G family, and the structure statistics A10 to A13).

All entities of a text are in its row, and so is whatever its references can name. So a worker parses
each text once and resolves references against the text's own ids by hashing; texts are independent, nothing is
shuffled, and no entity ever meets another by a join. Three relations and a summary come of it, each by
one scan: ``entities``, ``edges``, ``children`` and ``summaries``.

Defined cases: null and empty texts have no entities (``summaries`` has a row of zeros for them); of a
repeated id the last definition tells its type, the first one its place; ids that are no 64-bit numbers
are null, and nothing refers to them; rows that repeat are parsed each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brepflow.functions import text as T

MARK = "\x01"
COMPLEX = "COMPLEX_ENTITY"
#: Types that a root is expected to have; fixed values.
ROOT_TYPES = (
    "PRODUCT_CATEGORY_RELATIONSHIP", "APPLICATION_PROTOCOL_DEFINITION",
    "MECHANICAL_DESIGN_GEOMETRIC_PRESENTATION_REPRESENTATION", "SHAPE_DEFINITION_REPRESENTATION",
)



def glued_statements(text: Column) -> Column:
    """Lines of the DATA section, trimmed and joined by a blank until one ends in ``;`` outside literals.

    The section starts at a line ``DATA;`` and ends at a line ``ENDSEC;`` or the terminator. A last
    statement that does not end is left out.
    """
    joined = F.array_join(F.filter(F.transform(T.lines(text), T.trim_space), lambda x: x != ""), "\n")
    body = F.regexp_extract(joined, r"(?s)(?:\A|\n)DATA;\n(.*?)(?:\n(?:ENDSEC;|END-ISO-10303-21;)(?:\n|\z)|\z)", 1)
    marked = T.outside_literals(F.concat(body, F.lit("\n")), lambda t: F.replace(t, F.lit(";\n"), F.lit(";" + MARK)))
    parts = F.transform(F.split(marked, MARK), lambda x: F.replace(x, F.lit("\n"), F.lit(" ")))
    return F.filter(parts, lambda x: x.endswith(";"))


_COMMENT = re.compile(r"('[^']*(?:''[^']*)*')|/\*.*?\*/", re.S)
_LITERAL = re.compile(r"'[^']*(?:''[^']*)*'")
#: A statement up to its ``;``; a quote that opens no literal is a character like any other.
_STATEMENT = re.compile(r"((?>'[^']*(?:''[^']*)*'|[^';]+|')*+);")
_KEYWORD = re.compile(r"(DATA|ENDSEC)\s*\Z", re.I | re.A)
_ENTITY = re.compile(r"#\s*(\d+)\s*=\s*(\w*)\s*\((.*)\)\s*\Z", re.S | re.A)
_ID = re.compile(r"#\s*(\d+)", re.A)
_REF = re.compile(r"#(\d+)", re.A)
_STRICT = re.compile(r"[A-Z_][A-Z0-9_]*\Z")
_SPACE = " \t\n\x0b\f\r"


def _number(digits: str) -> int | None:
    return n if (n := int(digits)) < 1 << 63 else None


@dataclass(slots=True)
class Entity:
    """A statement of a DATA section; ``parsed`` tells whether it is an entity."""

    eid: int | None
    etype: str
    is_complex: bool
    parsed: bool
    refs: list[int | None]


def parsed(text: str | None) -> list[Entity]:
    """The ``#`` statements of a text's first DATA section, in order; the type of a complex entity is empty."""
    out: list[Entity] = []
    inside = False
    for part in _STATEMENT.findall(_COMMENT.sub(r"\1", text or "")):
        part = part.strip(_SPACE)
        if not part.startswith("#"):
            if word := _KEYWORD.match(part):
                if inside and word.group(1).upper() == "ENDSEC":
                    break
                inside = inside or word.group(1).upper() == "DATA"
            continue
        if not inside:
            continue
        if m := _ENTITY.match(part):
            eid, etype, args = m.groups()
            refs = [_number(x) for x in _REF.findall(_LITERAL.sub("_", args) if "'" in args else args)]
            out.append(Entity(_number(eid), etype, not etype, True, refs))
        else:
            m = _ID.match(part)
            out.append(Entity(_number(m.group(1)) if m else None, "", False, False, []))
    return out


def _entity_rows(es: list[Entity]) -> list[tuple]:
    named = {r for e in es for r in e.refs}
    known = {e.eid for e in es if e.eid is not None}
    by_others = {r for e in es for r in e.refs if r != e.eid}
    place: dict[int | None, int] = {}
    seen: set[tuple] = set()
    out = []
    for pos, e in enumerate(es):
        first = e.eid not in place
        new_id = place.setdefault(e.eid, len(place) + 1) if first else None
        fresh = (e.eid, e.etype) not in seen
        seen.add((e.eid, e.etype))
        out.append((pos, e.eid, e.etype, e.is_complex, e.parsed, e.refs, new_id, fresh, e.eid in known and e.eid in named, e.eid in known and e.eid in by_others))
    return out


def _edge_rows(es: list[Entity]) -> list[tuple]:
    known = {e.eid for e in es if e.eid is not None}
    found: dict[tuple, list[int]] = {}
    for e in es:
        here: set = set()
        for at, r in enumerate(e.refs):
            row = found.setdefault((e.eid, r), [at, 0, 0])
            row[0] = min(row[0], at)
            row[1] += 1
            if r in known and r != e.eid and not (e.is_complex and r in here):
                row[2] += 1
            here.add(r)
    return [(src, dst, first, n, kept, dst in known) for (src, dst), (first, n, kept) in found.items()]


def _child_rows(es: list[Entity]) -> list[tuple]:
    last = {e.eid: e for e in es if e.eid is not None}
    counts: Counter = Counter()
    inner: set[tuple] = set()
    for e in es:
        for r in e.refs:
            if (child := last.get(r)) is not None:
                key = (e.eid, COMPLEX if child.is_complex else child.etype)
                counts[key] += 1
                if child.refs:
                    inner.add(key)
    return [(src, etype, n, n >= 3, (src, etype) not in inner) for (src, etype), n in counts.items()]


def _summary_rows(es: list[Entity]) -> list[tuple]:
    ids = {e.eid for e in es}
    lost = [r for e in es for r in e.refs if r is None or r not in ids]
    n_complex, n_bad = sum(e.is_complex for e in es), sum(not e.parsed for e in es)
    n_strict = sum(_STRICT.match(e.etype) is not None for e in es)
    return [(len(es), len(ids - {None}), len(es) - n_complex - n_bad, n_complex, n_bad, n_strict, len(es) - n_complex - n_strict, sum(len(e.refs) for e in es), len(lost), len(set(lost) - {None}))]


_SCHEMAS = {
    _entity_rows: "pos int, eid bigint, etype string, is_complex boolean, parsed boolean, refs array<bigint>, new_id int, fresh boolean, referenced boolean, referenced_by_others boolean",
    _edge_rows: "src bigint, dst bigint, first_ord bigint, n bigint, n_filtered bigint, known boolean",
    _child_rows: "src bigint, etype string, n bigint, several boolean, leaves boolean",
    _summary_rows: "n_statements bigint, n_ids bigint, n_simple bigint, n_complex bigint, n_bad bigint, n_strict bigint, n_not_strict bigint, n_edges bigint, n_dangling bigint, n_dangling_ids bigint",
}
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}


def _relation(texts: DataFrame, column: str, rows_of: Callable[[list[Entity]], list[tuple]], carry: tuple[str, ...] = ()) -> DataFrame:
    """The rows of each text, with its row_id and the carried columns."""
    fields = [x.split(" ") for x in _SCHEMAS[rows_of].split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 128):
                part = batch.slice(first, 128)
                rows: list[tuple] = []
                at: list[int] = []
                for i, text in enumerate(part.column(column).to_pylist()):
                    found = rows_of(parsed(text))
                    rows += found
                    at += [i] * len(found)
                columns = list(zip(*rows)) or [()] * len(fields)
                kept = [part.column(c).take(pa.array(at, pa.int64())) for c in ("row_id", *carry)]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, _ARROW[k]) for c, (_, k) in zip(columns, fields))], ["row_id", *carry, *(n for n, _ in fields)])

    kinds = dict(texts.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in ("row_id", *carry)), _SCHEMAS[rows_of]])
    return texts.select("row_id", *carry, column).mapInArrow(run, schema)


def entities(texts: DataFrame, column: str = "step") -> DataFrame:
    """(row_id, pos, eid, etype, is_complex, parsed, refs, new_id, fresh, referenced, referenced_by_others).

    ``new_id`` numbers ids by first position and is null for repeated definitions; ``fresh`` marks the first of each
    (eid, etype). Roots (G06, O05) are the entities that are not referenced; under G05 an own reference does not count.
    """
    return _relation(texts, column, _entity_rows)


def edges(texts: DataFrame, column: str = "step") -> DataFrame:
    """(row_id, src, dst, first_ord, n, n_filtered, known), one row for each pair of a text.

    ``n`` counts occurrences; ``n_filtered`` those to known entities other than the own one, of complex entities one each.
    """
    return _relation(texts, column, _edge_rows)


def children(texts: DataFrame, column: str = "step") -> DataFrame:
    """(row_id, src, etype, n, several, leaves): children by type; ``several`` from three of one type; ``leaves``: none has children."""
    return _relation(texts, column, _child_rows)


def summaries(texts: DataFrame, column: str = "step", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each text: statements, distinct ids, kinds of statements, edges, dangling occurrences and ids."""
    return _relation(texts, column, _summary_rows, carry)


def structure(text: Column) -> dict[str, Column]:
    """A10: structure statistics, variant A: occurrences of dangling references of simple entities."""
    joined = F.array_join(F.filter(F.transform(T.lines(text), T.trim_space), lambda x: (x != "") & ~x.startswith("/*")), "\n")
    body = F.regexp_extract(joined, r"(?s)(?:\A|\n)DATA;\n(.*?)(?:\n(?:ENDSEC;|END-ISO-10303-21;)(?:\n|\z)|\z)", 1)
    parts = F.split(F.replace(F.concat(body, F.lit("\n")), F.lit(";\n"), F.lit(";" + MARK)), MARK)
    whole = F.filter(F.transform(parts, lambda x: F.replace(x, F.lit("\n"), F.lit(" "))), lambda x: x.endswith(";"))
    simple = r"\A#(\d+)\s*=\s*(\w+)\s*\((.+)\)\s*;\z"
    return {"statements": whole, "simple": F.filter(whole, lambda x: x.rlike(simple)), "complex": F.filter(whole, lambda x: x.rlike(r"\A#\d+\s*=\s*\("))}


def structure_stats(texts: DataFrame, column: str = "step") -> DataFrame:
    """A10: (row_id, terminated, n_entities, n_dangling, n_complex, empty, types)."""
    text = F.col(column)
    parts = structure(text)
    cut = texts.select("row_id", T.has_terminator(text).alias("terminated"), parts["simple"].alias("simple"), parts["complex"].alias("complex"))
    number = lambda x: F.regexp_extract(x, r"\A#(\d+)", 1).cast("bigint")
    args = lambda x: F.regexp_extract(x, r"\A#\d+\s*=\s*\w+\s*\((.+)\)\s*;\z", 1)
    wide = cut.select(
        "row_id", "terminated", F.size("complex").alias("n_complex"),
        F.array_distinct(F.concat(F.transform("simple", number), F.transform("complex", number))).alias("defined"),
        F.transform("simple", lambda x: F.regexp_extract(x, r"\A#\d+\s*=\s*(\w+)", 1)).alias("types"),
        F.flatten(F.transform("simple", lambda x: F.transform(F.regexp_extract_all(args(x), F.lit(r"#(\d+)"), F.lit(1)), lambda r: r.cast("bigint")))).alias("refs"),
    )
    # ids in order, each defined one before its references: a reference is lost unless its definition is the last one passed
    merged = F.sort_array(F.concat(F.transform("defined", lambda x: x * 2), F.transform("refs", lambda x: x * 2 + 1)))
    passed = lambda n, last: F.struct(n.alias("n"), last.alias("last"))
    step = lambda a, x: F.when(x % 2 == 0, passed(a["n"], x + 1)).otherwise(passed(a["n"] + (x != a["last"]).cast("int"), a["last"]))
    lost = F.aggregate(merged, passed(F.lit(0), F.lit(-1).cast("bigint")), step)["n"]
    return wide.select(
        "row_id", "terminated", F.size("defined").alias("n_entities"), F.when(F.size(F.array_except("refs", "defined")) > 0, lost).otherwise(0).alias("n_dangling"),
        "n_complex", (F.size("defined") == 0).alias("empty"), "types",
    )


def structure_stats_distinct(texts: DataFrame, column: str = "step") -> DataFrame:
    """Variant B: distinct dangling ids over the whole text; complex entities define nothing."""
    text = F.col(column)
    ints = lambda pattern: F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.cast("bigint")))
    return texts.select(
        "row_id", F.size(ints(r"(?dm)^#(\d+)\s*=\s*\w+\s*\(")).alias("n_entities"),
        F.size(F.array_except(ints(r"#(\d+)"), ints(r"(?dm)^#(\d+)\s*=\s*\w+\s*\("))).alias("n_dangling"),
        F.regexp_count(text, F.lit(r"(?dm)^#\d+\s*=\s*\(")).alias("n_complex"), T.starts_correctly(text).alias("starts_correctly"), T.cut_mid_entity(text).alias("cut"),
    )
