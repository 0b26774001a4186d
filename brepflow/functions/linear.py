"""Depth-first linearisation of entity graphs, one text at a time in Arrow batches.

Visiting each entity once is state of the whole text, so it is done by a worker that holds that
text; texts are independent, nothing is shuffled. Traversals keep their own stack.

Defined cases: null and empty texts give no rows (``reserialized`` gives null); the last
definition of a repeated id wins; a statement that cannot be parsed, or a reference to an
entity that is not defined, rejects the text: ``text`` is null and ``error`` says why.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from brepflow.functions.floats import normalise

_COMMENT = re.compile(r"('[^']*(?:''[^']*)*')|/\*.*?\*/", re.S)
_PIECE = re.compile(r"((?:'[^']*(?:''[^']*)*'|[^';])*);")
_SIMPLE = re.compile(r"#\s*(\d+)\s*=\s*(\w*)\s*\((.*)\)\s*\Z", re.S)
_LITERAL = re.compile(r"'[^']*(?:''[^']*)*'")
_REF_OR_LITERAL = re.compile(r"('[^']*(?:''[^']*)*')|#(\d+)")


@dataclass
class Graph:
    """The entities of one text in order of definition: type, arguments and references by id."""

    header: str = ""
    types: dict[int, str] = field(default_factory=dict)
    args: dict[int, str] = field(default_factory=dict)
    refs: dict[int, list[int]] = field(default_factory=dict)
    raw: dict[int, str] = field(default_factory=dict)
    error: str | None = None


def parse(text: str) -> Graph:
    """The graph of a text's DATA section; comments are left out."""
    g = Graph()
    inside = False
    head: list[str] = []
    for m in _PIECE.finditer(_COMMENT.sub(lambda c: c.group(1) or "", text)):
        part = " ".join(x for x in (line.strip() for line in m.group(1).split("\n")) if x)
        word = part.upper()
        if not inside:
            if word == "DATA":
                inside = True
            else:
                head.append(part + ";")
        elif word in ("ENDSEC", "END-ISO-10303-21"):
            break
        elif found := _SIMPLE.match(part):
            eid = int(found.group(1))
            g.types[eid], g.args[eid], g.raw[eid] = found.group(2), found.group(3), part + ";"
            g.refs[eid] = [int(x) for x in re.findall(r"#(\d+)", _LITERAL.sub("", found.group(3)))]
        elif part.startswith("#"):
            g.error = g.error or f"not a statement: {part[:80]}"
    g.header = "\n".join(head)
    return g


def roots(g: Graph, self_edges: bool = True) -> list[int]:
    """Ids that no entity refers to, ascending; without ``self_edges`` an entity's own reference does not count."""
    held = {r for eid, refs in g.refs.items() for r in refs if self_edges or r != eid}
    return sorted(set(g.types) - held)


def depth_first(g: Graph, start: list[int], seen: set[int], refs: dict[int, list[int]] | None = None) -> list[tuple[int, int, str]]:
    """(depth, id, kind) in pre-order, children in order of reference.

    What was seen before is left out; an entity on the path from the root to here is marked circular.
    """
    refs = g.refs if refs is None else refs
    out: list[tuple[int, int, str]] = []
    path: set[int] = set()
    stack = [(eid, 0, False) for eid in reversed(start)]
    while stack:
        eid, depth, leaving = stack.pop()
        if leaving:
            path.discard(eid)
        elif eid in path:
            out.append((depth, eid, "CIRCULAR_REF"))
        elif eid not in seen:
            seen.add(eid)
            path.add(eid)
            out.append((depth, eid, "NORMAL"))
            stack.append((eid, depth, True))
            stack += [(r, depth + 1, False) for r in reversed(refs[eid]) if r in g.types]
    return out


def ordered(g: Graph) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """All ids in order of output, and (depth, entities) newly visited under each root.

    Roots come first; entities that no root reaches (cycles) follow, from the least id on.
    """
    seen: set[int] = set()
    order: list[int] = []
    stats: dict[int, tuple[int, int]] = {}
    for root in roots(g):
        new = [(d, eid) for d, eid, kind in depth_first(g, [root], seen) if kind == "NORMAL"]
        if new:
            stats[root] = (max(d for d, _ in new), len(new))
            order += [eid for _, eid in new]
    for eid in sorted(g.types):
        if eid not in seen:
            order += [e for _, e, kind in depth_first(g, [eid], seen) if kind == "NORMAL"]
    return order, stats


def rewritten(args: str, new_id: dict[int, int]) -> str:
    """References outside literals renumbered, reals normalised; KeyError for an unmapped one."""
    moved = _REF_OR_LITERAL.sub(lambda m: m.group(1) or f"#{new_id[int(m.group(2))]}", args)
    return normalise(moved, guard=False)


def reserialize(text: str) -> tuple[str | None, str | None]:
    """(text, error): the whole file in depth-first order, with a note before each root's branch."""
    g = parse(text)
    if g.error:
        return None, g.error
    order, stats = ordered(g)
    new_id = {eid: i for i, eid in enumerate(order, 1)}
    lines = [g.header, "DATA;"] if not g.header or "ENDSEC;" in g.header else [g.header, "ENDSEC;", "DATA;"]
    try:
        for eid in order:
            if eid in stats:
                lines.append("/* [BRANCH] depth={} children={} */".format(*stats[eid]))
            lines.append(f"#{new_id[eid]} = {g.types[eid]}({rewritten(g.args[eid], new_id)});")
    except KeyError as e:
        return None, f"not defined: #{e.args[0]}"
    return "\n".join([*lines, "ENDSEC;", "END-ISO-10303-21;"]), None


def _each(make, schema: pa.Schema):
    """A worker that makes rows from each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 128):
                part = batch.slice(first, 128).to_pylist()
                rows = [(r["row_id"], *x) for r in part for x in make(r["step"])]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def _tree_rows(text: str | None) -> list[tuple]:
    if not text:
        return []
    g = parse(text)
    return [(pos, depth, eid, kind) for pos, (depth, eid, kind) in enumerate(depth_first(g, roots(g, self_edges=False), set()))]


def trees(texts: DataFrame) -> DataFrame:
    """(row_id, pos, depth, eid, kind)."""
    schema = pa.schema([("row_id", pa.int64()), ("pos", pa.int32()), ("depth", pa.int32()), ("eid", pa.int64()), ("kind", pa.string())])
    return texts.select("row_id", "step").mapInArrow(_each(_tree_rows, schema), "row_id bigint, pos int, depth int, eid bigint, kind string")


def root_stats(texts: DataFrame) -> DataFrame:
    """(row_id, root, depth, n_entities)."""
    schema = pa.schema([("row_id", pa.int64()), ("root", pa.int64()), ("depth", pa.int32()), ("n_entities", pa.int32())])
    make = lambda text: [(root, *x) for root, x in ordered(parse(text))[1].items()] if text else []
    return texts.select("row_id", "step").mapInArrow(_each(make, schema), "row_id bigint, root bigint, depth int, n_entities int")


def reserialized(texts: DataFrame) -> DataFrame:
    """(row_id, text, error)."""
    schema = pa.schema([("row_id", pa.int64()), ("text", pa.string()), ("error", pa.string())])
    make = lambda text: [reserialize(text) if text else (None, None)]
    return texts.select("row_id", "step").mapInArrow(_each(make, schema), "row_id bigint, text string, error string")
