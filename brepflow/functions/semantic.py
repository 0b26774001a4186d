"""Semantic restructuring of a STEP text: sections by kind of root, with notes.

Sections come in a fixed order: category relationships level by level, protocol definitions,
presentations with their styled items and complex entities in numbered blocks, and shape
definitions. Each entity is written once, where it is met first. Entities outside these
sections are left out (``n_dropped`` counts them); if one of them is referred to, the text is rejected.

Defined cases: as in ``linear``; a text without any such root gives a file without entities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from brepflow.functions import linear
from brepflow.functions.linear import Graph, _each, depth_first, parse, roots

CATEGORY, PROTOCOL, PRESENTATION, SHAPE = (
    "PRODUCT_CATEGORY_RELATIONSHIP", "APPLICATION_PROTOCOL_DEFINITION",
    "MECHANICAL_DESIGN_GEOMETRIC_PRESENTATION_REPRESENTATION", "SHAPE_DEFINITION_REPRESENTATION",
)
#: Types whose children are not written in a shape section; fixed values.
PRUNED = ("PRODUCT_DEFINITION_FORMATION_WITH_SPECIFIED_SOURCE", "PRODUCT_DEFINITION_CONTEXT")
_REF_OR_LITERAL = re.compile(r"('[^']*(?:''[^']*)*')|#(\d+)\b")


def moved(text: str, to: dict[int, int | str], strict: bool = False) -> str:
    """References outside literals replaced; others stay, or raise KeyError where ``strict``."""

    def one(m: re.Match) -> str:
        if m.group(1) is not None:
            return m.group(1)
        return f"#{to[int(m.group(2))]}" if strict else f"#{to.get(int(m.group(2)), m.group(2))}"

    return _REF_OR_LITERAL.sub(one, text)


@dataclass
class Writer:
    """The lines written so far: notes, and statements with the id they define."""

    g: Graph
    refs: dict[int, list[int]]
    lines: list[tuple[int | None, str]] = field(default_factory=list)
    written: set[int] = field(default_factory=set)

    def note(self, text: str) -> None:
        self.lines.append((None, f"/* {text} */"))

    def put(self, eid: int, content: str | None = None, again: bool = False) -> None:
        if again or eid not in self.written:
            self.written.add(eid)
            self.lines.append((eid, content or self.g.raw[eid]))

    def tree(self, eid: int) -> list[tuple[int, int, str]]:
        return depth_first(self.g, [eid], set(), self.refs)


def by_level(trees: list[list[tuple[int, int, str]]]) -> list[tuple[int, list[int]]]:
    """(depth, ids) level by level over all trees, once per level, in order of the trees."""
    at_depth: dict[int, dict[int, None]] = {}
    for tree in trees:
        for depth, eid, kind in tree:
            if kind == "NORMAL":
                at_depth.setdefault(depth, {})[eid] = None
    return [(depth, list(at_depth[depth])) for depth in sorted(at_depth)]


def levels(trees: list[list[tuple[int, int, str]]]) -> list[int]:
    """The ids of all levels, one level after the other."""
    return [eid for _, ids in by_level(trees) for eid in ids]


def _merged_rows(text: str | None) -> list[tuple]:
    if not text:
        return []
    g = parse(text)
    trees = [depth_first(g, [root], set()) for root in roots(g, self_edges=False)]
    return [(depth, pos, eid) for depth, ids in by_level(trees) for pos, eid in enumerate(ids)]


def merged(texts: DataFrame) -> DataFrame:
    """(row_id, depth, pos, eid): the levels of the trees of all roots of each text."""
    schema = pa.schema([("row_id", pa.int64()), ("depth", pa.int32()), ("pos", pa.int32()), ("eid", pa.int64())])
    return texts.select("row_id", "step").mapInArrow(_each(_merged_rows, schema), "row_id bigint, depth int, pos int, eid bigint")


def pruned(g: Graph, tree: list[tuple[int, int, str]]) -> list[int]:
    """The tree's ids without what lies below an entity of a pruned type."""
    out: list[int] = []
    below: int | None = None
    for depth, eid, kind in tree:
        if kind != "NORMAL":
            continue
        if below is not None and depth > below:
            continue
        below = depth if g.types[eid] in PRUNED else None
        out.append(eid)
    return out


def _category(w: Writer, roots: list[int]) -> None:
    """G14"""
    if roots:
        w.note(f"{CATEGORY} Section - {len(roots)} root entities")
        for eid in levels([w.tree(r) for r in roots]):
            w.put(eid)


def _protocol(w: Writer, roots: list[int]) -> None:
    """G15"""
    for root in roots:
        tree = w.tree(root)
        if max(depth for depth, _, _ in tree) != 1:
            w.note(f"{PROTOCOL} Section - Unusual depth")
        for _, eid, kind in tree:
            if kind == "NORMAL":
                w.put(eid)


def _presentation(w: Writer, roots: list[int]) -> list[list[int]]:
    """Returns the references of each root, for the placeholders."""
    plans = []
    for root in roots:
        styled = [r for r in w.refs[root] if w.g.types[r] == "STYLED_ITEM"]
        complex_ = [r for r in w.refs[root] if not w.g.types[r]]
        w.note(f"{PRESENTATION} Section - {len(styled)} STYLED_ITEM, {len(complex_)} COMPLEX_ENTITY")
        w.put(root)
        colours = [eid for _, eid, kind in w.tree(root) if kind == "NORMAL" and w.g.types[eid] == "COLOUR_RGB"]
        same = {c: colours[0] for c in colours[1:]}
        if colours:
            w.put(colours[0], f"#{colours[0]}=COLOUR_RGB( , 0.5, 0.5, 0.5 );", again=True)
        plans.append(w.refs[root])
        for i, item in enumerate(styled, 1):
            w.note(f"BEGIN STYLED_ITEM {i}")
            for _, eid, kind in w.tree(item):
                if kind == "NORMAL" and eid not in same:
                    w.put(eid, moved(w.g.raw[eid], same))
            w.note(f"END STYLED_ITEM {i}")
        for i, item in enumerate(complex_, 1):
            w.note(f"BEGIN COMPLEX_ENTITY {i}")
            for _, eid, kind in w.tree(item):
                if kind == "NORMAL":
                    w.put(eid)
            w.note(f"END COMPLEX_ENTITY {i}")
    return plans


def _shape(w: Writer, roots: list[int]) -> None:
    """G19"""
    if roots:
        w.note(f"{SHAPE} Section - {len(roots)} subtrees")
        for i, root in enumerate(roots, 1):
            w.note(f"BEGIN {SHAPE} {i}")
            for eid in pruned(w.g, w.tree(root)):
                w.put(eid)
            w.note(f"END {SHAPE} {i}")


def _placeholders(lines: list[str], types: list[str | None], plans: list[list[int]]) -> list[str]:
    """``#ID_k`` for the k-th reference of each presentation root, and a note of its id in each block."""
    waiting: list[tuple[str, int]] = []
    left = iter(plans)
    out: list[str] = []
    for line, kind in zip(lines, types):
        if kind == PRESENTATION:
            refs = next(left, [])
            waiting = [(f"ID_{k}", new) for k, new in enumerate(refs, 1)]
            line = moved(line, {new: key for key, new in waiting})
        out.append(line)
        if waiting and re.match(r"/\* BEGIN (?:STYLED_ITEM|COMPLEX_ENTITY) \d+ \*/\Z", line):
            key, new = waiting.pop(0)
            out.append(f"/* {key} = {new} */")
    return out


def restore(text: str) -> str:
    """The inverse of the placeholders, for texts whose notes name every key."""
    keys = dict(re.findall(r"/\* (ID_\d+) = (\d+) \*/", text))
    return re.sub(r"#(ID_\d+)\b", lambda m: f"#{keys.get(m.group(1), m.group(1))}", text)


def restructure(text: str) -> tuple[str | None, str | None, int]:
    """(text, error, entities left out)."""
    g = linear.parse(text)
    if g.error:
        return None, g.error, 0
    refs = {eid: [r for r in rs if r in g.types and r != eid] for eid, rs in g.refs.items()}
    refs |= {eid: sorted(set(refs[eid])) for eid, kind in g.types.items() if not kind}
    held = {r for rs in refs.values() for r in rs}
    roots = {kind: [e for e in sorted(g.types) if e not in held and g.types[e] == kind] for kind in (CATEGORY, PROTOCOL, PRESENTATION, SHAPE)}
    w = Writer(g, refs)
    _category(w, roots[CATEGORY])
    _protocol(w, roots[PROTOCOL])
    plans = _presentation(w, roots[PRESENTATION])
    _shape(w, roots[SHAPE])
    new_id: dict[int, int] = {}
    for eid, _ in w.lines:
        if eid is not None:
            new_id.setdefault(eid, len(new_id) + 1)
    try:
        lines = [line if eid is None else moved(line, new_id, strict=True) for eid, line in w.lines]
    except KeyError as e:
        return None, f"referred to, but not written: #{e.args[0]}", len(g.types) - len(w.written)
    kinds = [None if eid is None else g.types[eid] for eid, _ in w.lines]
    lines = _placeholders(lines, kinds, [[new_id[r] for r in plan if r in new_id] for plan in plans])
    head = [g.header, "DATA;"] if g.header else ["DATA;"]
    return "\n".join([*head, *lines, "ENDSEC;", "END-ISO-10303-21;"]) + "\n", None, len(g.types) - len(w.written)


def restructured(texts: DataFrame, style: str = "semantic") -> DataFrame:
    """(row_id, text, error, n_dropped) in the style ``semantic`` or ``paper``."""
    if style not in ("semantic", "paper"):
        raise ValueError(f"no such style: {style}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 128):
                part = batch.slice(first, 128)
                out = [(None, None, 0) if not t else restructure(t) if style == "semantic" else (*linear.reserialize(t), 0) for t in part.column("step").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_id"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int32())],
                    ["row_id", "text", "error", "n_dropped"],
                )

    return texts.select("row_id", "step").mapInArrow(run, "row_id bigint, text string, error string, n_dropped int")
