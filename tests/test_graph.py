"""Relations of entity graphs: defined cases, and a brute force over random graphs."""

import random

from brepflow.functions import semantic
from brepflow.operators import graph as G


def data(*s: str) -> str:
    return "ISO-10303-21;\nDATA;\n" + "\n".join(s) + "\nENDSEC;\nEND-ISO-10303-21;"


def table(spark, *texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "row_id bigint, step string, eid string")


def test_odd_texts(spark):
    big = 10**25
    t = table(
        spark, None, "", "no data", data("#1=A('it''s; #9',#2);/* #7=Z(); */", "# 2 = b ( #1 , #1 ) ;", "#2=(X(#2) Y(#1,#1));", "#3 oops;", f"#{big}=C(#{big},#4);", "'stray;#5=D();"),
        "DATA;\n#1=A();\n", data("#1=A('x" + "y" * 300_000 + "',#1);"),
    )
    s = {r.row_id: r for r in G.summaries(t, carry=("eid",)).collect()}
    assert [s[i].n_statements for i in range(6)] == [0, 0, 0, 6, 1, 1] and s[0].eid == "clash"
    assert (s[3].n_simple, s[3].n_complex, s[3].n_bad, s[3].n_ids, s[3].n_edges, s[3].n_dangling, s[3].n_dangling_ids) == (4, 1, 1, 4, 8, 2, 1)
    e = {(r.pos, r.eid): r for r in G.entities(t).filter("row_id = 3").collect()}
    assert [k for k in sorted(e)][:2] == [(0, 1), (1, 2)] and e[(1, 2)].refs == [1, 1] and e[(2, 2)].new_id is None and e[(2, 2)].is_complex
    edges = {(r.src, r.dst): (r.first_ord, r.n, r.n_filtered, r.known) for r in G.edges(t).filter("row_id = 3").collect()}
    assert edges[(2, 1)] == (0, 4, 3, True) and edges[(2, 2)] == (0, 1, 0, True) and edges[(1, 2)] == (0, 1, 1, True)
    kinds = {(r.src, r.etype): (r.n, r.several, r.leaves) for r in G.children(t).filter("row_id = 3").collect()}
    assert kinds[(1, "COMPLEX_ENTITY")] == (1, False, False) and kinds[(2, "A")] == (4, True, False)


def test_empty_table(spark):
    t = table(spark).limit(0)
    assert [f(t).count() for f in (G.entities, G.edges, G.children, G.summaries)] == [0, 0, 0, 0]


def test_random_graphs_equal_brute_force(spark):
    rnd = random.Random(5)
    graphs = []
    for _ in range(40):
        ids = rnd.sample(range(1, 90), rnd.randrange(1, 30))
        graphs.append([(i, "T" + str(i % 4), [rnd.choice([*ids, 95, 96]) for _ in range(rnd.randrange(4))]) for i in ids])
    t = table(spark, *(data(*(f"#{i}={k}({','.join(f'#{r}' for r in refs)},1.5);" for i, k, refs in g)) for g in graphs))
    roots = {(r.row_id, r.eid) for r in G.entities(t).filter("fresh and not referenced").collect()}
    assert roots == {(n, i) for n, g in enumerate(graphs) for i, _, _ in g if not any(i in refs for _, _, refs in g)}
    lost = {r.row_id: r.n_dangling for r in G.summaries(t).collect()}
    assert lost == {n: sum(r not in {i for i, _, _ in g} for _, _, refs in g for r in refs) for n, g in enumerate(graphs)}
    a10 = {r.row_id: r.n_dangling for r in G.structure_stats(t).collect()}
    assert a10 == lost


def test_merged_levels(spark):
    t = table(spark, data("#1=A(#3);", "#2=B(#4,#3);", "#3=C(#4);", "#4=D();"), None)
    got = {(r.depth, r.pos, r.eid) for r in semantic.merged(t).collect()}
    assert got == {(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4), (2, 0, 4)}
