"""Hand-made cases of parsing, linearisation, number formats, rewards, streaks and sources."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brepflow.functions import linear as L
from brepflow.functions import semantic
from brepflow.functions import text as T
from brepflow.functions.floats import normalise
from brepflow.operators import corpus, geometry, metrics, retrieval, tokens, windows
from brepflow.sources import files


def data(*s: str) -> str:
    return "DATA;\n" + "\n".join(s) + "\nENDSEC;\nEND-ISO-10303-21;"


FLOATS = {
    "1.": "1.000000", "-.5": "-0.500000", "1.5E-3": "1.500000E-3", "9.9999999E+2": "10.000000E+2", "0.0000005": "0.000000", "-0.0000001": "-0.000000",
    "12345.6789012": "12345.678901", "1-2.5": "1-2.500000", "#12.5": "#12.5", "2e5": "2e5", "'v2.1234567'": "'v2.1234567'", "1.5e3": "1.500000E3",
}


@pytest.mark.parametrize("given, wanted", FLOATS.items())
def test_floats(given, wanted):
    assert normalise(given) == wanted


def lines(text: str) -> list[str]:
    out, error = L.reserialize(text)
    assert error is None
    return out.split("\n")[2:-2]


def test_reserialize_branch_and_floats():
    assert lines(data("#10=A(#20,#30); #20=B(#30); #30=C('x',1.5);")) == ["/* [BRANCH] depth=2 children=3 */", "#1 = A(#2,#3);", "#2 = B(#3);", "#3 = C('x',1.500000);"]


def test_two_roots_share_a_node():
    order, stats = L.ordered(L.parse(data("#1=A(#3); #2=B(#3); #3=C(1.);")))
    assert order == [1, 3, 2] and stats == {1: (1, 2), 2: (0, 1)}


def test_cycle_without_root_and_self_edge():
    g = L.parse(data("#5=A(#6); #6=B(#5);"))
    assert L.roots(g) == [] and L.ordered(g)[0] == [5, 6]
    g = L.parse(data("#1=A(#1);"))
    assert L.roots(g) == [] and L.roots(g, self_edges=False) == [1]


def test_rejected_texts():
    assert L.reserialize(data("#1=A(#9);")) == (None, "not defined: #9")
    assert L.reserialize(data("#1=(A(;"))[0] is None


def test_complex_literal_multiline_and_repeated_id():
    assert "#2 = (X(3) Y((#1)));" in L.reserialize(data("#1=A(#2); #2=(X(3) Y((#1)));"))[0]
    assert "'Part; v2 #42 2.1234567'" in L.reserialize(data("#1=A('Part; v2 #42 2.1234567');"))[0]
    assert L.parse(data("#1=A(1,\n 2,\n3);")).args == {1: "1, 2, 3"}
    assert L.parse(data("#1=A();", "#1=B();")).types == {1: "B"}


def test_linearised_ids_are_dense_and_nothing_dangles():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        ids = rng.permutation(200)[:n] + 1
        text = data(*(f"#{i}=T{i}({','.join('#' + str(r) for r in rng.choice(ids, rng.integers(0, 4)))},1.5);" for i in ids))
        g = L.parse(L.reserialize(text)[0])
        assert sorted(g.types) == list(range(1, n + 1)) and {r for x in g.refs.values() for r in x} <= set(g.types)


def test_deep_chain_needs_no_recursion():
    text = data(*(f"#{i}=A(#{i + 1});" for i in range(1, 5000)), "#5000=B();")
    assert L.ordered(L.parse(text))[1] == {1: (4999, 5000)}


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_rewards(spark):
    scd = lambda x: geometry.geometric_reward(F.lit(float(x)))
    r = one(spark, a=scd(0.01), b=scd(0.255), c=scd(0.5), d=scd(0), e=geometry.sane(F.lit(float("nan"))), f=geometry.format_reward(F.lit(True), F.lit(137)), g=geometry.format_reward(F.lit(True), F.lit(138)))
    assert tuple(r) == (1.0, pytest.approx(0.5), 0.0, 1.0, 0.0, 0.0, 0.2)


def test_cube_is_at_no_distance_from_itself_and_icp_undoes_a_motion(spark):
    rng = np.random.default_rng(1)
    a = rng.random((60, 3))
    assert geometry.blocked_mean(a, a) == 0
    turn = np.array([[math.cos(0.1), -math.sin(0.1), 0], [math.sin(0.1), math.cos(0.1), 0], [0, 0, 1]])
    moved = geometry.registered(a @ turn.T + 0.02, a, (1.0, 0.5, 0.25))
    assert geometry.blocked_mean(moved, a) < 1e-6


def test_sampling_is_seeded_and_inside():
    tri = np.array([[[0, 0, 0], [1, 0, 0], [0, 1, 0]]], float)
    p = geometry.sampled(tri, 100, 7)
    assert (p == geometry.sampled(tri, 100, 7)).all() and (p[:, :2].sum(1) <= 1 + 1e-12).all()


def test_meshes_come_once_per_text_and_failures_are_a_status(spark):
    tri = np.array([[[0, 0, 0], [1, 0, 0], [0, 1, 0]]], float)

    def backend(text):
        if text == "bad":
            raise RuntimeError("crash")
        return tri

    t = spark.createDataFrame([("x",), ("x",), ("bad",), (None,)], "text string")
    assert sorted(r.status for r in geometry.clouds(t, backend, 5).collect()) == ["ok", "pred_parse"]
    assert {r.status for r in geometry.clouds(t, None).collect()} == {"backend_missing"}


def test_streaks(spark):
    rows = [("r", i, *x) for i, x in enumerate([(0.0, 0.0)] * 4 + [(None, None), (0.0, None), (0.0, 0.0), (1.0, 0.0), (0.0, 0.0)])]
    log = spark.createDataFrame(rows, "run string, i int, p double, s double")
    some, fires = F.col("p").isNotNull() | F.col("s").isNotNull(), (F.coalesce("p", F.lit(0.0)) != 0) | (F.coalesce("s", F.lit(0.0)) != 0)
    out = windows.zero_streaks(log, "run", "i", windows.stretch(F.col("i"), 3), some & ~fires, fires, 5, 8).orderBy("i").collect()
    assert [r.streak for r in out] == [1, 2, 3, 4, 4, 5, 6, 0, 1]
    assert [r.alarm for r in out].count("warn") == 1 and out[5].alarm == "warn"


def test_running_medians(spark):
    rows = [("a", 0, None), ("a", 1, 3.0), ("a", 2, 1.0), ("a", 3, 2.0), ("b", 0, 5.0), (None, 0, 1.0)]
    got = {(r.run, r.idx): r.median for r in windows.running_medians(spark.createDataFrame(rows, "run string, i int, x double"), "run", "i", "x").collect()}
    assert got == {("a", 0): None, ("a", 1): 3.0, ("a", 2): 2.0, ("a", 3): 2.0, ("b", 0): 5.0, (None, 0): 1.0}


def test_quantile_conventions(spark):
    v = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "x int")
    assert tuple(v.select(metrics.percentile(F.col("x"), 0.25), metrics.percentile(F.col("x"), 0.5)).first()) == (1.75, 2.5)
    assert tuple(metrics.floor_quantiles(v, "x", {"p25": (1, 4), "m": (1, 2)}).first()) == (2, 3)
    assert metrics.floor_quantiles(v.filter("x > 9"), "x", {"m": (1, 2)}).first().m is None
    assert v.filter("x > 9").agg(metrics.median_finite(F.col("x").cast("double")).alias("m")).first().m == float("inf")


def test_labels(spark):
    ids = lambda *x: F.array(*map(F.lit, x))
    r = one(spark, a=tokens.labels(ids(9, 1, 2, 5, 6), [1, 2]), b=tokens.labels(ids(9), [1, 2]), k=tokens.after_header(ids(1, 2), [1, 2]), n=tokens.after_header(ids(3), [1, 2]))
    assert (list(r.a), list(r.b), r.k, r.n) == ([-100, -100, -100, 5, 6], [-100], 2, -1)


def test_top_one_excludes_itself_in_any_blocking(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 4))
    t = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id bigint, v array<double>")
    scores = v @ v.T
    np.fill_diagonal(scores, -np.inf)
    want = dict(enumerate(scores.argmax(1).tolist()))
    for rows in (7, 4096):
        assert {r.id: r.best_id for r in retrieval.top_one(t, t, rows).collect()} == want
        assert {r.id: r.best_id for r in retrieval.top_one(t, t, rows, broadcast_bytes=0).collect()} == want
    assert retrieval.top_one(t.limit(1), t.limit(1)).count() == 0
    assert retrieval.top_one(t, t.limit(0)).count() == retrieval.top_one(t.limit(0), t, broadcast_bytes=0).count() == 0


def test_top_one_leaves_out_other_lengths_and_ties_go_to_the_smaller_id(spark):
    rows = [(1, [1.0, 0.0]), (5, [1.0, 0.0]), (3, [1.0, 0.0]), (7, [9.0]), (8, [9.0, 9.0, 9.0])]
    t = spark.createDataFrame(rows, "id bigint, v array<double>")
    for most in (0, 1 << 20):
        assert {r.id: r.best_id for r in retrieval.top_one(t, t, 2, broadcast_bytes=most).collect()} == {1: 3, 3: 1, 5: 1}


def test_routing_precedence_and_index(spark):
    m = spark.createDataFrame([("b", ["a/1", "a_2"], ["a/2", "a/3"], None), ("c", [], None, ["a/3", "a/4"])], "block string, train array<string>, val array<string>, test array<string>")
    r = spark.createDataFrame([("a_1",), ("a/2",), ("a/3",), ("a/4",), ("z/9",), (None,)], "uid string")
    got = {x.uid: x.split for x in corpus.routed(r, m).collect()}
    assert got == {"a_1": "train", "a/2": "train", "a/3": "val", "a/4": "test", "z/9": "unmatched", None: "unmatched"}
    assert sorted(x.idx for x in corpus.with_index(r, "uid").collect()) == list(range(6))
    with pytest.raises(ValueError):
        corpus.guard_rows(r, 7, "train")
    with pytest.raises(ValueError):
        corpus.guard_labels(r, ["uid"])


def test_files(spark, tmp_path):
    texts = spark.createDataFrame([("x/0000_1.step", "DATA;\r\n#1=A();\n"), ("0000_2.step", "")], "rel_path string, text string")
    files.write_steps(texts, str(tmp_path / "s"))
    back = files.read_steps(spark, str(tmp_path / "s"), recursive=True)
    assert {(r.rel_path, r.uid, r.text) for r in back.collect()} >= {("x/0000_1.step", "0000/1", "DATA;\r\n#1=A();\n")}
    assert files.read_steps(spark, str(tmp_path / "s"), first=1).count() <= 1
    records = spark.createDataFrame([(2, "b"), (1, None)], "id int, x string")
    assert files.write_json_array(records, str(tmp_path / "a.json"), "id") == 2
    assert [r.id for r in files.read_records(spark, str(tmp_path / "a.json")).orderBy("id").collect()] == [1, 2]
    files.write_records(records, str(tmp_path / "l"))
    assert files.read_records(spark, str(tmp_path / "l")).count() == 2
    index = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, uid string")
    files.save_index(index, str(tmp_path / "i"))
    assert files.load_index(spark, str(tmp_path / "i")).count() == 2
    with pytest.raises(Exception):
        files.save_index(index, str(tmp_path / "i"))
    files.save_index(index.filter("pos = 1"), str(tmp_path / "i2"))
    with pytest.raises(ValueError):
        files.load_index(spark, str(tmp_path / "i2"))
    files.check_marker(spark, str(tmp_path / "m"), "paper")
    files.check_marker(spark, str(tmp_path / "m"), "paper")
    with pytest.raises(ValueError):
        files.check_marker(spark, str(tmp_path / "m"), "semantic")
    (tmp_path / "loss.csv").write_text("timestamp,step,epoch,loss,learning_rate,grad_norm\nt,1,0.1,0.5,1e-4,2\nt,x,0.1,0.5,1e-4,2\nt,2,,,,\n")
    assert [r.step for r in files.read_losses(spark, str(tmp_path / "loss.csv")).collect()] == [1]


def test_export_tally(spark):
    items = spark.createDataFrame([("a", b"1"), ("b", b"bad"), ("c", b"2")], "uid string, content binary")

    def exporter(content):
        if content == b"bad":
            raise ValueError
        return "x"

    done = spark.createDataFrame([("c",)], "uid string")
    assert {r.uid: r.status for r in files.export(items, exporter, done).collect()} == {"a": "ok", "b": "fail", "c": "skip"}
    assert {r.status for r in files.export(items, None).collect()} == {"backend_missing"}


def test_config(monkeypatch):
    monkeypatch.setenv("ROOT_DIR", "/data")
    text = "paths:\n  root: ${oc.env:ROOT_DIR}\n  tmp: $ROOT_DIR/tmp  # scratch\nn: 3\n"
    assert files.load_config(text, {"n": "4"}) == {"paths.root": "/data", "paths.tmp": "/data/tmp", "n": "4"}


def test_streaming_alarms_equal_batch(spark, tmp_path):
    from brepflow.streaming.alarms import streak_alarms

    rows = [("r", i, x, y) for i, (x, y) in enumerate([(True, False)] * 3 + [(False, False)] + [(True, False)] * 3 + [(False, True), (True, False)])]
    schema = "run string, seq bigint, counts boolean, resets boolean"
    log = spark.createDataFrame(rows, schema).coalesce(1)
    source = str(tmp_path / "in")
    log.filter("seq < 4").write.mode("append").parquet(source)
    stream = streak_alarms(spark.readStream.schema(schema).parquet(source), 5, 6)
    q = stream.writeStream.format("memory").queryName("alarms").outputMode("append").start()
    q.processAllAvailable()
    log.filter("seq >= 4").write.mode("append").parquet(source)
    q.processAllAvailable()
    q.stop()
    got = [(r.seq, r.streak, r.alarm) for r in spark.table("alarms").orderBy("seq").collect()]
    batch = windows.zero_streaks(log, "run", "seq", windows.stretch(F.col("seq"), 2), F.col("counts"), F.col("resets"), 5, 6).orderBy("seq").collect()
    assert got == [(r.seq, r.streak, r.alarm) for r in batch]


def test_semantic_shape_section_drops_what_no_section_holds():
    text = data("#1=SHAPE_DEFINITION_REPRESENTATION(#2);", "#2=X(#3);", "#3=Y(1.0);", "#8=UNUSED(1.0);")
    out, error, dropped = semantic.restructure(text)
    assert error is None and dropped == 1
    assert out.split("\n") == [
        "DATA;", "/* SHAPE_DEFINITION_REPRESENTATION Section - 1 subtrees */", "/* BEGIN SHAPE_DEFINITION_REPRESENTATION 1 */",
        "#1=SHAPE_DEFINITION_REPRESENTATION(#2);", "#2=X(#3);", "#3=Y(1.0);", "/* END SHAPE_DEFINITION_REPRESENTATION 1 */", "ENDSEC;", "END-ISO-10303-21;", "",
    ]


def test_semantic_presentation_unifies_colours_and_sets_placeholders():
    text = data(
        "#1=MECHANICAL_DESIGN_GEOMETRIC_PRESENTATION_REPRESENTATION('',(#2,#3,#9));", "#2=STYLED_ITEM('',#4);", "#3=STYLED_ITEM('#5',#5);",
        "#4=COLOUR_RGB('a',1.,0.,0.);", "#5=COLOUR_RGB('b',0.,1.,0.);", "#9=(A(3) B());",
    )
    out, error, _ = semantic.restructure(text)
    lines = out.split("\n")
    assert error is None and "/* MECHANICAL_DESIGN_GEOMETRIC_PRESENTATION_REPRESENTATION Section - 2 STYLED_ITEM, 1 COMPLEX_ENTITY */" in lines
    assert "#1=MECHANICAL_DESIGN_GEOMETRIC_PRESENTATION_REPRESENTATION('',(#ID_1,#ID_2,#ID_3));" in lines
    assert "#2=COLOUR_RGB( , 0.5, 0.5, 0.5 );" in lines and "#4=STYLED_ITEM('#5',#2);" in lines
    assert lines[lines.index("/* BEGIN STYLED_ITEM 2 */") + 1] == "/* ID_2 = 4 */"
    assert "(#3,#4,#5)" in semantic.restore(out)


def test_semantic_pruning_and_stranded_entities():
    kept = data("#1=SHAPE_DEFINITION_REPRESENTATION(#2,#5);", "#2=PRODUCT_DEFINITION(#3);", "#3=PRODUCT_DEFINITION_CONTEXT('',#4);", "#4=APPLICATION_CONTEXT('');", "#5=Z(1);", "#6=APPLICATION_PROTOCOL_DEFINITION('',#4);")
    out, error, dropped = semantic.restructure(kept)
    assert error is None and dropped == 0 and out.index("APPLICATION_PROTOCOL_DEFINITION") < out.index("#3=SHAPE")
    out, error, _ = semantic.restructure(kept.replace("#6=APPLICATION_PROTOCOL_DEFINITION('',#4);", ""))
    assert out is None and error == "referred to, but not written: #4"


def test_semantic_levels_and_category():
    tree = lambda *x: [(d, e, "NORMAL") for d, e in x]
    assert semantic.levels([tree((0, 1), (1, 3), (2, 4)), tree((0, 2), (1, 4), (1, 3))]) == [1, 2, 3, 4, 4]
    out, _, _ = semantic.restructure(data("#7=PRODUCT_CATEGORY_RELATIONSHIP(#8);", "#8=A();", "#5=PRODUCT_CATEGORY_RELATIONSHIP(#8);"))
    assert out.split("\n")[1:5] == ["/* PRODUCT_CATEGORY_RELATIONSHIP Section - 2 root entities */", "#1=PRODUCT_CATEGORY_RELATIONSHIP(#3);", "#2=PRODUCT_CATEGORY_RELATIONSHIP(#3);", "#3=A();"]


def test_cycle_is_marked_on_its_path_only():
    g = L.parse(data("#1=A(#2,#3);", "#2=B(#1,#3);", "#3=C();"))
    assert L.depth_first(g, [1], set()) == [(0, 1, "NORMAL"), (1, 2, "NORMAL"), (2, 1, "CIRCULAR_REF"), (2, 3, "NORMAL")]


def test_embedding_interface(spark):
    t = spark.createDataFrame([(1, "ab"), (2, None), (3, "c")], "id bigint, text string")
    out = retrieval.embedded(t, lambda x: np.array([[len(s), 1.0] for s in x]), batch=1).orderBy("id").collect()
    assert [None if r.v is None else list(r.v) for r in out] == [[2.0, 1.0], None, [1.0, 1.0]]


def test_zero_vectors_stay(spark):
    assert list(one(spark, v=retrieval.unit(F.array(F.lit(0.0), F.lit(0.0)))).v) == [0.0, 0.0]
    assert list(one(spark, v=retrieval.unit(F.array(F.lit(3.0), F.lit(4.0)))).v) == pytest.approx([0.6, 0.8])


def test_both_styles_and_no_other(spark):
    t = spark.createDataFrame([(1, data("#1=SHAPE_DEFINITION_REPRESENTATION(#2);", "#2=X(1.5);")), (2, None), (3, "")], "row_id bigint, step string")
    for style in ("semantic", "paper"):
        out = {r.row_id: (r.text, r.error) for r in semantic.restructured(t, style).collect()}
        assert out[1][0] and out[2] == out[3] == (None, None)
    with pytest.raises(ValueError):
        semantic.restructured(t, "other")


def test_linearised_text_parses_back_to_the_same_types():
    text = data("#10=A(#20,#30);", "#20=B('it''s; #9',#30);", "#30=(C(1.) D());", "#40=E(#10,#40);")
    g = L.parse(L.reserialize(text)[0])
    assert sorted(g.types.values()) == ["", "A", "B", "E"] and g.error is None


def test_report_and_records(spark):
    html = files.report("a < b", spark.createDataFrame([(1, "<x>")], "n int, s string"))
    assert "a &lt; b" in html and "&lt;x>" in html


def test_counts_of_lines_and_prompts(spark):
    t = lambda s: F.lit(s)
    r = one(
        spark, n=T.entity_count(t("#1=A();\r\n #2=B();\n#3 =C();")), loose=T.entity_count_loose(t("#1=A();\r\n #2=B();\n#3 =C();")), cut=T.cut_mid_entity(t("DATA;\n#1=A(\n")),
        name=T.safe_name(t("a b/ü-" + "x" * 50)), empty=T.safe_name(t("")), step=T.extract_step(t("x ISO-10303-21; y END-ISO-10303-21; z")), plain=T.prompt(t("c"), t("")),
        mask=T.mask_literals(t("A('it''s',2)")), keep=T.mask_keep_quotes(t("A('it''s',2)")), th=T.ordinal(F.lit(111)), nd=T.ordinal(F.lit(22)),
    )
    assert (r.n, r.loose, r.cut, r.empty, r.th, r.nd) == (2, 3, True, "output", "111th", "22nd")
    assert len(r.name) == 40 and r.name.startswith("a_b/_-".replace("/", "_")[:4]) and r.step == "ISO-10303-21; y END-ISO-10303-21;"
    assert "retrieved" not in r.plain and r.mask == "A(_______,2)" and r.keep == "A('_____',2)"


def test_isolated_backend_survives_crashes_and_timeouts():
    import os
    import time

    def backend(text):
        if text == "crash":
            os._exit(1)
        if text == "slow":
            time.sleep(60)
        if text == "bad":
            raise ValueError
        return np.ones((1, 3, 3))

    run = geometry.isolated(backend, 1.0)
    assert [run(x) is None for x in ("crash", "slow", "bad", "fine")] == [True, True, True, False]
