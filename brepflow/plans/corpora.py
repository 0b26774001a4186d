"""Queries over corpus building: sources and sinks (S), filters and routing (F), lookups (J), set operations and order (O)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brepflow.functions import text as T
from brepflow.operators import corpus as K
from brepflow.operators import retrieval as V
from brepflow.operators import tokens
from brepflow.plans.graphs import ENTITY
from brepflow.operators import graph as G
from brepflow.plans.registry import Catalog, quoted
from brepflow.plans.texts import train, trimmed
from brepflow.session import scratch, spread, table
from brepflow.sources import files as S

C = Catalog()
N_ENTITIES = r"len(regexp_extract_all({}, '(?m)^#\d+\s*='))"
SPLITS = """listed as (select unnest(train) as uid, 1 as rank from split_manifest union all select unnest(val), 2 from split_manifest union all select unnest(test), 3 from split_manifest),
split_norm as (select replace(uid, '_', '/') as uid, ['train', 'val', 'test'][min(rank)] as split from listed where uid is not null group by 1),
split_raw as (select uid, ['train', 'val', 'test'][min(rank)] as split from listed where uid is not null group by 1)"""
FILES = "files as (select distinct replace(uid, '_', '/') as uid from train_with_rag where uid is not null)"


def captions(spark, folder) -> DataFrame:
    return table(spark, folder, "captions")


def known_files(spark, folder) -> DataFrame:
    return train(spark, folder).select(T.normal_uid(F.col("uid")).alias("uid")).filter("uid is not null").distinct()


# ---- sources and sinks


@C.add(
    r"""select path, concat_ws('/', nullif(split_part(path, '/', -4), ''), regexp_replace(split_part(path, '/', -1), '\.[^.]*$', '')) as uid, count(*) as n
    from (select 'run/' || split_part(replace(uid, '_', '/'), '/', 1) || '/vec/' || path as path from file_validation where path is not null and uid is not null) group by all"""
)
def s03_path_uid(spark, folder):
    """The recorded files as they would lie below their roots."""
    root = F.split_part(T.normal_uid(F.col("uid")), F.lit("/"), F.lit(1))
    t = table(spark, folder, "file_validation").filter("path is not null and uid is not null").select(F.concat(F.lit("run/"), root, F.lit("/vec/"), "path").alias("path"))
    return t.groupBy("path", S.path_uid(F.col("path")).alias("uid")).agg(F.count("*").alias("n"))


def _as_files(spark, folder) -> DataFrame:
    name = T.file_name(F.concat_ws("/", "uid", "row_id"))
    return train(spark, folder).filter("step is not null").select(F.concat("row_id", F.lit("/"), name).alias("rel_path"), F.col("step").alias("text"))


_FILE = "row_id || '/' || replace(concat_ws('/', uid, row_id), '/', '_') || '.step'"


@C.add(f"select {_FILE} as rel_path, md5(step) as text from train_with_rag where step is not null")
def s01_step_files(spark, folder):
    """Texts written as files and scanned again, empty ones included."""
    to = scratch(spark, "steps")
    S.write_steps(_as_files(spark, folder), to)
    return S.read_steps(spark, to, recursive=True).select("rel_path", F.md5("text").alias("text"))


@C.add(f"select {_FILE} as rel_path, md5(step) as text, row_id % 2 = 0 as kept from train_with_rag where step is not null")
def s02_relative_layout(spark, folder):
    """A tree of files copied with its layout; files that are there already (S12: of even row_id, written before) are left as they are."""
    source, to = scratch(spark, "tree"), scratch(spark, "copy")
    files = _as_files(spark, folder)
    S.write_steps(files, source)
    even = F.element_at(F.split("rel_path", "/"), 1).cast("bigint") % 2 == 0
    S.write_steps(files.filter(even).withColumn("text", F.concat(F.lit("kept "), "text")), to)
    S.write_steps(S.read_steps(spark, source, recursive=True), to, skip_existing=True)
    back = S.read_steps(spark, to, recursive=True)
    kept = back["text"].startswith("kept ")
    return back.select("rel_path", F.md5(F.when(kept, F.substring("text", 6, 2**31 - 1)).otherwise(F.col("text"))).alias("text"), kept.alias("kept"))


@C.add("select case when row_id % 3 = 0 then 'skip' when step is null or step = '' then 'fail' else 'ok' end as status, count(*) as n from train_with_rag group by 1")
def s04_export_tally(spark, folder):
    """Items exported by an exporter that refuses empty ones; every third was done before. The items are the texts' bytes."""

    def exporter(content: bytes) -> str:
        if not content:
            raise ValueError("empty")
        return content.decode()

    items = train(spark, folder).select(F.col("row_id").cast("string").alias("uid"), F.coalesce(F.col("step"), F.lit("")).cast("binary").alias("content"))
    done = items.filter(F.col("uid").cast("bigint") % 3 == 0).select("uid")
    return S.export(items, exporter, done).groupBy("status").agg(F.count("*").alias("n"))


@C.add("select row_id, uid, caption, entity_count from train_with_rag")
def s06_json_array(spark, folder):
    """Records written as one JSON array and read by the reader that tells arrays from lines."""
    to = scratch(spark, "array")
    S.write_json_array(train(spark, folder).select("row_id", "uid", "caption", "entity_count"), to, "row_id")
    return S.read_records(spark, to, "row_id bigint, uid string, caption string, entity_count int")


@C.add("select count(*) as n, true as refused, 1::bigint as n_forced from rag_index")
def s10_overwrite_guard(spark, folder):
    """An index that is there is refused, and replaced where that is forced."""
    to = scratch(spark, "guarded")
    index = table(spark, folder, "rag_index")
    S.save_index(index, to)
    refused = False
    try:
        S.save_index(index, to)
    except AnalysisException:
        refused = True
    n = S.load_index(spark, to).count()
    S.save_index(index.orderBy("pos").limit(1).withColumn("pos", F.lit(0)), to, force=True)
    return S.load_index(spark, to).agg(F.lit(n).cast("bigint").alias("n"), F.lit(refused).alias("refused"), F.count("*").alias("n_forced"))


@C.add("select style, style = 'paper' as accepted from (values ('paper'), ('semantic')) v(style)")
def s13_format_marker(spark, folder):
    """A folder of one annotation style accepts it again and refuses another."""
    to = scratch(spark, "marked")
    S.check_marker(spark, to, "paper")
    rows = []
    for style in ("paper", "semantic"):
        try:
            S.check_marker(spark, to, style)
            rows.append((style, True))
        except ValueError:
            rows.append((style, False))
    return spark.createDataFrame(rows, "style string, accepted boolean")


@C.add(
    f"""select row_number() over (order by row_id) as place, caption, coalesce(contains(step, 'END-ISO-10303-21;'), false) as complete, coalesce({N_ENTITIES.format('step')}, 0) as n_generated,
    coalesce({N_ENTITIES.format('retrieved_step')}, 0) as n_gt from train_with_rag order by row_id limit 20"""
)
def s20_case_report(spark, folder):
    """A report of the first twenty cases (the limit is the feature), read back from its JSON."""
    to = scratch(spark, "report")
    cases = train(spark, folder).orderBy("row_id").limit(20).select("caption", F.col("step").alias("generated"), F.col("retrieved_step").alias("gt"))
    S.write_case_report("Cases", cases, to)
    back = spark.read.schema("cases array<struct<caption:string,complete:boolean,n_generated:bigint,n_gt:bigint>>").json(f"{to}.json", multiLine=True)
    return back.select(F.posexplode("cases").alias("place", "c")).select((F.col("place") + 1).cast("bigint").alias("place"), "c.*")


@C.add("select * from (values ('a.b', 'x y'), ('a.c.0', '1'), ('a.c.1', '2'), ('a.d', 'it''s # one'), ('a.e', 'fallback/z'), ('n', '4'), ('l.0', 'p'), ('l.1', 'q: r')) v(key, value)")
def s23_config(spark, folder):
    """A nested configuration with lists, quotes, comments, the environment and an override."""
    text = "a:\n  b: x y  # plain\n  c: [1, 2]\n  d: 'it''s # one'\n  e: ${oc.env:BREPFLOW_NOT_SET,fallback}/z\nn: 3\nl:\n  - p\n  - \"q: r\"\n"
    return spark.createDataFrame(list(S.load_config(text, {"n": "4"}).items()), "key string, value string")


_MISSING = ", ".join(map(quoted, S.MISSING))


@C.add("select " + ", ".join(f"if({c} in ({_MISSING}), null, {c}) as {c}" for c in ("uid", "abstract", "beginner", "intermediate", "expert")) + " from captions")
def s05_caption_csv(spark, folder):
    """The captions, written as CSV and read again."""
    to = scratch(spark, "captions")
    S.write_captions(captions(spark, folder), to)
    return S.read_captions(spark, to)


@C.add("select row_id, uid, caption, md5(step) as step, entity_count from train_with_rag")
def s07_json_lines(spark, folder):
    """Records written as JSON lines and read again by the reader that tells arrays from lines."""
    to = scratch(spark, "records")
    S.write_records(train(spark, folder).select("row_id", "uid", "caption", "step", "entity_count"), to)
    back = S.read_records(spark, to, "row_id bigint, uid string, caption string, step string, entity_count int")
    return back.withColumn("step", F.md5("step"))


@C.add(f"with {SPLITS} select coalesce(split, 'unmatched') as split, count(*) as n from train_with_rag t left join split_norm s on s.uid = replace(t.uid, '_', '/') group by 1")
def s08_split_folders(spark, folder):
    """Records written to a folder per split and read again."""
    to = scratch(spark, "splits")
    S.write_records(K.routed(train(spark, folder).select("row_id", "uid", "caption"), table(spark, folder, "split_manifest")), to, by="split")
    return spark.read.schema("row_id bigint, uid string, caption string, split string").json(to).groupBy("split").agg(F.count("*").alias("n"))


@C.add("select count(*) as n, max(pos) + 1 as top, count(*) = max(pos) + 1 as whole from rag_index")
def s09_index_check(spark, folder):
    to = scratch(spark, "index")
    S.save_index(table(spark, folder, "rag_index"), to)
    return S.load_index(spark, to).agg(F.count("*").alias("n"), (F.max("pos") + 1).cast("bigint").alias("top"), (F.count("*") == F.max("pos") + 1).alias("whole"))


@C.add("select uid, count(*) as n from train_with_rag t where not exists (select 1 from file_validation v where v.uid = t.uid) group by uid")
def s12_pending(spark, folder):
    return S.pending(train(spark, folder), table(spark, folder, "file_validation").filter("uid is not null")).groupBy("uid").agg(F.count("*").alias("n"))


@C.add("select strftime(ts, '%Y-%m-%dT%H:%M:%S') as timestamp, event_id::int as step, (user_id % 5)::double as epoch, value as loss, 0.5::double as learning_rate, value / 4 as grad_norm from events")
def s14_loss_log(spark, folder):
    """The events appended to a loss log in two parts, and read."""
    to = scratch(spark, "losses")
    rows = table(spark, folder, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("event_id").cast("int").alias("step"), (F.col("user_id") % 5).cast("double").alias("epoch"), F.col("value").alias("loss"),
        F.lit(0.5).alias("learning_rate"), (F.col("value") / 4).alias("grad_norm"),
    )
    S.append_losses(rows.filter("step % 2 = 0"), to)
    S.append_losses(rows.filter("step % 2 = 1"), to)
    return S.read_losses(spark, to)


@C.add(r"select caption, md5(step) as generated, md5(retrieved_step) as gt, len(list_filter(regexp_split_to_array(retrieved_step, '\s+'), lambda x: x <> '')) <= 600 as in_dist from train_with_rag")
def s18_evaluation_records(spark, folder):
    """Evaluation records written as JSON and read."""
    to = scratch(spark, "evaluation")
    rows = train(spark, folder).select("caption", F.col("step").alias("generated"), F.col("retrieved_step").alias("gt"), F.when(F.col("retrieved_step").isNotNull(), F.size(T.words(F.col("retrieved_step"))) <= 600).alias("in_dist"))
    S.write_records(rows, to)
    back = S.read_records(spark, to, "caption string, generated string, gt string, in_dist boolean")
    return back.select("caption", F.md5("generated").alias("generated"), F.md5("gt").alias("gt"), "in_dist")


_LOSS = "select strftime(ts, '%Y-%m-%dT%H:%M:%S') as timestamp, event_id::varchar as step, (user_id % 5)::varchar as epoch, if(event_type = 'error', 'bad', event_id::varchar || '.5') as loss from events"


@C.add(f"select timestamp, try_cast(step as int) as step, try_cast(epoch as double) as epoch, try_cast(loss as double) as loss from ({_LOSS}) where try_cast(loss as double) is not null")
def s15_loss_rows(spark, folder):
    raw = table(spark, folder, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("event_id").cast("string").alias("step"), (F.col("user_id") % 5).cast("string").alias("epoch"),
        F.when(F.col("event_type") == "error", "bad").otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".5"))).alias("loss"),
    )
    return S.parsed_losses(raw)


@C.add("select user_id % 7 as run, event_id::int as step, if(event_type = 'error', null, event_id % 3)::double as reward from events")
def s16_trainer_state(spark, folder):
    """Log rows of a JSON state per run; absent keys are null."""
    e = table(spark, folder, "events")
    row = F.to_json(F.struct(F.col("event_id").alias("step"), F.when(F.col("event_type") != "error", F.col("event_id") % 3).alias("reward")))
    parts = e.groupBy((F.col("user_id") % 7).alias("run"), F.floor(F.col("event_id") / 500).alias("part")).agg(F.array_join(F.collect_list(row), ",").alias("r"))
    states = parts.select("run", F.concat(F.lit('{"log_history":['), "r", F.lit("]}")).alias("state"))
    return states.select("run", F.explode(S.log_rows(F.col("state"))).alias("x")).select("run", "x.step", "x.reward")


_EPOCHS = rf"""line as (select doc_id, source, unnest(string_split(text, chr(10))) as line from documents),
epochs as (select doc_id, regexp_extract(line, {quoted(S.EPOCH_LINE)}, 1)::int as epoch, regexp_extract(line, {quoted(S.EPOCH_LINE)}, 2)::double as minutes, regexp_extract(line, {quoted(S.EPOCH_LINE)}, 3)::double as avg,
  regexp_extract(line, {quoted(S.EPOCH_LINE)}, 4)::double as min, regexp_extract(line, {quoted(S.EPOCH_LINE)}, 5)::double as max from line where regexp_matches(line, {quoted(S.EPOCH_LINE)}))"""


def epochs(spark, folder) -> DataFrame:
    """Epoch lines of all documents, whatever their source."""
    lines = table(spark, folder, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", *(c.alias(k) for k, c in S.epoch_rows(F.col("line")).items())).filter("epoch is not null")


@C.add(f"with {_EPOCHS} select * from epochs")
def s17_epoch_lines(spark, folder):
    return epochs(spark, folder)


@C.add(f"with {SPLITS} select count(*) as n, count(*) - count(split) as n_unmatched, round(avg((split is null)::int), 6) as share, round(avg((split is null)::int), 6) > 0.05 as warn from train_with_rag t left join split_norm s on s.uid = replace(t.uid, '_', '/')")
def s19_unmatched(spark, folder):
    return S.unmatched(K.routed(train(spark, folder), table(spark, folder, "split_manifest")))


# ---- filters and routing


@C.add(f"select row_id from train_with_rag where {N_ENTITIES.format('step')} < 500")
def f01_entity_cap(spark, folder):
    return K.keep_small(train(spark, folder), F.col("step")).select("row_id")


@C.add("select uid, abstract as description, row_number() over (order by uid, abstract) - 1 as idx from captions where uid is not null and abstract is not null")
def f02_project(spark, folder):
    kept = captions(spark, folder).select("uid", "abstract").dropna().withColumnRenamed("abstract", "description")
    return K.with_index(kept, "uid", "description")


@C.add(f"with {FILES} select case when f.uid is null then 'missing_file' when coalesce({trimmed('abstract')} = '', true) then 'empty_caption' else 'kept' end as reason, count(*) as n from captions c left join files f on f.uid = replace(c.uid, '_', '/') group by 1")
def f03_skip_tally(spark, folder):
    known = known_files(spark, folder).withColumn("known", F.lit(True))
    joined = captions(spark, folder).withColumn("uid", T.normal_uid(F.col("uid"))).join(known, "uid", "left")
    return joined.groupBy(K.first_reason(("missing_file", F.col("known").isNull()), ("empty_caption", T.is_blank(F.col("abstract")))).alias("reason")).agg(F.count("*").alias("n"))


@C.add(
    ENTITY + f""", {SPLITS}, bad as (select row_id from edge d where not exists (select 1 from entity e where e.row_id = d.row_id and e.eid = d.dst) union select row_id from entity where not parsed)
    select case when coalesce(step, '') = '' or t.row_id in (select row_id from bad) then 'failed' when {N_ENTITIES.format('step')} >= 500 then 'too_large'
      when s.split is null then 'unmatched' else s.split end as reason, count(*) as n from train_with_rag t left join split_raw s using (uid) group by 1"""
)
def f04_skip_tally(spark, folder):
    step = F.col("step")
    t = spread(train(spark, folder).select("row_id", "uid", "step"), "row_id")
    t = t.withColumns({"n_counted": T.entity_count(step), "empty": F.coalesce(step, F.lit("")) == ""})
    found = G.summaries(t, carry=("uid", "n_counted", "empty"))  # one scan and one parse; texts go no further
    marked = K.routed(found, table(spark, folder, "split_manifest"), normalise=False)
    reason = K.first_reason(("failed", F.col("empty") | (F.col("n_dangling") > 0) | (F.col("n_bad") > 0)), ("too_large", F.col("n_counted") >= 500))
    return marked.groupBy(F.when(reason == "kept", F.col("split")).otherwise(reason).alias("reason")).agg(F.count("*").alias("n"))


@C.add(f"with {SPLITS} select row_id, coalesce(split, 'unmatched') as split from train_with_rag t left join split_norm s on s.uid = replace(t.uid, '_', '/')")
def f05_route(spark, folder):
    return K.routed(train(spark, folder).select("row_id", "uid"), table(spark, folder, "split_manifest")).select("row_id", "split")


@C.add(f"with {SPLITS} select row_id, coalesce(split, 'unmatched') as split from train_with_rag t left join split_raw s using (uid)")
def f06_route_raw(spark, folder):
    return K.routed(train(spark, folder).select("row_id", "uid"), table(spark, folder, "split_manifest"), normalise=False).select("row_id", "split")


@C.add(f"with {SPLITS} select count(*) as n from train_with_rag t join split_norm s on s.uid = replace(t.uid, '_', '/') where split = 'train' having count(*) >= 100")
def f07_guard_rows(spark, folder):
    """Rows of the train split, and none of them where there are fewer than a hundred."""
    routed = K.routed(train(spark, folder), table(spark, folder, "split_manifest")).filter("split = 'train'")
    try:
        return K.guard_rows(routed, K.LEAST_TRAIN_ROWS, "train").agg(F.count("*").alias("n"))
    except ValueError:
        return spark.createDataFrame([], "n bigint")


@C.add(f"select pos, uid from rag_index where output <> '' and {N_ENTITIES.format('output')} < 500")
def f08_usable_templates(spark, folder):
    return K.usable_templates(table(spark, folder, "rag_index")).select("pos", "uid")


@C.add(f"select row_id, id_retrieve, md5(coalesce(if({N_ENTITIES.format('i.output')} < 100, i.output, null), '')) as text from train_with_rag t left join rag_index i on i.uid = replace(t.id_retrieve, '_', '/')")
def f09_blanked(spark, folder):
    index = table(spark, folder, "rag_index").select(F.col("uid").alias("key"), "output")
    t = train(spark, folder).select("row_id", "id_retrieve", T.normal_uid(F.col("id_retrieve")).alias("key"))
    return t.join(index, "key", "left").select("row_id", "id_retrieve", F.md5(K.retrieved_text(F.col("output"), 100)).alias("text"))


@C.add("select row_id from train_with_rag where length(step) <= 2048 * 4 and octet_length(encode(step)) <= 2048 * 4 - 200")
def f10_length_filter(spark, folder):
    """Byte tokens; the bound on characters, which never drops more than that on tokens, goes first."""
    return K.within_tokens(train(spark, folder), F.col("step"), 2048 * 4 - 200, tokens.byte_count, 2048 * 4).select("row_id")


@C.add("select row_id, octet_length(encode(step)) <= 8192 as in_dist from train_with_rag")
def f11_in_distribution(spark, folder):
    """Byte tokens of the truth within the longest completion."""
    return train(spark, folder).select("row_id", (tokens.byte_count(F.col("step")) <= 8192).alias("in_dist"))


@C.add("select row_id, length(step) <= (3000 * 3.5)::int as in_budget from train_with_rag")
def f12_char_budget(spark, folder):
    return train(spark, folder).select("row_id", (F.length("step") <= int(3000 * 3.5)).alias("in_budget"))


_FIELDS = ("caption", "step", "retrieved_step")


@C.add(
    " union all ".join(
        f"select '{c}' as field, count(*) as n_bad, coalesce(list_sort(list(row_id) filter (r <= 5)), []) as first_bad from (select row_id, row_number() over (order by row_id) as r from train_with_rag where coalesce({trimmed(c)} = '', true))"
        for c in _FIELDS
    )
)
def f13_blank_fields(spark, folder):
    fields = F.explode(F.array(*(F.when(T.is_blank(F.col(c)), F.lit(c)) for c in _FIELDS))).alias("field")
    bad = train(spark, folder).select("row_id", fields).filter("field is not null")
    counts = bad.groupBy("field").agg(F.count("*").alias("n_bad"))
    first = bad.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy("row_id"))).filter("r <= 5").groupBy("field").agg(F.array_sort(F.collect_list("row_id")).alias("first_bad"))
    return counts.join(first, "field")


@C.add("select " + ", ".join(f"count_if(coalesce({trimmed(c)} = '', true)) as {c}" for c in _FIELDS) + " from train_with_rag")
def f14_label_fields(spark, folder):
    return train(spark, folder).agg(*(F.count_if(T.is_blank(F.col(c))).alias(c) for c in _FIELDS))


@C.add("select row_id, ok, place from (select row_id, contains(step, 'END-ISO-10303-21;') as ok, row_number() over (partition by contains(step, 'END-ISO-10303-21;') order by row_id) as place from train_with_rag where step is not null) where place <= 3")
def f15_first_of_each(spark, folder):
    """The first three of each kind (the limit is the feature)."""
    t = train(spark, folder).filter("step is not null")
    return K.first_of_each(t.select("row_id", "step"), T.has_terminator(F.col("step")), 3, "row_id").select("row_id", "ok", "place")


@C.add("select row_id, uid from train_with_rag")
def f17_shuffled(spark, folder):
    """The SQL has the rows; that the order is the same in each run, and another one than that of the keys, is tested apart."""
    return K.shuffled(train(spark, folder).select("row_id", "uid"), "row_id")


# ---- joins


@C.add(f"select c.uid, {trimmed('c.abstract')} as caption, t.row_id from captions c join train_with_rag t on replace(t.uid, '_', '/') = replace(c.uid, '_', '/') where coalesce({trimmed('c.abstract')}, '') <> ''")
def j01_paired(spark, folder):
    texts = train(spark, folder).select("row_id", T.file_name(F.col("uid")).alias("name"))
    c = captions(spark, folder).select("uid", T.trim_space(F.col("abstract")).alias("caption"), T.file_name(F.col("uid")).alias("name")).filter("caption <> ''")
    return c.join(texts, "name").select("uid", "caption", "row_id")


@C.add(f"with {FILES} select uid, abstract from captions c where exists (select 1 from files f where f.uid = replace(c.uid, '_', '/'))")
def j02_with_file(spark, folder):
    c = captions(spark, folder).select("uid", "abstract", T.normal_uid(F.col("uid")).alias("key"))
    return c.join(known_files(spark, folder).withColumnRenamed("uid", "key"), "key", "left_semi").select("uid", "abstract")


@C.add(f"with {SPLITS} select row_id, coalesce(split = 'train', false) as in_train from train_with_rag t left join split_norm s on s.uid = replace(t.uid, '_', '/')")
def j03_split_flag(spark, folder):
    return K.routed(train(spark, folder).select("row_id", "uid"), table(spark, folder, "split_manifest")).select("row_id", (F.col("split") == "train").alias("in_train"))


@C.add("select row_id, md5(coalesce(i.output, '')) as text from train_with_rag t left join rag_index i on i.uid = replace(t.id_retrieve, '_', '/')")
def j04_retrieved_text(spark, folder):
    index = table(spark, folder, "rag_index").select(F.col("uid").alias("key"), "output")
    t = train(spark, folder).select("row_id", T.normal_uid(F.col("id_retrieve")).alias("key"))
    return t.join(index, "key", "left").select("row_id", F.md5(F.coalesce("output", F.lit(""))).alias("text"))


def vectors(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


_TOP = """scored as (select q.vec_id as id, i.vec_id as best_id, list_dot_product(q.embedding::double[], i.embedding::double[]) as score from embeddings q join embeddings i on i.vec_id <> q.vec_id {}),
top as (select id, arg_max(best_id, (score, -best_id)) as best_id, round(max(score), 6) as score from scored group by id)"""


@C.add(f"with {_TOP.format('')} select * from top")
def j05_top_one(spark, folder):
    v = vectors(spark, folder)
    return V.top_one(v, v).withColumn("score", F.round("score", 6))


@C.add(f"with {_TOP.format('and i.vec_id % 5 <> 0')} select * from top")
def j05_top_one_restricted(spark, folder):
    v = vectors(spark, folder)
    return V.top_one(v, v.filter("id % 5 <> 0")).withColumn("score", F.round("score", 6))


@C.add(f"with {_TOP.format('and i.label = 3')} select vec_id as id, coalesce(best_id, vec_id) as best_id from embeddings left join top on top.id = vec_id")
def j06_retrieve(spark, folder):
    v = vectors(spark, folder)
    index = table(spark, folder, "embeddings").filter("label = 3").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return V.fallback_self(v, V.top_one(v, index))


@C.add(f"with {_TOP.format('')} select top.id, best_id, e.label as best_label from top join embeddings e on e.vec_id = best_id")
def j07_enriched(spark, folder):
    v = vectors(spark, folder)
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("best_id"), F.col("label").alias("best_label"))
    return V.top_one(v, v).join(labels, "best_id").select("id", "best_id", "best_label")


_RUN = "(select row_id, row_number() over (order by row_id) - 1 as idx from train_with_rag where source = '{}')"


@C.add(f"select a.idx, a.row_id as row_a, b.row_id as row_b from {_RUN.format('batch_a')} a join {_RUN.format('batch_b')} b using (idx)")
def j08_positional(spark, folder):
    t = train(spark, folder).select("row_id", "source")
    a, b = (K.with_index(t.filter(F.col("source") == s).select(F.col("row_id").alias(n)), n) for s, n in (("batch_a", "row_a"), ("batch_b", "row_b")))
    return a.join(b, "idx").select("idx", "row_a", "row_b")


@C.add(f"with {_EPOCHS}, a as (select epoch, min(avg) as a from epochs where doc_id % 2 = 0 group by 1), b as (select epoch, min(avg) as b from epochs where doc_id % 2 = 1 group by 1) select epoch, a, b from a join b using (epoch)")
def j09_common_epochs(spark, folder):
    e = epochs(spark, folder)
    a, b = (e.filter(F.col("doc_id") % 2 == k).groupBy("epoch").agg(F.min("avg").alias(n)) for k, n in ((0, "a"), (1, "b")))
    return a.join(b, "epoch")


@C.add(
    r"""with g as (select row_id, t as etype, count(*) as gt from (select row_id, unnest(regexp_extract_all(step, '(?m)^#\d+\s*=\s*(\w+)\s*\(', 1)) as t from train_with_rag) group by all),
    r as (select row_id, t as etype, count(*) as gen from (select row_id, unnest(regexp_extract_all(retrieved_step, '(?m)^#\d+\s*=\s*(\w+)\s*\(', 1)) as t from train_with_rag) group by all),
    j as (select row_id, etype, coalesce(gt, 0) as gt, coalesce(gen, 0) as gen from g full join r using (row_id, etype)),
    v as (select *, case when gt = 0 then 'EXTRA' when gen = 0 then 'MISSING' when abs(gt - gen) > greatest(2, floor(gt * 0.3)) then 'MISMATCH' else 'MATCH' end as verdict from j)
    select verdict, etype, count(*) as n_rows, sum(gt)::bigint as gt, sum(gen)::bigint as gen from v group by all"""
)
def j10_type_alignment(spark, folder):
    """Also O07: the union of the types of both sides."""
    t = train(spark, folder)
    g, r = (t.select("row_id", F.explode_outer(T.entity_types(F.col(c))).alias("etype")).filter("etype is not null").groupBy("row_id", "etype").agg(F.count("*").alias(n)) for c, n in (("step", "gt"), ("retrieved_step", "gen")))
    j = g.join(r, ["row_id", "etype"], "full_outer").fillna(0, ["gt", "gen"])
    verdict = F.when(F.col("gt") == 0, "EXTRA").when(F.col("gen") == 0, "MISSING").when(F.abs(F.col("gt") - F.col("gen")) > F.greatest(F.lit(2), F.floor(F.col("gt") * 0.3)), "MISMATCH").otherwise("MATCH")
    return j.groupBy(verdict.alias("verdict"), "etype").agg(F.count("*").alias("n_rows"), F.sum("gt").alias("gt"), F.sum("gen").alias("gen"))


# ---- order and sets


@C.add("select row_id, uid from train_with_rag order by row_id limit 100")
def o01_first_n(spark, folder):
    """The first hundred (the limit is the feature)."""
    return train(spark, folder).select("row_id", "uid").orderBy("row_id").limit(100)


@C.add("select row_id, uid from train_with_rag where row_id >= 40")
def o02_offset(spark, folder):
    return train(spark, folder).filter("row_id >= 40").select("row_id", "uid")


@C.add(
    r"""with t as (select row_id, t as etype, count(*) as n from (select row_id, unnest(regexp_extract_all(step, '(?m)^#\d+\s*=\s*(\w+)\s*\(', 1)) as t from train_with_rag) group by all)
    select row_id, etype, n, place from (select *, row_number() over (partition by row_id order by n desc, etype) as place from t) where place <= 5"""
)
def o03_top_types(spark, folder):
    """The five most frequent types of each text (the limit is the feature)."""
    types = train(spark, folder).select("row_id", F.explode_outer(T.entity_types(F.col("step"))).alias("etype")).filter("etype is not null")
    counted = types.groupBy("row_id", "etype").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("n"), "etype"))).filter("place <= 5")


@C.add(f"with {_EPOCHS} select distinct epoch from epochs where doc_id % 2 = 0 intersect select epoch from epochs where doc_id % 2 = 1")
def o08_epoch_intersection(spark, folder):
    e = epochs(spark, folder)
    return e.filter("doc_id % 2 = 0").select("epoch").intersect(e.filter("doc_id % 2 = 1").select("epoch"))


@C.add("select vec_id, (select count(distinct [round(embedding[3 * p + 1], 0), round(embedding[3 * p + 2], 0), round(embedding[3 * p + 3], 0)]) from (select unnest(range(21)) as p)) as n_points from embeddings")
def o09_distinct_points(spark, folder):
    p = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.transform(F.slice(F.col("embedding"), i * 3 + 1, F.lit(3)), lambda x: F.round(x.cast("double"), 0) + F.lit(0.0)))
    return table(spark, folder, "embeddings").select("vec_id", F.size(F.array_distinct(p)).alias("n_points"))


@C.add("select row_id, row_number() over (order by uid, row_id) - 1 as idx from train_with_rag")
def o10_stable_order(spark, folder):
    return K.with_index(train(spark, folder).select("row_id", "uid"), "uid", "row_id").select("row_id", "idx")


@C.add("select coalesce(error, 'ok') as stage, count(*) as n, row_number() over (order by count(*) desc, coalesce(error, 'ok')) as by_count, row_number() over (order by coalesce(error, 'ok')) as by_name from file_validation group by 1")
def o11_stage_histogram(spark, folder):
    n = table(spark, folder, "file_validation").groupBy(F.coalesce("error", F.lit("ok")).alias("stage")).agg(F.count("*").alias("n"))
    return n.withColumns({"by_count": F.row_number().over(Window.orderBy(F.desc("n"), "stage")), "by_name": F.row_number().over(Window.orderBy("stage"))})


def queries() -> dict:
    return C.queries


def oracle_sql() -> dict[str, str]:
    return C.sql
