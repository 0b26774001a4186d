"""Queries over metrics (A), windows (W), token rows (K) and geometry with rewards (R)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brepflow.functions import text as T
from brepflow.operators import geometry as R
from brepflow.operators import metrics as M
from brepflow.operators import retrieval as V
from brepflow.operators import tokens as K
from brepflow.operators import windows as W
from brepflow.plans.corpora import _EPOCHS, N_ENTITIES, epochs
from brepflow.plans.registry import Catalog
from brepflow.plans.texts import train, trimmed
from brepflow.session import scratch, spread, table
from brepflow.sources import files as S
from brepflow.streaming.alarms import streak_alarms

C = Catalog()
#: Scores made of the events: missing for errors, NaN for sign-ups, infinite for large values, else the value in hundredths.
SCORES = """scores as (select event_id as idx, user_id % 7 as run, user_id % 2 = 0 as in_dist, event_type as status,
  case when event_type = 'error' then null when event_type = 'signup' then 'nan'::double when value > 300 then 'inf'::double else value / 100 end as scd from events)"""
FINITE = "scd is not null and isfinite(scd)"


def scores(spark, folder) -> DataFrame:
    kind = F.col("event_type")
    scd = F.when(kind == "error", None).when(kind == "signup", float("nan")).when(F.col("value") > 300, float("inf")).otherwise(F.col("value") / 100)
    return table(spark, folder, "events").select(F.col("event_id").alias("idx"), (F.col("user_id") % 7).alias("run"), (F.col("user_id") % 2 == 0).alias("in_dist"), kind.alias("status"), scd.alias("scd"))


def losses(spark, folder) -> DataFrame:
    """The events as a loss log: run, epoch, order, loss (0 for views, NaN for errors), learning rate and gradient norm."""
    loss = F.when(F.col("event_type") == "view", 0.0).when(F.col("event_type") == "error", float("nan")).otherwise(F.col("value"))
    return table(spark, folder, "events").select(
        (F.col("user_id") % 7).alias("run"), F.floor(F.col("event_id") / 1000).alias("epoch"), "ts", F.col("event_id").alias("step"), loss.alias("loss"), "value",
        (F.col("user_id") % 10 / 10).alias("lr"), "event_type",
    )


LOSSES = """losses as (select user_id % 7 as run, event_id // 1000 as epoch, ts, event_id as step, case when event_type = 'view' then 0.0 when event_type = 'error' then 'nan'::double else value end as loss,
  value, user_id % 10 / 10 as lr, event_type from events)"""


# ---- metrics


@C.add("select source, round(avg(contains(step, 'END-ISO-10303-21;')::int), 6) as completion_rate from train_with_rag group by source")
def a01_completion_rate(spark, folder):
    return train(spark, folder).groupBy("source").agg(M.rate(T.has_terminator(F.col("step"))).alias("completion_rate"))


@C.add("select count(*) as n, round(avg(ok::int), 6) as renderability_rate from file_validation")
def a02_renderability_rate(spark, folder):
    """The recorded outcome of opening each file stands for the mesh that no kernel makes here."""
    return table(spark, folder, "file_validation").agg(F.count("*").alias("n"), M.rate(F.col("ok")).alias("renderability_rate"))


@C.add(f"select source, round(avg({N_ENTITIES.format('step')}), 6) as mean_entities from train_with_rag group by source")
def a03_average_entity_count(spark, folder):
    return train(spark, folder).groupBy("source").agg(F.round(F.avg(T.entity_count(F.col("step"))), 6).alias("mean_entities"))


@C.add(f"with {SCORES} select run, count_if({FINITE}) as n, coalesce(round(median(scd) filter ({FINITE}), 6), 'inf'::double) as mscd from scores group by run")
def a04_median_scd(spark, folder):
    scd = F.when(M.finite(F.col("scd")), F.col("scd"))
    rows = scores(spark, folder).select("run", scd.alias("scd"))
    medians = M.group_quantiles(rows, "run", "scd", {"mscd": 0.5})
    counts = rows.groupBy("run").agg(F.count("scd").alias("n"))
    return counts.join(medians, "run", "left").select("run", "n", F.coalesce(F.round("mscd", 6), F.lit(float("inf"))).alias("mscd"))


@C.add(
    f"""with {SCORES}, p(part) as (values ('all'), ('in_dist'), ('none')), b as (select p.part, s.*, idx % 300 as entities from p left join scores s on p.part = 'all' or (p.part = 'in_dist' and in_dist))
    select part, count(idx) as n, coalesce(round(avg((status <> 'click')::int) filter (idx is not null), 6), 0) as cr, coalesce(round(avg((scd is not null)::int) filter (idx is not null), 6), 0) as rr,
      coalesce(round(median(scd) filter ({FINITE}), 6), 'inf'::double) as mscd, coalesce(round(avg(entities), 6), 0) as aec from b group by part"""
)
def a05_metric_bundle(spark, folder):
    """All rows, those in distribution, and a part without rows."""
    rows = scores(spark, folder).select("*", (F.col("status") != "click").alias("complete"), (F.col("idx") % 300).alias("entities"))
    parts = {"all": F.lit(True), "in_dist": F.col("in_dist"), "none": F.lit(False)}
    return M.bundle(rows, F.col("complete"), F.col("scd"), F.col("entities"), parts)


_PERCENTS = (1, 5, 25, 50, 75, 95, 99)


@C.add("select source, " + ", ".join(f"round(quantile_cont(n, {p / 100}), 6) as p{p}" for p in _PERCENTS) + f", round(avg(n), 6) as mean, min(n) as least, max(n) as most from (select source, {N_ENTITIES.format('step')} as n from train_with_rag) group by source")
def a06_percentiles(spark, folder):
    n = train(spark, folder).select("source", T.entity_count(F.col("step")).alias("n"))
    return n.groupBy("source").agg(*(M.percentile(F.col("n"), p / 100).alias(f"p{p}") for p in _PERCENTS), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


_FLOOR = {"p25": (1, 4), "median": (1, 2), "p75": (3, 4), "p90": (9, 10), "p99": (99, 100)}


@C.add(
    "with v as (select list_sort(list(entities)) as s, count(*) as n from file_validation where ok and entities is not null) select "
    + ", ".join(f"s[(n * {a}) // {b} + 1] as {k}" for k, (a, b) in _FLOOR.items()) + " from v"
)
def a07_floor_percentiles(spark, folder):
    return M.floor_quantiles(table(spark, folder, "file_validation").filter("ok"), "entities", _FLOOR)


@C.add("with v as (select list_sort(list(length(step))) as s, count(step) as n from train_with_rag where step is not null) select s[n // 2 + 1] as upper_median from v")
def a08_upper_median(spark, folder):
    return M.floor_quantiles(train(spark, folder).select(F.length("step").alias("n")), "n", {"upper_median": (1, 2)})


@C.add(
    """select count(*) as n, count_if(ok) as n_ok, count_if(not ok) as n_failed, count_if(ok and entities = 0) as n_empty, count_if(ok and entities < 500) as n_pass, count_if(ok and entities >= 500) as n_filtered,
    round(100.0 * count_if(ok) / count(*), 1) as ok_percent, case when count_if(not ok) = 0 then 'clean' when count_if(not ok) / count(*) < 0.01 then 'negligible' else 'investigate' end as verdict from file_validation"""
)
def a09_validation_rollup(spark, folder):
    ok, n = F.col("ok"), F.col("entities")
    failed = F.count_if(~ok)
    return table(spark, folder, "file_validation").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), failed.alias("n_failed"), F.count_if(ok & (n == 0)).alias("n_empty"), F.count_if(ok & (n < 500)).alias("n_pass"),
        F.count_if(ok & (n >= 500)).alias("n_filtered"), F.round(F.lit(100.0) * F.count_if(ok) / F.count("*"), 1).alias("ok_percent"),
        F.when(failed == 0, "clean").when(failed / F.count("*") < 0.01, "negligible").otherwise("investigate").alias("verdict"),
    )


@C.add(
    rf"""with d as (select source, {N_ENTITIES.format('step')} as gen, {N_ENTITIES.format('retrieved_step')} as gt, octet_length(encode(step)) as l, octet_length(encode(retrieved_step)) as lg,
      coalesce(not ends_with(list_filter(list_transform(string_split(step, chr(10)), lambda x: {trimmed("x")}), lambda x: x <> '')[-1], ';'), false) as cut
      from train_with_rag where step is not null and retrieved_step is not null),
    g as (select source, count(*) as n, avg(cut::int) as cut_rate, avg(gen / greatest(gt, 1)) as er, avg(l / greatest(lg, 1)) as tr from d group by source)
    select source, n, round(cut_rate, 6) as cut_rate, round(er, 6) as entity_ratio, round(tr, 6) as token_ratio from g"""
)
def a14_generation_diagnosis(spark, folder):
    """Texts cut inside a statement, and mean ratios of entities and byte tokens to those of the truth."""
    gen, gt = T.entity_count(F.col("step")), T.entity_count(F.col("retrieved_step"))
    d = train(spark, folder).filter("step is not null and retrieved_step is not null")
    ratio = lambda a, b: F.round(F.avg(a / F.greatest(b, F.lit(1))), 6)
    return d.groupBy("source").agg(
        F.count("*").alias("n"), M.rate(T.cut_mid_entity(F.col("step"))).alias("cut_rate"), ratio(gen, gt).alias("entity_ratio"),
        ratio(K.byte_count(F.col("step")), K.byte_count(F.col("retrieved_step"))).alias("token_ratio"),
    )


@C.add(
    f"""with {SCORES} select status, count_if({FINITE}) as n_ok, count_if(not ({FINITE})) as n_failed, round(median(scd) filter ({FINITE}), 6) as median, round(avg(scd) filter ({FINITE}), 6) as mean,
    round(min(scd) filter ({FINITE}), 6) as least, round(quantile_cont(scd, 0.25) filter ({FINITE}), 6) as p25, round(quantile_cont(scd, 0.75) filter ({FINITE}), 6) as p75, round(quantile_cont(scd, 0.9) filter ({FINITE}), 6) as p90,
    round(max(scd) filter ({FINITE}), 6) as most from scores group by status"""
)
def a15_scd_distribution(spark, folder):
    rows = scores(spark, folder).select("status", F.when(M.finite(F.col("scd")), F.col("scd")).alias("scd"))
    quantiles = M.group_quantiles(rows, "status", "scd", {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9})
    scd = F.col("scd")
    plain = rows.groupBy("status").agg(
        F.count(scd).alias("n_ok"), F.count_if(scd.isNull()).alias("n_failed"), F.round(F.avg(scd), 6).alias("mean"), F.round(F.min(scd), 6).alias("least"), F.round(F.max(scd), 6).alias("most")
    )
    names = ("median", "p25", "p75", "p90")
    return plain.join(quantiles, "status", "left").select(*plain.columns, *(F.round(x, 6).alias(x) for x in names))


@C.add(
    f"""with {SCORES}, f as (select idx, if({FINITE}, scd, null) as scd from scores), p as (select a.scd as s, b.scd as r from f a join f b on b.idx = a.idx + 1 where a.idx % 2 = 0)
    select case when s is null and r is null then 'both failed' when s is null then 'only b' when r is null then 'only a' when abs(r - s) < 1e-4 then 'same' when r < s then 'better' else 'worse' end as verdict, count(*) as n from p group by 1"""
)
def a16_verdicts(spark, folder):
    f = scores(spark, folder).select("idx", F.when(M.finite(F.col("scd")), F.col("scd")).alias("scd"))
    a, b = f.filter("idx % 2 = 0").withColumnRenamed("scd", "s"), f.select((F.col("idx") - 1).alias("idx"), F.col("scd").alias("r"))
    s, r = F.col("s"), F.col("r")
    verdict = F.when(s.isNull() & r.isNull(), "both failed").when(s.isNull(), "only b").when(r.isNull(), "only a").when(F.abs(r - s) < 1e-4, "same").when(r < s, "better").otherwise("worse")
    return a.join(b, "idx").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


_REWARD = "case when {0} is null or not isfinite({0}) then 0.0 when {0} <= 0.01 then 1.0 when {0} >= 0.5 then 0.0 else (0.5 - {0}) / 0.49 end"


@C.add(
    f"""with {SCORES}, r as (select run, status, if({FINITE}, scd, null) as scd, {_REWARD.format('scd')} as reward from scores),
    h as (select run, string_agg(status || '=' || n, ', ' order by status) as stages from (select run, status, count(*) as n from r group by all) group by run)
    select r.run, count_if(reward > 0) as n_nonzero, round(avg(reward), 6) as mean, round(median(scd), 6) as median_scd, any_value(stages) as stages from r join h using (run) group by r.run"""
)
def a17_reward_summary(spark, folder):
    scd = F.when(M.finite(F.col("scd")), F.col("scd"))
    reward = R.sane(R.geometric_reward(scd))
    by = scores(spark, folder).select("run", "status", scd.alias("scd"), reward.alias("reward"))
    stages = by.groupBy("run", "status").agg(F.count("*").alias("n")).groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("status", "n"))), lambda x: F.concat_ws("=", x["status"], x["n"])), ", ").alias("stages"))
    medians = M.group_quantiles(by, "run", "scd", {"median_scd": 0.5}).select("run", F.round("median_scd", 6).alias("median_scd"))
    plain = by.groupBy("run").agg(F.count_if(F.col("reward") > 0).alias("n_nonzero"), F.round(F.avg("reward"), 6).alias("mean"))
    return plain.join(medians, "run", "left").join(stages, "run")


@C.add(f"with f as (select source, {N_ENTITIES.format('step')} as n, if(contains(step, 'END-ISO-10303-21;') and {N_ENTITIES.format('step')} >= 138, 0.2, 0.0) as r from train_with_rag) select source, count_if(r > 0) as n_nonzero, round(avg(r), 6) as mean, round(avg(n), 6) as mean_entities from f group by source")
def a18_format_reward(spark, folder):
    n = T.entity_count(F.col("step"))
    f = train(spark, folder).select("source", n.alias("n"), R.format_reward(T.has_terminator(F.col("step")), n).alias("r"))
    return f.groupBy("source").agg(F.count_if(F.col("r") > 0).alias("n_nonzero"), F.round(F.avg("r"), 6).alias("mean"), F.round(F.avg("n"), 6).alias("mean_entities"))


@C.add(f"with {LOSSES} select run, epoch, round(avg(value), 6) as mean, min(value) as least, max(value) as most, floor(epoch(max(ts)))::bigint - floor(epoch(min(ts)))::bigint as seconds from losses group by all")
def a19_epoch_summary(spark, folder):
    seconds = lambda x: F.unix_seconds(F.col(x).cast("timestamp"))
    ends = losses(spark, folder).groupBy("run", "epoch").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return ends.select("run", "epoch", "mean", "least", "most", (seconds("b") - seconds("a")).alias("seconds"))


@C.add(
    f"""with {LOSSES} select run, round(quantile_cont(value, 0.95), 6) as p95, max(value) as most, round(avg(value), 6) as mean, max(lr) as peak_lr, arg_max(step, (lr, -step)) as peak_step,
    arg_max(lr, step) as last_lr, arg_max(value, step) as last_loss from losses group by run"""
)
def a20_run_peaks(spark, folder):
    log = losses(spark, folder)
    p95 = M.group_quantiles(log, "run", "value", {"p95": 0.95}).select("run", F.round("p95", 6).alias("p95"))
    plain = log.groupBy("run").agg(
        F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"), F.max("lr").alias("peak_lr"),
        F.max_by("step", F.struct("lr", -F.col("step"))).alias("peak_step"), F.max_by("lr", "step").alias("last_lr"), F.max_by("value", "step").alias("last_loss"),
    )
    return plain.join(p95, "run", "left")


@C.add(f"with {_EPOCHS} select doc_id, epoch, round(avg - min, 6) as below, round(max - avg, 6) as above from epochs")
def a21_error_bars(spark, folder):
    return epochs(spark, folder).select("doc_id", "epoch", F.round(F.col("avg") - F.col("min"), 6).alias("below"), F.round(F.col("max") - F.col("avg"), 6).alias("above"))


@C.add(
    rf"""with c as (select source, case when contains(step, 'END-ISO-10303-21;') then 'EOS' when not ends_with({trimmed('step')}, ';') then 'TRUNC' else 'OTHER' end as outcome from train_with_rag where step is not null)
    select source, outcome, count(*) as n, case when 100.0 * max(e) / max(t) >= 50 then 'go' when 100.0 * max(e) / max(t) >= 20 then 'weak' else 'no-go' end as verdict
    from (select *, count_if(outcome = 'EOS') over (partition by source) as e, count(*) over (partition by source) as t from c) group by source, outcome"""
)
def a22_outcomes(spark, folder):
    step = F.col("step")
    outcome = F.when(T.has_terminator(step), "EOS").when(~T.trim_space(step).endswith(";"), "TRUNC").otherwise("OTHER")
    n = train(spark, folder).filter("step is not null").groupBy("source", outcome.alias("outcome")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("source")
    share = F.lit(100.0) * F.sum(F.when(F.col("outcome") == "EOS", F.col("n")).otherwise(0)).over(by) / F.sum("n").over(by)
    return n.withColumn("verdict", F.when(share >= 50, "go").when(share >= 20, "weak").otherwise("no-go"))


#: The text of a training row: a caption, and where a retrieved one is known a header and that one.
_TEXT = "caption || coalesce(chr(10) || '### output:' || chr(10) || retrieved_caption, '')"
_IDS = f"list_transform(regexp_extract_all(hex(encode({_TEXT})), '..'), lambda h: ((instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1)::int)"
HEADER = list(b"### output:\n")
_AFTER = f"coalesce(list_filter(generate_series(1, len(ids) - {len(HEADER) - 1}), lambda i: ids[i:i + {len(HEADER) - 1}] = {HEADER}::int[])[1] + {len(HEADER) - 1}, -1)"
_ROWS = f"ids as (select row_id, {_IDS} as ids from train_with_rag where caption is not null), k as (select *, {_AFTER} as k from ids)"
_LABELS = "if(k < 0, list_transform(ids, lambda x: -100), list_concat(list_transform(ids[1:k], lambda x: -100), ids[k + 1:]))"


def token_rows(spark, folder) -> DataFrame:
    """The byte tokens of each row's whole text."""
    text = F.concat("caption", F.coalesce(F.concat(F.lit("\n### output:\n"), "retrieved_caption"), F.lit("")))
    return train(spark, folder).filter("caption is not null").select("row_id", K.byte_ids(text).alias("ids"))


@C.add(f"with {_ROWS}, l as (select *, {_LABELS} as labels from k) select row_id, round(len(list_filter(labels, lambda x: x <> -100)) / nullif(len(labels), 0), 6) as share from l")
def a23_unmasked_share(spark, folder):
    return token_rows(spark, folder).select("row_id", K.unmasked_share(K.labels(F.col("ids"), HEADER)).alias("share"))


@C.add(f"with {LOSSES} select run, max(step) as step, arg_max(event_type, step) as event_type, arg_max(value, step) as value from losses group by run")
def a24_final_step(spark, folder):
    last = losses(spark, folder).groupBy("run").agg(F.max_by(F.struct("step", "event_type", "value"), "step").alias("x"))
    return last.select("run", "x.step", "x.event_type", "x.value")


@C.add("select case when ok then 'ok' when ok is null then 'skip' else 'fail' end as status, count(*) as n from file_validation group by 1")
def a25_tally(spark, folder):
    status = F.when(F.col("ok"), "ok").when(F.col("ok").isNull(), "skip").otherwise("fail")
    return table(spark, folder, "file_validation").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


# ---- windows


@C.add(f"with {LOSSES} select run, step, round(avg(value) over (partition by run order by ts, step rows between 99 preceding and current row), 8) as mean from losses")
def w01_trailing_mean(spark, folder):
    day = F.date_trunc("day", "ts")
    return W.trailing_mean(losses(spark, folder), "run", ["ts", "step"], day, "value").select("run", "step", "mean")


_RUNNING = f"""{SCORES}, w as (select run, idx, round(avg((scd is not null)::int) over o, 6) as rr, round(median(if({FINITE}, scd, null)) over o, 6) as mscd from scores
  window o as (partition by run order by idx rows between unbounded preceding and current row))"""


def running(spark, folder) -> DataFrame:
    scd = F.when(M.finite(F.col("scd")), F.col("scd"))
    rows = scores(spark, folder).select("run", "idx", scd.alias("scd"))
    return W.running_medians(rows, "run", "idx", "scd").select("run", "idx", F.round("median", 6).alias("mscd"))


@C.add(f"with {_RUNNING} select run, idx, rr from w")
def w02_running_rate(spark, folder):
    found = W.running_rate(scores(spark, folder), "run", ["idx"], W.stretch(F.col("idx")), F.col("scd").isNotNull())
    return found.select("run", "idx", F.col("rate").alias("rr"))


@C.add(f"with {_RUNNING} select run, idx, mscd from w")
def w03_running_median(spark, folder):
    return running(spark, folder)


@C.add(f"with {_RUNNING} select run, min(rr) as rr_low, max(rr) as rr_high, min(mscd) as mscd_low, max(mscd) as mscd_high from w group by run")
def w04_running_range(spark, folder):
    rates = w02_running_rate(spark, folder).groupBy("run").agg(F.min("rr").alias("rr_low"), F.max("rr").alias("rr_high"))
    medians = running(spark, folder).groupBy("run").agg(F.min("mscd").alias("mscd_low"), F.max("mscd").alias("mscd_high"))
    return rates.join(medians, "run")


_CHANNELS = """log as (select user_id % 7 as run, event_id as step, case when event_type in ('view', 'click') then 0.0 when event_type = 'purchase' then value end as parse,
  case when event_type in ('view', 'purchase') then 0.0 when event_type = 'signup' then value end as scd from events),
c as (select *, (parse is not null or scd is not null) and coalesce(parse, 0) = 0 and coalesce(scd, 0) = 0 as counts, coalesce(parse, 0) <> 0 or coalesce(scd, 0) <> 0 as resets from log)"""
_STREAK = """, i as (select *, sum(resets::int) over (partition by {0} order by step) as island from {1}),
s as (select *, coalesce(sum(counts::int) over (partition by {0}, island order by step), 0)::bigint as streak from i)
select run, step, streak, case when not counts then 'none' when streak >= {3} then 'fatal' when streak = {2} then 'warn' else 'none' end as alarm from s"""


def channels(spark, folder) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    parse = F.when(kind.isin("view", "click"), 0.0).when(kind == "purchase", value)
    scd = F.when(kind.isin("view", "purchase"), 0.0).when(kind == "signup", value)
    log = table(spark, folder, "events").select((F.col("user_id") % 7).alias("run"), F.col("event_id").alias("step"), parse.alias("parse"), scd.alias("scd"))
    some = F.col("parse").isNotNull() | F.col("scd").isNotNull()
    fires = (F.coalesce("parse", F.lit(0.0)) != 0) | (F.coalesce("scd", F.lit(0.0)) != 0)
    return log.withColumns({"counts": some & ~fires, "resets": fires})


@C.add(f"with {_CHANNELS}" + _STREAK.format("run", "c", 5, 8))
def w05_zero_streaks(spark, folder):
    log = channels(spark, folder)
    return W.zero_streaks(log, "run", "step", W.stretch(F.col("step")), F.col("counts"), F.col("resets"), 5, 8).select("run", "step", "streak", "alarm")


@C.add((f"with {_CHANNELS}" + _STREAK.format("run", "c", 5, 8)).replace("select run, step, streak", "select run::varchar as run, step as seq, streak"))
def w05_streaming_alarms(spark, folder):
    """The same alarms from a stream of the log, run until it is read up."""
    source, sink = scratch(spark, "log"), scratch(spark, "alarms")
    log = channels(spark, folder).select(F.col("run").cast("string").alias("run"), F.col("step").alias("seq"), "counts", "resets")
    log.write.parquet(source)
    stream = streak_alarms(spark.readStream.schema(log.schema).parquet(source), 5, 8)
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


@C.add(f"with {LOSSES}, c as (select *, loss = 0 as counts, not isnan(loss) and loss <> 0 as resets from losses)" + _STREAK.format("run", "c", 2, 3).replace("case when not counts", "case when isnan(loss) then 'stop' when not counts"))
def w06_loss_guard(spark, folder):
    log, loss = losses(spark, folder), F.col("loss")
    out = W.zero_streaks(log, "run", "step", W.stretch(F.col("step")), loss == 0, ~F.isnan(loss) & (loss != 0), 2, 3)
    return out.select("run", "step", "streak", F.when(F.isnan(loss) | (F.abs(loss) == float("inf")), "stop").otherwise(F.col("alarm")).alias("alarm"))


@C.add((f"with {LOSSES}, c as (select *, loss = 0 as counts, not isnan(loss) and loss <> 0 as resets from losses)" + _STREAK.format("run", "c", 2, 3).replace("case when not counts", "case when isnan(loss) then 'stop' when not counts")).replace("select run, step, streak", "select run::varchar as run, step as seq, streak"))
def w06_streaming_guard(spark, folder):
    """The loss guard over a stream of the log, stops included."""
    source, sink = scratch(spark, "losses"), scratch(spark, "guard")
    loss = F.col("loss")
    log = losses(spark, folder).select(
        F.col("run").cast("string").alias("run"), F.col("step").alias("seq"), (loss == 0).alias("counts"), (~F.isnan(loss) & (loss != 0)).alias("resets"), (F.isnan(loss) | (F.abs(loss) == float("inf"))).alias("stops")
    )
    log.write.parquet(source)
    stream = streak_alarms(spark.readStream.schema(log.schema).parquet(source), 2, 3)
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


@C.add("select user_id % 7 as run, max(event_id) as step, 'run/checkpoint-' || max(event_id) as latest from events group by 1")
def w07_latest_checkpoint(spark, folder):
    paths = table(spark, folder, "events").select((F.col("user_id") % 7).alias("run"), F.concat(F.lit("run/checkpoint-"), F.col("event_id")).alias("path"))
    return W.latest_checkpoint(paths, "run", "path")


# ---- token rows


@C.add("select row_id, left(retrieved_caption, list_max(list_filter(range(0, 201), lambda k: octet_length(encode(left(retrieved_caption, k))) <= 200))) as cut from train_with_rag where retrieved_caption is not null")
def k01_truncated_retrieval(spark, folder):
    """At most 200 byte tokens of the retrieved text (the limit is the feature)."""
    return train(spark, folder).filter("retrieved_caption is not null").select("row_id", K.cut_text(F.col("retrieved_caption"), 200).alias("cut"))


@C.add("select row_id, md5(concat_ws('|', caption, retrieved_caption)) as prompt, true as reused from train_with_rag")
def k07_formatted(spark, folder):
    """Prompts formatted once and read again under their parameters' key; other parameters have another key."""
    base = scratch(spark, "formatted")
    make = lambda: train(spark, folder).select("row_id", F.md5(F.concat_ws("|", "caption", "retrieved_caption")).alias("prompt"))
    _, fresh = K.formatted(spark, base, (folder, "512", "v1"), make)
    rows, reused = K.formatted(spark, base, (folder, "512", "v1"), make)
    _, other = K.formatted(spark, base, (folder, "256", "v1"), make)
    return rows.withColumn("reused", F.lit(reused and not fresh and not other))


@C.add(f"with {_ROWS} select row_id, k from k")
def k02_after_header(spark, folder):
    return token_rows(spark, folder).select("row_id", K.after_header(F.col("ids"), HEADER).alias("k"))


@C.add(f"with {_ROWS} select row_id, {_LABELS} as labels from k")
def k03_labels(spark, folder):
    return token_rows(spark, folder).select("row_id", K.labels(F.col("ids"), HEADER).alias("labels"))


@C.add(f"with {_ROWS} select row_id, ids[1:512] as ids from ids")
def k04_truncated(spark, folder):
    """At most 512 tokens (the limit is the feature)."""
    return token_rows(spark, folder).select("row_id", K.truncated(F.col("ids"), 512).alias("ids"))


@C.add(f"with {_ROWS}, w as (select *, max(len(ids)) over (partition by row_id // 16) as width from ids) select row_id, list_concat(ids, list_transform(range(width - len(ids)), lambda x: 0::int)) as ids from w")
def k05_padded(spark, folder):
    """Batches of sixteen, each padded to its longest row."""
    rows = token_rows(spark, folder)
    return rows.select("row_id", K.batched(F.col("ids"), F.floor(F.col("row_id") / 16)).alias("ids"))


@C.add(f"with {_ROWS} select row_id, greatest(256, 1024 - len(ids) - 64) as budget from ids")
def k06_generation_budget(spark, folder):
    return token_rows(spark, folder).select("row_id", K.generation_budget(F.size("ids"), 1024).alias("budget"))


@C.add("select vec_id, list_transform(embedding, lambda x: round(x::double / sqrt(list_dot_product(embedding::double[], embedding::double[])), 6)) as unit from embeddings")
def k09_unit_vectors(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.transform(V.unit(F.col("embedding")), lambda x: F.round(x, 6)).alias("unit"))


# ---- geometry and rewards

_POINTS = "pt as (select vec_id as id, p, embedding[3 * p + 1]::double as x, embedding[3 * p + 2]::double as y, embedding[3 * p + 3]::double as z from embeddings, range(21) t(p))"
_CENTRE = "ce as (select id, avg(x) as cx, avg(y) as cy, avg(z) as cz from pt group by id), rm as (select id, sqrt(avg((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)) as rms from pt join ce using (id) group by id)"
_CD = """near as (select a.id, a.p, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as d from pt a join pt b on b.id = a.id + 1 group by all),
back as (select b.id - 1 as id, b.p, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as d from pt b join pt a on b.id = a.id + 1 group by all),
cd as (select id, n.d as fwd, n.d + b.d as cd from (select id, avg(d) as d from near group by id) n join (select id, avg(d) as d from back group by id) b using (id))"""


def clouds(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), R.points(F.col("embedding")).alias("cloud"))


def cloud_pairs(spark, folder) -> DataFrame:
    """Each cloud with the next one: (id, a, b), where b is the truth."""
    c = clouds(spark, folder)
    return c.select("id", F.col("cloud").alias("a")).join(c.select((F.col("id") - 1).alias("id"), F.col("cloud").alias("b")), "id")


def scored_pairs(spark, folder) -> DataFrame:
    cd = cloud_pairs(spark, folder).select("id", "b", R.chamfer(F.col("a"), F.col("b")).alias("cd"))
    return cd.select("id", "cd", R.scaled(F.col("cd"), R.rms(F.col("b"), R.centroid(F.col("b")))).alias("scd"))


@C.add(f"with {_POINTS}, {_CD} select id, round(fwd, 6) as mean_d2 from cd")
def j12_nearest_points(spark, folder):
    return cloud_pairs(spark, folder).select("id", F.round(R.nearest_mean(F.col("a"), F.col("b")), 6).alias("mean_d2"))


@C.add(
    f"""with {_POINTS}, v as (select a.id, b.x - a.x as ux, b.y - a.y as uy, b.z - a.z as uz, c.x - a.x as vx, c.y - a.y as vy, c.z - a.z as vz from pt a join pt b on b.id = a.id and b.p = 1 join pt c on c.id = a.id and c.p = 2 where a.p = 0)
    select id, round(0.5 * sqrt((uy * vz - uz * vy) ** 2 + (uz * vx - ux * vz) ** 2 + (ux * vy - uy * vx) ** 2), 6) as area from v"""
)
def r03_triangle_area(spark, folder):
    p = F.col("cloud")
    n = R.cross(p[0], p[1], p[2])
    return clouds(spark, folder).select("id", F.round(0.5 * F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]), 6).alias("area"))


@C.add()
def r02_sampled_points(spark, folder):
    """64 points on the seven triangles of each cloud."""
    c = clouds(spark, folder).withColumn("triangles", F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.slice(F.col("cloud"), i * 3 + 1, F.lit(3))))
    return R.sampled_points(c.withColumn("seed", F.col("id")), 64).select("id", F.size("cloud").alias("n"), F.md5(F.to_json("cloud")).alias("cloud"))


@C.add("select vec_id as id, 84 + 50 * 7 as n_bytes, 7::bigint as n_triangles from embeddings")
def s21_stl(spark, folder):
    """The seven triangles of each cloud as STL files; the number of triangles is read from the files."""
    c = clouds(spark, folder).select("id", F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.slice(F.col("cloud"), i * 3 + 1, F.lit(3))).alias("triangles"))
    return R.stl(c).select("id", F.octet_length("stl").alias("n_bytes"), F.conv(F.substring(F.hex("stl"), 161, 2), 16, 10).cast("bigint").alias("n_triangles"))


@C.add("select n_points, delta_low, delta_high, bidirectional, scale_prenorm, deflection from (values (500, 0.02::double, 0.25::double, true, true, null::double)) v(n_points, delta_low, delta_high, bidirectional, scale_prenorm, deflection)")
def r16_reward_config(spark, folder):
    """A reward's settings read from a nested configuration over their defaults."""
    config = S.load_config("rl:\n  reward:\n    n_points: 500\n    delta_low: '0.02'\n    delta_high: 0.25\n")
    given = {k.removeprefix("rl.reward."): v for k, v in config.items()}
    made = R.RewardConfig(int(given["n_points"]), float(given["delta_low"]), float(given["delta_high"]))
    return spark.createDataFrame([tuple(vars(made).values())], "n_points int, delta_low double, delta_high double, bidirectional boolean, scale_prenorm boolean, deflection double")


@C.add()
def r13_scored_texts(spark, folder):
    """Whole scoring of each text against its retrieved one; triangles of consecutive points stand for the mesh that no kernel makes here."""
    pairs = spread(train(spark, folder).select(F.col("row_id").alias("id"), F.col("step").alias("pred"), F.col("retrieved_step").alias("gt")), "id")
    found = R.scored_texts(pairs, R.point_fan, R.RewardConfig(n_points=128))
    return found.select("id", "stage", "n_triangles", F.round("scd", 6).alias("scd"), "parse", F.round("reward", 6).alias("reward"))


@C.add()
def r07_registered(spark, folder):
    found = R.registered_pairs(cloud_pairs(spark, folder))
    return found.select("id", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@C.add(f"with {_POINTS}, {_CENTRE} select id, round(cx, 6) + 0.0 as cx, round(cy, 6) + 0.0 as cy, round(cz, 6) + 0.0 as cz, round(rms, 6) as rms from ce join rm using (id)")
def r05_centroid_scale(spark, folder):
    c = F.col("cloud")
    centre = R.centroid(c)
    return clouds(spark, folder).select("id", *((F.round(x, 6) + 0.0).alias(n) for x, n in zip(centre, ("cx", "cy", "cz"))), F.round(R.rms(c, centre), 6).alias("rms"))


@C.add(f"with {_POINTS}, {_CD} select id, round(cd, 6) as cd from cd")
def r08_chamfer(spark, folder):
    return cloud_pairs(spark, folder).select("id", F.round(R.chamfer(F.col("a"), F.col("b")), 6).alias("cd"))


@C.add(f"with {_POINTS}, {_CD} select id, round(cd, 6) as cd from cd")
def r08_chamfer_blocked(spark, folder):
    return R.chamfer_blocked(cloud_pairs(spark, folder)).withColumn("cd", F.round("cd", 6))


_SCD = f"{_POINTS}, {_CENTRE}, {_CD}, sc as (select cd.id, cd / (rms * rms) as scd from cd join rm on rm.id = cd.id + 1)"


@C.add(f"with {_SCD} select id, round(scd, 5) as scd from sc")
def r09_scd_unaligned(spark, folder):
    """Without registration this is another metric than the aligned one; hence the name."""
    return scored_pairs(spark, folder).select("id", F.round("scd", 5).alias("scd"))


@C.add(f"with {SCORES} select idx, round({_REWARD.format('scd')}, 6) as reward from scores where {FINITE}")
def r10_geometric_reward(spark, folder):
    return scores(spark, folder).filter(M.finite(F.col("scd"))).select("idx", F.round(R.geometric_reward(F.col("scd")), 6).alias("reward"))


@C.add(f"select row_id, if(contains(step, 'END-ISO-10303-21;') and {N_ENTITIES.format('step')} >= 4 and entity_count >= 10, 0.3, 0.0) as reward from train_with_rag")
def r11_parse_reward(spark, folder):
    """The counts of entities stand for those of triangles and points."""
    return train(spark, folder).select("row_id", R.parse_reward(T.has_terminator(F.col("step")), T.entity_count(F.col("step")), F.col("entity_count")).alias("reward"))


@C.add(f"select row_id, if(contains(step, 'END-ISO-10303-21;') and {N_ENTITIES.format('step')} >= 138, 0.2, 0.0) as reward from train_with_rag")
def r12_format_reward(spark, folder):
    return train(spark, folder).select("row_id", R.format_reward(T.has_terminator(F.col("step")), T.entity_count(F.col("step"))).alias("reward"))


@C.add(
    f"""with {SCORES}, s as (select idx, scd, case when idx % 11 = 0 then 'no_terminator' when idx % 13 = 0 then 'pred_parse' when idx % 17 < 4 or idx % 40 < 10 then 'pred_degenerate' when idx % 19 = 0 then 'gt_parse'
      when idx % 23 < 4 then 'gt_degenerate' when not ({FINITE}) then 'scd_nonfinite' else 'ok' end as stage from scores)
    select idx, stage, round(case when stage = 'ok' then {_REWARD.format('scd')} when stage in ('gt_parse', 'gt_degenerate', 'scd_nonfinite') then 'nan'::double else 0.0 end, 6) as reward from s"""
)
def r13_full_reward(spark, folder):
    """The stages are set by the index, so that each of them occurs."""
    i = F.col("idx")
    stage = R.fail_stage(i % 11 != 0, F.when(i % 13 != 0, i % 40), i % 17, F.when(i % 19 != 0, F.lit(99)), i % 23, F.col("scd"))
    return scores(spark, folder).select("idx", stage.alias("stage"), F.round(R.full_reward(stage, F.col("scd")), 6).alias("reward"))


@C.add(f"with {SCORES} select idx, if({FINITE}, scd, 0.0) as reward from scores")
def r14_sane_reward(spark, folder):
    return scores(spark, folder).select("idx", R.sane(F.col("scd")).alias("reward"))


@C.add("select count(distinct retrieved_step) as n_distinct, count(retrieved_step) as n_rows, count(retrieved_step) - count(distinct retrieved_step) as n_saved from train_with_rag")
def r15_distinct_truths(spark, folder):
    """What computing once per distinct truth saves."""
    n = train(spark, folder).filter("retrieved_step is not null").groupBy(F.sha2("retrieved_step", 256).alias("h")).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n_rows"), (F.sum("n") - F.count("*")).alias("n_saved"))


@C.add(f"with {_POINTS} select id, round(min(x), 6) as x0, round(max(x), 6) as x1, round(min(y), 6) as y0, round(max(y), 6) as y1, round(min(z), 6) as z0, round(max(z), 6) as z1, round(greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)), 6) as side from pt group by id")
def r17_bounding_box(spark, folder):
    c = F.col("cloud")
    axis = [F.transform(c, R.on_axis(k)) for k in range(3)]
    ends = [(F.array_min(a), F.array_max(a)) for a in axis]
    columns = {f"{n}{i}": F.round(e[i], 6) for n, e in zip("xyz", ends) for i in (0, 1)}
    return clouds(spark, folder).select("id", *(x.alias(k) for k, x in columns.items()), F.round(F.greatest(*(b - a for a, b in ends)), 6).alias("side"))


def queries() -> dict:
    return C.queries


def oracle_sql() -> dict[str, str]:
    return C.sql
