"""Sources and sinks of the corpus: STEP folders, records, captions, logs, indexes (S family).

Readers and writers go through Spark's file sources or, file by file in the workers, through the
folder's own file system, so they split over executors; what a driver writes as one file is said so in its docstring.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brepflow.functions import text as T
from brepflow.sources import shared

CAPTIONS = "uid string, abstract string, beginner string, intermediate string, expert string"
LOSSES = "timestamp string, step int, epoch double, loss double, learning_rate double, grad_norm double"
#: Texts that a caption table's reader takes as missing; fixed values.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
EPOCH_LINE = r"EPOCH\s+(\d+)\s+COMPLETE\s*\|.*?(\d+\.\d+)\s*min.*?loss avg=([\d.]+)\s+min=([\d.]+)\s+max=([\d.]+)"


def _plain(path: Column) -> Column:
    """A path with one slash after ``file:``."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def listed(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """(path, length) of the files of a folder, empty ones included; contents are not read.

    Spark's scans leave files of length 0 out, so these are added from the scan's own file index, whose
    paths the driver's JVM holds for any scan.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    full = files.select(_plain(F.col("path")).alias("path"), "length")
    jvm = spark._jvm
    paths = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(files._jdf.inputFiles())
    every = DataFrame(spark._jsparkSession.createDataset(paths, jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark).select(_plain(F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B")))).alias("path")).distinct()
    empty = every.join(full.select("path"), "path", "left_anti")
    return full.unionByName(empty.withColumn("length", F.lit(0).cast("bigint")))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 where they are not valid UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def read_steps(spark: SparkSession, folder: str, first: int | None = None, recursive: bool = False) -> DataFrame:
    """(path, rel_path, uid, text) of the STEP files of a folder, empty ones included; optionally the first n by path."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.step").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(folder).select(_plain(F.col("path")).alias("path"), decoded(F.col("content")).alias("text"))
    empty = listed(spark, folder, "*.step", recursive).filter("length = 0").select("path", F.lit("").alias("text"))
    rel = F.regexp_replace("path", "^.*?" + re.escape(re.sub("^file:/+", "/", folder).rstrip("/")) + "/", "")
    uid = F.replace(F.regexp_extract("path", r"([^/]+)\.step$", 1), F.lit("_"), F.lit("/"))
    out = files.unionByName(empty).select("path", rel.alias("rel_path"), uid.alias("uid"), "text")
    return out.orderBy("path").limit(first) if first is not None else out


def write_steps(texts: DataFrame, folder: str, skip_existing: bool = False) -> int:
    """(rel_path, text) as files, each written beside its place and then moved there; returns how many were written.

    Workers write through the folder's own file system (local, HDFS, object stores), which all executors must
    reach. With ``skip_existing`` a file that is there is left as it is. A null text is an empty file.
    """
    root = shared.qualified(texts.sparkSession, folder)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = shared.opened(root)
        for batch in batches:
            n = 0
            for rel_path, text in zip(batch.column("rel_path").to_pylist(), batch.column("text")):
                path = f"{base}/{rel_path}"
                if skip_existing and fs.get_file_info(path).type == FileType.File:
                    continue
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{path}.tmp") as f:
                    f.write(text.as_buffer() or b"")
                fs.move(f"{path}.tmp", path)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return texts.select("rel_path", "text").mapInArrow(put, "n bigint").agg(F.sum("n")).first()[0] or 0


def path_uid(path: Column) -> Column:
    """The uid of a file kept as ``.../root/a/b/stem.ext``: the fourth part from the end, and the stem."""
    parts = F.split(path, "/")
    return F.concat_ws("/", F.try_element_at(parts, F.lit(-4)), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""))


def export(items: DataFrame, exporter: Callable[[bytes], str] | None, done: DataFrame | None = None) -> DataFrame:
    """(uid, status, text) of items (uid, content): ok, fail, or skip for uids that are done; without an exporter ``backend_missing``."""
    schema = "uid string, status string, text string"

    def run(frames):
        for d in frames:
            status, text = [], []
            for content in d["content"]:
                try:
                    text.append(exporter(content) if exporter else None)
                    status.append("ok" if exporter else "backend_missing")
                except Exception:  # noqa: BLE001  one bad item is a tally, not the end of the job
                    text.append(None)
                    status.append("fail")
            yield d[["uid"]].assign(status=status, text=text)

    todo = pending(items, done) if done is not None else items
    out = todo.select("uid", "content").mapInPandas(run, schema)
    if done is not None:
        skipped = items.join(done.select("uid").distinct(), "uid", "left_semi")
        out = out.unionByName(skipped.select("uid", F.lit("skip").alias("status"), F.lit(None).cast("string").alias("text")))
    return out


def missing_as_null(x: Column) -> Column:
    """S05"""
    return F.when(~x.isin(*MISSING), x)


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """A caption CSV with quoted line breaks and doubled quotes."""
    raw = spark.read.schema(CAPTIONS).csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return raw.select(*(missing_as_null(F.col(c)).alias(c) for c in raw.columns))


def write_captions(captions: DataFrame, path: str) -> None:
    captions.write.csv(path, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def is_json_array(spark: SparkSession, path: str) -> bool:
    """Whether the file starts with ``[``."""
    row = spark.read.text(path).filter(F.trim("value") != "").select(F.left(F.trim("value"), F.lit(1)).alias("c")).first()
    return bool(row) and row["c"] == "["


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records from a JSON array or from JSON lines; blank lines are skipped."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=is_json_array(spark, path))


def write_records(records: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, in a folder per value of ``by`` where it is given."""
    writer = records.write.option("ignoreNullFields", "false")
    (writer.partitionBy(by) if by else writer).json(path)


def write_json_array(records: DataFrame, path: str, *order: str) -> int:
    """One JSON array (indent 2) in one file, in order, null fields kept; returns the number of records.

    Records are made into text by the executors; the one file is written by the driver, which holds one
    partition's text at a time.
    """
    spark = records.sparkSession
    line = F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false", "pretty": "true"})
    shown = records.orderBy(*order).select(F.replace(line, F.lit("\n"), F.lit("\n  ")).alias("j"))
    fs, to = shared.opened(shared.qualified(spark, path))
    n = 0
    with fs.open_output_stream(f"{to}.tmp") as f:
        f.write(b"[")
        for r in shown.toLocalIterator():
            f.write((",\n  " if n else "\n  ").encode() + r["j"].encode())
            n += 1
        f.write(b"\n]\n")
    fs.move(f"{to}.tmp", to)
    return n


def save_index(index: DataFrame, path: str, force: bool = False) -> None:
    """An index table with ``pos`` from 0; an existing one is refused unless forced."""
    index.write.mode("overwrite" if force else "errorifexists").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """An index table whose size agrees with its positions."""
    index = spark.read.parquet(path)
    size = index.agg(F.count("*").alias("n"), F.coalesce(F.max("pos") + 1, F.lit(0)).alias("top")).first()
    if size["n"] != size["top"]:
        raise ValueError(f"{size['n']} rows, but positions up to {size['top'] - 1}")
    return index


def pending(items: DataFrame, done: DataFrame, key: str = "uid") -> DataFrame:
    """The items that were not written yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def check_marker(spark: SparkSession, folder: str, style: str) -> None:
    """Write the folder's style, or refuse to mix another one in."""
    path = f"{folder.rstrip('/')}/_style"
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = files.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(files):
        held = spark.read.text(path).first()["value"]
        if held != style:
            raise ValueError(f"the folder holds {held}, not {style}")
    else:
        spark.createDataFrame([(style,)], "value string").coalesce(1).write.text(path)


def append_losses(rows: DataFrame, path: str) -> None:
    """Rows appended to a loss log; every file has its header."""
    rows.write.mode("append").csv(path, header=True)


def read_losses(spark: SparkSession, path: str) -> DataFrame:
    """A loss log without the rows that cannot be read (the whole row goes)."""
    return spark.read.schema(LOSSES).csv(path, header=True, mode="DROPMALFORMED").dropna(subset=["step", "epoch", "loss"])


def parsed_losses(raw: DataFrame) -> DataFrame:
    """S15 over string columns."""
    kinds = {"step": "int", "epoch": "double", "loss": "double", "learning_rate": "double", "grad_norm": "double"}
    return raw.select(*(F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in raw.columns)).dropna()


LOG_SCHEMA = "log_history array<struct<step:int, reward:double, `rewards/format_reward_fn`:double, `rewards/parse_reward_fn`:double, `rewards/reward_fn`:double>>"


def log_rows(states: Column) -> Column:
    """The log rows of a trainer-state text; absent keys are null."""
    return F.from_json(states, LOG_SCHEMA)["log_history"]


def epoch_rows(lines: Column) -> dict[str, Column]:
    """Fields of an epoch line; null where the line is none."""
    part = lambda i: F.nullif(F.regexp_extract(lines, "(?d)" + EPOCH_LINE, i), F.lit(""))
    return {"epoch": part(1).cast("int"), "minutes": part(2).cast("double"), "avg": part(3).cast("double"), "min": part(4).cast("double"), "max": part(5).cast("double")}


def unmatched(routed: DataFrame) -> DataFrame:
    """Share of unmatched records, and whether it is above 5 %."""
    share = F.round(F.avg((F.col("split") == "unmatched").cast("int")), 6)
    return routed.agg(F.count("*").alias("n"), F.count_if(F.col("split") == "unmatched").alias("n_unmatched"), share.alias("share"), (share > 0.05).alias("warn"))


_QUOTED = re.compile(r"""\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)')\s*(?:#.*)?\Z""")
_ENV = re.compile(r"\$\{oc\.env:(\w+)(?:,([^}]*))?\}")


def _scalar(text: str) -> str:
    """A value without its quotes or its comment; the environment is read outside single quotes."""
    if m := _QUOTED.match(text):
        if m.group(1) is None:
            return m.group(2).replace("''", "'")
        text = re.sub(r"\\(.)", r"\1", m.group(1))
    else:
        text = re.sub(r"(?:^|\s)#.*", "", text).strip()
    return os.path.expandvars(_ENV.sub(lambda m: os.environ.get(m.group(1), m.group(2) or ""), text))


def load_config(text: str, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Dotted keys of a nested configuration; overrides win.

    ``key: value`` lines indented by level; items of a list (``- item`` lines or ``[a, b]``) have their places as
    keys; ``${oc.env:NAME,default}`` and ``$NAME`` are read from the environment.
    """
    out: dict[str, str] = {}
    path: list[tuple[int, str]] = []
    places: dict[str, int] = {}
    for line in text.splitlines():
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        if body.startswith("- "):
            path = [p for p in path if p[0] < indent or not p[1].isdigit() and p[0] == indent]
            parent = ".".join(k for _, k in path)
            place = places.get(parent, 0)
            places[parent] = place + 1
            out[f"{parent}.{place}"] = _scalar(body[2:])
            continue
        key, colon, value = body.partition(":")
        if not colon:
            continue
        path = [p for p in path if p[0] < indent] + [(indent, key.strip())]
        name = ".".join(k for _, k in path)
        value = value.strip()
        if value.startswith("[") and value.endswith("]"):
            out |= {f"{name}.{i}": _scalar(x) for i, x in enumerate(filter(None, map(str.strip, value[1:-1].split(","))))}
        elif value and not value.startswith("#"):
            out[name] = _scalar(value)
    return out | (overrides or {})


def _escaped(x: object) -> str:
    return str(x).replace("&", "&amp;").replace("<", "&lt;")


def report(title: str, rows: DataFrame) -> str:
    """An HTML table of (few, aggregated) rows."""
    head = "".join(f"<th>{_escaped(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{_escaped(v)}</td>" for v in r) + "</tr>" for r in rows.collect())
    return f"<h1>{_escaped(title)}</h1><table><tr>{head}</tr>{body}</table>"


def write_case_report(title: str, cases: DataFrame, path: str) -> dict:
    """An inference report of few cases, as ``path``.json and ``path``.html; returns its summary.

    ``cases`` are rows of (caption, generated, gt). Each case has its caption, whether it is complete, the entities on
    both sides, and the types of both sides with their counts; counting is done by the executors.
    """
    types = lambda c: T.type_counts(F.col(f"{c}_types"))
    found = cases.select(
        "caption", F.coalesce(T.has_terminator(F.col("generated")), F.lit(False)).alias("complete"),
        *(F.coalesce(T.entity_count(F.col(c)), F.lit(0)).alias(f"n_{c}") for c in ("generated", "gt")),
        *(F.coalesce(T.entity_types(F.col(c)), F.array().cast("array<string>")).alias(f"{c}_types") for c in ("generated", "gt")),
    )
    rows = found.select("caption", "complete", "n_generated", "n_gt", types("generated").alias("generated"), types("gt").alias("gt")).collect()
    listed_cases = []
    for r in rows:
        sides = [{t["type"]: t["n"] for t in side} for side in (r["generated"], r["gt"])]
        topology = [{"type": t, "generated": sides[0].get(t, 0), "gt": sides[1].get(t, 0)} for t in sorted({*sides[0], *sides[1]})]
        listed_cases.append({"caption": r["caption"], "complete": r["complete"], "n_generated": r["n_generated"], "n_gt": r["n_gt"], "topology": topology})
    n = len(rows)
    summary = {"n": n, "completion_rate": sum(r["complete"] for r in rows) / n if n else 0.0, "mean_entities": sum(r["n_generated"] for r in rows) / n if n else 0.0}
    parts = [f"<h1>{_escaped(title)}</h1>", f"<p>{n} cases, completion rate {summary['completion_rate']:.3f}, {summary['mean_entities']:.1f} entities on average</p>"]
    for i, case in enumerate(listed_cases, 1):
        lines = "".join(f"<tr><td>{_escaped(t['type'])}</td><td>{t['generated']}</td><td>{t['gt']}</td></tr>" for t in case["topology"])
        state = "complete" if case["complete"] else "cut off"
        parts.append(f"<h2>Case {i} ({state})</h2><p>{_escaped(case['caption'] or '')}</p><table><tr><th>type</th><th>generated</th><th>truth</th></tr>{lines}</table>")
    fs, to = shared.opened(shared.qualified(cases.sparkSession, path))
    fs.create_dir(to.rpartition("/")[0], recursive=True)
    for suffix, content in ((".json", json.dumps({"title": title, "summary": summary, "cases": listed_cases}, ensure_ascii=False)), (".html", "\n".join(parts))):
        with fs.open_output_stream(to + suffix) as f:
            f.write(content.encode())
    return summary
