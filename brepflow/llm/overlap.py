"""Records of evaluation splits whose content is found again in training records.

The content of a val or test record is a set of hashes of its smallest units (a word with its
occurrence, a statement: n-grams with n = 1, since content has no order). A training record
that holds at least ``THRESHOLD`` of them misses at most ``n - ceil(THRESHOLD n)``, so among the
record's rarest ``missed + HITS`` hashes at least ``HITS`` are hit. Only those are partitioned
by hash and scanned against the training hashes; what reaches HITS is verified on the whole
contents. Hashes are ranked by their count over all training contents, so units that
every record holds are looked up only where nothing rarer is left. No hit is dropped or
capped: the result is exact.

Equal contents are one class on either side; large classes are split when they are expanded to rows. The engine broadcasts the evaluation hashes
where their measured size allows, and otherwise partitions them, splitting hot ones.

Defined cases: rows whose uid is null or in no array of the manifest are in no split; null or
empty arrays, and uids repeated in an array, are allowed; values without content are no cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brepflow.llm.content import PARITY
from brepflow.llm.neardup import THRESHOLD, expanded, verified
from brepflow.operators.orphans import same_uid
from brepflow.session import stage

HITS = 3


def splits(manifest: DataFrame) -> DataFrame:
    """(uid, split), distinct."""
    parts = [manifest.select(F.explode(name).alias("uid"), F.lit(name).alias("split")) for name in ("train", "val", "test")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select(same_uid(F.col("uid")).alias("uid"), "split").filter("uid is not null").distinct()


def rows_in_splits(train: DataFrame, manifest: DataFrame) -> DataFrame:
    """(row_id, split, source) of the rows that are in a split."""
    keyed = train.select("row_id", same_uid(F.col("uid")).alias("uid"), "source")
    return keyed.join(splits(manifest), "uid").select("row_id", "split", "source")


def contained_classes(contents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (field, a, b): at least ``threshold`` of evaluation content a is in training content b."""
    has = contents.groupBy("cid").agg(
        F.first("field").alias("field"), F.first("n").alias("n"), F.first("elems").alias("elems"),
        F.max(F.col("split") == "train").alias("trains"), F.max(F.col("split") != "train").alias("evaluates"),
    )
    distinct = stage(has, "split-classes")
    training = distinct.filter("trains").select(F.col("cid").alias("b"), F.explode("elems").alias("e"))
    asked = distinct.filter("evaluates").select(F.col("cid").alias("a"), "n", F.explode("elems").alias("e"))
    counts = training.groupBy("e").agg(F.count("*").alias("df"))
    ranked = asked.join(counts, "e", "left").withColumns({
        "rank": F.row_number().over(Window.partitionBy("a").orderBy(F.coalesce("df", F.lit(0)), "e")),
        "missed": F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9),
    })
    hits = F.least(F.lit(HITS), F.col("n") - F.col("missed"))
    rare = ranked.filter(F.col("df").isNotNull() & (F.col("rank") <= F.col("missed") + hits)).select("a", "e", hits.alias("hits"))
    found = rare.join(training, "e").groupBy("a", "b", "hits").agg(F.count("*").alias("hit")).filter("hit >= hits").select("a", "b")
    return verified(found, distinct, F.col("n_a"), threshold)


def cross_split_pairs(contents: DataFrame, members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(field, eval_row, train_row, split) for each evaluation row found again in a training row."""
    kept = stage(contents.drop(*PARITY).join(members.select("row_id", "split"), "row_id"), "split-contents")
    pairs = contained_classes(kept, threshold)
    rows = kept.select("cid", "row_id", "split").distinct()
    left = rows.filter("split <> 'train'").selectExpr("cid as a", "row_id as x", "split")
    right = rows.filter("split = 'train'").selectExpr("cid as b", "row_id as y")
    met = expanded(pairs, left, right).filter("x <> y")
    return met.select("field", F.col("x").alias("eval_row"), F.col("y").alias("train_row"), "split").distinct()


def cross_split_counts(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Per field, split and source of the evaluation row: rows in the split, rows found again, and pairs."""
    held = members.filter("split <> 'train'").groupBy("split", "source").agg(F.countDistinct("row_id").alias("n_rows"))
    fields = held.select("*", F.explode(F.array(F.lit("step"), F.lit("caption"))).alias("field"))
    per_row = pairs.groupBy("field", "split", F.col("eval_row").alias("row_id")).agg(F.count("*").alias("n"))
    source = members.select("row_id", "source").distinct()
    found = per_row.join(source, "row_id").groupBy("field", "split", "source").agg(F.count("*").alias("n_found"), F.sum("n").alias("n_pairs"))
    same = fields.alias("h").join(found.alias("f"), (F.col("h.field") == F.col("f.field")) & (F.col("h.split") == F.col("f.split")) & F.col("h.source").eqNullSafe(F.col("f.source")), "left")
    return same.select("h.field", "h.split", "h.source", "n_rows", F.coalesce("n_found", F.lit(0)).alias("n_found"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"))
