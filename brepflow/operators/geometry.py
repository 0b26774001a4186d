"""Point clouds, meshes and rewards (R family).

Clouds are arrays of [x, y, z]; a cloud is one row, so distances are computed in its row or, for
large clouds, in blocks by ``chamfer_blocked``. Meshes come from a back end (``MeshBackend``): none
is bundled, and a text whose mesh cannot be made has the status ``backend_missing`` or ``pred_parse``.
"""

from __future__ import annotations

import multiprocessing
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brepflow.functions.text import has_terminator
from brepflow.session import stage

#: Limits of the geometric reward, and the parts of the others; fixed values.
LOW, HIGH, PARSE_REWARD, FORMAT_REWARD, MIN_FORMAT_ENTITIES, MIN_TRIANGLES, MIN_POINTS = 0.01, 0.50, 0.3, 0.2, 138, 4, 10
MeshBackend = Callable[[str], "np.ndarray | None"]


@dataclass(frozen=True)
class RewardConfig:
    """What a geometric reward depends on; fixed values."""

    n_points: int = 2000
    delta_low: float = LOW
    delta_high: float = HIGH
    bidirectional: bool = True
    scale_prenorm: bool = True
    deflection: float | None = None


def points(v: Column, n: int = 21) -> Column:
    """The first 3n numbers of a vector as n points."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.transform(F.slice(v, i * 3 + 1, F.lit(3)), lambda x: x.cast("double")))


def on_axis(k: int) -> Callable[[Column], Column]:
    """The k-th coordinate of a point."""
    return lambda p: p[k]


def axis_mean(cloud: Column, axis: int) -> Column:
    return F.aggregate(cloud, F.lit(0.0), lambda a, p: a + p[axis]) / F.size(cloud)


def centroid(cloud: Column) -> list[Column]:
    """R05"""
    return [axis_mean(cloud, k) for k in range(3)]


def rms(cloud: Column, centre: list[Column]) -> Column:
    """Root mean square distance from the centre."""
    square = F.aggregate(cloud, F.lit(0.0), lambda a, p: a + sum((p[k] - centre[k]) * (p[k] - centre[k]) for k in range(3)))
    return F.sqrt(square / F.size(cloud))


def nearest_mean(a: Column, b: Column) -> Column:
    """Mean over a of the squared distance to the nearest point of b."""

    def square(p: Column, q: Column) -> Column:
        return sum((p[k] - q[k]) * (p[k] - q[k]) for k in range(3))

    least = F.transform(a, lambda p: F.array_min(F.transform(b, lambda q: square(p, q))))
    return F.aggregate(least, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def chamfer(a: Column, b: Column, both: bool = True) -> Column:
    """Squared distances, sum of means."""
    return nearest_mean(a, b) + nearest_mean(b, a) if both else nearest_mean(a, b)


def scaled(cd: Column, scale: Column) -> Column:
    """By the square of the scale; infinite for a degenerate one."""
    return F.when(scale < 1e-8, F.lit(float("inf"))).otherwise(cd / (scale * scale))


def blocked_mean(a: np.ndarray, b: np.ndarray, block: int = 2048) -> float:
    """As ``nearest_mean``, for large clouds."""
    best = np.full(len(a), np.inf)
    for i in range(0, len(a), block):
        for j in range(0, len(b), block):
            d = ((a[i : i + block, None, :] - b[None, j : j + block, :]) ** 2).sum(-1)
            best[i : i + block] = np.minimum(best[i : i + block], d.min(1))
    return float(best.mean())


def chamfer_blocked(pairs: DataFrame) -> DataFrame:
    """R08 over (id, a, b): (id, cd)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = np.array(a or [], float), np.array(b or [], float)
                out.append(blocked_mean(x, y) + blocked_mean(y, x) if len(x) and len(y) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.float64())], ["id", "cd"])

    return pairs.select("id", "a", "b").mapInArrow(run, "id bigint, cd double")


def registered(source: np.ndarray, target: np.ndarray, thresholds: tuple[float, ...], rounds: int = 30) -> np.ndarray:
    """The source moved rigidly onto the target by ICP, at falling distance thresholds."""
    moved = source.copy()
    for limit in thresholds:
        for _ in range(rounds):
            d = ((moved[:, None, :] - target[None, :, :]) ** 2).sum(-1)
            near = d.argmin(1)
            use = d[np.arange(len(moved)), near] <= limit * limit
            if use.sum() < 3:
                break
            p, q = moved[use], target[near[use]]
            u, _, vt = np.linalg.svd((p - p.mean(0)).T @ (q - q.mean(0)))
            flip = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1])
            turn = vt.T @ flip @ u.T
            after = (moved - p.mean(0)) @ turn.T + q.mean(0)
            if np.abs(after - moved).max() < 1e-9:
                break
            moved = after
    return moved


def sampled(triangles: np.ndarray, n: int, seed: int) -> np.ndarray:
    """N points over the triangles, by area, from a seed."""
    rng = np.random.default_rng(seed)
    area = 0.5 * np.linalg.norm(np.cross(triangles[:, 1] - triangles[:, 0], triangles[:, 2] - triangles[:, 0]), axis=1)
    pick = rng.choice(len(triangles), n, p=area / area.sum())
    r, s = np.sqrt(rng.random(n)), rng.random(n)
    t = triangles[pick]
    return (1 - r)[:, None] * t[:, 0] + (r * (1 - s))[:, None] * t[:, 1] + (r * s)[:, None] * t[:, 2]


def cross(p: Column, q: Column, r: Column) -> list[Column]:
    """The triangle's normal, twice its area long."""
    u, v = [q[k] - p[k] for k in range(3)], [r[k] - p[k] for k in range(3)]
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def geometric_reward(scd: Column, config: RewardConfig = RewardConfig()) -> Column:
    """1 up to the low limit, 0 from the high one on, linear between."""
    low, high = config.delta_low, config.delta_high
    return F.when(scd <= low, 1.0).when(scd >= high, 0.0).otherwise((high - scd) / (high - low))


def parse_reward(terminated: Column, triangles: Column, distinct_points: Column) -> Column:
    """R11"""
    return F.when(terminated & (triangles >= MIN_TRIANGLES) & (distinct_points >= MIN_POINTS), PARSE_REWARD).otherwise(0.0)


def format_reward(terminated: Column, entities: Column, least: int = MIN_FORMAT_ENTITIES) -> Column:
    """R12"""
    return F.when(terminated & (entities >= least), FORMAT_REWARD).otherwise(0.0)


def fail_stage(terminated: Column, pred_points: Column, pred_triangles: Column, gt_points: Column, gt_triangles: Column, scd: Column) -> Column:
    """The first stage that fails, or ``ok``. Points are null where a mesh could not be made."""
    return (
        F.when(~F.coalesce(terminated, F.lit(False)), "no_terminator").when(pred_points.isNull(), "pred_parse")
        .when((pred_triangles < MIN_TRIANGLES) | (pred_points < MIN_POINTS), "pred_degenerate").when(gt_points.isNull(), "gt_parse")
        .when((gt_triangles < MIN_TRIANGLES) | (gt_points < MIN_POINTS), "gt_degenerate")
        .when(scd.isNull() | F.isnan(scd) | (F.abs(scd) == float("inf")), "scd_nonfinite").otherwise("ok")
    )


def full_reward(stage: Column, scd: Column, config: RewardConfig = RewardConfig()) -> Column:
    """The geometric reward where all stages hold; NaN where the other side failed; else 0."""
    return F.when(stage == "ok", geometric_reward(scd, config)).when(stage.isin("gt_parse", "gt_degenerate", "scd_nonfinite"), float("nan")).otherwise(0.0)


def sane(x: Column) -> Column:
    """NaN, infinite and null as 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def isolated(backend: MeshBackend, timeout: float = 30.0) -> MeshBackend:
    """The back end in a process of its own for each text: a crash or a timeout is a text without a mesh."""
    context = multiprocessing.get_context("fork")

    def child(text: str, out) -> None:
        try:
            out.send(backend(text))
        except Exception:  # noqa: BLE001  as good as a crash
            out.send(None)

    def run(text: str) -> np.ndarray | None:
        here, there = context.Pipe(duplex=False)
        process = context.Process(target=child, args=(text, there), daemon=True)
        process.start()
        there.close()
        try:
            return here.recv() if here.poll(timeout) else None
        except EOFError:
            return None
        finally:
            process.kill()
            process.join()
            here.close()

    return run


def sampled_points(meshes: DataFrame, n: int) -> DataFrame:
    """R02 over (id, triangles, seed): (id, cloud); null for meshes without area."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for mesh, seed in zip(batch.column("triangles").to_pylist(), batch.column("seed").to_pylist()):
                t = np.array(mesh or np.empty((0, 3, 3)), float)
                area = np.linalg.norm(np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]), axis=1).sum()
                out.append(sampled(t, n, seed).tolist() if area > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.list_(pa.float64())))], ["id", "cloud"])

    return meshes.select("id", "triangles", "seed").mapInArrow(run, "id bigint, cloud array<array<double>>")


def registered_pairs(pairs: DataFrame, share: float = 1.0) -> DataFrame:
    """R07 over (id, a, b): (id, before, after), the mean squared distance from a to b without and with ICP.

    The thresholds are ``share`` of b's RMS scale, its half and its quarter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, after = [], []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = np.array(a, float), np.array(b, float)
                limit = share * float(np.sqrt(((y - y.mean(0)) ** 2).sum(1).mean()))
                before.append(blocked_mean(x, y))
                after.append(blocked_mean(registered(x, y, (limit, limit / 2, limit / 4)), y))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(before, pa.float64()), pa.array(after, pa.float64())], ["id", "before", "after"])

    return pairs.filter("a is not null and b is not null").select("id", "a", "b").mapInArrow(run, "id bigint, before double, after double")


def clouds(texts: DataFrame, backend: MeshBackend | None, n: int = 2000) -> DataFrame:
    """(text_hash, status, n_triangles, cloud), one row per distinct text.

    A text that the back end cannot mesh, or that makes it fail, has no cloud and the status ``pred_parse``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, triangles, cloud = [], [], []
            for text, seed in zip(batch.column("text").to_pylist(), batch.column("seed").to_pylist()):
                try:
                    mesh = backend(text) if backend else None
                except Exception:  # noqa: BLE001  a text that the native reader rejects
                    mesh = None
                ok = mesh is not None and len(mesh) > 0
                status.append("ok" if ok else "pred_parse" if backend else "backend_missing")
                triangles.append(len(mesh) if ok else 0)
                cloud.append(sampled(mesh, n, seed).tolist() if ok else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_hash"), pa.array(status), pa.array(triangles, pa.int32()), pa.array(cloud, pa.list_(pa.list_(pa.float64())))],
                ["text_hash", "status", "n_triangles", "cloud"],
            )

    distinct = texts.select("text").filter("text is not null").withColumn("text_hash", F.sha2("text", 256)).dropDuplicates(["text_hash"])
    seeded = distinct.withColumn("seed", F.conv(F.substring("text_hash", 1, 8), 16, 10).cast("bigint"))
    return seeded.mapInArrow(run, "text_hash string, status string, n_triangles int, cloud array<array<double>>")


_POINT = re.compile(r"CARTESIAN_POINT\s*\(\s*'[^']*'\s*,\s*\(([^()]*)\)", re.I)


def point_fan(text: str) -> np.ndarray | None:
    """A stand-in back end where no CAD kernel is at hand: triangles of each three consecutive points of a text, None for fewer."""
    found = [p.split(",") for p in _POINT.findall(text)]
    try:
        p = np.array([[float(x) for x in q] for q in found if len(q) == 3])
    except ValueError:
        return None
    return np.stack([p[:-2], p[1:-1], p[2:]], axis=1) if len(p) >= 3 else None


def scored_texts(pairs: DataFrame, backend: MeshBackend | None, config: RewardConfig = RewardConfig(), share: float = 1.0) -> DataFrame:
    """R01, R02, R04, R07 to R09, R11, R13, R15 chained over (id, pred, gt): (id, stage, n_triangles, scd, reward, parse).

    Each distinct text is meshed and sampled once, by its content's seed. A pair's clouds are brought to the truth's
    centroid and, with ``scale_prenorm``, to its RMS scale, registered by ICP and compared; only clouds of
    ``n_points`` points meet by a join on the texts' hashes.
    """
    texts = pairs.select(F.explode(F.array("pred", "gt")).alias("text"))
    made = stage(clouds(texts, backend, config.n_points), "clouds")
    keyed = pairs.select("id", has_terminator(F.col("pred")).alias("terminated"), F.sha2("pred", 256).alias("pred_hash"), F.sha2("gt", 256).alias("gt_hash"))
    side = lambda name: made.select(F.col("text_hash").alias(f"{name}_hash"), F.col("n_triangles").alias(f"{name}_triangles"), F.col("cloud").alias(name))
    both = keyed.join(side("pred"), "pred_hash", "left").join(side("gt"), "gt_hash", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scd: list[float | None] = []
            distinct: list[tuple[int | None, int | None]] = []
            for a, b in zip(batch.column("pred").to_pylist(), batch.column("gt").to_pylist()):
                x, y = (None if c is None else np.array(c, float) for c in (a, b))
                distinct.append(tuple(None if c is None else len(np.unique(c[:64], axis=0)) for c in (x, y)))
                scd.append(None if x is None or y is None else _aligned_scd(x, y, config, share))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("id", "terminated", "pred_triangles", "gt_triangles")), pa.array(scd, pa.float64()),
                    *(pa.array([d[k] for d in distinct], pa.int32()) for k in range(2)),
                ],
                ["id", "terminated", "pred_triangles", "gt_triangles", "scd", "pred_points", "gt_points"],
            )

    kind = dict(pairs.dtypes)["id"]
    columns = ("id", "terminated", "pred_triangles", "gt_triangles", "pred", "gt")
    schema = f"id {kind}, terminated boolean, pred_triangles int, gt_triangles int, scd double, pred_points int, gt_points int"
    found = both.select(*columns).mapInArrow(run, schema)
    c = F.col
    failed = fail_stage(c("terminated"), c("pred_points"), c("pred_triangles"), c("gt_points"), c("gt_triangles"), c("scd"))
    parse = parse_reward(c("terminated"), F.coalesce("pred_triangles", F.lit(0)), F.coalesce("pred_points", F.lit(0)))
    out = found.select("id", failed.alias("stage"), F.coalesce("pred_triangles", F.lit(0)).alias("n_triangles"), "scd", F.coalesce(parse, F.lit(0.0)).alias("parse"))
    return out.withColumn("reward", full_reward(c("stage"), c("scd"), config))


def _aligned_scd(x: np.ndarray, y: np.ndarray, config: RewardConfig, share: float) -> float:
    """The scaled Chamfer distance after registration; infinite for a truth without extent."""
    x, y = x - x.mean(0), y - y.mean(0)
    own, scale = (float(np.sqrt((c**2).sum(1).mean())) for c in (x, y))
    if scale < 1e-8:
        return float("inf")
    if config.scale_prenorm and own >= 1e-8:
        x = x * (scale / own)
    limit = share * scale
    x = registered(x, y, (limit, limit / 2, limit / 4))
    return (blocked_mean(x, y) + (blocked_mean(y, x) if config.bidirectional else 0.0)) / scale**2


def stl(triangles: DataFrame, column: str = "triangles") -> DataFrame:
    """The rows' triangles as binary STL files: (id, stl): a head of 80 bytes, their number, and 50 bytes for each; null for null."""
    facet = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("more", "<u2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = []
            for mesh in batch.column(column).to_pylist():
                if mesh is None:
                    out.append(None)
                    continue
                t = np.array(mesh or np.empty((0, 3, 3)), np.float64)
                normal = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
                size = np.linalg.norm(normal, axis=1, keepdims=True)
                rows = np.zeros(len(t), facet)
                rows["normal"], rows["corners"] = np.divide(normal, size, out=np.zeros_like(normal), where=size > 0), t
                out.append(bytes(80) + struct.pack("<I", len(t)) + rows.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "stl"])

    return triangles.select("id", column).mapInArrow(run, f"id {dict(triangles.dtypes)['id']}, stl binary")
