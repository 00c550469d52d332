"""Centroid clustering in exact integers, with a filter on PCA-rotated coordinates.

Every vector is stored once with its leading rotated coordinates and the norm of the rest. For a centroid taken through
the same rotation, projected distance plus the squared difference of the rest norms is a lower bound of the
distance. The centroid with the smallest bound is measured in integers, and so is every other one whose bound doesn't
exceed that distance; the nearest of them is exact, ties included. A bound is lowered by the rounding
error it can have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoopflow.llm.minhash import stored

#: Components are cut to this size, which scaled values reach beyond 2^52; up to it nothing is lost.
BOUND = 1 << 62
#: Differences below this size square and add up in 64 bits for up to 256 components.
PLAIN = 1 << 26
LONG = (1 << 63) - 1


def _safe(a: np.ndarray) -> np.ndarray:
    """Python integers where 64 bits might not hold squares or sums."""
    return a.astype(object) if a.size and int(np.abs(a).max()) >= PLAIN else a


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)


def scaled(vectors: DataFrame, dim: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): floor(scale * x) of vectors with ``dim`` components, none null or non-finite."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = vectors.where(x.isNotNull() & (F.size(x) == dim)).where(finite)
    bound = F.lit(float(BOUND))
    whole = F.transform(x, lambda e: F.greatest(F.least(F.floor(e.cast("double") * float(scale)).cast("double"), bound), -bound).cast("long"))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def _summed(rows: DataFrame, key: str, value: str) -> dict[int, list[int]]:
    """Element-wise exact sums of the arrays of each key; keys and places are a fixed few, so the result is small."""
    flat = rows.select(key, F.posexplode(value).alias("place", "x"))
    total = flat.groupBy(key, "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
    out: dict[int, list[int]] = {}
    for r in sorted(total.collect(), key=lambda r: (r[0], r[1])):
        out.setdefault(r[0], []).append(int(r[2]))
    return out


def moments(points: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance of all vectors; tasks pre-sum, so each sends ``dim + 1`` short rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = _matrix(b.column("v"), dim).astype(float)
            n, s, g = n + len(x), s + x.sum(0), g + x.T @ x
        rows = np.vstack([np.append(s, n), np.column_stack([g, np.zeros(dim)])])
        if n:
            yield pa.record_batch({"i": pa.array(range(dim + 1), pa.int32()), "x": pa.array(rows.tolist(), pa.list_(pa.float64()))})

    parts = points.select("v").mapInArrow(run, "i int, x array<double>").select("i", F.posexplode("x").alias("place", "x"))
    total = np.zeros((dim + 1, dim + 1))
    for i, j, x in parts.groupBy("i", "place").agg(F.sum("x")).collect():
        total[i, j] = x
    n = int(total[0, dim])
    if not n:
        return 0, np.zeros(dim), np.zeros((dim, dim))
    mean = total[0, :dim] / n
    return n, mean, total[1:, :dim] / n - np.outer(mean, mean)


def rotation(covariance: np.ndarray, lead: int) -> np.ndarray:
    """The ``lead`` main directions as columns. Any orthonormal ones give valid bounds, good ones tight bounds."""
    if not np.isfinite(covariance).all():
        return np.eye(len(covariance))[:, :lead]
    _, vectors = np.linalg.eigh(covariance)
    return vectors[:, ::-1][:, :lead]


def rotated(v: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading coordinates, norm of the rest, and norm of all around ``mean``."""
    x = v.astype(float) - mean
    p = x @ axes
    rest = x - p @ axes.T
    return p, np.sqrt((rest**2).sum(1)), np.sqrt((x**2).sum(1))


def nearest(v: np.ndarray, p: np.ndarray, rest: np.ndarray, norm: np.ndarray, centers: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest center (ties: smaller number), exact squared distance, and how many distances were measured."""
    cp, crest, cnorm = rotated(centers, mean, axes)
    low = ((p[:, None, :] - cp[None]) ** 2).sum(2) + (rest[:, None] - crest[None]) ** 2
    # Doubles carry 53 bits; sums of a few hundred terms lose far less than the factor here.
    low -= 1e-9 * (norm[:, None] + cnorm[None] + np.abs(mean).sum() + 1) ** 2
    exact_v, exact_c = _safe(v), _safe(centers)
    if exact_v.dtype == object or exact_c.dtype == object:
        exact_v, exact_c = v.astype(object), centers.astype(object)

    def distance(rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        d = exact_v[rows] - exact_c[which]
        return (d * d).sum(1)

    rows = np.arange(len(v))
    best = np.argmin(low, 1)
    dist = distance(rows, best)
    # A bound is compared as a double, rounded to the safe side.
    left = low <= dist.astype(float)[:, None] * (1 + 1e-12) + 1e-6
    left[rows, best] = False
    r, c = np.nonzero(left)
    d = distance(r, c) if len(r) else dist[:0]
    # Centers ascend within a row, so a later one wins only if it is nearer.
    for center in range(len(centers)):
        at = r[c == center]
        near = d[c == center]
        win = (near < dist[at]) | ((near == dist[at]) & (center < best[at]))
        best[at[win]], dist[at[win]] = center, near[win]
    return best, dist, len(v) + len(r)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, lead: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and centroid of every kept vector.

    Kept are vectors of exactly ``dim`` components, none null or non-finite, as integers floor(``scale`` * x).
    Centers start as the ``k`` vectors whose lower-case hex sha256 of ``seed:vec_id`` is smallest; equal hashes (a
    repeated id) go by the vector, a null id comes last. Each round assigns every vector and replaces each
    non-empty center by the floor of its mean; at the end all are assigned once more. Repeated rows count and
    are returned once each. Fewer kept vectors than ``k`` give fewer clusters, none give no rows. Other columns
    are ignored. Scaled components beyond 2^62 are cut to it; a distance or sum beyond 64 bits is returned as the largest long.

    Only the centers, their sums and the covariance pass through the driver: their size depends on ``k`` and ``dim`` alone.
    """
    spark = vectors.sparkSession
    points = stored(scaled(vectors, dim, scale, id_col, vec_col))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = points.orderBy(hashed.asc_nulls_last(), "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
    if not first:
        return spark.createDataFrame([], schema)
    centers = np.array([r["v"] for r in first], np.int64)
    _, mean, covariance = moments(points, dim)
    axes = rotation(covariance, min(lead, dim))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, rest, norm = rotated(_matrix(b.column("v"), dim), mean, axes)
            yield pa.record_batch([b.column("vec_id"), b.column("v"), pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(rest), pa.array(norm)],
                                  names=["vec_id", "v", "p", "rest", "norm"])

    table = stored(points.mapInArrow(project, "vec_id long, v array<long>, p array<double>, rest double, norm double"))

    def assign(b: pa.RecordBatch, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = _matrix(b.column("v"), dim)
        best, dist, _ = nearest(v, _matrix(b.column("p"), axes.shape[1]), b.column("rest").to_numpy(), b.column("norm").to_numpy(), at, mean, axes)
        return v, best, dist

    def each(fn: Callable, at: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """One row per center and task: the sums that ``fn`` gives for the center's vectors, and their number."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list[int]] = {}
            for b in batches:
                v, best, dist = assign(b, at)
                for c in np.unique(best).tolist():
                    mine = best == c
                    new = [*fn(v[mine], dist[mine]), int(mine.sum())]
                    sums[c] = [x + y for x, y in zip(sums[c], new)] if c in sums else new
            if sums:
                # Decimal strings keep sums of any size.
                yield pa.record_batch({"c": pa.array(sums, pa.int32()), "s": pa.array([[str(x) for x in s] for s in sums.values()], pa.list_(pa.string()))})
        return run

    def totals(fn: Callable, at: np.ndarray) -> dict[int, list[int]]:
        return _summed(table.mapInArrow(each(fn, at), "c int, s array<string>"), "c", "s")

    def component_sums(v: np.ndarray, dist: np.ndarray) -> list[int]:
        return [int(x) for x in _safe(v).sum(0)]

    for _ in range(rounds):
        for c, (*s, n) in totals(component_sums, centers).items():
            centers[c] = [x // n for x in s]
    inertia = {c: s[0] for c, s in totals(lambda v, dist: [int(dist.sum())], centers).items()}
    own = np.array([min(inertia.get(c, 0), LONG) for c in range(len(centers))], np.int64)
    whole = min(sum(inertia.values()), LONG)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]
    spelled = centers.tolist()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, best, dist = assign(b, centers)
            at = best.tolist()
            yield pa.record_batch([b.column("vec_id"), pa.array(at, pa.int32()), pa.array([min(int(d), LONG) for d in dist], pa.int64()), pa.array(own[best]),
                                   pa.array([whole] * len(at), pa.int64()), pa.array([names[c] for c in at], pa.string()), pa.array([spelled[c] for c in at], pa.list_(pa.int64()))],
                                  names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"])

    return table.mapInArrow(label, schema)


def cluster_sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same clustering as DuckDB SQL over ``embeddings``, one block of sub-queries a round."""
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) AS r, x FROM
  (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
   WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: isfinite(e))) = {dim}))""",
             f"c0 AS MATERIALIZED (SELECT CAST(r - 1 AS INTEGER) AS c, x FROM v WHERE r <= {k})"]
    near = """a{i} AS MATERIALIZED (SELECT r, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM
  (SELECT v.r, c.c, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS HUGEINT) AS d FROM v, c{i} c) GROUP BY r)"""
    for i in range(rounds):
        parts.append(near.format(i=i, k=k))
        parts.append(f"""m{i} AS MATERIALIZED (SELECT c, list(m ORDER BY j) AS x FROM
  (SELECT c, j, CAST((s - (s % n + n) % n) // n AS BIGINT) AS m FROM
    (SELECT a.c, j, sum(x) AS s, count(*) AS n FROM a{i} a JOIN (SELECT r, unnest(x) AS x, generate_subscripts(x, 1) AS j FROM v) e ON e.r = a.r GROUP BY a.c, j)) GROUP BY c)""")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.x, o.x) AS x FROM c{i} o LEFT JOIN m{i} m ON m.c = o.c)")
    parts.append(near.format(i=rounds, k=k))
    return "WITH " + ",\n".join(parts) + f"""
SELECT v.vec_id, a.c AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a ON a.r = v.r JOIN c{rounds} c ON c.c = a.c"""
