"""Exact Lloyd clustering with heap-ordered bounds.

A vector's *gap* is its distance to the second nearest centroid less that to its own. While its
centroid and all others together have moved less than the gap, its cluster cannot change. Every
cluster therefore keeps a heap ordered by ``key`` = gap + the cluster's accumulated drift at that
time; a vector expires once the drift has reached its key, and only expired vectors are popped and
measured against all centroids again.

At size the heaps are files: each round appends one *run* of the vectors it placed, ordered by
(cluster, key) in every file (an ordered array is a heap). Drift only grows, so the rows of a run
that are still in the heap are exactly those with a key beyond the cluster's drift, and a pop is a
range of keys for every cluster, ``before < key <= now``: Parquet statistics skip the rest. Nothing
that stays is read or written in a round; popped rows go into the next run under their new cluster.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateflow.llm import common

#: Components beyond this are refused: sums and squared distances must stay exact in 64 bits.
LARGEST = 1 << 26


def quantized(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v ARRAY<INT>): floor(scale * x) of every vector of ``dims`` finite components.

    Others (null or shorter or longer vectors, null or non-finite components) are left out. A
    component beyond ``LARGEST`` raises.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = rows.where((F.size(x) == dims) & finite)
    bound = F.lit(2.0 * LARGEST)
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, bound), -bound)))
    refused = F.raise_error(F.lit(f"a component beyond {LARGEST} after scaling")).cast("int")
    checked = F.transform(whole, lambda c: F.when(F.abs(c) > LARGEST, refused).otherwise(c.cast("int")))
    return kept.select("vec_id", checked.alias("v"))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors of the ``k`` smallest sha256 of ``salt:vec_id``, in that order (null id: no digits).

    Repeated ids are taken in order of their components. Fewer vectors give fewer centroids.
    """
    h = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64) if len(column) else np.empty((0, 0), dtype=np.int64)


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (points x centroids) of integer matrices.

    Products in doubles are exact while every sum stays below 2**53; larger values use integers.
    """
    big = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * big * big * points.shape[1] < 1 << 53:
        cross = (points.astype(np.float64) @ centroids.astype(np.float64).T).astype(np.int64)
    else:
        cross = points @ centroids.T
    return (points * points).sum(1)[:, None] - 2 * cross + (centroids * centroids).sum(1)[None, :]


def nearest(points: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, ties to the smaller number; heap key) of every point.

    The key is rounded down by more than the arithmetic can err, so a vector whose nearest centroid
    might have changed always expires; it stays above the drift so far, so no row is in no range.
    """
    d = squared_distances(points, centroids)
    own = d.argmin(1)
    rows = np.arange(len(points))
    upper = np.sqrt(d[rows, own].astype(np.float64))
    if d.shape[1] == 1:
        return own, np.full(len(points), np.inf)
    d[rows, own] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(1).astype(np.float64))
    base = drift[own]
    key = base + (lower - upper) - (1e-6 + 1e-12 * (base + lower + upper))
    return own, np.maximum(key, np.nextafter(base, np.inf))  # centroids move by 1 at least, or not at all


RUN = "vec_id BIGINT, v ARRAY<INT>, was INT, cluster INT, key DOUBLE"
_RUN = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("was", pa.int32()), ("cluster", pa.int32()), ("key", pa.float64())])


def _placed(rows: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """A new run: the rows (vec_id, v, was) with their exact nearest centroid and key, heap-ordered."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 8192):
                part = batch.slice(a, 8192)
                own, key = nearest(_matrix(part.column("v")), centroids, drift)
                cols = [part.column("vec_id"), part.column("v"), part.column("was"), pa.array(own, pa.int32()), pa.array(key)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, _RUN, strict=True)], schema=_RUN)

    placed = rows.select("vec_id", "v", "was").mapInArrow(run, RUN)
    return common.stored(placed.sortWithinPartitions("cluster", "key"), "heap-run")


def _between(low: np.ndarray, high: np.ndarray | None) -> Column:
    """Rows of a run whose key lies beyond their cluster's ``low``, up to ``high`` (None: any)."""
    ranges = []
    for c, a in enumerate(low.tolist()):
        one = (F.col("cluster") == c) & (F.col("key") > a)
        ranges.append(one if high is None else one & (F.col("key") <= float(high[c])))
    return reduce(lambda a, b: a | b, ranges)


def _moves(run: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Change of the exact (sums, counts) of every cluster by the vectors of a run that changed it.

    Partial sums in every task, then k x dims numbers to the driver.
    """
    changed = run.where("was IS NULL OR was <> cluster")
    signed = changed.select("v", F.explode(F.array(
        F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")),
        F.struct(F.col("was").alias("c"), F.lit(-1).alias("sign")),
    )).alias("m")).where("m.c IS NOT NULL")
    schema = "c INT, sums ARRAY<BIGINT>, n BIGINT"

    def partial(batches):
        sums, counts = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column("c").to_numpy(zero_copy_only=False)
            sign = batch.column("sign").to_numpy(zero_copy_only=False).astype(np.int64)
            points = _matrix(batch.column("v")) * sign[:, None]
            for i in np.unique(c).tolist():
                sums[i] += points[c == i].sum(0)
                counts[i] += sign[c == i].sum()
        live = np.flatnonzero((counts != 0) | (sums != 0).any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(live, pa.int32()), pa.array(sums[live].tolist(), pa.list_(pa.int64())), pa.array(counts[live])], names=["c", "sums", "n"]
        )

    parts = signed.select("v", "m.c", "m.sign").mapInArrow(partial, schema)
    total = parts.select("c", "n", F.posexplode("sums")).groupBy("c", "pos").agg(F.sum("col").alias("s"), F.sum("n").alias("n")).collect()
    sums, counts = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
    for r in total:
        sums[r["c"], r["pos"]] = r["s"]
        counts[r["c"]] = r["n"]
    return sums, counts


def cluster(vectors: DataFrame, k: int, rounds: int, dims: int = 64, scale: int = 256, salt: str = "2") -> tuple[DataFrame, np.ndarray, list[int]]:
    """(assignment (vec_id, cluster, distance), final centroids, vectors measured in each round).

    Centroids start as ``first_centroids``; each of ``rounds`` rounds assigns all vectors and
    replaces every non-empty centroid by floor(sum/count); then all are assigned once more. Exact in
    integers. Repeated rows count each; no kept vector gives an empty assignment.
    """
    spark = vectors.sparkSession
    points = common.stored(quantized(vectors, dims, scale), "vectors")
    centroids = first_centroids(points, k, salt)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id BIGINT, cluster INT, distance BIGINT"), np.empty((0, dims), dtype=np.int64), []
    k = len(centroids)
    drift = np.zeros(k)
    runs = [_placed(points.withColumn("was", F.lit(None).cast("int")), centroids, drift)]
    sums, counts = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
    measured = [runs[0].count()]
    for _ in range(rounds):
        more, n = _moves(runs[-1], k, dims)
        sums, counts = sums + more, counts + n
        live = counts > 0
        moved = centroids.copy()
        moved[live] = sums[live] // counts[live, None]  # floor, below zero too
        steps = np.sqrt(((moved - centroids).astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        centroids, before = moved, drift
        others = np.array([np.delete(steps, c).max(initial=0.0) for c in range(k)])
        drift = before + (steps + others) * (1 + 1e-9)
        expired = reduce(DataFrame.union, [r.where(_between(before, drift)) for r in runs]) if (drift > before).any() else runs[0].limit(0)
        runs.append(_placed(expired.select("vec_id", "v", F.col("cluster").alias("was")), centroids, drift))
        measured.append(runs[-1].count())
    held = reduce(DataFrame.union, [r.where(_between(drift, None)) for r in runs[:-1]]).union(runs[-1]) if rounds else runs[0]

    def distances(batches):
        for batch in batches:
            if batch.num_rows:
                c = batch.column("cluster").to_numpy(zero_copy_only=False)
                d = ((_matrix(batch.column("v")) - centroids[c]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    return held.select("vec_id", "v", "cluster").mapInArrow(distances, "vec_id BIGINT, cluster INT, distance BIGINT"), centroids, measured


def op13_heap_kmeans(spark, sf_dir: str) -> DataFrame:
    """Clusters of every 64-component embedding: 40 centroids, five rounds."""
    import hashlib

    found, centroids, _ = cluster(common.table(spark, sf_dir, "embeddings"), 40, 5)
    held = common.stored(found, "clusters")
    per = held.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digests = spark.createDataFrame(
        [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())], "cluster INT, centroid_sha256 STRING"
    )
    # one row per centroid, whatever the input
    small = per.crossJoin(F.broadcast(per.agg(F.sum("cluster_inertia").alias("inertia")))).join(digests, "cluster")
    return held.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 40, rounds: int = 5) -> str:
    """Plain Lloyd rounds in DuckDB SQL, all distances in every round."""
    steps = [
        f"""WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m
    FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM v ORDER BY h, v LIMIT {k})
)"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
    SELECT rid, vec_id, v, min({{'d': d, 'c': c}}) AS b FROM (
        SELECT rid, vec_id, v, c, CAST(list_sum([(v[i] - m[i]) * (v[i] - m[i]) FOR i IN range(1, 65)]) AS BIGINT) AS d FROM v, c{i}
    ) GROUP BY rid, vec_id, v
)"""
        )
        if i < rounds:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (
    SELECT c0.c, coalesce(n.m, c0.m) AS m FROM c{i} AS c0 LEFT JOIN (
        SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM (
            SELECT b.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, 65) AS r(i) GROUP BY 1, 2
        ) GROUP BY c
    ) AS n ON n.c = c0.c
)"""
            )
    last = f"""SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, b.d AS distance,
       CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} AS z ON z.c = b.c"""
    return ", ".join(steps) + "\n" + last


ORACLE = _oracle()
