"""Centroid clustering of integer vectors with cached distance bounds: every vector keeps an upper bound of the distance to
its centroid and a lower bound to each other one, and distances between centroids rule out the rest.

Vectors live in blocks of some thousands, one row a block; a round reads the blocks, moves bounds and assignments and
writes them anew. Only sums by centroid leave the tasks. Distances that decide are exact integers; bounds are floats
rounded outwards, and a centroid is skipped only if its bound is strictly worse, so ties are always settled exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import discard, written

#: Components beyond this are refused: a squared distance of 64 such components would leave 64-bit integers.
LARGEST = 1 << 27
BLOCK = 4096


def up(x: np.ndarray) -> np.ndarray:
    """The next float32 above, so that a bound never falls short."""
    return np.nextafter(np.nextafter(x.astype(np.float32), np.float32(np.inf)), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    """The next float32 below, not under 0."""
    return np.maximum(np.nextafter(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(-np.inf)), np.float32(0))


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of q to c (one centroid, or one a row)."""
    gap = q.astype(np.int64) - c
    return np.einsum("ij,ij->i", gap, gap)


def between(centroids: np.ndarray) -> np.ndarray:
    """Distances between centroids, rounded down."""
    return np.array([down(np.sqrt(squared(centroids, c).astype(np.float64))) for c in centroids], np.float32)


def assign(q: np.ndarray, centroids: np.ndarray, apart: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Move each vector to its nearest centroid (ties: the smaller number); updates cluster, upper and lower in place and
    returns how many distances were computed.

    A centroid is looked at if neither its lower bound nor half its distance to the vector's own centroid is strictly
    above the upper bound. The own distance is made exact first, which rules out most of what is left.
    """
    k = len(centroids)

    def open_pairs(rows: np.ndarray) -> np.ndarray:
        own = cluster[rows]
        mask = (upper[rows, None] >= lower[rows]) & (upper[rows, None] >= apart[own] * np.float32(0.5))
        mask[np.arange(len(rows)), own] = False
        return mask

    rows = np.arange(len(q))
    rows = rows[open_pairs(rows).any(1)]
    if not len(rows):
        return 0
    best = squared(q[rows], centroids[cluster[rows]])
    exact = np.sqrt(best.astype(np.float64))
    upper[rows] = up(exact)
    lower[rows, cluster[rows]] = down(exact)
    mask, done = open_pairs(rows), len(rows)
    winner = cluster[rows].copy()
    for c in range(k):
        hit = np.flatnonzero(mask[:, c])
        if not len(hit):
            continue
        d = squared(q[rows[hit]], centroids[c])
        done += len(hit)
        lower[rows[hit], c] = down(np.sqrt(d.astype(np.float64)))
        better = (d < best[hit]) | ((d == best[hit]) & (c < winner[hit]))
        best[hit[better]], winner[hit[better]] = d[better], c
    cluster[rows] = winner
    upper[rows] = up(np.sqrt(best.astype(np.float64)))
    return done


def sums_of(q: np.ndarray, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Component sums (k x dims) and number of vectors of each cluster."""
    counts = np.bincount(cluster, minlength=k)
    out = np.zeros((k, q.shape[1]), np.int64)
    order = np.argsort(cluster, kind="stable")
    held = np.flatnonzero(counts)
    out[held] = np.add.reduceat(q[order].astype(np.int64), (np.cumsum(counts) - counts)[held], axis=0)
    return out, counts


_STATE = "ids array<{kind}>, width int, q binary, cluster binary, upper binary, lower binary, sums array<long>, counts array<long>"


def _row(ids: pa.Array, q: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, k: int) -> pa.RecordBatch:
    sums, counts = sums_of(q, cluster, k)
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, pa.array(sums.ravel()), pa.array(counts))]
    arrays = [lists[0], pa.array([q.itemsize], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (q, cluster.astype(np.int32), upper, lower)), lists[1], lists[2]]
    return pa.RecordBatch.from_arrays(arrays, ["ids", "width", "q", "cluster", "upper", "lower", "sums", "counts"])


def _read(batch: pa.RecordBatch, i: int, dims: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = batch.column(0)[i].values
    n = len(ids)
    kind = {2: np.int16, 4: np.int32}[batch.column(1)[i].as_py()]
    q = np.frombuffer(batch.column(2)[i].as_buffer(), kind).reshape(n, dims)
    cluster = np.frombuffer(batch.column(3)[i].as_buffer(), np.int32).astype(np.int64)
    upper = np.frombuffer(batch.column(4)[i].as_buffer(), np.float32).copy()
    return ids, q, cluster, upper, np.frombuffer(batch.column(5)[i].as_buffer(), np.float32).reshape(n, -1).copy()


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """id, q: rows whose vector has exactly dims components, none null or non-finite, as floor(scale * component)."""
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    kept = vectors.where((F.size(vector_col) == dims) & whole)
    return kept.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("q"))


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Vectors that are null, of another length, or have a null or non-finite component are left out. Centroids start as the
    k vectors with the smallest sha256 of '<seed>:<id>' (a null id counts as no characters; equal hashes go by components;
    repeated rows are vectors like any others), or all of them if there are fewer; ties in distance go to the smaller
    centroid, empty centroids stay. An empty table gives no rows; other columns play no part. Components beyond 2**27
    after scaling raise an error in the task, as their squared distances leave 64-bit integers.
    """
    rows = quantised(vectors, id_col, vector_col, dims, scale)
    kind = rows.schema["id"].dataType.simpleString()
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(key, "q").limit(k).select("q").collect()  # k rows
    centroids = np.array([r["q"] for r in first], np.int64).reshape(-1, dims)
    k = len(centroids)
    if np.abs(centroids).max(initial=0) > LARGEST:
        raise ValueError("components are too large for 64-bit squared distances")
    schema = _STATE.format(kind=kind)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = between(centroids)
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                part = batch[a : a + BLOCK]
                q = part.column(1).flatten().to_numpy().reshape(-1, dims)
                top = int(np.abs(q).max(initial=0))
                if top > LARGEST:
                    raise ValueError("components are too large for 64-bit squared distances")
                q = q.astype(np.int16 if top < 1 << 15 else np.int32)
                cluster, upper, lower = np.zeros(len(q), np.int64), np.full(len(q), np.inf, np.float32), np.zeros((len(q), k), np.float32)
                assign(q, centroids, apart, cluster, upper, lower)
                yield _row(part.column(0), q, cluster, upper, lower, k)

    def move(centroids: np.ndarray, shift: np.ndarray):
        grown, apart = up(shift), between(centroids)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    ids, q, cluster, upper, lower = _read(batch, i, dims)
                    upper = up(upper.astype(np.float64) + grown[cluster])
                    lower = down(lower.astype(np.float64) - grown)
                    assign(q, centroids, apart, cluster, upper, lower)
                    yield _row(ids, q, cluster, upper, lower, k)

        return step

    state = written(rows.mapInArrow(load, schema), "vectors")
    for _ in range(rounds):
        sums, counts = _totals(state, "sums", k * dims).reshape(k, dims), _totals(state, "counts", k)
        after = centroids.copy()
        held = counts > 0
        after[held] = sums[held] // counts[held, None]
        shift = np.sqrt(squared(after, centroids).astype(np.float64))
        before, centroids = state, after
        state = written(before.mapInArrow(move(after, shift), schema), "vectors")
        discard(before)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, q, cluster, _, _ = _read(batch, i, dims)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(squared(q, centroids[cluster]))], ["id", "cluster", "distance"])

    out = written(state.mapInArrow(last, f"id {kind}, cluster int, distance long"), "clusters")
    discard(state)
    inertia = {r["cluster"]: r["d"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = out.sparkSession.createDataFrame([(c, inertia.get(c, 0), sum(inertia.values()), digest[c]) for c in range(k)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = out.join(F.broadcast(known), "cluster")  # k rows
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _totals(state: DataFrame, column: str, n: int) -> np.ndarray:
    """Sums by place of the arrays in a column, n values."""
    out = np.zeros(n, np.int64)
    for r in state.select(F.posexplode(column).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def clusters_sql(dims: int = 64, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256) -> str:
    """The same clusters by plain distances to all centroids, a pair of subqueries a round."""
    steps = [
        f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('{seed}:' || vec_id) AS h, q FROM v ORDER BY h, q LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT vec_id, q, p.c, p.d FROM (SELECT v.vec_id, v.q, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(v.q, x.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), c := x.c)) AS p
    FROM v CROSS JOIN c{r} x GROUP BY v.vec_id, v.q))""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT c, list(s ORDER BY i) AS q FROM (SELECT c, i, CAST(sum(x) AS HUGEINT) // count(*) - CASE WHEN sum(x) < 0 AND sum(x) % count(*) <> 0 THEN 1 ELSE 0 END AS s FROM (SELECT c, unnest(q) AS x, unnest(range({dims})) AS i FROM a{r}) GROUP BY c, i) GROUP BY c),
c{r + 1} AS (SELECT c, coalesce(list_transform(m{r}.q, lambda x: CAST(x AS BIGINT)), o.q) AS q FROM c{r} o LEFT JOIN m{r} USING (c))""")
    n = rounds
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(x.q, ',')) AS centroid_sha256 FROM a{n} JOIN c{n} x USING (c)
"""
