"""Centroid clustering (operator 12): Lloyd's rounds on whole numbers, with an annulus search for the nearest centroid.

Centroids are sorted by norm. A vector's distance to the centroid whose norm is closest to its own is an upper bound of the
distance to its nearest one; by the triangle inequality the nearest has a norm within that bound of the vector's norm, at the
bound itself included, and a binary search gives those centroids. They alone are compared, exactly, in whole numbers; of equal
distances the smaller centroid number wins. The centroids, k times the number of components, are the only thing that goes to
every task, and sums by centroid the only thing that comes back.

A vector takes part if it has exactly the given number of components, none of them null, NaN or infinite, and none beyond
LARGEST in magnitude once it is scaled, as its squared distances wouldn't fit a long then. Null and empty vectors don't take
part. The first centroids are the vectors of least hash of `seed:vec_id`; a null id comes after all others, and equal ids are
told apart by their vectors. With fewer vectors than centroids there are as many centroids as vectors. Every row that takes part gives one row, repeated rows
and null ids too; an empty table gives none. Extra columns are not looked at."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscine.llm import common as C
from oscine.llm import vectors

CENTROIDS, ROUNDS, COMPONENTS, SCALE, SEED = 16, 3, 64, 64, 1
#: Squared distances of vectors of at most 64 such components fit 64 bits.
LARGEST = 1 << 27
#: What norms and bounds may be off by rounding, as a part of their size.
_SLACK = 1e-9


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid for each row of whole numbers, and the squared distance to it."""
    norms, own = np.sqrt((centroids**2).sum(1)), np.sqrt((x**2).sum(1))
    order = np.argsort(norms, kind="stable")
    ring = norms[order]
    at = np.clip(np.searchsorted(ring, own), 1, len(ring) - 1) if len(ring) > 1 else np.zeros(len(x), np.int64)
    if len(ring) > 1:
        at -= own - ring[at - 1] < ring[at] - own
    best = order[at]
    distance = ((x - centroids[best]) ** 2).sum(1)
    bound = np.sqrt(distance)
    slack = _SLACK * (1 + own + bound)
    low, high = np.searchsorted(ring, own - bound - slack), np.searchsorted(ring, own + bound + slack, "right")
    for j in range(len(ring)):
        rows = np.flatnonzero((low <= j) & (j < high) & (at != j))
        there = ((x[rows] - centroids[order[j]]) ** 2).sum(1)
        closer = (there < distance[rows]) | ((there == distance[rows]) & (order[j] < best[rows]))
        distance[rows[closer]], best[rows[closer]] = there[closer], order[j]
    return best, distance


def _whole(batch: pa.RecordBatch, components: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the batch that take part, and their vectors in whole numbers."""
    for rows, found in vectors.matrices(batch.column("vector")):
        if found.shape[1] == components:
            with np.errstate(over="ignore"):
                scaled = np.floor(found * scale)
            fit = (np.abs(scaled) <= LARGEST).all(1)
            return rows[fit], scaled[fit].astype(np.int64)
    return np.zeros(0, np.int64), np.zeros((0, components), np.int64)


def _first(rows: DataFrame, k: int, components: int, scale: int, seed: int) -> np.ndarray:
    """The vectors of least hash, in whole numbers: k rows come to the driver."""
    fits = F.forall("vector", lambda x: x.isNotNull() & (F.abs(F.floor(x.cast("double") * scale)) <= LARGEST))
    known = rows.where(F.col("vector").isNotNull() & (F.size("vector") == components)).where(fits & ~F.exists("vector", F.isnan))
    chosen = known.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "vector").orderBy(F.asc_nulls_last("hash"), "vector").limit(k)
    return np.array([[int(np.floor(float(x) * scale)) for x in r["vector"]] for r in chosen.collect()], np.int64).reshape(-1, components)


def _moved(rows: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round: floors of the exact means; a centroid without vectors stays."""
    k, components = centroids.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, components), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            _, x = _whole(batch, components, scale)
            best, _ = nearest(x, centroids)
            counts += np.bincount(best, minlength=k)
            for c in np.unique(best):
                sums[c] += x[best == c].sum(0)
        full = np.flatnonzero(counts)
        yield pa.record_batch({"c": pa.array(full, pa.int32()), "n": pa.array(counts[full]), "sums": pa.array(list(sums[full]), pa.list_(pa.int64()))})

    parts = rows.select("vector").mapInArrow(summed, "c int, n long, sums array<long>")
    each = parts.select("c", "n", F.posexplode("sums").alias("at", "x")).groupBy("c", "at")
    moved = centroids.copy()
    for r in each.agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # k times components rows
        moved[r["c"], r["at"]] = int(r["x"]) // r["n"]
    return moved


def cluster(
    docs: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED, vec_id: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """The assigned vectors (vec_id, cluster, distance), written to the shared folder, and the final centroids."""
    if components > COMPONENTS:
        raise ValueError(f"at most {COMPONENTS} components")
    rows = docs.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    centroids = _first(rows, k, components, scale, seed)
    if not len(centroids):
        return docs.sparkSession.createDataFrame([], rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).schema), centroids
    for _ in range(rounds):
        centroids = _moved(rows, centroids, scale)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _whole(batch, components, scale)
            best, distance = nearest(x, centroids)
            yield pa.record_batch({"vec_id": batch.column("vec_id").take(pa.array(at)), "cluster": pa.array(best, pa.int32()), "distance": pa.array(distance)})

    kind = rows.schema["vec_id"].dataType.simpleString()
    return C.materialize(rows.mapInArrow(assigned, f"vec_id {kind}, cluster int, distance long"), "clusters"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assigned vectors, with the sum of distances of their cluster and of all, and the hash of their centroid."""
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    table = [(i, sums[i], sum(sums.values()), hashes[i]) for i in sums]
    of_cluster = assigned.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """DuckDB: all centroids are compared with all vectors, round by round."""
    assign = """d{r} AS (SELECT vec_id, x, c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - k.m[i]) * (v.x[i] - k.m[i])))::BIGINT AS d FROM v, c{r} k),
a{r} AS (SELECT vec_id, x, arg_min(c, d * 16 + c) AS c, min(d) AS d FROM d{r} GROUP BY vec_id, x)"""
    move = """s{r} AS (SELECT c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY c, i),
m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM s{r} GROUP BY c),
c{n} AS (SELECT k.c, coalesce(m{r}.m, k.m) AS m FROM c{r} k LEFT JOIN m{r} USING (c))"""
    steps = [
        "v AS (SELECT vec_id, list_transform(embedding, lambda y: floor(y::DOUBLE * 64)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x AS m FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16)",
    ]
    for r in range(ROUNDS):
        steps += [assign.format(r=r), move.format(r=r, n=r + 1)]
    steps.append(assign.format(r=ROUNDS))
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(list_aggregate(k.m, 'string_agg', ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} k USING (c)"""


ORACLE = _oracle()
