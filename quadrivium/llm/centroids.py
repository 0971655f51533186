"""Centroid clustering of vectors: Lloyd's rounds with Exponion search.

Vectors become integers, ``floor(scale * x)``, so distances and means are exact
and a run gives the same clusters however the rows are dealt.  Every vector
carries an upper bound on the distance to its centroid and a lower bound on
that to all others.  Between rounds the bounds are loosened by how far the
centroids moved; where they still prove the centroid to be the only nearest,
nothing is computed.  Otherwise the distance is tightened, and if that does not
settle it, only centroids in a ball around the current one are scanned: those
within ``2 * distance + distance of the nearest other centroid``, a prefix of
that centroid's list of the others sorted by distance.  The ball holds the
nearest and the second nearest; it is closed, so centroids at equal distance
are all seen and the smallest number wins.  Bounds are floats, widened by
``SLACK``; what decides are integer distances.

A round is one pass over the rows and one over the result for sums: each task
gives at most a row for each centroid.  The driver holds the centroids and
their distances, ``k * (dims + 2 * k)`` numbers.

Edge cases: vectors of another length, null ones and those with a null or
non-finite component are left out; repeated rows are clustered each; rows with
equal ids are ordered by their components where first centroids are chosen; a
null id counts as ''; fewer vectors than ``k`` give fewer centroids; equal
centroids leave the later one empty, and an empty one stays where it is; no
vectors give no rows.  A component of ``2**27`` or more after scaling is an
error, since squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, table

DIMS, SCALE, K, ROUNDS, SEED = 64, 64.0, 16, 3, "1"
LIMIT = 1 << 27
SLACK = 1e-9


@dataclass
class Model:
    """Centroids with what a search needs of them; ``moved``: how far each went in the last update."""

    centroids: np.ndarray
    moved: np.ndarray

    def __post_init__(self):
        between = np.sqrt(squared(self.centroids, self.centroids).astype(np.float64))
        np.fill_diagonal(between, -1.0)  # a centroid stands first in its own list, before equal ones
        self.order = np.argsort(between, axis=1, kind="stable")
        self.away = np.maximum(np.take_along_axis(between, self.order, axis=1), 0.0)
        self.nearest = self.away[:, 1] if len(self.centroids) > 1 else np.full(1, np.inf)
        by = np.sort(self.moved)
        self.others_moved = np.where(self.moved == by[-1], by[-2] if (self.moved == by[-1]).sum() == 1 and len(by) > 1 else by[-1], by[-1])


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all of ``y``; sums below 2**63 survive wrapped terms."""
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)


def search(x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The centroid of every row, its new bounds, and how many distances were computed."""
    at, upper = at.copy(), (upper + model.moved[at]) * (1 + SLACK)
    lower = np.maximum(lower - model.others_moved[at], 0.0) * (1 - SLACK)
    settled = lambda rows: upper[rows] < np.maximum(lower[rows], model.nearest[at[rows]] / 2 * (1 - SLACK))
    every = np.arange(len(x))
    loose = every[~settled(every)]
    own = x[loose] - model.centroids[at[loose]]
    upper[loose] = np.sqrt((own * own).sum(1).astype(np.float64)) * (1 + SLACK)
    computed = len(loose)
    loose = loose[~settled(loose)]
    radius = (2 * upper[loose] + model.nearest[at[loose]]) * (1 + SLACK)
    for c in np.unique(at[loose]):
        mine = at[loose] == c
        rows, inside = loose[mine], np.searchsorted(model.away[c], radius[mine], "right")
        for m in np.unique(inside):
            here = rows[inside == m]
            ball = np.sort(model.order[c, :m])
            found = squared(x[here], model.centroids[ball])
            best = found.argmin(1)  # of equal ones the first, which has the smallest number
            at[here], upper[here] = ball[best], np.sqrt(found[np.arange(len(here)), best].astype(np.float64)) * (1 + SLACK)
            lower[here] = np.sqrt(np.partition(found, 1, axis=1)[:, 1].astype(np.float64)) * (1 - SLACK) if m > 1 else np.inf
            computed += found.size
    return at, upper, lower, computed


def scaled(vectors: DataFrame, dims: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of usable vectors as integers."""
    usable = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    small = F.when(F.exists(vector_col, lambda x: F.abs(F.lit(scale) * x.cast("double")) >= LIMIT - 1), F.raise_error(F.lit(f"a component of {LIMIT} or more after scaling"))).otherwise(whole)
    return vectors.where((F.size(vector_col) == dims) & usable).select(F.col(id_col).alias("id"), small.cast("array<long>").alias("vector"))


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors of the smallest hashes of ``seed:id``, in the order of the hashes."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r["vector"] for r in rows.select(order.alias("hash"), "vector").orderBy("hash", "vector").limit(k).collect()], dtype=np.int64)


def _components(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def assigned(state: DataFrame, model: Model, dims: int) -> DataFrame:
    """One pass: (id, vector, at, upper, lower) with every row at its nearest centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, upper, lower = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                at, upper, lower, _ = search(_components(batch.column(1), dims), at, upper, lower, model)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int32()), pa.array(upper), pa.array(lower)], names=batch.schema.names)

    return state.mapInArrow(run, state.schema)


def new_centroids(state: DataFrame, centroids: np.ndarray, dims: int) -> np.ndarray:
    """The floors of the means; a task adds its rows up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            at, x = batch.column(1).to_numpy(zero_copy_only=False), _components(batch.column(0), dims)
            for c in np.unique(at):
                n[c] += (at == c).sum()
                sums[c] += x[at == c].sum(0)
        some = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * dims, pa.int32()), pa.array(sums[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), lists], names=["at", "n", "sums"])

    parts = state.select("vector", "at").mapInArrow(run, "at int, n long, sums array<long>")
    out = centroids.copy()
    for r in parts.groupBy("at").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).alias("sums")).collect():  # a row for each centroid at most
        out[r["at"]] = [s // r["n"] for s in r["sums"]]
    return out


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, seed: str = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every usable vector, distance squared, and the final centroids."""
    rows = scaled(vectors, dims, scale, id_col, vector_col)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids.reshape(0, dims)
    moved = np.zeros(len(centroids))
    state, made = rows.withColumns({"at": F.lit(0), "upper": F.lit(float("inf")), "lower": F.lit(0.0)}), None
    for _ in range(rounds):
        before, made = made, materialise(assigned(state, Model(centroids, moved), dims), "clusters")
        if before is not None:
            discard(before)
        state, old = made, centroids
        centroids = new_centroids(made, old, dims)
        step = (centroids - old).astype(np.float64)
        moved = np.sqrt((step * step).sum(1)) * (1 + SLACK)
    last = assigned(state, Model(centroids, moved), dims)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _components(batch.column(1), dims) - centroids[batch.column(2).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array((own * own).sum(1))], names=[id_col, "cluster", "distance"])

    kind = last.schema["id"].dataType.simpleString()
    out = materialise(last.select("id", "vector", "at").mapInArrow(distances, f"`{id_col}` {kind}, cluster int, distance long"), "clustered")
    if made is not None:
        discard(made)
    return out, centroids


def _known(number: Column, values: dict[int, int | str], kind: str) -> Column:
    """A look-up in a value for each centroid."""
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast(kind))]), number)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, centroids = clusters(table(spark, sf_dir, "embeddings"))
    if not len(centroids):
        return out.select("vec_id", "cluster", "distance", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    own = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    names = {c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest() for c in own}
    number = F.col("cluster")
    return out.select("vec_id", "cluster", "distance", _known(number, own, "long").alias("cluster_inertia"), F.lit(sum(own.values())).cast("long").alias("inertia"), _known(number, names, "string").alias("centroid_sha256"))


def _sql() -> str:
    """Lloyd's rounds with all distances."""
    steps = ["""kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT 16)
)"""]  # fmt: skip
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS (
  SELECT r, min({{'d': d, 'k': k}}) AS m FROM (SELECT r, k, CAST(list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{i}) GROUP BY r
)""")
        if i < ROUNDS:
            steps.append(f"""s{i} AS (
  SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT a{i}.m.k AS k, unnest(v) AS x, unnest(range(64)) AS i FROM kept JOIN a{i} USING (r)) GROUP BY k, i
), c{i + 1} AS (
  SELECT k, coalesce(w, v) AS v FROM c{i} LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS w FROM s{i} GROUP BY k) USING (k)
)""")
    return f"""WITH {', '.join(steps)}
SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM kept JOIN a{ROUNDS} USING (r) JOIN c{ROUNDS} ON c{ROUNDS}.k = m.k"""


SQL = _sql()
