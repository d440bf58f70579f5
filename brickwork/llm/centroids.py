"""Plain Lloyd clustering of vectors, in whole numbers.

Components become integers, floor(scale * x). The centroids go to every task;
``mapInPandas`` takes the squared differences to each centroid in numpy, the
least distance wins, ties go to the smaller number. Every task sums its vectors
by cluster and component, the sums merge through a grouped sum, and the driver,
which holds one row a cluster and component, floors the exact quotients.

Defined results. Vectors that are null, have another number of components or
hold a null or non-finite one take no part, nor do rows without an id; every
other row counts, repeated ones as often as they occur. With fewer vectors than
clusters, each vector starts one. Where ids are equal, the smaller components
come first among the starting centroids. Sums and distances are exact for any
component of a float; distances and inertias beyond a long are its largest
number. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = np.iinfo(np.int64).max
#: Squared distances of 64 components up to SMALL fit in a long; a vector of these is always nearer to such a centroid than to one with a component beyond FAR.
SMALL, FAR = 2**27, 2**33
#: Exact sums travel as longs of so many bits each.
LIMB = 60
#: Components beyond this are taken as this, so that their scaled values are finite.
MOST = 1e300


class Centroids:
    """Whole-number centroids, numbered from 0, and the nearest of them."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        reach = [max(map(abs, r), default=0) for r in rows]
        self.near = [n for n, r in enumerate(reach) if r <= SMALL]
        self.quick = bool(self.near) and all(r <= SMALL or r > FAR for r in reach)
        self.fixed = np.array([rows[n] for n in self.near], np.int64)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and exact squared distance (a long, or an object beyond) of each row of whole doubles."""
        cluster, distance = np.zeros(len(x), np.int32), np.zeros(len(x), object)
        small = (np.abs(x).max(axis=1, initial=0) <= SMALL) & (self.quick and x.shape[1] <= 64)
        if small.any():
            whole, best = x[small].astype(np.int64), None
            for n, c in zip(self.near, self.fixed):
                difference = whole - c
                d = np.einsum("ij,ij->i", difference, difference)
                if best is None:
                    best, at = d, np.full(len(d), n, np.int32)
                else:
                    closer = d < best
                    best[closer], at[closer] = d[closer], n
            cluster[small], distance[small] = at, best
        for i in np.flatnonzero(~small):
            v = [int(c) for c in x[i]]
            distance[i], cluster[i] = min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(self.rows))
        return cluster, distance


def _scaled(vectors: pd.Series, scale: int) -> np.ndarray:
    return np.floor(scale * np.clip(np.stack(vectors.to_numpy()).astype(np.float64), -MOST, MOST))


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """A whole number of any size as signed parts of LIMB bits."""
    sign, rest, n = (-1 if total < 0 else 1), abs(total), 0
    while rest or n == 0:
        yield n, sign * (rest & (2**LIMB - 1))
        rest, n = rest >> LIMB, n + 1


def _summed(centroids: Centroids, scale: int) -> Callable:
    """Per task: by cluster, the exact sum of each component, the number of vectors (-1) and the sum of distances (-2)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple[int, int], int] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            x = _scaled(pdf["v"], scale)
            cluster, distance = centroids.nearest(x)
            small = np.abs(x).max(axis=1) <= SMALL
            for c in np.unique(cluster).tolist():
                mine = cluster == c
                sums = [int(s) for s in x[mine & small].astype(np.int64).sum(axis=0)]
                for row in x[mine & ~small]:
                    sums = [s + int(v) for s, v in zip(sums, row)]
                for j, s in [*enumerate(sums), (-1, int(mine.sum())), (-2, sum(distance[mine].tolist()))]:
                    totals[c, j] = totals.get((c, j), 0) + s
        yield pd.DataFrame([(c, j, n, part) for (c, j), s in totals.items() for n, part in _limbs(s)], columns=["cluster", "component", "limb", "part"]).astype("int64")

    return run


def _totals(kept: DataFrame, centroids: Centroids, scale: int) -> dict[tuple[int, int], int]:
    """The sums of all tasks: one row a cluster, component and limb reaches the driver."""
    parts = kept.mapInPandas(_summed(centroids, scale), "cluster long, component long, limb long, part long")
    merged = parts.groupBy("cluster", "component", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out: dict[tuple[int, int], int] = {}
    for r in merged.collect():
        out[r.cluster, r.component] = out.get((r.cluster, r.component), 0) + (int(r.total) << LIMB * r.limb)
    return out


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, seed: str = "3:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector of ``dims`` components.

    Centroids start as the ``k`` vectors with the smallest SHA-256 of ``seed``
    and id. A round that moves no centroid ends the rounds, as all later ones
    would do the same.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.where(F.col("id").isNotNull() & (F.size("v") == dims) & finite)
    starts = kept.orderBy(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256), "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not starts:
        return df.sparkSession.createDataFrame([], schema)
    now = Centroids([[int(c) for c in x] for x in _scaled(pd.Series([np.array(r.v) for r in starts]), scale)])
    for _ in range(rounds):
        sums = _totals(kept, now, scale)
        moved = Centroids([[sums[n, j] // sums[n, -1] for j in range(dims)] if (n, -1) in sums else c for n, c in enumerate(now.rows)])
        if moved.rows == now.rows:
            break
        now = moved
    inertia = {n: s for (n, j), s in _totals(kept, now, scale).items() if j == -2}
    total, digests = min(LONGEST, sum(inertia.values())), [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.rows]
    of_cluster = [min(LONGEST, inertia.get(n, 0)) for n in range(len(now.rows))]

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            cluster, distance = now.nearest(_scaled(pdf["v"], scale))
            capped = np.array([min(LONGEST, d) for d in distance.tolist()], np.int64)
            yield pd.DataFrame({"vec_id": pdf["id"], "cluster": cluster, "distance": capped, "cluster_inertia": np.array(of_cluster)[cluster], "inertia": total, "centroid_sha256": np.array(digests, object)[cluster]})

    return kept.mapInPandas(assigned, schema)


def lloyd_sql(k: int = 8, rounds: int = 10) -> str:
    """The same by SQL: a round is three tables; the least of k * distance + number picks the cluster."""
    distance = "list_sum(list_transform(list_zip(a.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT"
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM kept ORDER BY sha256('3:' || vec_id), v LIMIT {k}
)"""
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT a.r, any_value(a.vec_id) AS vec_id, any_value(a.v) AS v, min({k} * {distance} + c.c) AS best FROM kept a CROSS JOIN c{n} c GROUP BY a.r)")
        if n < rounds:
            parts.append(f"s{n} AS MATERIALIZED (SELECT c, j, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT best % {k} AS c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{n}) GROUP BY c, j)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT p.c, coalesce(any_value(q.v), any_value(p.v)) AS v FROM c{n} p LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM s{n} GROUP BY c) q ON q.c = p.c GROUP BY p.c)")
    return f"""WITH {", ".join(parts)}
SELECT a.vec_id, (a.best % {k})::INTEGER AS cluster, (a.best // {k})::BIGINT AS distance,
  (sum(a.best // {k}) OVER (PARTITION BY a.best % {k}))::BIGINT AS cluster_inertia, (sum(a.best // {k}) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best % {k}"""


ORACLE_SQL = lloyd_sql()
