"""Exact top-k search by distributed histogram selection.

Components become whole numbers, floor(scale * x); the score is their inner
product. The queries go in blocks of bounded size against all rows. For each
query the interval that its scores can lie in, by the norms, is cut into bins;
every task counts its scores in the bins (leaving out those below its own k-th
best, which can't hold the global k-th), the counts are summed, and the bin
that holds the k-th score becomes the next interval, until it is one score
wide. A last pass keeps what scores higher
and, of those that tie with the k-th, the smallest ids.

Defined results. Vectors that are null, empty, or hold null or non-finite
components take no part, nor do rows with a null id; vectors of different
lengths have no score. Every row with a query's id is a query of its own, and
no row with its id is its candidate. With fewer than k candidates, all are
returned. Ties go to the smaller id. Any finite component takes part: scores are
exact, and those beyond a long are its largest number or minus that. An empty
table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import new_path, written

LOWEST = np.iinfo(np.int64).min


LONGEST = np.iinfo(np.int64).max
#: Components beyond this are taken as this, so that their scaled values are finite; their scores don't fit in a long anyway.
FAR = 1e300


def _rows(batch: pa.RecordBatch, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and scaled vectors of the rows that take part."""
    ids, vectors = batch.column(0), batch.column(1)
    lengths = np.asarray(vectors.value_lengths().fill_null(0))
    flat = vectors.flatten().cast(pa.float64())
    values = np.asarray(flat.fill_null(np.nan))
    ends = np.cumsum(lengths)
    known = np.asarray(ids.is_valid())
    out = {}
    for length in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == length)
        block = values[(ends[at] - length)[:, None] + np.arange(length)]
        ok = np.isfinite(block).all(axis=1) & known[at]
        if ok.any():
            out[length] = np.asarray(ids.fill_null(0))[at[ok]], np.floor(scale * np.clip(block[ok], -FAR, FAR))
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    """Euclidean norms, not too small by rounding, of vectors whose squares may overflow."""
    most = np.maximum(np.abs(x).max(axis=1), 1)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9)


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of candidates (rows) and queries (columns), exact; those that don't fit in a long are its ends."""
    most = q.shape[1] * float(np.abs(q).max()) * float(np.abs(c).max())
    if most < 2**53:  # whole-number products are exact in the narrowest type that holds the largest possible one
        kind = np.float32 if most < 2**24 else np.float64
        return c.astype(kind) @ q.astype(kind).T
    fits = lambda x: np.where(np.abs(x) < 2**62, x, 0).astype(np.int64)
    s = fits(c) @ fits(q).T  # right whatever wraps on the way, where the result fits
    with np.errstate(over="ignore"):
        beyond = np.nonzero(_norms(c)[:, None] * _norms(q)[None] >= 2**62)
    whole = {("c", r): [int(v) for v in c[r]] for r in set(beyond[0].tolist())} | {("q", n): [int(v) for v in q[n]] for n in set(beyond[1].tolist())}
    for r, n in zip(*(x.tolist() for x in beyond)):
        s[r, n] = max(-LONGEST, min(LONGEST, sum(a * b for a, b in zip(whole["c", r], whole["q", n]))))
    return s


def _scores(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of candidates (rows) for queries (columns), and where a candidate has the query's own id."""
    order = np.argsort(q_ids, kind="stable")
    left, right = (np.searchsorted(q_ids[order], ids, side) for side in ("left", "right"))
    hit = np.flatnonzero(right > left)
    rows = np.repeat(hit, (right - left)[hit])
    columns = order[np.concatenate([np.arange(a, b) for a, b in zip(left[hit], right[hit])])] if len(hit) else hit
    return _exact(q, c), np.stack([rows, columns])


def _tops(length: int, scale: int, q_ids, q, k: int, step: int, tile: int):
    """From batches: candidates' ids, their scores for one tile of queries, and which reach the k best of the task so far.

    What is below a task's own k-th best can't be among the k best of all; own rows never reach.
    """

    def run(batches):
        best = [None] * -(-len(q) // tile)  # the k best scores of each query so far, by tile
        for batch in batches:
            if length not in (rows := _rows(batch, scale)):
                continue
            ids, c = rows[length]
            for at in range(0, len(ids), step):
                for t in range(len(best)):
                    of = slice(t * tile, (t + 1) * tile)
                    s, own = _scores(q_ids[of], q[of], ids[at : at + step], c[at : at + step])
                    s[own[0], own[1]] = -np.inf if s.dtype.kind == "f" else LOWEST
                    top = np.partition(s, len(s) - k, axis=0)[len(s) - k :] if len(s) > k else s
                    top = np.where(np.isneginf(top), LOWEST, np.where(np.isneginf(top), 0, top).astype(np.int64)) if s.dtype.kind == "f" else top
                    top = top if best[t] is None else np.concatenate([best[t], top])
                    best[t] = np.partition(top, len(top) - k, axis=0)[len(top) - k :] if len(top) > k else top
                    keep = s >= best[t].min(axis=0) if len(best[t]) == k else np.ones(s.shape, bool)
                    keep[own[0], own[1]] = False
                    yield t * tile, ids[at : at + step], s, keep

    return run


def _counts(tops, low, span, width, bins: int, most: int = 1 << 20):
    """Counts of scores by query and bin of its interval, merged whenever ``most`` entries are held."""

    def merged(parts):
        key, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return key, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(key)).astype(np.int64)

    def run(batches):
        parts, held = [], 0
        for first, _, s, keep in tops(batches):
            r, n = np.nonzero(keep)
            score, n = s[r, n].astype(np.int64), n + first
            beyond = score.astype(np.uint64) - low[n].astype(np.uint64)  # right modulo 2 ** 64
            inside = (score >= low[n]) & (beyond < span[n])
            n, b = n[inside], (beyond[inside] // width[n[inside]]).astype(np.int64)
            parts.append(np.unique(n * np.int64(bins) + b, return_counts=True))
            held += len(parts[-1][0])
            if held > most:
                parts = [merged(parts)]
                held = len(parts[0][0])
        if parts:
            key, n = merged(parts)
            for at in range(0, len(key), 1 << 16):
                of = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(key[of] // bins), pa.array(key[of] % bins), pa.array(n[of])], names=["q", "bin", "n"])

    return run


def _winners(tops, q_ids, kth, ties):
    """Candidates above each query's k-th score, and the smallest ids of those that tie with it."""

    def run(batches):
        for first, ids, s, keep in tops(batches):
            r, n = np.nonzero(keep)
            score, n = s[r, n].astype(np.int64), n + first
            pdf = pd.DataFrame({"q": n, "query_id": q_ids[n], "vec_id": ids[r], "score": score})[score >= kth[n]]
            tied = pdf["score"].to_numpy() == kth[pdf["q"].to_numpy()]
            few = pdf[tied].sort_values(["q", "vec_id"])
            few = few[few.groupby("q").cumcount().to_numpy() < ties[few["q"].to_numpy()]]
            yield pa.RecordBatch.from_pandas(pd.concat([pdf[~tied], few]), preserve_index=False)

    return run


def top_k(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, every: int = 20, scale: int = 64, bins: int = 1024, block_bytes: int = 32 << 20, tile: int = 4096, step: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row whose id is divisible by ``every``.

    ``block_bytes`` bounds the queries that go to all tasks at once, 65,536
    vectors of 64 components; a pass over all rows serves such a block, a tile
    of ``tile`` queries after the other.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))

    def measured(batches):
        for batch in batches:
            found = [(length, int((ids % every == 0).sum()), float(_norms(c).max())) for length, (ids, c) in _rows(batch, scale).items()]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(found, columns=["length", "queries", "most"]).astype({"length": "int64", "queries": "int64", "most": "float64"}), preserve_index=False)

    lengths = rows.mapInArrow(measured, "length long, queries long, most double").groupBy("length").agg(F.sum("queries").alias("queries"), F.max("most").alias("most")).collect()

    asked = rows.where(F.col("id") % every == 0)
    out, parts = new_path(spark, "top-k"), 0
    schema = "query_id long, rank int, vec_id long, score long"
    for length, queries, most in sorted(map(tuple, lengths)):
        if not queries:
            continue
        blocks = -(-queries * 8 * length // block_bytes)
        of_length = written(asked.where(F.size("v") == length).withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks))), "queries")
        for block in range(blocks):
            table = of_length.where(F.col("block") == block).select("id", "v").toArrow()
            got = [r[length] for b in table.to_batches() if length in (r := _rows(b, scale))]
            if not got:
                continue
            q_ids, q = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            order = np.lexsort([*q.T[::-1], q_ids])
            q_ids, q = q_ids[order], q[order]
            tops = _tops(length, scale, q_ids, q, k, step, tile)
            with np.errstate(over="ignore"):
                reach = [LONGEST if r >= 2**62 else min(LONGEST, int(r) + 1) for r in (_norms(q) * most).tolist()]  # no score is larger
            low, above = np.array([-r for r in reach], np.int64), np.zeros(len(q), np.int64)
            span = np.array([2 * r + 1 for r in reach], np.uint64)
            all_of_them = np.zeros(len(q), bool)
            while True:
                width = (span - np.uint64(1)) // np.uint64(bins) + np.uint64(1)
                counted = rows.mapInArrow(_counts(tops, low, span, width, bins), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
                upto = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
                hold = counted.withColumn("upto", upto).join(spark.createDataFrame(pa.table({"q": np.arange(len(q)), "above": above})), "q")
                hold = hold.where((F.col("above") + F.col("upto") >= k) & (F.col("above") + F.col("upto") - F.col("n") < k)).select("q", "bin", (F.col("above") + F.col("upto") - F.col("n")).alias("higher")).toArrow()  # one row a query of the block
                at, b = np.asarray(hold["q"]), np.asarray(hold["bin"])
                low[at] += (b.astype(np.uint64) * width[at]).astype(np.int64)  # right modulo 2 ** 64
                above[at] = np.asarray(hold["higher"])
                found = np.zeros(len(q), bool)
                found[at] = True
                all_of_them |= ~found  # fewer than k candidates
                span = width
                if (width == 1).all():
                    break
            kth = np.where(all_of_them, LOWEST, low)
            ties = np.where(all_of_them, k, k - above)
            best = rows.mapInArrow(_winners(tops, q_ids, kth, ties), "q long, query_id long, vec_id long, score long")
            rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
            best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
            parts += 1
    return spark.read.schema(schema).parquet(out) if parts else spark.createDataFrame([], schema)


ORACLE_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
