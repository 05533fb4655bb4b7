"""Exact top-k inner products by elimination over a table of pivots.

For a pivot p, |d(q,p) - d(x,p)| never exceeds d(q,x), and the inner product is
(|q|^2 + |x|^2 - d(q,x)^2) / 2. So the largest such difference over all pivots bounds a candidate's
score from above. Candidates are evaluated in the order of their bounds, and a query is done when the next
bound is below its k-th best score. The origin is always a pivot, which gives |q||x| as a bound.

Queries go out in blocks of bounded size, each with the score that k vectors of a bounded sample
already reach, which tasks work out; every task scans its vectors in blocks and returns at most k rows for each
query. Blocks are answered one after the other and written, so that the plan doesn't grow with their number.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import bounded_batches, load, scratch, stored

SCALE = 1024
#: Pivots, vectors from which they are chosen, queries of one pass, vectors of one block.
PIVOTS, SAMPLE, QUERY_BLOCK, BLOCK = 24, 1024, 4096, 8192
#: Bounds are widened by so much of the squared lengths, and distances by the root of so much.
SLACK, ROUNDING = 1e-9, 1e-12
SCHEMA = "query_id long, vec_id long, score long"
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def quantise(column: pa.Array, ids: pa.Array, scale: int = SCALE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each dimension: the ids, and floor(scale * x) of the vectors, as doubles that hold integers.

    Vectors that are null, empty or without an id, and those that hold a component that is null, or not finite times ``scale``, are left out.
    """
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(sizes)])
    known = ~np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
    number = ids.fill_null(0).to_numpy()
    out = {}
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero((sizes == d) & known)
        x = values[at[rows][:, None] + np.arange(d)]
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(x * scale)
        fine = np.isfinite(x).all(1)
        if fine.any():
            out[d] = number[rows][fine], x[fine]
    return out


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows with one vector; those beyond 64 bits saturate."""
    top = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(x.shape[1], 1)
    if top < 2**53:
        return (x @ q).astype(np.int64)
    qs = [int(v) for v in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, qs)), LOW), HIGH) for row in x], np.int64)


class Side(NamedTuple):
    """The queries of one dimension in a block, with what elimination needs."""

    ids: np.ndarray
    q: np.ndarray
    far: tuple[np.ndarray, np.ndarray]  #: distances to the pivots, and how much they may be off
    pivots: np.ndarray
    reached: np.ndarray  #: a score that k vectors of the sample reach, or the lowest number


def distances(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of rows to pivots, and bounds of the rounding errors in them."""
    squares = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :]
    gap = np.maximum(squares - 2 * (x @ pivots.T), 0)
    low, high = np.sqrt(np.maximum(gap - ROUNDING * squares, 0)), np.sqrt(gap + ROUNDING * squares)
    return (low + high) / 2, (high - low) / 2


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """The origin, then always the vector farthest from those chosen."""
    chosen = [np.zeros(sample.shape[1])]
    near = np.full(len(sample), np.inf)
    while len(chosen) < n:
        near = np.minimum(near, distances(sample, chosen[-1][None])[0][:, 0])
        best = int(near.argmax())
        if near[best] <= 0:
            break
        chosen.append(sample[best])
    return np.array(chosen)


def search(side: Side, i: int, ids: np.ndarray, x: np.ndarray, norms: np.ndarray, far: tuple[np.ndarray, np.ndarray], k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merge a block of candidates into the best (ids, scores) of query ``i``."""
    q = side.q[i]
    qq = float(q @ q)
    gap = np.abs(far[0] - side.far[0][i])
    gap -= far[1] + side.far[1][i]
    gap = np.maximum(gap.max(1), 0)
    bound = (qq + norms - gap * gap) / 2 + SLACK * (qq + norms) + 1
    b_ids, b_scores = best
    floor = max(int(side.reached[i]), int(b_scores[-1]) if len(b_scores) >= k else LOW)
    left = np.flatnonzero(bound >= floor)
    left = left[np.argsort(-bound[left])]
    step, at = 4 * k, 0
    while at < len(left) and bound[left[at]] >= floor:
        some = left[at : at + step]
        at, step = at + step, step * 4
        scores = products(x[some], q)
        fine = (ids[some] != side.ids[i]) & (scores >= floor)
        b_ids, b_scores = np.concatenate([b_ids, ids[some][fine]]), np.concatenate([b_scores, scores[fine]])
        order = np.lexsort((b_ids, ~b_scores))[:k]
        b_ids, b_scores = b_ids[order], b_scores[order]
        if len(b_scores) >= k:
            floor = max(floor, int(b_scores[-1]))
    return b_ids, b_scores


def _query_blocks(queries: DataFrame, size: int):
    """Arrow tables of at most ``size`` queries; rows are dealt evenly and then written, so that a block stays the same."""
    n = queries.count()
    if n <= size:
        if n:
            yield queries.toArrow()
        return
    parts = -(-2 * n // size)
    kept = stored(queries.repartition(parts).withColumn("_block", F.spark_partition_id()), "queries")
    for b in range(parts):
        block = kept.where(F.col("_block") == b).drop("_block").toArrow()
        for a in range(0, block.num_rows, size):
            yield block.slice(a, size)


def reach(queries: DataFrame, drawn: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """``queries`` with ``reached``: a score that k vectors of the sample reach, or the lowest number."""
    shared = queries.sparkSession.sparkContext.broadcast(drawn)  # bounded by SAMPLE

    def run(batches):
        for batch in batches:
            out = np.full(batch.num_rows, LOW)
            sizes = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for d, (ids, q) in quantise(batch.column("embedding"), batch.column("vec_id"), 1).items():
                s_ids, s = shared.value.get(d, (np.zeros(0, np.int64), np.zeros((0, d))))
                for at, i, v in zip(np.flatnonzero(sizes == d).tolist(), ids.tolist(), q):
                    scores = products(s[s_ids != i], v)
                    if len(scores) >= k:
                        out[at] = np.partition(scores, len(scores) - k)[len(scores) - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "reached"])

    return queries.mapInArrow(run, "vec_id long, embedding array<double>, reached long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best candidates, ties to the smaller vec_id.

    Both frames have ``vec_id`` and ``embedding``. Candidates are the vectors of the query's dimension
    that don't carry its id: rows that share a query's id count as that query's own. Among candidates each row
    that repeats counts. A query id that repeats is answered once, for its smallest vector after rounding.
    Vectors that ``quantise`` leaves out take no part. A vector with as many components as a text has
    letters is a row as any other; a block holds ``BLOCK`` vectors, so memory is theirs.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    queries = queries.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sane = F.size("embedding") > 0
    for bad in ("isnull(x)", "isnan(x)", f"abs(x * {SCALE}) = double('Infinity')"):
        sane = sane & ~F.expr(f"exists(embedding, x -> {bad})")
    scaled = F.transform("embedding", lambda x: x * SCALE)
    rounded = F.transform(scaled, lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y))  # beyond, doubles hold integers
    queries = queries.where(F.col("vec_id").isNotNull() & sane).select("vec_id", rounded.alias("embedding")).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sample = vectors.where(F.col("vec_id").isNotNull() & sane).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().combine_chunks()
    drawn = quantise(sample.column("embedding").combine_chunks(), sample.column("vec_id").combine_chunks()) if sample.num_rows else {}
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked, paths = None, []
    for block in _query_blocks(reach(queries, drawn, k), query_block):
        if ranked is not None:
            paths.append(scratch(spark, "found"))
            ranked.write.parquet(paths[-1])
        sides = {}
        sizes = block.column("embedding").combine_chunks().value_lengths().to_numpy()
        reached = block.column("reached").to_numpy()
        for d, (ids, q) in quantise(block.column("embedding").combine_chunks(), block.column("vec_id").combine_chunks(), 1).items():
            _, s = drawn.get(d, (None, np.zeros((0, d))))
            pivots = choose_pivots(s) if len(s) else np.zeros((1, d))
            sides[d] = Side(ids, q, distances(q, pivots), pivots, reached[sizes == d])
        shared = spark.sparkContext.broadcast(sides)  # bounded by query_block

        def run(batches, shared=shared):
            best: dict[int, list] = {}
            held: dict[int, list] = {}

            def scan(d):
                ids, x = (np.concatenate(p) for p in zip(*held.pop(d)))
                side = shared.value[d]
                far, norms = distances(x, side.pivots), (x * x).sum(1)
                mine = best.setdefault(d, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(side.ids))
                for i in range(len(side.ids)):
                    mine[i] = search(side, i, ids, x, norms, far, k, mine[i])

            for batch in batches:
                for d, pair in quantise(batch.column("embedding"), batch.column("vec_id")).items():
                    if d in shared.value:
                        held.setdefault(d, []).append(pair)
                        if sum(len(p[0]) for p in held[d]) >= BLOCK:
                            scan(d)
            for d in list(held):
                scan(d)
            for d, mine in best.items():
                q = np.repeat(shared.value[d].ids, [len(m[0]) for m in mine])
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([m[0] for m in mine])), pa.array(np.concatenate([m[1] for m in mine]))], ["query_id", "vec_id", "score"])

        ranked = vectors.mapInArrow(run, SCHEMA).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if ranked is None:
        out = spark.createDataFrame([], SCHEMA + ", rank int")
    elif not paths:
        out = ranked
    else:
        paths.append(scratch(spark, "found"))
        ranked.write.parquet(paths[-1])
        out = spark.read.schema(ranked.schema).parquet(*paths)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk_pivots(spark, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


SQL = """WITH e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    q AS (SELECT vec_id, min(v) AS v FROM e WHERE vec_id % 100 = 0 GROUP BY vec_id),
    s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_dot_product(q.v, e.v) AS BIGINT) AS score FROM q JOIN e ON q.vec_id <> e.vec_id AND len(q.v) = len(e.v))
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
