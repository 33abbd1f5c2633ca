"""Exact top-k inner products by elimination with a table of pivot distances.

Distances from every vector to a bounded number of pivots are computed once.  By
the triangle inequality the distance of a query and a candidate is at least the
largest difference of their distances to one pivot, and the inner product is
(|q|^2 + |x|^2 - d^2) / 2: so the table bounds each score from above.  A query
looks at candidates in the order of their bounds and stops when no bound reaches
its k-th best score.

Queries and candidates meet in blocks, each of vectors with one nearest pivot, so
that a task holds one of each.  Before that every query gets a first k-th best
score from a bounded sample of candidates.  A pair of blocks meets only if the
ranges of their pivot distances allow for a score that one of the queries needs.

Components are integers of any size.  Scores go through floats or 64-bit integers
where these are exact, and through Python's integers elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import staged

#: Pivots, and the vectors they are chosen from and first scores are taken from.
PIVOTS, SAMPLE = 24, 1_024
#: Rows of a block of candidates and of a block of queries.
CANDIDATE_BLOCK, QUERY_BLOCK = 8_192, 8_192
#: Blocks of queries whose ranges a task holds.
MEETING = 256
#: Candidates that a query evaluates before it looks at its bound again; then twice as many.
STEP = 64
SCALE = 256
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _matrix(column, width: int) -> np.ndarray:
    """Rows of components as given, shorter vectors filled with zeros."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _exact(value: float) -> int:
    """floor(256 * value) without rounding or overflow."""
    return int(value) * SCALE if abs(value) >= 2.0**53 else floor(value * SCALE)


def _integers(vectors: np.ndarray) -> np.ndarray:
    """The integer components as floats, which hold them exactly; too large ones are infinite."""
    with np.errstate(over="ignore"):
        return np.floor(vectors * SCALE)


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products of the integer components: int64, or Python's integers if they may be larger."""
    if not queries.size or not candidates.size:
        return np.zeros((len(queries), len(candidates)), dtype=np.int64)
    q, x = _integers(queries), _integers(candidates)
    with np.errstate(over="ignore", invalid="ignore"):
        most = np.abs(q).max() * np.abs(x).max() * queries.shape[1]
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    if most < 2.0**62 and max(np.abs(q).max(), np.abs(x).max()) < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    exact_q, exact_x = ([[_exact(c) for c in row] for row in m.tolist()] for m in (queries, candidates))
    out = np.empty((len(queries), len(candidates)), dtype=object)
    for i, a in enumerate(exact_q):
        for j, b in enumerate(exact_x):
            out[i, j] = sum(c * d for c, d in zip(a, b) if c and d)
    return out


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of integer components as floats."""
    out = np.zeros((len(vectors), len(pivots)))
    with np.errstate(over="ignore", invalid="ignore"):
        for i, p in enumerate(pivots):
            # differences first: no digits of small vectors are lost beside a large pivot
            out[:, i] = np.sqrt(((vectors - p) ** 2).sum(1))
    return out


def _upper(q2, x2, below, far):
    """Bounds of scores from squared lengths, a least distance, and the largest pivot distance of either."""
    # rounding of lengths and distances must not lower a bound, nor must overflow
    with np.errstate(over="ignore", invalid="ignore"):
        off = 1e-12 * far
        bound = (q2 + x2 - np.maximum(below - off, 0.0) ** 2) / 2.0 + 1e-9 * (q2 + x2) + 1.0
        return np.where(np.isfinite(bound), bound, np.inf)


def _choose(vectors: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first pivots; the first is the first row."""
    if not len(vectors):
        return vectors
    chosen = [0]
    nearest = _distances(vectors, vectors[:1])[:, 0]
    while len(chosen) < min(count, len(vectors)):
        far = int(nearest.argmax())
        if nearest[far] == 0.0:
            break
        chosen.append(far)
        nearest = np.minimum(nearest, _distances(vectors, vectors[far : far + 1])[:, 0])
    return vectors[chosen]


def _needed(least: int | None) -> float:
    """What a bound must reach for a score of ``least``; bounds have room for the rounding."""
    if least is None:
        return -np.inf
    try:
        return float(least)
    except OverflowError:
        return np.finfo(float).max if least > 0 else -np.inf


def best_of_block(
    q_ids: np.ndarray, q: np.ndarray, q_far: np.ndarray, floors: list,
    ids: np.ndarray, x: np.ndarray, far: np.ndarray, k: int,
) -> list[tuple[int, int, int]]:
    """(place of the query, candidate, score) of each query's best in one block of candidates.

    ``floors`` are scores that k other candidates of the query are known to reach,
    so lower ones need not be found; None if there is no such score.  ``q_far``
    and ``far`` are rows of the pivot table.
    """
    order = np.argsort(ids, kind="stable")
    ids, x, far = ids[order], x[order], far[order]
    whole_q, whole_x = _integers(q), _integers(x)
    with np.errstate(over="ignore", invalid="ignore"):
        q2, x2 = ((m**2).sum(1) for m in (whole_q, whole_x))
        plain = np.abs(whole_q).max(initial=0.0) * np.abs(whole_x).max(initial=0.0) * q.shape[1] < 2.0**53
    farthest = far.max(1, initial=0.0)
    out: list[tuple[int, int, int]] = []
    for i in range(len(q)):
        below = np.zeros(len(x))
        with np.errstate(invalid="ignore"):
            for p in range(far.shape[1]):
                np.maximum(below, np.nan_to_num(np.abs(far[:, p] - q_far[i, p]), nan=0.0), out=below)
        bound = _upper(q2[i], x2, below, np.maximum(farthest, q_far[i].max(initial=0.0)))
        least: int | None = floors[i]
        able = np.flatnonzero(bound >= _needed(least))
        able = able[np.argsort(-bound[able], kind="stable")]
        best: list[tuple[int, int]] = []  # (-score, candidate)
        start, step = 0, STEP
        while start < len(able):
            part = able[start : start + step]
            if bound[part[0]] < _needed(least):
                break
            start, step = start + step, 2 * step
            score = (whole_x[part] @ whole_q[i]).astype(np.int64) if plain else _scores(q[i : i + 1], x[part])[0]
            use = ids[part] != q_ids[i]
            if least is not None:
                use &= (score >= least).astype(bool)
            best = sorted([*best, *zip((-score[use]).tolist(), ids[part][use].tolist())])[:k]
            if len(best) == k:
                least = -best[-1][0] if least is None else max(least, -best[-1][0])
        out += [(i, c, -s) for s, c in best]
    return out


def _kth(scores: np.ndarray, k: int) -> int | None:
    """The k-th largest, if there are so many."""
    return int(sorted(scores.tolist(), reverse=True)[k - 1]) if len(scores) >= k else None


def top_k(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, ``id_col``, score: each query's k best other rows.

    Components become floor(256 * x), integers of any size, and the score is their
    inner product; shorter vectors count as filled with zeros.  Equal scores go
    to the smaller id.  A score beyond 64 bits is ranked by its value and shown
    as the end of their range.  A vector that is null, or has a null or non-finite
    component, is neither query nor candidate; nor is a row without id.  A row is
    no candidate of a query with its id, so repeated ids do not find each other;
    repeated rows of a query answer once, and different vectors of one query id
    answer each for itself, so that there are k rows for every such vector.  An
    empty table gives no rows.
    """
    value = F.col("v").cast("array<double>")
    usable = F.col("v").isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = (
        vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"), is_query.alias("q"))
        .filter(F.col("id").isNotNull() & F.coalesce(usable, F.lit(False)))
        .select("id", F.coalesce("q", F.lit(False)).alias("q"), value.alias("v"))
    )
    by_chance = F.xxhash64("id")
    sample = rows.orderBy(by_chance, "id", "v").limit(SAMPLE).collect()  # bounded
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    sample_ids = np.array([r.id for r in sample], dtype=np.int64)
    sample_x = _matrix([r.v for r in sample], width)
    pivots = _choose(_integers(sample_x)[np.isfinite(_integers(sample_x)).all(1)], PIVOTS)

    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pivot table; for queries also the k-th best score in the sample."""
        for batch in batches:
            x = _matrix(batch.column("v").to_pylist(), width)
            ids = batch.column("id").to_pylist()
            far = _distances(_integers(x), pivots)
            with np.errstate(over="ignore"):
                length = (_integers(x) ** 2).sum(1)
            finite = np.isfinite(far).all(1)
            cell = np.where(finite, np.argmin(far, axis=1), -1) if far.shape[1] else np.zeros(len(ids))
            floors: list[str | None] = [None] * len(ids)
            for i, asks in enumerate(batch.column("q").to_pylist()):
                if asks and (kth := _kth(_scores(x[i : i + 1], sample_x[sample_ids != ids[i]])[0], k)) is not None:
                    floors[i] = str(kth)
            yield pa.record_batch(
                [
                    *(batch.column(c) for c in ("id", "q", "v")),
                    pa.array(list(far), pa.list_(pa.float64())),
                    pa.array(length, pa.float64()),
                    pa.array(cell.astype(np.int32)),
                    pa.array(floors, pa.string()),
                ],
                names=["id", "q", "v", "far", "length", "cell", "floor"],
            )

    kinds = "id bigint, q boolean, v array<double>, far array<double>, length double, cell int, floor string"
    table = staged(rows.mapInArrow(tabulate, kinds), "pivot-table")

    def dealt(members: DataFrame, size: int) -> DataFrame:
        """``members`` with their block: a part of those with one nearest pivot, which are few cells.

        Where all of them are fewer than a block for each cell, cells share blocks.
        """
        blocks = max(1, -(-members.count() // size))
        if blocks <= len(pivots):
            members = members.withColumn("cell", F.pmod("cell", F.lit(blocks)))
        cells = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
        # rows that repeat an id do not share a block for that
        at = F.concat_ws("-", "cell", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("parts")))
        return members.join(F.broadcast(cells.limit(PIVOTS + 1)), "cell").withColumn("block", at).drop("cell", "parts")

    candidates = staged(dealt(table.select("id", "v", "far", "length", "cell"), CANDIDATE_BLOCK), "pivot-candidates")
    asking = dealt(table.filter("q").drop("q").dropDuplicates(["id", "v"]), QUERY_BLOCK)
    queries = staged(asking.withColumn("nth", F.monotonically_increasing_id()), "pivot-queries")
    meetings = staged(_meetings(queries, candidates, len(pivots)), "pivot-meetings")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"nth": [], "query_id": [], "id": [], "score": []})
        floors = [None if f is None else int(f) for f in left["floor"]]
        found = best_of_block(
            left["id"].to_numpy(), _matrix(left["v"].tolist(), width), np.array(left["far"].tolist()).reshape(len(left), -1), floors,
            right["id"].to_numpy(), _matrix(right["v"].tolist(), width), np.array(right["far"].tolist()).reshape(len(right), -1), k,
        )
        nth, ids = left["nth"].tolist(), left["id"].tolist()
        return pd.DataFrame([(nth[i], ids[i], c, str(s)) for i, c, s in found], columns=["nth", "query_id", "id", "score"])

    asked = queries.withColumnRenamed("block", "qb").join(meetings, "qb").select("qb", "cb", "nth", "id", "v", "far", "floor")
    given = candidates.withColumnRenamed("block", "cb").join(meetings, "cb").select("qb", "cb", "id", "v", "far")
    found = asked.groupBy("qb", "cb").cogroup(given.groupBy("qb", "cb")).applyInPandas(meet, "nth bigint, query_id bigint, id bigint, score string")
    # as text, scores beyond 64 bits keep their order: by sign, digits, then digit by digit
    negative, digits = F.col("score").startswith("-"), F.length("score")
    order = [
        F.when(negative, -digits).otherwise(digits).desc(),
        F.when(negative, F.lit(None)).otherwise(F.col("score")).desc(),
        F.when(negative, F.col("score")).asc(),
        F.col("id"),
    ]
    best = Window.partitionBy("query_id", "nth").orderBy(*order)
    ends = F.when(negative, F.lit(LEAST)).otherwise(F.lit(MOST))
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), F.coalesce(F.expr("try_cast(score as bigint)"), ends).alias("score"))
    )


def _meetings(queries: DataFrame, candidates: DataFrame, n_pivots: int) -> DataFrame:
    """(qb, cb): blocks with a bound that reaches what one of the queries needs.

    Each block is one row here: the ranges of its pivot distances, its largest
    length, and its queries' least floor.
    """
    def ranges(rows: DataFrame, name: str, *more) -> DataFrame:
        each = [f(F.get("far", F.lit(p))) for p in range(n_pivots) for f in (F.min, F.max)]
        return rows.groupBy(F.col("block").alias(name)).agg(F.array(*each).cast("array<double>").alias(f"{name}_far"), F.max("length").alias(f"{name}_length"), *more)

    # a query without a floor needs every candidate
    need = F.when(F.count_if(F.col("floor").isNull()) == 0, F.min(F.col("floor").cast("double"))).alias("need")
    asks, has = ranges(queries, "qb", need), ranges(candidates, "cb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            q, x = (np.array(b[c].tolist(), dtype=float).reshape(len(b), -1, 2) for c in ("qb_far", "cb_far"))
            with np.errstate(invalid="ignore"):
                gaps = np.nan_to_num(np.maximum(x[:, :, 0] - q[:, :, 1], q[:, :, 0] - x[:, :, 1]), nan=0.0, posinf=0.0, neginf=0.0)
            far = np.maximum(q[:, :, 1].max(1, initial=0.0), x[:, :, 1].max(1, initial=0.0))
            bound = _upper(b["qb_length"].to_numpy(float), b["cb_length"].to_numpy(float), gaps.max(1, initial=0.0), far)
            need = b["need"].to_numpy(float)
            # a floor as a float may be rounded up
            yield b.loc[np.isnan(need) | (bound >= need - 1e-9 * np.abs(need)), ["qb", "cb"]]

    # blocks of queries in groups; each candidate block goes to each group
    asks = staged(asks, "pivot-asks")
    groups = max(1, -(-asks.count() // MEETING))
    asks = asks.withColumn("g", F.pmod(F.xxhash64("qb"), F.lit(groups)).cast("int"))
    has = has.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return asks.join(has, "g").mapInPandas(run, "qb string, cb string")


OP3_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
