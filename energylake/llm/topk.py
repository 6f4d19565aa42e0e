"""Exact top-k by inner product as a Voronoi kNN join.

The greatest inner products of a query are its nearest neighbours once every vector gets one
more component that brings all to the same length (queries get a zero there).  Queries and
vectors are grouped by their nearest pivot.  Of each group only summaries go to the
driver: its radius, and its distances nearest to the pivot.  From these follows, for
each group of queries, a distance within which all its neighbours lie; a vector is sent to those
groups only for which its own distance to its pivot leaves that possible.  Groups are cut into blocks of bounded size and
solved on their own; the best of all blocks are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import ceil_div, map_arrow, reach

#: pivots, taken from the vectors by the order of a hash
PIVOTS = 16
#: queries and vectors that meet in one task
QUERY_BLOCK = 2048
DATA_BLOCK = 50_000
STEP = 2048


def coded(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec, norm2, size): components floor(scale * x) as 64-bit integers in a binary.

    Rows without id, without vector, or with a null or non-finite component are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [np.floor(np.array(v.as_py(), np.float64) * scale).astype(np.int64) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([v.astype("<i8").tobytes() for v in whole], pa.binary()),
                    pa.array([float(v.astype(np.float64) @ v) for v in whole], pa.float64()),
                    pa.array([len(v) for v in whole], pa.int64()),
                ],
                ["id", "vec", "norm2", "size"],
            )

    x = F.col(vector_col)
    bad = F.exists(
        x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf"))
    )
    rows = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull()).filter(~bad)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("x"))
    return map_arrow(rows, run, "id long, vec binary, norm2 double, size long")


def _matrix(vecs: pa.Array | list, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    raw = [np.frombuffer(v.as_py() if isinstance(v, pa.Scalar) else v, "<i8") for v in vecs]
    out = np.zeros((len(raw), width), np.int64)
    for row, v in zip(out, raw, strict=True):
        row[: len(v)] = v
    return out


def _with_pivot(rows: DataFrame, pivots: np.ndarray, longest2: float, lifted: bool) -> DataFrame:
    """`rows` with the nearest pivot and the distance to it.

    `lifted`: the added component makes the vector as long as the longest; else it is zero.
    """
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        own = (p * p).sum(axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"), p.shape[1] - 1).astype(np.float64)
            norm2 = (x * x).sum(axis=1)
            last = np.sqrt(np.maximum(longest2 - norm2, 0)) if lifted else np.zeros(len(x))
            squared = (
                (norm2 + last**2)[:, None] + own - 2 * (x @ p[:, :-1].T + last[:, None] * p[:, -1])
            )
            nearest = squared.argmin(axis=1)
            distance = np.sqrt(np.maximum(squared[np.arange(len(x)), nearest], 0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("vec"),
                    pa.array(nearest.astype(np.int32)), pa.array(distance),
                ],
                ["id", "vec", "pivot", "distance"],
            )

    return map_arrow(rows, run, "id long, vec binary, pivot int, distance double")


def _reaches(
    pivots: np.ndarray, query_radius: dict[int, float], nearest: list, k: int, slack: float
) -> list[tuple[int, int, float]]:
    """(query group, data group, least distance to its pivot of a vector that may count).

    `nearest`: (data group, distance) of the vectors closest to their pivots, k + 1 ids of each
    group at least.  A query may itself be among them, hence one more.  `slack` covers rounding.
    """
    apart = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(axis=2), 0))
    out = []
    for q, radius in query_radius.items():
        bounds = sorted(radius + apart[q, g] + d for g, d in nearest)
        limit = bounds[k] if len(bounds) > k else float("inf")
        for g in range(len(pivots)):
            out.append((q, g, float(apart[q, g] - radius - limit - slack)))
    return out


def _solve(k: int, width: int, exact_floats: bool):
    """Best k vectors of a block for each query of it; ties to the smaller id."""

    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        q_ids = queries.column("id").to_numpy()
        q = _matrix(queries.column("vec"), width)
        ids = data.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        x = _matrix(data.column("vec"), width)[order]
        if exact_floats:
            q = q.astype(np.float64)
            x = x.astype(np.float64)
        # below every score, and its negative is a long too
        least = -(1 << 62)
        best = np.full((len(q), k), least)
        best_ids = np.full((len(q), k), np.iinfo(np.int64).max)
        for i in range(0, len(x), STEP):
            scores = (q @ x[i : i + STEP].T).astype(np.int64)
            here = ids[i : i + STEP]
            scores[q_ids[:, None] == here] = least
            # blocks come in order of id, so only a greater score replaces one
            for row in np.flatnonzero((scores > best[:, -1:]).any(axis=1)):
                s = scores[row]
                some = np.flatnonzero(s > best[row, -1])
                if len(some) > k:
                    # those at the k-th score that have the smallest ids stay
                    cut = np.partition(s[some], -k)[-k]
                    over, at = some[s[some] > cut], some[s[some] == cut]
                    some = np.concatenate([over, at[: k - len(over)]])
                all_s = np.concatenate([best[row], s[some]])
                all_i = np.concatenate([best_ids[row], here[some]])
                first = np.lexsort((all_i, -all_s))[:k]
                best[row], best_ids[row] = all_s[first], all_i[first]
        rows, ranks = np.nonzero(best > least)
        return pa.table(
            {
                "query_id": q_ids[rows],
                "query_no": queries.column("query_no").to_numpy()[rows],
                "vec_id": best_ids[rows, ranks],
                "score": best[rows, ranks],
            }
        )

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int = PIVOTS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest inner products of each query.

    Queries are the rows of `is_query` (a condition on a column `id`), candidates all rows with another
    id.  Rows of equal id and vector count once; a vector shorter than others counts as filled up
    with zeros; rows without id, vector or with null or non-finite components take no part.  A
    table without queries or without candidates gives no rows.  Scores must fit a long.
    """
    spark = vectors.sparkSession
    all_rows = stage(
        coded(vectors, scale, id_col, vector_col).dropDuplicates(["id", "vec"]), "vectors"
    )
    facts = all_rows.agg(F.max("norm2"), F.max("size"), F.count(F.lit(1))).first()
    longest2, width, n = facts[0] or 0.0, int(facts[1] or 0), facts[2]
    chosen = all_rows.orderBy(F.xxhash64("id", "vec"), "id").limit(pivots).collect()
    base = _matrix([r.vec for r in chosen], width).astype(np.float64)
    last = np.sqrt(np.maximum(longest2 - (base * base).sum(axis=1), 0))
    points = np.concatenate([base, last[:, None]], axis=1) if chosen else np.zeros((1, width + 1))

    data = stage(_with_pivot(all_rows, points, longest2, True), "vectors-by-pivot")
    queries = stage(
        _with_pivot(all_rows.filter(is_query), points, longest2, False).withColumn(
            "query_no", F.xxhash64("vec")
        ),
        "queries-by-pivot",
    )
    # summaries: k + 1 distances of each group, and one radius of each
    per_id = data.groupBy("pivot", "id").agg(F.min("distance").alias("distance"))
    close = Window.partitionBy("pivot").orderBy("distance", "id")
    nearest = [
        (r.pivot, r.distance)
        for r in per_id.withColumn("r", F.row_number().over(close)).filter(F.col("r") <= k + 1).collect()
    ]
    sizes = queries.groupBy("pivot").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    slack = 1e-6 * (1.0 + 4 * longest2**0.5)
    table = _reaches(points, {r.pivot: r.radius for r in sizes}, nearest, k, slack)
    chunks = {r.pivot: ceil_div(r.n, QUERY_BLOCK) for r in sizes}
    # one row for each pair of groups: pivots squared at most
    reach_table = spark.createDataFrame(
        [(q, chunks[q], g, least) for q, g, least in table],
        "query_group int, chunks int, pivot int, least double",
    )
    blocks = max(1, ceil_div(n, DATA_BLOCK))

    keys = ["query_group", "chunk", "block"]
    sent = (
        data.join(F.broadcast(reach_table), "pivot")
        .filter(F.col("distance") >= F.col("least"))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(*keys, "id", "vec")
    )
    per_group = reach_table.select(F.col("query_group").alias("pivot"), "chunks").distinct()
    asked = (
        queries.join(F.broadcast(per_group), "pivot")
        .withColumn("query_group", F.col("pivot"))
        .withColumn("chunk", F.pmod(F.xxhash64("id", "query_no"), F.col("chunks")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        .select(*keys, "id", "query_no", "vec")
    )
    exact = longest2 < 2.0**52
    reach(spark)
    found = (
        asked.groupBy(*keys)
        .cogroup(sent.groupBy(*keys))
        .applyInArrow(
            _solve(k, width, exact), "query_id long, query_no long, vec_id long, score long"
        )
    )
    best = Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
