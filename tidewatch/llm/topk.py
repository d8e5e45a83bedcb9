"""Exact top-k inner products by aggregation over sorted lists without random
access."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch, arrow_rows, partitions, read_table

CANDIDATES = 8192            # rows whose lists are sorted together, fewer for over 64 components
VALUES = 1 << 22             # components of the queries of one pass (32 MB); they go to every task
CHUNK = 256                  # queries bounded together
SPARE = 4                    # bounds stop when at most so many times k candidates can qualify
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


class SortedLists:
    """The components of a batch of vectors, one list per component, in
    descending order (read from the end for negative weights)."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.order = np.sort(rows, axis=0)
        self.largest = np.abs(rows).max(initial=0.0)

    def after(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Last values read, from the top and from the bottom of each list,
        once ``depth`` entries of both ends have been read."""
        return self.order[len(self.rows) - depth], self.order[depth - 1]

    def bounds(self, depth: int, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores (row, query): an entry that
        was read counts with its value, another with the end of its list for
        the lower and with the last value read for the upper bound. ``up``
        and ``down`` are the positive and negative weights."""
        high, low = self.after(depth)
        x = self.rows
        upper = np.where(x >= high, x, high) @ up.T + np.where(x <= low, x, low) @ down.T
        lower = np.where(x >= high, x, self.order[0]) @ up.T + np.where(x <= low, x, self.order[-1]) @ down.T
        return lower, upper


def whole_scores(rows: np.ndarray, query: np.ndarray) -> list[int]:
    """Exact integer inner products; results beyond 64 bits end at their limits."""
    if max(np.abs(rows).max(initial=0.0), 1.0) * max(np.abs(query).max(initial=0.0), 1.0) * max(len(query), 1) < EXACT:
        return (rows @ query).astype(np.int64).tolist()
    weights = [int(v) for v in query]
    exact = (sum(int(v) * w for v, w in zip(row, weights)) for row in rows)
    return [max(-LONG - 1, min(LONG, s)) for s in exact]


def best(lists: SortedLists, tags: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """(query, score, row, tag) of at least the k best rows of each query.

    The lists are read in steps, twice as deep each time. A row whose upper
    bound is below the k-th largest lower bound cannot qualify. A query is
    done when few enough rows can; their scores are then resolved exactly.
    """
    n, out = len(lists.rows), []
    dims = lists.rows.shape[1]
    slack = 1e-9 * max(lists.largest, 1.0) * max(dims, 1)
    for lo in range(0, len(queries), CHUNK):
        q = queries[lo:lo + CHUNK]
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        open_ = np.arange(len(q))
        depth = min(n, max(1, n // 8))
        while len(open_):
            lower, upper = lists.bounds(depth, up[open_], down[open_])
            # the query's own row takes no place among the lower bounds
            mine = tags[:, None] == own[lo + open_][None, :]
            lower[mine] = -np.inf
            upper[mine] = -np.inf
            reach = np.partition(lower, n - k, axis=0)[n - k] if n > k else np.full(len(open_), -np.inf)
            margin = slack * np.maximum(np.abs(q[open_]).max(axis=1, initial=0.0), 1.0)
            able = (upper >= (reach - 2 * margin)[None, :]) & ~mine
            count = able.sum(axis=0)
            done = (count <= SPARE * k) | (depth == n)
            for j in np.flatnonzero(done).tolist():
                at = np.flatnonzero(able[:, j])
                out += [(lo + int(open_[j]), s, r, int(tags[r])) for s, r in zip(whole_scores(lists.rows[at], q[open_[j]]), at.tolist())]
            open_ = open_[~done]
            depth = min(n, depth * 2)
    return out


def padded(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix; short rows end in zeros."""
    counts = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), dims))
    row = np.repeat(np.arange(len(column)), counts)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    return out


def exact_top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024, every: int = 100,
                query_values: int = VALUES) -> DataFrame:
    """The ``k`` rows with the largest integer inner product for each query.

    Components become floor(scale * x), x as double. Queries are the rows
    whose id is divisible by ``every``; candidates are all rows but the
    query's own row. Columns: ``query_id``, ``rank`` (from 1), ``id``,
    ``score``; equal scores by ascending id (null last).

    Candidates stay where they are: each task sorts the components of up to
    ``CANDIDATES`` rows into lists and reads them for a block of queries;
    queries pass in blocks of about ``query_values`` components, whatever their
    number, and only the best rows of each task are shuffled. Bounds are
    widened by more than the rounding of doubles, scores are exact; one
    beyond 64 bits ends at the limit.

    Null vectors and those with null or non-finite components take no part,
    shorter vectors count as ended by zeros, empty ones score 0. Rows that
    repeat an id are candidates and queries of their own; a null id is no
    query. An empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "topk")
    kind = df.schema[id_col].dataType.simpleString()
    finite = F.forall(F.col(vector_col), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    # a double of this size is whole already
    v = F.transform(F.col(vector_col), lambda x: F.when(F.abs(x.cast("double")) < 1e15, F.floor(x.cast("double") * scale).cast("double"))
                    .otherwise(x.cast("double") * scale))
    rows = df.where(F.col(vector_col).isNotNull() & finite).select(F.col(id_col).alias("id"), v.alias("v"))
    rows = rows.repartition(partitions(spark)).withColumn("tag", F.monotonically_increasing_id())
    rows = scratch.put(rows, "rows")
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score long")
    queries = rows.where(F.col("id") % every == 0)
    # a hash deals the queries evenly, whatever their ids are
    parts = max(1, -(-queries.count() * dims // query_values))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("tag"), F.lit(parts)))
    found = None
    for part in range(parts):
        block = queries.where(F.col("part") == part).select("tag", "id", "v").toArrow().combine_chunks()
        if not block.num_rows:
            continue
        shared = spark.sparkContext.broadcast((block.column("tag").to_numpy(), padded(block.column("v").combine_chunks(), dims)))

        def search(batches, shared=shared):
            own, weights = shared.value
            for b in batches:
                tags = b.column("tag").to_numpy()
                lists = SortedLists(padded(b.column("v"), dims))
                hits = best(lists, tags, weights, own, k)
                q, s, r, t = (np.array(c, np.int64) for c in zip(*hits)) if hits else [np.zeros(0, np.int64)] * 4
                yield pa.RecordBatch.from_arrays([pa.array(own[q]), b.column("id").take(pa.array(r)), pa.array(s), pa.array(t)], ["own", "id", "score", "tag"])

        with arrow_rows(spark, max(8 * k, min(CANDIDATES, 64 * CANDIDATES // max(dims, 1)))):
            hits = rows.select("tag", "id", "v").mapInArrow(search, f"own long, id {kind}, score long, tag long")
            hits = scratch.put(hits, "hits")
        shared.destroy()
        found = hits if found is None else found.union(hits)
    if found is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score long")
    order = Window.partitionBy("own").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "tag")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = queries.select(F.col("tag").alias("own"), F.col("id").alias("query_id"))
    return ranked.join(names, "own").select("query_id", "rank", "id", "score")


def op12_exact_top_k(spark, sf_dir):
    return exact_top_k(read_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


SQL = r"""
WITH e AS (
  SELECT row_number() OVER () AS tag, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
s AS (
  SELECT q.tag, q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0)::BIGINT AS score
  FROM e q JOIN e c ON c.tag <> q.tag WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
