"""Exact ranked lexical search: ball trees over sparse document vectors."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.llm import textkernel as K
from tidewatch.llm.common import Scratch, arrow_rows, partitions, read_table, text_chunks

TERMS = 1 << 15              # terms of the items of one pass, about
ITEMS = 512                  # items of one pass, about
CELLS = 1 << 22              # documents x terms of one tree
LEAF = 64                    # documents of a leaf
SAFE = 1.0 + 1e-4            # covers the rounding of single-precision centres and radii

# A term is made of ASCII letters, digits and all other characters beyond ASCII.
IS_TERM = np.zeros(256, dtype=bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    IS_TERM[_low:_high + 1] = True


def term_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of many texts and the first term of each text."""
    starts, ends, first = K.word_spans(data, offs, IS_TERM)
    return K.span_hashes(K.prefix_sums(K.LOWER[data]), starts, ends), first


class BallTree:
    """Balls around the vectors of a batch of documents.

    Rows are sparse (``bounds``, ``terms``, ``values``); ``scale`` weighs the
    terms. A ball has a centre and a radius that holds all its documents;
    balls are halved between two distant documents down to ``LEAF``
    documents or to equal ones.
    """

    def __init__(self, bounds: np.ndarray, terms: np.ndarray, values: np.ndarray, scale: np.ndarray):
        self.present, column = np.unique(terms, return_inverse=True)
        count = len(bounds) - 1
        dense = np.zeros((count, len(self.present)), np.float32)
        dense[np.repeat(np.arange(count), np.diff(bounds)), column] = scale[terms] * values
        self.place, self.nodes, centres, radii = np.arange(count), [], [], []
        todo = [(0, count, -1)]
        while todo:
            lo, hi, parent = todo.pop()
            rows = dense[self.place[lo:hi]]
            centre = rows.mean(axis=0)
            far = np.sqrt(np.square(rows - centre).sum(axis=1))
            node = len(self.nodes)
            self.nodes.append([lo, hi, []])
            centres.append(centre)
            radii.append(float(far.max()) * SAFE)
            if parent >= 0:
                self.nodes[parent][2].append(node)
            if hi - lo > LEAF and far.max() > 0:
                one = rows[far.argmax()]
                other = rows[np.square(rows - one).sum(axis=1).argmax()]
                side = np.argsort(rows @ (other - one), kind="stable")
                self.place[lo:hi] = self.place[lo:hi][side]
                middle = (lo + hi) // 2
                todo += [(lo, middle, node), (middle, hi, node)]
        # leaves read their rows one after another
        size = np.diff(bounds)[self.place]
        self.start = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(bounds[:-1][self.place] - self.start[:-1], size) + np.arange(self.start[-1])
        self.terms, self.values = column[at], values[at]
        self.centres, self.radii = np.stack(centres).astype(np.float64), np.array(radii)

    def columns(self, own: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Counts of the present terms in some queries (terms, times)."""
        out = np.zeros((len(own), len(self.present)))
        for q, (terms, times) in enumerate(own):
            at = np.minimum(np.searchsorted(self.present, terms), len(self.present) - 1)
            here = self.present[at] == terms
            out[q, at[here]] = times[here]
        return out

    def limits(self, counts: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores in each ball for queries of term counts
        (node, query): centre product plus radius times norm, rounded up."""
        near = self.centres @ counts.T
        return (near + self.radii[:, None] * np.sqrt(np.square(counts).sum(axis=1))[None, :]) * SAFE + 1.0

    def scores(self, node: int, weights: np.ndarray) -> np.ndarray:
        """Exact integer scores of the documents of a leaf."""
        lo, hi, _ = self.nodes[node]
        a, b = self.start[lo], self.start[hi]
        return np.add.reduceat(weights[self.terms[a:b]] * self.values[a:b], self.start[lo:hi] - a)


class Best:
    """The best documents of one query so far."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], 1

    def add(self, scores: list[int], ids: list) -> None:
        rows = self.rows + [(-s, i is None, 0 if i is None else i) for s, i in zip(scores, ids)]
        self.rows = sorted(rows)[:self.k]
        if len(self.rows) == self.k:
            self.least = -self.rows[-1][0]


def search_tree(tree: BallTree, ids: pa.Array, own: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, best: list[Best]) -> None:
    """Best-first search of one tree for all queries: the ball with the
    highest limit is opened first, and a ball below the k-th score ends it."""
    step = max(1, CELLS // max(len(tree.present), len(tree.nodes)))
    scale = weight[tree.present]
    for first in range(0, len(own), step):
        counts = tree.columns(own[first:first + step])
        limits = tree.limits(counts)
        for q in range(len(counts)):
            found, limit = best[first + q], limits[:, q]
            if limit[0] < found.least:
                continue
            weights, queue = counts[q].astype(np.int64) * scale, [(-limit[0], 0)]
            while queue and -queue[0][0] >= found.least:
                node = heapq.heappop(queue)[1]
                inner = tree.nodes[node][2]
                for child in inner:
                    if limit[child] >= found.least:
                        heapq.heappush(queue, (-limit[child], child))
                if not inner:
                    scores = tree.scores(node, weights)
                    good = np.flatnonzero(scores >= found.least)
                    if len(good):
                        where = tree.place[tree.nodes[node][0] + good]
                        found.add(scores[good].tolist(), ids.take(pa.array(where)).to_pylist())


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", k: int = 20, block_terms: int = TERMS) -> DataFrame:
    """The ``k`` highest-scoring documents of each item, by exact integer
    scores above 0. Columns: ``item_id``, ``rank`` (from 1), ``id``,
    ``score``; equal scores by ascending id (null last).

    Terms are the maximal runs of ASCII letters and digits and of all
    characters beyond ASCII, A-Z lower-cased. N documents have terms, L in
    all; a term in df of them weighs w = floor(1000 ln((2N+2)/(2df+1))); a
    document of n terms has m = 100 - 25 + (25 n N) div L and scores the sum
    of w ((10^9 tf) div (1000 tf + 12 m)) over the terms of the item.

    Items pass in blocks of about ``block_terms`` terms and at most about
    ``ITEMS`` items. Each pass reads every
    document once and keeps its counts of the block's terms; documents are
    dealt by their weightiest term, so that balls hold similar ones, and each
    batch of a task is a tree. Only the best rows of each task are ranked
    together. Terms are told apart by 64-bit hashes.

    A null text has no terms; a document without terms does not count, an
    item without any finds nothing. Rows that repeat an id are documents or
    items of their own. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()

    def hash_items(batches):
        for b in batches:
            for lo, hi, data, offs in text_chunks(b.column("t")):
                h, first = term_hashes(data, offs)
                terms = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[:2]), terms], ["tag", "item_id", "terms"])

    tagged = items.select(F.monotonically_increasing_id().alias("tag"), F.col(item_col).alias("item_id"), F.col(item_text_col).alias("t"))
    tagged = scratch.put(tagged.mapInArrow(hash_items, f"tag long, item_id {item_kind}, terms array<long>"), "items")
    total, rows = tagged.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-total // block_terms), -(-rows // ITEMS))
    tagged = tagged.where(F.size("terms") > 0).withColumn("part", F.pmod(F.xxhash64("tag"), F.lit(parts)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    found = spark.createDataFrame([], f"tag long, id {kind}, score long")
    for part in range(parts):
        block = tagged.where(F.col("part") == part).select("tag", "terms").toArrow().combine_chunks()
        if block.num_rows:
            found = found.union(_search_block(texts, block, kind, k, scratch))
    order = Window.partitionBy("tag").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(tagged.select("tag", "item_id"), "tag").select("item_id", "rank", "id", "score")


def _search_block(texts: DataFrame, block: pa.Table, kind: str, k: int, scratch: Scratch) -> DataFrame:
    spark = texts.sparkSession
    tags = block.column("tag").to_numpy()
    lists = [np.array(t, np.int64).view(np.uint64) for t in block.column("terms").to_pylist()]
    vocabulary = np.unique(np.concatenate(lists))

    def count(batches):
        for b in batches:
            for lo, hi, data, offs in text_chunks(b.column("t")):
                h, first = term_hashes(data, offs)
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[at] == h)
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                pairs, tf = np.unique(doc[hit] * len(vocabulary) + at[hit], return_counts=True)
                bounds = np.searchsorted(pairs, np.arange(hi - lo + 1) * len(vocabulary)).astype(np.int32)
                terms = pa.ListArray.from_arrays(pa.array(bounds), pa.array((pairs % len(vocabulary)).astype(np.int32)))
                times = pa.ListArray.from_arrays(pa.array(bounds), pa.array(tf.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo), pa.array(np.diff(first)), terms, times], ["id", "n", "terms", "tf"])

    rows = texts.mapInArrow(count, f"id {kind}, n long, terms array<int>, tf array<int>").where("n > 0")
    rows = scratch.put(rows, "counts")
    n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return spark.createDataFrame([], f"tag long, id {kind}, score long")
    frequency = np.zeros(len(vocabulary), np.int64)
    for term, df in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).toLocalIterator():
        frequency[term] = df
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)
    own = [np.unique(np.searchsorted(vocabulary, h), return_counts=True) for h in lists]
    shared = spark.sparkContext.broadcast((weight, own, tags))

    def weigh(batches):
        weight = shared.value[0]
        for b in batches:
            bounds = b.column("terms").offsets.to_numpy().astype(np.int64)
            terms, tf = (b.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tf"))
            bounds = bounds - bounds[0]
            m = 100 - 25 + (25 * b.column("n").to_numpy() * n_docs) // n_terms
            value = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, np.diff(bounds)))
            # terms by falling contribution name the neighbourhood of a document
            row = np.repeat(np.arange(len(b)), np.diff(bounds))
            order = np.lexsort((terms, -weight[terms] * value, row))
            leading = np.full((len(b), 3), -1, np.int64)
            rank = np.arange(len(terms)) - np.repeat(bounds[:-1], np.diff(bounds))
            for j in range(3):
                at = order[rank == j]
                leading[row[at], j] = terms[at]
            offsets = pa.array(bounds.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *(pa.array(leading[:, j]) for j in range(3)), pa.ListArray.from_arrays(offsets, pa.array(terms.astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(value))], ["id", "l0", "l1", "l2", "terms", "value"])

    def search(batches):
        weight, own, tags = shared.value
        best = [Best(k) for _ in tags]
        for b in batches:
            bounds = b.column("terms").offsets.to_numpy().astype(np.int64)
            terms, value = b.column("terms").flatten().to_numpy(), b.column("value").flatten().to_numpy()
            tree = BallTree(bounds - bounds[0], terms, value, weight)
            search_tree(tree, b.column("id"), own, weight, best)
        rows = [(int(t), None if null else i, -s) for t, found in zip(tags, best) for s, null, i in found.rows]
        columns = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), id_type, pa.int64()))], ["tag", "id", "score"])

    id_type = to_arrow_type(rows.schema["id"].dataType)
    docs_per_tree = max(LEAF, min(2048, CELLS // len(vocabulary)))
    near = rows.where(F.size("terms") > 0).mapInArrow(weigh, f"id {kind}, l0 long, l1 long, l2 long, terms array<int>, value array<long>")
    # the id parts documents that share their leading terms
    order = ["l0", "l1", "l2", F.xxhash64("id")]
    near = scratch.put(near.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("id", "terms", "value"), "near")
    with arrow_rows(spark, docs_per_tree):
        hits = scratch.put(near.mapInArrow(search, f"tag long, id {kind}, score long"), "hits")
    shared.destroy()
    scratch.drop(rows, near)
    return hits


def op13_ranked_search(spark, sf_dir):
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


SQL = r"""
WITH x AS (
  SELECT row_number() OVER () AS tag, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS (SELECT tag, doc_id, len(ts)::BIGINT AS n, ts FROM x WHERE len(ts) > 0),
a AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM d),
t AS (SELECT tag, term, count(*)::BIGINT AS tf FROM (SELECT tag, unnest(ts) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, a GROUP BY term, nd),
i AS (
  SELECT item, item_id, term, count(*)::BIGINT AS times FROM (
    SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (
  SELECT i.item, i.item_id, d.tag, d.doc_id,
         sum(i.times * f.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * (100 - 25 + ((25 * d.n * a.nd) // a.l)))))::BIGINT AS score
  FROM i JOIN f USING (term) JOIN t USING (term) JOIN d ON d.tag = t.tag CROSS JOIN a GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""
