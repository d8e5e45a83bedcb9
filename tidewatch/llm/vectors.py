"""Near-duplicate vectors by tiled comparison in principal axes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import Scratch, arrow_rows, read_table
from tidewatch.llm.components import components

TILE = 4096                  # vectors of a tile
ROWS = 512                   # rows of a tile compared at a time
LEADS = (16, 32)             # leading axes after which products are bounded


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision (scaled first, so that very large
    and very small components neither overflow nor vanish)."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def tile_links(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) of cosine >= threshold; of one tile with
    itself each pair once.

    The product of the leading axes plus the product of the norms of the
    rest bounds the cosine from above (one matrix product, the norm as one
    more axis). What can still reach the threshold goes on to more axes, and
    what is left at the end is decided by the whole product of the vectors
    as given.
    """
    ra, rb = a @ axes, b @ axes
    leads = [k for k in LEADS if k < a.shape[1]]

    def bounded(r: np.ndarray, k: int) -> np.ndarray:
        return np.hstack((r[:, :k], np.sqrt((r[:, k:] ** 2).sum(axis=1, keepdims=True))))

    left, right = [], []
    first = leads[0] if leads else a.shape[1]
    fb = bounded(rb, first).astype(np.float32).T
    fa = bounded(ra, first).astype(np.float32)
    for lo in range(0, len(a), ROWS):
        start = lo if same else 0
        i, j = np.nonzero(fa[lo:lo + ROWS] @ fb[:, start:] >= np.float32(threshold - 1e-4))
        i, j = i + lo, j + start
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 16):
            x, y = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
            for k in leads[1:]:
                ok = np.einsum("ij,ij->i", bounded(ra[x], k), bounded(rb[y], k)) >= threshold - 1e-9
                x, y = x[ok], y[ok]
            ok = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
            left.append(x[ok])
            right.append(y[ok])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of a link list with a node of its component (not itself)."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        new = new[new[root]] if len(new) else new
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def principal_axes(vectors: DataFrame, dim: int, kind: str) -> np.ndarray:
    """Eigenvectors of the second moments of all unit vectors, largest first;
    each task sums its own products, the sums are added by cell."""
    def moments(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            for lo in range(0, len(b), 4096):
                x = unit_rows(_matrix(b.column(0).slice(lo, 4096), dim, kind))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["m"])

    cells = vectors.select("vec").mapInArrow(moments, "m array<double>").select(F.posexplode("m").alias("cell", "v"))
    got = cells.groupBy("cell").agg(F.sum("v").alias("v")).collect()
    m = np.zeros(dim * dim)
    for r in got:
        m[r["cell"]] = r["v"]
    return np.linalg.eigh(m.reshape(dim, dim))[1][:, ::-1]


def _matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    blobs = [x.as_buffer() for x in column]
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), dim)


def parse_vectors(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """``id``, ``dim``, ``vec`` (bytes): dim 0 and no bytes if the vector is
    null, empty, zero or has a null or non-finite component."""
    v = F.col(vector_col)
    element = df.schema[vector_col].dataType.elementType
    kind, cast = ("<f4", "float") if isinstance(element, T.FloatType) else ("<f8", "double")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), v.cast(f"array<{cast}>").alias("v")).select("id", F.when(good, F.col("v")).alias("v"))

    def encode(batches):
        for b in batches:
            blobs = [None if x is None else np.array(x, kind).tobytes() for x in b.column(1).to_pylist()]
            dims = [0 if x is None else len(x) // np.dtype(kind).itemsize for x in blobs]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())], ["id", "dim", "vec"])

    return rows.mapInArrow(encode, f"id {rows.schema['id'].dataType.simpleString()}, dim int, vec binary"), kind


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, tile: int = TILE) -> DataFrame:
    """Links of cosine >= ``threshold`` between all vectors.

    Equal vectors are one vector with a weight. The distinct ones are sorted
    by the first principal axis into tiles; two tiles are compared unless
    their gap on that axis alone rules out the threshold. Links are counted
    in the task; only a spanning forest of each pair of tiles leaves it.

    Columns: ``id``, ``n_links``, ``component_id`` (smallest id reachable),
    ``kept`` (id is that smallest). A vector that is null, empty, zero or
    holds a null or non-finite component links with nothing, as do vectors
    of different length. Repeated rows link with each other (equal vectors);
    an empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "vectors")
    parsed, kind = parse_vectors(df, id_col, vector_col)
    rows = scratch.put(parsed, "rows")
    distinct = rows.where("dim > 0").groupBy("dim", "vec").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    distinct = scratch.put(distinct.withColumn("node", F.xxhash64("vec")), "distinct")
    found = None
    for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect():
        own = distinct.where(F.col("dim") == r["dim"])
        part = scratch.put(_compare(own, r["dim"], r["n"], kind, threshold, tile, scratch), "found")
        found = part if found is None else found.union(part)
    single = F.when(F.col("r.dim") > 0, F.col("d.n") - 1).otherwise(F.lit(0))
    if found is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    roots = components(found.where("b is not null").select("a", "b"), scratch)
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    nodes = distinct.join(roots, "node", "left").select("dim", "vec", "node", "n", "low", F.coalesce("root", "node").alias("root"))
    smallest = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    nodes = scratch.put(nodes.join(smallest, "root").join(links, "node", "left").select("node", "n", "component_id", F.coalesce("links", F.lit(0)).alias("links")), "nodes")
    out = rows.withColumn("node", F.when(F.col("dim") > 0, F.xxhash64("vec"))).alias("r").join(nodes.alias("d"), F.col("r.node") == F.col("d.node"), "left")
    component = F.when(F.col("r.dim") > 0, F.col("d.component_id")).otherwise(F.col("r.id"))
    return out.select("r.id", (F.coalesce("d.links", F.lit(0)) + single).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("r.id").eqNullSafe(component).alias("kept"))


def _compare(vectors: DataFrame, dim: int, count: int, kind: str, threshold: float, tile: int, scratch: Scratch) -> DataFrame:
    """``a``, ``b``, ``n``: forest links (b not null) and numbers of links."""
    spark = vectors.sparkSession
    axes = spark.sparkContext.broadcast(principal_axes(vectors, dim, kind))
    gap = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    def project(batches):
        for b in batches:
            x = unit_rows(_matrix(b.column(2), dim, kind)) if len(b) else np.zeros((0, dim))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(x @ axes.value[:, 0])], ["node", "n", "vec", "axis"])

    placed = vectors.select("node", "n", "vec").mapInArrow(project, "node long, n long, vec binary, axis double")

    def pack(batches):
        held, tiles = [], 0
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= tile:
                yield packed(held, tiles)
                held, tiles = [], tiles + 1
        if sum(map(len, held)):
            yield packed(held, tiles)

    def packed(held, seq):
        t = pa.Table.from_batches(held).combine_chunks()
        part, axis = t["part"][0].as_py(), t["axis"].to_numpy()
        blobs = [t["node"].to_numpy().tobytes(), t["n"].to_numpy().tobytes(), b"".join(x.as_buffer() for x in t["vec"])]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([axis.min()]), pa.array([axis.max()]),
                                           *(pa.array([x], pa.binary()) for x in blobs)], ["part", "seq", "lo", "hi", "nodes", "ns", "vecs"])

    ranges = placed.repartitionByRange(max(1, -(-count // tile)), "axis", "node").sortWithinPartitions("axis", "node")
    ranges = ranges.select(F.spark_partition_id().alias("part"), "axis", "node", "n", "vec")
    tiles = scratch.put(ranges.mapInArrow(pack, "part int, seq int, lo double, hi double, nodes binary, ns binary, vecs binary"), "tiles")
    lows = sorted((r["lo"], r["hi"], r["part"], r["seq"]) for r in tiles.select("lo", "hi", "part", "seq").collect())
    number = {(part, seq): k for k, (_, _, part, seq) in enumerate(lows)}
    names = spark.createDataFrame([(p, s, k) for (p, s), k in number.items()], "part int, seq int, tile int")
    starts = np.array([lo for lo, *_ in lows])
    last = [int(np.searchsorted(starts, hi + gap, side="right")) - 1 for _, hi, *_ in lows]
    until = spark.createDataFrame(list(enumerate(last)), "tile int, last int")
    tiles = scratch.put(tiles.join(names, ["part", "seq"]).join(until, "tile").select("tile", "last", "nodes", "ns", "vecs"), "numbered")

    def side(b, i, base):
        nodes, ns, vecs = (b.column(base + k)[i].as_buffer() for k in range(3))
        nodes = np.frombuffer(nodes, np.int64)
        return nodes, np.frombuffer(ns, np.int64), unit_rows(np.frombuffer(vecs, kind).reshape(len(nodes), dim))

    def compare(batches):
        for b in batches:
            for i in range(len(b)):
                na, wa, a = side(b, i, 2)
                same = b.column(0)[i].as_py() == b.column(1)[i].as_py()
                nb, wb, other = (na, wa, a) if same else side(b, i, 5)
                x, y = tile_links(a, other, axes.value, threshold, same)
                ids = np.concatenate((na[x], nb[y]))
                got, at = np.unique(ids, return_inverse=True)
                n = np.bincount(at, np.concatenate((wb[y], wa[x])), minlength=len(got)).astype(np.int64)
                fa, fb = forest(na[x], nb[y])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((fa, got))),
                                                  pa.array(np.concatenate((fb, np.zeros(len(got), np.int64))), mask=np.repeat([False, True], [len(fb), len(got)])),
                                                  pa.array(np.concatenate((np.zeros(len(fa), np.int64), n)))], ["a", "b", "n"])

    left = tiles.withColumn("other", F.explode(F.sequence("tile", "last")))
    right = tiles.select(F.col("tile").alias("other"), F.col("nodes").alias("nodes2"), F.col("ns").alias("ns2"), F.col("vecs").alias("vecs2"))
    pairs = left.select("tile", "other").repartition(max(1, len(lows)), "tile", "other")
    pairs = pairs.join(tiles.drop("last").hint("merge"), "tile").join(right.hint("merge"), "other").select("tile", "other", "nodes", "ns", "vecs", "nodes2", "ns2", "vecs2")
    with arrow_rows(spark, 2):
        return scratch.put(pairs.mapInArrow(compare, "a long, b long, n long"), "links")


def op2_near_vectors(spark, sf_dir):
    return near_vectors(read_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.c AS component_id, m.c = v.vec_id AS kept
FROM v JOIN m ON m.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
