"""Similarity join of documents by the Jaccard index of word n-grams."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.grams import bits_set
from tidewatch.llm import textkernel as K
from tidewatch.llm.common import Scratch, arrow_rows, binary_column, partitions, read_table, text_chunks
from tidewatch.llm.components import components
from tidewatch.operators.term_index import gram_bitmap

BAND_RATIO = 1.6             # upper end of a size band over its lower end
BLOCK = 1024                 # sets of one side of a block of pairs: at most 16 MB of signatures a block
HELD = 50_000                # partners of open sets that a task holds before it gives them out
STAR = 1024                  # partners that one copy of a pivot is compared with
SPARE = 0.08                 # share of tiles beyond those that differences can spoil
FIRST, FURTHER = 8, 16       # partners of an open set in the first round, growth in further ones


class Bands:
    """Size bands and the number of tiles of each.

    A pair with the smaller set in band b differs in at most d(b) hashes, so
    of more than d(b) tiles of the hash range that are not empty one holds
    the same hashes in both sets.
    """

    def __init__(self, percent: int, largest: int = 1 << 40):
        low = [1]
        while low[-1] <= largest:
            low.append(max(low[-1] + 1, int(low[-1] * BAND_RATIO)))
        self.percent = percent
        self.low = np.array(low, np.int64)
        self.differ = (100 - percent) * (self.low[1:] - 1) // percent
        self.tiles = np.where(self.differ > 0, self.differ + 1 + np.maximum(2, np.ceil(SPARE * self.differ).astype(np.int64)), 0)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, side="right") - 1

    def smallest(self, size: np.ndarray) -> np.ndarray:
        """Band of the smallest partner of a set of this size."""
        return self.of(np.maximum(1, -(-self.percent * size // 100)))


def set_ids(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit identifier per set; equal sets have equal ones."""
    size = np.diff(bounds)
    total = np.concatenate(([np.uint64(0)], np.cumsum(K.mix(h ^ np.uint64(0xA5A5A5A5)))))
    return K.mix(total[bounds[1:]] - total[bounds[:-1]] + size.astype(np.uint64)).view(np.int64)


def tile_keys(h: np.ndarray, bounds: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) for the tiles in which a partner of the set may agree."""
    size = np.diff(bounds)
    top, low = bands.of(np.maximum(size, 1)), bands.smallest(np.maximum(size, 1))
    sets, keys = [], []
    for back in range(int((top - low).max(initial=0)) + 1):
        band = top - back
        own = np.flatnonzero((band >= low) & (size > 0) & (bands.tiles[np.maximum(band, 0)] > 0))
        if not len(own):
            continue
        at = np.repeat(bounds[own] - np.cumsum(size[own]) + size[own], size[own]) + np.arange(size[own].sum())
        owner = np.repeat(np.arange(len(own)), size[own])
        tiles = bands.tiles[band[own]]
        x = h[at]
        tile = ((x >> np.uint64(32)) * tiles[owner].astype(np.uint64)) >> np.uint64(32)
        first = np.ones(len(x), bool)
        first[1:] = (tile[1:] != tile[:-1]) | (owner[1:] != owner[:-1])
        start = np.flatnonzero(first)
        content = np.add.reduceat(K.mix(x), start)
        o, t = owner[start], tile[start]
        filled = np.bincount(o, minlength=len(own))
        spoilt = np.flatnonzero(filled <= bands.differ[band[own]])
        if len(spoilt):                          # too few: empty tiles count too
            taken = set(zip(o.tolist(), t.tolist()))
            gaps = [(s, k) for s in spoilt.tolist() for k in range(int(tiles[s])) if (s, k) not in taken]
            o = np.concatenate((o, [s for s, _ in gaps])).astype(np.int64)
            t = np.concatenate((t, np.array([k for _, k in gaps], np.uint64)))
            content = np.concatenate((content, np.zeros(len(gaps), np.uint64)))
        sets.append(own[o])
        keys.append(K.mix(content + K.mix(t << np.uint64(8) | band[own][o].astype(np.uint64))).view(np.int64))
    if not sets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(sets), np.concatenate(keys)


def signature(h: np.ndarray) -> np.ndarray:
    """Hashed bitmap of a set, at least two bits wide for each hash (up to
    a limit); a power of two, so that it folds to any smaller one."""
    width = min(max(256, 1 << (2 * len(h) - 1).bit_length()), 1 << 16)
    bits = np.zeros(width, bool)
    bits[(h & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def folded(signatures: list[np.ndarray]) -> np.ndarray:
    """Signatures at the width of the smallest, as rows of 64-bit words."""
    width = min(map(len, signatures))
    return np.stack([np.bitwise_or.reduce(s.reshape(-1, width), axis=0) for s in signatures]).view(np.uint64)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    return folded([signature(h) for h in sets])


def may_link(size: np.ndarray, other: int, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether the overlap can reach the threshold: a bit set in only one of
    two signatures is a hash that only one of the sets has."""
    total = size + other
    overlap = np.minimum((total - differ) // 2, np.minimum(size, other))
    return (overlap > 0) & (100 * overlap >= percent * (total - overlap))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def compare_star(pivot: np.ndarray, others: list[np.ndarray], percent: int) -> list[int]:
    """Positions of the sets that link with the pivot."""
    signs = bitmaps([pivot, *others])
    differ = np.bitwise_count(signs[1:] ^ signs[0]).sum(axis=1).astype(np.int64)
    able = may_link(np.array([len(x) for x in others]), len(pivot), differ, percent)
    return [i for i in np.flatnonzero(able).tolist() if linked(pivot, others[i], percent)]


def _hash_sets(batches, width: int):
    for b in batches:
        for lo, hi, data, offs in text_chunks(b.column("t")):
            h, bounds = K.shingle_sets(data, offs, width)
            yield b.slice(lo, hi - lo), h, bounds, set_ids(h, bounds)


def find_tiles(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``tile``, ``pivot``, ``node``: distinct sets that share a tile, and the
    smallest of them. Tiles with the same members are one tile."""
    def keys(batches):
        bands, done = Bands(percent), set()
        for _, h, bounds, ids in _hash_sets(batches, width):
            new = [i for i, v in enumerate(ids.tolist()) if not (v in done or done.add(v))]
            sets, key = tile_keys(h, bounds, bands)
            fresh = np.zeros(len(ids), bool)
            fresh[new] = True
            fresh = fresh[sets]
            yield pa.RecordBatch.from_arrays([pa.array(key[fresh]), pa.array(ids[sets][fresh])], ["key", "node"])

    def group(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        key, node = (np.concatenate(c) for c in zip(*got))
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(key)))
        if not (count > 1).any():
            return
        members = np.add.reduceat(K.mix(node.view(np.uint64)), start).view(np.int64)
        _, one = np.unique(members, return_index=True)
        one = one[count[one] > 1]
        size = count[one]
        at = np.repeat(start[one] - np.cumsum(size) + size, size) + np.arange(size.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(members[one], size)), pa.array(np.repeat(node[start[one]], size)), pa.array(node[at])],
                                         ["tile", "pivot", "node"])

    found = texts.select("t").mapInArrow(keys, "key long, node long").repartition(partitions(texts.sparkSession), "key")
    return found.mapInArrow(group, "tile long, pivot long, node long").distinct()


def set_arrays(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``node``, ``hashes``: the sorted sets of the wanted nodes (``node``,
    ``id`` of a document that has it). Nothing is moved: a bitmap of fixed
    greatest size tells a task which documents to take. A few sets that are
    not wanted, or twice, may be among them."""
    key = F.xxhash64("id").bitwiseXOR(F.col("node")).alias("gram")
    bits = texts.sparkSession.sparkContext.broadcast(gram_bitmap(wanted.select(key), per_gram=32))

    def hashes(batches):
        for b, h, bounds, ids in _hash_sets(batches, width):
            able = bits_set(bits.value, (ids ^ b.column("k").to_numpy()).view(np.uint64))
            rows = binary_column(h.view(np.uint8), bounds * 8)
            yield pa.RecordBatch.from_arrays([pa.array(ids), rows], ["node", "hashes"]).filter(pa.array(able & (np.diff(bounds) > 0)))

    return texts.select("t", F.xxhash64("id").alias("k")).mapInArrow(hashes, "node long, hashes binary")


def arrays_of(nodes: DataFrame, arrays: DataFrame) -> DataFrame:
    """The sets of ``nodes`` (``node``) and a few more, picked in place, so
    that only they are moved by a join. The join moves them at any size."""
    bits = arrays.sparkSession.sparkContext.broadcast(gram_bitmap(nodes.select(F.col("node").alias("gram")), per_gram=16))

    def pick(batches):
        for b in batches:
            yield b.filter(pa.array(bits_set(bits.value, b.column(0).to_numpy().view(np.uint64))))

    return arrays.mapInArrow(pick, "node long, hashes binary").hint("merge")


def star_links(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Links of each pivot with the sets paired with it. A pivot with many
    partners is copied, so that no task compares more than about ``STAR``
    of them at a time. A set may come twice (``arrays``)."""
    spark = pairs.sparkSession
    arrays = arrays_of(pairs.select("node").union(pairs.select("pivot")), arrays)
    slots = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / STAR).cast("int").alias("slots"))
    left = (slots.join(arrays.withColumnRenamed("node", "pivot"), "pivot")
            .select("pivot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(None).cast("long").alias("node"), "hashes"))
    right = (pairs.join(slots, "pivot").withColumn("slot", F.pmod(F.xxhash64("node"), F.col("slots")).cast("int"))
             .join(arrays, "node").select("pivot", "slot", "node", "hashes"))

    def compare(batches):
        pivot, own = None, None
        for b in batches:
            nodes = b.column(2).to_pylist()
            where = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(3)]
            links, lo = [], 0
            while lo < len(nodes):
                if nodes[lo] is None:
                    pivot, own = where[lo], sets[lo].copy()
                    lo += 1
                    continue
                hi = lo
                while hi < len(nodes) and where[hi] == pivot and nodes[hi] is not None:
                    hi += 1
                links += [(pivot[0], nodes[lo + i]) for i in compare_star(own, sets[lo:hi], percent)]
                lo = max(hi, lo + 1)
            a, c = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    rows = left.union(right).repartition(partitions(spark), "pivot", "slot").sortWithinPartitions("pivot", "slot", F.col("node").asc_nulls_first())
    return rows.mapInArrow(compare, "a long, b long").distinct()


def able_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures leave a link possible."""
    one = nodes.select(F.col("node").alias("pivot"), F.col("n").alias("n1"), F.col("bits").alias("bits1"))
    rows = pairs.join(nodes.select("node", "n", "bits"), "node").join(one, "pivot").select("pivot", "node", "n1", "bits1", "n", "bits")

    def screen(batches):
        for b in batches:
            able = []
            for n1, x, n2, y in zip(b.column(2).to_pylist(), b.column(3), b.column(4).to_pylist(), b.column(5)):
                u, v = folded([np.frombuffer(z.as_buffer(), np.uint8) for z in (x, y)])
                able.append(bool(may_link(np.array([n2]), n1, np.array([int(np.bitwise_count(u ^ v).sum())]), percent)[0]))
            yield b.select(["pivot", "node"]).filter(pa.array(able, pa.bool_()))

    return rows.mapInArrow(screen, "pivot long, node long")


def candidates(tiles: DataFrame, nodes: DataFrame, tried: DataFrame | None, percent: int, most: int) -> DataFrame:
    """``pivot``, ``node``, ``more``: for each open set (``node``) of a tile up
    to ``most`` partners of another class, those with the smallest share of
    bits that differ; ``more`` if the set has others left.

    In a tile (``tile``, ``node``, ``label``) the sets outside its commonest
    class are open and look for partners; in a further round the sets of
    ``tried`` (``node``, ``seen``) do, for others than those seen. Sets that
    look are compared by signature with those that do not and with each
    other, in blocks of about ``BLOCK`` x ``BLOCK``; two sets that do not look
    never meet. Only looking sets give rows, and a task keeps the best of
    what it has met of each.
    """
    spark = tiles.sparkSession
    if tried is None:
        labels = tiles.groupBy("tile", "label").agg(F.count("*").alias("n"))
        sizes = labels.groupBy("tile").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("still"), F.sum("n").alias("n_all"))
        rows = tiles.join(sizes.where("n_all > still"), "tile").withColumn("looks", F.col("label") != F.col("main"))
        rows = rows.withColumn("seen", F.lit(None).cast("array<long>"))
    else:
        # classes have grown: a set may belong to the main class by now and still has to look
        rows = tiles.join(tried, "node", "left").withColumn("looks", F.col("seen").isNotNull())
        sizes = rows.groupBy("tile").agg(F.count_if(~F.col("looks")).alias("still"), F.count("*").alias("n_all"))
        rows = rows.join(sizes.where("n_all > still"), "tile")
    rows = rows.withColumn("stills", F.greatest(F.ceil(F.col("still") / BLOCK), F.lit(1)).cast("int"))
    rows = rows.withColumn("lookers", F.ceil((F.col("n_all") - F.col("still")) / BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("looks"), F.col("lookers")).otherwise(F.col("stills"))).cast("int"))
    with_still = F.transform(F.sequence(F.lit(0), F.col("stills") - 1), lambda x: F.struct((-1 - x).alias("i"), F.col("own").alias("j")))
    among = F.transform(F.sequence(F.lit(0), F.col("lookers") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    still = F.transform(F.sequence(F.lit(0), F.col("lookers") - 1), lambda x: F.struct((-1 - F.col("own")).alias("i"), x.alias("j")))
    rows = rows.withColumn("block", F.explode(F.when(F.col("looks"), F.concat(with_still, among)).otherwise(still)))
    rows = rows.select("tile", "block.i", "block.j", "looks", "node", "label", "seen").join(nodes.select("node", "n", "bits"), "node")

    def screen(batches):
        group, members, best = None, [], {}

        def flush():
            top = [heapq.nsmallest(most, found, key=lambda v: (found[v], v)) for found in best.values()]
            out = pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(top, pa.list_(pa.int64())),
                                              pa.array([len(found) > most for found in best.values()], pa.bool_())], ["node", "pivots", "more"])
            best.clear()
            return out

        for b in batches:
            for *key, looks, node, label, n, bits, seen in zip(*(c.to_pylist() for c in b.columns)):
                if key != group:
                    for _ in best_partners(members, percent, most, best):
                        yield flush()
                    group, members = key, []
                members.append((looks, node, label, n, np.frombuffer(bits, np.uint8), seen))
        for _ in best_partners(members, percent, most, best):
            yield flush()
        yield flush()

    order = ["tile", "i", "j"]
    rows = rows.select(*order, "looks", "node", "label", "n", "bits", "seen").repartition(partitions(spark), *order).sortWithinPartitions(*order, "node")
    # a row per open set and task; sets share many tiles, so tasks name mostly the same partners
    found = rows.mapInArrow(screen, "node long, pivots array<long>, more boolean").groupBy("node").agg(
        F.array_distinct(F.flatten(F.collect_list("pivots"))).alias("pivots"), F.max("more").alias("more"))
    return found.select(F.explode("pivots").alias("pivot"), "node", "more")


def best_partners(members: list[tuple], percent: int, most: int, best: dict[int, dict[int, int]]) -> Iterator[None]:
    """Add to ``best`` (open set -> partner -> share of bits that differ) the
    partners of one block that its looking sets may link with, one more than
    ``most`` at the most. Of two open sets the smaller one looks at first; a
    set with partners left (``seen``) looks at all others again. Yields
    whenever ``best`` holds ``HELD`` partners and has to be emptied."""
    if len({m[2] for m in members}) < 2 or not any(m[0] for m in members):
        return
    looks, node, label, size, signs, seen = zip(*members)
    looks, node, label, size, signs = np.array(looks), np.array(node), np.array(label), np.array(size), folded(list(signs))
    held = sum(map(len, best.values()))
    for i in np.flatnonzero(looks).tolist():
        others = np.flatnonzero((label != label[i]) & (~looks | (node > node[i]) | (seen[i] is not None)))
        if not len(others):
            continue
        differ = np.bitwise_count(signs[others] ^ signs[i]).sum(axis=1).astype(np.int64)
        able = may_link(size[others], size[i], differ, percent)
        if seen[i] and able.any():
            able &= ~np.isin(node[others], seen[i])
        others, differ = others[able], differ[able]
        if len(others):
            share = 10**6 * differ // (size[others] + size[i])
            top = np.argsort(share, kind="stable")[:most + 1]
            own = best.setdefault(int(node[i]), {})
            before = len(own)
            own.update(zip(node[others[top]].tolist(), share[top].tolist()))
            held += len(own) - before
            if held > HELD:
                yield
                held = 0


def ngram_jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents under links of Jaccard index >= ``percent``/100
    between their sets of distinct ``width``-word shingles.

    Sets fall into bands of size, the hash range of a band into tiles: more
    tiles than linked sets can differ in, so linked sets hold the same hashes
    in at least one. Sets that share a tile are compared, first all with the
    smallest of the tile. Where a tile still has several classes, each set
    outside its largest class is compared with the partners of other classes
    that look most alike, few at first and sixteen times as many in each
    further round, until no pair of classes can link: bitmap signatures bound
    the overlap from above, and what passes is intersected exactly. Equal
    sets are one set. No links within one class are listed, and no link
    between classes is lost.

    Columns: ``id``, ``n_shingles``, ``component_id`` (smallest id reachable
    by links). Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text
    with fewer words than ``width`` has its whole sequence as one shingle; a
    null text or one without words has none and is linked with nothing.
    Rows that repeat an id have a row each; a null id is never a
    ``component_id`` if its class has another id. An empty table gives an
    empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "jaccard")
    scratch.free()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = texts.schema["id"].dataType.simpleString()

    def describe(batches):
        for b, h, bounds, ids in _hash_sets(batches, width):
            size = np.diff(bounds)
            signs = [signature(h[lo:hi]) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            bits = binary_column(np.concatenate(signs), np.concatenate(([0], np.cumsum([len(s) for s in signs]))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(ids, mask=size == 0), bits], ["id", "n", "node", "bits"])

    sets = scratch.put(texts.mapInArrow(describe, f"id {kind}, n long, node long, bits binary"), "sets")
    nodes = sets.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.any_value("n").alias("n"), F.any_value("bits").alias("bits"))
    nodes = scratch.put(nodes, "nodes")
    tiles = scratch.put(find_tiles(texts, width, percent), "tiles")
    scratch.free()
    pairs = tiles.where("node != pivot").select("pivot", "node").distinct()
    pairs = scratch.put(able_pairs(pairs, nodes, percent), "pairs")

    with arrow_rows(spark, 500):
        arrays = scratch.put(set_arrays(texts, nodes.join(tiles.select("node").distinct(), "node", "left_semi"), width), "arrays")
        scratch.free()
        links = scratch.put(star_links(pairs, arrays, percent), "links")
        scratch.free()
        roots = components(links, scratch)
        tried, seen, most = None, None, FIRST
        while True:
            rest = tiles.where("node != pivot").join(roots, "node", "left").select("tile", "node", F.coalesce("root", "node").alias("label"))
            mixed = rest.groupBy("tile").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("tile")
            rest = scratch.put(rest.join(mixed, "tile"), "rest")
            pairs = scratch.put(candidates(rest, nodes, seen, percent, most), "pairs")
            scratch.drop(rest)
            scratch.free()
            if pairs.isEmpty():
                break
            links = scratch.put(links.union(star_links(pairs.select("pivot", "node"), arrays, percent)), "links")
            roots = components(links, scratch)
            # a set without partners left has met all that it may link with
            tried = pairs if tried is None else scratch.put(tried.union(pairs), "tried")
            seen = tried.join(pairs.where("more").select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.collect_set("pivot").alias("seen"))
            seen = scratch.put(seen, "seen")
            if seen.isEmpty():
                break
            most *= FURTHER
        scratch.drop(arrays)
        scratch.free()
    classes = nodes.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = scratch.put(classes.join(smallest, "root").select("node", "component_id"), "classes")
    return sets.join(classes, "node", "left").select("id", F.col("n").alias("n_shingles"),
                                                     F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op1_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard_join(read_table(spark, sf_dir, "documents"), width=4, percent=85).withColumnRenamed("id", "doc_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n, sh FROM s),
x AS (SELECT doc_id, n, unnest(sh) AS g FROM n),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * shared >= 85 * (na + nb - shared)),
r AS (SELECT doc_id AS id, doc_id AS c FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id
FROM n JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = n.doc_id
"""
