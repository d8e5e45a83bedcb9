"""Removal of repeated byte strings by sorting sampled suffixes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import textkernel as K
from tidewatch.llm.common import Scratch, arrow_rows, binary_column, partitions, read_table, string_bytes, text_chunks

GRAM = 32                    # leading bytes by which suffixes are sampled
SPLIT = 20_000               # suffixes with one beginning that a task sorts


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Sampled suffixes: (text, position, first and last start, gram hash,
    hash of the bytes that the starts cover).

    Every string of ``length`` bytes picks the position in it whose ``gram``
    bytes have the smallest hash (the first of equals), so equal strings pick
    the same place. Neighbouring starts with one pick make one row.
    """
    empty = np.zeros(0, np.int64)
    n, span = len(data), length - gram + 1
    if n < length:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    sums = K.prefix_sums(data)
    at = np.arange(n - gram + 1, dtype=np.int64)
    h = K.span_hashes(sums, at, at + gram)
    bits = np.uint64(max(20, n.bit_length()))
    low, width = (h >> bits << bits) | at.astype(np.uint64), 1    # hash, then position
    while width * 2 <= span:               # minimum over `width` positions
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    starts = np.flatnonzero(doc[:n - length + 1] == doc[length - 1:])
    if not len(starts):
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    pick = (low[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (starts[1:] != starts[:-1] + 1)
    lead = np.flatnonzero(new)
    a, lo, hi = pick[lead], starts[lead], starts[np.append(lead[1:], len(starts)) - 1]
    cover = K.mix(K.span_hashes(sums, lo, hi + length) + K.mix((a - lo).astype(np.uint64) << np.uint64(32) | (hi - lo).astype(np.uint64)))
    d = doc[lo]
    return d, a - offs[d], lo - offs[d], hi - offs[d], h[a], cover


def multikey_order(digits: np.ndarray) -> np.ndarray:
    """Order of rows of 8-byte digits: sorted by the first digit, then only
    rows that are equal so far by the next one."""
    order = np.argsort(digits[:, 0], kind="stable")
    group = np.append(0, np.cumsum(digits[order[1:], 0] != digits[order[:-1], 0])) if len(order) else order
    for k in range(1, digits.shape[1]):
        size = np.bincount(group) if len(group) else group
        tied = np.flatnonzero(size[group] > 1) if len(group) else group
        if not len(tied):
            break
        rows, g = order[tied], group[tied]
        sub = np.lexsort((digits[rows, k], g))
        order[tied] = rows[sub]
        d, new = digits[order, k], np.zeros(len(order), bool)
        new[1:] = group[1:] != group[:-1]
        inside = np.zeros(len(order), bool)
        inside[tied] = True
        new[1:] |= inside[1:] & inside[:-1] & (d[1:] != d[:-1])
        group = np.cumsum(new)
    return order


def later_starts(blob: np.ndarray, base: np.ndarray, place: np.ndarray, starts: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Which starts of sampled suffixes repeat an earlier row's string.

    Row i covers ``starts[i]`` strings from byte ``base[i]`` of ``blob`` on;
    its suffix begins ``place[i]`` bytes later. Rows come in order of text
    and position. The suffixes are sorted; with the common prefixes of
    neighbours, the strings that begin ``back`` bytes before the suffix are
    equal if the suffixes share ``length - back`` bytes and the bytes before
    have equal hashes. Returns rows x (length - gram + 1) booleans by
    ``back``.
    """
    n, span = len(base), length - gram + 1
    width = -(-length // 8) * 8
    right = base + place
    size = np.minimum(length, starts - 1 + length - place)
    padded = np.append(blob, np.zeros(width, np.uint8))
    order = np.arange(n)
    prefix = np.zeros(n, np.int64)
    if n:
        chars = padded[right[:, None] + np.arange(width)]
        chars[np.arange(width) >= size[:, None]] = 0
        order = multikey_order(np.ascontiguousarray(chars).view(">u8").astype(np.uint64))
        chars = chars[order]
        differ = chars[1:] != chars[:-1]
        prefix[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        del chars, differ
    sums = K.prefix_sums(blob)
    run = np.empty(n, np.int64)
    out = np.zeros((n, span), bool)
    for back in range(span):
        rows = np.flatnonzero((place >= back) & (place - back < starts))
        if len(rows) < 2:
            continue
        run[order] = np.cumsum(prefix < length - back)
        key = K.mix(K.span_hashes(sums, right[rows] - back, right[rows]) + run[rows].astype(np.uint64) * K.BASE)
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        out[rows[by[1:][same]], back] = True
    return out


def ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of the runs of set flags."""
    edge = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
    edge[:, 1:-1] = flags
    step = np.diff(edge, axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1] - 1


def sort_groups(batches, limit: int):
    """Lists of batches to sort together: whole parts of beginnings, many at a
    time. Rows come in order of ``lead`` (column 0) and ``salt`` (column 1); a
    list is closed at the first new pair once it holds ``limit`` rows."""
    key, held, rows = None, [], 0
    for b in batches:
        lead, salt = b.column(0), b.column(1)
        pos = 0
        while pos < len(b):
            end = len(b)
            if rows + end - pos > limit:
                end = pos + max(1, min(end - pos, limit - rows))
                while end < len(b) and lead[end] == lead[end - 1] and salt[end] == salt[end - 1]:
                    end += 1
            if held and rows >= limit and (lead[pos].as_py(), salt[pos].as_py()) != key:
                yield held
                held, rows = [], 0
                continue
            held.append(b.slice(pos, end - pos))
            rows += end - pos
            key = lead[end - 1].as_py(), salt[end - 1].as_py()
            pos = end
    if held:
        yield held


FLAGS = "id long, lo long, hi long, start long, content long"


def _flag_batch(ids, lo, hi, start=None, content=None) -> pa.RecordBatch:
    k = len(ids)
    null = pa.nulls(k, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), null if start is not None else pa.array(lo, pa.int64()), null if start is not None else pa.array(hi, pa.int64()),
                                       null if start is None else pa.array(start, pa.int64()), null if content is None else pa.array(content, pa.int64())],
                                      ["id", "lo", "hi", "start", "content"])


def repeated_starts(texts: DataFrame, scratch: Scratch, length: int, gram: int) -> DataFrame:
    """``id``, ``lo``, ``hi``: starts of strings that also start earlier.

    ``texts`` has integer ``id`` and ``t``. Sampled suffixes with equal bytes
    around them are settled by their hashes; of each distinct one the first
    goes on, with its bytes, to the range partition of its beginning, where
    suffixes are sorted. A beginning with many suffixes is split by id, and
    the first strings of its parts are compared once more.
    """
    spark = texts.sparkSession
    n = partitions(spark)

    def sample(batches):
        seen: dict[bytes, int] = {}
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, hi, data, offs in text_chunks(b.column(1), 1 << 20):
                # a text seen with a smaller id adds nothing: the other rows
                # of its group are settled by the hash of the whole text
                for_text = [hashlib.blake2b(data[offs[i]:offs[i + 1]].tobytes(), digest_size=12).digest() for i in range(hi - lo)]
                own = ids[lo:hi]
                fresh = np.ones(hi - lo, bool)
                for i, (key, v) in enumerate(zip(for_text, own.tolist())):
                    if key in seen and seen[key] < v:
                        fresh[i] = False
                    else:
                        seen[key] = v
                d, at, first, last, h, cover = anchors(data, offs, length, gram)
                ok = fresh[d]
                yield pa.RecordBatch.from_arrays([pa.array(own[d[ok]]), pa.array(at[ok].astype(np.int32)), pa.array((at - first)[ok].astype(np.int16)), pa.array((last - first + 1)[ok].astype(np.int16)),
                                                  pa.array(h[ok].view(np.int64)), pa.array(cover[ok].view(np.int64))], ["id", "at", "place", "starts", "gram", "cover"])

    def settle(batches):
        got = [[c.to_numpy() for c in b.columns] for b in batches]
        if not got:
            return
        ids, at, place, starts, key, cover = (np.concatenate(c) for c in zip(*got))
        order = np.lexsort((at, ids, cover, key))
        ids, at, place, starts, key, cover = (c[order] for c in (ids, at, place, starts, key, cover))
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & (cover[1:] == cover[:-1])
        one = ~again
        k = key[one]
        shared = np.zeros(len(k), bool)
        shared[1:] = k[1:] == k[:-1]
        shared[:-1] |= shared[1:]
        out = again.copy()
        out[one] = shared
        yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(at[out]), pa.array(place[out]), pa.array(starts[out]), pa.array(key[out]), pa.array(again[out])],
                                         ["id", "at", "place", "starts", "gram", "again"])

    found = texts.mapInArrow(sample, "id long, at int, place smallint, starts smallint, gram long, cover long").repartition(n, "gram")
    found = scratch.put(found.mapInArrow(settle, "id long, at int, place smallint, starts smallint, gram long, again boolean"), "suffixes")
    sure = found.where("again").select("id", (F.col("at").cast("long") - F.col("place")).alias("lo"),
                                       (F.col("at").cast("long") - F.col("place") + F.col("starts") - 1).alias("hi"))
    open_rows = found.where("not again").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "place", "starts", "gram"))).alias("s"))

    def cut(batches):
        for b in batches:
            data, offs = string_bytes(b.column(1))
            for lo in range(0, len(b), 64):
                part = b.column(2).slice(lo, 64)
                f = part.flatten()
                count = part.value_lengths().to_numpy()
                row = np.repeat(np.arange(lo, lo + len(part)), count)
                at, place, starts, key = (f.field(k).to_numpy().astype(np.int64) for k in range(4))
                begin = offs[row] + at - place
                size = starts - 1 + length
                ends = np.concatenate(([0], np.cumsum(size)))
                blob = data[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
                lead = np.ascontiguousarray(data[(offs[row] + at)[:, None] + np.arange(gram)])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(at), pa.array(place), pa.array(key),
                                                  binary_column(lead.ravel(), np.arange(len(row) + 1) * gram), binary_column(blob, ends)],
                                                 ["id", "at", "place", "gram", "lead", "bytes"])

    counts = found.where("not again").groupBy("gram").agg(F.count("*").alias("k")).where(F.col("k") > SPLIT)
    heavy = scratch.put(counts.select("gram", F.ceil(F.col("k") / SPLIT).cast("int").alias("parts")), "heavy")
    pieces = texts.join(open_rows, "id").select("id", "t", "s").mapInArrow(cut, "id long, at long, place long, gram long, lead binary, bytes binary")
    pieces = pieces.join(heavy, "gram", "left").withColumn("salt", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    pieces = pieces.select("lead", F.coalesce("salt", F.lit(0)).alias("salt"), "id", "at", "place", F.col("parts").isNotNull().alias("split"), "bytes")

    def sort_bucket(batches):
        def settled(held):
            t = pa.Table.from_batches(held).combine_chunks()
            ids, at, place, split = (t[c].to_numpy() for c in ("id", "at", "place", "split"))
            blob, ends = string_bytes(t["bytes"])
            begin = ends[0]
            blob, ends = blob[begin:ends[-1]], ends - begin
            order = np.lexsort((at, ids))
            base, starts = ends[:-1][order], np.diff(ends)[order] - length + 1
            ids, at, place, split = ids[order], at[order], place[order], split[order]
            late = later_starts(blob, base, place, starts, length, gram)
            row, first, last = ranges(late)
            yield _flag_batch(ids[row], at[row] - last, at[row] - first)
            if split.any():
                row, back = np.nonzero(~late & split[:, None] & (np.arange(late.shape[1]) <= place[:, None])
                                       & (place[:, None] - np.arange(late.shape[1]) < starts[:, None]))
                where = base[row] + place[row] - back
                content = K.span_hashes(K.prefix_sums(blob), where, where + length).view(np.int64)
                yield _flag_batch(ids[row], None, None, at[row] - back, content)

        for held in sort_groups(batches, SPLIT):
            yield from settled(held)

    ordered = pieces.repartitionByRange(n, "lead", "salt").sortWithinPartitions("lead", "salt")
    with arrow_rows(spark, 5000):
        flags = scratch.put(ordered.mapInArrow(sort_bucket, FLAGS), "flags")
    apart = Window.partitionBy("content").orderBy("id", "start")
    late = flags.where("content is not null").withColumn("k", F.row_number().over(apart)).where("k > 1").select("id", F.col("start").alias("lo"), F.col("start").alias("hi"))
    return sure.union(flags.where("content is null").select("id", "lo", "hi")).union(late)


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = GRAM) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also
    starts earlier: in a text with a smaller id, or before in the same text.

    Strings are judged on the input, never cross texts, and may overlap.
    Columns: ``id``, ``n_bytes``, ``n_removed``, ``n_spans`` (runs of removed
    bytes), ``spans`` (their starts and ends), ``kept`` (the rest, binary).
    Null texts are empty. A text equal to one with a smaller id goes whole
    (if it has ``length`` bytes). Of texts that share an id the one with the
    smaller SHA-256 counts as earlier, equal ones are one text; null ids come
    after all others. An empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "suffix")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("t"))
    sha = F.unhex(F.sha2("t", 256))
    docs = scratch.put(texts.select("id", F.length("t").alias("n"), sha.alias("sha")), "docs")
    clash = docs.groupBy("id").agg(F.count_distinct("sha").alias("k")).agg(F.max("k"), F.max("id"), F.max(F.col("id").isNull())).first()
    most, top, nulls = clash[0] or 1, clash[1], clash[2]
    number = F.col("id")
    if nulls:
        number = F.coalesce("id", F.lit((top if top is not None else 0) + 1))
    if most > 1:                           # order-preserving numbers for texts that share an id
        rank = docs.select("id", "sha").distinct().withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("sha")) - 1)
        rank = scratch.put(rank.select(F.col("id").alias("rid"), F.col("sha").alias("rsha"), (number * most + F.col("r")).alias("num")), "numbers")

        def numbered(rows):
            return rows.join(rank, rows["id"].eqNullSafe(rank["rid"]) & (rows["sha"] == rank["rsha"])).drop("rid", "rsha")

        docs = scratch.put(numbered(docs), "docs")
        texts = numbered(texts.withColumn("sha", sha)).select(F.col("num").alias("id"), "t")
    else:
        docs = docs.withColumn("num", number)
        texts = texts.select(number.alias("id"), "t")
    first = docs.groupBy("sha").agg(F.min("num").alias("first"))
    docs = docs.join(first, "sha").withColumn("copy", (F.col("num") != F.col("first")) & (F.col("n") >= length))
    docs = scratch.put(docs.select("id", "n", "num", "copy"), "copies")
    flags = repeated_starts(texts, scratch, length, gram).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("f"))
    both = docs.select("num", F.col("id").alias("own"), "copy").distinct().join(flags.withColumnRenamed("id", "fid"), F.col("num") == F.col("fid"), "left")
    rows = texts.join(both, texts["id"] == both["num"]).select("own", "t", "copy", F.when(~F.col("copy"), F.col("f")).alias("f"))

    def remove(batches):
        for b in batches:
            n_bytes, n_removed, spans, kept = [], [], [], []
            for t, copy, f in zip(b.column(1), b.column(2).to_pylist(), b.column(3)):
                raw = t.as_buffer()
                size = raw.size if raw is not None else 0
                body = np.frombuffer(raw, np.uint8) if size else np.zeros(0, np.uint8)
                if copy:
                    runs = np.array([[0, size]])
                elif f.is_valid and len(f.values):
                    lo, hi = f.values.field(0).to_numpy(), f.values.field(1).to_numpy() + length
                    edge = np.zeros(size + 1, np.int64)
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, hi, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    step = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
                    runs = np.stack((np.flatnonzero(step == 1), np.flatnonzero(step == -1)), axis=1)
                else:
                    runs = np.zeros((0, 2), np.int64)
                cover = np.ones(size, bool)
                for lo, hi in runs.tolist():
                    cover[lo:hi] = False
                n_bytes.append(size)
                n_removed.append(size - int(cover.sum()))
                spans.append([{"lo": int(a), "hi": int(e)} for a, e in runs])
                kept.append(body[cover].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(list(map(len, spans)), pa.int64()),
                                              pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.binary())],
                                             ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return rows.mapInArrow(remove, "id long, n_bytes long, n_removed long, n_spans long, spans array<struct<lo: long, hi: long>>, kept binary")


def op9_suffix_dedup(spark, sf_dir):
    return suffix_dedup(read_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
