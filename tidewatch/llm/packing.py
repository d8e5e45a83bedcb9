"""Packing token sequences: a configuration linear program over lengths."""

from __future__ import annotations

import base64
import functools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch, partitions, read_table

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"    # fixed value: the vocabulary's only special token
END_ID = 0
ROUNDS = 60                  # rounds of multiplicative weights
STEP = 0.3                   # share of what is left that a column may take in a round
RATE = 0.2                   # exponent of the weights
SLACK = 0.0001                # columns this near to the best price are taken too


@functools.lru_cache(maxsize=1)
def _fast_encoding(name: str) -> tiktoken.Encoding:
    """The vocabulary's ranks; equal ids for text without special tokens."""
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def _full_tokenizer(name: str) -> tokenizers.Tokenizer:
    return tokenizers.Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


def token_ids(text: str, name: str = VOCABULARY) -> np.ndarray:
    """Ids of a text by ``name``.json without added special tokens."""
    ids = _full_tokenizer(name).encode(text, add_special_tokens=False).ids if SPECIAL in text else _fast_encoding(name).encode_ordinary(text)
    return np.array(ids, np.uint32)


def token_pieces(df: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of each piece."""
    def cut(batches):
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                ids = np.append(token_ids(text.as_py() or "", vocabulary), np.uint32(END_ID)).astype("<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
                    rows.append(i)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(ids[lo:hi].tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                                              *(pa.array(c, pa.int64()) for c in (start, length, crc))], ["id", "piece", "start", "length", "ids_crc32"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def price(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value of each capacity and the last length
    put in (0: one unit is left empty). ``value`` is -inf where absent."""
    back = np.zeros(capacity + 1)            # back[capacity - w] = best[w]
    choice = np.zeros(capacity + 1, np.int64)
    for w in range(1, capacity + 1):
        v = value[1:w + 1] + back[capacity - w + 1:]
        k = int(v.argmax())
        kept = back[capacity - w + 1]
        if v[k] > kept:
            back[capacity - w], choice[w] = v[k], k + 1
        else:
            back[capacity - w] = kept
    return back[::-1], choice


def fill(choice: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        if choice[room]:
            out.append(int(choice[room]))
            room -= out[-1]
        else:
            room -= 1
    return out


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over a histogram; equal bins are one group."""
    room: dict[int, list[list]] = {}         # room left -> groups [bins, contents]
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for r in sorted(room):
            if r < size:
                continue
            per = r // size
            kept = []
            for group in room.pop(r):
                full = min(group[0], left // per)
                if full:
                    room.setdefault(r - per * size, []).append([full, group[1] + (size,) * per])
                    left -= full * per
                    group[0] -= full
                if left and group[0]:
                    room.setdefault(r - left * size, []).append([1, group[1] + (size,) * left])
                    left = 0
                    group[0] -= 1
                if group[0]:
                    kept.append(group)
            if kept:
                room.setdefault(r, []).extend(kept)
            if not left:
                break
        per = capacity // size
        if left // per:
            room.setdefault(capacity - per * size, []).append([left // per, (size,) * per])
        if left % per:
            room.setdefault(capacity - (left % per) * size, []).append([1, (size,) * (left % per)])
    return [(bins, content) for groups in room.values() for bins, content in groups]


def configurations(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[int, tuple[int, ...]]]:
    """Bins that hold each length exactly as often as counted: (bins, lengths).

    The linear program has a column for each set of lengths that fits. Each
    round prices columns by a knapsack over the weights of the lengths; for
    every length the best column that holds it is taken if its price is
    within ``SLACK`` of the best, for a share of what is left. The weight of
    a length falls exponentially with the share of it that is covered.
    Columns are taken in whole bins, so the solution is rounded down; what is
    left is placed by best fit. Time and result size depend on the number of
    lengths only, not on how often they occur.
    """
    total = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        total[size] = n
    left = total.copy()
    out: dict[tuple[int, ...], int] = {}
    if left[capacity]:
        out[(capacity,)] = int(left[capacity])
        left[capacity] = 0
    base = np.arange(capacity + 1) / capacity
    for _ in range(rounds):
        if not left.any():
            break
        share = left / np.maximum(total, 1)
        value = np.where(left > 0, base * np.exp(RATE * (share - share[left > 0].mean())), -np.inf)
        best, choice = price(value, capacity)
        for size in np.flatnonzero(left)[::-1].tolist():
            if not left[size] or value[size] + best[capacity - size] < (1 - SLACK) * best[capacity]:
                continue
            column = sorted([size, *fill(choice, capacity - size)], reverse=True)
            uses = {s: column.count(s) for s in set(column)}
            room = min(int(left[s]) // k for s, k in uses.items())
            if room:
                bins = max(1, int(room * STEP))
                out[tuple(column)] = out.get(tuple(column), 0) + bins
                for s, k in uses.items():
                    left[s] -= bins * k
    rest = best_fit({int(s): int(left[s]) for s in np.flatnonzero(left)}, capacity)
    return [(bins, column) for column, bins in out.items()] + rest


def places(bins: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Rows of (length, first rank, copies in a bin, first bin, offset), by
    length and rank: the piece of rank r of a length finds its bin there."""
    rank: dict[int, int] = {}
    rows, bin_id = [], 0
    for n, column in bins:
        offset = 0
        for size in sorted(set(column), reverse=True):
            copies = column.count(size)
            rows.append((size, rank.get(size, 0), copies, bin_id, offset))
            rank[size] = rank.get(size, 0) + n * copies
            offset += copies * size
        bin_id += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "copies", "bin", "offset"), cols))


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokenise every text (its ids, then one end id), cut those longer than
    ``capacity`` and pack the pieces into few sequences of that many tokens.

    Columns: ``id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``. The driver sees only the histogram of
    lengths (at most ``capacity`` rows) and makes a table of configurations
    whose size the capacity bounds. Pieces get their rank among those of
    their length in blocks (a length that most pieces share is spread over
    all of them), which gives sequence and offset by the table.

    A null or empty text is the end id alone. Repeated rows are packed each;
    an empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = scratch.put(token_pieces(df, id_col, text_col, capacity, vocabulary), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(configurations(counts, capacity)))

    blocks = 4 * partitions(spark)
    own = Window.partitionBy("length", "block").orderBy("id", "piece")
    ranked = pieces.withColumn("block", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(blocks)))
    starts = ranked.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = ranked.withColumn("own", F.row_number().over(own)).join(starts, ["length", "block"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))
    kind = ranked.schema["id"].dataType.simpleString()

    def place(batches):
        t = table.value
        first = t["length"] << 44 | t["rank"]
        for b in batches:
            size, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(first, size << 44 | rank, side="right") - 1
            nth = rank - t["rank"][at]
            seq = t["bin"][at] + nth // t["copies"][at]
            offset = t["offset"][at] + nth % t["copies"][at] * size
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(offset)],
                                             ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_packing(spark, sf_dir):
    return pack(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
