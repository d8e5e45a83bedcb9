"""Quality scores by a factorisation machine over words and structure."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import textkernel as K
from tidewatch.llm.common import crc_of_id, read_table, text_chunks
from tidewatch.session import ship_package

WORD_BITS = 15               # words are hashed into 2^15 features
BINS = 32                    # bins of each statistic
RANK = 8                     # size of the latent vectors
SAMPLE_ROWS = 4000           # bound of the labelled sample
EPOCHS = 8
THRESHOLD = 0.3


def _lut(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


CLASSES = {
    "upper": _lut(range(65, 91)), "lower": _lut(range(97, 123)), "digit": _lut(range(48, 58)),
    "stop": _lut(b".,;:?"), "mark": _lut(b"!"), "symbol": _lut(b"#$%&*@^~|<>=+_\\/"),
    "wide": _lut(range(128, 256)), "line": _lut(b"\n"), "space": _lut(b" \t"),
}
SHARES = ["upper", "lower", "digit", "stop", "mark", "symbol", "wide", "line", "space",
          "distinct_words", "top_word", "distinct_lines", "short_words", "long_words"]
SIZES = ["n_bytes", "n_words", "word_bytes", "line_words", "n_chars"]
STATS = len(SHARES) + len(SIZES)
FEATURES = (1 << WORD_BITS) + STATS * BINS


def features(data: np.ndarray, offs: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: feature, value and row offsets.

    Distinct words of a text (lower-cased in A-Z) weigh 1 + log count, scaled
    to length 1. Each statistic of the structure, and the metadata n_chars,
    is one of ``BINS`` indicator features.
    """
    n = len(offs) - 1
    size = np.diff(offs)
    low = K.LOWER[data]
    sums = K.prefix_sums(low)
    starts, ends, first = K.word_spans(data, offs)
    count = np.diff(first)
    slot = (K.span_hashes(sums, starts, ends) & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(n), count)
    key = np.sort((doc << WORD_BITS) | slot)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(key)))
    d, w = key[at] >> WORD_BITS, key[at] & ((1 << WORD_BITS) - 1)
    x = 1 + np.log(tf)
    norm = np.sqrt(np.bincount(d, x * x, minlength=n))
    x = x / norm[d]
    distinct = np.bincount(d, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, d, tf)

    def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values)))
        return total[bounds[1:]] - total[bounds[:-1]]

    byte_share = [per_doc(lut[data], offs) / np.maximum(size, 1) for lut in CLASSES.values()]
    cut = np.flatnonzero(data == 10)
    bounds = np.unique(np.concatenate((offs, cut + 1)))
    line_doc = np.searchsorted(offs, bounds[:-1], side="right") - 1
    length = np.diff(bounds)
    hashes = K.span_hashes(sums, bounds[:-1], bounds[:-1] + length - (data[bounds[1:] - 1] == 10)) if len(length) else np.zeros(0, np.uint64)
    order = np.lexsort((hashes, line_doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line_doc[order][1:] != line_doc[order][:-1])
    lines = np.bincount(line_doc, minlength=n)[:n]
    distinct_lines = np.bincount(line_doc[order][fresh], minlength=n)[:n]
    span = ends - starts
    words = np.maximum(count, 1)
    shares = byte_share + [distinct / words, top / words, distinct_lines / np.maximum(lines, 1),
                           per_doc(span <= 2, first) / words, per_doc(span > 15, first) / words]
    sizes = [size, count, per_doc(span, first) / words, count / np.maximum(lines, 1), np.maximum(n_chars, 0)]
    bins = [np.sqrt(s) * (BINS - 1) for s in shares] + [2 * np.log2(1 + s) for s in sizes]
    bins = np.clip(np.stack(bins, axis=1).astype(np.int64), 0, BINS - 1)
    stat = (1 << WORD_BITS) + np.arange(STATS) * BINS + bins
    feature = np.concatenate((w, stat.ravel()))
    value = np.concatenate((x, np.full(n * STATS, STATS ** -0.5)))
    owner = np.concatenate((d, np.repeat(np.arange(n), STATS)))
    order = np.argsort(owner, kind="stable")
    return feature[order], value[order], np.concatenate(([0], np.cumsum(distinct + STATS)))


class FactorisationMachine:
    """Linear weights and low-rank pairwise interactions, logistic loss."""

    def __init__(self, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bias = 0.0
        self.w = np.zeros(FEATURES)
        self.v = rng.normal(0, 0.05, (FEATURES, RANK))

    def margin(self, feature: np.ndarray, value: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Sum of w x plus half of (sum of v x)^2 - sum of (v x)^2, in time
        linear in the features of a row."""
        n = len(rows) - 1
        if not n:
            return np.zeros(0)
        vx = self.v[feature] * value[:, None]
        s = np.add.reduceat(vx, rows[:-1], axis=0)
        q = np.add.reduceat((vx * vx).sum(axis=1), rows[:-1])
        return self.bias + np.add.reduceat(self.w[feature] * value, rows[:-1]) + 0.5 * ((s * s).sum(axis=1) - q)

    def score(self, feature: np.ndarray, value: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(feature, value, rows), -40, 40)))

    def fit(self, feature: np.ndarray, value: np.ndarray, rows: np.ndarray, y: np.ndarray, epochs: int = EPOCHS,
            rate: float = 0.1, decay: float = 1e-5, batch: int = 32, seed: int = 11) -> FactorisationMachine:
        """AdaGrad over shuffled small batches."""
        rng = np.random.Generator(np.random.PCG64(seed))
        gw, gv, gb = np.full(FEATURES, 1e-6), np.full((FEATURES, RANK), 1e-6), 1e-6
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(p / (1 - p)))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), batch):
                own = order[lo:lo + batch]
                size = rows[own + 1] - rows[own]
                at = np.repeat(rows[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
                f, x, r = feature[at], value[at], np.concatenate(([0], np.cumsum(size)))
                e = (self.score(f, x, r) - y[own]) / len(own)
                vx = self.v[f] * x[:, None]
                s = np.add.reduceat(vx, r[:-1], axis=0)
                ex = np.repeat(e, size) * x
                dv = ex[:, None] * (np.repeat(s, size, axis=0) - vx)
                u, inv = np.unique(f, return_inverse=True)
                dw = np.bincount(inv, ex, minlength=len(u)) + decay * self.w[u]
                dvu = np.stack([np.bincount(inv, dv[:, k], minlength=len(u)) for k in range(RANK)], axis=1) + decay * self.v[u]
                gw[u] += dw * dw
                gv[u] += dvu * dvu
                gb += e.sum() ** 2
                self.w[u] -= rate * dw / np.sqrt(gw[u])
                self.v[u] -= rate * 0.5 * dvu / np.sqrt(gv[u])
                self.bias -= rate * e.sum() / np.sqrt(gb)
        return self


def _chunks(batch: pa.RecordBatch):
    chars = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    for lo, hi, data, offs in text_chunks(batch.column(1), 1 << 20):
        yield lo, hi, features(data, offs, chars[lo:hi])


def _inputs(df: DataFrame, id_col: str, text_col: str, chars_col: str | None) -> DataFrame:
    chars = F.col(chars_col) if chars_col else F.length(text_col)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), chars.cast("double").alias("c"))


def train_quality_model(df: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
                        chars_col: str | None = "n_chars", sample_rows: int = SAMPLE_ROWS) -> FactorisationMachine | None:
    """Fit on at most ``sample_rows`` rows of ``labels`` (``id_col``,
    ``label_col``), those with the smallest hash of the id; texts are looked
    up for these only, and only their features come to the driver. None if
    no text has a label."""
    ship_package(df.sparkSession)
    sample = (labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("sid"), F.col(label_col).cast("long").alias("y"))
              .withColumn("h", F.xxhash64("sid")).orderBy("h", "sid", "y").limit(sample_rows))
    rows = _inputs(df, id_col, text_col, chars_col).join(F.broadcast(sample), F.col("id") == F.col("sid")).select("y", "t", "c", "h")

    def extract(batches):
        for b in batches:
            for lo, hi, (f, x, r) in _chunks(b):
                yield pa.RecordBatch.from_arrays([
                    b.column(3).slice(lo, hi - lo), b.column(0).slice(lo, hi - lo),
                    pa.ListArray.from_arrays(pa.array(r, pa.int32()), pa.array(f, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(r, pa.int32()), pa.array(x, pa.float32()))], ["h", "y", "f", "x"])

    got = rows.mapInArrow(extract, "h long, y long, f array<int>, x array<float>").toArrow().sort_by("h").combine_chunks()
    if not len(got):
        return None
    f, x = got["f"].combine_chunks(), got["x"].combine_chunks()
    sizes = f.value_lengths().to_numpy()
    y = (got["y"].to_numpy() > 0).astype(np.float64)
    return FactorisationMachine().fit(f.flatten().to_numpy().astype(np.int64), x.flatten().to_numpy().astype(np.float64),
                                      np.concatenate(([0], np.cumsum(sizes))), y)


def quality_score(df: DataFrame, model: FactorisationMachine | None, id_col: str = "doc_id", text_col: str = "text",
                  chars_col: str | None = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """Score of each whole text: columns ``id``, ``score``, ``predicted``.

    Null texts count as empty and get the score of an empty text, a null
    n_chars counts as 0. Without a model every score is 0.5. Repeated rows
    get equal scores; an empty table gives an empty result.
    """
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        fm = shared.value
        for b in batches:
            out = np.full(len(b), 0.5)
            for lo, hi, (f, x, r) in _chunks(b) if fm else ():
                out[lo:hi] = fm.score(f, x, r)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out), pa.array((out >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    rows = _inputs(df, id_col, text_col, chars_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(score, f"id {kind}, score double, predicted int")


def op4_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    held = F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) == 0
    model = train_quality_model(docs, labels.where(~held), "quality")
    return quality_score(docs, model).select(F.col("id").alias("doc_id"), (F.pmod(crc_of_id(F.col("id")), F.lit(5)) == 0).alias("held_out"), "score", "predicted")
