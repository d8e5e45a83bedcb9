"""Language identification by a byte-level convolutional network."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import crc_of_id, read_table, string_bytes, text_chunks
from tidewatch.session import ship_package

UNKNOWN = "und"
WINDOW = 256                 # bytes of one window
WIDTHS = (2, 3, 4)           # filter widths in bytes
FILTERS = 16                 # filters of each width
DIM = 8                      # embedding of a byte
ROWS_PER_LANG = 400          # bound of the labelled sample, rows of a language
SAMPLE_WINDOWS = 8           # windows of a sampled text, spread over all of it (training only)
EPOCHS = 6
LETTER = re.compile(r"[^\W\d_]")

# Letters in lower case, every other ASCII byte as a space, the rest as it is.
CLEAN = np.arange(256, dtype=np.uint8)
CLEAN[:128] = 32
CLEAN[97:123] = CLEAN[65:91] = np.arange(97, 123)
ASCII_LETTER = np.zeros(256, np.int32)
ASCII_LETTER[97:123] = ASCII_LETTER[65:91] = 1


def windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts (each with the few bytes that the widest
    filter reads beyond it, padded by spaces), and the text of each."""
    size = np.diff(offs)
    count = np.maximum(1, -(-size // WINDOW))
    doc = np.repeat(np.arange(len(size)), count)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    at = (offs[doc] + rank * WINDOW)[:, None] + np.arange(WINDOW + max(WIDTHS) - 1)
    padded = np.append(CLEAN[data], np.uint8(32))
    return padded[np.where(at < offs[doc + 1][:, None], at, len(data))], doc


class ByteNet:
    """Embedding, filters of several widths, maximum over the window, softmax."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.langs = langs
        self.p = {"embed": rng.normal(0, 0.5, (256, DIM))}
        for w in WIDTHS:
            self.p[f"filter{w}"] = rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS))
            self.p[f"bias{w}"] = np.zeros(FILTERS)
        self.p["out"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs)))
        self.p["out_bias"] = np.zeros(len(langs))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteNet:
        """Adam on the mean cross-entropy of the windows."""
        rng = np.random.Generator(np.random.PCG64(seed))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                own = order[lo:lo + batch]
                grads = self._gradients(x[own], y[own])
                step += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n, rows = self.p, len(x), np.arange(len(x))[:, None]
        emb = p["embed"][x]
        pooled, best, cols = [], [], {}
        for w in WIDTHS:
            cols[w] = np.concatenate([emb[:, j:j + WINDOW] for j in range(w)], axis=2)
            act = cols[w] @ p[f"filter{w}"]
            best.append(act.argmax(axis=1))
            pooled.append(np.take_along_axis(act, best[-1][:, None, :], 1)[:, 0] + p[f"bias{w}"])
        raw = np.concatenate(pooled, axis=1)
        hidden = np.maximum(raw, 0)
        z = hidden @ p["out"] + p["out_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(n), y] -= 1
        z /= n
        g = {"out": hidden.T @ z, "out_bias": z.sum(axis=0), "embed": np.zeros_like(p["embed"])}
        back = (z @ p["out"].T) * (raw > 0)
        for k, w in enumerate(WIDTHS):
            b = back[:, k * FILTERS:(k + 1) * FILTERS]
            picked = cols[w][rows, best[k]]
            g[f"filter{w}"] = np.einsum("nfd,nf->df", picked, b)
            g[f"bias{w}"] = b.sum(axis=0)
            d = np.einsum("nf,df->nfd", b, p[f"filter{w}"]).reshape(n, FILTERS, w, DIM)
            for j in range(w):
                np.add.at(g["embed"], x[rows, best[k] + j], d[:, :, j])
        return g

    def tables(self) -> list[list[np.ndarray]]:
        """Filter responses of byte pairs (and a last single byte), so that a
        position costs a lookup for each pair in place of a product."""
        out = []
        for w in WIDTHS:
            f = self.p[f"filter{w}"].reshape(w, DIM, FILTERS)
            one = [self.p["embed"] @ f[j] for j in range(w)]
            parts = [(one[j][:, None] + one[j + 1][None]).reshape(65536, FILTERS) if j + 1 < w else one[j] for j in range(0, w, 2)]
            out.append([np.ascontiguousarray(t, np.float32) for t in parts])
        return out

    def probs(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Probabilities of the languages for each window."""
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        pooled = []
        for w, parts in zip(WIDTHS, tables):
            act = None
            for k, t in enumerate(parts):
                at = pair[:, 2 * k:2 * k + WINDOW] if len(t) > 256 else x[:, 2 * k:2 * k + WINDOW]
                got = t.take(at.ravel(), axis=0)
                act = got if act is None else np.add(act, got, out=act)
            pooled.append(act.reshape(len(x), WINDOW, FILTERS).max(axis=1) + self.p[f"bias{w}"])
        z = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.p["out"] + self.p["out_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True), dtype=np.float64)
        return z / z.sum(axis=1, keepdims=True)


def train_language_model(df: DataFrame, text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = ROWS_PER_LANG) -> ByteNet | None:
    """Fit on at most ``rows_per_lang`` different labelled texts of each
    language (those with the smallest hash), up to ``SAMPLE_WINDOWS`` windows
    of each, spread evenly over the whole text; a fifth of them also in upper
    case. None if no row has text and label."""
    d = df.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("t is not null and l is not null and t != ''")
    step = F.greatest(F.lit(WINDOW), F.floor(F.length("t") / SAMPLE_WINDOWS)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda i: F.substring(F.col("t"), i * step + 1, F.lit(WINDOW)))
    d = d.select("l", F.xxhash64("t").alias("h"), F.filter(parts, lambda x: x != "").alias("parts"))
    # copies of a text have one row
    d = d.groupBy("l", "h").agg(F.min("parts").alias("parts"))
    top = Window.partitionBy("l").orderBy("h")
    rows = sorted(d.withColumn("k", F.row_number().over(top)).where(F.col("k") <= rows_per_lang).select("l", "h", "parts").collect())
    if not rows:
        return None
    langs = sorted({r["l"] for r in rows})
    xs, ys = [], []
    for i, r in enumerate(rows):
        for text in r["parts"] + [t.upper() for t in r["parts"]] * (i % 5 == 0):
            raw = np.frombuffer(text.encode()[:WINDOW], np.uint8)
            x, _ = windows(raw, np.array([0, len(raw)]))
            if letters(x)[0]:
                xs.append(x)
                ys.append(np.full(len(x), langs.index(r["l"])))
    if not xs:
        return None
    return ByteNet(langs).fit(np.concatenate(xs), np.concatenate(ys))


def letters(x: np.ndarray) -> np.ndarray:
    """Bytes of each window that belong to letters (or to characters beyond
    ASCII)."""
    return (x[:, :WINDOW] != 32).sum(axis=1)


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    data, offs = string_bytes(column)
    out = np.zeros(len(column), bool)
    for lo, hi, part, at in text_chunks(column):
        total = np.concatenate(([0], np.cumsum(ASCII_LETTER[part])))
        out[lo:hi] = total[at[1:]] > total[at[:-1]]
    for i in np.flatnonzero(~out):
        if offs[i + 1] > offs[i]:
            out[i] = LETTER.search(data[offs[i]:offs[i + 1]].tobytes().decode(errors="ignore")) is not None
    return out


def language_id(df: DataFrame, model: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of each whole text: columns ``id``, ``lang_pred``, ``score``.

    A text is cut into windows of fixed length, all of which are scored; the
    probabilities are averaged over its windows, each weighted by its letters
    (tables of numbers do not vote), and the language with the highest mean
    is taken, its mean the score. A text that is null,
    empty or has no letter is ``und`` with score 0, as is every text without
    a model. Repeated rows get equal results; an empty table gives none.
    """
    ship_package(df.sparkSession)

    def score(batches):
        tables = model.tables() if model else None
        for b in batches:
            known = has_letter(b.column(1)) & (model is not None)
            best, prob = np.zeros(len(known), int), np.zeros(len(known))
            for lo, hi, data, offs in text_chunks(b.column(1), 1 << 18) if model else ():
                z = np.zeros((hi - lo, len(model.langs)))
                count = np.zeros(hi - lo)
                for x, doc in window_blocks(data, offs):
                    weight = letters(x)
                    np.add.at(z, doc, model.probs(x, tables) * weight[:, None])
                    np.add.at(count, doc, weight)
                z /= np.maximum(count, 1)[:, None]
                best[lo:hi], prob[lo:hi] = z.argmax(axis=1), z.max(axis=1)
            lang = [model.langs[k] if ok else UNKNOWN for k, ok in zip(best, known)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(np.where(known, prob, 0.0))], ["id", "lang_pred", "score"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(score, f"id {kind}, lang_pred string, score double")


def window_blocks(data: np.ndarray, offs: np.ndarray, limit: int = 1 << 20):
    """Windows of the texts, a bounded number at a time (``limit`` is a
    multiple of the window, so a longer text is cut between windows)."""
    if len(data) <= limit:
        yield windows(data, offs)
        return
    for i in range(len(offs) - 1):
        for lo in range(offs[i], max(offs[i + 1], offs[i] + 1), limit):
            part = data[lo:min(offs[i + 1], lo + limit + max(WIDTHS) - 1)]
            x, _ = windows(part, np.array([0, len(part)]))
            x = x[:limit // WINDOW]
            yield x, np.full(len(x), i)


def op3_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) == 2
    model = train_language_model(docs.where(~held))
    return language_id(docs, model).select(F.col("id").alias("doc_id"), (F.pmod(crc_of_id(F.col("id")), F.lit(4)) == 2).alias("held_out"), "lang_pred", "score")
