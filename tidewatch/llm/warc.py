"""WARC archives in seekable Zstandard bundles, written and read by Spark."""

from __future__ import annotations

import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch, arrow_rows, partitions, read_table

# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 1 << 18        # records of a frame, before compression
BUNDLE_BYTES = 1 << 25       # records of a bundle, before compression
REVISIT_BYTES = 100          # shorter payloads are never revisits
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record_bytes(record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; its header keeps the
    digest and the length of the payload it stands for."""
    kind = "response" if refers_to is None else "revisit"
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    body = payload
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
        body = b""
    head += ["Content-Type: application/octet-stream", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_records(block: bytes):
    """(offset, headers, body) of every record of a frame."""
    at = 0
    while at < len(block):
        end = block.index(b"\r\n\r\n", at)
        lines = block[at:end].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        yield at, headers, block[end + 4:end + 4 + size]
        at = end + 8 + size


class BundleWriter:
    """Independent frames of whole records, then the seek table."""

    def __init__(self) -> None:
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.total = 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame and offset in the frame at which the record is placed."""
        place = len(self.frames), self.open_bytes
        self.open.append(record)
        self.open_bytes += len(record)
        self.total += len(record)
        if self.open_bytes >= FRAME_BYTES:
            self._close()
        return place

    def _close(self) -> None:
        if self.open:
            frame = self.packer.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.open_bytes))
            self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        self._close()
        table = b"".join(struct.pack("<II", c, d) for c, d in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Compressed start and plain size of each frame, from the footer."""
    count, flags, magic = struct.unpack("<IBI", blob[-9:])
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("no seek table")
    sizes = np.frombuffer(blob[-9 - 8 * count:-9], "<u4").reshape(-1, 2).astype(np.int64)
    return np.concatenate(([0], np.cumsum(sizes[:, 0]))), sizes[:, 1]


def read_record(blob: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its place; only its frame is decompressed."""
    starts, plain = seek_table(blob)
    block = zstandard.ZstdDecompressor().decompress(blob[starts[frame]:starts[frame + 1]], max_output_size=int(plain[frame]))
    _, headers, body = next(parse_records(block[offset:]))
    return headers, body


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write one record per row to bundles under ``path`` and return the index:
    ``id``, ``bundle``, ``frame``, ``offset``, ``length``.

    Of equal payloads of ``revisit_bytes`` or more the row with the smallest
    id is the response, the others are revisits that name it. Rows are sorted
    by id in range partitions, each of which writes its own bundles; a bundle
    is written under a temporary name and renamed, and a task that is run
    again writes the same file. A null payload is empty, a null url becomes
    ``urn:page:ID``. Rows that repeat an id have one record each; a row whose
    id is the smallest of its group is a response; a null id becomes an empty
    record id. An empty table writes no
    bundle and gives an empty index.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    base = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    digests = scratch.put(base.select("id", F.unhex(F.sha2("payload", 256)).alias("sha"), F.length("payload").alias("n")), "digests")
    firsts = digests.where(F.col("n") >= revisit_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("k")).where("k > 1")
    refers = (digests.where(F.col("n") >= revisit_bytes).alias("d").join(firsts.alias("f"), F.col("d.sha") == F.col("f.sha"))
              .where(~F.col("d.id").eqNullSafe(F.col("f.first")))
              .select(F.col("d.id").alias("rid"), F.col("d.sha").alias("rsha"), F.col("f.first").alias("refers")).distinct())
    refers = scratch.put(refers, "refers")
    base = base.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    rows = (base.join(refers, base["id"].eqNullSafe(refers["rid"]) & (base["sha"] == refers["rsha"]), "left")
            .select("id", "url", "payload", "sha", "refers"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.repartitionByRange(partitions(spark), "id").sortWithinPartitions("id", "sha").withColumn("part", F.spark_partition_id())

    def write(batches):
        store, root = pafs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        writer, held, number, part = BundleWriter(), [], 0, 0

        def flush():
            name = f"part-{part:06d}-{number:05d}.warc.zst"
            blob = writer.finish()
            draft = f"{root}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(blob)
            store.move(draft, f"{root}/{name}")
            ids, frames, offsets, lengths = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array([name] * len(held)), *(pa.array(x, pa.int64()) for x in (frames, offsets, lengths))],
                                              ["id", "bundle", "frame", "offset", "length"])

        for b in batches:
            id_type = b.column(0).type
            for rid, url, body, sha, refers_to, part in zip(*(c.to_pylist() for c in b.columns)):
                uri = " ".join((url or f"urn:page:{rid}").split())
                record = record_bytes("" if rid is None else str(rid), uri, body, sha.hex(), None if refers_to is None else str(refers_to))
                held.append((rid, *writer.add(record), len(record)))
                if writer.total >= BUNDLE_BYTES:
                    yield flush()
                    writer, held, number = BundleWriter(), [], number + 1
        if held:
            yield flush()

    with arrow_rows(spark, 200):
        return scratch.put(rows.mapInArrow(write, f"id {kind}, bundle string, frame long, offset long, length long"), "index")


def read_warc(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """All records of the bundles that the index names: ``record_id``, ``url``,
    ``record_type``, ``payload_bytes``, ``payload_digest``, ``refers_to``,
    ``bundle``, ``frame``, ``offset``.

    Each bundle is read by one task, frame by frame by its seek table. The
    digest of a response is computed from the payload read and must equal
    the header's; a revisit has the digest and length of its header.
    """
    def read(batches):
        store, root = pafs.FileSystem.from_uri(path)
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_file(f"{root}/{name}") as file:
                    size = file.size()
                    file.seek(size - 9)
                    count = struct.unpack("<IBI", file.read(9))[0]
                    file.seek(size - 9 - 8 * count)
                    starts, plain = seek_table(file.read(9 + 8 * count))
                    for k in range(count):
                        file.seek(int(starts[k]))
                        block = unpack.decompress(file.read(int(starts[k + 1] - starts[k])), max_output_size=int(plain[k]))
                        out = [[] for _ in range(9)]
                        for at, h, body in parse_records(block):
                            digest, length = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["WARC-Payload-Length"])
                            if h["WARC-Type"] == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != length):
                                raise ValueError(f"{name}: payload of {h['WARC-Record-ID']} is damaged")
                            refers_to = h.get("WARC-Refers-To")
                            for column, value in zip(out, (h["WARC-Record-ID"][10:-1], h["WARC-Target-URI"], h["WARC-Type"], length, digest,
                                                           refers_to and refers_to[10:-1], name, k, at)):
                                column.append(value)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    names = ["record_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "bundle", "frame", "offset"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    bundles = index.select("bundle").distinct()
    # names are few and short, so the number of tasks follows the number of bundles
    bundles = bundles.repartition(max(1, bundles.count()))
    return bundles.mapInArrow(read, "record_id string, url string, record_type string, payload_bytes long, payload_digest string, "
                                    "refers_to string, bundle string, frame long, offset long")


def op10_warc(spark, sf_dir):
    path = Scratch(spark, "bundles").path("warc")
    index = write_warc(read_table(spark, sf_dir, "pages"), path)
    kind = index.schema["id"].dataType
    page = F.when(F.col("record_id") != "", F.col("record_id")).cast(kind)
    return read_warc(spark, path, index).select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                                                F.col("refers_to").cast(kind).alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (
  SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
         CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM g
"""
