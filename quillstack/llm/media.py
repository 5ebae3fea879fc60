"""Content-addressed media payloads in tar shards.

Each task stores the payloads of its rows as 8-bit greyscale PNG images (lossless) in a tar shard of its own; the name of a member
is the SHA-256 of its bytes, and a payload that comes again in the same shard is stored once. Rows carry digest, shard, offset and
length, so a row's payload is one range read. Width, height and sample size are filled in by range reads of the first bytes alone
(with_metadata), before any payload is read.

Nulls and odd rows: a null or empty text is the payload of one block of padding. Rows with a null doc_id are kept. Equal texts, repeated
rows included, have equal digests. An empty table gives empty results. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, in_parts, new_folder, table

BLOCK, PAD, HEAD = 576, 255, 33
#: A task starts another shard at about so many bytes; a task of the read side gets about so many.
SHARD_BYTES, READ_BYTES = 256 << 20, 16 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
ROWS = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, bits int"
METADATA = "width int, height int, bits int"


def padded(data: bytes) -> bytes:
    """data, filled up to a positive multiple of BLOCK bytes."""
    return data + bytes([PAD]) * (-len(data) % BLOCK if data else BLOCK)


def to_png(payload: bytes) -> bytes:
    """An 8-bit greyscale image of BLOCK samples a row."""
    rows = np.zeros((len(payload) // BLOCK, BLOCK + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, BLOCK)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", BLOCK, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def png_head(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample, from the first HEAD bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def from_png(media: bytes) -> bytes:
    """The samples of an image of to_png()."""
    width, height, bits = png_head(media)
    at, data = 8, []
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            data.append(media[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, width * bits // 8 + 1)
    if rows[:, 0].any():
        raise ValueError("only rows without a filter are written here")
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """A 64-bit average hash over 64 runs of samples, with mean and spread of all samples."""
    x = np.frombuffer(payload, dtype=np.uint8)
    cut = np.arange(64) * len(x) // 64
    means = np.add.reduceat(x, cut, dtype=np.int64) / np.diff(np.append(cut, len(x)))
    bits = np.packbits(means > x.mean())
    return f"{bits.tobytes().hex()}-{x.mean():.3f}-{x.std():.3f}"


class TarShard:
    """A tar file under way; put() gives the place of a member's bytes."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.out, self.at, self.places = uri, fs.open_output_stream(path), 0, {}

    def put(self, digest: str, media: bytes) -> int:
        if digest not in self.places:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            self.out.write(head := info.tobuf(tarfile.USTAR_FORMAT))
            self.places[digest] = self.at + len(head)
            self.out.write(media + bytes(-len(media) % 512))
            self.at += len(head) + len(media) + -len(media) % 512
        return self.places[digest]

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()


def store_media(rows: DataFrame, folder: str, id_col: str = "doc_id", data_col: str = "data") -> DataFrame:
    """Stores the binary `data_col` of every row; returns ROWS, a table under `folder`. A task that is tried again writes a new shard."""

    def store(batches):
        import pyarrow as pa

        shard = None
        for batch in in_parts(batches, 512, 1):
            out = []
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = data or b""
                media = to_png(padded(data))
                digest = hashlib.sha256(media).hexdigest()
                if shard is None or shard.at > SHARD_BYTES:
                    if shard is not None:
                        shard.close()
                    shard = TarShard(f"{folder}/media-{uuid.uuid4().hex}.tar")
                out.append((doc, len(data), digest, shard.uri, shard.put(digest, media), len(media)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if shard is not None:
            shard.close()

    picked = rows.select(F.col(id_col).cast("long").alias("id"), F.col(data_col).cast("binary").alias("data"))
    picked.mapInArrow(store, ROWS).write.parquet(f"{folder}/rows")
    return rows.sparkSession.read.schema(ROWS).parquet(f"{folder}/rows")


def _by_place(stored: DataFrame) -> DataFrame:
    """Rows in runs of neighbouring payloads, READ_BYTES a task."""
    total = stored.agg(F.sum("length")).first()[0] or 0
    n = max(stored.sparkSession.sparkContext.defaultParallelism, -(-total // READ_BYTES))
    return stored.repartitionByRange(n, "shard", "offset").sortWithinPartitions("shard", "offset")


def _members(batches, head: int | None) -> Iterator:
    """For each batch its rows, with the stored bytes (the first `head` ones, or all); neighbours with one place are read once."""
    uri, file, place, got = None, None, None, b""
    for batch in in_parts(batches, 256):
        rows = []
        for r in batch.to_pylist():
            if r["shard"] != uri:
                fs, path = filesystem(r["shard"])
                uri, file, place = r["shard"], fs.open_input_file(path), None
            if place != r["offset"]:
                file.seek(r["offset"])
                place, got = r["offset"], file.read(r["length"] if head is None else min(head, r["length"]))
            rows.append((r, got))
        yield rows


def with_metadata(stored: DataFrame) -> DataFrame:
    """ROWS with METADATA, from a range read of each header alone; rows come out in runs of neighbouring payloads."""

    def read(batches):
        import pyarrow as pa

        for rows in _members(batches, HEAD):
            heads = [png_head(h) for _, h in rows]
            columns = {c.split()[0]: pa.array([r[c.split()[0]] for r, _ in rows], pa.int64() if c.endswith("long") else pa.string()) for c in ROWS.split(", ")}
            yield pa.RecordBatch.from_pydict(columns | {k: pa.array([h[i] for h in heads], pa.int32()) for i, k in enumerate(("width", "height", "bits"))})

    return _by_place(stored).mapInArrow(read, f"{ROWS}, {METADATA}")


def read_media(stored: DataFrame) -> DataFrame:
    """Reads every stored payload back, checks its digest and its header's metadata, and computes READ."""

    def read(batches):
        import pyarrow as pa

        last, values = None, ()
        for rows in _members(batches, None):
            out = []
            for r, media in rows:
                if r["digest"] != last:
                    digest = hashlib.sha256(media).hexdigest()
                    if digest != r["digest"]:
                        raise ValueError(f"{r['shard']} at {r['offset']}: other bytes than were stored")
                    payload = from_png(media)
                    last, values = digest, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), digest, feature_of(payload))
                if r["width"] * r["height"] * r["bits"] // 8 != values[0]:
                    raise ValueError(f"{r['shard']} at {r['offset']}: the header says {r['width']} x {r['height']}, there are {values[0]} samples")
                out.append((r["doc_id"], r["n_bytes"], *values, r["width"], r["height"], r["bits"]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            names = [c.split()[0] for c in READ.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return with_metadata(stored).mapInArrow(read, READ)


def op3_media_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of `documents` as media payloads, stored and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    return read_media(store_media(docs, new_folder(spark, "media")))
