"""Token ids in binary files, by bit-plane shuffling.

A shard file holds the ids of a run of documents, in ascending doc_id order, as one stream. The stream is cut into blocks of a fixed
number of ids; each block is transposed into its four byte planes (or 32 bit planes), and each plane is compressed with zstandard
by itself. Planes that hold only zeros take no bytes. Layout of a file:

    magic | plane bytes of block 0, 1, ... | chunk index | document index | footer

The chunk index has, for each block, its offset, its number of ids and the lengths of its planes; the document index has doc_id and
length of each document. The footer (fixed size, at the end) has the places of both, so a reader needs two small range reads before
it can fetch any block. A manifest table lists the shards.

Nulls and odd rows: a null text counts as empty, and an empty text yields only the end id. Rows with a null doc_id are written too, before all
others. Repeated doc_ids are kept, ordered by text. An empty table yields an empty manifest. Columns other than the two named ones
are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, in_parts, new_folder
from .tokens import encoder

MAGIC = b"QSTOKPL1"
_FOOTER = struct.Struct("<QQQQQQ8s")  # chunk index at, length, document index at, length, blocks, bit planes?, magic
BLOCK = 1 << 16
#: Bytes of text that a shard gets, about; its document index is held in memory, so this bounds it, too.
SHARD_BYTES = 16 << 20
MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long"


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids: 4 byte planes, or 32 bit planes of packed bits."""
    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [rows[:, k].tobytes() for k in range(4)]
    return [np.packbits((rows[:, k >> 3] >> (k & 7)) & 1).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The reverse of to_planes; an empty plane is all zeros."""
    rows = np.zeros((n, 4), dtype=np.uint8)
    for k, plane in enumerate(planes):
        if not plane:
            continue
        if len(planes) == 4:
            rows[:, k] = np.frombuffer(plane, dtype=np.uint8)
        else:
            rows[:, k >> 3] |= np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=n) << (k & 7)
    return rows.view("<u4").ravel()


class ShardWriter:
    """Writes one shard file; add() documents in order, then close()."""

    def __init__(self, uri: str, block: int = BLOCK, bits: bool = False, level: int = 3):
        import zstandard

        fs, path = filesystem(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.block, self.bits = fs.open_output_stream(path), block, bits
        self.packer = zstandard.ZstdCompressor(level=level)
        self.at, self.waiting, self.n_waiting = 0, [], 0
        self.chunks, self.docs, self.lengths, self.tokens = [], [], [], 0
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.tokens += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            stream = np.concatenate(self.waiting)
            end = len(stream) // self.block * self.block
            for i in range(0, end, self.block):
                self._put(stream[i : i + self.block])
            self.waiting, self.n_waiting = [stream[end:]], len(stream) - end

    def _put(self, ids: np.ndarray) -> None:
        packed = [self.packer.compress(p) if any(p) else b"" for p in to_planes(ids, self.bits)]
        self.chunks.append((self.at, len(ids), *map(len, packed)))
        for p in packed:
            self._write(p)

    def close(self) -> tuple[int, int, int]:
        """Documents, ids and bytes written."""
        if self.n_waiting:
            self._put(np.concatenate(self.waiting))
        chunk_at = self.at
        self._write(index := np.array(self.chunks, dtype="<u8").tobytes())
        doc_at = self.at
        ids = np.array([0 if d is None else d for d in self.docs], dtype="<i8")
        null = np.array([d is None for d in self.docs], dtype=np.uint8)
        self._write(docs := self.packer.compress(ids.tobytes() + np.array(self.lengths, dtype="<u8").tobytes() + null.tobytes()))
        self._write(_FOOTER.pack(chunk_at, len(index), doc_at, len(docs), len(self.chunks), int(self.bits), MAGIC))
        self.out.close()
        return len(self.docs), self.tokens, self.at


class ShardReader:
    """Reads a shard: its document index, single blocks, any run of ids, or all documents in order."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = filesystem(uri)
        self.unpacker = zstandard.ZstdDecompressor()
        self.file = fs.open_input_file(path)
        chunk_at, chunk_n, doc_at, doc_n, blocks, self.bits, magic = _FOOTER.unpack(self._range(self.file.size() - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token shard: {uri}")
        self.chunks = np.frombuffer(self._range(chunk_at, chunk_n), dtype="<u8").reshape(blocks, -1) if blocks else np.zeros((0, 6), dtype="<u8")
        raw = self.unpacker.decompress(self._range(doc_at, doc_n))
        n = len(raw) // 17
        self.lengths = np.frombuffer(raw[8 * n : 16 * n], dtype="<u8").astype(np.int64)
        null = np.frombuffer(raw[16 * n :], dtype=np.uint8)
        self.docs = [None if z else d for d, z in zip(np.frombuffer(raw[: 8 * n], dtype="<i8").tolist(), null.tolist())]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1] if n else np.zeros(0, dtype=np.int64)
        self.ends = np.cumsum(self.chunks[:, 1].astype(np.int64))

    def _range(self, at: int, n: int) -> bytes:
        self.file.seek(int(at))
        return self.file.read(int(n))

    def block(self, k: int) -> np.ndarray:
        at, n, *sizes = (int(x) for x in self.chunks[k])
        raw, planes = self._range(at, sum(sizes)), []
        for s in sizes:
            planes.append(self.unpacker.decompress(raw[:s]) if s else b"")
            raw = raw[s:]
        return from_planes(planes, n)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n of the stream, from the blocks that hold them."""
        if not n:
            return np.zeros(0, dtype="<u4")
        first, last = np.searchsorted(self.ends, [start, start + n - 1], side="right")
        got = np.concatenate([self.block(k) for k in range(first, last + 1)])
        skip = start - (int(self.ends[first - 1]) if first else 0)
        return got[skip : skip + n]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in this shard, ids), block by block."""
        have, at, k = np.zeros(0, dtype="<u4"), 0, 0
        for doc, start, n in zip(self.docs, self.starts.tolist(), self.lengths.tolist()):
            while at + len(have) < start + n:
                have, at, k = np.concatenate([have[start - at :], self.block(k)]), start, k + 1
            yield doc, start, have[start - at : start - at + n]

    def close(self) -> None:
        self.file.close()


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bits: bool = False, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Writes the shards of `docs` under `folder` and returns the manifest, itself a table there.

    Documents are dealt out by ranges of id, as many as all texts have `shard_bytes`, one shard file for each range; a file's name is new for each attempt of a task, and only
    files of tasks that ended well reach the manifest.
    """

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, tok, out = TaskContext.get().partitionId(), encoder(tokenizer), None
        for batch in in_parts(batches, 256, 1):
            if out is None:
                out = ShardWriter(uri := f"{folder}/shard-{part:06d}-{uuid.uuid4().hex[:12]}.qst", block, bits)
            texts = [x or "" for x in batch.column(1).to_pylist()]
            end = np.array([end_id], dtype=np.uint32)
            for doc, ids in zip(batch.column(0).to_pylist(), tok.encode(texts)):
                out.add(doc, np.concatenate([ids, end]))
        if out is not None:
            n, tokens, size = out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "path": [uri], "n_docs": [n], "n_tokens": [tokens], "n_bytes": [size]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body"))
    total, n = rows.agg(F.sum(F.octet_length("body")), F.count("*")).first()
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, -(-((total or 0) + 8 * n) // shard_bytes))
    rows = rows.repartitionByRange(shards, "id").sortWithinPartitions("id", "body")
    rows.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, from the stored files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark, shards, base = manifest.sparkSession, [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):  # one row for each file, not for each document
        shards.append((r["path"], base))
        base += r["n_tokens"]

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard, rows = ShardReader(path), []
                for doc, start, ids in shard.documents():
                    rows.append((doc, at + start, len(ids), zlib.crc32(ids.tobytes())))
                shard.close()
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(shards, "path string, base long")
    if shards:
        files = files.repartition(len(shards))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` through the byte-level BPE, written as planes and read back."""
    import public_tokenizers

    from .common import table

    docs = table(spark, sf_dir, "documents")
    return read_token_files(write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), new_folder(spark, "tokens"), end_id=0))
