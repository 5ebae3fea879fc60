"""Exact removal of repeated byte strings by suffix sorting.

A byte is removed if a string of `length` bytes that covers it also starts in a document with a smaller doc_id. Work goes in units of
some megabytes of text, written once to the shared folder, and in shards of strings that could be equal:

1. Each window of `length` bytes has an anchor, the least hash of the 16-byte strings in it. Equal windows have equal anchors, so only
   anchors that two documents share matter. Units send their distinct anchors (delta-coded, by ranges of the hash) and get a bit for each.
2. A run of neighbouring windows with one shared anchor is a segment, some dozens of bytes. Each unit sends each distinct segment once,
   with the least doc_id that has it there, to the shard of its anchor.
3. A shard drops equal segments, and sorts the suffixes of all segments whose anchor comes with more than one text (suffixes.py). Suffixes
   that share `length` bytes are one string; the least doc_id among its segments is where it starts first. Anchors with a single
   text need no sorting. Units get back one bit for each window they sent: whether a smaller doc_id has it.
4. Units lay the bits over their texts. A copy within the unit whose doc_id isn't the least there is covered without asking.

Hashes only group: segments count as equal if their bytes are. Hot strings cost each unit one segment, however many documents hold them.
Units and shards have UNIT_BYTES of text, or the square root of PIECE_BYTES times all text if that is more: so the pieces that units and
shards exchange are as many as the text has PIECE_BYTES, and a task's memory grows with the square root of the input. Pieces stream to the
task of their shard or unit in order; a shard is worked off in ranges of anchors.

Nulls and odd rows: a null text counts as empty and stays null. A null doc_id counts as smaller than any other; rows with one doc_id
never remove from each other. Matches never cross documents. Texts shorter than `length` lose nothing. An empty table gives an empty
result. Columns are carried along, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import struct
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_ID, by_number, dropped, filesystem, groups_of, in_parts, new_folder, table, tidy, written
from .suffixes import suffix_order
from .tokens import _MASK, eight_bytes

LENGTH, GRAM = 50, 16
UNIT_BYTES, PIECE_BYTES, SORT_BYTES, MOST_WINDOWS = 8 << 20, 8 << 10, 2 << 20, 192
#: A shard's windows are compared about so many at a time.
WINDOWS_AT_ONCE = 1 << 20
PIECES = "unit string, shard int, data binary"
_A, _B, _BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 40


def sizes_for(total: int, least: int = UNIT_BYTES) -> int:
    """Bytes of text of a unit, and of a shard, for `total` bytes."""
    return max(least, math.isqrt(total * PIECE_BYTES))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed."""
    import zstandard

    parts, head = [], struct.pack("<I", len(arrays))
    for x in arrays:
        x = np.ascontiguousarray(x)
        head += struct.pack("<3sQ", x.dtype.str[1:].encode().ljust(3), len(x))
        parts.append(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,), at, kinds, out = struct.unpack_from("<I", raw), 4, [], []
    for _ in range(n):
        kind, size = struct.unpack_from("<3sQ", raw, at)
        kinds.append((np.dtype(kind.strip().decode()), size))
        at += 11
    for kind, size in kinds:
        planes = np.frombuffer(raw, dtype=np.uint8, count=size * kind.itemsize, offset=at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size * kind.itemsize
    return out


def _min_over(h: np.ndarray, width: int) -> np.ndarray:
    span, c = 1, h
    while span * 2 <= width:
        c = np.minimum(c[:-span], c[span:])
        span *= 2
    return np.minimum(c[: len(c) - (width - span)], c[width - span :]) if span < width else c


def spread(h: np.ndarray) -> np.ndarray:
    """Least hashes are small numbers; this makes their leading bits even, so that ranges of them are shards of one size."""
    h = h * _B
    h ^= h >> np.uint64(32)
    return h * _A


def runs_of(data: np.ndarray, doc_at: np.ndarray, doc_n: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor, document number) of the runs of neighbouring windows with one anchor, over all documents in data."""
    starts, counts, anchors, chunk = [], [], [], 1 << 19
    ends = doc_at + doc_n
    for at in range(0, max(len(data) - length + 1, 0), chunk):
        part = data[at : at + chunk + length - 1]
        n = len(part) - length + 1
        words = np.ndarray(shape=(len(part) - 7,), dtype="<u8", buffer=np.ascontiguousarray(part).data, strides=(1,)).astype(np.uint64)
        m = len(part) - GRAM + 1
        h = words[:m] * _A
        h ^= h >> np.uint64(29)
        h = (h ^ words[8 : 8 + m]) * _B
        h ^= h >> np.uint64(32)
        h *= _A
        least = _min_over(h, length - GRAM + 1)[:n]
        first = np.searchsorted(doc_at, at, side="right") - 1
        marks = np.zeros(n, dtype=np.int64)
        marks[doc_at[first + 1 : np.searchsorted(doc_at, at + n)] - at] = 1
        doc = first + np.cumsum(marks)
        valid = np.arange(at, at + n) + length <= ends[doc]
        edge = np.ones(n, dtype=bool)
        edge[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
        begin = np.flatnonzero(edge)
        size = np.diff(np.append(begin, n))
        keep = valid[begin]
        begin, size = begin[keep], size[keep]
        value = spread(least[begin]) >> np.uint64(64 - _BITS)
        if len(size) and size.max() > MOST_WINDOWS:  # as in long repetitions of few bytes
            pieces = -(-size // MOST_WINDOWS)
            k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            value, begin0, size0 = np.repeat(value, pieces), np.repeat(begin, pieces), np.repeat(size, pieces)
            begin, size = begin0 + k * MOST_WINDOWS, np.minimum(MOST_WINDOWS, size0 - k * MOST_WINDOWS)
        starts.append(begin + at)
        counts.append(size)
        anchors.append(value)
    if not starts:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z.astype(np.uint64), z
    start = np.concatenate(starts)
    return start, np.concatenate(counts), np.concatenate(anchors), np.searchsorted(doc_at, start, side="right") - 1


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., for sizes[0] numbers, then the same for the next."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)


def ordered(values: np.ndarray, bits: int) -> np.ndarray:
    """A stable order of values of `bits` bits; with their places in the free bits, if they fit, plain sorting will do, which is far faster."""
    free = int(len(values)).bit_length()
    if bits + free > 64:
        return np.argsort(values, kind="stable")
    return (np.sort(values << np.uint64(free) | np.arange(len(values), dtype=np.uint64)) & np.uint64((1 << free) - 1)).astype(np.int64)


def among(values: np.ndarray, known: np.ndarray, bits: int) -> np.ndarray:
    """Places of the values (of `bits` bits) that are in `known` (ascending); a table of leading bits leaves most others out before the search."""
    if not len(known):
        return np.zeros(0, dtype=np.int64)
    shift, sieve = np.uint64(max(0, bits - 22)), np.zeros(1 << min(22, bits), dtype=bool)
    sieve[known >> shift] = True
    some = np.flatnonzero(sieve[values >> shift])
    at = np.searchsorted(known, values[some])
    at[at == len(known)] = 0
    return some[known[at] == values[some]]


class Unit:
    """The documents of a unit file, in its order."""

    def __init__(self, batch, length: int):
        import pyarrow.compute as pc

        self.batch, self.length = batch, length
        self.key = np.asarray(batch.column("_key"))
        body = pc.fill_null(batch.column("_body").cast("large_binary"), b"")
        _, offsets, data = body.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64, count=len(body) + 1, offset=8 * body.offset)
        self.data = np.frombuffer(data, dtype=np.uint8, count=int(offsets[-1] - offsets[0]), offset=int(offsets[0])) if data and offsets[-1] > offsets[0] else np.zeros(0, dtype=np.uint8)
        self.doc_n = np.diff(offsets)
        some = self.doc_n > 0  # empty documents have no bytes, so no runs
        self.numbers = np.flatnonzero(some)
        self.doc_at = np.cumsum(self.doc_n) - self.doc_n
        start, size, anchor, doc = runs_of(self.data, self.doc_at[some], self.doc_n[some], length)
        self.start, self.size, self.anchor, self.doc = start, size, anchor, self.numbers[doc] if len(doc) else doc

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors, ascending, and whether two doc_ids here have it."""
        order = ordered(self.anchor, _BITS)
        value, key = self.anchor[order], self.key[self.doc[order]]
        head = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, dtype=np.int64)
        if not len(head):
            return value, np.zeros(0, dtype=bool)
        return value[head], np.maximum.reduceat(key, head) != np.minimum.reduceat(key, head)

    def segments(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs with an anchor of `shared` (ascending), ordered by anchor and text; the first run of each distinct text; its least key."""
        runs = among(self.anchor, shared, _BITS)
        size = self.size[runs] + self.length - 1
        order, new = alike(self.anchor[runs], self.data, self.start[runs], size)
        runs, head = runs[order], np.flatnonzero(new)
        least = np.minimum.reduceat(self.key[self.doc[runs]], head) if len(head) else np.zeros(0, dtype=np.int64)
        return runs, head, least


def _count_before(mask: np.ndarray) -> np.ndarray:
    """How many are set before each place, and at the end all; a unit has fewer than 2**31 bytes, as an Arrow column has."""
    out = np.zeros(len(mask) + 1, dtype=np.int32)
    np.cumsum(mask, dtype=np.int32, out=out[1:])
    return out


def alike(anchor: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of segments by anchor with equal ones side by side, and where in it another text begins. A hash finds the order, bytes
    decide; should texts with one hash alternate, one of them begins more than once, which costs work but changes no result."""
    words, h = eight_bytes(data, 8), size.astype(np.uint64) * _B
    most = int(size.max()) if len(size) else 0
    for k in range(0, most, 8):
        go = np.flatnonzero(size > k) if k >= LENGTH else slice(None)
        left = np.clip(size[go] - k, 0, 8)
        x = (h[go] ^ (words[np.minimum(start[go] + k, len(words) - 1)] & _MASK[left])) * _A
        h[go] = x ^ (x >> np.uint64(29))
    h *= _B
    order = np.argsort(anchor << np.uint64(64 - _BITS) | h >> np.uint64(_BITS), kind="stable")
    a, h, n = anchor[order], h[order], size[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (h[1:] != h[:-1]) | (n[1:] != n[:-1])
    pairs = np.flatnonzero(~new)
    p, q, n = start[order[pairs]], start[order[pairs - 1]], n[pairs]
    for k in range(0, most if len(pairs) else 0, 8):
        go = np.flatnonzero(n > k)
        differ = ((words[p[go] + k] ^ words[q[go] + k]) & _MASK[np.minimum(n[go] - k, 8)]) != 0
        new[pairs[go[differ]]] = True
    return order, new


def _shard(anchor: np.ndarray, shards: int) -> np.ndarray:
    return ((anchor * np.uint64(shards)) >> np.uint64(_BITS)).astype(np.int64)


def first_keys(data: np.ndarray, at: np.ndarray, windows: np.ndarray, key: np.ndarray, group: np.ndarray, length: int, sort_bytes: int = SORT_BYTES) -> np.ndarray:
    """For each window of the distinct segments (at, windows, key; ordered by group): the least key of any segment of its group that has it."""
    where = np.cumsum(windows) - windows
    out = np.repeat(key, windows)
    size = windows + length - 1
    many = np.bincount(group)[group] > 1
    todo = np.flatnonzero(many)
    # whole groups, about sort_bytes at a time; a group has one anchor, so windows of different groups differ
    upto = np.cumsum(size[todo] + 1)
    last = np.append(np.flatnonzero(group[todo][1:] != group[todo][:-1]), len(todo) - 1) if len(todo) else np.zeros(0, dtype=np.int64)
    begin = 0
    while begin < len(todo):
        base = upto[begin - 1] if begin else 0
        fit = last[(upto[last] - base <= sort_bytes) & (last >= begin)]
        end = int(fit[-1]) if len(fit) else int(last[np.searchsorted(last, begin)])
        rows = todo[begin : end + 1]
        sizes = size[rows]
        places = np.cumsum(sizes + 1) - sizes - 1
        text = np.ones(int((sizes + 1).sum()) + 1, dtype=np.uint8)  # 1 separates, 0 ends; UTF-8 has no bytes over 0xF4
        text[ragged(places, sizes)] = data[ragged(at[rows], sizes)] + np.uint8(2)
        text[-1] = 0
        order, shared = suffix_order(text, length)
        string = np.cumsum(shared < length)
        window_of = np.full(len(text), -1, dtype=np.int64)
        window_of[ragged(places, windows[rows])] = ragged(where[rows], windows[rows])
        mine = window_of[order]
        keep = mine >= 0
        mine, string = mine[keep], string[keep]
        heads = np.flatnonzero(np.concatenate(([True], string[1:] != string[:-1])))
        least = np.minimum.reduceat(out[mine], heads)
        out[mine] = np.repeat(least, np.diff(np.append(heads, len(mine))))
        begin = end + 1
    return out


def _write_unit(batches: list, uri: str) -> None:
    import pyarrow as pa

    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out, pa.ipc.new_file(out, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        for b in batches:
            w.write_batch(b)


def _read_unit(uri: str, length: int) -> Unit:
    import pyarrow as pa

    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        return Unit(pa.ipc.open_file(f).read_all().combine_chunks().to_batches()[0], length)


def least_of_windows(parts: list[tuple[np.ndarray, ...]], length: int, most: int = WINDOWS_AT_ONCE) -> list[np.ndarray]:
    """parts: (anchor, windows, key, data) of segments, each part sorted by anchor. For each part, whether each of its windows is in a
    segment with a smaller key. Ranges of anchors with about `most` windows are compared at a time."""
    every = np.sort(np.concatenate([p[0] for p in parts]))
    total = sum(int(p[1].sum()) for p in parts)
    steps = np.arange(1, -(-total // most)) * len(every) // max(1, -(-total // most))
    edges = [0, *np.unique(every[steps]).tolist(), 1 << 63]
    byte_at = [np.concatenate(([0], np.cumsum(p[1].astype(np.int64) + length - 1))) for p in parts]
    cuts = [np.searchsorted(p[0], np.array(edges, dtype=np.uint64)).tolist() for p in parts]
    out: list[list[np.ndarray]] = [[] for _ in parts]
    for e in range(len(edges) - 1):
        some = [(k, c[e], c[e + 1]) for k, c in enumerate(cuts) if c[e] < c[e + 1]]
        if not some:
            continue
        anchor = np.concatenate([parts[k][0][a:b] for k, a, b in some])
        windows = np.concatenate([parts[k][1][a:b] for k, a, b in some]).astype(np.int64)
        key = np.concatenate([parts[k][2][a:b] for k, a, b in some])
        data = np.concatenate([parts[k][3][byte_at[k][a] : byte_at[k][b]] for k, a, b in some])
        size = windows + length - 1
        at = np.cumsum(size) - size
        order, new = alike(anchor, data, at, size)
        first = np.flatnonzero(new)
        head = order[first]
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        group = np.cumsum(np.concatenate(([True], anchor[head][1:] != anchor[head][:-1]))) - 1
        least = first_keys(data, at[head], windows[head], np.minimum.reduceat(key[order], first), group, length)
        where, i = np.cumsum(windows[head]) - windows[head], 0
        for k, a, b in some:
            mine = slice(i, i + b - a)
            i += b - a
            out[k].append(least[ragged(where[number[mine]], windows[mine])] < np.repeat(key[mine], windows[mine]))
    return [np.concatenate(x) for x in out]


def _covered(docs: DataFrame, finish, schema, length: int, unit_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """finish(unit, removed) for each unit, with a mask of the removed bytes: Arrow batches of `schema`."""
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = docs.sparkSession
    folder = new_folder(spark, "units")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_key")
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), key, F.col(text_col).cast("string").alias("_body"))
    total = docs.select(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    unit_bytes = sizes_for(total, unit_bytes)
    shards = max(spark.sparkContext.defaultParallelism, -(-total // unit_bytes))

    def pieces(unit: list, shard: list, data: list):
        return pa.RecordBatch.from_pydict({"unit": pa.array(unit, pa.string()), "shard": pa.array(shard, pa.int32()), "data": pa.array(data, pa.binary())})

    def to_units(batches):
        def flush():
            uri = f"{folder}/{uuid.uuid4().hex}.arrow"
            unit = Unit(pa.Table.from_batches(held).combine_chunks().to_batches()[0], length)
            _write_unit([unit.batch], uri)
            value, many = unit.anchors()
            cut = np.searchsorted(_shard(value, shards), np.arange(shards + 1)).tolist()
            yield pieces([uri], [-1], [b""])
            for k, (a, b) in enumerate(zip(cut, cut[1:])):
                if a < b:
                    yield pieces([uri], [k], [pack(np.diff(value[a:b], prepend=np.uint64(0)), many[a:b])])

        held, size = [], 0
        for part in in_parts(batches, 256, 2):
            held.append(part)
            size += pc.sum(pc.binary_length(part.column("_body"))).as_py() or 0
            if size >= unit_bytes:
                yield from flush()
                held, size = [], 0
                tidy()
        if held:
            yield from flush()
            held = []
            tidy()

    anchors = new_folder(spark, "anchors")
    rows.mapInArrow(to_units, PIECES).write.parquet(anchors)
    sent = spark.read.schema(PIECES).parquet(anchors)

    def compare(batches):
        for shard, rows in groups_of(batches, "shard"):
            parts = [unpack(r["data"]) for r in rows]
            values = [np.cumsum(d, dtype=np.uint64) for d, _ in parts]
            # an anchor is shared if two units have it, or two documents of one unit
            every = np.sort(np.concatenate(values + [v[m] for v, (_, m) in zip(values, parts)]))
            twice = every[:-1][every[1:] == every[:-1]]
            hot = twice[np.concatenate(([True], twice[1:] != twice[:-1]))] if len(twice) else twice
            del every, twice
            for r, v in zip(rows, values):
                mine = np.intersect1d(v, hot, assume_unique=True)
                if len(mine):
                    yield pieces([r["unit"]], [shard], [pack(np.diff(mine, prepend=np.uint64(0)))])
            del parts, values, hot
            tidy()

    units = written(sent.where(F.col("shard") < 0), "names")
    n_units = max(1, units.count())
    shared = written(by_number(sent.where(F.col("shard") >= 0), shards, "shard", "unit").mapInArrow(compare, PIECES), "shared")
    dropped(spark, anchors)

    def shared_of(parts) -> np.ndarray:
        found = [np.cumsum(unpack(p["data"])[0], dtype=np.uint64) for p in parts]
        return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)

    def by_unit(df: DataFrame) -> DataFrame:
        return df.repartition(n_units, "unit").sortWithinPartitions("unit", "shard")

    def to_shards(batches):
        for uri, rows in groups_of(batches, "unit"):
            unit = _read_unit(uri, length)
            runs, head, least = unit.segments(shared_of(rows))
            first = runs[head]
            cut = np.searchsorted(_shard(unit.anchor[first], shards), np.arange(shards + 1)).tolist()
            for k, (a, b) in enumerate(zip(cut, cut[1:])):
                if a < b:
                    f = first[a:b]
                    data = unit.data[ragged(unit.start[f], unit.size[f] + length - 1)]
                    yield pieces([uri], [k], [pack(np.diff(unit.anchor[f], prepend=np.uint64(0)), unit.size[f].astype(np.uint16), least[a:b], data)])
            del unit, runs, head, least, first
            tidy()

    def to_bits(batches):
        for shard, rows in groups_of(batches, "shard"):
            parts = []
            for r in rows:
                anchor, windows, key, data = unpack(r.pop("data"))
                parts.append((np.cumsum(anchor, dtype=np.uint64), windows, key, data))
            for r, bits in zip(rows, least_of_windows(parts, length)):
                yield pieces([r["unit"]], [shard], [pack(np.packbits(bits))])
            del parts, rows
            tidy()

    answers = by_number(by_unit(shared).mapInArrow(to_shards, PIECES), shards, "shard", "unit").mapInArrow(to_bits, PIECES)
    answers = written(answers, "bits")

    def lay(batches):
        for uri, rows in groups_of(batches, "unit"):
            unit = _read_unit(uri, length)
            begins = np.zeros(len(unit.data), dtype=bool)
            parts = [r for r in rows if r["what"] == 1]
            if parts:
                runs, head, least = unit.segments(shared_of(parts))
                first = runs[head]
                cut = np.searchsorted(_shard(unit.anchor[first], shards), np.arange(shards + 1))
                bits = np.zeros(int(unit.size[first].sum()), dtype=bool)
                upto = np.concatenate(([0], np.cumsum(unit.size[first])))
                for p in (r for r in rows if r["what"] == 2):
                    a, b = int(upto[cut[p["shard"]]]), int(upto[cut[p["shard"] + 1]])
                    bits[a:b] = np.unpackbits(unpack(p["data"])[0], count=b - a)
                mark = np.zeros(len(runs), dtype=np.int64)
                mark[head] = 1
                number = np.cumsum(mark) - 1
                reach = np.cumsum(unit.size[runs])
                cuts = np.unique(np.append(np.searchsorted(reach, np.arange(1 << 19, int(reach[-1]), 1 << 19)), len(runs)))
                for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
                    some, n = runs[a:b], number[a:b]
                    covered = bits[ragged(upto[:-1][n], unit.size[some])]
                    covered |= np.repeat(unit.key[unit.doc[some]] > least[n], unit.size[some])
                    begins[ragged(unit.start[some], unit.size[some])[covered]] = True
                del runs, head, least, first, bits, number, reach
            upto = np.cumsum(begins, dtype=np.int32)
            removed = upto > 0
            removed[length:] = upto[length:] > upto[:-length]
            del upto, begins
            yield from finish(unit, removed)
            del unit, removed
            tidy()

    marked = [df.withColumn("what", F.lit(k)) for k, df in enumerate((units, shared, answers))]
    return by_unit(marked[0].unionByName(marked[1]).unionByName(marked[2])).mapInArrow(lay, schema)


def repeat_report(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""

    def finish(unit: Unit, removed: np.ndarray):
        import pyarrow as pa

        at, n = unit.doc_at, unit.doc_n
        gone = _count_before(removed)
        starts = removed.copy()
        starts[1:] &= ~removed[:-1]
        first = at[n > 0]
        starts[first] = removed[first]
        spans = _count_before(starts)
        kept = unit.data[~removed].tobytes()
        left = at - gone[at]
        n_removed = (gone[at + n] - gone[at]).astype(np.int64)
        sums = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(left.tolist(), (left + n - n_removed).tolist())]
        ids = pa.array(unit.key, pa.int64(), mask=unit.key == NO_ID)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(n_removed), pa.array((spans[at + n] - spans[at]).astype(np.int64)), pa.array(sums, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _covered(picked.select("doc_id", "text"), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length, unit_bytes, "doc_id", "text")


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """The rows of docs with the repeated bytes cut out of the text; characters that are cut in two go whole. Rows of which nothing is left go."""
    names = docs.columns
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    at = names.index(text_col)

    def finish(unit: Unit, removed: np.ndarray):
        import pyarrow as pa

        gone = _count_before(removed)
        a, n = unit.doc_at, unit.doc_n
        left = a - gone[a]
        n_removed = gone[a + n] - gone[a]
        kept = unit.data[~removed].tobytes()
        old = unit.batch.column("_body").to_pylist()
        new = [t if not r else kept[x : x + m - r].decode("utf-8", "ignore") for t, x, m, r in zip(old, left.tolist(), n.tolist(), n_removed.tolist())]
        columns = list(unit.batch.column("_row").flatten())
        columns[at] = pa.array(new, pa.string())
        out = pa.RecordBatch.from_arrays(columns, names=names)
        out = out.filter(pa.array((n_removed == 0) | np.array([bool(t) for t in new], dtype=bool)))
        for i in range(0, out.num_rows, 2048):
            yield out.slice(i, 2048)

    return _covered(docs, finish, schema, length, unit_bytes, id_col, text_col)


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all of `documents` in strings of 50 bytes that an earlier document has."""
    return repeat_report(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH hexed AS (
    SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents
), windows AS (
    SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM hexed)
), firsts AS (
    SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS f FROM windows
), covered AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM firsts WHERE f < doc_id
), runs AS (
    SELECT doc_id, min(p) AS a, max(p) + 1 AS b FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM covered) GROUP BY doc_id, g
), gaps AS (
    SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY a)
    UNION ALL
    SELECT doc_id, max(b), 1000000000 FROM runs GROUP BY doc_id
), kept AS (
    SELECT g.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM gaps g JOIN hexed USING (doc_id) GROUP BY g.doc_id
), spans AS (
    SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM hexed LEFT JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id)
"""
