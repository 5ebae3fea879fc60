"""SimHash near-duplicates by a generalised pigeonhole.

A fingerprint has 64 bits, and two documents are linked if theirs differ in at most `distance` bits. Bits are split into parts, and
part i gets a threshold t_i (-1: the part isn't used) with sum(t_i + 1) = distance + 1: two linked fingerprints then differ in at most
t_i bits in some part i, as otherwise they would differ in more than `distance` bits in all. Correlated bits go to the same part
(their agreement counts over all fingerprints decide), so that a part without much information can be left out; the thresholds are
found by dynamic programming on the estimated work: keys to write, and candidates that meet. A threshold of 0 probes the part's value,
a threshold of 1 the values with one bit blotted out, and so on.

Candidates meet by key in sorted runs. Within a run, fingerprints are compared with their neighbours at growing offsets as arrays, and
only links between different components of the run leave it: at most one fewer than its members, whatever its size. Keys are counted
first (map-side, so a hot key is never gathered): a run of more than `long_run` members is split by the pigeonhole again, over the bits
that its key leaves free. These fall into distance + 1 groups, two linked members agree in one of them whole, and each group's value joins
the key. Runs that are still too long are split once more; every split fixes more bits, and members are distinct, so this ends. Components
then come from alternating stars over the written links.

Nulls and odd rows: a null text counts as empty; texts without words have fingerprint zero, linked like any other. Rows with a null
doc_id take part, with a null component_id if they are its smallest. Equal texts share a fingerprint, and only distinct fingerprints
are compared. Repeated rows give repeated rows. An empty table gives an empty result. Columns other than those named are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, id_of, in_parts, key_of, table, written
from .components import components

BITS, DISTANCE, SHINGLE = 64, 3, 3
#: Estimated cost of writing and sorting a key, against one comparison in a run.
KEY_COST = 400
#: A run of more members than this is split by further bits; up to so many hot keys go to all tasks (16 bytes each), more are joined.
LONG_RUN, MOST_HOT = 40_000, 100_000
KEYED = "mask long, value long, fp long"


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of the word shingles of a whole text, lower-cased in ASCII."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(b" ".join(words), 42)
    whole = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    hashes = np.array([h(whole[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """key (never null, see common.key_of) and fp, the fingerprint as a signed long."""

    def compute(batches):
        import pyarrow as pa

        for batch in in_parts(batches, 512, 1):
            fps = np.array([fingerprint(t or "", shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])

    return docs.select(key_of(id_col).alias("key"), F.col(text_col).cast("string").alias("body")).mapInArrow(compute, "key long, fp long")


def agreement(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of distinct fingerprints, and in how many of them bits i and j are both set (a sum of small matrices, one for each task)."""

    def count(batches):
        import pyarrow as pa

        n, both = 0, np.zeros((BITS, BITS))
        for batch in in_parts(batches, 65536):
            bits = np.unpackbits(np.asarray(batch.column(0)).astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "both": pa.array([both.astype(np.int64).ravel().tolist()], pa.list_(pa.int64()))})

    rows = fps.select("fp").mapInArrow(count, "n long, both array<long>").collect()
    return sum(r["n"] for r in rows), sum((np.array(r["both"]) for r in rows), np.zeros(BITS * BITS)).reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly equal size: each group takes a seed bit and then the bits most correlated with what it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tied = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(free, key=lambda i: (tied[i, free].sum(), -i))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda i: (tied[i, group].sum(), -i)))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def meeting_rate(n: int, both: np.ndarray, group: list[int], radius: int) -> float:
    """Estimated share of pairs that differ in at most `radius` bits of `group`: disagreement of each bit, bits taken as independent."""
    p = np.diag(both)[group] / max(n, 1)
    differ = 2 * p * (1 - p)
    by = np.zeros(radius + 2)
    by[0] = 1
    for d in differ:
        by[1:-1] = by[1:-1] * (1 - d) + by[:-2] * d
        by[0] *= 1 - d
    return float(by[: radius + 1].sum())


def plan(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """The parts to probe, each with its threshold, of the least estimated cost over all numbers of parts up to distance + 2."""
    best = (float("inf"), [])
    for m in range(1, distance + 3):
        groups = group_bits(n, both, m)

        def cost(k: int, t: int) -> float:
            if t < 0:
                return 0.0
            keys = comb(len(groups[k]), t)
            return n * keys * KEY_COST + meeting_rate(n, both, groups[k], t) * n * n / 2 * (1 if not t else len(groups[k]) / t)

        # least[s]: the cheapest thresholds of the groups so far that use up s of the distance + 1 units (a threshold t uses t + 1)
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for k in range(m):
            nxt: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in least.items():
                for t in range(-1, distance + 1 - s):
                    made = (c + cost(k, t), [*ts, t])
                    if s + t + 1 not in nxt or made[0] < nxt[s + t + 1][0]:
                        nxt[s + t + 1] = made
            least = nxt
        total, ts = least[distance + 1]
        if total < best[0]:
            best = (total, [(g, t) for g, t in zip(groups, ts) if t >= 0])
    return best[1]


def masks(parts: list[tuple[list[int], int]]) -> list[int]:
    """The bit masks whose masked values are keys: a part with threshold t gives one mask for each choice of t bits to blot out."""
    return [sum(1 << b for b in group if b not in gone) for group, t in parts for gone in combinations(group, t)]


def _roots(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Unites the components of a[i] and b[i]; returns those links that did unite two."""
    used = []
    while len(a):
        x, y = label[a], label[b]
        go = x != y
        a, b, x, y = a[go], b[go], x[go], y[go]
        if not len(a):
            break
        hi, lo = np.maximum(x, y), np.minimum(x, y)
        top, first = np.unique(hi, return_index=True)  # each root gets one new parent, of a smaller number: no cycles
        label[top] = lo[first]
        used += list(zip(a[first].tolist(), b[first].tolist()))
        label[:] = _roots(label)
    return used


def run_links(fps: np.ndarray, run: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (of positions) that unite the components within each run of equal `run` values; fps are distinct within a run."""
    n = len(fps)
    label, links = np.arange(n), []
    edge = np.flatnonzero(np.diff(run)) + 1
    start = np.repeat(np.concatenate(([0], edge)), np.diff(np.concatenate(([0], edge, [n])))) if n else np.zeros(0, dtype=np.int64)
    left = np.arange(n)
    d = 1
    while len(left):
        left = left[left + d < n]
        left = left[start[left + d] == start[left]]
        near = left[np.bitwise_count(fps[left] ^ fps[left + d]) <= distance]
        if len(near):
            links += _join(label, near, near + d)
        d += 1
    return links


def narrower(mask: int, distance: int) -> list[int]:
    """Masks with more bits: two values that agree under `mask` and differ in at most `distance` bits agree under one of these."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[k :: distance + 1]) for k in range(distance + 1)]


def _keyed(fp: np.ndarray, mask: int):
    """Rows mask, value, fp of fingerprints under a mask."""
    import pyarrow as pa

    m = np.uint64(mask)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), m).view(np.int64)), pa.array((fp & m).view(np.int64)), pa.array(fp.view(np.int64))], names=["mask", "value", "fp"])


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, long_run: int = LONG_RUN) -> DataFrame:
    """Links a, b of distinct fingerprints (column fp) that unite each component."""
    n, both = agreement(fps)
    chosen = masks(plan(n, both, distance))
    long_run = max(long_run, 2 ** (distance + 1))  # longer runs have more free bits than groups, so a split fixes some in each

    def keys(batches):
        for batch in in_parts(batches, 8192):
            fp = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            for mask in chosen:
                yield _keyed(fp, mask)

    def split(batches):
        for batch in in_parts(batches, 8192):
            of = np.asarray(batch.column("mask")).astype(np.int64)
            fp = np.asarray(batch.column("fp")).astype(np.int64).view(np.uint64)
            for m in np.unique(of):
                for mask in narrower(int(m) & (1 << BITS) - 1, distance):
                    yield _keyed(fp[of == m], mask)

    def meet(batches):
        import pyarrow as pa

        def links(mask, value, fp):
            run = np.cumsum(np.concatenate(([0], (np.diff(mask) != 0) | (np.diff(value) != 0)))) if len(fp) else value
            got = run_links(fp.view(np.uint64), run, distance)
            a, b = np.array([x for x, _ in got], dtype=np.int64), np.array([y for _, y in got], dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

        held: list[np.ndarray] = []  # rows of the last, possibly unfinished run
        for batch in batches:
            cols = [np.asarray(batch.column(i)) for i in range(3)]
            if held and len(cols[0]) and (held[-1][0][0], held[-1][1][0]) == (cols[0][-1], cols[1][-1]) and cols[0][0] == cols[0][-1] and cols[1][0] == cols[1][-1]:
                held.append(cols)
                continue
            if held:
                cols = [np.concatenate([h[i] for h in held] + [cols[i]]) for i in range(3)]
            change = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0))
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield links(*(c[:cut] for c in cols))
            held = [[c[cut:] for c in cols]] if len(cols[0]) > cut else []
        if held:
            yield links(*(np.concatenate([h[i] for h in held]) for i in range(3)))

    probed, found = fps.select("fp").mapInArrow(keys, KEYED), []
    while probed is not None:
        hot = written(probed.groupBy("mask", "value").count().where(F.col("count") > long_run).select("mask", "value"), "hot")
        n_hot, rest = hot.count(), None
        if n_hot:
            some = F.broadcast(hot) if n_hot <= MOST_HOT else hot
            rest = written(probed.join(some, ["mask", "value"], "left_semi").select("mask", "value", "fp").mapInArrow(split, KEYED).distinct(), "split")
            probed = probed.join(some, ["mask", "value"], "left_anti").select("mask", "value", "fp")
        found.append(probed.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(meet, "a long, b long"))
        probed = rest
    return reduce(DataFrame.union, found)


def _grouped(docs: DataFrame, distance: int, id_col: str, text_col: str) -> DataFrame:
    """key, fp, root (a fingerprint that stands for the component) and component (its smallest key) of every row."""
    marked = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("key").alias("first")), "distinct")
    group = components(fingerprint_links(distinct, distance))  # v, root: fingerprints with links only
    tied = distinct.join(group, distinct["fp"] == group["v"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = tied.groupBy("root").agg(F.min("first").alias("component"))
    return marked.join(tied.join(least, "root").select("fp", "root", "component"), "fp")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that can be reached."""
    rows = _grouped(docs, distance, id_col, text_col)
    return rows.select(id_of("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), id_of("component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs, one of each component: the one with the smallest doc_id. Of several rows with that doc_id in the component the one
    with the least text stays (a null one first), and of equal texts the one with the least hash of all columns."""
    near = written(_grouped(docs, distance, "doc_id", "text"), "near")
    by_key = near.groupBy("key").agg(F.count("*").alias("rows"), F.max(F.col("key") == F.col("component")).alias("kept")).where("kept")
    key, row, fp = fresh(docs, "key"), fresh(docs, "row"), fresh(docs, "fp")
    picked = lambda keys: docs.join(keys.select(F.col("key").alias(key)), key_of("doc_id") == F.col(key), "left_semi")
    out = picked(by_key.where("rows = 1"))
    if by_key.where("rows > 1").isEmpty():
        return out
    # doc_ids that come again: their rows are told apart by their fingerprints
    rows, names, at = picked(by_key.where("rows > 1")), docs.columns, docs.columns.index("text")

    def mark(batches):
        import pyarrow as pa

        for batch in in_parts(batches, 512):
            values = np.array([fingerprint(t or "") for t in batch.column(at).cast(pa.string()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values.view(np.int64))], names=[*names, fp])

    marked = rows.mapInArrow(mark, T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())]))
    of = near.where(F.col("key") == F.col("component")).select(F.col("key").alias(key), F.col("fp").alias(row), "root").distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = F.xxhash64(*(F.to_json(F.struct(c)) for c in columns))
    whole = marked.select(key_of("doc_id").alias("one_key"), F.col(fp).alias("one_fp"), F.struct(*columns).alias("one_row"), F.struct(F.col("text").cast("string"), hashed).alias("one_rank"))
    joined = whole.join(of, (F.col("one_key") == F.col(key)) & (F.col("one_fp") == F.col(row)))
    one = joined.groupBy("one_key", "root").agg(F.min_by("one_row", "one_rank").alias("one_row"))
    return out.unionByName(one.select(*(F.col("one_row")[c].alias(c) for c in docs.columns)))


def op1_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all of `documents`."""
    return near_duplicates(table(spark, sf_dir, "documents"))
