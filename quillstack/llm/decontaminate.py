"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items are cut into words (runs of letters and digits; marks separate, points and commas within numbers don't),
lower-cased. Two readings are compared. The plain one has the words as they are. The template one has typed placeholders for numbers,
units and names (capitalised words that aren't common function words), so that "Ann has 5 kg" and "Bob has 7 kg" agree. Windows of five
words, or the whole item if it is shorter, are joined by hash. An item is found in a text if at least `similarity` of its distinct
windows are: in the plain reading, or in the template reading if the slots are consistent: with the item laid beside the text along the
matched windows, at least `similarity` of its slots must map to the text's commonest value for their own value. All windows count in both
readings. Windows with less than three literal words only don't pick candidates, but for items in which such windows are `similarity` of
all. An item without slots, or with less than three literal words in all, has no template reading. Where a text has windows of an item
several times, each place is tried: the matched windows around each diagonal that hold `similarity` of the item's are judged by themselves.

The items go to the tasks of the text scan while their windows number at most `most_windows`; a benchmark beyond that is joined by a
shuffle on the window hash instead. There, items with equal texts are judged once. A text with enough of an item's windows has one of its
rarest ones at least (all but as many as must be found, less one), so only these look for candidates, and windows that many items share
meet none of them; the candidates' windows are then counted. Both ways give the same rows.

Nulls and odd rows: a null or empty text has no words and contains nothing; items without words, or without item_id, are never found.
Rows with a null doc_id take part. Repeated documents give repeated rows; of items with one item_id each is judged by itself, and the
result has one row for each document, item_id and reading. Empty tables give empty results. Only the columns named are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_parts, table
from .tokens import word_hashes

WINDOW, SIMILARITY, LITERALS, MOST_WINDOWS = 5, 0.8, 3, 1_000_000
FOUND = "doc_id long, item_id long, reading string, containment double, slots int, consistent double"
UNITS = """mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres mg g kg lb lbs oz ton tons gram grams
kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours
day days week weeks month months year years mph kmh percent dollar dollars cent cents euro euros usd eur gbp degree degrees celsius fahrenheit
watt watts volt volts amp amps joule joules newton newtons pascal hz khz mhz ghz kb mb gb tb""".split()  # fmt: skip
COMMON = """the a an and or but if in on at of to for from by with as is are was were be been it its this that these those he she they we you i his
her their our your my not no there here who what when where which why how all some any each every one two le la les un une des du de et ou que qui
dans en au aux il elle ils nous vous ce cette el los las una y o es con por para der die das ein eine und oder ist im am zu mit von""".split()  # fmt: skip
_NUMBER, _UNIT, _NAME = np.uint64(0x1B873593CC9E2D51), np.uint64(0x85EBCA6BC2B2AE35), np.uint64(0x27D4EB2F165667C5)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Words:
    """The words of some texts: text number, plain hash and template hash of each, and whether it is a slot."""

    text: np.ndarray
    plain: np.ndarray
    template: np.ndarray
    slot: np.ndarray


def _hashes_of(words: list[str]) -> np.ndarray:
    raw = " ".join(words).encode()
    ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    return np.unique(word_hashes(np.frombuffer(raw, dtype=np.uint8), ends - [len(w.encode()) for w in words], ends))


def _member(h: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.searchsorted(among, h)
    at[at == len(among)] = 0
    return among[at] == h


def words_of(texts: list[str], block: int = 1 << 20) -> Words:
    """Words of all texts, as arrays; about `block` bytes at a time, cut at blanks, where no word and no number goes on."""
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    whole, at, parts = b"\n".join(raw) + b"\n", 0, []
    del raw
    while at < len(whole):
        end = len(whole) if len(whole) - at <= block else min(x for x in (whole.find(b" ", at + block), whole.find(b"\n", at + block)) if x >= 0) + 1
        starts, *columns = _words_in(np.frombuffer(whole, dtype=np.uint8, count=end - at, offset=at))
        parts.append((np.searchsorted(text_ends, starts + at, side="right"), *columns))
        at = end
    return Words(*(np.concatenate(c) for c in zip(*parts))) if len(parts) != 1 else Words(*parts[0])


def _words_in(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, plain hash, template hash, slot?) of each word of a run of bytes that ends with a blank."""
    inside = _WORD[data]
    digit = (data >= 48) & (data <= 57)
    point = np.zeros(len(data), dtype=bool)
    point[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
    inside = inside | point
    low = _LOWER[data]
    accent = np.zeros(len(data), dtype=bool)  # second byte of a capital letter from À to Þ
    accent[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low = low + (accent * np.uint8(32))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    plain = word_hashes(low, starts, ends)
    capital = (data >= 65) & (data <= 90) | accent
    number = digit[starts]
    capitals = np.concatenate(([0], np.cumsum(capital, dtype=np.int32)))
    first = capital[starts] | accent[np.minimum(starts + 1, len(data) - 1)] & (data[starts] == 0xC3)
    one_capital = (capitals[ends] - capitals[starts] == 1) & (ends - starts > 1)
    unit, common = _member(plain, _UNIT_HASHES), _member(plain, _COMMON_HASHES)
    name = first & one_capital & ~common & ~number & ~unit
    return starts, plain, np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, plain))), number | unit | name


_UNIT_HASHES, _COMMON_HASHES = _hashes_of(UNITS), _hashes_of(COMMON)


def windows_of(words: Words, size: int, template: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number at the start, hash, whether it has too few literal words to pick candidates) of each window within one text."""
    n = len(words.text) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    values = words.template if template else words.plain
    h = np.full(n, size * 2 + template, dtype=np.uint64)
    for k in range(size):
        h = (h ^ values[k : k + n]) * _STEP
        h ^= h >> np.uint64(31)
    ok = words.text[:n] == words.text[size - 1 :]
    at = np.flatnonzero(ok)
    slots = np.concatenate(([0], np.cumsum(words.slot)))
    return at, h[at], (slots[at + size] - slots[at] > size - LITERALS) & template


@dataclass
class Items:
    """The benchmark: windows of all items in both readings, sorted by hash."""

    ids: list[int]
    words: Words
    sizes: list[int]
    hash: np.ndarray
    variant: np.ndarray  # 2 * item number + reading
    at: np.ndarray
    need: np.ndarray  # distinct windows of each variant
    dense: np.ndarray  # how many of them have few literal words and aren't in `hash`
    whole: tuple[np.ndarray, np.ndarray, np.ndarray]  # variant, hash and place of all template windows, in this order
    sieve: np.ndarray

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (in h, in self.hash) of all equal hashes."""
        some = np.flatnonzero(self.sieve[h >> np.uint64(64 - int(len(self.sieve)).bit_length() + 1)])
        lo, hi = np.searchsorted(self.hash, h[some], side="left"), np.searchsorted(self.hash, h[some], side="right")
        n = hi - lo
        mine = np.repeat(some, n)
        return mine, np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def items_of(rows: list[tuple[int, str]], similarity: float = SIMILARITY) -> Items:
    """The windows of benchmark rows (item_id, text)."""
    words = words_of([t or "" for _, t in rows])
    length = np.bincount(words.text, minlength=len(rows))
    slots = np.bincount(words.text, weights=words.slot, minlength=len(rows))
    read = (slots > 0) & (length - slots >= LITERALS)
    sizes = sorted({min(WINDOW, int(x)) for x in length if x})
    parts = []
    for size in sizes:
        mine = length >= WINDOW if size == WINDOW else length == size
        for template in (False, True):
            at, h, dense = windows_of(words, size, template)
            keep = mine[words.text[at]] & (read[words.text[at]] | (not template))
            parts.append((h[keep], 2 * words.text[at][keep] + template, at[keep], dense[keep]))
    h, variant, at, dense = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for i in range(4))
    h, dense = h.astype(np.uint64), dense.astype(bool)
    _, first = np.unique(np.stack([variant.astype(np.uint64), h], axis=1), axis=0, return_index=True) if len(h) else (None, np.zeros(0, dtype=np.int64))
    need = np.bincount(variant[first], minlength=2 * len(rows))
    few = np.bincount(variant[first][dense[first]], minlength=2 * len(rows))
    few[few >= similarity * need] = 0  # their dense windows pick candidates, too
    order = np.lexsort((at, h, variant))
    order = order[variant[order] % 2 == 1]
    whole = (variant[order], h[order], at[order])
    keep = ~dense | (few[variant] == 0)
    h, variant, at = h[keep], variant[keep], at[keep]
    order = np.argsort(h, kind="stable")
    h, variant, at = h[order], variant[order], at[order]
    bits = min(26, max(16, int(len(h)).bit_length() + 7))
    sieve = np.zeros(1 << bits, dtype=bool)
    sieve[h >> np.uint64(64 - bits)] = True
    return Items([i for i, _ in rows], words, sizes, h, variant, at, need, few, whole, sieve)


def consistency(pairs: np.ndarray) -> tuple[int, float]:
    """pairs: (slot value of the item, slot value of the text). How many slots, and the share that maps to its item value's commonest partner."""
    if not len(pairs):
        return 0, 1.0
    both, n = np.unique(pairs, axis=0, return_counts=True)
    best: dict[int, int] = {}
    for (a, _), k in zip(both.tolist(), n.tolist()):
        best[a] = max(best.get(a, 0), k)
    return len(pairs), sum(best.values()) / len(pairs)


def _agreement(at_text: np.ndarray, at_item: np.ndarray, words: Words, t: int, items: Items, item: int) -> tuple[int, float]:
    """consistency() of an item laid beside text t along windows at ascending places of the item: each of its words is laid beside
    the text's word that the nearest window points to."""
    shift = at_text - at_item
    lo, hi = np.searchsorted(items.words.text, [item, item + 1])
    of_item = lo + np.flatnonzero(items.words.slot[lo:hi])
    right = np.minimum(np.searchsorted(at_item, of_item), len(at_item) - 1)
    left = np.maximum(right - 1, 0)
    near = np.where(np.abs(at_item[left] - of_item) < np.abs(at_item[right] - of_item), left, right)
    of_text = np.clip(of_item + shift[near], 0, len(words.text) - 1)
    same = (words.text[of_text] == t) & (words.template[of_text] == items.words.template[of_item])
    return consistency(np.stack([items.words.plain[of_item], words.plain[of_text]], axis=1)[same])


def judged(at: np.ndarray, h: np.ndarray, words: Words, t: int, items: Items, v: int, similarity: float) -> tuple[float, int, float] | None:
    """(containment, slots, consistent) of template variant v in text t, whose template windows are at, h; None if it isn't in it."""
    lo, hi = np.searchsorted(items.whole[0], [v, v + 1])
    mine, place = items.whole[1][lo:hi], items.whole[2][lo:hi]
    a, b = np.searchsorted(mine, h, side="left"), np.searchsorted(mine, h, side="right")
    n = b - a
    at_text, number = np.repeat(at, n), np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
    kind, at_item = mine[number], place[number]
    share = len(np.unique(kind)) / items.need[v]
    if share < similarity:
        return None
    place, first = np.unique(at_item, return_index=True)
    slots, agree = _agreement(at_text[first], place, words, t, items, v // 2)
    if agree >= similarity:
        return share, slots, agree
    # every diagonal with enough windows around it, by itself
    length = int(np.diff(np.searchsorted(items.words.text, [v // 2, v // 2 + 1]))[0])
    order = np.argsort(at_text - at_item, kind="stable")
    at_text, at_item, kind = at_text[order], at_item[order], kind[order]
    diagonal, best = at_text - at_item, None
    for d in np.unique(diagonal).tolist():
        x, y = np.searchsorted(diagonal, [d - max(WINDOW, length // 2), d + max(WINDOW, length // 2) + 1])
        if y - x < similarity * items.need[v] or len(np.unique(kind[x:y])) < similarity * items.need[v]:
            continue
        near = x + np.lexsort((np.abs(diagonal[x:y] - d), at_item[x:y]))
        near = near[np.concatenate(([True], at_item[near][1:] != at_item[near][:-1]))]
        slots, agree = _agreement(at_text[near], at_item[near], words, t, items, v // 2)
        if agree >= similarity and (best is None or (agree, slots) > (best[2], best[1])):
            best = (share, slots, agree)
    return best


def find_in(texts: list[str], items: Items, similarity: float = SIMILARITY) -> list[tuple]:
    """(text number, item_id, reading, containment, slots, consistent) of all items found in the texts."""
    words = words_of(texts)
    text, variant, hashes, windows = [], [], [], {}
    for size in items.sizes:
        for template in (False, True):
            at, h, _ = windows_of(words, size, template)
            if template:
                windows[size] = (at, h, words.text[at])
            # a window that a text repeats counts once
            some = np.flatnonzero(items.sieve[h >> np.uint64(64 - int(len(items.sieve)).bit_length() + 1)])
            some = some[np.lexsort((h[some], words.text[at[some]]))]
            t, k = words.text[at[some]], h[some]
            new = np.ones(len(some), dtype=bool)
            new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
            t, k = t[new], k[new]
            mine, other = items.hits(k)
            text.append(t[mine])
            variant.append(items.variant[other])
            hashes.append(k[mine])
    if not text:
        return []
    text, variant, hashes = (np.concatenate(x) for x in (text, variant, hashes))
    if not len(text):
        return []
    distinct = np.unique(np.stack([text.astype(np.uint64), variant.astype(np.uint64), hashes], axis=1), axis=0)
    group, n = np.unique(distinct[:, :2], axis=0, return_counts=True)
    group = group.astype(np.int64)
    need, dense = items.need[group[:, 1]], items.dense[group[:, 1]]
    share = n / need
    picked = np.where(dense > 0, (n + dense) / need, share) >= similarity
    out: dict[tuple, tuple] = {}
    for (t, v), s in zip(group[picked].tolist(), share[picked].tolist()):
        row = (s, 0, 1.0)
        if v % 2:
            length = int(np.diff(np.searchsorted(items.words.text, [v // 2, v // 2 + 1]))[0])
            at, h, of = windows[min(WINDOW, length)]
            lo, hi = np.searchsorted(of, [t, t + 1])
            row = judged(at[lo:hi], h[lo:hi], words, t, items, v, similarity)
            if row is None:
                continue
        key = (t, items.ids[v // 2], v % 2)
        out[key] = max(out.get(key, row), row)
    return [(t, i, "template" if r else "plain", *row) for (t, i, r), row in sorted(out.items())]


def _benchmark(benchmark: DataFrame, most_windows: int, similarity: float) -> Items | None:
    """The items for the tasks; None if their words are too many for that."""
    rows = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > 8 * most_windows:  # a word and its separator take two bytes at least; four on average or more
        return None
    return items_of([(r["item_id"], r["text"]) for r in rows.orderBy("item_id", "text").collect()], similarity)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, most_windows: int = MOST_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FOUND: one row for each document and benchmark item found in it, and reading."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    items = _benchmark(benchmark, most_windows, similarity)
    if items is None:
        return _by_shuffle(texts, benchmark, similarity)

    def find(batches):
        import pyarrow as pa

        for batch in in_parts(batches, 256, 1):
            docs_of = batch.column(0).to_pylist()
            rows = [(docs_of[t], *rest) for t, *rest in find_in([x or "" for x in batch.column(1).to_pylist()], items, similarity)]
            yield _found(pa, rows)

    return texts.mapInArrow(find, FOUND)


def _found(pa, rows: list[tuple]):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.float64())
    columns = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in FOUND.split(", ")])


def _window_rows(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """key (a row's number), size, hash, words of the text, whether the window is dense, of all windows; texts are numbered by the caller."""

    def emit(batches):
        import pyarrow as pa

        for batch in in_parts(batches, 256, 1):
            keys = np.asarray(batch.column(0))
            words = words_of([x or "" for x in batch.column(1).to_pylist()])
            length = np.bincount(words.text, minlength=len(keys)).astype(np.int32)
            for size in sizes:
                for template in (False, True):
                    at, h, dense = windows_of(words, size, template)
                    if len(h):
                        t = words.text[at]
                        pairs, one = np.unique(np.stack([t.astype(np.uint64), h], axis=1), axis=0, return_index=True)
                        t = pairs[:, 0].astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(keys[t]), pa.array(np.full(len(t), 2 * size + template, dtype=np.int32)), pa.array(pairs[:, 1].view(np.int64)), pa.array(length[t]), pa.array(dense[one])], names=["key", "kind", "hash", "words", "dense"])

    return rows.mapInArrow(emit, "key long, kind int, hash long, words int, dense boolean")


def _rarest(items: DataFrame, need: DataFrame) -> DataFrame:
    """The windows (key, kind, hash) that look for candidates: of an item's n windows, of which `least` must be found, the n - least + 1
    that the fewest items have. A text that has none of these has less than `least`."""
    common = items.groupBy("kind", "hash").agg(F.count("*").alias("owners"))
    ranked = items.join(common, ["kind", "hash"]).withColumn("rank", F.row_number().over(Window.partitionBy("key", "kind").orderBy("owners", "hash")))
    return ranked.join(need, ["key", "kind"]).where(F.col("rank") <= F.col("windows") - F.col("least") + 1).select("key", "kind", "hash")


def _by_shuffle(texts: DataFrame, benchmark: DataFrame, similarity: float) -> DataFrame:
    """contaminated() for a benchmark of any size: candidates by a shuffled join on the window hash, each verified from its two texts."""
    from .common import written

    sizes = list(range(1, WINDOW + 1))
    texts = written(texts.withColumn("key", F.monotonically_increasing_id()), "texts")
    rows = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    bodies = written(rows.select("body").distinct().withColumn("key", F.monotonically_increasing_id()), "items")
    owners = rows.distinct().join(bodies, "body").select("item_id", F.col("key").alias("item_key"))
    items = _window_rows(bodies.select("key", "body"), sizes).where(F.floor(F.col("kind") / 2) == F.least(F.col("words"), F.lit(WINDOW)))
    need = items.groupBy("key", "kind").agg(F.count("*").alias("need"), F.count_if("dense").alias("few"))
    need = need.withColumn("few", F.when(F.col("few") < similarity * F.col("need"), F.col("few")).otherwise(0))
    need = need.select("key", "kind", "few", (F.col("need") - F.col("few")).alias("windows"), F.ceil(similarity * F.col("need") - F.col("few") - 1e-9).alias("least"))
    items = written(items.join(need, ["key", "kind"]).where(~F.col("dense") | (F.col("few") == 0)).select("key", "kind", "hash"), "windows")
    mine = _window_rows(texts.select("key", "body"), sizes).select(F.col("key").alias("text_key"), "kind", "hash")
    asked = _rarest(items, need.select("key", "kind", "windows", "least")).withColumnRenamed("key", "item_key")
    tried = written(mine.join(asked, ["kind", "hash"]).select("text_key", "item_key", "kind").distinct(), "tried")
    some = texts.join(tried.select(F.col("text_key").alias("key")).distinct(), "key", "left_semi")
    of_tried = _window_rows(some.select("key", "body"), sizes).select(F.col("key").alias("text_key"), "kind", "hash")
    wanted = tried.join(items.withColumnRenamed("key", "item_key"), ["item_key", "kind"])
    met = wanted.join(of_tried, ["text_key", "kind", "hash"], "left_semi").groupBy("text_key", "item_key", "kind").agg(F.count("*").alias("met"))
    pairs = met.join(need.select(F.col("key").alias("item_key"), "kind", "least"), ["item_key", "kind"]).where(F.col("met") >= F.col("least")).select("text_key", "item_key").distinct()
    both = pairs.join(texts.withColumnRenamed("key", "text_key"), "text_key").join(bodies.select(F.col("key").alias("item_key"), F.col("body").alias("item")), "item_key")

    found_as = FOUND.replace("item_id", "item_key")

    def verify(batches):
        import pyarrow as pa

        for batch in in_parts(batches, 256):
            out = []
            for r in batch.to_pylist():
                out += [(r["text_key"], r["doc_id"], *rest[1:]) for rest in find_in([r["body"] or ""], items_of([(r["item_key"], r["item"])], similarity), similarity)]
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["text_key", *(c.split()[0] for c in found_as.split(", "))])

    found = both.select("text_key", "doc_id", "body", "item_key", "item").mapInArrow(verify, "text_key long, " + found_as).join(owners, "item_key")
    best = found.groupBy("text_key", "doc_id", "item_id", "reading").agg(F.max(F.struct("containment", "slots", "consistent")).alias("best"))
    return best.select("doc_id", "item_id", "reading", "best.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """The rows of docs in which no benchmark item is found."""
    items = _benchmark(benchmark, most_windows, similarity)
    if items is None:
        from .common import fresh, key_of

        gone = contaminated(docs, benchmark, similarity, most_windows).select(key_of("doc_id").alias(key := fresh(docs, "key"))).distinct()
        return docs.join(gone, key_of("doc_id") == F.col(key), "left_anti")
    at = docs.columns.index("text")

    def clean(batches):
        import pyarrow as pa

        for batch in in_parts(batches, 256, at):
            bad = {t for t, *_ in find_in([x or "" for x in batch.column(at).to_pylist()], items, similarity)}
            yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op10_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of `benchmark` in all of `documents`."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
