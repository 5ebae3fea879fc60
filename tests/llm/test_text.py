"""SimHash, quality, decontamination, licenses and passages against brute force on small tables."""

import itertools
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from quillstack.llm import chains, components, decontaminate, licenses, quality, repeats, simhash

from ..conftest import DATA, same_as_sql

DOCS = "doc_id long, text string, mask int, value string"


def brute_fingerprint(text):
    import re

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_groups(fps: dict) -> dict:
    root = {k: k for k in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in fps}


def test_simhash_equals_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    fps = {r["doc_id"]: brute_fingerprint(r["text"] or "") for r in rows}
    want = {k: (f"{fps[k]:016x}", g) for k, g in brute_groups(fps).items()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op1_simhash_pigeonhole(spark, DATA).collect()}
    assert got == want


def united(links, members):
    root = {v: v for v in members}
    for a, b in links:
        x, y = root[a], root[b]
        root = {v: min(x, y) if r in (x, y) else r for v, r in root.items()}
    return root


def test_run_links_find_every_component():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64))
    fps = np.unique(np.concatenate([base, near]))
    links = simhash.run_links(fps, np.zeros(len(fps), dtype=np.int64), 3)
    assert united(links, range(len(fps))) == brute_groups(dict(enumerate(int(x) for x in fps)))


@pytest.mark.parametrize("long_run, most_hot", [(64, 100_000), (64, 0), (40_000, 100_000)])
def test_hot_runs_are_split_and_lose_no_link(spark, monkeypatch, long_run, most_hot):
    monkeypatch.setattr(simhash, "MOST_HOT", most_hot)
    rng = np.random.default_rng(4)
    flips = [sum(1 << int(b) for b in rng.choice(24, rng.integers(1, 9), replace=False)) for _ in range(300)]
    fps = sorted({0x1234_5678_9ABC_DEF0 ^ f for f in flips} | {int(x) for x in rng.integers(0, 2**63, 30)})
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = [(r["a"], r["b"]) for r in simhash.fingerprint_links(table, long_run=long_run).distinct().collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    want = brute_groups(dict(zip(fps, fps)))
    assert len(set(want.values())) > 31
    assert united(links, fps) == want


def test_narrower_masks_meet_every_close_pair():
    rng = np.random.default_rng(6)
    for _ in range(500):
        mask = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 60), replace=False))
        free = [b for b in range(64) if not mask >> b & 1]
        change = sum(1 << int(b) for b in rng.choice(free, min(3, len(free)), replace=False))
        more = simhash.narrower(mask, 3)
        assert any(change & m == 0 for m in more) and all(m & mask == mask for m in more)
        assert all(m != mask for m in more) or len(free) < 4


def test_plan_covers_every_pair_of_three_bits():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (500, 64))
    parts = simhash.plan(500, (bits.T @ bits).astype(float))
    masks = simhash.masks(parts)
    for gone in [rng.choice(64, 3, replace=False) for _ in range(3000)]:
        change = sum(1 << int(b) for b in gone)
        assert any(change & m == 0 for m in masks)


def test_simhash_odd_rows(spark):
    rows = [(1, None, 1, "a"), (2, "", 2, "b"), (None, "  \t", 3, "c"), (4, "one", 4, "d"), (4, "one", 4, "d"), (5, "ONE", 5, "e")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r[0]), r[1] == "0" * 16, str(r[2])) for r in got) == [("1", True, "None"), ("2", True, "None"), ("4", False, "4"), ("4", False, "4"), ("5", False, "4"), ("None", True, "None")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "mask", "value"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "None"]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["v"]: r["root"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = quality.op8_quality_gam(spark, folder).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.8, (auc, len(good), len(bad))


def test_quality_without_labels_and_with_nulls(spark):
    docs = spark.createDataFrame([(1, None, 0, ""), (None, "x" * 100_000, 0, "")], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none)
    assert {round(r["score"], 6) for r in quality.scored(docs, model).collect()} == {0.5}
    assert quality.keep_good(docs, none).count() == 0
    odd = spark.createDataFrame([(None, 1), (1, None), (1, 1)], "doc_id long, quality int")
    assert quality.scored(docs, quality.fit(docs, odd)).count() == 2
    with pytest.raises(ValueError):
        quality.scored(docs.withColumn("score", docs["mask"]), model)


ITEMS = [(1, "Ann Miller buys 12 apples for 30 dollars and gives Ann Miller's brother 12 pears after lunch today"), (2, "What is the boiling point of pure water at sea level"), (3, ""), (None, "x y z")]


def found(df):
    return sorted((str(r["doc_id"]), r["item_id"], r["reading"]) for r in df.collect())


@pytest.mark.parametrize("most_windows", [1_000_000, 0])
def test_decontamination_readings(spark, most_windows):
    filler = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore "
    docs = [
        (1, filler + ITEMS[1][1] + " " + filler, 0, ""),
        (2, filler + "Bob Carter buys 7 apples for 90 euros and gives Bob Carter's brother 7 pears after lunch today. " + filler, 0, ""),
        (3, filler * 50, 0, ""), (4, None, 0, ""), (5, "", 0, ""), (None, ITEMS[1][1], 0, ""),
        (6, "Bob Carter buys 7 apples for 90 euros and gives Tom Hanks's brother 55 pears after lunch today", 0, ""),
    ]
    docs, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = found(decontaminate.contaminated(docs, items, most_windows=most_windows))
    assert ("1", 2, "plain") in got and ("None", 2, "plain") in got and ("2", 1, "template") in got
    assert {d for d, *_ in got} == {"1", "2", "None"}
    kept = decontaminate.decontaminated(docs, items, most_windows=most_windows)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6] and kept.columns == docs.columns
    assert decontaminate.contaminated(docs, spark.createDataFrame([], "item_id long, text string"), most_windows=most_windows).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame([], DOCS), items, most_windows=most_windows).count() == 0


def test_plain_reading_equals_brute_force(spark):
    import re

    folder = "/root/testdata/sf0.01"

    cut = lambda t: re.findall(r"(?:[^\W_]|[\x80-\U0010ffff]|(?<=\d)[.,](?=\d))+", t.lower())
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    docs = {r["doc_id"]: cut(r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if (r["text"] or "").isascii()}
    want = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = cut(r["text"])
        if w and r["text"].isascii():
            n = min(5, len(w))
            want |= {(d, r["item_id"]) for d, x in docs.items() if len(grams(w, n) & grams(x, n)) >= 0.8 * len(grams(w, n))}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op10_template_windows(spark, folder).where("reading = 'plain'").collect()}
    assert {p for p in got if p[0] in docs} == want and want


def test_licenses_equal_their_sql(spark):
    same_as_sql(licenses.op5_license_bands(spark, DATA), licenses.OP5_SQL)


@pytest.mark.parametrize("most_shingles", [20_000, 0])
def test_licenses_odd_rows(spark, most_shingles):
    t = spark.createDataFrame([("mit", "Released under the MIT License"), ("tiny", "two words"), (None, "a b c d e"), ("none", None), ("blank", "  ")], "license_id string, text string")
    rows = [(1, "x " * 30_000 + "released UNDER the  mit, license", 0, ""), (2, None, 0, ""), (None, "Released under the MIT License", 0, ""), (1, "released under the mit license", 0, ""), (3, "two words", 0, "")]
    got = licenses.license_scan(spark.createDataFrame(rows, DOCS), t, most_shingles=most_shingles).collect()
    assert sorted((str(r["doc_id"]), r["license_id"], r["containment"]) for r in got) == [("1", "mit", 1.0), ("3", "tiny", 1.0), ("None", "mit", 1.0)]
    assert licenses.license_scan(spark.createDataFrame([], DOCS), t, most_shingles=most_shingles).count() == 0
    assert licenses.license_scan(spark.createDataFrame(rows, DOCS), t.limit(0), most_shingles=most_shingles).count() == 0


@pytest.mark.parametrize("most_windows", [1_000_000, 0])
def test_template_reading_counts_all_windows(spark, most_windows):
    items = [(1, "What is the capital of France?"), (2, "Ann paid 5 dollars, Bob paid 7 dollars, Carl paid 9 dollars. How many dollars?"), (3, "Ann 5, Bob 7")]
    docs = [(1, "Rome is the capital of Italy and large", 0, ""), (2, "so what is the capital of Italy then", 0, ""), (4, "Tom 1, Eve 2", 0, "")]
    docs += [(3, "x Tom paid 1 dollars, Eve paid 2 dollars, Max paid 3 dollars. How many dollars? y", 0, ""), (5, "Tom paid 1 dollars, Eve paid 2 dollars.", 0, "")]
    args = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert found(decontaminate.contaminated(*args, most_windows=most_windows)) == [("2", 1, "template"), ("3", 2, "template")]


@pytest.mark.parametrize("most_windows", [1_000_000, 0])
def test_template_copies_after_others_are_found(spark, most_windows):
    good = "Bob Carter buys 7 apples for 90 euros and gives Bob Carter's brother 7 pears after lunch today. "
    bad = "Bob Carter buys 7 apples for 90 euros and gives Tom Hanks's brother 55 pears after lunch today. "
    docs = [(1, bad + "and then some more words here " * 9 + good, 0, ""), (2, bad + bad, 0, ""), (3, good + bad, 0, "")]
    args = spark.createDataFrame(docs, DOCS), spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    assert found(decontaminate.contaminated(*args, most_windows=most_windows)) == [("1", 1, "template"), ("3", 1, "template")]


def word_list(rng, n):
    return ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n)]


def test_passages_are_found_and_clean_texts_are_not(spark):
    rng = np.random.default_rng(3)
    passage = word_list(rng, 80)
    fuzzy = list(passage)
    for i in (13, 40, 66):
        fuzzy[i] = "changed"
    del fuzzy[30]
    docs = [(1, " ".join(word_list(rng, 60) + passage + word_list(rng, 60)), 0, ""), (2, " ".join(word_list(rng, 90) + fuzzy + word_list(rng, 10)), 0, "")]
    docs += [(3, " ".join(word_list(rng, 300)), 0, ""), (4, None, 0, ""), (None, " ".join(passage), 0, ""), (5, " ".join(passage[:40]), 0, "")]
    docs += [(k, " ".join(word_list(rng, 20) + passage), 0, "") for k in range(10, 40)]
    got = chains.repeated_passages(spark.createDataFrame(docs, DOCS).repartition(3), unit_bytes=4_000).collect()
    assert {r["doc_id"] for r in got} == {1, 2, *range(10, 40)}
    assert all(r["n_words"] >= 50 and r["identity"] >= 0.8 for r in got)
    row = next(r for r in got if r["doc_id"] == 2)
    assert abs(row["start"] - 90) <= 2 and abs(row["n_words"] - 79) <= 3
    assert chains.repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("changed", [5, 7, 9, 10])
def test_passages_of_fifty_words_are_found_at_any_identity_allowed(spark, changed):
    rng = np.random.default_rng(changed)
    docs, n = [], 40
    for k in range(n):
        passage = word_list(rng, 50)
        fuzzy = list(passage)
        for i in (1 + rng.permutation(48)[:changed]).tolist():
            fuzzy[i] = f"other{k}x{i}"
        docs += [(k, " ".join(word_list(rng, 60) + passage + word_list(rng, 60)), 0, ""), (1000 + k, " ".join(word_list(rng, 30) + fuzzy + word_list(rng, 30)), 0, "")]
    got = chains.repeated_passages(spark.createDataFrame(docs, DOCS).repartition(3), unit_bytes=20_000).collect()
    assert {(r["doc_id"], r["partner_id"]) for r in got} == {(1000 + k, k) for k in range(n)}
    assert all(r["n_words"] >= 50 and r["identity"] >= 0.8 for r in got)


def test_passages_of_frequent_phrases_are_found(spark):
    """Each phrase of a passage is also alone in documents before the first one with the passage and between the two."""
    rng = np.random.default_rng(8)
    phrases = [word_list(rng, 5) for _ in range(240)]
    docs, want = [], set()
    for k in range(20):
        mine = phrases[12 * k : 12 * k + 12]
        a, b = (sum(mine, []), sum(mine, []))
        for i in range(2, 60, 10):
            b[i] = f"other{k}x{i}"
        docs += [(1000 * k + 500, " ".join(word_list(rng, 50) + a + word_list(rng, 50)), 0, ""), (1000 * k + 900, " ".join(word_list(rng, 20) + b + word_list(rng, 50)), 0, "")]
        want.add((1000 * k + 900, 1000 * k + 500))
        for j in range(12):  # with the words around it, so that no string over the edge of a phrase is rare either
            piece = b[5 * j : 5 * j + 9] if j % 2 else b[max(0, 5 * j - 4) : 5 * j + 5]
            docs += [(1000 * k + at + j, " ".join(word_list(rng, 40) + piece + word_list(rng, 40)), 0, "") for at in (100, 600)]
    for unit_bytes in (4_000, 1 << 20):
        got = chains.repeated_passages(spark.createDataFrame(docs, DOCS).repartition(3), unit_bytes=unit_bytes).collect()
        assert {(r["doc_id"], r["partner_id"]) for r in got} >= want


@pytest.mark.parametrize("few", [3, 32])
@pytest.mark.parametrize("unit_bytes", [4_000, 1 << 20])
def test_no_two_texts_with_a_passage_lose_their_link(spark, few, unit_bytes):
    """Passages with words changed at other places in each document, of lines that other documents hold alone: all pairs are found, and
    documents with one string of 50 words hang together through it."""
    rng, docs, want, alike = np.random.default_rng(12), [], set(), []
    lines = [word_list(rng, 10) for _ in range(24)]
    for f in range(4):
        passage = sum(lines[6 * f : 6 * f + 6], [])
        family = (100 * f + rng.permutation(100)[:11]).tolist()
        for k in family:
            fuzzy = list(passage)
            for i in rng.choice(8, 2, replace=False).tolist():
                fuzzy[7 * i + int(rng.integers(2, 6))] = f"other{k}x{i}"
            for i in (24, 36):  # no two have 50 equal words in a row
                fuzzy[i] = f"more{k}x{i}"
            docs.append((k, " ".join(word_list(rng, 30) + fuzzy + word_list(rng, 30)), 0, ""))
        want |= {(max(p), min(p)) for p in itertools.combinations(family, 2)}
        same = word_list(rng, 63)
        alike.append(set(range(1000 + 20 * f, 1012 + 20 * f)))
        docs += [(k, " ".join(word_list(rng, 40) + same + word_list(rng, 40)), 0, "") for k in alike[-1]]
    docs += [(2000 + k, " ".join(word_list(rng, 25) + lines[k % 24] + word_list(rng, 25)), 0, "") for k in range(240)]
    got = {(r["doc_id"], r["partner_id"]) for r in chains.repeated_passages(spark.createDataFrame(docs, DOCS).repartition(3), unit_bytes=unit_bytes, few=few).collect()}
    assert {p for p in got if p[0] < 1000} == want
    root = united([p for p in got if p[0] >= 1000], {d for d, *_ in docs})
    for family in alike:
        assert {root[d] for d in family} == {min(family)}
    assert all(root[d] == d for d, *_ in docs if d >= 2000)


@pytest.mark.parametrize("unit_bytes", [2_000, 1 << 20])
def test_links_are_counted_as_the_passages_give_them(spark, unit_bytes):
    rng, docs = np.random.default_rng(14), [(None, None, 0, "")]
    for f in range(3):
        passage = word_list(rng, 60)
        for k in range(9):
            fuzzy = [f"other{k}x{i}" if i % 12 == k % 9 else w for i, w in enumerate(passage)]
            docs.append((100 * f + k, " ".join(word_list(rng, 20) + fuzzy + word_list(rng, 20 + f)), 0, ""))
    table = spark.createDataFrame(docs, DOCS).repartition(3)
    rows = chains.repeated_passages(table, unit_bytes=unit_bytes, few=4).collect()
    got = {r["doc_id"]: r for r in chains.linked_documents(table, unit_bytes=unit_bytes, few=4).collect()}
    root = united([(r["doc_id"], r["partner_id"]) for r in rows], {d for d, *_ in docs if d is not None})
    assert {k: (r["n_links"], r["class_id"]) for k, r in got.items()} == {k: (k % 100, root[k]) for k in root if k % 100}
    assert all(r["n_words"] == max(p["n_words"] for p in rows if p["doc_id"] == k) for k, r in got.items())


def test_pairs_of_frequent_seeds_equal_brute_force():
    """Contexts of one seed: every pair with enough three-word strings in common comes, or has a string in common from another seed."""
    rng = np.random.default_rng(13)
    for most in (2, 9):
        base = rng.integers(1, 256, (3, 96))
        words = base[rng.integers(0, 3, 90)].astype(np.uint8)
        for r in words:
            r[rng.permutation(96)[: rng.integers(0, 40)]] = rng.integers(1, 256)
        words[:, 46:50] = (5, 6, 7, 8)
        words[:20, :30] = 0
        key, none = np.sort(rng.integers(0, 80, 90)), np.zeros(90, dtype=np.uint64)
        grams = [{} for _ in words]
        for g, w in zip(grams, words.tolist()):
            for x in zip(w, w[1:], w[2:]):
                g[x] = g.get(x, 0) + (0 not in x)
        want = {(i, j) for i in range(90) for j in range(i) if key[i] != key[j] and sum(min(n, grams[j].get(x, 0)) for x, n in grams[i].items()) >= 18}
        got = [(i, j) for is_string, a, b in chains.frequent_pairs(words, key, none, np.full((90, len(chains.SALTS)), 2**64 - 1, dtype=np.uint64), 50, 0.8, most) if not is_string for i, j in zip(a.tolist(), b.tolist())]
        assert want and len(got) == len(want) and set(got) == want


def test_gaps_are_aligned_by_bits():
    """The matches of a row-by-row longest common subsequence, in a fraction of its time."""
    rng = np.random.default_rng(15)

    def by_rows(a, b):
        row = np.zeros(len(b) + 1, dtype=np.int64)
        for word in a:
            row[1:] = np.maximum(row[1:], row[:-1] + (b == word))
            row = np.maximum.accumulate(row)
        return int(row[-1])

    for n, m in ((0, 5), (1, 1), (3, 70), (65, 64), (300, 40)):
        a, b = rng.integers(0, 9, n).astype(np.uint64), rng.integers(0, 9, m).astype(np.uint64)
        assert chains.gap_matches(a, b) == by_rows(a, b)
    a, b = (rng.integers(0, 2000, 6000).astype(np.uint64) for _ in range(2))
    took = []
    for f in (by_rows, chains.gap_matches):
        began = time.process_time()
        got = f(a, b)
        took.append((time.process_time() - began, got))
    assert took[0][1] == took[1][1] and took[1][0] < took[0][0] / 3, took


def test_chains_equal_brute_force():
    """The best local chain over all orders of a few blocks."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        blocks = sorted({(int(x), int(y), int(n)) for x, y, n in zip(rng.integers(0, 200, 6), rng.integers(0, 200, 6), rng.integers(6, 12, 6))})
        score = {}
        for j in blocks:
            before = [score[i] - chains.GAP * ((j[0] - i[0] - i[2]) + (j[1] - i[1] - i[2])) for i in score if i[0] + i[2] <= j[0] + chains.SEED and i[1] + i[2] <= j[1] + chains.SEED and i[0] < j[0] and i[1] < j[1]]
            score[j] = j[2] + max([0, *before])
        made = chains.chains_of(blocks)
        assert sorted(b for c in made for b in c) == blocks
        total = lambda c: sum(n for *_, n in c) - sum(chains.GAP * ((v[0] - u[0] - u[2]) + (v[1] - u[1] - u[2])) for u, v in zip(c, c[1:]))
        assert max(map(total, made)) == pytest.approx(max(score.values()))


@pytest.mark.parametrize("parts", [1, 2])
def test_copies_in_units_of_their_own(spark, parts):
    text = " ".join(word_list(np.random.default_rng(1), 70))
    docs = spark.createDataFrame([(1, text, 0, ""), (2, text, 0, "")], DOCS).repartition(parts, "doc_id")
    got = [(r["doc_id"], r["partner_id"], r["n_words"]) for r in chains.repeated_passages(docs).collect()]
    assert got == [(2, 1, 70)]


@pytest.mark.parametrize("parts", [1, 80])
def test_passages_that_grow_far_from_their_core(spark, parts):
    """A core of 26 equal words, and every fourth word changed on either side of it: 58 words, 50 of them equal."""
    rng, docs = np.random.default_rng(9), []
    for k in range(40):
        passage = word_list(rng, 58)
        fuzzy = [w if 16 <= i < 42 or i % 4 else f"other{k}x{i}" for i, w in enumerate(passage)]
        docs += [(k, " ".join(word_list(rng, 40) + passage + word_list(rng, 40)), 0, ""), (1000 + k, " ".join(word_list(rng, 30) + fuzzy + word_list(rng, 50)), 0, "")]
    rows = spark.createDataFrame(docs, DOCS).repartition(parts, "doc_id")
    assert {(r["doc_id"], r["partner_id"]) for r in chains.repeated_passages(rows).collect()} == {(1000 + k, k) for k in range(40)}


def test_recall_of_passages_against_all_pairs(spark):
    """Documents with 50 words in a row of which 40 are those of an earlier document, by all pairs and all their diagonals."""
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    words = [decontaminate.words_of([t]).plain for _, t in rows]
    grams = [{} for _ in rows]
    for g, w in zip(grams, words):
        for i in range(len(w) - 3):
            g.setdefault(tuple(w[i : i + 4].tolist()), []).append(i)
    want = set()
    for j in range(len(rows)):
        for i in range(j):
            if rows[j][0] in want or len(words[i]) < 50 or len(words[j]) < 50:
                continue
            for d in {y - x for g in grams[j].keys() & grams[i].keys() for x in grams[j][g][:50] for y in grams[i][g][:50]}:
                lo, hi = max(0, -d), min(len(words[j]), len(words[i]) - d)
                same = np.cumsum(np.concatenate(([0], words[j][lo:hi] == words[i][lo + d : hi + d])))
                if len(same) > 50 and (same[50:] - same[:-50]).max() >= 40:
                    want.add(rows[j][0])
                    break
    got = {r["doc_id"] for r in chains.repeated_passages(spark.read.parquet(f"{DATA}/documents.parquet"), unit_bytes=20_000).collect()}
    assert want and len(got & want) >= 0.9 * len(want), (len(got & want), len(want))


def brute_train(x, y, rounds, pair_rounds, pairs):
    """The additive model by plain loops over rows and borders."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for k in range(m)]
    b = [[sum(v >= e for e in edges[k]) for v in x[:, k]] for k in range(m)]
    mean = (y.sum() + 1) / (n + 2)
    start = np.log(mean / (1 - mean))
    tables, grids, chosen = [[0.0] * (len(e) + 1) for e in edges], [], []

    def slopes():
        out = []
        for r in range(n):
            t = start + sum(tables[k][b[k][r]] for k in range(m)) + sum(g[b[i][r]][b[j][r]] for (i, j), g in zip(chosen, grids))
            p = 1 / (1 + np.exp(-t))
            out.append((p - y[r], p * (1 - p)))
        return out

    part = lambda rows: (sum(g for g, _ in rows), sum(h for _, h in rows))
    worth = lambda rows: part(rows)[0] ** 2 / (part(rows)[1] + quality.RIDGE)
    leaf = lambda rows: -part(rows)[0] / (part(rows)[1] + quality.RIDGE)

    def best(rows_by_bin, a, c):
        flat = lambda u, v: [z for q in range(u, v) for z in rows_by_bin[q]]
        gains = [(worth(flat(a, t)) + worth(flat(t, c)) - worth(flat(a, c)), -t) for t in range(a + 1, c)]
        return max(gains, default=(0.0, -a))

    for _ in range(rounds):
        for k in range(m):
            s, size = slopes(), len(tables[k])
            bins = [[s[r] for r in range(n) if b[k][r] == q] for q in range(size)]
            gain, cut = best(bins, 0, size)
            if gain <= 1e-12:
                continue
            cuts = {0, -cut, size}
            (left, at_left), (right, at_right) = best(bins, 0, -cut), best(bins, -cut, size)
            cuts |= {-at_left} if left >= right and left > 1e-12 else {-at_right} if right > 1e-12 else set()
            cuts = sorted(cuts)
            for u, v in zip(cuts, cuts[1:]):
                value = leaf([z for q in range(u, v) for z in bins[q]])
                for q in range(u, v):
                    tables[k][q] += quality.RATE * value

    def quadrants(i, j):
        s = slopes()
        out = (0.0, None)
        for u in range(1, len(tables[i])):
            for v in range(1, len(tables[j])):
                cells = [[s[r] for r in range(n) if (b[i][r] < u) == p and (b[j][r] < v) == q] for p in (True, False) for q in (True, False)]
                gain = sum(map(worth, cells)) - worth(s)
                if out[1] is None or gain > out[0] + 1e-12:
                    out = (gain, (u, v, [leaf(c) for c in cells]))
        return out

    ranked = sorted(((quadrants(i, j)[0], (i, j)) for i in range(m) for j in range(i)), reverse=True)
    picked = [p for g, p in ranked[:pairs] if g > 0]
    for i, j in picked:
        chosen.append((i, j))
        grids.append([[0.0] * len(tables[j]) for _ in tables[i]])
    for _ in range(pair_rounds):
        for (i, j), g in zip(chosen, grids):
            u, v, leaves = quadrants(i, j)[1]
            for p in range(len(tables[i])):
                for q in range(len(tables[j])):
                    g[p][q] += quality.RATE * leaves[2 * (p >= u) + (q >= v)]
    return [1 / (1 + np.exp(-(start + sum(tables[k][b[k][r]] for k in range(m)) + sum(g[b[i][r]][b[j][r]] for (i, j), g in zip(chosen, grids))))) for r in range(n)]


def test_additive_model_equals_brute_force(monkeypatch):
    rng = np.random.default_rng(5)
    for name, value in (("ROUNDS", 3), ("PAIR_ROUNDS", 2), ("PAIRS", 2), ("BINS", 5)):
        monkeypatch.setattr(quality, name, value)
    x = rng.normal(size=(60, 3))
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=60) / 2) > 0).astype(float)
    model = quality.train(x, y)
    assert model.score(x) == pytest.approx(brute_train(x, y, 3, 2, 2), abs=1e-9)


def brute_templates(docs, items):
    """(document, item) in the template reading: an item laid at every place of a text, without gaps."""
    import re

    def cut(text):
        out = []
        for w in re.findall(r"[A-Za-z0-9]+(?:[.,](?=\d)[0-9]+)*", text):
            low = w.lower()
            kind = "<n>" if w[0].isdigit() else "<u>" if low in decontaminate.UNITS else "<x>" if w[0].isupper() and w[1:].islower() and low not in decontaminate.COMMON else None
            out.append((low, kind))
        return out

    found = set()
    for i, item in items:
        a = cut(item)
        grams = lambda w: {tuple(k or z for z, k in w[p : p + 5]) for p in range(len(w) - 4)}
        need = grams(a)
        for d, text in docs:
            b = cut(text)
            for at in range(-len(a) + 1, len(b)):
                lay = [(p, at + p) for p in range(len(a)) if 0 <= at + p < len(b)]
                here = {tuple(k or z for z, k in a[p : p + 5]) for p, q in lay if p + 5 <= len(a) and q + 5 <= len(b) and [k or z for z, k in a[p : p + 5]] == [k or z for z, k in b[q : q + 5]]}
                if len(here) < 0.8 * len(need):
                    continue
                seen = {}
                for p, q in lay:
                    if a[p][1] and a[p][1] == b[q][1]:
                        seen.setdefault(a[p][0], []).append(b[q][0])
                total = sum(map(len, seen.values()))
                if total and sum(max(map(v.count, v)) for v in seen.values()) >= 0.8 * total:
                    found.add((d, i))
    return found


def test_windows_that_many_items_share_look_for_nothing(spark):
    rng = np.random.default_rng(12)
    preamble = "read the passage below and answer the question that comes after it"
    own = [" ".join(word_list(rng, 12)) for _ in range(60)]
    items = spark.createDataFrame([(i, f"{preamble} {x}") for i, x in enumerate(own)] + [(100, f"{preamble} {own[0]}"), (101, preamble)], "item_id long, text string")
    texts = [(1, f"as they say {preamble} {own[3]} and so on"), (2, preamble), (3, f"{own[0]} {preamble}"), (4, " ".join(word_list(rng, 90))), (5, f"{preamble} {own[0]}")]
    docs = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")
    wide, narrow = (sorted(tuple(r) for r in decontaminate.contaminated(docs, items, most_windows=m).collect()) for m in (1_000_000, 0))
    assert narrow == wide
    assert {r[:2] for r in narrow} >= {(1, 3), (1, 101), (2, 101), (5, 0), (5, 100)} and not any(r[0] == 4 for r in narrow)
    windows = decontaminate._window_rows(items.select(F.col("item_id").alias("key"), "text"), [5]).where("kind = 10").select("key", "kind", "hash")
    need = windows.groupBy("key", "kind").agg(F.count("*").alias("windows"), F.ceil(0.8 * F.count("*") - 1e-9).alias("least"))
    most = decontaminate._rarest(windows, need).groupBy("hash").count().agg(F.max("count")).first()[0]
    assert most <= 2


def test_template_reading_equals_brute_force(spark):
    import random

    rng = random.Random(7)
    names, verbs, things = "Ann Bob Carl Dora Eve Frank Gina Hugo".split(), "buys sells counts paints".split(), "apples chairs lamps books".split()
    frame = "{0} {v} {1} {t} for {2} dollars and {3} {v} {4} {t} before {0} goes home with {1} {t} that weigh {5} kg in the {x} of May"
    items, docs = [], []
    for k in range(12):
        word = f"town{k}"
        fill = lambda vary: frame.format(rng.choice(names), rng.randint(2, 99), rng.randint(2, 99), rng.choice(names), rng.randint(2, 99), rng.randint(2, 99), v=verbs[k % 4], t=things[k // 4], x=vary)  # noqa: E731, B023
        items.append((k, fill(word)))
        noise = lambda: " ".join(word_list(np.random.default_rng(rng.randint(0, 9999)), 30))
        docs.append((10 * k, f"{noise()} {fill(word)} {noise()}"))
        docs.append((10 * k + 1, f"{noise()} {fill(word).replace(verbs[k % 4], 'eats')} {noise()}"))
        broken = fill(word).split()
        docs.append((10 * k + 2, f"{noise()} {' '.join(names[(p + len(w)) % 8] if w in names else str(rng.randint(100, 999)) if w.isdigit() else w for p, w in enumerate(broken))} {noise()}"))
        docs.append((10 * k + 3, f"{noise()} {' '.join(broken[:14])} {noise()}"))
    want = brute_templates(docs, items)
    rows = spark.createDataFrame([(d, t, 0, "") for d, t in docs], DOCS)
    got = decontaminate.contaminated(rows, spark.createDataFrame(items, "item_id long, text string")).where("reading = 'template'").collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) >= 12


def test_equal_items_are_judged_each(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 0, ""), (1, "a b c d e f g", 0, "")], DOCS)
    items = spark.createDataFrame([(1, "b c d e f"), (2, "b c d e f"), (2, "b c d e f")], "item_id long, text string")
    for most in (1_000_000, 0):
        got = found(decontaminate.contaminated(docs, items, most_windows=most))
        assert got == [("1", 1, "plain")] * 2 + [("1", 2, "plain")] * 2


def test_extra_columns_may_have_any_names(spark):
    rows = [(1, "some words here now", "a", "b", 1, "c"), (2, "some words here now", "a", "b", 2, "c"), (2, "another text of its own", "a", "b", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, `KEY_` string, row int, _kept_key string")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["row"] for r in kept.collect()) == [1, 3]
    items = spark.createDataFrame([(1, "another text of its own")], "item_id long, text string")
    for most in (1_000_000, 0):
        assert {r["doc_id"] for r in decontaminate.decontaminated(docs.where("row > 1"), items, most_windows=most).collect()} <= {2}
        assert decontaminate.decontaminated(docs, items, most_windows=most).columns == docs.columns


def test_of_repeated_doc_ids_a_defined_row_stays(spark):
    rows = [(1, "b b b", 5, "x"), (1, "a a a", 6, "x"), (1, None, 7, "x"), (2, "b b b", 8, "x"), (1, "B b  b", 9, "x"), (None, "c c c", 10, "x"), (None, "c c c", 11, "x"), (None, "d d d", 12, "x")]
    kept = []
    for parts in (1, 3):
        got = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS).repartition(parts)).collect()
        kept.append(sorted((str(r["doc_id"]), r["mask"]) for r in got))
    assert kept[0] == kept[1] and {m for _, m in kept[0]} - {10, 11} == {6, 7, 9, 12} and len(kept[0]) == 5


def test_a_very_long_text(spark):
    """20 MB in one row, through everything that reads words or bytes."""
    rng = np.random.default_rng(11)
    known = word_list(rng, 3000)
    long = " ".join(known[i] for i in rng.integers(0, 3000, 3_000_000).tolist())
    item = " ".join(long.split(" ", 2000)[1000:1040])
    docs = spark.createDataFrame([(1, item, 0, ""), (2, long, 0, ""), (3, "x" * 3_000_000, 0, ""), (4, " ".join(known[:60]), 0, "")], DOCS)
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, items).collect()} == {1, 2}
    assert len(long) > 20_000_000 and simhash.near_duplicates(docs).count() == 4
    assert {(r["doc_id"], r["partner_id"]) for r in chains.repeated_passages(docs, min_words=30).collect()} >= {(2, 1)}
    removed = {r["doc_id"]: r["n_removed"] for r in repeats.repeat_report(docs).collect()}
    assert removed[2] >= len(item) and removed[1] == removed[3] == 0
