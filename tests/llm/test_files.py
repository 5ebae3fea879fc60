"""Tokens, token files, media, repeats, packing, totals and the pipeline: exact round trips and brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from quillstack.llm import common, media, packing, queries, repeats, rollup, suffixes, token_files, tokens
from tokenizers import Tokenizer

from ..conftest import DATA, same_as_sql

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, mask int, value string"


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(BPE)


def ids_of(bpe, text, end):
    return np.array([*bpe.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def documents(spark, folder=DATA):
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()


def test_chunked_ids_equal_whole_ids(bpe):
    texts = ["", " ", "a  b", "it's 5km, no?", "x\n\ny", "Été à Paris.\nOui!", "日本語 テスト", "<|endoftext|> a", "a b", "don't\tgo", "é a.b,c", "x" * 5000, "Ü.Ö", "é!", "a_b-c", "\n", "a\n b", "😀 ok"]
    encoder = tokens.ChunkEncoder(BPE, keep=40, bits=8)
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts)):
            assert ids.tolist() == bpe.encode(text, add_special_tokens=False).ids, text


def test_chunks_with_equal_hashes_keep_their_own_ids(bpe):
    """Thue-Morse strings: polynomial hashes of them collide, whatever the base."""
    encoder = tokens.ChunkEncoder(BPE)
    for n in (1024, 2048, 4096):
        x = "a"
        while len(x) < n:
            x += x.translate(str.maketrans("ab", "ba"))
        y = x.translate(str.maketrans("ab", "ba"))
        for group in ([x, y], [y], [x], [f"w {x} {y} z"]):
            for text, ids in zip(group, encoder.encode(group)):
                assert ids.tolist() == bpe.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("most", [5, 40, 1 << 19])
def test_long_texts_are_encoded_in_parts(bpe, most):
    rng = np.random.default_rng(most)
    encoder = tokens.ChunkEncoder(BPE)
    texts = [" ".join(rng.choice(["a", "été", "it's", "x,y", "Straße", "日本", "12", "a\nb", "internationalisations"], 50)) for _ in range(20)]
    for text, ids in zip(texts, encoder.encode(texts, most)):
        assert ids.tolist() == bpe.encode(text, add_special_tokens=False).ids


def test_token_files_equal_brute_force(spark, bpe):
    at, want = 0, {}
    for r in documents(spark):
        ids = ids_of(bpe, r["text"], 0)
        want[r["doc_id"]] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.op2_token_planes(spark, DATA).collect()}
    assert got == want


@pytest.mark.parametrize("bits", [False, True])
def test_token_files_odd_rows(spark, tmp_path, bpe, bits):
    rows = [(3, None, 1, "a"), (None, "null id", 2, "b"), (1, "word " * 40_000, 3, "c"), (1, "again", 4, "d")]
    manifest = token_files.write_token_files(spark.createDataFrame(rows, DOCS), BPE, f"file://{tmp_path}/{bits}", block=1000, bits=bits)
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 1, 3]
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(ids_of(bpe, t, 0).tobytes()) for t in ("null id", "again", "word " * 40_000, "")]
    path = max(manifest.collect(), key=lambda r: r["n_tokens"])["path"]
    shard = token_files.ShardReader(path)
    every = np.concatenate([ids for *_, ids in shard.documents()])
    for start, n in ((0, 1), (999, 2), (1500, 3000), (0, len(every))):
        assert np.array_equal(shard.ids(start, n), every[start : start + n])
    shard.close()
    empty = token_files.write_token_files(spark.createDataFrame([], DOCS), BPE, f"file://{tmp_path}/none{bits}")
    assert token_files.read_token_files(empty).count() == 0


def test_planes_round_trip():
    ids = np.random.default_rng(0).integers(0, 2**32, 777, dtype=np.uint32)
    for bits in (False, True):
        assert np.array_equal(token_files.from_planes(token_files.to_planes(ids, bits), len(ids)), ids)


def test_media_equal_brute_force(spark):
    got = {r["doc_id"]: r for r in media.op3_media_shards(spark, DATA).collect()}
    rows = documents(spark)
    assert len(got) == len(rows)
    for r in rows:
        raw = (r["text"] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        g, png = got[r["doc_id"]], media.to_png(payload)
        assert media.from_png(png) == payload
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (g["media_bytes"], g["media_sha256"], g["feature"]) == (len(png), hashlib.sha256(png).hexdigest(), media.feature_of(payload))


def test_media_shards_are_tar_files_and_heads_suffice(spark, tmp_path):
    import tarfile

    rows = [(1, b"a" * 600), (2, None), (None, b""), (1, b"a" * 600)]
    stored = media.store_media(spark.createDataFrame(rows, "doc_id long, data binary").coalesce(1), f"file://{tmp_path}")
    heads = {str(r["doc_id"]): (r["width"], r["height"], r["bits"]) for r in media.with_metadata(stored).collect()}
    assert heads == {"1": (576, 2, 8), "2": (576, 1, 8), "None": (576, 1, 8)}
    members = [m for p in tmp_path.glob("*.tar") for m in tarfile.open(p).getmembers()]
    assert len(members) == 2
    empty = media.store_media(spark.createDataFrame([], "doc_id long, data binary"), f"file://{tmp_path}/none")
    assert media.read_media(empty).count() == 0 and media.with_metadata(empty).count() == 0


def brute_removed(rows, length):
    """Mask of removed bytes of each (key, bytes); key None is the smallest."""
    rank = lambda k: -(2**63) if k is None else k
    first = {}
    for k, t in rows:
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            first[s] = min(first.get(s, 2**63), rank(k))
    out = []
    for k, t in rows:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < rank(k):
                gone[i : i + length] = True
        out.append(gone)
    return out


def test_repeats_equal_their_sql(spark):
    same_as_sql(repeats.op4_suffix_repeats(spark, DATA), repeats.OP4_SQL)


@pytest.mark.parametrize("unit_bytes", [300, 8 << 20])
def test_repeats_equal_brute_force(spark, unit_bytes):
    rng = np.random.default_rng(unit_bytes)
    pool = ["".join(rng.choice(list("abé"), 70)) for _ in range(5)] + ["ab" * 200, "a" * 500]
    rows = [(int(k), "".join(pool[i] for i in rng.integers(0, len(pool), 3)) + "".join(rng.choice(list("abc"), 30)), 0, "") for k in rng.permutation(25)]
    rows += [(None, pool[0], 0, ""), (None, pool[0], 0, ""), (30, None, 0, ""), (31, "", 0, ""), (32, "short", 0, ""), (3, rows[0][1], 0, "")]
    gone = brute_removed([(k, (t or "").encode()) for k, t, *_ in rows], 50)
    want = sorted((str(k), len(g), int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer((t or "").encode(), dtype=np.uint8)[~g].tobytes()).hexdigest()) for (k, t, *_), g in zip(rows, gone))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = repeats.repeat_report(docs, unit_bytes=unit_bytes).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    kept = repeats.without_repeats(docs, unit_bytes=unit_bytes)
    assert kept.columns == docs.columns
    texts = [np.frombuffer((t or "").encode(), dtype=np.uint8)[~g].tobytes().decode("utf-8", "ignore") if g.any() else t for (_, t, *_), g in zip(rows, gone)]
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted((str(k), str(t)) for (k, *_), t, g in zip(rows, texts, gone) if t or not g.any())
    assert repeats.repeat_report(spark.createDataFrame([], DOCS)).count() == 0
    assert repeats.without_repeats(spark.createDataFrame([], DOCS)).columns == docs.columns


@pytest.mark.parametrize("memory", [1 << 27, 64])
def test_suffix_order_equals_sorting(memory):
    rng = np.random.default_rng(memory)
    for n in (1, 2, 3, 50, 400):
        for letters in (1, 2, 5):
            text = np.append(rng.integers(1, 1 + letters, n - 1), 0).astype(np.uint8)
            order, shared = suffixes.suffix_order(text, 20, memory)
            raw = text.tobytes()
            heads = [raw[i : i + 20] for i in order.tolist()]
            assert sorted(order.tolist()) == list(range(n)) and heads == sorted(heads)
            for a, b, s in zip(heads, heads[1:], shared[1:].tolist()):
                assert s == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_packing_is_whole_and_tight(spark, bpe):
    got = packing.op9_pack_islands(spark, DATA).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for r in documents(spark):
        ids, at = ids_of(bpe, r["text"], 2), 0
        pieces = sorted(by_doc.pop(r["doc_id"]), key=lambda p: p["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces))) and (len(ids) > 1024 or len(pieces) == 1)
        for p in pieces:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            assert p["piece"] == 0 or p["length"] == 1024
            at += p["length"]
        assert at == len(ids)
    assert not by_doc
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
    bound = packing.lower_bound([r["length"] for r in got], 1024)
    assert len(bins) <= bound * 1.01 + 1, (len(bins), bound)


def test_packing_many_islands_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    sizes = [int(x) for x in rng.integers(1, 101, 900)]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, length long")
    rows = packing.pack(pieces, 100, island=100).collect()
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert len(rows) == 900 and max(fill.values()) <= 100 and len(fill) <= packing.lower_bound(sizes, 100) * 1.02 + 1
    odd = spark.createDataFrame([(None, None, 0, ""), (1, "", 0, ""), (1, "", 0, ""), (2, "word " * 3000, 0, "")], DOCS)
    got = packing.pack_documents(odd, BPE).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in got)[:2] == [("1", 1), ("1", 1)] and len(got) >= 5
    assert packing.pack_documents(spark.createDataFrame([], DOCS), BPE).count() == 0


def test_crossover_keeps_every_piece_once():
    import random

    size = [int(x) for x in np.random.default_rng(6).integers(1, 60, 200)]
    a, b = packing.best_fit(size, 100, list(range(200))), packing.best_fit([60 - s for s in size], 100, list(range(200)))
    b = [[i] for i in range(200)] if any(sum(size[i] for i in x) > 100 for x in b) else b
    child = packing.crossover(size, 100, a, b, random.Random(1))
    assert sorted(i for x in child for i in x) == list(range(200)) and all(sum(size[i] for i in x) <= 100 for x in child)


def test_totals_equal_their_sql(spark):
    same_as_sql(rollup.op6_token_rollup(spark, DATA), rollup.OP6_SQL)


def test_totals_by_batches(spark, tmp_path):
    made = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    rows = lambda *x: spark.createDataFrame(list(x), "source string, lang string, tokenizer string, tokens long")
    state = lambda: sorted(tuple(map(str, r)) for r in made.totals().collect())
    assert state() == []
    assert made.commit("1", rollup.inserted(rows(("a", None, "t", 5), ("a", None, "t", 5), ("b", "en", "t", None))))
    assert not made.commit("1", rollup.inserted(rows(("z", "z", "z", 9))))
    assert state() == [("a", "None", "t", "2", "10"), ("b", "en", "t", "1", "0")]
    made.compact()
    assert made.commit("2", rollup.revised(rows(("a", None, "t", 5)), rows(("a", None, "t", 7)))) and not made.commit("1", rollup.inserted(rows(("z", "z", "z", 9))))
    assert made.commit("3", rollup.deleted(rows(("b", "en", "t", None)))) and made.commit("4", rollup.inserted(rows()))
    assert state() == [("a", "None", "t", "2", "12")]


def test_pipeline_equals_its_stages_by_brute_force(spark, bpe, monkeypatch):
    import corpus_pipeline as p
    from quillstack.llm import decontaminate, quality, simhash

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    rows = [(d, t) for d, t in rows if model.score(np.array([quality.features(t)]))[0] >= 0.7]
    fps, kept = {d: simhash.fingerprint(t) for d, t in rows}, []
    value = np.array([fps[d] for d, _ in rows], dtype=np.uint64)
    label = np.arange(len(rows))
    while True:  # the least label in reach, again and again
        new = np.array([label[np.bitwise_count(value ^ v) <= 3].min() for v in value])
        if np.array_equal(new, label):
            break
        label = new
    rows = [r for i, r in enumerate(rows) if label[i] == i]
    gone = brute_removed([(d, t.encode()) for d, t in rows], 50)
    for (d, t), g in zip(rows, gone):
        left = np.frombuffer(t.encode(), dtype=np.uint8)[~g].tobytes().decode("utf-8", "ignore") if g.any() else t
        if left or not g.any():
            kept.append((d, left))
    items = decontaminate.items_of([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id", "text").collect()])
    kept = [(d, t) for d, t in kept if not decontaminate.find_in([t], items)]
    want = {}
    for d, t in kept:
        ids = ids_of(bpe, t, 2)
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want |= {(d, k): (a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))}
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in p.run(spark, folder).collect()}
    assert got == want and 100 < len(kept) < 1000
    assert [n for n, _ in p.STAGES] == ["quality classifier", "simhash near-dedup", "suffix-array dedup", "benchmark decontamination", "best-fit packing"]


def test_a_batch_committed_during_compaction_counts_once(spark, tmp_path, monkeypatch):
    made = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    rows = lambda *x: spark.createDataFrame(list(x), "source string, lang string, tokenizer string, tokens long")
    made.commit("1", rollup.inserted(rows(("a", "en", "t", 5))))
    totals = rollup.TokenRollup.totals

    def late(self, records=None):
        monkeypatch.setattr(rollup.TokenRollup, "totals", totals)
        self.commit("2", rollup.inserted(rows(("a", "en", "t", 7))))
        return totals(self, records)

    monkeypatch.setattr(rollup.TokenRollup, "totals", late)
    made.compact()
    assert [tuple(r) for r in made.totals().collect()] == [("a", "en", "t", 2, 12)]


def test_pieces_may_have_columns_of_any_names(spark):
    pieces = spark.createDataFrame([(1, 60, 9, "x"), (2, 40, 9, "y"), (3, 100, 9, "z")], "row long, length long, sequence_id int, offset string")
    got = packing.pack(pieces, 100).collect()
    assert sorted((r["row"], r["length"]) for r in got) == [(1, 60), (2, 40), (3, 100)] and len({r["sequence_id"] for r in got}) == 2


@pytest.fixture
def odd_tables(spark, tmp_path):
    """A folder of tables with nulls, empty and long texts, repeated rows and extra columns; and one of empty tables."""
    docs = "doc_id long, text string, lang string, source string, n_chars long, key string, unit string, shard int, score_ int"
    text = "The cat sat on the mat and looked at the dog for a while, then it went away to sleep. " * 4
    rows = [(1, text, "en", "a", 5, "k", "u", 1, 1), (1, text, "en", "a", 5, "k", "u", 1, 1), (2, text + "More words.", None, None, None, None, None, None, None)]
    rows += [(3, None, "de", "b", 0, "", "", 0, 0), (4, "", "de", "b", 0, "", "", 0, 0), (None, "no id " * 30, "fr", "c", 1, "", "", 0, 0), (5, "word " * 50_000, "es", "d", 1, "", "", 0, 0), (None, None, None, None, None, None, None, None, None)]
    for name, some in (("odd", rows), ("none", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(some, docs).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (3, 0, None), (None, 1, 1), (5, 0, 1), (5, None, None)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, "cat sat on the mat and looked at"), (None, "x"), (2, None)] if some else [], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return f"file://{tmp_path}"


@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries_take_odd_rows_and_empty_tables(spark, odd_tables, name):
    n = queries.QUERIES[name](spark, f"{odd_tables}/odd").count()
    if name in ("op1_simhash_pigeonhole", "op2_token_planes", "op3_media_shards", "op4_suffix_repeats", "op8_quality_gam"):
        assert n == 8
    assert n > 0 or name == "op5_license_bands"
    assert queries.QUERIES[name](spark, f"{odd_tables}/none").count() == 0


def test_pipeline_takes_odd_rows_and_empty_tables(spark, odd_tables):
    import corpus_pipeline as p

    assert p.run(spark, f"{odd_tables}/none").count() == 0
    p.run(spark, f"{odd_tables}/odd").collect()
    docs = spark.read.parquet(f"{odd_tables}/odd/documents.parquet")
    for _, stage in p.STAGES[1:4]:
        assert stage(spark, docs, f"{odd_tables}/odd").columns == docs.columns


def test_a_cluster_without_a_shared_folder_is_refused():
    assert common.local_folder("local[4]").startswith("file:///")
    with pytest.raises(RuntimeError):
        common.local_folder("spark://host:7077")
