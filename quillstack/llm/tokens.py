"""Token ids by the tokenizers library, with the ids of chunks of text kept in a hash table of arrays.

A byte-level BPE without a normalizer splits a text before it merges. A single space or line feed between two characters that are
not white space is always a border of that split, and so is the place between a Latin letter and a following ASCII mark. So the ids
of a text are the ids of its chunks, one after another. Each distinct chunk is encoded once. Chunks of up to 16 bytes are found all at
once, in a table whose keys are those bytes themselves, as two 64-bit numbers; longer ones are found in a dictionary of their bytes. No
chunk is known by a hash alone. Texts with other white space or a zero byte, and other kinds of tokenizer, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

_RUNS = ("  ", "\n\n", "\n ", " \n", "<|")
_ASCII_BLANKS = "\0\t\v\f\r\x1c\x1d\x1e\x1f"
_OTHER_BLANKS = "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_LETTER, _MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[[ord(c) for c in '.,!?;:|*$%&#"()[]{}/+=@_~^<>-']] = True
_AFTER_C3 = np.zeros(256, dtype=bool)  # second bytes of the letters À to ÿ
_AFTER_C3[0x80:0xC0] = True
_AFTER_C3[[0x97, 0xB7]] = False
_A, _B, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Chunks longer than SHORT bytes are keys of a dictionary, those longer than LONGEST are encoded anew each time.
SHORT, LONGEST = 16, 4096


def plain(x: str) -> bool:
    """Whether x has no zero byte, and its only white space is single spaces and line feeds between other characters. Substring tests beat a regex here."""
    return not (
        not x
        or x[0] in " \n"
        or x[-1] in " \n"
        or any(r in x for r in _RUNS)
        or any(c in x for c in _ASCII_BLANKS)
        or (not x.isascii() and any(c in x for c in _OTHER_BLANKS))
    )


def eight_bytes(data: np.ndarray, pad: int) -> np.ndarray:
    """A view whose entry i is the 8 bytes of `data` from i on, little end first; zeros follow the data for `pad` more entries."""
    padded = np.zeros(len(data) + pad + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded.data, strides=(1,))


def sixteen_bytes(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 8 bytes and the next 8 of runs of bytes, as numbers; what is beyond a run counts as zero."""
    return words[starts] & _MASK[np.minimum(sizes, 8)], words[starts + 8] & _MASK[np.clip(sizes - 8, 0, 8)]


def mixed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    h = (low ^ (low >> np.uint64(29))) * _A
    h = (h ^ (h >> np.uint64(32)) ^ high) * _B
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes: of up to SHORT bytes by arithmetic on all of them, of longer ones by XXH64."""
    import xxhash

    sizes = ends - starts
    h = mixed(*sixteen_bytes(eight_bytes(data, SHORT), starts, sizes)) + sizes.astype(np.uint64)
    long = np.flatnonzero(sizes > SHORT)
    if len(long):
        raw = data.tobytes()
        h[long] = np.array([xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())], dtype=np.uint64)
    return h


class ChunkEncoder:
    """encode(texts) gives one unsigned 32-bit array for each text. The table is emptied when `keep` chunks are in it."""

    def __init__(self, path: str, keep: int = 2_500_000, bits: int = 21):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep, self.bits = min(keep, (1 << bits) * 3 // 5), bits
        spec = json.loads(self.tokenizer.to_str())
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if feed else -1
        self.chunked = bool(
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex")
            and not pre.get("add_prefix_space")
            and model.get("type") == "BPE"
            and not model.get("dropout")
            and len(feed) == 1
            and all(re.fullmatch(r"<\|.*\|>", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec.get("added_tokens", []))
        )
        self._clear()

    def _clear(self) -> None:
        n = 1 << self.bits
        self.low, self.high = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)  # a chunk has no zero byte, so 0 is a free place
        self.place, self.count = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.pool, self.used, self.kept, self.long_bytes = np.zeros(1 << 16, dtype=np.uint32), 0, 0, 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _encode_all(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, and how many each has."""
        ids, counts = [], []
        for i in range(0, len(chunks), 4096):
            part = chunks[i : i + 4096]
            got = self._ids("\n".join(part))
            feeds = np.flatnonzero(got == self.feed)
            if len(feeds) == len(part) - 1:
                ids.append(np.delete(got, feeds))
                counts.append(np.diff(np.concatenate(([-1], feeds, [len(got)]))) - 1)
            else:  # the chunk that is a line feed itself
                each = [self._ids(c) for c in part]
                ids += each
                counts.append(np.array([len(x) for x in each]))
        return np.concatenate(ids), np.concatenate(counts)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The slot of each chunk, or -1."""
        out, todo, slot = np.full(len(low), -1, dtype=np.int64), np.arange(len(low)), (mixed(low, high) >> np.uint64(64 - self.bits)).astype(np.int64)
        mask = len(self.low) - 1
        while len(todo):
            at = slot[todo]
            key = self.low[at]
            hit = (key == low[todo]) & (self.high[at] == high[todo])
            out[todo[hit]] = at[hit]
            todo = todo[~hit & (key != 0)]
            slot[todo] = (slot[todo] + 1) & mask
        return out

    def _pooled(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places in the pool, and numbers of ids, of newly encoded chunks."""
        ids, counts = self._encode_all(chunks)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        places = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        return places, counts

    def _add(self, low: np.ndarray, high: np.ndarray, chunks: list[str]) -> None:
        places, counts = self._pooled(chunks)
        self.kept += len(low)
        todo, slot, mask = np.arange(len(low)), (mixed(low, high) >> np.uint64(64 - self.bits)).astype(np.int64), len(self.low) - 1
        while len(todo):
            free = todo[self.low[slot[todo]] == 0]
            at, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.low[at], self.high[at], self.place[at], self.count[at] = low[put], high[put], places[put], counts[put]
            left = np.ones(len(low), dtype=bool)
            left[put] = False
            todo = todo[left[todo]]
            slot[todo] = (slot[todo] + 1) & mask

    def _long(self, chunks: list[bytes]) -> list[tuple[int, int]]:
        """(place, count) of chunks longer than SHORT."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.long]
        found = self.long
        if new:
            places, counts = self._pooled([c.decode("utf-8") for c in new])
            made = dict(zip(new, zip(places.tolist(), counts.tolist())))
            kept = {c: v for c, v in made.items() if len(c) <= LONGEST}
            self.long.update(kept)
            self.long_bytes += sum(map(len, kept))
            found = self.long if len(kept) == len(made) else self.long | made
        return [found[c] for c in chunks]

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        raw = "\n".join(texts).encode("utf-8")
        data = np.frombuffer(raw, dtype=np.uint8)
        border = np.zeros(len(data) + 1, dtype=bool)
        feed = data == 10
        border[0] = border[-1] = True
        border[:-1] |= feed | (data == 32)
        border[1:] |= feed
        letter = _LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & _AFTER_C3[data[1:]]
        border[1:-1] |= letter[:-1] & _MARK[data[1:]]
        edges = np.flatnonzero(border)
        starts, sizes = edges[:-1], np.diff(edges)
        if self.used > 1 << 23 or self.long_bytes > 16 << 20:
            self._clear()
        low, high = sixteen_bytes(eight_bytes(data, SHORT), starts, sizes)
        longer = np.flatnonzero(sizes > SHORT)
        slot = self._find(low, high)
        slot[longer] = 0
        new = np.flatnonzero(slot < 0)
        if len(new):
            order = np.lexsort((high[new], low[new]))
            a, b = low[new][order], high[new][order]
            one = new[order[np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))]]
            if self.kept + len(one) > self.keep:
                self._clear()
                new = np.flatnonzero(sizes <= SHORT)
                _, first = np.unique(np.stack([low[new], high[new]]), axis=1, return_index=True)
                one = new[first]
                if len(one) > len(self.low) * 4 // 5:  # more chunks at once than the table can hold
                    return [self._ids(x) for x in texts]
            self._add(low[one], high[one], [raw[a:b].decode("utf-8") for a, b in zip(starts[one].tolist(), edges[one + 1].tolist())])
            slot[new] = self._find(low[new], high[new])
        count, place = self.count[slot], self.place[slot].astype(np.int64)
        if len(longer):
            found = self._long([raw[a:b] for a, b in zip(starts[longer].tolist(), edges[longer + 1].tolist())])
            place[longer], count[longer] = np.array(found, dtype=np.int64).T
        text_sizes = np.array([len(x.encode("utf-8")) if not x.isascii() else len(x) for x in texts])
        text_at = np.cumsum(text_sizes + 1) - text_sizes - 1
        first = np.searchsorted(starts, text_at)
        count[first[1:] - 1] = 0  # the line feeds between the texts
        upto = np.cumsum(count, dtype=np.int64)
        ids = self.pool[np.repeat(place - (upto - count), count) + np.arange(upto[-1])]
        cut = np.append(upto[first] - count[first], upto[-1])
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def encode(self, texts: list[str], most: int = 1 << 19) -> list[np.ndarray]:
        """About `most` characters at a time; a plain text that is longer goes in parts, each from a space on."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        group, parts, size = [], [], 0

        def flush():
            for i, ids in zip(group, self._encode_plain(parts) if parts else []):
                out[i].append(ids)
            group.clear()
            parts.clear()

        for k, x in enumerate(texts):
            if not self.chunked or not plain(x):
                out[k].append(self._ids(x))
                continue
            at = 0
            while at < len(x):
                end = x.find(" ", at + most) if len(x) - at > most else -1
                part = x[at : end if end >= 0 else len(x)]
                group.append(k)
                parts.append(part)
                size += len(part)
                at += len(part)
                if size > most:
                    flush()
                    size = 0
        flush()
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
