"""Operator 13: phrase collocations by HAT-trie counting.

Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line breaks into pieces and these at blanks and tabs into words. For
each language, phrases of 2 to 4 words that occur ``MIN_COUNT`` times within pieces are scored by their weakest cut.

1. Words: each task counts its different words; Spark sums them to (lang, word, id, n). A word's id is a 64-bit hash of
   its bytes; that no two words of the corpus share one is checked, and another seed is taken if they do.
2. Phrases: each task counts n-grams of word ids in a HAT-trie (``HatTrie``): a trie over the first words whose leaves
   are hash containers; a container that grows over ``BURST`` entries bursts into one for each next word. Over
   ``TRIE_ENTRIES`` entries, whole subtrees, the largest first, are spilled as sorted runs. Runs are cut into blocks by
   prefix partition (hash of the first two words), and each partition merges its blocks in key order, holding no more
   than the blocks that overlap.
3. A phrase can only reach MIN_COUNT if its parts do: pairs are counted where both words do (pass 2), phrases of 3 and 4
   words where all their pairs do (pass 3). The tasks know this from a Bloom filter, whose false positives only cost
   work; its size is at most 2^``BLOOM_BITS`` bits, whatever the corpus.
4. Cuts, containment and ranks are joins and windows over the phrases found. Scores are decimals, so exact.

A text is read in chunks; the last three words of a chunk are carried over, so phrases across chunks count.

Defined results: null and empty texts hold no words; a null lang is ``und``; repeated rows count each; ties of score and
count go by phrase (UTF-8 byte order); an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportlake.llm.common import U64, lean, mix, stored

MIN_COUNT = 30
WORDS = 4
TOP = 2000
SCALE = 2_000_000
INSIDE_PCT = 80
BURST = 1 << 12
TRIE_ENTRIES = 1 << 19
RUN_BLOCK = 1 << 10
BLOOM_BITS = 27
CHUNK = 1 << 21
WORD_ENTRIES = 1 << 18
PART_WORDS = 1 << 17
MERGE_ENTRIES = 1 << 18
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STOP = np.array([chr(b) in ".,;:!?\n\v\f\r" for b in range(256)])
_GAP = _STOP | np.array([b in (32, 9) for b in range(256)])
_EDGE = re.compile(rb"[ \t.,;:!?\n\v\f\r]")
_SPAN = 64
_LONG = 1 << 10


class Words:
    """Cuts byte chunks of one language into word ids. A word over _LONG bytes has a keyed hash of its bytes as id; any
    other the sum of random values of its bytes by place."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.key = b"%d" % seed
        self.values = rng.integers(1, 1 << 63, (_SPAN + 1) * 256, dtype=np.uint64) * U64(2) + U64(1)
        self.values[_SPAN * 256 :] = 0  # of bytes between words

    def cut(self, low: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
        """(ids, whether a mark or line break stands before a word in this chunk, first bytes, ends, whether one stands
        behind the last word) of a lower-case chunk that begins and ends between words."""
        data = np.frombuffer(low, np.uint8)
        gap = _GAP[data]
        edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
        start, end = edge[0::2], edge[1::2]
        if not len(start):
            return np.zeros(0, U64), np.zeros(0, bool), start, end, bool(_STOP[data].any())
        size = end - start
        long = np.flatnonzero(size > _LONG).tolist()
        stops = np.cumsum(_STOP[data], dtype=np.int32)
        fresh = np.diff(stops[start], prepend=0) > 0
        behind = bool(stops[-1] > stops[end[-1] - 1])
        if long:  # only their first bytes go through the arrays
            keep = np.ones(len(data), bool)
            for i in long:
                keep[start[i] + _LONG : end[i]] = False
            data, gap = data[keep], gap[keep]
            at = np.flatnonzero(np.diff(gap, prepend=True, append=True))[0::2]
        else:
            at = start
        lead = int(at[0])
        data, gap, at = data[lead:], gap[lead:], (at - lead).astype(np.int32)
        begin = np.zeros(len(data), np.int32)
        begin[at] = 1
        place = np.arange(len(data), dtype=np.int32) - at[np.cumsum(begin, dtype=np.int32) - 1]
        code = self.values[(np.where(gap, _SPAN, place & (_SPAN - 1)) << 8) + data]
        if size.max() > _SPAN:
            code *= U64(1) + U64(2) * (place // _SPAN).astype(U64)
        ids = mix(np.add.reduceat(code, at))
        for i in long:
            ids[i] = int.from_bytes(hashlib.blake2b(low[start[i] : end[i]], digest_size=8, key=self.key).digest(), "little")
        return ids, fresh, start, end, behind


def _streams(batch: pa.RecordBatch, size_limit: int) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, lower-case chunks of its texts) of a batch of (lang, text): a text ends with a line break, a chunk between
    words."""
    langs, texts = batch.column(0).to_pylist(), batch.column(1)
    by: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        by.setdefault(lang, []).append(i)
    for lang, rows in by.items():
        chunks, held, size = [], [], 0
        for i in rows:
            raw = (texts[i].as_py() or "").encode().translate(_LOWER)
            at = 0
            while len(raw) - at > size_limit:  # cut behind a blank or mark
                edge = _EDGE.search(raw, at + size_limit)
                if not edge:
                    break
                held.append(raw[at : edge.end()])
                chunks.append(b"".join(held))
                held, size, at = [], 0, edge.end()
            held.append(raw[at:] + b"\n")
            size += len(held[-1])
            if size > size_limit:
                chunks.append(b"".join(held))
                held, size = [], 0
        if held:
            chunks.append(b"".join(held))
        yield lang, chunks


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, id, word, other, n) of the words of (lang, text): ``other`` differs from ``word`` where two words share an
    id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Words(seed)
        held: dict[str, dict[int, list]] = {}
        size = 0

        def rows(lang: str, words: list[tuple[int, bytes, int]]) -> pa.RecordBatch:
            cols = [pa.array([lang] * len(words), pa.string()), pa.array(np.array([i for i, _, _ in words], U64).view(np.int64)), pa.array([w for _, w, _ in words], pa.binary()).cast(pa.string()), pa.array([n for _, _, n in words], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["lang", "id", "word", "n"])

        for b in batches:
            for lang, chunks in _streams(b, CHUNK):
                for low in chunks:
                    words = held.setdefault(lang, {})
                    ids, _, start, end, _ = cutter.cut(low)
                    u, first, which, n = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
                    clash = [] if _equal(low, start, end, first[which]) else [(i, low[a:z], 0) for i, a, z in zip(ids.tolist(), start.tolist(), end.tolist(), strict=True)]
                    for i, a, z, k in zip(u.tolist(), start[first].tolist(), end[first].tolist(), n.tolist(), strict=True):
                        word, seen = low[a:z], words.get(i)
                        if seen is None:
                            words[i] = [word, k]
                            size += 1
                        else:
                            seen[1] += k
                            if seen[0] != word:
                                clash.append((i, word, 0))
                    if clash:
                        yield rows(lang, clash)
                    if size > WORD_ENTRIES:
                        yield from (rows(x, [(i, w, k) for i, (w, k) in y.items()]) for x, y in held.items())
                        held, size = {}, 0
        yield from (rows(x, [(i, w, k) for i, (w, k) in y.items()]) for x, y in held.items())

    counted = docs.mapInArrow(lean(run), "lang string, id long, word string, n long")
    return counted.groupBy("lang", "id").agg(F.min("word").alias("word"), F.max("word").alias("other"), F.sum("n").alias("n"))


def _equal(raw: bytes, start: np.ndarray, end: np.ndarray, twin: np.ndarray) -> bool:
    """Whether each word has the bytes of its twin."""
    size = end - start
    if (size != size[twin]).any():
        return False
    data, ends = np.frombuffer(raw, np.uint8), np.cumsum(size)
    at = np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
    return bool((data[at] == data[at + np.repeat(start[twin] - start, size)]).all())


def _lang_code(lang: str) -> np.uint64:
    return U64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


class Bloom:
    """A Bloom filter of 64-bit hashes, four probes."""

    def __init__(self, bits: int):
        self.bits = bits
        self.cells = np.zeros(1 << (bits - 3), np.uint8)

    def _probes(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(4):
            yield (mix(keys ^ U64(0xA24BAED4963EE407 * (k + 1) & (1 << 64) - 1)) >> U64(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        for p in self._probes(keys):
            np.bitwise_or.at(self.cells, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for p in self._probes(keys):
            found &= (self.cells[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
        return found


def _pair(lang: np.uint64, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a + lang) * U64(0x9E3779B97F4A7C15) + b)


def _hashed(langs: list[str], ids: np.ndarray) -> np.ndarray:
    """The filter's key of words (one column of ids) or pairs (two)."""
    code = np.array([_lang_code(x) for x in langs], U64)
    return mix(ids[:, 0] + code) if ids.shape[1] == 1 else _pair(code, ids[:, 0], ids[:, 1])


def _bloom(keys: DataFrame, n: int) -> Bloom:
    """The filter of n ``keys`` (lang, ids), 16 bits a key where the bound allows: each task makes one, in blocks, and
    blocks are or-ed."""
    bits = min(max(16, (16 * n).bit_length()), BLOOM_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = Bloom(bits), 0
        for b in batches:
            if b.num_rows:
                own.add(_hashed(b.column(0).to_pylist(), b.column(1).flatten().to_numpy().view(U64).reshape(b.num_rows, -1)))
                rows += b.num_rows
        if rows:
            blocks = np.split(own.cells, max(1, len(own.cells) >> 16))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())], names=["block", "cells"])

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "cells": [np.bitwise_or.reduce([np.frombuffer(c, np.uint8) for c in rows["cells"]]).tobytes()]})

    made = keys.select("lang", "ids").mapInArrow(lean(run), "block int, cells binary").groupBy("block").applyInPandas(merge, "block int, cells binary")
    out = Bloom(bits)
    for block, cells in made.collect():  # 2^BLOOM_BITS bits at most
        out.cells[block << 16 : (block << 16) + len(cells)] = np.frombuffer(cells, np.uint8)
    return out


class HatTrie:
    """Counts of word-id sequences. The root's children stand under a first word; a child is a hash container of the
    words that follow (an id, or a tuple of ids), or, once burst, a node with a child for each next word."""

    def __init__(self, words: int, burst: int):
        self.words, self.burst, self.entries = words, burst, 0
        self.root: dict[int, dict] = {}
        self.burst_nodes: set[int] = set()

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Counts different rows of word ids, those of equal first words together."""
        first = np.flatnonzero(np.concatenate([[True], ids[1:, 0] != ids[:-1, 0]]))
        rest = ids[:, 1].tolist() if self.words == 2 else list(map(tuple, ids[:, 1:].tolist()))
        n, starts = counts.tolist(), first.tolist()
        for word, a, z in zip(ids[first, 0].tolist(), starts, [*starts[1:], len(ids)], strict=True):
            self._count(self.root.setdefault(word, {}), rest[a:z], n[a:z], self.words - 1)

    def _count(self, node: dict, keys: list, counts: list[int], left: int) -> None:
        """Adds keys of ``left`` words under a node."""
        if id(node) in self.burst_nodes:
            for k, n in zip(keys, counts, strict=True):
                self._count(node.setdefault(k[0], {}), [k[1] if left == 2 else k[1:]], [n], left - 1)
            return
        before, get = len(node), node.get
        for k, n in zip(keys, counts, strict=True):
            node[k] = get(k, 0) + n
        self.entries += len(node) - before
        if left > 1 and len(node) > self.burst:  # bursts: its children are containers of one word less
            held = list(node.items())
            node.clear()
            self.burst_nodes.add(id(node))
            for k, n in held:
                node.setdefault(k[0], {})[k[1] if left == 2 else k[1:]] = n

    def _take(self, node: dict, head: tuple[int, ...], rows: list[np.ndarray], counts: list[np.ndarray]) -> None:
        """Appends the entries of a subtree to ``rows`` and ``counts``."""
        if id(node) in self.burst_nodes:
            self.burst_nodes.discard(id(node))
            for word, down in node.items():
                self._take(down, (*head, word), rows, counts)
            return
        keys = np.array(list(node), U64).reshape(len(node), -1)
        rows.append(np.hstack([np.tile(np.array(head, U64), (len(node), 1)), keys]))
        counts.append(np.fromiter(node.values(), np.int64, len(node)))

    def _size(self, node: dict) -> int:
        return sum(self._size(x) for x in node.values()) if id(node) in self.burst_nodes else len(node)

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Removes whole subtrees, the largest first, until ``keep`` entries are left; their entries in key order."""
        sizes = sorted(((self._size(x), word) for word, x in self.root.items()), reverse=True)
        rows, counts = [np.zeros((0, self.words), U64)], [np.zeros(0, np.int64)]
        for size, word in sizes:
            if self.entries <= keep:
                break  # the small subtrees stay
            self._take(self.root.pop(word), (word,), rows, counts)
            self.entries -= size
        ids, n = np.concatenate(rows), np.concatenate(counts)
        order = np.lexsort(ids.T[::-1])
        return ids[order], n[order]


_RUN = "lang string, words int, part long, first binary, ids binary, counts binary"


def _runs(lang: str, ids: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a sorted run by prefix partition."""
    if not len(counts):
        return
    part = (mix(ids[:, 0] * U64(0xD6E8FEB86659FD93) + mix(ids[:, 1])) % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, ids, counts = part[order], ids[order], counts[order]
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    rows = []
    for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(part)], strict=True):
        for i in range(a, z, RUN_BLOCK):
            j = min(i + RUN_BLOCK, z)
            block = ids[i:j].astype(">u8")
            rows.append((lang, ids.shape[1], int(part[i]), block[0].tobytes(), block.tobytes(), counts[i:j].astype("<u4" if counts[i:j].max() < 1 << 32 else "<i8").tobytes()))
    types = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _RUN.split(", ")])


def _grams(ids: np.ndarray, linked: np.ndarray, words: int, old: int) -> tuple[np.ndarray, np.ndarray]:
    """The different phrases (rows of ids, ascending) that end behind the first ``old`` words, and how often each occurs;
    linked[i]: words i - 1 and i may be joined."""
    n = len(ids) - words + 1
    ok = np.ones(max(n, 0), bool)
    for j in range(1, words):
        ok &= linked[j : j + len(ok)]
    ok[: max(0, old - words + 1)] = False
    at = np.flatnonzero(ok)
    if not len(at):
        return np.zeros((0, words), U64), np.zeros(0, np.int64)
    u, rank = np.unique(ids, return_inverse=True)
    bits = U64(max(len(u) - 1, 1).bit_length())
    if words * int(bits) > 64:
        return _ranked(u, rank, at, words)
    key = np.zeros(len(at), U64)  # the words' ranks
    for k in range(words):
        key = key << bits | rank[at + k].astype(U64)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(first, append=len(key))
    key = key[first]
    mask = U64((1 << int(bits)) - 1)
    return np.stack([u[(key >> (bits * U64(words - 1 - k)) & mask).astype(np.int64)] for k in range(words)], axis=1), counts


def _ranked(u: np.ndarray, rank: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for phrases that don't fit one sort key."""
    rows = np.stack([rank[at + k] for k in range(words)], axis=1)
    rows = rows[np.lexsort(rows.T[::-1])]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return u[rows[first]], np.diff(first, append=len(rows))


def phrase_counts(docs: DataFrame, seed: int, sizes: tuple[int, ...], known: Bloom, parts: int, min_count: int) -> DataFrame:
    """(lang, words, ids, n) of phrases of ``sizes`` words with n >= min_count: pairs of words in ``known``, or longer
    phrases whose pairs are all in ``known``."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # of bounded size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, bloom = Words(seed), shared.value
        tries: dict[tuple[str, int], HatTrie] = {}
        for b in batches:
            for lang, chunks in _streams(b, CHUNK):
                code = _lang_code(lang)
                ids, fresh, cut = np.zeros(0, U64), np.zeros(0, bool), True
                for low in chunks:
                    new, begins, _, _, behind = cutter.cut(low)
                    if len(new):
                        begins[0] |= cut
                        cut = behind
                    else:
                        cut |= behind
                    old = len(ids)
                    ids, fresh = np.concatenate([ids, new]), np.concatenate([fresh, begins])
                    linked = ~fresh
                    linked[:1] = False
                    at = np.flatnonzero(linked)
                    if max(sizes) == 2:
                        good = bloom.has(mix(ids + code))
                        linked[at] = good[at] & good[at - 1]
                    else:
                        linked[at] = bloom.has(_pair(code, ids[at - 1], ids[at]))
                    for words in sizes:
                        grams, n = _grams(ids, linked, words, old)
                        if len(n):
                            tries.setdefault((lang, words), HatTrie(words, BURST)).add(grams, n)
                    while sum(t.entries for t in tries.values()) > TRIE_ENTRIES:
                        (name, _), large = max(tries.items(), key=lambda x: x[1].entries)
                        yield from _runs(name, *large.spill(large.entries // 2), parts)
                    ids, fresh = ids[1 - WORDS :], fresh[1 - WORDS :]
        for (lang, _), t in tries.items():
            yield from _runs(lang, *t.spill(0), parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, counts = None, None, None

        def out(i: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            often = c >= min_count
            rows = i[often].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([group[0]] * len(rows), pa.string()), pa.array([group[1]] * len(rows), pa.int32()), pa.array(list(rows), pa.list_(pa.int64())), pa.array(c[often])], names=["lang", "words", "ids", "n"])

        def summed(blocks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            i, c = np.concatenate([x for x, _ in blocks]), np.concatenate([x for _, x in blocks])
            order = np.lexsort(i.T[::-1])
            i, c = i[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]).any(axis=1)]))
            return i[first], np.add.reduceat(c, first)

        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            for lang, words, part, first, raw, cnt in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group != (lang, words, part):
                    if held:
                        yield out(*summed(held))
                    group, held, size = (lang, words, part), [], 0
                elif size > MERGE_ENTRIES:  # what stands before this block's first key is complete
                    i, c = summed(held)
                    done = _below(i, np.frombuffer(first, ">u8").astype(U64))
                    yield out(i[:done], c[:done])
                    held, size = [(i[done:], c[done:])], 0
                i = np.frombuffer(raw, ">u8").astype(U64).reshape(-1, words)
                c = np.frombuffer(cnt, "<u4" if len(cnt) == 4 * len(i) else "<i8").astype(np.int64)
                held.append((i, c))
                size += len(c)
        if held:
            yield out(*summed(held))

    runs = docs.mapInArrow(lean(count), _RUN).repartition("lang", "words", "part").sortWithinPartitions("lang", "words", "part", "first")
    return runs.mapInArrow(lean(merge), "lang string, words int, ids array<long>, n long")


def _below(ids: np.ndarray, key: np.ndarray) -> int:
    """The number of sorted rows before ``key``."""
    lo, hi = 0, len(ids)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if tuple(ids[mid].tolist()) < tuple(key.tolist()) else (lo, mid)
    return lo


def _counts(docs: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(words: lang, id, word, n of all words; frequent: lang, words, ids, n of words and phrases of min_count)."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    for seed in range(16):
        words = stored(word_counts(docs, seed), "words")
        if words.where("word <> other").isEmpty():
            break
    else:
        raise RuntimeError("words of the corpus share ids under every seed")
    often = words.where(F.col("n") >= min_count).select("lang", F.lit(1).alias("words"), F.array("id").alias("ids"), "n")
    total, n_often = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") >= min_count)).first()
    parts = -(-int(total) // PART_WORDS) or 1
    pairs = stored(phrase_counts(docs, seed, (2,), _bloom(often, n_often), parts, min_count), "pairs")
    longer = phrase_counts(docs, seed, tuple(range(3, WORDS + 1)), _bloom(pairs, pairs.count()), parts, min_count)
    return words.select("lang", "id", "word", "n"), stored(often.unionByName(pairs).unionByName(longer), "phrases")


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, words, ids, a, l, r, score) of the candidates among ``frequent`` (lang, words, ids, n) that no longer
    candidate holds in INSIDE_PCT of their places; frequent holds the parts of its phrases."""
    cand = frequent.where("words > 1").withColumnRenamed("n", "a")
    part = frequent.select("lang", "ids", "n")
    cuts = cand.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("slice(ids, 1, k)")).withColumn("right", F.expr("slice(ids, k + 1, words - k)"))
    cuts = cuts.join(part.select("lang", F.col("ids").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("ids").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    score = F.expr(f"(cast({SCALE} as decimal(8,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    weak = cuts.withColumn("score", score).groupBy("lang", "words", "ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> slice(ids, i, m))))")
    held = cand.where("words > 2").select("lang", F.explode(inner).alias("ids"), F.col("a").cast("decimal(20,0)").alias("b")).groupBy("lang", "ids").agg(F.max("b").alias("b"))
    out = weak.join(held, ["lang", "ids"], "left").where(f"b is null or 100 * b < {INSIDE_PCT} * cast(a as decimal(20,0))")
    return out.select("lang", "words", "ids", "a", "c.l", "c.r", "c.score")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases of ``docs`` (lang, text) by score: lang, rank, phrase, a, l, r, n, score."""
    words, frequent = _counts(docs, min_count)
    rows = stored(scored(frequent), "scored")
    named = rows.select("lang", "ids", F.posexplode("ids").alias("at", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
    named = named.groupBy("lang", "ids").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))  # WORDS at most
    rows = rows.join(named.select("lang", "ids", F.array_join("w.word", " ").alias("phrase")), ["lang", "ids"])
    first = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOW}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
grams AS (
  SELECT lang, m AS words, unnest(list_transform(range(1, CAST(len(ws) - m + 2 AS BIGINT)), lambda i: ws[i:i + m - 1])) AS g
  FROM worded, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(ws) >= m
), counts AS (SELECT lang, words, g, count(*) AS f FROM grams GROUP BY ALL),
cand AS (SELECT lang, words, g, f AS a FROM counts WHERE words > 1 AND f >= {MIN_COUNT}),
cuts AS (SELECT *, unnest(range(1, words)) AS k FROM cand),
scores AS (
  SELECT c.lang, c.words, c.g, c.a, k, x.f AS l, y.f AS r, CAST({SCALE} AS HUGEINT) * c.a // (CAST(x.f AS HUGEINT) + y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN counts y ON y.lang = c.lang AND y.g = c.g[k + 1:]
), weakest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_phrases AS (SELECT lang, a AS b, unnest(flatten(list_transform(range(2, words), lambda m: list_transform(range(1, words - m + 2), lambda i: g[i:i + m - 1])))) AS g FROM cand WHERE words > 2),
dropped AS (SELECT DISTINCT c.lang, c.g FROM cand c JOIN inner_phrases i ON i.lang = c.lang AND i.g = c.g WHERE 100 * CAST(b AS HUGEINT) >= {INSIDE_PCT} * CAST(a AS HUGEINT)),
kept AS (SELECT w.* FROM weakest w ANTI JOIN dropped d ON d.lang = w.lang AND d.g = w.g),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE words = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= {TOP}
"""
