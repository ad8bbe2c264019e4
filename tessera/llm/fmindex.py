"""Test passages inside training text, found by an FM-index of each training shard.

Each task cuts its documents into shards and builds one FM-index a shard over all the shard's words: suffix order,
Burrows-Wheeler string in a bit-packed wavelet matrix, and suffix positions sampled every ``SAMPLE`` words.  An
index is a row of a DataFrame with its shard's texts, so it can be kept on the shared storage and answer phrases not
known when it was built.  All phrases of ``length`` consecutive words of the test items are searched backward at once
(vectorised rank queries), the rows left are walked to a sampled position, and overlapping hits of an item in a
document merge into removal spans.

The test items are a stated query set.  They are taken in blocks of ``BLOCK_CHARS`` characters.  A block is sent to
the executors, searched in all shards, its hits are written, and it is dropped before the next one is read, so never
more than one block is alive.  With one block, index and search are one pass; with more, the indexes are written once
(``session.cut``) and every block reads them.  Texts that recur within a shard are indexed once and reported for each of
their documents.

Defined results: words are unbroken runs of Unicode letters and digits in lower case, after dropping U+00AD,
U+200B, U+200C, U+200D and U+FEFF; null and empty texts and items shorter than a phrase match nothing; repeated
documents are reported each; documents of any length are read whole; a phrase shared by items counts for each;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

WORD = re.compile(r"[^\W_]+")
DROPPED = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0xFEFF])
_DROPPED = re.compile("[\u00ad\u200b\u200c\u200d\ufeff]")
SAMPLE = 16
SHARD_WORDS = 1_000_000
BLOCK_CHARS = 8_000_000
CODEC = "zstd"


def words(text: str) -> list[str]:
    if _DROPPED.search(text):
        text = text.translate(DROPPED)
    return WORD.findall(text.lower())


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol must be the only smallest one.  As many symbols as a 63-bit number holds are
    compared first; then only suffixes that are not yet told apart are sorted again."""
    n = len(s)
    bits = max(1, int(s.max()).bit_length())
    step = max(1, min(63 // bits, n))
    key = np.zeros(n, np.int64)
    for k in range(step):
        key <<= bits
        key[: n - k] |= s[k:]
    order = np.argsort(key)
    head = np.empty(n, bool)
    head[0], head[1:] = True, key[order[1:]] != key[order[:-1]]
    del key
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    open_ = np.arange(n)
    while True:
        alone = head & np.append(head[1:], True)
        open_ = open_[~alone]
        if not len(open_):
            return order
        e = order[open_]
        key = rank[e] * n + rank[e + step]  # no suffix that is not alone ends within the symbols compared
        by = np.argsort(key)
        key, e = key[by], e[by]
        order[open_] = e
        head = np.empty(len(e), bool)
        head[0], head[1:] = True, key[1:] != key[:-1]
        rank[e] = open_[np.maximum.accumulate(np.where(head, np.arange(len(e)), 0))]
        step *= 2


class Bits:
    """A bit string with rank: 64 bits a word and the ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int32)]).astype(np.int32)

    @classmethod
    def of(cls, words_: np.ndarray, before: np.ndarray) -> Bits:
        out = cls.__new__(cls)
        out.words, out.before = words_, before
        return out

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)

    def at(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Rank queries over integers: how many c stand before position i."""

    def __init__(self, s: np.ndarray) -> None:
        self.bits = max(1, int(s.max()).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for level in range(self.bits - 1, -1, -1):
            bit = ((s >> level) & 1).astype(bool)
            zeros = s[~bit]
            self.levels.append((Bits(bit), len(zeros)))
            s = np.concatenate([zeros, s[bit]])
        self.start = self._down(np.arange(1 << self.bits), np.zeros(1 << self.bits, np.int64))

    @classmethod
    def of(cls, levels: list[tuple[np.ndarray, np.ndarray, int]], start: np.ndarray) -> WaveletMatrix:
        out = cls.__new__(cls)
        out.bits, out.levels, out.start = len(levels), [(Bits.of(w, b), zeros) for w, b, zeros in levels], start
        return out

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for (bits, zeros), level in zip(self.levels, range(self.bits - 1, -1, -1)):
            ones = bits.ones(i)
            i = np.where((c >> level) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._down(c, i) - self.start[c]

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What stands at each position, and how often before it."""
        c = np.zeros(len(i), np.int64)
        for bits, zeros in self.levels:
            one, ones = bits.at(i), bits.ones(i)
            c = c << 1 | one
            i = np.where(one, zeros + ones, i - ones)
        return c, i - self.start[c]


class ShardIndex:
    """FM-index of a string of integer symbols >= 1."""

    def __init__(self, s: np.ndarray) -> None:
        s = np.append(s, 0).astype(np.int64)
        self.length = len(s)
        order = suffix_order(s)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=int(s.max()) + 1))])
        self.wavelet = WaveletMatrix(s[order - 1])
        kept = (order % SAMPLE == 0) | (order == len(s) - 1)
        self.kept = Bits(kept)
        self.sampled = order[kept].astype(np.int32 if len(s) < 1 << 31 else np.int64)

    def state(self) -> tuple:
        """Plain arrays, which any process can read."""
        return self.length, self.before, [(b.words, b.before, zeros) for b, zeros in self.wavelet.levels], self.wavelet.start, (self.kept.words, self.kept.before), self.sampled

    @classmethod
    def of(cls, state: tuple) -> ShardIndex:
        out = cls.__new__(cls)
        out.length, out.before, levels, start, kept, out.sampled = state
        out.wavelet, out.kept = WaveletMatrix.of(levels, start), Bits.of(*kept)
        return out

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase number, position in the string) of every occurrence; phrases: one row of symbols each, 0 for one that is not there."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.length, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[which, column]
            known = (c > 0) & (c < len(self.before) - 1)
            which, low, high, c = which[known], low[known], high[known], c[known]
            low = self.before[c] + self.wavelet.rank(c, low)
            high = self.before[c] + self.wavelet.rank(c, high)
            left = low < high
            which, low, high = which[left], low[left], high[left]
            if not len(which):
                break
        count = high - low
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(which) else np.zeros(0, np.int64)
        return np.repeat(which, count), self.locate(rows)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at = np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        rows = rows.copy()
        for steps in range(SAMPLE + 1):
            here = self.kept.at(rows)
            at[open_[here]] = self.sampled[self.kept.ones(rows[here])] + steps
            open_, rows = open_[~here], rows[~here]
            if not len(rows):
                break
            c, rank = self.wavelet.symbol_and_rank(rows)
            rows = self.before[c] + rank
        return at


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Shard:
    """Distinct texts, the documents of each, and the FM-index of their words.  Symbol 1 + k ends text k, words have the numbers after."""

    def __init__(self) -> None:
        self.owners: dict[str, list[int]] = {}
        self.ids = _Numbers()
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc: int, text: str) -> None:
        if (known := self.owners.get(text)) is not None:
            known.append(doc)
            return
        self.owners[text] = [doc]
        part = np.fromiter(map(self.ids.__getitem__, words(text)), np.int64)
        self.parts.append(part)
        self.size += len(part) + 1

    def row(self) -> tuple[bytes, bytes]:
        """(index, texts), both packed."""
        ends = len(self.parts)
        starts = np.cumsum([0] + [len(p) + 1 for p in self.parts])
        s = np.empty(self.size, np.int64)
        for k, (at, part) in enumerate(zip(starts.tolist(), self.parts)):
            s[at : at + len(part)] = part + (ends + 1)
            s[at + len(part)] = 1 + k
        index = pickle.dumps((ShardIndex(s).state(), starts, "\n".join(self.ids), list(self.owners.values())), 5)
        texts = pickle.dumps(list(self.owners), 5)
        return index, len(texts).to_bytes(8, "little") + pa.compress(texts, CODEC, asbytes=True)


def indexes(docs: DataFrame, doc_id: str, text: str, shard_words: int | None = None) -> DataFrame:
    """One row a shard: its FM-index and its texts.  Narrow: shards never cross partitions."""
    held = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    most = shard_words or SHARD_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(shard: Shard) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in shard.row()], names=["index", "texts"])

        shard = Shard()
        for batch in batches:
            for doc, text_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard.add(doc, text_)
                if shard.size >= most:
                    yield packed(shard)
                    shard = Shard()
        if shard.size:
            yield packed(shard)

    return held.mapInArrow(run, "index binary, texts binary")


class Block:
    """The words of some test items: numbers in one array, and for each phrase where it begins and whose it is."""

    def __init__(self, items: Iterable[tuple[int, str]], length: int) -> None:
        ids = _Numbers()
        parts, begins, owners, at = [], [], [], 0
        for item, text in items:
            part = np.fromiter(map(ids.__getitem__, words(text)), np.int32)
            if (n := len(part) - length + 1) > 0:
                parts.append(part)
                begins.append(np.arange(at, at + n))
                owners.append(np.full(n, item, np.int64))
                at += len(part)
        none = [np.zeros(0, np.int64)]
        self.length, self.vocabulary = length, list(ids)
        self.numbers, self.begins, self.owners = (np.concatenate(x or none) for x in (parts, begins, owners))

    @classmethod
    def of(cls, state: tuple) -> Block:
        out = cls.__new__(cls)
        out.length, out.vocabulary, out.numbers, out.begins, out.owners = state
        return out

    def state(self) -> tuple:
        return self.length, self.vocabulary, self.numbers, self.begins, self.owners

    def phrases(self, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases all of whose words a shard has, as rows of its symbols, and their items."""
        of = np.fromiter(map(known.get, self.vocabulary, repeat(0)), np.int64, len(self.vocabulary))
        symbols = of[self.numbers]
        gone = np.concatenate([[0], np.cumsum(symbols == 0)])
        here = gone[self.begins + self.length] == gone[self.begins]
        begins = self.begins[here]
        return symbols[begins[:, None] + np.arange(self.length)], self.owners[here]


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character ranges of word ranges (end exclusive) in the text as written."""
    source, kept = [], []
    for i, c in enumerate(text):
        if ord(c) not in DROPPED:
            low = c.lower()
            kept.append(low)
            source += [i] * len(low)
    at = [(m.start(), m.end()) for m in WORD.finditer("".join(kept))]
    return [(source[at[a][0]], source[at[b - 1][1] - 1] + 1) for a, b in spans]


def _hits(index: bytes, packed: bytes, block: Block) -> list[tuple[int, int, int, int, int]]:
    """(doc, item, start, end, words) of the merged hits of a block in a shard."""
    state, starts, vocabulary, owners = pickle.loads(index)
    first = len(owners) + 1
    phrases, items = block.phrases({w: first + i for i, w in enumerate(vocabulary.split("\n"))} if vocabulary else {})
    if not len(phrases):
        return []
    which, at = ShardIndex.of(state).search(phrases)
    if not len(which):
        return []
    text_no = np.searchsorted(starts, at, side="right") - 1
    places = sorted(set(zip(text_no.tolist(), items[which].tolist(), (at - starts[text_no]).tolist())))
    found: dict[int, dict[int, list[list[int]]]] = {}
    for k, item, a in places:
        spans = found.setdefault(k, {}).setdefault(item, [])
        if spans and a <= spans[-1][1]:
            spans[-1][1] = a + block.length
        else:
            spans.append([a, a + block.length])
    texts = pickle.loads(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), CODEC, asbytes=True))
    rows = []
    for k, by_item in found.items():
        flat = [(item, a, b) for item, spans in by_item.items() for a, b in spans]
        chars = char_spans(texts[k], [(a, b) for _, a, b in flat])
        rows += [(doc, item, a, b, e - s) for (item, s, e), (a, b) in zip(flat, chars) for doc in owners[k]]
    return rows


def search(shards: DataFrame, block: Block) -> tuple[DataFrame, object]:
    """Hits of one block in all shards, and the broadcast they need."""
    shared = shards.sparkSession.sparkContext.broadcast(block.state())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Block.of(shared.value)
        for batch in batches:
            for index, texts in zip(batch.column(0), batch.column(1)):
                rows = _hits(index.as_py(), texts.as_py(), held)
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start_pos", "end_pos", "n_words"])

    return shards.mapInArrow(run, "doc_id bigint, item_id bigint, start_pos bigint, end_pos bigint, n_words bigint"), shared


def _blocks(items: DataFrame, length: int, most: int) -> Iterator[Block]:
    held: list[tuple[int, str]] = []
    size = 0
    for item, passage in items.toLocalIterator():
        if held and size + len(passage) > most:
            yield Block(held, length)
            held, size = [], 0
        held.append((item, passage))
        size += len(passage)
    yield Block(held, length)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", length: int = 12, block_chars: int | None = None) -> DataFrame:
    """Merged removal spans (doc_id, item_id, start_pos, end_pos, n_words) of test items in documents, in characters."""
    shards = indexes(docs, doc_id, text)
    queries = items.select(F.col(item_id).cast("bigint"), F.col(item_text).cast("string")).where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull())
    blocks = _blocks(queries, length, block_chars or BLOCK_CHARS)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        return search(shards, block)[0]
    shards = cut(shards)
    written: list[DataFrame] = []
    while block is not None:
        hits, shared = search(shards, block)
        written.append(cut(hits))
        shared.destroy()
        block, after = after, next(blocks, None)
    return reduce(DataFrame.unionByName, written)
