"""Best-fit packing of token sequences by the sum-of-squares rule.

Tokenizing happens next to the scan and only (doc_id, piece, start, length, crc) rows go on. They are
dealt by a hash into groups of a fixed number of pieces, so that the number of groups, not their
size, grows with the corpus; each group is packed on its own by the sum-of-squares rule. A group of
tens of thousands of pieces leaves only its last bins partly filled, so packing groups apart costs
well under one percent of the sequences.

Defined results: a null text is an empty one and yields the end token alone; a text of any length is
cut into pieces of `capacity` ids; repeated rows are packed as often as they occur; an empty table
gives no rows; columns other than the two named ones are ignored.
"""

from __future__ import annotations

import os
import re
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, slices, small_batches, tidy

CAPACITY = 2048
GROUP_PIECES = 60_000
#: Texts that are encoded whole: with control characters that Python's splitting takes for white space and
#: the tokenizer doesn't, with letters whose lower case depends on their place, with marks that Python's
#: tables of Unicode order otherwise, or with special tokens.
WHOLE = re.compile("[\x1c-\x1f\u03a3\u0130\u1df6\U0001e4ec\U0001e4ed]|(?i:<\\|(?:start|end)oftext\\|>)")
STOP = re.compile(r"([.,])(?<=[^\W_].)(?!\S)")
#: Texts handled at once, and their bytes.
ROWS, BYTES = 4096, 6 << 20
#: Distinct words that the tokenizer gets at once.
WORDS = 4096
#: Words whose ids a worker remembers, some 30 bytes each, and the longest of them.
KNOWN_WORDS, KNOWN_BYTES = 600_000, 48

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class KnownWords:
    """Ids of words under two 64-bit tabulation hashes, in sorted arrays. Of more than `most` words
    those used last stay."""

    def __init__(self, most: int = KNOWN_WORDS):
        self.most, self.now = most, 0
        self.tables = np.random.default_rng(7).integers(0, 2**64, (2, KNOWN_BYTES * 256), np.uint64)
        self.first, self.second = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.begins, self.sizes, self.used = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.pool = np.empty(0, "<u4")

    def hashes(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes of each word, and whether it is short enough to have them."""
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        lengths = np.diff(offsets)
        place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], lengths)
        at = np.minimum(place, KNOWN_BYTES - 1) * 256 + data
        del place
        starts = (offsets[:-1] - offsets[0])[lengths > 0]
        out = np.zeros((2, len(words)), np.uint64)
        for k, t in enumerate(self.tables):
            if len(starts):
                out[k, lengths > 0] = np.add.reduceat(t[at], starts)
        return out[0], out[1], (lengths > 0) & (lengths <= KNOWN_BYTES)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The place of each word, -1 for unknown ones."""
        if not len(self.first):
            return np.full(len(first), -1)
        at = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
        return np.where((self.first[at] == first) & (self.second[at] == second), at, -1)

    def put(self, first: np.ndarray, second: np.ndarray, pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> None:
        keep = np.arange(len(self.first))
        if len(keep) + len(first) > self.most:
            keep = np.sort(np.argsort(-self.used, kind="stable")[: max(0, self.most // 2 - len(first))])
        n = np.concatenate([self.sizes[keep], sizes]).astype(np.int64)
        begin = np.concatenate([self.begins[keep], begins + len(self.pool)])
        ends = np.cumsum(n)
        self.pool = np.concatenate([self.pool, pool])[np.repeat(begin - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        keys = np.concatenate([self.first[keep], first])
        order = np.argsort(keys, kind="stable")
        self.first, self.second = keys[order], np.concatenate([self.second[keep], second])[order]
        self.begins, self.sizes = (ends - n)[order], n[order].astype(np.int32)
        self.used = np.concatenate([self.used[keep], np.full(len(first), self.now, np.int32)])[order]


class WordEncoder:
    """Token ids of a text, word by word: this tokenizer drops white space, and no token crosses it,
    so the ids of a text are those of its white-space-separated parts in order. A full stop or comma
    behind a letter is a token of its own, and case doesn't matter, so few words are distinct.

    The tokenizer normalizes to NFC before it lower-cases, so that is done here as well before words
    are cut; texts that aren't in NFC afterwards are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has one task a core
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known = KnownWords()

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct words in one array, and where each word's begin and how many they are."""
        plain = np.fromiter(map(str.isalpha, words), bool, len(words))  # one word to the tokenizer as well
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        found, counts = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for at in range(0, len(order), WORDS):
            some = [words[i] for i in order[at : at + WORDS].tolist()]
            if plain[order[min(at + WORDS, len(order)) - 1]]:
                ids = self.batch([" ".join(some)])[0]
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(some):
                    found.append(ids)
                    counts.append(np.diff(ends, prepend=0))
                    continue
            each = self.batch(some)
            found += each
            counts.append(np.fromiter(map(len, each), np.int64, len(each)))
        sizes = np.empty(len(words), np.int64)
        begins = np.empty(len(words), np.int64)
        sizes[order] = n = np.concatenate(counts)
        begins[order] = np.cumsum(n) - n
        return np.concatenate(found), begins, sizes

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As encode_words, for words that may be known."""
        known = self.known
        known.now += 1
        first, second, short = known.hashes(words)
        at = np.where(short, known.find(first, second), -1)
        new = np.flatnonzero(at < 0)
        pool, begins, sizes = self.encode_words(words.take(pa.array(new)).to_pylist())
        old = at >= 0
        known.used[at[old]] = known.now
        out_begins, out_sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        out_begins[new], out_sizes[new] = begins, sizes
        out_begins[old], out_sizes[old] = known.begins[at[old]] + len(pool), known.sizes[at[old]]
        ids = np.concatenate([pool, known.pool])
        kept = short[new]
        known.put(first[new][kept], second[new][kept], pool, begins[kept], sizes[kept])
        return ids, out_begins, out_sizes

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text. Arrow splits the texts and numbers their distinct words, so Python
        handles each word of a batch once; numpy copies the ids of all its places."""
        lower, odd = [], {}
        for i, t in enumerate(texts):
            low = unicodedata.normalize("NFC", t).lower()
            if WHOLE.search(t) or not unicodedata.is_normalized("NFC", low):
                odd[i] = t
                low = ""
            lower.append(STOP.sub(r" \1", low))
        split = pc.utf8_split_whitespace(pa.array(lower, pa.large_string()))
        del lower
        coded = split.flatten().dictionary_encode()
        pool, begins, sizes = self.ids_of(coded.dictionary)
        codes, bounds = coded.indices.to_numpy(), split.offsets.to_numpy()
        for i, (first, last) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if i in odd:
                yield self.batch([odd[i]])[0]
                continue
            at = codes[first:last]
            n = sizes[at]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            yield pool[np.repeat(begins[at] - ends + n, n) + np.arange(total)]


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process, which runs many tasks."""
    kept = vars(sys.modules.setdefault("_factweave_worker", types.ModuleType("_factweave_worker")))
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def tokenized_pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """A row for each piece of at most capacity ids of each document with end_id behind its text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(tokenizer)
        end = np.array([end_id], "<u4")
        for whole in batches:
            for batch in slices(whole, 1, ROWS, BYTES):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                rows: list[tuple] = []
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                    ids = np.append(ids, end)
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        tidy()

    small_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of each item, in the order given.

    Each item goes where the sum over gaps g of N(g)^2 becomes smallest, N(g) being the number of
    open bins with a gap of g: into a bin of gap g the sum changes by 2(N(g-s) - N(g)) + 2, into one
    it fills by -2 N(s) + 1, into a new bin by 2 N(capacity-s) + 1. Ties take the smallest gap.
    """
    counts = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.empty(len(lengths), np.int64)
    places = np.empty(len(lengths), np.int64)
    used = 0
    never = np.int64(2**40)
    for i, s in enumerate(lengths.tolist()):
        if s < capacity:
            have = counts[s:capacity]
            change = np.where(have > 0, 2 * (counts[: capacity - s] - have) + 2, never)
            change[0] = 1 - 2 * counts[s] if counts[s] else never
            g = int(change.argmin())
            best, gap = change[g], g + s
        else:
            best, gap = never, capacity
        if s == capacity or best > 2 * counts[capacity - s] + 1:
            b, gap = used, capacity
            used += 1
        else:
            b = open_bins[gap].pop()
            counts[gap] -= 1
        bins[i], places[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            counts[gap - s] += 1
    return bins, places


def pack(pieces: DataFrame, count: int, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces with sequence_id and offset. count: how many there are."""
    groups = max(1, -(-count // group_pieces))

    def one(rows: pa.Table) -> pa.Table:
        lengths = rows["length"].to_numpy()
        order = np.lexsort((rows["piece"].to_numpy(), rows["doc_id"].to_numpy(), -lengths))
        bins, places = sum_of_squares(lengths[order], capacity)
        at = np.empty((2, len(order)), np.int64)
        at[0, order], at[1, order] = bins, places
        out = rows.drop_columns(["part"])
        return out.append_column("sequence_id", pa.array(at[0] * groups + rows["part"][0].as_py())).append_column("offset", pa.array(at[1]))

    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups))
    return pieces.withColumn("part", part).groupBy("part").applyInArrow(one, PACKED)


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Every document of (doc_id, text) as pieces in as few sequences of at most capacity ids as the
    rule finds."""
    pieces = save(tokenized_pieces(documents, tokenizer, capacity), "pieces")
    return pack(pieces, pieces.count(), capacity, group_pieces)
