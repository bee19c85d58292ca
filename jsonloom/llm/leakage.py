"""Evaluation texts that leaked into a corpus, found by spaced seeds.

A fixed mask over 12 word positions ignores four of them; the hash of the other eight is the seed. Seeds
of test items and of corpus documents are joined, and around every hit the texts are compared word by
word. The three masks ignore each position exactly once between them, so 12 equal words in a row are hit
by all masks, and 12 words with one replaced are still hit by the mask that ignores it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jsonloom.llm.mail import seen_text
from jsonloom.session import stage

SPAN = 12
#: Fixed masks: the word positions that count.
MASKS = (
    (0, 2, 3, 5, 6, 8, 9, 11),
    (0, 1, 3, 4, 6, 7, 9, 10),
    (1, 2, 4, 5, 7, 8, 10, 11),
)
BITS_A_SEED = 64  # of the filter: with SLOTS bits set by each seed about one window in 65,000 passes by chance
SLOTS = 4
MOST_BITS = 28  # log2 of the filter's bits: 32 MB. Beyond 4 million test seeds more windows pass, and the join sorts them out
WORDS_AT_ONCE = 100_000  # documents are hashed together up to so many words
BROADCAST_SEEDS = 500_000  # beyond so many test seeds the join is shuffled

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Word -> 64-bit hash; forgets all when a million words are held."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()


def words(text: str) -> list[str]:
    """Runs of letters and digits, without regard to case."""
    return _WORD.findall(text.casefold())


def word_hashes(text: str) -> np.ndarray:
    return np.fromiter((_hashes[w] for w in words(text)), dtype=np.uint64)


def seeds(hashes: np.ndarray) -> np.ndarray:
    """The seed of every window of SPAN words, a row for each mask."""
    n = len(hashes) - SPAN + 1
    out = np.empty((len(MASKS), max(n, 0)), dtype=np.uint64)
    for m, mask in enumerate(MASKS):
        h = out[m]
        h[:] = (m + 1) * 0x51ED2701
        for at in mask:
            h ^= hashes[at : at + h.size]
            h *= _MIX
            h ^= h >> np.uint64(29)
    return out


def filter_bits(n_seeds: int) -> int:
    """log2 of the number of bits of a filter of so many seeds."""
    return min(MOST_BITS, max(16, (BITS_A_SEED * n_seeds - 1).bit_length()))


def _slot(seed: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The i-th bit that a seed sets."""
    low, high = seed & np.uint64(0xFFFFFFFF), (seed >> np.uint64(32)) | np.uint64(1)
    return (low + np.uint64(i) * high) & np.uint64((1 << bits) - 1)


def passing(found: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask, position) of the seeds that the filter lets pass; most fail at the first bit."""
    bits = (cells.size * 64 - 1).bit_length()
    mask = at = None
    for i in range(SLOTS):
        seed = found if mask is None else found[mask, at]
        slot = _slot(seed, i, bits)
        hit = (cells[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)
        if mask is None:
            mask, at = np.nonzero(hit)
        else:
            keep = np.flatnonzero(hit)
            mask, at = mask[keep], at[keep]
    return mask, at


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int64)
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind)).cast(pa.list_(kind))


Batches = Iterator[pa.RecordBatch]


def _item_rows(batches: Batches) -> Batches:
    for b in batches:
        tokens = [word_hashes(t or "") for t in b.column(1).to_pylist()]
        found = [seeds(t) for t in tokens]
        at = [np.tile(np.arange(f.shape[1], dtype=np.int32), len(MASKS)) for f in found]
        cols = [b.column(0), _lists(tokens, pa.int64()), _lists([f.ravel() for f in found], pa.int64()), _lists(at, pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, names=["item_id", "item_words", "seeds", "at"])


def _hits(tokens: list[np.ndarray], bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(document, seeds, positions) of the documents with seeds that the filter lets pass. The documents are
    hashed as one run of words; windows that reach into the next one don't count."""
    ends = np.cumsum([len(t) for t in tokens])
    flat = np.concatenate(tokens)
    found = seeds(flat)
    if not found.size:
        return
    mask, at = passing(found, bits)
    doc = np.searchsorted(ends, at, side="right")
    inside = at + SPAN <= ends[doc]
    mask, at, doc = mask[inside], at[inside], doc[inside]
    order = np.argsort(doc, kind="stable")
    mask, at, doc = mask[order], at[order], doc[order]
    which, first = np.unique(doc, return_index=True)
    last = np.append(first[1:], len(doc))[: len(first)]
    for d, lo, hi in zip(which.tolist(), first.tolist(), last.tolist(), strict=True):
        yield d, found[mask[lo:hi], at[lo:hi]], (at[lo:hi] - (ends[d] - len(tokens[d]))).astype(np.int32)


def _document_rows(bits: np.ndarray, read: Callable[[str | None], str]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for b in batches:
            keys, tokens, hits, at = [], [], [], []
            some: list[tuple[int, np.ndarray]] = []

            def flush() -> None:
                for d, seed, pos in _hits([t for _, t in some], bits) if some else ():
                    keys.append(some[d][0])
                    tokens.append(some[d][1])
                    hits.append(seed)
                    at.append(pos)
                some.clear()

            held = 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = word_hashes(read(text))
                if len(t) >= SPAN:
                    some.append((key, t))
                    held += len(t)
                if held > WORDS_AT_ONCE:
                    flush()
                    held = 0
            flush()
            cols = [pa.array(keys, pa.int64()), _lists(tokens, pa.int64()), _lists(hits, pa.int64()), _lists(at, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "doc_words", "seeds", "at"])

    return run


def longest_runs(same: np.ndarray, allowed: int) -> tuple[int, int, int]:
    """(longest run of equal words, longest stretch with at most ``allowed`` others inside, its start)."""
    breaks = np.flatnonzero(~same)
    edges = np.concatenate(([-1], breaks, [len(same)]))
    exact = int((edges[1:] - edges[:-1] - 1).max())
    k = min(allowed + 1, len(edges) - 1)
    best, start = 0, 0
    for lo, hi in zip(edges[:-k].tolist(), edges[k:].tolist(), strict=True):
        a, b = lo + 1, hi
        while a < b and not same[a]:
            a += 1
        while b > a and not same[b - 1]:
            b -= 1
        if b - a > best:
            best, start = b - a, a
    return exact, best, start


def _verified(allowed: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for b in batches:
            rows = []
            for doc, item, shift, mine, theirs in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                # ``mine`` are the document's words from max(shift, 0) on, ``theirs`` the item's
                skip = max(0, -shift)
                n = min(len(mine), len(theirs) - skip)
                same = np.array(mine[:n], dtype=np.int64) == np.array(theirs[skip : skip + n], dtype=np.int64)
                exact, near, start = longest_runs(same, allowed)
                rows.append((doc, item, exact, near, max(shift, 0) + start, len(theirs)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "exact_words", "near_words", "doc_word", "item_words"])

    return run


def leaked_passages(
    documents: DataFrame, items: DataFrame, *, substitutions: int = 1, read: Callable[[str | None], str] = seen_text
) -> DataFrame:
    """(doc_id, item_id, exact_words, near_words, doc_word, item_words): for every document and test
    item that share a passage, the longest run of equal words, the longest stretch with at most
    ``substitutions`` replaced words, the word where that begins, and the item's length in words.
    At least 12 words, one of them replaced at most, are found for certain.

    documents: (doc_id BIGINT, text); items: (item_id BIGINT, text); other columns are ignored.
    read: how a document's text is read, by default as an e-mail message; items are plain text.

    Scale: documents are read once, as Arrow batches; only those with a seed that the filter of test
    seeds lets pass go on (written to the shared folder), with their hits. The filter's size follows from the
    number of test seeds, up to 32 MB. Hits join the test seeds by hash (broadcast up to BROADCAST_SEEDS; else
    exchanged, where adaptive execution splits the partition of a stock phrase's seed); the candidate pairs are distinct alignments of a document with
    an item, never pairs of documents. Copies of a document are found each for itself.

    Edge cases: NULL ids give no rows; NULL, empty and short texts (under 12 words) match nothing;
    repeated items and documents give one row per pair of ids; empty tables give no rows."""
    spark = documents.sparkSession
    test = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    item_rows = stage(test.mapInArrow(_item_rows, "item_id bigint, item_words array<bigint>, seeds array<bigint>, at array<int>"), "items")
    item_seeds = item_rows.select("item_id", F.explode(F.arrays_zip("seeds", "at")).alias("s")).select("item_id", F.col("s.seeds").alias("seed"), F.col("s.at").alias("item_at"))
    n_seeds = item_seeds.count()
    few = n_seeds <= BROADCAST_SEEDS
    size = filter_bits(n_seeds)
    low, high = F.col("seed").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("seed", 32).bitwiseOR(1)
    slots = item_seeds.select(F.explode(F.array(*[(low + high * i).bitwiseAND((1 << size) - 1) for i in range(SLOTS)])).alias("slot"))
    packed = slots.groupBy(F.shiftright("slot", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    cells = packed.toArrow()  # at most 2^MOST_BITS / 64 rows
    bits = np.zeros((1 << size) // 64, dtype=np.uint64)
    if cells.num_rows:
        bits[cells.column(0).to_numpy()] = cells.column(1).to_numpy().view(np.uint64)
    corpus = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    hits = stage(
        corpus.mapInArrow(_document_rows(bits, read), "doc_id bigint, doc_words array<bigint>, seeds array<bigint>, at array<int>"), "hits"
    )
    doc_seeds = hits.select("doc_id", F.explode(F.arrays_zip("seeds", "at")).alias("s")).select("doc_id", F.col("s.seeds").alias("seed"), F.col("s.at").alias("doc_at"))
    pairs = doc_seeds.join(F.broadcast(item_seeds) if few else item_seeds, "seed")
    pairs = pairs.select("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
    texts = item_rows.where(F.size("seeds") > 0).select("item_id", "item_words")
    aligned = (
        pairs.join(F.broadcast(texts) if few else texts, "item_id")
        .join(hits.select("doc_id", "doc_words"), "doc_id")
        .select(
            "doc_id", "item_id", "shift",
            F.slice("doc_words", F.greatest(F.col("shift"), F.lit(0)) + 1, F.size("item_words")).alias("doc_words"), "item_words",
        )
    )
    found = aligned.mapInArrow(
        _verified(substitutions), "doc_id bigint, item_id bigint, exact_words bigint, near_words bigint, doc_word bigint, item_words bigint"
    )
    best = found.where((F.col("exact_words") >= SPAN) | (F.col("near_words") >= SPAN)).groupBy("doc_id", "item_id").agg(
        F.max("exact_words").alias("exact_words"), F.max(F.struct("near_words", -F.col("doc_word"))).alias("b"), F.max("item_words").alias("item_words")
    )
    return best.select("doc_id", "item_id", "exact_words", F.col("b.near_words").alias("near_words"), (-F.col("b.col2")).alias("doc_word"), "item_words")
