"""Benchmark decontamination by spaced-seed hashing.

Texts are words with A-Z lower-cased. Fixed masks pick 7 positions out of windows of up
to 14 words and ignore the others; the hash of the picked words is a seed.

Seeds of documents are joined with seeds of benchmark items. Around each hit the two
texts are compared on the hit's diagonal, and the longest stretch with at most one
substitution in five words is measured. A document is contaminated by an item if a
stretch has MIN_WORDS words, or the whole of a shorter item.

No such pair is missed. The six masks together hit every aligned stretch of 13 to 25 words with
one substitution in five at most, wherever these are (searched exhaustively, and
tested), and a longer one, cut into two halves of 13 words or more, is as good in one of the
halves. An item of n < 13 words may have n // 5 words substituted; its words are cut into two
groups more than that, and each mask leaves out as many groups as there may be
substitutions, so some mask leaves out all of them.

The benchmark is a query set held against all rows in blocks: items stream to the
driver until a block has BLOCK_WORDS words, and each block is broadcast to one pass over the
documents. Where there is more than one block, each pass is written to the shared folder and its
broadcast released before the next, so one block is held at a time however large the
benchmark is. Documents are never shuffled.

Defined cases: a null or blank text has no words, so it neither contaminates nor is
contaminated; repeated rows or ids give their pairs once; a null id is an id like
others; empty tables give no rows; columns other than the ids and texts are
ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, as_table
from .tokens import U64, mix64, pieces, word_hashes

MASKS = (
    (0, 1, 2, 3, 5, 6, 7),
    (0, 1, 2, 4, 7, 9, 10),
    (0, 1, 4, 5, 7, 8, 9),
    (0, 1, 2, 4, 11, 12, 13),
    (0, 1, 3, 6, 8, 9, 10),
    (0, 1, 2, 3, 6, 7, 8),
)
MIN_WORDS = 13
#: A stretch may have one substitution in so many words.
ONE_IN = 5
#: A block ends at so many words; a text counts as a word for every WORD_BYTES bytes at least.
BLOCK_WORDS = 250_000
WORD_BYTES = 32
#: Hits expanded at a time, which bounds a task's memory.
HITS = 1 << 20

_ODD = mix64(np.arange(101, 101 + 16, dtype=U64)) | U64(1)


def _seeds(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """A seed for every window of the mask's span."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k, at in enumerate(mask):
        out += words[at : at + n] * _ODD[k]
    return mix64(out)


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks over the whole of an item of n words, n // ONE_IN of which may be substituted."""
    bad = n // ONE_IN
    if not bad:
        return [tuple(range(n))]
    group = np.arange(n) * (bad + 2) // n
    return [tuple(np.flatnonzero(~np.isin(group, out)).tolist()) for out in itertools.combinations(range(bad + 2), bad)]


def _owners(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


class Block:
    """Words and seed index of some benchmark items."""

    def __init__(self, items: list, texts: list[str | None]) -> None:
        parts = [word_hashes(data, offsets) for _, _, data, offsets in pieces(pa.array(texts, pa.string()))]
        self.items = items
        self.words = np.concatenate([w for w, _ in parts])
        self.counts = np.concatenate([c for _, c in parts])
        self.first = np.cumsum(self.counts) - self.counts
        owner = _owners(self.counts)
        short = np.unique(self.counts[(self.counts > 0) & (self.counts < MIN_WORDS)]).tolist()
        #: (mask, item words it is for: None for all) of every kind of seed
        self.kinds = [(m, None) for m in MASKS] + [(m, n) for n in short for m in short_masks(n)]
        self.index = []
        for mask, only in self.kinds:
            seeds = _seeds(self.words, mask)
            at = np.flatnonzero(owner[: len(seeds)] == owner[mask[-1] : mask[-1] + len(seeds)])
            if only is not None:
                at = at[(self.counts[owner[at]] == only) & (at == self.first[owner[at]])]
            order = at[np.argsort(seeds[at], kind="stable")]
            values, start = np.unique(seeds[order], return_index=True)
            bits = min(22, (32 * len(values) + 1).bit_length())
            present, drop = np.zeros(1 << bits, dtype=bool), U64(64 - bits)
            present[(values >> drop).astype(np.int64)] = True
            self.index.append((values, np.append(start, len(order)), order, present, drop))
        self.owner = owner

    def diagonals(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Distinct rows (text, item, item position - text position) that share a seed."""
        owner, first = _owners(counts), np.cumsum(counts) - counts
        found = [np.zeros((0, 3), np.int64)]
        for (mask, _), (values, start, order, present, drop) in zip(self.kinds, self.index):
            if not len(values):
                continue
            seeds = _seeds(words, mask)
            at = np.flatnonzero(present[(seeds >> drop).astype(np.int64)])
            at = at[owner[at] == owner[at + mask[-1]]]
            nth = np.searchsorted(values, seeds[at])
            same = (nth < len(values)) & (values[np.minimum(nth, len(values) - 1)] == seeds[at])
            at, nth = at[same], nth[same]
            many = start[nth + 1] - start[nth]
            cut = np.append(np.flatnonzero(np.diff(np.cumsum(many) // HITS)) + 1, len(at))
            a = 0
            for b in cut:
                m = many[a:b]
                where = np.repeat(start[nth[a:b]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                there, here = order[where], np.repeat(at[a:b], m)
                item, text = self.owner[there], owner[here]
                diagonal = (there - self.first[item]) - (here - first[text])
                found.append(np.unique(np.stack([text, item, diagonal], axis=1), axis=0))
                a = b
        return np.unique(np.concatenate(found), axis=0)

    def stretch(self, words: np.ndarray, item: int, diagonal: int) -> tuple[int, int, int]:
        """(length, start in text, equal words) of the longest good stretch on a diagonal."""
        theirs = self.words[self.first[item] : self.first[item] + self.counts[item]]
        lo, hi = max(0, -diagonal), min(len(words), len(theirs) - diagonal)
        equal = words[lo:hi] == theirs[lo + diagonal : hi + diagonal]
        # a stretch [i, j) is good if the cost at j is not above that at i
        cost = np.concatenate(([0], np.cumsum(np.where(equal, -1, ONE_IN - 1))))
        least = np.minimum.accumulate(cost[::-1])[::-1]
        last = np.searchsorted(least, cost, side="right") - 1
        start = int(np.argmax(last - np.arange(len(cost))))
        length = int(last[start]) - start
        return length, lo + start, int(equal[start : start + length].sum())

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, words, equal words, start) for each contaminated pair."""
        for row, _, data, offsets in pieces(texts):
            words, counts = word_hashes(data, offsets)
            first = np.cumsum(counts) - counts
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for text, item, diagonal in self.diagonals(words, counts).tolist():
                own = words[first[text] : first[text] + counts[text]]
                length, start, equal = self.stretch(own, item, diagonal)
                if length >= min(MIN_WORDS, int(self.counts[item])):
                    best[text, item] = max(best.get((text, item), (0, 0, 0)), (length, equal, -start))
            for (text, item), (length, equal, start) in best.items():
                yield row + text, item, length, equal, -start


def _blocks(benchmark: DataFrame) -> Iterator[tuple[Block, bool]]:
    """Blocks one after another, and whether each is the last; one item more than a block holds is read ahead."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    size = F.greatest(words, F.coalesce(F.octet_length("text"), F.lit(0)) / WORD_BYTES).cast("long")
    rows = benchmark.select("item_id", "text", size.alias("n")).toLocalIterator()
    row = next(rows, None)
    while row is not None:
        items, texts, held = [], [], 0
        while row is not None and held < BLOCK_WORDS:
            items.append(row["item_id"])
            texts.append(row["text"])
            held += row["n"] + 8
            row = next(rows, None)
        yield Block(items, texts), row is None


def _shared_blocks(spark: SparkSession, benchmark: DataFrame) -> Iterator[tuple[Broadcast, bool]]:
    """Each block as a broadcast, and whether it is the only one; if not, it is released before the next is read."""
    alone = True
    for block, last in _blocks(benchmark):
        alone = alone and last
        shared = spark.sparkContext.broadcast(block)
        del block
        yield shared, alone
        if not alone:
            shared.destroy()


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, n_equal, start_word): each document with each item it leaks.

    n_words and n_equal describe the longest stretch; start_word is its place in the document.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_words long, n_equal long, start_word long"
    out = spark.createDataFrame([], schema)
    columns = docs.select(F.col("doc_id").cast("long"), "text")
    for shared, alone in _shared_blocks(spark, benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for batch in batches:
                rows = list(held.matches(batch.column(1)))
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                rest = [pa.array([held.items[r[1]] for r in rows], pa.int64())] + [pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays([ids, *rest], names=["doc_id", "item_id", "n_words", "n_equal", "start_word"])

        found = columns.mapInArrow(run, schema)
        out = out.unionByName(found if alone else as_table(found, "leaks"))
    longest = F.max(F.struct("n_words", "n_equal", (-F.col("start_word")).alias("back"))).alias("m")
    best = out.groupBy("doc_id", "item_id").agg(longest)
    return best.select("doc_id", "item_id", "m.n_words", "m.n_equal", (-F.col("m.back")).alias("start_word"))


def _clean(shared: Broadcast) -> Callable[[str], Column]:
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        leaks = {row for row, *_ in shared.value.matches(texts)}
        return pa.array([i not in leaks for i in range(len(texts))], pa.bool_())

    return clean


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that leak a benchmark item; rows without an id are judged by text."""
    for shared, alone in _shared_blocks(docs.sparkSession, benchmark):
        docs = docs.where(_clean(shared)("text"))
        if not alone:
            docs = as_table(docs, "clean")
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated_pairs(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
