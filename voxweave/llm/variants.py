"""Spelling variants: words one edit apart, the frequent neighbour as a word's form.

1. Tasks cut texts into runs of letters, lower-case A-Z, delete a code point where the run's
   checksum says so, and count words before they leave the task; Spark sums them.
2. Letters are below U+0100, so a word is a row of bytes. Prefix and suffix polynomial hashes give the
   hash of each word without any one code point, in vector operations. Two words are near if one
   equals the other without a code point, or both are equal without the code point at one place.
3. Keys are radix-partitioned by the sum of hashes of the letters left: as a word has few different letters, it is
   sent with its string to few partitions, however long it is. There are so many partitions that
   each one's keys fit in a task; a key has at most (letters of the alphabet) x (length) words, as words are distinct.
   Keys are sorted, equal ones confirmed on the strings, and each word's neighbours
   counted group by group: the best of a group is the best of all its other members, so no pairs are made.
4. Roots are found by pointer doubling over forms; counts grow tenfold at each step, so chains are short.

Defined cases: null and empty texts have no words; a null doc_id is an empty string in the checksum;
repeated rows count each; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_table
from .tokens import _INVERSE, U64, mix64, powers, prefix

LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
DELETE_EVERY = 31
#: Words that a task counts before they leave it; words a block of keys is made of; bytes of keys a partition.
HELD, BLOCK, PARTITION = 200_000, 50_000, 6 << 20
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}")
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return batch

    for batch in batches:
        texts = batch.column(1).cast(pa.binary() if pa.types.is_string(batch.column(1).type) else pa.large_binary())
        for doc_id, text in zip(batch.column(0).to_pylist(), texts):
            raw = text.as_py()
            if not raw:
                continue
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            # in a lower-cased text a run of enough letters is a whole run
            for word, n in Counter(run.findall(raw.translate(_LOWER).decode("utf-8", "replace"))).items():
                h = zlib.crc32(word.encode(), start)
                if h % DELETE_EVERY == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < LEAST_LETTERS:
                        continue
                counts[word] += n
            if len(counts) >= HELD:
                yield out()
    yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words long and frequent enough."""
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_words, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def deletion_keys(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, hash, letters): a key for each word as it is (place -1) and without each code point.

    hash is that of the string left, and letters a sum of hashes of the code points left, in any order.
    """
    lengths = np.diff(offsets)
    word = np.repeat(np.arange(len(lengths)), lengths + 1)
    place = np.arange(len(word)) - np.repeat(offsets[:-1] + np.arange(len(lengths)), lengths + 1) - 1
    start, end = offsets[:-1][word], offsets[1:][word]
    sums, bag = prefix(flat), np.zeros(len(flat) + 1, U64)
    weights = mix64(flat.astype(U64) + U64(1))
    np.cumsum(weights, out=bag[1:])
    cut = np.where(place < 0, start, start + place)
    after = np.where(place < 0, start, cut + 1)
    tail = (sums[end] - sums[after]) * np.where(place < 0, U64(1), U64(_INVERSE))
    hashes = mix64((sums[cut] - sums[start] + tail) * powers(len(sums), _INVERSE)[start])
    letters = bag[end] - bag[start] - np.where(place < 0, U64(0), weights[np.minimum(cut, len(flat) - 1)])
    return word, place, hashes, mix64(letters)


def _dealt(parts: int):
    """(word, n) to packed keys: a row for each block and partition."""

    def block(words: list[bytes], n: np.ndarray) -> pa.RecordBatch:
        lengths = np.array([len(w) for w in words], np.int64)
        flat, offsets = np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], np.cumsum(lengths)))
        word, place, hashes, letters = deletion_keys(flat, offsets)
        to = (letters % U64(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        rows = []
        bounds = np.searchsorted(to[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(bounds)):
            keys = order[bounds[p] : bounds[p + 1]]
            used, ref = np.unique(word[keys], return_inverse=True)
            rows.append((int(p), b"".join([words[i] for i in used.tolist()]), lengths[used].astype(np.uint32).tobytes(), n[used].tobytes(), ref.astype(np.uint32).tobytes(), place[keys].astype(np.int32).tobytes(), hashes[keys].tobytes()))
        names = ["part", "words", "lengths", "n", "ref", "place", "hash"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, held = [], [], 0
        for batch in batches:
            for w in batch.column(0).to_pylist():
                words.append(w.encode("latin-1"))
                held += len(words[-1])
            n.append(np.asarray(batch.column(1)))
            if len(words) >= BLOCK or held >= BLOCK * 20:
                yield block(words, np.concatenate(n))
                words, n, held = [], [], 0
        if words:
            yield block(words, np.concatenate(n))

    return run


def _met(rows: list[tuple]) -> pa.RecordBatch:
    """All keys of a partition to (word, near, best_n, best): what each word meets here."""
    words: list[bytes] = []
    counts, refs, places, hashes = [], [], [], []
    for text, lengths, n, ref, place, key in rows:
        refs.append(np.frombuffer(ref, np.uint32).astype(np.int64) + len(words))
        ends = np.cumsum(np.frombuffer(lengths, np.uint32), dtype=np.int64)
        words += [text[a:b] for a, b in zip((ends - np.frombuffer(lengths, np.uint32)).tolist(), ends.tolist())]
        counts.append(np.frombuffer(n, np.int64))
        places.append(np.frombuffer(place, np.int32))
        hashes.append(np.frombuffer(key, U64))
    counts, ref, place, key = np.concatenate(counts), np.concatenate(refs), np.concatenate(places), np.concatenate(hashes)
    order = np.argsort(key)
    key = key[order]
    equal = key[1:] == key[:-1]
    shared = np.concatenate((equal, [False])) | np.concatenate(([False], equal))
    key, order = key[shared], order[shared]
    ref, place = ref[order], place[order]
    # the strings decide: groups are runs of equal keys whose strings are equal too
    left = [words[r] if p < 0 else words[r][:p] + words[r][p + 1 :] for r, p in zip(ref.tolist(), place.tolist())]
    group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    split = {int(group[k]) for k in range(1, len(left)) if group[k] == group[k - 1] and left[k] != left[k - 1]}
    if split:
        names: dict[tuple[int, bytes], int] = {}
        top = int(group[-1]) + 1
        group = np.array([names.setdefault((g, s), top + len(names)) if (g := int(group[k])) in split else g for k, s in enumerate(left)])
    own = np.array([words[r][p] if p >= 0 else 0 for r, p in zip(ref.tolist(), place.tolist())], np.int64)
    starts_run = np.array([p <= 0 or words[r][p - 1] != words[r][p] for r, p in zip(ref.tolist(), place.tolist())], bool)
    order = np.lexsort((own, -counts[ref], place, group))
    group, place, ref, starts_run = group[order], place[order], ref[order], starts_run[order]
    out_word, out_near, out_best = [], [], []
    if len(group):
        # replaced: words equal without the code point at one place; the first has most occurrences
        edge = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (place[1:] != place[:-1]))))
        size = np.diff(np.append(edge, len(group)))
        several = (size > 1) & (place[edge] >= 0)
        at = np.repeat(edge[several], size[several])
        inside = np.concatenate([np.arange(a, a + s) for a, s in zip(edge[several], size[several])]) if several.any() else np.zeros(0, np.int64)
        out_word.append(ref[inside])
        out_near.append(np.repeat(size[several] - 1, size[several]))
        out_best.append(ref[np.where(inside == at, at + 1, at)])
        # inserted or deleted: a whole word and those that are equal to it without a code point, once for a run of equal ones
        whole = np.full(int(group.max()) + 1, -1, np.int64)
        whole[group[place < 0]] = ref[place < 0]
        longer = np.flatnonzero((place >= 0) & starts_run & (whole[group] >= 0))
        one, other = ref[longer], whole[group[longer]]
        out_word += [one, other]
        out_near += [np.ones(len(one), np.int64)] * 2
        out_best += [other, one]
    word, near, best = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_word, out_near, out_best))
    say = lambda ids: pa.array([words[i].decode("latin-1") for i in ids.tolist()], pa.string())
    return pa.RecordBatch.from_arrays([say(word), pa.array(near, pa.int64()), pa.array(counts[best]), say(best)], names=["word", "near", "best_n", "best"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, rows = None, []
    for batch in batches:
        for p, *cells in zip(*(c.to_pylist() for c in batch.columns)):
            if p != part and rows:
                yield _met(rows)
                rows = []
            part = p
            rows.append(cells)
    if rows:
        yield _met(rows)


def neighbours(words: DataFrame, letters: int) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have any; letters: code points in all."""
    parts = max(8, letters * 30 // PARTITION + 1)
    keys = words.mapInArrow(_dealt(parts), "part int, words binary, lengths binary, n binary, ref binary, place binary, hash binary")
    met = keys.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_meet, "word string, near long, best_n long, best string")
    # most occurrences, then the first by code points
    first = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first")
    return met.groupBy("word").agg(F.sum("near").alias("n_near"), first).select("word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, form, root): forms followed to the last, twice as far in each round."""
    live = as_table(forms.select("word", "form", F.col("form").alias("root")), "variant-roots")
    while True:
        up = live.select(F.col("word").alias("at"), F.col("root").alias("upper"))
        further = live.join(up, live["root"] == up["at"], "left")
        nxt = as_table(further.select("word", "form", F.coalesce("upper", "root").alias("root"), F.col("upper").isNotNull().alias("moved")), "variant-roots")
        if nxt.where("moved").isEmpty():
            return nxt.select("word", "form", "root")
        live = nxt.select("word", "form", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = as_table(word_counts(docs), "variant-words")
    letters = words.agg(F.sum(F.length("word"))).first()[0] or 0
    near = neighbours(words, letters)
    enough = F.col("best_n") >= TIMES * F.col("n")
    known = as_table(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n")
        ),
        "variant-known",
    )
    ends = roots(known.where("form IS NOT NULL")).select("word", "root")
    return known.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents, with the forms they vary."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
