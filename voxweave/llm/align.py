"""Cross-tokenizer alignment: which tokens of two tokenizers share bytes, corpus-wide.

Each text is encoded by a byte-level BPE (A, after a space) and a sentencepiece BPE (B, which
adds one). Byte offsets where tokens of both end cut them into groups, and every A-B pair of
occurrences in a group is a link. An id pair's count is the number of documents that hold it.

Postings cogroup:

1. Tasks encode documents in chunks. Both tokenizers cut a text at each single space between other
   characters, so a text is a row of units that are encoded and aligned once each (`SPLIT`).
   A chunk gives its documents' own numbers, its postings (A id, B id, document, multiplicity)
   dealt by A id, and its pairs' document counts, which are combined before they leave the task. All are written once.
2. Counts are summed per pair, and the highest per A id is marked; the table is bounded by the two vocabularies.
3. Counts and postings meet by A id in streams that Spark sorts and may spill: a task holds the
   counts of one slice of A ids, then reads postings, whose number has no bound. Slices are
   split further by a salt of the chunk, which grows with the postings, so a frequent A id is in many
   cells; each cell gets the slice's counts. Contributions are summed per chunk and added up by chunk.

Defined cases: a null or empty text, or one whose tokens' bytes differ from space and text, has no tokens:
zeros, and '' for the hash; strings of special tokens in texts are plain text; repeated rows are
documents of their own; a null doc_id stays one; an empty table gives no rows; columns other than doc_id and text
are ignored. A single run without a safe space is encoded whole, and must fit in a task.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_table

TOKENIZERS = "/opt/tokenizers"
#: A space between two characters that are no white space: no token of A or B reaches over its left edge.
SPLIT = re.compile(r"(?<=\S) (?=\S)")
#: Slices of A ids. Bytes of postings a cell of slice and salt, and the least number of salts.
SLICES, CELL, SALTS = 32, 8 << 20, 4
#: A chunk ends after so many characters or documents; units stay known up to so many, if short.
CHUNK_CHARS, CHUNK_DOCS, KNOWN, SHORT = 1 << 20, 4096, 300_000, 64
#: Links of a group up to which they are listed one by one.
WIDE = 4096
#: Pairs whose counts a task holds before they leave it.
HELD = 1 << 20
B_BITS = 15


class Aligner:
    """Both tokenizers, and what is known of units: ids, numbers of groups and links, and pairs."""

    def __init__(self, folder: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(str(Path(folder, "byte_bpe_50k.json")))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=str(Path(folder, "piece_bpe_32k.model")))
        self.a_bytes = _byte_level(json.loads(Path(folder, "byte_bpe_50k.json").read_text(encoding="utf-8")))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if len(pieces) > 1 << B_BITS or any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("the piece vocabulary has too many pieces, or one with a space inside")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in table]) for table in (self.a_bytes, self.b_bytes))
        most = np.arange(max(len(self.a_bytes), len(self.b_bytes)))[:, None]
        power = 10 ** np.arange(4, -1, -1)
        #: five places, empty ones zero
        self.digits = np.where((most >= power) | (power == 1), 48 + most // power % 10, 0).astype(np.uint8)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.units: list[str] = []
        self.texts: list[bytes] = []
        #: n_a, n_b, n_groups, n_links, valid, pairs of each unit; all units' pairs and multiplicities
        self.numbers = np.zeros((0, 6), np.int64)
        self.pair, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, text: str) -> list[int]:
        """The text's units by their place; new ones are encoded by fresh()."""
        index, units = self.index, self.units
        out = []
        for u in SPLIT.split(text):
            i = index.get(u)
            if i is None:
                i = len(units)
                units.append(u)
                index[u] = i
            out.append(i)
        return out

    def fresh(self) -> None:
        new, done = self.units[len(self.texts) :], [(self.numbers, self.pair, self.times)]
        for at in range(0, len(new), 1 << 14):
            done.append(self._aligned(new[at : at + (1 << 14)]))
        self.numbers, self.pair, self.times = (np.concatenate(x) for x in zip(*done))

    def _aligned(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, pairs, multiplicities) of some units; their groups are added to texts."""
        a = [e.ids for e in self.a.encode_batch([" " + u for u in units], add_special_tokens=False)]
        b = self.b.encode(units, num_threads=1)
        valid = np.ones(len(units), bool)
        whole = [(" " + u).encode() for u in units]
        for ids, table in ((a, self.a_bytes), (b, self.b_bytes)):
            if b"".join([table[i] for x in ids for i in x]) != b"".join(whole):
                valid &= [b"".join([table[i] for i in x]) == w for x, w in zip(ids, whole)]
        if not valid.all():
            a, b, whole = ([x if ok else x[:0] for x, ok in zip(side, valid)] for side in (a, b, whole))
        size = np.array([len(w) for w in whole])
        unit_end = np.cumsum(size)
        marks, sides = [np.zeros(int(size.sum()) + 1, bool) for _ in "ab"], []
        for ids, lengths, mark in ((a, self.a_lengths, marks[0]), (b, self.b_lengths, marks[1])):
            n = np.array([len(x) for x in ids])
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
            ends = np.cumsum(lengths[flat])
            mark[ends] = True
            sides.append((n, flat, ends))
        cuts = np.flatnonzero(marks[0] & marks[1])
        (n_a, flat_a, ends_a), (n_b, flat_b, ends_b) = sides
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        wide_a, wide_b = (np.bincount(g, minlength=len(cuts)) for g in (group_a, group_b))
        unit = np.searchsorted(unit_end, cuts)
        links = wide_a * wide_b
        if len(links) and int(links.max()) > WIDE:
            # ids of such a group are counted before they are paired
            narrow, keys, times = links <= WIDE, [], []
            for g in np.flatnonzero(~narrow):
                (x, n), (y, m) = (np.unique(flat[group == g], return_counts=True) for flat, group in ((flat_a, group_a), (flat_b, group_b)))
                keys.append((unit[g] << 32 | x[:, None] << B_BITS | y).reshape(-1))
                times.append((n[:, None] * m).reshape(-1))
        else:
            narrow, keys, times = None, [], []
        first_b = np.cumsum(wide_b) - wide_b
        mine = np.arange(len(flat_a)) if narrow is None else np.flatnonzero(narrow[group_a])
        many = wide_b[group_a[mine]]
        right = np.repeat(first_b[group_a[mine]] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        left = np.repeat(mine, many)
        key, n = np.unique(unit[group_a[left]] << 32 | flat_a[left] << B_BITS | flat_b[right], return_counts=True)
        if keys:
            # a unit may have the same pair in narrow and in wide groups
            key, place = np.unique(np.concatenate([key, *keys]), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, place, np.concatenate([n, *times]))
            n = total
        self._spell(flat_a, group_a, flat_b, group_b, n_a, n_b)
        exact_links = np.zeros(len(units), np.int64)
        np.add.at(exact_links, unit, links)
        pairs = np.bincount(key >> 32, minlength=len(units))
        return np.stack([n_a, n_b, np.bincount(unit, minlength=len(units)), exact_links, valid, pairs], axis=1).astype(np.int64), key & 0xFFFFFFFF, n

    def _spell(self, flat_a, group_a, flat_b, group_b, n_a, n_b) -> None:
        """Each unit's groups as text: a token's digits and what separates it from the next, a row of bytes each."""
        at_a = np.arange(len(flat_a)) + np.searchsorted(group_b, group_a)
        at_b = np.arange(len(flat_b)) + np.searchsorted(group_a, group_b, side="right")
        ids = np.zeros(len(flat_a) + len(flat_b), np.int64)
        ids[at_a], ids[at_b] = flat_a, flat_b
        rows = np.zeros((len(ids), 6), np.uint8)
        rows[:, :5] = self.digits[ids]
        comma, bar, semicolon = b",|;"
        rows[:, 5] = comma
        for at, group, sign in ((at_a, group_a, bar), (at_b, group_b, semicolon)):
            if len(group):
                rows[at[np.append(group[1:] != group[:-1], True)], 5] = sign
        shown = rows > 0
        text, size = rows[shown].tobytes(), shown.sum(axis=1)
        ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum(n_a + n_b)]
        start = 0
        for e in ends.tolist():
            self.texts.append(text[start : e - 1] if e > start else b"")
            start = e

    def forget(self) -> None:
        """Start anew where too much is known, or something long."""
        if len(self.units) > KNOWN or any(len(u) > SHORT * 64 for u in self.units[-4096:]):
            self.clear()


def _byte_level(model: dict) -> list[bytes]:
    """Bytes of each id: entries spell bytes as printable characters, the others as those from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    out = [b""] * (1 + max(model["model"]["vocab"].values()))
    for entry, i in model["model"]["vocab"].items():
        out[i] = bytes(spelt[c] for c in entry) if all(c in spelt for c in entry) else entry.encode()
    return out


@lru_cache(maxsize=2)
def _aligner(folder: str) -> Aligner:
    return Aligner(folder)


ENCODED = "kind int, chunk long, slice int, doc_id array<long>, numbers array<long>, sha array<string>, keys binary, docs binary, times binary"


class _Counts:
    """Documents of each pair, combined as they come."""

    def __init__(self):
        self.keys, self.n, self.held = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(keys)
        self.n.append(n)
        self.held += len(keys)
        if self.held > 2 * len(self.keys[0]) + HELD // 4:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = np.concatenate(self.keys), np.concatenate(self.n)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.n = [keys[first]], [np.add.reduceat(n, first) if len(first) else n]
        self.held = 0
        return self.keys[0], self.n[0]


def _row(**parts) -> dict:
    return {k: parts.get(k) for k in ("kind", "chunk", "slice", "doc_id", "numbers", "sha", "keys", "docs", "times")}


def _encode(folder: str):
    """Chunks of documents to rows of kind 0 (documents), 1 (postings) and 2 (document counts of pairs)."""
    schema = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("slice", pa.int32()), ("doc_id", pa.list_(pa.int64())), ("numbers", pa.list_(pa.int64())), ("sha", pa.list_(pa.string())), ("keys", pa.binary()), ("docs", pa.binary()), ("times", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, chunk = _aligner(folder), _Counts(), TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        def done() -> pa.RecordBatch:
            nonlocal chunk, held
            out = pa.RecordBatch.from_pylist(_chunk(known, counts, chunk, ids, texts), schema=schema)
            chunk, held = chunk + 1, 0
            ids.clear()
            texts.clear()
            return out

        for batch in batches:
            column = batch.column(1).cast(pa.binary() if pa.types.is_string(batch.column(1).type) else pa.large_binary())
            for doc_id, raw in zip(batch.column(0).to_pylist(), column):
                raw = raw.as_py()
                ids.append(doc_id)
                # what is no UTF-8 can't come back from tokens
                texts.append(raw.decode() if raw and _is_text(raw) else None)
                held += len(raw or b"")
                if held >= CHUNK_CHARS or len(ids) >= CHUNK_DOCS:
                    yield done()
                    if len(counts.keys[0]) > HELD:
                        yield pa.RecordBatch.from_pylist(_count_rows(counts), schema=schema)
        if ids:
            yield done()
        yield pa.RecordBatch.from_pylist(_count_rows(counts), schema=schema)

    return run


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _count_rows(counts: _Counts) -> list[dict]:
    keys, n = counts.merge()
    counts.__init__()
    return [_row(kind=2, keys=keys.tobytes(), times=n.tobytes())] if len(keys) else []


def _chunk(known: Aligner, counts: _Counts, chunk: int, ids: list, texts: list) -> list[dict]:
    units = [np.array(known.of(t) if t else [], np.int64) for t in texts]
    known.fresh()
    lengths = np.array([len(u) for u in units])
    flat, doc = np.concatenate(units), np.repeat(np.arange(len(units)), lengths)
    # one invalid unit leaves its document without tokens: both encodings never lengthen a text
    valid = np.ones(len(units), bool)
    valid[doc[known.numbers[flat, 4] == 0]] = False
    flat, doc = flat[valid[doc]], doc[valid[doc]]
    numbers = np.zeros((len(units), 4), np.int64)
    for k in range(4):
        np.add.at(numbers[:, k], doc, known.numbers[flat, k])
    sha = [hashlib.sha256(b";".join([known.texts[i] for i in u.tolist()])).hexdigest() if ok and len(u) else "" for u, ok in zip(units, valid)]
    rows = [_row(kind=0, chunk=chunk, doc_id=ids, numbers=numbers.reshape(-1).tolist(), sha=sha)]
    if len(flat):
        # distinct units of each document, then their pairs
        both, times = np.unique(doc * len(known.units) + flat, return_counts=True)
        doc, flat = both // len(known.units), both % len(known.units)
        n = known.numbers[:, 5]
        first, size = (np.cumsum(n) - n)[flat], n[flat]
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        key, m, doc = known.pair[at], known.times[at] * np.repeat(times, size), np.repeat(doc, size)
        # by slice of A ids, then pair, then document
        order_key = ((key >> B_BITS) % SLICES) << 48 | key << 16 | doc
        order = np.argsort(order_key)
        order_key, m = order_key[order], m[order]
        first = np.flatnonzero(np.concatenate(([True], order_key[1:] != order_key[:-1])))
        order_key, m = order_key[first], np.add.reduceat(m, first)
        pair = order_key >> 16
        starts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        counts.add((pair[starts] & 0xFFFFFFFF).astype(np.uint32), np.diff(np.append(starts, len(pair))))
        # a byte a multiplicity: larger ones take several entries, which add up
        entries = -(-m // 255)
        if (entries > 1).any():
            order_key, left = np.repeat(order_key, entries), np.repeat(m, entries)
            nth = np.arange(len(left)) - np.repeat(np.cumsum(entries) - entries, entries)
            m = np.minimum(left - 255 * nth, 255)
        bounds = np.searchsorted(order_key, np.arange(SLICES + 1) << 48)
        for s in range(SLICES):
            part = order_key[bounds[s] : bounds[s + 1]]
            if len(part):
                pair = (part >> 16 & 0xFFFFFFFF).astype(np.uint32)
                step = np.diff(pair, prepend=np.uint32(0))
                rows.append(_row(kind=1, chunk=chunk, slice=s, keys=step.tobytes(), docs=(part & 0xFFFF).astype(np.uint16).tobytes(), times=m[bounds[s] : bounds[s + 1]].astype(np.uint8).tobytes()))
    known.forget()
    return rows


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts of pairs, a row each."""
    for batch in batches:
        for keys, n in zip(batch.column(0), batch.column(1)):
            keys, n = np.frombuffer(keys.as_py(), np.uint32), np.frombuffer(n.as_py(), np.int64)
            for at in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)].astype(np.int64)), pa.array(n[at : at + (1 << 16)])], names=["pair", "n"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by slice, packed: rows of (slice, keys, counts, whether highest)."""
    for batch in batches:
        s, pair, n, best = (np.asarray(batch.column(i)) for i in range(4))
        order = np.argsort(s, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(s[order])) + 1) if len(order) else ():
            cells = [pa.array([int(s[part[0]])], pa.int32()), *(pa.array([x[part].astype(t).tobytes()], pa.binary()) for x, t in ((pair, np.uint32), (n, np.int64), (best, np.uint8)))]
            yield pa.RecordBatch.from_arrays(cells, names=["slice", "keys", "docs", "times"])


def _contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of (slice, salt): counts first, then postings; a row of contributions for each posting row."""
    cell, gathered, keys, n, best = None, [], None, None, None
    for batch in batches:
        for s, salt, kind, chunk, k, d, t in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if (s, salt) != cell:
                cell, gathered, keys = (s, salt), [], None
            k = np.frombuffer(k, np.uint32)
            if kind == 0:
                gathered.append((k, np.frombuffer(d, np.int64), np.frombuffer(t, np.uint8)))
                continue
            if keys is None:
                keys, n, best = (np.concatenate(x) for x in zip(*gathered))
                order = np.argsort(keys)
                keys, n, best, gathered = keys[order], n[order], best[order].astype(np.int64), []
            place = np.searchsorted(keys, np.cumsum(k, dtype=np.uint32))
            docs, times = np.frombuffer(d, np.uint16), np.frombuffer(t, np.uint8).astype(np.int64)
            order = np.argsort(docs, kind="stable")
            docs, place, times = docs[order], place[order], times[order]
            first = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
            cols = [docs[first], np.add.reduceat(times * best[place], first), np.add.reduceat(times * n[place], first)]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in cols)], names=["chunk", "docs", "best", "total"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk: its documents (their row first), then contributions, added up."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    held, best, total = None, None, None

    def out() -> pa.RecordBatch:
        ids, numbers, sha = held
        numbers = np.array(numbers, np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(numbers[:, k]) for k in range(4)), pa.array(best), pa.array(total), pa.array(sha, pa.string())], names=names)

    for batch in batches:
        for ids, numbers, sha, docs, b, t in zip(*(batch.column(i).to_pylist() for i in range(2, 8))):
            if ids is not None:
                if held:
                    yield out()
                held, best, total = (ids, numbers, sha), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            else:
                docs = np.frombuffer(docs, np.uint16)
                best[docs] += np.frombuffer(b, np.int64)
                total[docs] += np.frombuffer(t, np.int64)
    if held:
        yield out()


def align(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = as_table(texts.mapInArrow(_encode(tokenizers), ENCODED), "align-encoded")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = pair_counts(encoded)
    packed = pairs.select(F.pmod("a", F.lit(SLICES)).cast("int").alias("slice"), "pair", "n", F.col("best").cast("int").alias("best"))
    packed = as_table(packed.repartition(SLICES, "slice").mapInArrow(_packed, "slice int, keys binary, docs binary, times binary"), "align-counts")

    postings = encoded.where("kind = 1")
    size = postings.agg(F.sum(F.length("keys") + F.length("docs") + F.length("times"))).first()[0] or 0
    salts = max(SALTS, size // (SLICES * CELL) + 1)
    salt = F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int").alias("salt")
    cells = postings.select("slice", salt, F.lit(1).alias("kind"), "chunk", "keys", "docs", "times").unionByName(
        packed.select("slice", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("chunk"), "keys", "docs", "times")
    )
    streams = cells.repartition(max(parts, SLICES * salts), "slice", "salt").sortWithinPartitions("slice", "salt", "kind")
    shares = streams.mapInArrow(_contribute, "chunk long, docs binary, best binary, total binary")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "array<long>"), ("numbers", "array<long>"), ("sha", "array<string>"))]
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("docs", "best", "total")]
    heads = encoded.where("kind = 0").select("chunk", F.lit(0).alias("kind"), "doc_id", "numbers", "sha", *nothing)
    both = heads.unionByName(shares.select("chunk", F.lit(1).alias("kind"), *none, "docs", "best", "total"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return both.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(_summed, schema)


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(pair, a, b, n, best): documents of each linked id pair; best: none of its A id has more."""
    rows = encoded.where("kind = 2").select("keys", "times").mapInArrow(_unpacked, "pair long, n long")
    sums = rows.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", B_BITS))
    # an A id has as many rows as B ids at most
    best = F.col("n") == F.max("n").over(Window.partitionBy("a"))
    return sums.select("pair", "a", F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b"), "n", best.alias("best"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded by both tokenizers and aligned."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
