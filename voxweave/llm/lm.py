"""Language-model scores by masked pseudo-likelihood.

A window network predicts each word from the two words on either side of it:
context words are embedded, scaled by position, summed and squashed. From that hidden state one
softmax gives the word's class, and a second one, with weights of its own for each class, the
cell within the class. Classes are cut from the frequency order so that each has about an equal share of
all words; a class of up to CELLS words has a cell for each word, so there the network predicts the
word itself; larger classes have CELLS cells, equal in words, within which a word has its share by its own
count. A document's score is the sum over its words of log P(word | both sides).

Everything is learned here, from all documents. Every word (by a 64-bit hash) has its own
count over the whole corpus, in a table that is never gathered. The HEAVY most frequent words,
which make up most of the text, travel as one array to the tasks; the counts of all others are
joined to the words of each block of documents. Frequent words have embeddings of their own as
context, the others share a quarter or more of the table. Up to VOCABULARY words there are BUCKETS embeddings;
beyond, they grow with the cube root of the number of words. WIDTH, CLASSES and CELLS are fixed.
Training runs in the tasks that hold the data: in each of ROUNDS rounds every partition starts
from the shared weights and does stochastic gradient steps over its documents (a round's
targets are every ROUNDS-th word of each document, and the rounds' targets together are all words,
each once), and the partitions' weights are averaged by the number of their targets. What
is gathered is one weight vector a partition, added up in slices as it streams in, and how
many words have each count (less than the root of twice the words of the corpus).
Sums are in fixed point, so the order of arrival does not matter; another partitioning of the
input trains other weights, and gives other scores.

Defined cases: a null or blank text has n_words 0, sum_logp 0 and mean_logp null; a word
next to a text's end has an end mark as context; all words that the training documents lack count
as one unseen word; repeated rows count and score as
rows; a corpus without words leaves the first weights; an empty table gives no rows;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_table
from .tokens import pieces, word_hashes

VOCABULARY = 1 << 15  # up to so many words the tables have their least sizes
BUCKETS = 1 << 12
EDGE = 0  # the context beyond either end
CLASSES, CELLS, WIDTH, SIDE = 32, 32, 16, 2
HEAVY = 1 << 16  # words whose counts are sent to the tasks
ROUNDS, MINIBATCH, RATE = 2, 4096, 0.1
_FIXED = float(1 << 16)
_SLICE = 2048
_BLOCK = 1 << 24  # bytes of text
_PART = 1 << 13
_SPAN = 2 * SIDE
_ROWS = 256

Weights = dict[str, np.ndarray]


def slots_for(words: int) -> int:
    """Context embeddings for a number of different words."""
    return round(BUCKETS * max(1.0, words / VOCABULARY) ** (1 / 3))


def shapes(slots: int) -> dict[str, tuple[int, ...]]:
    return {"embed": (slots + 1, WIDTH), "scale": (_SPAN, WIDTH), "hidden": (WIDTH,), "out": (WIDTH, CLASSES), "bias": (CLASSES,), "cells": (CLASSES, WIDTH, CELLS), "cell_bias": (CLASSES, CELLS)}


def first_weights(mass: np.ndarray, slots: int = BUCKETS) -> Weights:
    """Small random weights; the biases start from the shares of classes and cells (mass: CLASSES x CELLS)."""
    rng = np.random.default_rng(0)
    out = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in shapes(slots).items()}
    out["scale"][:] = 1
    out["hidden"][:] = 0
    of_class = mass.sum(axis=1)
    out["bias"] = np.log(of_class / of_class.sum() + 1e-6).astype(np.float32)
    out["cell_bias"] = np.log(mass / np.maximum(of_class, 1)[:, None] + 1e-6).astype(np.float32)
    return out


def pack(w: Weights) -> np.ndarray:
    return np.concatenate([v.ravel() for v in w.values()])


def unpack(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k, shape in ((k, v.shape) for k, v in like.items()):
        n = int(np.prod(shape))
        out[k] = flat[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def contexts(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Context embeddings of every word, one column for each of its four neighbours."""
    n = len(ids)
    owner = np.repeat(np.arange(len(counts)), counts)
    padded = np.concatenate([np.full(SIDE, EDGE), ids.astype(np.int64), np.full(SIDE, EDGE)])
    owners = np.concatenate([np.full(SIDE, -1), owner, np.full(SIDE, -1)])
    cols = []
    for off in [*range(-SIDE, 0), *range(1, SIDE + 1)]:
        at = slice(SIDE + off, SIDE + off + n)
        cols.append(np.where(owners[at] == owner, padded[at], EDGE))
    return np.stack(cols, axis=1) if n else np.zeros((0, _SPAN), np.int64)


def targets(counts: np.ndarray, turn: int) -> np.ndarray:
    """Which words a round predicts: of each document those whose position leaves `turn` modulo ROUNDS."""
    n = int(counts.sum())
    place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.flatnonzero(place % ROUNDS == turn)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b by stacks of _ROWS rows: products so small stay in the task's own thread, whereas for
    larger ones the BLAS starts threads that wait in busy loops and take CPU from other tasks."""
    out, n = np.empty((len(a), b.shape[1]), np.float32), len(a) // _ROWS * _ROWS
    np.matmul(a[:n].reshape(-1, _ROWS, a.shape[1]), b, out=out[:n].reshape(-1, _ROWS, b.shape[1]))
    np.matmul(a[n:], b, out=out[n:])
    return out


def _crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b, by stacks as well."""
    n = len(a) // _ROWS * _ROWS
    stacks = a[:n].reshape(-1, _ROWS, a.shape[1]).transpose(0, 2, 1) @ b[:n].reshape(-1, _ROWS, b.shape[1])
    return stacks.sum(axis=0) + a[n:].T @ b[n:]


def hidden(w: Weights, ctx: np.ndarray) -> np.ndarray:
    h = w["hidden"] + sum(w["embed"][ctx[:, k]] * w["scale"][k] for k in range(_SPAN))
    return np.tanh(h)


def _softmax(logits: np.ndarray) -> np.ndarray:
    """In place, over the last axis."""
    logits -= logits.max(axis=-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= np.einsum("...k->...", logits)[..., None]
    return logits


def _in_class(w: Weights, h: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hidden states by class, place of each word in its class, P(cell | class) by class and place).

    Classes have about equal shares of the words, so few of the places by class stay empty.
    """
    order = np.argsort(kinds.astype(np.int16), kind="stable")
    many = np.bincount(kinds, minlength=CLASSES)
    place = np.empty(len(kinds), np.int64)
    place[order] = np.arange(len(kinds)) - np.repeat(np.cumsum(many) - many, many)
    states = np.zeros((CLASSES, int(many.max()), WIDTH), np.float32)
    states[kinds, place] = h
    return states, place, _softmax(states @ w["cells"] + w["cell_bias"][:, None, :])


def cell_logp(w: Weights, ctx: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """log P(cell of the word | its context); cell = class * CELLS + place in the class."""
    out = np.empty(len(cell), dtype=np.float64)
    for a in range(0, len(cell), _SLICE):
        kinds, subs = np.divmod(cell[a : a + _SLICE], CELLS)
        h = hidden(w, ctx[a : a + _SLICE])
        p = _softmax(_times(h, w["out"]) + w["bias"])[np.arange(len(kinds)), kinds]
        _, place, q = _in_class(w, h, kinds)
        out[a : a + _SLICE] = np.log(p.astype(np.float64)) + np.log(q[kinds, place, subs].astype(np.float64))
    return out


class Trainer:
    """Adagrad steps on one partition's targets."""

    def __init__(self, w: Weights) -> None:
        self.w = {k: v.copy() for k, v in w.items()}
        self.seen = {k: np.full(v.shape, 1e-3, np.float32) for k, v in w.items()}
        self.targets = 0

    def _step(self, name: str, grad: np.ndarray, at: np.ndarray | slice = slice(None)) -> None:
        self.seen[name][at] += grad * grad
        self.w[name][at] -= RATE * grad / np.sqrt(self.seen[name][at])

    def step(self, ctx: np.ndarray, cell: np.ndarray) -> None:
        w, n = self.w, len(cell)
        kinds, subs = np.divmod(cell, CELLS)
        rows = w["embed"][ctx]
        h = np.tanh(w["hidden"] + np.einsum("nkd,kd->nd", rows, w["scale"]))
        p = _softmax(_times(h, w["out"]) + w["bias"])
        p[np.arange(n), kinds] -= 1
        p /= n
        back = _times(p, w["out"].T)
        states, place, q = _in_class(w, h, kinds)
        q[kinds, place, subs] -= 1
        q /= n
        filled = np.zeros((*q.shape[:2], 1), np.float32)
        filled[kinds, place] = 1
        q *= filled
        back += (q @ w["cells"].transpose(0, 2, 1))[kinds, place]
        self._step("cells", states.transpose(0, 2, 1) @ q)
        self._step("cell_bias", q.sum(axis=1))
        back *= 1 - h * h
        each = (back[:, None, :] * w["scale"]).reshape(-1, WIDTH)
        flat = ctx.ravel()
        narrow = len(w["embed"]) <= 1 << 16  # sorted faster
        order = np.argsort(flat.astype(np.uint16) if narrow else flat, kind="stable")
        ids = flat[order]
        start = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        embed = np.add.reduceat(each[order], start, axis=0)
        scale = np.einsum("nkd,nd->kd", rows, back)
        self._step("out", _crossed(h, p))
        self._step("bias", p.sum(axis=0))
        self._step("hidden", back.sum(axis=0))
        self._step("scale", scale)
        self._step("embed", embed, ids[start])
        self.targets += n


_TOKENS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("at", pa.binary()), ("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
_ENCODED = pa.schema([*list(_TOKENS)[:4], ("cells", pa.binary()), ("slots", pa.binary()), ("n", pa.binary())])
_TOKENS_SQL = "block long, doc_ids array<long>, sizes array<long>, at binary, words array<long>, counts array<long>"
_ENCODED_SQL = "block long, doc_ids array<long>, sizes array<long>, at binary, cells binary, slots binary, n binary"


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 33
    for batch in batches:
        for a, b, data, offsets in pieces(batch.column(1), _BLOCK):
            hashes, sizes = word_hashes(data, offsets)
            coded = pa.array(hashes.view(np.int64)).dictionary_encode()
            words, at = coded.dictionary.to_numpy(), coded.indices.to_numpy()
            counts = np.bincount(at, minlength=len(words))
            packed = zstandard.ZstdCompressor(level=3).compress(at.astype("<u4").tobytes())
            row = [block, batch.column(0)[a:b].to_pylist(), sizes, packed, words, counts]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _TOKENS)], schema=_TOKENS)
            block += 1


def _rows(batch: pa.RecordBatch, *columns: tuple[str, str]) -> Iterator[tuple[np.ndarray, ...]]:
    """(sizes, index of each word, further columns of the block's different words) of the blocks."""
    for row in range(batch.num_rows):
        sizes = batch["sizes"][row].values.to_numpy(zero_copy_only=False)
        at = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch["at"][row].as_py()), dtype="<u4")
        yield sizes, at, *(np.frombuffer(batch[name][row].as_buffer(), dtype=kind) for name, kind in columns)


def _one(values: np.ndarray, n: int) -> pa.RecordBatch:
    parts = [values[a : a + _PART].astype("<i8").tobytes() for a in range(0, len(values), _PART)]
    cols = [pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary()), pa.array([n] * len(parts), pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=["part", "sums", "n"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each slice: the sum of its rows' vectors, taken one at a time."""
    total: dict[int, np.ndarray] = {}
    n: dict[int, int] = {}
    for batch in batches:
        for part, sums, k in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            values = np.frombuffer(sums.as_buffer(), dtype="<i8")
            total[part] = total[part] + values if part in total else values.copy()
            n[part] = n.get(part, 0) + k
    if total:
        cols = [pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary()), pa.array(list(n.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["part", "sums", "n"])


_SUMS = "part long, sums binary, n long"


def _total(parts: DataFrame, length: int) -> tuple[np.ndarray, int] | None:
    """The sum of a vector of `length` from each partition, added up by slices."""
    rows = parts.repartition(-(-length // _PART), "part").mapInArrow(_add, _SUMS).collect()  # one vector
    rows = sorted(rows, key=lambda r: r["part"])
    return (np.concatenate([np.frombuffer(bytes(r["sums"]), dtype="<i8") for r in rows]), rows[0]["n"]) if rows else None


class Places:
    """Class, cell and context embedding of any word from its hash and its count.

    Words are ranked by count; of the heavy words ties are in the order of their hashes, of the others
    the hash itself, spread evenly, says where in the tie a word is.
    """

    def __init__(self, n: np.ndarray, ties: np.ndarray, heavy: np.ndarray, heavy_n: np.ndarray) -> None:
        """n, ties: each count, most first, and how many words have it; heavy: the most frequent words."""
        mass = ties * (n + 1)
        self.n, self.ties, self.before, self.over = n, ties, np.cumsum(ties) - ties, np.cumsum(mass) - mass
        self.total = float(mass.sum() + 1)  # and the unseen word
        self.slots = slots_for(int(ties.sum()))
        order = np.argsort(heavy)
        self.heavy, self.heavy_n = heavy[order], heavy_n[order]
        rank = np.empty(len(heavy), np.int64)
        rank[np.lexsort((self.heavy, -self.heavy_n))] = np.arange(len(heavy))
        self.heavy_rank = rank
        whole = self.before + ties <= min(len(heavy), self.slots - self.slots // 4)
        self.own = int(ties[whole].sum())  # words with a context embedding of their own
        # the rank that each class starts from, and its words
        edge = np.arange(CLASSES) / CLASSES * self.total
        tie = np.clip(np.searchsorted(self.over, edge, side="right") - 1, 0, None)
        known = len(n) > 0
        first = self.before[tie] + np.minimum(((edge - self.over[tie]) / (n[tie] + 1)).astype(np.int64), ties[tie]) if known else np.zeros(CLASSES, np.int64)
        self.first, self.members = first, np.diff(np.append(first, int(ties.sum())))

    def counts(self, words: np.ndarray) -> np.ndarray:
        """Counts of the heavy ones among words; 0 for others."""
        if not len(self.heavy):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.heavy, words), len(self.heavy) - 1)
        return np.where(self.heavy[at] == words, self.heavy_n[at], 0)

    def of(self, words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, context embedding) of words with counts n."""
        cell = np.full(len(words), CLASSES * CELLS - 1, np.int64)
        slot = self.own + 1 + words % max(self.slots - self.own, 1)
        seen = np.flatnonzero(n > 0)
        if len(seen):
            word = words[seen]
            tie = np.searchsorted(-self.n, -n[seen])
            spread = np.floor(self.ties[tie] * (word / 2.0**64 + 0.5)).astype(np.int64)
            at = np.minimum(np.searchsorted(self.heavy, word), len(self.heavy) - 1)
            ranked = (self.heavy[at] == word) & (self.before[tie] + self.ties[tie] <= len(self.heavy))
            rank = np.where(ranked, self.heavy_rank[at] - self.before[tie], np.minimum(spread, self.ties[tie] - 1))
            share = (self.over[tie] + (rank + 1) * (self.n[tie] + 1)) / self.total
            kind = np.minimum((share * CLASSES).astype(np.int64), CLASSES - 1)
            sub = (self.before[tie] + rank - self.first[kind]) * CELLS // np.maximum(self.members[kind], CELLS)
            cell[seen] = kind * CELLS + np.clip(sub, 0, CELLS - 1)
            slot[seen] = np.where(self.before[tie] + rank < self.own, self.before[tie] + rank + 1, slot[seen])
        return cell, slot


@dataclass
class Vocabulary:
    """counted: (word, n), a row for each word of the corpus; mass: smoothed count of each cell."""

    counted: DataFrame
    places: Places
    mass: np.ndarray


class Model:
    """Trained weights and word classes."""

    def __init__(self, weights: Weights, vocabulary: Vocabulary, encoded: tuple[DataFrame, DataFrame], targets: int = 0) -> None:
        self.weights, self.vocabulary = weights, vocabulary
        self.encoded = encoded  # the training tokens, and the same with classes and counts
        self.targets = targets  # words predicted in training, over all rounds


def token_table(docs: DataFrame) -> DataFrame:
    """Blocks of documents with their different words, counted; written once and read in every pass."""
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return as_table(columns.mapInArrow(_to_blocks, _TOKENS_SQL), "lm-tokens")


def vocabulary(tokens: DataFrame) -> Vocabulary:
    """Count of every word, and how classes and cells are cut from the counts."""
    spark = tokens.sparkSession
    each = tokens.select(F.explode(F.arrays_zip("words", "counts")).alias("w"))
    counted = as_table(each.groupBy(F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n")), "lm-counts")
    ties = counted.groupBy("n").agg(F.count(F.lit(1)).alias("ties")).collect()  # fewer than sqrt(2 x words of the corpus)
    n, same = np.array(sorted(((r["n"], r["ties"]) for r in ties), reverse=True), dtype=np.int64).reshape(-1, 2).T
    heavy = counted.orderBy(F.col("n").desc(), "word").limit(HEAVY).toArrow()  # at most HEAVY rows
    places = Places(n, same, heavy["word"].to_numpy(), heavy["n"].to_numpy())
    shared = spark.sparkContext.broadcast(places)

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(CLASSES * CELLS, np.int64)
        for batch in batches:
            count = batch["n"].to_numpy()
            np.add.at(held, shared.value.of(batch["word"].to_numpy(), count)[0], count + 1)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["cell", "mass"])

    mass = np.zeros(CLASSES * CELLS, np.int64)
    for r in counted.mapInArrow(masses, "cell long, mass long").groupBy("cell").agg(F.sum("mass").alias("mass")).collect():  # one row a cell
        mass[r["cell"]] = r["mass"]
    mass[-1] += 1  # the unseen word
    return Vocabulary(counted, places, mass.reshape(-1, CELLS))


def encode(tokens: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Token blocks with cell, context embedding and count of their different words."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(vocab.places)

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        words = left["words"].combine_chunks().values.to_numpy(zero_copy_only=False)
        n = shared.value.counts(words)
        n[right["pos"].to_numpy()] = right["n"].to_numpy()
        cell, slot = shared.value.of(words, n)
        new = [n_.astype(t).tobytes() for n_, t in ((cell, "<i4"), (slot, "<i4"), (n, "<i8"))]
        cols = [left[k].combine_chunks() for k in ("block", "doc_ids", "sizes", "at")] + [pa.array([v], pa.binary()) for v in new]
        return pa.Table.from_arrays(cols, schema=_ENCODED)

    heavy = F.broadcast(spark.createDataFrame(pa.table({"word": vocab.places.heavy})))  # at most HEAVY rows
    words = tokens.select(F.col("block").alias("of"), F.posexplode("words").alias("pos", "word")).join(heavy, "word", "left_anti")
    words = words.join(vocab.counted, "word").select("of", "pos", "n")
    blocks = tokens.select("block", "doc_ids", "sizes", "at", "words").groupBy("block")
    return as_table(blocks.cogroup(words.groupBy("of")).applyInArrow(put, _ENCODED_SQL), "lm-encoded")


def train(tokens: DataFrame) -> Model:
    spark = tokens.sparkSession
    vocab = vocabulary(tokens)
    encoded = encode(tokens, vocab)
    weights, seen = first_weights(vocab.mass, vocab.places.slots), 0
    columns = encoded.select("sizes", "at", "cells", "slots")
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(shared.value)
            rng = np.random.default_rng(turn)
            for batch in batches:
                for counts, ids, cells, slots in _rows(batch, ("cells", "<i4"), ("slots", "<i4")):
                    at = targets(counts, turn)
                    ctx = contexts(slots[ids], counts)[at]
                    target = cells[ids[at]].astype(np.int64)
                    order = rng.permutation(len(at))
                    for a in range(0, len(order), MINIBATCH):
                        part = order[a : a + MINIBATCH]
                        trainer.step(ctx[part], target[part])
            if trainer.targets:
                yield _one(np.rint(pack(trainer.w).astype(np.float64) * trainer.targets * _FIXED), trainer.targets)

        total = _total(columns.mapInArrow(run, _SUMS), sum(v.size for v in weights.values()))
        if total:
            weights = unpack(total[0] / _FIXED / total[1], weights)
            seen += total[1]
    return Model(weights, vocab, (tokens, encoded), seen)


def score(tokens: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, sum_logp, mean_logp) for each document of a token table."""
    encoded = model.encoded[1] if tokens is model.encoded[0] else encode(tokens, model.vocabulary)
    shared = tokens.sparkSession.sparkContext.broadcast((model.weights, model.vocabulary.mass.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, mass = shared.value
        for batch in batches:
            for row, (counts, ids, cells, slots, n) in enumerate(_rows(batch, ("cells", "<i4"), ("slots", "<i4"), ("n", "<i8"))):
                within = np.log((n + 1) / mass[cells])
                logp = cell_logp(weights, contexts(slots[ids], counts), cells[ids].astype(np.int64)) + within[ids]
                logp = np.concatenate(([0.0], np.cumsum(logp)))
                end = np.cumsum(counts)
                sums = np.round(logp[end] - logp[end - counts], 4)
                yield pa.RecordBatch.from_arrays([batch["doc_ids"][row].values, pa.array(counts, pa.int64()), pa.array(sums, pa.float64())], names=["doc_id", "n_words", "sum_logp"])

    out = encoded.mapInArrow(run, "doc_id long, n_words long, sum_logp double")
    return out.withColumn("mean_logp", F.when(F.col("n_words") > 0, F.col("sum_logp") / F.col("n_words")))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by the network that is trained on all of them."""
    tokens = token_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return score(tokens, train(tokens))
