"""Language identification by sparse multinomial logistic regression on TF-IDF of character n-grams.

1. Document frequencies of hashed n-grams are counted over all labelled documents.
2. The classifier is fitted on a bounded sample: of each of the `LANGUAGES` most frequent languages the `A_LANGUAGE`
   labelled documents with the least hashes. Every `HOLD`th of them is kept for the temperature.
3. Follow-the-regularised-leader with elastic net: the sample is dealt over `PARTS` tasks, each
   takes its documents one by one from the shared state; states are averaged after each round.
   The L1 term leaves most weights at zero.
4. A temperature is chosen by least log loss on the documents kept back, and all documents are predicted.

An n-gram is of 1 to `ORDER` code points of the lower-cased text, in which all that is no letter is a space. Terms
weigh (1 + log count) * idf, and a document's vector has length one.

Defined cases: a null text, or one without letters, is `und` with score 0; a null lang is never learned from; a null
doc_id is an empty string in the checksum; if no language can be learned, all documents are `und` with score 0; repeated rows
are documents of their own; ties go to the first language by code points; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_table
from .tokens import U64, mix64

ORDER, BITS = 3, 15
DIM = 1 << BITS
#: The bound of the sample: languages, and documents of each.
LANGUAGES, A_LANGUAGE, HOLD = 256, 1000, 5
PARTS, ROUNDS = 8, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1e-4
#: Code points of a text that are looked at in one step; n-grams over the seam are counted too.
STEP = 1 << 18
TEMPERATURES = np.geomspace(0.05, 5, 93)
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each code point's value, that of a space if it is no letter; those beyond the last plane of letters are spaces."""
    table = np.full(0x40000, 32, np.uint32)
    for c in range(len(table)):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            table[c] = c
    return table


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text, in pieces; none if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    table = _letters()
    points = table[np.minimum(points, len(table) - 1)]
    if not (points != 32).any():
        return
    for at in range(0, len(points), STEP):
        part = points[at : at + STEP + ORDER - 1].astype(U64)
        value = np.zeros(len(part), U64)
        for n in range(ORDER):
            value = value[: len(part) - n] * U64(0x100000001B3) + part[n:] + U64(1)
            own = value[: max(0, min(STEP, len(part)))]
            yield (mix64(own) >> U64(64 - BITS)).astype(np.int64)
            if len(value) <= 1:
                break


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) of a text."""
    total = np.zeros(DIM, np.int64)
    for part in grams(text):
        total += np.bincount(part, minlength=DIM)
    seen = np.flatnonzero(total)
    return seen, total[seen]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, values): the text's TF-IDF vector of length one, or an empty one."""
    at, n = counted(text)
    value = (1 + np.log(n)) * idf[at]
    return at, (value / (np.sqrt((value * value).sum()) or 1)).astype(np.float64)


def _text(value: object) -> str:
    return "" if value is None else value.decode("utf-8", "replace") if isinstance(value, bytes) else value


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[str]:
    for x in batch.column(column).cast(pa.binary() if pa.types.is_string(batch.column(column).type) else pa.large_binary()):
        yield _text(x.as_py())


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each n-gram, counted within the task; n-gram -1 counts documents."""
    total, flag, docs = np.zeros(DIM, np.int64), np.zeros(DIM, bool), 0
    for batch in batches:
        for text in _texts(batch, 0):
            docs += 1
            for part in grams(text):
                flag[part] = True
            seen = np.flatnonzero(flag)
            total[seen] += 1
            flag[seen] = False
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], docs))], names=["gram", "n"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """log((1 + documents) / (1 + documents with the n-gram)) + 1 of each n-gram, over all texts."""
    rows = texts.select(F.col("text").cast("string")).mapInArrow(_frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    n = {r.gram: r.n for r in rows.collect()}  # as many as there are hashed n-grams at most
    docs = n.pop(-1, 0)
    found = np.zeros(DIM)
    found[list(n)] = list(n.values())
    return np.log((1 + docs) / (1 + found)) + 1


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of the state: zero where the gradients' sum is within L1."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _probabilities(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def learn(z: np.ndarray, n: np.ndarray, at: np.ndarray, value: np.ndarray, label: int) -> None:
    """One document's step, in place; the last row of z and n is the bias."""
    at, value = np.append(at, len(z) - 1), np.append(value, 1.0)
    w = _weights(z[at], n[at])
    p = _probabilities(value @ w)
    p[label] -= 1
    g = value[:, None] * p[None, :]
    sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
    z[at] += g - sigma * w
    n[at] += g * g


def _rounds(state, classes: int):
    """A partition's documents, one by one from the shared state; the new state, a row a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n = (np.array(x) for x in state.value)
        docs = 0
        for batch in batches:
            for label, at, value in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                learn(z, n, np.frombuffer(at.as_py(), np.int64), np.frombuffer(value.as_py(), np.float64), label)
                docs += 1
        if docs:
            rows = [(c, docs, z[:, c].tobytes(), n[:, c].tobytes()) for c in range(classes)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["class", "docs", "z", "n"])

    return run


def _averaged(table: pa.Table) -> pa.Table:
    """One language's states, averaged by documents."""
    docs = np.asarray(table.column("docs"), dtype=np.float64)
    mean = lambda c: sum(k * np.frombuffer(x, np.float64) for k, x in zip(docs, table.column(c).to_pylist())) / docs.sum()
    return pa.table({"class": table.column("class").slice(0, 1), "z": pa.array([mean("z").tobytes()], pa.binary()), "n": pa.array([mean("n").tobytes()], pa.binary())})


def _vectors(idf, names: list[str]):
    """(lang, hash, text) to (label, n-grams, values, kept back)."""
    label = {x: k for k, x in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(label[lang], at.tobytes(), value.tobytes(), h % HOLD == 0) for lang, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch, 2)) for at, value in [vector(text, idf.value)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int32(), pa.binary(), pa.binary(), pa.bool_()))], names=["label", "at", "value", "held"])

    return run


def _losses(model):
    """Log loss at each temperature, summed within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(TEMPERATURES))
        for batch in batches:
            for label, at, value in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                s = _scores(model.value, np.frombuffer(at.as_py(), np.int64), np.frombuffer(value.as_py(), np.float64))
                total -= np.log(np.maximum(_probabilities(s[None, :] / TEMPERATURES[:, None])[:, label], 1e-300))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["temperature", "loss"])

    return run


def _scores(weights: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    return (value[:, None] * weights[at]).sum(axis=0) + weights[-1]


class Model:
    """What predict() needs: languages in code-point order, idf, weights with the bias last, temperature."""

    def __init__(self, names: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.names, self.idf, self.weights, self.temperature = names, idf, weights, temperature


def _hash() -> Column:
    return F.xxhash64("doc_id", "text")


def sample(labelled: DataFrame) -> tuple[list[str], DataFrame]:
    """(languages by code points, (lang, hash, text)) of the bounded sample, over narrow rows but for the last step."""
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    names = sorted(r.lang for r in counts)  # LANGUAGES at most
    # a share of the hashes that has four times as many documents as are wanted: the rest never leaves its task
    bound = [(r.lang, min((1 << 63) - 1, (4 * A_LANGUAGE << 64) // r["count"] - (1 << 63))) for r in counts]
    chosen = labelled.sparkSession.createDataFrame(bound, "lang string, bound long")
    narrow = labelled.select("lang", _hash().alias("hash")).join(F.broadcast(chosen), "lang").where("hash <= bound")
    order = Window.partitionBy("lang").orderBy("hash")
    last = narrow.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= A_LANGUAGE).groupBy("lang").agg(F.max("hash").alias("last"))
    rows = labelled.withColumn("hash", _hash()).join(F.broadcast(last), "lang").where("hash <= last")
    # copies of one row have one hash, and count once
    return names, rows.select("lang", "hash", "text").dropDuplicates(["lang", "hash"])


def fit(labelled: DataFrame) -> Model | None:
    """A model from (doc_id, text, lang) rows, all with a lang; None if there are none."""
    spark, sc = labelled.sparkSession, labelled.sparkSession.sparkContext
    names, rows = sample(labelled)
    if not names:
        return None
    idf = inverse_frequencies(labelled)
    shared = sc.broadcast(idf)
    table = rows.repartition(PARTS, "hash").sortWithinPartitions("hash").mapInArrow(_vectors(shared, names), "label int, at binary, value binary, held boolean")
    table = as_table(table, "langid-sample")
    z, n = np.zeros((DIM + 1, len(names))), np.zeros((DIM + 1, len(names)))
    for _ in range(ROUNDS):
        state = sc.broadcast((z, n))
        parts = table.where("NOT held").mapInArrow(_rounds(state, len(names)), "class int, docs long, z binary, n binary")
        for r in parts.groupBy("class").applyInArrow(_averaged, "class int, z binary, n binary").collect():  # as large as one state
            z[:, r["class"]], n[:, r["class"]] = np.frombuffer(r.z), np.frombuffer(r.n)
        state.unpersist()
    weights = _weights(z, n)
    losses = table.where("held").mapInArrow(_losses(sc.broadcast(weights)), "temperature long, loss double").groupBy("temperature").agg(F.sum("loss").alias("loss")).collect()
    best = min(losses, key=lambda r: (r.loss, abs(np.log(TEMPERATURES[r.temperature]))), default=None)
    temperature = float(TEMPERATURES[best.temperature]) if best is not None and best.loss > 0 else 1.0
    return Model(names, idf, weights, temperature)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = shared.value
        for batch in batches:
            names, scores = [], []
            for text in _texts(batch, 2):
                at, value = vector(text, m.idf) if m else ((), ())
                if not len(at):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = _probabilities(_scores(m.weights, at, value) / m.temperature)
                k = int(np.argmax(p))
                names.append(m.names[k])
                scores.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out() -> Column:
    """Documents that are never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(texts.where(~held_out() & F.col("lang").isNotNull()))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return texts.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by a classifier that is fitted on those not held out."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
