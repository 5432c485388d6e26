"""Attention over token sequences of any length, in blocks: no table of scores between all tokens is made.

Blocks are (sample_id, first long, shape array<int> of (tokens, channels), data array<double>): a run of tokens from `first`
on. What crosses blocks is small and mergeable: sums over tokens, or softmax states (highest score, sum, weighted
sum). States are worked out within tasks and summed by sample; weights are parameters of the plan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "sample_id long, first long, shape array<int>, data array<double>"
SCHEMA = pa.schema([("sample_id", pa.int64()), ("first", pa.int64()), ("shape", pa.list_(pa.int32())), ("data", pa.list_(pa.float64()))])
#: What is added to the scores of masked keys: fixed value.
MASKED = -1e9


def blocks(packed: DataFrame, size: int) -> DataFrame:
    """Packed arrays (sample_id, shape, data), channel last, to blocks of tokens in row-major order; null arrays have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sample, shape, data in zip(*batch.columns):
                if shape.is_valid and data.is_valid:
                    x = data.values.to_numpy(zero_copy_only=False).reshape(-1, shape.as_py()[-1])
                    yield _rows([(sample.as_py(), at, x[at : at + size]) for at in range(0, len(x), size)])

    return packed.select("sample_id", "shape", "data").mapInArrow(run, BLOCK)


def _rows(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    cols = zip(*[(s, at, list(x.shape), np.ascontiguousarray(x).ravel()) for s, at, x in rows]) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SCHEMA)], schema=SCHEMA)


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    for sample, first, shape, data in zip(*(batch.column(batch.schema.names.index(n)) for n in SCHEMA.names)):
        yield sample.as_py(), first.as_py(), data.values.to_numpy(zero_copy_only=False).reshape(shape.as_py())


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _dense(x: np.ndarray, layer: tuple | None) -> np.ndarray:
    """x times (matrix, bias or None)."""
    return x @ np.asarray(layer[0], float) + (0 if layer[1] is None else np.asarray(layer[1], float))


def cross_attention(queries: DataFrame, keys: DataFrame, heads: int, query: tuple, key: tuple, value: tuple, out: tuple, mask: DataFrame | None = None) -> DataFrame:
    """Multi-head attention of each sample's queries (one block) over its key blocks: blocks of the queries' shape.

    query, key, value and out are (matrix, bias or None). mask has (sample_id, first, data) rows, with the queries times a key block's tokens in
    row-major order; 0 masks a pair. A query whose keys are all masked attends as if none were. Samples without keys have no row.
    """
    many = keys.join(queries.select("sample_id", F.col("shape").alias("q_shape"), F.col("data").alias("q_data")), "sample_id")
    many = many.join(mask.select("sample_id", "first", F.col("data").alias("mask")), ["sample_id", "first"], "left") if mask is not None else many.withColumn("mask", F.lit(None).cast("array<double>"))

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = (batch.column(batch.schema.names.index(n)) for n in ("q_shape", "q_data", "mask"))
            rows = []
            for (sample, _, x), shape, data, allowed in zip(_tokens(batch), *more):
                q = _dense(data.values.to_numpy(zero_copy_only=False).reshape(shape.as_py()), query)
                k, v = _dense(x, key), _dense(x, value)
                free = np.ones((len(q), len(x))) if not allowed.is_valid else np.array(allowed.as_py()).reshape(len(q), len(x))
                for h, (qh, kh, vh) in enumerate(zip(*(np.split(m, heads, axis=1) for m in (q, k, v)))):
                    score = qh @ kh.T / np.sqrt(qh.shape[1]) + np.where(free != 0, 0.0, MASKED)
                    top = score.max(axis=1)
                    e = np.exp(score - top[:, None])
                    rows += [(sample, i, h, float(t), float(s), w) for i, (t, s, w) in enumerate(zip(top, e.sum(axis=1), e @ vh))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64())))], names=["sample_id", "i", "head", "top", "total", "part"])

    # states merge: all are scaled to the highest score of theirs, then summed; each is a few numbers
    state = many.mapInArrow(states, "sample_id long, i int, head int, top double, total double, part array<double>")
    one = ["sample_id", "i", "head"]

    def merged(table: pa.Table) -> pa.Table:
        top, total = (np.asarray(table.column(c)) for c in ("top", "total"))
        scale = np.exp(top - top.max())
        part = (np.array(table.column("part").to_pylist()) * scale[:, None]).sum(axis=0) / (total * scale).sum()
        return pa.table({**{c: table.column(c).slice(0, 1) for c in one}, "part": pa.array([part], pa.list_(pa.float64()))})

    parts = state.groupBy(*one).applyInArrow(merged, "sample_id long, i int, head int, part array<double>")
    whole = parts.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("i", "head", "part"))).alias("parts"))

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sample, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.array([c["part"] for c in cells]).reshape(len(cells) // heads, -1)
                rows.append((sample, 0, _dense(x, out)))
            yield _rows(rows)

    return whole.mapInArrow(ended, BLOCK)


def layer_normed(x: np.ndarray, gamma: Sequence[float], beta: Sequence[float], epsilon: float = 1e-6) -> np.ndarray:
    mean, variance = x.mean(axis=-1, keepdims=True), x.var(axis=-1, keepdims=True)
    return (x - mean) / np.sqrt(variance + epsilon) * np.asarray(gamma, float) + np.asarray(beta, float)


def _gelu(x: np.ndarray) -> np.ndarray:
    from math import erf

    return x * (1 + np.vectorize(erf, otypes=[float])(x / np.sqrt(2))) / 2


def tiled_queries(samples: DataFrame, queries: Sequence[Sequence[float]]) -> DataFrame:
    """The same learned queries for each sample: one block a row."""
    x = np.asarray(queries, float)
    data = F.array(*[F.lit(float(v)) for v in x.ravel()])
    return samples.select(F.col("sample_id").cast("long").alias("sample_id")).distinct().select("sample_id", F.lit(0).cast("long").alias("first"), F.array(*map(F.lit, x.shape)).alias("shape"), data.alias("data"))


def _mapped(df: DataFrame, fn) -> DataFrame:
    return df.mapInArrow(lambda batches: (_rows([(s, at, fn(x)) for s, at, x in _tokens(batch)]) for batch in batches), BLOCK)


def _added(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.select("sample_id", "first", F.col("data").alias("more"))
    return a.join(other, ["sample_id", "first"]).select("sample_id", "first", "shape", F.zip_with("data", "more", lambda x, y: x + y).alias("data"))


def masked_cross_attention(queries: DataFrame, keys: DataFrame, heads: int, attention: tuple, norms: tuple, mlp: tuple, mask: DataFrame | None = None) -> DataFrame:
    """A decoder block: queries, normed, attend to the keys and are added; a two-layer MLP of the normed sum is added as well.

    attention: (query, key, value, out); norms: two of (gamma, beta); mlp: two of (matrix, bias), with a GELU between.
    """
    x = _added(queries, cross_attention(_mapped(queries, lambda q: layer_normed(q, *norms[0])), keys, heads, *attention, mask))
    return _added(x, _mapped(x, lambda v: _dense(_gelu(_dense(layer_normed(v, *norms[1]), mlp[0])), mlp[1])))


def paired_attention(tokens: DataFrame, length: int, heads: int, qkvv: tuple, projection: Sequence[Sequence[float]], temperatures: tuple[Sequence[float], Sequence[float]] | None = None, epsilon: float = 1e-6) -> DataFrame:
    """Channel and spatial attention with shared queries and keys, added: blocks like those given.

    qkvv is (matrix to four times the channels, bias or None); projection takes the `length` tokens to a few. Queries and keys have length
    one along the tokens. The first pass sums, block by block, the Gram matrices and the projected keys and values of each head;
    the second gives each token its result. The spatial part's cells come in the order (within head, head, token) and are read as
    (token, channel), so runs of them go to the blocks that they belong to.
    """
    p = np.asarray(projection, float)
    few = p.shape[1]
    warm = [np.ones(heads) if t is None else np.asarray(t, float) for t in (temperatures or (None, None))]

    def four(x: np.ndarray) -> list[np.ndarray]:
        return np.split(_dense(x, qkvv), 4, axis=1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, values = [], [], []
            for sample, first, x in _tokens(batch):
                q, k, _, v = four(x)
                mine = p[first : first + len(x)]
                gram = [qh.T @ kh for qh, kh in zip(np.split(q, heads, axis=1), np.split(k, heads, axis=1))]
                flat = np.concatenate([(q * q).sum(axis=0), (k * k).sum(axis=0), np.ravel(gram), (k.T @ mine).ravel(), (v.T @ mine).ravel()])
                ids.append(np.full(len(flat), sample))
                places.append(np.arange(len(flat)))
                values.append(flat)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(values))], names=["sample_id", "place", "v"])

    total = tokens.mapInArrow(sums, "sample_id long, place int, v double").groupBy("sample_id", "place").agg(F.sum("v").alias("v"))
    state = total.groupBy("sample_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias("state"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for (sample, first, x), held in zip(_tokens(batch), batch.column(batch.schema.names.index("state"))):
                q, _, v_channel, _ = four(x)
                c = q.shape[1]
                size = c // heads
                held = held.values.to_numpy(zero_copy_only=False)
                squares_q, squares_k, gram, kp, vp = np.split(held, np.cumsum([c, c, c * size, c * few]))
                norm_q, norm_k = (np.sqrt(np.where(s < epsilon, epsilon, s)) for s in (squares_q, squares_k))
                gram, kp, vp = gram.reshape(heads, size, size), kp.reshape(c, few) / norm_k[:, None], vp.reshape(c, few)
                whole = []
                for h in range(heads):
                    at = slice(h * size, (h + 1) * size)
                    attend = _softmax(gram[h] / norm_q[at, None] / norm_k[None, at] * warm[0][h])
                    whole.append(v_channel[:, at] @ attend.T)
                    places = _softmax(q[:, at] / norm_q[at] @ kp[at] * warm[1][h])
                    spatial = places @ vp[at].T
                    # cell (d, h, token) is the flat place (d * heads + h) * length + token of the result
                    for d in range(size):
                        start = (d * heads + h) * length + first
                        rows.append((sample, start // c, start % c, spatial[:, d]))
                rows.append((sample, first, 0, np.concatenate(whole, axis=1).ravel()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64())))], names=["sample_id", "token", "c", "run"])

    run = tokens.join(state, "sample_id").mapInArrow(runs, "sample_id long, token long, c int, run array<double>")
    channels = int(np.asarray(qkvv[0]).shape[1]) // 4
    spans = tokens.select("sample_id", "first", F.col("shape")[0].alias("n"))
    # a run's cells by flat place, cut where blocks begin
    flat = run.withColumn("low", F.col("token") * channels + F.col("c")).withColumn("high", F.col("low") + F.size("run"))
    bounds = spans.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct((F.col("first") * channels).alias("a"), ((F.col("first") + F.col("n")) * channels).alias("b")))).alias("spans"))
    hit = flat.join(bounds, "sample_id").select("*", F.explode(F.filter("spans", lambda s: (s["a"] < F.col("high")) & (s["b"] > F.col("low")))).alias("span"))
    start = F.greatest("low", "span.a")
    pieces = hit.select("sample_id", (F.col("span.a") / channels).cast("long").alias("first"), ((F.col("span.b") - F.col("span.a")) / channels).cast("int").alias("n"), (start - F.col("span.a")).cast("int").alias("at"), F.slice("run", (start - F.col("low") + 1).cast("int"), (F.least("high", "span.b") - start).cast("int")).alias("run"))

    def met(table: pa.Table) -> pa.Table:
        out = np.zeros(table.column("n")[0].as_py() * channels)
        for at, part in zip(table.column("at").to_pylist(), table.column("run").combine_chunks()):
            part = part.values.to_numpy(zero_copy_only=False)
            out[at : at + len(part)] += part
        return pa.Table.from_batches([_rows([(table.column("sample_id")[0].as_py(), table.column("first")[0].as_py(), out.reshape(-1, channels))])])

    return pieces.groupBy("sample_id", "first").applyInArrow(met, BLOCK)
