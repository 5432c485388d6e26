"""Convolutions on arrays of any size, cut into tiles: a row a tile, borders exchanged between neighbours.

A tile is (sample_id, at array<int>, whole array<int>, shape array<int>, data array<double>): where it starts, the sizes of the whole array
and its own, channel last with three spatial axes (d is 1 for images). Convolutions are matrix products within a
task. Only the borders that a kernel reaches over are shuffled, each to the tiles that it touches; no row a voxel or tap.

Small tiles are worked on many at a time: those alike in a run of rows are one array with a leading axis. Tiles that belong together
meet in streams that Spark sorts; a task holds a run of HELD bytes, or one group of tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = "sample_id long, at array<int>, whole array<int>, shape array<int>, data array<double>"
SCHEMA = pa.schema([("sample_id", pa.int64()), *((n, pa.list_(pa.int32())) for n in ("at", "whole", "shape")), ("data", pa.list_(pa.float64()))])
ARRAY = "sample_id long, shape array<int>, data array<double>"
ARRAYS = pa.schema([SCHEMA.field(n) for n in ("sample_id", "shape", "data")])
#: Bytes of numbers that a task works on at a time, and that it holds before it gives them back; a larger tile is worked on alone.
HELD = 8 << 20
#: What a row or a batch takes beside its numbers, about.
OVERHEAD = 1 << 10


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of arrays, and where those of each row begin; the last is the end."""
    column = batch.column(batch.schema.names.index(name))
    ends = column.offsets.to_numpy()
    return column.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False), (ends - ends[0]).astype(np.int64)


def _table(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of arrays of equal length: a row each."""
    numbers, ends = _lists(batch, name)
    return numbers.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.int32)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.names.index("sample_id"))
    return np.array(column.to_pylist(), object) if column.null_count else column.to_numpy()


def _kinds(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, rows) of each distinct row of keys."""
    order = np.lexsort(keys.T[::-1])
    cuts = np.flatnonzero((keys[order][1:] != keys[order][:-1]).any(axis=1)) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        yield keys[rows[0]], rows


def _alike(keys: np.ndarray, data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, rows, their arrays as one) of each distinct key, whose last four numbers are the shape."""
    for key, rows in _kinds(keys):
        shape = key[-4:].tolist()
        yield key, rows, data[starts[rows][:, None] + np.arange(int(np.prod(shape)))].reshape(len(rows), *shape)


def _stacked(rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their arrays as one) of each shape of packed rows; shapes have four sizes."""
    for _, k, x in _alike(_table(rows, "shape"), *_lists(rows, "data")):
        yield k, x


def _runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str] = ()) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, where groups begin) of HELD bytes or one group. Rows come sorted by the keys, and none of their groups is cut; without keys each row is one."""

    def begins(batch: pa.RecordBatch) -> np.ndarray:
        if not keys:
            return np.arange(batch.num_rows)
        known = np.column_stack([_ids(batch), *(_table(batch, k) for k in keys if k != "sample_id")])
        return np.concatenate([[0], np.flatnonzero((known[1:] != known[:-1]).any(axis=1)) + 1])

    def cut(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        at = np.append(begins(batch), batch.num_rows)
        used = _lists(batch, "data")[1][at] * 8 + at * OVERHEAD
        k = 0
        while k < len(at) - 1:
            end = min(max(int(np.searchsorted(used, used[k] + HELD, "right")) - 1, k + 1), len(at) - 1)
            yield batch.slice(at[k], at[end] - at[k]), at[k:end] - at[k]
            k = end

    # what may go on in the next batch: rows of one group
    open_rows: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if not keys:
            yield from cut(batch)
            continue
        last = int(begins(batch)[-1])
        if open_rows and last == 0 and len(begins(_one([open_rows[-1].slice(open_rows[-1].num_rows - 1), batch.slice(0, 1)]))) == 1:
            open_rows.append(batch)
            continue
        if open_rows or last:
            yield from cut(_one([*open_rows, batch.slice(0, last)]))
        open_rows = [batch.slice(last)]
    if open_rows:
        yield from cut(_one(open_rows))


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    parts = pa.Table.from_batches(batches).combine_chunks().to_batches()
    if len(parts) > 1:
        raise ValueError("a group of tiles has more numbers than one column holds")
    return parts[0]


def _given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have HELD bytes."""
    some, held = [], 0
    for batch in batches:
        some.append(batch)
        held += batch.nbytes + OVERHEAD
        if held >= HELD:
            yield _one(some)
            some, held = [], 0
    if some:
        yield _one(some)


def _column(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    width = int(np.prod(rows.shape[1:]))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(rows).ravel(), kind.value_type))


def _rows(schema: pa.Schema, x: np.ndarray, sample: np.ndarray, *places: np.ndarray | Sequence[int]) -> pa.RecordBatch:
    """Rows of arrays x; places are one for all, or a row each."""
    lists = [*places, x.shape[1:]]
    cols = [_column(np.broadcast_to(np.asarray(v, np.int32), (len(x), np.shape(v)[-1])), schema[k + 1].type) for k, v in enumerate(lists)]
    return pa.RecordBatch.from_arrays([pa.array(sample, pa.int64()), *cols, _column(x, pa.list_(pa.float64()))], schema=schema)


def _placed(shapes: np.ndarray, parents: np.ndarray, places: np.ndarray, sizes: np.ndarray, data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, arrays) of each shape, zeros but for the pieces: piece k lies at a place in the array of number parents[k]."""
    kind, slot, arrays = np.zeros(len(shapes), np.int64), np.zeros(len(shapes), np.int64), []
    for shape, rows in _kinds(shapes):
        kind[rows], slot[rows] = len(arrays), np.arange(len(rows))
        arrays.append((rows, np.zeros((len(rows), *shape.tolist()))))
    for key, rows, x in _alike(np.column_stack([kind[parents], places, sizes]), data, starts):
        out = arrays[key[0]][1]
        window = tuple(slice(a, min(a + n, m)) for a, n, m in zip(key[1:4].tolist(), x.shape[1:], out.shape[1:]))
        out[(slot[parents[rows]], *window)] = x[(slice(None), *(slice(0, w.stop - w.start) for w in window))]
    yield from arrays


def cut(packed: DataFrame, size: Sequence[int]) -> DataFrame:
    """Packed rows (sample_id, shape, data) of three spatial axes and channels to tiles of a size; null arrays have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tiles() -> Iterator[pa.RecordBatch]:
            whole = (b.filter(pc.and_(pc.is_valid(b.column(1)), pc.is_valid(b.column(2)))) for b in batches)
            for rows, _ in _runs(whole):
                ids = _ids(rows)
                for shape, k, x in _alike(_table(rows, "shape"), *_lists(rows, "data")):
                    for at in product(*[range(0, n, s) for n, s in zip(shape.tolist(), size)]):
                        yield _rows(SCHEMA, x[(slice(None), *(slice(a, a + s) for a, s in zip(at, size)))], ids[k], at, shape[:3])

        yield from _given(tiles())

    return packed.select("sample_id", "shape", "data").mapInArrow(run, TILE)


def _met(tiles: DataFrame, *keys: str) -> DataFrame:
    return tiles.repartition(*keys).sortWithinPartitions(*keys)


def joined(tiles: DataFrame) -> DataFrame:
    """Tiles put together again: (sample_id, shape, data). An array must fit in a task here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays() -> Iterator[pa.RecordBatch]:
            for rows, first in _runs(batches, ["sample_id"]):
                ids, sizes, whole = _ids(rows)[first], _table(rows, "shape"), _table(rows, "whole")[first]
                parents = np.repeat(np.arange(len(first)), np.diff(np.append(first, rows.num_rows)))
                for k, x in _placed(np.column_stack([whole, sizes[first, 3]]), parents, _table(rows, "at"), sizes, *_lists(rows, "data")):
                    yield _rows(ARRAYS, x, ids[k])

        yield from _given(arrays())

    return _met(tiles, "sample_id").mapInArrow(run, ARRAY)


def with_halo(tiles: DataFrame, size: Sequence[int], halo: Sequence[int]) -> DataFrame:
    """Tiles grown by what lies around them, zeros beyond the border; `at` stays where the tile itself starts."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[pa.RecordBatch]:
            for rows, _ in _runs(batches):
                ids = _ids(rows)
                for key, k, x in _alike(np.column_stack([_table(rows, n) for n in ("at", "whole", "shape")]), *_lists(rows, "data")):
                    at, whole, own = key[:3].tolist(), key[3:6].tolist(), key[6:9].tolist()
                    # the tiles whose surroundings reach into this one
                    near = [range(max((a - h) // s, 0) * s, min(a + n + h, m), s) for a, n, h, s, m in zip(at, own, halo, size, whole)]
                    for to in product(*near):
                        low = [max(t - h, a) for t, h, a in zip(to, halo, at)]
                        high = [min(t + s + h, a + n) for t, s, h, a, n in zip(to, size, halo, at, own)]
                        if all(b > a for a, b in zip(low, high)):
                            # whole carries the place of the piece as well
                            yield _rows(SCHEMA, x[(slice(None), *(slice(l - a, b - a) for l, b, a in zip(low, high, at)))], ids[k], to, [*whole, *low])

        yield from _given(parts())

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grown() -> Iterator[pa.RecordBatch]:
            for rows, first in _runs(batches, ["sample_id", "at"]):
                ids, to, extra, sizes = _ids(rows)[first], _table(rows, "at"), _table(rows, "whole"), _table(rows, "shape")
                own = np.minimum(size, extra[first, :3] - to[first])
                parents = np.repeat(np.arange(len(first)), np.diff(np.append(first, rows.num_rows)))
                shapes = np.column_stack([own + 2 * np.asarray(halo), sizes[first, 3]])
                for k, x in _placed(shapes, parents, extra[:, 3:] - to + np.asarray(halo), sizes, *_lists(rows, "data")):
                    yield _rows(SCHEMA, x, ids[k], to[first][k], extra[first, :3][k])

        yield from _given(grown())

    return _met(tiles.mapInArrow(sent, TILE), "sample_id", "at").mapInArrow(met, TILE)


def correlate(x: np.ndarray, kernel: np.ndarray, dilation: int = 1) -> np.ndarray:
    """x, grown by the kernel's reach on either side, times a kernel (kd, kh, kw, in, out); a product a tap, all voxels at once. x may have a leading axis."""
    sizes = [n - (k - 1) * dilation for n, k in zip(x.shape[-4:], kernel.shape[:3])]
    out = np.zeros((*x.shape[:-4], *sizes, kernel.shape[4]))
    for tap, part in _taps(x, kernel, sizes, dilation):
        out += (part.reshape(-1, part.shape[-1]) @ kernel[tap]).reshape(out.shape)
    return out


def _taps(x: np.ndarray, kernel: np.ndarray, sizes: Sequence[int], dilation: int) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    for tap in np.ndindex(*kernel.shape[:3]):
        yield tap, x[(..., *(slice(t * dilation, t * dilation + n) for t, n in zip(tap, sizes)), slice(None))]


def depthwise(x: np.ndarray, kernel: np.ndarray, dilation: int = 1) -> np.ndarray:
    """The same for a kernel (kd, kh, kw, in) of each channel alone."""
    sizes = [n - (k - 1) * dilation for n, k in zip(x.shape[-4:], kernel.shape[:3])]
    return sum(part * kernel[tap] for tap, part in _taps(x, kernel, sizes, dilation))


def _reach(kernel: np.ndarray, dilation: int) -> list[int]:
    if any(k % 2 == 0 for k in kernel.shape[:3]):
        raise ValueError("kernels have odd sizes")
    return [(k - 1) // 2 * dilation for k in kernel.shape[:3]]


def _each(tiles: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """fn of tiles of one shape at a time, as one array with a leading axis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            for rows, _ in _runs(batches):
                ids, at, whole = _ids(rows), _table(rows, "at"), _table(rows, "whole")
                for _, k, x in _alike(_table(rows, "shape"), *_lists(rows, "data")):
                    yield _rows(SCHEMA, fn(x), ids[k], at[k], whole[k])

        yield from _given(out())

    return tiles.mapInArrow(run, TILE)


def convolution(tiles: DataFrame, size: Sequence[int], kernel: np.ndarray, dilation: int = 1, pointwise: np.ndarray | None = None) -> DataFrame:
    """'Same' convolution of tiles: a kernel (kd, kh, kw, in, out), or with pointwise (in, out) one of each channel, (kd, kh, kw, in)."""
    kernel = np.asarray(kernel, float)
    grown = with_halo(tiles, size, _reach(kernel, dilation))
    return _each(grown, lambda x: correlate(x, kernel, dilation) if pointwise is None else depthwise(x, kernel, dilation) @ np.asarray(pointwise, float))


def normalised(x: np.ndarray, norm: Sequence[Sequence[float]], epsilon: float = 1e-3) -> np.ndarray:
    """Batch normalisation as a model applies it: (mean, variance, gamma, beta) of each channel."""
    mean, variance, gamma, beta = (np.asarray(v, float) for v in norm)
    return (x - mean) / np.sqrt(variance + epsilon) * gamma + beta


def pyramid(tiles: DataFrame, size: Sequence[int], point: np.ndarray, dilated: Sequence[tuple[int, np.ndarray, np.ndarray | None]], pooled: np.ndarray, projection: np.ndarray, norms: Sequence) -> DataFrame:
    """Atrous spatial pyramid pooling of tiles.

    Branches side by side: a matrix over channels; a convolution for each (dilation, kernel, pointwise or None); the mean over space times a matrix, the
    same everywhere. Each has its batch norm and is cut at 0; a matrix over all branches, its norm and cut follow. Borders
    go once, for the largest reach; means are summed within tasks before they are shuffled.
    """
    point, pooled, projection = (np.asarray(m, float) for m in (point, pooled, projection))
    dilated = [(d, np.asarray(k, float), None if p is None else np.asarray(p, float)) for d, k, p in dilated]
    if len(norms) != len(dilated) + 3:
        raise ValueError("a norm for each branch and for the projection")
    halo = [max([0, *r]) for r in zip(*[_reach(k, d) for d, k, _ in dilated])] if dilated else [0, 0, 0]
    sums = tiles.mapInArrow(_channel_sums, "sample_id long, c int, v double, n long").groupBy("sample_id", "c").agg((F.sum("v") / F.sum("n")).alias("v"))
    means = sums.groupBy("sample_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "v"))), lambda x: x["v"]).alias("means"))
    grown = with_halo(tiles, size, halo).join(means, "sample_id").select("sample_id", "at", "whole", "shape", "data", "means")
    relu = lambda x: np.maximum(x, 0)

    def work(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
        inner = lambda less: x[(slice(None), *(slice(h, n - h) for h, n in zip(less, x.shape[1:])))]
        parts = [relu(normalised(inner(halo) @ point, norms[0]))]
        for (d, kernel, mix), norm in zip(dilated, norms[1:]):
            near = inner([h - r for h, r in zip(halo, _reach(kernel, d))])
            parts.append(relu(normalised(correlate(near, kernel, d) if mix is None else depthwise(near, kernel, d) @ mix, norm)))
        everywhere = relu(normalised(mean @ pooled, norms[-2]))[:, None, None, None]
        parts.append(np.broadcast_to(everywhere, (*parts[0].shape[:4], everywhere.shape[-1])))
        return relu(normalised(np.concatenate(parts, axis=-1) @ projection, norms[-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            for rows, _ in _runs(batches):
                ids, at, whole, (means, first) = _ids(rows), _table(rows, "at"), _table(rows, "whole"), _lists(rows, "means")
                for shape, k, x in _alike(_table(rows, "shape"), *_lists(rows, "data")):
                    yield _rows(SCHEMA, work(x, means[first[k][:, None] + np.arange(shape[3])]), ids[k], at[k], whole[k])

        yield from _given(out())

    return grown.mapInArrow(run, TILE)


def _channel_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, _ in _runs(batches):
        ids = _ids(rows)
        for shape, k, x in _alike(_table(rows, "shape"), *_lists(rows, "data")):
            cols = np.repeat(ids[k], shape[3]), np.tile(np.arange(shape[3]), len(k)), x.sum(axis=(1, 2, 3)).ravel(), np.full(len(k) * shape[3], shape[:3].prod())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.float64(), pa.int64()))], names=["sample_id", "c", "v", "n"])
