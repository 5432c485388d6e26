"""Record files: length-framed records with masked checksums, each an example of named features.

A file is read in byte ranges. A record belongs to the range that its frame starts in; a task finds the first frame of its range by the
checksum of the length, at any byte, and confirms it by that of the data. A broken record is an error.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import shared_path

RANGE_BYTES = 64 << 20
#: Bytes from which on a piece is worked out in lanes of its own; bytes read beyond a range, for its last record; bytes framed together.
LONG, BEYOND, FRAMED = 1 << 14, 1 << 12, 1 << 20
#: The Castagnoli polynomial, reflected; what is added to a rotated checksum.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
EXAMPLE = "map<string, struct<bytes: array<binary>, floats: array<float>, ints: array<long>>>"


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1))
    return t


TABLE = _table()
STEPS = TABLE.tolist()
#: What two bytes do to a register: LOW as the last two of a word, HIGH as the first two.
_after = lambda s: TABLE[s & np.uint32(255)] ^ (s >> np.uint32(8))  # noqa: E731  a zero byte
LOW = _after(_after(np.arange(1 << 16, dtype=np.uint32)))
HIGH = _after(_after(LOW))


def _lanes(rows: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The register after each row's bytes, all rows at once."""
    for k in range(rows.shape[1]):
        state = TABLE[(state ^ rows[:, k]) & np.uint32(255)] ^ (state >> np.uint32(8))
    return state


def crc32c(data: bytes | np.ndarray, lane: int = 4096) -> int:
    """The checksum of some bytes: lanes of equal length are worked out side by side, then joined from left to right."""
    x = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
    head = len(x) % lane
    now = 0xFFFFFFFF
    for b in x[:head].tolist():
        now = STEPS[(now ^ b) & 255] ^ (now >> 8)
    if len(x) > head:
        rows = x[head:].reshape(-1, lane).astype(np.uint32)
        each = _lanes(rows, np.zeros(len(rows), np.uint32))
        # what `lane` zero bytes do to each bit of a register
        shift = _lanes(np.zeros((32, lane), np.uint32), np.uint32(1) << np.arange(32, dtype=np.uint32))
        bits = np.arange(32, dtype=np.uint32)
        for r in each.tolist():
            now = int(np.bitwise_xor.reduce(shift[(np.uint32(now) >> bits & np.uint32(1)) == 1], initial=np.uint32(0))) ^ r
    return now ^ 0xFFFFFFFF


def checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The checksums of many pieces of some bytes: pieces of about one length are worked out side by side, four bytes a step."""
    out = np.zeros(len(starts), np.uint32)
    for k in np.flatnonzero(sizes >= LONG):
        out[k] = crc32c(data[starts[k] : starts[k] + sizes[k]])
    short = np.flatnonzero(sizes < LONG)
    classes = np.frexp(sizes[short].astype(float))[1]
    for c in np.unique(classes):
        rows = short[classes == c]
        rows = rows[np.argsort(-sizes[rows], kind="stable")]
        size, start = sizes[rows], starts[rows]
        words = size // 4
        at = start[:, None] + np.arange(max(int(words[0]), 1) * 4)
        cells = np.ascontiguousarray(np.ascontiguousarray(data[np.minimum(at, len(data) - 1)] if len(data) else np.zeros(at.shape, np.uint8)).view("<u4").T)
        state = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for k in range(int(words[0])):
            live = int(np.searchsorted(-words, -k, "left"))  # the pieces with more than k words come first
            s = state[:live] ^ cells[k, :live]
            state[:live] = HIGH[s & np.uint32(0xFFFF)] ^ LOW[s >> np.uint32(16)]
        for k in range(3):
            more = np.flatnonzero(size % 4 > k)
            state[more] = TABLE[(state[more] ^ data[start[more] + 4 * words[more] + k]) & np.uint32(255)] ^ (state[more] >> np.uint32(8))
        out[rows] = ~state
    return out


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def _masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def framed(records: Sequence[bytes]) -> list[bytes]:
    """The frame of each record; checksums are worked out together."""
    sizes = np.array([len(r) for r in records], np.int64)
    starts = np.cumsum(sizes) - sizes
    heads = sizes.astype("<u8").view(np.uint8)
    of_data = _masked(checksums(np.frombuffer(b"".join(records), np.uint8), starts, sizes)).astype("<u4").tobytes()
    of_size = _masked(checksums(heads, np.arange(len(sizes)) * 8, np.full(len(sizes), 8))).astype("<u4").tobytes()
    heads = heads.tobytes()
    return [heads[8 * k : 8 * k + 8] + of_size[4 * k : 4 * k + 4] + r + of_data[4 * k : 4 * k + 4] for k, r in enumerate(records)]


def frame(data: bytes) -> bytes:
    size = struct.pack("<Q", len(data))
    return size + struct.pack("<I", masked(crc32c(size))) + data + struct.pack("<I", masked(crc32c(data)))


def _headers(data: np.ndarray) -> np.ndarray:
    """Places whose twelve bytes are a length and its checksum."""
    n = len(data) - 11
    if n <= 0:
        return np.zeros(0, np.int64)
    state = np.full(n, 0xFFFFFFFF, np.uint32)
    for k in range(8):
        state = TABLE[(state ^ data[k : k + n]) & np.uint32(255)] ^ (state >> np.uint32(8))
    want = _masked(~state)
    given = sum(data[8 + k : 8 + k + n].astype(np.uint32) << np.uint32(8 * k) for k in range(4))
    return np.flatnonzero(want == given)


class _File:
    def __init__(self, path: str) -> None:
        self.path = path
        store, name = pafs.FileSystem.from_uri(path)
        self.file = store.open_input_file(name)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(min(n, max(self.size - at, 0)), at)

    def data(self, at: int) -> bytes | None:
        """The record whose frame starts here, if both checksums fit."""
        head = self.read(at, 12)
        if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(crc32c(head[:8])):
            return None
        n = struct.unpack("<Q", head[:8])[0]
        if at + n + 16 > self.size:
            return None
        body = self.read(at + 12, n + 4)
        return body[:n] if struct.unpack("<I", body[n:])[0] == masked(crc32c(body[:n])) else None


def _whole(block: bytes, most: int) -> tuple[list[int], list[int], int]:
    """(places, sizes, records at the start that are not broken) of the records that begin before `most` and lie within some bytes."""
    places, sizes, at = [], [], 0
    while at < most and at + 16 <= len(block):
        n = int.from_bytes(block[at : at + 8], "little")
        if at + n + 16 > len(block):
            break
        places.append(at)
        sizes.append(n)
        at += n + 16
    x, p, n = np.frombuffer(block, np.uint8), np.array(places, np.int64), np.array(sizes, np.int64)
    given = lambda at: sum(x[at + k].astype(np.uint32) << np.uint32(8 * k) for k in range(4))
    fits = (_masked(checksums(x, p, np.full(len(p), 8))) == given(p + 8)) & (_masked(checksums(x, p + 12, n)) == given(p + 12 + n))
    return places, sizes, len(p) if fits.all() else int(np.argmin(fits))


def frames(path: str | _File, start: int, end: int, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(place, data) of the records whose frames start in [start, end)."""
    f = path if isinstance(path, _File) else _File(path)
    at = start
    if start > 0:
        at = end
        for low in range(start, end, step):
            block = np.frombuffer(f.read(low, min(step, end - low) + 11), np.uint8).astype(np.uint32)
            at = next((low + int(p) for p in _headers(block) if low + p < end and f.data(low + int(p)) is not None), end)
            if at < end:
                break
    while at < min(end, f.size):
        block = f.read(at, min(step, end - at + BEYOND))
        places, sizes, good = _whole(block, end - at)
        for p, n in zip(places[:good], sizes):
            yield at + p, block[p + 12 : p + 12 + n]
        if good:
            at += places[good - 1] + sizes[good - 1] + 16
        if good == len(places) and good:
            continue
        # one that is broken, or goes beyond the block
        data = f.data(at)
        if data is None:
            raise ValueError(f"{f.path}: no whole record at byte {at}")
        yield at, data
        at += len(data) + 16


# ---- examples: fields of the wire format, by number ----------------------------------------------


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _fields(data: memoryview) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of a message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, kind, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, kind, data[at : at + n]
            at += n


def encode_example(features: dict[str, list]) -> bytes:
    """Named lists of bytes or text, floats, or ints."""
    out = b""
    for name, values in features.items():
        if values and isinstance(values[0], (bytes, str)):
            inner = _field(1, b"".join(_field(1, v.encode() if isinstance(v, str) else v) for v in values))
        elif values and isinstance(values[0], float):
            inner = _field(2, _field(1, np.asarray(values, "<f4").tobytes()))
        else:
            inner = _field(3, _field(1, b"".join(map(_varint, values))))
        out += _field(1, _field(1, name.encode()) + _field(2, inner))
    return _field(1, out)


def decode_example(data: bytes) -> dict[str, dict]:
    """Name to lists: `bytes`, `floats` or `ints`, the others null; packed and single values both."""
    out: dict[str, dict] = {}
    for _, _, features in _fields(memoryview(data)):
        for _, _, entry in _fields(features):
            parts = {n: v for n, _, v in _fields(entry)}
            value: dict = {"bytes": None, "floats": None, "ints": None}
            for kind, _, items in _fields(parts.get(2, memoryview(b""))):
                if kind == 1:
                    value["bytes"] = [bytes(v) for _, _, v in _fields(items)]
                elif kind == 2:
                    value["floats"] = [x for _, _, v in _fields(items) for x in np.frombuffer(v, "<f4").tolist()]
                else:
                    found: list[int] = []
                    for _, wire, v in _fields(items):
                        found += [v] if wire == 0 else _varints(v)
                    value["ints"] = [n - (1 << 64) if n >> 63 else n for n in found]
            out[bytes(parts.get(1, b"")).decode()] = value
    return out


def _varints(data: memoryview) -> list[int]:
    out, n, shift = [], 0, 0
    for b in data:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(n)
            n = shift = 0
    return out


def read_records(spark: SparkSession, path: str | DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, at, features) of record files: byte ranges are spread over tasks, small ones many to a task.

    The files are those of a folder, or of a manifest from write_records, for which no folder is listed.
    """
    files = (path if isinstance(path, DataFrame) else spark.read.format("binaryFile").load(path)).select("path", "length").where("length > 0")
    cuts = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges, size = files.agg(F.sum(F.ceil(F.col("length") / range_bytes)), F.sum("length")).first()
    tasks = min(ranges or 1, max(4 * spark.sparkContext.defaultParallelism, (size or 0) // RANGE_BYTES + 1), 100_000)
    spread = cuts.repartition(tasks).sortWithinPartitions("path", "start")
    schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("features", pa.map_(pa.string(), pa.struct([("bytes", pa.list_(pa.binary())), ("floats", pa.list_(pa.float32())), ("ints", pa.list_(pa.int64()))])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, rows, held = None, [], 0
        given = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file is None or file.path != name:
                    file = _File(name)
                for at, data in frames(file, start, start + range_bytes):
                    rows.append((name, at, list(decode_example(data).items())))
                    held += len(data)
                    if held > 16 << 20 or len(rows) == 10_000:
                        yield given()
                        rows, held = [], 0
        if rows:
            yield given()

    return spread.mapInArrow(run, f"path string, at long, features {EXAMPLE}")


def write_records(df: DataFrame, folder: str | None = None, file_bytes: int = 256 << 20) -> DataFrame:
    """Each row as an example of its columns (text, binary, numbers, and arrays of them), in files of a folder; returns (path, records, length).

    Nulls are left out. A task that runs again writes files of other names; those of the manifest are the whole ones.
    """
    folder = folder or shared_path(df.sparkSession, "records")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root)
        out, done, name, n, size = None, [], "", 0, 0
        def records() -> Iterator[bytes]:
            some, held = [], 0
            for batch in batches:
                for row in batch.to_pylist():
                    some.append(encode_example({k: v if isinstance(v, list) else [v] for k, v in row.items() if v is not None}))
                    held += len(some[-1])
                    if held >= FRAMED:
                        yield from framed(some)
                        some, held = [], 0
            yield from framed(some)

        for data in records():
            if out is None:
                name, n, size = f"part-{uuid.uuid4().hex}.tfrecord", 0, 0
                out = store.open_output_stream(f"{root}/{name}")
            out.write(data)
            n, size = n + 1, size + len(data)
            if size >= file_bytes:
                out.close()
                done.append((f"{folder}/{name}", n, size))
                out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "length"])

    from .tables import written

    return written(df.mapInArrow(run, "path string, records long, length long"), "records-manifest")


def channels(arrays: Sequence[Column]) -> Column:
    """Several arrays of one shape as the channels of one, channel last."""
    return F.flatten(F.transform(F.arrays_zip(*[a.alias(f"c{k}") for k, a in enumerate(arrays)]), lambda x: F.array(*[x[f"c{k}"] for k in range(len(arrays))])))
