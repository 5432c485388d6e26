"""Exact substring deduplication with suffix arrays.

A byte is removed if a string of LENGTH bytes that covers it also starts in a document with a
smaller doc_id. Strings are judged on the input, and never cross documents.

1. Documents are packed into shards of a few megabytes, compressed files in the shared
   folder, so that every later step finds the same bytes without moving texts again.
2. In each string of LENGTH bytes the GRAM-byte substring with the least hash, the
   leftmost of equals, is its anchor. Equal strings have equal anchors, so strings only meet
   under their anchor's hash. The strings of one anchor are consecutive; the bytes they span
   are the anchor's context. A shard reports each distinct (anchor hash, context hash) once,
   with the least document that has it.
3. Per bucket of anchor hashes: where all contexts of an anchor are equal, the least
   document of all is the answer for all of its strings. Where they differ, one shard sends the
   context's bytes.
4. Of those contexts, runs of strings whose hashes another context of the anchor has are kept, each
   distinct run once. A few megabytes of each bucket at a time, they are sorted into a suffix array by
   induced sorting; permuted common prefixes of LENGTH or more group equal strings, and each
   group's least document is the answer for its strings.
5. Answers go back to the shards, which mark and remove bytes.

One answer per shard and context is what travels, so thousands of copies cost one row a shard. An
anchor with very many different contexts is taken apart by the strings' offset from it; of equal strings
one is sorted.

Defined cases: a null text is empty; texts under LENGTH bytes are kept whole; a null doc_id is
larger than any other; rows with equal doc_ids do not remove each other's bytes; texts of any
length are processed whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_table, shared_dir
from .suffixes import permuted_common_prefixes, suffix_array
from .tokens import _BASE, _INVERSE, U64, buffers, mix64, powers, prefix, span_hashes

LENGTH, GRAM = 50, 20
WINDOW = LENGTH - GRAM + 1
SHARD_BYTES, CHUNK, BUCKET_BYTES, SORT_BYTES = 2 << 20, 1 << 18, 6 << 20, 1 << 18
MANY_BUCKETS = 96
#: A string reaches so far to the left of its anchor, or at least so far to its right.
NEAR = (LENGTH - GRAM) // 2
#: No byte of UTF-8.
MARK = 255
NOBODY = np.iinfo(np.int64).max
_LOW = U64((1 << 22) - 1)


# ---- shards -------------------------------------------------------------------------------


def _packer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.shards"
        out, at, rows = None, 0, []
        ids, texts, held = [], [], 0

        def flush() -> None:
            nonlocal out, at, ids, texts, held
            if not ids:
                return
            keys = pa.concat_arrays(ids)
            numbers = np.asarray(keys.fill_null(NOBODY), dtype=np.int64)
            sizes = np.concatenate([np.diff(o) for _, o in texts])
            body = b"".join(d[o[0] : o[-1]].tobytes() for d, o in texts)
            known = np.asarray(keys.is_valid()).astype(np.uint8)
            blob = zstandard.ZstdCompressor(level=3).compress(np.int64(len(numbers)).tobytes() + numbers.tobytes() + known.tobytes() + sizes.astype("<i8").tobytes() + body)
            if out is None:
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            out.write(blob)
            rows.append((f"{folder}/{name}", at, len(blob), len(body)))
            at += len(blob)
            ids, texts, held = [], [], 0

        for batch in batches:
            data, offsets = buffers(batch.column(1))
            a = 0
            while a < len(batch):
                room = max(0, SHARD_BYTES - held)
                b = min(max(int(np.searchsorted(offsets, offsets[a] + room, side="right")) - 1, a + 1), len(batch))
                ids.append(batch.column(0).slice(a, b - a))
                texts.append((data, offsets[a : b + 1].copy()))
                held += int(offsets[b] - offsets[a])
                if held >= SHARD_BYTES:
                    flush()
                a = b
            # the batch's buffers go away
            texts = [(d[o[0] : o[-1]].copy(), o - o[0]) for d, o in texts]
        flush()
        if out is not None:
            out.close()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        cols = zip(*rows) if rows else ([],) * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["path", "at", "length", "n_bytes"])

    return run


class Shard:
    """The documents of one shard, and the anchors of all their strings."""

    def __init__(self, path: str, at: int, length: int) -> None:
        store, name = pafs.FileSystem.from_uri(path)
        with store.open_input_file(name) as f:
            f.seek(at)
            raw = zstandard.ZstdDecompressor().decompress(f.read(length))
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        self.ids = np.frombuffer(raw, "<i8", n, 8)
        self.known = np.frombuffer(raw, np.uint8, n, 8 + 8 * n).astype(bool)
        self.offsets = np.concatenate(([0], np.cumsum(np.frombuffer(raw, "<i8", n, 8 + 9 * n))))
        self.data = np.frombuffer(raw, np.uint8, -1, 8 + 17 * n) if len(raw) > 8 + 17 * n else np.zeros(0, np.uint8)
        self._find_anchors()

    def _find_anchors(self) -> None:
        """Anchors in text order: first, last string; document; offset of the anchor; hashes."""
        found = []
        total = len(self.data)
        for a in range(0, max(0, total - LENGTH + 1), CHUNK):
            data = self.data[a : a + CHUNK + LENGTH - 1]
            sums = prefix(data)
            grams = mix64((sums[GRAM:] - sums[:-GRAM]) * powers(len(sums), _INVERSE)[: len(sums) - GRAM])
            least = (grams & ~_LOW) | np.arange(len(grams), dtype=U64)
            span = 1
            while span * 2 <= WINDOW:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if WINDOW > span:
                least = np.minimum(least[: span - WINDOW], least[WINDOW - span :])
            anchor = (least & _LOW).astype(np.int64)
            # strings must lie within one document
            at = np.arange(a, a + len(anchor))
            doc = np.searchsorted(self.offsets, [a, a + len(anchor)], side="right") - 1
            inside = np.ones(len(anchor), dtype=bool)
            for edge in self.offsets[doc[0] + 1 : doc[1] + 2].tolist():
                inside[max(0, edge - LENGTH + 1 - a) : max(0, edge - a)] = False
            bounds = self.offsets[doc[0] + 1 : doc[1] + 1] - a
            steps = np.bincount(bounds[bounds < len(anchor)], minlength=len(anchor))
            owner = doc[0] + np.cumsum(steps)
            keep = np.flatnonzero(inside)
            if not len(keep):
                continue
            new = np.ones(len(keep), dtype=bool)
            new[1:] = (anchor[keep[1:]] != anchor[keep[:-1]]) | (np.diff(keep) > 1)
            first = keep[new]
            last = keep[np.append(np.flatnonzero(new)[1:], len(keep)) - 1]
            offset = anchor[first] - first
            context = mix64(span_hashes(sums, first, last + LENGTH) + offset.astype(U64) * U64(_BASE))
            # the least of a window is a small number: mixed again, so that buckets are of one size
            found.append((at[first], at[last], owner[first], offset, mix64(grams[anchor[first]]), context))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, U64)] * 2
        self.first, self.last, self.doc, self.offset, self.anchor, self.context = cols
        # distinct (anchor hash, context hash), ordered: the entries
        order = np.lexsort((self.ids[self.doc], self.context, self.anchor))
        h, c = self.anchor[order], self.context[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        self.lead = order[new]  # of each entry, an anchor in the least document
        self.entry = np.empty(len(order), dtype=np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.entry_anchor, self.entry_context = self.anchor[self.lead], self.context[self.lead]
        self.entry_least = self.ids[self.doc[self.lead]]

    def cuts(self, buckets: int) -> np.ndarray:
        """Entry ranges of the buckets."""
        edges = np.array([(b << 32) // buckets for b in range(1, buckets)], dtype=np.int64)
        inner = np.searchsorted((self.entry_anchor >> U64(32)).astype(np.int64), edges)
        return np.concatenate(([0], inner, [len(self.lead)])).astype(np.int64)


def _bytes(*arrays: np.ndarray) -> bytes:
    """Arrays of one blob, each after its length."""
    return b"".join(np.int64(a.nbytes).tobytes() + a.tobytes() for a in arrays)


def _arrays(blob, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int(np.frombuffer(blob, "<i8", 1, at)[0])
        out.append(np.frombuffer(blob, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def _narrow(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and 4-byte places."""
    values, place = np.unique(x, return_inverse=True)
    return values, place.astype("<u4" if len(values) > 65535 else "<u2")


def _batch(names: list[str], *columns: tuple[list, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=names)


def _report(buckets: int):
    """Shards to rows (bucket, shard, blob): distinct entries and their least documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"], row["at"], row["length"])
                cuts = shard.cuts(buckets)
                ids, rows = [], []
                for b in range(buckets):
                    part = slice(cuts[b], cuts[b + 1])
                    if cuts[b + 1] > cuts[b]:
                        values, place = _narrow(shard.entry_least[part])
                        h = (shard.entry_anchor[part] & U64((1 << 48) - 1)).astype("<u8")
                        six = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :6])
                        ids.append(b)
                        rows.append(_bytes(np.array([place.itemsize], np.uint8), values, place, six, shard.entry_context[part]))
                yield _batch(["bucket", "shard", "blob"], (ids, pa.int32()), ([row["shard"]] * len(ids), pa.int64()), (rows, pa.binary()))

    return run


def _read_report(blob) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hashes, context hashes, least documents)."""
    width = _arrays(blob, "u1")[0][0]
    _, values, place, six, context = _arrays(blob, "u1", "<i8", f"<u{width}", "u1", "<u8")
    h = np.zeros((len(context), 8), np.uint8)
    h[:, :6] = six.reshape(-1, 6)
    return h.view("<u8").ravel(), context, values[place]


def _meet(table: pa.Table) -> pa.Table:
    """One bucket's reports to answers: kind 0 to shards, kind 1 for the sorting step.

    Kind 0: entries whose strings all have a smaller document elsewhere; entries to send.
    Kind 1: who has which of the contexts that must be sorted.
    """
    bucket, shards = table["bucket"][0].as_py(), table["shard"].to_numpy()
    parts = [_read_report(b.as_buffer()) for b in table["blob"]]
    sizes = np.array([len(p[0]) for p in parts])
    h, c, least = (np.concatenate([p[k] for p in parts]) for k in range(3))
    owner = np.repeat(np.arange(len(parts)), sizes)
    local = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # an anchor that is reported once has no partner
    order = np.argsort(h)
    twin = h[order][1:] == h[order][:-1]
    order = order[np.append(False, twin) | np.append(twin, False)]
    order = order[np.lexsort((owner[order], least[order], c[order], h[order]))]
    same_h = np.zeros(len(order), dtype=bool)
    same_h[1:] = h[order][1:] == h[order][:-1]
    same = same_h.copy()
    same[1:] &= c[order][1:] == c[order][:-1]
    group, context = np.cumsum(~same_h) - 1, np.cumsum(~same) - 1
    leader = order[~same]  # by context: a report with the least document
    kinds = np.bincount(group[~same])
    several = kinds[group] > 1
    best = least[leader][context]
    out_shard, out_kind, out_blob = [], [], []
    beaten = ~several & (best < least[order])
    sends = several & ~same
    # both sorted by owner once, so that each shard has a slice
    ends = np.arange(len(parts) + 1)
    by_owner = np.argsort(owner[order[beaten]], kind="stable")
    answers, found = order[beaten][by_owner], best[beaten][by_owner]
    asked = order[sends]
    asked = asked[np.lexsort((local[asked], owner[asked]))]
    cut, cut_asked = np.searchsorted(owner[answers], ends), np.searchsorted(owner[asked], ends)
    for s in np.flatnonzero((np.diff(cut) > 0) | (np.diff(cut_asked) > 0)):
        mine, ask = slice(cut[s], cut[s + 1]), slice(cut_asked[s], cut_asked[s + 1])
        values, place = _narrow(found[mine])
        out_shard.append(shards[s])
        out_kind.append(0)
        out_blob.append(_bytes(np.array([place.itemsize], np.uint8), local[answers[mine]].astype("<u4"), values, place, local[asked[ask]].astype("<u4")))
    if several.any():
        # contexts in the order of (owner, entry) in which they will be sent
        sent = order[sends]
        rank = np.lexsort((local[sent], shards[owner[sent]]))
        nth = np.empty(len(sent), dtype=np.int64)
        nth[rank] = np.arange(len(sent))
        number = np.full(int(context[-1]) + 1, -1)
        number[context[sends]] = nth
        at = order[several]
        anchors = h[sent][rank]
        out_shard.append(-1)
        out_kind.append(1)
        ours = least[at] == best[several]
        out_blob.append(_bytes(anchors, least[sent][rank], number[context[several]].astype("<u4"), shards[owner[at]].astype("<i8"), local[at].astype("<u4"), ours.astype(np.uint8)))
    names = ["bucket", "shard", "kind", "blob"]
    return pa.Table.from_batches([_batch(names, ([bucket] * len(out_shard), pa.int32()), (out_shard, pa.int64()), (out_kind, pa.int32()), (out_blob, pa.binary()))])


def _send(buckets: int):
    """(shard's place, its answers) to (bucket, shard, blob): bytes of the contexts asked for."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        place = next(r for r in rows if r["kind"] < 0)
        asked = {r["bucket"]: np.frombuffer(r["blob"], np.uint8) for r in rows if r["kind"] == 0}
        ids, blobs = [], []
        wanted = {}
        for b, blob in asked.items():
            width = _arrays(blob, "u1")[0][0]
            entries = _arrays(blob, "u1", "<u4", "<i8", f"<u{width}", "<u4")[4]
            if len(entries):
                wanted[b] = entries
        if wanted:
            shard = Shard(place["path"], place["at"], place["length"])
            cuts = shard.cuts(buckets)
            for b, entries in wanted.items():
                lead = shard.lead[cuts[b] + entries]
                start, stop = shard.first[lead], shard.last[lead] + LENGTH
                size = stop - start
                at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                ids.append(b)
                blobs.append(_bytes(size.astype("<u4"), shard.offset[lead].astype("<u4"), shard.data[at]))
        return pa.Table.from_batches([_batch(["bucket", "shard", "blob"], (ids, pa.int32()), ([place["shard"]] * len(ids), pa.int64()), (blobs, pa.binary()))])

    return run


def least_documents(body: np.ndarray, size: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For every string of LENGTH bytes in each text, the least document of all equal strings.

    body is the texts one after another; they are sorted as one string with a mark after each.
    """
    stop = np.cumsum(size + 1)
    marked = np.full(int(stop[-1]), MARK, dtype=np.uint8)
    owner = np.repeat(np.arange(len(size)), size + 1)
    inner = np.ones(len(marked), dtype=bool)
    inner[stop - 1] = False
    marked[inner] = body
    array = suffix_array(marked, 256)
    common = permuted_common_prefixes(marked, array, LENGTH)
    first = np.flatnonzero(common[array] < LENGTH)
    whole = np.arange(len(marked)) + LENGTH < stop[owner]
    doc = np.where(whole, least[owner], NOBODY)
    best = np.empty(len(marked), dtype=np.int64)
    best[array] = np.repeat(np.minimum.reduceat(doc[array], first), np.diff(np.append(first, len(marked))))
    return best[whole]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+n[0]-1, start[1] .. and so on."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _near_strings(anchors: np.ndarray, body: np.ndarray, begin: np.ndarray, size: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) strings of each context that another of its anchor may have.

    A string takes in NEAR bytes before its anchor, or NEAR bytes behind it. Contexts that share
    neither with another are out; those that share one side keep that side's strings.
    """
    sums = prefix(body)
    at = begin + offset
    strings = size - LENGTH + 1
    left, right = offset >= NEAR, offset + GRAM + NEAR <= size

    def shared(has: np.ndarray, a: np.ndarray) -> np.ndarray:
        out = np.zeros(len(begin), dtype=bool)
        some = np.flatnonzero(has)
        side = span_hashes(sums, a[some], a[some] + NEAR)
        order = some[np.lexsort((side, anchors[some]))]
        key = np.empty(len(begin), dtype=U64)
        key[some] = side
        equal = (anchors[order[1:]] == anchors[order[:-1]]) & (key[order[1:]] == key[order[:-1]])
        out[order[1:][equal]] = True
        out[order[:-1][equal]] = True
        return out

    on_left, on_right = shared(left, at - NEAR), shared(right, at + GRAM)
    middle = np.clip(offset - NEAR + 1, 0, strings)  # strings before it take in the left side
    lo = np.where(on_left, 0, middle)
    hi = np.where(on_right, strings, middle)
    return lo, np.maximum(lo, hi)


def _equals_last(body: np.ndarray, start: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Whether the string at each start is that at the start before, byte for byte, where `which`."""
    words = np.ndarray((len(body) - 7,), dtype="<u8", buffer=body.data, strides=(1,))
    at = np.flatnonzero(which)
    for j in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        at = at[words[start[at] + j] == words[start[at - 1] + j]]
    out = np.zeros(len(start), dtype=bool)
    out[at] = True
    return out


def _shared_runs(sums: np.ndarray, anchors: np.ndarray, body: np.ndarray, begin: np.ndarray, size: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, ...]:
    """(context, first, last + 1) of each run of strings whose hash another context of the anchor has at the same place."""
    lo, hi = _near_strings(anchors, body, begin, size, offset)
    live = np.flatnonzero(hi > lo)
    lo, hi, base = lo[live], hi[live], offset[live] - (WINDOW - 1)
    shared = np.zeros((len(live), WINDOW + 2), dtype=np.int8)
    for j in range(WINDOW):
        some = np.flatnonzero((base + j >= lo) & (base + j < hi))
        start = begin[live[some]] + base[some] + j
        key = mix64(span_hashes(sums, start, start + LENGTH) ^ anchors[live[some]])
        order = np.argsort(key)
        twin = key[order[1:]] == key[order[:-1]]
        shared[some[order[1:][twin]], j + 1] = 1
        shared[some[order[:-1][twin]], j + 1] = 1
    turns = np.diff(shared, axis=1)
    row, first = np.nonzero(turns == 1)
    last = np.nonzero(turns == -1)[1]
    return live[row], base[row] + first, base[row] + last


def _sort_contexts(anchors: np.ndarray, least: np.ndarray, body: np.ndarray, size: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """least_documents over contexts: anchors kept together, a bounded piece at a time.

    Only runs of strings that another context may have are sorted, and of equal runs of an anchor (as of
    equal contexts before) that with the least document for all.
    """
    begin = np.cumsum(size) - size
    strings = size - LENGTH + 1
    place = np.cumsum(strings) - strings
    out = np.repeat(least, strings)
    sums = prefix(body)
    which, first, last = _shared_runs(sums, anchors, body, begin, size, offset)
    if not len(which):
        return out
    start, n, at = begin[which] + first, last - first, offset[which] - first
    key = span_hashes(sums, start, start + n + LENGTH - 1)
    order = np.lexsort((least[which], n, at, key, anchors[which]))
    place, start, n, at, key, group, docs = (x[order] for x in (place[which] + first, start, n, at, key, anchors[which], least[which]))
    differs = [x[1:] != x[:-1] for x in (group, key, at, n)]
    new = np.append(True, np.logical_or.reduce(differs))
    lead = np.flatnonzero(new)
    to = np.zeros(len(lead), dtype=np.int64)
    np.cumsum(n[lead][:-1], out=to[1:])
    best = np.repeat(docs[lead], n[lead])
    spread = (place, n, to[np.cumsum(new) - 1])
    start, n, at, group, docs = (x[lead] for x in (start, n, at, group, docs))
    edge = np.append(group[1:] != group[:-1], True)
    group = np.cumsum(edge) - edge
    long = np.bincount(group, weights=n + LENGTH) > 16 * SORT_BYTES

    plain = np.flatnonzero(~long[group])
    held = np.cumsum(n[plain] + LENGTH) // SORT_BYTES
    cuts, seen = [0], 0
    for i in np.flatnonzero(edge[plain]):
        if held[i] > seen or i == len(plain) - 1:
            cuts.append(int(i) + 1)
            seen = held[i]
    for a, b in zip(cuts, cuts[1:]):
        part = plain[a:b]
        width = n[part] + LENGTH - 1
        best[_ranges(to[part], n[part])] = least_documents(body[_ranges(start[part], width)], width, docs[part])
    # strings of one anchor are equal only at equal offsets from it: a very long group is taken apart by
    # that offset, and of equal strings the one with the least document is sorted for all
    for g in np.flatnonzero(long):
        part = np.flatnonzero(group == g)
        for reach in range(WINDOW):
            k = at[part] - reach
            has = (k >= 0) & (k < n[part])
            some, k = part[has], k[has]
            if not len(some):
                continue
            key = span_hashes(sums, start[some] + k, start[some] + k + LENGTH)
            order = np.lexsort((docs[some], key))
            some, k, key = some[order], k[order], key[order]
            alike = np.append(False, key[1:] == key[:-1])
            new = ~(alike & _equals_last(body, start[some] + k, alike))
            leads = np.flatnonzero(new & (alike | np.append(alike[1:], False)))
            # a piece ends where the hash changes
            held = np.arange(len(leads)) * LENGTH // SORT_BYTES
            held = held[np.searchsorted(key[leads], key[leads])]
            answer = docs[some]
            for one in np.split(leads, np.flatnonzero(np.diff(held)) + 1):
                if len(one):
                    width = np.full(len(one), LENGTH)
                    answer[one] = least_documents(body[_ranges(start[some[one]] + k[one], width)], width, docs[some[one]])
            best[to[some] + k] = answer[np.flatnonzero(new)[np.cumsum(new) - 1]]
    place, n, to = spread
    out[_ranges(place, n)] = best[_ranges(to, n)]
    return out


def _sort_bucket(key: tuple, asked: pa.Table, sent: pa.Table) -> pa.Table:
    """A bucket's contexts to answers for the shards: runs of strings with a smaller document."""
    names = ["bucket", "shard", "kind", "blob"]
    if not len(asked):
        return pa.Table.from_batches([_batch(names, ([], pa.int32()), ([], pa.int64()), ([], pa.int32()), ([], pa.binary()))])
    anchors, least, number, who, local, ours = _arrays(asked["blob"][0].as_buffer(), "<u8", "<i8", "<u4", "<i8", "<u4", "u1")
    parts = [_arrays(row["blob"], "<u4", "<u4", "u1") for row in sorted(sent.to_pylist(), key=lambda r: r["shard"])]
    size, offset, body = (np.concatenate([p[k] for p in parts]) for k in range(3))
    size, offset = size.astype(np.int64), offset.astype(np.int64)
    best = _sort_contexts(anchors, least, body, size, offset)
    # runs of equal answers within a context
    strings = size - LENGTH + 1
    place = np.cumsum(strings) - strings
    opens = np.append(True, best[1:] != best[:-1])
    opens[place] = True
    lo = np.flatnonzero(opens)
    doc = best[lo]
    hi = np.append(lo[1:], len(best))
    context = np.repeat(np.arange(len(size)), strings)[lo]
    lo, hi = lo - place[context], hi - place[context]
    many = np.bincount(context, minlength=len(size))
    begin = np.cumsum(many) - many
    n = many[number]
    at = np.repeat(begin[number] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    # a shard whose own least document is the answer needs none
    news = ~(np.repeat(ours.astype(bool), n) & (doc[at] >= np.repeat(least[number], n)))
    to, entry = np.repeat(who, n)[news], np.repeat(local, n)[news]
    at = at[news]
    order = np.argsort(to, kind="stable")
    to, entry, at = to[order], entry[order], at[order]
    shards, first = np.unique(to, return_index=True)
    blobs = []
    for a, b in zip(first, np.append(first[1:], len(to))):
        values, place = _narrow(doc[at[a:b]])
        blobs.append(_bytes(np.array([place.itemsize], np.uint8), entry[a:b].astype("<u4"), lo[at[a:b]].astype("<u4"), hi[at[a:b]].astype("<u4"), values, place))
    return pa.Table.from_batches([_batch(names, ([key[0].as_py()] * len(shards), pa.int32()), (shards.tolist(), pa.int64()), ([2] * len(shards), pa.int32()), (blobs, pa.binary()))])


def _finish(buckets: int, texts: bool):
    """A shard's place and answers to its documents."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        place = next(r for r in rows if r["kind"] < 0)
        shard = Shard(place["path"], place["at"], place["length"])
        cuts = shard.cuts(buckets)
        smallest = shard.entry_least.copy()  # of all strings of an entry
        entry, lo, hi, doc = [], [], [], []
        for r in rows:
            if r["kind"] < 0:
                continue
            blob, base = r["blob"], cuts[r["bucket"]]
            width = _arrays(blob, "u1")[0][0]
            if r["kind"] == 0:
                _, which, values, at, _ = _arrays(blob, "u1", "<u4", "<i8", f"<u{width}", "<u4")
                smallest[base + which] = values[at]
            else:
                _, which, a, b, values, at = _arrays(blob, "u1", "<u4", "<u4", "<u4", "<i8", f"<u{width}")
                entry.append(base + which)
                lo.append(a)
                hi.append(b)
                doc.append(values[at])
        total = len(shard.data)
        change = np.zeros(total + 1, dtype=np.int32)

        def remove(first: np.ndarray, last: np.ndarray) -> None:
            np.add.at(change, first, 1)
            np.add.at(change, last + LENGTH, -1)

        whole = smallest[shard.entry] < shard.ids[shard.doc]
        remove(shard.first[whole], shard.last[whole])
        if entry:
            # the anchors of each entry, times its runs
            e, a, b, d = (np.concatenate(x).astype(np.int64) for x in (entry, lo, hi, doc))
            by_entry = np.argsort(shard.entry, kind="stable")
            count = np.bincount(shard.entry, minlength=len(shard.lead))
            begin = np.cumsum(count) - count
            n = count[e]
            which = by_entry[np.repeat(begin[e] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            hit = np.repeat(d, n) < shard.ids[shard.doc[which]]
            start = shard.first[which]
            remove((start + np.repeat(a, n))[hit], (start + np.repeat(b, n) - 1)[hit])
        gone = np.cumsum(change[:-1]) > 0
        ids, sizes, removed, spans, digests, bodies = [], [], [], [], [], []
        for i, (a, b) in enumerate(zip(shard.offsets[:-1].tolist(), shard.offsets[1:].tolist())):
            out = gone[a:b]
            kept = shard.data[a:b][~out].tobytes()
            ids.append(int(shard.ids[i]) if shard.known[i] else None)
            sizes.append(b - a)
            removed.append(int(out.sum()))
            spans.append(int(out[:1].sum()) + int((out[1:] & ~out[:-1]).sum()))
            digests.append(hashlib.sha256(kept).hexdigest())
            bodies.append(kept if texts else None)
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        whole_table = _batch(names, (ids, pa.int64()), (sizes, pa.int64()), (removed, pa.int64()), (spans, pa.int64()), (digests, pa.string()), (bodies, pa.binary()))
        return pa.Table.from_batches([whole_table])

    return run


def remove_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of docs.

    kept is what is left of the text's bytes; null if not `texts`.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/repeats-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    packed = rows.mapInArrow(_packer(folder), "path string, at long, length long, n_bytes long")
    shards = as_table(packed.withColumn("shard", F.monotonically_increasing_id()), "repeats-shards")
    size, many = shards.agg(F.sum("n_bytes"), F.count(F.lit(1))).first()
    # about one anchor in 15 bytes, and 20 bytes for each
    entries = int(size or 0) * 20 // 15
    # a row for each pair of shard and bucket: beyond MANY_BUCKETS they are larger rather than more
    buckets = max(1, min(-(-entries // BUCKET_BYTES), max(MANY_BUCKETS, -(-entries // (4 * BUCKET_BYTES)))))

    reports = shards.repartition(min(max(1, many), 100_000)).mapInArrow(_report(buckets), "bucket int, shard long, blob binary")
    answers = as_table(reports.groupBy("bucket").applyInArrow(_meet, "bucket int, shard long, kind int, blob binary"), "repeats-answers")
    places = shards.select(F.lit(-1).alias("bucket"), "shard", F.lit(-1).alias("kind"), F.lit(None).cast("binary").alias("blob"), "path", "at", "length")
    nowhere = [F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("length")]
    to_shards = answers.where("kind = 0").select("bucket", "shard", "kind", "blob", *nowhere)
    sent = places.unionByName(to_shards).groupBy("shard").applyInArrow(_send(buckets), "bucket int, shard long, blob binary")
    asked = answers.where("kind = 1").groupBy("bucket")
    sorted_answers = asked.cogroup(sent.groupBy("bucket")).applyInArrow(_sort_bucket, "bucket int, shard long, kind int, blob binary")
    sorted_answers = as_table(sorted_answers, "repeats-sorted").select("bucket", "shard", "kind", "blob", *nowhere)
    everything = places.unionByName(to_shards).unionByName(sorted_answers)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return everything.groupBy("shard").applyInArrow(_finish(buckets, texts), schema)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, without the 50-byte strings of earlier ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, texts=False).drop("kept")
