"""Vectorised text kernels that run inside Arrow tasks.

Everything works on one slice of a text column at a time: the UTF-8 bytes of all
texts of the slice back to back plus the offsets of each text.  A slice is cut at
about ``SLICE_BYTES`` (one text is never cut), so the arrays of a task stay small
whatever the partition holds.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BUFFER_ROWS = 1_500_000
U64 = np.uint64
_P = 0x9E3779B97F4A7C15  # odd multipliers of the polynomial hashes
_Q = (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ U64(salt)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^j and base^-j modulo 2^64 for j < n; the longest so far is kept for each base."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << 16
        while size < n:
            size += size >> 1

        def run(b: int) -> np.ndarray:
            out, done = np.ones(size, U64), 1
            while done < size:
                more = min(done, size - done)
                out[done : done + more] = out[:more] * U64(pow(b, done, 1 << 64))
                done += more
            return out

        _POWERS[base] = run(base), run(pow(base, -1, 1 << 64))
    up, down = _POWERS[base]
    return up[:n], down[:n]


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_P), 0x5851F42D4C957F2D)


def give_back() -> None:
    """Hand freed memory back to the system: Python workers outlive their tasks and would
    keep it while the executor's JVM needs room."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


CACHES: list = []  # what a module keeps between its tasks in a worker: functions that let it go
_home: list[str] = []


def arrive(home: str) -> None:
    """A task of the module ``home`` begins in this worker: what other modules' tasks have left there goes."""
    if _home and _home[-1] != home:
        for clear in (_POWERS.clear, *CACHES):
            clear()
        give_back()
    _home[:] = [home]


def lean(run):
    """The task function ``run``, giving back memory at its end, and before its beginning what another operator has kept."""
    home = run.__module__

    def tidy(batches):
        arrive(home)
        try:
            yield from run(batches)
        finally:
            _POWERS.clear()  # made again in milliseconds; in idle workers they would stand beside the others' work
            give_back()

    return tidy


def lut(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Bytes that end a word: white space, and what is not a letter, digit or non-ASCII.
SPACE = lut([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = ~lut([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
LOWER_TABLE = LOWER.tobytes()


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES):
    """Cut a batch into row slices of about ``size`` text bytes each."""
    _, off = flat(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(off, off[start] + size, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def ints(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A long column without nulls as numpy."""
    return batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False).astype(np.int64)


def words(data: np.ndarray, off: np.ndarray, separator: np.ndarray):
    """Start and end of every word, and for each text the number of its first word."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~separator[data]
    edge = off[(off > 0) & (off < n)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running polynomial sum."""
    up, down = powers(_P, len(data) + 1)
    run = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * up[:-1], out=run[1:])
    return mix((run[end] - run[start]) * down[start], 0) + mix((end - start).astype(U64))


def window_hashes(values: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values: one number per start."""
    n = len(values)
    if n < k:
        return np.zeros(0, U64)
    up, down = powers(_Q[which], n + 1)
    run = np.zeros(n + 1, U64)
    np.cumsum(mix(values, which * 0x632BE59BD9B4E019) * up[:-1], out=run[1:])
    return mix((run[k:] - run[:-k]) * down[: n + 1 - k], k)


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """True for each word number at which ``k`` words of the same text begin."""
    n = int(first[-1])
    ok = np.zeros(max(0, n - k + 1), bool)
    if len(ok):
        left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
        ok[:] = left[: len(ok)] >= k
    return ok


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0]..start[0]+count[0]-1, start[1].. and so on, back to back."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return shift + np.arange(total)


def group_starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """True where a row differs from the row before it."""
    n = len(sorted_keys[0])
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = False
        for key in sorted_keys:
            new[1:] |= key[1:] != key[:-1]
    return new


def run_lengths(new: np.ndarray) -> np.ndarray:
    """For each row, the size of its run."""
    at = np.flatnonzero(new)
    size = np.diff(np.concatenate((at, [len(new)])))
    return np.repeat(size, size)


def random_keys(n: int, seed: int, counter: int) -> np.ndarray:
    """Keys that spread rows which need no partner."""
    return mix(np.arange(counter, counter + n, dtype=U64), (seed * 0xA24BAED4963EE407) & (2**64 - 1)).view(np.int64)


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


class Buffer:
    """Collects numpy columns and hands them out in lots of bounded size."""

    def __init__(self, width: int, most: int | None = None):
        self.parts, self.rows, self.width, self.most = [], 0, width, most or BUFFER_ROWS

    def add(self, *columns) -> bool:
        if len(columns[0]):
            self.parts.append(columns)
            self.rows += len(columns[0])
        return self.rows >= self.most

    def take(self):
        parts, self.parts, self.rows = self.parts, [], 0
        return [np.concatenate([p[i] for p in parts]) for i in range(self.width)] if parts else None


def spread(key, known, seed, counter):
    """Rows that are already known to repeat need no partner: they get keys of their own."""
    return np.where(known, random_keys(len(key), seed, counter), key)


def gather(batches, names):
    parts = [[ints(b, n) if n != "known" else b.column(n).to_numpy(zero_copy_only=False) for n in names] for b in batches if b.num_rows]
    return [np.concatenate([p[i] for p in parts]) for i in range(len(names))] if parts else None


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: planes of zeros cost nothing once compressed."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplanes(raw: memoryview, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T).view(kind).ravel()


def pack(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, check: np.ndarray, known: np.ndarray, parts: int):
    """Places (key, doc, pos and 16 more bits of the key) in one packed row for each of
    ``parts`` ranges of the key: about a third of the bytes that single rows take."""
    key = key.view(U64)
    order = np.argsort(key)
    key, doc, pos, check, known = key[order], doc[order], pos[order], check[order], known[order]
    border = np.searchsorted(((key >> U64(32)) * U64(parts)) >> U64(32), np.arange(parts + 1, dtype=U64))
    rows = ([], [])
    for p in np.flatnonzero(np.diff(border)):
        s = slice(border[p], border[p + 1])
        ids, which = np.unique(doc[s], return_inverse=True)
        head = np.array([len(which), len(ids)], "<i8").tobytes()
        body = [_planes(np.diff(key[s], prepend=U64(0))), _planes(np.diff(ids, prepend=0)), _planes(which.astype("<u4")), _planes(pos[s].astype("<u4")), check[s].astype("<u2").tobytes(), known[s].astype(np.uint8).tobytes()]
        rows[0].append(int(p))
        rows[1].append(head + b"".join(body))
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary())], names=["part", "places"])


def unpack(blobs):
    """key, doc, pos, check and known of all packed rows."""
    parts = []
    for blob in blobs:
        raw = memoryview(blob.as_buffer())
        n, m = np.frombuffer(raw, "<i8", 2)
        at, out = 16, []
        for kind, size in (("<u8", n), ("<i8", m), ("<u4", n), ("<u4", n)):
            out.append(_unplanes(raw[at:], size, kind))
            at += size * np.dtype(kind).itemsize
        check = np.frombuffer(raw[at:], "<u2", n)
        known = np.frombuffer(raw[at + 2 * n :], np.uint8, n) > 0
        parts.append((np.cumsum(out[0], dtype=U64).view(np.int64), np.cumsum(out[1])[out[2]], out[3].astype(np.int64), check, known))
    return [np.concatenate([p[i] for p in parts]) for i in range(5)]
