"""Reading sorted Arrow batches by runs of one key, and binary columns made of numpy pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def column(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    c = batch.column(name)
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks()
        if isinstance(c, pa.ChunkedArray):
            c = pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
    return c.to_numpy(zero_copy_only=False)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, most: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of whole runs of equal ``key`` from a stream sorted by it, with False.

    A run longer than ``most`` comes in pieces with True as soon as it is known to be long, so no more than that is held.
    """
    held: list[pa.RecordBatch] = []  # pieces of the last run met, put together once it ends
    rows, held_key, long = 0, None, False
    for b in batches:
        if not b.num_rows:
            continue
        keys = column(b, key)
        if (held or long) and keys[0] == held_key:
            n = int(np.argmax(keys != held_key)) or len(keys)
            if long:
                yield pa.Table.from_batches([b.slice(0, n)]), True
            else:
                held.append(b.slice(0, n))
                rows += n
                if most is not None and rows > most:
                    yield pa.Table.from_batches(held), True
                    held, long = [], True
            if n == len(keys):
                continue
            b, keys = b.slice(n), keys[n:]
        last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        done = [*held, b.slice(0, last)] if last else held
        if done:
            t = pa.Table.from_batches(done)
            yield from _split(t, column(t, key), most)
        held, rows, held_key, long = [b.slice(last)], len(keys) - last, keys[-1], False
        if most is not None and rows > most:
            yield pa.Table.from_batches(held), True
            held, long = [], True
    if held:
        t = pa.Table.from_batches(held)
        yield from _split(t, column(t, key), most)


def _split(t: pa.Table, keys: np.ndarray, most: int | None) -> Iterator[tuple[pa.Table, bool]]:
    starts = bounds(keys)
    long = np.flatnonzero(np.diff(starts) > most) if most is not None else []
    at = 0
    for i in long:
        if starts[i] > at:
            yield t.slice(at, starts[i] - at), False
        yield t.slice(starts[i], starts[i + 1] - starts[i]), True
        at = starts[i + 1]
    if at < t.num_rows:
        yield t.slice(at), False


def bounds(keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal keys, and the length at the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).astype(np.int64)


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over pieces of ``data``; offsets in elements."""
    width = data.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())]).cast(pa.binary())


def pieces(c: pa.Array | pa.ChunkedArray, dtype=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a binary column without nulls and the offsets (in elements) of its rows."""
    if isinstance(c, pa.ChunkedArray):
        c = pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(c.buffers()[1], np.int32 if c.type == pa.binary() else np.int64)[c.offset : c.offset + len(c) + 1].astype(np.int64)
    data = np.frombuffer(c.buffers()[2] or b"", np.uint8)[raw[0] : raw[-1]]
    return data.view(dtype) if len(data) else np.zeros(0, dtype), (raw - raw[0]) // width
