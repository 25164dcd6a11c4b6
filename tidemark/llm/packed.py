"""Sorted hash arrays in the shared folder that workers map into memory, and packed columns between tasks."""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa

ROW = "kind string, shard int, blob binary"


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts ``keys``, and where in it each distinct key begins."""
    order = np.argsort(keys)
    k = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)


def by_small(ids: np.ndarray) -> np.ndarray:
    """A stable order of small integers."""
    return np.argsort(ids.astype(np.uint16) if len(ids) and ids.max() < 1 << 16 else ids, kind="stable")


def write_array(path: str, array: np.ndarray) -> None:
    """Whole or not at all, so that a task that runs twice does no harm."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(np.ascontiguousarray(array).tobytes())
    os.replace(part, path)


def mapped(path: str, kind: str) -> np.ndarray:
    """An array in the shared folder, mapped into memory; one that nobody wrote is empty."""
    return np.memmap(path, kind, "r") if os.path.exists(path) else np.empty(0, kind)


class Maps:
    """The arrays that a worker has mapped, at most ``most`` at a time, as each holds a file open: the one not read for longest is let go.

    Look-ups go shard by shard, so a worker never needs more than the few arrays of one shard at once.
    """

    def __init__(self, most: int = 256):
        self.most, self.held = most, OrderedDict()

    def __reduce__(self) -> tuple:
        return Maps, (self.most,)

    def __call__(self, path: str, kind: str) -> np.ndarray:
        got = self.held.get((path, kind))
        if got is None:
            while len(self.held) >= self.most:
                self.held.popitem(last=False)
            got = self.held[path, kind] = mapped(path, kind)
        else:
            self.held.move_to_end((path, kind))
        return got


# --- sorted hash arrays -----------------------------------------------------------------------


def _bits(n: int) -> int:
    """Bits of the hash that choose a bucket of about sixteen keys."""
    return max(0, (n // 16).bit_length() - 1) if n >= 32 else 0


def write_table(path: str, keys: np.ndarray, **columns: np.ndarray) -> None:
    """Sorted distinct hashes and their columns. Hashes in a table should differ in their first bits.

    The first bits choose a bucket, whose first place is stored; of each key the next 32 bits are stored. So a look-up of an
    absent key finds one with a probability of about 16 / 2^32.
    """
    if not len(keys):
        return
    bits = _bits(len(keys))
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    write_array(f"{path}.at", np.searchsorted(bucket, np.arange((1 << bits) + 1)).astype("<u4"))
    for name, column in columns.items():
        write_array(f"{path}.{name}", column.astype("<u4" if column.max() < 1 << 32 else "<i8"))
    write_array(f"{path}.key", ((keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4"))


def places(at: np.ndarray, keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places of hashes in a table, -1 where absent: binary searches in buckets, all side by side."""
    bits = (len(at) - 1).bit_length() - 1
    bucket = (asked >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(asked), np.int64)
    want = ((asked >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
    lo, hi = at[bucket].astype(np.int64), at[bucket + 1].astype(np.int64)
    end, last = hi, len(keys) - 1
    for _ in range(int((hi - lo).max(initial=0)).bit_length()):
        mid = (lo + hi) >> 1
        less = (keys[np.minimum(mid, last)] < want) & (lo < hi)
        lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
    return np.where((lo < end) & (keys[np.minimum(lo, last)] == want), lo, -1)


# --- packed counts between tasks ----------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(x).view("u1").reshape(len(x), -1).T).tobytes()


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal lengths, byte by byte, compressed."""
    raw = b"".join(map(_planes, columns))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    """The columns of several packed rows one after the other."""
    widths, out = [np.dtype(k).itemsize for k in kinds], [[] for _ in kinds]
    for blob in blobs:
        size = int.from_bytes(blob[:8], "little")
        raw, at = np.frombuffer(pa.decompress(blob[8:], size, codec="zstd"), "u1"), 0
        n = size // sum(widths)
        for o, k, w in zip(out, kinds, widths, strict=True):
            o.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(k).ravel())
            at += n * w
    return [np.concatenate(o) if o else np.empty(0, k) for o, k in zip(out, kinds, strict=True)]


def rows_of(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "shard", "blob"])


def dealt(kind: str, shard: np.ndarray, *columns: np.ndarray) -> list[tuple[str, int, bytes]]:
    """A packed row for each shard. Within a shard the order stays."""
    if not len(shard):
        return []
    order = by_small(shard)
    shard, cols = shard[order], [c[order] for c in columns]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
    return [(kind, int(shard[a]), pack(*(c[a:b] for c in cols))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
