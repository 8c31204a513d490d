"""Finding equal 64-bit numbers among very many, at a few bytes a number.

A chunk (a row with an id and bytes from which its numbers can be made again at any time) sorts its numbers, cuts them
into buckets by their highest bits and sends each bucket as packed differences. One group then holds a bucket of all
chunks, sorts it and answers with one bit a number: whether another number is equal. No row per number ever exists.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: Numbers in a bucket; a bucket is sorted in one go, so this bounds the memory of a task.
BUCKET = 1 << 20
#: Bytes of a check that travel with a number.
CHECK = 6
SENT = "chunk long, part int, bucket int, blob binary"
SENT_ARROW = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])


def mix(x: np.ndarray) -> np.ndarray:
    """A well mixed permutation of uint64, in a new array."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: n, bytes of a difference, whether values stand several times, whether there are checks, first value, size of the packed body.
HEAD = "<IB??QI"


def pack(values: np.ndarray, again: np.ndarray, checks: np.ndarray | None = None) -> bytes:
    """Sorted uint64 as byte planes of their differences, a bit each for those that stand several times, the low CHECK bytes of a uint64 beside each if given."""
    steps = np.diff(values)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    body = zstandard.compress(planes.tobytes() + (np.packbits(again).tobytes() if again.any() else b""), 1)
    return struct.pack(HEAD, len(values), width, again.any(), checks is not None, int(values[0]), len(body)) + body + (b"" if checks is None else checks.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CHECK].tobytes())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """values, again, checks."""
    n, width, some, checked, first, size = struct.unpack_from(HEAD, blob)
    at = struct.calcsize(HEAD)
    body = np.frombuffer(zstandard.decompress(blob[at : at + size]), np.uint8)
    cut = width * (n - 1)
    steps = np.zeros((n, 8), np.uint8)
    if n > 1:
        steps[1:, :width] = body[:cut].reshape(width, n - 1).T
    values = steps.view(np.uint64).ravel()
    values[0] = first
    again = np.unpackbits(body[cut:], count=n).view(bool) if some else np.zeros(n, bool)
    if not checked:
        return np.cumsum(values, dtype=np.uint64), again, None
    checks = np.zeros((n, 8), np.uint8)
    checks[:, :CHECK] = np.frombuffer(blob, np.uint8, offset=at + size).reshape(n, CHECK)
    return np.cumsum(values, dtype=np.uint64), again, checks.view(np.uint64).ravel()


def bucket_bits(total: int) -> int:
    """So that a bucket has BUCKET numbers or fewer, on average."""
    return max(0, (total - 1).bit_length() - (BUCKET.bit_length() - 1))


def cuts(values: np.ndarray, bits: int, width: int) -> tuple[list[int], list[int]]:
    """Buckets that sorted numbers of `width` bits have, and where each begins, and the end."""
    bucket = values >> np.uint64(width - bits) if bits else np.zeros(len(values), np.uint64)
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(values) else np.empty(0, np.int64)
    return bucket[at].tolist(), [*at.tolist(), len(values)]


def kinds(values: np.ndarray) -> np.ndarray:
    """Marks the first of each run of equal numbers."""
    return np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.empty(0, bool)


def sent(chunk: int, part: int, values: np.ndarray, bits: int, width: int, checks: np.ndarray | None = None) -> Iterator[tuple[int, int, int, bytes]]:
    """The rows of one part of a chunk; values are sorted. checks: more bits of each number, which must be equal too.

    A number that the part has several times is sent once, so no number, however frequent, has more entries than there
    are parts. Only where equal numbers of a part have unequal checks are all of a bucket sent one by one.
    """
    buckets, at = cuts(values, bits, width)
    for bucket, a, b in zip(buckets, at, at[1:]):
        first = kinds(values[a:b])
        if checks is not None and ((checks[a + 1 : b] != checks[a : b - 1]) & ~first[1:]).any():
            first[:] = True
        where = np.flatnonzero(first)
        again = np.diff(where, append=b - a) > 1
        yield chunk, part, bucket, pack(values[a:b][where], again, None if checks is None else checks[a:b][where])


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SENT_ARROW.types)], schema=SENT_ARROW)


def _tied(group: pa.Table) -> pa.Table:
    blobs = [unpack(x.as_buffer().to_pybytes()) for x in group["blob"]]
    values, mark = np.concatenate([b[0] for b in blobs]), np.concatenate([b[1] for b in blobs])
    order = np.argsort(values)
    same = np.diff(values[order]) == 0
    if blobs[0][2] is not None:
        checks = np.concatenate([b[2] for b in blobs])
        agree = np.diff(checks[order]) == 0
        if (same & ~agree).any():  # unequal strings with equal numbers: only now does the order by checks matter
            order = np.lexsort((checks, values))
            same, agree = np.diff(values[order]) == 0, np.diff(checks[order]) == 0
        same &= agree
    mark[order[1:][same]] = mark[order[:-1][same]] = True
    ends = np.cumsum([len(b[0]) for b in blobs])
    keep, marks = [], []
    for i, own in enumerate(np.split(mark, ends[:-1])):
        if own.any():
            keep.append(i)
            marks.append(bytes([len(own) > 1 and not np.diff(blobs[i][0]).all()]) + np.packbits(own).tobytes())
    out = group.select(["chunk", "part", "bucket"]).take(pa.array(keep, pa.int64()))
    return pa.Table.from_arrays([*out.columns, pa.array(marks, pa.binary())], schema=SENT_ARROW)


def ties(rows: DataFrame, bits: int, per_task: int = 4) -> DataFrame:
    """rows: SENT. Of every bucket of every chunk part that has a number equal to another: SENT, with a bit per number sent, in order, as blob, after a byte that is 1 if equal numbers were sent one by one."""
    tasks = max(1, (1 << bits) // per_task)
    return rows.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_tied, SENT)


def marked(values: np.ndarray, bits: int, width: int, rows: list[tuple[int, bytes]]) -> np.ndarray:
    """The bits of one chunk part, by place in its sorted numbers. rows: bucket and blob."""
    out, (buckets, at) = np.zeros(len(values), bool), cuts(values, bits, width)
    told = dict(rows)
    for bucket, a, b in zip(buckets, at, at[1:]):
        if bucket in told:
            kind = np.cumsum(kinds(values[a:b])) - 1
            one_by_one, got = told[bucket][0], np.frombuffer(told[bucket], np.uint8)[1:]
            out[a:b] = np.unpackbits(got, count=b - a).view(bool) if one_by_one else np.unpackbits(got, count=int(kind[-1]) + 1).view(bool)[kind]
    return out
