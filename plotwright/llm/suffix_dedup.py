"""Removing byte strings that repeat anywhere in the corpus: suffixes are sorted bucket by bucket, after a difference-cover sample has told which of them can tie."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwright.llm import packed
from plotwright.llm.common import dealt_documents, durable, join_hot, shared_dir

LENGTH = 200
#: Bytes of text in a chunk row (a longer document is a chunk of its own), in a bucket of the chunk table, and suffixes sorted at once.
CHUNK, TABLE_BUCKET, PART = 8 << 20, 16 << 20, 1 << 21
SPARE = 12
#: What a mark that goes back to its chunk is about.
SAMPLE, SUFFIX, COPY = 0, 1, 2
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15


@lru_cache
def cover(r: int = 1) -> tuple[int, list[int]]:
    """A difference cover by the rule of Colbourn and Ling: 6r + 4 residues modulo 24r(r + 1) + 12r + 13, whose differences are all residues."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, [0, *np.cumsum(steps).tolist()]


@lru_cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte; powers of the base and of its inverse."""

    def powers(x: int) -> np.ndarray:
        out = np.full(PART + LENGTH + 1, x, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return np.random.default_rng(BASE % 1000).integers(0, 1 << 64, 256, np.uint64), powers(BASE), powers(pow(BASE, -1, 1 << 64))


class Chunk:
    """Some documents' bytes, one after the other."""

    def __init__(self, body: bytes, lens: np.ndarray):
        self.flat = np.frombuffer(body, np.uint8)
        self.lens = lens
        self.ends = np.cumsum(lens)
        self.starts = self.ends - lens
        self.open = np.ones(len(lens), bool)  # documents whose suffixes take part

    def parts(self) -> Iterator[tuple[int, int, int]]:
        for part, start in enumerate(range(0, len(self.flat), PART)):
            yield part, start, min(PART, len(self.flat) - start)

    def sums(self, start: int, n: int) -> np.ndarray:
        """Polynomial prefix sums over the part and what its last suffixes need beyond it."""
        number, power, _ = tables()
        b = self.flat[start : start + n + LENGTH]
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(number[b] * power[: len(b)])])

    def hashes(self, sums: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        """Of the strings of so many bytes from the places `at` in the part."""
        return packed.mix((sums[at + length] - sums[at]) * tables()[2][at])

    def places(self, start: int, n: int, length: int, sampled: bool) -> np.ndarray:
        """Places in the part from which `length` bytes lie in one document; only those of the cover if sampled (by place in the document)."""
        first, last = np.searchsorted(self.ends, [start, start + n - 1], "right")
        docs = np.arange(first, last + 1)
        a, b = np.maximum(self.starts[docs], start), np.minimum(self.ends[docs] - length + 1, start + n)
        size = np.where(self.open[docs], np.maximum(b - a, 0), 0)
        at = np.arange(size.sum()) + np.repeat(a - (np.cumsum(size) - size), size)
        if sampled:
            v, residues = cover()
            wanted = np.zeros(v, bool)
            wanted[residues] = True
            at = at[wanted[(at - np.repeat(self.starts[docs], size)) % v]]
        return at - start

    def samples(self, start: int, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Cover-sample suffixes of the part: places and names, the names sorted. A name stands for the first bytes, as many as any string of LENGTH has after its first cover place."""
        length = LENGTH - cover()[0] + 1
        at = self.places(start, n, length, True)
        name = self.hashes(self.sums(start, n), at, length) >> np.uint64(64 - width)
        order = np.argsort(name, kind="stable")
        return at[order], name[order]

    def suffixes(self, start: int, n: int, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes of the part that can tie over LENGTH bytes, since a cover sample in reach is tied; places and sort keys, the keys sorted."""
        at = self.places(start, n, LENGTH, False)
        seen = np.cumsum(np.concatenate([[0], tied[start : start + n + cover()[0]]]), dtype=np.int32)
        at = at[seen[np.minimum(at + cover()[0], len(seen) - 1)] > seen[at]]
        key = self.hashes(self.sums(start, n), at, LENGTH)
        order = np.argsort(key, kind="stable")
        return at[order], key[order]

    def checks(self, start: int, at: np.ndarray) -> np.ndarray:
        """48 more bits of the strings of LENGTH bytes, folded eight bytes at a time, so that no algebra of the sort keys carries over."""
        eight = np.lib.stride_tricks.sliding_window_view(self.flat[start:], 8)
        h = np.full(len(at), BASE, np.uint64)
        for k in range(0, LENGTH, 8):
            h ^= eight[at + k].view(np.uint64).ravel()
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        return h >> np.uint64(16)


def _rows(batches):
    """Documents of a partition as chunk rows."""
    base = TaskContext.get().partitionId() << 32
    for b in batches:
        text = pc.fill_null(b.column(1).cast(pa.large_binary()), b"")
        lens = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lens)
        i = 0
        while i < len(lens):
            done = ends[i] - lens[i]
            j = max(i + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
            body = b"".join(x.as_buffer() for x in text[i:j] if len(x.as_buffer()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([base], pa.int64()), pa.array([b.column(0)[i:j].to_pylist()], pa.list_(pa.int64())), pa.array([lens[i:j].tolist()], pa.list_(pa.int64())), pa.array([zstandard.compress(body, 3)], pa.binary())],
                names=["chunk", "ids", "lens", "body"],
            )
            base, i = base + 1, j


def _chunk(group: pa.Table, told: dict | None = None) -> tuple[int, Chunk, np.ndarray]:
    """The id of a chunk row, the chunk without its redundant copies, and the numbers of all its copies."""
    c = Chunk(zstandard.decompress(group["body"][0].as_py()), np.array(group["lens"][0].as_py(), np.int64))
    copies = [(doc, first) for (phase, doc), rows in (told or {}).items() if phase == COPY for first, _ in rows]
    c.open[[doc for doc, first in copies if not first]] = False
    return group["chunk"][0].as_py(), c, np.array([doc for doc, _ in copies], np.int64)


def _digests(own: pa.Table) -> pa.Table:
    """Of every document that has a string of LENGTH: chunk, number in the chunk, digest."""
    chunk, c, _ = _chunk(own)
    long = np.flatnonzero(c.lens >= LENGTH).tolist()
    digests = [hashlib.blake2b(c.flat[c.starts[i] : c.ends[i]], digest_size=16).digest() for i in long]
    return pa.Table.from_pydict({"chunk": pa.array([chunk] * len(long), pa.int64()), "part": pa.array(long, pa.int32()), "digest": pa.array(digests, pa.binary())})


def _copies(chunks: DataFrame) -> DataFrame:
    """SENT and phase of all documents that have equal ones: part is the number in the chunk, bucket is 1 for the first of its kind."""
    rows = durable(chunks.groupBy("chunk").applyInArrow(_digests, "chunk long, part int, digest binary"))
    kinds = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("chunk", "part")).alias("first")).where("n > 1")
    first = (F.struct("chunk", "part") == F.col("first")).cast("int")
    return join_hot(rows, kinds, "digest", "n", rows.count()).select("chunk", "part", first.alias("bucket"), F.lit(None).cast("binary").alias("blob"), F.lit(COPY).alias("phase"))


def _told(group: pa.Table) -> dict[tuple[int, int], list[tuple[int, bytes]]]:
    """Marks by phase and part."""
    out: dict = {}
    for phase, part, bucket, blob in zip(*(group[c].to_pylist() for c in ("phase", "part", "bucket", "blob"))):
        out.setdefault((phase, part), []).append((bucket, blob))
    return out


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, binary) of every row of docs.

    A byte goes if a string of LENGTH bytes over it, within its document, also starts anywhere else. Null texts are
    empty; shorter documents lose nothing; repeated rows lose all that they share; a document of any length is a chunk of
    its own at most. Strings are judged on the input. Only key and text are read, so other columns can't clash. An empty
    table gives an empty one.

    1. Documents are written once as compressed chunks, in a table bucketed by chunk, so that no later step shuffles text.
       Of equal documents all bytes go, and only the first takes part in what follows, so copies cost nothing.
    2. Suffixes at difference-cover places are named by their first bytes; names are sorted bucket by bucket
       (packed.py) and tied ones are marked. If two strings of LENGTH bytes are equal, some place lies in the cover for
       both, so both have a tied sample in reach.
    3. Only suffixes with a tied sample in reach are sorted, by the hash of LENGTH bytes and again bucket by bucket, so
       that a task holds one bucket. Order among unequal suffixes isn't needed, so a 64-bit hash stands for them; those
       that tie must agree in 48 bits of a second hash of another kind as well, so 112 bits stand for a string. A string that many places have is one
       entry of each part that has it.
    4. Marks go back to their chunks, which take out what is covered.
    """
    spark = docs.sparkSession
    own = f"plotwright_{uuid.uuid4().hex}"  # a database in the shared folder, for the one table
    spark.sql(f"create database {own} location '{shared_dir(spark)}/{own}'")
    try:
        return _repeated(docs, f"{own}.chunks", key, text, with_kept)
    finally:
        spark.sql(f"drop database {own} cascade")


def _repeated(docs: DataFrame, name: str, key: str, text: str, with_kept: bool) -> DataFrame:
    """What repeated does, with the chunks in the table of that name."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 1
    tasks = max(1, -(-total // TABLE_BUCKET))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_rows, "chunk long, ids array<long>, lens array<long>, body binary")
    rows.write.bucketBy(tasks, "chunk").saveAsTable(name)
    chunks = spark.table(name)
    v, residues = cover()
    n_samples = max(2, total * len(residues) // v)
    width = min(64, (n_samples - 1).bit_length() + SPARE)
    bits = (min(packed.bucket_bits(n_samples), width), packed.bucket_bits(max(2, total // 4)))
    empty = packed.SENT_ARROW.empty_table()

    def send_samples(own: pa.Table, told: pa.Table) -> pa.Table:
        if not len(own):
            return empty
        chunk, c, _ = _chunk(own, _told(told))
        sent = [row for part, start, n in c.parts() for row in packed.sent(chunk, part, c.samples(start, n, width)[1], bits[0], width)]
        return pa.Table.from_batches([packed.batch(sent)]) if sent else empty

    def tied_samples(c: Chunk, told: dict) -> np.ndarray:
        tied = np.zeros(len(c.flat), bool)
        for part, start, n in c.parts():
            if (SAMPLE, part) in told:
                at, names = c.samples(start, n, width)
                tied[start + at[packed.marked(names, bits[0], width, told[SAMPLE, part])]] = True
        return tied

    def send_suffixes(own: pa.Table, told: pa.Table) -> pa.Table:
        if not len(own) or not len(told):
            return empty
        marks = _told(told)
        chunk, c, _ = _chunk(own, marks)
        tied = tied_samples(c, marks)
        sent = []
        for part, start, n in c.parts():
            at, keys = c.suffixes(start, n, tied)
            sent += packed.sent(chunk, part, keys, bits[1], 64, c.checks(start, at) if len(at) else None)
        return pa.Table.from_batches([packed.batch(sent)]) if sent else empty

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.binary())] * with_kept)

    def take_out(own: pa.Table, told: pa.Table) -> pa.Table:
        if not len(own):
            return schema.empty_table()
        marks = _told(told)
        _, c, copies = _chunk(own, marks)
        step = np.zeros(len(c.flat) + 1, np.int32)
        np.add.at(step, c.starts[copies], 1)
        np.add.at(step, c.ends[copies], -1)
        if any(phase == SUFFIX for phase, _ in marks):
            tied = tied_samples(c, marks)
            for part, start, n in c.parts():
                if (SUFFIX, part) in marks:
                    at, keys = c.suffixes(start, n, tied)
                    at = start + at[packed.marked(keys, bits[1], 64, marks[SUFFIX, part])]
                    np.add.at(step, at, 1)
                    np.add.at(step, at + LENGTH, -1)
        gone = np.cumsum(step[:-1], dtype=np.int32) > 0
        out = []
        for doc_id, a, b in zip(own["ids"][0].as_py(), c.starts.tolist(), c.ends.tolist()):
            g = gone[a:b]
            removed = int(g.sum())
            spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + g[0]) if removed else 0
            kept = c.flat[a:b][~g].tobytes() if removed else c.flat[a:b].tobytes()
            out.append((doc_id, b - a, removed, spans, hashlib.sha256(kept).hexdigest(), kept))
        return pa.Table.from_arrays([pa.array(col, t) for col, t in zip(zip(*out), schema.types)], schema=schema)

    copies = durable(_copies(chunks))
    samples = chunks.groupBy("chunk").cogroup(copies.groupBy("chunk")).applyInArrow(send_samples, packed.SENT)
    first = durable(packed.ties(samples, bits[0]).withColumn("phase", F.lit(SAMPLE)).unionByName(copies))
    suffixes = chunks.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(send_suffixes, packed.SENT)
    both = first.unionByName(packed.ties(suffixes, bits[1]).withColumn("phase", F.lit(SUFFIX)))
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return durable(chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(take_out, ddl))


def op10_cover_suffixes(spark, sf_dir):
    return repeated(dealt_documents(spark, sf_dir))


#: The same rows by definition, for small tables: every string of LENGTH bytes (as hex digits) is counted, and the bytes of those that stand twice go.
ORACLE = f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, length(hex(encode(coalesce(text, '')))) // 2 as n from documents),
k as (select doc_id, s, md5(substr(h, s * 2 + 1, {2 * LENGTH})) as m from (select doc_id, h, unnest(range(0, n - {LENGTH - 1})) as s from d where n >= {LENGTH})),
r as (select doc_id, s from (select doc_id, s, count(*) over (partition by m) as c from k) where c > 1),
g as (select doc_id, s, sum(case when s <= before + {LENGTH} then 0 else 1 end) over (partition by doc_id order by s) as run from (select doc_id, s, lag(s) over (partition by doc_id order by s) as before from r)),
runs as (select doc_id, min(s) as a, max(s) + {LENGTH} as z from g group by doc_id, run),
gaps as (select doc_id, z as a, lead(a) over (partition by doc_id order by a) as z from runs union all select doc_id, 0, min(a) from runs group by doc_id),
kept as (select doc_id, string_agg(substr(h, a * 2 + 1, (coalesce(z, n) - a) * 2), '' order by a) as h from gaps join d using (doc_id) group by doc_id),
cut as (select doc_id, count(*) as spans, sum(z - a) as removed from runs group by doc_id)
select d.doc_id, n::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256
from d left join cut using (doc_id) left join kept using (doc_id)
"""
