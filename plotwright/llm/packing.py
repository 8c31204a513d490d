"""Packing documents into sequences of one length, in the order of a Hilbert curve through document vectors."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotwright.llm.common import dealt_documents, durable

LENGTH = 2048
#: Axes of the curve and bits on each; a vector has so many hashed places before it is projected.
AXES, BITS, PLACES, SEED = 4, 12, 4096, 20_011
#: Chunks of text that a worker remembers; missed chunks that are encoded together; ids of pieces sent on at once.
MEMORY, TOGETHER, BATCH_IDS = 1_000_000, 256, 1 << 21
#: Light rows of a task while they are ordered.
ORDERED = 1 << 20
#: Stands between missed chunks. No other text has its id.
BETWEEN = "\x01"
#: Signs that may end a chunk of letters; letters of scripts that every table of Unicode agrees on stand below LETTERS.
SIGNS, LETTERS = ".,;:!?)", "\u0530"


class WordIds:
    """Ids of whole texts by a tokenizer that drops white space and case and never merges over white space, so chunks between spaces are remembered.

    A chunk of letters and a sign is put together from its word in lower case and the sign, so a word costs the
    tokenizer one call whatever stands around it. Words are encoded many at once; each ends with the one id of its that
    stands at ends of words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.between = self.alone(BETWEEN)
        if len(self.between) != self.kind.itemsize or self.alone("Ab cd.") != b"".join(map(self.alone, ("ab", "cd", "."))) or not self.ends[np.frombuffer(self.alone("ab"), self.kind)[-1]]:
            raise ValueError("a tokenizer is needed that drops case and white space and marks ends of words")

    def alone(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, self.kind).tobytes()

    def cut(self, chunks: list[str], between: str, border) -> None:
        """Remembers chunks, encoded many at once; border: where ids end a chunk, and how many ids stand between two."""
        size, groups = self.kind.itemsize, [chunks[i : i + TOGETHER] for i in range(0, len(chunks), TOGETHER)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([between.join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            ends, skip = border(ids)
            at, whole = 0, ids.tobytes()
            for c, z in zip(group, (ends * size).tolist()):
                self.known[c] = whole[at:z]
                at = z + skip * size

    def learn(self, chunks: set[str]) -> None:
        made, odd = {}, []
        for c in chunks:
            word = c.rstrip(SIGNS)
            low = word.lower()
            if low.isalpha() and max(low) < LETTERS and "Σ" not in word:
                made[c] = low, c[len(word) :]
            else:
                odd.append(c)
        self.cut([w for w in {w for w, _ in made.values()} if w not in self.known], " ", lambda ids: (np.flatnonzero(self.ends[ids]) + 1, 0))
        between = np.frombuffer(self.between, self.kind)[0]
        self.cut([c for c in {*odd, *(sign for _, sign in made.values())} if c not in self.known and BETWEEN not in c], f" {BETWEEN} ", lambda ids: (np.append(np.flatnonzero(ids == between), len(ids)), 1))
        self.known.update((c, self.alone(c)) for c in odd if BETWEEN in c)
        self.known.update((c, self.known[w] + self.known[sign]) for c, (w, sign) in made.items() if c != w)

    def of(self, texts: list[str]) -> list[bytes]:
        chunks = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > MEMORY:
            self.known = {"": b""}
        missed: set[str] = set()
        for c in chunks:
            missed.update(set(c).difference(self.known))
        self.learn(missed)
        return [b"".join(map(self.known.__getitem__, c)) for c in chunks]


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


@lru_cache(2)
def projection(vocabulary: int, axes: int, places: int, seed: int) -> np.ndarray:
    """An id's part of a document's projected vector: ids are hashed to places, places have random directions."""
    x = np.arange(vocabulary, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int32), (places, axes))[(x >> np.uint64(32)) % np.uint64(places)]


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of cells (n, axes) with values below 2**bits; axes * bits is at most 63.

    From the highest bit down, an axis with its bit set mirrors the lower bits of the first axis, one without it swaps
    them with the first axis's; what is left is a Gray code over the axes.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(axes):
            up = (x[i] >> b & 1).astype(bool)
            swapped = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swapped)
            x[i] ^= swapped
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | (x[i] >> b & 1)
    return key


def cells_of(ids: np.ndarray, sizes: np.ndarray, weights: np.ndarray, bits: int) -> np.ndarray:
    """Cells of documents whose ids (sizes of them each, none empty) stand one after the other: the mean direction of their places, on a grid over -1 to 1."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    sums = np.stack([np.add.reduceat(weights[ids, a], starts, dtype=np.int64) for a in range(weights.shape[1])], 1)
    return (sums + sizes[:, None]) * ((1 << bits) - 1) // (2 * sizes[:, None])  # integers, so that all machines agree


HELD = "row long, doc_id long, hilbert long, n long, crc long, ids binary"
HELD_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("hilbert", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())])
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
PIECES_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


def encoded(docs: DataFrame, path: str, end: int, key: str, text: str, axes: int, bits: int) -> DataFrame:
    """Every document's ids (compressed), how many, their CRC, its place on the curve and a number of its own."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, squeeze = word_ids(path), zstandard.ZstdCompressor(1)
        weights = projection(max(words.tokenizer.get_vocab_size(), end + 1), axes, PLACES, SEED)
        last, row = np.array([end], words.kind).tobytes(), TaskContext.get().partitionId() << 33
        for whole in batches:
            at = 0
            while at < len(whole):
                n = max(1, min(len(whole) - at, 256))
                b = whole.slice(at, n)
                at += n
                ids = [x + last for x in words.of([t or "" for t in b.column(1).to_pylist()])]
                sizes = np.array([len(x) // words.kind.itemsize for x in ids])
                cells = cells_of(np.frombuffer(b"".join(ids), words.kind), sizes, weights, bits)
                columns = [range(row, row + n), b.column(0), hilbert_keys(cells, bits), sizes, [zlib.crc32(x) for x in ids], [squeeze.compress(x) for x in ids]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, HELD_ARROW.types)], schema=HELD_ARROW)
                row += n

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(encode, HELD)


def along_curve(light: DataFrame) -> DataFrame:
    """row, first: how many ids stand before each row's in the order of (hilbert, doc_id, crc, n, row); null ids first.

    Rows are sorted by range, summed up within a task, and the tasks' totals (one number each) are added up.
    """
    order = ["hilbert", "doc_id", "crc", "n", "row"]
    tasks = max(1, -(-light.count() // ORDERED), min(1 << 14, int(light.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranged = durable(light.repartitionByRange(tasks, *order).select(*order, F.spark_partition_id().alias("task")))
    before, at = [], 0
    for task, total in sorted(tuple(r) for r in ranged.groupBy("task").agg(F.sum("n")).collect()):  # as many as tasks
        before.append((task, at))
        at += total
    base = F.broadcast(light.sparkSession.createDataFrame(before, "task int, base long"))
    running = F.sum("n").over(Window.partitionBy("task").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("first", running - F.col("n")).join(base, "task").select("row", (F.col("first") + F.col("base")).alias("first"))


def rest_cuts(total: int, length: int) -> list[int]:
    """Where the sequences after the last whole one begin, ending with total: the rest is cut into falling powers of two, which need no padding."""
    at, cuts = total // length * length, []
    while at < total:
        cuts.append(at)
        at += 1 << (total - at).bit_length() - 1
    return [*cuts, total]


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = 1, key: str = "doc_id", text: str = "text", axes: int = AXES, bits: int = BITS) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32 bits) of every piece.

    A document is its text's ids by the tokenizer at `path`, then the id `end`. Its ids are hashed into a vector, which is
    projected to `axes` numbers; documents are sorted by their place on a Hilbert curve through these, so neighbours are
    alike. Their ids form one line that is cut every `length` ids; what is left at its end is cut into falling powers of two,
    so no sequence needs padding. start is a piece's first id within its document, offset within its sequence.

    A null text is empty and so has the end alone; a null key is a key like others and stands first among ties; repeated
    rows and ties of the curve stand next to each other, by key, then CRC; a very long text is cut into as many pieces as
    it takes; other columns aren't read, so they can't clash. An empty table gives an empty one.

    Texts are encoded once and their ids kept compressed. Only five numbers a document are sorted; ids are shuffled
    once, to meet their places, by a number that no two rows share, so no key can be hot.
    """
    if length < 1 or length & length - 1:
        raise ValueError("length must be a power of two")
    if axes < 2 or axes * bits > 63:
        raise ValueError("a key must fit 63 bits")
    held = durable(encoded(docs, path, end, key, text, axes, bits))
    light = durable(held.drop("ids"))
    places = durable(along_curve(light))
    total = light.agg(F.sum("n")).first()[0] or 0
    cuts, kind = np.array(rest_cuts(total, length)), "<u2" if _small(path) else "<u4"
    whole = total // length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held_ids, open_ = [], 0, zstandard.ZstdDecompressor()
        for b in batches:
            for doc_id, n, first, z in zip(*(b.column(i).to_pylist() for i in range(4))):
                ids = np.frombuffer(open_.decompress(z), kind).astype("<u4")
                at = first
                while at < first + n:
                    if at < whole * length:
                        sequence, begin = divmod(at, length)
                        begin, stop = at - begin, at - begin + length
                    else:
                        k = int(np.searchsorted(cuts, at, "right")) - 1
                        sequence, begin, stop = whole + k, int(cuts[k]), int(cuts[k + 1])
                    size = min(stop, first + n) - at
                    out.append((doc_id, at - first, size, n, sequence, at - begin, ids[at - first : at - first + size].tobytes()))
                    at, held_ids = at + size, held_ids + size
                    if held_ids >= BATCH_IDS:
                        yield _batch(out)
                        out, held_ids = [], 0
        if out:
            yield _batch(out)

    return held.select("row", "doc_id", "n", "ids").join(places, "row").select("doc_id", "n", "first", "ids").mapInArrow(cut, PIECES)


def _small(path: str) -> bool:
    return word_ids(path).kind.itemsize == 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PIECES_ARROW.types)], schema=PIECES_ARROW)


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """sequence_id, n_ids, doc_ids and ids (little-endian unsigned 32 bits) of every sequence of pack().

    A sequence has `length` ids at most, so its group is bounded. One whose size is no power of two is filled up with the id
    `pad`; pack() leaves none. No pieces, no sequences.
    """
    item = F.struct("offset", "doc_id", "ids")
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), F.array_sort(F.collect_list(item)).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    filled = F.when(F.col("n_ids").bitwiseAND(F.col("n_ids") - 1) != 0, F.lit(length) - F.col("n_ids")).otherwise(0)
    padding = F.unhex(F.repeat(F.lit(int(pad).to_bytes(4, "little").hex()), filled.cast("int")))
    return whole.select("sequence_id", "n_ids", F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.concat(ids, padding).alias("ids"))


def op13_hilbert_packing(spark, sf_dir):
    import public_tokenizers

    pieces = pack(dealt_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
