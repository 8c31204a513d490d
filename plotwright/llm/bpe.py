"""Byte-level BPE in padded numpy matrices, and back."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwright.llm.common import dealt_documents, fresh

NONE = np.int32(0x7FFFFFFF)
#: Characters of text split at once; cells of a matrix; pieces that a worker remembers.
SLICE, CELLS, MEMORY = 1 << 20, 1 << 18, 200_000
#: Bytes of a piece from which its row is not copied in every round.
LONG = 1024
#: A vocabulary file goes to the executors whole, so its size is checked.
LARGEST_FILE = 64 << 20
#: White space as Unicode's property has it; the regex module counts four control characters more.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def splitter(pattern: str) -> regex.Pattern:
    """The pattern with \\s and \\S read as the White_Space property."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
        elif two == r"\S":
            out.append(f"[^{SPACE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = inside and two[0] != "]" or two[0] == "["
            out.append(two[0])
        i += 2 if two[0] == "\\" else 1
    return regex.compile("".join(out))


class Bpe:
    """Encoder and decoder of one rank file. Equal to merging, in each piece, the leftmost pair of lowest rank until none is left."""

    def __init__(self, file: bytes, pattern: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a}
        self.split = splitter(pattern)
        self.bytes_of = [b""] * (max(self.rank.values()) + 1)
        for token, r in self.rank.items():
            self.bytes_of[r] = token
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.ids_of = {}  # piece: its ids, as little-endian bytes
        pairs = {(self.rank[t[:k]], self.rank[t[k:]]): r for t, r in self.rank.items() for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank}
        self.rank_of_pair = {a << 32 | b: r for (a, b), r in pairs.items()}
        keys = np.array(list(self.rank_of_pair), np.int64)
        self.bits = max(8, (2 * len(keys)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        left, slot, values = keys, self.slot(keys), np.array(list(pairs.values()), np.int32)
        while len(left):  # linear probing, all keys a step at a time
            free = self.keys[slot] == -1
            self.keys[slot[free]], self.ranks[slot[free]] = left[free], values[free]  # of several, one stays
            lost = self.keys[slot] != left
            left, values, slot = left[lost], values[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where there is none; -1 is padding."""
        keys = (a.astype(np.int64) << 32 | b).ravel()
        slot = self.slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        out[(keys < 0) | (b.ravel() < 0)] = NONE
        return out.reshape(a.shape)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of similar length. Each round merges one pair in every row and closes the gap; finished rows leave the matrix."""
        n, width = len(pieces), max(map(len, pieces))
        ids = np.full((n, width), -1, np.int32)
        for i, p in enumerate(pieces):
            ids[i, : len(p)] = np.frombuffer(p, np.uint8)
        ids = np.where(ids >= 0, self.single[ids], -1)
        size, rows, out = np.array(list(map(len, pieces))), np.arange(n), [b""] * n
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            low = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            done = low == NONE
            if done.any():
                for i, k, line in zip(rows[done].tolist(), size[done].tolist(), ids[done].astype("<u4")):
                    out[i] = line[:k].tobytes()
                ids, ranks, size, rows, at, low = ids[~done], ranks[~done], size[~done], rows[~done], at[~done], low[~done]
                if not len(rows):
                    break
            line, col = np.arange(len(rows)), at[:, None]
            places = np.arange(ids.shape[1] - 1)
            ids[line, at] = low
            ids = np.take_along_axis(ids, places + (places > col), 1)
            ranks = np.take_along_axis(ranks, places[:-1] + (places[:-1] >= col), 1)
            size -= 1
            if ranks.shape[1]:
                for k in (at - 1, at):
                    ok = np.flatnonzero((k >= 0) & (k < ranks.shape[1]))
                    ranks[ok, k[ok]] = self.pair_ranks(ids[ok, k[ok]], ids[ok, k[ok] + 1])
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """Ids of one long piece, also by its leftmost pair of lowest rank in each round.

        The row stays in place: a merged cell is dead (rank NONE) and its neighbours are linked, and the lowest rank of
        each block of about sqrt(n) cells is kept, so a round costs about sqrt(n) steps of numpy's, not n.
        """
        n = len(piece)
        first = self.single[np.frombuffer(piece, np.uint8)]
        side = int(n**0.5) + 1
        ranks = np.full((-(-n // side), side), NONE, np.int32)
        flat = ranks.ravel()
        flat[: n - 1] = self.pair_ranks(first[None, :-1], first[None, 1:])[0]
        lowest, ids, rank_of = ranks.min(1), first.tolist(), self.rank_of_pair.get
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while (low := int(lowest[block := int(lowest.argmin())])) != NONE:
            at = block * side + int(ranks[block].argmin())
            dead = after[at]
            ids[at], after[at] = low, after[dead]
            before[after[dead]], flat[dead] = at, NONE
            left, right = before[at], after[at]
            flat[at] = rank_of(low << 32 | ids[right], NONE) if right < n else NONE
            if left >= 0:
                flat[left] = rank_of(ids[left] << 32 | low, NONE)
            for b in {left // side if left >= 0 else block, block, dead // side}:
                lowest[b] = ranks[b].min()
        out, at = [], 0
        while at < n:
            out.append(ids[at])
            at = after[at]
        return np.array(out, "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of new pieces into ids_of, a length bucket at a time."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if (r := self.rank.get(raw)) is not None:
                self.ids_of[piece] = r.to_bytes(4, "little")
            elif len(raw) >= LONG:
                self.ids_of[piece] = self.merge_long(raw)
            else:
                n = len(raw)
                step = max(2, 1 << max(0, n.bit_length() - 2))  # buckets up to a third wider than their shortest piece
                buckets.setdefault(-(-n // step) * step, []).append((piece, raw))
        for width, found in buckets.items():
            at_once = max(1, CELLS // width)
            for i in range(0, len(found), at_once):
                some = found[i : i + at_once]
                self.ids_of.update(zip((p for p, _ in some), self.merge([raw for _, raw in some])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.split.findall(t) for t in texts]
        if len(self.ids_of) > MEMORY:
            self.ids_of.clear()
        self.learn(set().union(*pieces).difference(self.ids_of))
        return [b"".join(map(self.ids_of.__getitem__, p)) for p in pieces]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_made: dict = {}


def worker_bpe(file, pattern: str) -> Bpe:
    """One encoder in each Python worker."""
    key = (hashlib.sha256(file.value).digest(), pattern)
    if key not in _made:
        _made.clear()
        _made[key] = Bpe(file.value, pattern)
    return _made[key]


def slices(lens: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose lengths add up to `most` or so, one row at least."""
    ends, i = np.cumsum(lens), 0
    while i < len(lens):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - lens[i] + most, "right")))
        yield i, j
        i = j


def load(spark, path: str):
    with open(path, "rb") as f:  # a small file beside the library, read by the driver alone
        file = f.read(LARGEST_FILE + 1)
    if len(file) > LARGEST_FILE:
        raise ValueError(f"{path} is larger than {LARGEST_FILE} bytes")
    return spark.sparkContext.broadcast(file)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and token_ids (array<int>) of each row, without special tokens.

    A null text is empty and has no ids; repeated rows give a row each; columns outside `keep` are left out; an empty table
    gives an empty one.
    """
    file = load(docs.sparkSession, path)
    fields = [docs.schema[c] for c in keep]
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def run(batches):
        bpe = worker_bpe(file, pattern)
        for b in batches:
            lens = pc.binary_length(b.column(len(keep))).to_numpy(zero_copy_only=False)
            for i, j in slices(lens, SLICE):
                coded = bpe.encode(b.column(len(keep))[i:j].to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in coded)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), np.int32)))
                yield pa.RecordBatch.from_arrays([*(b.column(k)[i:j] for k in range(len(keep))), ids], names=[*keep, "token_ids"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(run, f"{ddl}, token_ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """coded with decoded (binary) for token_ids; with digests only n_tokens, ids_sha256 and decoded_sha256 instead of both.

    No ids (an empty array) decode to nothing; all other columns pass through; an empty table gives an empty one.
    """
    file = load(coded.sparkSession, path)
    keep = [c for c in coded.columns if c != "token_ids"]
    rows = coded.select(*keep, "token_ids")
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        bpe = worker_bpe(file, pattern)
        for b in batches:
            lists = b.column(len(keep))
            lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            for i, j in slices(lens, SLICE):
                flat, cuts = lists[i:j].flatten().to_numpy(), np.cumsum([0, *lens[i:j]])
                ids = [flat[x:y] for x, y in zip(cuts[:-1], cuts[1:])]
                own = [b.column(k)[i:j] for k in range(len(keep))]
                back = [bpe.decode(x) for x in ids]
                if digests:
                    new = {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_sha256": pa.array([sha(x.astype("<u4").tobytes()) for x in ids]), "decoded_sha256": pa.array(list(map(sha, back)))}
                else:
                    new = {"token_ids": lists[i:j], "decoded": pa.array(back, pa.binary())}
                yield pa.RecordBatch.from_arrays([*own, *new.values()], names=[*keep, *new])

    new = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "token_ids array<int>, decoded binary"
    ddl = ", ".join(f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{ddl}, {new}")


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, n_tokens, ids_sha256 and decoded_sha256 of each row: decode(encode(docs), digests=True) in one worker a task, without the ids leaving it.

    A null text is empty; an empty text has no tokens and the digests of the empty string; null keys are kept; repeated
    rows give a row each; a text of one endless piece takes time n * sqrt(n). Columns outside `keep` are left out; one in
    `keep` that has the name of an added column gives way to it. An empty table gives an empty one.
    """
    keep = tuple(c for c in keep if c.lower() not in ("n_tokens", "ids_sha256", "decoded_sha256"))
    file = load(docs.sparkSession, path)
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(fresh(list(keep), "__text")))
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        bpe = worker_bpe(file, pattern)
        for b in batches:
            lens = pc.binary_length(b.column(len(keep))).to_numpy(zero_copy_only=False)
            for i, j in slices(lens, SLICE):
                coded = bpe.encode(b.column(len(keep))[i:j].to_pylist())
                back = pa.array([sha(bpe.decode(np.frombuffer(x, "<u4"))) for x in coded])
                new = [pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array(list(map(sha, coded))), back]
                yield pa.RecordBatch.from_arrays([*(b.column(k)[i:j] for k in range(len(keep))), *new], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    ddl = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInArrow(run, f"{ddl}n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op6_byte_bpe(spark, sf_dir):
    path, pattern = public_vocabulary()
    return round_trip(dealt_documents(spark, sf_dir), path, pattern)
