"""Short codes for vectors: a codebook for each part of a vector, fitted by filtering Lloyd over kd-trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwright.llm.common import durable, join_hot, spread

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components are held between -LARGEST and LARGEST, so squared distances fit 64 bits; values below half a million in size are never changed.
LARGEST = 1 << 27
#: Rows of a block at most (below 2**16), which has a tree for each part; parts of a leaf at most; pairs of leaf parts and entries that are compared at once.
BLOCK, LEAF, PAIRS = 1 << 14, 16, 1 << 18

BLOCKS = "ids array<long>, labels array<string>, parts array<binary>, orders array<binary>, wide boolean"
BLOCKS_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("parts", pa.list_(pa.binary())), ("orders", pa.list_(pa.binary())), ("wide", pa.bool_())])


def borders(n: int) -> list[np.ndarray]:
    """Where the nodes of each level of a tree over n rows begin, and n: nodes are halved until none is larger than LEAF."""
    levels = [np.array([0, n])]
    while np.diff(levels[-1]).max(initial=0) > LEAF:
        b = levels[-1]
        levels.append(np.sort(np.concatenate([b, (b[:-1] + b[1:] + 1) // 2])))
    return levels


def tree_order(points: np.ndarray) -> np.ndarray:
    """Order of the rows in which every node of the tree is a run: each level halves its nodes along their widest axis."""
    order = np.arange(len(points))
    for b in borders(len(points))[:-1]:
        p = points[order]
        node = np.repeat(np.arange(len(b) - 1), np.diff(b))
        widest = (np.maximum.reduceat(p, b[:-1]) - np.minimum.reduceat(p, b[:-1])).argmax(1)
        order = order[np.lexsort((p[np.arange(len(p)), widest[node]], node))]
    return order


def assign(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (ties: the lower index) of each of the points, which stand in tree order; sums and counts of the entries' points.

    Down the levels, a node keeps the entries that may be nearest to something in its bounding box. Against the entry
    nearest to the box's middle, another is dropped if even the corner furthest in its direction isn't nearer to it (or,
    with a higher index, only as near). A node with one entry left gives it its whole run, by cached sums and counts.
    """
    n, k = len(points), len(book)
    code = np.zeros(n, np.int64)
    sums, counts = np.zeros((k, points.shape[1]), np.int64), np.zeros(k, np.int64)
    if not n:
        return code, sums, counts
    levels = borders(n)
    total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, 0)])
    open_, left = np.zeros(1, np.int64), np.ones((1, k), bool)  # nodes of this level by place, entries that they keep
    square = (book * book).sum(1)
    for depth, b in enumerate(levels):
        low, high = (f.reduceat(points, b[:-1])[open_] for f in (np.minimum, np.maximum))
        middle = low + high  # twice the middle
        far = square - middle @ book.T  # distance to the middle, but for what all entries share
        best = np.where(left, far, np.iinfo(np.int64).max).argmin(1)
        rows, entry = np.nonzero(left)
        star = best[rows]
        way = book[entry] - book[star]
        corner = np.where(way > 0, high[rows], low[rows])
        gain = square[entry] - square[star] - 2 * (way * corner).sum(1)  # how much further entry is than star from that corner
        drop = (entry != star) & ((gain > 0) | (gain == 0) & (entry > star))
        left[rows[drop], entry[drop]] = False
        single = left.sum(1) == 1
        for node, e in zip(open_[single].tolist(), best[single].tolist()):
            a, z = int(b[node]), int(b[node + 1])
            code[a:z] = e
            sums[e] += total[z] - total[a]
            counts[e] += z - a
        open_, left = open_[~single], left[~single]
        if not len(open_):
            return code, sums, counts
        if depth + 1 < len(levels):  # children: every border of this level is one of the next
            first, after = np.searchsorted(levels[depth + 1], b[open_]), np.searchsorted(levels[depth + 1], b[open_ + 1])
            width = after - first
            child = np.repeat(first - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
            open_, left = child, np.repeat(left, width, 0)
    leaf = levels[-1]
    sizes = leaf[open_ + 1] - leaf[open_]
    step = max(1, PAIRS // (LEAF * k))
    for i in range(0, len(open_), step):  # leaves: their points against the entries that are left
        size, mask = sizes[i : i + step], left[i : i + step]
        at = np.repeat(leaf[open_[i : i + step]] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        row, entry = np.nonzero(np.repeat(mask, size, 0))
        away = points[at[row]] - book[entry]
        d = (away * away).sum(1)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(d, starts)
        hit = np.flatnonzero(d == least[row])
        first = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]  # entries rise within a point, so the first is the lowest
        code[at] = entry[first]
    loose = np.concatenate([np.arange(leaf[o], leaf[o + 1]) for o in open_])
    np.add.at(sums, code[loose], points[loose])
    np.add.at(counts, code[loose], 1)
    return code, sums, counts


def _matrix(b: pa.RecordBatch, at: int, width: int) -> np.ndarray:
    """Vectors of a batch as integers, shorter ones filled up with zeros."""
    lists = b.column(at)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64)
    if (sizes == width).all():
        return whole.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(whole)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = whole
    return out


def _blocks(width: int, parts: int):
    """Rows of id, label and vector as blocks: each part of their vectors in its own tree's order, and that order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), BLOCK):
                b = whole.slice(i, BLOCK)
                m = _matrix(b, 2, width).reshape(len(b), parts, width // parts)
                wide = bool(abs(m).max(initial=0) >= 1 << 15)
                orders = [tree_order(m[:, p]) for p in range(parts)]
                row = [b.column(0).to_pylist(), b.column(1).to_pylist(), [m[o, p].astype("<i4" if wide else "<i2").tobytes() for p, o in enumerate(orders)], [o.astype("<u2").tobytes() for o in orders], wide]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, BLOCKS_ARROW.types)], schema=BLOCKS_ARROW)

    return pack


def _points(b: pa.RecordBatch, row: int, dims: int) -> list[np.ndarray]:
    kind = "<i4" if b.column(4)[row].as_py() else "<i2"
    return [np.frombuffer(x, kind).astype(np.int64).reshape(-1, dims) for x in b.column(2)[row].as_py()]


SUMS = "part int, entry int, sums array<long>, n long"
SUMS_ARROW = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("sums", pa.list_(pa.int64())), ("n", pa.int64())])
CODES = "vec_id long, label string, code string, error long"
CODES_ARROW = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])


def _sums(books: np.ndarray):
    """Sums and counts of the entries over all blocks of a partition."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, dims = books.shape
        sums, counts = np.zeros((parts, k, dims), np.int64), np.zeros((parts, k), np.int64)
        for b in batches:
            for row in range(len(b)):
                for p, points in enumerate(_points(b, row, dims)):
                    _, s, c = assign(points, books[p])
                    sums[p] += s
                    counts[p] += c
        part, entry = np.nonzero(counts)
        columns = [part, entry, sums[part, entry].tolist(), counts[part, entry]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SUMS_ARROW.types)], schema=SUMS_ARROW)

    return add


def _codes(books: np.ndarray):
    digits = np.array([f"{i:02x}" for i in range(books.shape[1])])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = books.shape[2]
        for b in batches:
            for row in range(len(b)):
                ids = b.column(0)[row].as_py()
                codes, error = np.empty((len(ids), len(books)), np.int64), np.zeros(len(ids), np.int64)
                for p, (points, order) in enumerate(zip(_points(b, row, dims), b.column(3)[row].as_py())):
                    o = np.frombuffer(order, "<u2")
                    code, _, _ = assign(points, books[p])
                    codes[o, p] = code
                    error[o] += ((points - books[p][code]) ** 2).sum(1)
                columns = [ids, b.column(1)[row].as_py(), ["".join(x) for x in digits[codes].tolist()], error]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, CODES_ARROW.types)], schema=CODES_ARROW)

    return write


def codebooks(blocks: DataFrame, first: np.ndarray, rounds: int) -> np.ndarray:
    """Entries (part, entry, component) after so many rounds from the first ones. Only sums by part and entry come to the driver, as many as there are entries."""
    books = first.copy()
    for _ in range(rounds):
        told = blocks.mapInArrow(_sums(books), SUMS).select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
        told = told.groupBy("part", "entry", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
        for part, entry, at, s, n in told.collect():  # PARTS * ENTRIES * components at most
            books[part, entry, at] = int(s) // n
    return books


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row with a whole vector.

    A component x is the integer floor(256 * x). Vectors are cut into `parts` equal parts; each part position has a
    codebook of `entries`, first the parts of the rows with the smallest keys (ties by vector; null keys last). A round
    assigns every part to its nearest entry (squared distance, ties to the lower index) and moves each entry to
    floor(sum / count) of its parts; entries without parts stay. code has two hex digits a part; error is the sum of
    squared distances, label_error its sum over the rows of the same label (without one: together);
    codebooks_sha256 is the digest of all entries' components in order.

    Rows go whose vector is null or has a null or non-finite component. Vectors of differing lengths, or of one that `parts`
    doesn't divide, are filled up with zeros to the next multiple of `parts` from the longest. Components are held
    within -2**27 and 2**27. A label_error beyond 64 bits is the largest number of 64 bits. Repeated rows count as
    often as they stand; fewer rows than `entries` make as many entries; other columns aren't read, so they can't clash.
    An empty table gives an empty one.

    Rows are written once as blocks in the order of a kd-tree for each part; rounds read them, filter entries down the
    trees and shuffle one sum for each entry and task. No key decides where a row goes; only the sums by label are
    shuffled, pre-aggregated, and joined back with hot labels broadcast.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, key, vector, label)
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    width = parts * max(1, -(-(longest or 0) // parts))
    top = rows.orderBy(F.col("id").asc_nulls_last(), F.col("v").cast("array<double>")).limit(entries).collect()
    books = np.zeros((parts, max(1, len(top)), width // parts), np.int64)
    for i, r in enumerate(top):
        v = np.clip(np.floor(np.array(r.v, np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)
        books[:, i] = np.pad(v, (0, width - len(v))).reshape(parts, -1)
    blocks = durable(rows.mapInArrow(_blocks(width, parts), BLOCKS))
    books = codebooks(blocks, books, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = durable(blocks.mapInArrow(_codes(books), CODES).withColumn("label", F.coalesce(F.concat(F.lit("="), "label"), F.lit("none"))))
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    per = durable(coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"), F.count(F.lit(1)).alias("n")))
    total = per.agg(F.sum("n")).first()[0] or 0
    return join_hot(coded, per, "label", "n", total).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def whole_vectors(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, label (as text) and v of the rows whose vector is there and has finite components alone."""
    out = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    return out.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def op12_filtering_lloyd(spark, sf_dir):
    return compress(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def oracle() -> str:
    """The same rows by definition: every part against every entry of its codebook."""
    nearest = """
{out} as materialized (
  select i, vec_id, label, part, p.x, arg_min({{'entry': b.entry, 'd': d}}, d * {entries} + b.entry) as near
  from (select p.*, b.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda k: (p.x[k] - b.x[k]) * (p.x[k] - b.x[k])))::bigint as d from p join {book} b using (part)) p
  join {book} b using (part, entry) group by all)"""
    moved = """
{out} as materialized (
  select b.part, b.entry, coalesce(m.x, b.x) as x from {book} b left join (
    select part, entry, list(c order by k) as x from (
      select part, near.entry as entry, k, floor_div(sum(x[k])::bigint, count(*)) as c from {near}, range(1, len(x) + 1) t(k) group by part, near.entry, k) group by part, entry) m using (part, entry))"""
    steps = []
    for r in range(ROUNDS):
        steps += [nearest.format(out=f"a{r}", book=f"b{r}", entries=ENTRIES), moved.format(out=f"b{r + 1}", book=f"b{r}", near=f"a{r}")]
    steps.append(nearest.format(out="last", book=f"b{ROUNDS}", entries=ENTRIES))
    return f"""
with v as (select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
r as (select *, row_number() over (order by vec_id nulls last, e) as i from v),
p as materialized (select i, vec_id, label, part, e[part * (len(e) // {PARTS}) + 1 : (part + 1) * (len(e) // {PARTS})] as x from r, range({PARTS}) t(part)),
b0 as materialized (select part, i - 1 as entry, x from p where i <= {ENTRIES}),{",".join(steps)},
coded as (select i, vec_id, label, string_agg(printf('%02x', near.entry), '' order by part) as code, sum(near.d)::bigint as error from last group by i, vec_id, label)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
       (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) from b{ROUNDS}) as codebooks_sha256 from coded
""".replace("floor_div(sum(x[k])::bigint, count(*))", "(sum(x[k])::bigint - ((sum(x[k])::bigint % count(*)) + count(*)) % count(*)) // count(*)")
