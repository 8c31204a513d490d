"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotwright.llm import packed
from plotwright.llm.common import ascii_lower, dealt_documents, durable, fresh, join_hot, words_of
from plotwright.llm.components import components
from plotwright.llm.simhash import hex16, majority, votes

SHINGLE, RADIUS = 4, 4
#: Fingerprints of which a task makes the variants at once: 1024 x 2081 numbers, 17 MB.
CHUNK = 1024
#: Variants are compared by so many bits more than it takes to number them all; one in 2**SPARE meets another by chance and is sorted out later.
SPARE = 8


def shingle_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, n (rows with this doc_id and text) and the 64-bit fp of each text.

    Words of the A-Z-lower-cased text stand in shingles of four, repeats included (fewer words: one shingle of all); a
    bit is set if XXH64 with seed 42 has it in over half of them. No words (null, empty, blank): fp 0. Repeated rows
    vote together, which changes no majority.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("text_hash"), words_of(ascii_lower(body)).alias("__w"))
    w = F.col("__w")
    shingle = F.arrays_zip(w.alias("a"), *[F.slice(w, i + 2, F.size(w)).alias(c) for i, c in enumerate("bcd"[: SHINGLE - 1])])
    out = out.select("doc_id", "text_hash", F.posexplode_outer(shingle).alias("__pos", "__s"))
    first = F.coalesce(F.col("__pos"), F.lit(0)) == 0
    full = F.col("__s").isNotNull() & (first | F.col("__s.d").isNotNull())
    hashed = F.when(full, F.xxhash64(F.concat_ws(" ", *[F.col(f"__s.{c}") for c in "abcd"[:SHINGLE]])))
    out = out.select("doc_id", "text_hash", first.cast("long").alias("__first"), hashed.alias("__h"))
    out = out.groupBy("doc_id", "text_hash").agg(*votes(F.col("__h")), F.count("__h").alias("__total"), F.sum("__first").alias("n"))
    return out.select("doc_id", "text_hash", "n", majority(F.col("__total")).alias("fp"))


@lru_cache
def ball(radius: int) -> np.ndarray:
    """All 64-bit masks of up to `radius` bits."""
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)], np.uint64)


def _chunks(batches):
    """Fingerprints of a partition, by CHUNK, as rows of chunk and fps (bytes)."""
    base, held = TaskContext.get().partitionId() << 32, np.empty(0, np.int64)
    for b in batches:
        held = np.concatenate([held, b.column(0).to_numpy(zero_copy_only=False)])
        while len(held) >= CHUNK:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([base], pa.int64()), "fps": pa.array([held[:CHUNK].tobytes()], pa.binary())})
            base, held = base + 1, held[CHUNK:]
    if len(held):
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([base], pa.int64()), "fps": pa.array([held.tobytes()], pa.binary())})


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of n numbers: the smallest that links a-b reach. Each round hooks roots on smaller ones and halves the paths."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for at in (a, b, root[a], root[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_roots(classes: DataFrame, radius: int = RADIUS, fp: str = "fp") -> DataFrame:
    """fp and root (the smallest reachable over pairs within `radius` bits) of every distinct fingerprint that has such a pair; one without has no row, or is its own root.

    Every fingerprint emits all its variants within half the radius: two fingerprints within the radius share a variant,
    and two that share one are within twice the half, so sharing an exact variant verifies a pair. Variants shared by
    several fingerprints are first found as packed hashes (packed.py). A chunk contracts the fingerprints that share its
    exact variants to their smallest, and only these local roots are written out under each shared variant and shuffled:
    so a group of n near fingerprints makes n rows and links between the roots of its chunks, not n * n.
    """
    half = radius // 2
    assert radius == 2 * half, "the radius is even"
    masks = ball(half)
    n = classes.count()
    parts = max(1, -(-n // CHUNK))
    chunks = durable(classes.select(F.col(fp).alias("fp")).repartition(parts).mapInArrow(_chunks, "chunk long, fps binary"))
    total = max(2, n * len(masks))
    width = min(64, (total - 1).bit_length() + SPARE)
    bits = min(packed.bucket_bits(total), width)

    def variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = (fps.view(np.uint64)[:, None] ^ masks[None, :]).ravel()
        return v, packed.mix(v) >> np.uint64(64 - width)

    def emit(batches):
        for b in batches:
            for chunk, fps in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hashes = variants(np.frombuffer(fps, np.int64))[1]
                hashes.sort()
                yield packed.batch(list(packed.sent(chunk, 0, hashes, bits, width)))

    def meet(own: pa.Table, told: pa.Table) -> pa.Table:
        """Of the variants whose hash is shared: (variant, local root); of the fingerprints that have one: (null, fingerprint, local root)."""
        schema = pa.schema([("variant", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
        if not len(own) or not len(told):
            return schema.empty_table()
        fps = np.sort(np.frombuffer(own["fps"][0].as_py(), np.int64))  # so a smaller number is a smaller fingerprint
        v, h = variants(fps)
        ordered = np.sort(h)
        shared = np.unique(ordered[packed.marked(ordered, bits, width, list(zip(told["bucket"].to_pylist(), told["blob"].to_pylist())))])
        del ordered
        drop = np.uint64(max(0, width - 22))
        sieve = np.zeros(1 << min(22, width), bool)
        sieve[shared >> drop] = True
        at = np.flatnonzero(sieve[h >> drop])
        at = at[np.isin(h[at], shared)]
        # By variant, then by fingerprint: all of a variant link to its first.
        v, source = v[at].view(np.int64), at // len(masks)
        order = np.lexsort((source, v))
        v, source = v[order], source[order]
        first = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.empty(0, bool)
        hub = source[np.flatnonzero(first)][np.cumsum(first) - 1] if len(v) else source
        link = np.unique(source[~first] * len(fps) + hub[~first])
        root = _local_roots(len(fps), link // len(fps), link % len(fps))
        some = np.unique(source)
        variant = pa.concat_arrays([pa.array(v[first]), pa.nulls(len(some), pa.int64())])
        node = np.concatenate([fps[root[source[first]]], fps[some]])
        return pa.Table.from_arrays([variant, pa.array(node), pa.array(np.concatenate([node[: first.sum()], fps[root[some]]]))], schema=schema)

    told = packed.ties(chunks.mapInArrow(emit, packed.SENT), bits)
    met = chunks.repartition(parts, "chunk").groupBy("chunk").cogroup(told.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(meet, "variant long, a long, b long")
    met = durable(met)
    # A variant has at most as many fingerprints as the half ball has masks, so its window is bounded.
    across = met.where("variant is not null").select("a", F.min("a").over(Window.partitionBy("variant")).alias("b")).where("a != b").distinct()
    top = components(across)
    own = met.where("variant is null").select(F.col("a").alias("fp"), F.col("b").alias("node"))  # a local root has CHUNK rows at most
    return own.join(top, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, n, fp, component_id (the smallest doc_id reachable over links, itself included) and root of every distinct (doc_id, text).

    Null doc_ids never name a component unless it has no other id. Components of texts that share a doc_id, or have none,
    can have one component_id; root, the smallest fingerprint, is a component's own. An empty table gives an empty one.
    """
    rows = durable(shingle_fingerprints(docs, key, text))
    classes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows")))
    roots = near_roots(classes, radius)
    known = durable(classes.join(roots, "fp", "left").select("fp", "first_id", "n_rows", F.coalesce("root", "fp").alias("root")))
    groups = known.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_fps"))
    size = known.agg(F.count("*"), F.sum("n_rows")).first()
    named = join_hot(known.select("fp", "root", "n_rows"), groups, "root", "n_fps", size[0])
    return join_hot(rows, named, "fp", "n_rows", size[1] or 0).select("doc_id", "text_hash", "n", "fp", "component_id", "root")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of docs, one of each component: that of the smallest doc_id (of several with that id: of the smallest text hash; of equal rows: one)."""
    found = near_components(docs, key, text)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("k"))
    h, none, own, nth = (fresh(docs.columns, c) for c in ("__h", "__none", "__own", "__nth"))
    # Columns without nulls, so that the window and the join need one and the same shuffle.
    parted = lambda k: [k.isNull().alias(none), F.coalesce(k, F.lit(0).cast(docs.schema[key].dataType)).alias(own)]
    best = best.select(F.col("k.text_hash").alias(h), *parted(F.col("k.doc_id")))
    hashed = docs.select("*", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(h), *parted(F.col(key)))
    # One of equal rows, which tasks cut down before the shuffle.
    one = F.row_number().over(Window.partitionBy(h, none, own).orderBy(F.lit(0)))
    return hashed.withColumn(nth, one).where(F.col(nth) == 1).join(best, [h, none, own], "left_semi").select(*docs.columns)


def op5_ball_simhash(spark, sf_dir):
    found = near_components(dealt_documents(spark, sf_dir))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("__copy")
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id", copies).drop("__copy")
