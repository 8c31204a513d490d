"""Document fingerprints: weighted SimHash and permuted block tables. DataFrame functions only."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwright.llm.common import documents, durable, join_hot, words_of
from plotwright.llm.simhash import differing, hex16, majority, votes

#: Longer terms say more about a text; a term weighs its first word's code points, up to this many.
TOP_WEIGHT = 16
RADIUS = 3
#: Texts are dealt by doc_id into ranges of about so many bytes; the bounds are at most RANGES numbers.
RANGE_BYTES, RANGES = 8 << 20, 1 << 14


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and the 64-bit fingerprint of each text; keys must tell the rows apart (rows with equal keys vote together).

    A term is a pair of neighbouring words; the last word stands alone, so n words make n terms. It is hashed with XXH64
    and votes with its weight for the bits it has and against the others. Empty, blank and null texts have fingerprint
    0; a tied bit is 0.
    """
    words = F.col("__words")
    out = texts.select(*keys, words_of(F.col(text)).alias("__words"))
    out = out.select(*keys, F.explode_outer(F.arrays_zip(words.alias("a"), F.slice(words, 2, F.size(words)).alias("b"))).alias("__t"))
    term_hash = F.when(F.col("__t").isNotNull(), F.xxhash64(F.col("__t.a"), F.col("__t.b")))
    weight = F.least(F.char_length(F.col("__t.a")), F.lit(TOP_WEIGHT)).cast("long")
    out = out.select(*keys, term_hash.alias("__h"), weight.alias("__w"))
    out = out.groupBy(*keys).agg(*votes(F.col("__h"), F.col("__w")), F.sum("__w").alias("__total"))
    return out.select(*keys, majority(F.coalesce(F.col("__total"), F.lit(0))).alias("fp"))


LOWEST = -(1 << 63)


def range_bounds(base: DataFrame) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of __key and __tie that part base into ranges of about equal row counts, the smallest first, and whether each is the pair of a row (else its key is that of a row and its tie is the lowest).

    A key that fills several ranges (many rows of one doc_id, or without one) is parted by tie.
    """
    size = base.agg(F.min("__key"), F.sum(F.octet_length("__text"))).first()
    if size[0] is None:
        return [], False
    parts = min(RANGES, 1 + size[1] // RANGE_BYTES)
    if parts == 1:
        return [(size[0], LOWEST)], False
    inner = Counter(base.agg(F.percentile_approx("__key", [i / parts for i in range(1, parts)], 20 * parts)).first()[0])
    bounds = sorted({(size[0], LOWEST)} | {(k, LOWEST + (i << 64) // m) for k, m in inner.items() for i in range(m)})
    if max(inner.values()) == 1:
        return bounds, False
    # The first row of each range that has one; so many pairs come to the driver.
    first = base.groupBy(range_of(bounds).alias("b")).agg(F.min(F.struct("__key", "__tie")).alias("k")).select("k.*").collect()
    return sorted(map(tuple, first)), True


def range_of(bounds: list[tuple[int, int]]) -> Column:
    """Number of the range of a row; in two steps of sqrt(n) comparisons if there are many."""
    listed = lambda xs: F.split(F.lit(",".join(f"{k} {t}" for k, t in xs)), ",")
    at = lambda x, i: F.split(x, " ")[i].cast("long")
    pairs = lambda xs: F.transform(xs, lambda x: F.struct(at(x, 0).alias("k"), at(x, 1).alias("t")))
    upto = lambda xs: F.size(F.filter(xs, lambda b: (b["k"] < F.col("__key")) | ((b["k"] == F.col("__key")) & (b["t"] <= F.col("__tie")))))
    if len(bounds) < 64:
        return (upto(pairs(listed(bounds or [(0, 0)]))) - 1).cast("int")
    side = int(len(bounds) ** 0.5) + 1
    runs = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    nested = F.split(F.lit(";".join(",".join(f"{k} {t}" for k, t in r) for r in runs)), ";")
    coarse = upto(pairs(listed([r[0] for r in runs]))) - 1
    return (coarse * side + upto(pairs(F.split(nested[coarse], ","))) - 1).cast("int")


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of docs with the text of the next row by key (after the last: the first), as columns __id, __text, __next, __bucket, __row, __tail.

    Texts are shuffled once, by range of key and tie; the first row of each range is also sent to the range before it
    (__tail 1). Equal keys stand by a hash of their text; a null key stands before all others. An only row is its own next.
    """
    k = F.coalesce(F.col(key).cast("long"), F.lit(LOWEST))
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("__id"), k.alias("__key"), body.alias("__text"), F.xxhash64(body).alias("__tie"))
    bounds, exact = range_bounds(base)
    n = max(1, len(bounds))
    base = base.withColumn("__bucket", range_of(bounds))
    starts = F.split(F.split(F.lit(",".join(f"{k} {t}" for k, t in bounds or [(0, 0)])), ",")[F.col("__bucket")], " ")
    first = (starts[0].cast("long") == F.col("__key")) & (F.lit(not exact) | (starts[1].cast("long") == F.col("__tie")))
    own = F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("t"))
    before = F.struct(F.pmod(F.col("__bucket") - 1, F.lit(n)).cast("int").alias("b"), F.lit(1).alias("t"))
    sent = base.withColumn("__to", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own))))
    sent = sent.select("__id", "__key", "__tie", "__text", F.col("__to.b").alias("__bucket"), F.col("__to.t").alias("__tail"))
    order = Window.partitionBy("__bucket").orderBy("__tail", "__key", "__tie")
    return sent.withColumn("__next", F.coalesce(F.lead("__text").over(order), F.lit(""))).withColumn("__row", F.row_number().over(order))


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited and near_next of every row.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document's. Nulls, ties and repeated rows: see with_next and fingerprints. Texts of any length are read whole. Only key
    and text are read, so other columns can't clash. An empty table gives an empty one.
    """
    both = with_next(docs, key, text)
    n = F.char_length("__text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("substring(__text, 1, __n - __cut)"), F.expr("substring(__next, 1, __cut)"))
    both = both.withColumn("__n", n).withColumn("__cut", cut).withColumn("__edited", edited)
    row = ["__bucket", "__row", "__tail", "__id", "__n"]
    # The digest rides on the edited text's group alone.
    texts = F.explode(F.array(
        F.struct(F.lit(0).alias("which"), F.lit("").alias("sha"), F.col("__text").alias("text")),
        F.struct(F.lit(1).alias("which"), F.sha2("__edited", 256).alias("sha"), F.col("__edited").alias("text")),
    ))
    texts = both.select(*row, texts.alias("__x")).select(*row, F.col("__x.which").alias("__which"), F.col("__x.sha").alias("__sha"), F.col("__x.text").alias("__body"))
    # All groups below lie within a bucket, so none of them shuffles again.
    fps = fingerprints(texts, [*row, "__which", "__sha"], "__body")
    pick = lambda c, w: F.max(F.when(F.col("__which") == w, F.col(c)))
    fps = fps.groupBy(*row).agg(pick("fp", 0).alias("fp"), pick("fp", 1).alias("edited_fp"), pick("__sha", 1).alias("edited_sha256"))
    order = Window.partitionBy("__bucket").orderBy("__row")
    fps = fps.withColumn("__next_fp", F.coalesce(F.lead("fp").over(order), F.col("fp"))).where("__tail = 0")
    like = lambda a, b: 1.0 - differing(F.col(a), F.col(b)) / 64.0
    return fps.select(
        F.col("__id").alias("doc_id"), F.col("__n").cast("long").alias("n_chars"), "edited_sha256", "fp", "edited_fp",
        like("fp", "edited_fp").alias("near_edited"), like("fp", "__next_fp").alias("near_next"),
    )


def block_tables(radius: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """Masks of radius + 3 blocks of the 64 bits, and the tables: every choice of three blocks. Up to `radius` differing bits leave three blocks equal."""
    n = radius + 3
    edges = [round(64 * i / n) for i in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])], list(combinations(range(n), 3))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_pairs(classes: DataFrame, radius: int = RADIUS, fp: str = "fp") -> DataFrame:
    """All pairs a < b of distinct fingerprints within `radius` bits, each once, with their distance.

    classes has one row per distinct fingerprint, so copies don't multiply. Each is written to every table under the
    bits of its three blocks; a pair is taken from the first table in which it meets.
    """
    blocks, tables = block_tables(radius)
    rows = []
    for i, chosen in enumerate(tables):
        mask = sum(blocks[j] for j in chosen)
        earlier = [blocks[j] for j in range(chosen[-1]) if j not in chosen]
        rows.append((i, signed(mask), [signed(x) for x in earlier]))
    entry = [F.struct(F.lit(i).alias("t"), F.lit(m).cast("long").alias("m"), F.array(*[F.lit(x).cast("long") for x in e]).cast("array<bigint>").alias("e")) for i, m, e in rows]
    keyed = classes.select(F.col(fp).alias("__fp"), F.explode(F.array(*entry)).alias("__t"))
    keyed = keyed.select("__fp", F.col("__t.t").alias("__table"), F.col("__fp").bitwiseAND(F.col("__t.m")).alias("__bits"), F.col("__t.e").alias("__earlier"))
    a = keyed.select("__table", "__bits", F.col("__fp").alias("a"), "__earlier")
    b = keyed.select("__table", "__bits", F.col("__fp").alias("b"))
    met = a.join(b, ["__table", "__bits"]).where((F.col("a") < F.col("b")) & (differing(F.col("a"), F.col("b")) <= radius))
    first = F.forall("__earlier", lambda m: F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(m) != 0)
    return met.where(first).select("a", "b", differing(F.col("a"), F.col("b")).alias("distance"))


def op2_simhash_tables(spark, sf_dir):
    """The contract's columns; class_id (smallest doc_id with the same fingerprint), n_class (its documents) and n_links (other fingerprints within RADIUS bits)."""
    rows = durable(compare_edited(documents(spark, sf_dir)))
    classes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_class")))
    pairs = near_pairs(classes)
    links = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    known = classes.join(links, "fp", "left").select("fp", "class_id", "n_class", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return join_hot(rows, known.withColumn("n", F.col("n_class")), "fp", "n", rows.count()).select(
        "doc_id", "n_chars", "edited_sha256", hex16(F.col("fp")).alias("fingerprint"), hex16(F.col("edited_fp")).alias("edited_fingerprint"),
        "near_edited", "near_next", "class_id", "n_class", "n_links",
    )
