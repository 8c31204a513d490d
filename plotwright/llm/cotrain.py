"""Quality classifier by co-training: a text view and a metadata view teach each other, then score together."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotwright.llm.bpe import slices
from plotwright.llm.common import dealt_documents, durable
from plotwright.llm.flat import Flat
from plotwright.llm.licenses import WORD
from plotwright.llm.quality_rules import base_counts

#: The views are fitted on so many labelled rows, those with the smallest hashes of their doc_id. Pseudo-labels come from all rows without a label, and all rows are scored.
LABELLED = 8000
#: In each round a view gives the other its EACH surest guesses of either class, if they are CONFIDENT.
ROUNDS, CONFIDENT, EACH = 4, 0.97, 400
SALTS = 64
WORD_BITS, BINS, META_BITS = 15, 10, 10
STEPS = 150
#: Length of a text's words and value of a shape in the text view; decay of weights.
WORD_VALUE, SHAPE_VALUE, DECAY = 4.0, 1.0, 1e-3
#: A document is rejected below this probability of being good.
THRESHOLD = 0.5
SLICE = 1 << 19
SHAPES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "exclaims", "bars", "digits", "line_words", "distinct")


def words_and_shapes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (text << WORD_BITS | word bin) numbers without repeats, distinct bins of each text, and its SHAPES."""
    flat = Flat(texts, b"\n")
    b, n = flat.bytes, len(texts)
    starts, ends = flat.runs(WORD[b])
    key = np.unique(flat.doc_of(starts) << WORD_BITS | (flat.hashes(starts, ends, lower=True) >> np.uint64(64 - WORD_BITS)).astype(np.int64))
    distinct = np.bincount(key >> WORD_BITS, minlength=n)
    words, chars, symbols, dup, repeat = base_counts(texts)
    size, some = np.maximum(flat.lens, 1), np.maximum(words, 1)
    count = lambda *xs: flat.per_doc(np.isin(b, xs))
    lines = flat.per_doc(b == 10) + 1
    shapes = [np.log1p(words), chars / some, symbols / size, dup / lines, repeat / some, flat.per_doc((b >= 65) & (b < 91)) / size, count(33) / size, count(124) / size, flat.per_doc((b >= 48) & (b < 58)) / size, words / lines, distinct / some]
    return key, distinct, np.stack(shapes, 1)


def metadata(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Bins of what is known about a document without its text: source, language, both, length. A null is a value."""
    out = np.zeros((len(source), 4), np.int64)
    for i, (s, g, n) in enumerate(zip(source, lang, n_chars)):
        size = -1 if n is None else min(31, int(max(0, n)).bit_length())
        out[i] = [_bin(f"s{s}"), _bin(f"l{g}"), _bin(f"b{s}|{g}"), _bin(f"n{size}")]
    return out


def _bin(x: str) -> int:
    import zlib

    return zlib.crc32(x.encode("utf-8", "surrogatepass")) >> (32 - META_BITS)


@dataclass
class View:
    """Logistic regression on sparse rows, with its calibration."""

    width: int
    weight: np.ndarray = field(default=None)
    scale: tuple[float, float] = (1.0, 0.0)

    def raw(self, row, col, val, n):
        return np.bincount(row, self.weight[col] * val, n) + self.weight[-1]

    def fit(self, row, col, val, y, use):
        """y of the rows marked in `use`; Adam on the whole of them, classes weighted alike."""
        n = len(y)
        at = use[row]
        row, col, val = row[at], col[at], val[at]
        share = np.where(y > 0.5, 0.5 / max(1, (use & (y > 0.5)).sum()), 0.5 / max(1, (use & (y <= 0.5)).sum())) * use
        w, m, v = np.zeros(self.width + 1), np.zeros(self.width + 1), np.zeros(self.width + 1)
        for t in range(1, STEPS + 1):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col] * val, n) + w[-1], -30, 30)))
            e = (p - y) * share
            g = np.append(np.bincount(col, e[row] * val, self.width), e.sum()) + DECAY * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.weight = w

    def calibrate(self, raw, y):
        """Platt's two numbers by Newton steps on held-out rows."""
        self.scale = tuple(platt(np.stack([raw, np.ones_like(raw)], 1), y))

    def logit(self, raw):
        return self.scale[0] * raw + self.scale[1]


def platt(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a small logistic regression, slightly drawn to zero."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + 1e-3 * w)
    return w


sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    text: View
    meta: View
    edges: np.ndarray
    blend: np.ndarray
    held_out: dict

    def text_rows(self, key, distinct, shapes):
        return text_rows(key, distinct, shapes, self.edges)

    def score(self, texts: pa.Array, source: list, lang: list, n_chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of being good: by text, by metadata, by both."""
        n = len(texts)
        by_text = self.text.logit(self.text.raw(*self.text_rows(*words_and_shapes(texts)), n))
        by_meta = self.meta.logit(self.meta.raw(*meta_rows(metadata(source, lang, n_chars)), n))
        both = np.stack([by_text, by_meta, np.ones(n)], 1) @ self.blend
        return sigmoid(by_text), sigmoid(by_meta), sigmoid(both)


def text_rows(key, distinct, shapes, edges):
    """Sparse rows: word bins scaled to equal length, then one bin of each shape."""
    doc, n = key >> WORD_BITS, len(distinct)
    bins = np.stack([np.searchsorted(edges[i], shapes[:, i], "right") for i in range(len(SHAPES))], 1) + np.arange(len(SHAPES)) * BINS + (1 << WORD_BITS)
    row = np.concatenate([doc, np.repeat(np.arange(n), len(SHAPES))])
    val = np.concatenate([WORD_VALUE / np.sqrt(distinct[doc]), np.full(n * len(SHAPES), SHAPE_VALUE)])
    return row, np.concatenate([key & ((1 << WORD_BITS) - 1), bins.ravel()]), val


def unpacked(bins: pa.Array, shapes: pa.Array, meta: pa.Array):
    """What words_and_shapes and metadata gave, from the columns of features."""
    bytes_of = lambda x: b"".join(x.to_pylist())
    distinct = pc.binary_length(bins).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    key = np.repeat(np.arange(len(distinct)), distinct) << WORD_BITS | np.frombuffer(bytes_of(bins), np.uint16)
    return (key, distinct, np.frombuffer(bytes_of(shapes), np.float64).reshape(-1, len(SHAPES))), np.frombuffer(bytes_of(meta), np.int16).reshape(-1, 4).astype(np.int64)


def meta_rows(bins):
    n, k = bins.shape
    return np.repeat(np.arange(n), k), bins.ravel(), np.full(n * k, 0.5)


def features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, kind (a hash of text and metadata), bins, shapes and meta of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(body, "source", "lang", "n_chars").alias("kind"), body.alias("__text"), F.col("source").cast("string").alias("__s"), F.col("lang").cast("string").alias("__l"), F.col("n_chars").cast("long").alias("__n"))

    def run(batches):
        for b in batches:
            for i, j in slices(pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False), SLICE):
                key_, _, shapes = words_and_shapes(b.column(2)[i:j])
                cut = np.searchsorted(key_, np.arange(1, j - i) << WORD_BITS)
                bins = np.split((key_ & ((1 << WORD_BITS) - 1)).astype(np.uint16), cut)
                meta = metadata(*(b.column(k)[i:j].to_pylist() for k in (3, 4, 5))).astype(np.int16)
                packed = [pa.array([x.tobytes() for x in of], pa.binary()) for of in (bins, shapes, meta)]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(1)[i:j], *packed], names=["id", "kind", "bins", "shapes", "meta"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, kind long, bins binary, shapes binary, meta binary")


def labelled(labels: DataFrame) -> DataFrame:
    """__k (the id as a string) and y: 1 good, 0 bad (of several labels of an id: the worst). Labels without an id or a value are none."""
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    return labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("string").alias("__k")).agg(F.min(good).alias("y"))


def surest(rows: DataFrame, known: DataFrame, views: dict[str, View], edges: np.ndarray, taught: dict[str, np.ndarray], each: int) -> list[tuple[str, float, int]]:
    """(view that learns, value, kind) of the other view's surest guesses among all rows whose id isn't in `known`: `each` of either class, the surest first, ties by kind.

    Equal rows are one kind. taught: kinds that a view has learnt already. All rows are guessed, and of the guesses, not
    of the features, those with a label are taken out by a join. Null ids are salted in it, as many rows may have none.
    """
    names = list(views)

    def guess(batches):
        for b in batches:
            rows_, bins = unpacked(b.column(2), b.column(3), b.column(4))
            n, kind = b.num_rows, b.column(1).to_numpy()
            sparse = {"text": text_rows(*rows_, edges), "meta": meta_rows(bins)}
            for k, (mine, other) in enumerate((names, names[::-1])):
                p = sigmoid(views[mine].logit(views[mine].raw(*sparse[mine], n)))
                for value, sure in ((1, p), (0, 1 - p)):
                    at = np.flatnonzero((sure >= CONFIDENT) & ~np.isin(kind, taught[other]))
                    yield pa.RecordBatch.from_pydict({"learner": pa.array([1 - k] * len(at), pa.int32()), "value": pa.array([value] * len(at), pa.int32()), "sure": pa.array(sure[at]), "kind": pa.array(kind[at], pa.int64()), "id": b.column(0).take(pa.array(at))})

    told = rows.select("id", "kind", "bins", "shapes", "meta").mapInArrow(guess, f"learner int, value int, sure double, kind long, id {rows.schema['id'].dataType.simpleString()}")
    salt = F.when(F.col("id").isNull(), F.pmod("kind", F.lit(1024))).otherwise(0).cast("int")
    told = told.select("*", F.col("id").cast("string").alias("__k"), salt.alias("__salt")).join(known.select("__k", F.lit(0).alias("__salt")), ["__k", "__salt"], "left_anti")
    told = told.groupBy("learner", "value", "kind").agg(F.max("sure").alias("sure"))
    # The first of each of SALTS parts; so 4 * SALTS * each rows at most come to the driver.
    first = F.row_number().over(Window.partitionBy("learner", "value", F.pmod("kind", F.lit(SALTS))).orderBy(F.desc("sure"), "kind"))
    found = sorted((r["learner"], r["value"], -r["sure"], r["kind"]) for r in told.withColumn("k", first).where(F.col("k") <= each).collect())
    picked = [r for _, some in groupby(found, key=lambda r: r[:2]) for r in islice(some, each)]
    return sorted((names[learner], float(value), kind) for learner, value, _, kind in picked)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model | None:
    """The views after ROUNDS of exchange, calibrated and blended on a fifth of the labelled rows; another fifth only gives the figures held_out. None where the labels don't have both classes.

    Features of all rows are computed once and kept where they are; each round then guesses all rows, takes out those with
    a label and brings the picked ones (4 * EACH at most) to the driver. An id with several labels has the worst, one with several rows that of
    the smallest kind. Null ids, and labels without an id or a value, are no labels.
    """
    rows, known = durable(features(docs, key, text)), durable(labelled(labels))
    ids = rows.select("id", F.col("id").cast("string").alias("__k")).where("id is not null").distinct()
    some = ids.join(known, "__k").select("id", "y").orderBy(F.xxhash64("id"), "id").limit(LABELLED)
    one = F.min(F.struct("kind", "y", "bins", "shapes", "meta")).alias("r")
    got = rows.join(F.broadcast(some), "id").groupBy("id").agg(one).orderBy(F.xxhash64("id"), "id").select("r.*").toArrow()
    y = np.array(got["y"].to_pylist(), float)
    part = np.where(np.arange(len(y)) % 5 < 2, np.arange(len(y)) % 5, 2)  # 0 calibrates, 1 tests, 2 teaches
    if min(((part == k) & (y == v)).sum() for k in (0, 2) for v in (0, 1)) < 1:
        return None
    edges = np.quantile(unpacked(*(got[c] for c in ("bins", "shapes", "meta")))[0][2], np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    views = {"text": View((1 << WORD_BITS) + len(SHAPES) * BINS), "meta": View(1 << META_BITS)}
    of_kind: dict[int, int] = {}  # rows beyond the labelled ones, by kind
    taught: dict[str, dict[int, float]] = {k: {} for k in views}
    table = got
    for turn in range(ROUNDS):
        words, meta = unpacked(*(table[c] for c in ("bins", "shapes", "meta")))
        sparse, n = {"text": text_rows(*words, edges), "meta": meta_rows(meta)}, table.num_rows
        for k, view in views.items():
            target, use = np.zeros(n), np.zeros(n, bool)
            target[: len(y)], use[: len(y)] = y, part == 2
            for kind, value in taught[k].items():
                target[of_kind[kind]], use[of_kind[kind]] = value, True
            view.fit(*sparse[k], target, use)
            view.calibrate(view.raw(*sparse[k], n)[: len(y)][part == 0], y[part == 0])
        if turn < ROUNDS - 1:
            picked = surest(rows, known, views, edges, {k: np.array(sorted(v), np.int64) for k, v in taught.items()}, EACH)
            new = sorted({kind for _, _, kind in picked} - of_kind.keys())
            if new:
                wanted = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in new], "kind long"))
                found = rows.join(wanted, "kind").groupBy("kind").agg(F.min(F.struct("bins", "shapes", "meta")).alias("r")).orderBy("kind").select("kind", F.lit(None).cast("int").alias("y"), "r.*").toArrow()
                of_kind |= {kind: table.num_rows + i for i, kind in enumerate(found["kind"].to_pylist())}
                table = pa.concat_tables([table, found.cast(table.schema)])
            for learner, value, kind in picked:
                taught[learner][kind] = value
    logits = np.stack([*(v.logit(v.raw(*sparse[k], n))[: len(y)] for k, v in views.items()), np.ones(len(y))], 1)
    blend = platt(logits[part == 0], y[part == 0])
    p, test = sigmoid(logits @ blend), part == 1
    share = lambda hit, of: float(hit[of].mean()) if of.any() else float("nan")
    told = {"rows": int(test.sum()), "good_kept": share(p >= THRESHOLD, test & (y == 1)), "bad_rejected": share(p < THRESHOLD, test & (y == 0)), "pseudo": sum(map(len, taught.values()))}
    return Model(views["text"], views["meta"], edges, blend, told)


def _scores(model: Model | None, texts, source, lang, n_chars):
    if model is None:
        one = np.ones(len(texts))
        return one, one, one
    return model.score(pc.fill_null(texts, ""), source, lang, n_chars)


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, p_text, p_meta, score and kept of every row; without a model all are kept with probability 1.

    A null text is empty; null ids, sources, languages and lengths are values; equal rows have equal scores, a row each; texts
    of any length are read whole. Other columns are left out, so their names can't clash. An empty table gives an empty one.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col("source").cast("string").alias("s"), F.col("lang").cast("string").alias("l"), F.col("n_chars").cast("long").alias("n"))

    def run(batches):
        for b in batches:
            for i, j in slices(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False), SLICE):
                p = _scores(model, b.column(1)[i:j], *(b.column(k)[i:j].to_pylist() for k in (2, 3, 4)))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], *map(pa.array, p), pa.array(p[2] >= THRESHOLD)], names=["doc_id", "p_text", "p_meta", "score", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, p_text double, p_meta double, score double, kept boolean")


def keep_good(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns whatever their names, that the model keeps; nulls and odd texts as in score. Without a model, all."""
    at = {c: docs.columns.index(c) for c in (text, "source", "lang", "n_chars")}

    def run(batches):
        for b in batches:
            whole = pa.Table.from_batches([b])
            for i, j in slices(pc.fill_null(pc.binary_length(b.column(at[text])), 0).to_numpy(zero_copy_only=False), SLICE):
                part = whole.slice(i, j - i)
                col = {c: part.column(k).combine_chunks() for c, k in at.items()}
                p = _scores(model, col[text], *(col[c].to_pylist() for c in ("source", "lang", "n_chars")))
                yield from part.filter(pa.array(p[2] >= THRESHOLD)).to_batches()

    return docs.mapInArrow(run, docs.schema)


def op7_cotraining(spark, sf_dir):
    docs = dealt_documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
