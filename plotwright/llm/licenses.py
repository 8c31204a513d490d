"""License scans: an exact set-similarity join of text blocks with notices, by containment."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwright.llm.bpe import slices
from plotwright.llm.common import dealt_documents
from plotwright.llm.flat import Flat

#: Fixed phrases and their labels: places where the words stand one after the other.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices by label; a block that holds THRESHOLD of a notice's distinct words has the label. scan() takes any table of such.
TEMPLATES = {
    "notice-apache-2.0": "licensed under the apache license version 2 0",
    "notice-gpl-3": "this work is licensed under the gnu general public license version 3",
    "notice-lgpl": "this library is free software under the terms of the gnu lesser general public license",
    "notice-mit": "released under the mit license",
    "notice-mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "notice-cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "notice-cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "notice-cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "notice-bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "notice-mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "notice-reserved": "copyright all rights reserved",
}
THRESHOLD = 0.9
SLICE = 2 << 20
#: Templates go to every task, so the size of their table is checked.
LARGEST_TEMPLATES = 64 << 20
#: Bytes of words, as they are or lower-cased.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def block_words(template: str) -> int:
    """Words of the blocks that a template is compared with: a power of two, so that it fits in half a block. Blocks start every half block, so a notice of a template's length lies in one whole."""
    return 1 << max(3, (2 * len(template.split()) - 1).bit_length())


class Words:
    """The words of a batch that occur in phrases or templates."""

    def __init__(self, texts: pa.Array, vocabulary: pa.Array):
        """code: place of each word in the vocabulary, -1 if it isn't there; compared byte by byte."""
        flat = Flat(texts)
        starts, ends = flat.runs(WORD[flat.bytes])
        self.code = pc.fill_null(pc.index_in(flat.strings(starts, ends, lower=True), value_set=vocabulary), -1).to_numpy()
        self.doc = flat.doc_of(starts)
        self.n_words = np.bincount(self.doc, minlength=len(texts))
        self.first = np.cumsum(self.n_words) - self.n_words  # number of each document's first word
        self.hits = np.flatnonzero(self.code >= 0)


def vocabulary_of(phrases: dict, templates: dict) -> list[str]:
    return sorted({w for text in [*phrases, *templates.values()] for w in text.split()})


def _batches(batches, most: int):
    for b in batches:
        for i, j in slices(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False), most):
            yield b.column(0)[i:j], b.column(1)[i:j]


def word_counts(rows: DataFrame, words: list[str]) -> dict[str, int]:
    """How often each word of the vocabulary (so many numbers come to the driver, no more) stands in all texts."""
    vocabulary = pa.array([w.encode() for w in words], pa.large_binary())

    def run(batches):
        total = np.zeros(len(words), np.int64)
        for _, texts in _batches(batches, SLICE):
            w = Words(texts, vocabulary)
            total += np.bincount(w.code[w.hits], minlength=len(words))
        yield pa.RecordBatch.from_pydict({"word": pa.array(range(len(words)), pa.int32()), "n": pa.array(total)})

    found = rows.mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {words[r["word"]]: r["n"] for r in found}


class Templates:
    """Templates of one block size, as sets of numbers (smaller is rarer), with their prefixes."""

    def __init__(self, templates: dict[str, set[int]], threshold: float):
        self.tokens = templates
        self.need = {label: math.ceil(threshold * len(x) - 1e-9) for label, x in templates.items()}
        self.by_prefix: dict[int, list[tuple[str, int]]] = {}
        for label, tokens in templates.items():
            for place, t in enumerate(sorted(tokens)[: len(tokens) - self.need[label] + 1]):
                self.by_prefix.setdefault(t, []).append((label, place))
        self.least = min(self.need.values())

    def matches(self, have: list[int]) -> dict[str, float]:
        """Containment of every template that reaches the threshold in a block. have: the block's sorted numbers."""
        block, seen, out = set(have), set(), {}
        for place, t in enumerate(have):
            if len(have) - place < self.least:
                break
            for label, rarer in self.by_prefix.get(t, ()):
                if label in seen:  # it met a rarer number of the prefix already
                    continue
                seen.add(label)
                tokens, need = self.tokens[label], self.need[label]
                # Of the numbers from the first common one on, both must have enough.
                if min(len(have) - place, len(tokens) - rarer) >= need and (found := len(tokens & block)) >= need:
                    out[label] = found / len(tokens)
        return out


def template_table(templates: DataFrame | dict[str, str]) -> dict[str, str]:
    """Templates by label from a table (label, text), words lower-cased and cut as in scan; rows without a label or a word are left out, of several texts of a label all stay ("label", "label#2", ..)."""
    if isinstance(templates, dict):
        return templates
    size = templates.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > LARGEST_TEMPLATES:
        raise ValueError(f"templates of {size} bytes; {LARGEST_TEMPLATES} are allowed")
    out: dict[str, str] = {}
    for r in templates.where("label is not null and text is not null").select("label", "text").distinct().orderBy("label", "text").collect():
        flat = Flat(pa.array([r.text]))
        words = [w.decode() for w in flat.strings(*flat.runs(WORD[flat.bytes]), lower=True).to_pylist()]
        label, n = r.label, 1
        while label in out:
            n += 1
            label = f"{r.label}#{n}"
        if words:
            out[label] = " ".join(words)
    return out


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: DataFrame | dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    templates: a table (label, text), or a dict of clean texts. A template is compared with blocks of its size class
    (block_words), by the share of its distinct words that a block has; score is the largest share from the threshold on,
    else 0. The words of templates are ordered by their count in the whole corpus, rarest first. If a block has threshold
    times a template's words, it has one of the template's first few (prefix filter), so only blocks around those rare
    words are looked at; of these, blocks with too few words of templates (length) and pairs with too few words from the
    first common one on, on either side (position), drop out, and the rest are counted exactly.

    A null text is empty; an empty one has no words, no labels and null places; null keys are kept; repeated rows give a
    row each; very long texts are scanned whole. Other columns are left out, so their names can't clash. An empty table
    gives an empty one.
    """
    templates = template_table(templates)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    listed = vocabulary_of(phrases, templates)
    counts = word_counts(rows, listed)
    words = sorted(listed, key=lambda w: (counts.get(w, 0), w))
    number, vocabulary = {w: i for i, w in enumerate(words)}, pa.array([w.encode() for w in words], pa.large_binary())
    sizes: dict[int, dict[str, set[int]]] = {}
    for label, body in templates.items():
        sizes.setdefault(block_words(body), {})[label] = {number[w] for w in body.split()}
    classes = {size: Templates(some, threshold) for size, some in sizes.items()}
    sought = [([number[w] for w in p.split()], label) for p, label in phrases.items()]

    def near_templates(w: Words) -> dict[int, dict[str, float]]:
        """By document: the templates that blocks of it hold."""
        out: dict[int, dict[str, float]] = {}
        codes = w.code[w.hits]
        for size, own in classes.items():
            half, is_prefix = size // 2, np.zeros(len(words), bool)
            is_prefix[list(own.by_prefix)] = True
            at = w.hits[is_prefix[codes]]
            doc, block = w.doc[at], (at - w.first[w.doc[at]]) // half
            # Every word lies in the block that starts before it and in the one before that; each block is looked at once.
            every = np.unique(np.stack([np.tile(doc, 2), np.maximum(np.concatenate([block, block - 1]), 0)], 1), axis=0)
            start = w.first[every[:, 0]] + every[:, 1] * half
            stop = np.minimum(start + size, w.first[every[:, 0]] + w.n_words[every[:, 0]])
            lo, hi = np.searchsorted(w.hits, start), np.searchsorted(w.hits, stop)
            for k in np.flatnonzero(hi - lo >= own.least).tolist():
                for label, share in own.matches(sorted(set(codes[lo[k] : hi[k]].tolist()))).items():
                    mine = out.setdefault(int(every[k, 0]), {})
                    mine[label] = max(mine.get(label, 0.0), share)
        return out

    def run(batches):
        for ids, texts in _batches(batches, SLICE):
            w = Words(texts, vocabulary)
            n = len(texts)
            n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base: list[set] = [set() for _ in range(n)]
            for tokens, label in sought:
                k = len(tokens)
                at = w.hits[w.code[w.hits] == tokens[0]]
                at = at[at + k <= len(w.code)]
                for step, t in enumerate(tokens):
                    at = at[w.code[at + step] == t]
                at = at[w.doc[at] == w.doc[at + k - 1]]
                doc, place = w.doc[at], at - w.first[w.doc[at]]
                np.add.at(n_base, doc, 1)
                np.minimum.at(first, doc, place)
                np.maximum.at(last, doc, place)
                for d in set(doc.tolist()):
                    base[d].add(label)
            near = near_templates(w)
            none = last < 0
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(w.n_words), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none),
                    pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x | near.get(d, {}).keys())) for d, x in enumerate(base)]),
                    pa.array([max(near.get(d, {}).values(), default=0.0) for d in range(n)], pa.float64()),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op9_set_join(spark, sf_dir):
    return scan(dealt_documents(spark, sf_dir), templates=spark.createDataFrame(list(TEMPLATES.items()), "label string, text string"))


def oracle(phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same rows by definition, in DuckDB SQL: all places of all phrases, all blocks against all templates."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    places = [f"list_filter(range(0, len(w) - {len(p.split())} + 1), lambda i: w[i+1:i+{len(p.split())}] = {quoted(p.split())})" for p in phrases]
    labels = ", ".join(f"case when len(p{i}) > 0 then '{label}' end" for i, label in enumerate(phrases.values()))
    rows = ", ".join(f"('{label}', {quoted(sorted(set(body.split())))}, {math.ceil(threshold * len(set(body.split())) - 1e-9)}, {block_words(body)})" for label, body in templates.items())
    every = " || ".join(f"p{i}" for i in range(len(places)))
    return f"""
with d as (select row_number() over () as id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
p as (select id, doc_id, w, {", ".join(f"{x} as p{i}" for i, x in enumerate(places))} from d),
q as (select id, doc_id, len(w) as n_words, {every} as places, list_filter([{labels}], lambda x: x is not null) as base from p),
t(label, words, need, size) as (values {rows}),
v as (select size, list(distinct w) as words, min(need) as least from (select size, need, unnest(words) as w from t) group by 1),
b as (select id, size, list_intersect(list_distinct(w[s+1:s+size]), words) as words from (select id, w, size, words, least, unnest(range(0, greatest(1, len(w)), size // 2)) as s from d, v)
  where len(list_intersect(list_distinct(w[s+1:s+size]), words)) >= least),
m as (select id, label, max(len(list_intersect(b.words, t.words))::double / len(t.words)) as c from b join t on b.size = t.size where len(list_intersect(b.words, t.words)) >= need group by 1, 2),
l as (select id, list(label) as labels, max(c) as score from m group by 1)
select q.doc_id, n_words::bigint as n_words, len(places)::bigint as n_base, list_min(places)::bigint as first_word, list_max(places)::bigint as last_word,
  array_to_string(list_sort(list_distinct(base)), ',') as base_labels, array_to_string(list_sort(list_distinct(base || coalesce(labels, []))), ',') as labels, coalesce(score, 0.0)::double as score
from q left join l using (id)
"""
