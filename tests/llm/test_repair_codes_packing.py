"""Operators 11 to 13 against plain versions of their contracts, on odd tables, empty ones and ranges far smaller than a conversation."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plotwright.llm import dialogue_repair, packing, vector_codes

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TURNS = "conv_id long, turn long, role string, text string, here boolean, range string, chunk string, audit string"
VECTORS = "vec_id long, embedding array<float>, label string, code string, error string, id string, v string"


# --- 11 ---


def cheapest(rows, most=2):
    """Cost and audit over all edit strings with up to `most` inserts in a gap."""
    found = []

    def go(i, state, cost, audit, run):
        if i == len(rows) and state in (0, 3):
            found.append((cost, audit))
        if run < most:
            go(i, 3 if state == 2 else 2, cost + 3, audit + "I", run + 1)
        if i == len(rows):
            return
        initial, fault = rows[i]
        go(i + 1, state, cost + 4, audit + "D", 0)
        if fault in (1, 2):
            return
        extra = 3 * (fault == 3)
        go(i + 1, 3 if state == 2 else 2, cost + 3 + extra, audit + "R", 0)
        kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, state))
        if kept is not None:
            go(i + 1, kept, cost + extra, audit + "K", 0)

    go(0, 0, 0, "", 0)
    return min(found)


def test_search_is_cheapest():
    rng = random.Random(2)
    for _ in range(250):
        rows = [(rng.choice("suax"), rng.randint(0, 3)) for _ in range(rng.randint(0, 4))]
        assert list(dialogue_repair.search(rows, 0, True).values()) == [cheapest(rows)]


def plain_repair(turns):
    """A conversation by the contract; turns: (turn, role, text) in order."""
    seen, rows, counts = set(), [], Counter()
    for _, role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = 1 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else 3
        counts[fault] += 1
        seen.add((role, text))
        rows.append((role[:1], fault))
    best = {0: (0, "", ())}

    def inserted(best):
        out = {}
        for state, (cost, audit, lines) in best.items():
            for k in range(3):
                if state not in out or (cost, audit) < out[state][:2]:
                    out[state] = (cost, audit, lines)
                state = 3 if state == 2 else 2
                cost, audit, lines = cost + 3, audit + "I", (*lines, "user:" if state == 2 else "assistant:")
        return out

    for (_, role, text), (initial, fault) in zip(turns, rows):
        new = {}
        for state, (cost, audit, lines) in inserted(best).items():
            options = [(state, cost + 4, audit + "D", lines)]
            if fault not in (1, 2):
                other = 3 if state == 2 else 2
                options.append((other, cost + 3 + 3 * (fault == 3), audit + "R", (*lines, f"{'user' if other == 2 else 'assistant'}:{text}")))
                kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, state))
                if kept is not None:
                    options.append((kept, cost + 3 * (fault == 3), audit + "K", (*lines, f"{role}:{text}")))
            for s, *v in options:
                if s not in new or tuple(v[:2]) < new[s][:2]:
                    new[s] = tuple(v)
        best = new
    cost, audit, lines = min(v for s, v in inserted(best).items() if s in (0, 3))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return gaps, counts[1], counts[2], counts[3], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damaged(conversations):
    """The contract's damage, row by row."""
    out = defaultdict(list)
    for conv, turn, role, text in conversations:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv] += []
        if fate:
            text = "" if fate == 1 else text.translate({46: None, 33: None, 63: None}) if fate == 2 else text
            out[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return {c: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, rows in out.items()}


def conversations(rng):
    text = lambda: rng.choice(["Yes.", "no", "What?", " \n", "", None, "Go on!  ", f"word {rng.randint(0, 999)}.", "ärger。", "x" * 3000 + "."])
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
    out = [(c, t if rng.random() < 0.9 else None, role(), text()) for c in [*range(40), None] for t in rng.sample(range(12), rng.randint(1, 8))]
    out += [(50, t, role() or "user", rng.choice(["same.", f"other {t}."])) for t in range(700)]  # goes over many ranges
    out += [(51, 3, "user", "again and again.")] * 300 + out[:5] + [(52, -(2**62) * 2, "user", "a."), (52, 2**63 - 1, "assistant", "b.")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("piece, chunk", [(64 << 20, 256), (6000, 256), (20_000, 3)])
def test_repair(spark, monkeypatch, piece, chunk):
    monkeypatch.setattr(dialogue_repair, "CHUNK", chunk)
    rows = conversations(random.Random(piece))
    table = spark.createDataFrame([(*r, False, "x", "x", "x") for r in rows], TURNS).repartition(3)
    got = dialogue_repair.repair(dialogue_repair.damaged(table), here="here", piece=piece)
    want = {c: plain_repair(turns) for c, turns in damaged(rows).items()}
    want = {c: (min(w[0], 2**63 - 1), *w[1:]) for c, w in want.items()}
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    result = got.collect()
    assert len(result) == len(want)
    assert {r[0]: tuple(r[1:]) for r in result} == want


def test_repair_of_nothing(spark):
    assert dialogue_repair.repair(spark.createDataFrame([], TURNS)).collect() == []


# --- 12 ---


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(k, [int(np.floor(np.float64(x) * 256)) for x in v], label) for k, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = parts * max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    kept = [(k, [max(-(2**27), min(2**27, x)) for x in v] + [0] * (width - len(v)), label) for k, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = width // parts
    cut = lambda v: [v[p * d : (p + 1) * d] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min(range(len(books[p])), key=lambda e: (away(x, books[p][e]), e))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                groups[p, near(p, x)].append(x)
        for (p, e), xs in groups.items():
            books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    coded = [(k, [near(p, x) for p, x in enumerate(cut(v))], v, label) for k, v, label in kept]
    errors = [sum(away(x, books[p][c[p]]) for p, x in enumerate(cut(v))) for _, c, v, _ in coded]
    by = Counter()
    for e, (*_, label) in zip(errors, coded):
        by[label] += e
    return [(k, "".join(f"{x:02x}" for x in c), e, min(by[label], 2**63 - 1), digest) for e, (k, c, _, label) in zip(errors, coded)]


def test_assign_and_order():
    rng = np.random.default_rng(0)
    for _ in range(120):
        n, d, k, span = int(rng.integers(0, 400)), int(rng.integers(1, 6)), int(rng.integers(1, 65)), int(rng.choice([2, 5, 300]))
        points, book = rng.integers(-span, span + 1, (n, d)), rng.integers(-span, span + 1, (k, d))
        order = vector_codes.tree_order(points)
        assert sorted(order) == list(range(n))
        code, sums, counts = vector_codes.assign(points[order], book)
        want = ((points[order][:, None] - book[None]) ** 2).sum(2).argmin(1) if n else np.zeros(0, int)
        assert (code == want).all()
        assert (counts == np.bincount(want, minlength=k)).all()
        assert all((sums[e] == points[order][want == e].sum(0)).all() for e in range(k))


@pytest.mark.parametrize("ragged", [False, True])
def test_codes(spark, ragged):
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, 64)], str(rng.integers(0, 3))) for i in rng.permutation(150)]
    rows += rows[:4] + [(None, rows[0][1], None), (900, None, "1"), (901, [None, *rows[1][1][1:]], "1"), (902, [float("nan")] * 64, "2"), (903, [float("inf")] * 64, "2"), (7, rows[5][1], None)]
    if ragged:
        rows += [(-1, [], "a"), (950, [1.0, -2.5], "none"), (951, [float(np.float32(3e38))] * 70, "=none"), (952, [-1e9] * 3, "none")]
    table = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], VECTORS).repartition(3)
    got = vector_codes.compress(table)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(plain_codes(rows), key=repr)


@pytest.mark.parametrize("rows", [[], [(1, None, "a", "x", "x", "x", "x")]])
def test_codes_of_nothing(spark, rows):
    assert vector_codes.compress(spark.createDataFrame(rows, VECTORS)).collect() == []


# --- 13 ---


def test_hilbert_keys():
    """Every cell has a place of its own, and the next place is a neighbour."""
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        keys = packing.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_ids_of_any_text():
    words, plain, rng = packing.WordIds(VOCABULARY), Tokenizer.from_file(VOCABULARY), random.Random(1)
    signs = list("abAB éÉ́İΣς  \n\n\t\r\x01\x0b\x1c\x85 　'stre.,!?1234²½漢字🙂ß​ ") + ["<|endoftext|>", "'ll", "\x00", " \x01 "]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(texts, words.of(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("length", [2048, 64])
def test_packing(spark, odd, odd_rows, length):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    pieces = packing.pack(docs, VOCABULARY, length).collect()
    plain = Tokenizer.from_file(VOCABULARY)
    texts = Counter((r[0], np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in odd_rows)
    lines, line = defaultdict(list), []
    for r in pieces:
        assert len(r.ids) == 4 * r.length > 0
        lines[r.sequence_id].append((r.offset, r))
    for i, (number, parts) in enumerate(sorted(lines.items())):
        parts.sort(key=lambda x: x[0])
        assert number == i and [o for o, _ in parts] == [0, *itertools.accumulate(r.length for _, r in parts)][:-1]
        size = sum(r.length for _, r in parts)
        assert size == length or size < length and size & size - 1 == 0
        line += [r for _, r in parts]
    found, at, ids = Counter(), 0, b""
    for r in line:  # a document's pieces follow each other
        assert r.start == at
        at, ids = at + r.length, ids + r.ids
        if at == r.doc_tokens:
            found[r.doc_id, ids] += 1
            at, ids = 0, b""
    assert found == texts
    whole = packing.sequences(spark.createDataFrame(pieces, packing.PIECES), length).collect()
    assert sum(r.n_ids for r in whole) == sum(r.length for r in pieces)
    assert all(len(r.ids) == 4 * r.n_ids for r in whole)


def test_padding(spark):
    pieces = spark.createDataFrame([(1, 0, 2, 3, 0, 0, b"\1\0\0\0\2\0\0\0"), (1, 2, 1, 3, 0, 2, b"\3\0\0\0")], packing.PIECES)
    (row,) = packing.sequences(pieces, 8, 9).collect()
    assert np.frombuffer(row.ids, "<u4").tolist() == [1, 2, 3, 9, 9, 9, 9, 9] and row.n_ids == 3


def test_neighbours_are_alike(spark):
    """Along the curve, documents of one language stand together far more often than in any order without it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 200")
    order = packing.pack(docs, VOCABULARY).where("start = 0").orderBy("sequence_id", "offset").select("doc_id").collect()
    lang = dict(docs.select("doc_id", "lang").collect())
    row = [lang[r.doc_id] for r in order]
    share = np.mean([a == b for a, b in zip(row, row[1:])])
    chance = sum((n / len(row)) ** 2 for n in Counter(row).values())
    assert share > 0.8 > 1.5 * chance
