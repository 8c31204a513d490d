"""Each query against a plain version of its contract, on the odd tables, on empty ones and on a small corpus."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import tiktoken
import xxhash

from plotwright.llm import bpe, licenses, pii
from plotwright.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda b: hashlib.sha256(b).hexdigest()


def got(spark, name, path, *columns):
    return sorted((tuple(r) for r in QUERIES[name](spark, path).select(*columns).collect()), key=repr)


def documents(spark, path):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def fingerprint5(text):
    words = WORD.findall(text.translate(LOW))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots5(docs):
    """Fingerprint of each text and the smallest one that it reaches."""
    fps = [fingerprint5(t) for _, t in docs]
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(f, find(f)) for f in fps]


def components5(docs):
    roots, ids = roots5(docs), {}
    for (i, _), (_, root) in zip(docs, roots):
        if i is not None:
            ids[root] = min(ids.get(root, i), i)
    return [(i, f"{f:016x}", ids.get(root)) for (i, _), (f, root) in zip(docs, roots)]


def test_op5(spark, odd):
    docs = documents(spark, odd)
    assert got(spark, "op5_ball_simhash", odd, "doc_id", "fingerprint", "component_id") == sorted(components5(docs), key=repr)


def flipped(f, bits):
    x = (f ^ sum(1 << int(b) for b in bits)) & (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def brute_roots(every):
    """Smallest number reachable over pairs of four differing bits or fewer."""
    root = {f: f for f in every}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in every}


def test_op5_links_of_distance_1_to_5(spark, monkeypatch):
    """In one chunk and over many, with chains and a group of near fingerprints."""
    from plotwright.llm import near_dedup

    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 300)]
    near = [flipped(f, rng.choice(64, k, replace=False)) for k in (1, 2, 3, 4, 5) for f in fps[:20]]
    near += [flipped(fps[50], rng.choice(64, 2, replace=False)) for _ in range(150)]
    every = sorted(set(fps + near))
    rows = spark.createDataFrame([(f,) for f in every], "fp long")
    for chunk in (2048, 40):
        monkeypatch.setattr(near_dedup, "CHUNK", chunk)
        roots = {r.fp: r.root for r in near_dedup.near_roots(rows).collect()}
        assert {f: roots.get(f, f) for f in every} == brute_roots(every)


def test_op5_links_grow_with_the_group(spark, monkeypatch):
    """What is shuffled for a group of near fingerprints grows with the group, not with its pairs."""
    from plotwright.llm import near_dedup

    rng, seen = np.random.default_rng(8), []
    real = near_dedup.components
    monkeypatch.setattr(near_dedup, "CHUNK", 256)
    monkeypatch.setattr(near_dedup, "components", lambda edges: seen.append(edges.count()) or real(edges))
    for n in (600, 1200):
        every = list({flipped(77, rng.choice(64, 2, replace=False)) for _ in range(4 * n)})[:n]
        rows = spark.createDataFrame([(f,) for f in every], "fp long")
        assert near_dedup.near_roots(rows).select("root").distinct().count() == 1
    assert max(seen) <= 20


def test_op2(spark, odd, odd_rows):
    rows = QUERIES["op2_simhash_tables"](spark, odd).collect()
    docs = documents(spark, odd)
    assert len(rows) == len(docs)
    known = {}
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        known.setdefault(i, []).append(t)
    order = list(known)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    for i, following in zip(order, [*order[1:], order[0]]):
        if len(known[i]) == 1 and len(known[following]) == 1:
            (r,), t, n = by_id[i], known[i][0], known[following][0]
            cut = len(t) // 4
            edited = t[: len(t) - cut] + n[:cut]
            assert (r.n_chars, r.edited_sha256) == (len(t), sha(edited.encode()))
            other = int(by_id[following][0].fingerprint, 16)
            assert r.near_next == 1 - (int(r.fingerprint, 16) ^ other).bit_count() / 64
            assert r.near_edited == 1 - (int(r.fingerprint, 16) ^ int(r.edited_fingerprint, 16)).bit_count() / 64
    fps = {int(r.fingerprint, 16) for r in rows}
    for r in rows:
        f = int(r.fingerprint, 16)
        assert r.n_links == sum(0 < (f ^ g).bit_count() <= 3 for g in fps)
        assert r.n_class == sum(x.fingerprint == r.fingerprint for x in rows)


def fingerprint2(text):
    """Weighted votes of word pairs, by loops."""
    words = WORD.findall(text)
    votes, total = [0] * 64, 0
    for a, b in zip(words, [*words[1:], None]):
        weight, h = min(len(a), 16), xxhash.xxh64_intdigest(a.encode(), 42)
        h = h if b is None else xxhash.xxh64_intdigest(b.encode(), h)  # the hash of several columns: each one's seeds the next
        total += weight
        for i in range(64):
            votes[i] += weight * (h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * votes[i] > total)


def test_op2_fingerprints(spark, odd):
    want = sorted(((i, f"{fingerprint2(t):016x}") for i, t in documents(spark, odd)), key=repr)
    assert got(spark, "op2_simhash_tables", odd, "doc_id", "fingerprint") == want


def test_op2_next_over_many_ranges(spark, monkeypatch):
    """Every row's next one, with a doc_id that fills many ranges, one without, and single ones."""
    import random

    from plotwright.llm import fingerprints

    rng = random.Random(2)
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 500)
    rows = [(rng.choice([7, 7, 7, None, rng.randint(0, 1000)]), f"text {i} " * 4) for i in range(400)]
    rows += [(5000 + i, f"one {i}") for i in range(300)]
    for some in (rows, rows[400:]):
        order = sorted((-(1 << 63) if i is None else i, np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64), t) for i, t in some)
        follows = {t: order[(k + 1) % len(order)][2] for k, (_, _, t) in enumerate(order)}
        out = fingerprints.with_next(spark.createDataFrame(some, "doc_id long, text string"), "doc_id", "text")
        found = [(r["__text"], r["__next"], r["__bucket"]) for r in out.where("__tail = 0").collect()]
        assert sorted((t, n) for t, n, _ in found) == sorted(follows.items())
        most = Counter(b for _, _, b in found).most_common(1)[0][1]
        assert most <= 2 * len(some) / (1 + sum(len(t) for _, t in some) // 500)


def test_op2_pairs_within_the_radius(spark):
    from plotwright.llm.fingerprints import near_pairs

    rng = np.random.default_rng(2)
    fps = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 200)]
    every = sorted(set(fps + [f ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for k in (1, 2, 3, 4) for f in fps[:40]]))
    pairs = sorted((r.a, r.b, r.distance) for r in near_pairs(spark.createDataFrame([(f,) for f in every], "fp long")).collect())
    assert pairs == [(a, b, d) for i, a in enumerate(every) for b in every[i + 1 :] if (d := ((a ^ b) & (1 << 64) - 1).bit_count()) <= 3]


def quality3(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            repeated |= set(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def test_op3(spark, odd):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got(spark, "op3_kneser_ney_bands", odd, *columns) == sorted(((i, *quality3(t)) for i, t in documents(spark, odd)), key=repr)
    rows = QUERIES["op3_kneser_ney_bands"](spark, odd).collect()
    assert not any(r.kept and r.base_failed for r in rows) and any(r.kept for r in rows)


def thue_morse(n, letters="ab"):
    return "".join(letters[k.bit_count() % 2] for k in range(n))


def test_op3_counts_compare_bytes():
    """Strings that polynomial hashes modulo a power of two can't tell apart."""
    import pyarrow as pa

    from plotwright.llm.quality_rules import base_counts

    words = lambda letters: " ".join("".join(thue_morse(1024, letters)[i : i + 128]) for i in range(0, 1024, 128))
    texts = [f"{thue_morse(n)}\n{thue_morse(n, 'ba')}" for n in (1024, 2048)] + [f"{words('ab')} x {words('ba')}", f"{words('ab')} x {words('ab')}", "\n\na\n \na \na", ""]
    got_ = list(zip(*(c.tolist() for c in base_counts(pa.array(texts)))))
    assert [g[:1] + g[3:] for g in got_] == [(q[0], q[3], q[4]) for q in map(quality3, texts)]


def test_op3_windows_with_equal_hashes(monkeypatch):
    import random

    import pyarrow as pa

    from plotwright.llm import quality_rules

    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(50)]
    monkeypatch.setattr(quality_rules, "mix", lambda x: x % np.uint64(5))
    assert quality_rules.base_counts(pa.array(texts))[4].tolist() == [quality3(t)[4] for t in texts]


def brute3(docs, lang_of):
    """kept and log-perplexities by loops: Kneser-Ney over dictionaries, quartiles of sorted lists, bands."""
    from plotwright.llm import quality_rules as q

    symbol, small, capital = q.characters()
    out = {}
    for lang in sorted({lang_of[k] for k in range(len(docs))}, key=repr):
        mine = [k for k in range(len(docs)) if lang_of[k] == lang]
        letters = Counter(int(small[ord(c)]) for k in mine for c in docs[k][1] if symbol[ord(c)] == q.LETTER)
        full, code = [0] * len(q.LETTERS), {}
        for letter, n in sorted(letters.items(), key=lambda x: (-x[1], x[0])):
            at = full.index(min(full))
            code[letter], full[at] = q.LETTERS[at], full[at] + n

        def symbols(t):
            s = []
            for c in t:
                s += [q.CAPITAL] * bool(capital[ord(c)])
                s.append(code[int(small[ord(c)])] if symbol[ord(c)] == q.LETTER else int(symbol[ord(c)]))
            return s

        texts = {docs[k][1]: symbols(docs[k][1]) for k in mine}
        count = {q.ORDER: Counter()}
        for s in texts.values():
            padded = [0] * (q.ORDER - 1) + s
            count[q.ORDER].update(tuple(padded[i : i + q.ORDER]) for i in range(len(s)))
        for order in range(q.ORDER - 1, 0, -1):
            count[order] = Counter(g[1:] for g in count[order + 1])
        rest, whole, discount = {}, {}, {}
        for order, c in count.items():
            n = [max(1, sum(v == k for v in c.values())) for k in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            d = [0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], low), high) for k, low, high in ((1, 0.1, 0.95), (2, 0.2, 1.9), (3, 0.3, 2.85))]
            discount[order] = d
            whole[order], rest[order] = Counter(), Counter()
            for g, v in c.items():
                whole[order][g[:-1]] += v
                rest[order][g[:-1]] += d[min(v, 3)]

        def p(g):
            if not g:
                return 1 / q.ALPHABET
            c, w = count[len(g)][g], whole[len(g)][g[:-1]]
            if not w:
                return p(g[1:])
            return max(c - discount[len(g)][min(c, 3)], 0) / w + rest[len(g)][g[:-1]] / w * p(g[1:])

        cache, score = {}, {}
        for t, s in texts.items():
            padded, total = [0] * (q.ORDER - 1) + s, 0.0
            for i in range(len(s)):
                g = tuple(padded[i : i + q.ORDER])
                if g not in cache:
                    cache[g] = math.log(p(g))
                total -= cache[g]
            n_words = len(WORD.findall(t))
            score[t] = (total / len(s) if s else None, total / n_words if n_words else None, len(s))
        bands = []
        for k in (0, 1):
            v = sorted(x[k] for x in score.values() if x[1] is not None)
            bands.append([v[max(0, math.ceil(len(v) * f) - 1)] for f in (0.25, 0.5, 0.75)] if v else None)
        for k in mine:
            a, b, n = score[docs[k][1]]
            inside = b is not None
            for x, band in zip((a, b), bands):
                if inside:
                    width = max((band[2] - band[0]) / 1.349, 1e-3) * 5 * math.sqrt(1 + 200 / max(n, 1))
                    inside = abs(x - band[1]) <= width
            out[k] = (inside and not quality3(docs[k][1])[-1], a, b)
    return [out[k] for k in range(len(docs))]


@pytest.mark.parametrize("most", [32, 1])
def test_op3_verdicts(spark, odd, monkeypatch, most):
    """Models, perplexities and bands against loops; with broadcast models and with shuffled ones."""
    from plotwright.llm import quality_rules as q

    monkeypatch.setattr(q, "LANGUAGES", most)
    monkeypatch.setattr(q, "GROUP", 10_000)
    rows = spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text", "lang").collect()
    docs = [(r.doc_id, r.text or "") for r in rows]
    want = sorted(((i, *x) for (i, _), x in zip(docs, brute3(docs, [r.lang for r in rows]))), key=repr)
    found = got(spark, "op3_kneser_ney_bands", odd, "doc_id", "kept", "log_perplexity", "log_word_perplexity")
    close = lambda a, b: a is b is None or math.isclose(a, b, rel_tol=1e-4)
    key = lambda x: (repr(x[:2]), x[3] or 0)
    for a, b in zip(sorted(found, key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and close(a[2], b[2]) and close(a[3], b[3]), (a, b)


def test_op3_model():
    """Probabilities of a context sum to 1; the hash arrays give what the formula gives."""
    from plotwright.llm import quality_rules as q

    rng = np.random.default_rng(3)
    gram = np.unique(rng.integers(0, q.CELLS, 5000))
    count = rng.integers(1, 9, len(gram))
    table = q.look_up(q.kneser_ney(gram, count), np.arange(q.CELLS))
    assert np.allclose(np.exp(table.astype(np.float64)).reshape(-1, q.ALPHABET).sum(1), 1, atol=1e-4)
    # One n-gram by hand: discounted count plus the context's rest of the shorter probability.
    c = np.zeros(q.CELLS, int)
    c[gram] = count
    g = int(gram[100])
    context = c.reshape(-1, q.ALPHABET)[g // q.ALPHABET]
    n1, n2, n3, n4 = ((c == k).sum() for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    rest = sum(d[min(x, 3)] for x in context) / context.sum()
    lower = table_of_order(c, 3)[g % q.ALPHABET**3]
    assert math.isclose(math.exp(table[g]), (c[g] - d[min(c[g], 3)]) / context.sum() + rest * lower, rel_tol=1e-3)


def table_of_order(c, order):
    """Continuation model by loops over the definition."""
    from plotwright.llm import quality_rules as q

    if order == 0:
        return np.full(1, 1 / q.ALPHABET)
    kinds = c
    while len(kinds) > q.ALPHABET**order:
        kinds = (kinds.reshape(q.ALPHABET, -1) > 0).sum(0)
    n1, n2, n3, n4 = (max(1, (kinds == k).sum()) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    d = np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.1, 0.2, 0.3], [0, 0.95, 1.9, 2.85])
    lower, out = table_of_order(c, order - 1), np.zeros(len(kinds))
    for g in range(len(kinds)):
        context = kinds[g // q.ALPHABET * q.ALPHABET : g // q.ALPHABET * q.ALPHABET + q.ALPHABET]
        total = max(1, context.sum())
        rest = sum(d[min(x, 3)] for x in context) / total if context.sum() else 1
        out[g] = max(kinds[g] - d[min(kinds[g], 3)], 0) / total + rest * lower[g % len(lower)]
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP, CARD, PHONE = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(m):
    return [int(c) for c in m[0] if c.isdigit()]


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0


def base4(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


def test_op4(spark, odd):
    want = []
    for i, t in documents(spark, odd):
        base = base4(t)
        want.append((i, *(sum(s[0] == k for s in base) for k in pii.BASE), sha(pii.joined(base).encode())))
    assert got(spark, "op4_anchor_expansion", odd, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)


def test_op4_random_texts():
    import random

    rng = random.Random(4)
    bits = ["1", "2", "0", "25", "123", "4111111111111111", "4111 1111 1111 1111", "-", " ", ".", "@", "+", "a", "b.c", "é", "🙂", "(", ")", "x@y.com", "%", "\n", "+1 555", "http://u:p@h.com", "iban DE89 3704 0044 0532 0130 00 "]
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert [s for s in pii.spans(t) if s[0] in pii.BASE] == base4(t), t


@pytest.mark.parametrize("bit", [*(f"{c}={c}:" for cues in pii.CUES.values() for c in cues), "token=", "iban DE89 ", "account 12", "http://", "http://a:b", "a@b.", "+1(", "1.", "4111 ", "@", "+", "1"])
def test_op4_linear_time(bit):
    """A megabyte of every anchor takes seconds."""
    import time

    start = time.perf_counter()
    pii.spans(bit * (1_000_000 // len(bit)))
    assert time.perf_counter() - start < 20


def test_op4_secret_after_a_dry_run():
    found = lambda t: [t[a:b] for k, a, b in pii.spans(t) if k == "secret"]
    assert found("token=xxsecret= abc12345") == ["abc12345"]
    assert found("token=token=token=abcdefgh") == [] and found("token=token=abcdefg1 secret: 12345678") == ["token=abcdefg1", "12345678"]


def test_op4_iban_before_further_words():
    t = "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX"
    assert [t[a:b] for k, a, b in pii.spans(t) if k == "iban"] == ["DE89 3704 0044 0532 0130 00"]


def test_op4_added_kinds_and_mask(spark, odd):
    t = 'token = "04dbebab91ab85687d" iban DE89370400440532013000 account no: 12345678 http://bob:pw@h.example/'
    assert [t[a:b] for k, a, b in pii.spans(t) if k not in pii.BASE] == ["DE89370400440532013000", "12345678", "04dbebab91ab85687d", "bob:pw"]
    assert pii.masked("to a@b.co, +1 555 555 5555!", pii.spans("to a@b.co, +1 555 555 5555!")) == "to [EMAIL], [PHONE]!"
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = pii.mask(docs)
    assert out.columns == docs.columns and out.where("text like '%4111%'").count() == 0 and out.where("text is null").count() == 1


def test_op6(spark, odd):
    path, pattern = bpe.public_vocabulary()
    import base64

    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in documents(spark, odd):
        ids = reference.encode_ordinary(t)
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.encode())))
    assert got(spark, "op6_byte_bpe", odd, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    twice = bpe.decode(bpe.encode(spark.read.parquet(f"{odd}/documents.parquet"), path, pattern), path, pattern, digests=True)
    assert sorted(map(tuple, twice.collect()), key=repr) == sorted(want, key=repr)
    coded = bpe.encode(spark.read.parquet(f"{odd}/documents.parquet"), path, pattern)
    assert all(bytes(r.decoded).decode() == reference.decode(r.token_ids) for r in bpe.decode(coded, path, pattern).collect())


def test_op6_white_space_and_scripts():
    path, pattern = bpe.public_vocabulary()
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Bpe(open(path, "rb").read(), pattern)
    texts = [f"x{chr(c)} y{chr(c)}  'll" for c in range(0x3100) if not 0xD800 <= c < 0xE000] + ["a" * 3000, "ab" * 900 + " " * 50]
    for t, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t), repr(t)


def test_op6_long_pieces():
    """Pieces beyond the matrix as the library has them, and a megabyte without white space in seconds."""
    import base64
    import random
    import time

    path, pattern = bpe.public_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own, rng = bpe.Bpe(open(path, "rb").read(), pattern), random.Random(6)
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    texts = [letters[:n] for n in (1023, 1024, 1025, 5000)] + ["a" * 5000, "ab" * 3000, "é" * 2000, "the" * 1500, "=" * 4000]
    for t, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)
    start = time.perf_counter()
    (ids,) = own.encode([letters])
    assert time.perf_counter() - start < 60 and own.decode(np.frombuffer(ids, "<u4")) == letters.encode()


def test_op9(spark, odd):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for i, t in documents(spark, odd):
        w, places, base, labels, best = pattern.findall(t.translate(LOW)), [], set(), set(), 0.0
        for phrase, label in licenses.PHRASES.items():
            k = phrase.split()
            found = [j for j in range(len(w) - len(k) + 1) if w[j : j + len(k)] == k]
            places += found
            base |= {label} if found else set()
        for label, notice in licenses.TEMPLATES.items():
            size, n = licenses.block_words(notice), set(notice.split())
            for b in range(0, max(1, len(w)), size // 2):
                block = set(w[b : b + size])
                if len(n & block) >= licenses.THRESHOLD * len(n) - 1e-9:
                    labels.add(label)
                    best = max(best, len(n & block) / len(n))
        want.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), best))
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert got(spark, "op9_set_join", odd, *columns) == sorted(want, key=repr)


def test_op9_templates_of_any_length(spark):
    """A table of templates from three words to 900; notices at every place of a text, whole and with words changed."""
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5)))
    sizes = (3, 7, 30, 64, 65, 200, 900)
    templates = {f"t{n}": " ".join(word() for _ in range(n)) for n in sizes}
    rows = []
    for n in sizes:
        for changed in (0, n // 20, n // 5):
            notice = templates[f"t{n}"].split()
            for k in rng.sample(range(n), changed):
                notice[k] = "zzz"
            fill = [word() for _ in range(rng.randint(0, 700))]
            rows.append((len(rows), " ".join([*fill, *notice, *(word() for _ in range(50))])))
    rows.append((len(rows), None))
    table = spark.createDataFrame([(k, v.upper() + ".") for k, v in templates.items()] + [(None, "x"), ("empty", " ")], "label string, text string")
    found = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), {}, table).collect()}
    for i, t in rows:
        w, want = (t or "").split(), {}
        for label, body in templates.items():
            size, n = licenses.block_words(body), set(body.split())
            share = max(len(n & set(w[b : b + size])) / len(n) for b in range(0, max(1, len(w)), size // 2))
            if share >= licenses.THRESHOLD - 1e-9:
                want[label] = share
        assert found[i] == (",".join(sorted(want)), max(want.values(), default=0.0)), i
        assert i >= 21 or i % 3 == 2 or f"t{sizes[i // 3]}" in want


def test_op10(spark, odd):
    docs = documents(spark, odd)
    count = Counter(t.encode()[k : k + 200] for _, t in docs for k in range(len(t.encode()) - 199))
    want = []
    for i, t in docs:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = sum(bool(g) and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(b), int(gone.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~gone]))))
    assert got(spark, "op10_cover_suffixes", odd, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


def test_op10_cover():
    from plotwright.llm.suffix_dedup import cover

    for r in (0, 1, 2):
        v, d = cover(r)
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_op10_parts(spark, monkeypatch):
    """Documents over several parts of a chunk."""
    from plotwright.llm import suffix_dedup

    rng = np.random.default_rng(6)
    c = suffix_dedup.Chunk(bytes(rng.integers(97, 101, 900, np.uint8)), np.array([300, 0, 150, 450]))
    monkeypatch.setattr(suffix_dedup, "PART", 128)
    every = np.concatenate([s + c.places(s, n, 200, False) for _, s, n in c.parts()])
    assert sorted(every.tolist()) == [*range(0, 101), *range(450, 701)]
    some = np.concatenate([s + c.places(s, n, 128, True) for _, s, n in c.parts()])
    v, d = suffix_dedup.cover()
    assert sorted(some.tolist()) == [x for a, b in ((0, 300), (300, 450), (450, 900)) for x in range(a, b - 127) if (x - a) % v in d]


def test_op7(spark):
    from plotwright.llm import cotrain

    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = cotrain.fit(docs, labels)
    assert model.held_out["good_kept"] > 0.95 and model.held_out["bad_rejected"] > 0.7
    scores = cotrain.score(docs, model)
    assert scores.count() == docs.count() and cotrain.keep_good(docs, model).count() == scores.where("kept").count()


def test_op7_one_exchange(spark):
    """The surest guesses over all unlabelled rows, by loops over all of them."""
    import math as m
    import random

    from plotwright.llm import cotrain

    rng = random.Random(7)
    texts = [" ".join(rng.choice(["good", "fine", "calm", "bad", "vile", "x1", "river"]) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    docs = [(i, texts[i], rng.choice("ab"), rng.choice(["en", None]), len(texts[i])) for i in range(250)]
    docs += [(250 + i, *docs[i][1:]) for i in range(50)]  # copies
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long").repartition(5)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 250, 10)] + [(0, 0, 0)], "doc_id long, quality int, toxic int")
    rows, known = cotrain.features(frame, "doc_id", "text"), cotrain.labelled(labels)
    assert {int(r["__k"]): r.y for r in known.collect()} == {i: int(i > 0) for i in range(0, 250, 10)}
    noise = np.random.default_rng(7)
    views = {"text": cotrain.View((1 << cotrain.WORD_BITS) + len(cotrain.SHAPES) * cotrain.BINS), "meta": cotrain.View(1 << cotrain.META_BITS)}
    for view in views.values():
        view.weight, view.scale = noise.normal(0, 2, view.width + 1), (1.5, 0.1)
    every = [r.asDict() for r in rows.collect() if not (r.id < 250 and r.id % 10 == 0)]
    edges = np.sort(noise.normal(0, 1, (len(cotrain.SHAPES), cotrain.BINS - 1)), 1)
    taught = {"text": np.array([every[0]["kind"]]), "meta": np.array([], np.int64)}
    want = []
    for mine, other in (("text", "meta"), ("meta", "text")):
        best = {}
        for r in every:
            bins, shapes, meta = (np.frombuffer(r[c], t) for c, t in (("bins", np.uint16), ("shapes", float), ("meta", np.int16)))
            w = views[mine].weight
            if mine == "text":
                raw = sum(w[b] * cotrain.WORD_VALUE / m.sqrt(len(bins)) for b in bins) + sum(w[(1 << cotrain.WORD_BITS) + i * cotrain.BINS + sum(x >= e for e in edges[i])] * cotrain.SHAPE_VALUE for i, x in enumerate(shapes))
            else:
                raw = 0.5 * sum(w[b] for b in meta)
            p = 1 / (1 + m.exp(-(1.5 * (raw + w[-1]) + 0.1)))
            best[r["kind"]] = p
        for value, sure in ((1.0, lambda p: p), (0.0, lambda p: 1 - p)):
            found = sorted((-sure(p), kind) for kind, p in best.items() if sure(p) >= cotrain.CONFIDENT and kind not in taught[other])
            want += [(other, value, kind) for _, kind in found[:12]]
    assert cotrain.surest(rows, known, views, edges, taught, 12) == sorted(want) and len(want) > 20


def test_op7_odd_tables(spark, odd, empty):
    from plotwright.llm import cotrain

    rows = QUERIES["op7_cotraining"](spark, odd).collect()
    assert len(rows) == len(documents(spark, odd)) and all(0 <= r.score <= 1 for r in rows)
    labels = spark.read.parquet(f"{empty}/labels.parquet")
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    assert cotrain.fit(docs, labels) is None and cotrain.score(docs, None).where("kept").count() == docs.count()


def test_packed_ties():
    """Ties of small numbers, with and without checks, against counts."""
    import pyarrow as pa

    from plotwright.llm import packed

    rng = np.random.default_rng(0)
    for turn in range(200):
        bits = int(rng.integers(0, 4))
        values = [np.sort(rng.integers(0, 64, rng.integers(1, 30)).astype(np.uint64)) for _ in range(3)]
        # Mostly the checks follow the value, as they do for equal strings; else equal numbers are sent one by one.
        checks = [(v % 3 if turn % 2 else rng.integers(0, 3, len(v))).astype(np.uint16) for v in values]
        for use in (False, True):
            rows = [r for i, (v, c) in enumerate(zip(values, checks)) for r in packed.sent(i, 0, v, bits, 6, c if use else None)]
            told = {}
            for bucket in {r[2] for r in rows}:
                group = pa.Table.from_batches([packed.batch([r for r in rows if r[2] == bucket])])
                for r in packed._tied(group).to_pylist():
                    told.setdefault(r["chunk"], []).append((r["bucket"], r["blob"]))
            n = Counter((int(a), int(b) * use) for v, c in zip(values, checks) for a, b in zip(v, c))
            for i, (v, c) in enumerate(zip(values, checks)):
                want = [n[int(a), int(b) * use] > 1 for a, b in zip(v, c)]
                assert packed.marked(v, bits, 6, told.get(i, [])).tolist() == want


def test_packed_sends_a_number_once():
    from plotwright.llm import packed

    (row,) = packed.sent(0, 0, np.full(100_000, 7, np.uint64), 0, 64)
    assert len(row[3]) < 100 and packed.unpack(row[3])[1].tolist() == [True]


def test_op10_leaves_no_table(spark, odd, monkeypatch):
    from plotwright.llm import suffix_dedup

    before = spark.sql("show databases").count()
    monkeypatch.setattr(suffix_dedup, "_copies", lambda chunks: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        suffix_dedup.repeated(spark.read.parquet(f"{odd}/documents.parquet"))
    assert spark.sql("show databases").count() == before


def test_round_trip_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "x", "mine", "t"), (2, None, None, None)], "n_tokens int, text string, ids_sha256 string, __text string")
    path, pattern = bpe.public_vocabulary()
    got = bpe.round_trip(docs, path, pattern, keep=("n_tokens", "__text", "ids_sha256")).collect()
    assert [(r["__text"], r.n_tokens, r.ids_sha256 != "mine") for r in got] == [("t", 1, True), (None, 0, True)]
