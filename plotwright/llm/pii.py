"""Personal data by anchor expansion: an Aho-Corasick pass finds anchors, local parsers settle the boundaries."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwright.llm.bpe import slices
from plotwright.llm.common import dealt_documents

#: In the order in which spans are listed.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "account", "secret", "login")
#: Words that announce an identifier (any of lower, upper and title case).
CUES = {
    "iban": ("iban",),
    "account": ("account", "acct", "passport", "ssn", "social security"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "api key"),
}
SLICE = 4 << 20

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"[^A-Za-z0-9]{0,4}(?:no\.?|number)?[^A-Za-z0-9]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?: ?(?:no\.?|number|id|#))?[ :=#]{1,4}([A-Za-z]{0,3}[0-9](?:-?[A-Za-z0-9]){4,31})(?![A-Za-z0-9])")
BEFORE_SECRET = re.compile(r"""["']?\s{0,3}[:=]\s{0,3}["']?""")
SECRET = re.compile(r"[A-Za-z0-9_+/=.~-]{8,}")
LOGIN = re.compile(r"([^\s/?#@:\"'<>]{1,256}(?::[^\s/?#@\"'<>]{0,256})?)@[A-Za-z0-9-]")


@lru_cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for x in "@+0123456789":
        found.add_word(x, (x if x in "@+" else "0", 1))
    found.add_word("://", ("://", 3))
    for kind, cues in CUES.items():
        for cue in cues:
            for form in {cue, cue.upper(), cue.title()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    code = iban.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def iban_size(found: str) -> int:
    """Characters of the longest valid number at the start of found that ends there or before a space; 0 if none is."""
    ends = [len(found), *(i for i in range(len(found) - 1, 0, -1) if found[i] == " ")]
    return next((e for e in ends if mod97(found[:e])), 0)


def octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start; within a kind none overlap.

    Each anchor is expanded by the parser of its kind from where that kind's last match ended: so matches are those of a
    leftmost, greedy, non-overlapping search. Matches that fail validation are dropped. Parsers of numbers, logins and
    accounts read a bounded stretch for an anchor, and no other reads a run twice, so the time is linear in the text.
    """
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys((*KINDS, "dotted"), 0)
    dry = 0  # end of the last run of a secret's characters that has no digit: later cues in it have none either

    def cue(kind: str, pattern: re.Pattern, start: int, size) -> None:
        if start >= done[kind] and (m := pattern.match(text, start)) and (n := size(m[1])):
            out[kind].append((m.start(1), m.start(1) + n))
            done[kind] = m.start(1) + n

    for last, (what, n) in automaton().iter(text):
        at = last - n + 1
        if what == "0":
            if at >= done["card"]:
                m = DIGITS.match(text, at)
                done["card"] = m.end()
                if m.end() - at >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                    out["card"].append(m.span())
            if at >= done["dotted"]:
                m = DOTTED.match(text, at)
                done["dotted"], runs, start = m.end(), m[0].split("."), at
                for i in range(0, len(runs) - 3, 4):
                    end = start + sum(map(len, runs[i : i + 4])) + 3
                    if octets(runs[i : i + 4]):
                        out["ip"].append((start, end))
                    start = end + 1
        elif what == "@":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                out["email"].append((start, m.end()))
                done["email"] = m.end()
        elif what == "+":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                    out["phone"].append(m.span())
        elif what == "://":
            cue("login", LOGIN, last + 1, len)
        elif what == "iban":
            cue("iban", IBAN, last + 1, iban_size)
        elif what == "account":
            cue("account", ACCOUNT, last + 1, lambda x: len(x) if sum(map(str.isdigit, x)) >= 4 else 0)
        elif last + 1 >= done["secret"] and (before := BEFORE_SECRET.match(text, last + 1)) and before.end() >= dry and (m := SECRET.match(text, before.end())):
            if any(map(str.isdigit, m[0])):
                out["secret"].append(m.span())
                done["secret"] = m.end()
            else:
                dry = m.end()
    return [(k, a, b) for k in KINDS for a, b in out[k]]


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for start, end, kind in sorted((a, -b, k) for k, a, b in found):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, -end)
    return "".join([*out, text[at:]])


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (kind:start:end, comma-joined) of every row.

    A null text is empty; an empty text has no spans and the digest of the empty string; a null key is kept; repeated rows
    give a row each; of a very long text every span is found, in linear time. Other columns are left out, so their names
    can't clash. An empty table gives an empty one.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            for i, j in slices(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False), SLICE):
                every = [spans(t) for t in b.column(1)[i:j].to_pylist()]
                base = [[s for s in x if s[0] in BASE] for x in every]
                counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in BASE]
                shas = [hashlib.sha256(joined(x).encode()).hexdigest() for x in base]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], *counts, pa.array(shas), pa.array(list(map(joined, every)))], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data replaced in `text` by its kind in brackets, overlapping spans by the first one's.

    Null stays null and empty stays empty; rows keep their number, so repeated rows stay repeated; all other columns,
    whatever their names, pass through. An empty table gives an empty one.
    """
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            whole = pa.Table.from_batches([b])
            for i, j in slices(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False), SLICE):
                part = whole.slice(i, j - i)
                new = pa.array([t if t is None else masked(t, spans(t)) for t in part.column(at).to_pylist()], part.schema.field(at).type)
                yield from part.set_column(at, part.schema.field(at), new).to_batches()

    return docs.mapInArrow(run, docs.schema)


def op4_anchor_expansion(spark, sf_dir):
    return find(dealt_documents(spark, sf_dir))
