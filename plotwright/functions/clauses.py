"""A reader of clauses: what the figures and words of a text mean by what stands around them.

A text is folded character by character, cut into words, numbers and signs once, and read by tables of phrases
(vocabulary.py). Offsets are those of the text as it is. All readings of a column come from one Arrow pass.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache, partial
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from plotwright.functions import vocabulary as V

#: A number beyond this many square metres, or below one, is no area; digits of a number at most.
LARGEST_AREA, DIGITS = 1e8, 15
#: Characters before a figure in which its owner is searched, in plain and in careful reading; for a plot word near "surface".
NEAR, OWN, CONTEXT = 40, 60, 80


class _Folded(dict):
    """One character for each: without its accents, in lower case."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = unicodedata.normalize("NFKD", c)[:1] or c
        self[code] = out = plain.lower()[:1] or c
        return out


FOLDED = _Folded()


def fold_text(text: str) -> str:
    """text in lower case and without accents, every character at its own place."""
    return text.translate(FOLDED)


class Words:
    """A text as words, numbers and signs: what they say, where they are, and the blank before each."""

    SHAPE = re.compile(r"(\s*)(\d+|[^\W\d_]+|\S)")

    def __init__(self, text: str):
        self.text = text
        self.folded = fold_text(text)
        found = [(m[1], m[2], m.start(2), m.end(2)) for m in self.SHAPE.finditer(self.folded)]
        self.gap, self.say, self.start, self.end = map(list, zip(*found)) if found else ([], [], [], [])

    def __len__(self) -> int:
        return len(self.say)

    def at(self, i: int) -> str:
        return self.say[i] if 0 <= i < len(self.say) else ""

    def glued(self, i: int) -> bool:
        """Nothing stands between word i and the one before it."""
        return 0 < i < len(self.say) and not self.gap[i]

    def cut(self, signs: str, spaced: bool) -> list[int]:
        """The number of the clause of each word: one ends after any of the signs, if spaced only before a blank."""
        out, n = [], 0
        for i, gap in enumerate(self.gap):
            before = self.say[i - 1] if i else ""
            line = "\n" in signs and ("\n" in gap[:-1] if spaced else "\n" in gap)
            if line or before in signs and before and (gap or not spaced):
                n += 1
            out.append(n)
        return out

    def span(self, i: int, j: int) -> str:
        """The text of words i to j (exclusive) as written."""
        return self.text[self.start[i] : self.end[j - 1]]


class Phrases:
    """A table of phrases and what they stand for. Of several that fit at a place, the longest holds."""

    def __init__(self, *tables: Iterable[str] | dict[str, object]):
        self.exact: dict[str, list] = {}
        self.stems: dict[str, list] = {}
        for table in tables:
            for phrase in table:
                self._add([self._slot(s) for s in phrase.split()], table[phrase] if isinstance(table, dict) else phrase)
        self.lengths = sorted({len(s) for s in self.stems})

    @staticmethod
    def _slot(written: str) -> tuple:
        if written[0] == "~":
            return None, (), int(written[1:])
        optional = len(written) > 1 and written[-1] == "?"
        words = (written[:-1] if optional else written).split("|") if len(written) > 1 else [written]
        exact = frozenset(w for w in words if w[-1] != "*" or len(w) == 1)
        return exact, tuple(w[:-1] for w in words if w[-1] == "*" and len(w) > 1), int(optional)

    def _add(self, slots: list, value: object) -> None:
        for w in slots[0][0]:
            self.exact.setdefault(w, []).append((slots[1:], value))
        for w in slots[0][1]:
            self.stems.setdefault(w, []).append((slots[1:], value))
        if slots[0][2] and len(slots) > 1:
            self._add(slots[1:], value)

    @classmethod
    def _rest(cls, w: Words, i: int, slots: list) -> int | None:
        """Where the slots end if they fit from word i on, as far as possible."""
        if not slots:
            return i
        exact, stems, loose = slots[0]
        if exact is None:  # any words
            ends = [cls._rest(w, i + k, slots[1:]) for k in range(loose + 1)]
            return max((e for e in ends if e is not None), default=None)
        say = w.at(i)
        end = cls._rest(w, i + 1, slots[1:]) if say and (say in exact or say.startswith(stems)) else None
        skipped = cls._rest(w, i, slots[1:]) if loose else None
        return skipped if end is None else end if skipped is None else max(end, skipped)

    def fit(self, w: Words, i: int) -> tuple[int, object] | None:
        """End and value of the longest phrase that begins with word i."""
        say, best = w.at(i), None
        found = self.exact.get(say, [])
        for k in self.lengths:
            if k > len(say):
                break
            found = found + self.stems[say[:k]] if say[:k] in self.stems else found
        for slots, value in found:
            end = self._rest(w, i + 1, slots)
            if end is not None and (best is None or end > best[0]):
                best = end, value
        return best

    def hits(self, w: Words) -> list[tuple[int, int, object]]:
        """Begin, end and value of all phrases, the next one searched after the one before."""
        out, i = [], 0
        while i < len(w):
            fit = self.fit(w, i)
            if fit:
                out.append((i, *fit))
                i = max(i + 1, fit[0])
            else:
                i += 1
        return out

    def ends_at(self, w: Words, i: int, most: int = 4) -> int | None:
        """Where a phrase of up to `most` words begins that ends right before word i."""
        return next((k for k in range(max(0, i - most), i) if (self.fit(w, k) or (0, 0))[0] == i), None)


class Figure:
    """A number as written: its value, the word after it, the sign between its groups of three, whether it has decimals."""

    __slots__ = ("begin", "end", "value", "group", "decimals")

    def __init__(self, w: Words, i: int, groups: str):
        say, gap = w.say, w.gap
        j, group, digits = i + 1, "", say[i]
        while len(say[i]) <= 3 and j < len(w):
            if say[j] in groups and w.glued(j) and w.glued(j + 1) and self._three(w, j + 1) and group in ("", say[j]):
                group, digits, j = say[j], digits + say[j + 1], j + 2
            elif " " in groups and gap[j] in (" ", "\xa0", " ", " ") and self._three(w, j) and group in ("", gap[j]):
                group, digits, j = gap[j], digits + say[j], j + 1
            else:
                break
        self.decimals = say[j] in ".," and say[j] != group and w.glued(j) and w.glued(j + 1) and say[j + 1].isdecimal() if j + 1 < len(w) else False
        if self.decimals:
            digits, j = f"{digits}.{say[j + 1]}", j + 2
        self.begin, self.end, self.group = i, j, group
        self.value = float(digits) if len(digits) <= DIGITS else float("inf")

    @staticmethod
    def _three(w: Words, k: int) -> bool:
        return k < len(w) and len(w.say[k]) == 3 and w.say[k].isdecimal()


def figures(w: Words, groups: str = "., ") -> Iterable[Figure]:
    """Numbers from left to right; what stands right after a dot or comma of another number is none."""
    i = 0
    while i < len(w):
        if not w.say[i].isdecimal():
            i += 1
            continue
        f = Figure(w, i, groups)
        if not (w.glued(i) and w.at(i - 1) in (".", ",") and w.glued(i - 1) and w.at(i - 2).isdecimal()):
            yield f
        i = f.end


# --- areas ---

UNITS = Phrases(dict.fromkeys(V.SQUARE, 1.0), dict.fromkeys(V.HECTARE, 1e4), dict.fromkeys(V.HUNDRED, 100.0))
LOOSE_UNITS = Phrases(dict.fromkeys(V.SQUARE, (1.0, False)), dict.fromkeys(V.HECTARE[:-2], (1e4, False)), dict.fromkeys(V.LOOSE, (1.0, True)))
SIDES = Phrases(dict.fromkeys(V.PLOT_STEMS, "plot"), dict.fromkeys(V.BUILT_STEMS, "built"))
OWNERS = Phrases(*[dict.fromkeys(words, kind) for words, kind in ((V.PART, "part"), (V.PLOT, "plot"), (V.BUILT, "built"), (V.FLAT, "flat"), (V.SURFACE, "surface"))])
ABOUT, AWAY = Phrases(V.ABOUT), frozenset(V.FROM)


def _measure(w: Words, f: Figure, units: Phrases, stop: bool = False):
    """End and value of the unit after a figure, or after its full stop and one blank; a word that goes on after the unit makes it none."""
    unit = units.fit(w, f.end + (stop and w.at(f.end) == "." and w.glued(f.end) and w.gap[f.end + 1 : f.end + 2] == [" "]))
    if unit and w.glued(unit[0]) and (w.at(unit[0])[:1].isalnum()):
        return None
    return unit


def areas_of(w: Words) -> list[dict]:
    """m2 and kind (plot, built or null) of every area: by the word right after it, else the nearest before it in its sentence."""
    out, sides, sentence = [], SIDES.hits(w), w.cut(".;·|\n", True)
    for f in figures(w):
        unit = _measure(w, f, UNITS)
        if not unit or not 1 <= f.value * unit[1] <= LARGEST_AREA:
            continue
        kind = next((k for i, j, k in reversed(sides) if j <= f.begin and sentence[i] == sentence[f.begin] and w.end[j - 1] > w.start[f.begin] - NEAR), None)
        kind = next((k for i, _, k in sides if i == unit[0]), kind)
        out.append({"m2": round(f.value * unit[1], 1), "kind": kind})
    return out


def stated_of(w: Words, written: bool = False) -> list[dict]:
    """m2, kind (plot, built, flat or surface) and near_plot of the areas that a clause gives to somebody; written: also those below one, and with a full stop before the unit.

    A word right after the figure owns it ("90 m2 de parcela"), else the nearest before it in its clause, but not a
    counted one ("2 banos con 90 m2"). Areas of parts and distances are left out; loose units need an owner.
    near_plot: the sentence speaks of a plot, which decides whose a bare surface is.
    """
    out, owners, clause, sentence = [], OWNERS.hits(w), w.cut(".;,|\n(", True), w.cut(".;!?\n", True)
    begins = {i: k for i, _, k in owners}
    for f in figures(w):
        unit = _measure(w, f, LOOSE_UNITS, written)
        if not unit:
            continue
        end, (factor, loose) = unit
        before = ABOUT.ends_at(w, f.begin) or f.begin
        if w.at(before - 1) == V.AT and clause[before - 1] == clause[f.begin] or loose and w.at(end) in AWAY:
            continue
        after = end + (w.at(end) in ("de", "del"))
        after += w.at(after) in ("la", "el", "los", "las")
        kind = begins.get(after)
        if kind is None or w.start[after] > w.end[end - 1] + 30:
            mine = [(i, k) for i, j, k in owners if j <= f.begin and clause[i] == clause[f.begin] and w.start[i] >= w.start[f.begin] - OWN]
            kind = next((k for i, k in reversed(mine) if not (k == "part" and w.at(i - 1).isdecimal())), None)
        if kind in (None, "part") or loose and kind == "surface" or not (0 if written else 1) <= f.value * factor <= LARGEST_AREA:
            continue
        close = any(k == "plot" and (i >= end and w.start[i] <= w.end[end - 1] + 30 or j <= f.begin and sentence[i] == sentence[f.begin] and w.start[i] >= w.start[f.begin] - CONTEXT) for i, j, k in owners)
        out.append({"m2": round(f.value * factor, 1), "kind": kind, "near_plot": close})
    return out


# --- money ---

MAGNITUDES, AMOUNT_MARKS = Phrases(V.MAGNITUDE), Phrases(V.AMOUNT_CURRENCY)
OTHER_UNITS = Phrases(V.SQUARE, V.OTHER_UNITS)
MARKS, KNOWN, UNREAD, RATES = Phrases(V.CURRENCY), Phrases(V.RANGE_MAGNITUDE), Phrases(V.UNREAD_MAGNITUDE), Phrases(V.RATE)


def _close(w: Words, i: int) -> bool:
    """Word i stands right after the one before it, or after one blank."""
    return i < len(w) and len(w.gap[i]) <= 1


def amounts_of(w: Words) -> list[float]:
    """Sums of 1000 and more that carry a currency or a magnitude; a bare number, an area or a distance is none."""
    out = []
    for f in figures(w):
        marked = w.at(f.begin - 1) in ("€", "$", "£") and _close(w, f.begin)
        end, value = f.end, f.value
        if OTHER_UNITS.fit(w, end) and _close(w, end):
            continue
        size = MAGNITUDES.fit(w, end) if _close(w, end) else None
        if size:
            marked, value, end = True, value * size[1], size[0]
        if w.glued(end) and w.at(end)[:1].isalnum():
            continue
        if _close(w, end) and AMOUNT_MARKS.fit(w, end):
            marked = True
        if marked and 1000 <= value < float("inf"):
            out.append(value)
    return out


def _side(w: Words, i: int) -> dict | None:
    """A bound of a range from word i on: currency, whole number, magnitude, currency, each of them but the number maybe absent."""
    marks = set()
    mark = MARKS.fit(w, i)
    if mark:
        marks.add(mark[1])
        i = mark[0]
        if not _close(w, i):
            return None
    if not w.at(i).isdecimal() or not mark and w.glued(i) and w.at(i - 1) in (".", ","):
        return None
    f = Figure(w, i, "., ")
    if f.decimals or w.at(f.end) in (".", ",") and w.glued(f.end) and w.glued(f.end + 1) and w.at(f.end + 1).isdecimal():
        return None
    end, value = f.end, f.value
    size = KNOWN.fit(w, end) if _close(w, end) else None
    if size and size[0] - end == 1 and w.at(end) == "m" and w.glued(end + 1) and w.at(end + 1) == "2":
        size = None
    if size:
        value, end = value * size[1], size[0]
    tail = end
    unread = False
    mark = MARKS.fit(w, end) if _close(w, end) else None
    if mark:
        marks.add(mark[1])
        end = mark[0]
    if w.glued(tail) and w.at(tail).isalpha() and not mark:
        unread = True
    for k in {tail, end}:
        if _close(w, k) and (UNREAD.fit(w, k) or KNOWN.fit(w, k) and not (w.at(k) == "m" and w.glued(k + 1) and w.at(k + 1) == "2")):
            unread = True
    return {"end": end, "tail": tail, "value": value, "bare": not f.group and not size, "blank": f.group.isspace(), "marks": marks, "unread": unread}


def ranges_of(w: Words) -> list[dict]:
    """low, high, currency and text of money ranges: two bounds, one currency between them, the upper one above the lower.

    A lower bound below 1000 without magnitude or groups that would still fit as thousands is ambiguous: low is null. A
    magnitude that isn't known, a letter after a number, or a rate after the range: both are null.
    """
    out, i = [], 0
    while i < len(w):
        low = _side(w, i)
        to = w.at(low["end"]) if low else ""
        high = _side(w, low["end"] + 1) if low and to in V.TO and (not to.isalpha() or w.gap[low["end"]] and low["end"] + 1 < len(w) and w.gap[low["end"] + 1]) else None
        if not high:
            i += 1
            continue
        marks = low["marks"] | high["marks"]
        if len(marks) == 1:
            word_after = high["blank"] and w.at(high["tail"]).isalpha() and not MARKS.fit(w, high["tail"])
            unread = low["unread"] or high["unread"] or word_after or RATES.fit(w, high["end"])
            found = {"low": None, "high": None, "currency": marks.pop(), "text": w.span(i, high["end"])}
            if unread:
                out.append(found)
            elif high["value"] > low["value"]:
                ambiguous = low["bare"] and low["value"] < 1000 and low["value"] * 1000 <= high["value"]
                out.append(found | {"low": None if ambiguous else low["value"], "high": high["value"]})
        i = high["end"]
    return out


# --- words that a negation can turn ---

AUCTION, AUCTION_NO, SEASON, MONTHS = Phrases(V.AUCTION), Phrases(V.AUCTION_NO), Phrases(V.SEASONAL), Phrases(V.SEASONAL_MONTHS)
DEPOSIT, LONG_LET = Phrases(V.DEPOSIT), Phrases(V.LONG_LET)
WORD = str.isalnum


def named(w: Words, terms: Phrases, clause: list[int]) -> bool:
    """A term without a negation among the three words before it in its clause."""
    for i, _, _ in terms.hits(w):
        before = [s for k, s in zip(clause[:i], w.say[:i]) if k == clause[i] and WORD(s)] if i else []
        if not set(before[-3:]) & set(V.TERM_NOT):
            return True
    return False


def auction_of(w: Words) -> bool:
    """An auction is named, and not right after "sin", "ni" or "no es una" and the like."""
    for i, _, _ in AUCTION.hits(w):
        k = i
        while w.at(k - 1) in V.ARTICLES and AUCTION_NO.ends_at(w, k) is None:
            k -= 1
        if w.at(i - 1) not in V.AUCTION_NOT and AUCTION_NO.ends_at(w, k) is None:
            return True
    return False


def seasonal_of(w: Words) -> bool:
    """A let for a season, for holidays or for months: not negated before or after it in its clause, and no long let in its sentence."""
    signs = [(*h, False) for h in SEASON.hits(w)] + [(*h, True) for h in MONTHS.hits(w)]
    if not signs:
        return False
    clause, sentence = w.cut(",.;:!?|()\n", False), w.cut(".;!?|\n", False)
    for i, j, _, months in signs:
        last = sentence[j - 1]
        within = [k for k in range(len(w)) if sentence[i] <= sentence[k] <= last]
        own = Words(w.span(within[0], within[-1] + 1))
        if LONG_LET.hits(own) or months and DEPOSIT.hits(own) or w.at(j) == "larga" and not months:
            continue
        before = [w.say[k] for k in range(i) if clause[k] == clause[i] and WORD(w.say[k])]
        if set(before[-4:]) & set(V.NEAR_NOT):
            continue
        far = next((s for s in reversed(before) if s not in V.LINKS), "")
        after = [w.say[k] for k in range(j, len(w)) if clause[k] == clause[j - 1] and WORD(w.say[k])][:3]
        if far not in V.FAR_NOT and not set(after) & set(V.AFTER_NOT):
            return True
    return False


# --- numbers with a meaning of their own ---

ZONES = Phrases(V.ZONE)


def zones_of(w: Words) -> list[str]:
    """Planning zones as dotted parts: up to four numbers of two digits, then maybe a letter."""
    out = set()
    for _, i, _ in ZONES.hits(w):
        i += w.at(i) == ":"
        parts = []
        while w.at(i).isdecimal() and len(w.at(i)) <= 2 and len(parts) < 4:
            parts.append(w.at(i))
            i += 1
            if w.at(i) == "." and (w.at(i + 1).isdecimal() and len(parts) < 4 or len(w.at(i + 1)) == 1 and w.at(i + 1).isascii() and w.at(i + 1).isalpha()):
                i += 1
            else:
                break
        if parts and len(w.at(i)) == 1 and w.at(i).isascii() and w.at(i).isalpha() and (w.glued(i) or w.at(i - 1) == "."):
            parts.append(w.at(i))
            i += 1
        if parts and not (w.glued(i) and w.at(i)[:1].isalnum()):
            out.add(".".join(parts))
    return sorted(out)


def phones_of(w: Words) -> list[str]:
    """Digits of numbers of 9 to 15 digits in groups of two and more, seven groups at most, between blanks, dots or dashes; web addresses have none."""
    out, i = [], 0
    while i < len(w):
        if w.at(i) in ("http", "https", "www"):
            while i < len(w) and (w.glued(i + 1)):
                i += 1
            i += 1
            continue
        if not w.at(i).isdecimal() or len(w.at(i)) < 2:
            i += 1
            continue
        start = i - (w.at(i - 1) == "+" and w.glued(i))
        digits, groups = w.at(i), 1
        i += 1
        while groups < 7 and i < len(w):
            if w.gap[i] in (" ",) and w.at(i).isdecimal() and len(w.at(i)) >= 2:
                digits, i = digits + w.at(i), i + 1
            elif w.at(i) in (".", "-") and w.glued(i) and w.glued(i + 1) and w.at(i + 1).isdecimal() and len(w.at(i + 1)) >= 2:
                digits, i = digits + w.at(i + 1), i + 2
            else:
                break
            groups += 1
        alone = not (w.glued(start) and (w.at(start - 1)[-1:].isalnum() or w.at(start - 1) in ("_", ".", ","))) and not (w.glued(i) and (w.at(i)[:1].isalnum() or w.at(i) == "_"))
        if alone and 9 <= len(digits) <= 15:
            out.append(digits)
    return out


# --- signals of a search hit ---

RENT, SALE, DEAL = Phrases(V.RENT), Phrases(V.SALE), Phrases(V.DEAL)
PROPERTY = Phrases([f"{p}|{p}s|{p}es" for p in V.PROPERTY], V.PROPERTY_PHRASES, [f"{s}*" for s in V.PROPERTY_STEMS])
SIGNALS = {"price": (Phrases(V.SIGNAL_CURRENCY), frozenset(V.SIGNAL_BEFORE)), "page_price": (Phrases(V.PAGE_CURRENCY), frozenset(V.PAGE_BEFORE)), "area": (Phrases(V.SIGNAL_UNITS), frozenset()), "page_area": (Phrases(V.PAGE_UNITS), frozenset())}
ROOMS, COUNTED = Phrases(V.ROOMS), Phrases(V.COUNTED)


def signals_of(w: Words) -> dict:
    """What a text shows of a listing: a price, an area, rooms, a deal, a property; a price and an area as a page needs them."""
    numbers = [i for i, s in enumerate(w.say) if s.isdecimal()]
    out = {k: any(after.fit(w, i + 1) or w.at(i - 1) in before and _close(w, i) for i in numbers) for k, (after, before) in SIGNALS.items()}
    rooms = any(ROOMS.fit(w, i + 1 + (w.at(i + 1) in ("-", "."))) for i in numbers)
    counted = any(s in V.COUNTS and COUNTED.fit(w, i + 1) for i, s in enumerate(w.say))
    return out | {"rooms": rooms or counted, "deal": bool(DEAL.hits(w)), "property": bool(PROPERTY.hits(w)), "rent": bool(RENT.hits(w)), "sale": bool(SALE.hits(w))}


AREA_TYPE = pa.list_(pa.struct([("m2", pa.float64()), ("kind", pa.string())]))
STATED_TYPE = pa.list_(pa.struct([("m2", pa.float64()), ("kind", pa.string()), ("near_plot", pa.bool_())]))
RANGE_TYPE = pa.list_(pa.struct([("low", pa.float64()), ("high", pa.float64()), ("currency", pa.string()), ("text", pa.string())]))
SIGNAL_NAMES = ("price", "page_price", "area", "page_area", "rooms", "deal", "property", "rent", "sale")
READINGS = {
    "areas": (areas_of, AREA_TYPE), "stated": (stated_of, STATED_TYPE), "written": (partial(stated_of, written=True), STATED_TYPE), "amounts": (amounts_of, pa.list_(pa.float64())), "ranges": (ranges_of, RANGE_TYPE),
    "auction": (auction_of, pa.bool_()), "seasonal": (seasonal_of, pa.bool_()), "zones": (zones_of, pa.list_(pa.string())), "phones": (phones_of, pa.list_(pa.string())),
    "signals": (signals_of, pa.struct([(n, pa.bool_()) for n in SIGNAL_NAMES])),
}
_DDL = {
    "areas": "array<struct<m2:double,kind:string>>", "stated": "array<struct<m2:double,kind:string,near_plot:boolean>>", "written": "array<struct<m2:double,kind:string,near_plot:boolean>>", "amounts": "array<double>",
    "ranges": "array<struct<low:double,high:double,currency:string,text:string>>", "auction": "boolean", "seasonal": "boolean", "zones": "array<string>",
    "phones": "array<string>", "signals": f"struct<{','.join(f'{n}:boolean' for n in SIGNAL_NAMES)}>",
}


@lru_cache(None)
def _reader(names: tuple[str, ...]):
    """One function for each set of names, so that a plan which asks twice reads once."""

    def read(texts: pa.Array) -> pa.Array:
        words = [Words(t or "") for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([READINGS[n][0](w) for w in words], READINGS[n][1]) for n in names], list(names))

    return F.arrow_udf(read, f"struct<{','.join(f'{n}:{_DDL[n]}' for n in names)}>")


def reading(x: Column, *names: str) -> Column:
    """The named readings of a text (READINGS) as a struct, all from one pass. A null or empty text reads as no words; texts of any length are read whole."""
    return _reader(names)(x)


def deal(shown: Column) -> Column:
    """rent or sale if the signals of a text show only one of them."""
    return F.when(shown["rent"] & ~shown["sale"], "rent").when(shown["sale"] & ~shown["rent"], "sale")


def folded(x: Column) -> Column:
    """The text in lower case and without accents, every character at its own place. Null stays null."""

    def fold(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else fold_text(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(fold, "string")(x)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, in order; those that touch are one."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((a, z))
    return out


def needle(term: str) -> str:
    """A task's term as a phrase: a Latin word with its plural, another one as the beginning of a word."""
    words = [s for _, s, _, _ in ((m[1], m[2], 0, 0) for m in Words.SHAPE.finditer(fold_text(term)))]
    last = words[-1]
    return " ".join([*words[:-1], f"{last}|{last}s|{last}es" if last.isascii() and last.isalnum() else f"{last}*"])


def windows_of(w: Words, terms: list[Phrases], width: int, each: int, most: int, skip: int = 0, plain: int = 0) -> list[dict]:
    """start, end and quote of the text around the terms' words, in order of the text.

    Windows of a term that meet are one; the first of every term is taken, then the second, `each` of a term and `most`
    in all; those taken that meet are one again. Hits that end before `skip` are left out, and of the first `plain` terms
    those right after "no", "sin", "nunca", "libre de".
    """
    per_term = []
    for nth, t in enumerate(terms):
        hits = [(i, j) for i, j, _ in t.hits(w) if w.end[j - 1] > skip]
        if nth < plain:
            hits = [(i, j) for i, j in hits if w.at(i - 1) not in ("no", "sin", "nunca") and not (w.at(i - 1) == "de" and w.at(i - 2) in ("libre", "libres"))]
        spans = merged((max(0, w.start[i] - width), min(len(w.text), w.end[j - 1] + width)) for i, j in hits)
        per_term.append(spans[:each])
    ranked = list(chain.from_iterable([s[k] for s in per_term if k < len(s)] for k in range(each)))
    return [{"start": a, "end": z, "quote": " ".join(w.text[a:z].split())} for a, z in merged(ranked[:most])]


def quote_windows(x: Column, terms: list[list[str]], width: int = 80, each: int = 2, most: int = 8, skip: int = 0, plain: int = 0) -> Column:
    """windows_of for a column; terms are lists of words that mean the same. Offsets are those of the text as it is."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("quote", pa.string())]))

    def cut(texts: pa.Array) -> pa.Array:
        tables = [Phrases([needle(t) for t in words]) for words in terms]
        return pa.array([windows_of(Words(t or ""), tables, width, each, most, skip, plain) for t in texts.to_pylist()], kind)

    return F.arrow_udf(cut, "array<struct<start:int,end:int,quote:string>>")(x)


# --- what readings say of a stated fact ---


def plot_area(found: Column) -> Column:
    return F.array_max(F.transform(F.filter(found, lambda a: a["kind"] == "plot"), lambda a: a["m2"]))


def largest_area(found: Column) -> Column:
    return F.array_max(F.transform(found, lambda a: a["m2"]))


def area_conflict(kind: Column, area: Column, plot: Column, surface: Column, stated: Column, ratio: float = 2.0) -> Column:
    """A row's areas of which one is none of the text's areas of its kind, within a factor; null columns say nothing.

    kind: the row's type of property. A plot meets the text's plots, a building its buildings; one of an unknown kind may
    be either, but the house is no larger than its plot, nor the plot smaller than its house. A bare surface of the text
    is the row's own area of any kind.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    land = no(F.lower(F.trim(kind)).isin("land", "landparcel"))
    flat = no(F.lower(F.trim(kind)).isin(*V.FLAT_TYPES)) | F.exists(stated, lambda s: s["kind"] == "flat")
    m2 = lambda keep: F.transform(F.filter(stated, keep), lambda s: s["m2"])
    bare = lambda s: s["kind"] == "surface"
    plots = m2(lambda s: (s["kind"] == "plot") | bare(s) & (land | s["near_plot"]))
    built = m2(lambda s: s["kind"].isin("built", "flat") | bare(s) & flat & ~(land | s["near_plot"]))
    loose = m2(lambda s: bare(s) & ~(land | s["near_plot"] | flat))
    near = lambda v, xs: F.exists(xs, lambda x: F.greatest(v, x) <= ratio * F.least(v, x))
    none = lambda xs: F.size(xs) == 0

    def against(v: Column, own: Column) -> Column:
        fits_plot, fits_built = none(plots) | near(v, plots), none(built) | near(v, built)
        house = fits_built & (none(plots) | (v <= ratio * F.array_max(plots)))
        ground = fits_plot & (none(built) | (v * ratio >= F.array_min(built)))
        wrong = F.when(own == "plot", ~fits_plot).when(own == "built", ~fits_built).otherwise((~none(plots) | ~none(built)) & ~(house | ground))
        return no((v > 0) & (wrong | ((own != "plot") & ~none(loose) & ~near(v, loose))))

    of_row = F.when(land, "plot").when(no(plot > 0) | flat, "built").otherwise("any")
    return against(plot, F.lit("plot")) | against(area, of_row) | against(surface, of_row)


def rental_term(x: Column) -> Column:
    low = F.lower(x)
    short, long = low.rlike("short term|temporada|vacacional|por d[ií]as|посуточ"), low.rlike("long term|larga (?:estancia|temporada)|долгосроч")
    return F.when(long, "long").when(short, "short")
