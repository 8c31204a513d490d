"""Conversation structure repair: the cheapest edits that make a conversation take turns, by A* on an edit lattice."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwright.llm.common import durable

#: What an edit costs; a truncated turn that isn't deleted costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the pattern (s?(ua)+)?: nothing yet, after a system turn, after a user turn, after an assistant turn.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: From each state, the edits that end a conversation and their cost (None: it may end as it is, too).
TAIL = {NONE: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
FINE, BLANK, REPEATED, CUT = range(4)
WHITE = " \t\n\x0b\x0c\r"
ENDS, LEGAL = frozenset(".!?"), frozenset(("su", "ua", "au"))
#: Rows that one search sees at most; bytes of a range of rows; a search that can't end.
CHUNK, PIECE, NEVER = 256, 64 << 20, 1 << 60


def after(state: int, initial: str) -> int | None:
    """The state after a kept turn, None if it may not stand there."""
    if initial == "s":
        return SYSTEM if state == NONE else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def made(state: int) -> int:
    """The state after an inserted turn or one with a new role: only one of the two roles may stand there."""
    return ASSISTANT if state == USER else USER


def search(rows: list[tuple[str, int]], entry: int, ends: bool) -> dict[int, tuple[int, str]]:
    """For each state after rows (initial and fault of each): the cheapest edits from the state `entry`, of those the ASCII-least audit.

    If the conversation ends there, only the best state that it may end in, with inserts after the last row. The frontier
    is ordered by (cost so far + what the rows ahead cost in any case, audit). What they cost in any case is a delete for
    each blank or repeated turn and the charge for each truncated one, which is below the delete that would avoid it; so
    it never falls along a path, and a node is settled when it is first taken.
    """
    n = len(rows)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        fault = rows[i][1]
        ahead[i] = ahead[i + 1] + (DELETE if fault in (BLANK, REPEATED) else min(TRUNCATED, DELETE) if fault == CUT else 0)
    frontier, settled, found = [(ahead[0], "", 0, entry)], set(), {}
    while frontier:
        f, audit, i, state = heappop(frontier)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == n:
            if not ends:
                found[state] = (f, audit)
                continue
            if state in (NONE, ASSISTANT):
                return {state: (f, audit)}
        if i < n or ends:
            heappush(frontier, (f + INSERT, audit + "I", i, made(state)))
        if i == n:
            continue
        initial, fault = rows[i]
        spent = f - ahead[i] + ahead[i + 1]
        heappush(frontier, (spent + DELETE, audit + "D", i + 1, state))
        if fault in (BLANK, REPEATED):
            continue
        spent += TRUNCATED if fault == CUT else 0
        heappush(frontier, (spent + REROLE, audit + "R", i + 1, made(state)))
        if (kept := after(state, initial)) is not None:
            heappush(frontier, (spent, audit + "K", i + 1, kept))
    return found


def crossings(rows: list[tuple[str, int]]) -> tuple[list[int], list[int], list[str]]:
    """Of each entry and exit (entry * 4 + exit): cost, place of the audit among the entry's, audit.

    Inserts at a border belong to what follows, so audits of one entry end with a row each and none begins another; who
    is less at a border stays less whatever follows.
    """
    costs, places, audits = [NEVER] * 16, [0] * 16, [""] * 16
    for entry in range(4):
        found = search(rows, entry, False)
        for place, exit_ in enumerate(sorted(found, key=lambda q: found[q][1])):
            costs[entry * 4 + exit_], audits[entry * 4 + exit_] = found[exit_]
            places[entry * 4 + exit_] = place
    return costs, places, audits


def backward(left: list[int], costs: list[int], places: list[int]) -> tuple[list[int], list[int]]:
    """left: cost from each exit to the end. The exit to take from each entry, and the cost from each entry."""
    choice = [min(range(4), key=lambda q: (costs[e * 4 + q] + left[q], places[e * 4 + q])) for e in range(4)]
    return choice, [costs[e * 4 + q] + left[q] for e, q in enumerate(choice)]


def edited(turns: list[tuple[str, str]], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """Role and text of what the edits make of turns, from a state on."""
    at = 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        role, text = turns[at] if edit != "I" else ("", "")
        if edit == "K":
            state = after(state, role[:1])
        else:
            state = made(state)
            role = "user" if state == USER else "assistant"
        at += edit != "I"
        yield role, text


class Tally:
    """What is counted over a conversation's rows, chunk by chunk."""

    def __init__(self):
        self.low = self.high = self.turn = self.initial = None
        self.distinct = self.blank = self.repeated = self.cut = self.illegal = 0

    def row(self, turn: int | None, initial: str, fault: int) -> None:
        if turn is not None:
            if self.turn != turn:
                self.distinct += 1
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        self.blank += fault == BLANK
        self.repeated += fault == REPEATED
        self.cut += fault == CUT
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial

    def told(self) -> list[int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return [min(gaps, (1 << 63) - 1), self.blank, self.repeated, self.cut, self.illegal]


def fault_of(text: str, seen: bool) -> int:
    body = text.rstrip(WHITE)
    return BLANK if not body else REPEATED if seen else FINE if body[-1] in ENDS else CUT


def repaired(turns: list[tuple[int | None, str, str]]) -> tuple[list[int], int, str, str]:
    """Counts, cost, audit and digest of a whole conversation (turn, role, text in order)."""
    tally, seen, rows = Tally(), set(), []
    for turn, role, text in turns:
        fault = fault_of(text, (role, text) in seen)
        seen.add((role, text))
        rows.append((role[:1], fault))
        tally.row(turn, role[:1], fault)
    if len(rows) <= CHUNK:
        ((cost, audit),) = search(rows, NONE, True).values()
    else:
        parts = [crossings(rows[i : i + CHUNK]) for i in range(0, len(rows), CHUNK)]
        left, choices = [len(TAIL[q]) * INSERT for q in range(4)], []
        for costs, places, _ in reversed(parts):
            choice, left = backward(left, costs, places)
            choices.append(choice)
        cost, audit, state = left[NONE], "", NONE
        for (_, _, audits), choice in zip(parts, reversed(choices)):
            audit, state = audit + audits[state * 4 + choice[state]], choice[state]
        audit += TAIL[state]
    lines = "\n".join(f"{r}:{t}" for r, t in edited([(r, t) for _, r, t in turns], audit, NONE))
    return tally.told(), cost, audit, hashlib.sha256(lines.encode()).hexdigest()


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
RESULT = [("conv_id", pa.int64()), *[(c, pa.int64()) for c in (*COUNTS, "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())]
#: A conversation's result, or (chunk not null) rows of one that may go on in another range.
FIRST_ARROW = pa.schema([*RESULT, ("range", pa.int32()), ("chunk", pa.int32()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
FIRST = ", ".join(["conv_id long", *[f"{c} long" for c in (*COUNTS, "cost")], "audit string, repaired_sha256 string, range int, chunk int, turns array<long>, roles array<string>, texts array<string>"])
#: Bytes of text in an Arrow batch of results or chunks, about.
OUT = 8 << 20


def _out(schema: pa.Schema, rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _flushed(schema: pa.Schema, rows: Iterator[tuple[int, tuple]]) -> Iterator[pa.RecordBatch]:
    """Rows (with their weight in bytes) as batches of about OUT bytes."""
    held, weight = [], 0
    for w, row in rows:
        held.append(row)
        weight += w + 64
        if weight >= OUT:
            yield _out(schema, held)
            held, weight = [], 0
    if held:
        yield _out(schema, held)


def _within_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a range: the conversations between its first and its last are whole and end here."""

    def rows():
        yield from _whole_or_open(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))

    return _flushed(FIRST_ARROW, rows())


def _whole_or_open(rows: Iterator[tuple]) -> Iterator[tuple[int, tuple]]:
    """Results of whole conversations; the first and the last one as chunks, which are numbered over the range."""
    started, first, held, now, number, chunk = False, True, [], None, 0, 0

    def opened(part: list) -> tuple[int, tuple]:
        turns, roles, texts = map(list, zip(*part)) if part else ([], [], [])
        return sum(map(len, texts)), (now, *[None] * 8, number, chunk, turns, roles, texts)

    for conv, number, here, turn, role, text in rows:
        if started and conv != now:
            if first:
                yield opened(held)
                chunk += 1
                first = False
            else:
                counts, cost, audit, digest = repaired(held)
                yield len(audit), (now, *counts, cost, audit, digest, *[None] * 5)
            held = []
        started, now = True, conv
        if here:
            held.append((turn, role, text))
        if first and len(held) == CHUNK:
            yield opened(held)
            chunk += 1
            held = []
    for i in range(0, max(1, len(held)), CHUNK) if started else ():
        yield opened(held[i : i + CHUNK])
        chunk += 1


LIGHT = [("conv_id", pa.int64()), ("range", pa.int32()), ("chunk", pa.int32()), ("costs", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("low", pa.int64()), ("high", pa.int64()), ("initials", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]
CROSSED_ARROW = pa.schema([*LIGHT, ("audits", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
CROSSED = "conv_id long, range int, chunk int, costs array<long>, places array<int>, low long, high long, initials array<string>, counts array<long>, audits array<string>, roles array<string>, texts array<string>"


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (conv_id, range, chunk, turns, roles, texts, repeats) with their crossings and counts."""

    def rows():
        for b in batches:
            for conv, number, chunk, turns, roles, texts, repeats in zip(*(c.to_pylist() for c in b.columns)):
                tally, marked, lattice = Tally(), set(repeats or ()), []
                for i, (turn, role, text) in enumerate(zip(turns, roles, texts)):
                    fault = fault_of(text, i in marked)
                    lattice.append((role[:1], fault))
                    tally.row(turn, role[:1], fault)
                costs, places, audits = crossings(lattice)
                ends = [roles[0][:1], roles[-1][:1]] if roles else []
                counts = [tally.distinct, tally.blank, tally.repeated, tally.cut, tally.illegal]
                yield sum(map(len, texts)) + sum(map(len, audits)), (conv, number, chunk, costs, places, tally.low, tally.high, ends, counts, audits, roles, texts)

    return _flushed(CROSSED_ARROW, rows())


CHOSEN_ARROW = pa.schema([*LIGHT[:3], ("choice", pa.list_(pa.int32())), ("left", pa.int64()), *LIGHT[5:]])
CHOSEN = "conv_id long, range int, chunk int, choice array<int>, left long, low long, high long, initials array<string>, counts array<long>"
TAKEN_ARROW = pa.schema([("range", pa.int32()), ("chunk", pa.int32()), ("entry", pa.int32()), ("exit", pa.int32()), ("summary", pa.list_(pa.int64()))])
TAKEN = "range int, chunk int, entry int, exit int, summary array<long>"


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of conversations, last ones first: the exit from each entry, and what is left to pay from the start."""

    def rows():
        now, left = object(), []
        for b in batches:
            for conv, number, chunk, costs, places, *rest in zip(*(c.to_pylist() for c in b.columns)):
                if conv != now:
                    now, left = conv, [len(TAIL[q]) * INSERT for q in range(4)]
                choice, left = backward(left, costs, places)
                yield 100, (conv, number, chunk, choice, left[NONE], *rest)

    return _flushed(CHOSEN_ARROW, rows())


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of conversations in order: entry and exit of each; after the last one, the conversation's counts and cost."""

    def rows():
        now, held = object(), None
        for b in batches:
            for conv, number, chunk, choice, left, low, high, initials, counts in zip(*(c.to_pylist() for c in b.columns)):
                if conv != now:
                    if held:
                        yield 100, (*held, told(whole, cost))
                    now, state, whole, cost = conv, NONE, [None, None, None, 0, 0, 0, 0, 0], left
                elif held:
                    yield 100, (*held, None)
                if low is not None:
                    whole[3] -= whole[1] == low
                    whole[0], whole[1] = low if whole[0] is None else whole[0], high
                if initials:
                    whole[7] += whole[2] is not None and whole[2] + initials[0] not in LEGAL
                    whole[2] = initials[1]
                whole[3:] = [a + b for a, b in zip(whole[3:], counts)]
                held, state = (number, chunk, state, choice[state]), choice[state]
        if held:
            yield 100, (*held, told(whole, cost))

    def told(whole, cost):
        low, high, _, distinct, *counts = whole
        return [min(0 if low is None else high - low + 1 - distinct, (1 << 63) - 1), *counts, cost]

    return _flushed(TAKEN_ARROW, rows())


RESULT_ARROW = pa.schema(RESULT)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of conversations in order, with the crossing taken: audit and digest of the whole."""

    def rows():
        now, audit, digest, lines = object(), [], None, 0
        for b in batches:
            for conv, entry, exit_, summary, audits, roles, texts in zip(*(c.to_pylist() for c in b.columns)):
                if conv != now:
                    now, audit, digest, lines = conv, [], hashlib.sha256(), 0
                edits = audits[entry * 4 + exit_] + (TAIL[exit_] if summary else "")
                audit.append(edits)
                for role, text in edited(list(zip(roles, texts)), edits, entry):
                    digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                    lines += 1
                if summary:
                    yield sum(map(len, audit)), (conv, *summary, "".join(audit), digest.hexdigest())

    return _flushed(RESULT_ARROW, rows())


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", here: str | None = None, piece: int = PIECE) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    A conversation's rows stand by turn (nulls first), then role and text. A row's first fault counts: blank text, role
    and text seen earlier, last character no end of a sentence. gaps: numbers missing between the lowest and the highest
    turn; illegal: neighbours whose roles' initials aren't su, ua or au. Edits keep a row, give it the role user or
    assistant (3), delete it (4; blank and repeated ones must go) or insert an empty turn (3); a truncated row that stays
    costs 3. audit holds the initials of the cheapest edits after which the roles' initials read (s?(ua)+)?, the
    ASCII-least of several. repaired_sha256 is the digest of the repaired role:text lines.

    A null role or text is one space; an empty role fits nowhere as it is. A null conv_id is a conversation. Rows whose
    column `here` is false only name their conversation; one without other rows has zeros, an empty audit and the digest
    of nothing. Repeated rows are duplicates. Texts of any length are read whole. Columns of other names are left out, so
    they can't clash. An empty table gives an empty one.

    Rows are sorted over ranges of bounded size, so a conversation of any size is dealt over many. What lies whole
    within a range is solved there. Of the others (two a range, or a hot one's) CHUNK rows at a time are crossed from and
    to every state; only costs and the order of audits, a few numbers a chunk, pass in order through one task each;
    repeats among them are found by digest. At last their chunks are read in order once, since a digest is a chain; the
    audit must fit a cell.
    """
    there = F.col(here) if here else F.lit(True)
    base = turns.select(
        F.col(conv).cast("long").alias("conv_id"), F.coalesce(there, F.lit(False)).alias("here"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )
    size = base.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    tasks = max(1 + size // piece, min(turns.sparkSession.sparkContext.defaultParallelism, 1 + size // min(piece, 1 << 20)))
    order = ["conv_id", "turn", "role", "text"]
    # The random number deals equal rows over several ranges.
    ranged = base.withColumn("salt", F.rand(11)).repartitionByRange(tasks, *order, "salt").sortWithinPartitions(*order)
    first = durable(ranged.select("conv_id", F.spark_partition_id().alias("range"), "here", "turn", "role", "text").mapInArrow(_within_ranges, FIRST))
    whole = first.where(F.col("chunk").isNull()).select(*RESULT_ARROW.names)
    open_ = first.where(F.col("chunk").isNotNull()).select("conv_id", "range", "chunk", "turns", "roles", "texts")
    return whole.unionByName(_over_ranges(open_))


def _over_ranges(chunks: DataFrame) -> DataFrame:
    """Results of the conversations that lie in these chunks."""
    place = F.struct("range", "chunk", "at")
    row = chunks.select("conv_id", "range", "chunk", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "x"))
    row = row.select("range", "chunk", "at", F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), F.char_length("x.roles"), "x.roles", "x.texts"), 256).alias("digest"))
    several = row.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeats = row.join(several, "digest").where(place != F.col("first")).groupBy("range", "chunk").agg(F.collect_list("at").alias("repeats"))  # CHUNK at most
    marked = chunks.join(repeats, ["range", "chunk"], "left").select(*chunks.columns, "repeats")
    crossed = durable(marked.mapInArrow(_crossed, CROSSED))
    order = ["conv_id", "range", "chunk"]
    light = crossed.select(*[c for c, _ in LIGHT]).repartition("conv_id")
    chosen = light.sortWithinPartitions("conv_id", F.desc("range"), F.desc("chunk")).mapInArrow(_choose, CHOSEN)
    taken = chosen.sortWithinPartitions(*order).mapInArrow(_take, TAKEN)
    parts = crossed.select(*order, "audits", "roles", "texts").join(taken, ["range", "chunk"]).repartition("conv_id").sortWithinPartitions(*order)
    return parts.select("conv_id", "entry", "exit", "summary", "audits", "roles", "texts").mapInArrow(_join, ", ".join(FIRST.split(", ")[:9]))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, here, turn, role and text of rows that are damaged by a CRC of conv_id and turn: dropped, emptied, without ends of sentences, doubled, or given to the user."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fate = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    text = F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace(shown[3], "[.!?]", "")).otherwise(shown[3])
    times = F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return turns.select("conv_id", (fate != 0).alias("here"), "turn", F.when(fate == 4, F.lit("user")).otherwise(shown[2]).alias("role"), text.alias("text"), times.alias("time")).drop("time")


def op11_dialogue_repair(spark, sf_dir):
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), here="here")


#: The same rows by a recursion over each conversation's rows that keeps the best edits for each state of the pattern.
ORACLE = r"""
with recursive
crc as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
fated as (select *, xor(list_reduce(list_transform(string_split(key, ''), lambda ch: ord(ch)::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) % 20 as fate from raw, crc),
damaged as (
  select conv_id, turn, case when fate = 4 then 'user' else role end as role, case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(case when fate = 3 then [1, 2] else [1] end) as time from fated where fate <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, time) as i from damaged),
faulty as (
  select *, substr(role, 1, 1) as initial, case
    when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b'
    when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 't' else '' end as fault,
    lag(substr(role, 1, 1)) over (partition by conv_id order by i) as before from placed),
inserts(state, k, spent, edits, added, past) as (values
  (0, 0, 0, '', '', 0), (0, 1, 3, 'I', chr(10) || 'user:', 2), (0, 2, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3),
  (1, 0, 0, '', '', 1), (1, 1, 3, 'I', chr(10) || 'user:', 2), (1, 2, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3),
  (2, 0, 0, '', '', 2), (2, 1, 3, 'I', chr(10) || 'assistant:', 3), (2, 2, 6, 'II', chr(10) || 'assistant:' || chr(10) || 'user:', 2),
  (3, 0, 0, '', '', 3), (3, 1, 3, 'I', chr(10) || 'user:', 2), (3, 2, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3)),
best as (
  select conv_id, 0::bigint as i, 0 as state, 0::bigint as cost, '' as audit, '' as lines from (select distinct conv_id from conversations)
  union all
  select conv_id, i, state, cost, audit, lines from (
    select *, row_number() over (partition by conv_id, state order by cost, audit) as place from (
      select b.conv_id, f.i, case o.edit when 'D' then n.past when 'R' then (case when n.past = 2 then 3 else 2 end)
               else (case f.initial when 's' then (case when n.past = 0 then 1 end) when 'u' then (case when n.past <> 2 then 2 end) when 'a' then (case when n.past = 2 then 3 end) end) end as state,
             (b.cost + n.spent + case o.edit when 'D' then 4 else (case when o.edit = 'R' then 3 else 0 end) + (case when f.fault = 't' then 3 else 0 end) end)::bigint as cost,
             b.audit || n.edits || o.edit as audit,
             b.lines || n.added || case o.edit when 'D' then '' when 'R' then chr(10) || (case when n.past = 2 then 'assistant' else 'user' end) || ':' || f.text else chr(10) || f.role || ':' || f.text end as lines
      from best b join faulty f on f.conv_id is not distinct from b.conv_id and f.i = b.i + 1 join inserts n on n.state = b.state, (values ('D'), ('K'), ('R')) o(edit)
      where o.edit = 'D' or f.fault not in ('b', 'd')) where state is not null)
  where place = 1),
ended as (
  select b.conv_id, b.cost + n.spent as cost, b.audit || n.edits as audit, b.lines || n.added as lines,
         row_number() over (partition by b.conv_id order by b.cost + n.spent, b.audit || n.edits) as place
  from best b join inserts n on n.state = b.state and n.past in (0, 3)
  where b.i = (select count(*) from faulty f where f.conv_id is not distinct from b.conv_id)),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'b') as blank, count(*) filter (where fault = 'd') as duplicate,
         count(*) filter (where fault = 't') as truncated, count(*) filter (where before || initial not in ('su', 'ua', 'au')) as illegal from faulty group by conv_id)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
       coalesce(illegal, 0)::bigint as illegal, e.cost::bigint as cost, audit, sha256(substr(lines, 2)) as repaired_sha256
from ended e left join counts c on c.conv_id is not distinct from e.conv_id where place = 1
"""
