"""Claims with a lease: who may work on a key, until when, and who takes over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What an event gets. An ask: claimed, taken_over (from a holder whose lease ran out), again (a result grew old), busy, done. A finish: finished, or lost if another one holds the key.
GRANTS = ("claimed", "taken_over", "again")
STATE = "holder string, since long, done boolean"
OUT = "key string, n long, worker string, t long, verdict string"


def answer(held: tuple | None, worker: str, finish: bool, t: int, lease: int, ttl: int | None) -> tuple[str, tuple | None]:
    """What an event gets and the state after it; held: holder, since when, and whether it is done."""
    if finish:
        mine = held is not None and not held[2] and held[0] == worker
        return ("finished", (worker, t, True)) if mine else ("lost", held)
    if held is None:
        return "claimed", (worker, t, False)
    _, since, done = held
    if done:
        return ("again", (worker, t, False)) if ttl is not None and t - since > ttl else ("done", held)
    return ("taken_over", (worker, t, False)) if t - since > lease else ("busy", held)


def leases(stream: DataFrame, key: str, order: str, worker: str, finish: str, ts: str, lease: int, ttl: int | None = None, clock: bool = False) -> DataFrame:
    """key, n, worker, t and verdict of every event; lease and ttl in seconds.

    A worker asks for a key and holds it for `lease` seconds; if it finishes in time, or late but before anybody took
    over, the key is done, and may be asked for again after `ttl` seconds (null: never). One that never finishes is
    lost: the next to ask after the lease takes over, once. Times are those of the events, so a stream that is read
    again gives the same; an event before the one that it follows counts as of the same time. With `clock`,
    for streams that go on (a trigger that ends with its input would wait for timers for ever), a row "expired" tells
    that a lease or a result's time has passed on the clock too (its n is null), and a result that grew old leaves the state.

    A key's events of one micro-batch are held together, so the trigger's limits bound them. Null keys are a key.
    """

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        if state.hasTimedOut:
            holder, since, done = held
            if done:
                state.remove()
            else:
                state.update(held)  # the claim stays with its holder until another one asks
            yield pd.DataFrame([(k[0], None, holder, since + (ttl if done else lease), "expired")], columns=["key", "n", "worker", "t", "verdict"])
            return
        out, before = [], held
        for t, n, who, end in sorted(row for f in frames for row in zip(f["t"], f["n"], f["worker"], f["finish"])):
            verdict, held = answer(held, who, bool(end), int(t), lease, ttl)
            out.append((k[0], n, who, t, verdict))
        if held is not None:
            state.update(held)
            if held != before:
                wait = ttl if held[2] else lease
                if clock and wait is not None:
                    state.setTimeoutDuration(max(1, wait) * 1000)
        yield pd.DataFrame(out, columns=["key", "n", "worker", "t", "verdict"])

    slim = stream.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("n"), F.coalesce(F.col(worker).cast("string"), F.lit("")).alias("worker"), F.coalesce(F.col(finish), F.lit(False)).alias("finish"), F.unix_timestamp(F.col(ts).cast("timestamp")).alias("t")).where("t is not null")
    return slim.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if clock else GroupStateTimeout.NoTimeout)
