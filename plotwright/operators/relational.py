"""Set-based operators: writes by natural key, fairness, chunks, streaks, rolling counts, expectations.

All of them are compositions of joins, aggregates and windows whose order is total, so results don't depend on how rows
are spread. Windows are partitioned by a key throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nth(df: DataFrame, keys: list[str], order: list[Column], name: str = "nth") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in the given order; Catalyst limits groups before the shuffle."""
    return nth(df, keys, order, "__nth").where(F.col("__nth") <= n).drop("__nth")


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key (distinct on)."""
    return last_n(df, keys, order, 1)


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of batch to append: the first of each key, where the target has none. First writer wins."""
    return first_per(batch, keys, order).join(target.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """old with new written over it; of each column the last value that isn't null stays."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in rest])


def requeue(old: DataFrame, new: DataFrame, key: str, retry: tuple[str, ...]) -> DataFrame:
    """Conditional upsert of a queue: unknown keys enter as queued, known ones go back to queued only from a retry state."""
    both = old.select(key, F.col("state").alias("was")).join(new.select(key, F.lit(True).alias("offered")).distinct(), key, "full")
    state = F.when(F.col("was").isNull(), F.lit("queued")).when(F.col("offered") & F.col("was").isin(*retry), F.lit("queued")).otherwise(F.col("was"))
    return both.select(key, state.alias("state"), (F.col("was").isNull()).alias("inserted"))


def keep_actual(entries: DataFrame, key: str, actual: str, seq: str) -> DataFrame:
    """One entry per key: an estimate never replaces an actual one, else the later wins."""
    rest = [c for c in entries.columns if c != key]
    return entries.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(actual).cast("int"), F.col(seq))).alias("e")).select(key, "e.*")


def audit(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Changes between two snapshots: key, operation, both rows as JSON."""
    a = old.select(key, F.to_json(F.struct(*old.columns)).alias("old_row"))
    b = new.select(key, F.to_json(F.struct(*new.columns)).alias("new_row"))
    op = F.when(F.col("old_row").isNull(), "insert").when(F.col("new_row").isNull(), "delete").otherwise("update")
    return a.join(b, key, "full").where(~F.col("old_row").eqNullSafe(F.col("new_row"))).select(key, op.alias("operation"), "old_row", "new_row")


def chunk_assign(df: DataFrame, id: str, keys: list[str], order: list[Column], size: int, most: int, already: int = 0) -> DataFrame:
    """window_no and state: ranks fill windows of `size` behind those `already` there, up to `most` in all; the rest is skipped.

    Only the ranks that count are made (groups are limited before the shuffle), so few keys with many rows each are no
    single tasks; the rest learns by a join on the unique id that it has none.
    """
    first = nth(df, keys, order, "__rank").where(F.col("__rank") <= most - already)
    windows = first.select(id, (F.floor((F.col("__rank") + already - 1) / size) + 1).cast("long").alias("window_no"))
    return df.join(windows, id, "left").withColumn("state", F.when(F.col("window_no").isNotNull(), "queued").otherwise("skipped"))


def round_robin(df: DataFrame, lane: list[str], order: list[Column], name: str = "turn", most: int | None = None) -> DataFrame:
    """turn 1 is each lane's first row, turn 2 its second: ordering by turn interleaves the lanes. most: turns that are needed, so long lanes are cut before the shuffle."""
    turned = nth(df, lane, order, name)
    return turned if most is None else turned.where(F.col(name) <= most)


def trailing(df: DataFrame, keys: list[str], ts: str, seconds: int, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over each key's rows of the last `seconds`, the row's own instant included."""
    w = Window.partitionBy(*keys).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return df.select("*", *[c.over(w).alias(n) for n, c in aggregates.items()])


def trailing_streak(df: DataFrame, keys: list[str], newest_first: list[Column], passed: Column) -> DataFrame:
    """Length of the run of passing rows that ends with the newest, per key."""
    failed = F.sum(F.when(passed, 0).otherwise(1)).over(Window.partitionBy(*keys).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__failed", failed).groupBy(*keys).agg(F.count_if(F.col("__failed") == 0).alias("streak"))


def since_last(df: DataFrame, keys: list[str], ts: str, success: Column, failure: Column) -> DataFrame:
    """Failures after each key's last success (all of them where there was none)."""
    last = F.max(F.when(success, F.col(ts))).over(Window.partitionBy(*keys))
    marked = df.withColumn("__last", last)
    after = failure & (F.col("__last").isNull() | (F.col(ts) > F.col("__last")))
    return marked.groupBy(*keys).agg(F.max("__last").alias("last_success"), F.count_if(after).alias("failures"))


def label_counts(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """A labelled funnel (ord, step, n) from one pass, whatever the number of steps."""
    one = df.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(steps.values())])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(s).alias("step"), F.col(f"c{i}").alias("n")) for i, s in enumerate(steps)])
    return one.select(F.inline(rows))


def suffixes(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def in_domains(df: DataFrame, host: str, domains: DataFrame, domain: str = "domain") -> DataFrame:
    """Rows whose host is one of the domains or under one: an equi semi-join on suffixes instead of a theta join."""
    named = df.withColumn("__suffix", F.explode(suffixes(F.col(host))))
    return named.join(domains.select(F.col(domain).alias("__suffix")).distinct(), "__suffix", "left_semi").drop("__suffix").dropDuplicates()


def illegal_transitions(moves: DataFrame, legal: list[tuple[str, str]], old: str, new: str) -> DataFrame:
    """Moves that the table of legal ones doesn't have."""
    allowed = moves.sparkSession.createDataFrame(legal, f"{old} string, {new} string")
    return moves.where(~F.col(old).eqNullSafe(F.col(new))).join(F.broadcast(allowed), [old, new], "left_anti")


def json_counts(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Per key a JSON object of counts by value, keys sorted."""
    counts = df.groupBy(*keys, value.alias("__v")).agg(F.count("*").alias("__n"))
    pairs = F.array_sort(F.collect_list(F.struct("__v", "__n")))
    return counts.groupBy(*keys).agg(F.to_json(F.map_from_entries(pairs)).alias("counts"))


def merge_hits(hits: DataFrame, key: str, rank: str, backend: str, most: int, by: list[str] | None = None) -> DataFrame:
    """Round-robin merge of ranked backends: rank by rank, the first hit of each key wins, `most` in all (per `by`)."""
    by = by or []
    first = first_per(hits, [*by, key], [F.col(rank), F.col(backend)])
    if not by:
        return first.orderBy(rank, backend, key).limit(most)
    return last_n(first, by, [F.col(rank), F.col(backend), F.col(key)], most)


def leading(hits: DataFrame, key: str, backend: str, order: str, most: int) -> DataFrame:
    """The hits of every backend up to its `most`-th different key: all that a merge of `most` keys can take.

    A later key has `most` keys before it in its own backend, each of which the merge prefers. The cut is found from the
    keys' first hits, counted per task; what stays to be ranked is short unless a backend repeats itself. Hits without a
    backend or a place in its order are left out.
    """
    firsts = hits.groupBy(backend, key).agg(F.min(order).alias("__at"))
    cut = last_n(firsts, [backend], [F.col("__at"), F.col(key)], most).groupBy(backend).agg(F.max("__at").alias("__cut"))
    return hits.join(cut, backend).where(F.col(order) <= F.col("__cut")).drop("__cut")


def expire(df: DataFrame, ts: str, now: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and the count of those past the retention window (a dry run)."""
    old = F.col(ts) < now - F.make_dt_interval(F.lit(days))
    return df.where(~old | F.col(ts).isNull()), df.agg(F.count_if(old).alias("n_old"))


def import_after(batch: DataFrame, rows: str, offset: int, most: int) -> DataFrame:
    """Elements of a stored array from an offset on, at most so many: an import that resumes."""
    return batch.select("*", F.posexplode(F.slice(F.col(rows), offset + 1, most)).alias("__pos", "row")).withColumn("pos", F.col("__pos") + offset).drop("__pos", rows)


def split_contract(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all rules, and the others with the name of the first rule broken (unknown breaks none)."""
    reason = F.lit(None).cast("string")
    for name, rule in reversed(rules.items()):
        reason = F.when(~rule, F.lit(name)).otherwise(reason)
    marked = df.withColumn("broken", reason)
    return marked.where("broken is null").drop("broken"), marked.where("broken is not null")
