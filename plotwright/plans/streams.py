"""Stateful operators in their batch form, and streams run to completion over the events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plotwright.operators.relational import first_per
from plotwright.plans.registry import plan
from plotwright.session import shared_dir
from plotwright.session import table as t
from plotwright.streaming import state as S
from plotwright.streaming.leases import leases


def _stream(spark, sf, name="events"):
    """The table as a stream; a glob names its folder or its only file."""
    return spark.readStream.schema(t(spark, sf, name).schema).parquet(f"{sf}/{name}.parq*")


def _finish(spark, out, mode="append"):
    """The stream's rows after all input, from a durable sink in the checkpoint folder."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = out.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state").option("path", f"{base}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/rows")


@plan("""select user_id::varchar as key, event_id as n, (count(*) filter (where event_type = 'error') over (partition by user_id, g order by event_id))::int as refusals,
  count(*) filter (where event_type = 'error') over (partition by user_id, g order by event_id) >= 3 as blocked from (select *, count(*) filter (where event_type <> 'error') over (partition by user_id order by event_id) as g from events)""")
def refusal_stream(spark, sf):
    """Refusals in a row per host, by a state per key."""
    s = _stream(spark, sf).withColumn("bad", F.col("event_type") == "error")
    return _finish(spark, S.refusal_blocks(s, "user_id", "event_id", "bad", 3)).select("key", "n", "refusals", "blocked")


@plan("""select user_id, event_id, count(*) filter (where event_type = 'error') over (partition by user_id, g order by event_id) as refusals,
  count(*) filter (where event_type = 'error') over (partition by user_id, g order by event_id) >= 2 as blocked from (select *, count(*) filter (where event_type <> 'error') over (partition by user_id order by event_id) as g from events)""")
def host_blocks(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("bad"))
    return S.refusal_runs(e, "user_id", "event_id", "bad", 2).select("user_id", "event_id", "refusals", "blocked")


@plan("""select user_id, event_id from (select *, date_diff('second', lag(date_trunc('second', ts)) over (partition by user_id order by ts), date_trunc('second', ts)) as gap from events) where gap is null or gap > 7200""")
def query_reuse(spark, sf):
    return S.reuse_gap(t(spark, sf, "events"), "user_id", "ts", 7200).select("user_id", "event_id")


@plan("""select min(event_id) as event_id, user_id from events group by user_id""")
def claimed_once(spark, sf):
    """The first event of each user, whatever the batches: insert-ignore by foreachBatch."""
    base = f"{shared_dir(spark)}/claims-{uuid.uuid4().hex}"
    s = _stream(spark, sf).select("user_id", "event_id")
    sink = S.insert_ignore_sink(f"{base}/rows", ["user_id"], [F.col("event_id")])
    s.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/rows").select("event_id", "user_id")


@plan("""with recursive o as materialized (select user_id, floor(epoch(ts))::bigint as t, row_number() over (partition by user_id order by ts) as i from events),
  r as (select user_id, i, t as last, true as fresh from o where i = 1 union all select o.user_id, o.i, case when o.t - r.last > 86400 then o.t else r.last end, o.t - r.last > 86400 from r join o on o.user_id = r.user_id and o.i = r.i + 1)
  select user_id::varchar as key, count(*) as n, count(*) filter (where fresh) as n_fresh from r group by 1""")
def ttl_stream(spark, sf):
    """Events of each key, and how many of them were fresh: none in the day before the last fresh one ended."""
    out = _finish(spark, S.seen_with_ttl(_stream(spark, sf), "user_id", "ts", 86400))
    return out.groupBy("key").agg(F.count("*").alias("n"), F.count_if("fresh").alias("n_fresh"))


@plan("""select user_id, event_type as state from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1""")
def latest_states(spark, sf):
    return S.latest_state(t(spark, sf, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], "event_type").withColumnRenamed("event_type", "state")


@plan("""select user_id from (select user_id, arg_max(event_type, event_id) as state, max(ts) as beat from events group by 1) where state = 'view' and date_diff('second', date_trunc('second', beat), timestamp '2024-01-31') > 86400""")
def stale_reaper(spark, sf):
    b = t(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("k"), F.max("ts").alias("beat"))
    b = b.withColumn("state", F.when(F.col("k") == "view", "running").otherwise("done"))
    return S.stale_batches(b, "beat", F.lit("2024-01-31").cast("timestamp"), 86400).select("user_id")


@plan("""select user_id, event_type, ts from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as k from events) where k = 1""")
def seen_before(spark, sf):
    """First sighting of each (user, type)."""
    return first_per(t(spark, sf, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "ts")


@plan("""with recursive o as materialized (select user_id, event_id, (event_id % 3)::varchar as worker, event_type = 'purchase' as finish, floor(epoch(ts))::bigint as t, row_number() over (partition by user_id order by floor(epoch(ts)), event_id) as i from events),
  r as (select user_id, event_id, worker, t, i, case when finish then 'lost' else 'claimed' end as verdict, case when not finish then worker end as holder, t as since, false as done from o where i = 1
    union all
    select o.user_id, o.event_id, o.worker, o.t, o.i, v.verdict, case when v.verdict in ('finished', 'claimed', 'taken_over', 'again') then o.worker else r.holder end,
      case when v.verdict in ('finished', 'claimed', 'taken_over', 'again') then o.t else r.since end, case when v.verdict = 'finished' then true when v.verdict in ('claimed', 'taken_over', 'again') then false else r.done end
    from r join o on o.user_id = r.user_id and o.i = r.i + 1, lateral (select case
      when o.finish then case when r.holder = o.worker and not r.done then 'finished' else 'lost' end
      when r.holder is null then 'claimed' when r.done then case when o.t - r.since > 259200 then 'again' else 'done' end
      when o.t - r.since > 21600 then 'taken_over' else 'busy' end as verdict) v)
  select user_id::varchar as key, event_id as n, worker, t, verdict from r""")
def leased_claims(spark, sf):
    """Users as keys, three workers that ask for them and finish with a purchase: leases of six hours, results of three days."""
    s = _stream(spark, sf).withColumn("worker", F.col("event_id") % 3).withColumn("finish", F.col("event_type") == "purchase")
    return _finish(spark, leases(s, "user_id", "event_id", "worker", "finish", "ts", 21600, 259200))


@plan("""select event_id, user_id, ts from events where event_type = 'purchase'""")
def finding_stream(spark, sf):
    """Purchases in order of time under the number of their batch; a batch that comes again writes itself over."""
    base = f"{shared_dir(spark)}/findings-{uuid.uuid4().hex}"
    s = _stream(spark, sf).where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    sink = S.ordered_sink(f"{base}/rows", [F.col("ts"), F.col("event_id")])

    def twice(batch, epoch):
        sink(batch, epoch)
        sink(batch, epoch)

    s.writeStream.foreachBatch(twice).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/rows").select("event_id", "user_id", "ts")
