"""Joins, aggregates, windows, top-k and keyed writes on the star schema and the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotwright.operators import relational as R
from plotwright.plans.registry import plan
from plotwright.session import table as t


@plan("""select o_orderpriority, count(*) as n_orders, count(*) filter (where o_orderstatus = 'F') as finished,
  count(*) filter (where o_orderstatus = 'O') as open_orders, count(*) filter (where o_totalprice > 200000) as large,
  count(distinct o_custkey) filter (where o_orderstatus = 'F') as customers from orders group by 1""")
def metrics_filter(spark, sf):
    o = t(spark, sf, "orders")
    status = lambda s: F.col("o_orderstatus") == s
    return o.groupBy("o_orderpriority").agg(
        F.count("*").alias("n_orders"), F.count_if(status("F")).alias("finished"), F.count_if(status("O")).alias("open_orders"),
        F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.count_distinct(F.when(status("F"), F.col("o_custkey"))).alias("customers"),
    )


@plan("""with q as (select count(*) as queries, count(*) filter (where o_orderstatus = 'F') as done from orders),
  u as (select count(*) as links, count(distinct l_suppkey) as hosts from lineitem),
  f as (select count(*) as found from part where p_size > 25), x as (select count(*) as errors from events where event_type = 'error')
  select * from q, u, f, x""")
def metrics_materialised(spark, sf):
    q = t(spark, sf, "orders").agg(F.count("*").alias("queries"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    u = t(spark, sf, "lineitem").agg(F.count("*").alias("links"), F.count_distinct("l_suppkey").alias("hosts"))
    f = t(spark, sf, "part").where("p_size > 25").agg(F.count("*").alias("found"))
    x = t(spark, sf, "events").where("event_type = 'error'").agg(F.count("*").alias("errors"))
    return q.crossJoin(u).crossJoin(f).crossJoin(x)  # one row each


@plan("""select c_mktsegment, case when n_regionkey in (0, 1) then 'near' else 'far' end as side, count(distinct c_custkey) as customers,
  count(o_orderkey) as orders, count(distinct o_custkey) filter (where o_orderstatus = 'O') as with_open
  from customer join nation on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey and o_totalprice > 100000 group by 1, 2""")
def source_counts(spark, sf):
    o = t(spark, sf, "orders").where("o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_orderstatus")
    c = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    side = F.when(F.col("n_regionkey").isin(0, 1), "near").otherwise("far").alias("side")
    return c.groupBy("c_mktsegment", side).agg(
        F.count_distinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"),
        F.count_distinct(F.when(F.col("o_orderstatus") == "O", F.col("o_custkey"))).alias("with_open"),
    )


@plan("""select n_name, r_name, count(*) as n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey where o_orderdate >= timestamp '1997-01-01' group by 1, 2""")
def join_chain(spark, sf):
    o = t(spark, sf, "orders").where("o_orderdate >= timestamp '1997-01-01'").select("o_orderkey", "o_custkey")
    j = t(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@plan("""select * from (select 1 as ord, 'links' as step, count(*) as n from lineitem
  union all select 2, 'returned', count(*) from lineitem where l_returnflag = 'R'
  union all select 3, 'finished', count(*) from lineitem where l_linestatus = 'F'
  union all select 4, 'discounted', count(*) from lineitem where l_discount > 0.05
  union all select 5, 'large', count(*) from lineitem where l_quantity >= 40)""")
def funnel_union(spark, sf):
    return R.label_counts(t(spark, sf, "lineitem"), {
        "links": F.lit(True), "returned": F.col("l_returnflag") == "R", "finished": F.col("l_linestatus") == "F",
        "discounted": F.col("l_discount") > 0.05, "large": F.col("l_quantity") >= 40,
    })


@plan("""with h as (select l_suppkey as host, count(*) as queued, count(*) filter (where l_linestatus = 'F') as read,
  count(*) filter (where l_returnflag = 'R') as found from lineitem group by 1)
  select host, queued, read, found, (sum(queued) over ())::bigint as total_queued, round(found::double / queued, 6) as share from h""")
def host_funnel(spark, sf):
    h = t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("host")).agg(
        F.count("*").alias("queued"), F.count_if(F.col("l_linestatus") == "F").alias("read"), F.count_if(F.col("l_returnflag") == "R").alias("found"))
    total = t(spark, sf, "lineitem").agg(F.count("*").alias("total_queued"))
    return h.crossJoin(total).withColumn("share", F.round(F.col("found") / F.col("queued"), 6))


@plan("""select o_orderpriority as stage, o_orderstatus as kind, grouping(o_orderpriority)::int as all_stages, grouping(o_orderstatus)::int as all_kinds,
  round(sum(o_totalprice), 2) as usd, count(*) as n from orders group by rollup (o_orderpriority, o_orderstatus)""")
def cost_rollup(spark, sf):
    return t(spark, sf, "orders").rollup("o_orderpriority", "o_orderstatus").agg(
        F.grouping("o_orderpriority").cast("int").alias("all_stages"), F.grouping("o_orderstatus").cast("int").alias("all_kinds"),
        F.round(F.sum("o_totalprice"), 2).alias("usd"), F.count("*").alias("n"),
    ).withColumnsRenamed({"o_orderpriority": "stage", "o_orderstatus": "kind"})


@plan("""select user_id, '{' || string_agg('"' || event_type || '":' || n, ',' order by event_type) || '}' as counts
  from (select user_id, event_type, count(*) as n from events group by 1, 2) group by 1""")
def reason_map(spark, sf):
    return R.json_counts(t(spark, sf, "events"), ["user_id"], F.col("event_type"))


@plan("""select conv_id, list(text order by turn)[1:10] as first_turns, count(*) as n from conversations where role = 'user' group by 1""")
def first_comments(spark, sf):
    c = t(spark, sf, "conversations").where("role = 'user'")
    few = R.last_n(c, ["conv_id"], [F.col("turn")], 10).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("x")))).alias("l"))
    n = c.groupBy("conv_id").agg(F.count("*").alias("n"))
    return few.join(n, "conv_id").select("conv_id", F.transform("l", lambda x: x["x"]).alias("first_turns"), "n")


@plan("""select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >= timestamp '1998-06-01')""")
def not_delivered(spark, sf):
    recent = t(spark, sf, "orders").where("o_orderdate >= timestamp '1998-06-01'").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf, "customer").join(recent, "c_custkey", "left_anti").select("c_custkey", "c_name")


@plan("""select p_partkey, p_name from part where not exists (select 1 from lineitem where 'part:' || p_partkey = 'part:' || l_partkey and l_quantity >= 45)""")
def not_delivered_by_composed_key(spark, sf):
    key = lambda c: F.concat(F.lit("part:"), F.col(c).cast("string")).alias("delivery_key")
    sent = t(spark, sf, "lineitem").where("l_quantity >= 45").select(key("l_partkey"))
    return t(spark, sf, "part").select("p_partkey", "p_name", key("p_partkey")).join(sent, "delivery_key", "left_anti").drop("delivery_key")


@plan("""select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)
  or exists (select 1 from nation where n_nationkey = c_nationkey and n_regionkey = 2)""")
def either_path(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    rich = c.join(t(spark, sf, "orders").where("o_totalprice > 450000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    near = c.join(t(spark, sf, "nation").where("n_regionkey = 2"), F.col("n_nationkey") == F.col("c_nationkey"), "left_semi")
    return rich.union(near).select("c_custkey").distinct()


@plan("""select user_id, max(ts) filter (where event_type = 'purchase') as last_success,
  count(*) filter (where event_type = 'error' and (ts > l or l is null)) as failures
  from (select *, max(case when event_type = 'purchase' then ts end) over (partition by user_id) as l from events) group by 1""")
def last_success(spark, sf):
    kind = F.col("event_type")
    return R.since_last(t(spark, sf, "events"), ["user_id"], "ts", kind == "purchase", kind == "error")


@plan("""select c_custkey, c_name, coalesce((select count(*) from orders where o_custkey = c_custkey), 0)
  + coalesce((select count(*) from orders where o_custkey = c_custkey and o_orderstatus = 'F'), 0) as n from customer""")
def correlated_counts(spark, sf):
    n = t(spark, sf, "orders").groupBy("o_custkey").agg((F.count("*") + F.count_if(F.col("o_orderstatus") == "F")).alias("k"))
    return t(spark, sf, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", F.coalesce("k", F.lit(0)).alias("n"))


@plan("""select user_id, count(*) as n from (select *, row_number() over (partition by user_id order by event_id desc) as k from events) where k <= 3
  group by 1 having bool_and(event_type in ('error', 'click')) and count(*) = 3""")
def error_streak(spark, sf):
    few = R.last_n(t(spark, sf, "events"), ["user_id"], [F.desc("event_id")], 3)
    g = few.groupBy("user_id").agg(F.count("*").alias("n"), F.bool_and(F.col("event_type").isin("error", "click")).alias("bad"))
    return g.where("bad and n = 3").select("user_id", "n")


@plan("""select event_id, user_id, count(*) over w as day_count, round(sum(value) over w, 4) as day_value from events
  window w as (partition by user_id order by ts range between interval 1 day preceding and current row)""")
def rolling_quota(spark, sf):
    out = R.trailing(t(spark, sf, "events"), ["user_id"], "ts", 86400, {"day_count": F.count("*"), "day_value": F.sum("value")})
    return out.select("event_id", "user_id", "day_count", F.round("day_value", 4).alias("day_value"))


@plan("""select user_id, hour, n, n >= 3 as opens from (select user_id, date_trunc('hour', ts) as hour, count(*) filter (where event_type = 'error') as n
  from events group by 1, 2) where n > 0""")
def breaker_windows(spark, sf):
    g = t(spark, sf, "events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count_if(F.col("event_type") == "error").alias("n"))
    return g.where("n > 0").withColumn("opens", F.col("n") >= 3)


@plan("""select user_id, count(*) filter (where bad = 0) as streak from (select user_id, sum(case when event_type <> 'error' then 0 else 1 end)
  over (partition by user_id order by ts desc, event_id desc rows unbounded preceding) as bad from events) group by 1""")
def pass_streak(spark, sf):
    return R.trailing_streak(t(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], F.col("event_type") != "error")


@plan("""select p_partkey, p_brand, case when k <= 60 then (k - 1) // 7 + 1 end as window_no, case when k <= 60 then 'queued' else 'skipped' end as state
  from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) + 3 as k from part)""")
def chunk_assign(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    return R.chunk_assign(p, "p_partkey", ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 7, 60, 3).drop("p_retailprice")


@plan("""select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as number from orders""")
def running_ordinal(spark, sf):
    return R.nth(t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "number").select("o_custkey", "o_orderkey", F.col("number").cast("long"))


@plan("""select c_custkey, bool_or(o_totalprice > 300000) as investor, count(*) as objects, max(o_orderdate) as last_seen from customer join orders on o_custkey = c_custkey
  group by 1 order by investor desc, objects desc, last_seen desc, c_custkey limit 50""")
def people_rank(spark, sf):
    g = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_totalprice") > 300000).alias("investor"), F.count("*").alias("objects"), F.max("o_orderdate").alias("last_seen"))
    g = g.join(t(spark, sf, "customer").select("c_custkey"), "c_custkey", "left_semi")
    return g.orderBy(F.desc("investor"), F.desc("objects"), F.desc("last_seen"), "c_custkey").limit(50)


@plan("""select s_suppkey, s_name, n_name from supplier left join nation on s_nationkey = n_nationkey and n_regionkey < 3
  order by case n_regionkey when 2 then 0 when 0 then 1 else 2 end, nullif(round(s_acctbal, -3), 0) desc nulls last, s_suppkey limit 40""")
def kind_order(spark, sf):
    n = t(spark, sf, "nation").where("n_regionkey < 3")
    j = t(spark, sf, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    kind = F.when(F.col("n_regionkey") == 2, 0).when(F.col("n_regionkey") == 0, 1).otherwise(2)
    return j.orderBy(kind, F.nullif(F.round("s_acctbal", -3), F.lit(0.0)).desc_nulls_last(), "s_suppkey").limit(40).select("s_suppkey", "s_name", "n_name")


@plan("""select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >= timestamp '1998-07-01') as fresh from customer
  order by fresh desc, c_custkey limit 100""")
def recent_first(spark, sf):
    fresh = t(spark, sf, "orders").where("o_orderdate >= timestamp '1998-07-01'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("f")).distinct()
    return t(spark, sf, "customer").join(fresh, "c_custkey", "left").select("c_custkey", F.coalesce("f", F.lit(False)).alias("fresh")).orderBy(F.desc("fresh"), "c_custkey").limit(100)


@plan("""select user_id, event_type, event_id, ts from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as k
  from events where value >= 5) e where k = 1 and not exists (select 1 from events x where x.value < 1 and x.user_id = e.user_id and x.event_type = e.event_type)""")
def first_writer(spark, sf):
    e = t(spark, sf, "events")
    return R.insert_ignore(e.where("value < 1"), e.where("value >= 5"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "ts")


@plan("""select user_id, arg_max(event_type, event_id) filter (where event_type is not null) as event_type, arg_max(v, event_id) filter (where v is not null) as v,
  max(event_id) as event_id from (select user_id, event_id, event_type, case when value > 20 then value end as v from events) group by 1""")
def last_writer(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_id", "event_type", F.when(F.col("value") > 20, F.col("value")).alias("v"))
    half = F.col("event_id") % 2 == 0
    return R.upsert(e.where(half), e.where(~half), ["user_id"], "event_id")


@plan("""with o as (select user_id, case when max(event_id) % 3 = 0 then 'failed' when max(event_id) % 3 = 1 then 'done' else 'queued' end as state
  from events where event_type <> 'purchase' group by 1), n as (select distinct user_id from events where event_type = 'purchase')
  select coalesce(o.user_id, n.user_id) as user_id, case when o.state is null then 'queued' when n.user_id is not null and o.state = 'failed' then 'queued' else o.state end as state,
  o.state is null as inserted from o full join n on o.user_id = n.user_id""")
def requeue(spark, sf):
    """Purchases ask for their users again; all other events say where the users stood."""
    e = t(spark, sf, "events").select("user_id", "event_id", "event_type")
    last = F.max("event_id") % 3
    state = F.when(last == 0, "failed").when(last == 1, "done").otherwise("queued")
    return R.requeue(e.where("event_type <> 'purchase'").groupBy("user_id").agg(state.alias("state")), e.where("event_type = 'purchase'").select("user_id", "event_id"), "user_id", ("failed",))


@plan("""select l_partkey, arg_max(l_extendedprice, (case when l_linestatus = 'F' then 1 else 0 end) * 1000000000000 + l_orderkey * 10 + l_linenumber) as usd,
  bool_or(l_linestatus = 'F') as actual from lineitem group by 1""")
def keyed_cost(spark, sf):
    e = t(spark, sf, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("usd"), (F.col("l_linestatus") == "F").alias("actual"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return R.keep_actual(e, "l_partkey", "actual", "seq").select("l_partkey", "usd", "actual")


@plan("""select coalesce(a.s_suppkey, b.s_suppkey) as s_suppkey, case when a.s_suppkey is null then 'insert' when b.s_suppkey is null then 'delete' else 'update' end as operation,
  '{"s_suppkey":' || a.s_suppkey || ',"bal":' || a.bal::bigint || '}' as old_row, '{"s_suppkey":' || b.s_suppkey || ',"bal":' || b.bal::bigint || '}' as new_row
  from (select s_suppkey, round(s_acctbal) as bal from supplier where s_suppkey % 7 <> 0) a full join
  (select s_suppkey, case when s_suppkey % 3 = 0 then round(s_acctbal) + 1 else round(s_acctbal) end as bal from supplier where s_suppkey % 5 <> 0) b on a.s_suppkey = b.s_suppkey
  where a.bal is distinct from b.bal""")
def audit_log(spark, sf):
    s = t(spark, sf, "supplier").select("s_suppkey", F.round("s_acctbal").cast("long").alias("bal"))
    new = s.where("s_suppkey % 5 <> 0").withColumn("bal", F.when(F.col("s_suppkey") % 3 == 0, F.col("bal") + 1).otherwise(F.col("bal")))
    return R.audit(s.where("s_suppkey % 7 <> 0"), new, "s_suppkey").select("s_suppkey", "operation", "old_row", "new_row")


@plan("""select count(*) filter (where ts < (select max(ts) from events) - interval 20 day) as n_old from events""")
def retention_dry_run(spark, sf):
    e = t(spark, sf, "events")
    now = e.agg(F.max("ts")).first()[0]
    return R.expire(e, "ts", F.lit(now), 20)[1]


@plan("""select o_orderpriority as role, case when count(*) = count(v) then round(avg(v), 6) end as mean from (select *, nullif(round(o_totalprice, -2), 100) as v from orders) group by 1""")
def role_means(spark, sf):
    v = F.nullif(F.round("o_totalprice", -2), F.lit(100.0))
    return t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("role")).agg(F.when(F.count("*") == F.count(v), F.round(F.avg(v), 6)).alias("mean"))


@plan("""select batch, round(avg(m), 6) as mean from (select date_trunc('year', o_orderdate) as batch, o_orderpriority, avg(o_totalprice) as m from orders group by 1, 2) group by 1""")
def batch_mean(spark, sf):
    roles = t(spark, sf, "orders").groupBy(F.date_trunc("year", "o_orderdate").cast("timestamp_ntz").alias("batch"), "o_orderpriority").agg(F.avg("o_totalprice").alias("m"))
    return roles.groupBy("batch").agg(F.round(F.avg("m"), 6).alias("mean"))


@plan("""select l_suppkey, round(sum(l_extendedprice), 2) as spent from lineitem group by 1 having sum(l_extendedprice) >= 22000000""")
def over_budget(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("s")).where("s >= 22000000").select("l_suppkey", F.round("s", 2).alias("spent"))


@plan("""select round(sum(case when event_type = 'purchase' then value else 0 end), 4) as objects, round(sum(case when event_type = 'signup' then value else 0 end), 4) as investors,
  round(sum(case when event_type not in ('purchase', 'signup') then value else 0 end), 4) as common from events""")
def cost_split(spark, sf):
    part = lambda c, n: F.round(F.sum(F.when(c, F.col("value")).otherwise(0)), 4).alias(n)
    k = F.col("event_type")
    return t(spark, sf, "events").agg(part(k == "purchase", "objects"), part(k == "signup", "investors"), part(~k.isin("purchase", "signup"), "common"))


@plan("""select o_orderstatus as state, o_orderpriority as bucket, case when o_totalprice > 300000 then 'price' when o_totalprice > 100000 then 'area' end as why, count(*) as n from orders group by 1, 2, 3""")
def outcome_counts(spark, sf):
    why = F.when(F.col("o_totalprice") > 300000, "price").when(F.col("o_totalprice") > 100000, "area")
    return t(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("bucket"), why.alias("why")).agg(F.count("*").alias("n"))


@plan("""select sum(case when state = 'F' then n else 0 end)::bigint as sent, sum(case when state = 'O' and why = 'price' then n else 0 end)::bigint as held_price,
  sum(case when state <> 'F' and why is null then n else 0 end)::bigint as unexplained from (select o_orderstatus as state,
  case when o_totalprice > 300000 then 'price' when o_totalprice > 100000 then 'area' end as why, count(*) as n from orders group by 1, 2)""")
def outcome_tally(spark, sf):
    n = lambda c, a: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(a)
    s, w = F.col("state"), F.col("why")
    return outcome_counts(spark, sf).agg(n(s == "F", "sent"), n((s == "O") & (w == "price"), "held_price"), n((s != "F") & w.isNull(), "unexplained"))


@plan("""select event_type as why, count(*) as n, event_type in ('error', 'purchase') as substantial from events group by 1 order by substantial desc, n desc, why""")
def counted_reasons(spark, sf):
    g = t(spark, sf, "events").groupBy(F.col("event_type").alias("why")).agg(F.count("*").alias("n"))
    return g.withColumn("substantial", F.col("why").isin("error", "purchase")).orderBy(F.desc("substantial"), F.desc("n"), "why")


@plan("""select 'orders' as what, o_orderstatus as detail, count(*) as n from orders group by 2 union all select 'events', event_type, count(*) from events group by 2
  union all select 'parts', p_brand, count(*) from part group by 2""")
def lead_union(spark, sf):
    one = lambda name, what, c: t(spark, sf, name).groupBy(F.col(c).alias("detail")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "detail", "n")
    return one("orders", "orders", "o_orderstatus").unionByName(one("events", "events", "event_type")).unionByName(one("part", "parts", "p_brand"))


@plan("""select user_id from events where event_type = 'error' union select user_id from events where value > 45""")
def seen_union(spark, sf):
    e = t(spark, sf, "events")
    return e.where("event_type = 'error'").select("user_id").union(e.where("value > 45").select("user_id")).distinct()


@plan("""select host, k.d as domain from (select distinct split_part(split_part(url, '//', 2), '/', 1) as host from pages) p
  join (values ('example.com'), ('example.org'), ('ththth.example.net')) k(d) on p.host = k.d or p.host like '%.' || k.d""")
def suffix_join(spark, sf):
    hosts = t(spark, sf, "pages").select(F.split(F.split("url", "//")[1], "/")[0].alias("host")).distinct()
    known = spark.createDataFrame([("example.com",), ("example.org",), ("ththth.example.net",)], "domain string")
    return hosts.withColumn("domain", F.explode(R.suffixes(F.col("host")))).join(F.broadcast(known), "domain").select("host", "domain")


@plan("""select k.user_id, k.kind, count(e.event_id) as n from (values (1, 'error'), (2, 'view'), (3, 'click'), (99, 'none')) k(user_id, kind)
  left join events e on e.user_id = k.user_id and e.event_type = k.kind group by 1, 2""")
def unnest_join(spark, sf):
    arrays = spark.createDataFrame([([1, 2, 3, 99], ["error", "view", "click", "none"])], "user_id array<long>, kind array<string>")
    keys = arrays.select(F.inline(F.arrays_zip("user_id", "kind")))
    e = t(spark, sf, "events").select("user_id", F.col("event_type").alias("kind"), "event_id")
    return keys.join(e, ["user_id", "kind"], "left").groupBy(F.col("user_id").cast("int"), "kind").agg(F.count("event_id").alias("n"))


@plan("""select event_id, (props::json->>'k')::int as k from events where (props::json->>'k')::int between 10 and 12""")
def json_predicate(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return t(spark, sf, "events").where(k.between(10, 12)).select("event_id", k.alias("k"))


@plan("""select s_suppkey from supplier where nullif(s_nationkey, 3) is distinct from 5""")
def null_safe_filter(spark, sf):
    return t(spark, sf, "supplier").where(~F.nullif("s_nationkey", F.lit(3)).eqNullSafe(F.lit(5))).select("s_suppkey")


@plan("""select p_partkey from part where p_name ilike '%RED%' and p_brand not in ('Brand#1', 'Brand#2')""")
def ilike_and_list(spark, sf):
    return t(spark, sf, "part").where(F.col("p_name").ilike("%RED%") & ~F.col("p_brand").isin("Brand#1", "Brand#2")).select("p_partkey")


@plan("""with a as (select l_suppkey as k, count(*) as n_lines from lineitem where l_discount > 0.09 group by 1), b as (select s_suppkey as k, 1 as known from supplier where s_acctbal > 0)
  select coalesce(a.k, b.k) as k, coalesce(n_lines, 0) as n_lines, coalesce(known, 0) as known from a full join b on a.k = b.k""")
def merge_of_two_stores(spark, sf):
    a = t(spark, sf, "lineitem").where("l_discount > 0.09").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n_lines"))
    b = t(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), F.lit(1).alias("known"))
    return a.join(b, "k", "full").select("k", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("known", F.lit(0)).alias("known"))


@plan("""select user_id, old, new, count(*) as n from (select user_id, lag(event_type) over (partition by user_id order by ts, event_id) as old, event_type as new from events)
  where old is not null and old <> new and (old, new) not in (('view', 'click'), ('click', 'purchase'), ('signup', 'view'), ('view', 'purchase')) group by 1, 2, 3""")
def transition_guard(spark, sf):
    from pyspark.sql import Window

    old = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    moves = t(spark, sf, "events").select("user_id", old.alias("old"), F.col("event_type").alias("new")).where("old is not null")
    bad = R.illegal_transitions(moves, [("view", "click"), ("click", "purchase"), ("signup", "view"), ("view", "purchase")], "old", "new")
    return bad.groupBy("user_id", "old", "new").agg(F.count("*").alias("n"))


@plan("""select conv_id, count(*) as n, count(*) > 6 as broken from conversations group by 1 having count(*) > 6""")
def capacity_guard(spark, sf):
    return t(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 6").withColumn("broken", F.col("n") > 6)


@plan("""select event_id, turn, user_id from (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as turn from events) order by turn, user_id, event_id limit 200""")
def fair_queue(spark, sf):
    q = R.round_robin(t(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], most=200)
    return q.orderBy("turn", "user_id", "event_id").limit(200).select("event_id", F.col("turn").cast("long"), "user_id")


@plan("""with h as (select user_id as key, event_type as backend, row_number() over (partition by event_type order by event_id) as rank from events),
  f as (select *, row_number() over (partition by key order by rank, backend) as k from h) select key, backend, rank from f where k = 1 order by rank, backend, key limit 60""")
def hit_merge(spark, sf):
    hits = R.leading(t(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("backend"), "event_id"), "key", "backend", "event_id", 60)
    hits = R.nth(hits, ["backend"], [F.col("event_id")], "rank")
    return R.merge_hits(hits, "key", "rank", "backend", 60).select("key", "backend", F.col("rank").cast("long"))


@plan("""select l_partkey as url, round(sum(1.0 / l_linenumber), 6) as score, count(distinct l_suppkey) as engines from lineitem group by 1""")
def metasearch_score(spark, sf):
    g = t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("url")).agg(F.round(F.sum(1.0 / F.col("l_linenumber")), 6).alias("score"), F.count_distinct("l_suppkey").alias("engines"))
    return g.orderBy(F.desc("score"), "url")


@plan("""select o_orderkey, o_orderdate + interval 36 hour as due, (date_diff('second', o_orderdate, timestamp '1999-01-01') / 60.0)::double as minutes from orders""")
def interval_math(spark, sf):
    minutes = (F.unix_timestamp(F.lit("1999-01-01 00:00:00").cast("timestamp")) - F.unix_timestamp("o_orderdate")) / 60.0
    return t(spark, sf, "orders").select("o_orderkey", (F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(36))).alias("due"), minutes.alias("minutes"))


@plan("""select user_id, min(event_id) as first_event, count(*) as n from events group by 1 having count(*) filter (where event_type = 'error') <= 9""")
def only_clean_users(spark, sf):
    g = t(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    return g.where("bad <= 9").drop("bad")


@plan("""select l_orderkey, l_linenumber from lineitem where not regexp_matches(l_returnflag, '^[NR]$') or l_quantity <= 0 or l_discount > 1""")
def contract_violations(spark, sf):
    rules = {"flag": F.col("l_returnflag").rlike("^[NR]$"), "quantity": F.col("l_quantity") > 0, "discount": F.col("l_discount") <= 1}
    return R.split_contract(t(spark, sf, "lineitem"), rules)[1].select("l_orderkey", "l_linenumber")


@plan("""select conv_id, pos, row from (select conv_id, generate_subscripts(l, 1) - 1 as pos, unnest(l) as row from (select conv_id, list(role order by turn) as l from conversations group by 1))
  where pos >= 2 and pos < 5""")
def resumed_import(spark, sf):
    stored = t(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("rows"))
    return R.import_after(stored, "rows", 2, 3).select("conv_id", F.col("pos").cast("long"), "row")


@plan("""select n_name as model, round(sum(l_quantity * case when starts_with(n_name, 'NATION_1') then 2.5 else 1.0 end), 3) as usd
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1""")
def longest_prefix_price(spark, sf):
    """Price by the longest matching prefix of the model's name."""
    prices = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(x).alias("x")) for p, x in (("NATION_1", 2.5), ("", 1.0))])
    best = lambda name: F.aggregate(prices, F.struct(F.lit(-1).alias("n"), F.lit(0.0).alias("x")), lambda a, b: F.when(F.startswith(name, b["p"]) & (F.length(b["p"]) > a["n"]), F.struct(F.length(b["p"]).alias("n"), b["x"].alias("x"))).otherwise(a))["x"]
    n = t(spark, sf, "nation").select("n_nationkey", "n_name", best(F.col("n_name")).alias("price"))
    s = t(spark, sf, "supplier").select("s_suppkey", "s_nationkey").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    j = t(spark, sf, "lineitem").select("l_suppkey", "l_quantity").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(F.col("n_name").alias("model")).agg(F.round(F.sum(F.col("l_quantity") * F.col("price")), 3).alias("usd"))


@plan("""select event_type as item, round(sum(value), 4) as usd from events where user_id % 4 = 0 and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' group by 1""")
def off_campaign(spark, sf):
    """Spend without a campaign (users divisible by four stand for none) in an interval."""
    campaign = F.when(F.col("user_id") % 4 != 0, F.col("user_id"))
    e = t(spark, sf, "events").withColumn("campaign", campaign).where("campaign is null and ts >= timestamp_ntz '2024-01-05' and ts < timestamp_ntz '2024-01-20'")
    return e.groupBy(F.col("event_type").alias("item")).agg(F.round(F.sum("value"), 4).alias("usd"))


@plan("""select p_partkey, len(string_split(p_name || ' ' || p_type, ' ')) as items from part where len(string_split(p_name || ' ' || p_type, ' ')) >= 3""")
def json_array_lengths(spark, sf):
    stored = t(spark, sf, "part").select("p_partkey", F.to_json(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("j"))
    return stored.select("p_partkey", F.json_array_length("j").cast("long").alias("items")).where("items >= 3")


@plan("""select word, count(*) as n from (select unnest(string_split(p_name, ' ')) as word from part) group by 1""")
def json_array_lateral(spark, sf):
    """Stored JSON arrays back to rows."""
    stored = t(spark, sf, "part").select(F.to_json(F.split("p_name", " ")).alias("j"))
    return stored.select(F.explode(F.from_json("j", "array<string>")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@plan("""select l_suppkey as lane, l_orderkey * 10 + l_linenumber as item, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as turn from lineitem""")
def interleaved_lanes(spark, sf):
    """Every item of every lane, by turns."""
    lanes = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("lane"), "l_orderkey", "l_linenumber")
    turned = R.round_robin(lanes, ["lane"], [F.col("l_orderkey"), F.col("l_linenumber")])
    return turned.orderBy("turn", "lane").select("lane", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), F.col("turn").cast("long"))
