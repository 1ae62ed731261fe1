"""Window queries in their batch form; the tests run the same functions on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlens.plans.registry import registry
from gridlens.session import table
from gridlens.streaming import windows

QUERIES, query = registry()

def _tumbling(seconds: int) -> str:
    return f"""select strftime(to_timestamp(e // {seconds} * {seconds}) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as w_start, strftime(to_timestamp(e // {seconds} * {seconds} + {seconds}) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as w_end, event_type, count(*) as n, round(sum("value"), 4) as total, max("value") as largest
 from (select *, cast(floor(epoch(ts)) as bigint) as e from events) x group by e // {seconds}, event_type"""


def _shown(df):
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("w_start", "w_end")]
    return df.select(*shown, *[c for c in df.columns if c not in ("w_start", "w_end")])


@query(_tumbling(15))
def tumbling_15s(spark, sf):
    return _shown(windows.tumbling(table(spark, sf, "events"), "15 seconds", ["event_type"]))


@query(_tumbling(60))
def tumbling_60s(spark, sf):
    return _shown(windows.tumbling(table(spark, sf, "events"), "60 seconds", ["event_type"]))


@query("""select strftime(to_timestamp(w) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as w_start, strftime(to_timestamp(w + 3600) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as w_end, event_type, count(*) as n, round(sum("value"), 4) as total, max("value") as largest
 from (select *, cast(floor(epoch(ts)) as bigint) // 1200 * 1200 - s.s * 1200 as w from events, (values (0), (1), (2)) s(s)) x group by w, event_type""")
def sliding_windows(spark, sf):
    return _shown(windows.sliding(table(spark, sf, "events"), "1 hour", "20 minutes", ["event_type"]))


@query("""with m as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 1800000000 then 0 else 1 end as fresh from events), g as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from m)
 select user_id, count(*) as n, round(sum("value"), 4) as total, max("value") as largest, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as w_start from g group by user_id, k""")
def session_windows(spark, sf):
    return _shown(windows.sessions(table(spark, sf, "events"), "30 minutes", ["user_id"])).drop("w_end")


@query("""select event_type, count(*) as n, round(avg("value"), 6) as mean, round(max("value"), 6) as largest from events group by event_type""")
def phase_durations(spark, sf):
    return windows.durations(table(spark, sf, "events"), "event_type")


@query("""select strftime(to_timestamp(s) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as w_start, event_type, count(*) as n, round(avg("value"), 6) as mean, round(max("value"), 6) as largest
 from (select *, e // 900 * 900 - k * 900 as s from (select *, cast(floor(epoch(ts)) as bigint) as e from events) x, (values (0), (1), (2), (3)) o(k)) y group by s, event_type""")
def sliding_phase_durations(spark, sf):
    """Durations of each phase over the hour before every quarter of an hour."""
    return _shown(windows.sliding_durations(table(spark, sf, "events"), "1 hour", "15 minutes", "event_type")).drop("w_end")


@query("""select strftime(to_timestamp(e // 3600 * 3600) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as w_start, event_type, count(*) as n, quantile_disc("value", 0.5) as p50, quantile_disc("value", 0.9) as p90, quantile_disc("value", 0.99) as p99
 from (select *, cast(floor(epoch(ts)) as bigint) as e from events) x group by e // 3600, event_type""")
def hourly_percentiles(spark, sf):
    return _shown(windows.spread(table(spark, sf, "events"), "1 hour", ["event_type"])).drop("w_end")


@query("""select event_type, case when "value" <= 1 then 0 when "value" <= 5 then 1 when "value" <= 25 then 2 else 3 end as bucket, count(*) as n, round(sum("value"), 4) as total from events group by 1, 2""")
def value_histogram(spark, sf):
    return windows.histogram(table(spark, sf, "events"), [1.0, 5.0, 25.0], ["event_type"])


@query("""select user_id, cast(sum(case event_type when 'click' then 1 when 'purchase' then -1 else 0 end) as bigint) as "level" from events group by user_id""")
def user_levels(spark, sf):
    return windows.levels(table(spark, sf, "events"), "click", "purchase", ["user_id"])
