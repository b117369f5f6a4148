"""Queries for dates, recurrence and opening hours. Texts with few forms have their expected reading written out in the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from localmarkets.functions import dates as D
from localmarkets.operators import listing as Q
from localmarkets.operators.joins import read_once
from localmarkets.views import HOURS, SCHEDULES, TODAY, WEEK_HOURS, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col
today = lambda: F.lit(TODAY).cast("date")


def query(name: str, sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql)
        return f

    return keep


def names(values: list[str], index: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({index} AS INT)]"


def reading(column: str, texts: list[str | None], values: list[str]) -> str:
    """SQL CASE with the expected value of each text."""
    return f"CASE {column} " + " ".join(f"WHEN '{t}' THEN {v}" for t, v in zip(texts, values, strict=True) if t is not None) + " END"


@query("D1_parse_danish_date", r"""
WITH x AS (SELECT k, CASE CAST(k % 4 AS INT) WHEN 0 THEN lpad(CAST(k % 31 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') || '-2026'
  WHEN 1 THEN CAST(k % 31 + 1 AS VARCHAR) || '/' || CAST(k % 12 + 1 AS VARCHAR) || ' 2026' ELSE NULL END AS text FROM v_key)
SELECT k, CASE WHEN k % 4 IN (0, 1) THEN TRY_CAST('2026-' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(k % 31 + 1 AS VARCHAR), 2, '0') AS DATE)
  WHEN k % 4 = 2 THEN TRY_CAST('2026-' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(k % 31 + 1 AS VARCHAR), 2, '0') AS DATE) END AS date
FROM x""")
def _(spark, d):
    day, month = (c("k") % 31 + 1).cast("string"), (c("k") % 12 + 1).cast("int")
    name = F.element_at(F.array(*[F.lit(m) for m in D.MONTH_NAMES]), month)
    text = (
        F.when(c("k") % 4 == 0, F.concat(F.lpad(day, 2, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-2026")))
        .when(c("k") % 4 == 1, F.concat(day, F.lit("/"), month.cast("string"), F.lit(" 2026")))
        .when(c("k") % 4 == 2, F.concat(F.lit("Lørdag den "), day, F.lit(". "), name, F.lit(" 2026")))
        .otherwise(F.concat(day, F.lit(". brumaire 2026")))
    )
    return view(spark, d, "v_key").select("k", D.parse_danish_date(text).alias("date"))


@query("D3_calendar", "SELECT o_orderkey, isodow(o_orderdate) AS weekday, week(o_orderdate) AS iso_week, CAST(o_orderdate AS DATE) + 9 AS later FROM orders")
def _(spark, d):
    day = F.to_date("o_orderdate")
    return view(spark, d, "orders").select("o_orderkey", D.weekday(day).cast("long").alias("weekday"), F.weekofyear(day).cast("long").alias("iso_week"), F.date_add(day, 9).alias("later"))


_days = ["'7=12:00-17:00'", "'6=10:00-16:00,7=10:00-16:00'", "'6=10:00-16:00,7=10:00-15:00'", "'*=10:00-16:30'", "''", "''", "'1=09:00-12:30,5=09:00-12:30,6=09:00-12:30,7=09:00-12:30'", "''", "''", "'2=08:30-17:00'", "'1=10:00-18:00,2=10:00-18:00,3=10:00-18:00'", "''"]


@query("D4_parse_opening_hours", f"SELECT k, coalesce({reading('hours_text', HOURS, _days)}, '') AS hours FROM v_schedule")
def _(spark, d):
    told = D.parse_opening_hours(c("hours_text"))
    days = F.filter(F.transform(told["days"], lambda w, i: F.concat((i + 1).cast("string"), F.lit("="), w["start"], F.lit("-"), w["end"])), lambda x: x.isNotNull())
    generic = F.concat(F.lit("*="), told["generic"]["start"], F.lit("-"), told["generic"]["end"])
    return view(spark, d, "v_schedule").select("k", F.array_join(F.array_compact(F.concat(days, F.array(generic))), ",").alias("hours"))


_rules = ["'weekly 7'", "'weekly 6 7'", "'weekly 7'", "'nth 1 6'", "'last 7'", "'nth 3 4'", "'nth 2 5'", "'odd-weeks 7'", "'even-weeks 6'", "''", "''", "''", "''", "'odd-weeks 3'", "'weekly 4'"]


@query("D5_parse_recurrence", f"SELECT k, coalesce({reading('schedule_text', SCHEDULES, _rules)}, '') AS rules FROM v_schedule")
def _(spark, d):
    rule = lambda r: F.concat_ws(" ", r["kind"], r["nth"].cast("string"), F.array_join(r["weekdays"].cast("array<string>"), " "))
    return view(spark, d, "v_schedule").select("k", F.array_join(F.transform(D.parse_recurrence(c("schedule_text")), rule), ";").alias("rules"))


_labels = ["'Hver søndag'", "'Hver lørdag og søndag'", "'Hver søndag'", "'Første lørdag i måneden'", "'Sidste søndag i måneden'", "'Tredje torsdag i måneden'", "'Anden fredag i måneden'", "'Søndag i ulige uger'", "'Lørdag i lige uger'", "NULL", "NULL", "NULL", "NULL", "'Onsdag i ulige uger'", "'Hver torsdag'"]


@query("D6_describe_recurrence", f"SELECT k, {reading('schedule_text', SCHEDULES, _labels)} AS label FROM v_schedule")
def _(spark, d):
    return view(spark, d, "v_schedule").select("k", D.describe_recurrence(c("schedule_text")).alias("label"))


_word = "string_split(rule, ' ')"


@query("D7_resolve_schedule", f"""
WITH r AS (SELECT *, coalesce({reading('schedule_text', SCHEDULES, _rules)}, '') AS rule, coalesce({reading('hours_text', HOURS, _days)}, '') AS hours FROM v_schedule),
d AS (SELECT k, range_start AS a, range_end AS z, rule, hours, CAST(unnest(generate_series(DATE '2026-07-03', DATE '2026-12-30', INTERVAL 1 DAY)) AS DATE) AS date FROM r),
p AS (SELECT *, {_word}[1] AS kind, list_contains(list_transform(list_slice({_word}, CASE WHEN {_word}[1] = 'nth' THEN 3 ELSE 2 END, 9), lambda w: TRY_CAST(w AS INT)), isodow(date)) AS on_day FROM d),
f AS (SELECT *, (a IS NOT NULL AND ((z - a <= 6 AND date BETWEEN a AND z) OR (z - a > 6 AND date IN (a, z))))
  OR (rule <> '' AND date BETWEEN coalesce(a, date) AND coalesce(z, date) AND on_day AND CASE kind WHEN 'weekly' THEN true WHEN 'odd-weeks' THEN week(date) % 2 = 1 WHEN 'even-weeks' THEN week(date) % 2 = 0
    WHEN 'nth' THEN CAST((day(date) + 6) / 7 - 0.5 AS INT) IS NOT NULL AND floor((day(date) - 1) / 7) + 1 = CAST({_word}[2] AS INT) ELSE month(date + 7) <> month(date) END) AS held FROM p),
t AS (SELECT k, date, CASE WHEN starts_with(hours, '*=') THEN substr(hours, 3) ELSE nullif(regexp_extract(hours, CAST(isodow(date) AS VARCHAR) || '=([0-9:]+-[0-9:]+)', 1), '') END AS w FROM f WHERE held)
SELECT k, date, string_split(w, '-')[1] AS start_time, string_split(w, '-')[2] AS end_time FROM t""")
def _(spark, d):
    told = ["range_start", "range_end", "schedule_text", "hours_text"]
    days = D.resolve_schedule(*[c(f"__{n}") for n in told], today(), 180)
    return read_once(view(spark, d, "v_schedule"), told, days=days).select("k", F.inline("days"))


@query("D8_nth_weekday", """
SELECT o_orderkey, CASE WHEN month(a + CAST((b - isodow(a) + 7) % 7 AS INT) + (n - 1) * 7) = month(a) THEN a + CAST((b - isodow(a) + 7) % 7 AS INT) + (n - 1) * 7 END AS nth,
  l - CAST((isodow(l) - b + 7) % 7 AS INT) AS last
FROM (SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS a, last_day(CAST(o_orderdate AS DATE)) AS l, CAST(o_orderkey % 7 + 1 AS INT) AS b, CAST(o_orderkey % 5 + 1 AS INT) AS n FROM orders) x""")
def _(spark, d):
    day, wd, n = F.to_date("o_orderdate"), (c("o_orderkey") % 7 + 1).cast("int"), (c("o_orderkey") % 5 + 1).cast("int")
    return view(spark, d, "orders").select("o_orderkey", D.nth_weekday(day, wd, n).alias("nth"), D.last_weekday(day, wd).alias("last"))


@query("D9_season_occurrences", """
SELECT c_custkey, CAST(day AS DATE) AS date FROM (
  SELECT c_custkey, CAST(c_custkey % 7 + 1 AS INT) AS b, unnest(generate_series(make_date(y, 5, 1), make_date(y, 9, 30), INTERVAL 1 DAY)) AS day
  FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 2026 ELSE 2027 END AS y FROM customer) q) x WHERE isodow(day) = b""")
def _(spark, d):
    # Seen on a day of the season or after its end: then it is next year's.
    seen = F.when(c("c_custkey") % 2 == 0, today()).otherwise(F.lit("2026-10-02").cast("date"))
    year = F.year(seen) + (seen > F.make_date(F.year(seen), F.lit(9), F.lit(30))).cast("int")
    first = F.make_date(year, F.lit(5), F.lit(1))
    start = F.date_add(first, F.pmod((c("c_custkey") % 7 + 1).cast("int") - D.weekday(first), F.lit(7)))
    return view(spark, d, "customer").select("c_custkey", F.explode(F.sequence(start, F.make_date(year, F.lit(9), F.lit(30)), F.expr("interval 7 days"))).alias("date"))


@query("D10_first_weekends", """
SELECT c_custkey, CAST(s AS DATE) AS saturday, CAST(s + INTERVAL 1 DAY AS DATE) AS sunday FROM (
  SELECT c_custkey, f + CAST((6 - isodow(f) + 7) % 7 AS INT) AS s FROM (
    SELECT c_custkey, CAST(unnest(generate_series(make_date(2026, CAST(c_custkey % 6 + 1 AS INT), 1), DATE '2026-12-01', INTERVAL 1 MONTH)) AS DATE) AS f FROM customer) y) x""")
def _(spark, d):
    months = F.sequence(F.make_date(F.lit(2026), (c("c_custkey") % 6 + 1).cast("int"), F.lit(1)), F.lit("2026-12-01").cast("date"), F.expr("interval 1 month"))
    day = D.nth_weekday(c("first"), F.lit(6), F.lit(1))
    return view(spark, d, "customer").select("c_custkey", F.explode(months).alias("first")).select("c_custkey", day.alias("saturday"), F.date_add(day, 1).alias("sunday"))


@query("D11_expand_span", """
SELECT k, CAST(unnest(generate_series(start_date, least(start_date + CAST(k % 45 AS INT), start_date + 29), INTERVAL 1 DAY)) AS DATE) AS date FROM v_raw""")
def _(spark, d):
    return view(spark, d, "v_raw").select("k", F.explode(D.expand_span(c("start_date"), F.date_add("start_date", (c("k") % 45).cast("int")))).alias("date"))


@query("D14_periods_to_occurrences", """
WITH p AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS z FROM orders),
d AS (SELECT DISTINCT o_custkey, CAST(unnest(generate_series(a, least(z, a + 29), INTERVAL 1 DAY)) AS DATE) AS date FROM p)
SELECT o_custkey, date FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY date) AS n FROM d WHERE date >= DATE '1997-01-01') x WHERE n <= 60""")
def _(spark, d):
    first = F.to_date("o_orderdate")
    return Q.periods_to_occurrences(view(spark, d, "orders"), "o_custkey", first, F.date_add(first, (c("o_orderkey") % 40).cast("int")), F.lit("1997-01-01").cast("date"))


@query("D15_plausible_dates", """
SELECT k, date FROM (SELECT k, unnest([start_date, start_date + CAST(k % 900 AS INT), start_date - CAST(k % 700 AS INT)]) AS date FROM v_raw) x
WHERE date BETWEEN DATE '2026-07-03' - 366 AND DATE '2026-07-03' + 730""")
def _(spark, d):
    n = c("k").cast("int")
    days = F.array("start_date", F.date_add("start_date", n % 900), F.date_sub("start_date", n % 700))
    return view(spark, d, "v_raw").select("k", F.explode(D.plausible_dates(days, today())).alias("date"))


@query("D17_local_now", """
SELECT event_id, CAST(l AS DATE) AS date, strftime(l, '%H:%M') AS time FROM (
  SELECT event_id, ts + CASE WHEN ts >= TIMESTAMP '2024-03-31 01:00:00' AND ts < TIMESTAMP '2024-10-27 01:00:00' THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END AS l FROM events) x""")
def _(spark, d):
    return view(spark, d, "events").select("event_id", D.local_now(c("ts"))["date"].alias("date"), D.local_now(c("ts"))["time"].alias("time"))


_sat = "CASE WHEN isodow(d) = 7 THEN d - 1 ELSE d + CAST(6 - isodow(d) AS INT) END"


@query("D18_weekend", f"SELECT o_orderkey, {_sat} AS saturday, {_sat} + 1 AS sunday, greatest(d, {_sat}) AS first FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) x")
def _(spark, d):
    day = F.to_date("o_orderdate")
    return view(spark, d, "orders").select("o_orderkey", D.weekend(day)["saturday"].alias("saturday"), D.weekend(day)["sunday"].alias("sunday"), D.occurrence_window("weekend", day)["first"].alias("first"))


@query("D19_first_date_in_window", "SELECT event_id, min(date) AS first FROM v_occ WHERE date BETWEEN DATE '2026-07-03' AND DATE '2026-08-02' GROUP BY event_id")
def _(spark, d):
    return Q.first_date_in_window(view(spark, d, "v_occ"), today(), F.date_add(today(), 30))


@query("D20_is_open_at", """
SELECT event_id, bool_or(coalesce(date = DATE '2026-07-04' AND end_time >= start_time AND start_time <= '10:30' AND '10:30' <= end_time, false)) AS open FROM v_occ GROUP BY event_id""")
def _(spark, d):
    at = D.is_open_at(c("date"), c("start_time"), c("end_time"), F.lit("2026-07-04").cast("date"), F.lit("10:30"))
    return view(spark, d, "v_occ").groupBy("event_id").agg(F.bool_or(at).alias("open"))


_week = [
    "'0:600-1050 1:600-1050 2:600-1050 3:600-1050 4:600-1050'", "'0:600-840 2:600-840 4:600-840'", "'0:600-720 0:780-1020'", "'0:0-1440 1:0-1440 2:0-1440 3:0-1440 4:0-1440 5:0-1440 6:0-1440'",
    "'0:540-1080 1:540-1080 2:540-1080 3:540-1080 4:540-1080 5:540-1080'", "'0:720-1440 4:720-1440 5:720-1440 6:720-1440'", "NULL", "'0:480-1200 1:480-1200 2:600-720 3:480-1200 4:480-1200 5:480-1200 6:480-1200'",
    "NULL", "''", "NULL", "NULL", "'5:660-780'", "NULL", "'0:600-960 1:600-960 2:600-960 3:600-960 4:600-960 5:600-960 6:600-960'",
]
_hours = [*WEEK_HOURS, "Mo-Fr 10:00-17:00"]
_week.append("'0:600-1020 1:600-1020 2:600-1020 3:600-1020 4:600-1020'")


def weeks(spark, d, read=lambda week: week):
    """Shops with their ``week``, as ``read`` tells it."""
    week = D.let(D.parse_week_hours(c("__text")), read)
    return read_once(view(spark, d, "v_venues"), "opening_hours_text", week=week)


@query("D21_parse_week_hours", f"SELECT source_type, source_id, {reading('opening_hours_text', _hours, _week)} AS week FROM v_venues")
def _(spark, d):
    flat = F.flatten(F.transform(c("week"), lambda rs, i: F.transform(rs, lambda r: F.format_string("%d:%d-%d", i, r["start"], r["end"]))))
    return weeks(spark, d).select("source_type", "source_id", F.array_join(flat, " ").alias("week"))


@query("D22_open_state", f"""
WITH w AS (SELECT source_type, source_id, {reading('opening_hours_text', _hours, _week)} AS week, CAST(source_id % 7 AS INT) AS d, CAST(source_id % 1440 AS INT) AS m FROM v_venues),
r AS (SELECT *, unnest(CASE WHEN week IS NULL OR week = '' THEN [NULL] ELSE string_split(week, ' ') END) AS x FROM w),
p AS (SELECT source_type, source_id, week, d, m, CAST(string_split(x, ':')[1] AS INT) AS rd, CAST(string_split(string_split(x, ':')[2], '-')[1] AS INT) AS s, CAST(string_split(string_split(x, ':')[2], '-')[2] AS INT) AS e FROM r),
q AS (SELECT source_type, source_id, week IS NOT NULL AS known, min(CASE WHEN rd = d AND m >= s AND m < e THEN e END) AS closes,
  min(CASE WHEN (rd - d + 7) % 7 > 0 OR s > m THEN ((rd - d + 7) % 7) * 10000 + s END) AS later FROM p GROUP BY source_type, source_id, week)
SELECT source_type, source_id, known, closes IS NOT NULL AS open, lpad(CAST(closes // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(closes % 60 AS VARCHAR), 2, '0') AS closes_at,
  CASE WHEN closes IS NULL THEN lpad(CAST((later % 10000) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((later % 10000) % 60 AS VARCHAR), 2, '0') END AS opens_at,
  CASE WHEN closes IS NULL THEN later // 10000 END AS opens_in_days FROM q""")
def _(spark, d):
    state = D.open_state(c("week"), (c("source_id") % 7).cast("int"), (c("source_id") % 1440).cast("int"))
    return weeks(spark, d).select("source_type", "source_id", state.alias("s")).select("source_type", "source_id", "s.*")


_compact = [
    "'Mo-Fr 10:00-17:30'", "'Mo 10:00-14:00; We 10:00-14:00; Fr 10:00-14:00'", "'Mo 10:00-12:00,13:00-17:00'", "'Mo-Su 00:00-24:00'", "'Mo-Sa 09:00-18:00'", "'Mo 12:00-24:00; Fr-Su 12:00-24:00'", "NULL",
    "'Mo-Tu 08:00-20:00; We 10:00-12:00; Th-Su 08:00-20:00'", "NULL", "NULL", "NULL", "NULL", "'Sa 11:00-13:00'", "NULL", "'Mo-Su 10:00-16:00'", "'Mo-Fr 10:00-17:00'",
]


@query("D23_to_week_string", f"SELECT source_type, source_id, {reading('opening_hours_text', _hours, _compact)} AS hours FROM v_venues")
def _(spark, d):
    return weeks(spark, d, D.to_week_string).select("source_type", "source_id", c("week").alias("hours"))


_diff = "(date - DATE '2026-07-03')"


@query("D24_timing_label", f"""
SELECT event_id, date, start_time, CASE WHEN {_diff} <= 0 THEN 'i dag' WHEN {_diff} = 1 THEN 'i morgen' WHEN {_diff} <= 6 THEN 'på ' || {names(D.DAY_NAMES, 'isodow(date)')}
  ELSE 'd. ' || day(date) || '. ' || {names(D.MONTH_NAMES, 'month(date)')} END AS label,
  CASE start_time WHEN '10:00' THEN 'kl. 10–16' WHEN '09:30' THEN 'kl. 9.30–14' END AS hours FROM v_occ""")
def _(spark, d):
    return view(spark, d, "v_occ").select("event_id", "date", "start_time", D.timing_label(today(), c("date")).alias("label"), D.format_hours(c("start_time"), c("end_time")).alias("hours"))


@query("D25_date_labels", f"""
SELECT o_orderkey, substr({names(D.DAY_NAMES, 'isodow(d)')}, 1, 3) AS weekday_short, {names(D.DAY_NAMES, 'isodow(d)')} AS weekday_long, substr({names(D.MONTH_NAMES, 'month(d)')}, 1, 3) AS month_short,
  {names(D.DAY_NAMES, 'isodow(d)')} || ' ' || day(d) || '. ' || {names(D.MONTH_NAMES, 'month(d)')} AS long, day(d) || '. ' || {names(D.MONTH_NAMES, 'month(d)')} || ' ' || year(d) AS updated
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) x""")
def _(spark, d):
    return view(spark, d, "orders").select("o_orderkey", D.date_labels(F.to_date("o_orderdate")).alias("l")).select("o_orderkey", "l.*")


@query("D12_summary_range", f"""
WITH x AS (SELECT o_orderkey AS k, DATE '2026-07-06' + CAST(o_orderkey % 40 AS INT) AS a, DATE '2026-07-06' + CAST(o_orderkey % 40 + o_orderkey % 13 AS INT) AS z FROM orders),
d AS (SELECT k, a, z, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date FROM x)
SELECT k, date FROM d WHERE z - a <= 6 OR date IN (a, z) OR isodow(date) = 7""")
def _(spark, d):
    k = c("o_orderkey")
    a, n = F.date_add(F.lit("2026-07-06").cast("date"), (k % 40).cast("int")), (k % 13).cast("int")
    label = lambda x: F.concat(F.dayofmonth(x).cast("string"), F.lit(". "), F.element_at(F.array(*[F.lit(m) for m in D.MONTH_NAMES]), F.month(x)))
    rows = view(spark, d, "orders").select(k.alias("k"), F.concat(label(a), F.lit(" – "), label(F.date_add(a, n)), F.lit(" 2026")).alias("text")).withColumn("r", D.parse_summary_range(c("text")))
    days = D.resolve_schedule(c("r.start"), c("r.end"), F.lit("hver søndag"), F.lit(None).cast("string"), F.lit("2026-07-03").cast("date"), 180)
    return rows.select("k", F.explode(F.transform(days, lambda o: o["date"])).alias("date"))


@query("D13_week_windows", """
SELECT c_custkey AS k, CAST(unnest(generate_series(DATE '2026-07-06', DATE '2026-07-06' + CAST(c_custkey % 7 AS INT), INTERVAL 1 DAY)) AS DATE) AS date FROM customer""")
def _(spark, d):
    text = F.concat(F.lit("Marked uge 28 den 6.-"), (c("c_custkey") % 7 + 6).cast("string"), F.lit(". juli, uge 30 den 1.–20. juli"))
    return view(spark, d, "customer").select(c("c_custkey").alias("k"), F.explode(D.parse_week_windows(text, F.lit(2026))).alias("date"))


@query("T30_stable_id", "SELECT count(DISTINCT c_name) AS names, count(DISTINCT c_name) AS ids FROM customer")
def _(spark, d):
    from localmarkets.functions.text import stable_id

    return view(spark, d, "customer").agg(F.count_distinct("c_name").alias("names"), F.count_distinct(stable_id(c("c_name"))).alias("ids"))
