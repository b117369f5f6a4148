"""Dates, recurrence and opening hours as Column expressions. Days come in as arguments; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from localmarkets.functions.text import W0, W1, let

# Danish names.
MONTH_NAMES = ["januar", "februar", "marts", "april", "maj", "juni", "juli", "august", "september", "oktober", "november", "december"]
DAY_NAMES = ["mandag", "tirsdag", "onsdag", "torsdag", "fredag", "lørdag", "søndag"]
ORDINALS = ["Første", "Anden", "Tredje", "Fjerde"]
DAYS = "mandag|tirsdag|onsdag|torsdag|fredag|lørdag|loerdag|søndag|soendag"


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int")), "yyyy-MM-dd")


def _month(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTH_NAMES]), name), F.lit(0))


def parse_danish_date(c: Column) -> Column:
    """First numeric date with a year, or else "d. month yyyy"; null for days that no calendar has."""
    low = F.lower(F.trim(c))
    numeric, named = r"(\d{1,2})[-./](\d{1,2})[-./ ](\d{4})", r"(\d{1,2})\.?\s+([a-zæøå]+)\s+(\d{4})"
    part = lambda p, i: F.regexp_extract(low, p, i)
    return F.when(low.rlike(numeric), _date(part(numeric, 3), part(numeric, 2), part(numeric, 1))).when(low.rlike(named), _date(part(named, 3), _month(part(named, 2)), part(named, 1)))


def weekday(d: Column) -> Column:
    """1 Monday to 7 Sunday."""
    return F.weekday(d) + 1


def scan_dates(c: Column, ref: Column) -> Column:
    """Distinct dates in a text, in order. A date without a year is this year's if not past, next year's if more than 45 days past, else left out; a dotted one needs "d." or "den"."""
    low, months = F.lower(c), "|".join(MONTH_NAMES)
    every = lambda p: F.regexp_extract_all(low, F.lit(p), F.lit(1))
    full = F.transform(every(rf"(\d{{1,2}}[./-]\d{{1,2}}[./ -]\d{{4}}|\d{{1,2}}\.?\s+(?:{months})\s+\d{{4}})"), parse_danish_date)
    number = lambda m, p: F.regexp_extract(m, p, 1)
    named = F.transform(every(rf"(\d{{1,2}}\.?\s+(?:{months}))(?!\s+\d{{4}})"), lambda m: F.struct(number(m, r"^(\d+)").alias("d"), _month(number(m, rf"({months})")).cast("string").alias("m")))
    slashed, dotted = every(r"(?<![\d./-])(\d{1,2}/\d{1,2})(?![\d./-])"), every(rf"{W0}(?:den|d\.)\s*(\d{{1,2}}\.\d{{1,2}})(?![.\d/])")
    split = F.transform(F.concat(slashed, dotted), lambda m: F.struct(number(m, r"^(\d+)").alias("d"), number(m, r"(\d+)$").alias("m")))

    def resolve(p: Column) -> Column:
        own = _date(F.year(ref), p["m"], p["d"])
        return F.when(own >= ref, own).when(F.datediff(ref, own) > 45, _date(F.year(ref) + 1, p["m"], p["d"]))

    return F.array_sort(F.array_distinct(F.array_compact(F.concat(full, F.transform(F.concat(named, split), resolve)))))


def nth_weekday(d: Column, day: Column, n: Column) -> Column:
    """The n-th such weekday of the month of ``d``; null if the month has none."""
    first = F.trunc(d, "month")
    found = F.date_add(first, F.pmod(day - weekday(first), F.lit(7)) + (n - 1) * 7)
    return F.when(F.month(found) == F.month(d), found)


def last_weekday(d: Column, day: Column) -> Column:
    last = F.last_day(d)
    return F.date_sub(last, F.pmod(weekday(last) - day, F.lit(7)))


# --- recurrence ---


def day_number(name: Column) -> Column:
    return F.greatest(F.array_position(F.array(*[F.lit(n[:2]) for n in DAY_NAMES]), F.substring(F.replace(name, F.lit("oe"), F.lit("ø")), 1, 2)), F.lit(0)).cast("int")


def parse_recurrence(c: Column) -> Column:
    """array of struct(kind, nth, weekdays): weekly, nth, last, odd-weeks or even-weeks; empty where the text says nothing certain."""
    low = F.lower(F.trim(c))
    parity = rf"({DAYS})e?\s+i\s+(?:alle\s+)?(ulige|lige)\s+uger"
    monthly = rf"(første|anden|tredje|fjerde|[1-4]\.|sidste)\s+({DAYS})\s+i\s+(?:hver\s+)?måned"
    weekly = rf"(?:hver|alle)\s+({DAYS})e?(?:\s+og\s+({DAYS})e?)?"
    part = lambda p, i: F.regexp_extract(low, p, i)
    none = F.lit(None).cast("int")
    rule = lambda kind, nth, days: F.array(F.struct(kind.alias("kind"), nth.alias("nth"), days.alias("weekdays")))
    word = part(monthly, 1)
    nth = F.greatest(F.array_position(F.array(*[F.lit(o.lower()) for o in ORDINALS]), word), F.array_position(F.array(*[F.lit(f"{i}.") for i in range(1, 5)]), word)).cast("int")
    found = (
        F.when(low.rlike(parity), rule(F.when(part(parity, 2) == "ulige", "odd-weeks").otherwise("even-weeks"), none, F.array(day_number(part(parity, 1)))))
        .when(low.rlike(monthly), rule(F.when(word == "sidste", "last").otherwise("nth"), F.when(word != "sidste", nth), F.array(day_number(part(monthly, 2)))))
        .when(low.rlike(rf"hver\s+anden\s+({DAYS})"), None)
        .when(low.rlike(weekly), rule(F.lit("weekly"), none, F.filter(F.array(day_number(part(weekly, 1)), day_number(part(weekly, 2))), lambda d: d > 0)))
    )
    return F.coalesce(found, F.array().cast("array<struct<kind:string,nth:int,weekdays:array<int>>>"))


def describe_recurrence(c: Column) -> Column:
    def label(r: Column) -> Column:
        names = F.transform(r["weekdays"], lambda d: F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), d))
        days = F.array_join(names, " og ")
        first = F.concat(F.upper(F.substring(days, 1, 1)), F.substr(days, F.lit(2)))
        ordinal = F.try_element_at(F.array(*[F.lit(o) for o in ORDINALS]), r["nth"])
        return (
            F.when(r["kind"] == "weekly", F.concat(F.lit("Hver "), days))
            .when(r["kind"] == "odd-weeks", F.concat(first, F.lit(" i ulige uger")))
            .when(r["kind"] == "even-weeks", F.concat(first, F.lit(" i lige uger")))
            .when(r["kind"] == "last", F.concat(F.lit("Sidste "), days, F.lit(" i måneden")))
            .otherwise(F.concat(ordinal, F.lit(" "), days, F.lit(" i måneden")))
        )

    return F.nullif(F.array_join(F.transform(parse_recurrence(c), label), " · "), F.lit(""))


def on_rule(d: Column, r: Column) -> Column:
    """Whether a day follows a rule."""
    week = F.weekofyear(d) % 2
    kind = (
        F.when(r["kind"] == "weekly", True)
        .when(r["kind"] == "odd-weeks", week == 1)
        .when(r["kind"] == "even-weeks", week == 0)
        .when(r["kind"] == "nth", F.ceil(F.dayofmonth(d) / 7) == r["nth"])
        .when(r["kind"] == "last", F.month(F.date_add(d, 7)) != F.month(d))
    )
    return F.array_contains(r["weekdays"], weekday(d).cast("int")) & kind


# --- opening hours of texts ---

HOUR_RANGE = r"(?:kl\.?\s*)?(\d{1,2})(?:[.:](\d{2}))?\s*[-–]\s*(?>(\d{1,2})(?:[.:](\d{2}))?)"
CLAUSE = rf"({DAYS})(?:\s*[-–]\s*({DAYS}))?\s*:?\s*{HOUR_RANGE}"
WINDOW = "struct<start:string,end:string>"


def _clock(hour: Column, minute: Column) -> Column:
    return F.concat(F.lpad(hour, 2, "0"), F.lit(":"), F.lpad(F.when(minute == "", "00").otherwise(minute), 2, "0"))


def _window(piece: Column, pattern: str, at: int) -> Column:
    part = lambda i: F.regexp_extract(piece, pattern, at + i)
    return F.struct(_clock(part(0), part(1)).alias("start"), _clock(part(2), part(3)).alias("end"))


def parse_opening_hours(c: Column) -> Column:
    """struct(days: array of 7 windows or nulls, Monday first; generic: window or null)."""
    low = F.lower(F.trim(c))
    months = "|".join(MONTH_NAMES)
    pieces = F.regexp_extract_all(low, F.lit(rf"({CLAUSE})(?!\s*\.?\s*(?:{months}))"), F.lit(1))
    clauses = F.transform(pieces, lambda p: F.struct(
        day_number(F.regexp_extract(p, CLAUSE, 1)).alias("a"), day_number(F.regexp_extract(p, CLAUSE, 2)).alias("z"), _window(p, CLAUSE, 3).alias("w"),
        F.regexp_extract(p, CLAUSE, 3).try_cast("int").alias("h"), F.regexp_extract(p, CLAUSE, 5).try_cast("int").alias("e")))
    clauses = F.filter(clauses, lambda p: (p["h"] <= 23) & (p["e"] <= 24))

    def covers(p: Column, d: Column) -> Column:
        z = F.when(p["z"] == 0, p["a"]).otherwise(p["z"])
        return F.when(p["a"] <= z, d.between(p["a"], z)).otherwise((d >= p["a"]) | (d <= z))

    days = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda d: F.try_element_at(F.filter(clauses, lambda p: covers(p, d)), F.lit(-1))["w"])
    start, end = F.regexp_extract(low, HOUR_RANGE, 1).try_cast("int"), F.regexp_extract(low, HOUR_RANGE, 3).try_cast("int")
    generic = F.when((F.size(clauses) == 0) & low.rlike(HOUR_RANGE) & (start <= 23) & (end <= 24) & (end > start), _window(low, HOUR_RANGE, 1))
    empty = F.array_repeat(F.lit(None).cast(WINDOW), 7)
    return F.struct(F.coalesce(days, empty).alias("days"), generic.alias("generic"))


def times_for(hours: Column, d: Column) -> Column:
    return F.coalesce(F.element_at(hours["days"], weekday(d).cast("int")), hours["generic"])


def resolve_schedule(start: Column, end: Column, schedule: Column, hours: Column, first: Column, horizon: int) -> Column:
    """array of struct(date, start_time, end_time): the published days and those that the rules imply, within the horizon.

    A range of up to 6 days is filled, a wider one keeps its ends; rules fill days inside the range, or the horizon without one.
    """
    last = F.date_add(first, horizon)
    inside = lambda d: d.between(first, last)
    short = F.datediff(end, start) <= 6
    ranged = F.when(start.isNull(), F.array().cast("array<date>")).when(short & (end >= start), F.sequence(start, end)).otherwise(F.when(short, F.array().cast("array<date>")).otherwise(F.array(start, end)))
    low, high = F.greatest(F.coalesce(start, first), first), F.least(F.coalesce(end, last), last)
    both = F.struct(parse_recurrence(schedule).alias("rules"), parse_opening_hours(F.coalesce(hours, F.lit(""))).alias("hours"))

    def resolved(x: Column) -> Column:
        days = F.when((F.size(x["rules"]) > 0) & (low <= high), F.filter(F.sequence(low, high), lambda d: F.exists(x["rules"], lambda r: on_rule(d, r)))).otherwise(F.array().cast("array<date>"))
        every = F.array_sort(F.array_union(F.filter(ranged, inside), days))
        return F.transform(every, lambda d: F.struct(d.alias("date"), times_for(x["hours"], d)["start"].alias("start_time"), times_for(x["hours"], d)["end"].alias("end_time")))

    return let(both, resolved)


# --- opening hours of map data ---

WEEK = ["mo", "tu", "we", "th", "fr", "sa", "su"]
RANGES = "array<struct<start:int,end:int>>"


def parse_week_hours(c: Column) -> Column:
    """Array of 7 lists of (start, end) minutes, Monday first; null if nothing in it is understood. Rules with holidays, months or weeks are skipped; a later rule replaces a day."""
    names = F.array(*[F.lit(n) for n in WEEK])
    rules = F.filter(F.transform(F.split(F.lower(c), ";"), lambda r: F.trim(r)), lambda r: (r != "") & ~r.rlike(rf"{W0}(ph|sh|week|easter|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec){W1}"))

    def days(selector: Column) -> Column:
        """Indices 0 to 6 as flags; null where a part isn't a day."""
        parts = F.filter(F.transform(F.split(selector, ","), lambda p: sub_space(p)), lambda p: p != "")
        spans = F.transform(parts, lambda p: F.struct(
            (F.array_position(names, F.substring_index(p, "-", 1)) - 1).cast("int").alias("a"), (F.array_position(names, F.substring_index(p, "-", -1)) - 1).cast("int").alias("z"), p.rlike("^[a-z]{2}(-[a-z]{2})?$").alias("ok")))
        good = F.forall(spans, lambda s: s["ok"] & (s["a"] >= 0) & (s["z"] >= 0)) & (F.size(spans) > 0)
        return F.when(good, F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.exists(spans, lambda s: F.pmod(d - s["a"], F.lit(7)) <= F.pmod(s["z"] - s["a"], F.lit(7)))))

    def ranges(times: Column) -> Column:
        found = F.transform(F.regexp_extract_all(times, F.lit(r"(\d{1,2}:\d{2}\s*-\s*\d{1,2}:\d{2})"), F.lit(1)), lambda t: F.struct(
            (F.regexp_extract(t, r"^(\d+)", 1).cast("int") * 60 + F.regexp_extract(t, r"^\d+:(\d+)", 1).cast("int")).alias("start"),
            (F.regexp_extract(t, r"-\s*(\d+)", 1).cast("int") * 60 + F.regexp_extract(t, r":(\d+)$", 1).cast("int")).alias("end")))
        closed = F.transform(found, lambda r: F.struct(r["start"].alias("start"), F.when(r["end"] == 0, 1440).otherwise(r["end"]).alias("end")))
        return F.filter(closed, lambda r: (r["end"] > r["start"]) & (r["end"] <= 1440))

    def one(r: Column) -> Column:
        off, timed = r.rlike(rf"{W0}(off|closed){W1}"), r.rlike(r"\d{1,2}:\d{2}")
        selector = F.trim(F.when(timed, F.regexp_extract(r, r"^(.*?)\d{1,2}:\d{2}", 1)).otherwise(F.regexp_replace(r, rf"{W0}(off|closed){W1}", "")))
        every = F.array_repeat(F.lit(True), 7)
        own = F.when(r == "24/7", every).otherwise(F.when(selector == "", every).otherwise(days(selector)))
        spans = F.when(r == "24/7", F.array(F.struct(F.lit(0).alias("start"), F.lit(1440).alias("end")))).when(off, F.array().cast(RANGES)).otherwise(ranges(F.when(timed, r).otherwise(F.lit(""))))
        usable = own.isNotNull() & ((r == "24/7") | off | (F.size(spans) > 0))
        return F.when(usable, F.struct(own.alias("days"), spans.alias("ranges")))

    told = F.array_compact(F.transform(rules, one))
    week = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda d: F.coalesce(F.try_element_at(F.filter(told, lambda t: F.element_at(t["days"], d)), F.lit(-1))["ranges"], F.array().cast(RANGES)))
    return F.when(F.size(told) > 0, week)


def sub_space(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def minutes_label(m: Column) -> Column:
    return F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def open_state(week: Column, day: Column, minutes: Column) -> Column:
    """struct(known, open, closes_at, opens_at, opens_in_days) at a weekday (0 Monday) and minute."""
    now = F.try_element_at(F.filter(F.element_at(week, day + 1), lambda r: (minutes >= r["start"]) & (minutes < r["end"])), F.lit(1))
    ahead = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda a: F.transform(F.element_at(week, F.pmod(day + a, F.lit(7)) + 1), lambda r: F.struct(a.alias("a"), r["start"].alias("s")))))
    later = F.array_min(F.filter(ahead, lambda x: (x["a"] > 0) | (x["s"] > minutes)))
    open_ = now.isNotNull()
    return F.struct(
        week.isNotNull().alias("known"), F.coalesce(open_, F.lit(False)).alias("open"), F.when(open_, minutes_label(now["end"])).alias("closes_at"),
        F.when(~open_, minutes_label(later["s"])).alias("opens_at"), F.when(~open_, later["a"]).alias("opens_in_days"),
    )


def to_week_string(week: Column) -> Column:
    """Compact hours: neighbouring days with equal hours in one group, closed days left out; null if no day is open."""
    names = F.array(*[F.lit(n.capitalize()) for n in WEEK])
    texts = F.transform(week, lambda rs: F.array_join(F.transform(rs, lambda r: F.concat(minutes_label(r["start"]), F.lit("-"), minutes_label(r["end"]))), ","))

    def joined(text: Column) -> Column:
        at = lambda d: F.element_at(text, d)
        starts = F.filter(F.sequence(F.lit(1), F.lit(7)), lambda d: (at(d) != "") & ((d == 1) | (at(F.greatest(d - 1, F.lit(1))) != at(d))))

        def group(d: Column) -> Column:
            # The day before the next one with other hours.
            other = F.array_min(F.filter(F.sequence(d, F.lit(7)), lambda e: at(e) != at(d)))
            last = F.coalesce(other - 1, F.lit(7))
            days = F.when(last == d, F.element_at(names, d)).otherwise(F.concat(F.element_at(names, d), F.lit("-"), F.element_at(names, last)))
            return F.concat(days, F.lit(" "), at(d))

        return F.nullif(F.array_join(F.transform(starts, group), "; "), F.lit(""))

    return let(texts, joined)


# --- windows and labels ---


def local_now(ts: Column) -> Column:
    """struct(date, time) on a Danish clock."""
    own = F.from_utc_timestamp(ts, "Europe/Copenhagen")
    return F.struct(F.to_date(own).alias("date"), F.date_format(own, "HH:mm").alias("time"))


def weekend(d: Column) -> Column:
    """struct(saturday, sunday) of the weekend that holds or follows a day; a Sunday looks back."""
    saturday = F.when(weekday(d) == 7, F.date_sub(d, 1)).otherwise(F.date_add(d, 6 - weekday(d)))
    return F.struct(saturday.alias("saturday"), F.date_add(saturday, 1).alias("sunday"))


def occurrence_window(kind: str, d: Column) -> Column:
    if kind == "today":
        return F.struct(d.alias("first"), d.alias("last"))
    w = weekend(d)
    return F.struct(F.greatest(d, w["saturday"]).alias("first"), w["sunday"].alias("last"))


def is_open_at(date: Column, start: Column, end: Column, day: Column, time: Column) -> Column:
    return F.coalesce((date == day) & (end >= start) & (start <= time) & (time <= end), F.lit(False))


def timing_label(today: Column, d: Column) -> Column:
    n = F.datediff(d, today)
    far = F.concat(F.lit("d. "), F.dayofmonth(d), F.lit(". "), F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month(d)))
    return F.when(n <= 0, "i dag").when(n == 1, "i morgen").when(n <= 6, F.concat(F.lit("på "), F.element_at(F.array(*[F.lit(x) for x in DAY_NAMES]), weekday(d).cast("int")))).otherwise(far)


def format_hours(start: Column, end: Column) -> Column:
    short = lambda t: F.concat(F.substring(t, 1, 2).cast("int").cast("string"), F.when(F.substring(t, 4, 2) == "00", "").otherwise(F.concat(F.lit("."), F.substring(t, 4, 2))))
    return F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("kl. "), short(start), F.lit("–"), short(end))).when(start.isNotNull(), F.concat(F.lit("kl. "), short(start)))


def date_labels(d: Column) -> Column:
    day, month = F.element_at(F.array(*[F.lit(x) for x in DAY_NAMES]), weekday(d).cast("int")), F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month(d))
    number = F.dayofmonth(d).cast("string")
    return F.struct(
        F.substring(day, 1, 3).alias("weekday_short"), day.alias("weekday_long"), F.substring(month, 1, 3).alias("month_short"),
        F.concat(day, F.lit(" "), number, F.lit(". "), month).alias("long"), F.concat(number, F.lit(". "), month, F.lit(" "), F.year(d).cast("string")).alias("updated"),
    )


def parse_summary_range(c: Column) -> Column:
    """struct(start, end) of "d. month [yyyy] – d. month yyyy"; the year of the end holds for a start without one; null if the end comes first."""
    months = "|".join(MONTH_NAMES)
    p = rf"(\d{{1,2}})\.?\s+({months})(?:\s+(\d{{4}}))?\s*[-–]\s*(\d{{1,2}})\.?\s+({months})\s+(\d{{4}})"
    low = F.lower(c)
    part = lambda i: F.regexp_extract(low, p, i)
    year = F.when(part(3) == "", part(6)).otherwise(part(3))
    start, end = F.when(low.rlike(p), _date(year, _month(part(2)), part(1))), F.when(low.rlike(p), _date(part(6), _month(part(5)), part(4)))
    return F.when(start <= end, F.struct(start.alias("start"), end.alias("end")))


def parse_week_windows(c: Column, year: Column) -> Column:
    """Days of all "uge NN den D.–D. month" windows of up to 7 days, in order."""
    months = "|".join(MONTH_NAMES)
    p = rf"uge\s+\d{{1,2}}\s+den\s+(\d{{1,2}})\.?\s*[-–]\s*(\d{{1,2}})\.?\s+({months})"
    found = F.regexp_extract_all(F.lower(c), F.lit(f"({p})"), F.lit(1))
    spans = F.transform(found, lambda m: F.struct(
        _date(year, _month(F.regexp_extract(m, p, 3)), F.regexp_extract(m, p, 1)).alias("a"), _date(year, _month(F.regexp_extract(m, p, 3)), F.regexp_extract(m, p, 2)).alias("z")))
    good = F.filter(spans, lambda s: F.datediff(s["z"], s["a"]).between(0, 6))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(good, lambda s: F.sequence(s["a"], s["z"])))))


def expand_span(start: Column, end: Column, most: int = 30) -> Column:
    """The days of a span, the first ``most``; one day where the end is missing or before the start."""
    return F.slice(F.sequence(start, F.greatest(start, F.coalesce(end, start))), 1, most)


def plausible_dates(days: Column, ref: Column) -> Column:
    """The days of an array from a year before to two years after the reference day."""
    return F.filter(days, lambda x: x.between(F.date_sub(ref, 366), F.date_add(ref, 730)))
