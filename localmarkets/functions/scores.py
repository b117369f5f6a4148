"""Additive scores; every part is an expression that can be shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hundredths(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / 100


def event_confidence(trust: Column, sources: Column, days: Column, located: Column, dated: Column, confirms: Column) -> Column:
    """0 to 1 from trust, corroboration, freshness, place, dates and visitors; a lone source of little trust stays below the line."""
    fresh = F.greatest(F.lit(0.0), F.lit(1.0) - F.greatest(F.lit(0), days - 14) / 106)
    score = trust * 0.5 + F.least(sources - 1, F.lit(2)) * 0.1 + fresh * 0.2 + F.when(located, 0.1).otherwise(0.0) + F.when(dated, 0.1).otherwise(0.0)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), hundredths(score + F.least(confirms, F.lit(4)) * 0.03)))
    cap = F.when(confirms >= 3, 0.6).otherwise(0.44)
    return F.when((sources <= 1) & (trust < 0.5), F.least(score, cap)).otherwise(score)


def trust_level(confidence: Column) -> Column:
    return F.when(confidence >= 0.75, "confirmed").when(confidence >= 0.45, "ok").otherwise("unverified")


def gem_points(description: Column, stalls: Column, free_known: Column, timed: Column, venue: Column, contact: Column) -> Column:
    n = F.coalesce(F.length(description), F.lit(0))
    one = lambda x: F.when(x, 1).otherwise(0)
    return F.when(n >= 200, 2).when(n >= 80, 1).otherwise(0) + one(stalls.isNotNull()) + one(free_known) + one(timed) + one(venue.isNotNull()) + one(contact.isNotNull())


def hidden_gem(confidence: Column, sources: Column, dates: Column, located: Column, stalls: Column, points: Column, least: int = 6) -> Column:
    number = F.nullif(F.regexp_extract(stalls, r"\d{1,4}", 0), F.lit("")).cast("int")
    return (confidence >= 0.7) & (sources == 1) & dates.between(1, 6) & located & (F.coalesce(number, F.lit(0)) <= 150) & (points >= least)


def survivor_score(lat: Column, precise: Column, postcode: Column, street: Column, venue: Column, description: Column, dates: Column) -> Column:
    some = lambda x, n: F.when(x.isNotNull() & (x != ""), n).otherwise(0)
    place = F.when(lat.isNotNull() & precise, 100).when(lat.isNotNull(), 20).otherwise(0)
    return place + some(postcode, 10) + some(street, 10) + some(venue, 5) + some(description, 3) + F.least(dates, F.lit(20))


def recommend_score(confidence: Column, km: Column, days: Column, gem: Column, saved: Column, family: Column, free: Column) -> Column:
    near = F.when(km.isNotNull(), F.greatest(F.lit(0.0), F.lit(1.0) - km / 60) * 0.35).otherwise(0.0)
    plus = lambda x, w: F.when(x, w).otherwise(0.0)
    return confidence * 0.3 + near + plus(days <= 7, 0.25) + plus(gem, 0.3) + plus(saved, 0.35) + plus(family, 0.12) + plus(free, 0.08)


def recommend_reasons(label: Column, confidence: Column, km: Column, gem: Column, saved: Column, family: Column, free: Column, stalls: Column) -> Column:
    """At most three short reasons, the day first."""
    whole = F.floor(km + 0.5).cast("string")
    worth = gem | (confidence >= 0.8) | (F.coalesce(stalls, F.lit(0)) >= 30)
    near = F.when(km <= 15, F.concat(F.lit("kun "), whole, F.lit(" km væk"))).when((km <= 60) & worth, F.concat(whole, F.lit(" km — værd at køre")))
    own = F.array_compact(F.array(F.when(saved, "gemt af dig"), F.when(gem, "skjult perle"), near, F.when(family, "familievenlig"), F.when(free, "gratis")))
    own = F.concat(own, F.when((confidence >= 0.75) & (F.size(own) < 2), F.array(F.lit("godt bekræftet"))).otherwise(F.array().cast("array<string>")))
    return F.slice(F.concat(F.array(label), own), 1, 3)


def probe_score(status: Column, ld: Column, api: Column, ical: Column, rss: Column, keywords: Column, language: Column, wordpress: Column) -> Column:
    plus = lambda x, w: F.when(x, w).otherwise(0)
    total = plus(ld, 3) + plus(api, 4) + plus(ical, 2) + plus(rss, 2) + F.least(keywords, F.lit(3)) + plus(language, 1) + plus(wordpress, 1)
    return F.when(status == 200, total).otherwise(0)


def probe_verdict(score: Column) -> Column:
    return F.when(score >= 6, "promote").when(score >= 3, "review").otherwise("none")


def trust_layer(status: Column, confidence: Column, call_first: Column) -> Column:
    radar = status.isin("rejected", "historical", "unverified", "possibly_inactive") | (confidence < 45)
    check = call_first | status.isin("call_first", "sporadic")
    return F.when(radar, "radar").when(check, "kontroller-foerst").when((status == "confirmed_active") & (confidence >= 70), "bekraeftet").otherwise("kontroller-foerst")


def source_trust_label(trust: Column) -> Column:
    return F.when(trust >= 0.7, "hoej").when(trust >= 0.55, "god").when(trust >= 0.45, "middel").otherwise("faellesskab")


# What a place's status and the visibility of its address may be, the most open first.
STATUSES = ["confirmed_active", "recently_observed", "active_online", "sporadic", "call_first", "unverified", "possibly_inactive", "historical", "rejected"]
VISIBILITIES = ["fuld", "omraade", "kun-aabningsdage", "kontakt-kraeves", "intern", "ikke-offentlig"]
