"""Raw listings to canonical events, order-free: clean, resolve, merge, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from localmarkets.functions import geo, scores
from localmarkets.functions import text as T
from localmarkets.operators import resolve as R
from localmarkets.shared import observed_cut, scratch


def clean(raws: DataFrame) -> DataFrame:
    """Fields as they are matched and merged: dates out of titles, vague streets and points abroad gone."""
    inside = geo.in_denmark(F.col("lat"), F.col("lng"))
    return raws.withColumns({
        "title": T.strip_date_tokens(F.col("title")), "street": T.clean_street(F.col("street")), "venue_name": T.clean_venue_name(F.col("venue_name")), "city": T.clean_city(F.col("city"), F.col("postcode")),
        "lat": F.when(inside, F.col("lat")), "lng": F.when(inside, F.col("lng")), "geocode_quality": F.when(inside, F.col("geocode_quality")),
    })


def merge_status(members: DataFrame) -> DataFrame:
    """(cluster, status) of listings with cluster, trust, called_off, changed and the status that they had before (null: new).

    The fold of ``event_status`` over a cluster, free of order: it is called off if one that is trusted at 0.5, or as the best of the
    cluster, says so; a cluster that was called off stays so until a best source takes it back with a change; an expired one is active.
    """
    best = F.max("trust").over(Window.partitionBy("cluster"))
    told = members.withColumn("best", best)
    off = F.bool_or(F.col("called_off") & (F.col("trust") >= F.least(F.lit(0.5), F.col("best"))))
    back = F.bool_or(~F.col("called_off") & (F.col("trust") >= F.col("best")) & F.col("changed"))
    was = F.bool_or(F.coalesce(F.col("status") == "cancelled", F.lit(False)))
    return told.groupBy("cluster").agg(F.when(off | (was & ~back), "cancelled").otherwise("active").alias("status"))


def kept_slugs(members: DataFrame) -> DataFrame:
    """(cluster, hint): the slug that the most trusted member had, the smallest k among equals; null where none had one."""
    had = F.col("slug").isNotNull()
    return members.groupBy("cluster").agg(F.max(F.when(had, F.struct("trust", (-F.col("k")).alias("first"), F.col("slug").alias("slug"))))["slug"].alias("hint"))


def figures_of(members: DataFrame) -> DataFrame:
    """(cluster, created, merged, unchanged) of listings with cluster, changed, and the slug that their event had before (null: none).

    An event that none of its listings had before is created by one of them; a listing whose event goes on is unchanged if its payload
    is; every other listing is merged. The three add up to the listings.
    """
    had = F.col("slug").isNotNull()
    own = members.groupBy("cluster").agg(F.count("*").alias("n"), F.bool_or(had).alias("had"), F.count_if(had & ~F.col("changed")).alias("unchanged"))
    created = F.when(F.col("had"), 0).otherwise(1)
    return own.select("cluster", created.alias("created"), (F.col("n") - created - F.col("unchanged")).alias("merged"), "unchanged")


def canonicalize(raws: DataFrame, occurrences: DataFrame, today: Column, previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, occurrences) of ``canonicalize_run``."""
    return canonicalize_run(raws, occurrences, today, previous)[:2]


def canonicalize_run(raws: DataFrame, occurrences: DataFrame, today: Column, previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(events, occurrences, figures) by cluster; listings without a day from today on take no part and are skipped.

    The key of an event is the smallest k of its cluster, so the result doesn't depend on the order in
    which listings arrived. ``previous`` (k, slug, status) is what each listing's event was before: its slug
    is kept whichever listing is the smallest now, and its status goes on. ``raws`` may have ``cancelled``
    and ``changed`` (the payload differs from the run before); a title may call off too. Figures: ``created``,
    ``merged``, ``unchanged`` and ``skipped`` listings, observed while the tables of the run are written.
    """
    ahead = occurrences.where(F.col("date") >= today)
    dates = ahead.groupBy("event_id").agg(F.array_sort(F.collect_set("date")).alias("dates"))
    flag = lambda n: F.coalesce(n, F.lit(False)) if n in raws.columns else F.lit(False)
    flagged = raws.withColumns({"called_off": flag("cancelled") | F.coalesce(T.title_signals_cancelled(F.col("title")), F.lit(False)), "changed": flag("changed")})
    dated = flagged.join(dates, F.col("k") == F.col("event_id"), "left").drop("event_id")
    with scratch(raws.sparkSession) as own:
        rows, skipped = observed_cut(clean(dated), "cleaned", skipped=F.count_if(F.col("dates").isNull()))
        rows = rows.where("dates is not null")
        clustered = own.keep(rows.join(R.same_market(rows), "k").drop("dates"), "clustered")
    events = R.merge_fields(clustered)
    days = R.merge_occurrences(ahead.join(clustered.select("k", "cluster", "trust"), F.col("event_id") == F.col("k")))
    first = days.groupBy("cluster").agg(F.min("date").alias("first_date"), F.count("*").alias("days"))
    members = clustered.select("k", "cluster", "trust", "called_off", "changed")
    if previous is None:
        members = members.withColumns({"slug": F.lit(None).cast("string"), "status": F.lit(None).cast("string")})
    else:
        members = members.join(previous.select("k", "slug", "status"), "k", "left")
    told = merge_status(members).join(kept_slugs(members), "cluster").join(figures_of(members), "cluster")
    told, figures = observed_cut(told, "states", created=F.sum("created"), merged=F.sum("merged"), unchanged=F.sum("unchanged"))
    located = F.col("lat").isNotNull() & T.is_precise(F.col("geocode_quality"))
    age = F.greatest(F.lit(0), F.datediff(today, F.col("last_seen")))
    scored = events.join(first, "cluster").withColumn("confidence", scores.event_confidence(F.col("trust"), F.col("sources"), age, located, F.col("days") > 0, F.lit(0)))
    scored = scored.join(told.select("cluster", "status", "hint"), "cluster")
    slug = F.coalesce("hint", T.slugify(F.concat_ws(" ", "title", "city")))
    return R.unique_slugs(scored.withColumn("base", slug), "base", "cluster").drop("base", "hint"), days, figures | skipped
