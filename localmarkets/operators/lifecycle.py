"""Change between runs: keyed upserts, expiry, disappearance. Snapshots are tables; each function gives the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from localmarkets.functions import geo
from localmarkets.functions import text as T


def upsert_raw(existing: DataFrame, batch: DataFrame, key: list[str], touch: bool = True) -> DataFrame:
    """Next snapshot (key, payload, hash, last_seen, change): new, changed, unchanged or kept (not in the batch).

    Both sides have key, payload, last_seen. Without ``touch`` an unchanged row keeps its last sighting.
    """
    old = existing.select(*key, F.col("payload").alias("old_payload"), T.content_hash(F.coalesce("payload", F.lit(""))).alias("old_hash"), F.col("last_seen").alias("old_seen"), F.lit(True).alias("was"))
    new = batch.select(*key, F.col("payload").alias("new_payload"), T.content_hash(F.coalesce("payload", F.lit(""))).alias("new_hash"), F.col("last_seen").alias("new_seen"), F.lit(True).alias("is"))
    both = old.join(new, key, "full")
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "kept").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    seen = F.when(F.col("is").isNull() | ((change == "unchanged") & F.lit(not touch)), F.col("old_seen")).otherwise(F.greatest("old_seen", "new_seen"))
    return both.select(*key, F.when(F.col("is"), F.col("new_payload")).otherwise(F.col("old_payload")).alias("payload"), F.coalesce("new_hash", "old_hash").alias("hash"), seen.alias("last_seen"), change.alias("change"))


def expire_past(events: DataFrame, occurrences: DataFrame, today: Column) -> DataFrame:
    """Active events without a day from today on become expired."""
    ahead = occurrences.where(F.col("date") >= today).select(F.col("event_id").alias("k")).distinct().withColumn("ahead", F.lit(True))
    return events.join(ahead, "k", "left").withColumn("status", F.when((F.col("status") == "active") & F.col("ahead").isNull(), "expired").otherwise(F.col("status"))).drop("ahead")


def vanished(previous: DataFrame, current: DataFrame, key: list[str], healthy: DataFrame) -> DataFrame:
    """Rows of healthy sources that the current run has not seen again; a source that was not read in full takes nothing away."""
    return previous.join(healthy, "source_key", "left_semi").join(current.select(*key), key, "left_anti")


def reconcile(events: DataFrame, links: DataFrame, gone: DataFrame) -> DataFrame:
    """(event_id, links, left): events that lost a link; those with none left are to expire."""
    marked = links.join(gone.select("raw_id").withColumn("gone", F.lit(1)), "raw_id", "left")
    counts = marked.groupBy("event_id").agg(F.count("*").alias("links"), F.sum(F.when(F.col("gone").isNull(), 1).otherwise(0)).alias("left"))
    return events.join(counts, "event_id").where("left < links").select("event_id", "links", "left")


def retire(venues: DataFrame, seen: DataFrame, types: list[str]) -> DataFrame:
    """Active rows of the given kinds that the run has not seen are gone; every other row keeps the status that it has."""
    found = seen.select("source_type", "source_id").distinct().withColumn("seen", F.lit(True))
    lost = F.col("source_type").isin(types) & F.col("seen").isNull() & (F.col("status") == "active")
    return venues.join(found, ["source_type", "source_id"], "left").withColumn("status", F.when(lost, "gone").otherwise(F.col("status"))).drop("seen")


def accumulate(existing: DataFrame, fresh: DataFrame, key: str, today: Column, keep_days: int = 400) -> DataFrame:
    """Union by key, the fresh row wins; only dated rows older than the bound go."""
    both = existing.withColumn("batch", F.lit(0)).unionByName(fresh.withColumn("batch", F.lit(1)))
    rows = both.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("batch")))).where("n = 1").drop("n", "batch")
    return rows.where(F.col("date").isNull() | (F.col("date") >= F.date_sub(today, keep_days)))


def candidate_funnel(existing: DataFrame, mined: DataFrame) -> DataFrame:
    """Counts are overwritten, verdicts stay; a domain is due for a probe unless it was promoted or rejected."""
    both = existing.select("domain", "status", "note", F.col("mentions").alias("old")).join(mined.select("domain", F.col("mentions").alias("new")), "domain", "full")
    status = F.coalesce("status", F.lit("new"))
    return both.select("domain", F.coalesce("new", "old").alias("mentions"), status.alias("status"), "note", (~status.isin("promoted", "rejected")).alias("due"))


def upsert_venues(existing: DataFrame, batch: DataFrame, key: list[str], slug: Column) -> DataFrame:
    """Next snapshot (key, all other columns of the batch, slug, status): rows of the batch win whole and are active, slugs once given stay; ``slug`` is that of a new row.

    Existing rows have the columns of the batch, slug and status. Rows that the batch lacks stay as they are.
    """
    told = [c for c in batch.columns if c not in key]
    old = existing.select(*key, F.struct(*told).alias("old"), F.col("slug").alias("old_slug"), F.col("status").alias("old_status"))
    both = old.join(batch.select(*key, F.struct(*told).alias("new")), key, "full")
    row = F.when(F.col("new").isNotNull(), F.col("new")).otherwise(F.col("old"))
    chosen = both.select(*key, row.alias("row"), "old_slug", F.when(F.col("new").isNotNull(), "active").otherwise(F.col("old_status")).alias("status"))
    return chosen.select(*key, *[F.col("row")[c].alias(c) for c in told], "old_slug", "status").withColumn("slug", F.coalesce("old_slug", slug)).drop("old_slug")


def backfill(rows: DataFrame) -> DataFrame:
    """What stored listings lack, inferred from their prose: ``place``, ``stalls``, ``free``; and ``lat`` only inside the country.

    All columns of ``rows`` stay but ``lat``, which is checked.
    """
    prose = F.concat_ws(" ", "title", F.coalesce("description", F.lit("")))
    place = F.when(F.col("indoor_outdoor") == "unknown", T.infer_indoor_outdoor(prose)).otherwise(F.col("indoor_outdoor"))
    told = {"place": place, "stalls": F.coalesce("stall_count_text", T.extract_stall_count_text(prose)), "free": F.coalesce("is_free", T.infer_is_free(prose))}
    return rows.withColumns(told | {"lat": F.when(geo.in_denmark(F.col("lat"), F.col("lng")), F.col("lat"))})


def append_document_log(log: DataFrame, documents: DataFrame, fetched: Column) -> DataFrame:
    """Rows to append (url, hash, fetched): one for each content of a page that the log does not hold yet.

    ``documents``: url, html; a null page counts as empty. Repeated contents of one url are one row.
    """
    fresh = documents.where("url is not null").select("url", F.sha2(F.coalesce("html", F.lit("")), 256).alias("hash")).distinct()
    return fresh.join(log.select("url", "hash"), ["url", "hash"], "left_anti").withColumn("fetched", fetched)


def list_candidates(candidates: DataFrame, least: int = 2, status: str | None = None) -> DataFrame:
    """Candidates (domain, mentions, score) with enough mentions: those not probed yet last, by score, mentions and name."""
    rows = candidates if status is None else candidates.where(F.col("status") == status)
    return rows.where(F.col("mentions") >= least).orderBy(F.col("score").desc_nulls_last(), F.desc("mentions"), "domain")


def structured_feed_domains(candidates: DataFrame, url: str, probe: str, status: str | None = None) -> DataFrame:
    """(domain): distinct domains whose probe (JSON text) found an interface and that are not rejected (column ``status``); malformed probes say nothing."""
    told = F.from_json(probe, "struct<api:boolean>")["api"]
    rows = candidates if status is None else candidates.where(~F.col(status).eqNullSafe("rejected"))
    return rows.where(told).select(T.normalize_domain(F.col(url)).alias("domain")).distinct()


def list_tips(tips: DataFrame, *newest: str, status: Column | None = None) -> DataFrame:
    """Tips, those of one state only if it is given, the newest first by the named columns."""
    rows = tips if status is None else tips.where(status)
    return rows.orderBy(*[F.desc(n) for n in newest])
