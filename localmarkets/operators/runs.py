"""Whole jobs with their figures: resolution runs, community tips, discovery, and the log of runs.

Figures are observed in the pass that writes a table, never by a second scan; each run is a row that is
appended to the log.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from localmarkets.functions import facts, scores
from localmarkets.functions import text as T
from localmarkets.operators import canonical
from localmarkets.operators.lifecycle import candidate_funnel
from localmarkets.shared import cut, observed_cut
from localmarkets.sources.tips import tips_to_raw

LOG = "run string, kind string, finished timestamp, figures map<string,bigint>"
TIP_SOURCE, TIP_TRUST = "tip", 0.35
#: Candidates that are probed, their least mentions, the score from which they are strong, and the length of the shortlist.
PROBED, MENTIONS, STRONG, SHORTLIST = 10, 2, 6, 20


@dataclass
class RunLog:
    spark: SparkSession
    path: str

    def append(self, run: str, kind: str, figures: dict[str, int]) -> None:
        row = self.spark.createDataFrame([(run, kind, figures)], "run string, kind string, figures map<string,bigint>")
        row.select("run", "kind", F.current_timestamp().alias("finished"), "figures").coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(self.path)


def process_tips(tips: DataFrame, today: Column, listings: DataFrame | None = None, occurrences: DataFrame | None = None, previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, int]]:
    """(statuses, events, days, figures): new tips (k, text) become listings of low trust and are resolved with ``listings``.

    A tip that can be read is processed, one that can't stays new and is counted. Keys of tips and of listings (columns as for
    ``canonicalize``) are different numbers.
    """
    raws, read = observed_cut(tips_to_raw(tips, today), "tips", parsed=F.count("*"))
    nothing = {n: F.lit(None).cast(kind) for n, kind in {"description": "string", "venue_name": "string", "lat": "double", "lng": "double", "geocode_quality": "string", "contact_website": "string", "is_free": "boolean", "stall_count_text": "string", "indoor_outdoor": "string"}.items()}
    own = raws.withColumns(nothing | {"source_key": F.lit(TIP_SOURCE), "trust": F.lit(TIP_TRUST), "last_seen": today})
    days = raws.select(F.col("k").alias("event_id"), F.explode("days").alias("date"), "start_time", "end_time")
    rows = own.drop("days", "start_time", "end_time")
    if listings is not None:
        rows, days = listings.unionByName(rows, allowMissingColumns=True), occurrences.unionByName(days, allowMissingColumns=True)
    events, admitted, resolved = canonical.canonicalize_run(rows, days, today, previous)
    statuses, counted = observed_cut(tips.select("k").join(raws.select("k", F.lit("processed").alias("done")), "k", "left").select("k", F.coalesce("done", F.lit("new")).alias("status")), "tip-statuses", tips=F.count("*"))
    return statuses, events, admitted, counted | {"unparsed": counted["tips"] - read["parsed"]} | resolved


def probe_pages(pages: DataFrame, domains: DataFrame, status: Column | None = None) -> DataFrame:
    """(domain, score, keywords, signals): the best page of each domain by its score; ``pages`` has url and html."""
    told = facts.page_signals(F.col("html"))
    score = scores.probe_score(F.lit(200) if status is None else status, told["json_ld"], F.lit(False), told["ical"], told["rss"], F.size(told["keywords"]), told["danish"], told["wordpress"])
    named = pages.withColumn("domain", T.normalize_domain(F.col("url"))).join(domains.select("domain"), "domain", "left_semi")
    signals = F.array_compact(F.array(*[F.when(told[n], F.lit(n)) for n in ("json_ld", "ical", "rss", "wordpress", "danish")]))
    return named.select("domain", score.alias("score"), told["keywords"].alias("keywords"), signals.alias("signals"), "url").groupBy("domain").agg(F.max(F.struct("score", "url", "keywords", "signals")).alias("best")).select("domain", "best.score", "best.keywords", "best.signals")


def discovery_run(mined: DataFrame, existing: DataFrame, pages: DataFrame, probed: int = PROBED, least: int = MENTIONS) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(candidates, shortlist, figures): mined domains join the funnel, the most mentioned ones that are due are probed, and those with titles that nobody knows yet are listed.

    ``existing``: domain, status, note, mentions, score of runs before.
    """
    domains, seen = observed_cut(mined, "mined", domains=F.count("*"))
    funnel = candidate_funnel(existing.drop("score"), domains).join(existing.select("domain", F.col("score").alias("old_score")), "domain", "left")
    due = cut(funnel.where(F.col("due") & (F.col("mentions") >= least)).orderBy(F.col("old_score").desc_nulls_last(), F.desc("mentions"), "domain").limit(probed), "due")
    found = probe_pages(pages, due)
    told = funnel.join(found, "domain", "left").join(due.select("domain", F.lit(True).alias("now")), "domain", "left")
    # A domain without a page is probed too, and scores nothing.
    scored = F.when(F.col("now"), F.coalesce("score", F.lit(0))).otherwise(F.col("old_score"))
    candidates, counted = observed_cut(
        told.select("domain", "mentions", "status", "note", scored.alias("score"), "keywords", "signals", F.coalesce("now", F.lit(False)).alias("now")), "candidates",
        probed=F.count_if("now"), strong=F.count_if(F.col("score") >= STRONG),
    )
    fresh = domains.select("domain", "mentions", "titles", (F.col("titles") - F.col("covered")).alias("fresh")).where("fresh >= 1")
    shortlist = fresh.orderBy(F.desc("fresh"), F.desc("mentions"), "domain").limit(SHORTLIST)
    return candidates.drop("now"), shortlist, seen | counted
