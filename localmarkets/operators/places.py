"""Informal places: scores from their sources and visits, matching, publication, quality report.

Places: id, slug, name, place_type, street, postcode, city, lat, lng, geo_precision,
address_visibility, status, phone, profile_url, contact_name, pattern, call_first, confidence,
find_score, opening_notes, n_images, price_level, last_seen, last_verified.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from localmarkets.functions import geo, scores
from localmarkets.functions import text as T
from localmarkets.functions.scores import STATUSES, VISIBILITIES
from localmarkets.operators.resolve import TILE, each, sets, tiled_join
from localmarkets.shared import cut

HUMAN = ["user_visit", "phone_verification", "operator_review"]
EXPOSURE = {v: 5 - i for i, v in enumerate(VISIBILITIES)}  # how much a visibility shows


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def source_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1)), r"^www\.", "")


def independent_sources(sources: DataFrame) -> DataFrame:
    """place_id, sources (distinct kind and host), rows, phone_verified."""
    key = F.concat_ws("|", "source_type", F.coalesce(source_host(F.col("url")), F.lit("")))
    return sources.groupBy("place_id").agg(F.count_distinct(key).alias("sources"), F.count("*").alias("rows"), F.bool_or(F.col("source_type") == "phone_verification").alias("phone_verified"))


def visit_counts(visits: DataFrame) -> DataFrame:
    shown = F.coalesce("was_open", F.lit(False)) & ~F.col("reported_closed")
    return visits.groupBy("place_id").agg(F.count("*").alias("visits"), F.count_if(shown).alias("confirmed"), F.count_if("reported_closed").alias("closed"))


def with_evidence(places: DataFrame, sources: DataFrame, visits: DataFrame) -> DataFrame:
    """Places with the counts of their sources and visits; none counts as 0."""
    rows = places.join(independent_sources(sources), F.col("id") == F.col("place_id"), "left").drop("place_id").join(visit_counts(visits), F.col("id") == F.col("place_id"), "left").drop("place_id")
    zero = {n: F.coalesce(n, F.lit(0).cast("long")) for n in ("sources", "rows", "visits", "confirmed", "closed")}
    return rows.withColumns(zero | {"phone_verified": F.coalesce("phone_verified", F.lit(False))})


def place_confidence(today: Column) -> dict[str, Column]:
    """score (0 to 100) and reasons. One visit counts half, a report of closing half until there are two."""
    c, some = F.col, (lambda n: F.col(n).isNotNull() & (F.col(n).cast("string") != ""))
    age = F.datediff(today, F.coalesce("last_verified", "last_seen"))
    extra = F.least(F.greatest(c("sources") - 1, F.lit(0)), F.lit(3))
    decayed = half_up(18 * (F.lit(1.0) - (age - 60) / 480))
    fresh = F.when(age <= 60, 18).when(age < 540, decayed).otherwise(0)
    closed = F.when(c("closed") >= 2, -20).when(c("closed") == 1, -5).otherwise(0)
    parts = [
        (some("street"), F.lit(14), "precise address"), (some("phone"), F.lit(10), "telephone"), (extra > 0, extra * 9, "several sources"), (some("pattern"), F.lit(8), "opens regularly"),
        (c("n_images") > 0, F.lit(6), "pictures"), (c("geo_precision") == "exact", F.lit(6), "exact point"), (some("opening_notes"), F.lit(5), "opening hours"),
        (c("phone_verified"), F.lit(16), "confirmed by telephone"), (c("confirmed") > 0, F.when(c("confirmed") >= 2, 12).otherwise(6), "confirmed by visit"),
        (fresh > 0, fresh, "seen lately"), ((c("rows") <= 1) & (age > 180), F.lit(-14), "one old observation"), (c("closed") > 0, closed, "reported closed"),
    ]
    score = F.lit(20)
    for on, points, _ in parts:
        score = score + F.when(on, points).otherwise(0)
    reasons = F.array_compact(F.array(*[F.when(on, reason) for on, _, reason in parts]))
    return {"score": F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int"), "reasons": reasons}


# Places that are private, and the scale of the find score.
PRIVATE_TYPES, FIND_SCALE = ["loppelade", "gaardsalg", "garagesalg", "doedsbo", "loppeskur", "privat-saelger", "lade", "gaard", "garage", "dodsbo"], 157


def find_score(clearance: list[str]) -> dict[str, Column]:
    """score (0 to 100) and band: how promising a place is for finds."""
    c = F.col
    plus = lambda on, n: F.when(on, n).otherwise(0)
    raw = (
        F.lit(30) + plus(c("place_type").isin(PRIVATE_TYPES), 16) + plus(c("place_type").isin(clearance), 14) + plus(c("sources") <= 2, 10) + plus(c("status").isin("sporadic", "call_first"), 7)
        + F.lit(6) + plus(c("price_level") == "lav", 12) + plus(c("price_level") == "hoej", -14) + plus(c("confirmed") >= 2, 12) + plus(c("confirmed") == 1, 6)
    )
    score = F.greatest(F.lit(0), F.least(F.lit(100), half_up(raw / FIND_SCALE * 100))).cast("int")
    return {"score": score, "band": F.when(score >= 80, "very promising").when(score >= 60, "promising").when(score >= 40, "maybe").otherwise("unlikely")}


def _keyed(places: DataFrame) -> DataFrame:
    return places.select(
        "id", T.normalize_phone(F.col("phone")).alias("phone"), T.normalize_profile_url(F.col("profile_url")).alias("profile"), T.normalize_street(F.col("street")).alias("street"), T.fold_name(F.col("city")).alias("city"),
        "lat", "lng", T.distinctive_tokens(F.col("name")).alias("tokens"), T.fold_name(F.col("contact_name")).alias("contact"), T.fold_name(F.col("pattern")).alias("pattern"), "place_type",
    )


def _points(a: str = "a", b: str = "b") -> dict[str, Column]:
    """veto (two telephones), hard (one telephone or profile) and the points of two places."""
    x, y = (lambda n: F.col(f"{a}_{n}")), (lambda n: F.col(f"{b}_{n}"))
    same = lambda n: F.coalesce(x(n) == y(n), F.lit(False))
    veto = F.coalesce(x("phone") != y("phone"), F.lit(False))
    town = same("city")
    # A hundredth of a degree is over a kilometre.
    far = F.when(F.abs(x("lat") - y("lat")) <= 0.01, geo.haversine(x("lat"), x("lng"), y("lat"), y("lng")))
    streets = F.when(town & same("street"), 45).when(town & F.coalesce(x("street") != y("street"), F.lit(False)), -35).otherwise(0)
    yard = F.when(far <= 120, 35).when(far <= 800, 10).otherwise(0)
    plus = lambda on, n: F.when(on, n).otherwise(0)
    score = plus(same("phone"), 100) + plus(same("profile"), 100) + streets + yard + plus(F.arrays_overlap(x("tokens"), y("tokens")), 30) + plus(same("contact"), 20) + plus(same("pattern"), 8) + F.when(same("place_type"), 5).otherwise(-10)
    return {"veto": veto, "hard": same("phone") | same("profile"), "points": score}


def match_score(a: str = "a", b: str = "b", told: dict[str, Column] | None = None) -> dict[str, Column]:
    """verdict (merge, review, distinct) and score. Only one telephone or profile may merge; two telephones part. ``told``: ``_points``, if they are columns."""
    veto, hard, score = (told or _points(a, b)).values()
    verdict = F.when(veto, "distinct").when(hard & (score >= 100), "merge").when(score >= 55, "review").otherwise("distinct")
    return {"verdict": verdict, "score": F.when(veto, -60).otherwise(score).cast("int")}


def place_pairs(places: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b, verdict, score), a < b: pairs that are not distinct.

    A pair reaches 55 points only with one telephone, profile, address, contact or yard: the blocks. It
    stands in the first of them that it is in and is judged where it meets, so no pair is shuffled.
    Places of one address that are alike but for what tells two places apart are judged once, as a set.
    """
    rows = cut(_keyed(places), "places")
    one, two = (rows.select([F.col(n).alias(f"{p}_{n}") for n in rows.columns]) for p in "ab")
    same = lambda *names: F.coalesce(reduce(and_, [F.col(f"a_{n}") == F.col(f"b_{n}") for n in names]), F.lit(False))
    first = F.col("a_id") < F.col("b_id")
    told = []
    blocks = (["phone"], ["profile"], ["contact"])
    for i, key in enumerate(blocks):
        own = [side.where(F.col(f"{p}_{key[0]}").isNotNull()).withColumns({"key": F.col(f"{p}_{key[0]}"), f"{p}_k": F.col(f"{p}_id")}) for side, p in ((one, "a"), (two, "b"))]
        told.append(tiled_join(*own, ["key"], reduce(and_, [~same(*k) for k in blocks[:i]], first), tile))
    apart = reduce(and_, [~same(*k) for k in blocks])
    y, x = geo.cell(F.col("a_lat"), 0.01), geo.cell(F.col("a_lng"), 0.02)
    left = one.withColumns({"y": y, "x": x, "a_k": F.col("a_id")}).where("y is not null and x is not null")
    right = two.where("b_lat is not null and b_lng is not null").withColumn("y", F.explode(geo.near_cells(F.col("b_lat"), 0.01))).withColumn("x", F.explode(geo.near_cells(F.col("b_lng"), 0.02))).withColumn("b_k", F.col("b_id"))
    told.append(tiled_join(left, right, ["y", "x"], first & apart & ~same("street", "city"), tile))
    met = [_verdicts(t, []).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "verdict", "score") for t in told]
    return reduce(DataFrame.unionByName, [*met, _address_pairs(rows, tile)])


def _verdicts(both: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, a_id, b_id, verdict and score of pairs with both sides that are not distinct; the points are generated columns, so they are made once."""
    points = _points()
    known = both.select(*keep, "a_id", "b_id", F.inline(F.array(F.struct(*[e.alias(n) for n, e in points.items()])))).where("not veto and points >= 55")
    return known.select(*keep, "a_id", "b_id", *[e.alias(n) for n, e in match_score(told={n: F.col(n) for n in points}).items()])


def _address_pairs(rows: DataFrame, tile: int) -> DataFrame:
    """``place_pairs`` of one street and town and neither telephone, profile nor contact.

    Equal keys are in the blocks before, so of a key only counts whether there is one: two telephones part, and else
    a profile or a contact tells nothing. Places that agree in that and in the rest, the point too, are a set.
    """
    kept = ["street", "city", "lat", "lng", "tokens", "pattern", "place_type"]
    known = rows.where("street is not null and city is not null").withColumns({"k": F.col("id"), "called": F.col("phone").isNotNull()})
    held = cut(sets(known, [*kept, "called"], ["k", "phone", "profile", "contact"]), "address-sets")
    # A telephone of one side is never the other's here.
    sides = [held.select(*[F.col(n).alias(f"{p}_{n}") for n in ("k", "n", "members", *kept)], F.col("k").alias(f"{p}_id"), F.when(F.col("called"), F.lit(p)).alias(f"{p}_phone"), *[F.lit(None).cast("string").alias(f"{p}_{n}") for n in ("profile", "contact")], "street", "city") for p in "ab"]
    both = _verdicts(tiled_join(*sides, ["street", "city"], F.col("a_k") <= F.col("b_k"), tile), ["a_k", "b_k", "a_members", "b_members"]).drop("a_id", "b_id")
    differ = reduce(and_, [~F.coalesce(F.col(f"x.{n}") == F.col(f"y.{n}"), F.lit(False)) for n in ("phone", "profile", "contact")])
    return each(both, differ).select(F.least("x.k", "y.k").alias("a"), F.greatest("x.k", "y.k").alias("b"), "verdict", "score")


PUBLIC = ["slug", "name", "place_type", "street", "postcode", "city", "lat", "lng", "geo_precision", "area_only", "status", "confidence", "find_score", "phone", "profile_url"]


def public_view(places: DataFrame) -> DataFrame:
    """What may be shown, column by column: full addresses only where they are public, other points snapped, none where contact is asked for."""
    full = F.col("address_visibility") == "fuld"
    shown = places.where(F.col("address_visibility").isin("fuld", "omraade", "kun-aabningsdage", "kontakt-kraeves") & (F.col("status") != "rejected"))
    blurred = geo.blur(F.col("lat"), F.col("lng"))
    point = lambda n: F.when(F.col("address_visibility") == "kontakt-kraeves", None).when(full, F.col(n)).otherwise(blurred[n])
    return shown.select(
        "slug", "name", "place_type", F.when(full, F.col("street")).alias("street"), "postcode", "city", point("lat").alias("lat"), point("lng").alias("lng"),
        F.when(full, F.col("geo_precision")).otherwise("area").alias("geo_precision"), (~full).alias("area_only"), "status", "confidence", "find_score", "phone", "profile_url",
    )


def visibility_leaks(places: DataFrame, published: DataFrame) -> DataFrame:
    """(slug, leak) of each published row that shows more than its place allows."""
    view = published.select(F.col("slug").alias("v_slug"), *[F.col(n).alias(f"v_{n}") for n in ("street", "lat", "lng", "area_only", "geo_precision")])
    both = places.join(view, F.col("slug") == F.col("v_slug"))
    vis = F.col("address_visibility")
    part = vis.isin("omraade", "kun-aabningsdage", "kontakt-kraeves")
    still = (F.abs(F.col("v_lat") - F.col("lat")) <= 1e-9) & (F.abs(F.col("v_lng") - F.col("lng")) <= 1e-9)
    rules = [
        (vis.isin("intern", "ikke-offentlig"), "published"), (part & F.col("v_street").isNotNull(), "street"), (part & ~F.col("v_area_only"), "not marked as an area"),
        (part & F.coalesce(still, F.lit(False)), "exact point"), (part & (F.col("v_geo_precision") != "area"), "precision"), ((vis == "kontakt-kraeves") & (F.col("v_lat").isNotNull() | F.col("v_lng").isNotNull()), "pin"),
    ]
    return both.select("slug", F.explode(F.array_compact(F.array(*[F.when(on, leak) for on, leak in rules]))).alias("leak"))


def publish(places: DataFrame) -> DataFrame:
    """The public view without any row that leaks, with its layer and search text."""
    view = public_view(places)
    clean = view.join(visibility_leaks(places, view).select("slug").distinct(), "slug", "left_anti")
    calls = places.select(F.col("slug").alias("s"), "call_first")
    layer = scores.trust_layer(F.col("status"), F.col("confidence"), F.col("call_first"))
    return clean.join(calls, F.col("slug") == F.col("s")).select(*PUBLIC, layer.alias("layer"), T.search_fold(F.concat_ws(" ", "name", "city")).alias("search_text"))


def sort_within_layers(places: DataFrame, key: Column) -> list[Column]:
    """Sort keys: the three layers in their order, the key only inside a layer."""
    return [F.when(F.col("layer") == "bekraeftet", 0).when(F.col("layer") == "kontroller-foerst", 1).otherwise(2), key, F.col("id")]


def tighten(stored: Column, incoming: Column) -> Column:
    """The incoming visibility, if it shows no more than the stored one."""
    rank = lambda v: F.coalesce(*[F.when(v == name, n) for name, n in EXPOSURE.items()])
    return F.when(stored.isNull() | (rank(incoming) <= rank(stored)), incoming).otherwise(stored)


def quality_report(places: DataFrame, today: Column) -> DataFrame:
    """(severity, slug, check): what is wrong with stored places; duplicates by telephone and address; a total. Places come with their evidence counts."""
    c, none = F.col, (lambda n: F.col(n).isNull() | (F.col(n).cast("string") == ""))
    age = F.datediff(today, F.coalesce("last_verified", "last_seen"))
    phone = T.normalize_phone(c("phone"))
    rules = [
        (~c("status").isin(STATUSES), "error", "unknown status"), (~c("address_visibility").isin(VISIBILITIES), "error", "unknown visibility"),
        (~c("confidence").between(0, 100) | ~c("find_score").between(0, 100), "error", "score out of range"), (c("lat").isNotNull() & ~geo.in_denmark(c("lat"), c("lng")), "error", "point abroad"),
        (~c("postcode").rlike("^[1-9][0-9]{3}$"), "error", "bad postcode"), (none("city") & none("postcode") & c("lat").isNull(), "error", "no place"),
        ((c("address_visibility") == "fuld") & ~none("street") & ~c("phone_verified"), "error", "full address without vetting"), (none("name"), "error", "no name"), (c("rows") == 0, "warn", "no sources"),
        (~none("phone") & phone.isNull(), "warn", "bad telephone"), ((c("status") == "confirmed_active") & c("last_verified").isNull(), "error", "confirmed but never verified"),
        ((c("status") == "confirmed_active") & c("last_verified").isNotNull() & (age > 180), "warn", "old confirmation"),
        ((age > 540) & ~c("status").isin("historical", "rejected", "possibly_inactive"), "warn", "no activity"), ((c("status") == "call_first") & none("phone"), "warn", "call first without telephone"),
        (c("call_first") & none("phone") & none("profile_url"), "warn", "no contact"), ((c("address_visibility") == "kontakt-kraeves") & none("phone") & none("profile_url"), "error", "contact asked for but none given"),
        (~none("pattern") & (c("rows") < 2), "warn", "regular without history"),
    ]
    issue = lambda on, severity, check: F.when(on, F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check")))
    found = places.select("slug", F.explode(F.array_compact(F.array(*[issue(*r) for r in rules]))).alias("i")).select("i.severity", "slug", "i.check")
    twice = None
    for check, key in (("same telephone", phone), ("same address", F.lower(F.concat_ws("|", F.when(~none("street"), F.trim("street")), F.trim("city"))))):
        usable = places.where(key.isNotNull() & (~none("street") if check == "same address" else F.lit(True)))
        groups = usable.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")
        rows = groups.select(F.lit("warn").alias("severity"), F.concat("key", F.lit(" x"), c("n").cast("string")).alias("slug"), F.lit(check).alias("check"))
        twice = rows if twice is None else twice.unionByName(rows)
    total = places.agg(F.count("*").alias("n")).select(F.lit("info").alias("severity"), c("n").cast("string").alias("slug"), F.lit("total").alias("check"))
    return found.unionByName(twice).unionByName(total)


def with_layer(places: DataFrame) -> DataFrame:
    return places.withColumn("layer", scores.trust_layer(F.col("status"), F.col("confidence"), F.col("call_first")))


def filter_places(places: DataFrame, types: list[str] | None = None, layers: list[str] | None = None, least_score: int | None = None, hide_call_first: bool = False) -> DataFrame:
    """Places that meet every filter that is set; all columns and ``layer``."""
    rows = with_layer(places)
    tests = [
        None if types is None else F.col("place_type").isin(types),
        None if layers is None else F.col("layer").isin(layers),
        None if least_score is None else F.col("find_score") >= least_score,
        ~F.col("call_first") if hide_call_first else None,
    ]
    for test in tests:
        rows = rows if test is None else rows.where(test)
    return rows


def active_filter_count(*filters: Column) -> Column:
    """How many filters of a saved state are set: neither null nor false."""
    return sum((F.when(f.isNotNull() & (f.cast("string") != "false"), 1).otherwise(0) for f in filters), F.lit(0))


def validate_photos(photos: DataFrame, file: str) -> DataFrame:
    """Photos whose file is a plain name of an image: no folder, no upper case, no other kind."""
    return photos.where(F.col(file).rlike(r"^[a-z0-9][a-z0-9_-]*\.(jpg|jpeg|png|webp)$"))


def upsert_places(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """(slug, address_visibility) of each row of the batch: a stored place never comes to show more than before."""
    old = stored.select("slug", F.col("address_visibility").alias("__stored"))
    rows = batch.select("slug", "address_visibility").join(old, "slug", "left")
    return rows.select("slug", tighten(F.col("__stored"), F.col("address_visibility")).alias("address_visibility"))


def add_observations(observations: DataFrame, order: str = "event_id") -> DataFrame:
    """One row for each place, kind of source, address and time: the latest by ``order``, as a struct maximum."""
    key = ["place_id", "source_type", "url", "observed_at"]
    rest = [c for c in observations.columns if c not in key]
    same = observations.withColumn("__url", F.coalesce("url", F.lit("")))
    best = same.groupBy("place_id", "source_type", "__url", "observed_at").agg(F.max_by(F.struct("url", *rest), order).alias("__row"))
    return best.select("place_id", "source_type", "observed_at", "__row.*").select(*observations.columns)


def ingest_places(vetted: DataFrame, observations: DataFrame) -> DataFrame:
    """Vetted places with a point or a street, and the span of their observations (``first_seen``, ``newest``)."""
    seen = observations.groupBy(F.col("place_id").alias("id")).agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("newest"))
    return vetted.where("lat is not null or street is not null").drop("first_seen", "newest").join(seen, "id", "left")


def report_summary(report: DataFrame) -> DataFrame:
    """(check, severity, n) of a quality report, errors first."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warn", 1).otherwise(2)
    return report.groupBy("check", "severity").agg(F.count("*").alias("n")).orderBy(rank, F.desc("n"), "check")
