"""Queries for the text expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from localmarkets.functions import text as T
from localmarkets.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, source: str, key: str, columns: dict[str, Callable[[], Column]], sql: dict[str, str] | None = None) -> None:
    """A query that gives ``key`` and one column for each expression over the whole of ``source``."""
    QUERIES[name] = lambda spark, d: view(spark, d, source).select(key, *[make().alias(n) for n, make in columns.items()])
    if sql:
        SQL[name] = with_views(f"SELECT {key}, " + ", ".join(f"{e} AS {n}" for n, e in sql.items()) + f" FROM {source}")


# The same rules in SQL, for the other engine.
def q_sub(x: str, pattern: str, by: str = " ", flags: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', '{flags}')"


def q_swap(x: str, *pairs: tuple[str, str]) -> str:
    for old, new in pairs:
        x = f"replace({x}, '{old}', '{new}')"
    return x


def q_squeeze(x: str) -> str:
    return f"trim({q_sub(x, r'\s+')})"


def q_title(x: str) -> str:
    return q_squeeze(q_sub(q_swap(f"lower({x})", ("æ", "ae"), ("ø", "oe"), ("å", "aa")), "[^a-z0-9 ]+"))


Q_DATES = rf"\b(?:{T.WEEKDAYS}|{T.MONTHS})\b|\bd\.\s*\d|\d{{1,2}}[./-]\d{{1,2}}|\b(?:19|20)\d{{2}}\b"
Q_DATE_PARTS = [
    r"\bkl\.?\s*\d{1,2}(?:[.:]\d{2})?\s*[-–]\s*\d{1,2}(?:[.:]\d{2})?",
    rf"\b(?:den|d)\.?\s*\d{{1,2}}\.?\s*(?:{T.MONTHS})(?:\s*\d{{4}})?",
    rf"\b\d{{1,2}}\.?\s*(?:{T.MONTHS})(?:\s*\d{{4}})?",
    r"\b\d{1,2}[./-]\d{1,2}(?:[./-]\d{2,4})?\b",
    rf"\b(?:{T.WEEKDAYS})e?\b",
    r"\b20\d{2}\b",
    r"\bd\.\s*",
]


def q_strip_dates(x: str) -> str:
    s = x
    for p in Q_DATE_PARTS:
        s = q_sub(s, p, " ", "gi")
    s = q_sub(q_sub(q_sub(s, r"\(\s*\)"), r"\s{2,}"), r"\s+([,.])", r"\1")
    s = f"trim({q_sub(q_sub(s, r'[\s,–-]+$', ''), r'^[\s,–-]+', '')})"
    return f"CASE WHEN NOT regexp_matches({x}, '{Q_DATES}', 'i') THEN {x} WHEN length({s}) >= 3 THEN {s} ELSE {x} END"


def q_forms(x: str) -> str:
    for p, name in ((r"\bcopenhagen\b", "København"), (r"\bkobenhavn\b", "København"), (r"^kbh\.?\b", "København"), (r"\belsinore\b", "Helsingør"), (r"\barhus\b", "Aarhus")):
        x = q_sub(x, p, name, "gi")
    return x


def q_clean_city(city: str, postcode: str) -> str:
    parts = f"list_filter(list_transform(string_split({city}, ','), lambda s: trim(s)), lambda s: s <> '')"
    pick = f"coalesce(list_filter({parts}, lambda s: coalesce(starts_with(s, {postcode}), false))[1], ({parts})[-1])"
    out = q_sub(pick, r"^[1-9]\d{3}\s+(.+)$", r"\1", "")
    out = f"trim({q_sub(q_sub(out, r'\s+på\s+.+$', '', 'gi'), r'\.\s*$', '')})"
    return f"nullif(trim({q_forms(out)}), '')"


def q_postcode(x: str) -> str:
    return rf"nullif(regexp_extract({x}, '\b([1-9]\d{{3}})\b', 1), '')"


def q_has(x: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({x}, '{pattern}', '{flags}')"


def q_in_out(inside: str, outside: str) -> str:
    return f"CASE WHEN coalesce({inside}, false) AND coalesce({outside}, false) THEN 'mixed' WHEN {inside} THEN 'indoor' WHEN {outside} THEN 'outdoor' ELSE 'unknown' END"


Q_INDOOR = r"indend(?:ø|o)rs|indoor|\b\w*hallen\b|\bidr(?:æ|ae)tshal\w*\b|\bsportshal\w*\b|\bridehal\w*\b|\bridehus\b|\barena\b|forsamlingshus|kulturhus|medborgerhus|sogneg(?:å|aa)rd"
Q_OUTDOOR = r"udend(?:ø|o)rs|outdoor|friluft|(?:å|aa)ben himmel|\bi det fri\b|cirkusplads|dyrskueplads|\bfestplads|boldbane"
Q_FREE = r"(?:gratis|fri)\s+(?:adgang|entr(?:é|e|ee)|indgang)|(?:adgang|entr(?:é|e|ee)|indgang)\s*:?\s*(?:gratis|fri)\b|ingen\s+entr(?:é|e|ee)"
Q_STALLS = r"(?:ca\.?\s*|over\s*|mere\s+end\s*|op\s+til\s*)?(\d{1,4})(?:\s*[-–til]+\s*(\d{1,4}))?\s+(stadepladser|standpladser|stader|stande|boder|kr(?:æ|ae)mmere|udstillere)\b"


def q_category(x: str) -> str:
    cases = [(r"(^|[^hH])jule|(^|\s)jul($|\s|e)|christmas", "julemarked"), *T.CATEGORIES[1:]]
    return "CASE " + " ".join(f"WHEN {q_has(f'lower({x})', p, '')} THEN '{v}'" for p, v in cases) + " ELSE 'andet' END"


def q_free(x: str) -> str:
    paid = r"(?:entr(?:é|e|ee)|billet|voksne)[^0-9]{0,12}\d{1,4}\s*(?:kr|,-|dkk)"
    return f"CASE WHEN {q_has(x, Q_FREE)} <> {q_has(x, paid)} THEN {q_has(x, Q_FREE)} END"


def q_stalls(x: str) -> str:
    part = lambda i: f"regexp_extract({x}, '{Q_STALLS}', {i}, 'i')"
    return f"CASE WHEN TRY_CAST(nullif({part(1)}, '') AS INT) BETWEEN 3 AND 5000 THEN {part(1)} || CASE WHEN {part(2)} <> '' THEN '–' || {part(2)} ELSE '' END || ' ' || lower({part(3)}) END"


def q_folds(x: str) -> str:
    low = q_swap(f"lower({x})", ("æ", "ae"))
    return f"concat_ws(' ', {q_swap(low, ('ø', 'oe'), ('å', 'aa'))}, {q_swap(low, ('ø', 'o'), ('å', 'a'))})"


def q_fold(x: str) -> str:
    return q_swap(f"lower({x})", ("æ", "ae"), ("ø", "o"), ("å", "a"), ("oe", "o"), ("aa", "a"))


def q_promo(x: str) -> str:
    s = q_sub(x, r"\s*\(\s*(?:kun\s+)?for\s+privat[e]?\s*\)", " ", "gi")
    s = q_sub(s, r"\s*[·,–-]?\s*\d{1,2}\.?\s*s(?:æ|ae)son\b.*$", " ", "gi")
    s = q_sub(s, r"\s+(?:kun\s+for\s+)?privat[e]?\s*$", " ", "gi")
    s = f"trim({q_sub(q_sub(s, r'\s{2,}'), r'[\s,·–-]+$', '')})"
    return f"CASE WHEN length({s}) >= 3 THEN {s} ELSE {x} END"


def q_domain(x: str) -> str:
    url = q_sub(f"trim({x})", r"[.,;:!?)\]]+$", "", "")
    url = f"CASE WHEN {q_has(url, r'^[a-z][a-z0-9+.-]*://')} THEN {url} ELSE 'http://' || {url} END"
    host = rf"regexp_replace(lower(regexp_extract({url}, '^[^:/?#]+://(?:[^/?#@]*@)?([^/:?#]*)', 1)), '^www\.', '')"
    return f"CASE WHEN {q_has(host, r'^[a-z0-9-]+(\.[a-z0-9-]+)+$', '')} THEN {host} END"


def q_phone(x: str) -> str:
    d = q_sub(q_sub(q_sub(x, r"[^\d+]", ""), r"^\+", "", ""), "^0045", "45", "")
    d = f"CASE WHEN length({d}) = 8 THEN '45' || {d} ELSE {d} END"
    own = f"substr({d}, 3)"
    return f"CASE WHEN length({d}) = 10 AND starts_with({d}, '45') AND NOT {q_has(own, '^[01]', '')} AND {own} <> repeat(substr({own}, 1, 1), 8) AND {own} <> '12345678' THEN {d} END"


def q_street(x: str) -> str:
    s = q_sub(q_title(x), r"^(.*?)\s+(\d+)\s*([a-z])\b", r"\1 \2\3", "")
    return f"CASE WHEN length({s}) >= 4 AND {q_has(s, r'\d', '')} THEN {s} END"


def q_profile(x: str) -> str:
    url = f"CASE WHEN starts_with({x}, 'http') THEN {x} ELSE 'https://' || {x} END"
    part = lambda p: f"regexp_extract({url}, '{p}', 1)"
    path = part(r"^https?://[^/?#]+([^?#]*)")
    group, first = f"regexp_extract({path}, '/groups/([^/]+)', 1)", f"regexp_extract({path}, '^/+([^/]+)', 1)"
    return f"""CASE WHEN {q_has(f"lower({part('^https?://([^/:?#]+)')})", r"(^|\.)facebook\.com$|(^|\.)fb\.com$", "")} THEN
 CASE WHEN {group} <> '' THEN 'group:' || lower({group}) WHEN {part("[?&]id=([^&#]+)")} <> '' THEN 'profile:' || {part("[?&]id=([^&#]+)")}
 WHEN {first} <> '' AND {first} NOT IN ('posts', 'permalink', 'photo', 'events', 'marketplace', 'story.php') THEN 'page:' || lower({first}) END END"""


GENERIC = ", ".join(f"'{w}'" for w in T.GENERIC_NAMES)


def q_tokens(x: str) -> str:
    return f"list_filter(string_split({q_title(x)}, ' '), lambda t: length(t) >= 3 AND t NOT IN ({GENERIC}))"


def q_base(x: str) -> str:
    ends = "|".join(T.DISTRICTS.split("|"))
    return rf"CASE WHEN {q_has(f'trim({x})', rf'\s({ends})$', '')} THEN array_to_string(list_slice(string_split_regex(trim({x}), '\s+'), 1, -2), ' ') ELSE trim({x}) END"


c = F.col
register("T1_normalize_title", "v_raw", "k", {"title": lambda: T.normalize_title(c("title"))}, {"title": q_title("title")})
register("T1_normalize_documents", "documents", "doc_id", {"value": lambda: F.md5(T.normalize_title(c("text")))}, {"value": f"md5({q_title('text')})"})
register("T2_slugify", "part", "p_partkey", {"slug": lambda: T.slugify(c("p_name"))}, {"slug": f"substr(replace({q_title('p_name')}, ' ', '-'), 1, 80)"})
register("T3_title_signals_cancelled", "v_text", "k", {"cancelled": lambda: T.title_signals_cancelled(c("text"))}, {"cancelled": rf"{q_has('text', r'\b(aflyst|aflyses|cancelled|canceled)\b')} AND NOT {q_has('text', r'\baflys\w*\s+ikke\b')}"})
register("T4_strip_date_tokens", "v_raw", "k", {"title": lambda: T.strip_date_tokens(c("title")), "dated": lambda: T.title_has_date_tokens(c("title"))}, {"title": q_strip_dates("title"), "dated": q_has("title", Q_DATES)})
register("T4_strip_date_prose", "v_text", "k", {"title": lambda: T.strip_date_tokens(c("text"))}, {"title": q_strip_dates("text")})
register("T5_title_for_match", "v_raw", "k", {"title": lambda: T.normalize_title_for_match(c("title"))}, {"title": q_title(q_strip_dates("title"))})
_n = q_squeeze("text")
register("T6_clean_venue_name", "documents", "doc_id", {"venue": lambda: T.clean_venue_name(c("text"))}, {"venue": f"CASE WHEN {_n} <> '' AND length({_n}) <= 80 AND NOT {q_has(_n, r'[.!?]\s+\S', '')} AND NOT {q_has(_n, '^(på |ved |se )?adressen:?$')} THEN {_n} END"})
register("T7_clean_street", "v_raw", "k", {"street": lambda: T.clean_street(c("street"))}, {"street": f"CASE WHEN trim(street) <> '' AND {q_squeeze(q_sub('lower(trim(street))', '[.,]'))} NOT IN ({', '.join(repr(v) for v in T.VAGUE_STREETS)}) THEN trim(street) END"})
register("T8_clean_city", "v_raw", "k", {"city": lambda: T.clean_city(F.concat_ws(", ", c("city"), F.concat_ws(" ", "postcode", "city")), c("postcode"))}, {"city": q_clean_city("(city || ', ' || postcode || ' ' || city)", "postcode")})
register("T9_normalize_category", "v_text", "k", {"category": lambda: T.normalize_category(c("text"))}, {"category": q_category("text")})
register("T10_normalize_indoor_outdoor", "v_text", "k", {"place": lambda: T.normalize_indoor_outdoor(c("text"))}, {"place": q_in_out(q_has("lower(text)", "inden|indoor", ""), q_has("lower(text)", "uden|outdoor", ""))})
register("T11_infer_indoor_outdoor", "v_text", "k", {"place": lambda: T.infer_indoor_outdoor(c("text"))}, {"place": q_in_out(q_has("text", Q_INDOOR), q_has("text", Q_OUTDOOR))})
register("T12_parse_is_free", "v_text", "k", {"free": lambda: T.parse_is_free(c("text"))}, {"free": f"CASE WHEN {q_has('lower(text)', r'gratis|fri entr|ingen entr|^0\s*(kr|,-)?$', '')} THEN true WHEN {q_has('text', r'\d', '')} THEN false END"})
register("T13_infer_is_free", "v_text", "k", {"free": lambda: T.infer_is_free(c("text"))}, {"free": q_free("text")})
register("T14_extract_stall_count", "v_text", "k", {"stalls": lambda: T.extract_stall_count_text(c("text"))}, {"stalls": q_stalls("text")})
register("T15_parse_stall_count", "v_raw", "k", {"stalls": lambda: T.parse_stall_count(c("stall_count_text"))}, {"stalls": r"CAST(nullif(regexp_extract(stall_count_text, '\d{1,4}'), '') AS INT)"})
register("T16_extract_postcode", "documents", "doc_id", {"postcode": lambda: T.extract_postcode(c("text"))}, {"postcode": q_postcode("text")})
register("T17_search_fold", "documents", "doc_id", {"value": lambda: F.md5(T.search_fold(c("text")))}, {"value": f"md5({q_folds('text')})"})
register("T18_fold_for_search", "documents", "doc_id", {"value": lambda: F.md5(T.fold_for_search(c("text")))}, {"value": f"md5({q_fold('text')})"})
register("T19_strip_promo_cruft", "v_text", "k", {"title": lambda: T.strip_promo_cruft(c("text"))}, {"title": q_promo("text")})


def q_display(x: str) -> str:
    short = q_promo(x)
    letters = q_sub(f"({short})", "[^a-zA-ZæøåÆØÅ]", "")
    told = f"CASE WHEN length({letters}) >= 4 AND length({q_sub(letters, '[^A-ZÆØÅ]', '')}) / length({letters}) > 0.7 THEN lower({short}) ELSE {short} END"
    return f"CASE WHEN {q_has(f'({told})', '^[a-zæøå]', '')} THEN upper(substr({told}, 1, 1)) || substr({told}, 2) ELSE {told} END"


register("T20_display_title", "v_text", "k", {"title": lambda: T.display_title(c("text")), "place": lambda: T.display_place(c("text"))}, {"title": q_display("text"), "place": r"array_to_string(list_transform(string_split_regex(text, '\s+'), lambda w: CASE WHEN w <> '' THEN upper(substr(w, 1, 1)) || substr(w, 2) ELSE w END), ' ')"})
_s = f"substr({_n}, 1, 154)"
_e = f"(length({_s}) - instr(reverse({_s}), ' '))"
register("T21_truncate_at_word", "documents", "doc_id", {"snippet": lambda: T.truncate_at_word(c("text"))}, {"snippet": f"CASE WHEN length({_n}) <= 155 THEN {_n} ELSE " + q_sub(f"CASE WHEN instr({_s}, ' ') > 0 AND {_e} > 93 THEN substr({_s}, 1, {_e}) ELSE {_s} END", "[.,;:!?–-]+$", "", "") + " || '…' END"})
_h = q_sub(q_sub(q_sub("html", r"<br\s*/?>", "' || chr(10) || '", "gi"), r"</p>", "' || chr(10) || chr(10) || '", "gi"), r"<[^>]+>", "")
for _i in T.NUMERIC:
    _h = f"replace({_h}, '&#{_i};', chr({_i}))"
_h = q_swap(_h, ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "''"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"))
register("T22_strip_html", "pages", "page_id", {"value": lambda: F.md5(T.strip_html(c("html"))), "n": lambda: F.length(T.strip_html(c("html")))}, {"value": f"md5({q_sub(q_sub(q_sub(_h, '[ \t]+'), r'\n{3,}', chr(39) + ' || chr(10) || chr(10) || ' + chr(39)), r'^\s+|\s+$', '')})", "n": f"length({q_sub(q_sub(q_sub(_h, '[ \t]+'), r'\n{3,}', chr(39) + ' || chr(10) || chr(10) || ' + chr(39)), r'^\s+|\s+$', '')})"})
_a = q_sub("(street || ', ' || postcode || ' ' || city || ', Danmark')", r",?\s*(Danmark|Denmark)\s*", "", "gi")
_ps = f"list_filter(list_transform(string_split({_a}, ','), lambda p: trim(p)), lambda p: p <> '')"
_tw = rf"list_filter(list_transform(list_slice({_ps}, 2, 100), lambda p: trim(regexp_replace(p, '\b[1-9]\d{{3}}\b', ''))), lambda t: t <> '' AND length(t) <= 40 AND regexp_matches(t, '^[a-zA-ZæøåÆØÅé.\- ]+$') AND NOT regexp_matches(t, '^(på|ved|i|bag)\s', 'i'))"
register("T23_parse_address", "v_raw", "k", {n: (lambda n=n: T.parse_address(F.concat(c("street"), F.lit(", "), c("postcode"), F.lit(" "), c("city"), F.lit(", Danmark")))[n]) for n in ("street", "postcode", "city")}, {"street": f"({_ps})[1]", "postcode": q_postcode(_a), "city": f"({_tw})[1]"})
register("T24_normalize_phone", "v_places", "id", {"phone": lambda: T.normalize_phone(c("phone"))}, {"phone": q_phone("phone")})
register("T25_normalize_profile_url", "v_places", "id", {"profile": lambda: T.normalize_profile_url(c("profile_url"))}, {"profile": q_profile("profile_url")})
register("T26_fold_name", "v_places", "id", {"name": lambda: T.fold_name(c("name")), "street": lambda: T.normalize_street(c("street")), "tokens": lambda: F.array_join(T.distinctive_tokens(c("name")), " ")}, {"name": q_title("name"), "street": q_street("street"), "tokens": f"coalesce(array_to_string({q_tokens('name')}, ' '), '')"})
register("T27_normalize_domain", "pages", "page_id", {"domain": lambda: T.normalize_domain(c("url"))}, {"domain": q_domain("url")})
_ends = "|".join(s.replace(".", r"\.") for s in T.EXCLUDED_SUFFIXES)
register("T28_is_excluded_domain", "pages", "page_id", {"excluded": lambda: T.is_excluded_domain(T.normalize_domain(c("url")), ["blog.tiontion.example.com"])}, {"excluded": f"{q_domain('url')} = 'blog.tiontion.example.com' OR {q_has(q_domain('url'), rf'(^|\.)({_ends})$', '')}"})
register("T31_content_hash", "orders", "o_orderkey", {"hash": lambda: T.content_hash(F.concat_ws("|", "o_orderkey", "o_orderstatus", "o_orderpriority"))}, {"hash": "substr(sha256(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority), 1, 24)"})
# A town in the form that feeds give it, so that some pass and some don't.
_city = "CASE CAST(k % 5 AS INT) WHEN 0 THEN 'Odense' WHEN 1 THEN 'Fyens Stiftstidende' WHEN 2 THEN 'hilsen' WHEN 3 THEN 'Nykøbing Falster' ELSE 'Husk' END"
_ok = f"coalesce({q_has(f'({_city})', T.CITY_OK, '')} AND NOT {q_has(f'({_city})', T.CITY_BAD[4:])} AND NOT {q_has(f'({_city})', T.CITY_PROSE[4:])} AND NOT {q_has('postcode', '^20(1[9]|2[0-9]|3[0-5])$', '')}, false)"
_noise = T.STREET_NOISE[5:].replace(T.W0, r"\b").replace(T.W1, r"\b")
register(
    "T33_sanitize_feed_location", "v_raw", "k",
    {n: (lambda n=n: T.sanitize_feed_location(c("street"), c("postcode"), F.expr(_city))[n]) for n in ("street", "postcode", "city")},
    {"street": f"CASE WHEN NOT {q_has('street', _noise)} THEN street END", "postcode": f"CASE WHEN {_ok} THEN postcode END", "city": f"CASE WHEN {_ok} THEN {_city} END"},
)
register("T34_looks_like_market", "v_text", "k", {"market": lambda: T.looks_like_market(c("text"))}, {"market": q_has("text", "loppe|kr(?:æ|ae)mmer|genbrug|bagagerum|antik|julemarked|flea|marked")})
register("T36_base_label", "v_raw", "k", {"base": lambda: T.base_label(c("city")), "slug": lambda: T.slugify_city(c("city"))}, {"base": q_base("city"), "slug": f"substr(replace({q_title('city')}, ' ', '-'), 1, 60)"})
register("T37_clean_listing_text", "v_text", "k", {"title": lambda: T.clean_listing_text(F.concat(c("text"), F.lit(" – Aflyst!")))}, {"title": f"trim({q_sub(chr(40) + 'text || ' + chr(39) + ' – Aflyst!' + chr(39) + chr(41), r'\s*[-–—]\s*aflyst\s*!?\s*$', '', 'i')})"})
register("T38_geocode_quality", "v_raw", "k", {"approximate": lambda: T.is_approximate_geocode(c("geocode_quality")), "precise": lambda: T.is_precise(c("geocode_quality"))}, {"approximate": "geocode_quality NOT IN ('source', 'A', 'B')", "precise": "geocode_quality NOT IN ('P', 'C')"})
register("T39_normalize_exonym", "v_raw", "k", {"city": lambda: T.normalize_exonym(F.concat(F.lit("Copenhagen "), c("city"), F.lit(" elsinore")))}, {"city": q_forms("('Copenhagen ' || city || ' elsinore')")})
register("T41_safe_external_url", "pages", "page_id", {"url": lambda: T.safe_external_url(c("url"))["url"], "label": lambda: T.safe_external_url(c("url"))["label"]}, {"url": "CASE WHEN regexp_matches(url, '^https?://', 'i') THEN url END", "label": r"regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1, 'i')), '^www\.', '')"})
