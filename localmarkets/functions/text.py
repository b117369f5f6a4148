"""Text normalisation as Column expressions. Null in, null out unless said otherwise; nothing here runs Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII word edges; Java's own \b follows Unicode letters.
W0, W1 = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def sub(c: Column, pattern: str, by: str = " ") -> Column:
    return F.regexp_replace(c, pattern, by)


def swap(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze(c: Column) -> Column:
    return F.trim(sub(c, r"\s+"))


def normalize_title(c: Column) -> Column:
    """Lower case, Danish letters spelled out, everything else to single spaces."""
    return squeeze(sub(swap(F.lower(c), ("æ", "ae"), ("ø", "oe"), ("å", "aa")), "[^a-z0-9 ]+"))


def slugify(c: Column) -> Column:
    return F.substring(F.replace(normalize_title(c), F.lit(" "), F.lit("-")), 1, 80)


def slugify_city(c: Column) -> Column:
    return F.substring(F.replace(normalize_title(c), F.lit(" "), F.lit("-")), 1, 60)


def title_signals_cancelled(c: Column) -> Column:
    """Whether a title says that the market is called off; false for null."""
    said = c.rlike(rf"(?i){W0}(aflyst|aflyses|cancelled|canceled){W1}") & ~c.rlike(rf"(?i){W0}aflys[a-z0-9_]*\s+ikke{W1}")
    return F.coalesce(said, F.lit(False))


# Danish month names and their abbreviations, longest first, and weekdays.
MONTHS = "januar|februar|marts|april|maj|juni|juli|august|september|oktober|november|december|jan|feb|mar|apr|jun|jul|aug|sept|sep|okt|nov|dec"
WEEKDAYS = "mandag|tirsdag|onsdag|torsdag|fredag|l(?:ø|oe)rdag|s(?:ø|oe)ndag"


def title_has_date_tokens(c: Column) -> Column:
    return c.rlike(rf"(?iu){W0}(?:{WEEKDAYS}|{MONTHS}){W1}|{W0}d\.\s*\d|\d{{1,2}}[./-]\d{{1,2}}|{W0}(?:19|20)\d{{2}}{W1}")


# What is taken out of a dated title, in this order.
DATE_PARTS = [
    rf"(?iu){W0}kl\.?\s*\d{{1,2}}(?:[.:]\d{{2}})?\s*[-–]\s*\d{{1,2}}(?:[.:]\d{{2}})?",
    rf"(?iu){W0}(?:den|d)\.?\s*\d{{1,2}}\.?\s*(?:{MONTHS})(?:\s*\d{{4}})?",
    rf"(?iu){W0}\d{{1,2}}\.?\s*(?:{MONTHS})(?:\s*\d{{4}})?",
    rf"{W0}\d{{1,2}}[./-]\d{{1,2}}(?:[./-]\d{{2,4}})?{W1}",
    rf"(?iu){W0}(?:{WEEKDAYS})e?{W1}",
    rf"{W0}20\d{{2}}{W1}",
    rf"(?i){W0}d\.\s*",
]


def strip_date_tokens(c: Column) -> Column:
    """The title without dates and times; as it was if fewer than three characters would be left."""
    s = c
    for p in DATE_PARTS:
        s = sub(s, p)
    s = sub(sub(sub(s, r"\(\s*\)"), r"\s{2,}"), r"\s+([,.])", "$1")
    s = F.trim(sub(sub(s, r"[\s,–-]+$", ""), r"^[\s,–-]+", ""))
    return F.when(~title_has_date_tokens(c), c).otherwise(F.when(F.length(s) >= 3, s).otherwise(c))


def normalize_title_for_match(c: Column) -> Column:
    return normalize_title(strip_date_tokens(c))


def clean_venue_name(c: Column) -> Column:
    bad = lambda n: (n == "") | (F.length(n) > 80) | n.rlike(r"[.!?]\s+\S") | n.rlike("(?iu)^(på |ved |se )?adressen:?$")
    return let(squeeze(c), lambda n: F.when(~bad(n), n))


# Phrases that stand where a street belongs.
VAGUE_STREETS = [
    "byens gader", "byens gade", "hele byen", "i hele byen", "rundt i byen", "flere steder", "flere steder i byen",
    "diverse", "diverse steder", "forskellige steder", "hele området", "ingen adresse",
]


def clean_street(c: Column) -> Column:
    s = F.trim(c)
    plain = squeeze(sub(F.lower(s), "[.,]"))
    return F.when((s != "") & ~plain.isin(VAGUE_STREETS), s)


# Foreign and mangled names of Danish cities.
CITY_FORMS = [
    (rf"(?i){W0}copenhagen{W1}", "København"), (rf"(?i){W0}kobenhavn{W1}", "København"), (rf"(?i)^kbh\.?{W1}", "København"),
    (rf"(?i){W0}elsinore{W1}", "Helsingør"), (rf"(?i){W0}arhus{W1}", "Aarhus"),
]


def clean_city(city: Column, postcode: Column) -> Column:
    """One town name out of a field with repeated addresses; null if nothing is left."""
    parts = F.array_distinct(F.filter(F.transform(F.split(city, ","), lambda p: F.trim(p)), lambda s: s != ""))
    own = lambda p: F.filter(p, lambda s: F.coalesce(s.startswith(postcode), F.lit(False)))
    pick = let(parts, lambda p: F.coalesce(F.try_element_at(own(p), F.lit(1)), F.try_element_at(p, F.lit(-1))))
    out = sub(pick, r"^[1-9]\d{3}\s+(.+)$", "$1")
    out = F.trim(sub(sub(out, r"(?iu)\s+på\s+.+$", ""), r"\.\s*$", ""))
    for pattern, name in CITY_FORMS:
        out = sub(out, pattern, name)
    return let(F.trim(out), lambda x: F.when(x != "", x))


def normalize_exonym(c: Column) -> Column:
    for pattern, name in CITY_FORMS:
        c = sub(c, pattern, name)
    return c


# Category patterns, the first that is found decides.
CATEGORIES = [
    (r"(?i)(?<!h)jule|(^|\s)jul(?=$|\s|e)|christmas", "julemarked"),
    (r"bagagerum|car ?boot", "bagagerumsmarked"),
    (r"antik|antique", "antikmarked"),
    (r"kr(æ|ae)mmer", "kraemmermarked"),
    (r"genbrugsmarked|genbrugssalg|genbrugsbutik|second ?hand|charity", "genbrugsmarked"),
    (r"gade/vej|gadeloppe|vejloppe|g(å|aa)rdloppe|byloppe|gadesalg|garage", "byloppemarked"),
    (r"loppe|flea|vintage", "loppemarked"),
]


def normalize_category(c: Column) -> Column:
    low, out = F.lower(c), F.lit("andet")
    for pattern, name in reversed(CATEGORIES):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def _in_out(inside: Column, outside: Column) -> Column:
    inside, outside = F.coalesce(inside, F.lit(False)), F.coalesce(outside, F.lit(False))
    return F.when(inside & outside, "mixed").when(inside, "indoor").when(outside, "outdoor").otherwise("unknown")


def normalize_indoor_outdoor(c: Column) -> Column:
    low = F.lower(c)
    return _in_out(low.rlike("inden|indoor"), low.rlike("uden|outdoor"))


# Words of prose that name an indoor or an outdoor place.
INDOOR = rf"(?iu)indend(?:ø|o)rs|indoor|{W0}[A-Za-z0-9_]*hallen{W1}|{W0}idr(?:æ|ae)tshal[A-Za-z0-9_]*{W1}|{W0}sportshal[A-Za-z0-9_]*{W1}|{W0}ridehal[A-Za-z0-9_]*{W1}|{W0}ridehus{W1}|{W0}arena{W1}|forsamlingshus|kulturhus|medborgerhus|sogneg(?:å|aa)rd"
OUTDOOR = rf"(?iu)udend(?:ø|o)rs|outdoor|friluft|(?:å|aa)ben himmel|{W0}i det fri{W1}|cirkusplads|dyrskueplads|{W0}festplads|boldbane"


def infer_indoor_outdoor(c: Column) -> Column:
    return _in_out(c.rlike(INDOOR), c.rlike(OUTDOOR))


def parse_is_free(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.rlike(r"gratis|fri entr|ingen entr|^0\s*(kr|,-)?$"), True).when(low.rlike(r"\d"), False)


# Free and paid entry in prose.
FREE_ENTRY = rf"(?iu)(?:gratis|fri)\s+(?:adgang|entr(?:é|e|ee)|indgang)|(?:adgang|entr(?:é|e|ee)|indgang)\s*:?\s*(?:gratis|fri){W1}|ingen\s+entr(?:é|e|ee)"
PAID_ENTRY = r"(?iu)(?:entr(?:é|e|ee)|billet|voksne)[^0-9]{0,12}\d{1,4}\s*(?:kr|,-|dkk)"


def infer_is_free(c: Column) -> Column:
    free, paid = c.rlike(FREE_ENTRY), c.rlike(PAID_ENTRY)
    return F.when(free != paid, free)


#: Number, optional second number, stall noun (fixed values).
STALLS = rf"(?iu)(?:ca\.?\s*|over\s*|mere\s+end\s*|op\s+til\s*)?(\d{{1,4}})(?:\s*[-–til]+\s*(\d{{1,4}}))?\s+(stadepladser|standpladser|stader|stande|boder|kr(?:æ|ae)mmere|udstillere){W1}"


def extract_stall_count_text(c: Column) -> Column:
    low, high, noun = (F.regexp_extract(c, STALLS, i) for i in (1, 2, 3))
    n = F.nullif(low, F.lit("")).cast("int")
    text = F.when(high != "", F.concat(low, F.lit("–"), high)).otherwise(low)
    return F.when(n.between(3, 5000), F.concat(text, F.lit(" "), F.lower(noun)))


def parse_stall_count(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\d{1,4}", 0), F.lit("")).cast("int")


def extract_postcode(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, rf"{W0}([1-9]\d{{3}}){W1}", 1), F.lit(""))


def search_fold(c: Column) -> Column:
    """Both spellings of the Danish letters, one after the other."""
    low = swap(F.lower(c), ("æ", "ae"))
    return F.concat_ws(" ", swap(low, ("ø", "oe"), ("å", "aa")), swap(low, ("ø", "o"), ("å", "a")))


def fold_for_search(c: Column) -> Column:
    return swap(F.lower(c), ("æ", "ae"), ("ø", "o"), ("å", "a"), ("oe", "o"), ("aa", "a"))


def strip_promo_cruft(c: Column) -> Column:
    s = sub(c, r"(?i)\s*\(\s*(?:kun\s+)?for\s+privat[e]?\s*\)")
    s = sub(s, rf"(?iu)\s*[·,–-]?\s*\d{{1,2}}\.?\s*s(?:æ|ae)son{W1}.*$")
    s = sub(s, r"(?i)\s+(?:kun\s+for\s+)?privat[e]?\s*$")
    s = F.trim(sub(sub(s, r"\s{2,}"), r"[\s,·–-]+$", ""))
    return let(s, lambda x: F.when(F.length(x) >= 3, x).otherwise(c))


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def display_title(c: Column) -> Column:
    def shouted(letters: Column) -> Column:
        return (F.length(letters) >= 4) & (F.length(sub(letters, "[^A-ZÆØÅ]", "")) / F.length(letters) > 0.7)

    def plain(t: Column) -> Column:
        return F.when(let(sub(t, "[^a-zA-ZæøåÆØÅ]", ""), shouted), F.lower(t)).otherwise(t)

    # The letters that may begin the title are few: their capitals need no rules of all scripts.
    small = "abcdefghijklmnopqrstuvwxyzæøå"
    capital = lambda t: F.concat(F.translate(F.substring(t, 1, 1), small, small.upper()), F.substr(t, F.lit(2)))
    return let(let(strip_promo_cruft(c), plain), lambda t: F.when(t.rlike("^[a-zæøå]"), capital(t)).otherwise(t))


def display_place(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, r"\s+"), lambda w: F.when(w != "", _capital(w)).otherwise(w)), " ")


def truncate_at_word(c: Column, most: int = 155) -> Column:
    """At most ``most`` characters, cut at a word where one ends past 60 %, with an ellipsis."""
    clean = squeeze(c)
    head = F.substring(clean, 1, most - 1)
    space = F.length(head) - F.locate(" ", F.reverse(head))  # characters before the last space
    cut = F.when((F.locate(" ", head) > 0) & (space > most * 0.6), F.substr(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(sub(cut, r"[.,;:!?–-]+$", ""), F.lit("…")))


# Numeric entities that are decoded, with the named ones below.
NUMERIC = (38, 39, 160, 176, 230, 248, 229, 198, 216, 197, 233, 8211, 8212, 8216, 8217, 8220, 8221, 8230)


def decode_entities(c: Column) -> Column:
    for number in NUMERIC:
        c = F.replace(c, F.lit(f"&#{number};"), F.lit(chr(number)))
    return swap(c, ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"))


def strip_html(c: Column) -> Column:
    """Line breaks for br and closing p, no other tags, entities decoded, blanks squeezed."""
    t = sub(sub(sub(c, r"(?i)<br\s*/?>", "\n"), r"(?i)</p>", "\n\n"), r"<[^>]+>", "")
    return sub(sub(sub(decode_entities(t), r"[ \t]+"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def parse_address(c: Column) -> Column:
    """struct(street, postcode, city) of "street, 1234 town, country". Four figures that end the street are its number, no postcode."""
    clean = sub(decode_entities(c), r"(?i),?\s*(Danmark|Denmark)\s*", "")
    parts = F.array_distinct(F.filter(F.transform(F.split(clean, ","), lambda p: F.trim(p)), lambda p: p != ""))
    towns = F.transform(F.slice(parts, 2, 100), lambda p: F.trim(F.regexp_replace(p, rf"^(.*?){W0}[1-9]\d{{3}}{W1}", "$1")))
    towns = F.filter(towns, lambda t: (t != "") & (F.length(t) <= 40) & t.rlike(r"^[a-zA-ZæøåÆØÅé.\- ]+$") & ~t.rlike(r"(?iu)^(på|ved|i|bag)\s"))
    street, rest = F.try_element_at(parts, F.lit(1)), F.array_join(F.slice(parts, 2, 100), ", ")
    postcode = F.coalesce(extract_postcode(rest), extract_postcode(F.when(F.size(parts) > 1, F.regexp_replace(street, r"\d{4}$", "")).otherwise(clean)))
    return F.struct(street.alias("street"), postcode.alias("postcode"), F.try_element_at(towns, F.lit(1)).alias("city"))


def normalize_phone(c: Column) -> Column:
    """45 and eight digits; null for what can't be a Danish subscriber's number."""
    d = sub(sub(sub(c, r"[^\d+]", ""), r"^\+", ""), "^0045", "45")
    d = F.when(F.length(d) == 8, F.concat(F.lit("45"), d)).otherwise(d)
    own = F.substr(d, F.lit(3))
    ok = (F.length(d) == 10) & d.startswith("45") & ~own.rlike("^[01]") & ~own.rlike(r"^(\d)\1{7}$") & (own != "12345678")
    return F.when(ok, d)


def normalize_profile_url(c: Column) -> Column:
    """group:, profile: or page: key of a social-network address; null for posts and other hosts."""
    url = F.when(c.startswith("http"), c).otherwise(F.concat(F.lit("https://"), c))
    host = F.lower(F.regexp_extract(url, r"^https?://(?:[^/@]*@)?([^/:?#]+)", 1))
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    group = F.regexp_extract(path, r"/groups/([^/]+)", 1)
    ident = F.regexp_extract(url, r"[?&]id=([^&#]+)", 1)
    first = F.regexp_extract(path, r"^/+([^/]+)", 1)
    page = F.when((first != "") & ~first.isin("posts", "permalink", "photo", "events", "marketplace", "story.php"), F.concat(F.lit("page:"), F.lower(first)))
    key = F.when(group != "", F.concat(F.lit("group:"), F.lower(group))).when(ident != "", F.concat(F.lit("profile:"), ident)).otherwise(page)
    return F.when(host.rlike(r"(^|\.)facebook\.com$|(^|\.)fb\.com$"), key)


def fold_name(c: Column) -> Column:
    return normalize_title(c)


def normalize_street(c: Column) -> Column:
    s = sub(fold_name(c), rf"^(.*?)\s+(\d+)\s*([a-z]){W1}", "$1 $2$3")
    return F.when((F.length(s) >= 4) & s.rlike(r"\d"), s)


# Words that name no place.
GENERIC_NAMES = [
    "loppemarked", "loppe", "lopper", "marked", "kraemmermarked", "genbrug", "salg", "privat", "gaardsalg", "garagesalg",
    "lade", "loppelade", "stort", "lille", "aabent", "nyt", "gamle", "den", "det", "og", "paa", "i", "ved",
]


def distinctive_tokens(c: Column) -> Column:
    return F.filter(F.split(fold_name(c), " "), lambda t: (F.length(t) >= 3) & ~t.isin(GENERIC_NAMES))


def normalize_domain(c: Column) -> Column:
    """Lower-case host without www; null unless it is a dotted ASCII host."""
    url = sub(F.trim(c), r"[.,;:!?)\]]+$", "")
    url = F.when(url.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), url).otherwise(F.concat(F.lit("http://"), url))
    host = sub(F.lower(F.regexp_extract(url, r"^[^:/?#]+://(?:[^/?#@]*@)?([^/:?#]*)", 1)), r"^www\.", "")
    return F.when(host.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"), host)


# Hosts that are never a source.
EXCLUDED_SUFFIXES = [
    "facebook.com", "fb.com", "fb.me", "messenger.com", "instagram.com", "linkedin.com", "tiktok.com", "x.com", "twitter.com", "youtube.com",
    "youtu.be", "billetto.dk", "billetto.com", "billetsalg.dk", "billetten.dk", "safeticket.dk", "place2book.com", "nemtilmeld.dk",
    "eventbrite.com", "eventbrite.dk", "ticketmaster.dk", "google.com", "goo.gl", "forms.gle", "bit.ly", "kortlink.dk", "mobilepay.dk",
]


def is_excluded_domain(domain: Column, own: list[str]) -> Column:
    ends = "|".join(s.replace(".", r"\.") for s in EXCLUDED_SUFFIXES)
    return domain.isin(own) | domain.rlike(rf"(^|\.)({ends})$")


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 24)


def stable_id(c: Column) -> Column:
    """An id that depends on the text alone."""
    return F.xxhash64(c)


def looks_like_market(c: Column) -> Column:
    return c.rlike(r"(?iu)loppe|kr(?:æ|ae)mmer|genbrug|bagagerum|antik|julemarked|flea|marked")


# Postal-district tokens after a town's name.
DISTRICTS = "C|K|M|N|S|V|Ø|NV|SV|SØ|NØ|Sj|F|J"


def base_label(c: Column) -> Column:
    t = F.trim(c)
    words = F.split(t, r"\s+")
    last = F.element_at(words, -1)
    return F.when((F.size(words) >= 2) & last.isin(DISTRICTS.split("|")), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")).otherwise(t)


def clean_listing_text(c: Column) -> Column:
    """A title without its trailing mark of cancellation."""
    return F.trim(sub(c, r"(?i)\s*[-–—]\s*aflyst\s*!?\s*$", ""))


def is_approximate_geocode(c: Column) -> Column:
    return F.coalesce(~c.isin("source", "A", "B"), F.lit(False))


def is_precise(c: Column) -> Column:
    return F.coalesce(~c.isin("P", "C"), F.lit(True))


def safe_external_url(c: Column) -> Column:
    """struct(url, label) of an http or https address; null for any other scheme."""
    url = F.when(c.rlike(r"(?i)^https?://"), c).otherwise(F.when(~c.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.concat(F.lit("https://"), c)))
    host = sub(F.lower(F.regexp_extract(url, r"(?i)^https?://([^/:?#]+)", 1)), r"^www\.", "")
    return F.when(host.rlike(r"\."), F.struct(url.alias("url"), host.alias("label")))


# Months and dates where a street was expected, and words that aren't a town.
STREET_NOISE = rf"(?iu){W0}(?:mandag|tirsdag|onsdag|torsdag|fredag|lørdag|søndag){W1}|{W0}den{W1}|{W0}d\.\s*\d|{W0}kl\.?\s*\d|{W0}\d{{4}}{W1}|{W0}(?:januar|februar|marts|april|maj|juni|juli|august|september|oktober|november|december){W1}|(?:loppe|kr(?:æ|ae)mmer|genbrug|bazar|grundlovs|byfest|marked)"
CITY_OK = r"^[A-ZÆØÅ][a-zæøåé]+(?:[ -][A-ZÆØÅa-zæøå]+){0,2}$"
CITY_BAD = r"(?i)stiftstidende|avis|posten|tidende|nyheder|facebook"
CITY_PROSE = r"(?i)^(?:mvh|hilsen|hilsner|tak|fra|til|med|kl|kun|husk|nyt|se|kom|ring|sms|pris|priser|gratis|salg|stande|stadeplads|program|arrangeret|kontakt|info|alle|vi|du|der|og|samt|osv|mm|ca|ps|obs)$"


def sanitize_feed_location(street: Column, postcode: Column, city: Column) -> Column:
    """struct(street, postcode, city): noisy streets go; postcode and town stay together or not at all."""
    town = F.coalesce(city.rlike(CITY_OK) & ~city.rlike(CITY_BAD) & ~F.trim(city).rlike(CITY_PROSE), F.lit(False))
    code = F.coalesce(~F.trim(postcode).rlike("^20(1[9]|2[0-9]|3[0-5])$"), F.lit(False))
    own = F.when(town & code, postcode)
    return F.struct(F.when(~street.rlike(STREET_NOISE), street).alias("street"), own.alias("postcode"), F.when(own.isNotNull(), city).alias("city"))


# What feeds and their readings put between the words of a post.
CHROME = [
    rf"(?i){W0}q?\s*search facebook{W1}", rf"(?i){W0}gruppen{W1}", rf"(?i){W0}public group{W1}", rf"(?i){W0}[\d.,]+\s*k?\s*members{W1}",
    rf"(?i){W0}(?:invite|ahout|about|discussion|people|media|files|joined){W1}", rf"(?i){W0}rising contributor{W1}", rf"(?iu){W0}[A-Za-zÆØÅæøå]+\s+\d{{1,2}}\s+at\s+\d{{1,2}}[:.]\d{{2}}\s*[ap]m{W1}",
    rf"(?i){W0}\d{{1,2}}[:.]\d{{2}}\s*[ap]m{W1}", r"(?:^|\s)[·•*]\s*-?\s*\d+(?=\s|$)", r"(?i)(?:^|\s)\d{1,2}\s*[hdwm](?=\s*[·•\-o*])", r"(?i)(?:^|\s)e?book(?=\s|$)", r"(?i)(?:^|\s)ook(?=\s)", rf"(?i)[·•]\s*share{W1}",
]


def strip_feed_chrome(text: Column) -> Column:
    """A post without the words and signs that a feed's page puts around it."""
    out = F.concat(F.lit(" "), text, F.lit(" "))
    for p in CHROME:
        out = sub(out, p)
    return F.trim(F.regexp_replace(squeeze(out), r"^[^\p{L}\p{N}]+", ""))


def code_label(code: Column, labels: list[tuple[int, int, str]], other: str = "unknown") -> Column:
    """The label of the range (first, last, label) that a code is in."""
    out = F.lit(other)
    for low, high, label in reversed(labels):
        out = F.when(code.between(low, high), label).otherwise(out)
    return out


# Labels of weather codes by range.
WEATHER = [(0, 0, "clear"), (1, 3, "clouds"), (45, 48, "fog"), (51, 67, "rain"), (71, 77, "snow"), (80, 82, "showers"), (95, 99, "thunder")]


def extract_postal_town(c: Column, but: tuple[str, ...] = ()) -> Column:
    """The first "1234 Town" of a page's text; years (20xx), ends of telephone numbers (555-1234) and the given ones (an address in the footer) are passed over."""
    found = F.regexp_extract_all(c, F.lit(rf"{W0}(?<!\d[-.])([1-9]\d{{3}} [A-ZÆØÅ][a-zæøå]+)"), F.lit(1))
    return F.try_element_at(F.filter(found, lambda x: ~x.startswith("20") & ~x.isin(*but)), F.lit(1))


def extract_phone(lines: Column) -> Column:
    """The digits of the first line that names a telephone: eight in pairs, six or more as they are, else null."""
    digits = F.regexp_replace(F.try_element_at(F.filter(lines, lambda x: x.rlike(r"(?i)tlf|tel")), F.lit(1)), "[^0-9]", "")
    return F.when(F.length(digits) == 8, F.trim(F.regexp_replace(digits, "(..)", "$1 "))).when(F.length(digits) >= 6, digits)
