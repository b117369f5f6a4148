"""Classification of posts by phrase tables: what kind of announcement a text is. Texts are folded to ASCII first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from localmarkets.functions.dates import let

E = r"(?<![A-Za-z0-9_])"
Z = r"(?![A-Za-z0-9_])"

# Phrases (ASCII spelling) and what they say.
HABIT = {
    "aabner laden|aabner vi laden": "opens the barn", "nye ting i laden|nyt i laden": "news in the barn", "flaget er ude|naar flaget er ude": "flag is out",
    "vi holder aabent igen|aabent igen": "open again", "aabent paa gaarden|gaardsalg": "open at the farm", "lopper i garagen|garagesalg": "garage",
    "selvbetjent.{0,20} (?:loppeskur|skur|bod)|loppeskur": "self-service shed", "loppelade|lade.{0,15} lopper": "flea barn", "aaben hal|privat hal": "open hall",
    "loppesalg paa adressen": "sale at the address", "stort privat loppesalg|privat loppesalg": "private sale", "kom og goer et kup": "make a bargain", "samlersalg": "collectors",
}
RECURRING = {
    "hver (?:mandag|tirsdag|onsdag|torsdag|fredag|loerdag|soendag)": "every weekday", "hver weekend|alle weekender": "every weekend", "hver anden": "every other",
    "(?:foerste|sidste) (?:loerdag|soendag)": "day of the month", "aabent igen|igen i aar|som altid": "again", "hele sommeren|hele sa?sonen|hele saesonen": "all season", "fast.{0,10} aabningstid": "fixed hours",
}
ONE_OFF = {
    "alt skal vaek": "all must go", "flyttesalg": "moving", "oprydningssalg": "clearance", "bohave saelges|indbo saelges": "household", "sidste (?:chance|dag|gang)": "last chance",
    "lukker|ophoerssalg": "closing", "kun i dag|kun paa loerdag|enkelt dag": "one day",
}
ESTATE = {"doedsbo|rydder doedsbo|doedsbosalg": "estate", "afdoedes?": "deceased"}
CLUB = {"forening|forenings(?:loppe|marked|salg)": "club", "spejder|menighed|kirke|borgerforening": "church or club", "stoetter.{0,20} (?:projekt|forening|klub)": "supports a cause"}
TRADE = {
    "antikvitetshandel|antikhandel|galleri": "antiques trade", "webshop|netbutik|online shop": "web shop", "cvr|momsregistreret|firma": "company", "kurateret|noeje udvalgt": "curated",
    "vi tilbyder vurdering|vurdering af doedsbo": "appraisal",
}
SHOP = {"genbrugsbutik|genbrugs butik": "second-hand shop", "roede kors|kirkens korshaer|blaa kors|frelsens haer": "charity", "aabningstider.{0,40} man(?:dag)?.{0,40} fre(?:dag)?": "weekday hours"}
MARKET = {
    "kraemmermarked|stadeplads|stadeleje": "stalls", "bagagerumsmarked": "car boot", "loppemarked i.{0,30} (?:hallen|centret|idraetscenter|arena)": "in a hall", "entre.{0,15} kr": "entry fee",
    "loppemarked (?:paa|i|ved).{0,24} (?:torv|torvet|pladsen|havn|gymnasium|skole|hallen|stage)": "public place",
}
NOISE = {
    "kraemmere soeges|stadeholdere soeges": "seeks sellers", "soeges|koebes|efterlyses": "seeks", "tak for i dag|tak for et godt marked": "thanks", "husk vores sidste": "looks back", "gratis.{0,15} afhentning": "free pick-up",
}
FLEA = rf"{E}loppe|{E}kraemmer|{E}genbrug|{E}antik|{E}brugte?{Z}|{E}bohave{Z}|{E}indbo{Z}|{E}samler|{E}doedsbo|{E}retro{Z}|{E}vintage{Z}"
KINDS = [("estate|deceased", "doedsbo"), ("barn", "loppelade"), ("farm", "gaardsalg"), ("garage", "garagesalg"), ("shed", "loppeskur"), ("hall", "privat-hal"), ("club|church", "foreningsloppe")]


def fold(c: Column) -> Column:
    for old, new in (("æ", "ae"), ("ø", "oe"), ("å", "aa"), ("é", "e")):
        c = F.replace(F.lower(c) if old == "æ" else c, F.lit(old), F.lit(new))
    return c


def hits(t: Column, table: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(t.rlike(f"{E}(?:{p}){Z}"), says) for p, says in table.items()]))


def is_corpus_candidate(c: Column) -> Column:
    t = fold(c)
    return F.coalesce(t.rlike(FLEA) | (F.size(hits(t, HABIT)) > 0) | (F.size(hits(t, ESTATE)) > 0) | (F.size(hits(t, CLUB)) > 0), F.lit(False))


def classify_post(c: Column) -> Column:
    """struct(label, confidence, place_type, evidence, needs_review); doubt goes to the cautious label."""
    tables = {"habit": HABIT, "recurring": RECURRING, "one_off": ONE_OFF, "estate": ESTATE, "club": CLUB, "trade": TRADE, "shop": SHOP, "market": MARKET, "noise": NOISE}

    def told(x: Column) -> Column:
        some = {n: F.size(x[n]) > 0 for n in tables}
        none = F.lit(None).cast("string")
        empty = F.array().cast("array<string>")
        out = lambda label, conf, place=none, evidence=empty, review=False: F.struct(
            (F.lit(label) if isinstance(label, str) else label).alias("label"), (F.lit(conf) if isinstance(conf, float) else conf).alias("confidence"), (F.lit(place) if isinstance(place, str) else place).alias("place_type"),
            evidence.alias("evidence"), (F.lit(review) if isinstance(review, bool) else review).alias("needs_review"))
        blob = F.array_join(F.concat(x["habit"], x["recurring"]), " ")
        kind = F.lit("privat-saelger")
        for pattern, name in reversed(KINDS):
            kind = F.when(blob.rlike(pattern), name).otherwise(kind)
        flea = x["text"].rlike(FLEA) | some["habit"] | some["estate"]
        event = x["text"].rlike(rf"{E}(interested|going|went|share){Z}") & x["text"].rlike(rf"{E}(mon|tue|wed|thu|fri|sat|sun),?\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec){Z}")
        moving = F.when(x["text"].rlike("flyttesalg"), "flyttesalg").otherwise("enkeltstaaende_privatsalg")
        return (
            F.when(~F.coalesce(flea, F.lit(False)), out("irrelevant", 0.9, evidence=F.array(F.lit("no market words"))))
            .when(some["noise"] & ~some["habit"], out("irrelevant", 0.75, evidence=x["noise"]))
            .when(F.size(x["trade"]) >= 2, out("professionel_antikhandel", 0.8, evidence=x["trade"]))
            .when(some["shop"] & ~some["habit"], out("fast_genbrugssted", 0.75, evidence=x["shop"]))
            .when(event & ~some["habit"], out("loppemarked", 0.7, evidence=F.array(F.lit("public event with a date"))))
            .when(some["market"] & ~some["habit"], out("loppemarked", 0.7, evidence=x["market"]))
            .when(some["club"] & ~some["habit"], out("foreningsmarked", 0.6, "foreningsloppe", x["club"], True))
            .when(some["estate"] & (some["recurring"] | some["habit"]), out("informal_place", 0.7, "doedsbo", F.concat(x["estate"], x["habit"], x["recurring"], x["one_off"]), True))
            .when(some["estate"], out("doedsbosalg", 0.75, evidence=F.concat(x["estate"], x["one_off"])))
            .when(some["one_off"] & ~some["recurring"], out(moving, 0.75, evidence=x["one_off"]))
            .when(some["habit"], out("informal_place", F.when(some["recurring"], 0.8).otherwise(0.55), kind, F.concat(x["habit"], x["recurring"]), ~some["recurring"]))
            .otherwise(out("kraever_review", 0.3, evidence=F.array(F.lit("market words, unclear")), review=True))
        )

    t = fold(F.coalesce(c, F.lit("")))
    return let(F.struct(t.alias("text"), *[hits(t, v).alias(n) for n, v in tables.items()]), told)
