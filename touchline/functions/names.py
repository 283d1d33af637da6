"""Names of teams and competitions: normal forms, similarities and generated aliases, on columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of names, by use, and the affixes, years and special aliases of seeding.
STOPWORDS_MATCH = ("fc", "sc", "sv", "ev", "afc", "bc", "cf", "sk", "fk", "club", "clube", "ac", "as", "ss")
STOPWORDS_DETECT = ("fc", "sc", "sv", "ev", "afc", "bc", "cf", "sk", "fk", "club", "clube", "de", "da", "do", "del")
STOPWORDS_RESOLVE = ("fc", "sc", "sv", "ev", "afc", "bc", "cf", "sk", "fk", "club", "clube", "de", "da", "do", "del", "der", "di", "ac", "as", "ss", "tsg", "vfl", "vfb", "rc")
STOPWORDS_COMPETITION = ("league", "liga", "division", "cup", "uefa", "soccer", "football", "the", "de", "la", "el")
PREFIXES = ("1 fc", "1 fsv", "fc", "afc", "cf", "rc", "acf", "gd", "us", "ssc", "sv", "sc", "fk", "sk", "tsg", "vfl", "vfb")
SUFFIXES = ("fc", "afc", "cf", "ac", "bc", "sk", "fk")
YEARS = r"\b(18|19|20)[0-9]{2}\b"
SPECIAL_ALIASES = {
    "fc internazionale milano": ["inter milan", "inter"],
    "internazionale milano": ["inter milan", "inter"],
    "athletic club": ["athletic bilbao"],
    "rc celta de vigo": ["celta vigo", "celta"],
    "real betis balompie": ["real betis"],
    "gd estoril praia": ["estoril"],
    "sporting clube de braga": ["braga", "sporting braga"],
    "acf fiorentina": ["fiorentina"],
    "us lecce": ["lecce"],
    "tsg 1899 hoffenheim": ["hoffenheim", "tsg hoffenheim"],
    "1 fc heidenheim 1846": ["heidenheim"],
    "1 fsv mainz 05": ["mainz 05", "fsv mainz 05", "mainz"],
    "fc st pauli 1910": ["st pauli", "fc st pauli"],
    "borussia monchengladbach": ["gladbach", "monchengladbach"],
    "bayer 04 leverkusen": ["bayer leverkusen", "leverkusen"],
    "sport lisboa e benfica": ["benfica"],
    "fc porto": ["porto"],
    "vitoria sc": ["vitoria guimaraes"],
    "fc famalicao": ["famalicao"],
    "sbv excelsior": ["excelsior"],
    "pec zwolle": ["zwolle", "fc zwolle"],
    "afc ajax": ["ajax"],
    "psv eindhoven": ["psv"],
    "fc twente enschede": ["twente", "fc twente 65"],
    "racing club de lens": ["rc lens", "lens"],
    "angers sco": ["angers"],
    "olympique lyonnais": ["lyon"],
    "olympique de marseille": ["marseille"],
    "stade rennais fc 1901": ["rennes"],
    "ogc nice": ["nice"],
    "rc strasbourg alsace": ["strasbourg"],
    "as monaco fc": ["monaco", "as monaco"],
    "le havre ac": ["le havre"],
    "sporting clube de portugal": ["sporting cp", "sporting", "sporting lisbon"],
    "fk bodo glimt": ["bodo glimt", "bodo glimt"],
    "paris saint germain fc": ["paris saint germain", "psg"],
    "club atletico de madrid": ["atletico madrid", "atletico de madrid"],
}
# Aliases of competitions beside those derived from their names.
SPECIAL_COMPETITIONS = {
    "PREMIER_LEAGUE": ["premier league", "epl", "english premier league", "england premier league"],
    "BUNDESLIGA": ["bundesliga", "germany bundesliga", "deutschland bundesliga"],
    "LA_LIGA": ["la liga", "spain la liga", "spanien la liga"],
    "SERIE_A": ["serie a", "italy serie a", "italien serie a"],
    "LIGUE_1": ["ligue 1", "france ligue 1", "frankreich ligue 1"],
    "EREDIVISIE": ["eredivisie", "netherlands eredivisie", "niederlande eredivisie"],
    "PRIMEIRA_LIGA": ["primeira liga", "portugal primeira liga"],
    "CHAMPIONSHIP": ["championship", "efl championship", "english championship"],
    "CHAMPIONS_LEAGUE": ["champions league", "uefa champions league", "ucl"],
    "EUROPA_LEAGUE": ["europa league", "uefa europa league", "uel"],
    "SUPER_LIG": ["super lig", "superlig", "turkey super lig", "turkei super lig"],
}



def _folding() -> tuple[str, str, dict[str, str]]:
    """Letters and the ASCII that they decompose to once their marks are gone: those of one sign as two texts, the others by letter."""
    one, many = {}, {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200))):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if x.isascii())
        if plain:
            (one if len(plain) == 1 else many)[c] = plain
    return "".join(one), "".join(one.values()), many


_FROM, _TO, _LONGER = _folding()


def _spelled(x: Column) -> Column:
    """Ligatures, fractions and the like written out, for the few texts that have them."""
    keys, values = ("\x1f".join(v).replace("\\", "\\\\").replace("'", "\\'") for v in (_LONGER, _LONGER.values()))
    known = F.expr(f"map_from_arrays(split('{keys}', '\x1f'), split('{values}', '\x1f'))")  # folded into one constant
    written = F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(F.try_element_at(known, c), c)), "")
    # a class of hundreds of letters is tried one by one for every sign, so plain texts pass by their lengths
    return F.when(F.octet_length(x) == F.length(x), x).when(x.rlike("[" + "".join(_LONGER) + "]"), written).otherwise(x)


def normal(text: Column, underscore: bool = False, signs: str = "") -> Column:
    """Lower case, umlauts spelled out, letters decomposed and their marks dropped, other signs gone (or ``signs`` for each), single blanks."""
    x = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.translate(_spelled(x), _FROM, _TO)
    x = F.regexp_replace(x, "[/_-]" if underscore else "[/-]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9\s]", signs), r"\s+", " "))


def without(normalised: Column, stopwords: tuple[str, ...]) -> Column:
    """A normal form without the given words; the form itself if nothing would be left."""
    kept = F.array_join(F.filter(F.split(normalised, " "), lambda w: ~w.isin(*stopwords)), " ")
    return F.when(kept == "", normalised).otherwise(kept)


def tokens(normalised: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalised, " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def substring(a: Column, b: Column) -> Column:
    """Length of the shorter to the longer where one contains the other."""
    inside = F.contains(a, b) | F.contains(b, a)
    return F.when((a == "") | (b == "") | ~inside, 0.0).otherwise(F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b)))


def prefix(a: Column, b: Column) -> Column:
    """Common leading words to the words of the longer."""
    x, y = F.split(a, " "), F.split(b, " ")
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    lead = F.coalesce(F.array_position(same, F.lit(False)) - 1, F.lit(-1))
    n = F.when(lead < 0, F.size(same)).otherwise(lead)
    return F.when((a == "") | (b == ""), 0.0).otherwise(n / F.greatest(F.size(x), F.size(y)))


def similarity(a: Column, b: Column, exact: float = 1.0, weights: tuple[float, float, float] = (0.85, 0.90, 0.75)) -> Column:
    """``exact`` for equal names, else the largest weighted of word overlap, containment and common lead."""
    j, s, p = (F.lit(w) * f(a, b) for w, f in zip(weights, (jaccard, substring, prefix), strict=True))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, exact).otherwise(F.bround(F.greatest(j, s, p), 4))


def trivial_difference(a: Column, b: Column) -> Column:
    """Names too alike to be worth a candidate."""
    same_words = F.sort_array(tokens(a)) == F.sort_array(tokens(b))
    j = jaccard(a, b)
    return (a == b) | same_words | (j >= 0.90) | ((substring(a, b) > 0) & (j >= 0.70))


def strip_affixes(x: Column) -> Column:
    return strip_suffixes(strip_prefixes(x))


def strip_prefixes(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"^((" + "|".join(PREFIXES) + r")\s+)+", ""))


def strip_suffixes(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(\s+(" + "|".join(SUFFIXES) + r"))+$", ""))


def strip_years(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, YEARS, " "), r"\s+", " "))


def aliases(name: Column, special: dict[str, list[str]] | None = None) -> Column:
    """All aliases that seeding derives from a canonical name, cleaned, of three letters or more."""
    raw = normal(name)
    bare = strip_years(raw)
    words = F.split(raw, " ")
    tail = lambda n: F.when(F.size(words) >= n, F.array_join(F.slice(words, -n, n), " "))
    listed = SPECIAL_ALIASES if special is None else special
    extra = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in listed.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), raw), F.array().cast("array<string>")) if listed else F.array().cast("array<string>")
    some = F.concat(F.array_compact(F.array(raw, bare, strip_prefixes(raw), strip_suffixes(raw), strip_affixes(raw), strip_prefixes(bare), strip_affixes(bare), F.when(F.size(words) >= 2, tail(2)), tail(3))), extra)
    cleaned = F.transform(some, lambda a: strip_affixes(strip_years(a)))
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda a: F.length(a) >= 3)))


def dedup_key(*fields: Column) -> Column:
    return F.sha2(F.concat_ws("||", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256)
