"""Personal data by weak supervision, in SQL expressions only (operator 9).

Base patterns give e-mail and IP addresses, card and phone numbers; what passes its check is always a
span.  Loose patterns add candidates: the failing matches of the base patterns, local phone numbers,
spelled-out addresses and numbers in the form of an identity number.  Labelers then vote on every
candidate (+1, -1 or 0): the strict pattern, a checksum or range, gazetteers (words that announce
personal data or something else, endings of mail domains, issuers of cards and calling codes), and the shape
of its surroundings.  Expectation-maximisation estimates how reliable each labeler is, and its posteriors
train the final classifier, a logistic model over the votes, the kind and the content (digits, length,
separators).  Both work on counts of the vote patterns (at most ``MAX_CELLS`` rows, a number that
the corpus doesn't change); the classifier goes back as a SQL expression.

No pattern repeats a group but possessively, which Java's matcher does without recursion, and none starts
inside a run that it has scanned before, so a text of any length takes time in proportion.

Nulls: a null text counts as empty; a null id stays null.  Each row gives a row; repeated rows give the same.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .native_spans import apart, joined, located
from .store import settle

# A match starts at the start of a run of its first class, or where the match before it ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL_PHONE = r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
IDENTITY = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20(?:\[at\]|\(at\))\x20[A-Za-z0-9-]++(?:\x20(?:\[dot\]|\(dot\))\x20[A-Za-z0-9-]++)++"
KINDS = ("email", "ip", "card", "phone")
LOOSE = ("local_phone", "identity", "spelled_email", "failed")

# Gazetteers.
#: Words, of four languages, that announce personal data.
BEFORE = (
    "e-?mail|mail|mailto|contact|phone|tel|telephone|call|dial|mobile|cell|fax|whatsapp|sms|text me|reach me|card|visa|mastercard|amex|credit|debit|account|iban|"
    "ssn|social|security|passport|identity|id|address|ip|host|server|client|from|to|"
    "telefon|anruf|rufnummer|handy|mobil|kontakt|karte|konto|adresse|ausweis|"
    "teléfono|llame|móvil|correo|tarjeta|cuenta|dirección|dni|"
    "téléphone|appelez|portable|courriel|carte|compte|adresse|joindre"
)
#: Words that announce numbers of another kind.
OTHER = "version|ver|v|release|build|section|chapter|page|figure|fig|table|line|isbn|issn|doi|order|invoice|item|part|price|usd|eur|year|no|nr|kapitel|seite|preis|página|precio|capítulo|chapitre|prix"
#: Endings of mail domains; any country's two letters count as well.
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|online|site|shop|store|blog|cloud|email|museum|coop|aero|[a-z]{2}"
#: First digits of the issuers of cards.
ISSUERS = "4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|30[0-5]|3[689]|35|6011|64[4-9]|65|62|5[06-9]|81"
#: Calling codes of zones and countries, after the plus sign.
CALLING = "1|7|2[07]|2[1-689][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[789][0-9]|8[1246]|8[058][0-9]|9[0-58]|9[679][0-9]"

LABELERS = ("pattern", "check", "before", "other", "ending", "issuer", "edge", "lone")
#: Content of a candidate: classes of its digits, its length and its separators.
CONTENT = ("digits", "size", "marks")
MAX_CELLS = len(KINDS + LOOSE) * 3 ** len(LABELERS) * 5 * 5 * 3
ADD_AT = 0.9
WIDTH = 40

_OCTETS = "^0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"
_LUHN = """(aggregate(sequence(1, length({d})), 0L, (sum, i) -> sum + CASE WHEN i % 2 = 1 THEN bigint(substr(reverse({d}), i, 1))
    ELSE (2 * bigint(substr(reverse({d}), i, 1))) div 10 + (2 * bigint(substr(reverse({d}), i, 1))) % 10 END) % 10 = 0)"""


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _card_ok(x: str) -> str:
    d = _digits(x)
    return f"(length({d}) BETWEEN 13 AND 19 AND {_LUHN.format(d=d)})"


def _ip_ok(x: str) -> str:
    return f"forall(split({x}, '[.]'), p -> p RLIKE '{_OCTETS}')"


def _phone_ok(x: str) -> str:
    return f"(length({_digits(x)}) BETWEEN 9 AND 15)"


def _spans(kind: str, rank: int, found: str, ok: str) -> str:
    return f"transform({found}, s -> struct({rank} AS rank, s.start AS start, s.end AS end, '{kind}' AS kind, {ok} AS ok, s.hit AS hit, s.lead AS lead, s.tail AS tail))"


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: the id, base spans (in order) and other candidates with the labelers' votes."""
    d = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    numeric = "NOT (text RLIKE '[0-9][^A-Za-z]{0,3}[0-9]')"
    at = lambda regex, unless: located("text", regex, unless, WIDTH)
    parts = [
        _spans("email", 0, at(EMAIL, "NOT contains(text, '@')"), "true"),
        _spans("ip", 1, at(IP, "NOT (text RLIKE '[0-9][.][0-9]')"), _ip_ok("s.hit")),
        _spans("card", 2, at(CARD, numeric), _card_ok("s.hit")),
        _spans("phone", 3, at(PHONE, "NOT contains(text, '+')"), _phone_ok("s.hit")),
    ]
    loose = [
        _spans("local_phone", 4, at(LOCAL_PHONE, numeric), "true"),
        _spans("identity", 5, at(IDENTITY, numeric), "true"),
        _spans("spelled_email", 6, at(SPELLED, "NOT (contains(text, '[at]') OR contains(text, '(at)'))"), "true"),
    ]
    found = d.select("id", F.expr(f"concat({', '.join(parts)})").alias("all"), F.expr(f"concat({', '.join(loose)})").alias("loose"))
    split = found.select(
        "id",
        F.expr("filter(all, s -> s.ok)").alias("base"),
        F.expr("concat(transform(filter(all, s -> NOT s.ok), s -> struct(7 AS rank, s.start AS start, s.end AS end, 'failed' AS kind, false AS ok, s.hit AS hit, s.lead AS lead, s.tail AS tail)), loose)").alias("rest"),
    )
    said = lambda words: rf"lower(s.lead) RLIKE r'(^|[^\p{{L}}])({words})[^\p{{L}}0-9]{{0,3}}\p{{L}}{{0,3}}[^\p{{L}}0-9]{{0,3}}$'"
    votes = ", ".join(
        [
            "CASE WHEN s.rank < 4 OR s.rank = 6 THEN 1 WHEN s.rank = 7 THEN -1 ELSE 0 END AS pattern",
            f"CASE WHEN s.rank = 7 THEN -1 WHEN s.rank IN (1, 2) THEN 1 WHEN s.rank IN (3, 4) THEN CASE WHEN {_phone_ok('s.hit')} THEN 1 ELSE -1 END ELSE 0 END AS check",
            f"CASE WHEN {said(BEFORE)} THEN 1 ELSE 0 END AS before",
            f"CASE WHEN {said(OTHER)} THEN -1 ELSE 0 END AS other",
            f"CASE WHEN s.rank NOT IN (0, 6) THEN 0 WHEN lower(s.hit) RLIKE '[^a-z]({ENDINGS})$' THEN 1 ELSE -1 END AS ending",
            rf"CASE WHEN s.rank = 2 THEN CASE WHEN s.hit RLIKE '^({ISSUERS})' THEN 1 ELSE -1 END WHEN s.rank = 3 THEN CASE WHEN s.hit RLIKE r'^\+({CALLING})' THEN 1 ELSE -1 END ELSE 0 END AS issuer",
            "CASE WHEN s.lead RLIKE '[A-Za-z0-9]$' OR s.tail RLIKE '^[A-Za-z0-9]' THEN -1 ELSE 1 END AS edge",
            f"CASE WHEN length({_digits('s.lead')}) + length({_digits('s.tail')}) > 24 THEN -1 ELSE 1 END AS lone",
        ]
    )
    content = f"""least(length({_digits('s.hit')}) div 4, 4) AS digits, least(length(s.hit) div 8, 4) AS size,
        CASE WHEN s.hit RLIKE '^[0-9]*$' THEN 0 WHEN s.hit RLIKE '[A-Za-z]' THEN 2 ELSE 1 END AS marks"""
    voted = f"s -> struct(s.rank AS rank, s.start AS start, s.end AS end, s.kind AS kind, {votes}, {content})"
    out = split.select("id", F.expr(f"transform(base, {voted})").alias("base"), F.expr(f"transform(rest, {voted})").alias("rest"))
    return settle(out.withColumns({"base": F.array_sort("base"), "rest": F.array_sort("rest")}), "pii-candidates")


def reliabilities(cells: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[list[tuple[dict[int, float], dict[int, float]]], dict[tuple[int, ...], float]]:
    """EM over (votes, count): for each labeler how likely each vote is given the truth, and the
    posterior of each pattern of votes.  It starts from the majority of the votes."""
    total = {}
    for votes, n in cells:
        total[votes] = total.get(votes, 0) + n
    post = {v: min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for v in total}
    model: list = []
    for _ in range(rounds):
        weight = [sum(n * post[v] for v, n in total.items()), sum(n * (1 - post[v]) for v, n in total.items())]
        model = []
        for k in range(len(next(iter(total), ()))):
            sides = []
            for true in (True, False):
                seen = {-1: 1.0, 0: 1.0, 1: 1.0}  # one of each, so that nothing is impossible
                for v, n in total.items():
                    seen[v[k]] += n * (post[v] if true else 1 - post[v])
                mass = sum(seen.values())
                sides.append({x: y / mass for x, y in seen.items()})
            model.append(tuple(sides))
        prior = (weight[0] + 1) / (sum(weight) + 2)
        for v in total:
            odds = math.log(prior / (1 - prior)) + sum(math.log(good[x] / bad[x]) for x, (good, bad) in zip(v, model, strict=True))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return model, post


def _inputs(kind: int, votes: tuple[int, ...], content: tuple[int, ...]) -> list[float]:
    return [1.0, *(1.0 if kind == k else 0.0 for k in range(len(KINDS + LOOSE))), *map(float, votes), *(x / 4 for x in content)]


def classifier(cells: list[tuple[int, tuple[int, ...], tuple[int, ...], int]], steps: int = 200) -> list[float]:
    """Weights of a logistic model of (kind, votes, content) trained on EM posteriors; counts weigh by their root."""
    _, post = reliabilities([(v, n) for _, v, _, n in cells])
    rows = [(_inputs(k, v, c), post[v], math.sqrt(n)) for k, v, c, n in cells]
    w = [0.0] * (1 + len(KINDS + LOOSE) + len(LABELERS) + len(CONTENT))
    mass = sum(n for _, _, n in rows) or 1.0
    for _ in range(steps):
        g = [0.01 * x for x in w]
        for x, y, n in rows:
            e = n / mass * (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True)))))) - y)
            for i, v in enumerate(x):
                g[i] += e * v
        w = [a - 1.0 * b for a, b in zip(w, g, strict=True)]
    return w


def train(found: DataFrame) -> list[float]:
    """The classifier from the counts of vote patterns over the whole corpus."""
    votes, content = ([f"c.{x}" for x in names] for names in (LABELERS, CONTENT))
    c = found.select(F.explode(F.concat("base", "rest")).alias("c")).groupBy("c.rank", *votes, *content).agg(F.count("*").alias("n"))
    rows = c.orderBy("rank", *LABELERS, *CONTENT).limit(MAX_CELLS).collect()  # all of them: there can't be more
    return classifier([(r["rank"], tuple(r[x] for x in LABELERS), tuple(r[x] for x in CONTENT), r["n"]) for r in rows])


def find_personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", add_at: float = ADD_AT) -> DataFrame:
    """One row for each row: the id, base and found (all spans): arrays of struct<rank, start, end, kind>
    by kind and start."""
    found = candidates(docs, text, doc_id)
    w = train(found)
    k = 1 + len(KINDS + LOOSE)
    terms = [f"{w[0]}D", f"element_at(array({', '.join(f'{x}D' for x in w[1:k])}), s.rank + 1)"]
    terms += [f"{x}D * s.{name}" for name, x in zip(LABELERS, w[k:], strict=False)] + [f"{x}D * s.{name} / 4" for name, x in zip(CONTENT, w[k + len(LABELERS) :], strict=True)]
    at = math.log(add_at / (1 - add_at))
    short = "s -> struct(s.rank AS rank, s.start AS start, s.end AS end, s.kind AS kind)"
    more = found.withColumn("likely", F.expr(f"filter(rest, s -> {' + '.join(terms)} >= {at}D)"))
    return more.select(
        F.col("id").alias(doc_id),
        F.expr(f"transform(base, {short})").alias("base"),
        F.array_sort(F.concat(F.expr(f"transform(base, {short})"), F.expr(f"transform({apart('likely', 'base')}, {short})"))).alias("found"),
    )


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return found.select(
        doc_id,
        *(F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )
