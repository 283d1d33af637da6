"""Secret scan with a battery of randomness tests, in SQL expressions only (operator 8).

The base patterns give assignments to secret-like names, access key ids and long hex strings.  The
method looks at every token of at least ``MIN_TOKEN`` characters, as a whole and its runs of letters and digits
apart.  It infers the token's encoding and tests its characters for uniform use of that alphabet (chi-squared), for
runs above and below the alphabet's middle, for runs of digits and other characters (of vowels and others where
there is one case of letters alone), and for serial correlation.  A discovery must pass as random: the standard
scores combine to a statistic that a random string exceeds once in 1,000 times.

How likely ordinary text passes as well as that depends on the encoding and the length.  For characters drawn as often
as the corpus uses them (within the alphabet), the chi-squared statistic and the number of changes between kinds of
characters have means, variances and a covariance in closed form; ordinary text uses few characters often, seldom
changes between digits and letters, and often between vowels and others.  Their difference in standard scores gives
each token a p-value, and Benjamini and Hochberg's rule, for each encoding and class of lengths, the largest p-value
at which the share of false discoveries stays below ``FALSE_SHARE``.  The driver gets one row of character counts and
the tokens' histogram, some thousand rows.

Nulls: a null text counts as empty; a null id stays null.  Each row gives a row; repeated rows give the same.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .native_spans import apart, joined, located, quoted
from .store import settle

MIN_TOKEN = 16
FALSE_SHARE = 0.01
#: Beyond these a random string's statistic (three squared standard scores, or four) lies once in 1,000 times.
MOST, MOST_OF_KINDS = 16.27, 18.47
#: Width of a bin of standard scores, and the scores that are told apart.
BIN, LOWEST, HIGHEST = 0.05, -12.0, 0.0
#: Lower ends of the classes of lengths.
LENGTHS = (16, 20, 24, 32, 48)
#: Characters over which serial correlation is summed at once.
CHUNK = 1024

ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a maximal run of 20 or more
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"  # likewise of 24 or more
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
#: A run of letters and digits that is a part of a token.
PART = r"(?<=[+/_-])[A-Za-z0-9]{16,}+|(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+(?=[+/_-])"
KINDS = ("assign", "access", "hex", "random")

_DIGITS, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CHARACTERS = _UP + _LOW + _DIGITS + "+/"
#: Encodings in the order of inference: pattern and alphabet.
ENCODINGS = (
    (r"^[0-9]+$", _DIGITS),
    (r"^[A-Za-z][a-z]*$", _LOW),
    (r"^[A-Z]+$", _UP),
    (r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^[A-Z2-7]+$", _UP + "234567"),
    (r"^[a-z0-9]+$", _DIGITS + _LOW),
    (r"^[A-Z0-9]+$", _DIGITS + _UP),
    (r"^[A-Za-z]+$", _UP + _LOW),
    (r"^[A-Za-z0-9]+$", _DIGITS + _UP + _LOW),
    (r"", CHARACTERS),
)
WORD = 1


def kinds(alphabet: str) -> str:
    """A mark for each character: digit or not; vowel or not where all are letters of one case.

    One mark where there is neither: capitals and small letters alternate in ordinary names as well.
    """
    if set(_DIGITS) & set(alphabet):
        return "".join("d" if c in _DIGITS else "x" for c in alphabet)
    one_case = alphabet in (_LOW, _UP)
    return "".join("d" if one_case and c in "AEIOUaeiou" else "x" for c in alphabet)


#: Encodings whose alphabets have characters of several kinds: all but digits and letters of both cases.
MIXED = tuple(k for k, (_, a) in enumerate(ENCODINGS) if len(set(kinds(a))) > 1)


@dataclass
class Changes:
    """The number of changes between kinds among n characters drawn by their shares: its mean and deviation are of this form."""

    one: float  # that two neighbours differ
    both: float  # that both of three neighbours' pairs do

    @classmethod
    def of(cls, marks: str, share: list[float]) -> Changes:
        by = {m: sum(s for k, s in zip(marks, share, strict=True) if k == m) for m in set(marks)}
        return cls(1 - sum(s * s for s in by.values()), sum(s * (1 - s) ** 2 for s in by.values()))

    def mean(self, n: str) -> str:
        return f"(({n} - 1) * {self.one}D)"

    def variance(self, n: str) -> str:
        return f"(({n} - 1) * {self.one * (1 - self.one)}D + 2 * ({n} - 2) * {self.both - self.one**2}D)"


#: The same for random strings.
_RANDOM = [Changes.of(kinds(a), [1 / len(a)] * len(a)) for _, a in ENCODINGS]


def _chi() -> str:
    """SQL for the chi-squared statistic of c.token (n characters) over c.alphabet."""
    n, size = "length(c.token)", "length(c.alphabet)"
    alike = f"aggregate(split(c.alphabet, ''), 0.0D, (s, x) -> s + CASE WHEN x = '' THEN 0.0D ELSE pow({n} - length(replace(c.token, x, '')), 2) END)"
    return f"({size} * {alike} / {n} - {n})"


def _statistic(chi: str) -> str:
    """SQL for the combined statistic of c.token; it is small for random strings."""
    n, size = "length(c.token)", "length(c.alphabet)"
    uniform = f"({chi} - ({size} - 1)) / sqrt(2.0D * ({size} - 1) * ({n} - 1) / {n})"
    high = f"translate(c.token, c.alphabet, concat(repeat('0', {size} div 2), repeat('1', {size} - {size} div 2)))"
    runs = f"length(regexp_replace({high}, '0++|1++', 'x'))"
    run = f"({runs} - (1.0D + 2.0D * ({n} - 1) * 0.25D)) / sqrt(({n} - 1) * 0.25D)"
    place = f"transform(filter(split(k, ''), y -> y != ''), y -> locate(y, c.alphabet) - ({size} + 1) / 2.0D)"
    chunk = f"transform(array({place}), at -> aggregate(transform(at, (y, i) -> y * coalesce(get(at, i + 1), 0.0D)), 0.0D, (s, y) -> s + y))[0]"
    product = f"aggregate(regexp_extract_all(c.token, '.{{1,{CHUNK}}}', 0), 0.0D, (s, k) -> s + {chunk})"
    serial = f"{product} / (({size} * {size} - 1) / 12.0D) / sqrt({n} - 1)"
    by = lambda f: "CASE " + " ".join(f"WHEN c.encoding = {k} THEN {f(_RANDOM[k])}" for k in MIXED) + " END"
    change = f"coalesce(pow({_changes()} - {by(lambda c: c.mean(n))}, 2) / {by(lambda c: c.variance(n))}, 0.0D)"
    return f"pow(greatest({uniform}, 0.0D), 2) + pow({run}, 2) + pow({serial}, 2) + {change}"


def _changes() -> str:
    """SQL for the number of changes between kinds of characters of c.token."""
    return "(length(regexp_replace(translate(c.token, c.alphabet, c.kinds), 'd++|x++', 'x')) - 1)"


def _tokens(regex: str) -> str:
    """SQL for array<struct<start, end, n, encoding, chi, s>>: all tokens and their statistics."""
    bare = "rtrim('=', translate(t.hit, '-_', '+/'))"
    which = "CASE " + " ".join(f"WHEN {bare} RLIKE '{p}' THEN {i}" for i, (p, _) in enumerate(ENCODINGS[:-1])) + f" ELSE {len(ENCODINGS) - 1} END"
    alphabets = "array(" + ", ".join(f"'{a}'" for _, a in ENCODINGS) + ")"
    marks = "array(" + ", ".join(f"'{kinds(a)}'" for _, a in ENCODINGS) + ")"
    coded = f"transform({located('text', regex)}, t -> struct(t.start AS start, t.end AS end, {which} AS encoding, {bare} AS bare))"
    ready = f"transform(filter({coded}, t -> length(t.bare) >= {MIN_TOKEN}), t -> struct(t.start AS start, t.end AS end, t.encoding AS encoding, CASE WHEN t.encoding = {WORD} THEN lower(t.bare) ELSE t.bare END AS token, element_at({alphabets}, t.encoding + 1) AS alphabet, element_at({marks}, t.encoding + 1) AS kinds))"
    return f"transform({ready}, c -> struct(c.start AS start, c.end AS end, length(c.token) AS n, c.encoding AS encoding, {_chi()} AS chi, {_changes()} AS changes, {_statistic(_chi())} AS s))"


def _kind(kind: str, spans: str) -> str:
    return f"transform({spans}, s -> struct(s.start AS start, {KINDS.index(kind)} AS rank, s.end AS end, '{kind}' AS kind))"


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: the id, its base spans, and whole tokens and other runs with their statistics; no text."""
    d = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    named = "lower(text)"
    keys = " OR ".join(f"contains({named}, '{k}')" for k in ("passw", "secret", "token", "api"))
    assign = f"filter({located('text', ASSIGN, f'NOT ({keys})')}, s -> length(regexp_extract(s.hit, {quoted(ASSIGN)}, 1)) >= 6)"
    access = located("text", ACCESS, "NOT contains(text, 'AKIA')")
    spans = d.select(
        "id",
        F.expr(_kind("assign", assign)).alias("assign"),
        F.expr(_kind("access", access)).alias("access"),
        F.expr(_kind("hex", located("text", HEX))).alias("hex"),
        F.expr(_tokens(TOKEN)).alias("tokens"),
        F.expr(_tokens(PART)).alias("parts"),
    )
    return settle(spans, "secret-spans")


@dataclass
class Ordinary:
    """Chi-squared and changes of n characters drawn as ordinary text uses an alphabet: their moments are of this form."""

    size: int
    two: float  # that two characters are the same
    three: float  # that three are
    changes: Changes
    apart: float  # that two are the same and a third is of another kind

    @classmethod
    def of(cls, alphabet: str, share: list[float]) -> Ordinary:
        marks = kinds(alphabet)
        by = {m: sum(s for k, s in zip(marks, share, strict=True) if k == m) for m in set(marks)}
        apart = sum(s * s * (1 - by[m]) for m, s in zip(marks, share, strict=True))
        return cls(len(alphabet), sum(x**2 for x in share), sum(x**3 for x in share), Changes.of(marks, share), apart)

    def mean(self, n: str) -> str:
        return f"({self.size} * (({n} - 1) * {self.two}D + 1) - {n})"

    def deviation(self, n: str) -> str:
        pairs, triples = self.two - self.two**2, max(self.three - self.two**2, 0.0)
        return f"({self.size} / cast({n} AS double) * sqrt({n} * ({n} - 1D) * (2 * {pairs}D + 4 * ({n} - 2D) * {triples}D)))"

    def together(self, n: str) -> str:
        """The correlation of chi-squared and changes: pairs of places that share one or both."""
        same = self.two * self.changes.one
        covariance = f"({2 * self.size}D / {n} * ({n} - 1) * ({-same}D + 2 * ({n} - 2) * {self.apart - same}D))"
        return f"greatest(-0.99D, least(0.99D, {covariance} / ({self.deviation(n)} * sqrt({self.changes.variance(n)}))))"


def ordinary_text(docs: DataFrame, text: str = "text") -> list[Ordinary]:
    """For each encoding, from the counts of the alphabet's characters in all texts (one row)."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = docs.agg(*(F.sum(F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double").alias(f"c{i}") for i, c in enumerate(CHARACTERS))).first()
    count = {c: (row[f"c{i}"] or 0.0) + 1.0 for i, c in enumerate(CHARACTERS)}
    out = []
    for _, alphabet in ENCODINGS:
        one_case = alphabet == alphabet.upper() or alphabet == alphabet.lower()  # then letters are used as in either case
        used = [count[c] + (count[c.swapcase()] if one_case and c.isalpha() else 0.0) for c in alphabet]
        share = [x / sum(used) for x in used]
        out.append(Ordinary.of(alphabet, share))
    return out


def score(null: list[Ordinary], t: str) -> str:
    """SQL for a token's standard score in ordinary text; low scores, few repeats and changes of kind as in random strings, are secrets."""
    n = f"{t}.n"

    def one(k: int, o: Ordinary) -> str:
        chi = f"({t}.chi - {o.mean(n)}) / {o.deviation(n)}"
        if k not in MIXED:
            return chi
        sign = "-" if _RANDOM[k].one > o.changes.one else "+"  # random strings change more often, but between vowels and others less
        return f"({chi} {sign} ({t}.changes - {o.changes.mean(n)}) / sqrt({o.changes.variance(n)})) / sqrt(2D {sign} 2D * {o.together(n)})"

    return "CASE " + " ".join(f"WHEN {t}.encoding = {k} THEN {one(k, o)}" for k, o in enumerate(null)) + " END"


def passes(t: str) -> str:
    """SQL for whether a token passes as random."""
    return f"({t}.s < CASE WHEN {t}.encoding IN ({', '.join(map(str, MIXED))}) THEN {MOST_OF_KINDS}D ELSE {MOST}D END)"


def length_class(n: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} >= {at} THEN {at}" for at in reversed(LENGTHS)) + f" ELSE {LENGTHS[0]} END"


def limits(counts: list[tuple[int, int, int, int]], false_share: float) -> dict[tuple[int, int], float]:
    """Benjamini and Hochberg's largest score for each encoding and class, from (encoding, class, bin, tokens)."""
    out = {}
    for group in sorted({c[:2] for c in counts}):
        here = sorted((b, n) for *k, b, n in counts if tuple(k) == group)
        total, found = sum(n for _, n in here), 0
        for b, n in here:
            found += n
            at = LOWEST + (b + 1) * BIN
            if at <= HIGHEST and 0.5 * math.erfc(-at / math.sqrt(2)) * total <= false_share * found:
                out[group] = at
    return out


def thresholds(spans: DataFrame, null: list[Ordinary], false_share: float = FALSE_SHARE) -> dict[tuple[int, int], float]:
    """For each encoding and class of lengths the largest score of a discovery; some thousand rows of counts are collected."""
    token = spans.select(F.explode(F.concat("tokens", "parts")).alias("t"))
    # what doesn't pass as random is no discovery at any score, but counts as tested
    place = f"CASE WHEN {passes('t')} THEN greatest(0, least({int((HIGHEST - LOWEST) / BIN)}, cast(floor((({score(null, 't')}) - ({LOWEST})) / {BIN}) AS int))) ELSE {int((HIGHEST - LOWEST) / BIN)} END"
    counts = token.groupBy(F.expr("t.encoding").alias("encoding"), F.expr(length_class("t.n")).alias("class"), F.expr(place).alias("bin")).agg(F.count("*").alias("n"))
    return limits([tuple(r) for r in counts.collect()], false_share)


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", false_share: float = FALSE_SHARE) -> DataFrame:
    """One row for each row: the id, base (spans of the patterns) and found (all spans), as arrays of
    struct<start, rank, end, kind> in the order of start and kind."""
    spans = measured(docs, text, doc_id)
    null = ordinary_text(docs, text)
    found = thresholds(spans, null, false_share)
    limit = "CASE " + " ".join(f"WHEN t.encoding = {e} AND ({length_class('t.n')}) = {c} THEN {z}D" for (e, c), z in found.items()) + " END" if found else "cast(NULL AS double)"
    random = lambda tokens: f"filter({tokens}, t -> coalesce({passes('t')} AND {score(null, 't')} < {limit}, false))"
    base = spans.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    base = base.withColumns({"whole": F.expr(random("tokens")), "other": F.expr(random("parts"))})
    base = base.withColumns({"whole": F.expr(apart("whole", "base")), "other": F.expr(apart("other", "base"))})
    base = base.withColumn("other", F.expr(apart("other", "whole")))
    return base.select(F.col("id").alias(doc_id), "assign", "access", "hex", "base", F.array_sort(F.concat("base", F.expr(_kind("random", "whole")), F.expr(_kind("random", "other")))).alias("found"))


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return found.select(
        doc_id,
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )
