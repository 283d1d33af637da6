"""Spans of regular expressions as Spark SQL expressions, in code points.

All functions take and give SQL text or Columns; none runs Python on the executors.  The work is linear in a
text and its matches, but for sorting: running sums and maxima go over an array in rounds, each of which
widens what an element has seen eightfold, instead of appending to an array element by element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Eight rounds of eight see arrays of 16 million elements whole.
_ROUNDS = tuple(8**k for k in range(8))


def quoted(text: str) -> str:
    """A raw SQL string literal."""
    if "'" not in text:
        return f"r'{text}'"
    return f'r"{text}"' if '"' not in text else " || ".join(f"r'{x}'" if "'" not in x else f'r"{x}"' for x in _pieces(text))


def _pieces(text: str) -> list[str]:
    out = [""]
    for c in text:
        if (c == "'" and '"' in out[-1]) or (c == '"' and "'" in out[-1]):
            out.append("")
        out[-1] += c
    return out


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to a value that is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running_sums(numbers: str) -> str:
    """SQL for the array of sums of an array of integers up to each element."""
    for k in _ROUNDS:
        before = " + ".join(f"coalesce(get(b, i - {j * k}), 0)" for j in range(1, 8))
        numbers = _let("b", numbers, f"CASE WHEN size(b) > {k} THEN transform(b, (x, i) -> x + {before}) ELSE b END")
    return numbers


def running_maxima(numbers: str) -> str:
    """SQL for the array of maxima of an array of numbers up to each element."""
    for k in _ROUNDS:
        before = ", ".join(f"get(b, i - {j * k})" for j in range(1, 8))  # greatest skips nulls
        numbers = _let("b", numbers, f"CASE WHEN size(b) > {k} THEN transform(b, (x, i) -> greatest(x, {before})) ELSE b END")
    return numbers


def located(text: str, regex: str, unless: str | None = None, context: int = 0) -> str:
    """SQL for array<struct<start, end, hit>>: leftmost matches that don't overlap, ends exclusive.

    What stands between the matches and the matches themselves alternate, so their lengths give the
    places.  ``unless`` is SQL that holds for no text that can have a match.  With ``context`` each match
    also has lead and tail, up to so many characters before and after it.
    """
    re = quoted(regex)
    kind = "array<struct<start:int,end:int,hit:string" + ",lead:string,tail:string" * bool(context) + ">>"
    around = f""", right(concat(coalesce(get(hits, i - 1), ''), get(gaps, i)), {context}) AS lead,
        left(concat(get(gaps, i + 1), coalesce(get(hits, i + 1), '')), {context}) AS tail""" if context else ""
    ends = running_sums("transform(hits, (h, i) -> length(get(gaps, i)) + length(h))")
    found = _let(
        "hits", f"regexp_extract_all({text}, {re}, 0)",
        "CASE WHEN size(hits) = 0 THEN cast(array() AS " + kind + ") ELSE "
        + _let("gaps", f"split({text}, {re}, -1)", _let("ends", ends, f"transform(hits, (h, i) -> struct(get(ends, i) - length(h) AS start, get(ends, i) AS end, h AS hit{around}))"))
        + " END",
    )
    return f"CASE WHEN {unless} THEN cast(array() AS {kind}) ELSE {found} END" if unless else found


def apart(spans: str, others: str) -> str:
    """SQL for those spans that share no character with any of the others; both are names of columns."""
    few = f"filter({spans}, s -> NOT exists({others}, o -> o.start < s.end AND s.start < o.end))"
    # of the others that start before a span ends, the farthest end tells; how many these are comes from one sort
    events = f"""array_sort(concat(
        transform({spans}, (s, i) -> struct(s.end AS at, 0 AS other, i AS i)),
        transform({others}, (o, i) -> struct(o.start AS at, 1 AS other, i AS i))))"""
    counted = _let("e", events, _let("n", running_sums("transform(e, v -> v.other)"), "transform(array_sort(filter(transform(e, (v, i) -> struct(v.other AS other, v.i AS i, get(n, i) AS n)), v -> v.other = 0)), v -> v.n)"))
    ends = running_maxima(f"transform(array_sort(transform({others}, o -> struct(o.start AS start, o.end AS end))), o -> o.end)")
    many = _let("before", counted, _let("far", ends, f"filter({spans}, (s, i) -> NOT coalesce(get(far, get(before, i) - 1) > s.start, false))"))
    return f"CASE WHEN size({spans}) * size({others}) <= 4096 THEN {few} ELSE {many} END"


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
