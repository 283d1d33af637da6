"""Quality rules with cross-document line frequency (operator 5).

One pass over the texts takes the per-document counts and, for each line, a hash of its normalised
form (words in lower case, one blank between them).  Lines are then counted over distinct documents, each
row being one (exact copies of a text count like others), for each host; a line above the limit is removed everywhere on
that host, and a document that loses too many of its words that way is rejected.

Nulls: a null text has no words and fails the base rule; a null host is a host of its own; rows are
told apart by position, so repeated rows and null or repeated ids each give their own result row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .store import settle

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line on more distinct documents of a host than this is boilerplate there.
MAX_DOCS_PER_HOST = 100
#: A document keeps at least this percentage of its words once such lines are gone.
MIN_KEPT_PERCENT = 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCAN = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h:long,w:int>>"


def scan_slice(s: tb.Slice) -> dict[str, np.ndarray]:
    """The counts of each row of a slice and the normalised lines of all rows."""
    w0, w1 = s.words()
    word_row = s.row_of(w0)
    n_words = tb.per_row(w0, s.start, s.end)
    raw = tb.prefix_hash(tb.BYTE_VALUE[s.buf])
    low = tb.prefix_hash(tb.BYTE_VALUE[tb.LOWER[s.buf]])

    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[np.stack([s.start, s.end])], axis=0)[0]
    dark = ~tb.IS_SPACE[s.buf] & ((s.buf & 0xC0) != 0x80)

    line0, line1 = s.lines()
    line_row = s.row_of(line0)
    first_word, after_word = np.searchsorted(w0, line0), np.searchsorted(w0, line1)
    full = after_word > first_word
    line0, line1, line_row, first_word, after_word = (x[full] for x in (line0, line1, line_row, first_word, after_word))
    salt = tb.mix(line_row.astype(np.uint64) + np.uint64(1))
    twice = tb.later(tb.span_hash(raw, line0, line1) + salt)

    word = tb.span_hash(raw, w0, w1)
    covered = np.zeros(len(w0) + 1, np.int64)
    if len(w0) >= REPEAT_WINDOW:
        by_word = tb.prefix_hash(word)
        at = np.arange(len(w0) - REPEAT_WINDOW + 1)
        at = at[word_row[at] == word_row[at + REPEAT_WINDOW - 1]]
        again = at[tb.repeated(tb.span_hash(by_word, at, at + REPEAT_WINDOW) + tb.mix(word_row[at].astype(np.uint64) + np.uint64(1)))]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + REPEAT_WINDOW, -1)
    hit = np.flatnonzero(np.cumsum(covered)[:-1] > 0)

    by_low = tb.prefix_hash(tb.span_hash(low, w0, w1))
    return {
        "n_words": n_words,
        "word_chars": count(dark),
        "n_symbols": count(_SYMBOL[s.buf]),
        "n_dup_lines": np.bincount(line_row[twice], minlength=s.n),
        "n_repeat_words": np.bincount(word_row[hit], minlength=s.n),
        "line_row": line_row,
        "line_hash": tb.span_hash(by_low, first_word, after_word).view(np.int64),
        "line_words": (after_word - first_word).astype(np.int32),
    }


def _measure(s: tb.Slice) -> dict[str, pa.Array]:
    x = scan_slice(s)
    offsets = np.zeros(s.n + 1, np.int32)
    np.cumsum(np.bincount(x["line_row"], minlength=s.n), out=offsets[1:])
    line = pa.StructArray.from_arrays([pa.array(x["line_hash"]), pa.array(x["line_words"])], names=["h", "w"])
    counts = {k: pa.array(x[k].astype(np.int64)) for k in COUNTS}
    return counts | {"lines": pa.ListArray.from_arrays(pa.array(offsets), line)}


def apply_rules(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    max_docs_per_host: int = MAX_DOCS_PER_HOST,
    min_kept_percent: int = MIN_KEPT_PERCENT,
) -> DataFrame:
    """``docs`` without its text, with the counts, n_removed_words, base_failed and kept."""
    added = {*COUNTS, "n_removed_words", "base_failed", "kept"}
    carried = [c for c in docs.columns if c != text and c not in added]
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{text}`").alias("text"),
        F.col(f"`{host}`").alias("host"),
        F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried))).alias("side"),
    )
    scanned = settle(tb.scan_texts(numbered, "text", _measure, _SCAN), "rules-scan")
    lines = scanned.select("row", "host", F.inline("lines"))
    # a document's repeats of a line are taken together where it is read, without a shuffle
    once = scanned.select("host", F.explode(F.array_distinct(F.col("lines.h"))).alias("h"))
    common = (
        once.groupBy("host", "h").agg(F.count("*").alias("n_docs"))
        .filter(F.col("n_docs") > max_docs_per_host)
        .select(F.col("host").alias("host2"), F.col("h").alias("h2"))
    )
    lost = (
        lines.join(common, F.col("host").eqNullSafe(F.col("host2")) & (F.col("h") == F.col("h2")), "left_semi")
        .groupBy("row").agg(F.sum("w").cast("long").alias("lost"))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    return (
        scanned.join(lost, "row", "left")
        .withColumn("n_removed_words", F.coalesce("lost", F.lit(0)).cast("long"))
        .select(
            *(F.col(f"side.c{i}").alias(c) for i, c in enumerate(carried)),
            *COUNTS,
            "n_removed_words",
            failed.alias("base_failed"),
            (~failed & (100 * left >= min_kept_percent * F.col("n_words"))).alias("kept"),
        )
    )
