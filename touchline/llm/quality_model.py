"""Quality classifier learned from positive and unlabelled texts (operator 4).

A linear model over surface features minimises the non-negative unbiased risk: trusted positives
(label 1, outside the held-out rows) against unlabelled web text, with the share of good texts in
the latter estimated first.  The threshold's place is then set where the trusted rows of both labels
are told apart best; without rows of label 0, where the estimated prior makes the error least.  The fit uses about ``sample_rows``
rows of each kind, taken by a hash of the id; scoring is one pass over all whole texts, without a shuffle.
Where every text has a label, the rows that aren't held out, without their labels, are the unlabelled text.

Nulls: a null text counts as empty and is scored like any other; a row with a null id is never held
out; a null label is no label.  Repeated rows are scored alike.  Without any row of label 1 that isn't held out, or
without unlabelled text, there is nothing to learn from: that is an error, but for an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

#: Rows of each kind, at most about, that the fit sees.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
HELD_OUT = 2


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LOWER, _DIGIT = _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(bytes(range(48, 58)))
_SENTENCE, _BANG, _BAR = _table(b".,;:?'\"-()"), _table(b"!"), _table(b"|")
_HIGH = np.arange(256) >= 128
_LEAD = (np.arange(256) & 0xC0) == 0xC0  # first bytes of longer characters
_MARK = ~(_UPPER | _LOWER | _DIGIT | _SENTENCE | _BANG | _BAR | _HIGH | tb.IS_SPACE)


def features(s: tb.Slice) -> np.ndarray:
    """A row of shares between 0 and about 1 for each text of a slice."""
    w0, w1 = s.words()
    row = s.row_of(w0)
    words = np.maximum(tb.per_row(w0, s.start, s.end), 1)
    size = np.maximum(s.end - s.start, 1)
    edges = np.stack([s.start, s.end])

    def count(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask[s.buf])])[edges], axis=0)[0]

    h = tb.span_hash(tb.prefix_hash(tb.BYTE_VALUE[tb.LOWER[s.buf]]), w0, w1)
    salted = h + tb.mix(row.astype(np.uint64) + np.uint64(1))
    same = np.zeros(len(h), bool)
    same[1:] = salted[1:] == salted[:-1]
    per_word = lambda flags: np.bincount(row[flags], minlength=s.n) / words
    capital = _UPPER[s.buf[w0]] if len(w0) else np.zeros(0, bool)
    second = _UPPER[s.buf[np.minimum(w0 + 1, len(s.buf) - 1)]] & (w1 - w0 > 1) if len(w0) else capital
    letters = np.maximum(count(_UPPER) + count(_LOWER), 1)
    line0, line1 = s.lines()
    base = np.stack(
        [
            count(_UPPER) / letters,
            per_word(capital & second),
            np.minimum(count(_BANG) / words, 3),
            np.minimum(count(_BAR) / words, 1),
            np.minimum(count(_MARK) / words, 4),
            per_word(same),
            per_word(tb.later(salted)),
            count(_DIGIT) / size,
            np.minimum(count(_SENTENCE) / words, 2),
            count(_LEAD) / size,
            np.minimum((size - words) / words, 40) / 10,
            np.log1p(words) / 10,
            np.bincount(s.row_of(line0), minlength=s.n)[: s.n] / words,
        ],
        axis=1,
    )
    return np.concatenate([base, np.sqrt(base[:, :7])], axis=1)


N_FEATURES = 20


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias, -30, 30)
        return 1 / (1 + np.exp(-z))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio, over thresholds, of how much of each
    scores higher, with a margin for the sample sizes."""
    cuts = np.quantile(positive, np.linspace(0, 0.9, 91))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    margin = np.sqrt(np.log(20) / (2 * len(positive))) + np.sqrt(np.log(20) / (2 * len(unlabelled)))
    best = int(np.argmin((u + margin) / p))
    return float(np.clip(u[best] / p[best], 0.05, 0.99))


def _descend(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Adam on the non-negative PU risk with the logistic loss; without a prior, positives against unlabelled."""
    x_p, x_u = (np.concatenate([x, np.ones((len(x), 1))], axis=1) for x in (p, u))
    w = np.zeros(x_p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        s_p, s_u = sigmoid(x_p @ w), sigmoid(x_u @ w)
        up = -(x_p * (1 - s_p)[:, None]).mean(0)  # positives as positive
        down_p, down_u = (x_p * s_p[:, None]).mean(0), (x_u * s_u[:, None]).mean(0)  # as negative
        if prior is None:
            g = up + down_u
        else:
            loss = lambda s: -np.log(np.maximum(1 - s, 1e-13)).mean()
            negative = loss(s_u) - prior * loss(s_p)
            g = prior * up + down_u - prior * down_p if negative >= 0 else prior * down_p - down_u
        g[:-1] += 1e-3 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def best_cut(positive: np.ndarray, other: np.ndarray, weight: float = 1.0) -> float:
    """The cut with the largest difference of the shares of positives, weighted, and others at or above it, in
    the middle of the widest gap where several are as good."""
    at = np.unique(np.concatenate([positive, other]))
    lower = np.concatenate([at[:1] - 1, at[:-1]])
    accepted = [1 - np.searchsorted(np.sort(x), at) / len(x) for x in (positive, other)]
    gain = weight * accepted[0] - accepted[1]
    good = np.flatnonzero(gain >= gain.max() - 1e-12)
    best = good[np.argmax((at - lower)[good])]
    return float(at[best] + lower[best]) / 2


def fit(positive: np.ndarray, unlabelled: np.ndarray, negative: np.ndarray | None = None, steps: int = 400) -> Model:
    """The model for rows of features; without positives or unlabelled rows it scores 0.5."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(N_FEATURES), 0.0, np.zeros(N_FEATURES), np.ones(N_FEATURES), 0.5)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    w, b = _descend(p, u, None, steps)
    prior = class_prior(p @ w + b, u @ w + b)
    w, _ = _descend(p, u, prior, steps)
    if negative is not None and len(negative):
        n = np.clip((negative - mean) / scale, -8, 8)
        cut = best_cut(p @ w, n @ w)
    else:  # the error is prior + accepted share of unlabelled - 2 * prior * accepted share of positives
        cut = best_cut(p @ w, u @ w, 2 * prior)
    return Model(w, float(np.log(THRESHOLD / (1 - THRESHOLD))) - cut, mean, scale, prior)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{doc_id}`").cast("string")), F.lit(4)) == HELD_OUT, F.lit(False))


def _feature_array(s: tb.Slice) -> dict[str, pa.Array]:
    x = features(s)
    return {"x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))}


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on ``labels.quality`` of the rows that aren't held out and on unlabelled rows of ``docs``."""
    trusted = lambda quality: labels.filter((F.col("quality") == quality) & ~held_out(doc_id)).select(F.col(f"`{doc_id}`").alias("id")).distinct()
    d = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    good, bad = trusted(1), trusted(0)
    known = labels.filter(F.col("quality").isNotNull()).select(F.col(f"`{doc_id}`").alias("id")).distinct()

    def some(rows: DataFrame, n: int, salt: int) -> DataFrame:
        if n <= sample_rows:
            return rows
        # the share of 2**63 hashes: some rows at any size
        return rows.filter(F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit((1 << 63) - 1)) < sample_rows * (1 << 63) // n)

    def rows(df: DataFrame) -> np.ndarray:
        found = tb.scan_texts(df.select("text"), "text", _feature_array, "x array<double>").collect()
        return np.array([r.x for r in found]).reshape(-1, N_FEATURES)

    positive = rows(d.join(F.broadcast(some(good, good.count(), 1)), "id", "left_semi"))  # a bounded sample of ids
    negative = rows(d.join(F.broadcast(some(bad, bad.count(), 3)), "id", "left_semi"))
    unlabelled = rows(some(d, docs.count(), 2).join(known, "id", "left_anti"))
    if not len(unlabelled):
        unlabelled = rows(some(d.filter(~held_out("id")), docs.count(), 2))
    if (not len(positive) or not len(unlabelled)) and not docs.isEmpty():
        raise ValueError("no trusted positives or no unlabelled text: the classifier can't be fitted")
    return fit(positive, unlabelled, negative)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, keep_text: bool = False) -> DataFrame:
    """``docs`` with score and predicted, without the text unless it is to be kept."""

    def measure(s: tb.Slice) -> dict[str, pa.Array]:
        y = model.score(features(s))
        return {"score": pa.array(y), "predicted": pa.array((y >= threshold).astype(np.int32))}

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    return tb.scan_texts(docs.select(*(F.col(f"`{c}`") for c in kept)), text, measure, "score double, predicted int", keep_text)
