"""Quality classifier by positive-unlabelled learning.

Trusted good documents are the positives; web text without a label is a mixture
of good and bad. An additive model over binned text statistics minimises the
non-negative unbiased risk, which needs the share of good documents in the mixture.
That share is estimated from the scores of a first model that tells positives from the
mixture, since above no threshold can the mixture hold a smaller share than prior times
the positives'. Where labelled documents hold bad ones too and are an unbiased audit, their share can be taken instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.samples import fitting_sample
from broadsheet.llm.words import mix, runs, shingles, words

SAMPLE = 12_000  # labelled documents, and as many unlabelled ones, that a model is fitted on at most
BINS = 16
RIDGE = 1e-4  # penalty on squared weights
_SYMBOLS = b"!?.,;:*#$%&|@<>{}=_/\\\"'()-"


def _byte_classes() -> np.ndarray:
    """Class of each byte: upper case, lower case, digit, white space, other alphabets, each symbol by itself, the rest."""
    classes = np.full(256, 5 + len(_SYMBOLS), np.int64)
    classes[65:91], classes[97:123], classes[48:58], classes[128:] = 0, 1, 2, 4
    classes[[9, 10, 11, 12, 13, 32]] = 3
    for i, symbol in enumerate(_SYMBOLS):
        classes[symbol] = 5 + i
    return classes


def _per_text(values: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    return np.bincount(owner, values, texts)


def _repeated(values: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of the values of each text that occur before in it, and the share of its commonest one."""
    count = np.maximum(np.bincount(owner, minlength=texts), 1)
    if not len(values):
        return np.zeros(texts), np.zeros(texts)
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])])
    begin = np.flatnonzero(new)
    times = np.diff(np.concatenate([begin, [len(v)]]))
    most = np.zeros(texts)
    np.maximum.at(most, o[begin], times)
    return 1 - np.bincount(o[begin], minlength=texts) / count, most / count


def features(column: pa.Array) -> np.ndarray:
    """Statistics of each text, one row each; a text without words has zeros."""
    texts = len(column)
    found = words(column)
    size = np.diff(found.offsets)
    classes = _byte_classes()
    kinds = int(classes.max()) + 1
    where = np.repeat(np.arange(texts), size)
    table = np.bincount(where * kinds + classes[found.data], minlength=texts * kinds).reshape(texts, kinds)
    bytes_ = np.maximum(size, 1)[:, None]
    owner, count = found.owner(), np.diff(found.first)
    n = np.maximum(count, 1)
    length = found.stop - found.start
    same = np.zeros(len(found.hashes))
    same[1:] = (found.hashes[1:] == found.hashes[:-1]) & (owner[1:] == owner[:-1])
    breaks = np.concatenate([[0], np.cumsum(found.data == 10)])
    line = breaks[found.start]
    new_line = np.concatenate([[True], (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])]) if len(line) else np.zeros(0, bool)
    begin = np.flatnonzero(new_line)
    place = np.arange(len(line)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(line)]]))) if len(line) else line
    lines = np.add.reduceat(mix(found.hashes + place.astype(np.uint64)), begin) if len(begin) else np.empty(0, np.uint64)
    line_owner = owner[begin]
    line_count = np.bincount(line_owner, minlength=texts)
    triples, first, _ = shingles(found, 3)
    triple_owner = np.repeat(np.arange(texts), np.diff(first))
    repeated, commonest = _repeated(found.hashes, owner, texts)
    stats = [
        np.log1p(size), np.log1p(count), _per_text(length, owner, texts) / n,
        np.sqrt(np.maximum(_per_text(length.astype(float) ** 2, owner, texts) / n - (_per_text(length, owner, texts) / n) ** 2, 0)),
        repeated, commonest, _per_text(same, owner, texts) / n,
        *_repeated(triples, triple_owner, texts), *_repeated(lines, line_owner, texts),
        np.log1p(line_count), count / np.maximum(line_count, 1),
    ]
    return np.column_stack([*stats, table / bytes_])


def _edges(values: np.ndarray) -> np.ndarray:
    """Bounds of the bins: quantiles of all values and, for statistics that are mostly at their least, of the others."""
    if not len(values):
        return np.zeros(0)
    above = values[values > values.min()]
    half = np.linspace(0, 1, BINS // 2 + 1)
    return np.unique(np.concatenate([np.quantile(values, half[1:-1]), np.quantile(above, half[:-1]) if len(above) else []]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Bin edges and a weight for each bin of each statistic."""

    edges: list[np.ndarray]
    weights: np.ndarray
    bias: float
    prior: float = 0.5

    def bins(self, x: np.ndarray) -> np.ndarray:
        placed = [np.searchsorted(e, x[:, i], "right") + i * BINS for i, e in enumerate(self.edges)]
        return np.column_stack(placed)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return self.weights[bins].sum(axis=1) + self.bias

    def score(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.empty(0)
        parts = [features(column.slice(a, b - a)) for a, b in runs(column)]
        return _sigmoid(self.margin(self.bins(np.concatenate(parts))))


def _descend(model: Model, positive: np.ndarray, mixture: np.ndarray, gradient, rounds: int) -> None:
    """Fit weights by Adam on full passes; ``gradient`` gives the pull on each row's margin."""
    size = len(model.weights) + 1
    moment, square = np.zeros(size), np.zeros(size)
    for step in range(1, rounds + 1):
        on_p, on_m = gradient(model.margin(positive), model.margin(mixture))
        pull = np.zeros(size)
        for bins, rows in ((positive, on_p), (mixture, on_m)):
            pull[:-1] += np.bincount(bins.ravel(), np.repeat(rows, bins.shape[1]), size - 1)
            pull[-1] += rows.sum()
        pull[:-1] += RIDGE * model.weights
        moment, square = 0.9 * moment + 0.1 * pull, 0.99 * square + 0.01 * pull * pull
        move = 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        model.weights -= move[:-1]
        model.bias -= move[-1]


def _against_mixture(p: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logistic risk of telling positives from the mixture, both weighing the same."""
    return -(1 - _sigmoid(p)) / max(len(p), 1), _sigmoid(m) / max(len(m), 1)


def _unbiased(prior: float):
    """Pull of the non-negative unbiased risk with logistic loss."""

    def gradient(p: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        as_negative = np.logaddexp(0, m).mean() - prior * np.logaddexp(0, p).mean()
        down_p, up_p, up_m = -(1 - _sigmoid(p)) / len(p), _sigmoid(p) / len(p), _sigmoid(m) / len(m)
        if as_negative >= 0:
            return prior * down_p - prior * up_p, up_m
        return prior * up_p, -up_m  # the negatives' risk cannot be below 0: step back

    return gradient


def estimate_prior(positive: np.ndarray, mixture: np.ndarray) -> float:
    """Share of positives in the mixture from scores: the least ratio of both shares above any threshold.

    The shares get the usual deviation bound, so thresholds that few rows reach do
    not decide.
    """
    thresholds = np.quantile(positive, np.linspace(0, 0.99, 100))
    p = np.array([(positive >= t).mean() for t in thresholds])
    m = np.array([(mixture >= t).mean() for t in thresholds])
    slack = np.sqrt(np.log(40) / 2 / max(len(positive), 1)) + np.sqrt(np.log(40) / 2 / max(len(mixture), 1))
    best = int(np.argmin((m + slack) / p))
    return float(np.clip(m[best] / p[best], 0.01, 0.99))


def _matching(margins: np.ndarray, prior: float) -> float:
    """The shift at which the mixture's mean score is the prior."""
    low, high = -30.0, 30.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _sigmoid(margins + middle).mean() < prior else (low, middle)
    return low


def _prior_of(edges: list[np.ndarray], bins: np.ndarray, known: np.ndarray, rounds: int) -> float:
    """Prior by a model fitted on half of the rows and looked at on the other half."""
    half = np.arange(len(bins)) % 2 == 0
    if not all(part.any() for part in (known & half, ~known & half, known & ~half, ~known & ~half)):
        return 0.5
    first = Model(edges, np.zeros(len(edges) * BINS), 0.0)
    _descend(first, bins[known & half], bins[~known & half], _against_mixture, rounds)
    return estimate_prior(first.margin(bins[known & ~half]), first.margin(bins[~known & ~half]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, rounds: int = 250, audit: bool = False) -> Model:
    """Fit on at most ``most`` labelled documents and ``most`` without label.

    Documents with label 0 are left out; with ``audit``, where there are any, the prior is the share of label 1
    among the labelled documents instead of the estimate from the scores.

    ``docs``: doc_id, text; ``labels``: doc_id and ``label``. Without positives or without
    unlabelled documents every score is the prior, one half.
    """
    sample = fitting_sample(docs, labels, label, most)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for a, b in runs(column):
                yield pa.record_batch(
                    [batch.column("doc_id").slice(a, b - a), batch.column("label").slice(a, b - a),
                     pa.array(list(features(column.slice(a, b - a))), pa.list_(pa.float64()))],
                    names=["doc_id", "label", "x"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    rows = sample.mapInArrow(describe, f"doc_id {kind}, label int, x array<double>").toArrow()  # 2 x most rows of some 40 numbers
    width = 13 + int(_byte_classes().max()) + 1
    x = np.array(rows["x"].to_pylist(), dtype=float).reshape(rows.num_rows, width)
    given = np.array([-1 if v is None else v for v in rows["label"].to_pylist()], int)
    audited = audit and (given == 0).any() and (given == 1).any()
    share = float((given == 1).sum() / (given >= 0).sum()) if audited else None
    x, known = x[given != 0], given[given != 0] == 1
    order = np.lexsort((known, *x.T[::-1]))  # the same order, and so the same sums, each time
    x, known = x[order], known[order]
    edges = [_edges(x[:, i]) for i in range(width)]
    model = Model(edges, np.zeros(width * BINS), 0.0)
    if not known.any() or known.all():
        return model
    bins = model.bins(x)
    prior = share if share is not None else _prior_of(edges, bins, known, rounds // 2)
    _descend(model, bins[known], bins[~known], _unbiased(prior), rounds)
    model.prior = prior
    model.bias += _matching(model.margin(bins[~known]), prior)
    return model


def score(model: Model, text: Column) -> Column:
    """Probability, between 0 and 1, that a text is good. Null and empty texts count as texts without words."""

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(model.score(column), pa.float64())

    return scored(text)
