"""Toxicity by weak supervision.

Many voters look at a text: words of a small lexicon, patterns, and words and word
beginnings that the labelled documents suggest. A generative model of the votes,
fitted by expectation maximisation over labelled and unlabelled documents, estimates how
often each voter fires on toxic and on clean texts, and how voters correlate beyond
that; voters that say the same count less. Given labels are one more voter, with
an accuracy of its own. A linear classifier on hashed words is then trained on the model's
posterior labels, and scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.samples import fitting_sample
from broadsheet.llm.words import letter_classes, prefixes, runs, words

SAMPLE = 12_000  # labelled documents, and as many unlabelled ones, that a model is fitted on at most
BUCKETS = 1 << 20  # hashed features
FEATURES = 4096  # features that the classifier looks at, at most
MINED = 256  # voters taken from the labelled documents, at most
SUPPORT = 5  # toxic documents that a feature occurs in, at least
PREFIXES = (4, 5, 6)  # bytes of word beginnings
RIGHT = 0.8
CHANCE = 0.15  # correlation of voters that does not count yet
PRIOR = 0.1  # share of toxic texts where labels don't tell

LEXICON = {
    "insult": "idiot idiots moron morons imbecile dumb dumbass stupid fool loser losers clown jerk bastard",
    "contempt": "worthless pathetic disgusting trash garbage scum filth vermin useless",
    "vulgar": "shit bullshit crap asshole bitch damn fuck fucking piss",
    "threat": "kill die hate destroy murder",
    "other languages": "idiota imbécil estúpido basura asqueroso idiote imbécile stupide ordure connard dumm dummkopf trottel abschaum widerlich",
}


def _hash_words(text: str) -> np.ndarray:
    return words(pa.array([text]), letter_classes()).hashes


def hashed_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of all texts, side by side, and where each text's begin: words and word beginnings."""
    found = words(column, letter_classes())
    owner = found.owner()
    kinds = [found.hashes, *(prefixes(found, size) for size in PREFIXES)]
    number, text = [], []
    for values in kinds:
        there = values != 0
        number.append((values[there] % np.uint64(BUCKETS)).astype(np.int64))
        text.append(owner[there])
    both = np.unique(np.concatenate(text) * BUCKETS + np.concatenate(number))
    return both % BUCKETS, np.searchsorted(both // BUCKETS, np.arange(len(column) + 1))


def _fixed_votes(column: pa.Array) -> np.ndarray:
    """Votes of the lexicon and the patterns, one column each."""
    found = words(column, letter_classes())
    owner, texts = found.owner(), len(column)
    votes = [np.bincount(owner, np.isin(found.hashes, _hash_words(entry)), texts) > 0 for entry in LEXICON.values()]
    insults = np.isin(found.hashes, np.concatenate([_hash_words(LEXICON[k]) for k in ("insult", "contempt")]))
    you = np.isin(found.hashes, _hash_words("you your u tu vous du ihr"))
    near = np.zeros(len(insults), bool)
    for gap in range(1, 5):  # an insult soon after an address
        near[gap:] |= insults[gap:] & you[:-gap] & (owner[gap:] == owner[:-gap])
    votes.append(np.bincount(owner, near, texts) > 0)
    size = np.maximum(np.diff(found.offsets), 1)
    where = np.repeat(np.arange(texts), np.diff(found.offsets))
    upper = np.bincount(where, (found.data >= 65) & (found.data <= 90), texts) / size
    marks = np.bincount(where, found.data == 33, texts) / size
    votes += [upper > 0.3, marks > 0.02]
    votes.append(np.bincount(owner, insults, texts) >= 2)
    return np.column_stack(votes)


def _mined(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features that occur in toxic documents more often than chance allows, the strongest first; those that make a voter.

    A voter is right on at least the share ``RIGHT`` of the labelled documents that it fires on.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_label, all_ = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            toxic = batch.column("label").to_numpy(zero_copy_only=False) == 1
            column = batch.column("text")
            for a, b in runs(column):
                number, first = hashed_features(column.slice(a, b - a))
                all_ += np.bincount(number, minlength=BUCKETS)
                with_label += np.bincount(number[np.repeat(toxic[a:b], np.diff(first))], minlength=BUCKETS)
        used = np.flatnonzero(with_label)  # others cannot speak for toxicity
        yield pa.record_batch([pa.array(used), pa.array(with_label[used]), pa.array(all_[used])], names=["feature", "toxic", "n"])

    known = sample.filter("label is not null")
    totals = known.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    if not totals["n"] or not totals["toxic"] or totals["toxic"] == totals["n"]:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rate = totals["toxic"] / totals["n"]
    counted = known.select("text", "label").mapInArrow(count, "feature bigint, toxic bigint, n bigint")
    summed = counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).filter(F.col("toxic") >= SUPPORT)
    surprise = (F.col("toxic") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    strongest = summed.withColumn("z", surprise).filter("z > 4").orderBy(F.desc("z"), "feature").limit(FEATURES)
    found = strongest.select("feature", (F.col("toxic") >= F.col("n") * RIGHT).alias("voter")).collect()
    return tuple(np.array([row["feature"] for row in found if row["voter"] or not voter], np.int64) for voter in (False, True))


class LabelModel:
    """Latent class model of voters that vote toxic or abstain; a given label is a vote for either class.

    A voter that abstains says nothing by itself; that all of them do is one vote more.
    """

    def __init__(self, votes: np.ndarray, labels: np.ndarray, prior: float = PRIOR):
        votes = self.with_silence(votes)
        self.toxic = np.full(votes.shape[1], 0.3)  # how often a voter fires on toxic texts
        self.clean = np.clip(votes.mean(axis=0) * 0.5, 1e-4, 0.5) if len(votes) else np.full(votes.shape[1], 0.1)
        self.toxic[-1], self.clean[-1] = 0.1, 0.8
        self.weights = np.ones(votes.shape[1])
        given = labels[labels >= 0]  # the class balance is held fixed, or the classes could drift apart
        self.prior = float(np.clip((given.sum() + prior * 10) / (len(given) + 10), 0.005, 0.5))
        self.label_toxic, self.label_clean = 0.95, 0.02
        for _ in range(3):
            for _ in range(15):
                self._refit(votes, labels, self._posterior(votes, labels))
            self._correlate(votes, self._posterior(votes, labels))

    @staticmethod
    def with_silence(votes: np.ndarray) -> np.ndarray:
        return np.column_stack([votes, votes.sum(axis=1) == 0]).astype(float)

    def posterior(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return self._posterior(self.with_silence(votes), labels)

    def _posterior(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        odds = np.log(self.prior / (1 - self.prior)) + votes @ (np.log(self.toxic / self.clean) * self.weights)
        odds += np.where(labels == 1, np.log(self.label_toxic / self.label_clean), 0)
        odds += np.where(labels == 0, np.log((1 - self.label_toxic) / (1 - self.label_clean)), 0)
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def _refit(self, votes: np.ndarray, labels: np.ndarray, p: np.ndarray) -> None:
        self.toxic = np.clip((p @ votes + 0.5) / (p.sum() + 1), 1e-4, 0.9999)
        self.clean = np.clip(((1 - p) @ votes + 0.5) / ((1 - p).sum() + 1), 1e-4, 0.9999)
        given = labels >= 0
        if given.any():
            l, q = labels[given], p[given]
            self.label_toxic = float(np.clip((q @ (l == 1) + 9.5) / (q.sum() + 10), 0.6, 0.999))
            self.label_clean = float(np.clip(((1 - q) @ (l == 1) + 0.5) / ((1 - q).sum() + 10), 0.001, 0.4))

    def _correlate(self, votes: np.ndarray, p: np.ndarray) -> None:
        """Weigh voters down by how much they fire together beyond what the class explains."""
        rest = votes - (np.outer(p, self.toxic) + np.outer(1 - p, self.clean))
        spread = np.sqrt((rest * rest).mean(axis=0)) + 1e-9
        together = np.clip((rest / spread).T @ (rest / spread) / max(len(votes), 1), 0, 1)
        self.weights = 1 / np.maximum(np.where(together > CHANCE, together, 0).sum(axis=1), 1)


@dataclass
class Model:
    features: np.ndarray  # sorted
    weights: np.ndarray
    fixed: np.ndarray  # weights of the lexicon and pattern votes
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.empty(0)
        return np.concatenate([self._margin(column.slice(a, b - a)) for a, b in runs(column)])

    def _margin(self, column: pa.Array) -> np.ndarray:
        place, text = _selected(column, self.features)
        total = np.bincount(text, self.weights[place], len(column)) + _fixed_votes(column) @ self.fixed + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _selected(column: pa.Array, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the texts' features in the sorted list, and the text of each."""
    number, first = hashed_features(column)
    text = np.repeat(np.arange(len(column)), np.diff(first))
    place = np.searchsorted(features, number)
    known = np.flatnonzero(place < len(features))
    known = known[features[place[known]] == number[known]]
    return place[known], text[known]


def _train(place: np.ndarray, row: np.ndarray, fixed: np.ndarray, target: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on soft labels: Adam on full passes with a small ridge."""
    parameters = np.zeros(size + fixed.shape[1] + 1)
    moment, square = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, 301):
        margin = np.bincount(row, parameters[place], len(target)) + fixed @ parameters[size:-1] + parameters[-1]
        pull = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - target) / len(target)
        slope = np.concatenate([np.bincount(place, pull[row], size), fixed.T @ pull, [pull.sum()]])
        slope[:-1] += 1e-5 * parameters[:-1]
        moment, square = 0.9 * moment + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        parameters -= 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return parameters[:size], parameters[size:-1], float(parameters[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> Model:
    """Fit on at most ``most`` labelled and ``most`` unlabelled documents (doc_id, text), labels 1 and 0 in ``label``.

    Without labels the lexicon and pattern voters work alone. An empty table gives a model
    that scores every text alike.
    """
    sample = fitting_sample(docs, labels, label, most)
    strongest, voting = _mined(sample)
    features = np.sort(strongest)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for a, b in runs(column):
                part = column.slice(a, b - a)
                place, text = _selected(part, features)
                lists = np.split(place, np.searchsorted(text, np.arange(1, b - a)))
                yield pa.record_batch(
                    [batch.column("doc_id").slice(a, b - a), batch.column("label").slice(a, b - a),
                     pa.array(lists, pa.list_(pa.int64())), pa.array(list(_fixed_votes(part)), pa.list_(pa.bool_()))],
                    names=["doc_id", "label", "places", "fixed"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    rows = sample.mapInArrow(look, f"doc_id {kind}, label int, places array<bigint>, fixed array<boolean>").toArrow()  # 2 x most short rows
    rows = rows.sort_by([("doc_id", "ascending")])
    patterns = len(LEXICON) + 4
    if not rows.num_rows:
        return Model(features, np.zeros(len(features)), np.zeros(patterns), 0.0)
    labels_ = np.array([-1 if v is None else v for v in rows["label"].to_pylist()])
    lists = rows["places"].to_pylist()
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    place = np.array([p for x in lists for p in x], np.int64)
    fixed = np.array(rows["fixed"].to_pylist(), float)
    voters = np.searchsorted(features, voting[:MINED])
    column_of = np.full(len(features) + 1, -1)
    column_of[voters] = np.arange(len(voters))
    chosen = column_of[place] >= 0
    votes = np.zeros((len(lists), len(voters)))
    votes[row[chosen], column_of[place[chosen]]] = 1
    votes = np.column_stack([votes, fixed])
    model = LabelModel(votes, labels_)
    weights, fixed_weights, bias = _train(place, row, fixed, model.posterior(votes, labels_), len(features))
    return Model(features, weights, fixed_weights, bias)


def score(model: Model, text: Column) -> Column:
    """Probability, between 0 and 1, that a text is toxic. Null and empty texts count as texts without words."""

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(model.score(column), pa.float64())

    return scored(text)
