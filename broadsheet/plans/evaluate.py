"""Scoring answers against a question set with table metrics.

The scores are our own: sentences end at ".", "!" or "?"; a sentence is
supported by a context that holds at least ``THRESHOLD`` of its distinct tokens.
All scores of one case come from that case's row alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.text import half_up, let, strip, token_id, token_sign, tokens
from broadsheet.plans.answers import Model, per_model

THRESHOLD = 0.6

# Fixed value: the answer counted when a model gave none.
NO_INFORMATION = "Không có thông tin."

METRICS = ["faithfulness", "answer_relevancy", "context_precision", "context_recall"]


def trimmed(testset: DataFrame) -> DataFrame:
    return testset.withColumn("question", strip(F.col("question"))).withColumn("ground_truth", strip(F.col("ground_truth")))


def cases(testset: DataFrame, models: list[Model]) -> DataFrame:
    """Every question once per model, texts trimmed."""
    return per_model(trimmed(testset), models)


def dataset(answered: DataFrame) -> DataFrame:
    """Question, answer (with default), contexts in rank order, truth."""
    contexts = F.transform(F.array_sort("results", lambda a, b: a["rank"] - b["rank"]), lambda hit: hit["content"])
    answer = F.when(F.coalesce(F.col("response"), F.lit("")) == "", F.lit(NO_INFORMATION)).otherwise(F.col("response"))
    return answered.withColumn("answer", answer).withColumn("contexts", contexts)


def sentences(text: Column) -> Column:
    """Distinct tokens of each sentence; sentences without a token do not count."""
    parts = F.transform(F.split(text, "[.!?]"), lambda s: F.array_distinct(tokens(s)))
    return F.filter(parts, lambda t: F.size(t) > 0)


def context_tokens(contexts: Column) -> Column:
    return F.transform(contexts, lambda c: F.array_distinct(tokens(c)))


def covers(part: Column, whole: Column) -> Column:
    """True when ``whole`` holds enough of ``part``'s tokens (compared in whole numbers, threshold 3/5)."""
    return F.size(F.array_intersect(part, whole)) * 5 >= F.size(part) * 3


def _six(part: Column, whole: Column) -> Column:
    return half_up(part, whole, 1_000_000) / F.lit(1_000_000.0)


def supported_share(text: Column, contexts: Column) -> Column:
    """Share of the text's sentences that some context supports; 0 without sentences."""

    def share(wanted: Column, given: Column) -> Column:
        supported = F.filter(wanted, lambda s: F.exists(given, lambda c: covers(s, c)))
        return _six(F.size(supported), F.size(wanted))

    return let(sentences(text), lambda wanted: let(context_tokens(contexts), lambda given: share(wanted, given)))


def relevancy(question: Column, answer: Column, dim: int) -> Column:
    """Cosine of the hashed bags of tokens, from slot counts (not the float vectors)."""

    zero = F.lit(0).cast("bigint")

    def slots(text: Column) -> Column:
        return F.array_sort(F.transform(tokens(text), lambda t: F.struct((token_id(t) % dim).alias("slot"), token_sign(t).alias("sign"))))

    def sums(pairs: Column) -> Column:
        """Sum of the signs of each slot: equal slots stand together, and a slot's run is sliced out once."""
        last = F.size(pairs) - 1
        starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get(pairs, i)["slot"] != F.get(pairs, i - 1)["slot"]))

        def summed(at: Column) -> Column:
            def run(start: Column, j: Column) -> Column:
                end = F.coalesce(F.get(at, j + 1), last + 1)
                signs = F.slice(pairs, start + 1, end - start)
                return F.struct(F.get(pairs, start)["slot"], F.aggregate(signs, zero, lambda a, p: a + p["sign"]))

            return F.map_from_entries(F.transform(at, run))

        none = F.create_map().cast("map<bigint,bigint>")
        return F.when(last >= 0, let(starts, summed)).otherwise(none)

    def norm(m: Column) -> Column:
        return F.aggregate(F.map_values(m), zero, lambda a, v: a + v * v)

    def cosine(q: Column, a: Column) -> Column:
        shared = F.array_intersect(F.map_keys(q), F.map_keys(a))
        dot = F.aggregate(shared, zero, lambda acc, k: acc + q[k] * a[k])
        length = F.sqrt(norm(q).cast("double") * norm(a))
        return F.round(F.when(length > 0, dot / length).otherwise(F.lit(0.0)), 6)

    return let(let(slots(question), sums), lambda q: let(let(slots(answer), sums), lambda a: cosine(q, a)))


def context_precision(truth: Column, contexts: Column) -> Column:
    """Mean over the relevant contexts of the precision at their rank; 0 if none is relevant."""

    def ranks(wanted: Column) -> Column:
        """Ranks of the relevant contexts; the j-th of them has precision j / rank."""
        at = F.transform(
            context_tokens(contexts),
            lambda c, i: F.when((F.size(wanted) > 0) & covers(wanted, c), i + 1).otherwise(0),
        )
        return F.filter(at, lambda rank: rank > 0)

    def mean(found: Column) -> Column:
        total = F.aggregate(
            F.transform(found, lambda rank, j: half_up(j + 1, rank, 1_000_000)), F.lit(0).cast("bigint"), lambda a, v: a + v
        )
        return F.when(F.size(found) > 0, F.round(total / F.size(found) / F.lit(1_000_000.0), 6)).otherwise(F.lit(0.0))

    return let(let(F.array_distinct(tokens(truth)), ranks), mean)


def scores(rows: DataFrame, dim: int) -> DataFrame:
    """All four metrics of every case."""
    return rows.select(
        "*",
        supported_share(F.col("answer"), F.col("contexts")).alias("faithfulness"),
        relevancy(F.col("question"), F.col("answer"), dim).alias("answer_relevancy"),
        context_precision(F.col("ground_truth"), F.col("contexts")).alias("context_precision"),
        supported_share(F.col("ground_truth"), F.col("contexts")).alias("context_recall"),
    )


def summary(scored: DataFrame) -> DataFrame:
    """Mean of each metric per model; sums run over whole millionths, so their order does not matter."""

    def mean(metric: str) -> Column:
        micro = F.round(F.col(metric) * 1_000_000).cast("bigint")
        return F.round(F.sum(micro) / F.count("*") / F.lit(1_000_000.0), 6).alias(metric)

    return scored.groupBy("model").agg(F.count("*").alias("cases"), *[mean(m) for m in METRICS])
