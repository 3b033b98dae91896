"""Prompt contexts, prompts, generators and answer records."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.text import strip

# Texts shown when there is nothing to show.
NOTHING_FOUND = "Không tìm thấy nguồn tin nào liên quan đến câu hỏi của bạn."
NO_ANSWER = "Không tìm thấy câu trả lời."

# Frame of the formatted answer.
RULE = "-" * 30
ANSWER_HEAD = " AI trả lời:"
INFO_LINE = "Thông tin: {total} nguồn tin | Thời gian: {duration}ms"
REFERENCES_HEAD = "References Used:"

# Prompt wording of our own; the two markers are filled in per question.
SYSTEM_PROMPT = "You answer questions about the news from the given articles only, naming the title of each source you use."
HUMAN_PROMPT = "Articles:\n{context}\n\nQuestion:\n{question}\n\nIf the articles do not answer the question, say so.\nAnswer:"

@dataclass(frozen=True)
class Model:
    """One registered generator."""

    name: str
    model_id: str
    provider: str


def context(results: Column) -> Column:
    """Numbered hits with their source, a blank line between them."""
    blocks = F.transform(
        results,
        lambda hit, i: F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] "), hit["title"], F.lit(": "), hit["content"],
            F.lit("\nSource: "), hit["url"],
        ),
    )
    return F.array_join(blocks, "\n\n")


def prompt(context_text: Column, question: Column) -> Column:
    """System and human part in one text. The question is put in last, so markers inside articles stay as they are."""
    head, middle = HUMAN_PROMPT.split("{context}")
    before, after = middle.split("{question}")
    return F.concat(F.lit(SYSTEM_PROMPT + "\n\n" + head), context_text, F.lit(before), question, F.lit(after))


def strip_think(answer: Column) -> Column:
    """Drop every ``<think>`` section, then trim."""
    return strip(F.regexp_replace(F.coalesce(answer, F.lit("")), "(?is)<think>.*?</think>", ""))


def answer_record(lists: DataFrame, answer: Column) -> DataFrame:
    """Query, summary, hits and total; a query without hits gets the fixed text."""
    total = F.size("results")
    return lists.select(
        "*",
        F.when(total == 0, F.lit(NOTHING_FOUND)).otherwise(answer).alias("summary"),
        total.cast("bigint").alias("total"),
    )


def references(results: Column) -> Column:
    lines = F.transform(
        results,
        lambda hit, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), hit["title"], F.lit(" | Link: "), hit["url"]),
    )
    return F.array_join(lines, "\n")


def format_answer(summary: Column, total: Column, duration_ms: Column, results: Column) -> Column:
    """The whole answer as shown to a reader."""
    before, rest = INFO_LINE.split("{total}")
    middle, after = rest.split("{duration}")
    listed = F.when(F.size(results) > 0, F.concat(F.lit(f"\n\n{REFERENCES_HEAD}\n"), references(results))).otherwise(F.lit(""))
    return F.concat(
        F.lit(f"{RULE}\n{ANSWER_HEAD}\n"), F.coalesce(summary, F.lit(NO_ANSWER)), F.lit("\n\n" + before),
        total.cast("string"), F.lit(middle), duration_ms.cast("string"), F.lit(after), listed, F.lit("\n" + RULE),
    )


def registry(models: DataFrame) -> list[Model]:
    """The registry as a list, in its order; it is configuration."""
    return [Model(r["name"], r["model_id"], r["provider"]) for r in models.orderBy("position").collect()]


def listing(models: DataFrame, classes: dict[str, str]) -> DataFrame:
    """position, name, model_id, provider, class of the models whose provider is known.

    ``classes``: generator class of each provider, in lower case. A model id belongs to the
    last model that has it; the others show "N/A". A name counts once, at its first
    place, with what its last entry says.
    """
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in classes.items() for x in pair]), F.lower("provider"))
    known = models.withColumn("class", kind).filter(F.col("class").isNotNull())
    owner = known.groupBy("model_id").agg(F.max("position").alias("_owner"))
    named = known.groupBy("name").agg(
        F.min("position").alias("first"), F.max(F.struct("position", "model_id", "provider", "class")).alias("last"))
    shown = named.select("name", F.col("first").alias("position"), F.col("last.position").alias("_place"), "last.model_id", "last.provider", "last.class")
    return shown.join(owner, "model_id").select(
        "position", "name", F.when(F.col("_place") == F.col("_owner"), F.col("model_id")).otherwise("N/A").alias("model_id"), "provider", "class")


def per_model(df: DataFrame, models: list[Model]) -> DataFrame:
    """Every row once per model, by exploding a literal list (no join)."""
    entries = F.array(*[
        F.struct(F.lit(m.name).alias("model"), F.lit(m.model_id).alias("model_id"), F.lit(m.provider).alias("provider"))
        for m in models
    ])
    return df.select("*", F.inline(entries))


# A generator answers a batch of prompts; a loader makes one, once in each task.
Generator = Callable[[list[str]], list[str]]
Loader = Callable[[], Generator]


def _answers(loaders: dict[str, Loader], loaded: dict[str, Generator], model: str, prompts: list[str]) -> list[tuple]:
    """Answer and error of each prompt. A batch that fails is tried prompt by prompt."""
    try:
        if model not in loaded:
            loaded[model] = loaders[model]()
        replies = loaded[model](prompts)
        if len(replies) != len(prompts):
            raise ValueError(f"{len(replies)} answers to {len(prompts)} prompts")
        return [(reply, None) for reply in replies]
    except Exception as failure:  # noqa: BLE001 - the failure is the result of its row
        if len(prompts) > 1:
            return [_answers(loaders, loaded, model, [prompt])[0] for prompt in prompts]
        return [(None, f"{type(failure).__name__}: {failure}")]


def generate(df: DataFrame, loaders: dict[str, Loader], batch: int = 32) -> DataFrame:
    """Add ``response`` and ``error`` from the generator of each row's ``model`` to its ``prompt``.

    Each task loads a generator once, when it first needs it, and gives it prompts in
    batches of ``batch``. A prompt that fails costs only its own row.
    """

    @F.pandas_udf("response string, error string")
    def call(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        loaded: dict[str, Generator] = {}
        for models, prompts in parts:
            out = pd.DataFrame({"response": None, "error": None}, index=models.index, dtype=object)
            for model, rows in models.groupby(models).groups.items():
                for start in range(0, len(rows), batch):
                    some = rows[start : start + batch]
                    replies = _answers(loaders, loaded, model, prompts.loc[some].tolist())
                    out.loc[some, ["response", "error"]] = pd.DataFrame(replies, index=some, columns=["response", "error"], dtype=object)
            yield out

    out = df.withColumn("_out", call("model", "prompt"))
    return out.select(*df.columns, F.col("_out.response").alias("response"), F.col("_out.error").alias("error"))


def ask(lists: DataFrame, models: list[Model], loaders: dict[str, Loader]) -> DataFrame:
    """From hit lists to shown answers.

    ``lists``: query_id, query, identifier (of a model), results. Returns query_id, query,
    model, summary, total, results, error. The model is resolved, the prompt built from
    the hits, the generator asked, think sections dropped. A query without hits gets the
    fixed text and no generator is asked. Where the model is unknown or the generator
    fails, the record is that of a failure: no summary, no hits, total 0, and the error.
    """
    resolved = resolve(lists, models)
    prompted = resolved.withColumn("prompt", F.when(F.size("results") > 0, prompt(context(F.col("results")), F.col("query"))))
    asked = generate(prompted.filter(F.col("prompt").isNotNull() & F.col("model").isNotNull()), loaders)
    silent = prompted.filter(F.col("prompt").isNull() | F.col("model").isNull()).select(
        "*", F.lit(None).cast("string").alias("response"),
        F.when(F.col("model").isNull(), F.concat(F.lit("unknown model: "), F.coalesce("identifier", F.lit("")))).alias("error"))
    every = asked.unionByName(silent)
    failed = F.col("error").isNotNull()
    kept = every.withColumn("results", F.when(failed, F.slice("results", F.lit(1), F.lit(0))).otherwise(F.col("results")))
    records = answer_record(kept, strip_think(F.col("response")))
    return records.select(
        "query_id", "query", "model", F.when(~failed, F.col("summary")).alias("summary"), "total", "results", "error")


def resolve(requests: DataFrame, models: list[Model]) -> DataFrame:
    """Model of each ``identifier``: by name, else by model id; the first one for "default" or nothing.

    An identifier that is not registered resolves to NULL.
    """
    if not models:
        raise ValueError("no models are registered")
    by_name = F.create_map(*[F.lit(x) for m in models for x in (m.name, m.name)])
    ids = {m.model_id: m.name for m in models}
    by_id = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    asked = F.col("identifier")
    first = F.lit(models[0].name)
    unnamed = F.coalesce(asked, F.lit("")) == ""
    default = (asked == "default") & F.lit("default" not in {m.name for m in models})
    found = F.coalesce(F.try_element_at(by_name, asked), F.try_element_at(by_id, asked))
    return requests.withColumn("model", F.when(unnamed | default, first).otherwise(found))
