"""Queries for contexts, prompts, answers, models and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet import schemas
from broadsheet.plans import answers, evaluate
from broadsheet.queryset import fixtures, sql
from broadsheet.queryset.registry import query
from broadsheet.queryset.search_queries import token_parts
from broadsheet.session import new_path
from broadsheet.sources import evalset

sql.part("contexts", r"""
  SELECT a.query_id, a.query, a.text, count(h.id) AS total,
    coalesce(string_agg(concat('[', rank, '] ', title, ': ', content, chr(10), 'Source: ', url), chr(10) || chr(10) ORDER BY rank) FILTER (h.id IS NOT NULL), '') AS context,
    coalesce(string_agg(concat('[', rank, '] ', title, ' | Link: ', url), chr(10) ORDER BY rank) FILTER (h.id IS NOT NULL), '') AS refs,
    max(CASE WHEN rank = 1 THEN concat('[', rank, '] ', title, ': ', content, chr(10), 'Source: ', url) END) AS lead,
    coalesce(list(content ORDER BY rank) FILTER (h.id IS NOT NULL), []) AS contents
  FROM accepted a LEFT JOIN hits h ON a.query_id = h.query_id GROUP BY a.query_id, a.query, a.text""", "accepted", "hits")
sql.part("models", """
  SELECT row_number() OVER (ORDER BY lang) AS position, concat('m_', lang) AS name, concat(lang, '-1') AS model_id, 'local' AS provider
  FROM (SELECT DISTINCT lang FROM documents)""")


@query("context_build", sql.statement("SELECT query_id, context FROM contexts", "contexts"))
def context_build(spark, sf_dir):
    return fixtures.hit_lists(spark, sf_dir).select("query_id", answers.context(F.col("results")).alias("context"))


def _lit(text: str) -> str:
    return " || chr(10) || ".join(f"'{line}'" for line in text.split("\n"))


_HEAD, _REST = answers.HUMAN_PROMPT.split("{context}")
_MIDDLE, _TAIL = _REST.split("{question}")


@query("prompt_build", sql.statement(
    f"SELECT query_id, concat({_lit(answers.SYSTEM_PROMPT + chr(10) * 2 + _HEAD)}, context, {_lit(_MIDDLE)}, query, {_lit(_TAIL)}) AS prompt "
    "FROM contexts", "contexts"))
def prompt_build(spark, sf_dir):
    lists = fixtures.hit_lists(spark, sf_dir)
    return lists.select("query_id", answers.prompt(answers.context(F.col("results")), F.col("query")).alias("prompt"))


_SUMMARY = f"CASE WHEN total = 0 THEN '{answers.NOTHING_FOUND}' ELSE concat('Answer to: ', query) END"


def _records(spark, sf_dir):
    return answers.answer_record(fixtures.hit_lists(spark, sf_dir), F.concat(F.lit("Answer to: "), F.col("query")))


@query("answer_record", sql.statement(f"SELECT query_id, query, {_SUMMARY} AS summary, total FROM contexts", "contexts"))
def answer_record(spark, sf_dir):
    return _records(spark, sf_dir).select("query_id", "query", "summary", "total")


@query("strip_think", rf"""
  SELECT conv_id, turn, {sql.strip("regexp_replace(shown, '(?is)<think>.*?</think>', '', 'g')")} AS answer FROM (
    SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN concat('<think>step', chr(10), role, '</think> ', text, ' <THINK>x</THINK>')
      ELSE text END AS shown FROM conversations)""")
def strip_think(spark, sf_dir):
    turns = fixtures.table(spark, sf_dir, "conversations")
    thought = F.concat(F.lit("<think>step\n"), "role", F.lit("</think> "), "text", F.lit(" <THINK>x</THINK>"))
    shown = F.when(F.col("conv_id") % 2 == 0, thought).otherwise(F.col("text"))
    return turns.select("conv_id", "turn", answers.strip_think(shown).alias("answer"))


@query("answer_format", sql.statement(f"""
  SELECT query_id, concat('{answers.RULE}', chr(10), '{answers.ANSWER_HEAD}', chr(10), {_SUMMARY}, chr(10), chr(10),
    'Thông tin: ', total, ' nguồn tin | Thời gian: ', '0.0', 'ms',
    CASE WHEN total > 0 THEN concat(chr(10), chr(10), '{answers.REFERENCES_HEAD}', chr(10), refs) ELSE '' END,
    chr(10), '{answers.RULE}') AS formatted FROM contexts""", "contexts"))
def answer_format(spark, sf_dir):
    """Formatted answers; the duration is set to 0.0 to keep the result repeatable."""
    text = answers.format_answer(F.col("summary"), F.col("total"), F.lit("0.0"), F.col("results"))
    return _records(spark, sf_dir).select("query_id", text.alias("formatted"))


_ECHO_OR_LEAD = "CASE position WHEN 1 THEN query WHEN 2 THEN lead END"


@query("compare_models", sql.statement(f"""
  SELECT query_id, name AS model, provider, total AS context_documents, {_ECHO_OR_LEAD} AS response,
    CASE WHEN position > 2 THEN 'ValueError: model is not available' END AS error
  FROM contexts CROSS JOIN models WHERE total > 0""", "contexts", "models"))
def compare_models(spark, sf_dir):
    return fixtures.compared(spark, sf_dir).select(
        "query_id", "model", "provider", F.size("results").cast("bigint").alias("context_documents"), "response", "error")


# Each query names a model: by name, by id, none at all, or one that is not there.
sql.part("requests", """
  SELECT query_id, CASE query_id % 4 WHEN 0 THEN 'm_de' WHEN 1 THEN 'en-1' WHEN 2 THEN '' ELSE 'nobody' END AS identifier FROM contexts""", "contexts")
sql.part("asked", f"""
  SELECT c.query_id, c.query, c.total AS hits, r.identifier, m.name AS model, CASE m.position WHEN 1 THEN query WHEN 2 THEN lead END AS reply,
    CASE WHEN m.name IS NULL THEN concat('unknown model: ', r.identifier)
      WHEN c.total > 0 AND m.position > 2 THEN 'ValueError: model is not available' END AS error
  FROM contexts c JOIN requests r USING (query_id)
    LEFT JOIN models m ON r.identifier IN (m.name, m.model_id) OR (r.identifier = '' AND m.position = 1)""", "contexts", "requests", "models")


@query("ask", sql.statement(f"""
  SELECT query_id, query, model, CASE WHEN error IS NOT NULL THEN NULL WHEN hits = 0 THEN '{answers.NOTHING_FOUND}'
    ELSE {sql.strip("reply")} END AS summary, CASE WHEN error IS NOT NULL THEN 0 ELSE hits END AS total, error FROM asked""", "asked"))
def ask(spark, sf_dir):
    """Questions through retrieval, prompt and generator to the answer record, failures included."""
    which = F.col("query_id") % 4
    identifier = F.when(which == 0, "m_de").when(which == 1, "en-1").when(which == 2, "").otherwise("nobody")
    lists = fixtures.hit_lists(spark, sf_dir).select("query_id", "query", "results", identifier.alias("identifier"))
    registered = fixtures.models(spark, sf_dir)
    records = answers.ask(lists, registered, fixtures.generators(registered))
    return records.select("query_id", "query", "model", "summary", "total", "error")


@query("model_list", sql.statement("""
  SELECT position, name, CASE WHEN position = 2 THEN 'N/A' ELSE model_id END AS model_id, provider, 'LocalGenerator' AS class FROM models
  UNION ALL SELECT 100, 'late', model_id, 'LOCAL', 'LocalGenerator' FROM models WHERE position = 2""", "models"))
def model_list(spark, sf_dir):
    """The registry with a later model that takes over an id, and one of a provider that nobody serves."""
    table = fixtures.model_table(spark, sf_dir)
    late = table.filter("position = 2").select(F.lit(100).alias("position"), F.lit("late").alias("name"), "model_id", F.lit("LOCAL").alias("provider"))
    other = table.filter("position = 1").select(
        F.lit(101).alias("position"), F.lit("other").alias("name"), F.lit("o-1").alias("model_id"), F.lit("elsewhere").alias("provider"))
    rows = answers.listing(table.unionByName(late).unionByName(other), {"local": "LocalGenerator"})
    return rows.withColumn("position", F.col("position").cast("bigint"))


@query("model_resolve", sql.statement("""
  SELECT doc_id, identifier, CASE WHEN coalesce(identifier, '') IN ('', 'default') THEN (SELECT name FROM models WHERE position = 1)
    ELSE coalesce(n.name, i.name) END AS model
  FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('m_', lang) WHEN 1 THEN concat(lang, '-1') WHEN 2 THEN 'default'
      WHEN 3 THEN '' WHEN 4 THEN NULL ELSE source END AS identifier FROM documents) r
    LEFT JOIN models n ON r.identifier = n.name LEFT JOIN models i ON r.identifier = i.model_id""", "models"))
def model_resolve(spark, sf_dir):
    """One request per document: by name, by model id, default, empty, absent or unknown."""
    which = F.col("doc_id") % 6
    asked = (
        F.when(which == 0, F.concat(F.lit("m_"), "lang")).when(which == 1, F.concat("lang", F.lit("-1")))
        .when(which == 2, "default").when(which == 3, "").when(which == 5, F.col("source"))
    )
    requests = fixtures.table(spark, sf_dir, "documents").select("doc_id", asked.alias("identifier"))
    return answers.resolve(requests, fixtures.models(spark, sf_dir))


# Evaluation: benchmark texts are the truths, their queries the questions.


@query("evalset_scan", f"""
  SELECT {sql.strip("u.text")} AS question, {sql.strip("a.text")} AS ground_truth FROM conversations u
  JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""")
def evalset_scan(spark, sf_dir):
    """Question set written as CSV with quotes, commas and line breaks, and read back."""
    path = new_path(spark, "evalset")
    pairs = fixtures.qa(spark, sf_dir).select("question", F.col("answer").alias("ground_truth"))
    evalset.write_testset(pairs, path)
    return evaluate.trimmed(evalset.read_testset(spark, path))


def _testset(spark, sf_dir):
    lists = fixtures.hit_lists(spark, sf_dir)
    return lists.select("query_id", F.col("query").alias("question"), F.col("text").alias("ground_truth"), "results")


@query("eval_cases", sql.statement(f"""
  SELECT query_id, query AS question, {sql.strip("text")} AS ground_truth, name AS model FROM accepted CROSS JOIN models""",
    "accepted", "models"))
def eval_cases(spark, sf_dir):
    cases = evaluate.cases(_testset(spark, sf_dir), fixtures.models(spark, sf_dir))
    return cases.select("query_id", "question", "ground_truth", "model")


sql.part("eval_rows", f"""
  SELECT query_id, query AS question, {sql.strip("text")} AS ground_truth, name AS model, contents,
    CASE WHEN total > 0 THEN coalesce({_ECHO_OR_LEAD}, '{evaluate.NO_INFORMATION}') ELSE '{evaluate.NO_INFORMATION}' END AS answer
  FROM contexts CROSS JOIN models""", "contexts", "models")


def _dataset(spark, sf_dir):
    """Every case with the answer of its model; queries without hits have no response."""
    cases = evaluate.cases(_testset(spark, sf_dir), fixtures.models(spark, sf_dir))
    responses = fixtures.compared(spark, sf_dir).select("query_id", "model", "response")
    return evaluate.dataset(cases.join(responses, ["query_id", "model"], "left"))


@query("eval_dataset", sql.statement("""
  SELECT query_id, model, question, answer, ground_truth, array_to_string(contents, chr(10) || '---' || chr(10)) AS contexts,
    CAST(len(contents) AS BIGINT) AS context_count FROM eval_rows""", "eval_rows"))
def eval_dataset(spark, sf_dir):
    return _dataset(spark, sf_dir).select(
        "query_id", "model", "question", "answer", "ground_truth", F.array_join("contexts", "\n---\n").alias("contexts"),
        F.size("contexts").cast("bigint").alias("context_count"),
    )


def _scored(spark, sf_dir):
    return fixtures.once(spark, sf_dir, "scored", lambda: fixtures.stage(
        evaluate.scores(_dataset(spark, sf_dir), schemas.DENSE_DIM).drop("results"), "scored"))


def _metric(spark, sf_dir, name):
    return _scored(spark, sf_dir).select("query_id", "model", name)


_TOKENS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'))"
_SETS = "list_transform(contents, lambda c: " + _TOKENS.format("c") + ")"


def _supported(text: str) -> str:
    wanted = (f"list_filter(list_transform(regexp_split_to_array({text}, '[.!?]'), lambda s: {_TOKENS.format('s')}), "
              "lambda t: len(t) > 0)")
    return f"""SELECT query_id, model, len(wanted) AS n, len(list_filter(wanted, lambda s:
      len(list_filter(sets, lambda c: len(list_intersect(s, c)) * 5 >= len(s) * 3)) > 0)) AS good
    FROM (SELECT query_id, model, {wanted} AS wanted, {_SETS} AS sets FROM eval_rows)"""


sql.part("faithfulness", f"SELECT query_id, model, {sql.ratio('good', 'n', 6)} AS faithfulness FROM ({_supported('answer')})", "eval_rows")
sql.part("context_recall", f"SELECT query_id, model, {sql.ratio('good', 'n', 6)} AS context_recall FROM ({_supported('ground_truth')})", "eval_rows")
sql.part("eval_questions", "SELECT query_id || '|' || model AS case_id, question FROM eval_rows", "eval_rows")
sql.part("eval_answers", "SELECT query_id || '|' || model AS case_id, answer FROM eval_rows", "eval_rows")
token_parts("eq", "eval_questions", "case_id", "question", schemas.DENSE_DIM)
token_parts("ea", "eval_answers", "case_id", "answer", schemas.DENSE_DIM)


def _slots(prefix: str) -> str:
    return f"(SELECT case_id, token_id % {schemas.DENSE_DIM} AS slot, sum(tf * sign) AS v FROM {prefix}_tokens GROUP BY ALL)"


sql.part("relevancy", f"""
  SELECT e.query_id, e.model, CASE WHEN ql.l > 0 AND al.l > 0
      THEN round(coalesce(d.dot, 0) / sqrt(CAST(ql.l AS DOUBLE) * CAST(al.l AS DOUBLE)), 6) + 0.0 ELSE 0.0 END AS answer_relevancy
  FROM eval_rows e
  LEFT JOIN (SELECT case_id, sum(v * v) AS l FROM {_slots("eq")} GROUP BY case_id) ql ON ql.case_id = e.query_id || '|' || e.model
  LEFT JOIN (SELECT case_id, sum(v * v) AS l FROM {_slots("ea")} GROUP BY case_id) al ON al.case_id = e.query_id || '|' || e.model
  LEFT JOIN (SELECT q.case_id, CAST(sum(q.v * a.v) AS DOUBLE) AS dot FROM {_slots("eq")} q JOIN {_slots("ea")} a
    ON q.case_id = a.case_id AND q.slot = a.slot GROUP BY q.case_id) d ON d.case_id = e.query_id || '|' || e.model""",
         "eval_rows", "eq_tokens", "ea_tokens")
sql.part("context_precision", f"""
  SELECT query_id, model, CASE WHEN len(ranks) > 0 THEN round(list_sum(list_transform(ranks,
      lambda r, j: (2 * j * 1000000 + r) // (2 * r))) / len(ranks) / 1000000.0, 6) ELSE 0.0 END AS context_precision
  FROM (SELECT query_id, model, list_filter(list_transform(sets,
      lambda c, i: CASE WHEN len(wanted) > 0 AND len(list_intersect(wanted, c)) * 5 >= len(wanted) * 3 THEN i ELSE 0 END),
      lambda r: r > 0) AS ranks
    FROM (SELECT query_id, model, {_TOKENS.format("ground_truth")} AS wanted, {_SETS} AS sets FROM eval_rows))""", "eval_rows")


@query("eval_faithfulness", sql.statement("SELECT * FROM faithfulness", "faithfulness"))
def eval_faithfulness(spark, sf_dir):
    return _metric(spark, sf_dir, "faithfulness")


@query("eval_relevancy", sql.statement("SELECT * FROM relevancy", "relevancy"))
def eval_relevancy(spark, sf_dir):
    return _metric(spark, sf_dir, "answer_relevancy")


@query("eval_ctx_precision", sql.statement("SELECT * FROM context_precision", "context_precision"))
def eval_ctx_precision(spark, sf_dir):
    return _metric(spark, sf_dir, "context_precision")


@query("eval_ctx_recall", sql.statement("SELECT * FROM context_recall", "context_recall"))
def eval_ctx_recall(spark, sf_dir):
    return _metric(spark, sf_dir, "context_recall")


def _mean(metric: str) -> str:
    return f"round(sum(CAST(round({metric} * 1000000) AS BIGINT)) / count(*) / 1000000.0, 6) AS {metric}"


sql.part("all_scores", """
  SELECT * FROM faithfulness JOIN relevancy USING (query_id, model) JOIN context_precision USING (query_id, model)
    JOIN context_recall USING (query_id, model)""", "faithfulness", "relevancy", "context_precision", "context_recall")


@query("eval_summary", sql.statement(
    f"SELECT model, count(*) AS cases, {', '.join(map(_mean, evaluate.METRICS))} FROM all_scores GROUP BY model", "all_scores"))
def eval_summary(spark, sf_dir):
    return evaluate.summary(_scored(spark, sf_dir))


@query("eval_sink", sql.statement(f"SELECT query_id, model, {', '.join(evaluate.METRICS)} FROM all_scores", "all_scores"))
def eval_sink(spark, sf_dir):
    """Scores written as one CSV folder per model, with a byte-order mark, and read back."""
    path = new_path(spark, "scores")
    scores = _scored(spark, sf_dir).select("query_id", "model", *evaluate.METRICS)
    evalset.write_scores(scores, path)
    return evalset.read_scores(spark, path, scores.schema)
