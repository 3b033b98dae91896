"""One query for each operator, over its whole table, and the pipeline."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from broadsheet.functions.text import let
from broadsheet.llm import (
    block_topk, chat_format, decontamination, licenses, mixing, ngram_join, periodic_runs, quality, sharding, spelling, substring_dedup,
    token_counts, toxicity,
)
from broadsheet.llm.folds import held_out
from broadsheet.llm.registry import ORACLES, QUERIES, query  # noqa: F401
from broadsheet.llm.scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Jaccard similarity through an inverted list of shingles; the components by walking the links.
NGRAM_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
flat AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, word || ' ' || lead(word) OVER follow || ' ' || lead(word, 2) OVER follow AS g
    FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM worded WHERE len(w) >= 3)
    WINDOW follow AS (PARTITION BY doc_id ORDER BY i)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM worded WHERE len(w) BETWEEN 1 AND 2)
  WHERE g IS NOT NULL),
sized AS (SELECT doc_id, CAST(count(g) AS BIGINT) AS n FROM documents LEFT JOIN flat USING (doc_id) GROUP BY doc_id),
shared AS (SELECT g, row_number() OVER () AS number FROM flat GROUP BY g HAVING count(*) > 1),
numbered AS (SELECT doc_id, number FROM flat JOIN shared USING (g)),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM numbered x JOIN numbered y ON x.number = y.number AND x.doc_id < y.doc_id GROUP BY 1, 2),
linked AS (
  SELECT a, b FROM pairs JOIN sized p ON p.doc_id = a JOIN sized q ON q.doc_id = b
  WHERE 100 * shared >= 90 * (p.n + q.n - shared)),
links AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
walk AS (
  SELECT doc_id, doc_id AS reached FROM sized
  UNION SELECT walk.doc_id, links.b FROM walk JOIN links ON links.a = walk.reached)
SELECT w.doc_id, any_value(n) AS n_shingles, min(reached) AS component_id
FROM walk w JOIN sized USING (doc_id) GROUP BY w.doc_id
"""


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


@query("op1_ngram_jaccard_join", NGRAM_SQL)
def op1_ngram_jaccard_join(spark, sf_dir):
    classes, _ = ngram_join.join(table(spark, sf_dir, "documents"), words=3, of=90, out_of=100)
    return classes.select("doc_id", F.col("size").alias("n_shingles"), "component_id")


# Levels as in water filling: a source whose cap lies under the level is full, the others share by weight.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 3 * source_size AS cap,
    CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS DOUBLE) AS weight
  FROM sources),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE),
    max(CASE WHEN level <= cap / weight THEN level END) OVER () * weight), 0.0) AS target
  FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS demand,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(
  greatest(0, least(size, demand - before)) + greatest(0, least(size, demand - source_size - before))
  + greatest(0, least(size, demand - 2 * source_size - before)) AS BIGINT) AS taken
FROM placed
"""


@query("op6_curriculum_mix", MIX_SQL)
def op6_curriculum_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.in_order(mixing.mix(docs, carry=["doc_id"]))
    return mixed.select("doc.doc_id", "size", "source_size", "target", "taken")


@query("op7_hilbert_shards")
def op7_hilbert_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sharding.shard(docs, shards=16, carry=["doc_id"]).select("doc_id", *sharding.OWN)


TOPK_SQL = """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM scaled q JOIN scaled c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT * FROM ranked WHERE rank <= 5
"""


@query("op8_block_topk", TOPK_SQL)
def op8_block_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), block_topk.scaled(F.col("embedding")).alias("vector"))
    found = block_topk.search(vectors, F.col("id") % 50 == 0, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def taught(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learned from."""
    return table(spark, sf_dir, "labels").filter(~held_out())


@query("op2_pu_quality")
def op2_pu_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, taught(spark, sf_dir), "quality")
    scored = docs.select("doc_id", held_out().alias("held_out"), quality.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op10_weak_toxicity")
def op10_weak_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, taught(spark, sf_dir), "toxic")
    scored = docs.select("doc_id", held_out().alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op5_template_decontamination")
def op5_template_decontamination(spark, sf_dir):
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "windows", "found", "coverage", "slots", "agreeing")


@query("op9_line_hash_dedup")
def op9_line_hash_dedup(spark, sf_dir):
    left, _ = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", F.size("removed").alias("n_removed"), "removed", "text")


@query("op3_license_scan")
def op3_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


# Where the public vocabularies lie, and an id that theirs does not use.
VOCABULARY = os.environ.get("TOKENIZER_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
SEPARATOR = 50256


@query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(docs, "flat-tokens")
    flat = scratch.keep(token_counts.flat_files(docs, VOCABULARY, SEPARATOR))
    found = token_counts.counts(flat.filter("data is not null"), SEPARATOR)
    named = flat.filter("ordinal is not null").select("file", "ordinal", "doc_id")
    result = scratch.keep(named.join(found, ["file", "ordinal"]).select("doc_id", F.col("tokens").alias("n_tokens")))
    scratch.drop(flat)
    return result


# The marks of the template are measured, not written: what is read back is the same, and so is the length.
CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
placed AS (
  SELECT *, row_number() OVER follow AS place, lag(role) OVER follow AS before
  FROM turns WINDOW follow AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text)),
measured AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(s>|/s>|/?INST\]|ROLE|/ROLE\]|AND\])'))
    + CASE WHEN place > 1 AND before IS NOT DISTINCT FROM role THEN length(' [AND] ')
           WHEN role = 'user' THEN length('[INST]  [/INST]') WHEN role = 'assistant' THEN length('<s>  </s>')
           ELSE length('[ROLE]  [/ROLE]') + coalesce(1 + length(role) + len(regexp_extract_all(role, '[\[\]<\\]')), 0) END AS chars
  FROM placed)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM measured GROUP BY conv_id
"""


@query("op11_chat_format", CHAT_SQL)
def op11_chat_format(spark, sf_dir):
    """The given conversations and one that quotes the template; what the digests cover is read back from the formatted text."""
    quoting = spark.sql("""SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')
                           AS t(conv_id, turn, role, text)""")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(quoting)
    made = chat_format.format_conversations(turns)
    shown = F.struct(
        chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_learned(F.col("pieces")).alias("learned"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))

    def digests(read):
        said = F.transform(read["turns"], lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n")))
        return F.struct(
            F.size(read["turns"]).cast("bigint").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
            F.length(read["learned"]).cast("bigint").alias("loss_chars"), F.sha2(read["learned"], 256).alias("loss_sha256"),
            read["formatted_chars"].alias("formatted_chars"))

    return made.select("conv_id", let(shown, digests).alias("d")).select("conv_id", "d.*")


WORD = r"[^\x20\x09-\x0D]+"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: every tenth document by its id's checksum repeats a stretch of its words from some place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def repeat(words, h):
        g, n = F.floor(h / 10), F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return let(F.struct(a.alias("a"), p.alias("p")), lambda v: F.array_join(F.transform(
            words, lambda w, i: F.when(i < v["a"], w).otherwise(F.get(words, (v["a"] + F.pmod(i - v["a"], v["p"])).cast("int")))), " "))

    chosen = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    planted = let(chosen, lambda words: F.when(F.size(words) > 0, repeat(words, h)).otherwise(""))
    return docs.select("doc_id", F.when((F.pmod(h, F.lit(10)) == 0) & F.col("text").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    found = periodic_runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    rows = found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.array_max(ranked).alias("best"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.p")
    return rows.select(
        "doc_id", "n_runs", (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"),
        F.call_function("div", 1000 * length, period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_COUNT = 6, 5


def planted_vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the longer words that occur often enough, one in 199 of a document's words with a letter left out.

    Shorter runs are passed over before they are listed: none of them can become longer.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"[A-Za-z\u00C0-\u00FF]{{{LEAST_LETTERS},}}"), F.lit(0))).alias("run"))
    lowered = runs.select("doc_id", F.when(F.rlike("run", F.lit("[A-Z]")), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    place = F.pmod(h, F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2))
    words = lowered.select(F.when(F.pmod(h, F.lit(199)) == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = words.filter(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


@query("op13_spelling_variants")
def op13_spelling_variants(spark, sf_dir):
    found = spelling.group_variants(planted_vocabulary(table(spark, sf_dir, "documents")), times=5)
    return found.select("word", "form", "root", "n", "n_near", "form_n")
