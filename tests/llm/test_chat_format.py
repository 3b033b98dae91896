"""Chat formatting: the DuckDB statement, an exact round trip of hostile texts, and the edges."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from broadsheet.llm import chat_format
from broadsheet.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
MARKS = ["<s> ", " </s>", "<s>", "</s>", "[INST]", "[/INST]", " [AND] ", "[ROLE", "[ROLE x] ", " [/ROLE]", "\\", "<", "[", "]", " ", "a", "\n", "é", "<\\s>", "[\\\\INST]"]


def formatted(spark, rows):
    made = chat_format.format_conversations(spark.createDataFrame(rows, SCHEMA))
    return made.select(
        "conv_id", "formatted", "pieces", "n_blocks", chat_format.read_turns(F.col("formatted")).alias("turns"),
        chat_format.read_learned(F.col("pieces")).alias("learned"))


def key(row):
    return tuple((v is not None, v) for v in row)


def check(made, rows):
    by_id = {}
    for i, turn, role, text in rows:
        by_id.setdefault(i, []).append((turn, role, text or ""))
    assert len(made) == len(by_id)
    for r in made:
        turns = [t[1:] for t in sorted(by_id[r["conv_id"]], key=key)]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["learned"] == "".join(text for role, text in turns if role == "assistant")
        assert "".join(p["text"] for p in r["pieces"]) == r["formatted"]
        assert r["n_blocks"] == sum(i == 0 or turns[i - 1][0] != t[0] for i, t in enumerate(turns))


def test_statement(spark, sf_dir, duck):
    got = QUERIES["op11_chat_format"](spark, sf_dir)
    want = duck.sql(ORACLES["op11_chat_format"])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(tuple(r) for r in got.select(*want.columns).collect())
    assert rows == sorted(want.fetchall()) and rows[0][0] == -7 and rows[0][1] == 2
    said = "</s>[INST] ok [/INST]"
    own = got.filter("conv_id = -7").first()
    assert own["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert own["loss_chars"] == len(said) and own["formatted_chars"] > 2 * len(said)


def test_shape(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hello"), (1, 2, "user", "are you there"), (1, 3, "assistant", "yes </s>")]
    (row,) = formatted(spark, rows).collect()
    assert row["formatted"] == "[ROLE system] be kind [/ROLE][INST] hello [AND] are you there [/INST]<s> yes <\\/s> </s>"
    assert [p["text"] for p in row["pieces"] if p["learned"]] == ["yes <\\/s>"]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(
    st.sampled_from([1, 2, None]), st.one_of(st.none(), st.integers(0, 5)),
    st.one_of(st.none(), st.sampled_from(["user", "assistant", "", "tool", "a] b", "[/ROLE]", "x\\c<s>"])),
    st.one_of(st.none(), st.lists(st.sampled_from(MARKS), max_size=6).map("".join))), min_size=1, max_size=60))
def test_round_trip(spark, rows):
    check(formatted(spark, rows).collect(), rows)


def test_edges(spark):
    long = "word <s> " * 60_000
    rows = [
        (None, None, None, None), (None, 0, "user", "of nobody"), (1, 0, "user", ""), (1, 0, "user", ""), (1, 1, "assistant", None),
        (2, 0, "assistant", long), (2, 1, "assistant", long), (3, None, "user", "late?"), (3, 0, None, "x"), (4, 0, "user", "\n"),
        *[(5, i, "user" if i % 3 else "assistant", f"turn {i}") for i in range(3000)],
    ]
    check(formatted(spark, rows).collect(), rows)
    clashing = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("turns", "made", "pieces", "formatted", "n_blocks")])
    assert chat_format.format_conversations(clashing).columns == ["conv_id", "n_blocks", "pieces", "formatted"]
    assert chat_format.format_conversations(clashing).count() == 6
    assert chat_format.format_conversations(clashing.limit(0)).count() == 0


def test_native(spark, sf_dir):
    plan = QUERIES["op11_chat_format"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and plan.count("Exchange") <= 2
