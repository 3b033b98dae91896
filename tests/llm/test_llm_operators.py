"""Operators against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import (
    block_topk, components, decontamination, licenses, mixing, ngram_join, quality, sharding, substring_dedup, token_counts, toxicity, words,
)


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 1)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    clean = [(a, b) for a, b in edges if a is not None and a != b]
    want = union(clean, {x for e in clean for x in e})
    assert got.keys() == want.keys()
    assert len({(got[n], want[n]) for n in want}) == len(set(want.values())) == len(set(got.values()))


def edited(rng, text, rate):
    return " ".join(f"new{rng.randrange(9999)}" if rng.random() < rate else w for w in text.split())


@pytest.mark.parametrize("k, of, out_of, every", [(3, 90, 100, False), (5, 4, 5, True)])
def test_join_matches_all_pairs(spark, monkeypatch, k, of, out_of, every):
    monkeypatch.setattr(ngram_join, "TILE_SETS", 8)  # small tiles, so groups are divided
    rng = random.Random(k)
    common = " ".join(f"c{i}" for i in range(30))
    texts = []
    for _ in range(12):
        base = " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(8, 160)))
        texts += [base] + [edited(rng, base, rng.choice([0, 0.005, 0.01, 0.03])) for _ in range(rng.randrange(1, 12))]
    base = " ".join(f"h{i}" for i in range(120))
    texts += [edited(rng, base, 0.01) for _ in range(40)] + [f"{common} own{i} words{i} of{i}" for i in range(30)] + ["x y", "X  y", "z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    classes, links = ngram_join.join(docs, k, of, out_of, every)

    def grams(t):
        w = t.lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])

    sets = [grams(t) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
              if out_of * len(sets[i] & sets[j]) >= of * len(sets[i] | sets[j])]
    want = union(linked, range(len(texts)))
    rows = classes.collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert {r["doc_id"]: r["size"] for r in rows} == dict(enumerate(map(len, sets)))
    if every:
        of_class = {}
        for r in rows:
            of_class.setdefault(r["class_id"], sets[r["doc_id"]])
        pairs = {frozenset((of_class[r["a"]], of_class[r["b"]])) for r in links.collect()}
        assert pairs == {frozenset((sets[i], sets[j])) for i, j in linked if sets[i] != sets[j]}


@pytest.mark.parametrize("low, high", [(-3, 3), (-300, 300)])
def test_topk_matches_all_scores(spark, monkeypatch, low, high):
    monkeypatch.setattr(block_topk, "BLOCK", 7)
    monkeypatch.setattr(block_topk, "SEGMENT", 3)
    monkeypatch.setattr(block_topk, "QUERIES", 4)
    rng = np.random.default_rng(high)
    matrix = rng.integers(low, high, (200, 6))
    ids = rng.permutation(1000)[:200]
    df = spark.createDataFrame([(int(i), [int(x) for x in v]) for i, v in zip(ids, matrix)], "id bigint, vector array<bigint>")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in block_topk.search(df, F.col("id") % 10 == 0, k=4).collect()}
    want = {}
    for q in np.flatnonzero(ids % 10 == 0):
        scores = matrix @ matrix[q]
        best = sorted((-int(s), int(i)) for n, (s, i) in enumerate(zip(scores, ids)) if n != q)[:4]
        want |= {(int(ids[q]), rank): (i, -s) for rank, (s, i) in enumerate(best, 1)}
    assert got == want


def test_hilbert_curve_visits_each_cell_by_single_steps(spark):
    cells = spark.range(8 * 8 * 8).selectExpr("cast(id div 64 as int) x", "cast(id div 8 % 8 as int) y", "cast(id % 8 as int) z")
    rows = cells.select("x", "y", "z", sharding.hilbert_index(F.array("x", "y", "z"), 3, 3).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(512))
    assert all(abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) + abs(a["z"] - b["z"]) == 1 for a, b in zip(rows, rows[1:]))


def test_equal_texts_follow_each_other_in_shards(spark):
    rows = [(i, f"text {i % 40}", "en" if i % 3 else "de", f"s{i % 7}") for i in range(400)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), 4).orderBy("shard", "slot").collect()
    runs = [r["text"] for i, r in enumerate(got) if not i or r["text"] != got[i - 1]["text"]]
    assert len(runs) == 40


@pytest.mark.parametrize("schedule", mixing.SCHEDULES + (((0.0, 0.0), (0.3, 2.0), (1.0, 0.0)),))
def test_positions_invert_the_integral(spark, schedule):
    times, weights = zip(*schedule)
    grid = np.linspace(0, 1, 200_001)
    level = np.interp(grid, times, weights)
    integral = np.concatenate([[0], np.cumsum((level[1:] + level[:-1]) / 2)])
    integral /= integral[-1]
    shares = [i / 40 for i in range(41)]
    rows = spark.createDataFrame([(s,) for s in shares], "s double").coalesce(1).select("s", mixing.position(F.col("s"), schedule).alias("t")).collect()
    assert max(abs(np.interp(r["t"], grid, integral) - r["s"]) for r in rows) < 1e-6


def test_targets_by_sharing_the_excess_again(spark):
    sizes = {"a": 10, "b": 5000, "c": 0, "d": 300, "e": 7, None: 900}
    got = {r["source"]: r["target"] for r in mixing.targets(
        spark.createDataFrame(list(sizes.items()), "source string, source_size bigint"), (5, 2, 1), 1.0, 3).collect()}
    names = ["a", "b", "c", "d", "e", None]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    want, open_, rest = {}, set(names), sum(sizes.values())
    while True:
        level = rest / sum(weight[n] for n in open_)
        full = {n for n in open_ if level * weight[n] > 3 * sizes[n]}
        if not full:
            break
        want |= {n: 3 * sizes[n] for n in full}
        rest, open_ = rest - sum(3 * sizes[n] for n in full), open_ - full
    want |= {n: level * weight[n] for n in open_}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("block", [3, 64, 1 << 16])
def test_token_counts_match_the_tokenizer(spark, monkeypatch, block):
    monkeypatch.setattr(token_counts, "GROUP", 4)
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    texts = ["one two three " * 30, "", None, "<|endoftext|> is text here", "x", "", "the end " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(2)
    flat = token_counts.flat_files(docs, path, 50256, block).cache()
    found = token_counts.counts(flat.filter("data is not null"), 50256)
    got = {r["doc_id"]: r["tokens"] for r in flat.filter("ordinal is not null").join(found, ["file", "ordinal"]).collect()}
    with open(path, "rb") as file:
        encode = token_counts.encoder(file.read())
    assert got == {i: len(encode.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_flat_files_from_a_folder(spark, tmp_path):
    rng = np.random.default_rng(3)
    want = {}
    for name in "ab":
        lengths = rng.integers(0, 30, 40).tolist() + [5]
        ids = np.concatenate([np.append(rng.integers(0, 99, n), 99) for n in lengths])[:-1]  # no separator at the end
        ids.astype("<u2").tofile(tmp_path / name)
        want[name] = lengths
    found = token_counts.counts(token_counts.read_flat(spark, str(tmp_path), block=16), 99).orderBy("ordinal").collect()
    got = {}
    for r in found:
        got.setdefault(r["file"][-1], []).append(r["tokens"])
    assert got == want


def test_changed_parameters_are_found(spark):
    item = "Yesterday Maria Lopez bought 12 apples for 3 dollars and walked 5 km home with her friend Tom Baker, then ate 2 of the apples."
    changed = "Yesterday Anna Smith bought 40 apples for 7 dollars and walked 9 miles home with her friend Joe Miller, then ate 6 of the apples."
    mixed = changed.replace("Anna Smith bought 40", "Anna Smith bought 40") + " And nothing else happened that day."
    other = "Yesterday the mayor opened a new bridge over the river, and 300 people walked home with their friends after it."
    texts = [item, changed, f"Some words before. {mixed}", other, item.lower(), item.upper().lower()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = decontamination.leaks(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()
    got = {r["doc_id"]: r for r in found}
    assert {0, 1, 2} <= set(got) and 3 not in got
    assert got[1]["slots"] > 0 and got[1]["agreeing"] == got[1]["slots"]


def held(spark, texts, items):
    """Numbers of the texts that hold an item, with the item's number."""
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()}


def test_names_that_open_sentences_are_slots(spark):
    def story(one, two, *n):
        return (f"{one} has {n[0]} apples in a basket at home. {two} brings {n[1]} more of them on the way back. "
                f"{one} eats a few of them. How many apples does {one} keep if {two} takes some?")

    items = [story("Alice", "Bob", 3, 5), "Carol walks to the old market every day. Dave follows and Carol does not see it until late.",
             "Dave reads a long book about the sea. Erin says that Dave should give it to Alice or Bob one day."]
    texts = [story("Carol", "Erin", 4, 8), story("Zoe", "Dave", 7, 2), story("Alice", "Bob", 3, 5), story("May", "One", 7, 2).replace("One", "Day"),
             items[1].replace("Carol", "Alice").replace("Dave", "Zoe"), items[2].replace("Dave", "Carol").replace("Erin", "Bob"),
             "Alice has a dog. Bob has a cat. Dave says that Carol may keep them both for a day or two at home."]
    assert held(spark, texts, items) == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 2)}


def test_copies_in_another_case_are_found(spark):
    item = "Yesterday Maria Lopez bought 12 apples for 3 dollars and walked 5 km home with her friend Tom Baker, then ate 2 of the apples."
    texts = [item, item.lower(), item.upper(), item.title(), "some words before. " + item.lower().replace("12", "40").replace("5", "9"), item[: len(item) // 2].lower()]
    assert held(spark, texts, [item]) == {(i, 0) for i in range(5)}


def test_slots_of_other_lengths_and_long_parts_are_found(spark):
    rng = random.Random(6)
    item = "every morning the farmer Maria sells 25 fresh eggs to people in town"
    two = "the old farmer Maria sells 25 fresh eggs to the people who live in her small town near Paris"
    passage = " ".join(f"p{'abcdefghij'[rng.randrange(10)]}{'klmnopqrst'[rng.randrange(10)]}{'uvwxyz'[rng.randrange(6)]}" for _ in range(300))
    texts = [item.replace("Maria", "Anna Maria"), item.replace("25", "twenty-five"), two.replace("Maria", "Anna Maria").replace("25", "thirty-one"),
             "some words before " + " ".join(passage.split()[40:265]) + " and some behind", " ".join(passage.split()[40:80]) + " is a short part"]
    assert held(spark, texts, [item, two, passage]) == {(0, 0), (1, 0), (2, 1), (3, 2)}


def test_dense_and_short_items_are_found_inside_texts(spark):
    items = ["Tom 12 Ann 7 Bob 31 Eve 8 Max 15 Tom 90 Ann 44", "Who wrote Hamlet?", "3 4 5 6 7 8", "Anna Maria Lopez eats red apples", "Why not"]
    around = "This page was written on a rainy afternoon. {} And the rest of it is about gardens and their care."
    texts = [around.format(i) for i in items] + [around.format("Nothing."), "who wrote", around.format("Zoe eats red apples"), around.format("Tom 1 Ann 2 Bob 3 Eve 4")]
    assert held(spark, texts, items) == {(0, 0), (1, 1), (3, 3), (4, 4), (7, 3)}


def test_items_of_one_word_are_found_as_sentences_only(spark):
    texts = ["Yes, we went home.", "They said yes and left.", "Shall we go? Yes. We went.", "first line\nyes\nlast line", "YES", "yes"]
    assert held(spark, texts, ["Yes", "Shall we"]) == {(2, 0), (3, 0), (4, 0), (5, 0), (2, 1)}


def test_items_of_one_template_are_all_found(spark):
    rng = random.Random(9)
    names = [f"{a}{b}" for a in "BCDFGHKLMN" for b in ("ana", "elo", "iri", "oma")]

    def story(same):
        one, two = rng.sample(names, 2)
        n = rng.randrange(10, 99)
        return (f"{one} has {n} apples in the basket and {two} brings {n if same else 100 + n} more on the way. "
                f"How many apples does {one} keep in the end when {two} takes {n}?")

    items = [story(i % 3 == 0) for i in range(400)]
    texts = [" ".join(story(True) for _ in range(60)), story(False), story(False).replace("basket", "cellar").replace("keep in the end", "lose"), "How many apples does one keep?"]
    found = held(spark, texts, items)
    assert {i for t, i in found if t == 0} == set(range(400))
    # The others have one value where the text has two, which leaves them 19 of 24 windows or, in other forms, a few more.
    assert {i for t, i in found if t == 1 and i % 3} == {i for i in range(400) if i % 3}
    assert not {t for t, _ in found} & {2, 3}


def plainly_agreeing(pairs, item, kinds, values):
    """The slots of windows that stand at the same distance, one after the other."""
    size, places, seen, agreed, longest = min(decontamination.WINDOW, len(item)), set(), 0, 0, 0
    for shift in {a - p for p, a in pairs}:
        own = sorted(p for p, a in set(pairs) if a - p == shift)
        meets = {}
        for at in sorted({p + j for p in own for j in range(size) if kinds[p + shift + j]}):
            meets.setdefault((kinds[at + shift], item[at]), []).append(values[at + shift])
        usual = {k: min(v, key=lambda x: (-v.count(x), x)) for k, v in meets.items()}
        wrong = {p + j for p in own for j in range(size) if kinds[p + shift + j] and usual[kinds[p + shift + j], item[p + j]] != values[p + shift + j]}
        seen += sum(map(len, meets.values()))
        agreed += sum(v.count(usual[k]) for k, v in meets.items())
        right = [p for p in own if not any(p + j in wrong for j in range(size))]
        covered = {q for p in right for q in range(p, p + size)}
        for q in covered:
            if q - 1 not in covered:
                n = q
                while n in covered:
                    n += 1
                longest = max(longest, n - q)
        places |= set(right)
    return places, seen, agreed, longest


def test_agreement_of_slots_matches_a_plain_version():
    rng = random.Random(10)
    for _ in range(200):
        n, m = rng.randrange(5, 20), rng.randrange(20, 60)
        item, kinds, values = [rng.randrange(4) for _ in range(n)], [rng.choice((0, 0, 1, 2)) for _ in range(m)], [rng.randrange(-2, 3) for _ in range(m)]
        pairs = [(rng.randrange(n - 4), rng.randrange(m - 4)) for _ in range(rng.randrange(1, 40))]
        p, a = (np.array(x) for x in zip(*pairs))
        got = decontamination._agreeing(p, a, *(np.array(x) for x in (item, kinds, values)))
        assert (set(got[0].tolist()), *got[1:]) == plainly_agreeing(pairs, item, kinds, values)


def test_contradicting_slots_are_no_leak(spark):
    item = "Compare 5 with x so that 5 is more than y while 5 stays below z and 5 ends here, and 5 again, says 5 too."
    wrong = "Compare 1 with x so that 2 is more than y while 3 stays below z and 4 ends here, and 6 again, says 7 too."
    right = wrong
    for digit in "23467":
        right = right.replace(digit, "1")
    docs = spark.createDataFrame([(1, wrong), (2, right)], "doc_id bigint, text string")
    found = decontamination.leaks(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string"), block=5)
    assert [r["doc_id"] for r in found.collect()] == [2]


def sentences(rng, count):
    return [" ".join(f"t{rng.randrange(10**6)}" for _ in range(rng.randrange(9, 15))).capitalize() + "." for _ in range(count)]


def test_pasted_passages_are_removed_with_their_offsets(spark):
    rng = random.Random(4)
    passage = " ".join(sentences(rng, 6))
    first = " ".join(sentences(rng, 5)) + "\n" + passage + "\n" + " ".join(sentences(rng, 4))
    second = " ".join(sentences(rng, 5)) + " and so on " + passage + " goes on ünd " + " ".join(sentences(rng, 4))
    clean = " ".join(sentences(rng, 20))
    docs = spark.createDataFrame([(3, second), (2, first), (9, clean)], "doc_id bigint, text string")
    left, removed = substring_dedup.dedup(docs)
    rows = {r["doc_id"]: r for r in left.collect()}
    assert rows[2]["text"] == first and rows[9]["text"] == clean and not rows[9]["removed"]
    gone = "".join(second[s["start"] : s["stop"]] for s in rows[3]["removed"])
    assert len(gone) > 0.95 * len(passage) - 10
    for s in rows[3]["removed"]:
        unit = second[s["start"] : s["stop"]]
        assert s["first_doc"] == 2 and first[s["first_start"] :].lower().startswith(unit.lower())
    assert removed.count() == len(rows[3]["removed"])


def test_units_cover_repeated_lines_and_offsets_count_characters(spark):
    line = "größe und ähnliche wörter stehen hier in einer langen zeile ohne ende"
    docs = spark.createDataFrame([(1, f"ü\n{line}"), (2, f"é é\n{line.upper().replace('Ö', 'ö').replace('Ä', 'ä').replace('SS', 'ß')}  \nrest")], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in substring_dedup.dedup(docs)[0].collect()}
    assert [(s["start"], s["first_start"]) for s in rows[2]["removed"]] == [(4, 2)]
    assert rows[2]["text"] == "é é\n  \nrest"


def test_prior_from_scores():
    rng = np.random.default_rng(0)
    positive, mixture = rng.normal(2, 1, 4000), np.concatenate([rng.normal(2, 1, 2400), rng.normal(-2, 1, 1600)])
    assert abs(quality.estimate_prior(positive, mixture) - 0.6) < 0.06


@pytest.mark.parametrize("level", [-4.0, 1.0])
def test_pull_of_the_risk_matches_differences(level):
    rng = np.random.default_rng(1)
    p, m, prior = rng.normal(1, 1, 6), rng.normal(level, 1, 9), 0.6

    def as_negative(p, m):
        return sum(math.log1p(math.exp(x)) for x in m) / len(m) - prior * sum(math.log1p(math.exp(x)) for x in p) / len(p)

    def risk(p, m):
        good = prior * sum(math.log1p(math.exp(-x)) for x in p) / len(p)
        return good + as_negative(p, m) if as_negative(p, m) >= 0 else -as_negative(p, m)

    assert (as_negative(p, m) < 0) == (level < 0)
    for got, values, other in zip(quality._unbiased(prior)(p, m), (p, m), (False, True)):
        for i in range(len(values)):
            up, down = values.copy(), values.copy()
            up[i], down[i] = up[i] + 1e-5, down[i] - 1e-5
            slope = (risk(p, up) - risk(p, down) if other else risk(up, m) - risk(down, m)) / 2e-5
            assert got[i] == pytest.approx(slope, abs=1e-6)


def test_scores_match_a_plain_version():
    rng = np.random.default_rng(2)
    texts = pa.array(["Aa bb AA! \n aa bb\n aa bb", "", "12 % x", None, "word " * 500])
    rows = quality.features(texts)
    edges = [np.unique(rng.normal(0, 1, rng.integers(0, quality.BINS))) for _ in range(rows.shape[1])]
    model = quality.Model(edges, rng.normal(0, 0.2, rows.shape[1] * quality.BINS), 0.1)
    want = [0.1 + sum(model.weights[i * quality.BINS + sum(e <= x for e in edges[i])] for i, x in enumerate(row)) for row in rows]
    assert model.score(texts) == pytest.approx([1 / (1 + math.exp(-x)) for x in want])


def test_prior_is_estimated_unless_an_audit_is_asked_for(spark):
    rng = random.Random(11)

    def good():
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(60)) + "."

    def bad():
        return " ".join(rng.choice(("$$$", "WIN", "!!!", "click")) for _ in range(60))

    docs = [(i, good() if i % 4 else bad()) for i in range(1600)]
    labels = [(i, int(i % 4 > 0)) for i in range(0, 1600) if i % 3 == 0 and (i % 4 or i % 5 == 0)]  # few of the bad ones
    d, l = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    true = sum(i % 4 > 0 for i, _ in docs if i not in dict(labels)) / (len(docs) - len(labels))
    halves = sum(v for _, v in labels) / 2, (len(docs) - len(labels)) / 2
    assert abs(quality.fit(d, l).prior - true) < sum(math.sqrt(math.log(40) / 2 / n) for n in halves)  # the deviation that the estimate allows for
    assert quality.fit(d, l, audit=True).prior == sum(v for _, v in labels) / len(labels)


def test_statistics_match_a_plain_version():
    texts = ["Aa bb AA! \n aa bb\n aa bb", "", "12 % x"]
    got = quality.features(pa.array(texts))
    for row, text in zip(got, texts):
        tokens = re.findall(r"\S+", text.lower())
        assert row[1] == pytest.approx(np.log1p(len(tokens)))
        if tokens:
            assert row[4] == pytest.approx(1 - len(set(tokens)) / len(tokens))
            assert row[5] == pytest.approx(max(Counter(tokens).values()) / len(tokens))
        assert row[13] == pytest.approx(sum("A" <= c <= "Z" for c in text) / max(len(text), 1))


def test_label_model_weighs_copies_of_a_voter_once():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2

    def voter(hit, false):
        return np.where(truth, rng.random(4000) < hit, rng.random(4000) < false).astype(float)

    copied = voter(0.3, 0.25)  # a bad voter, ten times
    votes = np.column_stack([voter(0.7, 0.02), voter(0.6, 0.03), voter(0.65, 0.02), *[copied] * 10])
    labels = np.where(rng.random(4000) < 0.1, truth.astype(int), -1)
    model = toxicity.LabelModel(votes, labels)
    assert model.weights[3:13].max() < 0.2 < 0.5 < model.weights[:3].min()
    assert ((model.posterior(votes, np.full(4000, -1)) > 0.5) == truth).mean() > 0.93


def test_prefixes():
    found = words.words(pa.array(["vequent vequail veq"]), words.letter_classes())
    four = words.prefixes(found, 4)
    assert four[0] == four[1] != 0 and four[2] == 0


def test_a_long_run_of_one_short_sentence_is_cut_in_one_pass(spark):
    texts = [f"{word} " * 300_000 for word in ("no.", "yes.", "ok.", "hm!")]
    left, _ = substring_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert left.count() == 4


def test_repeated_short_lines_and_passages_of_them_are_removed(spark):
    rng = random.Random(5)
    verse = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 8))) for _ in range(200)]
    flowing = [f"u{rng.randrange(10**6)}" for _ in range(600)]

    def wrapped(width):
        return "\n".join(" ".join(flowing[i : i + width]) for i in range(0, len(flowing), width))

    texts = ["Home\nown line one\n漢字文", "\n".join(verse), wrapped(7), "other line two\nhome\n\n漢字文\nHome", "own words\n" + "\n".join(verse) + "\nlast words", wrapped(5)]
    rows = {r["doc_id"]: r for r in substring_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))[0].collect()}
    assert [rows[i]["text"] for i in range(3)] == texts[:3]
    assert rows[3]["text"].split() == ["other", "line", "two"]
    assert rows[4]["text"].split() == ["own", "words", "last", "words"]
    assert len(rows[5]["text"].split()) < 0.1 * len(flowing)  # the lines end elsewhere


def test_licences_in_long_paragraphs_and_at_the_end_of_texts(spark):
    rng = random.Random(7)

    def plain(n):
        return " ".join(f"{'bcdfgklmnprst'[rng.randrange(13)]}{'aeiou'[rng.randrange(5)]}{'bcdfgklmnprst'[rng.randrange(13)]}a" for _ in range(n))

    corpus = [(i, "\n".join(plain(8) for _ in range(30))) for i in range(60)]
    notices = [(family, n) for family, ns in licenses.TEMPLATES.items() for n in ns]
    long_ = [(1000 + i, f"{plain(3000)} {n} {plain(3000)}") for i, (_, n) in enumerate(notices)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(corpus + long_, "doc_id bigint, text string")).filter("doc_id >= 1000").collect()}
    assert {i: (r["family"], r["similarity"], r["confirmed"]) for i, r in got.items()} == {1000 + i: (f, 1.0, True) for i, (f, _) in enumerate(notices)}


def test_licence_threshold_covers_all_paragraphs(spark):
    docs = spark.createDataFrame([(i, "\n".join(["some words"] * 100)) for i in range(30)], "doc_id bigint, text string")
    unsure = [(p, False) for p in (0.6, 0.7, 0.7, 0.8, 0.9, 0.95)] + [(0.97, True)] * 50
    candidates = spark.createDataFrame(unsure, "probability_of_family double, confirmed boolean")
    assert 0.8 < licenses._threshold(docs, candidates) < 0.81  # 2 of 2,950 may pass
    assert licenses._threshold(docs, candidates.filter("probability_of_family > 0.85")) == 0.5


def test_shards_tell_sources_with_a_common_beginning_apart(spark):
    rng = random.Random(8)
    rows = [(i, f"{i} " + "x" * rng.randrange(9999), "en", f"https://example.org/{rng.randrange(32):02}") for i in range(3200)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), 16)
    spread = [len({r["source"] for r in got.filter(F.col("shard") == s).collect()}) for s in range(16)]
    assert sum(spread) / 16 < 16
