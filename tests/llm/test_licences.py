"""Licence notices with siblings, negations and line ends inside."""

import random

import pytest

from broadsheet.llm import licenses, samples

BSD_HEAD = """/*
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:
 */"""
MIT_GRANT = """# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction."""
LGPL = ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License\n"
        "as published by the Free Software Foundation.")
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License."
MPL = 'This Source Code Form is subject to the terms of the Mozilla Public License, v. {}.'

CASES = [
    (CC.format(""), "CC-BY"), (CC.format("-ShareAlike"), "CC-BY-SA"), (CC.format("-NoDerivatives"), "CC-BY-ND"),
    (CC.format("-NonCommercial"), "CC-BY-NC"), (CC.format("-NonCommercial-ShareAlike"), "CC-BY-NC-SA"), (CC.format("-NonCommercial-NoDerivs"), "CC-BY-NC-ND"),
    ("Licensed under CC BY 4.0.", "CC-BY"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA"), ("Licensed under CC BY-ND 4.0.", "CC-BY-ND"),
    (GNU.format(""), "GPL"), (GNU.format("Lesser "), "LGPL"), (GNU.format("Affero "), "AGPL"), (LGPL, "LGPL"),
    (MPL.format("2.0"), "MPL-2.0"), (MPL.format("1.1"), None), ("SPDX-License-Identifier: MPL-1.1", "MPL-1.1"),
    ("This work is not dedicated to the public domain.", None), ("This work is dedicated to the public domain.", "Public domain"),
    ("This work isn't licensed under the MIT License. Released under the BSD License.", "BSD"),
    ("We do not care. Released under the MIT License.", "MIT"), ("This was never released under the MIT License.", None),
    ("Licensed under the Apache License, Version 1.1.", None), ("Licensed under the Apache License,\nVersion 2.0.", "Apache-2.0"),
    (MIT_GRANT, "MIT"), (BSD_HEAD, "BSD"), (ISC, "ISC"),
    ("Not\nall rights reserved.", None), ("This work is licensed under a Creative Commons\nAttribution-ShareAlike\n4.0 International License.", "CC-BY-SA"),
    ("This work is not\ndedicated to the public domain.", None), ("import os\n// SPDX-License-Identifier: MIT\nimport re", "MIT"),
]


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(9)

    def plain():
        return " ".join(f"{'bcdfgklmnprst'[rng.randrange(13)]}{'aeiou'[rng.randrange(5)]}{'bcdfgklmnprst'[rng.randrange(13)]}a" for _ in range(9)) + "."

    corpus = [(-1 - i, "\n".join(plain().capitalize() for _ in range(30))) for i in range(60)]
    notices = [(i, f"{plain().capitalize()}\n{notice}\n\n{plain()}") for i, (notice, _) in enumerate(CASES)]
    notices += [(100, f"{plain()} " * 20_000 + "\n" + MIT_GRANT), (101, MIT_GRANT), (101, MIT_GRANT), (None, MIT_GRANT), (102, "\n\n \n"), (103, ""), (104, None)]
    rows = [(i, text, "family", 1.0, 7) for i, text in corpus + notices]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, family string, probability double, unit int")
    return licenses.scan(docs).collect()


def test_families_of_siblings_and_wrapped_notices(found):
    got = {i: [r["family"] for r in found if r["doc_id"] == i and r["confirmed"]] for i in range(len(CASES))}
    assert got == {i: [family] if family else [] for i, (_, family) in enumerate(CASES)}
    assert all(r["family"] == "unknown" for r in found if not r["confirmed"] and r["doc_id"] in {14, 16, 20, 21, 26, 28})


def test_line_ranges(found):
    def places(i):
        return [(r["place"], r["last_place"]) for r in found if r["doc_id"] == i and r["confirmed"]]

    assert places(0) == [(1, 1)] and places(12) == [(1, 1)]  # the line alone says it
    assert places(22) == [(1, 2)] and places(25) == [(1, 3)] and places(24) == [(2, 4)]
    assert places(29) == [(2, 2)]
    assert len(places(100)) == 1 and len(places(101)) == 2 and len(places(None)) == 1
    assert not any(r["doc_id"] in (102, 103, 104) for r in found)


def test_units_cover_all_lines(spark):
    rng = random.Random(10)
    pieces = ["One two.", "three", "4 five.", "", " * ", "# Six", "// seven.", "SPDX-License-Identifier: MIT", "eight!\"", "Nine?"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = docs.select("text", licenses._units(docs["text"]).alias("units")).collect()
    for r in rows:
        assert [line for u in r["units"] for line in u["lines"]] == r["text"].split("\n")
        firsts = [u["first"] for u in r["units"]]
        assert firsts == [sum(len(u["lines"]) for u in r["units"][:k]) for k in range(len(firsts))]
        assert all(len(u["lines"]) == 1 for u in r["units"] if any("SPDX" in line or not any(c.isalnum() for c in line) for line in u["lines"]))


def test_least_hashed_rows_are_those_of_a_full_sort(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    for most in (1, 50, 9_000, 30_000):
        want = ids.selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h").limit(most).collect()
        assert {r["doc_id"] for r in samples.least_hashed(ids, most, "doc_id").collect()} == {r["doc_id"] for r in want}
    assert samples.least_hashed(ids.limit(0), 5, "doc_id").count() == 0


def test_one_text_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None)], "doc_id int, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id int, quality int")
    assert sorted(tuple(r) for r in samples.fitting_sample(docs, labels, "quality", 10).collect()) == [(1, "a", 1), (2, None, None)]
