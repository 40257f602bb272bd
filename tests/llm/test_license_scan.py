import re

import duckdb
import numpy as np
import pytest

from rivulet.llm.license_scan import TEMPLATES, Index, align, license_texts, op3_license, scan, scan_row


def found(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return [(m.template, round(m.coverage, 2), text.encode()[m.first_byte : m.end_byte].decode()) for m in scan(df).first().matches]


def test_every_template_is_found_with_its_span(spark):
    rows = [(n, f"Héllo before.\n{t}!\nAnd after it.") for n, t in TEMPLATES.items()]
    for r in scan(spark.createDataFrame(rows, "name string, text string")).collect():
        assert r.licenses == r.name and r.coverage == 1.0
        m = r.matches[0]
        cut = r.text.encode()[m.first_byte : m.end_byte].decode()
        assert re.findall(r"\w+", cut.lower()) == re.findall(r"\w+", TEMPLATES[r.name].lower())


def test_changed_notices(spark):
    assert found(spark, "this is licensed under the the Apache license version 2.0 ok") == [("Apache-2.0", 1.0, "licensed under the the Apache license version 2.0")]
    assert [f[0] for f in found(spark, "Redistribution and use in source and binary form, with or without any modification, are permitted provided that following conditions are met")] == ["BSD"]
    assert found(spark, "released under the sun") == [] and found(spark, "") == []


def test_align_is_banded_and_exact():
    t = [b"a", b"b", b"c", b"d"]
    assert align(t, [b"x", b"a", b"b", b"c", b"d"], 1, 2) == (4, 1, 5)
    assert align(t, [b"a", b"b", b"z", b"c", b"d"], 0, 2) == (4, 0, 5)
    assert align(t, [b"a", b"c", b"d"], 0, 2)[0] == 3
    assert align(t, [], 0, 2) == (0, 0, 0)


def test_whole_table_against_plain_search(spark, sf_dir, documents):
    """Every document that has a notice word for word is found, and no document without a word of one."""
    plain = lambda t: " ".join(re.findall(r"[a-z0-9]+|[^\x00-\x7f]+", t.lower()))
    want = {i: {n for n, x in TEMPLATES.items() if f" {plain(x)} " in f" {plain(t)} "} for i, t, _ in documents}
    got = {r.doc_id: set(r.licenses.split(",")) - {""} for r in op3_license(spark, sf_dir).collect()}
    assert set(got) == set(want)
    assert all(want[i] <= got[i] for i in want) and any(want.values())
    assert all("licen" in t.lower() for i, t, _ in documents if got[i])


def test_odd_rows(spark, odd, none):
    got = scan(odd)
    assert "_matches" in got.columns and len(got.collect()) == 10
    assert {r.n_matches for r in got.select("n_matches").collect()} == {0}
    assert scan(none).collect() == []
    assert scan(odd, templates={}).count() == 10
    assert Index({}).names == []


def test_sf_has_notices(sf_dir):
    assert duckdb.sql(f"SELECT count(*) FROM '{sf_dir}/documents.parquet' WHERE text ILIKE '%license%'").fetchall()[0][0] > 0


def test_whole_texts_are_found_with_their_span(spark):
    rows = [(n, f"Copyright (c) 2020 Somebody\n{t}\nint main() {{}}") for n, t in license_texts().items()]
    assert len(rows) > 20
    for r in scan(spark.createDataFrame(rows, "name string, text string")).collect():
        assert r.licenses == r.name and r.coverage == 1.0 and r.n_matches == 1
        cut = r.text.encode()[r.matches[0].first_byte : r.matches[0].end_byte].decode()
        words = [re.findall("[a-z0-9]+", x.lower()) for x in (cut, license_texts()[r.name])]
        assert words[0] == words[1]


def test_changed_and_cut_texts(spark):
    mit = license_texts()["MIT-full"]
    assert [f[0] for f in found(spark, mit.replace("Software", "Program", 4).replace("The above", "All of the above"))] == ["MIT-full"]
    # Its opening alone is no whole text.
    assert [f[0] for f in found(spark, mit[:300])] == ["MIT-text"]
    gpl = license_texts()["GPL-3-full"]
    assert "GPL-3-full" not in [f[0] for f in found(spark, gpl.replace("GNU GENERAL", "GNU AFFERO GENERAL", 1))]
    two = found(spark, mit + "\n\n" + license_texts()["ISC-full"])
    assert [f[0] for f in two] == ["MIT-full", "ISC-full"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Released under the BSD License", "BSD-notice"),
        ("Released under the ISC License", "ISC-notice"),
        ("Released under the GPL License", "GPL-notice"),
        ("Released under the Foo License", ""),
        ("Released under a MIT License", "MIT"),
        ("Licensed under CC BY 4.0", "CC-BY-short"),
        ("Licensed under CC BY-ND 4.0", "CC-BY-ND-short"),
        ("Licensed under CC BY-NC 4.0", "CC-BY-NC"),
        ("Licensed under CC BY-NC-SA 3.0", "CC-BY-NC-SA-3.0-short"),
        ("This work is licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "AGPL-header"),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "LGPL-header"),
    ],
)
def test_names_variants_and_versions(spark, text, want):
    assert ",".join(f[0] for f in found(spark, f"Some words before. {text}. And some after it.")) == want


def test_no_alignment_within_the_edits_is_missed():
    """Changed, dropped and added words at random: whatever a full alignment accepts is proposed by the hits."""
    rng, index = np.random.default_rng(3), Index(TEMPLATES)
    names = set(index.name_hashes.tolist())
    for t, template in enumerate(index.hashed):
        free = [i for i in range(1, len(template) - 1) if int(template[i]) not in names]
        for _ in range(20):
            words, edits = template.tolist(), int(rng.integers(0, index.edits[t] + 1))
            for i in sorted(rng.choice(free, min(edits, len(free)), replace=False).tolist(), reverse=True):
                words[i : i + 1] = [[], [7], [words[i], 7]][rng.integers(3)]
            words = np.array([5, 6, *words, 8, 9], np.uint64)
            hits = index.hits(words, np.zeros(len(words), np.int64))
            got = scan_row(words, hits[:, 1:], index) if len(hits) else []
            assert got and got[0][2] < len(words) - 2 and got[0][3] > 2, (index.names[t], words)
