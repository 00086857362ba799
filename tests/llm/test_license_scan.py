import duckdb
import pytest

from sortweave.llm import license_scan as L

MIT, ISC = L.LICENSES[0][1], L.LICENSES[4][1]
ROWS = [
    (1, MIT), (2, "Copyright (c) 2021 A. Person\n\n" + MIT.upper().replace(",", " ,")), (3, ISC.replace("purpose", "  purpose\n")), (4, MIT + " more"), (5, "Text.\nreleased under the MIT licence\nLicensed under CC BY-NC 4.0."),
    (6, None), (7, ""), (8, "© 2020 x"), (9, "x" * 200_000), (None, "Released under the MIT License."), (9, "Licensed under the Apache License, Version 2.0!"), (9, "Licensed under the Apache License, Version 2.0!"),
]


def test_matches(spark):
    got = {(r.doc_id, r.license, r.line_licenses) for r in L.scan(spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, DIGEST int")).collect()}
    assert got == {(1, "MIT", ""), (2, "MIT", ""), (3, "ISC", ""), (4, None, ""), (5, None, "CC-BY-NC-4.0,MIT"), (6, None, ""), (7, None, ""), (8, None, ""), (9, None, ""), (None, "MIT", "MIT"), (9, "Apache-2.0", "Apache-2.0")}


def test_row_counts_and_empty(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert L.scan(df).count() == len(ROWS)
    assert L.scan(df.limit(0)).count() == 0
    assert L.known(spark).count() == len(L.LICENSES)


@pytest.mark.parametrize("a,b", [("The Licence; of an ORGANISATION", "the license of an organization"), ("a\n Copyright 2020 X\nb", "A B"), ("non-commercial", "Noncommercial"), ("copyright notice", "Copyright: notice")])
def test_canonical_forms_agree(spark, a, b):
    x, y = (r[0] for r in spark.createDataFrame([(a,), (b,)], "t string").select(L.canonical(L.F.col("t"))).collect())
    assert x == y
    assert x == duckdb.connect().execute(f"SELECT {L._canonical_sql('t')} FROM (VALUES ('{a}')) v(t)").fetchall()[0][0]


def test_full_texts_titles_and_reserved_rights(spark):
    full = dict(L.full_texts())
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense", "BSL-1.0"} <= set(full)
    rows = [(i, name, text.replace("\n", "\r\n  ").upper()) for i, (name, text) in enumerate(L.LICENSES)]
    rows.append((9000, "MIT", f"MIT License\n\nCopyright (c) 2020 A\nAll rights reserved.\n\n{MIT}"))
    rows.append((9001, "BSD-3-Clause", "The 3-Clause BSD License\n(c) 2019 B. All rights reserved.\n" + dict(L._SHORT)["BSD-3-Clause"]))
    rows.append((9002, None, "MIT License\n" + MIT[:-9]))
    got = {r.doc_id: r.license for r in L.scan(spark.createDataFrame(rows, "doc_id long, name string, text string")).collect()}
    assert got == {i: name for i, name, _ in rows}


def test_longer_lists_are_joined_with_the_same_result(spark):
    df = spark.createDataFrame([*ROWS, (20, "x\nhttp\nwww b c\nper\ncent"), (21, "per\n\ncent")], "doc_id long, text string")
    more = [*L.LICENSES, ("own", "per cent"), ("none", "!!")]
    both = [sorted(map(tuple, L.scan(df, more, sent).collect()), key=str) for sent in (5000, 0)]
    assert both[0] == both[1] and (21, "own", "") in {(r[0], r[2], r[3]) for r in both[0]}
    table = spark.createDataFrame([*more, ("null", None)], "license string, text string")
    assert sorted(map(tuple, L.scan(df, table).collect()), key=str) == both[0]
    assert {r.license for r in L.scan(df, []).collect()} == {None}


@pytest.mark.parametrize("text", ["a\n\nSub\nlicence http\nwww", "Copyright 2020\nper\ncent\n(c) x", "\n", "", "non-\ncommercial; x\ty"])
def test_form_of_lines_is_that_of_the_text(spark, text):
    t = L.F.col("t")
    x, y = spark.createDataFrame([(text,)], "t string").select(L.canonical(t), L._joined(L.F.transform(L.F.split(t, "\n", -1), L._plain))).first()
    assert x == y
