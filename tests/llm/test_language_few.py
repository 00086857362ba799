import random

from sortweave.llm import language_id as L


def test_languages_of_one_document_are_learnt(spark):
    r = random.Random(4)
    rows = [(i, " ".join("".join(r.choices("abcdefg", k=5)) for _ in range(60)), "xx") for i in range(30)]
    rows += [(100 + i, " ".join("".join(r.choices("mnopqrs", k=5)) for _ in range(60)), f"l{i:02}") for i in range(25)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.languages) == {x[2] for x in rows}


def test_letters_beyond_16_bits_fold_on_no_other_letter():
    import numpy as np

    from sortweave.llm import language_id as L

    far = "\U00010400\U00020000\U0001d400"
    codes = L.characters([far])[0][3:6].tolist()
    assert all(0xE000 <= c < 0xE000 + 6400 for c in codes) and not any(chr(c).isalpha() for c in codes)
    assert L._short(np.array([97, 0xFFFF], np.uint32)).tolist() == [97, 0xFFFF]


def test_repeated_rows_and_rejected_scores(spark):
    from sortweave.llm import language_id as L

    text = "the quick brown fox jumps over the lazy dog and runs away again "
    rows = [(i, text * (1 + i % 3), "en") for i in range(40)] + [(i + 50, "der schnelle braune fuchs springt und rennt wieder davon " * (1 + i % 3), "de") for i in range(40)]
    rows += [(900, text, "en")] * 3 + [(901, "qzxv wkqj zzxq vvkq " * 40, None), (902, None, "en"), (902, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.predict(df, L.fit(df)).collect()
    assert len(got) == len(rows) and len({(r.lang_pred, r.score) for r in got if r.doc_id == 900}) == 1
    assert all(r.score < 1 for r in got if r.rejected) and any(r.rejected for r in got if r.doc_id == 901)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id == 902} == {("und", 0.0)}
