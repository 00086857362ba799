import zlib

import numpy as np
import pyarrow as pa
import pytest

from sortweave.llm import hilbert_pack, orc_ids, tokens
from sortweave.llm.common import new_path

TEXTS = ["", "a", " a", "a ", "\n", "a\nb", "a \nb", "  a b", "a\tb c", "\x85 a b", "　a b", "a\n", "\n\na", "a\x1c b", "'s 't a's", "<|endoftext|> x <|endoftext|>", "é é 中文 字", "x  y z", None, "a\x1cb c", "𝔘nicode 🙂 🙂🙂 text", "word " * 5000 + "end", "y" * 20000, "Ümläut éçole ñandú ÿ ǅ ɐ ʰa ﬁ x² ½", "it's we'll o'clock", "a\u00adb \u00aa \u00ba"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_buffer(tokens.vocabulary())
    t.encode_special_tokens = True
    return t


def plain(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_those_of_whole_texts(tokenizer):
    enc = tokens.Encoder(tokens.vocabulary(), most=20)
    for _ in range(2):  # the memory starts anew in between
        ids, offsets = enc.encode(pa.array(TEXTS))
        assert [ids[i:j].tolist() for i, j in zip(offsets[:-1], offsets[1:], strict=True)] == [plain(tokenizer, t) for t in TEXTS]
    assert len(enc.encode(pa.array([], pa.string()))[0]) == 0


def test_documents_equal_those_of_whole_texts(tokenizer, spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    ids, offsets = tokens.Encoder(tokens.vocabulary()).encode(pa.array(texts))
    assert [ids[i:j].tolist() for i, j in zip(offsets[:-1], offsets[1:], strict=True)] == [plain(tokenizer, t) for t in texts]


def test_mixed_characters_equal_those_of_whole_texts(tokenizer):
    """Blanks, controls, letters, marks and closing punctuation in all neighbourhoods, by a memory that keeps forgetting."""
    rng, enc = np.random.default_rng(3), tokens.Encoder(tokens.vocabulary(), most=60)
    for common in (list(" \nabé.,!'s1"), list(" \n\t\rab\x00\x01\u3000\x1cßก—日😀.,:;?!")):
        for _ in range(60):
            texts = ["".join(rng.choice(common, rng.integers(0, 40))) for _ in range(20)]
            ids, offsets = enc.encode(pa.array(texts))
            assert [ids[i:j].tolist() for i, j in zip(offsets[:-1], offsets[1:], strict=True)] == [plain(tokenizer, t) for t in texts]
            assert len(enc.known) == len(enc.met) == len(enc.at) - 1


def test_slices_hold_all_rows_in_order():
    enc = tokens.Encoder(tokens.vocabulary())
    enc.SLICE = 10
    batch = pa.record_batch([pa.array(["", "abc", None, "x" * 35, "", "abcdefgh", "abc"])], ["text"])
    parts = list(enc.slices(batch, 0))
    assert len(parts) > 2 and all(p.num_rows for p in parts)
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert list(enc.slices(batch.slice(0, 0), 0)) == []


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def frame(spark, repeat=True):
    rows = list(enumerate(TEXTS)) + ([(3, "again"), (3, "again"), (None, "no id")] if repeat else [])
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, IDS int"), rows


@pytest.mark.parametrize("length", [16, 2048])
def test_packing_is_gapless_and_whole(spark, tokenizer, length):
    df, rows = frame(spark)
    pieces = hilbert_pack.pack(df, length).collect()
    line = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    at = 0
    for p in line:
        assert p.sequence_id * length + p.offset == at and 0 < p.length <= length - p.offset
        at += p.length
    want = sorted((str(d), [*plain(tokenizer, t), 1]) for d, t in rows)
    assert at == sum(len(i) for _, i in want)
    assert [p.hilbert_key for p in line] == sorted(p.hilbert_key for p in line)
    starts = sorted((str(p.doc_id), p.doc_tokens) for p in pieces if p.start == 0)
    assert starts == sorted((d, len(i)) for d, i in want)
    once = {d: i for d, i in want if sum(d == e for e, _ in want) == 1}
    for d, ids in once.items():
        own = sorted((p for p in pieces if str(p.doc_id) == d), key=lambda p: p.start)
        assert [p.start for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        assert [p.ids_crc32 for p in own] == [crc(ids[p.start : p.start + p.length]) for p in own]
        assert sum(p.length for p in own) == len(ids)
    assert hilbert_pack.pack(df.limit(0)).count() == 0


def test_hilbert_keys_visit_each_cell_by_unit_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
        keys = hilbert_pack.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_orc_round_trip(spark, tokenizer):
    df, rows = frame(spark, repeat=False)
    path = new_path(spark, "orc-test")
    orc_ids.write_orc(df, path)
    stored = orc_ids.read_orc(spark, path)
    got, start = orc_ids.digests(stored).orderBy("doc_id").collect(), 0
    for r, (doc_id, text) in zip(got, rows, strict=True):
        ids = [*plain(tokenizer, text), 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), crc(ids))
        start += len(ids)
    some = orc_ids.read_orc(spark, path, [5, 21])
    assert {r.doc_id: list(r.ids) for r in some.collect()} == {d: [*plain(tokenizer, t), 0] for d, t in rows if d in (5, 21)}
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()


def test_orc_empty_repeated_and_null_ids(spark):
    df, rows = frame(spark)
    path = new_path(spark, "orc-test")
    orc_ids.write_orc(df, path)
    got = sorted(orc_ids.digests(orc_ids.read_orc(spark, path)).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    assert [r.start for r in got] == [sum(q.n_tokens for q in got[:i]) for i in range(len(got))]
    path = new_path(spark, "orc-test")
    orc_ids.write_orc(df.limit(0), path)
    assert orc_ids.digests(orc_ids.read_orc(spark, path)).count() == 0
