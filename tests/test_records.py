import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from sortweave import storage
from sortweave.functions import keys, records, sizes
from sortweave.operators import merge, runs, sort, split, verify
from sortweave.sources import convert, counters, fixedkv, generate

EXTREME = [bytes(8), b"\x7f" + b"\xff" * 7, b"\x80" + bytes(7), b"\xff" * 8, b"\x01" + bytes(6) + b"\x80"]


def frame(spark, pairs):
    return spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in pairs], "key binary, value binary")


def pairs(n, seed=1, kb=8, vb=8, high=True):
    r = random.Random(seed)
    out = [(r.randbytes(kb), i.to_bytes(max(vb, 8), "big")[-vb:] if vb else b"") for i in range(n)]
    return out if high else [(bytes([k[0] & 0x7F]) + k[1:], v) for k, v in out]


PYTHON_ORDERS = {
    "O1": lambda k: k,
    "O2": lambda k: struct.unpack("<q", k)[0],
    "O3": lambda k: struct.unpack(">q", k)[0],
    "O4": lambda k: struct.unpack("<Q", k)[0],
    "O5": lambda k: struct.unpack(">Q", k)[0],
}


@pytest.mark.parametrize("order", keys.ORDERS)
def test_orders(spark, order):
    data = pairs(300) + [(k, b"%08d" % i) for i, k in enumerate(EXTREME)]
    got = [(bytes(r.key), bytes(r.value)) for r in sort.sort_records(frame(spark, data), order, ["value"]).collect()]
    assert got == sorted(data, key=lambda x: (PYTHON_ORDERS[order](x[0]), x[1]))


def test_unknown_order(spark):
    with pytest.raises(ValueError):
        keys.sort_key(F.col("key"), "O9")


@pytest.mark.parametrize(("kb", "vb", "n"), [(8, 8, 1000), (8, 120, 101), (10, 90, 37), (8, 0, 5), (3, 2, 0), (8, 8, 1)])
def test_fixedkv_round_trip(spark, tmp_path, kb, vb, n):
    fixedkv.register(spark)
    data = pairs(n, kb=kb, vb=vb)
    src = tmp_path / "in.dat"
    src.write_bytes(b"".join(k + v for k, v in data))
    options = {"keyBytes": str(kb), "valueBytes": str(vb), "splitBytes": str(16 * (kb + vb))}
    df = spark.read.format("fixedkv").options(**options).load(str(src))
    assert sorted((bytes(r.key), bytes(r.value)) for r in df.collect()) == sorted(data)
    if not n:
        return
    out = str(tmp_path / "out")
    os.mkdir(out)
    sort.sort_parts(df, 3, "key", "value").write.format("fixedkv").options(**options).mode("append").save(out)
    files = sorted(os.listdir(out))
    assert all(f.startswith("part-") for f in files)
    joined = b"".join((tmp_path / "out" / f).read_bytes() for f in files)
    assert joined == b"".join(k + v for k, v in sorted(data))
    back = spark.read.format("fixedkv").options(**options, positions="true").load(out)
    assert verify.verify(back, df).ok


def test_fixedkv_truncated(spark, tmp_path):
    fixedkv.register(spark)
    (tmp_path / "bad.dat").write_bytes(b"x" * 33)
    with pytest.raises(Exception, match="whole number"):
        spark.read.format("fixedkv").load(str(tmp_path / "bad.dat")).count()


def test_fixedkv_missing(spark, tmp_path):
    fixedkv.register(spark)
    with pytest.raises(Exception, match="nothing"):
        spark.read.format("fixedkv").load(str(tmp_path / "nothing")).count()


def _numbered(spark, data, per=4):
    rows = [(bytearray(k), bytearray(v), i // per, i % per) for i, (k, v) in enumerate(data)]
    return spark.createDataFrame(rows, "key binary, value binary, part int, row int")


def test_verifier_faults(spark):
    data = sorted(pairs(12))
    source = frame(spark, data)
    assert verify.verify(_numbered(spark, data), source).ok
    swapped = [*data]
    swapped[1], swapped[2] = swapped[2], swapped[1]
    assert verify.verify(_numbered(spark, swapped), source).inversions == 1
    assert not verify.verify(_numbered(spark, data[:-1]), source).ok
    changed = [*data[:5], (data[5][0], b"changed!"), *data[6:]]
    assert not verify.verify(_numbered(spark, changed), source).permutation
    moved = data[4:8] + data[:4] + data[8:]
    assert verify.verify(_numbered(spark, moved), source).misplaced_parts == 1
    assert not verify.verify(_numbered(spark, [(bytes(8), bytes(8))] * 12), source).ok


@pytest.mark.parametrize("values", [[], [5], [5, 3], [1, 2, 3, 4, 5], [7] * 50, [7] * 45 + [1, 2, 3, 9, 9], [-5, -1, 0, 1, 2**63 - 1, -(2**63)], list(range(-40, 60))])
def test_exact_parts(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "k long")
    parts, found = split.exact_parts(df, F.col("k"), 2)
    expect = {0: sorted(values)}
    for level in range(2):
        after = {}
        for b, ks in expect.items():
            if not ks:
                continue
            v = ks[max(1, len(ks) // 2) - 1]
            assert [x["splitter"] for x in found if (x["level"], x["bucket"]) == (level, b)] == [v]
            after[2 * b], after[2 * b + 1] = [k for k in ks if k <= v], [k for k in ks if k > v]
        expect = after
    got = {}
    for r in parts.collect():
        got.setdefault(r.part, []).append(r.k)
    assert {b: sorted(ks) for b, ks in got.items()} == {b: ks for b, ks in expect.items() if ks}


def test_nulls_last_struct_and_position(spark):
    df = spark.createDataFrame([(3,), (None,), (1,), (None,), (2,)], "k long")
    placed = sort.with_position(df.withColumn("id", F.monotonically_increasing_id()), F.col("k"), [F.col("id")], nulls_last=True)
    assert [r.k for r in placed.orderBy("pos").collect()] == [1, 2, 3, None, None]
    got = sort.sort_struct(df.select(F.struct("k").alias("record"))).collect()
    assert [r.record.k for r in got] == [1, 2, 3, None, None]
    assert sort.with_position(df.limit(0), F.col("k")).count() == 0


def test_parquet_unsigned_records(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    ks = [2**64 - 1, 0, 2**63, 2**63 - 1, 5]
    struct_array = pa.StructArray.from_arrays([pa.array(ks, pa.uint64()), pa.array([b"v%07d" % i for i in range(5)], pa.binary(8))], ["key", "value"])
    pq.write_table(pa.table({"record": struct_array}), tmp_path / "r.parquet")
    df = spark.read.parquet(str(tmp_path / "r.parquet"))
    assert [int(r.record.key) for r in sort.sort_struct(df).collect()] == sorted(ks)
    assert records.record_fields(df).columns == ["key", "value"]
    with pytest.raises(ValueError):
        records.record_fields(df.withColumn("x", F.lit(1)))


@pytest.mark.parametrize("lengths", [[4], [3, 0], [5, 2, 7], [0, 0, 0, 1, 9], [1, 2, 3, 4, 5, 6, 7, 8]])
def test_merge(spark, lengths):
    r = random.Random(3)
    data = [sorted(r.randrange(20) for _ in range(n)) for n in lengths]
    frames = [spark.createDataFrame([(k,) for k in ks], "k long") for ks in data]
    assert [x.k for x in merge.merge_runs(frames, F.col("k")).collect()] == sorted(k for ks in data for k in ks)
    placed = merge.merge_positions(frames, F.col("k")).orderBy("pos").collect()
    assert [(x.k, -x.run_id) for x in placed] == sorted((k, -i) for i, ks in enumerate(data) for k in ks)


def test_bswap_and_midpoint(spark):
    values = [0, 1, 128, 255, 256, -1, 2**63 - 1, -(2**63), 0x0102030405060708, -2]
    df = spark.createDataFrame([(v,) for v in values], "k long")
    got = [r[0] for r in df.select(keys.bswap64(F.col("k"))).collect()]
    assert got == [struct.unpack(">q", struct.pack("<q", v))[0] for v in values]
    mids = [(a, b) for a in values for b in values]
    got = spark.createDataFrame(mids, "a long, b long").select(keys.midpoint(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [(a + b) // 2 for a, b in mids]


def test_sizes(spark):
    assert [sizes.parse_size(s) for s in ("77", "1024B", "512kb", "1M", "1.5G", " 2gb ")] == [77, 1024, 524288, 1048576, 1610612736, 2147483648]
    for bad in ("0", "x", "", "-1", "1.2.3"):
        with pytest.raises(ValueError):
            sizes.parse_size(bad)
    assert [sizes.format_size(n) for n in (0, 1023, 1024, 1 << 30, (1 << 40) * 5)] == ["0B", "1023B", "1K", "1G", "5T"]
    assert sizes.record_counts(1000, 10, 90) == (10, 0)
    with pytest.raises(ValueError):
        sizes.record_counts(7, 8, 0)


def test_generate(spark):
    df, over = generate.generate_size(spark, "10K", 10, 90, seed=4)
    assert (df.count(), over) == (102, 40)
    again = generate.generate(spark, 102, 10, 90, seed=4).repartition(7)
    assert verify.multiset(df, ["key", "value"]).first() == verify.multiset(again, ["key", "value"]).first()
    assert all(r.key[0] < 0x80 and len(r.key) == 10 and len(r.value) == 90 for r in df.collect())
    assert any(r.key[0] >= 0x80 for r in generate.generate(spark, 100, high_bit=True).collect())


def test_counters(spark, tmp_path):
    (tmp_path / "pcm.csv").write_text(
        ",,System,,Other\nDate,Time,Read,Write,Read\n2024-01-02,14:29:41.491, 1024.0 , 2048 ,1\n2024-01-02,14:29:41.816,512, x,1\n"
    )
    got = counters.read_counters(spark, str(tmp_path / "pcm.csv")).orderBy("ts").collect()
    assert [(r.label, r.read_gb, r.write_gb, r.total_gb) for r in got] == [("14:29:41.491", 1.0, 2.0, 3.0), ("14:29:41.816", 0.5, None, None)]


def test_run_positions(spark):
    df = runs.assign_runs(spark.range(10), "id", 4)
    assert [r.run_id for r in df.orderBy("id").collect()] == [0] * 4 + [1] * 4 + [2] * 2
    empty = runs.sort_runs(runs.assign_runs(spark.range(0), "id", 4), F.col("id"))
    assert empty.count() == 0


def test_fixedkv_append_overwrite_and_lists(spark, tmp_path):
    fixedkv.register(spark)
    out = str(tmp_path / "kv")
    data = pairs(10)
    for _ in range(2):
        frame(spark, data).write.format("fixedkv").mode("append").save(out)
    read = spark.read.format("fixedkv").load(out)
    assert sorted((bytes(r.key), bytes(r.value)) for r in read.collect()) == sorted(data * 2)
    frame(spark, data[:3]).write.format("fixedkv").mode("overwrite").save(out)
    assert spark.read.format("fixedkv").load(out).count() == 3
    (tmp_path / "more.dat").write_bytes(b"".join(k + v for k, v in data))
    several = spark.read.format("fixedkv").option("positions", "true").load([str(tmp_path / "more.dat"), out])
    assert sorted((bytes(r.key), bytes(r.value)) for r in several.collect()) == sorted(data + data[:3])
    assert [bytes(r.key) for r in several.where("part = 0").orderBy("row").collect()] == [k for k, _ in data]


@pytest.mark.parametrize("bad", [(bytearray(7), bytearray(8)), (None, bytearray(8)), (bytearray(8), bytearray(9))])
def test_fixedkv_refuses_other_widths(spark, tmp_path, bad):
    fixedkv.register(spark)
    rows = spark.createDataFrame([(bytearray(8), bytearray(8)), bad], "key binary, value binary")
    with pytest.raises(Exception, match="a record must have"):
        rows.write.format("fixedkv").mode("append").save(str(tmp_path / "kv"))
    assert not os.path.exists(tmp_path / "kv") or not [f for f in os.listdir(tmp_path / "kv") if f.startswith("part")]


@pytest.mark.parametrize(
    ("rows", "expected"),
    [([], 0), ([(1, 5)], 0), ([(1, 5), (3, 4), (7, 2)], 2), ([(1, 5), (3, None), (7, 2)], 0), ([(i * i, i) for i in range(200)], 0), ([(i * i, -i) for i in range(200)], 199), ([(None, 9), (1, 1), (2, 0)], 1)],
)
def test_inversions_with_gaps(spark, rows, expected):
    df = spark.createDataFrame(rows, "p long, k long").repartition(3)
    assert verify.inversions(df, F.col("k"), "p").first()["inversions"] == expected


def test_inversions_of_groups(spark):
    df = spark.createDataFrame([(g, i, (i if g else -i)) for g in range(3) for i in range(50)], "g int, p int, k int")
    assert verify.inversions(df, F.col("k"), "p", "g").first()["inversions"] == 49
    assert not verify.parts_sorted(df, F.col("k"), "g", "p").first()[0]
    assert verify.parts_sorted(df.where("g > 0"), F.col("k"), "g", "p").first()[0]


def test_multiset_tells_values_apart(spark):
    def digest(*rows):
        return verify.multiset(spark.createDataFrame(rows, "a string, b string"), ["a", "b"]).first()

    alike = [("x|y", "z"), ("x", "y|z"), (None, "~"), ("~", None), ("", "~"), ("n", "~"), (None, None), ("", "")]
    assert len({digest(r) for r in alike}) == len(alike)
    assert digest(*alike) == digest(*alike[::-1])
    assert digest(("a", "b"), ("a", "b")) != digest(("a", "b"))


def test_key_steps(spark):
    values = [0, -1, 5, 2**63 - 1, -(2**63)]
    got = spark.createDataFrame([(v,) for v in values], "k long").select(keys.increment(F.col("k")), keys.decrement(F.col("k"))).collect()
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    assert [tuple(r) for r in got] == [(wrap(v + 1), wrap(v - 1)) for v in values]


def test_convert_to_parquet(spark, tmp_path):
    data = pairs(50) + [(k, b"%08d" % i) for i, k in enumerate(EXTREME)]
    (tmp_path / "in.dat").write_bytes(b"".join(k + v for k, v in data))
    for order, form in (("O4", "<Q"), ("O5", ">Q")):
        out = str(tmp_path / order)
        convert.to_parquet(spark, str(tmp_path / "in.dat"), out, order=order, single=True)
        assert len([f for f in os.listdir(out) if f.startswith("part")]) == 1
        got = spark.read.parquet(out).select("record.*").collect()
        assert sorted((int(r.key), bytes(r.value)) for r in got) == sorted((struct.unpack(form, k)[0], v) for k, v in data)
    with pytest.raises(ValueError):
        records.unsigned_records(frame(spark, data), "O1")


def test_shared_folder(spark):
    class Fake:
        conf = {}

        class sparkContext:
            master = "local-cluster[3,2,1000]"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Fake)
    with storage.recorded() as paths:
        kept = storage.keep(spark.range(5), "five")
    assert kept.count() == 5 and len(paths) == 1
    folder = paths[0].removeprefix("file://")
    assert os.path.isdir(folder)
    storage.release(spark, paths)
    assert not os.path.exists(folder)
