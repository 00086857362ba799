import gzip
import hashlib
import random
import re

import pytest

from sortweave.llm import warc_index as W
from sortweave.llm.common import new_path

BIG = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 80
ROWS = [
    (1, "http://A.Example.com/x?q=1#f", BIG), (9, "https://a.example.com/x?q=1", BIG), (4, None, BIG), (9, "http://b.org", BIG), (2, "http://b.org/\r\nx", "small"), (3, "http://b.org/y", "small"),
    (5, "", None), (None, "http://c.net:8080/", BIG), (6, "::bad[", "x" * 999), (7, "u", "x" * 999), (8, "u", "x" * 1000), (10, "u", "x" * 1000), (11, "http://b.org", "y" * 300_000), (12, "http://b.org", "\r\n\r\n"),
]


def brute(rows):
    best = {}
    for i, (page, _, html) in enumerate(rows):
        data = (html or "").encode()
        if len(data) >= 1000:
            best.setdefault(data, []).append((page is not None, page or 0, i))
    out = []
    for i, (page, _, html) in enumerate(rows):
        data = (html or "").encode()
        top = max(best[data]) if data in best else None
        revisit = top is not None and top[2] != i
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top[1] if revisit else None))
    return sorted(out, key=str)


def test_round_trip_against_brute_force(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, DIGEST int").repartition(3)
    path = new_path(spark, "warc-test")
    W.write_warc(df, path, records_per_file=4)
    captures = W.read_captures(spark, path)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in captures.collect()), key=str)
    assert got == brute(ROWS)
    merged = [tuple(r) for r in W.merge_captures(captures).collect()]
    assert [r[2:4] for r in merged] == sorted(r[2:4] for r in merged)
    assert sorted(merged, key=str) == sorted((tuple(r) for r in captures.collect()), key=str)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()
    text = gzip.decompress(files[0].content)
    assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")


def test_empty(spark):
    path = new_path(spark, "warc-test")
    W.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert W.merge_captures(W.read_captures(spark, path)).count() == 0


def test_damaged_archives_are_refused():
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1:0>\r\nWARC-Date: x\r\nWARC-Payload-Digest: sha1:" + hashlib.sha1(b"abc").hexdigest().encode() + b"\r\nContent-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    assert len(list(W.parse_warc(gzip.compress(good * 2), "a"))) == 2
    for bad in (good[:-5], good.replace(b"abc", b"abd"), b"x" + good):
        with pytest.raises(ValueError):
            list(W.parse_warc(gzip.compress(bad), "a"))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8])
def test_loser_tree(k):
    r = random.Random(k)
    runs = [sorted((r.randrange(20), i) for i in range(r.randrange(9))) for _ in range(k)]
    got = list(W.LoserTree([iter(x) for x in runs], lambda row: row[0]))
    assert [x[0] for x in got] == sorted(x[0] for run in runs for x in run)
    assert sorted(got) == sorted(x for run in runs for x in run)


def test_url_keys():
    assert W.url_key("https://user@M.Example.com:8080/a/b?x=1#top") == "com,example,m:8080)/a/b?x=1"
    assert W.url_key(None) == ")/"


def test_all_ids_large_pages_and_rolled_archives(spark):
    """Ids at both ends have dates of four digits; archives are rolled by bytes; the index alone addresses each record."""
    rng = random.Random(5)
    big = "".join(rng.choice("abcdefgh") for _ in range(700_000)) * 30  # over 16 MB: two members
    rows = [(2**63 - 1, "http://a.org", "x"), (-1, "http://a.org", "y"), (-(2**63), "http://a.org", "z"), (10**12, "http://a.org", "w"), (5, "http://b.org", big), (6, "http://b.org", big)]
    rows += [(100 + i, f"http://c.org/{i % 7}", "".join(rng.choice("abcdef") for _ in range(3000))) for i in range(60)]
    path = new_path(spark, "warc-test")
    W.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path, archive_bytes=20_000)
    captures = W.read_captures(spark, path)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in captures.collect()), key=str)
    assert got == brute(rows)
    files = {r.path.rsplit("/", 1)[-1]: r.content for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()}
    indexed = captures.collect()
    assert len(files) > 5 and all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", r.captured) for r in indexed)
    assert all(len(c) <= 20_000 or sum(r.archive == name for r in indexed) == 1 for name, c in files.items())
    html = {r[0]: r[2] for r in rows}
    for r in indexed:
        record = gzip.decompress(files[r.archive][r.offset : r.offset + r.length])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        assert r.record_type == "revisit" or html[r.page_id].encode() in record
    for name, c in files.items():
        spans = sorted((r.offset, r.length) for r in indexed if r.archive == name)
        assert [a for a, _ in spans] == [0, *(a + n for a, n in spans[:-1])] and sum(spans[-1]) == len(c)


@pytest.mark.parametrize("runs", [1, 2, 7])
def test_merge_streams_blocks(runs):
    """Blocks in the order of their first captures give all captures in order, with few of them open."""
    rng = random.Random(runs)
    rows = [(i, None, f"k{rng.randrange(300):03}", f"t{rng.randrange(9)}", 0, "", "", None, f"a{rng.randrange(runs)}", i, 0, 0) for i in range(6000)]
    each = {}
    for row in sorted(rows, key=W.order):
        each.setdefault(row[8], []).append(row)
    blocks = sorted((run[i : i + 50] for run in each.values() for i in range(0, len(run), 50)), key=lambda b: W.order(b[0]))
    merge = W.Merge()
    assert list(merge.rows(iter(blocks))) == sorted(rows, key=W.order)
    assert merge.most <= 2 * 50 * runs and not merge.waiting and not merge.open


def test_ranges_of_one_url(spark):
    """A URL with all captures spans ranges; ranges are ascending and of like sizes."""
    rows = [(i % 50, None, "k", f"t{i % 9}", 0, "", "", None, f"a{i % 5}", i, 0, 0) for i in range(4000)]
    df = spark.createDataFrame(sorted(rows, key=lambda r: (r[8], W.order(r))), W.CAPTURE).coalesce(1)
    merged = W.merge_captures(df, 400).withColumn("part", W.F.spark_partition_id()).collect()
    assert [tuple(r)[:-1] for r in merged] == sorted(rows, key=W.order)
    sizes = [sum(r.part == p for r in merged) for p in {r.part for r in merged}]
    assert len(sizes) >= 8 and max(sizes) < 1000
