"""WARC archives of pages with revisit records, and an external merge of their capture indexes.

Pages are written as WARC/1.1 records, each a gzip member of its own, in archives that are rolled by bytes. The index has the byte
offset and length of each record's members, which read alone give the record. The write goes through Spark's text writer, so to any file system
that Spark knows, under its commit protocol: an archive is one row of a file, without its last byte. That byte, the highest of the member's
four bytes of length, is 0, as a member holds less than 16 MB of text (a longer record has several); it is the writer's line separator.

Each archive gives one locally sorted capture run, kept as it is. Runs are cut at splitters of (URL key, time, page id, place) and into blocks; the
blocks of a range come to its task in the order of their first captures, and a loser tree merges those that overlap. Ranges in order are the
global capture history.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortweave.llm.common import columns_free_of, keep, new_path

#: Least payload that a revisit may stand for.
LEAST = 1000
#: Bytes of an archive, unless one record is longer, and records of one.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 32 << 20, 50_000
#: WARC-Date is 2024-01-01 plus page_id seconds, in a span of so many: years of four digits for all ids.
DATE_SPAN = 10**9
#: Captures of a block, captures that a range is to have at most, about, and keys sampled for each range.
BLOCK, RANGE, SAMPLED = 1024, 200_000, 40
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "page_id bigint, url string, url_key string, captured string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, record bigint, offset bigint, length bigint"


def with_decisions(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(row_id, page_id, url, payload, n, digest, record_type, refers_to, refers_row) for each of (page_id, url, html).

    Of equal payloads of at least ``least`` bytes the one with the largest page_id (then the last row) is the
    response; null page_ids come before all others. Payloads that occur once, or are shorter, never wait for
    a join partner: the groups with repeats are aggregated map-side first, and a hot digest is one row of them,
    to which Spark's skew join brings the pages in as many tasks as they need. Rows are numbered once, in a kept table.
    """
    rows = columns_free_of(pages, ["page_id", "url", "html"]).select(
        F.monotonically_increasing_id().alias("row_id"), F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload")
    )
    rows = keep(rows.withColumn("n", F.octet_length("payload").cast("bigint")).withColumn("digest", F.sha1(F.col("payload").cast("binary"))), "warc-pages")
    best = F.max(F.struct("page_id", "row_id")).alias("best")
    groups = rows.where(F.col("n") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), best).where("copies > 1").select(F.col("digest").alias("_digest"), "best")
    joined = rows.join(groups, (F.col("digest") == F.col("_digest")) & (F.col("n") >= least), "left")
    revisit = F.col("best").isNotNull() & (F.col("best.row_id") != F.col("row_id"))
    return joined.select(
        "row_id", "page_id", "url", "payload", "n", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("best.page_id")).alias("refers_to"), F.when(revisit, F.col("best.row_id")).alias("refers_row"),
    )


def record_id(page: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def record_text(captured: Column) -> Column:
    """One WARC record without its closing blank line. A revisit has the HTTP header only, whose Content-Length is the full payload's."""
    end = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "), F.col("n").cast("string"), F.lit(end + end))
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    revisit = F.col("record_type") == "revisit"
    block = F.octet_length(http).cast("bigint") + F.when(revisit, 0).otherwise(F.col("n"))
    return F.concat(
        F.lit(f"WARC/1.1{end}WARC-Type: "), F.col("record_type"),
        F.lit(f"{end}WARC-Record-ID: "), record_id(F.col("page_id"), F.col("row_id")),
        F.coalesce(F.concat(F.lit(f"{end}WARC-Target-URI: "), url), F.lit("")),
        F.lit(f"{end}WARC-Date: "), captured,
        F.lit(f"{end}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{end}WARC-Profile: {PROFILE}{end}WARC-Refers-To: "), record_id(F.col("refers_to"), F.col("refers_row")))).otherwise(""),
        F.lit(f"{end}Content-Type: application/http; msgtype=response{end}Content-Length: "), block.cast("string"), F.lit(end + end),
        http, F.when(revisit, "").otherwise(F.col("payload")),
    )


#: Text of a gzip member, at most: the fourth byte of its length is 0.
MEMBER = (1 << 24) - 1


def members(record: bytes) -> bytes:
    """A record as one gzip member, or several if it is too long for one."""
    out = []
    for at in range(0, max(1, len(record)), MEMBER):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += [packer.compress(record[at : at + MEMBER]), packer.flush()]
    return b"".join(out)


def _archives(most_bytes: int, most_records: int):
    """One row an archive, without its last byte."""

    def run(batches):
        held, size = [], 0

        def row():
            whole = b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([whole[:-1]], pa.binary())], ["value"])

        for b in batches:
            for text in b.column(0):
                packed = members(bytes(text.as_buffer()) + b"\r\n\r\n")
                if held and (size + len(packed) > most_bytes or len(held) >= most_records):
                    yield row()
                    held, size = [], 0
                held.append(packed)
                size += len(packed)
        if held:
            yield row()

    return run


def write_warc(pages: DataFrame, path: str, records_per_file: int = ARCHIVE_RECORDS, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes one record for each of (page_id, url, html).

    WARC-Date is taken to be 2024-01-01 plus page_id seconds, modulo DATE_SPAN (null: the first), as pages carry no time. Null html is
    an empty payload; a null url has no WARC-Target-URI; repeated rows are separate records. A task holds one archive at a time.
    """
    seconds = F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(DATE_SPAN))
    captured = F.date_format(F.timestamp_seconds(F.lit(1704067200) + seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    decided = with_decisions(pages, least)
    archives = decided.select(record_text(captured).alias("value")).mapInArrow(_archives(archive_bytes, records_per_file), "value binary")
    archives.select(F.col("value").cast("string").alias("value")).write.options(lineSep="\0", maxRecordsPerFile="1").text(path)


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then port, path and query; no scheme, user or fragment."""
    try:
        u = urlsplit(url or "")
        host = ",".join(reversed((u.hostname or "").split(".")))
        port = f":{u.port}" if u.port else ""
    except ValueError:
        return f"){url}"
    return f"{host}{port}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


_NAME = re.compile(rb"<urn:page:(-?\d*):\d+>")


def unpacked(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, end, text) of each gzip member."""
    at, view = 0, memoryview(data)
    while at < len(data):
        reader, out, end = zlib.decompressobj(31), [], at
        while not reader.eof:
            if end == len(data):
                raise ValueError(f"the member at {at} does not end")
            piece = view[end : end + (1 << 16)]
            try:
                out.append(reader.decompress(piece))
            except zlib.error as e:
                raise ValueError(f"the member at {at} is damaged") from e
            end += len(piece) - len(reader.unused_data)
        yield at, end, b"".join(out)
        at = end


def _records(data: bytes, archive: str) -> Iterator[tuple[int, int, bytes, dict, bytes]]:
    """(offset, length, first line, header, block) of each record, whether members hold one, several or a part of one."""
    parts, held, offset, number = unpacked(data), b"", 0, 0

    def more() -> int:
        nonlocal held, offset
        start, end, text = next(parts, (0, 0, None))
        if text is None:
            raise ValueError(f"{archive}: record {number} does not end where its length says")
        if not held:
            offset = start
        held += text
        return end

    end = 0
    while True:
        if not held:
            try:
                end = more()
            except ValueError as e:
                if end == len(data):
                    return
                raise e
        while (cut := held.find(b"\r\n\r\n")) < 0:
            end = more()
        first, _, rest = held[:cut].partition(b"\r\n")
        head = _header(rest)
        if first.strip() != b"WARC/1.1":
            raise ValueError(f"{archive}: record {number} does not begin with WARC/1.1")
        begin = cut + 4
        stop = begin + int(head[b"content-length"])
        while len(held) < stop + 4:
            end = more()
        if held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"{archive}: record {number} does not end where its length says")
        yield offset, end - offset, first, head, held[begin:stop]
        held, number = held[stop + 4 :], number + 1


def parse_warc(data: bytes, archive: str) -> Iterator[tuple]:
    """Captures of one gzipped archive, in file order. A malformed record raises ValueError."""
    for number, (offset, length, _, head, block) in enumerate(_records(data, archive)):
        first, _, payload = block.partition(b"\r\n\r\n")
        http = _header(first.partition(b"\r\n")[2])
        kind, digest = head[b"warc-type"].decode(), head[b"warc-payload-digest"].decode().removeprefix("sha1:")
        size = int(http[b"content-length"])
        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"{archive}: record {number} does not have the payload that its digest names")
        page, refers = (_NAME.fullmatch(head.get(k, b"<urn:page::0>"))[1] for k in (b"warc-record-id", b"warc-refers-to"))
        url = head[b"warc-target-uri"].decode() if b"warc-target-uri" in head else None
        yield (int(page) if page else None, url, url_key(url), head[b"warc-date"].decode(), size, digest, kind, int(refers) if refers else None, archive, number, offset, length)


def _header(lines: bytes) -> dict[bytes, bytes]:
    out = {}
    for line in lines.split(b"\r\n"):
        name, _, value = line.partition(b":")
        out[name.strip().lower()] = value.strip()
    return out


def order(row: tuple) -> tuple:
    """URL key, time, page id (null first), archive, record."""
    return row[2], row[3], row[0] is not None, row[0] or 0, row[8], row[9]


_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("url_key", pa.string()), ("captured", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    + [("archive", pa.string()), ("record", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]
)


def _batches(rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _read(batches):
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            yield from _batches(iter(sorted(parse_warc(content.as_py(), path.rsplit("/", 1)[-1]), key=order)))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """All captures of the archives; each archive's come as one sorted run."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(_read, CAPTURE)


class LoserTree:
    """Merges sorted runs: each inner node remembers the loser of its match, so a step replays one path to the root."""

    def __init__(self, runs: list[Iterator], key):
        self.key = key
        self._enter([self._head(r) for r in runs])

    def _head(self, run: Iterator) -> tuple | None:
        row = next(run, None)
        return None if row is None else (self.key(row), row, run)

    def _enter(self, heads: list) -> None:
        self.head = [h for h in heads if h is not None] or [None]
        self.k = len(self.head)
        self.loser = [0] * self.k
        self.winner = self._build(1)

    def add(self, run: Iterator) -> None:
        """One more run; those that are done leave the tree."""
        self._enter([*self.head, self._head(run)])

    def _less(self, i: int, j: int) -> bool:
        a, b = self.head[i], self.head[j]
        return a is not None and (b is None or (a[0], i) < (b[0], j))

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.loser[node] = lose
        return win

    def until(self, key) -> Iterator:
        """Rows whose key is below this one; without one, all that are left."""
        while (top := self.head[self.winner]) is not None and (key is None or top[0] < key):
            yield top[1]
            i = self.winner
            self.head[i] = self._head(top[2])
            node = (i + self.k) // 2
            while node:
                if self._less(self.loser[node], i):
                    self.loser[node], i = i, self.loser[node]
                node //= 2
            self.winner = i

    def __iter__(self):
        return self.until(None)


def _tuples(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _blocks(splitters: list[tuple]):
    """Sorted runs as blocks: (range, key columns of the first capture, data). A block is of one run and one range."""
    names = ["range", "url_key", "captured", "known", "page", "archive", "record", "data"]

    def block(held: list[tuple], at: int) -> pa.RecordBatch:
        (data,) = _batches(iter(held), len(held))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _SCHEMA) as out:
            out.write_batch(data)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.array([x]) for x in order(held[0])), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names)

    def run(batches):
        held, at = [], 0
        for b in batches:
            for row in _tuples(b):
                place = bisect_right(splitters, order(row))
                if held and (row[8] != held[0][8] or place != at or len(held) == BLOCK):
                    yield block(held, at)
                    held = []
                held.append(row)
                at = place
        if held:
            yield block(held, at)

    return run


class Merge:
    """Merges blocks that come in the order of their first captures; blocks of a run follow one another.

    Open at a time are the blocks that overlap, one of each run at most and the next one of it: ``most`` is how many rows they had.
    """

    def __init__(self):
        self.tree, self.waiting, self.open, self.most = LoserTree([], order), {}, 0, 0

    def _run(self, name: str) -> Iterator[tuple]:
        while self.waiting[name]:
            for row in self.waiting[name].popleft():
                self.open -= 1
                yield row
        del self.waiting[name]

    def rows(self, blocks: Iterator[list[tuple]]) -> Iterator[tuple]:
        for block in blocks:
            yield from self.tree.until(order(block[0]))
            self.open += len(block)
            self.most = max(self.most, self.open)
            name = block[0][8]
            if name in self.waiting:
                self.waiting[name].append(block)
            else:
                self.waiting[name] = deque([block])
                self.tree.add(self._run(name))
        yield from self.tree.until(None)


def _merge(batches):
    def blocks():
        for b in batches:
            for data in b.column(0):
                with pa.ipc.open_stream(data.as_buffer()) as f:
                    yield [row for part in f for row in _tuples(part)]

    yield from _batches(Merge().rows(blocks()))


def merge_captures(captures: DataFrame, range_rows: int = RANGE) -> DataFrame:
    """Captures in global order of (url_key, captured, page_id): partitions are ascending ranges, each merged from its runs.

    ``captures`` come as sorted runs, an archive's rows one after another, and are kept so. Ranges are cut at keys from a bounded sample, SAMPLED for each
    range, so that each has ``range_rows`` captures or fewer, about, whatever the number of runs; a URL with very many captures spans ranges, as time, page id and
    place are part of the key. A task holds the blocks that overlap at one point of its range, without payloads. Nothing else is sorted but blocks by their first captures.
    """
    spark = captures.sparkSession
    runs = keep(captures, "warc-runs")
    total = runs.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_rows))
    share = min(1.0, SAMPLED * ranges / max(1, total))
    sample = sorted(order(tuple(r)) for r in runs.sample(False, share, 7).limit(2 * SAMPLED * ranges).collect())
    splitters = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    cut = runs.mapInArrow(_blocks(splitters), "range int, url_key string, captured string, known boolean, page bigint, archive string, record bigint, data binary")
    by = ["url_key", "captured", "known", "page", "archive", "record"]
    dealt = cut.repartitionById(len(splitters) + 1, F.col("range")).sortWithinPartitions(*by)
    return dealt.select("data").mapInArrow(_merge, CAPTURE)


def op8_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives, read back and merged to capture histories."""
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return merge_captures(read_captures(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM m"""
