"""The registry: name -> (query, SQL for DuckDB or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortweave.functions import keys, metrics, records, sizes
from sortweave.operators import merge, runs, sort, split, verify
from sortweave.sources import convert, counters, fixedkv
from sortweave.sources import generate as generator
from sortweave.storage import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LINE_TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
LINE_TIE_SQL = ", ".join(LINE_TIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = " ".join(sql.split())
        return f

    return put


# ---- sorting ----


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS pos, o_orderkey, o_totalprice FROM orders")
def sort_pos(spark, d):
    return sort.with_position(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice"), [F.col("o_orderkey")])


def _swapped_sql(k: str) -> str:
    """Byte-swapped signed value of a non-negative BIGINT, in SQL without bit operators."""
    total = " + ".join(f"((({k})::HUGEINT // {256**i}) % 256) * {256 ** (7 - i)}::HUGEINT" for i in range(8))
    return f"(CASE WHEN ({total}) >= 9223372036854775808::HUGEINT THEN ({total}) - 18446744073709551616::HUGEINT ELSE ({total}) END)::BIGINT"


def _unsigned_sql(k: str) -> str:
    return f"(CASE WHEN {k} < 0 THEN {k}::HUGEINT + 18446744073709551616::HUGEINT ELSE {k}::HUGEINT END)"


def _by_order(spark: SparkSession, d: str, order: str, stored: Column) -> DataFrame:
    """Ranks of the distinct line keys whose 8 bytes are those of ``stored``."""
    lines = table(spark, d, "lineitem").select("l_orderkey").distinct()
    keyed = lines.select("l_orderkey", keys.key_of_long(stored).alias("key"))
    placed = sort.with_position(keyed, keys.sort_key(F.col("key"), order), [F.col("l_orderkey")])
    return placed.select("pos", "l_orderkey", F.lower(F.hex("key")).alias("key_hex"))


def _order_sql(value: str, stored: str) -> str:
    return f"""WITH k AS (SELECT DISTINCT l_orderkey, {stored} AS s FROM lineitem),
        v AS (SELECT l_orderkey, {value} AS v, lower(lpad(printf('%x', {_unsigned_sql('s')}), 16, '0')) AS key_hex FROM k)
        SELECT row_number() OVER (ORDER BY v, l_orderkey) AS pos, l_orderkey, key_hex FROM v"""


_SWAPPED = _swapped_sql("l_orderkey")


@query(f"""WITH k AS (SELECT DISTINCT l_orderkey, {_unsigned_sql(_SWAPPED)} AS v FROM lineitem)
    SELECT row_number() OVER (ORDER BY v, l_orderkey) AS pos, l_orderkey, v::VARCHAR AS key_value FROM k""")
def sort_key_be_unsigned(spark, d):
    """O1 and O5: keys whose first byte is high in half of them come last, not first."""
    lines = table(spark, d, "lineitem").select("l_orderkey").distinct().withColumn("s", keys.bswap64(F.col("l_orderkey")))
    keyed = lines.select("l_orderkey", keys.key_of_long(F.col("s")).alias("key"), keys.unsigned_decimal(F.col("s")).cast("string").alias("key_value"))
    return sort.with_position(keyed, keys.sort_key(F.col("key"), "O5"), [F.col("l_orderkey")]).select("pos", "l_orderkey", "key_value")


@query(f"""WITH k AS (SELECT DISTINCT l_orderkey, {_SWAPPED} AS v FROM lineitem)
    SELECT row_number() OVER (ORDER BY v, l_orderkey) AS pos, l_orderkey, v AS key_value FROM k""")
def sort_key_be_signed(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey").distinct()
    keyed = lines.select("l_orderkey", keys.key_of_long(keys.bswap64(F.col("l_orderkey"))).alias("key"))
    read = keyed.select("l_orderkey", keys.sort_key(F.col("key"), "O3").alias("key_value"))  # what the order reads from the bytes, once
    return sort.with_position(read, F.col("key_value"), [F.col("l_orderkey")]).select("pos", "l_orderkey", "key_value")


@query(f"""WITH k AS (SELECT DISTINCT l_orderkey, {_SWAPPED} AS v FROM lineitem)
    SELECT row_number() OVER (ORDER BY v, l_orderkey) AS pos, l_orderkey, v AS key_value FROM k""")
def sort_key_le_signed(spark, d):
    """O2 of keys stored big-endian: the bytes read from the other end."""
    lines = table(spark, d, "lineitem").select("l_orderkey").distinct()
    keyed = lines.select("l_orderkey", keys.key_of_long(F.col("l_orderkey")).alias("key"))
    read = keyed.select("l_orderkey", keys.sort_key(F.col("key"), "O2").alias("key_value"))
    return sort.with_position(read, F.col("key_value"), [F.col("l_orderkey")]).select("pos", "l_orderkey", "key_value")


@query(f"""WITH k AS (SELECT DISTINCT l_orderkey, {_unsigned_sql(_SWAPPED)} AS v FROM lineitem)
    SELECT row_number() OVER (ORDER BY v, l_orderkey) AS pos, l_orderkey, v::VARCHAR AS key_value FROM k""")
def sort_key_le_unsigned(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey").distinct()
    keyed = lines.select("l_orderkey", keys.key_of_long(F.col("l_orderkey")).alias("key"))
    read = keyed.select("l_orderkey", keys.sort_key(F.col("key"), "O4").alias("order"))
    value = keys.unsigned_decimal(keys.flip_sign(F.col("order"))).cast("string").alias("key_value")
    return sort.with_position(read, F.col("order"), [F.col("l_orderkey")]).select("pos", "l_orderkey", value)


@query("""WITH k AS (SELECT doc_id, hex(encode(text)[1:10]) AS key_hex FROM documents)
    SELECT row_number() OVER (ORDER BY key_hex, doc_id) AS pos, doc_id, key_hex FROM k""")
def sort_text_bytes(spark, d):
    keyed = table(spark, d, "documents").select("doc_id", records.decode_key(F.encode("text", "UTF-8"), 10).alias("key"))
    return sort.with_position(keyed, F.col("key"), [F.col("doc_id")]).select("pos", "doc_id", F.hex("key").alias("key_hex"))


@query("SELECT rank() OVER (ORDER BY l_orderkey) AS pos, l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def sort_dup_rank(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return sort.with_position(lines, F.col("l_orderkey"), ranked=True)


@query("""WITH e AS (SELECT event_id, nullif(user_id % 5, 0) AS k FROM events)
    SELECT row_number() OVER (ORDER BY k ASC NULLS LAST, event_id) AS pos, event_id, k FROM e""")
def sort_nulls_last(spark, d):
    keyed = table(spark, d, "events").select("event_id", F.nullif(F.col("user_id") % 5, F.lit(0)).alias("k"))
    return sort.with_position(keyed, F.col("k"), [F.col("event_id")], nulls_last=True)


@query("SELECT row_number() OVER (ORDER BY hex(encode(text)[1:1]) ASC NULLS LAST, doc_id) AS pos, doc_id FROM documents")
def argsort(spark, d):
    """Indices of all documents in key order; the key is a first byte that many of them share, nulls last."""
    return sort.argsort(table(spark, d, "documents"), F.substring(F.encode("text", "UTF-8"), 1, 1), "doc_id")


@query("SELECT row_number() OVER (ORDER BY encode(text) ASC NULLS LAST, doc_id) AS pos, doc_id FROM documents")
def argsort_text(spark, d):
    """Indices of all documents in the order of the bytes of the whole text, nulls last."""
    return sort.argsort(table(spark, d, "documents"), F.encode("text", "UTF-8"), "doc_id")


@query("SELECT row_number() OVER (ORDER BY n_chars NULLS LAST, doc_id) AS pos, doc_id, n_chars, md5(text) AS digest FROM documents")
def argsort_take(spark, d):
    docs = table(spark, d, "documents")
    indices = sort.argsort(docs, F.col("n_chars"), "doc_id")
    return sort.take(docs, indices, "doc_id").select("pos", "doc_id", "n_chars", F.md5("text").alias("digest"))


@query("""SELECT row_number() OVER (ORDER BY o_orderkey NULLS LAST) AS pos, o_orderkey, o_custkey FROM orders""")
def sort_struct_pos(spark, d):
    """The Parquet layout: one struct column, sorted by its first field."""
    struct = table(spark, d, "orders").select(F.struct(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value")).alias("record"))
    placed = sort.with_position(struct, F.col("record.key"), nulls_last=True)
    return placed.select("pos", F.col("record.key").alias("o_orderkey"), F.col("record.value").alias("o_custkey"))


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos, o_orderkey, o_totalprice FROM orders QUALIFY pos <= 100")
def topk_pos(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return sort.top_k(orders, 100, F.col("o_totalprice").desc(), F.col("o_orderkey"))


# ---- runs and late values ----


@query(f"SELECT {_SWAPPED.replace('l_orderkey', 'o_orderkey')} AS key, o_orderkey AS row_idx FROM orders")
def key_index_pairs(spark, d):
    return runs.key_index_pairs(table(spark, d, "orders"), keys.bswap64(F.col("o_orderkey")), "o_orderkey")


@query("""SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) AS pos, o_orderkey AS row_idx, o_custkey AS key, o_totalprice, o_orderpriority FROM orders""")
def value_gather(spark, d):
    orders = table(spark, d, "orders")
    pairs = sort.with_position(runs.key_index_pairs(orders, F.col("o_custkey"), "o_orderkey"), F.col("key"), [F.col("row_idx")])
    values = orders.select(F.col("o_orderkey").alias("row_idx"), "o_totalprice", "o_orderpriority")
    return runs.value_gather(pairs, values)


@query("""SELECT event_id, user_id, event_id // 700 AS run_id, row_number() OVER (PARTITION BY event_id // 700 ORDER BY user_id, event_id) AS run_pos FROM events""")
def run_sort(spark, d):
    events = runs.assign_runs(table(spark, d, "events").select("event_id", "user_id"), "event_id", 700)
    return runs.sort_runs(events, F.col("user_id"), [F.col("event_id")])


@query("""WITH r AS (SELECT event_id, user_id, value, event_id // 700 AS run_id FROM events),
    s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY user_id, event_id) AS run_pos FROM r)
    SELECT row_number() OVER (ORDER BY user_id, run_id, run_pos) AS pos, run_id, run_pos, user_id, value FROM s""")
def run_value_gather(spark, d):
    """Keys merged by (key, run), each taking the next value of its run."""
    events = runs.assign_runs(table(spark, d, "events").select("event_id", "user_id", "value"), "event_id", 700)
    ordered = runs.sort_runs(events, F.col("user_id"), [F.col("event_id")])
    merged = sort.with_position(ordered.select("user_id", "run_id", "run_pos"), F.col("user_id"), [F.col("run_id"), F.col("run_pos")])
    return runs.attach_run_values(merged, ordered.select("run_id", "run_pos", "value"))


_TABLES = ("orders", "lineitem", "events", "part", "customer")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS runs, count(*) % 1000 AS last_run FROM {t}" for t in _TABLES))
def run_count(spark, d):
    out = None
    for t in _TABLES:
        n = table(spark, d, t).agg(F.count(F.lit(1)).alias("n"))
        row = n.select(F.lit(t).alias("name"), "n", sizes.run_count(F.col("n"), 1000).alias("runs"), (F.col("n") % 1000).alias("last_run"))
        out = row if out is None else out.unionByName(row)
    return out


# ---- order statistics and partitioning ----


@query("SELECT min(l_orderkey) AS min_key, max(l_orderkey) AS max_key, count(*) AS n FROM lineitem")
def key_min_max(spark, d):
    return split.key_range(table(spark, d, "lineitem"), F.col("l_orderkey"))


@query("SELECT count(*) FILTER (WHERE l_orderkey <= 1000) AS rank_count FROM lineitem")
def rank_count(spark, d):
    return split.rank_count(table(spark, d, "lineitem"), F.col("l_orderkey"), F.lit(1000))


def _levels_sql(depth: int, k: str, source: str) -> str:
    """Level by level: the key of rank max(1, floor(n/2)) of each bucket, by sorting the bucket."""
    ctes = [f"b0 AS (SELECT {k} AS k, 0 AS b FROM {source})"]
    for i in range(depth):
        ctes.append(f"r{i} AS (SELECT k, b, row_number() OVER (PARTITION BY b ORDER BY k) AS r, count(*) OVER (PARTITION BY b) AS n FROM b{i})")
        ctes.append(f"v{i} AS (SELECT b, min(n) AS n, max(CASE WHEN r = greatest(1, n // 2) THEN k END) AS v FROM r{i} GROUP BY b)")
        ctes.append(f"b{i + 1} AS (SELECT x.k, 2 * x.b + CASE WHEN x.k > v.v THEN 1 ELSE 0 END AS b FROM b{i} x JOIN v{i} v ON x.b = v.b)")
    return "WITH " + ", ".join(ctes)


def _splitters(depth: int):
    def f(spark, d):
        _, found = split.exact_parts(table(spark, d, "lineitem"), F.col("l_orderkey"), depth)
        rows = [(x["level"], x["bucket"], x["splitter"], x["rows"]) for x in found]
        return spark.createDataFrame(rows, "level long, bucket long, splitter long, n long")

    f.__name__ = f"splitters_d{depth}"
    sql = _levels_sql(depth, "l_orderkey", "lineitem")
    return query(sql + " " + " UNION ALL ".join(f"SELECT {i}::BIGINT AS level, b::BIGINT AS bucket, v AS splitter, n::BIGINT AS n FROM v{i}" for i in range(depth)))(f)


splitters_d1, splitters_d2, splitters_d3 = map(_splitters, (1, 2, 3))


@query(_levels_sql(3, "l_orderkey", "lineitem") + " SELECT b::BIGINT AS part, count(*) AS n, min(k) AS lo, max(k) AS hi FROM b3 GROUP BY b")
def range_parts(spark, d):
    parts, _ = split.exact_parts(table(spark, d, "lineitem").select("l_orderkey"), F.col("l_orderkey"), 3)
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"))


# ---- merging ----


def _order_runs(spark: SparkSession, d: str, k: int) -> list[DataFrame]:
    """Runs of uneven lengths, the last one empty."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return [orders.where((F.col("o_orderkey") % (k * k) >= i * i) & (F.col("o_orderkey") % (k * k) < (i + 1) * (i + 1))) for i in range(k)] + [orders.where("o_orderkey < 0")]


def _merge_sql(k: int) -> str:
    case = " ".join(f"WHEN o_orderkey % {k * k} < {(i + 1) ** 2} THEN {i}" for i in range(k))
    return f"""WITH r AS (SELECT o_orderkey, o_totalprice, o_custkey, (CASE {case} END)::BIGINT AS run_id FROM orders)
        SELECT row_number() OVER (ORDER BY o_custkey, run_id DESC, o_orderkey) AS pos, o_orderkey, o_totalprice, o_custkey, run_id FROM r"""


@query(_merge_sql(2))
def merge_two_way(spark, d):
    return merge.merge_positions(_order_runs(spark, d, 2), F.col("o_custkey"), [F.col("o_orderkey")])


@query(_merge_sql(5))
def merge_k_way(spark, d):
    return merge.merge_positions(_order_runs(spark, d, 5), F.col("o_custkey"), [F.col("o_orderkey")])


@query(_levels_sql(2, "o_custkey", "orders") + ", p AS (SELECT b, v FROM v1), q AS (SELECT max(CASE WHEN b = 0 THEN v END) AS a, max(CASE WHEN b = 1 THEN v END) AS c FROM p), m AS (SELECT v AS mid FROM v0)"
    " SELECT (CASE WHEN o_custkey <= a THEN 0 WHEN o_custkey <= mid THEN 1 WHEN o_custkey <= c THEN 2 ELSE 3 END)::BIGINT AS part,"
    " row_number() OVER (PARTITION BY (CASE WHEN o_custkey <= a THEN 0 WHEN o_custkey <= mid THEN 1 WHEN o_custkey <= c THEN 2 ELSE 3 END) ORDER BY o_custkey, o_orderkey) AS part_pos, o_custkey, o_orderkey FROM orders, q, m")
def merge_by_parts(spark, d):
    """Runs cut at shared exact splitters; each part is merged on its own."""
    merged = merge.merge_by_parts(_order_runs(spark, d, 3), F.col("o_custkey"), [F.col("o_orderkey")], depth=2)
    return merged.select("part", "part_pos", "o_custkey", "o_orderkey")


# ---- verification ----


@query("""WITH l AS (SELECT o_totalprice AS k, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS p FROM orders)
    SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE k < p)::BIGINT AS inversions FROM l""")
def verify_inversions(spark, d):
    return verify.inversions(table(spark, d, "orders"), F.col("o_totalprice"), "o_orderkey")


@query("""WITH l AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS pos, o_totalprice FROM orders), w AS (SELECT o_totalprice AS k, lag(o_totalprice) OVER (ORDER BY pos) AS p FROM l)
    SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE k < p)::BIGINT AS inversions FROM w""")
def verify_sorted(spark, d):
    """The same check passes on what the sort gives."""
    return verify.inversions(sort_pos(spark, d), F.col("o_totalprice"), "pos")


@query("""WITH p AS (SELECT o_custkey % 7 AS part, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1)
    SELECT part, n, lo, hi, coalesce((lo < max(hi) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS misplaced FROM p""")
def verify_boundaries(spark, d):
    return verify.boundaries(table(spark, d, "orders").withColumn("part", F.col("o_custkey") % 7), F.col("o_orderkey"), "part")


def _row_text_sql(columns: list[str]) -> str:
    return " || ".join(f"coalesce((2 * strlen({c}::VARCHAR))::VARCHAR || ':' || hex({c}::VARCHAR), 'n')" for c in columns)


_CHECKED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query(f"""WITH h AS (SELECT md5({_row_text_sql(_CHECKED)}) AS h FROM orders)
    SELECT count(*) AS n, sum(('0x' || substring(h, 1, 16))::UBIGINT)::VARCHAR AS digest_a, sum(('0x' || substring(h, 17, 16))::UBIGINT)::VARCHAR AS digest_b FROM h""")
def multiset_check(spark, d):
    return verify.multiset(table(spark, d, "orders"), _CHECKED)


@query("""WITH l AS (SELECT o_custkey % 7 AS part, o_orderkey AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderdate, o_orderkey) AS p FROM orders)
    SELECT coalesce(bool_and(p IS NULL OR k >= p), true) AS all_sorted FROM l""")
def verify_parts(spark, d):
    """Whether each part is in order in itself; these are not."""
    orders = table(spark, d, "orders").withColumn("part", F.col("o_custkey") % 7)
    return verify.parts_sorted(orders, F.col("o_orderkey"), "part", "o_orderdate")


# ---- files of fixed width ----


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Orders as records of 8 key and 8 value bytes; half of the keys begin with a high bit."""
    orders = table(spark, d, "orders")
    return orders.select(keys.key_of_long(keys.bswap64(F.col("o_orderkey"))).alias("key"), keys.key_of_long(F.col("o_custkey")).alias("value"))


def _stored(spark: SparkSession, records_: DataFrame, name: str) -> str:
    fixedkv.register(spark)
    path = new_path(spark, name)
    records_.write.format("fixedkv").mode("append").save(path)
    return path


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("fixedkv").option("positions", "true").load(paths)


_ORDER_KEY = _SWAPPED.replace("l_orderkey", "o_orderkey")


@query(f"""WITH k AS (SELECT {_unsigned_sql(_ORDER_KEY)} AS v, o_custkey FROM orders)
    SELECT row_number() OVER (ORDER BY v, o_custkey) AS pos, lpad(printf('%x', v), 16, '0') AS key_hex, o_custkey AS value FROM k""")
def fixedkv_round_trip(spark, d):
    """Records written by ranges, one file a task, and read back: files in name order are in key order."""
    path = _stored(spark, sort.ranged(_records(spark, d), [F.col("key"), F.col("value")]), "fixedkv")
    placed = sort.with_position(_files(spark, path), F.col("part"), [F.col("row")])
    return placed.select("pos", F.lower(F.hex("key")).alias("key_hex"), keys.long_of_key(F.col("value")).alias("value"))


@query(f"""WITH k AS (SELECT {_unsigned_sql(_ORDER_KEY)} AS v, o_custkey FROM orders)
    SELECT row_number() OVER (ORDER BY v, o_custkey) AS pos, lpad(printf('%x', v), 16, '0') AS key_hex, o_custkey AS value FROM k""")
def fixedkv_merge(spark, d):
    """Two sorted runs in folders of their own, loaded by a list of paths, merged to one file and read again."""
    each = [_stored(spark, sort.ranged(run, [F.col("key"), F.col("value")]), f"run-{i}") for i, run in enumerate(_halves(spark, d))]
    merged = merge.merge_runs([_files(spark, each).select("key", "value")], F.col("key"), F.col("value"))
    whole = _stored(spark, sort.single_file(merged, "key", "value"), "merged")
    return _files(spark, whole).select((F.col("row") + 1).alias("pos"), F.lower(F.hex("key")).alias("key_hex"), keys.long_of_key(F.col("value")).alias("value"))


def _halves(spark: SparkSession, d: str) -> list[DataFrame]:
    even = keys.long_of_key(F.col("value")) % 2 == 0
    return [_records(spark, d).where(even), _records(spark, d).where(~even)]


@query("""SELECT row_number() OVER (ORDER BY o_orderkey, o_custkey) AS pos, o_orderkey::VARCHAR AS key, lpad(printf('%x', o_custkey), 16, '0') AS value_hex FROM orders""")
def parquet_convert(spark, d):
    """Binary records with little-endian keys, converted to the Parquet layout and sorted from there."""
    path = new_path(spark, "records-parquet")
    convert.to_parquet(spark, _stored(spark, _records(spark, d), "records"), path)
    placed = sort.with_position(spark.read.parquet(path), F.col("record.key"), [F.col("record.value")], nulls_last=True)
    return placed.select("pos", F.col("record.key").cast("string").alias("key"), F.lower(F.hex("record.value")).alias("value_hex"))


@query("SELECT count(*) AS rows, count(*) AS rows_expected, 0::BIGINT AS inversions, 0::BIGINT AS misplaced_parts, true AS permutation, true AS ok FROM orders")
def verify_report(spark, d):
    """A sorted write, checked against its source: order in each file, order of the files, and the same records."""
    source = _records(spark, d)
    return verify.report(_files(spark, _stored(spark, sort.ranged(source, [F.col("key")]), "checked")), source)


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS ts, max(value) AS r, min(value) AS w FROM events GROUP BY 1)
    SELECT strftime(ts, '%H:%M:%S') || '.000' AS label, strftime(ts, '%Y-%m-%d') AS day, r / 1024 AS read_gb, w / 1024 AS write_gb, r / 1024 + w / 1024 AS total_gb FROM h""")
def counter_log(spark, d):
    """A CSV with two header rows and padded numbers, written from hourly readings and read back."""
    hours = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.max("value").alias("r"), F.min("value").alias("w"))
    reading = lambda c: F.concat(F.lit("  "), F.col(c).cast("string"), F.lit(" "))
    body = hours.select(F.col("ts").alias("at"), F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss.SSS"), reading("r"), reading("w")).alias("line"))
    head = spark.createDataFrame([(0, ",,System,"), (1, "Date,Time,Read,Write")], "n int, line string")
    lines = head.select("n", F.lit(None).cast(body.schema["at"].dataType).alias("at"), "line").unionByName(body.select(F.lit(2).alias("n"), "at", "line"))
    path = new_path(spark, "counters")
    sort.single_file(lines, "n", "at").select("line").write.text(path)
    log = counters.read_counters(spark, path)
    return log.select("label", F.date_format("ts", "yyyy-MM-dd").alias("day"), "read_gb", "write_gb", "total_gb")


# ---- codec, masks, metrics ----


def _hex64_sql(k: str) -> str:
    return f"lpad(hex({k}), 16, '0')"


@query(f"SELECT o_orderkey, {_hex64_sql('o_orderkey')} || {_hex64_sql('o_custkey')} AS record FROM orders")
def encode_record(spark, d):
    orders = table(spark, d, "orders")
    return orders.select("o_orderkey", F.hex(records.encode_record(keys.key_of_long(F.col("o_orderkey")), keys.key_of_long(F.col("o_custkey")))).alias("record"))


@query(f"SELECT o_orderkey, {_hex64_sql('o_orderkey')} AS key, {_hex64_sql('o_custkey')} AS value, o_custkey AS value_long FROM orders")
def decode_record(spark, d):
    encoded = table(spark, d, "orders").select("o_orderkey", records.encode_record(keys.key_of_long(F.col("o_orderkey")), keys.key_of_long(F.col("o_custkey"))).alias("r"))
    value = records.decode_value(F.col("r"), 8, 8)
    return encoded.select("o_orderkey", F.hex(records.decode_key(F.col("r"), 8)).alias("key"), F.hex(value).alias("value"), keys.long_of_key(value).alias("value_long"))


@query(f"WITH k AS (SELECT DISTINCT l_orderkey, {_SWAPPED} AS s FROM lineitem) SELECT l_orderkey, (CASE WHEN s < 0 THEN (s::HUGEINT + 9223372036854775808::HUGEINT)::BIGINT ELSE s END) AS masked FROM k")
def clear_msb(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey").distinct()
    return lines.select("l_orderkey", keys.clear_msb(keys.bswap64(F.col("l_orderkey"))).alias("masked"))


@query("SELECT o_orderkey, (o_orderkey + o_custkey) // 2 AS mid, o_orderkey // 4096 * 4096 AS down, (o_orderkey + 4095) // 4096 * 4096 AS up FROM orders")
def key_midpoint(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", keys.midpoint(k, F.col("o_custkey")).alias("mid"), sizes.align_down(k).alias("down"), sizes.align_up(k).alias("up"))


@query("""WITH t AS (SELECT date_trunc('day', ts) AS day, value / 1024 AS gb FROM events)
    SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n, max(gb) AS peak_gb FROM t GROUP BY 1""")
def bandwidth(spark, d):
    """Readings as padded text with separate date and time, cleaned as the counter log is."""
    log = table(spark, d, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "HH:mm:ss").alias("time"), F.concat(F.lit("  "), F.col("value").cast("string"), F.lit("\t ")).alias("reading")
    )
    ts = F.to_timestamp(F.concat_ws(" ", "date", "time"))
    rows = log.select(F.date_format(ts, "yyyy-MM-dd").alias("day"), (metrics.clean_double(F.col("reading")) / 1024).alias("gb"))
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.max("gb").alias("peak_gb"))


@query("SELECT o_orderkey, o_custkey * 1000.0::DOUBLE / (1073741824.0::DOUBLE * (1 + o_orderkey % 9)) AS gib_s, 100.0::DOUBLE * (o_orderkey % 9) / nullif(o_orderkey % 4, 0) AS miss FROM orders")
def ratios(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", metrics.bandwidth_gib_s(F.col("o_custkey"), 1 + k % 9).alias("gib_s"), metrics.percent(k % 9, k % 4).alias("miss"))


@query("""WITH t AS (SELECT o_custkey % 8 AS thread, 100.0::DOUBLE * sum(o_orderkey % 9) / nullif(sum(o_orderkey % 4 + 9), 0) AS miss FROM orders GROUP BY 1)
    SELECT count(*) AS threads, round(avg(miss), 9) AS mean_miss FROM t""")
def mean_ratio(spark, d):
    """The mean over threads of each thread's own ratio."""
    k = F.col("o_orderkey")
    threads = table(spark, d, "orders").groupBy((F.col("o_custkey") % 8).alias("thread")).agg(metrics.percent(F.sum(k % 9), F.sum(k % 4 + 9)).alias("miss"))
    return threads.agg(F.count(F.lit(1)).alias("threads"), F.round(metrics.mean_of(F.col("miss")), 9).alias("mean_miss"))


@query(f"SELECT o_orderkey, o_orderkey + 1 AS next, o_orderkey - 1 AS previous, CASE WHEN s = 9223372036854775807 THEN -9223372036854775807 - 1 ELSE s + 1 END AS swapped_next FROM (SELECT o_orderkey, {_ORDER_KEY} AS s FROM orders)")
def key_step(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", keys.increment(k).alias("next"), keys.decrement(k).alias("previous"), keys.increment(keys.bswap64(k)).alias("swapped_next"))


_FORMATTED = [(0, "0B"), (1, "1B"), (1023, "1023B"), (1024, "1K"), (1572864, "1M"), (1 << 30, "1G"), (5 << 40, "5T"), (3 << 50, "3072T")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({a}::BIGINT, '{b}')" for a, b in _FORMATTED) + ") AS t(n, s)")
def size_format(spark, d):
    return spark.createDataFrame([(a,) for a, _ in _FORMATTED], "n long").select("n", sizes.size_text(F.col("n")).alias("s"))


@query("SELECT n_chars, n_chars // 100 AS records, n_chars % 100 AS left_over FROM (SELECT DISTINCT n_chars FROM documents)")
def record_count(spark, d):
    """Whole records of 10 + 90 bytes in a size, and the bytes left over."""
    sizes_ = table(spark, d, "documents").select("n_chars").distinct()
    records_, over = sizes.records_in(F.col("n_chars"), 10, 90)
    return sizes_.select("n_chars", records_.alias("records"), over.alias("left_over"))


_SIZES = [("77", 77), ("1024B", 1024), ("512kb", 524288), ("1M", 1048576), ("1MB", 1048576), ("1.5G", 1610612736), (" 2gb ", 2147483648), ("0", None), ("x", None), ("5T", 5497558138880)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b if b is not None else 'NULL'}::BIGINT)" for a, b in _SIZES) + ") AS t(s, n)")
def size_parse(spark, d):
    return spark.createDataFrame([(a,) for a, _ in _SIZES], "s string").select("s", sizes.size_bytes(F.col("s")).alias("n"))


@query()
def generated_sort(spark, d):
    """Seeded 10/90 records, sorted by their bytes, with positions. No table is read."""
    made = generator.generate(spark, 5000, 10, 90, seed=42)
    placed = sort.with_position(made, F.col("key"), [F.col("value")])
    return placed.select("pos", F.hex("key").alias("key"), F.md5("value").alias("value_md5"))
