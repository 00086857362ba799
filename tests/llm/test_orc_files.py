"""What the ORC files themselves hold: stripes, row indexes, Bloom filters, run-length encoding; and what readers skip by them."""

import re
from glob import glob

import pyarrow.orc as orc
import pytest
from pyspark.sql import functions as F

from sortweave.llm import orc_ids
from sortweave.llm.common import new_path

ROWS = 60_000


@pytest.fixture(scope="module")
def stored(spark):
    path = new_path(spark, "orc-files")
    docs = spark.range(0, 2 * ROWS, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    orc_ids.write_orc(docs, path, stripe_bytes=1 << 16)
    return path


def files(path):
    return sorted(glob(re.sub("^file:/+", "/", path) + "/*.orc"))


def scanned(df):
    """Rows that the reader gives to Spark, before Spark's own filter; and rows of the result."""
    rows = len(df.collect())
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value(), rows


def test_stripes_row_indexes_and_encoding(stored):
    opened = [orc.ORCFile(f) for f in files(stored)]
    assert sum(f.nrows for f in opened) == ROWS
    assert all(f.nstripes > 1 for f in opened)
    assert all(f.row_index_stride == 1000 for f in opened)
    assert {str(f.file_version) for f in opened} == {"0.12"}  # integers of run-length encoding 2
    last = -1
    for f in opened:  # stripes are read one by one and hold ascending ids
        for i in range(f.nstripes):
            ids = f.read_stripe(i, columns=["doc_id"]).column(0).to_pylist()
            assert ids == sorted(ids) and ids[0] > last
            last = ids[-1]


def test_bloom_filters_are_in_the_index(spark, stored):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def index_bytes(path):
        options = jvm.org.apache.orc.OrcFile.readerOptions(conf)
        readers = [jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), options) for f in files(path)]
        return sum(s.getIndexLength() for r in readers for s in r.getStripes())

    plain = new_path(spark, "orc-plain")
    spark.read.orc(stored).write.options(**{"compression": "zstd", "orc.row.index.stride": "1000", "orc.stripe.size": str(1 << 16)}).orc(plain)
    # at 1 % false positives a filter has over nine bits an id
    assert index_bytes(stored) > index_bytes(plain) + ROWS


def test_statistics_and_bloom_filters_skip_rows(spark, stored):
    assert scanned(orc_ids.read_orc(spark, stored)) == (ROWS, ROWS)
    read, found = scanned(orc_ids.read_orc(spark, stored, [41_000]))
    assert found == 1 and read <= 4000  # row groups of 1000
    # odd ids lie within the minimum and maximum of row groups, but in no filter
    misses = [scanned(orc_ids.read_orc(spark, stored, [i])) for i in range(10_001, 110_001, 10_000)]
    assert all(found == 0 for _, found in misses)
    assert sum(read for read, _ in misses) <= 2000
