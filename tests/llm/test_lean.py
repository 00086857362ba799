import pyarrow as pa

from sortweave.llm.common import lean


def test_lean_passes_batches_on_and_ends_when_its_reader_stops_early(spark):
    df = spark.range(1000, numPartitions=3)
    assert sorted(r.id for r in df.mapInArrow(lean(lambda batches: batches), df.schema).collect()) == list(range(1000))

    ended = []

    def run(batches):
        try:
            yield from batches
        finally:
            ended.append(True)

    first = lean(run)(iter([pa.record_batch([[1]], ["x"]), pa.record_batch([[2]], ["x"])]))
    assert next(first).num_rows == 1
    first.close()
    assert ended == [True]
