import pyarrow as pa

from agora.llm.shipping import BATCH_BYTES, ship


def _bytes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "b": [batch.nbytes]})


def test_batches_for_python_are_bounded_in_bytes(spark):
    long_texts = spark.range(3000, numPartitions=1).selectExpr("id", "repeat('x', 10000) AS text")
    found = long_texts.mapInArrow(_bytes, "n long, b long").collect()
    assert sum(r.n for r in found) == 3000
    assert max(r.b for r in found) <= BATCH_BYTES + 20_000


def test_one_long_row_is_never_cut(spark):
    one = spark.range(2, numPartitions=1).selectExpr("repeat('x', 10000000) AS text")
    assert [r.n for r in one.mapInArrow(_bytes, "n long, b long").collect()] == [1, 1]


def test_a_smaller_bound_of_the_session_stays(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for own, then in (("1000000", "1000000"), ("1m", "1m"), ("3kb", "3kb"), ("1g", str(BATCH_BYTES)), ("67108864b", str(BATCH_BYTES))):
            spark.conf.set(name, own)
            ship(spark)
            assert spark.conf.get(name) == then
    finally:
        spark.conf.set(name, before)
