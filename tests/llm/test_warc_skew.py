from pyspark.sql import functions as F

from twinledger.llm import warc


def test_responses_do_not_meet_in_one_task(spark):
    rows = [(f"r{i}", i, "u", "response", None, "d", 1, "d") for i in range(400)]
    rows.append(("v1", 900, "u", "revisit", "r7", "d", None, None))
    records = spark.createDataFrame(rows, warc._PARSED).repartition(8)
    settings = {
        "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.files.minPartitionNum": "1000",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        found = warc.resolve(spark, records)
        counts = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        revisits = [tuple(r) for r in found.filter("record_type = 'revisit'").collect()]
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert sum(counts) == 401 and max(counts) <= 200
    assert revisits == [(900, 1, "d", "revisit", 7)]
