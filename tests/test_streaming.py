from replicalens.operators import classify
from replicalens.plans.derived import table
from replicalens.streaming import replan

SF = "/root/testdata/sf0.001"


def test_stream_ends_where_the_batch_does(spark, tmp_path):
    lines = table(spark, SF, "lines")
    for n, part in enumerate(lines.randomSplit([1.0, 1.0, 1.0], seed=3)):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    replan.start(stream, f"{tmp_path}/out").awaitTermination()
    key = lambda df: sorted(map(str, df.select("project_key", "sid", "klass", "direction", "metadata_differs").collect()))
    want, got = classify.classify(lines), replan.latest(spark, f"{tmp_path}/out")
    assert key(got) == key(want)
