import random

from colinear.operators.seeds import seed_blocks
from colinear.streaming.arrivals import seed_arrivals


def test_arrivals_equal_a_batch(spark, tmp_path):
    r = random.Random(2)
    genome = "".join(r.choice("ACGT") for _ in range(500))
    target = spark.createDataFrame([(0, genome)], "seq_id long, seq string")
    query = spark.createDataFrame([(1, genome[50:150]), (2, genome[300:380])], "seq_id long, seq string")
    query.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(query.schema).parquet(str(tmp_path / "in"))
    seed_arrivals(stream, target, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out" / "batch=0")).drop("batch")
    assert sorted(got.collect()) == sorted(seed_blocks(query, target, 15).collect())
