import random
import statistics

from tracehold.operators.median import grouped_median


def test_exact(spark):
    rng = random.Random(5)
    groups = {"even": [rng.gauss(0, 1e6) for _ in range(1000)], "odd": [float(rng.randrange(50)) for _ in range(777)],
              "one": [3.5], "two": [-1.0, 4.0], "hot": [7.0] * 500 + [8.0] * 499, "wide": [1e-300, 1e300, -1e300, 0.0, 5.0],
              "signs": [-0.25, -0.5, 0.0, 0.5, 1.5, -2.0], "near": [1.0 + i * 1e-12 for i in range(300)],
              "third": [float(i) for i in range(3000) if i % 3], None: [2.0, 9.0, 4.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("odd", None), ("empty", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r.median for r in grouped_median(df, ["g"], "v").collect()}
    assert got == {k: statistics.median(v) for k, v in groups.items()}
