import random

from recolta.operators import search as R
from recolta.plans import core_queries as C


def test_every_fiftieth_row_is_a_query(spark, tmp_path):
    rng = random.Random(1)
    data = [(i, [float(rng.randrange(4)) for _ in range(6)]) for i in range(230)] + [(231, None), (232, [1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = [(i, v) for i, v in data if v and len(v) == 6]
    want = {(q, i, d) for q, x in whole if q % 50 == 0 for d, i in sorted((sum((a - b) ** 2 for a, b in zip(x, v)), i) for i, v in whole)[:20]}
    got = C.vector_knn_all(spark, str(tmp_path)).collect()
    assert len(got) == 100 and {(r.query, r.vec_id, r.distance) for r in got} == want
    small = R.nearest_all(df, "vec_id", "embedding", df.filter("vec_id % 50 = 0"), 20, 16)
    assert {tuple(r) for r in small.collect()} == want
