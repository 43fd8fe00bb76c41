from pyspark.sql import functions as F

from recolta.operators import search as R
from tests.test_operators import CFG, item, items


def test_captions_and_diacritics(spark):
    rows = items(spark, item("1", "a photo"), item("2", "Cafe\u0301 cr\u00e8me"), item("3", "nothing"))
    df = rows.withColumn("image_captions", F.when(F.col("id") == "1", F.array(F.lit("the caf\u00e9"), F.lit(None), F.lit("harbour"))))
    found = lambda q: {r.id for r in R.bm25(df, "id", R.indexed(df), q, fold=True).collect()}
    assert found("cafe") == found("CAF\u00c9") == found("cafe\u0301") == {"1", "2"}
    assert found("photo harbour") == {"1"} and found("creme") == {"2"}
    assert R.bm25(df, "id", ["text_content"], "creme").count() == 0
    lexical = R.hybrid(df, "harbour", CFG, 3).first()
    assert lexical.id == "1"
