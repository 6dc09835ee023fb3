"""Places of contexts: those of common words go by a part of the texts, and what is left is counted in all."""

from pyspark.sql import functions as F

from tidemark.llm import pii


def test_common_contexts_go_by_a_part_of_the_texts(spark, monkeypatch):
    texts = [f"one of the cats and one of the dogs {i} saw one of the birds" for i in range(2000)] + [f"token key : k{i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = pii.own_rows(docs)
    common, rare = (F.xxhash64(F.lit(a), F.lit(b)) for a, b in (("of", "the"), ("key", ":")))
    wanted = spark.range(1).select(F.explode(F.array(common, rare)).alias("left")).select(F.col("left").alias("key"), "left", F.lit("").alias("right"), F.lit(5).cast("long").alias("of"))
    every = {r["left"]: r["n_places"] for r in pii.placed(rows, wanted).collect()}
    assert sorted(every.values()) == [40, 6000]
    counted, plain = [], pii.placed

    def told(*given):
        counts = plain(*given)
        counted.append(sum(r["n_places"] for r in counts.collect()))
        return counts

    monkeypatch.setattr(pii, "placed", told)
    left = {r["left"] for r in pii.seldom_by_chance(rows, wanted).collect()}
    assert left == {a for a, n in every.items() if 5 >= pii.MIN_PLACES * n} and len(left) == 1
    assert sum(counted) < 2000 and counted[-1] == 40  # 6040 rows before


def test_all_contexts_stay_that_hold_enough(spark):
    texts = [f"a b {i}" for i in range(100)]
    rows = pii.own_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    one = spark.range(1).select(F.xxhash64(F.lit("a"), F.lit("b")).alias("key")).select("key", F.col("key").alias("left"), F.lit("").alias("right"))
    for of, stays in ((2, 1), (1, 0)):  # 2 % of 100 places, and less
        assert pii.seldom_by_chance(rows, one.withColumn("of", F.lit(of).cast("long"))).count() == stays
