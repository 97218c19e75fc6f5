"""The trees of personal data learn from every candidate."""

from pyspark.sql import functions as F

from stormrail.llm import pii


def test_all_candidates_are_trained_on(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier
    x = F.struct(*[((F.col("id") * (i + 3)) % 17).cast("double").alias(f) for i, f in enumerate(pii.FEATURES)])
    found = spark.range(40_000).select(F.struct((F.col("id") % 4).cast("int").alias("order"), x.alias("x")).alias("c"),
                                       (F.col("id") % 17 > 5).cast("int").alias("label"))
    seen, fit = [], GBTClassifier.fit

    def watched(self, rows, *args):
        seen.append(rows.agg(F.sum("n")).first()[0])
        return fit(self, rows, *args)

    monkeypatch.setattr(GBTClassifier, "fit", watched)
    monkeypatch.setattr(pii, "TREES", 2)
    assert pii.train(found) is not None
    assert seen == [found.filter(F.pmod(F.xxhash64("c"), F.lit(4)) != 0).count()] and seen[0] > 20_000
