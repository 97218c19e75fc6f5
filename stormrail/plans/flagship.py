"""The flagship plan used by ``entry``: feature build -> average delay ->
delay class -> class distribution per station."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormrail import roles as R
from stormrail.functions.scalar import avg_delay, class_by_limits
from stormrail.plans.ingest import build_features


def class_distribution_by_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = build_features(R.delays(spark, sf_dir), R.observations(spark, sf_dir), R.strikes(spark, sf_dir))
    labelled = f.withColumn("avg_delay", avg_delay("delay", "train_count")) \
                .withColumn("class", class_by_limits("delay"))
    return labelled.groupBy("station", "class").agg(
        F.count(F.lit(1)).cast("long").alias("count"),
        F.round(F.avg("avg_delay"), 6).alias("mean_avg_delay"))
