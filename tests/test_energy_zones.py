from pyspark.sql import functions as F

from loadlens.operators import energy


def test_months_of_a_half_hour_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        minutes = spark.range(240).select(
            F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-31 22:00:00")) + F.col("id") * 60).alias("Timestamp"),
            F.lit(60.0).alias("Global_active_power"),
            F.lit(0.0).alias("Global_reactive_power"),
        )
        monthly = energy.energy_tables(minutes)["monthly"]
        rows = sorted(r["Energy_Global_active_power"] for r in monthly.collect())
        assert rows == [120.0, 120.0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
