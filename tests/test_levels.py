"""Session levels on small bars."""

import datetime

from pyspark.sql import functions as F

from barspark.operators import levels


def test_wide_bars_keep_their_volume(spark):
    bars = spark.createDataFrame([("x", datetime.datetime(2024, 1, 15, 15), 0.0, 1199.5, 2400.0)], "instrument string, ts timestamp_ntz, low double, high double, volume double")
    got = levels.volume_profile(bars, 1.0).agg(F.count("*"), F.sum("volume"), F.max("bin")).first()
    assert tuple(got) == (1200, 2400.0, 1199)
