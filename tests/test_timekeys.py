"""F15/F16 stay on UTC wall clock whatever the session time zone is."""
import datetime as dt

from pyspark.sql import functions as F

from linkweave.functions import as_of, month_of


def test_as_of_is_time_zone_independent(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/Los_Angeles", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            r = spark.range(1).select(
                as_of(dt.datetime(2026, 1, 1)).alias("a"), as_of("2026-01-01 00:00:00").alias("b"),
                as_of(dt.datetime(2026, 1, 1, 9, tzinfo=dt.timezone(dt.timedelta(hours=9)))).alias("c"),
                month_of(as_of("2026-01-31 23:30:00")).alias("m")).first()
            assert r.a == r.b == r.c == dt.datetime(2026, 1, 1), tz
            assert r.m == "2026-01", tz
        now = spark.range(1).select(as_of().alias("n")).first().n
        utc_now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        assert abs((utc_now - now).total_seconds()) < 120
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
