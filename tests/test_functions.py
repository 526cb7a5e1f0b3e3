"""Column functions on bytes, with the high bit set too."""

from pyspark.sql import functions as F

from lodestone import functions as fn


def test_integers_of_binary(spark):
    df = spark.createDataFrame([(bytearray(b"\x96\x00\xff\x80\x01"),), (bytearray(b"\x01"),), (None,)], "b binary")
    rows = df.select(fn.le_uint("b", 0, 4), fn.le_int("b", 2, 2), fn.be_uint("b", 0, 2), fn.varint_at(F.col("b"), F.lit(0))).collect()
    assert tuple(rows[0])[:3] == (0x80FF0096, 0x80FF - 65536, 0x9600) and rows[0][3].asDict() == {"value": 0x16, "size": 2}
    assert tuple(rows[1])[:3] == (None, None, None)
    assert tuple(rows[2])[:3] == (None, None, None)


def test_epoch_texts_of_any_year_and_time_zone(spark, duck):
    values = [0, -1, 86_461_000 * 5_999_999, 253_402_300_799_999, 253_402_300_800_000, -62_135_596_800_000, -62_167_219_200_000, -62_200_000_000_000, -60_000_000_000_000, 9_223_372_022_399_999, 1_679_792_400_000, None]
    sql = "SELECT strftime(make_timestamp(CAST(? AS BIGINT) * 1000), '%Y/%-m/%-d %-H:%-M')"
    want = [duck.execute(sql, [v]).fetchone()[0] for v in values]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v long").orderBy("i")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r[0] for r in df.select(fn.epoch_text(F.col("v"))).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
