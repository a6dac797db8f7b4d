from kestrelgrid.streaming import mosaic_audit as ma


def test_closed_dates_are_appended_once(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def arrive(*dates):
        spark.createDataFrame([(d, 0, x, 5000 + x, 0) for d in dates for x in range(3)], ma.SCHEMA).write.mode("append").parquet(source)
        ma.append_audit(spark, source, target, state, 1000, late="10 days").awaitTermination()

    arrive("A2010001", "A2010005")
    arrive("A2010040")
    arrive("A2010041")
    rows = spark.read.parquet(target).orderBy("date").collect()
    assert [(str(r.date), r.valid_pixels, r.status) for r in rows] == [("2010-01-01", 3, "SKIPPED_VERY_LOW"), ("2010-01-05", 3, "SKIPPED_VERY_LOW")]
