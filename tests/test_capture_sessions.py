from netloom.sources.captures import read_captures, write_captures


def test_writes_while_another_session_is_active(spark, tmp_path):
    frames = spark.createDataFrame([(1_000_000, bytearray(60))], "us long, frame binary").selectExpr("timestamp_micros(us) AS ts", "frame")
    other = spark.newSession()
    other.createDataFrame([(1,)], "a int").count()
    try:
        write_captures(frames, str(tmp_path / "captures"))
    finally:
        spark.createDataFrame([(1,)], "a int").count()  # active again
    assert read_captures(spark, str(tmp_path / "captures")).count() == 1
