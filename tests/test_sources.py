import pytest

from tidegrid.sources import io


def test_drift_is_resolved_and_bad_files_listed(spark, tmp_path):
    spark.createDataFrame([(1, 2.0)], "id int, airport_fee double").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([(2**40, 3.0)], "ID long, Airport_fee double").write.parquet(f"{tmp_path}/b")
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{tmp_path}/c")
    df, bad = io.read_normalized(spark, [f"{tmp_path}/{x}" for x in "abcd"], {"id": (["id"], "long"), "fee": (["airport_fee"], "double"), "extra": (["extra"], "string")}, required=["id"], provenance="file")
    assert sorted((r.id, r.fee, r.extra) for r in df.collect()) == [(1, 2.0, None), (2**40, 3.0, None)] and len(bad) == 2
    empty, _ = io.read_normalized(spark, [], {"id": (["id"], "long")})
    assert empty.count() == 0


def test_sink_profile_and_listing(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2) for i in range(100)], "id int, part int")
    io.write_partitioned(df, f"{tmp_path}/t", ["part"])
    back = spark.read.parquet(f"{tmp_path}/t")
    assert back.where("part = 1").count() == 50 and sum(r.n_rows for r in io.file_profile(back).collect()) == 100
    assert io.list_files(spark, f"{tmp_path}/t/part=*") and io.path_exists(spark, f"{tmp_path}/t") and not io.path_exists(spark, f"{tmp_path}/no")
    assert io.read_first_existing(spark, [f"{tmp_path}/no", f"{tmp_path}/t"]).count() == 100
    with pytest.raises(FileNotFoundError):
        io.read_first_existing(spark, [f"{tmp_path}/no"])


def test_names_and_guards(spark):
    assert io.monthly_paths("d/{year}-{month:02d}.parquet", [2024], [1, 2]) == ["d/2024-01.parquet", "d/2024-02.parquet"]
    df = spark.createDataFrame([("t_2024-03.parquet",)], "f string")
    assert tuple(df.select(*io.year_month(df["f"])).first()) == (2024, 3)
    assert io.keep_distinct_columns(df, ["f", "f", "x"]).columns == ["f"]
    assert ("f", "a", "string") in io.schema_diff({"a": df})
    with pytest.raises(ValueError):
        io.require(df, ["x"])
    with pytest.raises(ValueError):
        io.require_rows(df.where("false"))
