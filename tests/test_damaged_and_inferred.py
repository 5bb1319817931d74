import datetime
import os

import pytest

from tidegrid.sources import delimited as dl
from tidegrid.sources import io


def write(path, text):
    path.write_text(text)
    return f"file://{path}"


def test_inference(spark, tmp_path):
    a = write(tmp_path / "a.csv", "id,price,day,at,flag,code,big,none,mixed\n1,2,2024-01-05,2024-01-05 10:00:00,true,007,12345678901234567890,,1\n2,,2024-02-30x,2024-01-06,False,8,1,,x\n")
    b = write(tmp_path / "b.csv", "PRICE,id,extra\n2.5,3,\n1e3,4,e\n")
    texts = dl.read_text_columns(spark, [a, b])
    assert dl.inferred_types(texts) == {"id": "bigint", "price": "double", "day": "string", "at": "timestamp_ntz", "flag": "boolean", "code": "string", "big": "string", "none": "string", "mixed": "string", "extra": "string"}
    rows = {r.id: r for r in dl.read_inferred(spark, [b, a]).collect()}
    assert rows[1].PRICE == 2.0 and rows[4].PRICE == 1000.0 and rows[2].PRICE is None and rows[1].code == "007" and rows[3].flag is None
    assert rows[2].at == datetime.datetime(2024, 1, 6) and rows[1].flag is True and rows[4].extra == "e"


def test_no_value_turns_null(spark, tmp_path):
    values = ["1", "-0", "+5", "1.", ".5", "1e400", "NaN", "2024-02-30", "2024-01-01", "2024-01-01T00:00", "true", " 7 ", "1_0", "0x1", "١"]
    for other in values:
        for value in values:
            path = write(tmp_path / "v.csv", f"v,w\n{value},\n{other},1\n")
            kinds = dl.inferred_types(dl.read_text_columns(spark, [path])) if value == other else None
            if kinds:
                got = dl.read_inferred(spark, [path]).where("v is null").count()
                assert got == 0, (value, kinds)


def test_empty_files(spark, tmp_path):
    empty, bare = write(tmp_path / "e.csv", ""), write(tmp_path / "h.csv", "a,b\n")
    assert dl.read_inferred(spark, [empty, bare]).count() == 0
    with pytest.raises(ValueError):
        dl.read_inferred(spark, [empty])


def test_damaged_pages_are_listed(spark, tmp_path):
    for name in "abc":
        rows = spark.range(20_000).selectExpr("id", f"'{name}' as name", "uuid() as noise")
        rows.coalesce(1).write.parquet(f"file://{tmp_path}/{name}")
    spark.range(0).selectExpr("id", "'d' as name", "'' as noise").coalesce(1).write.parquet(f"file://{tmp_path}/d")
    paths = {n: next(f"{tmp_path}/{n}/{f}" for f in os.listdir(f"{tmp_path}/{n}") if f.endswith(".parquet")) for n in "abcd"}
    data = bytearray(open(paths["b"], "rb").read())
    for i in range(len(data) // 2, len(data) // 2 + 2000):
        data[i] ^= 0x5A
    open(paths["b"], "wb").write(bytes(data))
    open(paths["c"], "wb").write(b"not a file of that kind")
    for n in "bc":
        os.remove(f"{tmp_path}/{n}/.{os.path.basename(paths[n])}.crc")
    whole, lost = io.read_whole_files(spark, [f"file://{p}" for p in paths.values()])
    assert {r.name: r["count"] for r in whole.groupBy("name").count().collect()} == {"a": 20_000}
    got = {os.path.basename(os.path.dirname(r.file)): (r.n_footer, r.n_read < 20_000) for r in lost.collect()}
    assert got == {"b": (20_000, True), "c": (None, True)}
    assert io.read_whole_files(spark, [f"file://{paths['c']}"], "id long")[0].count() == 0


def lineitem(spark, folder, n_third):
    rows = spark.range(400_000 + n_third).selectExpr("if(id < 400000, id % 2 + 1, 3) as l_linenumber", "cast(id % 50 as double) as l_quantity", "xxhash64(id) as l_orderkey", "rand(3) as l_extendedprice")
    rows.write.parquet(f"file://{folder}/lineitem.parquet")
    return f"file://{folder}"


@pytest.mark.parametrize("n_third", [0, 1, 300_000])
def test_damage_of_any_size_stays_out_of_the_driver(spark, tmp_path, n_third):
    import tracemalloc

    from tidegrid.plans.profile_queries import damaged_files

    sf_dir = lineitem(spark, tmp_path, n_third)
    tracemalloc.start()
    try:
        got = {r.line: r.n for r in damaged_files(spark, sf_dir).collect()}
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == {1: 200_000, 2: 200_000}
    assert most < 2_000_000  # the damaged files have 5 MB


def test_pages_are_held_against_their_checksums(spark, tmp_path):
    """Damage that decodes: a value of a page that is neither compressed nor encoded."""
    rows = spark.range(1000).selectExpr("id * 1000003 as v").coalesce(1)
    rows.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(f"file://{tmp_path}/t")
    (name,) = (f for f in os.listdir(tmp_path / "t") if f.endswith(".parquet"))
    path = tmp_path / "t" / name
    data = bytearray(path.read_bytes())
    at = data.index((500 * 1000003).to_bytes(8, "little"))
    data[at] ^= 1
    path.write_bytes(bytes(data))
    os.remove(tmp_path / "t" / f".{name}.crc")
    whole, lost = io.read_whole_files(spark, [f"file://{path}"])
    assert whole.count() == 0 and [r.n_footer for r in lost.collect()] == [1000]
