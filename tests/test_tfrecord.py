import os
import struct
import zlib

import numpy as np
import pytest

from tidegrid.sources import tfrecord as tf

SCHEMA = "id long, x array<double>, name string, flag boolean, raw binary, score double, small int"


@pytest.fixture()
def rows(spark):
    tf.register(spark)
    data = [(i - 3, [float(k) / 4 for k in range(i % 5)], f"é{i}", i % 2 == 0, bytes([i % 256, 0]), i / 8, -i) for i in range(50)]
    return spark.createDataFrame([*data, (None,) * 7], SCHEMA)


def files(path):
    return sorted(f for f in os.listdir(path) if f.endswith(".tfrecord"))


def test_sums():
    # Published check value of CRC-32C, and its mask.
    crc = 0xE3069283
    assert tf.masked_sums([b"123456789"])[0] == (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF
    rng = np.random.default_rng(0)
    parts = [rng.bytes(int(n)) for n in rng.integers(0, 60, 40)] + [b""]
    assert tf.masked_sums(parts).tolist() == [tf.masked_sums([p])[0] for p in parts] and tf.masked_sums([]).tolist() == [] and [tf.masked_sum(p) for p in parts] == tf.masked_sums(parts).tolist()


def test_bytes_of_a_known_example():
    # The text form of the format: features { feature { key: "a" value { int64_list { value: 1 } } } }
    assert tf.encode_example({"a": 1}, {"a": "int64"}) == bytes.fromhex("0a0c0a0a0a0161120 51a030a0101".replace(" ", ""))
    assert tf.decode_example(tf.encode_example({"a": -1, "b": None}, {"a": "int64", "b": "float"}), {"a", "b"}) == {"a": [-1]}


def test_round_trip(spark, rows, tmp_path):
    path = f"{tmp_path}/out"
    rows.repartition(3).write.format("tfrecord").option("maxRecordsPerFile", 7).mode("append").save(path)
    got = spark.read.format("tfrecord").schema(SCHEMA).load(path)
    key = lambda r: (r.id is not None, r.id or 0)
    assert sorted(got.collect(), key=key) == sorted(rows.collect(), key=key)
    assert not os.path.exists(f"{path}/_temporary") and os.path.exists(f"{path}/_SUCCESS") and len(files(path)) >= 8
    assert spark.read.format("tfrecord").schema("name string, other double").load(path).where("name = 'é7' and other is null").count() == 1
    rows.limit(5).write.format("tfrecord").mode("overwrite").save(path)
    assert spark.read.format("tfrecord").schema("id long").load(path).count() == 5
    rows.limit(2).write.format("tfrecord").mode("append").save(path)
    assert spark.read.format("tfrecord").schema("id long").load(path).count() == 7


def test_empty(spark, rows, tmp_path):
    rows.limit(0).write.format("tfrecord").mode("append").save(f"{tmp_path}/none")
    assert spark.read.format("tfrecord").schema("id long").load(f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("where", ["length", "payload", "end"])
def test_damage_is_reported(spark, rows, tmp_path, where):
    path = f"{tmp_path}/out"
    rows.coalesce(1).write.format("tfrecord").mode("append").save(path)
    name = f"{path}/{files(path)[0]}"
    data = bytearray(open(name, "rb").read())
    second = 16 + struct.unpack("<Q", data[:8])[0]
    if where == "end":
        data = data[:-3]
    else:
        data[second + (1 if where == "length" else 20)] ^= 4
    open(name, "wb").write(bytes(data))
    with pytest.raises(Exception, match="damaged record at byte " + ("" if where == "end" else str(second))):
        spark.read.format("tfrecord").schema("id long").load(path).collect()


def test_a_failed_task_leaves_nothing(spark, rows, tmp_path):
    path = f"{tmp_path}/out"
    bad = rows.selectExpr("id", "if(id = 20, raise_error('no'), name) as name").repartition(4)
    with pytest.raises(Exception, match="no"):
        bad.write.format("tfrecord").mode("append").save(path)
    assert not os.path.exists(path) or os.listdir(path) == []
    with pytest.raises(Exception, match="no TFRecord feature holds"):
        rows.selectExpr("current_date() as d").write.format("tfrecord").mode("append").save(path)
