import hashlib
import base64

import pytest

from tidegrid.llm import sharding, url_filter, warc
from tidegrid.llm.queries import URL_RULES


def judge(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, "allow"
    rest = url[at + 3 :]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, action in URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, action
    return host, path, best and best[0], best[1] if best else "allow"


URLS = [None, "", "example.com/en/7", "http://A.Example.COM/en/7x?q", "https://x.com/en/7", "https://com/en/", "https://xcom/en/a", "http://a.example.net/de/8#f", "http://a.example.net/de/9", "ftp://org/es/", "http://b.org", "http://b.org?x=/es/", "http://é.org/es/ü", "a://b://c.com/en/", "http://.com/en/", "http://x.com/EN/", "http://" + "a." * 200 + "com/en/" + "y" * 9000]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i % 15, u, 1, "z") for i, u in enumerate(URLS * 2)], "page_id long, url string, entry int, rule string")
    rules = spark.createDataFrame(URL_RULES, "entry string, action string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.url_filter(pages, rules).collect())
    want = sorted((i % 15, h, p, rule or "", v) for i, (h, p, rule, v) in ((i, judge(u)) for i, u in enumerate(URLS * 2)))
    assert got == want
    assert url_filter.url_filter(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.url_filter(pages, rules.limit(0)).collect()} == {"allow"}


def test_bloom_never_misses(spark):
    rules = spark.createDataFrame([(f"h{i}.org/p{i}", "block") for i in range(500)], "entry string, action string")
    pages = spark.createDataFrame([(i, f"http://a.h{i}.org/p{i}/x") for i in range(1000)], "page_id long, url string")
    assert url_filter.url_filter(pages, rules).where("verdict = 'block'").count() == 500


def test_warc_round_trip(spark, tmp_path):
    html = [None, "", "<p>é</p>", "<p>é</p>", "x" * 200_000, "", "a\r\nb"]
    rows = [(i, f"http://h/{i}\r\nX: y", h, "z") for i, h in enumerate(html)] + [(2, "u", "<p>é</p>", "z"), (9, None, "only", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, address string")
    warc.write_archive(pages, f"{tmp_path}/w")
    records = warc.read_archive(spark, f"{tmp_path}/w")
    got = sorted(tuple(r) for r in warc.describe_records(records).fillna(-1).collect())
    want = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        first = min(k for k, _, x, _ in rows if (x or "").encode() == data)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, len(data), digest, "response" if i == first else "revisit", -1 if i == first else first))
    assert got == sorted(want)
    assert spark.read.parquet(f"{tmp_path}/w/payloads").count() == len({(h or "") for _, _, h, _ in rows})
    for r in records.collect():
        revisit = b"WARC-Type: revisit" in r.header
        assert r.record == bytes(r.header) + (b"" if revisit else bytes(r.payload)) + b"\r\n\r\n" and bytes(r.header).endswith(b"\r\n\r\n")
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert warc.round_trip(pages, min_bytes=5).where("payload_bytes < 5 and record_type = 'revisit'").count() == 0


def test_warc_finds_a_changed_payload(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), f"{tmp_path}/w")
    spark.read.parquet(f"{tmp_path}/w/payloads").selectExpr("address", "cast('abd' as binary) as payload").write.parquet(f"{tmp_path}/v")
    spark.read.parquet(f"{tmp_path}/v").write.mode("overwrite").parquet(f"{tmp_path}/w/payloads")
    with pytest.raises(Exception, match="digest"):
        warc.read_archive(spark, f"{tmp_path}/w").collect()


def test_shards(spark, odd_docs, no_docs, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, fan_in=3, shard_rows=2)
    for _ in range(4):
        store.append(odd_docs)
    before = len(store.manifest()["files"])
    store.append(no_docs)
    version = store.compact()
    assert len(store.manifest()["files"]) < before and version == max(store.versions())
    key = lambda df: sorted(map(str, df.collect()))
    assert key(store.read()) == sorted(key(odd_docs) * 4)
    assert key(store.read(1)) == key(odd_docs)
    assert store.vacuum() == 0 and store.vacuum(min_age_s=0) > 0 and store.read().count() == 48
    empty = sharding.ShardStore(spark, f"file://{tmp_path}/e")
    empty.append(no_docs)
    empty.compact()
    assert empty.read().count() == 0


def test_a_lost_race_leaves_the_version(spark, odd_docs, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    base = store.manifest()
    store.append(odd_docs)
    with pytest.raises(sharding.ShardConflict):
        store._commit(base, [], odd_docs.schema.json())
    assert store.read().count() == odd_docs.count()


def test_tiers():
    store = sharding.ShardStore.__new__(sharding.ShardStore)
    store.target_bytes, store.fan_in = 1000, 3
    files = [{"path": str(i), "bytes": b} for i, b in enumerate([10, 11, 12, 400, 90, 900, 950, 901])]
    assert [[f["bytes"] for f in run] for run in store.plan(files)] == [[10, 11, 12]]


def test_arrivals_in_flight_and_changed_columns(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/f")
    assert store.vacuum() == 0
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, Text string"))
    late, base = store._write(spark.createDataFrame([(2, "b")], "doc_id long, Text string")), store.manifest()
    assert store.vacuum() == 0
    assert store._commit(base, [*base["files"], *late], base["schema"]) == 2 and store.read().count() == 2
    # Names in another case, columns that lack and columns that are new.
    store.append(spark.createDataFrame([("c", 3, 1.5)], "text string, DOC_ID long, score double"))
    store.append(spark.createDataFrame([(4,)], "doc_id long"))
    got = store.read()
    assert got.columns == ["doc_id", "Text", "score"] and {tuple(r) for r in got.collect()} == {(1, "a", None), (2, "b", None), (3, "c", 1.5), (4, None, None)}
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("5",)], "doc_id string"))
    lost, base = store._write(spark.createDataFrame([(6, "x")], "doc_id long, Text string")), store.manifest()
    assert store.vacuum(min_age_s=0) == len(lost)  # written by a job that died long ago
    with pytest.raises(sharding.MissingFiles):
        store._commit(base, [*base["files"], *lost], base["schema"])
    assert store.read().count() == 4


def test_nested_types_in_appends(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/n", fan_in=2)
    store.append(spark.sql("select 1L as id, array('a') as tags, map('k', named_struct('x', 1)) as m, named_struct('y', array(1L)) as s"))
    wide = spark.createDataFrame([(2, ["b", None], {"k": (None,)}, ([None],)), (3, None, None, None)], "id long, tags array<string>, m map<string, struct<x: int>>, s struct<y: array<bigint>>")
    store.append(wide)
    store.append(spark.sql("select 4L as id, cast(array() as array<string>) as tags"))
    store.compact()
    got = {r.id: r.asDict(recursive=True) for r in store.read().collect()}
    assert got[1] == {"id": 1, "tags": ["a"], "m": {"k": {"x": 1}}, "s": {"y": [1]}} and got[2]["tags"] == ["b", None] and got[2]["m"] == {"k": {"x": None}}
    assert got[3]["tags"] is None and got[4]["tags"] == [] and got[4]["m"] is None
    with pytest.raises(ValueError):
        store.append(spark.sql("select 5L as id, array(1) as tags"))
