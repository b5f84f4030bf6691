"""Literal rows for operators that SQL over the driver's tables does not reach."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidewater.functions import codecs as K
from tidewater.functions import scalars as S
from tidewater.operators import metric_space as M
from tidewater.operators import relational as R
from tidewater.operators import windows as E
from tidewater.sources import content, events


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("text, value", [(b"i42e", 42), (b"i-7e", -7), (b"i0e", 0), (b"4:spam", b"spam"), (b"0:", b""), (b"l4:spami1ee", [b"spam", 1]), (b"d3:bari1e3:fooi2ee", {b"bar": 1, b"foo": 2}), (b"le", []), (b"de", {})])
def test_bencode_round_trip(text, value):
    assert K.bdecode(text) == value
    assert K.bencode(value) == text


@pytest.mark.parametrize("text", [b"", b"i042e", b"i-0e", b"ie", b"i12abce", b"5:spam", b"05:spam1", b"l", b"d1:ae", b"di1ei2ee", b"i1ei2e", b"x"])
def test_bencode_refuses(text):
    with pytest.raises(K.Malformed):
        K.bdecode(text)


def test_bencode_is_not_recursive():
    deep = b"l" * 50_000 + b"e" * 50_000
    assert K.bscan(deep)[1] == len(deep)


def test_bencode_columns(spark):
    rows = spark.createDataFrame([(bytearray(b"d1:ai1e1:bl1:x1:\xffee"),), (bytearray(b"i1"),), (None,)], "b binary")
    assert [r.x for r in rows.select(K.bencode_to_json("b").alias("x")).collect()] == ['{"a": 1, "b": ["x", {"hex": "ff"}]}', None, None]
    back = rows.limit(1).select(K.json_to_bencode(K.bencode_to_json("b")).alias("x")).first().x
    assert bytes(back) == b"d1:ai1e1:bl1:x1:\xffee"


def test_artifact_round_trip(spark):
    data = K.build_artifact("a.bin", b"x" * 40_000, 16_384, ["http://a", "http://b", "http://a"])
    got = spark.createDataFrame([(bytearray(data),), (bytearray(b"de"),)], "b binary").select(K.read_artifact("b").alias("a")).select("a.*").collect()
    assert got[0].name == "a.bin" and got[0].length == 40_000 and len(got[0].pieces) == 3 and got[0].trackers == ["http://a", "http://b"]
    assert got[0].info_hash == hashlib.sha1(K.bencode(K.bdecode(data)[b"info"])).hexdigest()
    assert got[1].error == "no announce" and got[1].pieces is None


def test_multi_file_offsets():
    info = {"files": [{"length": 1500, "path": ["a"]}, {"length": 1500, "path": ["d", "b"]}], "name": "n", "piece length": 1000, "pieces": b"h" * 60}
    a = K.artifact(K.bencode({"announce": "u", "info": info}))
    assert [(f["path"], f["offset"]) for f in a["files"]] == [("a", 0), ("d/b", 1500)]


def test_file_piece_ranges(spark):
    rows = spark.createDataFrame([(0, 1500), (1500, 3000)], ["start", "end"])
    got = R.pieces_of_files(rows, 1000).groupBy("start").agg(F.min("piece").alias("a"), F.max("piece").alias("b")).orderBy("start").collect()
    assert [(r.a, r.b) for r in got] == [(0, 1), (1, 2)]


def test_overlap_of_first_piece(spark):
    rows = spark.createDataFrame([(0, 600), (600, 1200)], ["start", "end"])
    assert [r.shared for r in R.pieces_of_files(rows, 1000).filter("piece = 0").orderBy("start").collect()] == [600, 400]


def test_bitfield(spark):
    assert one(spark, S.bitfield_hex("d", F.lit(8)), d=[0, 2, 5]) == "A4"
    row = spark.createDataFrame([(bytearray(b"\xa4"), i) for i in range(9)], "b binary, i int")
    assert [r.x for r in row.select(S.bit_set("b", "i").alias("x")).collect()] == [i in (0, 2, 5) for i in range(9)]


def test_rarest_piece(spark):
    rows = spark.createDataFrame(list(enumerate([3, 1, 5, 2, 1])), ["piece", "availability"])
    assert R.rarest(rows, rows.limit(0)).first().piece == 1


def test_buckets(spark):
    own = "00" * 20
    assert one(spark, S.bucket_index(F.lit("80" + "00" * 19), F.lit(own))) == 159
    assert one(spark, S.bucket_index(F.lit("00" * 19 + "01"), F.lit(own))) == 0
    assert one(spark, S.bucket_index(F.lit(own), F.lit(own))) == 0


def test_table_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, bucket int, first_seen long, last_seen long")
    r = M.table_stats(empty).first()
    assert (r.nodes, r.buckets, r.full, r.mean, r.oldest, r.newest) == (0, 0, 0, 0.0, None, None)


def test_lookup_finds_the_nearest(spark):
    ids = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(60)]
    ring = spark.createDataFrame([(ids[i], ids[(i + s) % 60]) for i in range(60) for s in (1, 2, 5, 11, 23)], "id string, neighbour string")
    target = "ff" * 20
    got = [r.id for r in M.lookup(ring, spark.createDataFrame([(ids[0],)], "id string"), target).orderBy("rank").collect()]
    best = sorted(ids, key=lambda x: int(x, 16) ^ int(target, 16))
    assert got[0] == best[0] and len(got) == 8


def test_compact_peers(spark):
    row = spark.createDataFrame([(bytearray.fromhex("C0A801011AE1"),)], "b binary")
    assert [tuple(p) for p in row.select(S.compact_peers("b").alias("x")).first().x] == [("192.168.1.1", 6881)]
    assert bytes(one(spark, S.encode_peer(F.lit("192.168.1.1"), F.lit(6881)))).hex() == "c0a801011ae1"
    node = spark.createDataFrame([(bytearray(b"\x01" * 20 + bytes.fromhex("C0A801011AE1")),)], "b binary")
    assert [tuple(p) for p in node.select(S.compact_nodes("b").alias("x")).first().x] == [("01" * 20, "192.168.1.1", 6881)]


def test_magnet(spark):
    h = "86f7e437faa5a7fce15d1ddcb9eaeaea377667b8"
    link = f"magnet:?xt=urn:btih:{h.upper()}&dn=a%20b&tr=http%3A%2F%2Fx&tr=http%3A%2F%2Fy"
    m = one(spark, S.magnet_parts(F.lit(link)))
    assert (m.topic, m.name, m.trackers) == (h, "a b", ["http://x", "http://y"])
    assert one(spark, S.magnet_link(F.lit(h), F.lit("a b"), F.array(F.lit("http://x"), F.lit("http://y")))) == link.replace(h.upper(), h)
    assert one(spark, S.magnet_parts(F.lit("magnet:?dn=x"))) is None
    assert one(spark, S.magnet_parts(F.lit("http://x"))) is None


def test_base32(spark):
    h = "86f7e437faa5a7fce15d1ddcb9eaeaea377667b8"
    row = spark.createDataFrame([(h,)], "h string").select("h", K.hex_base32("h").alias("b"))
    got = row.select("b", K.info_hash(F.lower("b")).alias("x"), K.base32_hex(F.lit("A1!!")).alias("bad")).first()
    assert got.x == h and len(got.b) == 32 and got.bad is None


def test_digest(spark):
    assert one(spark, S.sha1_hex(F.lit("a"))) == "86f7e437faa5a7fce15d1ddcb9eaeaea377667b8"


@pytest.mark.parametrize("n, text", [(0, "0 B"), (1, "1 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"), (5 * 1024**3, "5 GB")])
def test_format_bytes(spark, n, text):
    assert one(spark, S.format_bytes(F.lit(n))) == text


@pytest.mark.parametrize("ms, text", [(5_000, "5s"), (184_000, "3m 4s"), (3_720_000, "1h 2m"), (0, "0s")])
def test_format_duration(spark, ms, text):
    assert one(spark, S.format_duration(F.lit(ms))) == text


def test_file_warnings(spark):
    rows = spark.createDataFrame([("a.exe",), ("a.PDF",), ("a.odd",), ("a",), (".bashrc",)], "n string")
    assert [r.x for r in rows.select(S.file_warnings("n").alias("x")).collect()] == [["executable"], [], ["uncommon"], ["no_extension"], ["no_extension"]]


def test_frames(spark):
    data = b"\0\0\0\0" + b"\0\0\0\x05\x04abcd" + b"\0\0\0\x09\x07x"
    assert K.frames(data) == ([(None, b""), (4, b"abcd")], b"\0\0\0\x09\x07x")
    spark.udtf.register("read_frames", K.ReadFrames)
    got = spark.sql(f"SELECT * FROM read_frames(unhex('{data.hex()}'))").collect()
    assert [(r.place, r.message) for r in got] == [(0, None), (1, 4)]
    spark.udtf.register("read_values", K.ReadValues)
    assert [r.ends for r in spark.sql(f"SELECT * FROM read_values(unhex('{b'i1e4:spamx'.hex()}'))").collect()] == [3, 9]


def test_bans(spark):
    rows = spark.createDataFrame([("p", s) for s in (0, 100, 200, 300, 2100, 2200, 2300, 9000)], "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))
    got = E.bans(rows, "key", "ts").orderBy("banned_at").collect()
    assert [(r.banned_at, r.until) for r in got] == [(200.0, 2000.0), (2300.0, 4100.0)]


def test_token_bucket(spark):
    rows = spark.createDataFrame([("a", 0, 80.0), ("a", 1, 80.0), ("a", 11, 500.0)], "key string, tick long, want double")
    got = E.token_bucket(rows, "key", "tick", "want", rate=100.0, capacity=100.0).orderBy("tick").collect()
    assert [r.granted for r in got] == [80.0, 30.0, 100.0]


def test_account_lookup(spark):
    users = spark.createDataFrame([("1", "g1", "a@x"), ("2", None, "b@x")], "id string, google_id string, email string")
    wanted = spark.createDataFrame([("g1", "z@x"), ("g2", "b@x"), ("g3", "c@x")], "google_id string, email string")
    got = {r.google_id: (r.id, r.created) for r in R.get_or_create(wanted, users).collect()}
    assert got == {"g1": ("1", False), "g2": ("2", False), "g3": (None, True)}


def test_events_are_decoded_and_quarantined(spark):
    good = '{"type":"torrent:completed","infoHash":"h","timestamp":1700000000000,"userId":"u","data":"{\\"name\\":\\"n\\",\\"size\\":5,\\"averageSpeed\\":2.5}"}'
    rows = spark.createDataFrame([(good,), ('{"type":"x","infoHash":"h","timestamp":1}',), ("not json",), ('{"type":"torrent:added","timestamp":1}',), (None,)], "value string")
    e = events.decoded(rows)
    assert events.accepted(e).count() == 1
    assert [r.problem for r in events.quarantined(e).collect()] == ["unknown type", "no type", "no infoHash", "no type"]
    facts = events.facts(events.accepted(e))
    f = facts["torrent_completions"].first()
    assert (f.info_hash, f.size, f.average_speed, f.total_pieces) == ("h", 5, 2.5, 0)
    assert facts["torrents"].count() == 0 and facts["torrent_events"].count() == 1


def test_directives(spark):
    rows = spark.createDataFrame([('{"type":"JOB_ASSIGNED","payload":"{}","timestamp":1}',), ('{"type":"NOPE","payload":"{}","timestamp":1}',), ('{"type":"JOB_PAUSED","payload":"3","timestamp":1}',)], "value string")
    assert [r.problem for r in events.directives(rows).collect()] == [None, "unknown type", "payload is no object"]


def test_messages_and_documents(spark):
    rows = spark.createDataFrame([("h", "a", 1)], "infoHash string, topic string, n int")
    m = events.messages(rows, "infoHash").first()
    assert (m.key, m.value, m.topic) == ("h", '{"infoHash":"h","n":1}', "a")
    back = events.imported(events.exported(rows), "infoHash string, topic string, n int")
    assert back.collect() == rows.collect()


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/cas"
    rows = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"b"),), (bytearray(b"a"),), (None,)], "data binary")
    content.put(rows, path)
    content.put(rows, path)
    got = content.get(spark, path).collect()
    assert len(got) == 2 and all(r.intact for r in got)


def test_pieces_and_ranges(spark):
    rows = spark.createDataFrame([(bytearray(b"abcdefg"),)], "data binary")
    got = content.pieces(rows, "data", 3).orderBy("piece").collect()
    assert [bytes(r.bytes) for r in got] == [b"abc", b"def", b"g"]
    parts = spark.createDataFrame([(0, 3, bytearray(b"abc")), (3, 7, bytearray(b"defg"))], "start long, end long, data binary")
    assert bytes(content.byte_range(parts, "data", 2, 5).first().data) == b"cde"
    blocks = spark.createDataFrame([("k", 3, bytearray(b"d"), 2), ("k", 0, bytearray(b"abc"), 1), ("k", 0, bytearray(b"xyz"), 9)], "key string, offset int, data binary, seq int")
    r = content.assembled(blocks, "key").first()
    assert bytes(r.data) == b"abcd" and r.sha1 == hashlib.sha1(b"abcd").hexdigest()
