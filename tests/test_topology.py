import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookframe.functions import binary
from brookframe.functions.exact import exact_cast, fixed_width, unsigned
from brookframe.operators import codecs
from brookframe.operators.groups import COUNT, MAX, MIN, SUM, Agg, group_by, windowed_group_by
from brookframe.operators.joins import windowed_join
from brookframe.operators.rows import Derived, select_columns
from brookframe.plans import cuts, roles, runs
from brookframe.plans.topology import Topology
from brookframe.sources import topics
from brookframe.streaming.epochs import GroupState, joined_stream, start, stream_topic, windowed_stream

SCHEMA = "user string, amount long, __key binary, __timestamp long, __partition int, __offset long, __headers binary, __batch long"


def rows(spark, *values):
    """(user, amount, timestamp, partition, offset, batch)"""
    return spark.createDataFrame([(u, a, None, t, p, o, None, b) for u, a, t, p, o, b in values], SCHEMA)


def basic(spark):
    return rows(spark, ("a", 5, 1, 0, 0, 0), ("a", 3, 2, 0, 1, 0), ("b", 9, 3, 0, 2, 0))


def test_validation(spark):
    t, other = Topology(), Topology()
    with pytest.raises(ValueError, match="no source"):
        t.run({})
    s = t.source("s", ["in"])
    with pytest.raises(ValueError, match="no sink"):
        t.run({})
    with pytest.raises(ValueError, match="already"):
        t.source("s", ["in"])
    with pytest.raises(ValueError, match="another topology"):
        other.sink("x", s, "out")
    with pytest.raises(ValueError, match="itself"):
        t.join("j", s, s, "user", "user", 1)
    with pytest.raises(ValueError, match="source"):
        t.pass_through("p", t.filter("f", s, F.lit(True)), "out")
    with pytest.raises(ValueError, match="two parents"):
        t.merge("m", s)
    with pytest.raises(ValueError, match="reserved"):
        Derived("__key", F.lit(1), T.LongType())
    assert t.source_topics() == ["in"]


def test_fan_out_and_undeclared_topic(spark):
    t = Topology()
    s = t.source("s", ["in"])
    kept = t.filter("f", s, F.col("amount") > 4)
    t.sink("x", kept, "x")
    t.sink("y", t.derive("d", kept, Derived("double", F.col("amount") * 2, T.LongType())), "y")
    out = t.run({"in": basic(spark), "else": basic(spark)})
    assert [r.amount for r in out["x"].orderBy("__offset").collect()] == [5, 9] and [r.double for r in out["y"].orderBy("__offset").collect()] == [10, 18]
    assert t.run({"else": basic(spark)}) == {}


def test_groups(spark):
    got = group_by(basic(spark), ["user"], [Agg(SUM, "amount", "total"), Agg(COUNT, "amount", "n")]).collect()
    assert {(r.user, r.total, r.n) for r in got} == {("a", 8, 2), ("b", 9, 1)}
    top = (1 << 63) - 1
    over = rows(spark, ("a", top, 1, 0, 0, 0), ("a", 1, 1, 0, 1, 0))
    with pytest.raises(Exception, match="OVERFLOW|overflow|out of range"):
        group_by(over, ["user"], [Agg(SUM, "amount", "t")]).collect()
    back = over.union(rows(spark, ("a", -1, 1, 0, 2, 0)))
    assert group_by(back, ["user"], [Agg(SUM, "amount", "t")]).first().t == top
    with pytest.raises(ValueError):
        group_by(over, [], [])
    with pytest.raises(ValueError):
        Agg("avg", "amount", "x")
    with pytest.raises(TypeError):
        group_by(over.withColumn("flag", F.lit(True)), ["user"], [Agg(SUM, "flag", "t")])


def test_windows_prune_by_stream_time(spark):
    df = rows(spark, ("a", 5, 1, 0, 0, 0), ("a", 3, 12, 0, 1, 0), ("a", 2, 2, 0, 2, 1), ("a", 1, 100, 0, 3, 2), ("a", 9, 3, 0, 4, 3))
    got = windowed_group_by(df, ["user"], 10, [Agg(COUNT, "amount", "n"), Agg(SUM, "amount", "total")], by_batch=True).collect()
    assert {(r["__batch"], r["__window_start"], r.n, r.total) for r in got} == {(0, 0, 1, 5), (0, 10, 1, 3), (1, 0, 2, 7), (1, 10, 1, 3), (2, 100, 1, 1), (3, 100, 1, 1)}
    with pytest.raises(ValueError):
        windowed_group_by(df, ["user"], 10, [], retention=5)
    with pytest.raises(Exception, match="no timestamp"):
        windowed_group_by(df.withColumn("__timestamp", F.lit(None).cast("long")), ["user"], 10, [Agg(COUNT, "amount", "n")]).collect()


def test_join_is_within_partition_and_window(spark):
    left, right = rows(spark, ("a", 5, 100, 0, 0, 0), ("a", 6, 100, 1, 0, 0)), rows(spark, ("a", 9, 105, 0, 0, 0), ("a", 8, 111, 1, 0, 0), (None, 7, 100, 0, 1, 0))
    got = windowed_join(left, right, "user", "user", 10).collect()
    assert [(r.left_user, r.left_amount, r.right_user, r.right_amount, r["__partition"]) for r in got] == [("a", 5, "a", 9, 0)]
    assert not windowed_join(left, right, "user", "amount", 10).collect()  # other families of types are never equal
    with pytest.raises(ValueError, match="prefixes"):
        windowed_join(left, right, "user", "user", 10, "x_", "x_")


def test_merge_needs_one_schema(spark):
    with pytest.raises(ValueError, match="differ"):
        topics.merge(basic(spark), basic(spark).withColumn("amount", F.col("amount").cast("int")))
    with pytest.raises(ValueError, match="no column"):
        select_columns(basic(spark), "nothing")


def test_exact_casts(spark):
    df = spark.createDataFrame([(1.5, "12", 300, b"abc")], "x double, s string, i int, b binary")
    assert df.select(exact_cast(F.col("s"), T.StringType(), T.LongType()).alias("v")).first().v == 12
    for bad in (exact_cast(F.col("x"), T.DoubleType(), T.LongType()), exact_cast(F.col("i"), T.IntegerType(), T.ByteType()), exact_cast(F.col("x"), T.DoubleType(), T.DecimalType(5, 0)), unsigned(F.col("i"), 8), fixed_width(F.col("b"), 4)):
        with pytest.raises(Exception):
            df.select(bad.alias("v")).collect()
    assert df.select(exact_cast(F.lit("18446744073709551615"), T.StringType(), T.DecimalType(20, 0)).alias("v")).first().v == 18446744073709551615


def test_binary_layouts(spark):
    df = spark.createDataFrame([([("trace", b"x"), ("trace", None)],), ([],)], "h array<struct<key:string,value:binary>>")
    packed = [r.p for r in df.select(binary.pack_headers(F.col("h")).alias("p")).collect()]
    assert packed[0] == bytes.fromhex("00000002") + b"\0\0\0\5trace\0\0\0\1x\0\0\0\5trace\xff\xff\xff\xff" and packed[1] == bytes(4)
    # fixed values: murmur2 of known keys, dealt over 16 partitions
    keys = spark.createDataFrame([(b"controller", 12), (b"dispatcher", 10), (b"role-a", 10), (b"role-b", 12)], "k binary, want int")
    assert all(r.got == r.want for r in keys.select("want", binary.key_partition(F.col("k"), 16).alias("got")).collect())
    with pytest.raises(Exception, match="framed"):
        keys.select(binary.schema_id(F.col("k"))).collect()


def test_blobs_split_at_the_cap(spark):
    df = rows(spark, *((f"user-{i:02}-" + "x" * 20, i, 5, 0, i, 0) for i in range(64)))
    packed = codecs.blob_encode(df, 1500).collect()
    assert sum(r.n_rows for r in packed) == 64 and all(len(r.value) <= 1500 for r in packed) and len(packed) > 1
    with pytest.raises(Exception, match="one row takes"):
        codecs.blob_encode(df, 100).collect()


def test_gzip_ceiling_and_json(spark):
    df = spark.createDataFrame([(b"hello" * 10, 1), (None, 2)], "value binary, k int")
    assert [r.value for r in codecs.gunzip_values(codecs.gzip_values(df)).orderBy("k").collect()] == [b"hello" * 10, None]
    with pytest.raises(Exception, match="over 4 bytes"):
        codecs.gunzip_values(codecs.gzip_values(df), 4).collect()
    js = spark.createDataFrame([(b'{"id":"a","tags":["new", "paid"]}',), (b'{"id":null}',)], "value binary")
    schema = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("tags", T.ArrayType(T.StringType()))])
    whole = spark.createDataFrame([(b'{"id":"a","tags":["new", "paid"]}',)], "value binary")
    assert codecs.json_decode(whole, schema).first().tags == '["new","paid"]'
    with pytest.raises(Exception, match="required"):
        codecs.json_decode(js, schema).collect()
    assert codecs.pinned_schema(whole).fieldNames() == ["id", "tags"]


def test_failures(spark):
    df = rows(spark, ("a", 1, 1, 0, 0, 0), ("bad", 2, 1, 0, 1, 0), ("c", 3, 1, 1, 0, 0), ("d", 4, 1, 0, 2, 1))
    good, lost = runs.split_failures(df, F.col("user") == "bad", runs.DEAD_LETTER)
    assert {r.user for r in good.collect()} == {"c", "d"} and {r.user for r in lost.collect()} == {"a", "bad"}
    assert not runs.split_failures(df, F.col("user") == "bad", runs.SKIP)[1].collect()
    with pytest.raises(Exception, match="a record failed"):
        runs.split_failures(df, F.col("user") == "bad")[0].collect()


def test_roles_without_and_with_a_lease(spark):
    kind = "role string, kind int, member string, record_offset long, tombstone boolean, registered_at long, deadline long, producer_id long, producer_epoch smallint"
    members = [("r", 0, f"node-{i}", 10 * i, False, 1000 * i, None, i, 0) for i in (1, 2, 3)]
    free = {r.member: r for r in roles.decisions(spark.createDataFrame(members, kind), 5000).collect()}
    assert (free["node-1"].action, free["node-2"].action, free["node-2"].until, free["node-3"].until) == ("challenge", "wait", 7000, 13000)
    held = spark.createDataFrame([*members, ("r", 1, "node-1", 40, False, None, 30000, 1, 0)], kind)
    at = {r.member: (r.action, r.until) for r in roles.decisions(held, 0).collect()}
    assert at == {"node-1": ("hold", None), "node-2": ("wait", 30000), "node-3": ("wait", 35000)}


def test_cut(spark):
    cut = spark.createDataFrame([(5, "in", 0, 2), (5, "in", 1, 1)], "epoch long, topic string, partition int, cut_offset long")
    df = rows(spark, *(("a", 1, 1, 0, o, 0) for o in range(4)))
    early, held = cuts.align(df, cut)
    assert sorted(r["__offset"] for r in early.collect()) == [0, 1] and sorted(r["__offset"] for r in held.collect()) == [2, 3]
    idle = spark.createDataFrame([(1, 0)], "__partition int, position long")
    assert not cuts.fired(df, cut, idle).first().fired and cuts.fired(df, cut, idle.withColumn("position", F.lit(1).cast("long"))).first().fired


def test_streams(spark, tmp_path):
    one, two = rows(spark, ("a", 5, 1, 0, 0, 0), ("a", 3, 12, 0, 1, 0)), rows(spark, ("a", 2, 2, 0, 2, 1), ("b", 7, 100, 1, 0, 1))
    for i, df in enumerate((one, two)):
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = stream_topic(spark, f"{tmp_path}/in", one.schema)
    query = start(stream, {"all": (lambda b: b, f"{tmp_path}/all"), "large": (lambda b: b.filter("amount > 4"), f"{tmp_path}/large")}, f"{tmp_path}/ck")
    query.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/all").count() == 4 and spark.read.parquet(f"{tmp_path}/large").count() == 2
    state = GroupState(f"{tmp_path}/state", ["user"], [Agg(SUM, "amount", "total"), Agg(MIN, "amount", "low")], 10)
    state.advance(one, 0, None)
    out = state.advance(two, 1, 0).collect()
    assert {(r.user, r["__window_start"], r.total, r.low) for r in out} == {("a", 0, 7, 2), ("a", 10, 3, 3), ("b", 100, 7, 7)}
    again = state.advance(rows(spark, ("a", 1, 100, 0, 3, 2)), 2, 1).collect()
    assert {(r.user, r["__window_start"]) for r in again} == {("a", 100), ("b", 100)}
    counts = windowed_stream(stream, ["user"], 10, [Agg(COUNT, "amount", "n"), Agg(MAX, "amount", "high")], 1000)
    query = counts.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.user, r["__window_start"], r.n) for r in spark.table("windows").collect()} == {("a", 0, 2), ("a", 10, 1), ("b", 100, 1)}
    joined = joined_stream(stream, stream_topic(spark, f"{tmp_path}/in", one.schema), "user", "user", 10)
    query = joined.writeStream.format("memory").queryName("pairs").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert (5, 2) in {(r.left_amount, r.right_amount) for r in spark.table("pairs").collect()}


def test_avro_schemas(spark):
    import io
    import json

    from brookframe.operators.avro_rows import avro_decode, reader, spark_type, write

    schema = json.loads("""{"type":"record","name":"n","fields":[{"name":"tags","type":{"type":"array","items":"string"}},{"name":"labels","type":{"type":"map","values":"long"}},
      {"name":"color","type":{"type":"enum","name":"c","symbols":["RED","BLUE"]}},{"name":"sum","type":{"type":"fixed","name":"f","size":2}},{"name":"flag","type":"boolean"},{"name":"low","type":["null","int"]}]}""")
    value = {"tags": ["a", "b"], "labels": [("x", -(1 << 60))], "color": "BLUE", "sum": b"ab", "flag": True, "low": -3}
    out = io.BytesIO()
    write(schema, value, out)
    assert reader(schema)(io.BytesIO(out.getvalue())) == value
    assert spark_type(schema).simpleString() == "struct<tags:array<string>,labels:map<string,bigint>,color:string,sum:binary,flag:boolean,low:int>"
    with pytest.raises(ValueError, match="can't be read"):
        reader("long", "string")
    with pytest.raises(Exception, match="not known"):
        avro_decode(spark.createDataFrame([(b"\0\0\0\0\1x",)], "value binary"), '{"type":"record","name":"r","fields":[]}', {}).collect()


def test_avro_compatibility():
    from brookframe.operators.avro_rows import compatible

    def record(*fields):
        return '{"type":"record","name":"r","fields":[' + ",".join(fields) + "]}"

    a, wide, text = ('{"name":"a","type":"%s"}' % t for t in ("int", "long", "string"))
    note = '{"name":"note","type":["null","string"],"default":null}'
    assert compatible(record(a, note), record(a), "full")
    assert compatible(record(wide), record(a)) and not compatible(record(wide), record(a), "forward")
    assert not compatible(record(text), record(wide), "backward")
    with pytest.raises(ValueError, match="mode"):
        compatible(record(a), record(a), "sideways")


def test_processors(spark, tmp_path):
    import pandas as pd

    from brookframe.streaming.stateful import process_by_partition

    def twice(batches):
        for b in batches:
            yield b
            yield b

    t = Topology()
    t.sink("out", t.process("twice", t.source("s", ["in"]), twice, SCHEMA), "out")
    assert t.run({"in": basic(spark)})["out"].count() == 6
    for i in range(2):
        rows(spark, ("a", 5 + i, 1, 0, i, i), ("a", 1, 1, 1, i, i)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = stream_topic(spark, f"{tmp_path}/in", basic(spark).schema)

    def total(state, batch):
        now = (state[0] if state else 0) + int(batch.amount.sum())
        return (now,), pd.DataFrame({"p": [int(batch["__partition"].iloc[0])], "total": [now]})

    query = process_by_partition(stream, total, "p int, total long", "total long").writeStream.format("memory").queryName("totals").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    best = {}
    for r in spark.table("totals").collect():
        best[r.p] = max(best.get(r.p, 0), r.total)
    assert best == {0: 11, 1: 2}


def test_headers_unpack_and_malformed_ones_raise(spark):
    def read(data):
        return spark.createDataFrame([(bytearray(data) if data is not None else None,)], "h binary").select(binary.unpack_headers(F.col("h")).alias("h")).first().h

    assert read(None) is None and read(b"\0\0\0\0") == []
    two = b"\0\0\0\2" + b"\0\0\0\1a" + b"\0\0\0\2xy" + b"\0\0\0\0" + b"\xff\xff\xff\xff"
    assert [(x.key, None if x.value is None else bytes(x.value)) for x in read(two)] == [("a", b"xy"), ("", None)]
    for bad in (b"", b"\0\0\0", b"\0\0\0\1", two[:-1], two + b"z", b"\xff\xff\xff\xff", b"\0\0\0\1\0\0\0\1a\xff\xff\xff\xfe", b"\0\0\0\1\xff\xff\xff\xff\0\0\0\0"):
        with pytest.raises(Exception, match="not packed headers"):
            read(bad)


def test_a_run_of_one_partition_rejects_others(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1)], "x int, p int")
    t = Topology()
    t.sink("out", t.source("s", ["a"]), "b")
    topic = topics.as_topic(rows, timestamp_ms=F.lit(0), partition=F.col("p"), offset=F.col("x"))
    assert t.run({"a": topic.filter("__partition = 1")}, partition=1)["out"].count() == 1
    with pytest.raises(Exception, match="not of partition 1"):
        t.run({"a": topic}, partition=1)["out"].collect()


def test_scalar_json_values(spark):
    schema = T.StructType([T.StructField("value", T.StringType())])
    df = spark.createDataFrame([(1, '"a b"'), (2, "[1,2]"), (3, '{"value":"c"}'), (4, "null")], "i int, value string")
    assert [r.value for r in codecs.json_decode(df, schema).orderBy("i").collect()] == ["a b", "[1,2]", "c", None]
    assert sorted(r.value for r in codecs.json_encode(spark.createDataFrame([("x",), (None,)], "value string")).collect()) == ['"x"', "null"]


def test_a_long_key_hashes_as_alone(spark):
    keys = [b"a", b"x" * 100_000, b"", b"21", b"foobar"]
    df = spark.createDataFrame([(i, bytearray(k)) for i, k in enumerate(keys)], "i int, k binary").coalesce(1)
    got = {r.i: r.p for r in df.select("i", binary.key_partition(F.col("k"), 1 << 30).alias("p")).collect()}
    alone = {i: df.filter(F.col("i") == i).select(binary.key_partition(F.col("k"), 1 << 30).alias("p")).first().p for i in got}
    assert got == alone


def test_cut_records_are_read_by_their_layout(spark):
    """The bytes are fixed values of the wire format."""
    key = bytes.fromhex("00000002000a6f72646572732d6375740000000000000007")
    value = bytes.fromhex("0000000001918435bd00000001918435bd2a000000000100066f72646572730000000200000000000000000000040000000001000000000000080000000000")

    def read(k, v):
        row = spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v))], "k binary, v binary")
        return row.select(cuts.decode_cut(F.col("k"), F.col("v")).alias("c")).first().c

    c = read(key, value)
    assert (c.grp, c.epoch, c.triggered, c.completed, c.status, c.missing) == ("orders-cut", 7, 1724500000000, 1724500000042, 0, [])
    assert [tuple(o) for o in c.offsets] == [("orders", 0, 1024), ("orders", 1, 2048)]
    missing = value[:-4] + bytes.fromhex("00000001" "0001" "61" "00000003")
    assert [tuple(m) for m in read(key, missing).missing] == [("a", 3)]
    assert read(key, None) is None and read(key, b"") is None and read(key[:3] + b"\1" + key[4:], value) is None
    for k, v in ((key[:-1], value), (key + b"x", value), (b"\0\1" + key[2:], value), (key, value[:-1]), (key, value + b"x"), (key, value[:10]), (key, b"\0\1" + value[2:]), (key, value[:18] + b"\5" + value[19:]), (key, value[:19] + b"\x7f\xff\xff\xff" + value[23:])):
        with pytest.raises(Exception, match="not the (key|value)"):
            read(k, v)


def test_blobs_take_as_many_rows_as_fit(spark):
    """The longest prefix each time, also where rows differ much in size."""
    rows = [(i, "x" * ((i * 37) % 90), 0, 0, i, 0) for i in range(200)]
    df = spark.createDataFrame(rows, "n long, t string, __partition int, __timestamp long, __offset long, __batch long").withColumns({"__key": F.lit(b"k"), "__headers": F.lit(None).cast("binary")})
    schema = df.select("n", "t").schema
    for cap in (700, 1500, 100_000):
        got = [r.n_rows for r in codecs.blob_encode(df, cap).collect()]
        want, at = [], 0
        while at < len(rows):
            n = max(k for k in range(1, len(rows) - at + 1) if codecs.stream_bytes(schema, [r[:2] for r in rows[at : at + k]]) <= cap)
            want.append(n)
            at += n
        assert got == want
    with pytest.raises(Exception, match="one row takes"):
        codecs.blob_encode(df, 100).collect()
