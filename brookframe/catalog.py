"""Queries over the given tables, one for each behaviour of the engine, and the SQL that each equals."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookframe.functions import binary
from brookframe.functions.exact import exact_cast, floor_to, unsigned
from brookframe.functions.tagged import tagged
from brookframe.operators import attempts, codecs, groups, process
from brookframe.operators.groups import COUNT, MAX, MIN, SUM, Agg, first_appearance, group_by, windowed_group_by
from brookframe.operators.joins import windowed_join
from brookframe.operators.json_schema import columns_of
from brookframe.operators.rows import Derived, filter_rows, select_columns, with_derived
from brookframe.plans import cuts, polls, roles, runs
from brookframe.plans.topology import Topology
from brookframe.sources import topics
from brookframe.sources.topic_log import append_log, read_log, stream_log
from brookframe.streaming.folders import arrived, shared_folder
from brookframe.streaming.stream_time import grouped_by_stream_time, joined_by_stream_time, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

HOUR, DAY = 3_600_000, 86_400_000
NOW = 1_705_000_000_000
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
TOPIC = """WITH topic AS (
  SELECT event_id, user_id, event_type, value, props, CAST(user_id AS VARCHAR) AS key_text, epoch_us(ts) // 1000 AS __timestamp,
    CAST(user_id % 4 AS INTEGER) AS __partition, event_id AS __offset, event_id // 2500 AS __batch FROM events)
"""


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a topic: dealt by user, in polls of 2,500 events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    payload = events.select("event_id", "user_id", "event_type", "value", "props", F.expr(MICROS).alias("us"))
    rows = topics.as_topic(
        payload, key=F.encode(F.col("user_id").cast("string"), "UTF-8"), timestamp_ms=F.floor(F.col("us") / 1000), partition=F.col("user_id") % 4, offset=F.col("event_id"), batch=F.expr("event_id div 2500")
    )
    return rows.drop("us")


def _key_text(df: DataFrame) -> DataFrame:
    return df.withColumn("key_text", F.decode("__key", "UTF-8")).drop("__key", "__headers")


META = "__timestamp, __partition, __offset, __batch"


@query(TOPIC + f"SELECT event_id, user_id, event_type, value, props, key_text, {META} FROM topic")
def topic_metadata(spark, d):
    return _key_text(topic(spark, d))


@query(TOPIC + "SELECT event_id, value, __partition FROM topic WHERE value > 100")
def filter_value(spark, d):
    return filter_rows(topic(spark, d), F.col("value") > 100).select("event_id", "value", "__partition")


@query(TOPIC + "SELECT event_id, __partition FROM topic WHERE __partition = 1")
def filter_partition(spark, d):
    return filter_rows(topic(spark, d), F.col("__partition") == 1).select("event_id", "__partition")


@query(TOPIC + "SELECT event_id, __offset FROM topic WHERE __offset >= 100 AND __offset < 700 AND event_type = 'click'")
def filter_offset_range(spark, d):
    return filter_rows(topic(spark, d), (F.col("__offset") >= 100) & (F.col("__offset") < 700) & (F.col("event_type") == "click")).select("event_id", "__offset")


@query(TOPIC + "SELECT event_id FROM topic WHERE nullif(event_type, 'error') <> 'click'")
def filter_null_predicate(spark, d):
    return filter_rows(topic(spark, d), F.nullif("event_type", F.lit("error")) != "click").select("event_id")


@query(TOPIC + f"SELECT value, event_type, key_text, {META} FROM topic")
def select_keeps_metadata(spark, d):
    return _key_text(select_columns(topic(spark, d), "value", "event_type"))


@query(TOPIC + f"SELECT event_type, value, key_text, {META} FROM topic")
def select_dedup(spark, d):
    return _key_text(select_columns(topic(spark, d), "event_type", "value", "event_type"))


@query(TOPIC + "SELECT event_id, __partition, event_id * 2 AS twice, upper(event_type) AS shouted FROM topic")
def derive_append(spark, d):
    out = with_derived(topic(spark, d), Derived("twice", F.col("event_id") * 2, T.LongType()), Derived("shouted", F.upper("event_type"), T.StringType()))
    assert out.columns[-2:] == ["twice", "shouted"]
    return out.select("event_id", "__partition", "twice", "shouted")


@query(TOPIC + "SELECT event_id, user_id + 1 AS user_id, event_type FROM topic")
def derive_replace(spark, d):
    out = with_derived(topic(spark, d), Derived("user_id", F.col("user_id") + 1, T.LongType()))
    return out.select("event_id", "user_id", "event_type")


@query(TOPIC + "SELECT event_id * 2 AS event_id, event_id + 1 AS next_id FROM topic")
def derive_reads_input(spark, d):
    out = with_derived(topic(spark, d), Derived("event_id", F.col("event_id") * 3, T.LongType()), Derived("next_id", F.col("event_id") + 1, T.LongType()), Derived("event_id", F.col("event_id") * 2, T.LongType()))
    return out.select("event_id", "next_id")


@query(TOPIC + "SELECT event_id, CAST(user_id AS INTEGER) AS user_int, CAST(value AS DECIMAL(18,2)) AS price, CAST(event_id AS VARCHAR) AS id_text FROM topic")
def derive_coerce(spark, d):
    price = F.col("value").cast("decimal(18,2)")
    out = with_derived(topic(spark, d), Derived("user_int", F.col("user_id"), T.IntegerType()), Derived("price", price, T.DecimalType(18, 2)), Derived("id_text", F.col("event_id"), T.StringType()))
    return out.select("event_id", "user_int", "price", "id_text")


@query(TOPIC + "SELECT event_type, CAST(sum(event_id) AS BIGINT) AS total, count(*) AS n FROM topic GROUP BY __partition, event_type")
def group_sum_count(spark, d):
    return group_by(topic(spark, d), ["event_type"], [Agg(SUM, "event_id", "total"), Agg(COUNT, "event_id", "n")])


@query(TOPIC + "SELECT event_type, min(value) AS low, max(value) AS high FROM topic GROUP BY __partition, event_type")
def group_min_max(spark, d):
    return group_by(topic(spark, d), ["event_type"], [Agg(MIN, "value", "low"), Agg(MAX, "value", "high")])


@query(TOPIC + "SELECT user_id, min(event_type) AS first_type, max(props) AS last_props FROM topic GROUP BY __partition, user_id")
def group_min_max_text(spark, d):
    return group_by(topic(spark, d), ["user_id"], [Agg(MIN, "event_type", "first_type"), Agg(MAX, "props", "last_props")])


@query(TOPIC + "SELECT nullif(event_type, 'view') AS kind, count(*) AS n FROM topic GROUP BY __partition, nullif(event_type, 'view')")
def group_null_key(spark, d):
    return group_by(topic(spark, d).withColumn("kind", F.nullif("event_type", F.lit("view"))), ["kind"], [Agg(COUNT, "event_id", "n")])


@query(TOPIC + "SELECT user_id, event_type, count(*) AS n, max(event_id) AS last_id FROM topic GROUP BY __partition, user_id, event_type")
def group_multi_key(spark, d):
    return group_by(topic(spark, d), ["user_id", "event_type"], [Agg(COUNT, "value", "n"), Agg(MAX, "event_id", "last_id")])


@query(TOPIC + "SELECT __partition, count(*) AS n FROM topic GROUP BY __partition")
def group_by_metadata(spark, d):
    return group_by(topic(spark, d), ["__partition"], [Agg(COUNT, "event_id", "n")])


@query(TOPIC + "SELECT event_type, CAST(sum(CASE WHEN event_id % 2 = 0 THEN 9223372036854775000 - event_id ELSE -9223372036854775000 + event_id END::HUGEINT) % 1000 AS BIGINT) AS rest FROM topic GROUP BY __partition, event_type")
def sum_exact_long(spark, d):
    """Partial sums leave the range of long; the sum stays exact."""
    big = F.when(F.col("event_id") % 2 == 0, F.lit(9223372036854775000) - F.col("event_id")).otherwise(F.lit(-9223372036854775000) + F.col("event_id"))
    grouped = group_by(topic(spark, d).withColumn("big", big), ["event_type"], [Agg(SUM, "big", "total", T.DecimalType(38, 0))])
    return grouped.select("event_type", (F.col("total") % 1000).cast("long").alias("rest"))


@query("SELECT p_brand, CAST(sum(p_size) AS INTEGER) AS total FROM part GROUP BY p_partkey % 4, p_brand")
def sum_narrow_int(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    rows = topics.as_topic(part, timestamp_ms=F.lit(0), partition=F.col("p_partkey") % 4, offset=F.col("p_partkey"))
    return group_by(rows, ["p_brand"], [Agg(SUM, "p_size", "total")])


@query(TOPIC + "SELECT event_type, round(sum(value), 2) AS total FROM topic GROUP BY __partition, event_type")
def sum_double(spark, d):
    return group_by(topic(spark, d), ["event_type"], [Agg(SUM, "value", "total")]).withColumn("total", F.round("total", 2))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.col("l_extendedprice").cast("decimal(15,2)").alias("price"))
    return topics.as_topic(lines, timestamp_ms=F.lit(0), partition=F.col("l_orderkey") % 4, offset=F.col("l_orderkey"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(15,2)) AS total FROM lineitem GROUP BY l_orderkey % 4, l_returnflag, l_linestatus")
def sum_decimal(spark, d):
    return group_by(_lines(spark, d), ["l_returnflag", "l_linestatus"], [Agg(SUM, "price", "total")])


@query(TOPIC + "SELECT user_id, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors FROM topic GROUP BY __partition, user_id")
def sum_bool_override(spark, d):
    return group_by(topic(spark, d).withColumn("bad", F.col("event_type") == "error"), ["user_id"], [Agg(SUM, "bad", "errors", T.LongType())])


@query(TOPIC + "SELECT event_type, CAST(sum(user_id) AS VARCHAR) AS total FROM topic GROUP BY __partition, event_type")
def sum_text_digits(spark, d):
    return group_by(topic(spark, d).withColumn("digits", F.col("user_id").cast("string")), ["event_type"], [Agg(SUM, "digits", "total")])


@query(TOPIC + "SELECT event_type, count(*) AS n, CAST(sum(nullif(user_id % 3, 0)) AS BIGINT) AS total FROM topic GROUP BY __partition, event_type")
def count_counts_nulls(spark, d):
    rows = topic(spark, d).withColumn("x", F.nullif(F.col("user_id") % 3, F.lit(0)))
    return group_by(rows, ["event_type"], [Agg(COUNT, "x", "n"), Agg(SUM, "x", "total")])


@query(TOPIC + "SELECT event_type, sum(CASE WHEN event_type = 'click' THEN event_id END)::BIGINT AS total, min(CASE WHEN event_type = 'click' THEN event_id END) AS low, max(CASE WHEN event_type = 'click' THEN event_id END) AS high FROM topic GROUP BY __partition, event_type")
def agg_all_null(spark, d):
    rows = topic(spark, d).withColumn("x", F.when(F.col("event_type") == "click", F.col("event_id")))
    return group_by(rows, ["event_type"], [Agg(SUM, "x", "total"), Agg(MIN, "x", "low"), Agg(MAX, "x", "high")])


@query(TOPIC + "SELECT event_type, CAST(sum(user_id) AS DOUBLE) AS total, CAST(count(*) AS INTEGER) AS n, CAST(max(user_id) AS VARCHAR) AS high FROM topic GROUP BY __partition, event_type")
def agg_output_type(spark, d):
    return group_by(topic(spark, d), ["event_type"], [Agg(SUM, "user_id", "total", T.DoubleType()), Agg(COUNT, "user_id", "n", T.IntegerType()), Agg(MAX, "user_id", "high", T.StringType())])


@query(TOPIC + "SELECT event_type, __partition, count(*) AS n FROM topic GROUP BY __partition, event_type")
def group_partition_isolated(spark, d):
    return group_by(topic(spark, d), ["event_type", "__partition"], [Agg(COUNT, "event_id", "n")])


@query(TOPIC + """, clock AS (SELECT DISTINCT __partition, __batch FROM topic)
SELECT c.__batch, event_type, c.__partition, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total, max(value) AS high
FROM clock c JOIN topic t ON t.__partition = c.__partition AND t.__batch <= c.__batch GROUP BY c.__batch, c.__partition, event_type""")
def group_cumulative_by_batch(spark, d):
    return group_by(topic(spark, d), ["event_type", "__partition"], [Agg(COUNT, "event_id", "n"), Agg(SUM, "event_id", "total"), Agg(MAX, "value", "high")], by_batch=True)


ST = TOPIC + """, each AS (SELECT __partition, __batch, max(__timestamp) AS t FROM topic GROUP BY ALL),
clock AS (SELECT __partition, __batch, max(t) OVER (PARTITION BY __partition ORDER BY __batch) AS st FROM each)
"""


@query(TOPIC + f""", w AS (SELECT *, CAST(floor(__timestamp / {HOUR}.0) AS BIGINT) * {HOUR} AS s FROM topic)
SELECT event_type, s AS __window_start, s + {HOUR} AS __window_end, count(*) AS n, max(value) AS high FROM w GROUP BY __partition, event_type, s""")
def window_tumbling(spark, d):
    return windowed_group_by(topic(spark, d), ["event_type"], HOUR, [Agg(COUNT, "event_id", "n"), Agg(MAX, "value", "high")], retention=10_000 * DAY)


@query(TOPIC + f""", moved AS (SELECT *, __timestamp - 1705000000123 AS t FROM topic), w AS (SELECT *, CAST(floor(t / {DAY}.0) AS BIGINT) * {DAY} AS s FROM moved)
SELECT event_type, s AS __window_start, s + {DAY} AS __window_end, count(*) AS n FROM w GROUP BY __partition, event_type, s""")
def window_negative_time(spark, d):
    rows = topic(spark, d).withColumn("__timestamp", F.col("__timestamp") - 1705000000123)
    return windowed_group_by(rows, ["event_type"], DAY, [Agg(COUNT, "event_id", "n")], retention=10_000 * DAY)


@query(TOPIC + f""", w AS (SELECT *, CAST(floor(__timestamp / {DAY}.0) AS BIGINT) * {DAY} AS s, max(__timestamp) OVER (PARTITION BY __partition) AS st FROM topic)
SELECT event_type, s AS __window_start, s + {DAY} AS __window_end, count(*) AS n FROM w WHERE s + {DAY} >= st - {2 * DAY} GROUP BY __partition, event_type, s""")
def window_retention_one_batch(spark, d):
    return windowed_group_by(topic(spark, d), ["event_type"], DAY, [Agg(COUNT, "event_id", "n")], retention=2 * DAY)


@query(ST + f""", w AS (SELECT t.*, CAST(floor(__timestamp / {DAY}.0) AS BIGINT) * {DAY} AS s, st FROM topic t JOIN clock USING (__partition, __batch))
SELECT c.__batch, event_type, s AS __window_start, s + {DAY} AS __window_end, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total
FROM w JOIN clock c ON c.__partition = w.__partition AND c.__batch >= w.__batch
WHERE s + {DAY} >= w.st - {2 * DAY} AND s + {DAY} >= c.st - {2 * DAY} GROUP BY c.__batch, c.__partition, event_type, s""")
def window_retention_by_batch(spark, d):
    return windowed_group_by(topic(spark, d), ["event_type"], DAY, [Agg(COUNT, "event_id", "n"), Agg(SUM, "event_id", "total")], retention=2 * DAY, by_batch=True)


LATE = f"__timestamp - CASE WHEN event_id % 10 = 0 THEN {5 * DAY} ELSE 0 END"


@query(ST.replace("epoch_us(ts) // 1000", f"epoch_us(ts) // 1000 - CASE WHEN event_id % 10 = 0 THEN {5 * DAY} ELSE 0 END") + f""", w AS (SELECT t.*, CAST(floor(__timestamp / {DAY}.0) AS BIGINT) * {DAY} AS s, st FROM topic t JOIN clock USING (__partition, __batch))
SELECT c.__batch, user_id, s AS __window_start, s + {DAY} AS __window_end, count(*) AS n
FROM w JOIN clock c ON c.__partition = w.__partition AND c.__batch >= w.__batch
WHERE s + {DAY} >= w.st - {DAY} AND s + {DAY} >= c.st - {DAY} GROUP BY c.__batch, c.__partition, user_id, s""")
def window_late_dropped(spark, d):
    rows = topic(spark, d).withColumn("__timestamp", F.expr(LATE))
    return windowed_group_by(rows, ["user_id"], DAY, [Agg(COUNT, "event_id", "n")], by_batch=True)


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = select_columns(topic(spark, d), "event_id", "user_id", "value")
    kind = topic(spark, d)
    return (select_columns(filter_rows(kind, F.col("event_type") == k), *rows.columns[:3]) for k in ("click", "purchase"))


JOIN = TOPIC + """, l AS (SELECT * FROM topic WHERE event_type = 'click'), r AS (SELECT * FROM topic WHERE event_type = 'purchase')
"""


@query(JOIN + f"SELECT l.event_id AS left_event_id, r.event_id AS right_event_id, l.user_id AS left_user_id FROM l JOIN r ON l.user_id = r.user_id AND l.__partition = r.__partition AND abs(l.__timestamp - r.__timestamp) <= {6 * HOUR}")
def join_window(spark, d):
    return windowed_join(*_sides(spark, d), "user_id", "user_id", 6 * HOUR).select("left_event_id", "right_event_id", "left_user_id")


@query(JOIN + f"SELECT l.event_id AS left_event_id, r.event_id AS right_event_id FROM l JOIN r ON l.user_id = r.user_id AND l.__partition = r.__partition AND l.__timestamp // {DAY} = r.__timestamp // {DAY}")
def join_zero_window(spark, d):
    left, right = (x.withColumn("__timestamp", floor_to(F.col("__timestamp"), DAY)) for x in _sides(spark, d))
    return windowed_join(left, right, "user_id", "user_id", 0).select("left_event_id", "right_event_id")


@query(JOIN + f"SELECT l.event_id AS left_event_id, r.event_id AS right_event_id FROM l JOIN r ON nullif(l.user_id % 10, 3) = nullif(r.user_id % 10, 3) AND l.__partition = r.__partition AND abs(l.__timestamp - r.__timestamp) <= {HOUR}")
def join_null_keys(spark, d):
    left, right = (x.withColumn("user_id", F.nullif(F.col("user_id") % 10, F.lit(3))) for x in _sides(spark, d))
    return windowed_join(left, right, "user_id", "user_id", HOUR).select("left_event_id", "right_event_id")


@query(JOIN + f"SELECT l.event_id AS left_event_id, r.event_id AS right_event_id FROM l JOIN r ON l.user_id = r.user_id AND l.__partition = r.__partition AND abs(l.__timestamp - r.__timestamp) <= {HOUR}")
def join_key_family(spark, d):
    """Integers of different widths are one family of keys."""
    left, right = _sides(spark, d)
    return windowed_join(left.withColumn("user_id", F.col("user_id").cast("int")), right, "user_id", "user_id", HOUR).select("left_event_id", "right_event_id")


@query(JOIN + "SELECT count(*) AS n FROM l WHERE false")
def join_other_family(spark, d):
    """An integer never equals a text or a decimal, even if they look alike."""
    left, right = _sides(spark, d)
    return windowed_join(left, right.withColumn("user_id", F.col("user_id").cast("decimal(20,0)")), "user_id", "user_id", DAY).agg(F.count("*").alias("n"))


@query(JOIN + "SELECT l.event_id AS left_event_id, r.event_id AS right_event_id FROM l JOIN r ON l.event_id // 40 = r.event_id // 40 AND l.__partition = r.__partition AND l.event_id % 2 = r.event_id % 2")
def join_farthest_times(spark, d):
    """Times at both ends of a long: their difference doesn't overflow into a match."""
    ends = F.when(F.col("event_id") % 2 == 0, F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
    left, right = (x.withColumns({"__timestamp": ends, "user_id": F.expr("event_id div 40")}) for x in _sides(spark, d))
    return windowed_join(left, right, "user_id", "user_id", HOUR).select("left_event_id", "right_event_id")


@query(JOIN + f"SELECT l.event_id AS \"left___offset\", r.event_id AS \"right___offset\", l.__timestamp, l.__partition FROM l JOIN r ON l.user_id = r.user_id AND l.__partition = r.__partition AND abs(l.__timestamp - r.__timestamp) <= {HOUR}")
def join_escaped_names(spark, d):
    """Payload columns named like metadata get their own names back before the prefix."""
    sides = []
    for kind in ("click", "purchase"):
        rows = filter_rows(topic(spark, d), F.col("event_type") == kind)
        payload = rows.select(F.col("event_id").alias("__offset"), "user_id", F.col("event_id").alias("at"), F.col("__timestamp").alias("time"), F.col("__partition").alias("part"))
        named = topics.as_topic(payload, timestamp_ms=F.col("time"), partition=F.col("part"), offset=F.col("at"))
        sides.append(select_columns(named, topics.payload_column("__offset"), "user_id"))
    return windowed_join(*sides, "user_id", "user_id", HOUR).select("left___offset", "right___offset", "__timestamp", "__partition")


@query(JOIN + f"SELECT l.event_id AS a_event_id, l.value AS a_value, r.event_id AS b_event_id, r.value AS b_value, l.__timestamp, l.__partition, l.__offset FROM l JOIN r ON l.user_id = r.user_id AND l.__partition = r.__partition AND abs(l.__timestamp - r.__timestamp) <= {DAY}")
def join_prefixes_left_metadata(spark, d):
    return windowed_join(*_sides(spark, d), "user_id", "user_id", DAY, "a_", "b_").drop("a_user_id", "b_user_id", "__key", "__headers")


@query(JOIN + f""", sides AS (SELECT * FROM l UNION ALL SELECT * FROM r), each AS (SELECT __partition, __batch, max(__timestamp) AS t FROM sides GROUP BY ALL),
clock AS (SELECT __partition, __batch, max(t) OVER (PARTITION BY __partition ORDER BY __batch) AS st FROM each),
lmax AS (SELECT __partition, __batch, max(__timestamp) AS t FROM l GROUP BY ALL), rmax AS (SELECT __partition, __batch, max(__timestamp) AS t FROM r GROUP BY ALL)
SELECT l.event_id AS left_event_id, r.event_id AS right_event_id, greatest(l.__batch, r.__batch) AS __batch
FROM l JOIN r ON l.user_id = r.user_id AND l.__partition = r.__partition AND abs(l.__timestamp - r.__timestamp) <= {DAY}
JOIN clock c ON c.__partition = l.__partition AND c.__batch = greatest(l.__batch, r.__batch)
LEFT JOIN lmax ON lmax.__partition = l.__partition AND lmax.__batch = l.__batch LEFT JOIN rmax ON rmax.__partition = r.__partition AND rmax.__batch = r.__batch
WHERE l.__batch = r.__batch OR CASE WHEN l.__batch < r.__batch THEN lmax.t ELSE rmax.t END >= c.st - {DAY}""")
def join_retention_by_batch(spark, d):
    return windowed_join(*_sides(spark, d), "user_id", "user_id", DAY, by_batch=True).select("left_event_id", "right_event_id", "__batch")


@query(TOPIC + "SELECT event_id, event_type FROM topic WHERE event_type IN ('click', 'view')")
def merge_topics(spark, d):
    rows = topic(spark, d)
    return topics.merge(*(filter_rows(rows, F.col("event_type") == k) for k in ("click", "view"))).select("event_id", "event_type")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def merge_same_parent_twice(spark, d):
    region = spark.read.parquet(f"{d}/region.parquet")
    return topics.merge(region, region)


@query(TOPIC + "SELECT 'big' AS sink, event_id, value FROM topic WHERE value > 100 UNION ALL SELECT 'errors', event_id, value FROM topic WHERE event_type = 'error'")
def fan_out_two_sinks(spark, d):
    t = Topology()
    source = t.source("events", ["events"])
    t.sink("big", t.filter("over 100", source, F.col("value") > 100), "big")
    t.sink("errors", t.filter("bad", source, F.col("event_type") == "error"), "errors")
    out = t.run({"events": topic(spark, d), "undeclared": topic(spark, d)})
    return topics.merge(*(df.select(F.lit(name).alias("sink"), "event_id", "value") for name, df in out.items()))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Undecoded records: values are the JSON of ``props``."""
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select(
        F.encode(F.col("user_id").cast("string"), "UTF-8").alias("key"), F.encode("props", "UTF-8").alias("value"), F.expr(f"{MICROS} div 1000").alias("timestamp"),
        F.array(F.struct(F.lit("trace").alias("key"), F.encode("event_type", "UTF-8").alias("value"))).alias("headers"), "event_id",
        (F.col("user_id") % 4).cast("int").alias("__partition"), F.col("event_id").alias("__offset"), F.expr("event_id div 2500").alias("__batch"),
    )


@query("SELECT 'copy' AS topic, CAST(user_id AS VARCHAR) AS k, props AS v, epoch_us(ts) // 1000 AS timestamp, event_type AS trace FROM events")
def pass_through(spark, d):
    t = Topology()
    t.pass_through("copy", t.source("raw", ["raw"]), "copy")
    raw = topics.pass_through(t.run({"raw": _records(spark, d)})["copy"], "copy")
    return raw.select("topic", F.decode("key", "UTF-8").alias("k"), F.decode("value", "UTF-8").alias("v"), "timestamp", F.decode(F.col("headers")[0]["value"], "UTF-8").alias("trace"))


@query("SELECT c_custkey AS __offset, c_name AS __key, c_mktsegment AS segment FROM customer WHERE c_custkey % 2 = 0")
def payload_escape_roundtrip(spark, d):
    """Payload columns that are named like metadata keep their names through a topic."""
    named = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("__offset"), F.col("c_name").alias("__key"), F.col("c_mktsegment").alias("segment"))
    rows = topics.as_topic(named, timestamp_ms=F.lit(0), partition=F.lit(0), offset=F.col("__offset"))
    return topics.to_payload(filter_rows(rows, F.col(topics.payload_column("__offset")) % 2 == 0))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_bridge_decode(spark, d):
    return codecs.json_decode(_records(spark, d), T.StructType([T.StructField("k", T.LongType())])).select("event_id", "k")


@query("SELECT event_id, concat('{\"event_type\":\"', event_type, '\",\"user_id\":', user_id, ',\"props\":{\"k\":', json_extract_string(props, '$.k'), '}}') AS value FROM events")
def json_bridge_encode(spark, d):
    rows = select_columns(topic(spark, d), "event_type", "user_id", "props")
    return codecs.json_encode(rows, json_columns=("props",)).select(F.col("__offset").alias("event_id"), "value")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_required(spark, d):
    return codecs.json_decode(_records(spark, d), T.StructType([T.StructField("k", T.IntegerType(), False)])).select("event_id", "k")


@query("SELECT event_id, event_id * 3 AS value FROM events")
def json_bridge_scalars(spark, d):
    """A record that is a number, not an object: one column named value."""
    rows = topic(spark, d).select((F.col("event_id") * 3).alias("value"), *(c for c in topic(spark, d).columns if c.startswith("__")))
    written = codecs.json_encode(rows).select("__offset", "value")
    return codecs.json_decode(written, T.StructType([T.StructField("value", T.LongType())])).select(F.col("__offset").alias("event_id"), "value")


RUNS = TOPIC + """, k AS (SELECT *, user_id % 2 AS kk FROM topic), m AS (SELECT *, CASE WHEN kk = lag(kk) OVER p AND __timestamp // 86400000 = lag(__timestamp // 86400000) OVER p THEN 0 ELSE 1 END AS new
  FROM k WINDOW p AS (PARTITION BY user_id % 3, __batch ORDER BY __offset)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id % 3, __batch ORDER BY __offset) AS run FROM m)
"""


@query(RUNS + """SELECT CAST(user_id % 3 AS INTEGER) AS __partition, kk AS k, __timestamp // 86400000 * 86400000 AS __timestamp, CAST(count(*) AS INTEGER) AS n_rows FROM r GROUP BY user_id % 3, __batch, run, kk, __timestamp // 86400000""")
def blob_envelopes(spark, d):
    return codecs.blob_encode(_runs(spark, d)).select("__partition", F.decode("__key", "UTF-8").cast("long").alias("k"), "__timestamp", "n_rows")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Events in runs of one key and day."""
    return topic(spark, d).withColumns({"__partition": (F.col("user_id") % 3).cast("int"), "__key": F.encode((F.col("user_id") % 2).cast("string"), "UTF-8"), "__timestamp": floor_to(F.col("__timestamp"), DAY)})


@query(RUNS + """, runs AS (SELECT user_id % 3 AS p, kk, __timestamp // 86400000 * 86400000 AS t, count(*) AS n FROM r GROUP BY user_id % 3, __batch, run, kk, __timestamp // 86400000), pieces AS (SELECT *, unnest(range((n + 2) // 3)) AS i FROM runs)
SELECT CAST(p AS INTEGER) AS __partition, kk AS k, t AS __timestamp, CAST(least(3, n - 3 * i) AS INTEGER) AS n_rows FROM pieces""")
def blob_greedy(spark, d):
    """Under a cap that three rows just fit, each record takes as many rows of its run as it can."""
    rows = select_columns(_runs(spark, d), "event_id")
    cap = codecs.stream_bytes(T.StructType([rows.schema["event_id"]]), [(i,) for i in range(3)])
    return codecs.blob_encode(rows, cap).select("__partition", F.decode("__key", "UTF-8").cast("long").alias("k"), "__timestamp", "n_rows")


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN '' ELSE props END AS value FROM events")
def tombstone_normalised(spark, d):
    records = _records(spark, d).withColumn("value", F.when(F.decode(F.col("headers")[0]["value"], "UTF-8") != "view", F.col("value")))
    return topics.normalise_tombstones(records).select("event_id", F.decode("value", "UTF-8").alias("value"))


FAILED = "event_id % 4001 = 17"


@query(TOPIC + f""", bad AS (SELECT DISTINCT __partition, __batch FROM topic WHERE {FAILED})
SELECT event_id, 5 + 1 AS n_headers, 'source.offset=' || event_id AS last_header FROM topic SEMI JOIN bad USING (__partition, __batch)""")
def dead_letter_partition_batch(spark, d):
    """One bad record sends its whole poll of the partition to the dead letters."""
    _, lost = runs.split_failures(_records(spark, d), F.expr(FAILED), runs.DEAD_LETTER)
    letters = runs.dead_letters(lost, "events", "ValueError", "bad record")
    last = F.element_at("headers", -1)
    return letters.select("event_id", F.size("headers").alias("n_headers"), F.concat(last["key"], F.lit("="), F.decode(last["value"], "UTF-8")).alias("last_header"))


BAD_JSON, BAD_HEADERS = "event_id % 4001 = 17", "event_id % 3001 = 11"


@query(TOPIC + f""", bad AS (SELECT __partition, __batch, min(__offset) AS first FROM topic WHERE {BAD_JSON} OR {BAD_HEADERS} GROUP BY ALL)
SELECT event_id, props AS value, first AS first_bad, CASE WHEN first % 4001 = 17 THEN 'MalformedValue: not JSON of the schema: ' || (SELECT left(e.props, -1) FROM topic e WHERE e.event_id = first) ELSE 'MalformedValue: not packed headers' END AS error, 'events/' || __partition || '/' || __offset AS source
FROM topic JOIN bad USING (__partition, __batch) WHERE NOT ({BAD_JSON})
UNION ALL SELECT event_id, left(props, -1), first, 'MalformedValue: not JSON of the schema: ' || (SELECT left(e.props, -1) FROM topic e WHERE e.event_id = first), 'events/' || __partition || '/' || __offset FROM topic JOIN bad USING (__partition, __batch) WHERE {BAD_JSON} AND first % 4001 = 17
UNION ALL SELECT event_id, left(props, -1), first, 'MalformedValue: not packed headers', 'events/' || __partition || '/' || __offset FROM topic JOIN bad USING (__partition, __batch) WHERE {BAD_JSON} AND first % 4001 <> 17""")
def dead_letter_decode(spark, d):
    """Cut-off JSON and cut-off headers: each poll with one goes to the dead letters as it came, with the class and message of its first bad record."""
    packed = binary.pack_headers(F.col("headers"))
    cut_off = {"value": F.when(F.expr(BAD_JSON), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value")), "__headers": F.when(F.expr(BAD_HEADERS), F.substring(packed, F.lit(1), F.length(packed) - 1)).otherwise(packed)}
    records = _records(spark, d).withColumns(cut_off).drop("headers").withColumn("raw", F.col("value"))
    # a record that is bad both ways has failed by its JSON, and keeps the headers that it came with if they can be read
    tried = attempts.try_headers(attempts.try_json(records, T.StructType([T.StructField("k", T.LongType(), False)])))
    _, lost = runs.outcome(tried, runs.DEAD_LETTER)
    letters = runs.dead_letters(lost.withColumn("headers", F.coalesce("headers", binary.parsed_headers(F.col("__headers")))), "events")
    told = lambda back: F.decode(F.element_at("headers", -back)["value"], "UTF-8")
    first = F.min(F.when(F.expr(f"{BAD_JSON} or {BAD_HEADERS}"), F.col("event_id"))).over(Window.partitionBy("__partition", "__batch"))
    return letters.select("event_id", F.decode("raw", "UTF-8").alias("value"), first.alias("first_bad"), F.concat(told(5), F.lit(": "), told(4)).alias("error"), F.concat_ws("/", told(3), told(2), told(1)).alias("source"))


@query(TOPIC + f""", polls AS (SELECT __partition, __batch, count(*) AS n, bool_or({FAILED}) AS bad FROM topic GROUP BY ALL)
SELECT __partition, count(*) AS batches, CAST(sum(n) AS BIGINT) AS input, CAST(coalesce(sum(n) FILTER (NOT bad), 0) AS BIGINT) AS output, count(*) FILTER (bad) AS failures, CAST(coalesce(sum(n) FILTER (bad), 0) AS BIGINT) AS dead_letters FROM polls GROUP BY __partition""")
def runner_metrics(spark, d):
    records = topic(spark, d)
    good, _ = runs.split_failures(records, F.expr(FAILED), runs.SKIP)
    return runs.metrics(records, F.expr(FAILED), good)


@query(TOPIC + "SELECT __partition, max(__offset) + 1 AS next_offset FROM topic GROUP BY __partition")
def next_offsets(spark, d):
    return runs.next_offsets(topic(spark, d))


MANIFEST = TOPIC + """, manifest AS (
  SELECT 'g' || user_id % 3 AS grp, event_id // 500 AS epoch, CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS kind, event_id AS record_offset, event_id % 11 = 0 AS tombstone,
    CAST(user_id % 2 AS INTEGER) AS status, 'events' AS topic, unnest([0, 1, 2, 3]) AS partition, event_id AS base FROM topic WHERE event_type IN ('error', 'signup')),
m AS (SELECT * EXCLUDE (base), base - 37 * partition AS cut_offset FROM manifest),
cuts AS (SELECT * FROM m WHERE kind = 0), latest AS (SELECT cuts.* FROM cuts JOIN (SELECT grp, epoch, max(record_offset) AS record_offset FROM cuts GROUP BY ALL) USING (grp, epoch, record_offset) WHERE NOT tombstone),
after AS (SELECT epoch, topic, partition, cut_offset FROM latest WHERE grp = 'g1' AND status = 0 AND epoch > -1), next AS (SELECT * FROM after WHERE epoch = (SELECT min(epoch) FROM after))
"""


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = topic(spark, d).filter("event_type in ('error', 'signup')")
    out = rows.select(
        F.concat(F.lit("g"), F.col("user_id") % 3).alias("grp"), F.expr("event_id div 500").alias("epoch"), F.when(F.col("event_id") % 17 == 0, 1).otherwise(0).alias("kind"), F.col("event_id").alias("record_offset"),
        (F.col("event_id") % 11 == 0).alias("tombstone"), (F.col("user_id") % 2).cast("int").alias("status"), F.lit("events").alias("topic"), F.explode(F.array(*map(F.lit, range(4)))).alias("partition"), "event_id",
    )
    return out.withColumn("cut_offset", F.col("event_id") - 37 * F.col("partition")).drop("event_id")


@query(MANIFEST + "SELECT grp, epoch, status, partition, cut_offset FROM latest")
def cut_fold_latest(spark, d):
    return cuts.latest_cuts(_manifest(spark, d)).select("grp", "epoch", "status", "partition", "cut_offset")


@query(MANIFEST + "SELECT * FROM after")
def cut_complete_after(spark, d):
    return cuts.complete_cuts_after(_manifest(spark, d), "g1", -1)


@query(MANIFEST + "SELECT * FROM after WHERE epoch = (SELECT max(epoch) FROM after)")
def cut_latest_complete(spark, d):
    return cuts.latest_complete_cut(_manifest(spark, d), "g1").select("epoch", "topic", "partition", "cut_offset")


@query(MANIFEST + "SELECT event_id, __partition FROM topic t LEFT JOIN next ON t.__partition = next.partition WHERE __offset < coalesce(cut_offset, 9223372036854775807)")
def cut_truncate(spark, d):
    return cuts.align(topic(spark, d), cuts.next_cut(_manifest(spark, d), "g1", -1))[0].select("event_id", "__partition")


@query(MANIFEST + "SELECT event_id FROM topic t JOIN next ON t.__partition = next.partition WHERE __offset >= cut_offset")
def cut_resume(spark, d):
    return cuts.resume(topic(spark, d), cuts.next_cut(_manifest(spark, d), "g1", -1)).select("event_id")


@query(MANIFEST + ", pos AS (SELECT __partition, max(__offset) + 1 AS position FROM topic GROUP BY ALL) SELECT count(*) AS partitions, coalesce(bool_and(position >= cut_offset), false) AS fired FROM next JOIN pos ON partition = __partition")
def cut_fired(spark, d):
    return cuts.fired(topic(spark, d), cuts.next_cut(_manifest(spark, d), "g1", -1))


@query(MANIFEST + ", pos AS (SELECT __partition, max(__offset) + 1 AS position FROM topic JOIN next ON __partition = partition WHERE __offset < cut_offset GROUP BY ALL) SELECT partition, greatest(coalesce(position, 0), cut_offset) AS \"offset\" FROM next LEFT JOIN pos ON partition = __partition")
def cut_committed(spark, d):
    return cuts.committed_offsets(topic(spark, d), cuts.next_cut(_manifest(spark, d), "g1", -1))


@query(MANIFEST + "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM topic t JOIN next ON t.__partition = next.partition WHERE __offset < cut_offset GROUP BY __partition, event_type")
def cut_state_at_epoch(spark, d):
    early, _ = cuts.align(topic(spark, d), cuts.next_cut(_manifest(spark, d), "g1", -1))
    return group_by(early, ["event_type"], [Agg(COUNT, "event_id", "n"), Agg(SUM, "event_id", "total")])


ROLES = TOPIC + f""", log AS (SELECT 'role-' || user_id % 5 AS role, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS kind, 'node-' || user_id % 40 AS member, event_id AS record_offset, event_id % 13 = 0 AS tombstone,
  __timestamp AS registered_at, __timestamp + 30000 AS deadline, user_id AS producer_id, CAST(event_id % 100 AS SMALLINT) AS producer_epoch FROM topic),
slots AS (SELECT *, CASE WHEN kind = 0 THEN member ELSE '' END AS slot FROM log), now AS (SELECT * FROM slots QUALIFY row_number() OVER (PARTITION BY role, kind, slot ORDER BY record_offset DESC) = 1),
alive AS (SELECT * FROM now WHERE NOT tombstone), held AS (SELECT r.role, r.member, r.record_offset AS joined, r.registered_at, h.member AS holder, h.deadline, coalesce(r.member = h.member, false) AS leads
  FROM alive r LEFT JOIN alive h ON h.role = r.role AND h.kind = 1 WHERE r.kind = 0),
ranked AS (SELECT *, CASE WHEN leads THEN 0 ELSE row_number() OVER (PARTITION BY role, leads ORDER BY joined) - CASE WHEN holder IS NULL THEN 1 ELSE 0 END END AS rank FROM held),
turns AS (SELECT *, CASE WHEN holder IS NOT NULL THEN deadline + (rank - 1) * 5000 ELSE registered_at + rank * 5000 END AS turn FROM ranked)
"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("__timestamp")
    return topic(spark, d).select(
        F.concat(F.lit("role-"), F.col("user_id") % 5).alias("role"), F.when(F.col("event_type") == "purchase", roles.LEASE).otherwise(roles.REGISTRATION).alias("kind"), F.concat(F.lit("node-"), F.col("user_id") % 40).alias("member"),
        F.col("event_id").alias("record_offset"), (F.col("event_id") % 13 == 0).alias("tombstone"), t.alias("registered_at"), (t + roles.DURATION).alias("deadline"), F.col("user_id").alias("producer_id"), (F.col("event_id") % 100).cast("smallint").alias("producer_epoch"),
    )


@query(ROLES + "SELECT role, kind, member, record_offset FROM alive")
def role_fold(spark, d):
    return roles.fold(_log(spark, d)).select("role", "kind", "member", "record_offset")


@query(ROLES + "SELECT role, member, CAST(rank AS INTEGER) AS rank FROM ranked")
def role_rank(spark, d):
    return roles.ranks(_log(spark, d)).select("role", "member", F.col("rank").cast("int").alias("rank"))


@query(ROLES + f"SELECT role, member, CASE WHEN leads THEN 'hold' WHEN turn <= {NOW} THEN 'challenge' ELSE 'wait' END AS action, CASE WHEN NOT leads AND turn > {NOW} THEN turn END AS until FROM turns")
def role_decision(spark, d):
    return roles.decisions(_log(spark, d), NOW).drop("rank")


@query(ROLES + f"SELECT role, member, deadline > {NOW} AS live, greatest(deadline - {NOW}, 0) AS remaining, deadline - 20000 AS renew_at FROM alive WHERE kind = 1")
def lease_timing(spark, d):
    return roles.lease_timing(roles.fold(_log(spark, d)).filter(F.col("kind") == roles.LEASE), NOW)


@query(ROLES + "SELECT role, arg_max(producer_id || ':' || producer_epoch, (producer_id, producer_epoch)) AS token FROM log WHERE kind = 1 GROUP BY role")
def token_order(spark, d):
    return roles.newest_token(_log(spark, d))


@query(TOPIC + "SELECT 'events-cut' AS grp, event_id % 50 AS epoch, min(__timestamp) OVER e AS triggered, max(__timestamp) OVER e AS completed, __partition AS partition, max(event_id) OVER p AS cut_offset FROM topic WINDOW e AS (PARTITION BY event_id % 50), p AS (PARTITION BY event_id % 50, __partition) QUALIFY row_number() OVER (PARTITION BY event_id % 50, __partition ORDER BY event_id) = 1")
def cut_decode(spark, d):
    """Cuts as records of the manifest's wire format, and read again."""
    each = topic(spark, d).groupBy((F.col("event_id") % 50).alias("epoch"), "__partition").agg(F.max("event_id").alias("cut_offset"), F.min("__timestamp").alias("first"), F.max("__timestamp").alias("last"))
    entry = F.struct(F.col("__partition").alias("partition"), "cut_offset")
    whole = each.groupBy("epoch").agg(F.array_sort(F.collect_list(entry)).alias("offsets"), F.min("first").alias("first"), F.max("last").alias("last"))
    key, value = cuts.encode_cut(F.lit("events-cut"), F.col("epoch"), F.col("first"), F.col("last"), F.lit(0), F.lit("events"), F.col("offsets"))
    read = whole.select(key.alias("key"), value.alias("value")).select(cuts.decode_cut(F.col("key"), F.col("value")).alias("c"))
    return read.select("c.grp", "c.epoch", "c.triggered", "c.completed", F.explode("c.offsets").alias("o")).select("grp", "epoch", "triggered", "completed", "o.partition", "o.cut_offset")


@query("SELECT event_id, CAST(user_id AS INTEGER) AS schema_id, props AS body FROM events")
def wire_schema_id(spark, d):
    framed = _records(spark, d).withColumn("value", binary.frame(F.decode("key", "UTF-8").cast("int"), F.col("value")))
    return framed.select("event_id", binary.schema_id(F.col("value")).alias("schema_id"), F.decode(binary.body(F.col("value")), "UTF-8").alias("body"))


@query("SELECT event_id, upper('00000001' || '00000005' || hex('trace') || printf('%08x', length(event_type)) || hex(event_type)) AS packed FROM events")
def headers_pack(spark, d):
    return _records(spark, d).select("event_id", F.hex(binary.pack_headers(F.col("headers"))).alias("packed"))


@query("SELECT event_id, 2 AS n, 'trace' AS first_key, event_type AS first_value, CAST(NULL AS VARCHAR) AS second_value FROM events")
def headers_unpack(spark, d):
    two = F.concat("headers", F.array(F.struct(F.lit("none").alias("key"), F.lit(None).cast("binary").alias("value"))))
    back = _records(spark, d).select("event_id", binary.unpack_headers(binary.pack_headers(two)).alias("h"))
    text = lambda i: F.decode(F.col("h")[i]["value"], "UTF-8")
    return back.select("event_id", F.size("h").alias("n"), F.col("h")[0]["key"].alias("first_key"), text(0).alias("first_value"), text(1).alias("second_value"))


M32, MIX = "% 4294967296", "1540483477::UBIGINT"
MURMUR2 = f"""WITH k AS (SELECT event_id, CAST(user_id AS VARCHAR) AS s FROM events),
w AS (SELECT event_id, length(s) AS n, [ascii(c)::UBIGINT for c in string_split(s, '')] AS b FROM k),
whole AS (SELECT event_id, n, b, list_reduce(list_prepend(xor(2538058380::UBIGINT, n::UBIGINT), [b[4 * i + 1] + b[4 * i + 2] * 256 + b[4 * i + 3] * 65536 + b[4 * i + 4] * 16777216 for i in range(n // 4)]),
  lambda h, x: xor((h * {MIX}) {M32}, (xor((x * {MIX}) {M32}, ((x * {MIX}) {M32}) >> 24) * {MIX}) {M32})) AS h FROM w),
tail AS (SELECT event_id, CASE WHEN n % 4 = 0 THEN h ELSE (xor(h, coalesce(b[n - n % 4 + 1], 0) + coalesce(b[n - n % 4 + 2], 0) * 256 + coalesce(b[n - n % 4 + 3], 0) * 65536) * {MIX}) {M32} END AS h FROM whole),
mixed AS (SELECT event_id, (xor(h, h >> 13) * {MIX}) {M32} AS h FROM tail)
SELECT event_id, CAST((xor(h, h >> 15) & 2147483647) % 16 AS INTEGER) AS dealt FROM mixed"""


@query(MURMUR2)
def role_partition_murmur2(spark, d):
    return topic(spark, d).select("event_id", binary.key_partition(F.col("__key"), 16).alias("dealt"))


@query(TOPIC + "SELECT event_id, event_type, value, __partition FROM topic")
def ipc_roundtrip(spark, d):
    rows = select_columns(topic(spark, d), "event_id", "event_type", "value")
    schema = T.StructType([rows.schema[c] for c in ("event_id", "event_type", "value")])
    return codecs.ipc_decode(codecs.blob_encode(rows, 64 << 10).drop("n_rows"), schema).select("event_id", "event_type", "value", "__partition")


@query("SELECT event_id, props AS value FROM events")
def gzip_roundtrip(spark, d):
    back = codecs.gunzip_values(codecs.gzip_values(_records(spark, d).select("event_id", "value")))
    return back.select("event_id", F.decode("value", "UTF-8").alias("value"))


@query(TOPIC + "SELECT __partition, user_id, min(__offset) AS __first, count(*) AS n FROM topic GROUP BY ALL")
def group_first_appearance(spark, d):
    return first_appearance(topic(spark, d), ["__partition", "user_id"], [Agg(COUNT, "event_id", "n")])


@query("SELECT o_custkey, CAST(DATE '1970-01-01' + CAST(sum(CAST(o_orderdate AS DATE) - DATE '1970-01-01') AS INTEGER) AS DATE) AS days FROM orders GROUP BY o_custkey")
def sum_of_dates(spark, d):
    """Dates sum as the days they are stored as."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    rows = topics.as_topic(orders, timestamp_ms=F.lit(0), partition=F.lit(0), offset=F.lit(0))
    return group_by(rows, ["o_custkey"], [Agg(SUM, "day", "days")])


@query("SELECT p_partkey, CAST(p_size AS DECIMAL(20,0)) AS size FROM part")
def unsigned_range(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", unsigned(F.col("p_size").cast("decimal(20,0)"), 8).alias("size"))


@query(TOPIC + "SELECT event_type, count(*) AS n FROM topic WHERE __partition = 2 GROUP BY event_type")
def run_one_partition(spark, d):
    t = Topology()
    t.sink("out", t.group("types", t.source("events", ["events"]), ["event_type"], [Agg(COUNT, "event_id", "n")]), "by-type")
    return t.run({"events": filter_rows(topic(spark, d), F.col("__partition") == 2)}, partition=2)["out"]


@query("SELECT p_partkey, CAST(p_size AS SMALLINT) AS narrow, CAST(p_size AS VARCHAR) AS written, CAST(p_partkey AS DECIMAL(20,0)) AS wide FROM part")
def exact_casts(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    size, key = part.schema["p_size"].dataType, part.schema["p_partkey"].dataType
    return part.select("p_partkey", exact_cast(F.col("p_size").cast("double"), T.DoubleType(), T.ShortType()).alias("narrow"), exact_cast(F.col("p_size"), size, T.StringType()).alias("written"), exact_cast(F.col("p_partkey"), key, T.DecimalType(20, 0)).alias("wide"))


ORDER = '{"type":"record","name":"event","fields":[{"name":"event_id","type":"int"},{"name":"event_type","type":"string"},{"name":"value","type":["null","double"]}]}'
#: A reader with a wider id, and a field that writers don't have.
WIDER = '{"type":"record","name":"event","fields":[{"name":"note","type":["null","string"],"default":null},{"name":"event_id","type":"long"},{"name":"value","type":["null","double"]}]}'


@query(TOPIC + "SELECT CAST(NULL AS VARCHAR) AS note, event_id, nullif(value, 0) AS value, __partition FROM topic")
def avro_evolved_roundtrip(spark, d):
    """Written by one schema and read by another."""
    from brookframe.operators.avro_rows import avro_decode, avro_encode

    rows = select_columns(topic(spark, d), "event_id", "event_type", "value")
    rows = with_derived(rows, Derived("event_id", F.col("event_id"), T.IntegerType()), Derived("value", F.nullif("value", F.lit(0.0)), T.DoubleType()))
    return avro_decode(avro_encode(rows, ORDER, 7), WIDER, {7: ORDER}).select("note", "event_id", "value", "__partition")


APPENDED = TOPIC.replace("event_id AS __offset", "row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS __offset")


def _payload(spark: SparkSession, d: str) -> DataFrame:
    return topic(spark, d).select("event_id", "event_type", "value", "__timestamp", "__partition")


@query(APPENDED + "SELECT event_id, event_type, __timestamp, __partition, __offset FROM topic WHERE __offset >= 20 AND (__partition <> 2 OR __offset < 90) AND __partition <> 3")
def topic_log_range(spark, d):
    """Events appended to a topic log, which gives them their offsets, and ranges of three partitions read from it."""
    path = shared_folder(spark, "topic")
    append_log(_payload(spark, d), path, "event_id", maxRecordsPerFile=5_000)
    ranged = read_log(spark, path, startingOffsets='{"0": 20, "1": 20, "2": 20}', endingOffsets='{"2": 90}', partitions="[0, 1, 2]")
    return ranged.select("event_id", "event_type", "__timestamp", "__partition", "__offset")


@query(APPENDED.replace("ORDER BY event_id", "ORDER BY event_id >= (SELECT median(event_id) FROM events), event_id") + "SELECT event_id, value, __partition, __offset FROM topic WHERE __offset >= CASE __partition WHEN 1 THEN 37 ELSE 0 END")
def topic_log_stream(spark, d):
    """A stream over a topic log that stops, and goes on with its checkpoint after more was appended."""
    path, out = shared_folder(spark, "topic"), shared_folder(spark, "streamed")
    rows = _payload(spark, d)
    middle = F.lit(rows.agg(F.median("event_id")).first()[0])
    for half in (rows.filter(F.col("event_id") < middle), rows.filter(F.col("event_id") >= middle)):
        append_log(half, path, "event_id")
        stream = stream_log(spark, path, startingOffsets='{"1": 37}')
        arrived(stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").start(f"{out}/rows"))
    return spark.read.parquet(f"{out}/rows").select("event_id", "value", "__partition", "__offset")


def _in_two_runs(spark: SparkSession, d: str, made) -> DataFrame:
    """What a stream over a topic log of whole polls gives: it is stopped after half of them, and goes on with its state."""
    path, out = shared_folder(spark, "topic"), shared_folder(spark, "streamed")
    rows = topic(spark, d).select("event_id", "user_id", "event_type", "value", "__timestamp", "__batch", "__partition")
    middle = F.lit(rows.agg(F.expr("max(__batch) div 2")).first()[0])
    for half in (rows.filter(F.col("__batch") <= middle), rows.filter(F.col("__batch") > middle)):
        append_log(half, path, "event_id")
        with stateful(spark):
            query = made(lambda: stream_log(spark, path)).writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").start(f"{out}/rows")
        arrived(query)
    return spark.read.parquet(f"{out}/rows")


@query(SQL["window_retention_by_batch"])
def window_stream_time(spark, d):
    """The windows of each poll by the stream time of its partition, from a stream with state."""
    aggs = [Agg(COUNT, "event_id", "n"), Agg(SUM, "event_id", "total")]
    return _in_two_runs(spark, d, lambda events: grouped_by_stream_time(events(), ["event_type"], aggs, DAY, 2 * DAY))


@query(SQL["group_cumulative_by_batch"])
def group_stream_state(spark, d):
    aggs = [Agg(COUNT, "event_id", "n"), Agg(SUM, "event_id", "total"), Agg(MAX, "value", "high")]
    return _in_two_runs(spark, d, lambda events: grouped_by_stream_time(events(), ["event_type", "__partition"], aggs))


@query(SQL["join_retention_by_batch"])
def join_stream_time(spark, d):
    """Clicks and purchases as two streams, joined with the rows that the partition's stream time retains."""
    def made(events):
        sides = (events().filter(F.col("event_type") == kind).select("event_id", "user_id", "value", "__timestamp", "__batch", "__partition", "__offset") for kind in ("click", "purchase"))
        return joined_by_stream_time(*sides, "user_id", "user_id", DAY).select("left_event_id", "right_event_id", "__batch")

    return _in_two_runs(spark, d, made)


@query(TOPIC + """SELECT '66' || ['0000000000000000', '8000000000000000', '7FF8000000000000', '3FF8000000000000', 'C024000000000000'][event_id % 5 + 1] AS tag, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM topic GROUP BY __partition, event_id % 5""")
def group_by_tag(spark, d):
    """Zeros of both signs, NaN and other doubles as keys by their bits."""
    zero = F.element_at(F.array(*map(F.lit, [0.0, -0.0, float("nan"), 1.5, -10.0])), (F.col("event_id") % 5 + 1).cast("int"))
    grouped = groups.group_by_tag(topic(spark, d).withColumn("x", zero), ["x"], [Agg(COUNT, "event_id", "n"), Agg(SUM, "event_id", "total")])
    return grouped.select(F.hex(tagged(F.col("x"), T.DoubleType())).alias("tag"), "n", "total")


@query(JOIN + f"SELECT l.event_id AS left_event_id, r.event_id AS right_event_id FROM l JOIN r ON l.user_id = r.user_id AND l.__partition = r.__partition AND abs(l.__timestamp - r.__timestamp) <= {HOUR}")
def join_by_tag(spark, d):
    """Decimals of different scales are one key by their value."""
    left, right = _sides(spark, d)
    left, right = (x.withColumn("user_id", (F.col("user_id") / 4).cast(kind)) for x, kind in ((left, "decimal(10,2)"), (right, "decimal(20,6)")))
    return windowed_join(left, right, "user_id", "user_id", HOUR, by_tag=True).select("left_event_id", "right_event_id")


class _Stretches(process.Processor):
    """Numbers the stretches of equal event types that a partition goes through."""

    def __init__(self, partition: int):
        self.last, self.n = None, 0

    def process(self, batch):
        kinds = batch.column("event_type").to_pylist()
        numbers = []
        for kind in kinds:
            self.n += kind != self.last
            self.last = kind
            numbers.append(self.n)
        yield pa.RecordBatch.from_arrays([batch.column("event_id"), batch.column("__partition"), pa.array(numbers, pa.int64())], ["event_id", "__partition", "stretch"])


@query(TOPIC + """, m AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS begins FROM topic WINDOW w AS (PARTITION BY __partition ORDER BY __offset))
SELECT event_id, __partition, CAST(sum(begins) OVER (PARTITION BY __partition ORDER BY __offset) AS BIGINT) AS stretch FROM m""")
def process_by_partition(spark, d):
    """A processor of one's own whose state depends on the order of records."""
    t = Topology()
    t.sink("out", t.process_in_order("stretches", t.source("events", ["events"]), _Stretches, "event_id long, __partition int, stretch long"), "out")
    return t.run({"events": topic(spark, d)})["out"]


PROPS = '{"type":"object","required":["k"],"properties":{"k":{"$ref":"#/$defs/count"},"note":{"type":["string","null"]},"tags":{"type":"array"}},"$defs":{"count":{"type":"integer"}}}'


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS note, '[' || event_id || ',\"x\"]' AS tags FROM events")
def json_schema_decode(spark, d):
    """Columns as a JSON Schema declares them: a required integer, a text or null, and an array as JSON text."""
    tags = F.concat(F.expr("substring(cast(value as string), 1, length(cast(value as string)) - 1)"), F.lit(', "tags": ['), "event_id", F.lit(', "x"]}'))
    return codecs.json_decode(_records(spark, d).withColumn("value", F.encode(tags, "UTF-8")), columns_of(PROPS)).select("event_id", "k", "note", "tags")


@query("SELECT event_id, CAST(user_id AS INTEGER) AS schema_id, CASE event_id % 3 WHEN 0 THEN '0' WHEN 1 THEN (event_id - 100) || ',' || user_id ELSE '0,0' END AS indexes, props AS body, CASE WHEN event_id % 3 = 0 THEN '00' ELSE '04' END AS begins FROM events")
def protobuf_frames(spark, d):
    """Frames with message indexes of one and several bytes, and read again."""
    indexes = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(0))).when(F.col("event_id") % 3 == 1, F.array((F.col("event_id") - 100).cast("int"), F.decode("key", "UTF-8").cast("int"))).otherwise(F.array(F.lit(0), F.lit(0)))
    framed = _records(spark, d).withColumn("value", binary.protobuf_frame(F.decode("key", "UTF-8").cast("int"), indexes, F.col("value")))
    read = framed.select("event_id", "value", binary.unpack_protobuf_frame(F.col("value")).alias("f"))
    return read.select("event_id", "f.schema_id", F.array_join("f.indexes", ",").alias("indexes"), F.decode("f.body", "UTF-8").alias("body"), F.hex(F.substring("value", 6, 1)).alias("begins"))


@query(TOPIC + f""", polls AS (SELECT __partition, __batch, count(*) AS n, bool_or({BAD_JSON}) AS bad, count(*) FILTER (CAST(json_extract_string(props, '$.k') AS BIGINT) > 50) AS wanted FROM topic GROUP BY ALL)
SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS input_records, CAST(coalesce(sum(wanted) FILTER (NOT bad), 0) AS BIGINT) AS output_records, count(*) FILTER (bad) AS failures, CAST(coalesce(sum(n) FILTER (bad), 0) AS BIGINT) AS dead_letter_records, true AS timed FROM polls""")
def stream_metrics(spark, d):
    """What a stream of polls counts on its way: cut-off JSON goes to the dead letters with its poll, the rest is filtered."""
    path, out = shared_folder(spark, "topic"), shared_folder(spark, "run")
    rows = _records(spark, d).withColumns({"value": F.when(F.expr(BAD_JSON), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))})
    append_log(rows.select("event_id", "key", "value", "headers", "__batch", "__partition"), path, "event_id")
    metrics = polls.Metrics()
    query = polls.run_polls(
        stream_log(spark, path), lambda df: attempts.try_json(df.withColumn("raw", F.col("value")), T.StructType([T.StructField("k", T.LongType())])), lambda df: df.filter("k > 50"),
        f"{out}/good", f"{out}/checkpoint", runs.DEAD_LETTER, f"{out}/dead", "events", metrics,
    )
    arrived(query)
    got = metrics.snapshot()
    return spark.createDataFrame([(*(got[k] for k in list(got)[:5]), got["processing_nanos"] > 0)], "batches long, input_records long, output_records long, failures long, dead_letter_records long, timed boolean")
