"""Who leads a role, as queries over a log of registrations and leases.

A row: ``role, kind, member, record_offset, tombstone, registered_at, deadline, producer_id, producer_epoch``; kind 0
is a member's registration, 1 the role's lease. Times are milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REGISTRATION, LEASE = 0, 1
STAGGER, DURATION, RENEW = 5_000, 30_000, 10_000


def fold(log: DataFrame) -> DataFrame:
    """The last record of each key (a role's member, or a role's lease) by offset, unless it is a tombstone; in any order of rows."""
    key = ["role", "kind", F.when(F.col("kind") == REGISTRATION, F.col("member")).alias("slot")]
    named = log.select("*", key[-1])
    last = named.groupBy("role", "kind", "slot").agg(F.max("record_offset").alias("record_offset"))
    on = [F.col("n.role") == F.col("l.role"), F.col("n.kind") == F.col("l.kind"), F.col("n.slot").eqNullSafe(F.col("l.slot")), F.col("n.record_offset") == F.col("l.record_offset")]
    return named.alias("n").join(last.alias("l"), on, "left_semi").filter(~F.col("tombstone")).drop("slot")


def ranks(log: DataFrame) -> DataFrame:
    """Members of each role in succession: the lease's holder has rank 0, the others follow by the offset of their registration."""
    now = fold(log)
    holder = now.filter(F.col("kind") == LEASE).select("role", F.col("member").alias("holder"), "deadline", "producer_id", "producer_epoch")
    roster = now.filter(F.col("kind") == REGISTRATION).select("role", "member", F.col("record_offset").alias("joined"), "registered_at")
    held = roster.join(holder, "role", "left").withColumn("leads", F.coalesce(F.col("member") == F.col("holder"), F.lit(False)))
    place = F.row_number().over(Window.partitionBy("role", "leads").orderBy("joined"))
    rank = F.when(F.col("leads"), 0).when(F.col("holder").isNull(), place - 1).otherwise(place)
    return held.withColumn("rank", rank)


def saturated(a: Column, b: Column) -> Column:
    """a + b of longs, held within their range."""
    low, high = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    total = a.cast("decimal(20,0)") + b.cast("decimal(20,0)")
    return F.least(F.greatest(total, low.cast("decimal(20,0)")), high.cast("decimal(20,0)")).cast("long")


def decisions(log: DataFrame, now: int, stagger: int = STAGGER) -> DataFrame:
    """What each member does at ``now``: hold, challenge, or wait until its turn.

    With a lease the turn of rank r comes (r - 1) staggers after the deadline; without one, r staggers after the
    member registered.
    """
    ranked = ranks(log)
    turn = F.when(F.col("holder").isNotNull(), saturated(F.col("deadline"), (F.col("rank") - 1) * stagger)).otherwise(saturated(F.col("registered_at"), F.col("rank") * stagger))
    ranked = ranked.withColumn("turn", turn)
    action = F.when(F.col("leads"), "hold").when(F.col("turn") <= now, "challenge").otherwise("wait")
    return ranked.select("role", "member", "rank", action.alias("action"), F.when(action == "wait", F.col("turn")).alias("until"))


def lease_timing(leases: DataFrame, now: int, duration: int = DURATION, renew: int = RENEW) -> DataFrame:
    """Whether each lease is live at ``now``, what remains of it, and when it is renewed."""
    if not 0 < renew < duration:
        raise ValueError("a lease is renewed within its duration")
    remains = F.greatest(F.col("deadline") - now, F.lit(0))
    return leases.select("role", "member", (F.col("deadline") > now).alias("live"), remains.alias("remaining"), saturated(F.col("deadline"), F.lit(renew - duration)).alias("renew_at"))


def newest_token(log: DataFrame) -> DataFrame:
    """The greatest fencing token of each role: by producer id, then epoch."""
    top = F.max(F.struct("producer_id", "producer_epoch")).alias("t")
    return log.filter(F.col("kind") == LEASE).groupBy("role").agg(top).select("role", F.concat_ws(":", "t.producer_id", "t.producer_epoch").alias("token"))
