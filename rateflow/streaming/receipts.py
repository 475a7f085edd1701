"""Delivery state of the outbox. A mail gateway appends one receipt for each try."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(receipts: DataFrame, key: str = "message_id") -> DataFrame:
    """(key, tries, sent, error) by the receipt of the highest version.

    Receipts (key, version, sent, error) may be repeated; of unequal ones with one version a
    delivered one counts. Partial maxima before the shuffle, whatever the number of receipts.
    """
    order = F.struct("version", F.coalesce("sent", F.lit(False)).alias("sent"), F.coalesce("error", F.lit("")).alias("e"))
    best = receipts.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order.alias("o"), "error")).alias("m"))
    return best.select(key, (F.col("m.o.version") + 1).cast("int").alias("tries"), F.col("m.o.sent").alias("sent"), F.col("m.error").alias("error"))


def outbox_state(outbox: DataFrame, receipts: DataFrame, key: str = "message_id") -> DataFrame:
    """The replies with ``state`` (undeliverable, pending, failed, sent), ``tries`` and the last error."""
    known = latest(receipts, key)
    state = (
        F.when(F.col("sent"), F.lit("sent"))
        .when(~F.col("deliverable"), F.lit("undeliverable"))
        .when(F.col("tries").isNull(), F.lit("pending"))
        .otherwise(F.lit("failed"))
    )
    joined = outbox.join(known, key, "left").withColumn("state", state)
    return joined.withColumn("tries", F.coalesce("tries", F.lit(0))).drop("sent")


def is_due(max_tries: int | None = None) -> Column:
    """Whether a reply of ``outbox_state`` is to be offered (again) to the gateway."""
    open_ = F.col("state").isin("pending", "failed")
    return open_ if max_tries is None else open_ & (F.col("tries") < max_tries)
