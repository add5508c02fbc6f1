"""Repair plans for the publication outbox."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pressgrain.operators.joins import receipt_disjunctive_join


def reconcile_outbox(events: DataFrame, receipts: DataFrame) -> DataFrame:
    """One repair per event: conflict, create a missing receipt, or mark a received event delivered."""
    pairs = receipt_disjunctive_join(events, receipts)
    bad = (
        (F.col("event_id") != F.col("r_event_id")) | (F.col("destination") != F.col("r_destination"))
        | (F.col("idempotency_key") != F.col("r_idempotency_key")) | (F.col("payload_version") != F.col("r_payload_version")))
    seen = pairs.groupBy("event_id").agg(F.bool_or(bad).alias("_bad"))
    repair = (
        F.when(F.col("_bad"), "conflict")
        .when((F.col("status") == "delivered") & F.col("_bad").isNull(), "create_receipt")
        .when((F.col("status") == "pending") & F.col("_bad").isNotNull(), "mark_delivered"))
    return events.join(seen, "event_id", "left").select("event_id", repair.alias("repair")).filter(F.col("repair").isNotNull())
