"""The job state machine as an associative fold.

An event maps every state to its next state; maps compose. So a key's history is cut into time ranges,
each range is reduced to one small map, and the maps are composed in order: a key with very many events
is spread over its ranges and never gathered into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pressgrain.operators.windows import TRANSITIONS


def _next(states: list[str], allowed: dict[str, Sequence[str]]) -> Column:
    """map<event, array<int>>: for each event, the next state's index for every current state."""
    pairs = []
    for e in states:
        pairs += [F.lit(e), F.array(*[F.lit(states.index(e) if e in allowed[s] else i) for i, s in enumerate(states)])]
    return F.create_map(*pairs)


def fold_states(events: DataFrame, bucket: Column, allowed: dict[str, Sequence[str]] = TRANSITIONS, start: str = "none") -> DataFrame:
    """Final state of each item (item_id, seq, updated_at, state); events a state does not allow are not
    applied, and a terminal state absorbs everything after it."""
    states = list(allowed)
    identity = F.array(*[F.lit(i) for i in range(len(states))])
    table = _next(states, allowed)

    def compose(acc: Column, step: Column) -> Column:
        return F.transform(acc, lambda i: F.element_at(step, i + 1))

    per = events.withColumn("_b", bucket).groupBy("item_id", "_b").agg(F.array_sort(F.collect_list(F.struct("updated_at", "seq", "state"))).alias("_e"), F.count(F.lit(1)).alias("_n"))
    reduced = per.select("item_id", "_b", "_n", F.aggregate("_e", identity, lambda acc, e: compose(acc, F.element_at(table, e["state"]))).alias("_m"))
    whole = reduced.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("_b", "_m"))).alias("_s"), F.sum("_n").alias("events"))
    folded = whole.select("item_id", "events", F.aggregate("_s", identity, lambda acc, s: compose(acc, s["_m"])).alias("_f"))
    names = F.array(*[F.lit(s) for s in states])
    return folded.select("item_id", "events", F.element_at(names, F.element_at("_f", F.lit(states.index(start) + 1)) + 1).alias("state"))
