"""Rules on streams of event rows."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..plans import correlation, sigma


def match_stream(events: DataFrame, rules: list[sigma.Rule]) -> DataFrame:
    """Single-event matches of a stream: stateless, the same plan as for a batch."""
    return sigma.match(events, rules)


def sequence_stream(events: DataFrame, rule: correlation.Rule, delay: str = "10 minutes") -> DataFrame:
    """Matches of a two-step rule over a stream with an event-time column ``ts``, as a stream-stream join.

    State is held for the rule's window beyond the watermark. Steps compare variables only in batches.
    """
    if len(rule.steps) != 2 or any(p.variable for s in rule.steps for p in s.where):
        raise ValueError("a stream takes rules of two steps without variables")
    keys = [k for k in rule.partition_by if k != "case_id"]
    sure = correlation.certain(rule)

    def side(k: int) -> DataFrame:
        rows = events.where(sure).where(rule.steps[k].static())
        return rows.select(F.col("ts").alias(f"ts{k}"), F.col("event_id").alias(f"id{k}"), *[F.col(key).alias(f"{key}{k}") for key in keys]).withWatermark(f"ts{k}", delay)

    on = [F.col(f"{k}0") == F.col(f"{k}1") for k in keys]
    on += [F.col("ts1") >= F.col("ts0"), F.col("ts1") < F.col("ts0") + F.expr(f"INTERVAL {rule.within + 1} MILLISECONDS"), F.struct(F.col("ts1").alias("t"), F.col("id1").alias("i")) > F.struct(F.col("ts0").alias("t"), F.col("id0").alias("i"))]
    found = side(0).join(side(1), functools.reduce(operator.and_, on))
    ordered = F.array("id0", "id1")
    return found.select(ids.match_id(F.lit(rule.rule_id), F.lit(rule.sha256), ordered).alias("match_id"), F.lit(rule.rule_id).alias("rule_id"), ordered.alias("ordered_event_ids"))
