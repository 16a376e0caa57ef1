"""Event windows: greedy, non-overlapping spike-to-barrier windows of each asset."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spikes(rows: DataFrame, level: float = 0.15, step: float = 0.08) -> DataFrame:
    """rows (asset, m, score) with delta (absolute change from the row before) and spike."""
    delta = F.abs(F.col("score") - F.lag("score").over(Window.partitionBy("asset").orderBy("m")))
    out = rows.withColumn("delta", F.coalesce(delta, F.lit(0.0)))
    return out.withColumn("spike", (F.abs("score") >= level) | (F.col("delta") >= step))


def candidate_windows(rows: DataFrame, longest: int = 1440, shortest: int = 60) -> DataFrame:
    """For each spike the window's end: the first row at or after it with a barrier within `longest` minutes, else the last row
    in reach; length and whether it is long enough to be accepted."""
    reach = Window.partitionBy("asset").orderBy("m").rangeBetween(0, longest)
    end = F.coalesce(F.min(F.when(F.coalesce(F.col("barrier"), F.lit("none")) != "none", F.col("m"))).over(reach), F.max("m").over(reach))
    hit = F.min(F.when(F.coalesce(F.col("barrier"), F.lit("none")) != "none", F.struct("m", "barrier"))).over(reach)
    out = rows.withColumns({"end_m": end, "outcome": F.coalesce(hit["barrier"], F.lit("timeout"))}).where("spike")
    return out.withColumn("accepted", F.col("end_m") - F.col("m") >= shortest)


def detect_events(rows: DataFrame, cooldown: int = 60, longest: int = 1440, shortest: int = 60) -> DataFrame:
    """(asset, start_m, end_m, outcome, trigger_score, trigger_delta): windows taken greedily in time, none within `cooldown`
    minutes of the last one's end. Candidates come from window functions over all rows; only the chain of accepted
    candidates, which depends on the one before, runs per asset."""

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        out, free = [], None
        for r in pdf.sort_values("m").itertuples(index=False):
            if free is None or r.m >= free:
                out.append(r)
                free = r.end_m + cooldown
        return pd.DataFrame([(r.asset, r.m, r.end_m, r.outcome, r.score, r.delta) for r in out], columns=["asset", "start_m", "end_m", "outcome", "trigger_score", "trigger_delta"])

    found = candidate_windows(spikes(rows), longest, shortest).where("accepted").select("asset", "m", "end_m", "outcome", "score", "delta")
    return found.groupBy("asset").applyInPandas(chain, "asset string, start_m long, end_m long, outcome string, trigger_score double, trigger_delta double")
