"""Schedules, losses and sampling filters as expressions and small aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORED = -100


def learning_rate(step: Column, high: float, low: float, warmup: int, total: int) -> Column:
    """Linear warm-up, then a cosine to low at the last step."""
    if warmup < 0 or total <= warmup or not 0 <= low <= high:
        raise ValueError("need 0 <= warmup < total and 0 <= low <= high")
    share = (step - warmup) / max(1, total - 1 - warmup)
    return F.when(step < warmup, high * (step + 1) / max(1, warmup)).when(step >= total - 1, F.lit(low)).otherwise(low + 0.5 * (1 + F.cos(F.lit(math.pi) * share)) * (high - low))


def training_plan(tokens: int, batch: int, length: int, tokens_per_update: int, parameters: int) -> dict[str, float]:
    """accumulation, updates, passes and tokens per parameter."""
    if tokens_per_update % (batch * length):
        raise ValueError("tokens per update must be a multiple of a batch")
    updates = math.ceil(tokens / tokens_per_update)
    return {"accumulation": tokens_per_update // (batch * length), "updates": updates, "passes": updates * tokens_per_update / tokens, "tokens_per_parameter": tokens / parameters}


def dtype_for(vocab_size: int, dtype: str = "auto") -> str:
    """uint16 if every id fits, else uint32; an explicit type must fit."""
    wanted = ("uint16" if vocab_size <= 65536 else "uint32") if dtype == "auto" else dtype
    if wanted not in ("uint16", "uint32") or vocab_size - 1 >= 2 ** int(wanted[4:]):
        raise ValueError(f"{vocab_size} ids don't fit {wanted}")
    return wanted


def weighted_loss(label: Column, loss: Column, end: int, end_weight: float) -> tuple[Column, Column]:
    """Aggregates: the weighted sum of losses and the sum of weights."""
    w = F.when(label == IGNORED, 0.0).when(label == end, end_weight).otherwise(1.0)
    return F.sum(loss * w), F.sum(w)


def sequence_log_prob(label: Column, log_prob: Column, mean: bool = False) -> Column:
    """Aggregate: log probability of the labels that count; their mean if asked for."""
    used = label != IGNORED
    total = F.sum(F.when(used, log_prob).otherwise(0.0))
    return total / F.greatest(F.count_if(used), F.lit(1)) if mean else total


def dpo_loss(pc: Column, pr: Column, rc: Column, rr: Column, beta: float) -> Column:
    """-log sigmoid of beta times the preference's gain, stable for either sign."""
    x = beta * ((pc - pr) - (rc - rr))
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))


def top_p(df: DataFrame, row: str, token: str, logit: str, p: float, temperature: float = 1.0) -> DataFrame:
    """df with prob and kept: the most probable tokens of a row until their sum passes p, that token included."""
    scaled = F.col(logit) / max(temperature, 1e-5)
    per_row = Window.partitionBy(row)
    df = df.withColumn("__e", F.exp(scaled - F.max(scaled).over(per_row)))
    df = df.withColumn("prob", F.col("__e") / F.sum("__e").over(per_row)).drop("__e")
    before = F.coalesce(F.sum("prob").over(per_row.orderBy(F.desc("prob"), token).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return df.withColumn("kept", F.lit(True) if p >= 1 else before <= p)


def draws(df: DataFrame, row: str, token: str, seed: int) -> DataFrame:
    """One token a row, by its prob among those kept, from a number that the seed and row decide."""
    kept = df.where("kept")
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 2**32
    w = Window.partitionBy(row).orderBy(token)
    upto = F.sum("prob").over(w) / F.sum("prob").over(Window.partitionBy(row))
    drawn = F.min_by(token, F.when(F.col("__upto") > u, F.col("__upto")))
    last = F.max_by(token, F.struct("__upto", token))  # where rounding leaves the whole sum below the number
    return kept.withColumn("__upto", upto).groupBy(row).agg(F.when(F.max("__upto") > F.first(u), drawn).otherwise(last).alias(token))
