"""Learning rates and weight decay by step and batch size, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def batch_scale(effective: int, reference: int | None) -> float:
    """How much larger the effective batch is than the one that the rate was chosen for; that one is at least 1."""
    return max(effective / max(reference if reference is not None else effective, 1), 1e-8)


def learning_rate(step: Column, peak: float, warmup: int, scale: float = 1.0) -> Column:
    """Rises in proportion to the step for `warmup` steps to peak times scale, then falls with the step's root; 1e-8 at least. Steps 0 and 1 are alike; without warm-up it only falls."""
    s = F.greatest(step, F.lit(1)).cast("double")
    if warmup <= 0:
        return F.greatest(F.lit(peak * scale) / F.sqrt(s), F.lit(1e-8))
    w = F.lit(float(warmup))
    return F.greatest(F.lit(peak * scale) * F.sqrt(w) * F.least(1 / F.sqrt(s), s * F.pow(w, F.lit(-1.5))), F.lit(1e-8))


def weight_decay(decay: float, scale: float, mode: str) -> float:
    """Decay for a batch scaled by `scale`: as it is (none), over the scale's root (inv_sqrt), or over the scale (inv)."""
    factors = {"none": 1.0, "inv_sqrt": scale**-0.5, "inv": 1 / scale}
    if mode not in factors:
        raise ValueError(f"unknown weight decay mode {mode}")
    return decay * factors[mode]
