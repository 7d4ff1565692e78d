"""S3: the synthetic alloy table, one row per input key.

Draws are md5-derived uniforms of (key, seed, draw index), so a row gets
the same numbers wherever it is computed, and the normal noise uses the
Box-Muller transform. Formula as in the reference, including the constant
``+ noise_sigma`` shift added before the Gaussian noise.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathom.bundle import Bundle, DatasetRoles
from fathom.functions.hashing import uniform
from fathom.operators.prepare import SYNTHETIC_FEATURES, SYNTHETIC_TARGET, SYNTHETIC_UNITS

# Generator ranges and formula constants.
RANGES = {"Al_conc_wt_pct": (0.0, 6.0), "Ti_conc_wt_pct": (0.0, 4.0), "V_conc_wt_pct": (0.0, 3.0),
          "process_temperature_C": (200.0, 600.0), "process_time_h": (0.5, 8.0)}
BASE_HARDNESS = 150.0
COEFFS = {"Al_conc_wt_pct": 2.0, "Ti_conc_wt_pct": 3.0, "V_conc_wt_pct": 1.5, "process_temperature_C": 0.05}
TIME_LOG_COEFF = -10.0
TIME_EPS = 1e-9
SOURCE = "synthetic placeholder"
DESCRIPTION = ("Synthetic alloy dataset with composition, processing parameters, "
               "and Vickers hardness target, generated from a simple heuristic model "
               "plus Gaussian noise.")


def alloy_columns(key: Column, noise_sigma: float, seed: int) -> list[Column]:
    u = [uniform(key, f"|{seed}|{j}") for j in range(7)]
    feats = {}
    for j, name in enumerate(SYNTHETIC_FEATURES):
        lo, hi = RANGES[name]
        feats[name] = F.lit(lo) + F.lit(hi - lo) * u[j]
    z = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u[5])) * F.cos(F.lit(2 * math.pi) * u[6])
    hardness = F.lit(BASE_HARDNESS)
    for name, k in COEFFS.items():
        hardness = hardness + F.lit(k) * feats[name]
    hardness = (hardness + F.lit(TIME_LOG_COEFF) * F.ln(feats["process_time_h"] + F.lit(TIME_EPS))
                + F.lit(noise_sigma) + F.lit(noise_sigma) * z)
    return [feats[n].alias(n) for n in SYNTHETIC_FEATURES] + [hardness.alias(SYNTHETIC_TARGET)]


def synthetic_alloy(keys: DataFrame, key_col: str, noise_sigma: float = 5.0,
                    random_seed: int | None = None, keep_key: bool = False) -> Bundle:
    """One synthetic row per row of ``keys``. Unseeded -> a fresh seed per call."""
    seed = int(random_seed) if random_seed is not None else random.randrange(2 ** 31)
    key = F.col(key_col).cast("string")
    cols = ([F.col(key_col)] if keep_key else []) + alloy_columns(key, float(noise_sigma), seed)
    df = keys.select(cols)
    roles = DatasetRoles(SYNTHETIC_FEATURES, SYNTHETIC_TARGET, dict(SYNTHETIC_UNITS), SOURCE, DESCRIPTION)
    return Bundle(df, roles)


def synthetic_alloy_range(spark: SparkSession, n_samples: int = 200, noise_sigma: float = 5.0,
                          random_seed: int | None = None) -> Bundle:
    """The loader form of the reference: ``n_samples`` rows over ``spark.range``."""
    return synthetic_alloy(spark.range(int(n_samples)), "id", noise_sigma, random_seed)
