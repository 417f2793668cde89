"""What a call means at a given prevalence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise import constants as K
from slicewise.functions import numeric as N


def metrics_at_prevalence(df: DataFrame, prevalence: Column, sensitivity: Column | float = K.DEFAULT_SENSITIVITY,
                          specificity: Column | float = K.DEFAULT_SPECIFICITY, n_cases: int = 1000,
                          lr_positive: Column | None = None, lr_negative: Column | None = None) -> DataFrame:
    """Adds counts per ``n_cases``, PPV, NPV, pain index (FP per TP) and likelihood ratios.

    All figures round half to even on the binary value; the likelihood ratios are derived unless given.
    """
    sens = F.lit(sensitivity) if not isinstance(sensitivity, Column) else sensitivity
    spec = F.lit(specificity) if not isinstance(specificity, Column) else specificity
    cases = F.lit(float(n_cases))
    n_pos = F.rint(cases * prevalence)
    n_neg = cases - n_pos
    staged = df.withColumns({"_n_pos": n_pos, "_tp": F.rint(n_pos * sens), "_fp": F.rint(n_neg * (F.lit(1.0) - spec))})
    tp, fp = F.col("_tp"), F.col("_fp")
    fn, tn = F.col("_n_pos") - tp, cases - F.col("_n_pos") - fp
    lr_pos = lr_positive if lr_positive is not None else sens / F.greatest(F.lit(1.0) - spec, F.lit(1e-10))
    lr_neg = lr_negative if lr_negative is not None else (F.lit(1.0) - sens) / F.greatest(spec, F.lit(1e-10))
    return staged.select(
        *df.columns,
        tp.cast("bigint").alias("tp"), fn.cast("bigint").alias("fn"),
        fp.cast("bigint").alias("fp"), tn.cast("bigint").alias("tn"),
        N.round_even(F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), 4).alias("ppv"),
        N.round_even(F.when(tn + fn > 0, tn / (tn + fn)).otherwise(0.0), 4).alias("npv"),
        F.when(tp > 0, N.round_even(fp / tp, 2)).otherwise(F.lit(float("inf"))).alias("pain_index"),
        N.round_even(lr_pos, 2).alias("lr_positive"), N.round_even(lr_neg, 4).alias("lr_negative"))
