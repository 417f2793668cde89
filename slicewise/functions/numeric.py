"""Numeric columns: probabilities, rates, half precision, score buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10
OCTAVES = 150


def _fixed(c: Column, digits: int) -> Column:
    """Text of a finite double with fixed decimals: its exact binary value, halves to even.

    A built-in call, so that displayed values can be built on displayed values without
    the expression growing by powers. That call takes a lone 5 just beyond the last place
    (0.0005 to three) for an exact half where the binary value lies above it.
    """
    shown = F.call_function("format_number", c, F.lit("0." + "0" * digits if digits else "0"))
    lone = float(f"5e-{digits + 1}")
    up = f"{lone:.{digits}f}"
    return shown if float(up) == 0 else F.when(c == lone, up).when(c == -lone, f"-{up}").otherwise(shown)


def round_even(c: Column, digits: int) -> Column:
    """The double nearest to ``c`` rounded to ``digits`` decimals, on its exact binary value, halves to even."""
    return F.when(F.abs(c) < F.lit(float("inf")), _fixed(c, digits).cast("double") + F.lit(0.0)).otherwise(c)


def decimals(c: Column, digits: int, plus: bool = False) -> Column:
    """Text with fixed decimals, rounded on the exact binary value, halves to even; ``inf`` and ``nan`` as such."""
    sign = F.when(c < 0, "-").otherwise("+" if plus else "")
    shown = F.when(F.abs(c) == float("inf"), "inf").otherwise(_fixed(F.abs(c), digits))
    return F.when(F.isnan(c), "nan").otherwise(F.concat(sign, shown))


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def all_finite(cols: list[Column]) -> Column:
    """True when no value is null, NaN or infinite (NaN sorts above infinity)."""
    return reduce(lambda a, b: a & b, [F.abs(c) < F.lit(float("inf")) for c in cols])


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def half(c: Column) -> Column:
    """Round a value in [0, 65504] to half precision (11 significant bits, halves to even)."""
    exponent = F.greatest(F.floor(F.log2(c)), F.lit(-14)).cast("double")
    unit = F.pow(F.lit(2.0), exponent - 10)
    return F.when(c <= 0, F.lit(0.0)).otherwise(F.rint(c / unit) * unit)


def score_bucket(p: Column, steps: int = 1024) -> Column:
    """A bucket number that never decreases with ``p`` in [0, 1].

    Every binary octave of p (below one half) or of 1 - p (above) is cut into
    ``steps`` equal parts, 150 octaves a side (all of single precision), so there
    are at most 300 * steps buckets. A bucket of single-precision scores holds at
    most 2^23 / steps distinct values, however the scores are spread.
    """
    def code(x: Column) -> Column:
        exponent = F.greatest(F.floor(F.log2(x)), F.lit(-OCTAVES)).cast("double")
        inside = F.floor(x / F.pow(F.lit(2.0), exponent) * steps)
        return ((exponent + OCTAVES) * steps + inside).cast("int")

    top = OCTAVES * steps
    low_side = F.when(p <= 0, F.lit(0)).otherwise(code(p))
    high_side = 2 * top - F.when(p >= 1, F.lit(0)).otherwise(code(F.lit(1.0) - p))
    return F.when(p < 0.5, low_side).otherwise(high_side)


def rates(tp: Column, fp: Column, fn: Column, tn: Column, style: str = "evaluation") -> dict[str, Column]:
    """Sensitivity, specificity, PPV, NPV, LR+ and LR- of a confusion matrix.

    ``evaluation`` caps LR+ (infinite from 1e6 or a false-positive rate of at
    most 1e-10) and rounds; ``training`` leaves the values as they are.
    """
    sens = tp / (tp + fn + F.lit(EPS))
    spec = tn / (tn + fp + F.lit(EPS))
    ppv = tp / (tp + fp + F.lit(EPS))
    npv = tn / (tn + fn + F.lit(EPS))
    fpr = F.lit(1.0) - spec
    ratio = sens / (fpr + F.lit(EPS))
    inf = F.lit(float("inf"))
    lr_neg = (F.lit(1.0) - sens) / (spec + F.lit(EPS))
    if style == "training":
        lr_pos = F.when(fpr > 0, ratio).otherwise(inf)
        return {"sensitivity": sens, "specificity": spec, "ppv": ppv, "npv": npv,
                "lr_positive": lr_pos, "lr_negative": lr_neg}
    lr_pos = F.when((fpr > F.lit(EPS)) & (ratio < F.lit(1e6)), F.round(ratio, 4)).otherwise(inf)
    return {"sensitivity": F.round(sens, 6), "specificity": F.round(spec, 6),
            "ppv": F.round(ppv, 6), "npv": F.round(npv, 6),
            "lr_positive": lr_pos, "lr_negative": F.round(lr_neg, 6)}


def shuffle_key(c: Column, seed: int) -> Column:
    """A reproducible random-looking order: the md5 of id and seed."""
    return F.md5(F.concat(c.cast("string"), F.lit(str(seed))))


def unit_draw(c: Column, salt: str) -> Column:
    """A reproducible number in [0, 1) per row: the first 32 bits of a md5."""
    hex8 = F.substring(F.md5(F.concat(c.cast("string"), F.lit(salt))), 1, 8)
    return F.conv(hex8, 16, 10).cast("double") / F.lit(4294967296.0)
