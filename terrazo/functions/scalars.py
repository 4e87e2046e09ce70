"""Row-wise functions: radar power, scaling, flags, class evidence. All are built-in column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_db(power: Column) -> Column:
    """10 log10 of positive power; else null."""
    return F.when(power > 0, 10 * F.log10(power))


def beta0(re: Column, im: Column, scale: Column | float) -> Column:
    return (F.lit(scale) if not isinstance(scale, Column) else scale) * (re * re + im * im)


def gamma0(beta: Column, incidence_deg: Column) -> Column:
    """Sigma0 is beta0 sin(incidence), gamma0 is sigma0 over cos(incidence)."""
    a = F.radians(incidence_deg)
    return beta * F.sin(a) / F.cos(a)


def clip(c: Column, low: float, high: float) -> Column:
    """Null stays null, unlike with greatest and least alone."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def clip_scale(c: Column, low: float = 3.0, high: float = 15.0) -> Column:
    """Position between two bounds, 0 to 1; missing counts as 0."""
    return F.coalesce(clip((c - low) / (high - low), 0.0, 1.0), F.lit(0.0))


def nan_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(float("nan")))


def nan_mean(*cs: Column) -> Column:
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cs])
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cs])
    return F.when(n > 0, total / n)


def normalised_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def qc_flag(n_dates: Column, all_dates: int = 4) -> Column:
    return F.when(n_dates >= all_dates, "ok").when(n_dates == 0, "no_sar_data").otherwise("partial")


def provenance(flagged: Column, imputed: Column) -> Column:
    return F.when(flagged, "rfi_flagged").when(imputed, "imputed_spatial_same_crop").otherwise("measured")


def alias_normalise(text: Column, aliases: list[tuple[str, str]], other: str = "Other") -> Column:
    """The class of the first alias, in list order, that the trimmed lower-cased text contains; blank is null."""
    t = F.lower(F.trim(text))
    out = F.when(t.isNull() | (t == ""), F.lit(None).cast("string"))
    for needle, to in aliases:
        out = out.when(F.contains(t, F.lit(needle)), to)
    return out.otherwise(other)


def softmax(scores: Column) -> Column:
    """Of an array; what isn't a number scores 0."""
    clean = F.transform(scores, lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x))
    top = F.array_max(clean)
    e = F.transform(clean, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def temperature(p: Column, t: float) -> Column:
    q = F.transform(p, lambda x: F.pow(x, F.lit(1.0 / t)))
    return F.transform(q, lambda x: x / F.aggregate(q, F.lit(0.0), lambda a, b: a + b))


def entropy_norm(p: Column, k: int) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.greatest(x, F.lit(1e-12)) * F.log(F.greatest(x, F.lit(1e-12)))) / math.log(k)


def argmax_label(p: Column, labels: list[str]) -> Column:
    """The first label with the largest value."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(p, F.array_max(p)).cast("int"))


def normal_cdf(z: Column) -> Column:
    """A rational approximation of the normal distribution function, within 1.5e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, 1 - half).otherwise(half)


def normal_cdf_sql(z: str) -> str:
    """The same approximation as SQL text."""
    x = f"(abs({z}) / sqrt(2))"
    t = f"(1 / (1 + 0.3275911 * {x}))"
    poly = f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))))"
    return f"CASE WHEN {z} >= 0 THEN 1 - 0.5 * {poly} * exp(-{x} * {x}) ELSE 0.5 * {poly} * exp(-{x} * {x}) END"


def kdist_texture(cv: Column, n: Column, looks: float) -> Column:
    return F.when(n >= 12, F.greatest(F.lit(0.0), (1 + cv * cv) / (1 + 1.0 / looks) - 1))


def enl_cv(cv: Column, looks: float) -> Column:
    return F.sqrt(F.greatest(cv * cv - 1.0 / looks, F.lit(0.0)))


def wcm_forward(v: Column, a: float, b: float, soil_lin: Column, incidence_deg: float) -> Column:
    """Water-cloud model: vegetation term plus attenuated soil, in linear power."""
    c = math.cos(math.radians(incidence_deg))
    tau = F.exp(-2 * b * v / c)
    return a * v * c * (1 - tau) + soil_lin * tau
