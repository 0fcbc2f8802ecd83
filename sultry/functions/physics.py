"""Moist-air temperature physics as column functions.

Saturation pressures and input handling are native expressions. Only the root search of the wet bulb is a pandas
UDF over Arrow batches: bracketed inverse quadratic steps on whole numpy vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Constants of moist air (Romps 2026).
TRIPLE_K = 273.16
TRIPLE_PA = 611.65
E0V = 2.374e6
E0S = 0.3337e6
RGASA = 287.04
RGASV = 461.0
CVA = 719.0
CVV = 1418.0
CVL = 4119.0
CVS = 1861.0
CPA = CVA + RGASA
CPV = CVV + RGASV

LIQUID_POWER = (CPV - CVL) / RGASV
LIQUID_RATE = (E0V - (CVV - CVL) * TRIPLE_K) / RGASV
ICE_POWER = (CPV - CVS) / RGASV
ICE_RATE = (E0V + E0S - (CVV - CVS) * TRIPLE_K) / RGASV
TOP_K = 700.0


def _esat(t: Column, power: float, rate: float) -> Column:
    warm = F.lit(TRIPLE_PA) * F.pow(t / TRIPLE_K, F.lit(power)) * F.exp(F.lit(rate) * (F.lit(1 / TRIPLE_K) - F.lit(1.0) / F.when(t > 0, t)))
    return F.when(t <= 0, F.lit(0.0)).otherwise(warm)


def esat_liquid(t: Column) -> Column:
    """Saturation vapour pressure over liquid water in Pa at t kelvin; 0 at or below 0 K."""
    return _esat(t, LIQUID_POWER, LIQUID_RATE)


def esat_ice(t: Column) -> Column:
    """Saturation vapour pressure over ice in Pa at t kelvin; 0 at or below 0 K."""
    return _esat(t, ICE_POWER, ICE_RATE)


def _np_esat(t: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        e = TRIPLE_PA * (t / TRIPLE_K) ** LIQUID_POWER * np.exp(LIQUID_RATE * (1 / TRIPLE_K - 1 / t))
    return np.where(t > 0, e, 0.0)


def _root(f, low: np.ndarray, high: np.ndarray, close: float = 1e-10, most: int = 80) -> np.ndarray:
    """Root of f between low and high, where its signs differ, by Chandrupatla's method: an inverse quadratic step where the last three points
    allow it, else a bisection, so that the bracket always shrinks; elements that have settled stay. Where the signs agree the result means nothing."""
    new, old = high.copy(), low.copy()  # the last point, and the one across the root from it
    f_new, f_old = f(new), f(old)
    part, third, f_third = np.full(len(new), 0.5), old, f_old
    best = new
    for _ in range(most):
        x = new + part * (old - new)
        fx = f(x)
        same = np.sign(fx) == np.sign(f_new)
        third, f_third = np.where(same, new, old), np.where(same, f_new, f_old)
        old, f_old = np.where(same, old, new), np.where(same, f_old, f_new)
        new, f_new = x, fx
        best = np.where(np.abs(f_new) < np.abs(f_old), new, old)
        with np.errstate(divide="ignore", invalid="ignore"):
            least = close / np.abs(old - new)
            if not ((least <= 0.5) & (f_new != 0)).any():
                break
            xi, phi = (new - old) / (third - old), (f_new - f_old) / (f_third - f_old)
            step = f_new / (f_old - f_new) * f_third / (f_old - f_third) + (third - new) / (old - new) * f_new / (f_third - f_new) * f_old / (f_third - f_old)
            part = np.where((phi**2 < xi) & ((1 - phi) ** 2 < 1 - xi), step, 0.5)
        part = np.clip(np.nan_to_num(part, nan=0.5), np.minimum(least, 0.5), np.maximum(1 - least, 0.5))
    return best


def _np_tsat(e: np.ndarray) -> np.ndarray:
    """Newton's method on the logarithm of the pressure as a function of 1/T, which is nearly a straight line."""
    with np.errstate(divide="ignore", invalid="ignore"):
        goal = np.log(e / TRIPLE_PA)
        u = np.clip(1 / TRIPLE_K - goal / LIQUID_RATE, 1 / TOP_K, 1.0)
        for _ in range(10):
            miss = -LIQUID_POWER * np.log(u * TRIPLE_K) + LIQUID_RATE * (1 / TRIPLE_K - u) - goal
            u = np.clip(u + miss / (LIQUID_POWER / u + LIQUID_RATE), 1 / TOP_K, 1.0)
    bad = ~(e >= 0) | (e > _np_esat(np.array([TOP_K]))[0])
    return np.where(bad, np.nan, np.where(e == 0, 0.0, 1 / u))


def _tsat(e: pd.Series) -> pd.Series:
    return pd.Series(_np_tsat(e.to_numpy(dtype=float, na_value=np.nan)))


def _wetbulb(p: pd.Series, t: pd.Series, e: pd.Series) -> pd.Series:
    p, t, e = (x.to_numpy(dtype=float, na_value=np.nan) for x in (p, t, e))
    ok = np.isfinite(p) & np.isfinite(t) & np.isfinite(e) & (p > 0) & (t > 0) & (e >= 0) & (e <= p)
    out = np.full(len(p), np.nan)
    p, t, e = p[ok], t[ok], e[ok]
    qv = RGASA * e / (RGASV * p - RGASV * e + RGASA * e)
    cp = (1 - qv) * CPA + qv * CPV

    def residual(w: np.ndarray) -> np.ndarray:
        es = _np_esat(w)
        with np.errstate(divide="ignore", invalid="ignore"):
            qs = np.where(w <= 0, 0.0, np.where(es > p, es / p, 1 / (RGASV * p / (RGASA * es) - RGASV / RGASA + 1)))
        return cp * (w - t) * (1 - qs) + (qs - qv) * (E0V + (CVV - CVL) * (w - TRIPLE_K) + RGASV * w)

    low = _np_tsat(e)
    high = np.minimum(t, _np_tsat(p))
    at_low, at_high = residual(low), residual(high)
    root = _root(residual, low, high)
    out[ok] = np.where(at_low == 0, low, np.where((at_high == 0) | (at_low * at_high > 0) | (low > high), high, root))
    return pd.Series(out)


def _null_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def tsat_liquid(e: Column) -> Column:
    """Temperature in K at which liquid saturation pressure is e Pa: 0 for 0, null outside [0, esat(700 K)]."""
    return _null_nan(F.pandas_udf(_tsat, "double")(e.cast("double")))


def wetbulb_romps_vapor(p: Column, t: Column, e: Column) -> Column:
    """Thermodynamic wet bulb in K from pressure (Pa), air temperature (K) and vapour pressure (Pa); null where the
    inputs are missing, not finite, not positive or e > p. The residual's root lies between the
    saturation temperature of e and the lesser of t and that of p; the lower bound counts if its residual is 0, the
    upper if its own is 0 or both have one sign, or where the air is oversaturated."""
    return F.pandas_udf(_wetbulb, "double")(p.cast("double"), t.cast("double"), e.cast("double"))


def wetbulb_romps_rh(p: Column, t: Column, rh: Column) -> Column:
    """Wet bulb in K from relative humidity 0..1, over liquid above the triple point, else over ice; null outside."""
    e = rh * F.when(t > TRIPLE_K, esat_liquid(t)).otherwise(esat_ice(t))
    return _null_nan(wetbulb_romps_vapor(p, t, F.when(rh.between(0, 1), e)))


def wetbulb_romps_dewpoint(p: Column, t: Column, td: Column) -> Column:
    """Wet bulb in K from a dew point, which counts as at most the air temperature."""
    return _null_nan(wetbulb_romps_vapor(p, t, esat_liquid(F.when(td.isNotNull() & t.isNotNull(), F.least(td, t)))))


def _stull(t: Column, rh: Column) -> Column:
    return t * F.atan(0.151977 * F.sqrt(rh + 8.313659)) + F.atan(t + rh) - F.atan(rh - 1.676331) + 0.00391838 * F.pow(rh, F.lit(1.5)) * F.atan(0.023101 * rh) - 4.686035


def half_up(x: Column, digits: int = 2) -> Column:
    """Rounds half towards plus infinity, unlike round(), which rounds half away from zero."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def wetbulb_stull_strict(t: Column, rh: Column) -> Column:
    """Stull's wet bulb in degrees C to two digits; null outside -20..50 degrees and 5..99 per cent."""
    return F.when(t.between(-20, 50) & rh.between(5, 99), half_up(_stull(t, rh)))


def wetbulb_stull_clamped(t: Column, rh: Column) -> Column:
    """Stull's wet bulb with clamped inputs; saturated air has its own temperature."""
    clamp = lambda x, a, b: F.least(F.greatest(x, F.lit(a)), F.lit(b))
    return F.when(rh >= 100, half_up(t)).otherwise(half_up(_stull(clamp(t, -20.0, 50.0), clamp(rh, 5.0, 99.0))))


def wetbulb_stull_browser(t: Column, rh: Column) -> Column:
    """The clamped form without the saturated case."""
    clamp = lambda x, a, b: F.least(F.greatest(x, F.lit(a)), F.lit(b))
    return half_up(_stull(clamp(t, -20.0, 50.0), clamp(rh, 5.0, 99.0)))


def kelvin_to_celsius(k: Column) -> Column:
    return half_up(k - 273.15)
