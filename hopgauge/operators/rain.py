"""Specific attenuation by rain, k R^a in dB/km for a rain rate R in mm/h, by the published regression for 1 to 1000 GHz (ITU-R P.838-3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms (height, centre, width) of the sums over the logarithm of the frequency in GHz, slope and offset, for log k and for a, by polarization.
K_H = ((-5.33980, -0.10008, 1.13098), (-0.35351, 1.26970, 0.45400), (-0.23789, 0.86036, 0.15354), (-0.94158, 0.64552, 0.16817)), -0.18961, 0.71147
K_V = ((-3.80595, 0.56934, 0.81061), (-3.44965, -0.22911, 0.51059), (-0.39902, 0.73042, 0.11899), (0.50167, 1.07319, 0.27195)), -0.16398, 0.63297
A_H = ((-0.14318, 1.82442, -0.55187), (0.29591, 0.77564, 0.19822), (0.32177, 0.63773, 0.13164), (-5.37610, -0.96230, 1.47828), (16.1721, -3.29980, 3.43990)), 0.67849, -1.95537
A_V = ((-0.07771, 2.33840, -0.76284), (0.56727, 0.95545, 0.54039), (-0.20238, 1.14520, 0.26809), (-48.2991, 0.791669, 0.116226), (48.5833, 0.791459, 0.116479)), -0.053739, 0.83433


def _curve(log_f: Column, curve: tuple) -> Column:
    terms, slope, offset = curve
    total = log_f * slope + offset
    for height, centre, width in terms:
        total = total + height * F.exp(-F.pow((log_f - centre) / width, F.lit(2.0)))
    return total


def k_and_a(frequency_ghz: Column, polarization: Column, elevation: Column | None = None) -> tuple[Column, Column]:
    """k and the exponent a, for H, V (by first letter, in any case) or a tilt in degrees (as text, 45 for circular); NULL for other polarizations and beyond 1 to 1000 GHz.

    elevation: of the path in degrees (none: level, as for links on the ground).
    """
    f = F.when(frequency_ghz.between(1, 1000), frequency_ghz.cast("double"))
    log_f = F.log10(f)
    k_h, k_v = F.pow(F.lit(10.0), _curve(log_f, K_H)), F.pow(F.lit(10.0), _curve(log_f, K_V))
    a_h, a_v = _curve(log_f, A_H), _curve(log_f, A_V)
    first = F.upper(F.substring(polarization, 1, 1))
    tilt = F.when(first == "H", 0.0).when(first == "V", 90.0).otherwise(polarization.try_cast("double"))
    level = F.lit(1.0) if elevation is None else F.pow(F.cos(F.radians(elevation)), F.lit(2.0))
    turn = level * F.cos(2 * F.radians(tilt))
    k = (k_h + k_v + (k_h - k_v) * turn) / 2
    a = (k_h * a_h + k_v * a_v + (k_h * a_h - k_v * a_v) * turn) / (2 * k)
    # H and V of a level path are the curves themselves, to the last digit
    pure = lambda h, v, mixed: F.when(tilt == 0.0, h).when(tilt == 90.0, v).otherwise(mixed) if elevation is None else mixed
    return pure(k_h, k_v, k), pure(a_h, a_v, a)


def regression(frequency_ghz: Column, polarization: Column) -> Column:
    """k, as the coefficient of ``quality.run``."""
    return k_and_a(frequency_ghz, polarization)[0]


def rain_rate(attenuation_db: Column, length_km: Column, frequency_ghz: Column, polarization: Column) -> Column:
    """Rain rate in mm/h that gives a path's attenuation; 0 for none or less, NULL without a length."""
    k, a = k_and_a(frequency_ghz, polarization)
    specific = F.try_divide(attenuation_db.cast("double"), F.when(length_km > 0, length_km.cast("double")))
    return F.when(specific <= 0, 0.0).otherwise(F.pow(specific / k, 1 / a))
