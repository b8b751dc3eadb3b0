"""Rule-based choice of a renewable source for one month of one place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from voltmes.functions.numbers import nan_to_null

# Fixed values.
WIND = "Eólica"
HYDRO = "Hidrelétrica / Pequenas Centrais Hidrelétricas (PCH)"
SOLAR = "Solar fotovoltaica"
DEFAULT = "Solar fotovoltaica (padrão)"


@dataclass(frozen=True)
class Thresholds:
    # Fixed values.
    wind: float = 6.0
    wet: float = 200.0
    dry: float = 100.0
    warm: float = 22.0
    hydro_regions: tuple[str, ...] = ("norte", "nordeste")


def recommend(region: Column, rain: Column, temperature: Column, wind: Column, rules: Thresholds = Thresholds()) -> Column:
    """All matching sources joined by ``; ``, or the default source; a missing reading matches no rule."""
    rain, temperature, wind = (nan_to_null(c.cast("double")) for c in (rain, temperature, wind))
    wet = (rain >= rules.wet) & F.lower(region).isin(*rules.hydro_regions)
    sunny = (rain < rules.dry) & (temperature >= rules.warm)
    advice = F.concat_ws("; ", F.when(wind >= rules.wind, WIND), F.when(wet, HYDRO), F.when(sunny, SOLAR))
    return F.when(advice == "", DEFAULT).otherwise(advice)
