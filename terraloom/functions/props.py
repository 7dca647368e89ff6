"""Physical properties of features as vectors and as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Properties, in the order of the vector, and the scale of each.
PROP_KEYS = {
    "elevation_m": 1 / 6000, "relief_m": 1 / 3500, "hardness": 1 / 10, "rainfall_mm": 1 / 1200,
    "uplift_mm_yr": 1 / 8, "roughness": 1.0, "vp_ms": 1 / 7000, "perm_mD": 1 / 1500,
}
STANDS_IN = "permeability_mD"  #: for any property that is missing


def vector(props: Column) -> Column:
    """The scaled properties of a map of strings or numbers to numbers, each held between 0 and 2.

    Permeability falls back on transmissivity; what is missing then falls back
    on ``STANDS_IN``, and on 0.
    """

    def one(key: str, scale: float) -> Column:
        own = [props[key], *([props["transmissivity_mDm"]] if key == "perm_mD" else []), props[STANDS_IN]]
        value = F.coalesce(*[v.try_cast("double") for v in own], F.lit(0.0)) * scale
        return F.least(F.greatest(value, F.lit(0.0)), F.lit(2.0))

    return F.array(*[one(k, s) for k, s in PROP_KEYS.items()])


def feature_text(name: Column, kind: Column, props: Column) -> Column:
    """What a feature is known by in text: its name, kind and properties."""
    listed = F.array_join(F.transform(F.map_entries(props), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ", ")
    return F.concat(name, F.lit(" ("), kind, F.lit("). properties: "), F.coalesce(listed, F.lit("")))
