"""Column names and types of clouds and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSITION = "id long, px float, py float, pz float"
POSITION_NORMAL = POSITION + ", nx float, ny float, nz float"
POINT = POSITION_NORMAL + ", red smallint, green smallint, blue smallint"
XYZ, NORMAL, COLOR = ["px", "py", "pz"], ["nx", "ny", "nz"], ["red", "green", "blue"]


def from_table(df: DataFrame, **columns: str) -> DataFrame:
    """A cloud from any table: id, px, py, pz and optionally nx, ny, nz, red, green, blue as SQL expressions over df.

    Missing or null normals are zero normals, missing or null colours are 0; positions stay as they are.
    """
    out = [F.expr(columns["id"]).cast("long").alias("id"), *(F.expr(columns[c]).cast("float").alias(c) for c in XYZ)]
    out += [F.coalesce(F.expr(columns[c]).cast("float"), F.lit(0.0).cast("float")).alias(c) if c in columns else F.lit(0.0).cast("float").alias(c) for c in NORMAL]
    out += [F.coalesce(F.expr(columns[c]).cast("smallint"), F.lit(0).cast("smallint")).alias(c) if c in columns else F.lit(0).cast("smallint").alias(c) for c in COLOR]
    return df.select(out)
