"""Row-wise operators: filters, projections, maps and keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.operators.ranking import ranked
from pointweave.schema import NORMAL, XYZ
from pointweave.shared import looked_up


def dbl(name: str) -> Column:
    return F.col(name).cast("double")


def squared_norm() -> Column:
    return dbl("nx") * dbl("nx") + dbl("ny") * dbl("ny") + dbl("nz") * dbl("nz")


def keep(cloud: DataFrame, condition: Column) -> DataFrame:
    return cloud.where(condition)


def mapped(cloud: DataFrame, **columns: Column) -> DataFrame:
    """Columns changed row by row, by expressions over the row."""
    return cloud.withColumns(columns)


def batched(cloud: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, prepare: Callable[[], None] | None = None) -> DataFrame:
    """work on Arrow batches, in parallel; prepare runs once in each task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if prepare is not None:
            prepare()
        yield from map(work, parts)

    return cloud.mapInPandas(run, schema)


def valid_normals(cloud: DataFrame) -> DataFrame:
    """Points whose normal's squared length is over one half; NaN is no valid normal."""
    n2 = squared_norm()
    return cloud.where((n2 > 0.5) & ~F.isnan(n2))


def narrowed(cloud: DataFrame, columns: list[str]) -> DataFrame:
    return cloud.select(columns)


def normalized(cloud: DataFrame) -> DataFrame:
    """Normals of length 1 (as double); zero, NaN and null normals stay."""
    n = F.sqrt(squared_norm())
    sized = (n > 0) & ~F.isnan(n)
    return cloud.withColumns({c: F.when(sized, dbl(c) / n).otherwise(dbl(c)) for c in NORMAL})


def moved(cloud: DataFrame, by: tuple[float, float, float]) -> DataFrame:
    """Adds to positions only."""
    return cloud.withColumns({c: dbl(c) + F.lit(float(d)) for c, d in zip(XYZ, by, strict=True)})


def transformed(cloud: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """matrix times position and matrix times normal."""

    def rows(names: list[str]) -> dict[str, Column]:
        return {c: F.lit(float(m[0])) * dbl(names[0]) + F.lit(float(m[1])) * dbl(names[1]) + F.lit(float(m[2])) * dbl(names[2]) for c, m in zip(names, matrix, strict=True)}

    return cloud.withColumns(rows(XYZ) | rows(NORMAL))


def randomized(cloud: DataFrame, seed: int = 0) -> DataFrame:
    """Each normal's sign by a coin that depends on id and seed only."""
    sign = F.when(F.xxhash64(F.col("id"), F.lit(seed)).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
    return cloud.withColumns({c: dbl(c) * sign for c in NORMAL})


def signed(cloud: DataFrame, solution: DataFrame) -> DataFrame:
    """Normals times the sign of their node (columns node, sign, component); points without a node keep theirs, and are their own component."""
    own = solution.select(F.col("node").alias("id"), "sign", "component")
    joined = cloud.join(own, "id", "left").withColumns({c: dbl(c) * F.coalesce("sign", F.lit(1)) for c in NORMAL})
    return joined.withColumn("component", F.coalesce("component", "id")).drop("sign")


def segment_color(segment: Column) -> dict[str, Column]:
    """A segment's colour: hue (3 * segment mod 13) / 13, full saturation, value 1 for odd segments and 1/2 for even ones."""
    hue = F.pmod(segment * 3, F.lit(13)).cast("double") / F.lit(13.0) * F.lit(6.0)
    value = F.lit(0.5) + F.lit(0.5) * F.pmod(segment, F.lit(2)).cast("double")

    def channel(shift: float) -> Column:
        # how far the hue is from the channel's own, on a circle of 6
        far = F.abs(F.pmod(hue - F.lit(shift) + F.lit(3.0), F.lit(6.0)) - F.lit(3.0))
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(2.0) - far)) * value * F.lit(255.0)).cast("int")

    return {"red": channel(0.0), "green": channel(2.0), "blue": channel(4.0)}


def grid_cells(cloud: DataFrame, cell: float, y_min: float, z_min: float, y_max: float) -> DataFrame:
    """Adds cy, cz (cells of the y-z grid) and cell_id = cy + cells along y * cz."""
    along_y = int((y_max - y_min) // cell) + 1
    cy = F.floor((dbl("py") - F.lit(float(y_min))) / F.lit(float(cell)))
    cz = F.floor((dbl("pz") - F.lit(float(z_min))) / F.lit(float(cell)))
    return cloud.withColumns({"cy": cy, "cz": cz, "cell_id": cy + F.lit(along_y) * cz})


def spread_bits(x: Column) -> Column:
    """The low 16 bits of x, moved to the even places."""
    x = x.cast("long").bitwiseAND(F.lit(0xFFFF))
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(u: Column, v: Column) -> Column:
    """u in the even bits, v in the odd bits."""
    return spread_bits(u).bitwiseOR(F.shiftleft(spread_bits(v), 1))


def binned_morton(y: Column, z: Column, y_min: float, z_min: float, cell: float) -> Column:
    return morton(((y - F.lit(float(y_min))) / F.lit(float(cell))).cast("long"), ((z - F.lit(float(z_min))) / F.lit(float(cell))).cast("long"))


def morton_sorted(cloud: DataFrame, slice_key: Column, y_min: float, z_min: float, cell: float) -> DataFrame:
    """Columns slice, morton and nth: a point's place, from 1, in its slice by Morton index and id."""
    keyed = cloud.withColumn("slice", slice_key).withColumn("morton", binned_morton(dbl("py"), dbl("pz"), y_min, z_min, cell))
    rows = ranked(keyed, [F.col("slice"), F.col("morton"), F.col("id")], "nth")
    first = rows.groupBy("slice").agg(F.min("nth").alias("first"), F.count("*").alias("rows"))
    return looked_up(rows, first, "slice", cloud.count(), count="rows").withColumn("nth", F.col("nth") - F.col("first") + 1).drop("first", "rows")
