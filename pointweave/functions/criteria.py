"""Flip criteria: how strongly two oriented points ask for the same (positive) or the opposite (negative) sign."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(side: str, name: str) -> Column:
    """A side's column as double."""
    return F.col(f"{side}_{name}").cast("double")


def squared_distance(a: str, b: str) -> Column:
    x, y, z = (col(a, c) - col(b, c) for c in ("px", "py", "pz"))
    return x * x + y * y + z * z


def hoppe(a: str, b: str) -> Column:
    """Dot product of the normals."""
    return col(a, "nx") * col(b, "nx") + col(a, "ny") * col(b, "ny") + col(a, "nz") * col(b, "nz")


def xie(a: str, b: str) -> Column:
    """Dot product after one normal is mirrored at the plane across the edge; coincident points have no edge, which leaves the dot product."""
    x, y, z = (col(a, c) - col(b, c) for c in ("px", "py", "pz"))
    length2 = x * x + y * y + z * z
    along_a = x * col(a, "nx") + y * col(a, "ny") + z * col(a, "nz")
    along_b = x * col(b, "nx") + y * col(b, "ny") + z * col(b, "nz")
    return F.when(length2 > 0, hoppe(a, b) - F.lit(2.0) * along_a * along_b / length2).otherwise(hoppe(a, b))


CRITERIA: dict[str, Callable[[str, str], Column]] = {"hoppe": hoppe, "xie": xie}


def criterion(name: str) -> Callable[[str, str], Column]:
    if name.lower() not in CRITERIA:
        raise ValueError(f"unknown flip criterion {name!r}; there are {', '.join(CRITERIA)}")
    return CRITERIA[name.lower()]


def vote(name: str, a: str, b: str, radius: float) -> Column:
    """The criterion's value, less with distance and 0 at the radius."""
    return criterion(name)(a, b) * (F.lit(1.0) - F.col("d2") / F.lit(radius * radius))


def votes_of(name: str, point: np.ndarray, others: np.ndarray, d2: np.ndarray, radius: float) -> np.ndarray:
    """vote() between a point, or a point for each of the others, and others, as arrays (px, py, pz, nx, ny, nz)."""
    own = point.T
    dot = own[3] * others[:, 3] + own[4] * others[:, 4] + own[5] * others[:, 5]
    if criterion(name) is xie:
        x, y, z = (point[..., :3] - others[:, :3]).T
        length2 = x * x + y * y + z * z
        along, along_others = x * own[3] + y * own[4] + z * own[5], x * others[:, 3] + y * others[:, 4] + z * others[:, 5]
        dot = np.where(length2 > 0, dot - 2.0 * along * along_others / np.where(length2 > 0, length2, 1.0), dot)
    return dot * (1.0 - d2 / (radius * radius))
