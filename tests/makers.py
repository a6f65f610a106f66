"""Small clouds for the tests."""

import numpy as np
import pandas as pd

COLUMNS = ["id", "px", "py", "pz", "nx", "ny", "nz"]


def frame(spark, position, normal, start=0):
    p, n = np.asarray(position, dtype="f4").reshape(-1, 3), np.asarray(normal, dtype="f4").reshape(-1, 3)
    table = pd.DataFrame({"id": np.arange(start, start + len(p))} | {c: p[:, k] for k, c in enumerate(COLUMNS[1:4])} | {c: n[:, k] for k, c in enumerate(COLUMNS[4:])})
    return spark.createDataFrame(table, "id long, px float, py float, pz float, nx float, ny float, nz float")


def sphere(n, centre=(0, 0, 0), seed=0):
    """Points spread evenly over the unit sphere, and their radial normals."""
    k = np.arange(n) + 0.5
    z, turn = 1 - 2 * k / n, np.pi * (1 + 5**0.5) * k + seed
    p = np.column_stack([np.sqrt(1 - z * z) * np.cos(turn), np.sqrt(1 - z * z) * np.sin(turn), z])
    return p + np.asarray(centre), p


def strip(n=400):
    """A Möbius strip: no signs suit all its normals."""
    rng = np.random.default_rng(1)
    u, v = rng.uniform(0, 2 * np.pi, n), rng.uniform(-0.3, 0.3, n)
    p = np.column_stack([(1 + v * np.cos(u / 2)) * np.cos(u), (1 + v * np.cos(u / 2)) * np.sin(u), v * np.sin(u / 2)])
    normal = np.column_stack([np.sin(u / 2) * np.cos(u), np.sin(u / 2) * np.sin(u), -np.cos(u / 2)])
    return p, normal
