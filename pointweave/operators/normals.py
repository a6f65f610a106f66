"""Unsigned normals by local principal components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.operators.knn import cell_neighbours, neighbours
from pointweave.operators.ordered import sliced
from pointweave.operators.transform import binned_morton, dbl
from pointweave.schema import XYZ

NEIGHBOURS = 20
PAIRS = [("px", "px"), ("px", "py"), ("px", "pz"), ("py", "py"), ("py", "pz"), ("pz", "pz")]


def local_covariance(cloud: DataFrame, radius: float, k: int = NEIGHBOURS, near: DataFrame | None = None) -> DataFrame:
    """id, number of neighbours and the six sums of each point with neighbours (near, if given; else those within the radius).

    The centre is the neighbours' mean, without the point. The sums are the products of the point's offset from it, plus those of the
    neighbours' offsets scaled to length 1; a neighbour at the centre itself adds nothing. Of a point's at most k neighbours a list
    is made, so one shuffle does.
    """
    near = (neighbours(cloud, k, radius) if near is None else near).groupBy(*(F.col(f"a_{c}").alias(c) for c in ("id", *XYZ)))
    lists = near.agg(F.array_sort(F.collect_list(F.struct("rank", *(F.col(f"b_{c}").cast("double").alias(c) for c in XYZ)))).alias("near"))
    n = F.size("near")

    def total(of) -> Column:
        return F.aggregate("near", F.lit(0.0), lambda acc, x: acc + of(x))

    centred = lists.withColumns({f"m_{c}": total(lambda x, c=c: x[c]) / n for c in XYZ})

    def unit(x: Column, c: str) -> Column:
        d = [x[a] - F.col(f"m_{a}") for a in XYZ]
        length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
        return F.when(length > 0, (x[c] - F.col(f"m_{c}")) / length).otherwise(0.0)

    def own(c: str) -> Column:
        return dbl(c) - F.col(f"m_{c}")

    sums = [(own(a) * own(b) + total(lambda x, a=a, b=b: unit(x, a) * unit(x, b))).alias(f"c{a[1]}{b[1]}") for a, b in PAIRS]
    return centred.select("id", n.alias("n"), *sums)


#: Fixed value: rounds of the three rotations. The entries beside the diagonal shrink quadratically.
SWEEPS = 4


def rotated(df: DataFrame, p: int, q: int) -> DataFrame:
    """One rotation that clears entry (p, q) of the symmetric matrix a00 to a22, with its axes in the columns of v00 to v22."""
    r = 3 - p - q
    a = lambda i, j: F.col(f"a{min(i, j)}{max(i, j)}")
    t, c = F.col("_t"), F.col("_c")
    apart = (a(q, q) - a(p, p)) / (F.lit(2.0) * a(p, q))
    tangent = F.when(a(p, q) == 0, 0.0).otherwise(F.when(apart < 0, -1.0).otherwise(1.0) / (F.abs(apart) + F.sqrt(apart * apart + F.lit(1.0))))
    df = df.withColumn("_t", tangent).withColumn("_c", F.lit(1.0) / F.sqrt(t * t + F.lit(1.0)))
    turned = {f"a{p}{p}": a(p, p) - t * a(p, q), f"a{q}{q}": a(q, q) + t * a(p, q), f"a{p}{q}": F.lit(0.0)}
    for name, x, y in [(lambda i: f"a{min(r, i)}{max(r, i)}", a(r, p), a(r, q)), *((lambda i, k=k: f"v{k}{i}", F.col(f"v{k}{p}"), F.col(f"v{k}{q}")) for k in range(3))]:
        turned |= {name(p): c * (x - t * y), name(q): c * (t * x + y)}
    return df.withColumns(turned)


def least_axis(df: DataFrame, sums: list[str]) -> DataFrame:
    """Adds ex, ey, ez: the axis of least extent of the symmetric matrix in columns sums (xx, xy, xz, yy, yz, zz), of length 1, largest component positive. By Jacobi's rotations as column expressions."""
    kept = df.columns
    df = df.withColumns({f"a{i}{j}": F.col(x) for (i, j), x in zip([(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)], sums, strict=True)} | {f"v{k}{i}": F.lit(float(k == i)) for k in range(3) for i in range(3)})
    for _ in range(SWEEPS):
        for p, q in ((0, 1), (0, 2), (1, 2)):
            df = rotated(df, p, q)
    first = (F.col("a00") <= F.col("a11")) & (F.col("a00") <= F.col("a22"))
    axis = [F.when(first, F.col(f"v{k}0")).when(F.col("a11") <= F.col("a22"), F.col(f"v{k}1")).otherwise(F.col(f"v{k}2")) for k in range(3)]
    df = df.select(*kept, *(x.alias(f"_e{k}") for k, x in enumerate(axis)))
    x, y, z = (F.col(f"_e{k}") for k in range(3))
    most = F.when((F.abs(x) >= F.abs(y)) & (F.abs(x) >= F.abs(z)), x).when(F.abs(y) >= F.abs(z), y).otherwise(z)
    sign = F.when(most < 0, -1.0).otherwise(1.0)
    return df.select(*kept, *((F.col(f"_e{k}") * sign).alias(e) for k, e in enumerate(("ex", "ey", "ez"))))


def axes(covariances: DataFrame) -> DataFrame:
    """local_covariance's rows of three neighbours or more, with their axis of least extent."""
    return least_axis(covariances.where("n >= 3"), [f"c{a[1]}{b[1]}" for a, b in PAIRS])


def estimated(cloud: DataFrame, radius: float, k: int = NEIGHBOURS, max_per_slice: int | None = None) -> DataFrame:
    """The cloud with normals along the axis of least extent of each neighbourhood, largest component positive; zero for points with fewer than three neighbours.

    max_per_slice: neighbours are sought only in a point's slice along x (2 * radius wide, of at most so many points) and its cell of the
    y-z grid there (2 * radius wide), as a machine with little memory would; else wherever they are.
    """
    near = None
    if max_per_slice is not None:
        low = cloud.select(dbl("py").alias("y"), dbl("pz").alias("z")).agg({"y": "min", "z": "min"}).first()
        at = {c.partition("(")[2][0]: float(v or 0.0) for c, v in low.asDict().items()}
        key = F.struct("slice", binned_morton(dbl("py"), dbl("pz"), at["y"], at["z"], 2 * radius))
        near = cell_neighbours(sliced(cloud, 2 * radius, max_per_slice), k, radius, key)
    found = axes(local_covariance(cloud, radius, k, near)).select("id", "ex", "ey", "ez")
    zero = F.lit(0.0)
    return cloud.join(found, "id", "left").withColumns({"nx": F.coalesce("ex", zero), "ny": F.coalesce("ey", zero), "nz": F.coalesce("ez", zero)}).drop("ex", "ey", "ez")
