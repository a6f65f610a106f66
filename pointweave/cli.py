"""Command line: python -m pointweave.cli FILE [options].

Reads an ASCII PLY or XYZ file (or a Parquet cloud), orients it and writes its components, largest first, as Parquet beside it,
and the largest as PLY.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.functions.criteria import CRITERIA
from pointweave.operators import graph, normals, transform
from pointweave.plans import orient
from pointweave.schema import COLOR, NORMAL, XYZ
from pointweave.shared import stored
from pointweave.sources import clouds, sinks
from pointweave.timing import StageTimer


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pointweave", description=__doc__)
    p.add_argument("filename")
    p.add_argument("-stream", action="store_true", help="orient by a sweep along x")
    p.add_argument("-prepare", action="store_true", help="centre the cloud, turn its longest axis to x and sort")
    p.add_argument("-randomize", action="store_true", help="flip each normal by a coin first")
    p.add_argument("-estimateNormals", action="store_true", help="estimate unsigned normals first")
    p.add_argument("-calculateEnergies", action="store_true", help="print the energy before and after")
    p.add_argument("-k", type=int, default=6)
    p.add_argument("-r", type=float, default=1.0)
    p.add_argument("-thetaS", type=float, default=0.0)
    p.add_argument("-thetaAcc", type=float, default=0.5)
    p.add_argument("-flipcrit", type=str.lower, choices=sorted(CRITERIA), default="hoppe")
    p.add_argument("-solver", choices=sorted(orient.SOLVERS), default="refined")
    return p


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else clouds.read_ply(spark, path)


def run(spark: SparkSession, argv: list[str]) -> str:
    """Do what the arguments say; returns the output folder."""
    args = parser().parse_args(argv)
    timer, out = StageTimer(), args.filename.rstrip("/").rsplit(".", 1)[0] + "_oriented"
    with timer.stage("Preparation"):
        cloud = read(spark, args.filename)
        if args.prepare:
            cloud = orient.prepare(cloud).cloud.drop("ord")
        if args.estimateNormals:
            cloud = transform.valid_normals(normals.estimated(cloud, 4 * args.r))
        if args.randomize:
            cloud = transform.randomized(cloud)
        cloud = stored(cloud, "cloud")
    energy = lambda c: graph.energy(graph.edges_global(c, args.k, args.r, args.flipcrit)).first()
    if args.calculateEnergies:
        print("Energy before:", energy(cloud).energy)
    with timer.stage("Orientation"):
        if args.stream:
            points = orient.orient_stream(cloud, args.k, args.r, args.flipcrit, args.thetaS, args.thetaAcc, min_extent=args.r, solver=args.solver)
        else:
            points = orient.orient_global(cloud, args.k, args.r, args.flipcrit, min_extent=args.r, solver=args.solver)
        points = stored(points, "oriented")
    if args.calculateEnergies:
        print("Energy after:", energy(points).energy)
    with timer.stage("Finalization"):
        sinks.write_components(points, f"{out}/components.parquet")
        sinks.write_ply(points.where(F.col("comp_rank") == 0).select("id", *XYZ, *NORMAL, *COLOR), f"{out}/largest.ply")
    print(timer.table())
    return out


if __name__ == "__main__":
    run(SparkSession.builder.appName("pointweave").getOrCreate(), sys.argv[1:])
