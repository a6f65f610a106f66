"""Trust regions for labellings: terms that no cut can hold are replaced by their tangent at the labelling, turns are charged for, and
the charge grows when a cut's labelling turns out no better.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.operators.flow import SINK, sink_side
from pointweave.operators.graph import model_energy, resigned
from pointweave.operators.ranking import ranked
from pointweave.operators.refine import LEAST_GAIN, flipped
from pointweave.shared import stored

#: What turning a node costs at first, as a part of the mean weight at a node; how it grows when a step is refused and shrinks when one is taken.
FIRST, HARDER, EASIER = 0.05, 4.0, 0.5


def turns(edges: DataFrame, solution: DataFrame, charge: float) -> DataFrame:
    """node and turn -1 of the nodes that turn in the best labelling of the tangent model, in which a turn costs charge more.

    With x = 1 for a turned node, an edge that is as it asks costs its weight if one end turns: a pair of arcs. One that is not costs its size w unless one end
    turns, w (1 - x_i - x_j + 2 x_i x_j), whose tangent at 0 is w (1 - x_i - x_j): a gain for either end.
    """
    now = stored(resigned(edges, solution), "turned")
    gain = now.where("weight < 0")
    gain = gain.select(F.col("hi").alias("node"), F.abs("weight").alias("g")).union(gain.select("lo", F.abs("weight"))).groupBy("node").agg(F.sum("g").alias("g"))
    places = stored(ranked(solution.join(gain, "node", "left").select("node", "component", F.coalesce("g", F.lit(0.0)).alias("g")), [F.col("node")], "place"), "places")
    held = F.col("node") == F.col("component")  # the least node of a component never turns
    cost = F.lit(charge) - F.col("g")
    whole = now.agg(F.sum(F.abs("weight"))).first()[0] or 0.0
    # turned nodes are the source's side: who gains by turning is given that much, who loses gives it to the sink
    excess = places.where(~held & (cost < 0)).select(F.col("place").alias("u"), (-cost).alias("e"))
    to_sink = places.where(held | (cost > 0)).select(F.col("place").alias("u"), F.lit(SINK).cast("long").alias("v"), F.when(held, 2 * whole + 1).otherwise(cost).alias("r"))
    ends = {e: places.select(F.col("node").alias(e), F.col("place").alias(f"{e}_place")) for e in ("hi", "lo")}
    tied = stored(now.where("weight > 0").join(ends["hi"], "hi").join(ends["lo"], "lo").select(F.col("hi_place").alias("u"), F.col("lo_place").alias("v"), F.col("weight").alias("r")), "tied")
    stay = sink_side(tied.union(tied.select(F.col("v").alias("u"), F.col("u").alias("v"), "r")).union(to_sink), excess)
    return places.join(stay.withColumnRenamed("u", "place"), "place", "left_anti").where(~held).select("node", F.lit(-1).alias("turn"))


def trusted(edges: DataFrame, solution: DataFrame, most_steps: int = 8) -> DataFrame:
    """solution (node, component, sign) after at most so many steps of the trust region; the energy falls with every step taken.

    A step cuts the tangent model. Is the labelling better, it is taken and turning gets cheaper; else turning gets dearer. The steps end when turning is so dear that nothing turns.
    """
    edges = stored(edges.where("weight != 0").select("hi", "lo", "weight"), "edges")
    solution = stored(solution, "solution")
    row = edges.agg(F.sum(F.abs("weight")).alias("w")).first()
    charge = FIRST * (row.w or 0.0) / max(1, solution.count())
    best = model_energy(edges, solution).first().energy
    for _ in range(most_steps):
        step = stored(turns(edges, solution, charge), "step")
        if step.isEmpty():
            break
        other = stored(flipped(solution, step), "solution")
        energy = model_energy(edges, other).first().energy
        if energy < best - LEAST_GAIN:
            solution, best, charge = other, energy, charge * EASIER
        else:
            charge *= HARDER
    return solution
