"""Passes over a cloud in order, without a task that sees all of it: ranges of the order, a summary of each, and a carry into each."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.operators.ranking import ranked, sorted_ranges
from pointweave.operators.transform import dbl
from pointweave.shared import forget, stored, stored_with

Batches = Iterator[pd.DataFrame]


def by_range(parts: Batches) -> Iterator[tuple[int, Batches]]:
    """The batches of each range; a range's batches are to be read before the next range's."""
    pieces = (piece for part in parts for _, piece in part.groupby("range", sort=True))
    ahead = next(pieces, None)
    while ahead is not None:
        number = int(ahead["range"].iloc[0])

        def own(number: int = number) -> Batches:
            nonlocal ahead
            while ahead is not None and int(ahead["range"].iloc[0]) == number:
                piece, ahead = ahead, next(pieces, None)
                yield piece.drop(columns="range")

        yield number, own()


def folded(df: DataFrame, order: list, summarise: Callable[[Batches], Any], combine: Callable[[Any, Any], Any], start: Any, work: Callable[[Any, Batches], Batches], schema: str) -> DataFrame:
    """work over the rows in the given order, batch by batch: each range of the order is a run of batches, and gets as carry what comes before it.

    summarise makes a range's batches one small value; combine adds such a value to a carry; start is the first range's carry. Ranges run in parallel, twice: once
    to be summarised, once with their carry. Only the summaries, one a range, meet on the driver.
    """
    rows = sorted_ranges(df, order)
    in_order = rows.repartition("range").sortWithinPartitions("range", *order)

    def summaries(parts: Batches) -> Batches:
        for number, own in by_range(parts):
            yield pd.DataFrame({"range": [number], "value": [pickle.dumps(summarise(own))]})

    carries, carry = {}, start
    for r in sorted(in_order.mapInPandas(summaries, "range int, value binary").collect()):
        carries[r["range"]], carry = carry, combine(carry, pickle.loads(bytes(r.value)))

    def run(parts: Batches) -> Batches:
        for number, own in by_range(parts):
            yield from work(carries[number], own)

    return in_order.mapInPandas(run, schema)


def gaps(cloud: DataFrame) -> DataFrame:
    """id, ord (place by px, then id, from 1) and gap: how far the point is beyond the one before it along x; 0 for the first."""

    def summarise(parts: Batches) -> tuple[int, float | None]:
        n, last = 0, None
        for part in parts:
            n, last = n + len(part), float(part["px"].iloc[-1])
        return n, last

    def work(carry: tuple[int, float | None], parts: Batches) -> Batches:
        n, last = carry
        for part in parts:
            before = part["px"].shift(1)
            before.iloc[0] = part["px"].iloc[0] if last is None else last
            yield pd.DataFrame({"id": part["id"], "ord": range(n + 1, n + len(part) + 1), "gap": part["px"] - before})
            n, last = n + len(part), float(part["px"].iloc[-1])

    points = cloud.where("id is not null and px is not null").select("id", dbl("px").alias("px"))
    return folded(points, [F.col("px"), F.col("id")], summarise, lambda a, b: (a[0] + b[0], b[1] if b[0] else a[1]), (0, None), work, "id long, ord long, gap double")


def sliced(cloud: DataFrame, width: float, most: int | None = None) -> DataFrame:
    """The cloud's points with an x, with place (by px, then id) and slice, both from 1. A slice opens at its first point and closes at the
    first one that is width or more beyond, or after `most` points.

    Each place's next opening is found by one sort of the points and of where their slices end. Of the chain of openings from the first place on, the
    first 2, 4, 8, ... are found by steps that double: what the known ones lead to in so many steps is known, too.
    """
    if width <= 0 or (most is not None and most < 1):
        raise ValueError("width and most must be positive")
    points, seen = stored_with(ranked(cloud.where("px is not null"), [F.col("px"), F.col("id")], "place"), "places", n=F.count("*"))
    x, place = dbl("px"), F.col("place")
    marks = points.select(x.alias("at"), F.lit(1).alias("kind"), "place").union(points.select((x + F.lit(float(width))).alias("at"), F.lit(0).alias("kind"), "place"))
    met = ranked(marks, [F.col("at"), F.col("kind"), place], "mark").where("kind = 0")
    # ends are in the points' own order: before the mark of the end of `place` stand `place - 1` ends; the others are points
    following = F.greatest(F.col("mark") - place + 1, place + 1)
    following = following if most is None else F.least(following, place + most)
    jump = stored(met.select("place", following.alias("next")).where(F.col("next") <= seen["n"]), "jump")
    opened = points.where("place = 1").select("place")
    known = 1 if seen["n"] else 0
    while known:
        further = opened.join(jump, "place").select(F.col("next").alias("place"))
        opened, of_opened = stored_with(opened.union(further), "opened", n=F.count("*"))
        if of_opened["n"] < 2 * known:
            break
        known = of_opened["n"]
        later = jump.select(F.col("place").alias("next"), F.col("next").alias("then"))
        before, jump = jump, stored(jump.join(later, "next").select("place", F.col("then").alias("next")), "jump")
        forget(before)
    starts = ranked(opened.select(place.alias("first")), [F.col("first")], "slice")
    ends = starts.select((F.col("slice") - 1).alias("slice"), F.col("first").alias("end"))
    spans = stored(starts.join(ends, "slice", "left").select("slice", "first", (F.coalesce("end", F.lit(seen["n"] + 1)) - F.col("first")).alias("rows")), "spans")
    return counted_off(points, spans)


def counted_off(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (place, without gaps) with the slice of spans (slice, first, rows) that their place lies in: the openings up to it, counted range by range."""
    flagged = points.join(spans.select(F.col("first").alias("place"), F.lit(1).alias("opens")), "place", "left")

    def summarise(parts: Batches) -> int:
        return sum(int(part["opens"].sum()) for part in parts)

    def work(carry: int, parts: Batches) -> Batches:
        for part in parts:
            number = carry + part["opens"].cumsum()
            carry = int(number.iloc[-1])
            yield pd.DataFrame({"place": part["place"], "slice": number})

    numbers = folded(flagged.select("place", F.coalesce("opens", F.lit(0)).alias("opens")), [F.col("place")], summarise, lambda a, b: a + b, 0, work, "place long, slice long")
    return points.join(numbers, "place")
