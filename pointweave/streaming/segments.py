"""Segmentation of a stream: points arrive in x order, and state is kept of those that later points may still ask for."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from pointweave.functions.criteria import criterion, votes_of
from pointweave.operators.knn import check, usable
from pointweave.operators.segment import Sweep
from pointweave.operators.transform import dbl
from pointweave.schema import NORMAL, XYZ
from pointweave.streaming.sweep import START, TICKS, ticks

PLACE = [*XYZ, *NORMAL]
ACTIVE = "id long, " + ", ".join(f"{c} double" for c in PLACE) + ", segment long, flip int"
#: What the stream returns: points with their segment and flip (or late), and what a batch adds to the weight between two segments.
POINT, EDGE = 0, 1
OUT = "kind int, cloud string, id long, " + ", ".join(f"{c} double" for c in PLACE) + ", segment long, flip int, late boolean, hi long, lo long, weight double, held long"


#: Candidates of a point, in mean, from which on a smaller radius is tried first; how often it is halved at most; and pairs that are looked at at once.
CROWDED, MOST_HALVINGS, PAIRS_AT_ONCE = 64, 12, 1_000_000


class Columns:
    """Points in x order in y-z columns as wide as a radius: who asks meets those before it that are within the radius along x, in its own column and the eight around it."""

    def __init__(self, place: np.ndarray, answers: np.ndarray, radius: float):
        self.place, self.radius, self.n = place, radius, len(place) + 1
        self.at = np.floor(place[:, 1:] / radius)
        self.of_axis = [np.unique(self.at[answers, axis]) for axis in (0, 1)]
        key = self.key(self.at[answers])[0]
        self.keys = np.unique(key)
        rank = np.searchsorted(self.keys, key) * self.n + answers
        order = np.argsort(rank)
        self.rank, self.answers = rank[order], answers[order]

    def key(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of columns, and whether any point that answers is in both their places along y and z."""
        place = [np.minimum(np.searchsorted(own, at[:, axis]), len(own) - 1) for axis, own in enumerate(self.of_axis)]
        there = (self.of_axis[0][place[0]] == at[:, 0]) & (self.of_axis[1][place[1]] == at[:, 1])
        return place[0] * len(self.of_axis[1]) + place[1], there

    def ranges(self, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the candidates of each point that asks begin, and how many there are: a column of the result for each of nine columns."""
        first = np.searchsorted(self.place[:, 0], self.place[asks, 0] - self.radius)
        begin, count, own = np.zeros((len(asks), 9), dtype=np.int64), np.zeros((len(asks), 9), dtype=np.int64), self.at[asks]
        for k, step in enumerate((i, j) for i in (-1.0, 0.0, 1.0) for j in (-1.0, 0.0, 1.0)):
            other = own + step
            key, there = self.key(other)
            there &= ((other != own) | (np.array(step) == 0)).all(axis=1)  # far out a step may be lost in rounding
            column = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there &= self.keys[column] == key
            begin[:, k] = np.searchsorted(self.rank, column * self.n + first)
            count[:, k] = np.where(there, np.searchsorted(self.rank, column * self.n + asks) - begin[:, k], 0)
        return begin, count

    def pairs(self, asks: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs a (of those who ask), b and their squared distance, less than the radius's."""
        each, total = count.ravel(), int(count.sum())
        a, first = np.repeat(np.repeat(asks, 9), each), np.repeat(begin.ravel() - (np.cumsum(each) - each), each)
        b = self.answers[first + np.arange(total)]
        d = self.place[a] - self.place[b]
        d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        near = np.flatnonzero(d2 < self.radius * self.radius)
        return a[near], b[near], d2[near]


def first_of_each(a: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the first k of their a; rows of one a stand together."""
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[1:] != a[:-1]
    start = np.flatnonzero(new)
    return np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a)))) < k


def nearest_before(place: np.ndarray, ids: np.ndarray, first: int, k: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest points within the radius that stand before each point from `first` on: pairs a, b (rows) and squared distance, in order of a, distance and b's id.

    place: px, py, pz in order of px and id. As in operators.knn the search starts with a smaller radius where points are many, who has k neighbours is done, and
    of points at one place only the k least ids answer; so a point looks at a bounded number of others on the whole, however dense the cloud is."""
    order = np.lexsort((place[:, 2], place[:, 1], place[:, 0]))  # stable: by id at one place
    here = np.cumsum(np.append(0, (place[order][1:] != place[order][:-1]).any(axis=1))) if len(place) else order
    answers, asks = np.sort(order[first_of_each(here, k)]), np.arange(first, len(place))
    out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
    width, halvings = radius, 0
    while len(asks) and halvings < MOST_HALVINGS and Columns(place, answers, width).ranges(asks)[1].sum() > CROWDED * len(asks):
        width, halvings = width / 2, halvings + 1
    while len(asks):
        columns, left = Columns(place, answers, width), []
        begin, count = columns.ranges(asks)
        part = np.cumsum(count.sum(axis=1)) // PAIRS_AT_ONCE
        for own in np.split(np.arange(len(asks)), np.flatnonzero(np.diff(part)) + 1):
            a, b, d2 = columns.pairs(asks[own], begin[own], count[own])
            best = np.lexsort((ids[b], d2, a))
            best = best[first_of_each(a[best], k)]
            a, b, d2 = a[best], b[best], d2[best]
            done = np.ones(len(asks[own]), dtype=bool) if halvings == 0 else np.searchsorted(a, asks[own], "right") - np.searchsorted(a, asks[own]) == k
            kept = done[np.searchsorted(asks[own], a)]
            out.append((a[kept], b[kept], d2[kept]))
            left.append(asks[own][~done])
        asks, width, halvings = np.concatenate(left), width * 2, halvings - 1
    a, b, d2 = (np.concatenate(x) for x in zip(*out, strict=True))
    best = np.lexsort((ids[b], d2, a))
    return a[best], b[best], d2[best]


class Segmenter(StatefulProcessor):
    """The sweep of one cloud. State: the points within a radius of the last one (a list), the standings of their segments (a list) and the last
    point (a value). A timer clears the lists once the watermark is a radius beyond the last point, whether or not more points of the cloud come."""

    def __init__(self, k: int, radius: float, criterion_: str, theta_s: float, theta_acc: float, x_min: float):
        self.k, self.radius, self.criterion, self.theta_s, self.theta_acc, self.x_min = k, radius, criterion_, theta_s, theta_acc, x_min

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getListState("active", ACTIVE)
        self.standing = handle.getListState("standing", "hi long, lo long, weight double")
        self.last = handle.getValueState("last", "px double, id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        points = pd.concat(list(rows)).sort_values(["px", "id"])
        last = self.last.get() if self.last.exists() else (-np.inf, 0)
        late = (points["px"] < last[0]) | ((points["px"] == last[0]) & (points["id"] < last[1]))
        own, known = Sweep(self.theta_s, self.theta_acc), {}
        for id_, *row, segment, flip in self.active.get():
            own.placed[id_], known[id_] = (segment, flip), row
        for hi, lo, weight in self.standing.get():
            own.standing[frozenset((hi, lo))] = weight
        before, first = dict(own.standing), len(known)
        for id_, *row in points.loc[~late, ["id", *PLACE]].itertuples(index=False):
            known[id_] = row
        ids, rows_ = np.array(list(known), dtype=np.int64), np.array(list(known.values()), dtype=float).reshape(-1, len(PLACE))
        a, b, d2 = nearest_before(rows_[:, :3], ids, first, self.k, self.radius)
        near = list(zip(ids[b].tolist(), votes_of(self.criterion, rows_[a], rows_[b], d2, self.radius).tolist(), d2.tolist(), strict=True))
        ends = np.searchsorted(a, np.arange(first, len(ids) + 1)).tolist()
        for id_, start, end in zip(ids[first:].tolist(), ends[:-1], ends[1:], strict=True):
            own.add(id_, near[start:end])
        if not late.all():
            last = tuple(points.loc[~late, ["px", "id"]].iloc[-1].tolist())
            last = (float(last[0]), int(last[1]))
            self.last.update(last)
        held = self.keep(own, known, last)
        yield self.out(key, points, late, own, before, held)

    def keep(self, own: Sweep, known: dict[int, list[float]], last: tuple[float, int]) -> int:
        """What later points may ask for stays, the rest goes; returns how many points stay."""
        ahead = [(id_, *map(float, row), *own.placed[id_]) for id_, row in known.items() if row[0] > last[0] - self.radius]
        live = {x[-2] for x in ahead}
        self.active.put(ahead) if ahead else self.active.clear()
        stand = [(max(pair), min(pair), float(x)) for pair, x in own.standing.items() if pair <= live]
        self.standing.put(stand) if stand else self.standing.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((ticks(last[0] + self.radius, self.radius, self.x_min) + START) // 1000 + 1)
        return len(ahead)

    def out(self, key: Any, points: pd.DataFrame, late: pd.Series, own: Sweep, before: dict, held: int) -> pd.DataFrame:
        points = points[["id", *PLACE]].assign(kind=POINT, late=late, hi=0, lo=0, weight=0.0)
        placed = [(0, 0) if x else own.placed[id_] for id_, x in zip(points["id"].tolist(), late, strict=True)]
        points["segment"], points["flip"] = zip(*placed, strict=True)
        more = [(max(pair), min(pair), x - before.get(pair, 0.0)) for pair, x in own.standing.items() if pair not in before or x != before[pair]]
        edges = pd.DataFrame(more, columns=["hi", "lo", "weight"]).assign(kind=EDGE, id=0, segment=0, flip=0, late=False, **dict.fromkeys(PLACE, 0.0))
        every = (pd.concat([points, edges]) if more else points).assign(cloud=str(key[0]), held=held)
        return every[[c.split()[0] for c in OUT.split(", ")]]

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.active.clear()
        self.standing.clear()
        yield from ()

    def close(self) -> None:
        pass


def segments_of_stream(stream: DataFrame, k: int, radius: float, x_min: float, criterion_: str = "hoppe", theta_s: float = 0.0, theta_acc: float = 0.5, by: str | None = None) -> DataFrame:
    """The stream's points with segment and flip as they come, and what they add to the edges between segments (see OUT).

    Points come in x order (then id); normals are to be of length 1. by: a column that tells clouds apart, each swept by itself and in parallel, side by side along x (they share
    the watermark); one cloud is one key, since each point's segment depends on those before it. A point that stands before one already placed is late: it joins no segment and is flagged, or, if the watermark is
    beyond it, dropped and counted by Spark. Points without id or finite position take no part. The session's state store must be RocksDB's.
    """
    check(k, radius)
    criterion(criterion_)
    points = usable(stream).select("id", *(dbl(c).alias(c) for c in PLACE), (F.col(by).cast("string") if by else F.lit("")).alias("cloud"))
    time = F.timestamp_micros(F.floor((F.col("px") - F.lit(float(x_min))) / F.lit(float(radius)) * F.lit(TICKS)).cast("long") + F.lit(START))
    return points.withColumn("time", time).withWatermark("time", "1 second").groupBy("cloud").transformWithStateInPandas(Segmenter(k, radius, criterion_, theta_s, theta_acc, x_min), OUT, "append", "eventTime")


class Late(StreamingQueryListener):
    """Counts late points of queries whose name starts with a given one: those flagged (observed as `sweep`) and those that the watermark dropped; remembers how many points the state held after each batch."""

    def __init__(self, name: str):
        self.name, self.flagged, self.dropped, self.held = name, 0, 0, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if (p.name or "").startswith(self.name):
            seen = p.observedMetrics.get("sweep")
            self.flagged += (seen.late or 0) if seen else 0
            self.dropped += sum(max(0, s.numRowsDroppedByWatermark) for s in p.stateOperators)
            if seen and seen.points:
                self.held.append(seen.held)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    @property
    def late(self) -> int:
        return self.flagged + self.dropped
