"""Which objects at a time stand for given ones: traversal through splits and merges.

A split or merge makes its subject equal to the union of its components. Objects that are
not valid at the asked time are replaced, step by step, by what they are equal to on the
other side; components stand for the whole only if all of them have been reached. A single
dead end empties the answer: five of six parts are not the whole.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .objects import only
from .relations import checkpointer


class MixedDirections(ValueError):
    """Some inputs lie before the time and some after it."""


@dataclass(frozen=True)
class Change:
    event_id: str
    kind: str
    subject: str
    components: frozenset[str]


def _side(life: tuple[datetime, datetime | None], t: datetime) -> int:
    """1: the object begins after t; -1: it has ended by then; 0: it is valid."""
    start, end = life
    return 1 if start > t else -1 if end is not None and end <= t else 0


def traverse(lives: dict[str, tuple[datetime, datetime | None]], changes: Iterable[Change], equal: Iterable[tuple[str, str]], ids: Iterable[str], t: datetime) -> set[str]:
    """Ids valid at t that together equal the given ones; empty if there is no complete answer."""
    wanted = set(ids)
    sides = {o: _side(lives[o], t) for o in wanted}
    directions = {s for s in sides.values() if s}
    if not directions:
        return wanted
    if len(directions) > 1:
        raise MixedDirections("objects both before and after the time")
    direction = directions.pop()  # 1: go back in time, -1: forward
    wholes: dict[str, list[Change]] = {}
    parts: dict[str, list[Change]] = {}
    for c in changes:
        wholes.setdefault(c.subject, []).append(c)
        for p in c.components:
            parts.setdefault(p, []).append(c)
    same: dict[str, set[str]] = {}
    for a, b in equal:
        same.setdefault(a, set()).add(b)
        same.setdefault(b, set()).add(a)

    def beyond(a: str, b: str) -> bool:
        """Whether b lies on the side of a that leads to t."""
        (a0, a1), (b0, b1) = lives[a], lives[b]
        if direction == -1:
            return a1 is not None and b0 >= a1
        return b1 is not None and b1 <= a0

    seen, found, queue = set(wanted), {o for o in wanted if not sides[o]}, {o for o in wanted if sides[o]}
    while queue:
        # in order of time, away from the inputs
        current = min(queue, key=lambda o: (lives[o][0], o)) if direction == -1 else max(queue, key=lambda o: (lives[o][0], o))
        queue.discard(current)
        steps: list[set[str]] = [{b} for b in same.get(current, ()) if beyond(current, b)]
        for c in wholes.get(current, ()):
            others = {b for b in c.components if beyond(current, b)}
            if others and others == c.components:
                steps.append(others)
        waiting = False
        for c in parts.get(current, ()):
            if not beyond(current, c.subject):
                continue
            if c.components <= seen:
                steps.append({c.subject})
            else:
                waiting = True  # until the other components arrive; checked at the end
        if not steps and not waiting:
            return set()
        for o in set().union(*steps) - seen:
            seen.add(o)
            if _side(lives[o], t) == 0:
                found.add(o)
            elif _side(lives[o], t) == direction:
                queue.add(o)
    # components that waited for others that never came
    for o in seen:
        if _side(lives[o], t) == direction:
            reached = any(b in seen for b in same.get(o, ()) if beyond(o, b)) or any(c.components <= seen for c in wholes.get(o, ())) or any(
                c.subject in seen and c.components <= seen for c in parts.get(o, ())
            )
            if not reached:
                return set()
    return found


def change_edges(events: DataFrame, components: DataFrame, equals: DataFrame) -> DataFrame:
    """``s, p``: ids linked by a change or by equality, both ways. A change links its subject and its components,
    and those with each other through it."""
    own = events.where(F.col("event_type").isin("SPLIT", "MERGED")).select(F.col("object_id").alias("s"), "event_id")
    star = own.join(components.select("event_id", F.col("object_id").alias("p")), "event_id").select("s", "p")
    # components of one event meet in the event's name instead of pair by pair
    hub = components.select(F.concat(F.lit("\x00"), "event_id").alias("s"), F.col("object_id").alias("p"))
    one_way = star.unionByName(hub).unionByName(equals.select(F.col("subject").alias("s"), F.col("object").alias("p")))
    return one_way.unionByName(one_way.select(F.col("p").alias("s"), F.col("s").alias("p"))).where("s <> p").distinct()


def neighbourhoods(events: DataFrame, components: DataFrame, equals: DataFrame, ids: DataFrame) -> DataFrame:
    """``group_id, object_id``: for each group of ids (group_id, object_id) all that is linked to them by changes or
    equality, at any distance: the part of the graph that a traversal can touch. Each round is a join of the
    newest ids only; edges go both ways, so what these reach is new unless it came in this round or the one before."""
    keep = checkpointer(events.sparkSession)
    edges = keep(change_edges(events, components, equals))
    seen = keep(ids.select("group_id", "object_id").distinct())
    last, front, rounds = seen.limit(0), seen, 0
    while True:
        found = edges.join(front.select("group_id", F.col("object_id").alias("s")), "s").select("group_id", F.col("p").alias("object_id")).distinct()
        last, front = front, keep(found.join(front.unionByName(last), ["group_id", "object_id"], "left_anti"))
        if front.isEmpty():
            return seen.where(~F.col("object_id").startswith("\x00"))
        seen = seen.unionByName(front)
        rounds += 1
        if rounds % 50 == 0:  # a long chain makes no plan of thousands of tables
            seen = keep(seen)


def neighbourhood(events: DataFrame, components: DataFrame, equals: DataFrame, ids: DataFrame) -> DataFrame:
    """The same for one group: the first column of ``ids``."""
    one = ids.select(F.lit("").alias("group_id"), F.col(ids.columns[0]).alias("object_id"))
    return neighbourhoods(events, components, equals, one).select("object_id")


_WALK = "group_id string, object_id string"


def equivalents(objects: DataFrame, events: DataFrame, components: DataFrame, equals: DataFrame, ids: DataFrame, t: datetime) -> DataFrame:
    """``group_id, object_id``: what stands at t for each group of ids (group_id, object_id). Groups are found by
    joins and walked in parallel; one task holds one group's connected changes (a place's history, not the dataset)."""
    near = neighbourhoods(events, components, equals, ids)
    none, time = F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz")

    def rows(df: DataFrame, kind: str, a: Column, b: Column = none, start: Column = time, end: Column = time) -> DataFrame:
        return df.select("group_id", F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), start.cast("timestamp_ntz").alias("start"), end.cast("timestamp_ntz").alias("end"))

    lives = near.join(objects, "object_id")
    own = near.join(events.where(F.col("event_type").isin("SPLIT", "MERGED")).select("object_id", "event_id"), "object_id")
    parts = own.select("group_id", "event_id").distinct().join(components, "event_id")
    same = near.join(equals.select(F.col("subject").alias("object_id"), "object"), "object_id")
    table = (
        rows(lives, "life", F.col("object_id"), start=F.coalesce("exists_from", "exists_at"), end=F.col("exists_to"))
        .unionByName(rows(own, "event", F.col("event_id"), F.col("object_id")))
        .unionByName(rows(parts, "part", F.col("event_id"), F.col("object_id")))
        .unionByName(rows(same, "same", F.col("object_id"), F.col("object")))
        .unionByName(rows(ids.select("group_id", "object_id"), "asked", F.col("object_id")))
    )

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        of = {k: d for k, d in pdf.groupby("kind")}
        pairs = lambda k: list(zip(of[k]["a"], of[k]["b"], strict=True)) if k in of else []
        lives = {a: (s.to_pydatetime(), None if pd.isna(e) else e.to_pydatetime()) for a, s, e in zip(*(of["life"][c] for c in ("a", "start", "end")), strict=True)} if "life" in of else {}
        members: dict[str, set[str]] = {}
        for event, part in pairs("part"):
            members.setdefault(event, set()).add(part)
        changes = [Change(event, "", subject, frozenset(members.get(event, ()))) for event, subject in pairs("event")]
        found = traverse(lives, changes, pairs("same"), of["asked"]["a"], t)
        return pd.DataFrame({"group_id": [pdf["group_id"].iloc[0]] * len(found), "object_id": sorted(found)}, dtype=object)

    return table.groupBy("group_id").applyInPandas(walk, _WALK)


def equivalent(objects: DataFrame, events: DataFrame, components: DataFrame, equals: DataFrame, ids: Iterable[str], t: datetime) -> set[str]:
    """The same for one group of ids; the answer comes to the driver."""
    asked = objects.sparkSession.createDataFrame([("", i) for i in ids], _WALK)
    return {r["object_id"] for r in equivalents(objects, events, components, equals, asked, t).collect()}


def equivalent_objects(objects: DataFrame, events: DataFrame, components: DataFrame, equals: DataFrame, ids: Iterable[str], t: datetime) -> DataFrame:
    """The objects themselves; nothing passes through the driver."""
    asked = objects.sparkSession.createDataFrame([("", i) for i in ids], _WALK)
    return only(objects, "object_id", equivalents(objects, events, components, equals, asked, t).select("object_id"))
