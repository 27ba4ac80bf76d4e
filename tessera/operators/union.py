"""Finding splits and merges: which earlier shapes together equal which later ones.

Each group of candidate objects is searched by itself, in parallel over groups. Objects are
put in order of time; those that end by the end of the first are early, those that begin
from then on are late. More early than late objects is a merge, fewer a split. Subsets are
tried from the full set downwards, one for each size (objects in order of id), or all of
them with ``exhaustive``; a match is the common area of both unions over the larger one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame

from ..geometry import polygon as g

SCHEMA = "group_id string, direction string, union_object string, early array<string>, late array<string>, strength double"


class OpenLifetime(ValueError):
    """An object without an end can't be placed before or after others."""


@dataclass(frozen=True)
class Candidate:
    object_id: str
    start: pd.Timestamp
    end: pd.Timestamp
    shape: g.Shape


def _subsets(items: Sequence[Candidate], exhaustive: bool) -> Iterator[tuple[Candidate, ...]]:
    ordered = sorted(items, key=lambda c: c.object_id)
    for size in range(len(ordered), 0, -1):
        if exhaustive:
            yield from combinations(ordered, size)
        else:
            yield tuple(ordered[len(ordered) - size :])


def split_by_time(items: Sequence[Candidate]) -> tuple[list[Candidate], list[Candidate]]:
    if any(pd.isna(c.end) for c in items):
        raise OpenLifetime("all candidates need an end")
    ordered = sorted(items, key=lambda c: (c.start, c.end, c.object_id))
    boundary = ordered[0].end
    return [c for c in ordered if c.end <= boundary], [c for c in ordered if c.end > boundary and c.start >= boundary]


def match(items: Sequence[Candidate], threshold: float, exhaustive: bool = False, strict: bool = False) -> tuple | None:
    """direction, union object, early ids, late ids, strength of the best match above the threshold.

    With equally many on both sides the best of both directions is returned as UNKNOWN;
    ``strict`` raises instead."""
    if not items:
        return None
    early, late = split_by_time(items)
    if not early or not late:
        return None
    sides = []
    if len(early) >= len(late):
        sides.append(("MERGED", late, early))
    if len(early) <= len(late):
        sides.append(("SPLIT", early, late))
    best = None
    for direction, wholes, parts in sides:
        for whole in sorted(wholes, key=lambda c: c.object_id):
            size = g.area(whole.shape)
            for chosen in _subsets(parts, exhaustive):
                shapes = [c.shape for c in chosen]
                largest = max(size, g.union_area(shapes))
                strength = g.unions_common_area([whole.shape], shapes) / largest if largest else 0.0
                if strength > threshold:
                    ids = [c.object_id for c in chosen]
                    found = (strength, direction, whole.object_id, *((ids, [whole.object_id]) if direction == "MERGED" else ([whole.object_id], ids)))
                    if best is None or strength > best[0]:
                        best = found
                    break
    if best is None:
        return None
    if len(early) == len(late):
        if strict:
            raise g.GeometryError("as many early as late objects: split or merge?")
        best = (best[0], "UNKNOWN", *best[2:])
    return best[1], best[2], best[3], best[4], best[0]


def spatial_unions(candidates: DataFrame, threshold: float = 0.9, exhaustive: bool = False, strict: bool = False, group: str = "group_id") -> DataFrame:
    """The best match of each group. ``candidates``: group_id, object_id, wkt, exists_from, exists_to."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        items = [Candidate(r.object_id, r.exists_from, r.exists_to, g.parse(r.wkt)) for r in pdf.itertuples()]
        found = match(items, threshold, exhaustive, strict)
        rows = [] if found is None else [(str(pdf[group].iloc[0]), *found)]
        return pd.DataFrame(rows, columns=["group_id", "direction", "union_object", "early", "late", "strength"])

    return candidates.select(group, "object_id", "wkt", "exists_from", "exists_to").groupBy(group).applyInPandas(search, SCHEMA)


def contributions(candidates: DataFrame, group: str = "group_id") -> DataFrame:
    """Each part's equality with the union of its group, and the union's area."""

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        shapes = [g.parse(w) for w in pdf["wkt"]]
        whole = g.union_area(shapes)
        rows = [(str(k), o, g.area(s) / whole if whole else 0.0, whole) for k, o, s in zip(pdf[group], pdf["object_id"], shapes, strict=True)]
        return pd.DataFrame(rows, columns=["group_id", "object_id", "contribution", "union_area"])

    return candidates.select(group, "object_id", "wkt").groupBy(group).applyInPandas(each, "group_id string, object_id string, contribution double, union_area double")
