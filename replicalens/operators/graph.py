"""Per-session graph rules, for sessions whose rows include the other side's: extension, branch, or undecidable.

The walk is inherently sequential, so each session's few columns go to one Python call; only sessions of which one side
strictly includes the other get here.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import TITLE_TYPES, VOLATILE_TYPES


class Side:
    """What the rules ask of one side's rows (dicts with idx, uuid, parent, type, leaf_uuid, flags, hash)."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        self.named = [r for r in rows if r["uuid"]]
        self.uuids = {r["uuid"] for r in self.named}
        self.parent = {r["uuid"]: r["parent"] for r in self.named}
        self.used = {r["parent"] for r in rows if r["parent"]}
        self.leaves = [r for r in self.named if talks(r) and r["uuid"] not in self.used and not r["is_sidechain"] and not r["is_tool_fanout"]]
        self.cursor = next((r["leaf_uuid"] for r in reversed(rows) if r["type"] == "last-prompt" and r["leaf_uuid"]), None)

    def cyclic(self) -> bool:
        """Whether following parents from anywhere comes back; every node is walked once."""
        done: set = set()
        for start in self.parent:
            path, node = [], start
            trail: set = set()
            while node in self.parent and node not in done:
                if node in trail:
                    return True
                trail.add(node)
                path.append(node)
                node = self.parent[node]
            done.update(path)
        return False

    def reaches(self, ancestor, node) -> bool:
        """Whether ancestor is node or stands above it; rows without a row of their own can be reached, not left."""
        seen = set()
        while node is not None and node not in seen:
            if node == ancestor:
                return True
            seen.add(node)
            node = self.parent.get(node)
        return False

    def linked_through_bookkeeping(self) -> bool:
        meta = {r["uuid"] for r in self.named if not talks(r)}
        return any(r["parent"] in meta for r in self.rows if r["parent"])

    def tip(self):
        """The cursor if it is a genuine leaf; without a cursor the only leaf."""
        leaves = {r["uuid"] for r in self.leaves}
        if self.cursor:
            return self.cursor if self.cursor in leaves else None
        return next(iter(leaves)) if len(leaves) == 1 else None

    def lagging_tip(self):
        """The tip, or the only leaf when the cursor just wasn't moved on: it stands above the leaf, and none follows it."""
        if (tip := self.tip()) is not None or not self.cursor or len(self.leaves) != 1:
            return tip
        leaf, at_cursor = self.leaves[0]["uuid"], [r for r in self.named if r["uuid"] == self.cursor]
        first = min(r["idx"] for r in self.named if r["uuid"] == leaf)
        moved_back = any(r["type"] == "last-prompt" and r["idx"] >= first for r in self.rows)
        stale = bool(at_cursor) and all(map(talks, at_cursor)) and self.reaches(self.cursor, leaf) and not moved_back
        return leaf if stale else None


def talks(row: dict) -> bool:
    return row["type"] not in VOLATILE_TYPES


def superset(bigger: Side, smaller: Side, to_hub: bool) -> str:
    """Class of a session of which one side has all rows of the other and more."""
    if bigger.cyclic() or smaller.cyclic() or bigger.linked_through_bookkeeping() or smaller.linked_through_bookkeeping():
        return "needs-decision"
    for r in bigger.named:
        rooted = r["parent"] is None or r["parent"] not in bigger.uuids
        if rooted and r["type"] != "system" and r["uuid"] not in smaller.uuids:
            return "needs-decision"
    big_tip = bigger.tip()
    if big_tip is None:
        return "needs-decision"
    new = [r for r in bigger.named if r["uuid"] not in smaller.uuids and talks(r)]
    small_tip = smaller.lagging_tip()
    if not (new and len({r["uuid"] for r in bigger.leaves}) == 1 and small_tip is not None and bigger.reaches(small_tip, big_tip)):
        return "superset-branch"
    same = lambda r: (r["uuid"] or None, r["canon_hash"])
    has = {same(r) for r in bigger.rows}
    if to_hub and any(r["type"] in TITLE_TYPES and same(r) not in has for r in smaller.rows):
        return "needs-decision"
    return "fast-forward"


COLUMNS = ["side", "project_key", "sid", "idx", "uuid", "parent", "type", "leaf_uuid", "is_sidechain", "is_tool_fanout", "canon_hash"]


def classify_supersets(lines: DataFrame, which: DataFrame) -> DataFrame:
    """project_key, sid, superset_class for which(project_key, sid, to_hub)."""

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        sides = defaultdict(list)
        for r in frame.sort_values("idx").astype(object).where(frame.notna(), None).to_dict("records"):
            sides[r["side"]].append(r)
        to_hub = bool(frame["to_hub"].iloc[0])
        local, hub = Side(sides["local"]), Side(sides["hub"])
        found = superset(local, hub, True) if to_hub else superset(hub, local, False)
        return pd.DataFrame({"project_key": frame["project_key"][:1], "sid": frame["sid"][:1], "superset_class": [found]})

    rows = lines.where("ok").select(*COLUMNS).join(which, ["project_key", "sid"])
    return rows.groupBy("project_key", "sid").applyInPandas(walk, "project_key string, sid string, superset_class string")
