"""Trigram index: extraction, query plans, candidates, maintenance."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """Distinct three-character windows."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def index(files: DataFrame) -> DataFrame:
    """(tri, file_id), one row each."""
    return files.select("file_id", F.explode(trigrams(F.col("content"))).alias("tri")).select("tri", "file_id")


@dataclass(frozen=True)
class Plan:
    """all / any of parts; a string part is a trigram.  No parts: every file may match."""

    op: str
    parts: tuple = ()

    @property
    def matches_all(self) -> bool:
        return not self.parts


EVERY = Plan("all")


def plan_literal(query: str) -> Plan:
    return Plan("all", tuple(dict.fromkeys(query[i : i + 3] for i in range(len(query) - 2))))


def plan(query: str, *, literal: bool = True, ignore_case: bool = False) -> Plan:
    """What a file must hold to match.  Case folding, flags and patterns without a
    run of three literal characters match every file."""
    if ignore_case:
        return EVERY
    if literal:
        return plan_literal(query)
    if "(?" in query:
        return EVERY
    branches = _split(query)
    parts = []
    for b in branches:
        runs = [plan_literal(r) for r in _runs(b)]
        tris = tuple(dict.fromkeys(t for r in runs for t in r.parts))
        if not tris:
            return EVERY
        parts.append(Plan("all", tris))
    return parts[0] if len(parts) == 1 else Plan("any", tuple(parts))


def _split(pattern: str) -> list[str]:
    """Alternatives at the top level."""
    out, depth, cls, cur, i = [], 0, False, "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            cur += pattern[i : i + 2]
            i += 2
            continue
        if cls:
            cls = c != "]"
        elif c == "[":
            cls = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            out.append(cur)
            cur = ""
            i += 1
            continue
        cur += c
        i += 1
    return [*out, cur]


def _runs(pattern: str) -> list[str]:
    """Literal runs that every match of an alternative holds; groups are passed over."""
    flat, depth, i = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            token, i = pattern[i : i + 2], i + 2
            item = token[1] if not token[1].isalnum() else None
        elif c == "[":
            end = pattern.find("]", i + 2)
            i = len(pattern) if end < 0 else end + 1
            item = None
        elif c in "()":
            depth += 1 if c == "(" else -1
            i += 1
            item = None
        else:
            i += 1
            item = None if c in ".^$" else c
        optional = re.match(r"[*?]|\{0?,", pattern[i:])
        repeat = re.match(r"[+*?]\??|\{[^}]*\}\??", pattern[i:])
        if repeat:
            i += repeat.end()
        if depth > 0 or optional:
            item = None
        flat.append((item, bool(repeat)))
    runs, cur = [], ""
    for item, repeated in flat:
        if item is None:
            runs.append(cur)
            cur = ""
        else:
            cur += item
            if repeated:
                runs.append(cur)
                cur = item
    return [r for r in [*runs, cur] if len(r) >= 3]


def candidates(idx: DataFrame, p: Plan) -> DataFrame | None:
    """(file_id) of files that may match; None where the plan prunes nothing.

    All trigrams of the plan are read in one pass over the index and the plan is
    evaluated on the set of those that a file has.
    """
    if p.matches_all:
        return None
    wanted = sorted({t for part in p.parts for t in (part.parts if isinstance(part, Plan) else (part,))})
    held = idx.where(F.col("tri").isin(*wanted)).groupBy("file_id").agg(F.collect_set("tri").alias("held"))

    def holds(node) -> Column:
        if isinstance(node, str):
            return F.array_contains("held", node)
        tests = [holds(x) for x in node.parts]
        out = tests[0]
        for t in tests[1:]:
            out = (out & t) if node.op == "all" else (out | t)
        return out

    return held.where(holds(p)).select("file_id")


def pruned(files: DataFrame, idx: DataFrame, p: Plan, changed: DataFrame | None = None) -> DataFrame:
    """Files to scan: candidates, and files that changed since the index was made."""
    some = candidates(idx, p)
    if some is None:
        return files
    if changed is not None:
        some = some.unionByName(changed.select("file_id")).distinct()
    return files.join(some, "file_id", "left_semi")


def merge(old: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """The index after some files changed or went."""
    gone = changed.select("file_id").unionByName(removed.select("file_id")).distinct()
    return old.join(gone, "file_id", "left_anti").unionByName(index(changed))
