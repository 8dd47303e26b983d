"""Exact multiset cover: which rows occur in at least one solution.

A solution picks rows so that every column is hit exactly as often as its
multiplicity says.  Rows and columns that hang together form components, which
are found with distributed label propagation and solved one by one; a
component without a solution leaves the whole problem without one.  Where all
rows of a component join two kinds of columns it is a matching, solved by flow
in time that is no power of its choices; others are searched.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.plans.cut import cut, written


class SearchBudgetError(RuntimeError):
    """The search of a component needs more steps than allowed; nothing is decided."""


def rows_in_solutions(target: Mapping[int, int], rows: Mapping[int, Sequence[int]], budget: int = 2_000_000, times: Mapping[int, int] | None = None) -> set[int]:
    """Rows of one problem that are part of a solution; ``times``: how often a row may be used, if not once.

    Rows of two columns each that lie between two kinds of columns are a matching
    and take no search, see ``edges_in_matchings``.

    Depth-first over the column with the fewest choices; what is left to cover
    and which rows may still be used decide whether a state has a solution, so
    each state is explored once.  Equal rows are chosen as a number of copies.
    """
    if any(n <= 0 for n in target.values()):
        raise ValueError("multiplicities must be positive")
    shapes: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for r, cols in rows.items():
        if cols and all(c in target for c in cols):
            shapes[tuple(sorted(cols))].append(r)
    kinds = sorted(shapes)
    columns = sorted(target)
    total = [sum(times[r] if times else 1 for r in shapes[k]) for k in kinds]
    if (sides := _two_sides(kinds, columns)) is not None:
        live = edges_in_matchings(target, sides, kinds, total)
        return {r for k in live for r in shapes[k]}
    at = {c: i for i, c in enumerate(columns)}
    of_column: list[list[int]] = [[] for _ in columns]
    for k, cols in enumerate(kinds):
        for c in cols:
            of_column[at[c]].append(k)
    left0 = tuple(target[c] for c in columns)
    copies0 = tuple(total)
    known: dict[tuple, bool] = {}
    steps = 0

    def successors(left: tuple[int, ...], copies: tuple[int, ...]):
        usable = [k for k, n in enumerate(copies) if n and all(left[at[c]] for c in kinds[k])]
        choices = {i: [k for k in of_column[i] if k in set(usable)] for i, n in enumerate(left) if n}
        column = min(choices, key=lambda i: (len(choices[i]), i))
        if not choices[column]:
            return
        k = choices[column][0]
        # all ways to use the first kind of this column: 0 to as many copies as fit
        most = min(copies[k], *(left[at[c]] for c in kinds[k]))
        for n in range(most, -1, -1):
            new = list(left)
            for c in kinds[k]:
                new[at[c]] -= n
            rest = list(copies)
            rest[k] = 0
            yield k, n, tuple(new), tuple(rest)

    # frames: state, its successors, whether one of them has a solution
    def solve(start: tuple) -> bool:
        nonlocal steps
        stack = [[start, successors(*start) if any(start[0]) else None, False]]
        if not any(start[0]):
            known[start] = True
            return True
        while stack:
            frame = stack[-1]
            state, options, found = frame
            moved = False
            for _, _, left, copies in options:
                steps += 1
                if steps > budget:
                    raise SearchBudgetError(f"more than {budget} steps")
                child = (left, copies)
                if child not in known and not any(left):
                    known[child] = True
                if child in known:
                    if known[child]:
                        frame[2] = True
                    continue
                frame.append(child)
                stack.append([child, successors(*child), False])
                moved = True
                break
            if moved:
                continue
            known[state] = frame[2]
            stack.pop()
            if stack:
                parent = stack[-1]
                if known[parent.pop()]:
                    parent[2] = True
        return known[start]

    if not solve((left0, copies0)):
        return set()
    # choices that lead to solutions: walk solvable states only
    live, seen, todo = set(), set(), [(left0, copies0)]
    while todo:
        state = todo.pop()
        if state in seen or not any(state[0]):
            continue
        seen.add(state)
        for k, n, left, copies in successors(*state):
            if known.get((left, copies)):
                if n:
                    live.add(k)
                todo.append((left, copies))
    return {r for k in live for r in shapes[kinds[k]]}


def _two_sides(kinds: Sequence[tuple[int, ...]], columns: Sequence[int]) -> set[int] | None:
    """Columns of one side, if every kind of row has one column of each of two sides."""
    if not kinds or any(len(k) != 2 or k[0] == k[1] for k in kinds):
        return None
    near: dict[int, list[int]] = defaultdict(list)
    for a, b in kinds:
        near[a].append(b)
        near[b].append(a)
    side: dict[int, bool] = {}
    for c in columns:
        if c in side:
            continue
        side[c], todo = True, [c]
        while todo:
            at = todo.pop()
            for other in near[at]:
                if other not in side:
                    side[other] = not side[at]
                    todo.append(other)
                elif side[other] == side[at]:
                    return None
    return {c for c, left in side.items() if left}


def edges_in_matchings(target: Mapping[int, int], left: set[int], edges: Sequence[tuple[int, int]], most: Sequence[int]) -> set[tuple[int, int]]:
    """Edges used by some choice that meets every column's number, an edge up to ``most`` times.

    A maximum flow is one such choice.  Any other differs from it by cycles of
    the residual graph, so an edge is used by some choice if the flow uses it or
    if it has room and both ends lie in one strongly connected part.
    """
    flow = _flow(target, left, edges, most)
    if flow is None:
        return set()
    after: dict[int, list[int]] = defaultdict(list)
    for (a, b), f, m in zip(edges, flow, most, strict=True):
        a, b = (a, b) if a in left else (b, a)
        if f < m:
            after[a].append(b)
        if f > 0:
            after[b].append(a)
    part = _strong_parts(target, after)
    return {e for e, f in zip(edges, flow, strict=True) if f > 0 or part[e[0]] == part[e[1]]}


def _flow(target: Mapping[int, int], left: set[int], edges: Sequence[tuple[int, int]], most: Sequence[int]) -> list[int] | None:
    """How often each edge is used in a choice that meets all numbers; None if there is none.

    Phases of breadth-first levels and augmenting paths along them, after a
    greedy start.
    """
    need = dict(target)
    if sum(n for c, n in need.items() if c in left) != sum(n for c, n in need.items() if c not in left):
        return None
    ends = [(a, b) if a in left else (b, a) for a, b in edges]
    flow = [0] * len(edges)
    of: dict[int, list[int]] = defaultdict(list)
    order = sorted(range(len(edges)), key=lambda e: ends[e])
    for e in order:
        a, b = ends[e]
        of[a].append(e)
        of[b].append(e)
        n = min(need[a], need[b], most[e])
        flow[e], need[a], need[b] = n, need[a] - n, need[b] - n
    room = lambda e, c: most[e] - flow[e] if ends[e][0] == c else flow[e]
    while any(need[c] for c in left):
        level = {c: 0 for c in left if need[c]}
        queue = deque(level)
        while queue:
            c = queue.popleft()
            for e in of[c]:
                other = ends[e][1] if ends[e][0] == c else ends[e][0]
                if other not in level and room(e, c) > 0:
                    level[other] = level[c] + 1
                    queue.append(other)
        if not any(need[c] for c in level if c not in left):
            return None
        tried = dict.fromkeys(level, 0)
        for start in [c for c in left if need[c]]:
            while need[start]:
                path, at = [], start
                while True:
                    if at not in left and need[at]:
                        break
                    moved = False
                    while tried[at] < len(of[at]):
                        e = of[at][tried[at]]
                        other = ends[e][1] if ends[e][0] == at else ends[e][0]
                        if level.get(other) == level[at] + 1 and room(e, at) > 0:
                            path.append((e, at))
                            at, moved = other, True
                            break
                        tried[at] += 1
                    if moved:
                        continue
                    if not path:
                        break
                    e, at = path.pop()
                    tried[at] += 1
                if not path:
                    break
                n = min(need[start], need[at], *(room(e, c) for e, c in path))
                for e, c in path:
                    flow[e] += n if ends[e][0] == c else -n
                need[start], need[at] = need[start] - n, need[at] - n
    return flow


def _strong_parts(nodes: Iterable[int], after: Mapping[int, Sequence[int]]) -> dict[int, int]:
    """A number for each node, the same where nodes can reach each other (two depth-first passes)."""
    order, seen = [], set()
    for start in nodes:
        if start in seen:
            continue
        seen.add(start)
        stack = [(start, iter(after.get(start, ())))]
        while stack:
            at, ahead = stack[-1]
            new = next((x for x in ahead if x not in seen), None)
            if new is None:
                order.append(at)
                stack.pop()
            else:
                seen.add(new)
                stack.append((new, iter(after.get(new, ()))))
    before: dict[int, list[int]] = defaultdict(list)
    for a, others in after.items():
        for b in others:
            before[b].append(a)
    part: dict[int, int] = {}
    for start in reversed(order):
        if start in part:
            continue
        part[start], todo = start, [start]
        while todo:
            for x in before[todo.pop()]:
                if x not in part:
                    part[x] = start
                    todo.append(x)
    return part


def components(rows: DataFrame, target: DataFrame) -> DataFrame:
    """(col_id, part): columns that hang together by rows have the same part, their smallest column.

    In each round every part is hooked to the smallest part that a row of it
    leads to, and the hooks are followed twice.
    """
    labels = written(target.select("col_id", F.col("col_id").alias("part")))
    while True:
        of_row = rows.join(labels, "col_id").groupBy("row_id").agg(F.min("part").alias("part"))
        near = rows.join(of_row, "row_id").groupBy("col_id").agg(F.min("part").alias("near"))
        met = labels.join(near, "col_id", "left").select("part", F.least("part", F.coalesce("near", "part")).alias("up"))
        hooks = written(met.groupBy("part").agg(F.min("up").alias("up")))
        if hooks.filter("up <> part").isEmpty():
            return labels
        for _ in range(2):
            further = hooks.select(F.col("part").alias("at"), F.col("up").alias("further"))
            hooks = written(hooks.join(further, F.col("up") == F.col("at"), "left").select("part", F.coalesce("further", "up").alias("up")))
        labels = written(labels.join(hooks, "part").select("col_id", F.col("up").alias("part")))


def cover_rows(rows: DataFrame, target: DataFrame, budget: int = 2_000_000) -> DataFrame:
    """row_id of all rows in some solution, from ``rows`` (row_id, col_id) and ``target`` (col_id, mult).

    A column ``copies`` of ``rows`` says how often a row may be used, else once.
    A column without rows, like a component without a solution, empties the
    result.
    """
    times = F.col("copies") if "copies" in rows.columns else F.lit(1)
    rows, target = cut(rows.select("row_id", "col_id", times.cast("bigint").alias("copies")).distinct()), cut(target.select("col_id", "mult"))
    if not target.filter("mult <= 0").isEmpty():
        raise ValueError("multiplicities must be positive")
    if not target.join(rows, "col_id", "left_anti").isEmpty():
        return rows.select("row_id").limit(0)
    outside = rows.join(target, "col_id", "left_anti").select("row_id").distinct()
    rows = written(rows.join(outside, "row_id", "left_anti"))
    labels = components(rows, target)
    of_row = rows.join(labels, "col_id")
    problem = of_row.join(target, "col_id").select("part", "row_id", "col_id", "mult", "copies")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        multiplicity = dict(zip(pdf["col_id"].tolist(), pdf["mult"].tolist(), strict=True))
        members: dict[int, list[int]] = defaultdict(list)
        for r, c in zip(pdf["row_id"].tolist(), pdf["col_id"].tolist(), strict=True):
            members[r].append(c)
        times = dict(zip(pdf["row_id"].tolist(), pdf["copies"].tolist(), strict=True))
        found = rows_in_solutions(multiplicity, members, budget, times)
        return pd.DataFrame({"row_id": pd.Series(sorted(found) or [None], dtype="Int64")})

    found = cut(problem.groupBy("part").applyInPandas(run, "row_id bigint"))
    unsolved = not found.filter("row_id is null").isEmpty()
    covered = target.join(problem, "col_id", "left_anti").isEmpty()
    return found.filter("row_id is not null") if covered and not unsolved else found.limit(0)
