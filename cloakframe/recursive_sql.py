"""SQL of the iterative partitionings, for DuckDB: recursive queries over window functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence


def mondrian_sql(table: str, rid: str, features: Sequence[str], sets: Sequence[str] = (), k: int = 1, sensitive: str = "NULL", side: Callable[[str], str] | None = None) -> str:
    """CTEs up to ``path_of`` (rid, path): strict median partitioning of ``table``.

    ``sets`` names the features that are categories.  ``side`` gives a further
    condition of the rows that meet a predicate, over the window ``p`` of their
    partition; it may use ``s``, the sensitive value.
    """
    names = [f"f{i}" for i in range(len(features))]
    is_set = {n: f in sets for n, f in zip(names, features, strict=True)}
    numbers, categories = [n for n in names if not is_set[n]], [n for n in names if is_set[n]]
    typed = ", ".join(f if is_set[n] else f"CAST({f} AS DOUBLE)" for n, f in zip(names, features, strict=True))
    scale = ", ".join(f"CAST({f'count(DISTINCT {f})' if is_set[n] else f'max({f}) - min({f})'} AS DOUBLE) AS z_{n}" for n, f in zip(names, features, strict=True))
    left = {n: f"rank_{n} <= many_{n} // 2" if is_set[n] else f"{n} < mid_{n}" for n in names}
    span = {n: f"(many_{n} / z_{n})" if is_set[n] else f"wide_{n}" for n in names}
    by = "WINDOW p AS (PARTITION BY path)"
    level = f"SELECT t.*, z.*{''.join(f', median({n}) OVER p AS mid_{n}, (max({n}) OVER p - min({n}) OVER p) / z_{n} AS wide_{n}' for n in numbers)}{''.join(f', min(rid) OVER (PARTITION BY path, {n}) AS seen_{n}' for n in categories)} FROM t CROSS JOIN z {by}"
    level = f"SELECT *{''.join(f', dense_rank() OVER (PARTITION BY path ORDER BY seen_{n}) AS rank_{n}' for n in categories)} FROM ({level})"
    level = f"SELECT *{''.join(f', max(rank_{n}) OVER p AS many_{n}' for n in categories)} FROM ({level}) {by}"
    tests = []
    for n in names:
        halves = [c for rows in (left[n], f"NOT ({left[n]})") for c in (f"count(*) FILTER ({rows}) OVER p >= {k}", *([side(rows)] if side else []))]
        tests.append(f"({' AND '.join(halves)}) AS ok_{n}")
    level = f"SELECT *, {', '.join(tests)} FROM ({level}) {by}"
    chosen = []
    for i, n in enumerate(names):
        wider = [f"NOT (ok_{m} AND {span[m]} {'>=' if j < i else '>'} {span[n]})" for j, m in enumerate(names) if m != n]
        chosen.append(f"WHEN {' AND '.join([f'ok_{n}', *wider])} THEN CASE WHEN {left[n]} THEN 'L' ELSE 'R' END")
    level = f"SELECT *, CASE {' '.join(chosen)} END AS half FROM ({level})"
    columns = ", ".join(names)
    return (
        f"WITH RECURSIVE z AS (SELECT {scale} FROM {table}), t(rid, s, {columns}, path) AS (SELECT {rid}, {sensitive}, {typed}, 'R' FROM {table} "
        f"UNION ALL SELECT rid, s, {columns}, path || half FROM ({level}) WHERE half IS NOT NULL), "
        "path_of AS (SELECT rid, max_by(path, length(path)) AS path FROM t GROUP BY rid)"
    )


def mdav_sql(table: str, rid: str, numbers: Sequence[str], k: int, sets: Sequence[str] = ()) -> str:
    """CTEs up to ``cluster_of`` (rid, cluster): maximum distance to average vector over standardised numbers and categories."""
    x, c = [f"x{i}" for i in range(len(numbers))], [f"c{i}" for i in range(len(sets))]
    every = [*x, *c]
    of = lambda form: ", ".join(form.format(n=n) for n in every)
    distance = lambda to: " + ".join(["sqrt(" + " + ".join(f"({n} - {to}_{n}) * ({n} - {to}_{n})" for n in x) + ")", *(f"CAST({n} <> {to}_{n} AS INT)" for n in c)])
    scaled = [f"(CAST({f} AS DOUBLE) - avg({f}) OVER ()) / stddev_samp({f}) OVER () AS {n}" for n, f in zip(x, numbers, strict=True)]
    first = "".join(f", min({rid}) OVER (PARTITION BY {f}) AS first_{n}" for n, f in zip(c, sets, strict=True))
    codes = [f"dense_rank() OVER (ORDER BY first_{n}) AS {n}" for n in c]
    start = f"SELECT rid, {', '.join([*x, *codes])} FROM (SELECT {rid} AS rid, {', '.join(scaled)}{first} FROM {table})"
    # what is left: its size and its centre (the mean, and the commonest category)
    left = f"SELECT *{''.join(f', count(*) OVER (PARTITION BY {n}) AS n_{n}' for n in c)} FROM t WHERE cluster IS NULL"
    centre = "".join(f", avg({n}) OVER () AS m_{n}" for n in x) + "".join(f", first_value({n}) OVER (ORDER BY n_{n} DESC, {n}) AS m_{n}" for n in c)
    left = f"SELECT *, count(*) OVER () AS n{centre} FROM ({left})"
    far = f"SELECT *, CASE WHEN second THEN {distance('r')} ELSE {distance('m')} END AS far FROM ({left})"
    picked = f"SELECT *, {of('first_value({n}) OVER (ORDER BY far DESC, rid) AS q_{n}')} FROM ({far})"
    near = f"SELECT *, row_number() OVER (ORDER BY {distance('q')}, rid) AS place FROM ({picked})"
    return (
        f"WITH RECURSIVE b AS ({start}), t(rid, {', '.join(every)}, cluster, step, second, {of('r_{n}')}) AS (SELECT rid, {', '.join(every)}, CAST(NULL AS INT), 0, false, {of('{n}')} FROM b "
        f"UNION ALL SELECT rid, {', '.join(every)}, CASE WHEN NOT second AND n < {2 * k} OR place <= {k} THEN step END, step + 1, NOT second AND n >= {3 * k}, {of('q_{n}')} FROM ({near})), "
        "cluster_of AS (SELECT rid, CAST(cluster AS BIGINT) AS cluster FROM t WHERE cluster IS NOT NULL)"
    )
