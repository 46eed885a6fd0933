"""DuckDB statements that give the results expected of the registered queries."""

from __future__ import annotations

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINE_XY = {"x1": "l_quantity", "x2": "l_extendedprice / 1000"}
EVENT_HOUR = "CAST(extract('hour' FROM ts) AS DOUBLE)"


def indexed(table: str, order: list[str], columns: str, keys: list[str] = ()) -> str:
    """Rows with their 0-based index in ``order``, per key."""
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return (
        f"SELECT *, row_number() OVER ({part}ORDER BY {', '.join(order)}) - 1 AS rn, {columns} "
        f"FROM {table}"
    )


def members(size: int, shift: int) -> str:
    """Rows of ``idx`` with the id of every window they belong to."""
    if size == shift:
        return f"SELECT *, rn // {size} AS win FROM idx"
    first = f"greatest(0, (rn - {size - shift}) // {shift})"
    first = f"CASE WHEN rn < {size - shift} THEN 0 ELSE {first} END"
    return (
        f"SELECT *, unnest(generate_series(CAST({first} AS BIGINT), rn // {shift})) AS win FROM idx"
    )


def gram(p: int, source: str, keys: list[str] = (), size: int | None = None) -> str:
    sums = ["count(*) AS n", "sum(y * y) AS yy"]
    sums += [f"sum(x{i} * y) AS b{i}" for i in range(1, p + 1)]
    sums += [f"sum(x{i} * x{j}) AS g{i}_{j}" for i in range(1, p + 1) for j in range(i, p + 1)]
    group = ", ".join([*keys, "win"])
    having = f" HAVING count(*) = {size}" if size else ""
    return f"SELECT {group}, {', '.join(sums)} FROM {source} GROUP BY {group}{having}"


def _g(i: int, j: int) -> str:
    return f"g{min(i, j)}_{max(i, j)}"


def chain(p: int, steps: int, rate: float, keys: list[str] = (), tol: float = 0.001) -> str:
    """Recursive walk over windows and steps; reads ``g``, defines ``chain``."""
    ws = [f"w{i}" for i in range(1, p + 1)]
    head = "".join(f"{k}, " for k in keys)
    zero = ", ".join(f"CAST(0 AS DOUBLE) AS {w}" for w in ws)
    new = []
    for i in range(1, p + 1):
        grad = " + ".join(f"{_g(i, j)} * c.w{j}" for j in range(1, p + 1))
        new.append(f"c.w{i} - {rate!r} / sqrt(c.it + 1) * ({grad} - b{i}) / n AS v{i}")
    moved = " + ".join(f"(v{i} - w{i}) ** 2" for i in range(1, p + 1))
    norm = " + ".join(f"v{i} ** 2" for i in range(1, p + 1))
    step = ", ".join(f"CASE WHEN done THEN w{i} ELSE v{i} END" for i in range(1, p + 1))
    start = f"SELECT DISTINCT {head}" if keys else "SELECT "
    origin = " FROM g" if keys else ""
    low = f"CAST(0 AS BIGINT) AS win"
    return (
        f"chain AS ({start}{low}, 0 AS it, {zero}, false AS done{origin} UNION ALL "
        f"SELECT {head}CASE WHEN done THEN win + 1 ELSE win END, "
        f"CASE WHEN done THEN 0 ELSE it + 1 END, {step}, "
        f"CASE WHEN done THEN false ELSE it + 1 >= {steps} OR (it + 1 >= 2 AND "
        f"sqrt({moved}) < {tol!r} * greatest(sqrt({norm}), 1)) END "
        f"FROM (SELECT c.*, {', '.join(new)} FROM chain c JOIN g USING ({', '.join([*keys, 'win'])})))"
    )


def trained(p: int, keys: list[str] = ()) -> str:
    """Weights and error of every window; reads ``chain`` and ``g``."""
    dot = " - ".join(["yy", *[f"2 * w{i} * b{i}" for i in range(1, p + 1)]])
    quad = " + ".join(
        f"w{i} * w{j} * {_g(i, j)}" for i in range(1, p + 1) for j in range(1, p + 1)
    )
    names = ", ".join([*keys, "win"])
    betas = ", ".join(f"w{i}" for i in range(1, p + 1))
    return (
        f"m AS (SELECT {names}, n, {betas}, ({dot} + {quad}) / n AS mse "
        f"FROM chain JOIN g USING ({names}) WHERE done)"
    )


def betas(p: int, digits: int = 2) -> str:
    return f"round(mse, {digits}) AS stderr, 0.0::DOUBLE AS beta0, " + ", ".join(
        f"round(w{i}, 6) AS beta{i}" for i in range(1, p + 1)
    )


def linreg(
    table: str, order: list[str], columns: str, carried: list[str], p: int,
    size: int, shift: int, steps: int, rate: float, keys: list[str] = (), digits: int = 2,
) -> str:
    """The regression over count windows, attached to the closing rows."""
    names = "".join(f"{k}, " for k in keys)
    on = " AND ".join(
        [f"idx.{k} = m.{k}" for k in keys]
        + [f"idx.rn >= {size - 1}", f"(idx.rn - {size - 1}) % {shift} = 0",
           f"(idx.rn - {size - 1}) // {shift} = m.win"]
    )
    kept = ", ".join(f"idx.{c}" for c in carried)
    return (
        f"WITH RECURSIVE idx AS ({indexed(table, order, columns, keys)}), "
        f"mem AS ({members(size, shift)}), g AS ({gram(p, 'mem', keys, size)}), "
        f"{chain(p, steps, rate, keys)}, {trained(p, keys)} "
        f"SELECT {kept}, {betas(p, digits)} FROM idx JOIN m ON {on}"
    )


def _dist(center: str, dims: int, row: str = "r") -> str:
    return " + ".join(f"({row}.x{j} - {center}.x{j}) ** 2" for j in range(1, dims + 1))


def kmeans_steps(
    dims: int, k: int, steps: int, size: int, shift: int, keys: list[str] = ()
) -> str:
    """CTEs of ``k``-means from the first different points; reads ``idx``.

    Defines ``c{steps}`` (keys, win, cid, x1…), ``asg`` (rows with cid and
    distance) and ``mem``.
    """
    names = ", ".join([*keys, "win"])
    xs = ", ".join(f"x{j}" for j in range(1, dims + 1))
    ctes = [
        f"alls AS ({members(size, shift)})",
        f"full_w AS (SELECT {names} FROM alls GROUP BY {names} HAVING count(*) = {size})",
        f"mem AS (SELECT alls.* FROM alls JOIN full_w USING ({names}))",
        f"dst AS (SELECT {names}, {xs}, min(rn) AS pos FROM mem GROUP BY {names}, {xs})",
        f"c0 AS (SELECT {names}, {xs}, cid FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY {names} ORDER BY pos) - 1 AS cid FROM dst) WHERE cid < {k})",
    ]

    def assigned(center: str) -> str:
        return (
            f"SELECT r.* EXCLUDE (cid, dist), cid, dist FROM (SELECT r.*, c.cid, {_dist('c', dims)} AS dist, "
            f"row_number() OVER (PARTITION BY {', '.join('r.' + n for n in [*keys, 'win'])}, r.rn "
            f"ORDER BY {_dist('c', dims)}, c.cid) AS nearest "
            f"FROM mem r JOIN {center} c ON "
            + " AND ".join(f"r.{n} = c.{n}" for n in [*keys, "win"])
            + ") r WHERE nearest = 1"
        )

    for i in range(1, steps + 1):
        means = ", ".join(f"avg(x{j}) AS x{j}" for j in range(1, dims + 1))
        keep = ", ".join(f"coalesce(n.x{j}, c.x{j}) AS x{j}" for j in range(1, dims + 1))
        ctes.append(f"a{i} AS ({assigned(f'c{i - 1}')})")
        ctes.append(f"n{i} AS (SELECT {names}, cid, {means} FROM a{i} GROUP BY {names}, cid)")
        ctes.append(
            f"c{i} AS (SELECT {', '.join('c.' + n for n in [*keys, 'win'])}, {keep}, c.cid "
            f"FROM c{i - 1} c LEFT JOIN n{i} n ON "
            + " AND ".join(f"c.{n} = n.{n}" for n in [*keys, "win", "cid"])
            + ")"
        )
    ctes.append(f"asg AS ({assigned(f'c{steps}')})")
    return ", ".join(ctes)


def kmeans(
    table: str, order: list[str], columns: str, carried: list[str], dims: int, k: int,
    size: int, shift: int, steps: int, keys: list[str] = (),
) -> str:
    """k-means attached to the closing rows, with numeric centre columns."""
    names = ", ".join([*keys, "win"])
    centers = ", ".join(
        f"round(max(CASE WHEN c.cid = {i} THEN c.x{j} END), 6) AS c{i}_{j - 1}"
        for i in range(k) for j in range(1, dims + 1)
    )
    closing = (
        f"SELECT *, (rn - {size - 1}) // {shift} AS win FROM idx "
        f"WHERE rn >= {size - 1} AND (rn - {size - 1}) % {shift} = 0"
    )
    kept = ", ".join(f"cl.{c}" for c in carried)
    return (
        f"WITH idx AS ({indexed(table, order, columns, keys)}), "
        f"{kmeans_steps(dims, k, steps, size, shift, keys)}, "
        f"cost AS (SELECT {names}, round(sum(dist), 4) AS stderr FROM asg GROUP BY {names}), "
        f"wide AS (SELECT {names}, {centers} FROM c{steps} c GROUP BY {names}), "
        f"cl AS ({closing}) "
        f"SELECT {kept}, stderr, wide.* EXCLUDE ({names}) "
        f"FROM cl JOIN cost USING ({names}) JOIN wide USING ({names})"
    )


def two_groups(table: str, order: list[str], columns: str, carried: list[str], size: int) -> str:
    """The means of the rows with x1 below 500 and of the others, in each window, on its closing row."""
    sides = (("low", "x1 < 500"), ("high", "x1 >= 500"))
    means = ", ".join(f"avg(x{j}) FILTER ({test}) AS {name}_{j - 1}" for name, test in sides for j in (1, 2))
    gaps = " + ".join(f"(x{j} - CASE WHEN x1 < 500 THEN low_{j - 1} ELSE high_{j - 1} END) ** 2" for j in (1, 2))
    rounded = ", ".join(f"round({name}_{j}, 6) AS {name}_{j}" for name, _ in sides for j in (0, 1))
    return (
        f"WITH idx AS (SELECT *, rn // {size} AS win FROM ({indexed(table, order, columns)})), "
        f"m AS (SELECT win, {means} FROM idx GROUP BY win), "
        f"cost AS (SELECT win, round(sum({gaps}), 2) AS stderr FROM idx JOIN m USING (win) GROUP BY win) "
        f"SELECT {', '.join(carried)}, stderr, {rounded} FROM idx JOIN m USING (win) JOIN cost USING (win) "
        f"WHERE rn % {size} = {size - 1}"
    )


def kmeans_history(
    table: str, order: list[str], columns: str, size: int, steps: int, alpha: float,
) -> str:
    """Two held centres in the plane: each window's centres join the nearest, history decays."""
    near = [
        f"((o.x{i} - h.a1) ** 2 + (o.y{i} - h.b1) ** 2 < (o.x{i} - h.a0) ** 2 + (o.y{i} - h.b0) ** 2)"
        for i in (0, 1)
    ]

    def gained(value: str, j: int) -> str:
        return " + ".join(
            f"CASE WHEN {'' if j else 'NOT '}{near[i]} THEN {value.format(i=i)} ELSE 0 END" for i in (0, 1)
        )

    grown = []
    for j in (0, 1):
        m = f"({gained('o.m{i}', j)})"
        grown.append(f"h.n{j} * {alpha!r} + {m}")
        for c, x in (("a", "x"), ("b", "y")):
            moved = gained("o.m{i} * o." + x + "{i}", j)
            grown.append(
                f"CASE WHEN {m} > 0 THEN (h.{c}{j} * h.n{j} * {alpha!r} + {moved}) / "
                f"(h.n{j} * {alpha!r} + {m}) ELSE h.{c}{j} END"
            )
    own = ", ".join(
        f"max(CASE WHEN cid = {i} THEN m END) AS m{i}, max(CASE WHEN cid = {i} THEN x1 END) AS x{i}, "
        f"max(CASE WHEN cid = {i} THEN x2 END) AS y{i}"
        for i in (0, 1)
    )
    each = " UNION ALL ".join(
        f"SELECT win AS window_id, {j}::BIGINT AS cluster_id, round(n{j}, 6) AS weight, "
        f"round(a{j}, 6) AS center_0, round(b{j}, 6) AS center_1 FROM h"
        for j in (0, 1)
    )
    return (
        f"WITH RECURSIVE idx AS ({indexed(table, order, columns)}), "
        f"{kmeans_steps(2, 2, steps, size, size)}, "
        "cnt AS (SELECT win, cid, count(*)::DOUBLE AS m FROM asg GROUP BY win, cid), "
        f"own AS MATERIALIZED (SELECT win, {own} FROM c{steps} JOIN cnt USING (win, cid) GROUP BY win), "
        "h(win, n0, a0, b0, n1, a1, b1) AS (SELECT win, m0, x0, y0, m1, x1, y1 FROM own WHERE win = 0 "
        f"UNION ALL SELECT o.win, {', '.join(grown)} FROM h JOIN own o ON o.win = h.win + 1) "
        f"{each}"
    )


def drawn(p: int, steps: int, fraction: float, seed: int) -> str:
    """Sums over the rows that each step of a window draws; reads ``mem``."""
    unit = (
        f"CAST('0x' || substr(md5(concat_ws('|', rn, step, {seed})), 1, 8) AS BIGINT) / 4294967296.0"
    )
    rows = (
        f"(SELECT * FROM (SELECT *, unnest(generate_series(1, {steps})) AS step FROM mem) "
        f"WHERE {unit} < {fraction!r}) drawn"
    )
    sums = gram(p, rows, ["step"])
    return f"gs AS MATERIALIZED ({sums})"


def linreg_drawn(
    table: str, order: list[str], columns: str, carried: list[str], p: int,
    size: int, steps: int, rate: float, fraction: float, seed: int, digits: int = 2,
) -> str:
    """The regression whose steps each train on a drawn share of the window."""
    walk = chain(p, steps, rate).replace(
        "FROM chain c JOIN g USING (win)",
        f"FROM chain c JOIN gs ON gs.win = c.win AND gs.step = least(c.it + 1, {steps})",
    )
    kept = ", ".join(f"idx.{c}" for c in carried)
    return (
        f"WITH RECURSIVE idx AS ({indexed(table, order, columns)}), "
        f"mem AS ({members(size, size)}), g AS ({gram(p, 'mem', [], size)}), "
        f"{drawn(p, steps, fraction, seed)}, {walk}, {trained(p)} "
        f"SELECT {kept}, {betas(p, digits)} FROM idx JOIN m ON idx.rn >= {size - 1} AND "
        f"(idx.rn - {size - 1}) % {size} = 0 AND (idx.rn - {size - 1}) // {size} = m.win"
    )


def two_kernels(factor: float) -> str:
    """The walk of two kernels over the values of each event type, row by row.

    A kernel is (rows n, sum s, sum of squares q). A row joins the nearest kernel if it
    is within its reach: the distance to the other one for a single row, else ``factor``
    deviations. Otherwise it opens the second kernel, or the two are merged to make room.
    """
    gap = "(sb / nb - sa / na) ** 2"

    def reach(x: str) -> str:
        return (
            f"CASE WHEN n{x} < 2 THEN coalesce({gap}, 0.0) ELSE {factor ** 2} * "
            f"greatest(0.0, q{x} / n{x} - (s{x} / n{x}) ** 2) END"
        )

    near_b = "(nb IS NOT NULL AND (sb / nb - v) ** 2 < (sa / na - v) ** 2)"
    joins_a = f"(NOT {near_b} AND (sa / na - v) ** 2 <= {reach('a')})"
    joins_b = f"({near_b} AND (sb / nb - v) ** 2 <= {reach('b')})"
    step = ", ".join(
        f"CASE WHEN {joins_a} THEN {x}a + {d} WHEN {joins_b} OR nb IS NULL THEN {x}a ELSE {x}a + {x}b END AS {x}a, "
        f"CASE WHEN {joins_a} THEN {x}b WHEN {joins_b} THEN {x}b + {d} ELSE {d} END AS {x}b"
        for x, d in (("n", "1.0"), ("s", "v"), ("q", "v * v"))
    )
    return (
        "WITH RECURSIVE r AS MATERIALIZED (SELECT event_id, user_id, event_type, value, value AS v, "
        "row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events), "
        "walk(event_type, rn, na, nb, sa, sb, qa, qb) AS ("
        "SELECT event_type, rn, 1.0::DOUBLE, NULL::DOUBLE, v, NULL::DOUBLE, v * v, NULL::DOUBLE "
        "FROM r WHERE rn = 1 UNION ALL "
        f"SELECT event_type, rn, na, nb, sa, sb, qa, qb FROM (SELECT r.event_type, r.rn, {step} "
        "FROM walk w JOIN r ON r.event_type = w.event_type AND r.rn = w.rn + 1)) "
        "SELECT event_id, user_id, event_type, value, "
        "round(least(sa / na, sb / nb), 6) AS low, "
        "round(CASE WHEN nb IS NOT NULL THEN greatest(sa / na, sb / nb) END, 6) AS high "
        "FROM walk JOIN r USING (event_type, rn)"
    )
