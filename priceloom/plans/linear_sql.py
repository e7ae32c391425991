"""SQL texts for checking linear models and principal components against an independent solution.

They only serve the comparison with another engine: moments come from SQL aggregates, linear
systems from Gaussian elimination, and eigenvectors from Jacobi rotations in a recursive query.
"""

from itertools import combinations, combinations_with_replacement


def moments_cte(name: str, source: str, columns: list[str], target: str) -> str:
    """One row: n, means m0.., mt, covariances a{i}_{j} (i <= j), b{i} with the target, tt."""
    parts = ["count(*) as n", f"avg({target}) as mt", f"var_pop({target}) as tt"]
    for i, c in enumerate(columns):
        parts += [f"avg({c}) as m{i}", f"covar_pop({c}, {target}) as b{i}"]
    for i, j in combinations_with_replacement(range(len(columns)), 2):
        parts.append(f"covar_pop({columns[i]}, {columns[j]}) as a{i}_{j}")
    return f"{name} as materialized (select {', '.join(parts)} from {source})"


def solve_ctes(name: str, moments: str, chosen: list[int], penalty: str = "0") -> str:
    """CTEs that solve the normal equations of the chosen columns; the last one, ``name``, has w{i} and w."""
    d = len(chosen)

    def a(i, j):
        lo, hi = sorted((chosen[i], chosen[j]))
        return f"a{lo}_{hi}"

    first = [f"{a(i, j)}{f' + {penalty}' if i == j else ''} as x{i}_{j}" for i in range(d) for j in range(d)]
    first += [f"b{chosen[i]} as y{i}" for i in range(d)]
    ctes = [f"{name}_0 as materialized (select {', '.join(first)} from {moments})"]
    for k in range(d):
        cells = []
        for i in range(d):
            for j in range(d):
                cells.append(f"x{i}_{j}" + (f" - x{i}_{k} * x{k}_{j} / x{k}_{k}" if i != k else "") + f" as x{i}_{j}")
            cells.append(f"y{i}" + (f" - x{i}_{k} * y{k} / x{k}_{k}" if i != k else "") + f" as y{i}")
        ctes.append(f"{name}_{k + 1} as materialized (select {', '.join(cells)} from {name}_{k})")
    weights = [f"y{i} / x{i}_{i} as w{chosen[i]}" for i in range(d)]
    ctes.append(f"{name}_w as materialized (select {', '.join(weights)} from {name}_{d})")
    intercept = "mt - " + " - ".join(f"w{c} * m{c}" for c in chosen)
    ctes.append(f"{name} as materialized (select {name}_w.*, {intercept} as w from {name}_w, {moments})")
    return ",\n".join(ctes)


def test_r2(model: str, moments: str, chosen: list[int]) -> str:
    """A scalar query: R2 of a solved model on the rows of ``moments``."""
    cross = " + ".join(f"w{i} * b{i}" for i in chosen)
    square = " + ".join(f"w{i} * w{j} * a{min(i, j)}_{max(i, j)}" for i in chosen for j in chosen)
    bias = "mt - w - " + " - ".join(f"w{i} * m{i}" for i in chosen)
    return (f"select 1 - (tt - 2 * ({cross}) + ({square}) + ({bias}) * ({bias})) / tt as r2 "
            f"from {model}, {moments}")


def selection_ctes(features: list[str]) -> str:
    """CTE ``path`` (step, feature_added, r2) from CTEs ``train_m`` and ``test_m``."""
    d = len(features)
    ctes, rows = [], []
    for size in range(1, d + 1):
        for chosen in combinations(range(d), size):
            name = "s" + "".join(map(str, chosen))
            ctes.append(solve_ctes(name, "train_m", list(chosen)))
            mask = sum(1 << i for i in chosen)
            rows.append(f"select {mask} as mask, {size} as size, r2 from ({test_r2(name, 'test_m', list(chosen))})")
    ctes.append(f"scores as materialized ({' union all '.join(rows)})")
    previous = "0"
    for step in range(1, d + 1):
        held = f"(mask & {previous}) = {previous}" if step > 1 else "true"
        ctes.append(f"step{step} as materialized (select mask, r2 from scores where size = {step} and {held} "
                    "order by r2 desc limit 1)")
        previous = f"(select mask from step{step})"
    added = []
    for step in range(1, d + 1):
        before = f"xor(mask, (select mask from step{step - 1}))" if step > 1 else "mask"
        names = " ".join(f"when {1 << i} then '{f}'" for i, f in enumerate(features))
        added.append(f"select {step}::bigint as step, case {before} {names} end as feature_added, r2 from step{step}")
    ctes.append(f"path as materialized ({' union all '.join(added)})")
    return ",\n".join(ctes)


def pca_ctes(source: str, columns: list[str], rotations: int = 100) -> str:
    """CTEs ``components`` (pc, value, ratio, loadings) and ``centre`` from scaled columns of ``source``.

    The largest loading of every component is positive. Lists are 1-based and row-major.
    """
    d = len(columns)
    pairs = list(combinations(range(1, d + 1), 2))
    cov = ", ".join(f"covar_pop({a}, {b})" for a in columns for b in columns)
    unit = ", ".join("1.0::double" if i == j else "0.0::double" for i in range(d) for j in range(d))
    ps = "[" + ", ".join(str(p) for p, _ in pairs) + "]"
    qs = "[" + ", ".join(str(q) for _, q in pairs) + "]"
    means = ", ".join(f"avg({c})" for c in columns)

    def at(m, i, j):
        return f"{m}[(({i}) - 1) * {d} + ({j})]"

    i, j = f"((e - 1) // {d} + 1)", f"((e - 1) % {d} + 1)"
    turn_columns = ("[case when {j} = p then c * {mp} - s * {mq} when {j} = q then s * {mp} + c * {mq} else {m}[e] end "
                    "for e in range(1, {n})]")
    turn_rows = ("[case when {i} = p then c * {mp} - s * {mq} when {i} = q then s * {mp} + c * {mq} else {m}[e] end "
                 "for e in range(1, {n})]")
    n = d * d + 1
    right = turn_columns.format(n=n, j=j, m="a", mp=at("a", i, "p"), mq=at("a", i, "q"))
    vectors = turn_columns.format(n=n, j=j, m="v", mp=at("v", i, "p"), mq=at("v", i, "q"))
    left = turn_rows.format(n=n, i=i, m="b", mp=at("b", "p", j), mq=at("b", "q", j))
    return f"""
centre as materialized (select [{means}] as mean from {source}),
jacobi as (
  select 0 as step, [{cov}] as a, [{unit}] as v from {source}
  union all
  select step + 1, {left} as a, v
  from (select step, p, q, c, s, {right} as b, {vectors} as v
        from (select *, 1 / sqrt(1 + t * t) as c, t / sqrt(1 + t * t) as s
              from (select *, case when abs(off) < 1e-300 then 0.0
                                   else (case when tau >= 0 then 1 else -1 end) / (abs(tau) + sqrt(1 + tau * tau)) end as t
                    from (select *, {at('a', 'p', 'q')} as off,
                                 ({at('a', 'q', 'q')} - {at('a', 'p', 'p')})
                                 / (2 * case when abs({at('a', 'p', 'q')}) < 1e-300 then 1 else {at('a', 'p', 'q')} end) as tau
                          from (select *, {ps}[step % {len(pairs)} + 1] as p, {qs}[step % {len(pairs)} + 1] as q
                                from jacobi where step < {rotations})))))
),
eigen as materialized (
  select k, a[(k - 1) * {d} + k] as value, [v[(i - 1) * {d} + k] for i in range(1, {d + 1})] as raw
  from jacobi, range(1, {d + 1}) as numbers(k) where step = {rotations}
),
components as materialized (
  select row_number() over (order by value desc) as pc, value, value / sum(value) over () as ratio,
         [x * case when list_max(raw) >= -list_min(raw) then 1 else -1 end for x in raw] as loadings
  from eigen
)"""


def scores_sql(columns: list[str], k: int, extra: str) -> str:
    """A query body: scores pc1..pck of the scaled columns of ``scaled``, with ``extra`` columns."""
    parts = []
    for pc in range(1, k + 1):
        terms = [f"({c} - (select mean[{i + 1}] from centre)) * (select loadings[{i + 1}] from components where pc = {pc})"
                 for i, c in enumerate(columns)]
        parts.append(f"{' + '.join(terms)} as pc{pc}")
    return f"select {extra}, {', '.join(parts)} from scaled"
