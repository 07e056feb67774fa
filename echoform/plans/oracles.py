"""SQL of order-dependent fits: recursive queries that learn one row of every model at a time.

The state of a model g is a list of weights (and one of the classes they belong to);
each step picks a category from lists of structs and gives the next state. Rows come
from a CTE p(g, i, k, x, ...) with k = 1, 2, ... in order inside a model. Indices of
categories are from 1 inside.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Terms:
    """A kernel in SQL: choice and match of lists x and w (ws: all weights), update and new weight; x: the input's form."""

    choice: str
    match: str
    rho: float
    update: str
    new: str


def scaled(table: str, model: str, key: str, a: str, b: str) -> str:
    """n(g, i, k, u, v): two columns of a table brought to [0, 1], in order of a key inside each model."""
    return f"""b AS (SELECT min({a})::DOUBLE AS a0, max({a})::DOUBLE AS z0, min({b})::DOUBLE AS a1, max({b})::DOUBLE AS z1 FROM {table}),
n AS (SELECT {model}::VARCHAR AS g, {key} AS i, row_number() OVER (PARTITION BY {model} ORDER BY {key}) AS k, CASE WHEN z0 = a0 THEN 0 ELSE ({a} - a0) / (z0 - a0) END AS u, CASE WHEN z1 = a1 THEN 0 ELSE ({b} - a1) / (z1 - a1) END AS v FROM {table}, b)"""


CUSTOMER = scaled("customer", "c_nationkey", "c_custkey", "c_custkey % 101", "c_acctbal")
CODED = "[u, v, 1 - u, 1 - v]"
BITS = "[" + ", ".join(f"(floor({c} * 4) > {i})::DOUBLE" for c in "uv" for i in range(4)) + "]"
BITS_CODED = f"list_concat({BITS}, list_transform({BITS}, lambda v: 1 - v))"


def fuzzy(rho: float, alpha: float) -> Terms:
    both = "list_sum(list_transform(list_zip(x, w), lambda z: least(z[1], z[2])))"
    return Terms(f"{both} / ({alpha!r} + list_sum(w))", f"{both} / (len(x) / 2)", rho, "list_transform(list_zip(x, w), lambda z: least(z[1], z[2]))", "x")


def hypersphere(rho: float, alpha: float, r_hat: float) -> Terms:
    """Any number of columns; beta 1."""
    r = "sqrt(list_sum(list_transform(list_zip(x, w[1:len(x)]), lambda z: (z[1] - z[2]) ** 2)))"
    radius = "w[len(x) + 1]"
    move = f"0.5 * (1 - CASE WHEN {r} + {alpha!r} > 0 THEN least({radius}, {r}) / ({r} + {alpha!r}) ELSE 1 END)"
    update = f"list_append(list_transform(list_zip(x, w[1:len(x)]), lambda z: z[2] + {move} * (z[1] - z[2])), {radius} + 0.5 * (greatest({radius}, {r}) - {radius}))"
    return Terms(f"({r_hat!r} - greatest({radius}, {r})) / ({r_hat!r} - {radius} + {alpha!r})", f"1 - greatest({radius}, {r}) / {r_hat!r}", rho, update, "list_append(x, 0.0)")


def gaussian(rho: float, alpha: float, sigma: float, d: int) -> Terms:
    """Weight [mean, sigma, 1 / sigma^2, sqrt(det), count] of d columns."""
    part = lambda k: f"w[{k * d + 1}:{k * d + d}]"
    count = f"w[{3 * d + 2}]"
    e = f"exp(-0.5 * list_sum(list_transform(list_zip(x, {part(0)}, {part(2)}), lambda z: (z[2] - z[1]) ** 2 * z[3])))"
    mean = "((1 - 1 / (@ + 1)) * z[2] + z[1] / (@ + 1))".replace("@", count)
    square = f"((1 - 1 / ({count} + 1)) * z[3] ** 2 + ({mean} - z[1]) ** 2 / ({count} + 1))"
    over = lambda what: f"list_transform(list_zip(x, {part(0)}, {part(1)}), lambda z: {what})"
    update = f"list_concat({over(mean)}, {over(f'sqrt({square})')}, {over(f'1 / {square}')}, [sqrt(list_product({over(square)})), {count} + 1])"
    new = f"list_concat(x, list_transform(x, lambda v: {sigma!r}), list_transform(x, lambda v: 1 / {sigma!r} ** 2), [sqrt(list_product(list_transform(x, lambda v: {sigma!r} ** 2))), 1.0])"
    return Terms(f"{e} / ({alpha!r} + w[{3 * d + 1}]) * {count} / list_sum(list_transform(ws, lambda q: q[{3 * d + 2}]))", e, rho, update, new)


def ellipsoid(rho: float, alpha: float, mu: float, r_hat: float) -> Terms:
    """Two columns, beta 1: weight [centre, axis, radius]."""
    square = "((x[1] - w[1]) ** 2 + (x[2] - w[2]) ** 2)"
    along = "(w[3] * (x[1] - w[1]) + w[4] * (x[2] - w[2]))"
    r = f"(CASE WHEN w[3] <> 0 OR w[4] <> 0 THEN sqrt(greatest({square} - (1 - {mu!r} ** 2) * {along} ** 2, 0)) / {mu!r} ELSE sqrt({square}) END)"
    most = f"greatest(w[5], {r})"
    ratio = f"(CASE WHEN {r} = 0 THEN 1 ELSE least(w[5], {r}) / {r} END)"
    c = [f"(w[{k}] + 0.5 * (x[{k}] - w[{k}]) * (1 - {ratio}))" for k in (1, 2)]
    size = f"sqrt((x[1] - {c[0]}) ** 2 + (x[2] - {c[1]}) ** 2)"
    axis = [f"(CASE WHEN w[5] <> 0 AND {size} <> 0 THEN (x[{k}] - {c[k - 1]}) / {size} ELSE w[{k + 2}] END)" for k in (1, 2)]
    return Terms(f"({r_hat!r} - w[5] - {most}) / nullif({r_hat!r} - 2 * w[5] + {alpha!r}, 0)", f"1 - (w[5] + {most}) / {r_hat!r}", rho, f"[{', '.join([*c, *axis])}, w[5] + 0.5 * ({most} - w[5])]", "[x[1], x[2], 0.0, 0.0, 0.0]")


def bayesian(rho: float, variance: float) -> Terms:
    """Two columns: weight [mean, covariance by rows, count]; the determinant is bounded from above."""
    det = "(w[3] * w[6] - w[4] * w[5])"
    gap = ["(x[1] - w[1])", "(x[2] - w[2])"]
    power = f"(w[6] * {gap[0]} ** 2 - (w[4] + w[5]) * {gap[0]} * {gap[1]} + w[3] * {gap[1]} ** 2) / {det}"
    mean = [f"((1 - 1 / (w[7] + 1)) * w[{k}] + x[{k}] / (w[7] + 1))" for k in (1, 2)]
    cov = [f"(w[7] / (w[7] + 1) * w[{3 + 2 * i + j}] + (x[{i + 1}] - {mean[i]}) * (x[{j + 1}] - {mean[j]}) / (w[7] + 1))" for i in (0, 1) for j in (0, 1)]
    choice = f"exp(-0.5 * {power}) / sqrt((2 * pi()) ** 2 * {det}) * w[7] / list_sum(list_transform(ws, lambda q: q[7]))"
    return Terms(choice, f"-({cov[0]} * {cov[3]} - {cov[1]} * {cov[2]})", -rho, f"[{', '.join([*mean, *cov])}, w[7] + 1]", f"[x[1], x[2], {variance!r}, 0.0, 0.0, {variance!r}, 1.0]")


def quadratic(rho: float, s: float, rate: float) -> Terms:
    """Two columns: weight [A by rows, b, s]."""
    gap = ["(w[1] * x[1] + w[2] * x[2] - w[5])", "(w[3] * x[1] + w[4] * x[2] - w[6])"]
    far = f"({gap[0]} ** 2 + {gap[1]} ** 2)"
    t = f"exp(-(w[7] * w[7]) * {far})"
    pull = [f"(2 * w[7] * w[7] * {t} * {g})" for g in gap]
    a = [f"w[{2 * i + j + 1}] - {rate!r} * {pull[i]} * x[{j + 1}]" for i in (0, 1) for j in (0, 1)]
    return Terms(t, t, rho, f"[{', '.join(a)}, w[5] + {rate!r} * {pull[0]}, w[6] + {rate!r} * {pull[1]}, w[7] - {rate!r} * 2 * w[7] * {t} * {far}]", f"[1.0, 0.0, 0.0, 1.0, x[1], x[2], {s!r}]")


def art1(rho: float, l: float) -> Terms:  # noqa: E741
    """Weight [bottom-up, top-down]; updated weights have float precision."""
    top = "list_transform(list_zip(x, w[len(x) + 1:2 * len(x)]), lambda z: z[1] * (z[2] <> 0)::INT)"
    scale = f"({l!r} / ({l!r} - 1 + list_sum({top})))::FLOAT"
    update = f"list_concat(list_transform({top}, lambda v: ({scale} * v::FLOAT)::FLOAT::DOUBLE), {top})"
    return Terms("list_sum(list_transform(list_zip(x, w[1:len(x)]), lambda z: z[1] * z[2]))", f"list_sum({top}) / len(x)", rho, update, f"list_concat(list_transform(x, lambda v: {l!r} / ({l!r} - 1 + len(x)) * v), x)")


def _next(terms: Terms, ws: str, best: str, x: str = "x") -> str:
    """The weights after a row: the best category learns it, or a new one is added."""
    return f"CASE WHEN {best} IS NULL THEN list_append({ws}, {terms.new}) ELSE list_transform({ws}, lambda w, j: CASE WHEN j = {best} THEN {terms.update} ELSE w END) END"


def _first(terms: Terms, ws: str, match: str = ">=") -> str:
    """The most active category that passes the vigilance, the older one of equals."""
    return f"-list_max(list_filter(list_transform({ws}, lambda w, j: CASE WHEN ({terms.match}) {match} {terms.rho!r} THEN {{'t': ({terms.choice})::DOUBLE, 'k': -j}} END), lambda s: s IS NOT NULL AND s.t IS NOT NULL)).k"


def _mapped(terms: Terms, ws: str, cs: str, y: str, method: str = "MT+", epsilon: float = 1e-10) -> str:
    """The category that takes a row of class y, under a tracking method."""
    return _searched(terms, ws, f"{cs}[j] = {y}", method, epsilon)


def _searched(terms: Terms, ws: str, ok: str, method: str = "MT+", epsilon: float = 1e-10) -> str:
    """The category that takes a row, of those that a test of w and j allows: refused ones that passed raise the bar for later ones."""
    strict = method in ("MT0", "MT~")
    passed = ">" if strict else ">="
    listed = f"list_sort(list_filter(list_transform({ws}, lambda w, j: {{'a': -(({terms.choice})::DOUBLE), 'j': j, 'm': ({terms.match})::DOUBLE, 'ok': coalesce(({ok})::BOOLEAN, false)}}), lambda s: s.m {passed} {terms.rho!r}))"
    if method == "MT~":
        return f"list_filter({listed}, lambda s: s.ok)[1].j"
    before = "list_max(list_transform(list_filter(found[1:r - 1], lambda q: NOT q.ok), lambda q: q.m))"
    if method == "MT1":
        rule = f"{before} IS NULL"
    else:
        rule = f"coalesce(s.m {passed} {before} + {dict([('MT+', epsilon), ('MT-', -epsilon), ('MT0', 0.0)])[method]!r}, true)"
    return f"list_filter(list_transform([{listed}], lambda found: list_filter(found, lambda s, r: s.ok AND {rule})[1].j), lambda v: v IS NOT NULL)[1]"


def _state(fields: dict[str, str], step: str, inner: str, start: str = "") -> str:
    """f(g, k, ...): a state for each model, blank (or that of a query) at k = 0, then a step for each row."""
    names = ", ".join(fields)
    return f"""f(g, k, {names}) AS (
  {start or f"SELECT DISTINCT g, 0::BIGINT, {', '.join(fields.values())} FROM p"}
  UNION ALL
  SELECT g, k, {step} FROM ({inner}))"""


#: The next row of each model beside its state.
JOIN = "FROM f JOIN p ON p.g = f.g AND p.k = f.k + 1"
LAST = "z AS MATERIALIZED (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY g ORDER BY k DESC) = 1)"
_W, _C = "[]::DOUBLE[][]", "[]::BIGINT[]"


def fit(rows: str, terms: Terms) -> str:
    """model, sample_id, cluster_id of a clustering."""
    state = _state({"i": "0::BIGINT", "ws": _W, "c": "-1::BIGINT"}, f"i, {_next(terms, 'ws', 'best')}, coalesce(best, len(ws) + 1) - 1", f"SELECT p.g, p.k, p.i, x, ws, {_first(terms, 'ws')} AS best {JOIN}")
    return f"WITH RECURSIVE {rows},\n{state}\nSELECT g AS model, i AS sample_id, c AS cluster_id FROM f WHERE k > 0"


def sizes(rows: str, terms: Terms) -> str:
    """model, cluster_id and n, the rows that each category learnt."""
    return f"SELECT model, cluster_id::INT AS cluster_id, count(*) AS n FROM ({fit(rows, terms)}) GROUP BY ALL"


def applied(rows: str, terms: Terms) -> str:
    """model, cluster_id and n, the rows that the fitted model puts into each category."""
    state = _state({"ws": _W}, _next(terms, "ws", "best"), f"SELECT p.g, p.k, x, ws, {_first(terms, 'ws')} AS best {JOIN}")
    top = f"-list_max(list_transform(ws, lambda w, j: {{'t': ({terms.choice})::DOUBLE, 'k': -j}})).k - 1"
    return f"WITH RECURSIVE {rows},\n{state}, {LAST}\nSELECT model, cluster_id, count(*) AS n FROM (SELECT p.g AS model, {top} AS cluster_id FROM p JOIN z ON p.g = z.g) GROUP BY ALL"


def predicted(rows: str, terms: Terms, every: str) -> str:
    """model, sample_id, cluster_id of other rows (g, i, x) under the fitted models."""
    state = _state({"ws": _W}, _next(terms, "ws", "best"), f"SELECT p.g, p.k, x, ws, {_first(terms, 'ws')} AS best {JOIN}")
    top = f"-list_max(list_transform(ws, lambda w, j: {{'t': ({terms.choice})::DOUBLE, 'k': -j}})).k - 1"
    return f"WITH RECURSIVE {rows},\n{state}, {LAST}\nSELECT e.g AS model, i AS sample_id, {top} AS cluster_id FROM ({every}) e JOIN z ON e.g = z.g"


def allowed(rows: str, terms: Terms, test: str, method: str = "MT+", epsilon: float = 0.0, more: str = "") -> str:
    """model, sample_id, cluster_id where a category takes a row only if a test of x, w and j holds."""
    state = _state({"i": "0::BIGINT", "ws": _W, "c": "-1::BIGINT"}, f"i, {_next(terms, 'ws', 'best')}, coalesce(best, len(ws) + 1) - 1", f"SELECT p.g, p.k, p.i, x, ws, {_searched(terms, 'ws', test, method, epsilon)} AS best {JOIN}")
    return f"WITH RECURSIVE {rows},\n{state}\nSELECT g AS model, i AS sample_id, c AS cluster_id FROM f WHERE k > 0{more}"


def at_step(rows: str, terms: Terms, step: int) -> str:
    """model, cluster_id, w: the weights of each model after a step."""
    state = _state({"ws": _W}, _next(terms, "ws", "best"), f"SELECT p.g, p.k, x, ws, {_first(terms, 'ws')} AS best {JOIN} AND p.k <= {step}")
    return f"WITH RECURSIVE {rows},\n{state}, {LAST}\nSELECT g AS model, (unnest(range(len(ws))))::INT AS cluster_id, unnest(list_transform(ws, lambda w: list_transform(w, lambda v: round(v, 6)))) AS w FROM z"


def capped(rows: str, terms: Terms, most: int) -> str:
    """model, sample_id, cluster_id where a category takes at most so many rows; one that is full and passes raises the bar."""
    counts = "CASE WHEN best IS NULL THEN list_append(ns, 1) ELSE list_transform(ns, lambda n, j: CASE WHEN j = best THEN n + 1 ELSE n END) END"
    state = _state({"i": "0::BIGINT", "ws": _W, "ns": _C, "c": "-1::BIGINT"}, f"i, {_next(terms, 'ws', 'best')}, {counts}, coalesce(best, len(ws) + 1) - 1", f"SELECT p.g, p.k, p.i, x, ws, ns, {_searched(terms, 'ws', f'ns[j] < {most}', 'MT+', 0.0)} AS best {JOIN}")
    return f"WITH RECURSIVE {rows},\n{state}\nSELECT g AS model, i AS sample_id, c AS cluster_id FROM f WHERE k > 0"


def mapped_fused(rows: str, channels: list[Terms], gamma: list[float]) -> str:
    """model, sample_id, cluster_id, predicted: fused channels as the module of a map onto the classes y of rows p(g, i, k, x0, x1, ..., y)."""
    best = _fused_search(channels, gamma, "cs[j] = y")
    names = ", ".join(f"x{i}" for i in range(len(channels)))
    learnt = ", ".join(channel(c.update, i) for i, c in enumerate(channels))
    step = f"CASE WHEN best IS NULL THEN list_append(ws, [{names}]) ELSE list_transform(ws, lambda w, j: CASE WHEN j = best THEN [{learnt}] ELSE w END) END, CASE WHEN best IS NULL THEN list_append(cs, y) ELSE cs END"
    state = _state({"ws": "[]::DOUBLE[][][]", "cs": _C}, step, f"SELECT p.g, p.k, {names}, y, ws, cs, {best} AS best {JOIN}")
    found = f"SELECT p.g, p.i, cs, {chosen(channels, gamma, ())} AS j FROM p JOIN z ON p.g = z.g"
    return f"WITH RECURSIVE {rows},\n{state}, {LAST}\nSELECT g AS model, i AS sample_id, j - 1 AS cluster_id, cs[j] AS predicted FROM ({found})"


def dual(rows: str, terms: Terms, lower: float) -> str:
    """model, sample_id, cluster_id under two vigilances."""
    found = f"list_max(list_filter(list_transform(ws, lambda w, j: CASE WHEN ({terms.match}) >= {lower!r} AND ({terms.choice}) > 0 THEN {{'t': ({terms.choice})::DOUBLE, 'k': -j, 'm': ({terms.match})::DOUBLE}} END), lambda s: s IS NOT NULL))"
    inner = f"SELECT *, CASE WHEN s.m >= {terms.rho!r} THEN -s.k END AS best, CASE WHEN s IS NULL THEN coalesce(list_max(cs), -1) + 1 ELSE cs[-s.k] END AS label FROM (SELECT p.g, p.k, p.i, x, ws, cs, {found} AS s {JOIN})"
    state = _state({"i": "0::BIGINT", "ws": _W, "cs": _C, "c": "-1::BIGINT"}, f"i, {_next(terms, 'ws', 'best')}, CASE WHEN best IS NULL THEN list_append(cs, label) ELSE cs END, label", inner)
    return f"WITH RECURSIVE {rows},\n{state}\nSELECT g AS model, i AS sample_id, c AS cluster_id FROM f WHERE k > 0"


def artmap(rows: str, terms: Terms, method: str = "MT+", epsilon: float = 1e-10, vigilant: bool = False) -> str:
    """model, sample_id, cluster_id, predicted of all rows p(g, i, k, x, y) after a supervised fit."""
    top = f"list_max(list_transform(ws, lambda w, j: {{'t': ({terms.choice})::DOUBLE, 'k': -j}})).k"
    best = f"coalesce({_first(terms, 'ws')}, 1)" if vigilant else f"-{top}"
    inner = f"SELECT p.g, p.k, x, y, ws, cs, {_mapped(terms, 'ws', 'cs', 'y', method, epsilon)} AS best {JOIN}"
    state = _state({"ws": _W, "cs": _C}, f"{_next(terms, 'ws', 'best')}, CASE WHEN best IS NULL THEN list_append(cs, y) ELSE cs END", inner)
    return f"WITH RECURSIVE {rows},\n{state}, {LAST}\nSELECT g AS model, i AS sample_id, best - 1 AS cluster_id, cs[best] AS predicted FROM (SELECT p.g, p.i, cs, {best} AS best FROM p JOIN z ON p.g = z.g)"


def smart(rows: str, levels: list[Terms]) -> str:
    """model, sample_id, level0, level1, ...: each level's clusters are the next one's classes."""
    n = range(1, len(levels))
    base, rest = levels[0], levels[1:]
    inner = f"SELECT p.g, p.k, p.i, x, {', '.join(f'w{m}' for m in range(len(levels)))}, {', '.join(f'c{m}' for m in n)}, {_first(base, 'w0')} AS b0 {JOIN}"
    inner = f"SELECT *, coalesce(b0, len(w0) + 1) - 1 AS l0 FROM ({inner})"
    for m, terms in zip(n, rest, strict=True):
        inner = f"SELECT *, coalesce(b{m}, len(w{m}) + 1) - 1 AS l{m} FROM (SELECT *, {_mapped(terms, f'w{m}', f'c{m}', f'l{m - 1}', 'MT+', 0.0)} AS b{m} FROM ({inner}))"
    fields = {"i": "0::BIGINT"} | {f"w{m}": _W for m in range(len(levels))} | {f"c{m}": _C for m in n} | {f"l{m}": "-1::BIGINT" for m in range(len(levels))}
    grown = [_next(t, f"w{m}", f"b{m}") for m, t in enumerate(levels)] + [f"CASE WHEN b{m} IS NULL THEN list_append(c{m}, l{m - 1}) ELSE c{m} END" for m in n] + [f"l{m}" for m in range(len(levels))]
    return f"WITH RECURSIVE {rows},\n{_state(fields, 'i, ' + ', '.join(grown), inner)}\nSELECT g AS model, i AS sample_id, {', '.join(f'l{m} AS level{m}' for m in range(len(levels)))} FROM f WHERE k > 0"


def deep(rows: str, levels: list[Terms]) -> str:
    """model, sample_id, level0 (the class), level1, ... of all rows p(g, i, k, x, y) after a supervised hierarchy: prediction by the last level."""
    n = range(1, len(levels) + 1)
    inner = f"SELECT p.g, p.k, x, y AS l0, {', '.join(f'w{m}, c{m}' for m in n)} {JOIN}"
    for m, terms in zip(n, levels, strict=True):
        inner = f"SELECT *, coalesce(b{m}, len(w{m}) + 1) - 1 AS l{m} FROM (SELECT *, {_mapped(terms, f'w{m}', f'c{m}', f'l{m - 1}', 'MT+', 0.0)} AS b{m} FROM ({inner}))"
    grown = [f"{_next(t, f'w{m}', f'b{m}')}, CASE WHEN b{m} IS NULL THEN list_append(c{m}, l{m - 1}) ELSE c{m} END" for m, t in zip(n, levels, strict=True)]
    last = len(levels)
    names = [f"q{last}"]
    found = f"SELECT p.g, p.i, {', '.join(f'c{m}' for m in n)}, -list_max(list_transform(w{last}, lambda w, j: {{'t': ({levels[-1].choice})::DOUBLE, 'k': -j}})).k - 1 AS q{last} FROM p JOIN z ON p.g = z.g"
    for m in reversed(n):
        found = f"SELECT *, c{m}[q{m} + 1] AS q{m - 1} FROM ({found})"
        names.append(f"q{m - 1}")
    fields = {c: kind for m in n for c, kind in ((f"w{m}", _W), (f"c{m}", _C))}
    return f"WITH RECURSIVE {rows},\n{_state(fields, ', '.join(grown), inner)}, {LAST}\nSELECT g AS model, i AS sample_id, {', '.join(f'{q} AS level{q[1:]}' for q in reversed(names))} FROM ({found})"


def two_sided(rows: str, a: Terms, b: Terms, epsilon: float = 1e-10) -> str:
    """model, sample_id, cluster_b and value (centre of the target cluster) of rows p(g, i, k, x, t) after ARTMAP with one coded target."""
    choose_b = _first(b, "vs").replace("list_zip(x, w)", "list_zip(t, w)").replace("len(x)", "len(t)")
    next_b = _next(b, "vs", "bb").replace("list_append(vs, x)", "list_append(vs, t)").replace("list_zip(x, w)", "list_zip(t, w)")
    top = f"-list_max(list_transform(ws, lambda w, j: {{'t': ({a.choice})::DOUBLE, 'k': -j}})).k"
    inner = f"SELECT *, {_mapped(a, 'ws', 'cs', 'lb', 'MT+', epsilon)} AS ba FROM (SELECT *, coalesce(bb, len(vs) + 1) - 1 AS lb FROM (SELECT p.g, p.k, x, t, ws, cs, vs, {choose_b} AS bb {JOIN}))"
    state = _state({"ws": _W, "cs": _C, "vs": _W}, f"{_next(a, 'ws', 'ba')}, CASE WHEN ba IS NULL THEN list_append(cs, lb) ELSE cs END, {next_b}", inner)
    return f"""WITH RECURSIVE {rows},
{state}, {LAST}
SELECT g AS model, i AS sample_id, cb AS cluster_b, round((vs[cb + 1][1] + 1 - vs[cb + 1][2]) / 2, 6) AS value
FROM (SELECT p.g, p.i, vs, cs[{top}] AS cb FROM p JOIN z ON p.g = z.g)"""


def topology(rows: str, terms: Terms, beta_lower: float, tau: int, phi: int, labels: bool = False) -> str:
    """model, src, dst, weight (or model, cluster_id, n, if labels: rows under the categories left): edges between the first and the second resonant category, with prunes every tau rows. Fast learning of the first."""
    found = f"list_transform(list_sort(list_filter(list_transform(ws, lambda w, j: {{'a': -(({terms.choice})::DOUBLE), 'j': j, 'm': ({terms.match})::DOUBLE}}), lambda s: s.m >= {terms.rho!r}))[1:2], lambda s: s.j)"
    slow = f"list_transform(list_zip(w, ({terms.update})), lambda z: {beta_lower!r} * z[2] + (1 - {beta_lower!r}) * z[1])"
    learnt = f"CASE WHEN len(best) = 0 THEN list_append(ws, {terms.new}) ELSE list_transform(ws, lambda w, j: CASE WHEN j = best[1] THEN {terms.update} WHEN j = best[2] THEN {slow} ELSE w END) END"
    counts = "CASE WHEN len(best) = 0 THEN list_append(ns, 1) ELSE list_transform(ns, lambda n, j: CASE WHEN j = best[1] OR j = best[2] THEN n + 1 ELSE n END) END"
    lasting = "CASE WHEN len(best) = 0 THEN list_append(ps, 0) ELSE ps END"
    known = "len(list_filter(es, lambda e: e[1] = best[1] AND e[2] = best[2])) > 0"
    edges = f"CASE WHEN len(best) < 2 THEN es WHEN {known} THEN list_transform(es, lambda e: CASE WHEN e[1] = best[1] AND e[2] = best[2] THEN [e[1], e[2], e[3] + 1] ELSE e END) ELSE list_append(es, [best[1], best[2], 1]) END"
    inner = f"SELECT g, k, {learnt} AS ws, {counts} AS ns, {lasting} AS ps, {edges} AS es, list_append(ids, i) AS ids, list_append(ls, coalesce(best[1], len(ws) + 1)) AS ls FROM (SELECT p.g, p.k, p.i, x, ws, ns, ps, es, ids, ls, {found} AS best {JOIN})"
    left = "list_filter(range(1, len(ns) + 1), lambda j: ps[j] = 1 OR ns[j] >= @)".replace("@", str(phi))
    inner = f"SELECT *, CASE WHEN k % {tau} = 0 THEN {left} END AS kept FROM ({inner})"
    cut = lambda c: f"CASE WHEN kept IS NULL THEN {c} ELSE list_transform(kept, lambda j: {c}[j]) END"
    moved = "list_transform(list_filter(es, lambda e: list_contains(kept, e[1]) AND list_contains(kept, e[2])), lambda e: [list_position(kept, e[1]), list_position(kept, e[2]), e[3]])"
    step = f"{cut('ws')}, {cut('ns')}, CASE WHEN kept IS NULL THEN ps ELSE list_transform(kept, lambda j: 1::BIGINT) END, CASE WHEN kept IS NULL THEN es ELSE {moved} END, ids, CASE WHEN kept IS NULL THEN ls ELSE list_transform(ls, lambda l: list_position(kept, l)) END"
    state = _state({"ws": _W, "ns": _C, "ps": _C, "es": "[]::BIGINT[][]", "ids": _C, "ls": _C}, step, inner)
    if labels:
        top = f"-list_max(list_transform(ws, lambda w, j: {{'t': ({terms.choice})::DOUBLE, 'k': -j}})).k"
        listed = "SELECT g, ws, unnest(ids) AS i, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS k FROM z"
        found = f"SELECT s.g, coalesce(l, {top}) - 1 AS c FROM ({listed}) s JOIN p ON p.g = s.g AND p.k = s.k"
        return f"WITH RECURSIVE {rows},\n{state}, {LAST}\nSELECT g AS model, c::BIGINT AS cluster_id, count(*) AS n FROM ({found}) GROUP BY ALL"
    return f"WITH RECURSIVE {rows},\n{state}, {LAST}\nSELECT model, e[1] - 1 AS src, e[2] - 1 AS dst, e[3] AS weight FROM (SELECT g AS model, unnest(es) AS e FROM z)"


def vat(points: str) -> str:
    """model, position, sample_id of points (g, i, u, v): from the row of the largest distance, always the row nearest to those placed.

    Of equally near rows that of the earliest placed one comes first, then the least id.
    """
    return f"""WITH RECURSIVE q AS ({points}),
d AS (SELECT a.g, a.i, list(sqrt((a.u - b.u) ** 2 + (a.v - b.v) ** 2) ORDER BY b.i) AS far FROM q a JOIN q b USING (g) GROUP BY a.g, a.i),
m AS (SELECT g, list(i ORDER BY i) AS ids, list(far ORDER BY i) AS far, count(*) AS n FROM d GROUP BY g),
s AS (SELECT g, list_max(list_transform(far, lambda r, j: {{'d': list_max(r), 'k': -j}})).k AS k FROM m),
f(g, pos, spot, best) AS (
  SELECT g, 0::BIGINT, (-k)::BIGINT, list_transform(far[-k], lambda v, j: CASE WHEN j <> -k THEN {{'d': v, 'o': 0::BIGINT, 'j': j::BIGINT}} END) FROM s JOIN m USING (g)
  UNION ALL
  SELECT g, pos, spot, list_transform(best, lambda b, j: CASE WHEN b IS NULL OR j = spot THEN NULL WHEN far[spot][j] < b.d THEN {{'d': far[spot][j], 'o': pos, 'j': b.j}} ELSE b END)
  FROM (SELECT f.g, pos + 1 AS pos, list_min(list_filter(best, lambda b: b IS NOT NULL)).j AS spot, best, far FROM f JOIN m ON m.g = f.g AND pos + 1 < n))
SELECT f.g AS model, pos AS position, ids[spot] AS sample_id FROM f JOIN m ON m.g = f.g"""


def channel(terms: str, i: int) -> str:
    """A term over x and w, for channel i: its row is x{i} and its weight w[i + 1]."""
    return terms.replace("list_zip(x, w)", f"list_zip(x{i}, w[{i + 1}])").replace("list_sum(w)", f"list_sum(w[{i + 1}])").replace("len(x)", f"len(x{i})")


def _fused_search(channels: list[Terms], gamma: list[float], ok: str = "true") -> str:
    """The category that takes a row in all channels, of those that a test of w and j allows."""
    n = range(len(channels))
    total = " + ".join(f"{g!r} * ({channel(c.choice, i)})" for i, (c, g) in enumerate(zip(channels, gamma, strict=True)))
    matches = ", ".join(f"'m{i}': ({channel(c.match, i)})::DOUBLE" for i, c in enumerate(channels))
    listed = f"list_sort(list_transform(ws, lambda w, j: {{'a': -(({total})::DOUBLE), 'j': j, 'ok': coalesce(({ok})::BOOLEAN, false), {matches}}}))"
    rules = "s.ok AND " + " AND ".join(f"s.m{i} >= {c.rho!r} AND coalesce(s.m{i} >= list_max(list_transform(found[1:r - 1], lambda q: q.m{i})), true)" for i, c in enumerate(channels))
    return f"list_transform([{listed}], lambda found: list_filter(found, lambda s, r: {rules})[1].j)[1]"


def fused(channels: list[Terms], gamma: list[float], start: str = "") -> str:
    """f(g, k, ws): a fused fit of rows p(g, i, k, x0, x1, ...), a list of weights for each category; z: the last state. Fuzzy channels with epsilon 0.

    Vigilance rises to the matches of every category that fails, in the channels where it passed.
    """
    best, n = _fused_search(channels, gamma), range(len(channels))
    rows = ", ".join(f"x{i}" for i in n)
    learnt = ", ".join(channel(c.update, i) for i, c in enumerate(channels))
    step = f"CASE WHEN best IS NULL THEN list_append(ws, [{rows}]) ELSE list_transform(ws, lambda w, j: CASE WHEN j = best THEN [{learnt}] ELSE w END) END"
    return f"{_state({'ws': '[]::DOUBLE[][][]'}, step, f'SELECT p.g, p.k, {rows}, ws, {best} AS best {JOIN}', start)}, {LAST}"


def chosen(channels: list[Terms], gamma: list[float], skip: tuple[int, ...]) -> str:
    """The category that some channels choose, the skipped ones at their full share."""
    total = " + ".join(f"{g!r}" if i in skip else f"{g!r} * ({channel(c.choice, i)})" for i, (c, g) in enumerate(zip(channels, gamma, strict=True)))
    return f"-list_max(list_transform(ws, lambda w, j: {{'t': ({total})::DOUBLE, 'k': -j}})).k"


def temporal(steps: str, channels: list[Terms], gamma: list[float], alpha: float, discount: float, rounds: int, actions: list[tuple[int, str]]) -> str:
    """model, sample_id, action_id, reward: the best action of every step's state after rounds of temporal-difference learning.

    steps: CTEs that end in c(g, i, o, x0, x1, r), o the order in an episode, an episode being
    a model. Each round's values come from the model of the round before.
    """
    renamed = lambda text, n: re.sub(r"\b([fpz])\b(?=[\s().,]|$)", rf"\g<1>{n}", text)
    parts, centre = [], "(ws[@][3][1] + 1 - ws[@][3][2]) / 2"
    for n in range(rounds):
        if n:
            value = f"SELECT c.*, ws, {chosen(channels, gamma, (2,))} AS j FROM c JOIN z{n - 1} USING (g)"
            parts.append(f"q{n} AS (SELECT * EXCLUDE (ws, j), {centre.replace('@', 'j')} AS q FROM ({value}))")
        else:
            parts.append("q0 AS (SELECT *, 0.0::DOUBLE AS q FROM c)")
        ahead = "lead(q) OVER (PARTITION BY g ORDER BY o) AS nq, count(*) OVER (PARTITION BY g) AS n"
        goal = f"CASE WHEN n = 1 THEN r ELSE least(1.0, greatest(0.0, q + {alpha!r} * (r + {discount!r} * nq - q))) END"
        parts.append(f"p{n} AS (SELECT g, i, x0, x1, [t, 1 - t] AS x2, row_number() OVER (PARTITION BY g ORDER BY i) AS k FROM (SELECT g, i, x0, x1, {goal} AS t FROM (SELECT *, {ahead} FROM q{n}) WHERE nq IS NOT NULL OR n = 1))")
        parts.append(renamed(fused(channels, gamma, f"SELECT g, 0::BIGINT, ws FROM z{n - 1}" if n else ""), n))
    space = ", ".join(f"({a}, {v})" for a, v in actions)
    scored = f"SELECT g, i, a, ws, {chosen(channels, gamma, (2,))} AS j FROM (SELECT c.g, c.i, c.x0, s.a, s.x1, ws FROM c JOIN z{rounds - 1} USING (g), (VALUES {space}) AS s(a, x1))"
    best = f"SELECT g, i, a, {centre.replace('@', 'j')} AS v, row_number() OVER (PARTITION BY g, i ORDER BY {centre.replace('@', 'j')} DESC, a) AS best FROM ({scored})"
    return f"WITH RECURSIVE {steps}, {', '.join(parts)}\nSELECT g AS model, i AS sample_id, a::BIGINT AS action_id, round(v, 12) AS reward FROM ({best}) WHERE best = 1"


def online_validity(rows: str, terms: Terms) -> str:
    """model, sample_id, cluster_id where a category takes a row only if the incremental Calinski-Harabasz index of the rows seen grows by it.

    The state holds, for each cluster, {n, m, s}: rows, mean and scatter, and the rows and mean of all.
    """
    grown = "{'n': e.n + 1, 'm': list_transform(list_zip(e.m, x), lambda z: z[1] + (z[2] - z[1]) / (e.n + 1)), 's': e.s + e.n / (e.n + 1) * list_sum(list_transform(list_zip(e.m, x), lambda z: (z[2] - z[1]) ** 2))}"
    one = "{'n': 1.0::DOUBLE, 'm': x, 's': 0.0::DOUBLE}"
    every = "list_transform(list_zip(am, x), lambda z: z[1] + (z[2] - z[1]) / (an + 1))"

    def value(clusters: str, n: str, mean: str) -> str:
        between = f"list_sum(list_transform({clusters}, lambda e: e.n * list_sum(list_transform(list_zip(e.m, {mean}), lambda z: (z[1] - z[2]) ** 2))))"
        within = f"list_sum(list_transform({clusters}, lambda e: e.s))"
        return f"(CASE WHEN len({clusters}) < 2 OR {within} <= 0 THEN 0.0 ELSE {between} / {within} * ({n} - len({clusters})) / (len({clusters}) - 1) END)"

    joined = f"list_transform(cl, lambda e, q: CASE WHEN q = j THEN {grown} ELSE e END)"
    after = value(joined, "(an + 1)", every)
    search = _searched(terms, "ws", f"{after} > now", "MT+", 0.0)
    kind = "STRUCT(n DOUBLE, m DOUBLE[], s DOUBLE)[]"
    inner = f"SELECT *, {search} AS best FROM (SELECT p.g, p.k, p.i, x, ws, cl, an, CASE WHEN an = 0 THEN list_transform(x, lambda v: 0.0::DOUBLE) ELSE am END AS am, {value('cl', 'an', 'am')} AS now {JOIN})"
    step = f"i, {_next(terms, 'ws', 'best')}, CASE WHEN best IS NULL THEN list_append(cl, {one}) ELSE list_transform(cl, lambda e, q: CASE WHEN q = best THEN {grown} ELSE e END) END, an + 1, {every}, coalesce(best, len(ws) + 1) - 1"
    fields = {"i": "0::BIGINT", "ws": _W, "cl": f"[]::{kind}", "an": "0.0::DOUBLE", "am": "[]::DOUBLE[]", "c": "-1::BIGINT"}
    return f"WITH RECURSIVE {rows},\n{_state(fields, step, inner)}\nSELECT g AS model, i AS sample_id, c AS cluster_id FROM f WHERE k > 0"


def guided(rows: str, terms: Terms) -> str:
    """model, sample_id, cluster_id where a category takes a row only if the Calinski-Harabasz index of all the model's rows grows by it; rows start in cluster 0."""

    def index(labels: str) -> str:
        members = f"list_transform(list_distinct({labels}), lambda o: list_transform(list_filter(range(1, len(xs) + 1), lambda q: {labels}[q] = o), lambda q: xs[q]))"
        means = f"list_transform({members}, lambda o: {{'o': o, 'm': list_transform(range(1, len(x) + 1), lambda d: list_sum(list_transform(o, lambda v: v[d])) / len(o))}})"
        far = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) ** 2))"
        within = f"list_sum(list_transform(mm, lambda e: list_sum(list_transform(e.o, lambda v: {far('v', 'e.m')}))))"
        between = f"list_sum(list_transform(mm, lambda e: len(e.o) * {far('e.m', 'am')}))"
        return f"list_transform([{means}], lambda mm: CASE WHEN len(mm) < 2 OR len(mm) >= len(xs) OR {within} = 0 THEN 0.0 ELSE {between} / {within} * (len(xs) - len(mm)) / (len(mm) - 1) END)[1]"

    moved = "list_transform(ls, lambda l, q: CASE WHEN q = k THEN j - 1 ELSE l END)"
    search = _searched(terms, "ws", f"len(ws) < 2 OR {index(moved)} > now", "MT+", 0.0)
    whole = "y AS MATERIALIZED (SELECT g, xs, list_transform(range(1, len(xs[1]) + 1), lambda d: list_sum(list_transform(xs, lambda v: v[d])) / len(xs)) AS am FROM (SELECT g, list(x ORDER BY k) AS xs FROM p GROUP BY g))"
    inner = f"SELECT p.g, p.k, p.i, x, ws, ls, xs, am, {index('ls')} AS now {JOIN} JOIN y ON y.g = p.g"
    inner = f"SELECT *, coalesce(best, len(ws) + 1) - 1 AS label FROM (SELECT *, {search} AS best FROM ({inner}))"
    step = f"i, {_next(terms, 'ws', 'best')}, list_transform(ls, lambda l, q: CASE WHEN q = k THEN label ELSE l END), label"
    start = "SELECT g, 0::BIGINT, 0::BIGINT, []::DOUBLE[][], list_transform(xs, lambda v: 0::BIGINT), -1::BIGINT FROM y"
    state = _state({"i": "", "ws": "", "ls": "", "c": ""}, step, inner, start)
    return f"WITH RECURSIVE {rows}, {whole},\n{state}\nSELECT g AS model, i AS sample_id, c AS cluster_id FROM f WHERE k > 0"


def cross_validated(table: str, row: str, make, values: list[float], folds: int, name: str) -> str:
    """params, fold, n, right: a supervised fit on the rows of other folds for every value, and its hits in each fold.

    table: a query of (i, x, y); row: how a value is told; make(value): the kernel's terms.
    """
    parts = []
    for k, v in enumerate(values):
        terms = make(v)
        best = f"-list_max(list_transform(ws, lambda w, j: {{'t': ({terms.choice})::DOUBLE, 'k': -j}})).k"
        inner = f"SELECT p.g, p.k, x, y, ws, cs, {_mapped(terms, 'ws', 'cs', 'y')} AS best {JOIN}"
        state = _state({"ws": _W, "cs": _C}, f"{_next(terms, 'ws', 'best')}, CASE WHEN best IS NULL THEN list_append(cs, y) ELSE cs END", inner)
        learnt = re.sub(r"\bf\b(?=[\s().,]|$)", f"f{k}", f"{state}, {LAST.replace('z AS', f'z{k} AS')}")
        parts.append((learnt, f"SELECT {row.format(v)} AS params, g::BIGINT AS fold, count(*) AS n, sum((cs[best] = y)::BIGINT)::BIGINT AS right FROM (SELECT z.g, e.y, cs, {best} AS best FROM e JOIN z{k} z ON z.g = (e.i % {folds})::VARCHAR) GROUP BY g"))
    rows = f"e AS ({table}), p AS (SELECT d::VARCHAR AS g, i, x, y, row_number() OVER (PARTITION BY d ORDER BY i) AS k FROM e, range({folds}) AS r(d) WHERE d <> i % {folds})"
    return f"WITH RECURSIVE {rows}, " + ", ".join(a for a, _ in parts) + "\n" + " UNION ALL ".join(f"({b})" for _, b in parts)


def aligned(table: str, key: str, text: str, other: str) -> str:
    """key, agreement, score of global alignments of a column with a string: rows of the score table one after the other, with the way that leads to each cell.

    A gap along a row is a maximum over the cells before; the way there is that of the last cell that is no such gap.
    """
    best = "list_prepend(-(i + 1), list_transform(range(1, len(b) + 1), lambda j: greatest(s[j] + CASE WHEN a[i + 1] = b[j] THEN 1 ELSE -1 END, s[j + 1] - 1)))"
    score = "list_transform(best, lambda v, j: list_max(list_transform(best[1:j], lambda u, q: u - (j - q))))"
    diagonal = "now[j] = s[j - 1] + CASE WHEN a[i + 1] = b[j - 1] THEN 1 ELSE -1 END"
    way = f"list_transform(now, lambda v, j: CASE WHEN j = 1 THEN repeat('-', i + 1) WHEN {diagonal} THEN p[j - 1] || CASE WHEN a[i + 1] = b[j - 1] THEN a[i + 1] ELSE '-' END WHEN now[j] = s[j] - 1 THEN p[j] || '-' END)"
    filled = "list_transform(way, lambda v, j: coalesce(v, list_transform([list_filter(list_transform(way[1:j], lambda u, q: CASE WHEN u IS NOT NULL THEN {'q': q, 'u': u} END), lambda u: u IS NOT NULL)[-1]], lambda e: e.u || repeat('-', (j - e.q)::BIGINT))[1]))"
    return f"""WITH RECURSIVE o AS (SELECT string_split('{other}', '') AS b),
f(k, a, b, i, s, p) AS (
  SELECT {key}, string_split({text}, ''), b, 0::BIGINT, list_transform(range(len(b) + 1), lambda j: -j), list_transform(range(len(b) + 1), lambda j: repeat('-', j)) FROM {table}, o WHERE {text} IS NOT NULL
  UNION ALL
  SELECT k, a, b, i + 1, now, {filled}
  FROM (SELECT *, {way} AS way FROM (SELECT *, {score} AS now FROM (SELECT *, {best} AS best FROM f WHERE i < len(a)))))
SELECT k AS {key}, p[-1] AS agreement, round(s[-1] / greatest(len(a), len(b)), 6) AS score FROM f WHERE i = len(a)"""


def offline_validity(rows: str, terms: Terms) -> str:
    """model, sample_id, cluster_id as by online_validity(), but with all rows in cluster 0 from the start, which they leave in turn."""
    far = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) ** 2))"
    grown = f"{{'n': e.n + 1, 'm': list_transform(list_zip(e.m, x), lambda z: z[1] + (z[2] - z[1]) / (e.n + 1)), 's': e.s + e.n / (e.n + 1) * {far('e.m', 'x')}}}"
    before = "list_transform(list_zip(e.m, x), lambda z: z[1] - (z[2] - z[1]) / (e.n - 1))"
    left = f"CASE WHEN e.n <= 1 THEN {{'n': 0.0::DOUBLE, 'm': e.m, 's': 0.0::DOUBLE}} ELSE {{'n': e.n - 1, 'm': {before}, 's': e.s - (e.n - 1) / e.n * {far('x', before)}}} END"

    def value(clusters: str) -> str:
        live = f"list_filter({clusters}, lambda e: e.n > 0)"
        within = "list_sum(list_transform(mm, lambda e: e.s))"
        between = f"list_sum(list_transform(mm, lambda e: e.n * {far('e.m', 'am')}))"
        return f"list_transform([{live}], lambda mm: CASE WHEN len(mm) < 2 OR {within} <= 0 THEN 0.0 ELSE {between} / {within} * (an - len(mm)) / (len(mm) - 1) END)[1]"

    moved = lambda j: f"list_transform(cl, lambda e, q: CASE WHEN {j} = 1 THEN e WHEN q = 1 THEN {left} WHEN q = {j} THEN {grown} ELSE e END)"
    search = _searched(terms, "ws", f"{value(moved('j'))} > now", "MT+", 0.0)
    whole = f"y AS (SELECT g, n AS an, am, list_sum(list_transform(xs, lambda v: {far('v', 'am')})) AS scatter FROM (SELECT g, xs, len(xs)::DOUBLE AS n, list_transform(range(1, len(xs[1]) + 1), lambda d: list_sum(list_transform(xs, lambda v: v[d])) / len(xs)) AS am FROM (SELECT g, list(x ORDER BY k) AS xs FROM p GROUP BY g)))"
    inner = f"SELECT *, {search} AS best FROM (SELECT p.g, p.k, p.i, x, ws, cl, an, am, {value('cl')} AS now {JOIN} JOIN y ON y.g = p.g)"
    new = f"list_append({moved(0)}, {{'n': 1.0::DOUBLE, 'm': x, 's': 0.0::DOUBLE}})"
    step = f"i, {_next(terms, 'ws', 'best')}, CASE WHEN best IS NULL AND len(ws) = 0 THEN cl WHEN best IS NULL THEN {new} ELSE {moved('best')} END, coalesce(best, len(ws) + 1) - 1"
    start = "SELECT g, 0::BIGINT, 0::BIGINT, []::DOUBLE[][], [{'n': an, 'm': am, 's': scatter}], -1::BIGINT FROM y"
    return f"WITH RECURSIVE {rows}, {whole},\n{_state({'i': '', 'ws': '', 'cl': '', 'c': ''}, step, inner, start)}\nSELECT g AS model, i AS sample_id, c AS cluster_id FROM f WHERE k > 0"


def biclusters(cells: str, a: Terms, b: Terms, eta: float) -> str:
    """model, row_cluster, column_cluster, rows, columns of square matrices: CTEs that end in full(g, a, b, m), a row and b column numbers. Correlations by pairs of rows."""
    renamed = lambda text, n: re.sub(r"\b([fp])\b(?=[\s().,]|$)", rf"\g<1>{n}", text)
    coded = "list_concat(v, list_transform(v, lambda q: 1 - q))"
    lines = lambda row, column: f"SELECT g, {row} AS i, row_number() OVER (PARTITION BY g ORDER BY {row}) AS k, {coded} AS x FROM (SELECT g, {row}, list(m ORDER BY {column}) AS v FROM full_grid GROUP BY g, {row})"

    def learnt(terms: Terms, best: str, more: str = "") -> str:
        return _state({"i": "0::BIGINT", "ws": _W, "c": "-1::BIGINT"}, f"i, {_next(terms, 'ws', 'best')}, coalesce(best, len(ws) + 1) - 1", f"SELECT p.g, p.k, p.i, x, ws, {best} AS best {JOIN}")

    return f"""WITH RECURSIVE {cells},
p0 AS ({lines("b", "a")}),
{renamed(learnt(b, _first(b, "ws")), 0)},
lab AS (SELECT g, i, c AS cb FROM f0 WHERE k > 0),
r AS (SELECT u.g, lab.cb, u.a AS one, w.a AS two, CASE WHEN stddev_pop(u.m) > 0 AND stddev_pop(w.m) > 0 THEN corr(u.m, w.m) END AS r
      FROM full_grid u JOIN full_grid w ON u.g = w.g AND u.b = w.b JOIN lab ON lab.g = u.g AND lab.i = u.b JOIN lab me ON me.g = u.g AND me.i = w.a AND me.cb = lab.cb GROUP BY ALL),
ok AS (SELECT g, one AS i, max((r >= {eta!r})::INT) AS ok FROM (SELECT g, cb, one, avg(r) AS r FROM r GROUP BY ALL) GROUP BY ALL),
p1 AS (SELECT q.*, coalesce(ok, 0) = 1 AS ok FROM ({lines("a", "b")}) q LEFT JOIN ok ON ok.g = q.g AND ok.i = q.i),
{renamed(learnt(a, _searched(a, "ws", "ok", "MT+", 0.0)), 1)},
ra AS (SELECT g, c, string_agg(i::VARCHAR, ',' ORDER BY i) AS rows FROM f1 WHERE k > 0 GROUP BY g, c),
rb AS (SELECT g, cb, string_agg(i::VARCHAR, ',' ORDER BY i) AS columns FROM lab GROUP BY g, cb)
SELECT ra.g AS model, c AS row_cluster, cb AS column_cluster, rows, columns FROM ra JOIN rb ON ra.g = rb.g"""


def swept(table: str, points: list[tuple[str, Terms]]) -> str:
    """params, clusters, ari: a clustering of a query's rows (i, x, y) for every point, and its adjusted Rand index against y."""
    parts = []
    for k, (_, terms) in enumerate(points):
        state = _state({"i": "0::BIGINT", "ws": _W, "c": "-1::BIGINT"}, f"i, {_next(terms, 'ws', 'best')}, coalesce(best, len(ws) + 1) - 1", f"SELECT p.g, p.k, p.i, x, ws, {_first(terms, 'ws')} AS best {JOIN}")
        parts.append(re.sub(r"\bf\b(?=[\s().,]|$)", f"f{k}", state))
    labels = " UNION ALL ".join(f"SELECT '{name.replace(chr(39), chr(39) * 2)}' AS params, i, c FROM f{k} WHERE k > 0" for k, (name, _) in enumerate(points))
    pairs = lambda n: f"{n} * ({n} - 1) / 2"
    return f"""WITH RECURSIVE e AS ({table}), p AS (SELECT '' AS g, i, x, y, row_number() OVER (ORDER BY i) AS k FROM e),
{", ".join(parts)},
t AS (SELECT params, c, y, count(*)::DOUBLE AS n FROM ({labels}) l JOIN e USING (i) GROUP BY ALL),
j AS (SELECT params, sum({pairs('n')}) AS joint, sum(n) AS m, count(DISTINCT c) AS clusters FROM t GROUP BY params),
l AS (SELECT params, sum({pairs('n')}) AS lefts FROM (SELECT params, sum(n) AS n FROM t GROUP BY params, c) GROUP BY params),
r AS (SELECT params, sum({pairs('n')}) AS rights FROM (SELECT params, sum(n) AS n FROM t GROUP BY params, y) GROUP BY params)
SELECT params, clusters, round(CASE WHEN (lefts + rights) / 2 = lefts * rights / ({pairs('m')}) THEN 1 ELSE (joint - lefts * rights / ({pairs('m')})) / ((lefts + rights) / 2 - lefts * rights / ({pairs('m')})) END, 6) AS ari
FROM j JOIN l USING (params) JOIN r USING (params)"""


def slow(terms: Terms, beta: float) -> Terms:
    """A kernel that learns at a rate."""
    update = f"list_transform(list_zip(w, ({terms.update})), lambda u: {beta!r} * u[2] + {(1 - beta)!r} * u[1])"
    return Terms(terms.choice, terms.match, terms.rho, update, terms.new)
