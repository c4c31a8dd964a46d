"""Fragments of comparison SQL, written independently of the Spark expressions."""

Z = "1.959963984540054e0"


def payout(x: str) -> str:
    return f"(case when {x} > 0 then {x} / 100e0 when {x} < 0 then 100e0 / -({x}) end)"


def decimal(x: str) -> str:
    return f"(case when {x} >= 100 then 1 + {x} / 100e0 when {x} <= -100 then 1 + 100e0 / abs({x}) end)"


def implied(x: str) -> str:
    return f"(case when {x} > 0 then 100e0 / (100e0 + {x}) when {x} < 0 then -({x}) / (100e0 - {x}) end)"


def power_k(a: str, b: str) -> str:
    """Bisection by halving steps, from 1 upwards."""
    steps = "list_concat([1e0], list_transform(range(0, 62), lambda i: 512e0 / pow(2, i)))"
    return (f"(case when {a} > 0 and {a} < 1 and {b} > 0 and {b} < 1 and {a} + {b} > 1 then "
            f"list_reduce({steps}, lambda k, s: case when pow({a}, k + s) + pow({b}, k + s) > 1 then k + s else k end) end)")


def power_fair(a: str, b: str) -> str:
    return f"pow({a}, {power_k(a, b)})"


def normal_cdf(x: str) -> str:
    """Simpson's rule on 400 steps from zero."""
    return (f"(0.5e0 + ({x}) / 1200e0 * list_sum(list_transform(range(0, 401), lambda i: "
            f"case when i = 0 or i = 400 then 1e0 when i % 2 = 1 then 4e0 else 2e0 end * exp(-pow(({x}) * i / 400e0, 2) / 2))) / sqrt(2e0 * pi()))")


def wilson(s: str, n: str) -> tuple[str, str]:
    mid = f"({s} + pow({Z}, 2) / 2) / ({n} + pow({Z}, 2))"
    half = f"{Z} / ({n} + pow({Z}, 2)) * sqrt({s} * ({n} - {s}) / cast({n} as double) + pow({Z}, 2) / 4)"
    return (f"(case when {n} > 0 then greatest(0e0, {mid} - {half}) else 0e0 end)",
            f"(case when {n} > 0 then least(1e0, {mid} + {half}) else 0e0 end)")


def interval(source: str, cells: str, units: dict[str, str], value: str = "profit_units", z: float = 1.959963984540054) -> str:
    """Cluster interval per cell by the definition; the widest unit wins."""
    keys = f"{cells}, " if cells else ""
    parts = []
    for rank, (unit, column) in enumerate(units.items()):
        c = f"(select {keys}cast({column} as varchar) as cl, sum({value}) as p, count(*) as n from {source} where {value} is not null group by {keys}cl)"
        t = f"(select {keys}sum(p) as tp, sum(n) as tn, count(*) as g, sum(p) / sum(n) as roi from {c} group by {cells or 'all'})"
        join = f"using ({cells})" if cells else "on true"
        parts.append(
            f"select {keys}'{unit}' as unit, {rank} as rk, any_value(roi) as roi, any_value(tn) as bets, any_value(g) as clusters, "
            f"case when any_value(g) < 2 or max(abs(p - roi * n)) <= 1.4210854715202004e-14 * max(abs(p) + abs(roi) * n) then 0e0 "
            f"else sqrt(sum(pow(p - roi * n, 2)) / (any_value(g) * (any_value(g) - 1e0))) / (any_value(tn) / cast(any_value(g) as double)) end as se, "
            f"(any_value(g) < 2 or max(abs(p - roi * n)) <= 1.4210854715202004e-14 * max(abs(p) + abs(roi) * n)) as flat "
            f"from {c} join {t} {join} " + (f"group by {cells}" if cells else ""))
    union = " union all ".join(parts)
    inf = "cast('infinity' as double)"
    pick = (f"select *, case when flat then {inf} else {Z} * se end as half, case when flat then {inf} else {z!r}e0 * se end as wide from ({union})"
            f" where rk < 2 or not flat")
    over = f"partition by {cells} " if cells else ""
    return (f"select {keys}roi, bets, clusters, unit, se as standard_error, roi - half as low, roi + half as high, roi - wide as adjusted_low, roi + wide as adjusted_high, "
            f"case when bets < 200 then 'not enough evidence' when wide = 0 or (roi - wide <= 0 and roi + wide >= 0) then 'no demonstrated edge' "
            f"when roi - wide > 0 then 'demonstrated edge' else 'demonstrated deficit' end as verdict "
            f"from (select *, row_number() over ({over}order by round(half, 9) desc, rk) as pick from ({pick})) where pick = 1")


INTERVAL = "roi:d bets:i clusters:i unit:s standard_error:d low:d high:d adjusted_low:d adjusted_high:d verdict:s"
