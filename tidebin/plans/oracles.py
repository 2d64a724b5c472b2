"""The catalogue's queries as DuckDB SQL over the same whole tables.

Queries without an entry (forests, p-values) are tested against brute-force numpy
in `tests/` instead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

Z95 = "1.959963984540054"


def _list(names: Sequence[str], alias: str = "") -> str:
    return "".join(f"{alias}{n}, " for n in names)


def forward(
    name: str, src: str, freq: int, aggs: Mapping[str, str], keys: Sequence[str] = (), *, origin: str | None = None,
    complete: bool = True,
) -> str:
    """CTEs that bin `src(keys, day, ...)` forward into `name`."""
    k, using = _list(keys), f"USING ({', '.join(keys)})" if keys else "ON TRUE"
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    first = f"DATE '{origin}'" if origin else "min(day)"
    measures = ", ".join(f"{sql} AS {out}" for out, sql in aggs.items())
    filled = ", ".join(f"coalesce({out}, 0) AS {out}" for out in aggs)
    keep = f"WHERE days_to_max >= {freq}" if complete else ""
    return f"""
{name}_b AS (SELECT {k} {first} AS o, max(day) AS m FROM {src} {group}),
{name}_i AS (SELECT {k} CAST(floor((day - o) / {freq}.0) AS BIGINT) AS bin_idx, {measures},
    count(DISTINCT day) AS n_days FROM {src} JOIN {name}_b {using} GROUP BY {k} bin_idx),
{name}_s AS (SELECT {k} unnest(range(min(bin_idx), max(bin_idx) + 1)) AS bin_idx FROM {name}_i {group}),
{name}_f AS (SELECT {k} bin_idx, CAST(o + CAST(bin_idx * {freq} AS INTEGER) AS DATE) AS start_date, m,
    {filled}, coalesce(n_days, 0) AS n_days
    FROM {name}_s LEFT JOIN {name}_i USING ({k} bin_idx) JOIN {name}_b {using}),
{name} AS (SELECT * FROM (SELECT {k} bin_idx, start_date, CAST(start_date + {freq - 1} AS DATE) AS end_date,
    {", ".join(aggs)}, n_days, CAST(m - start_date AS INTEGER) AS days_to_max FROM {name}_f) {keep})"""


def backward(name: str, src: str, freq: int, col: str) -> str:
    """CTEs that average `src(day, v)` in intervals counted back from the last day."""
    return f"""
{name}_b AS (SELECT max(day) AS m, CAST(floor((max(day) - min(day)) / {freq}.0) AS BIGINT) AS oldest FROM {src}),
{name}_i AS (SELECT oldest - CAST(floor((m - day) / {freq}.0) AS BIGINT) AS bin_idx, avg(v) AS {col},
    count(DISTINCT day) AS n_days FROM {src} JOIN {name}_b ON TRUE GROUP BY bin_idx),
{name}_s AS (SELECT unnest(range(0, oldest + 1)) AS bin_idx, m, oldest FROM {name}_b),
{name} AS (SELECT bin_idx, CAST(m - CAST((oldest - bin_idx) * {freq} + {freq - 1} AS INTEGER) AS DATE) AS start_date,
    CAST(m - CAST((oldest - bin_idx) * {freq} AS INTEGER) AS DATE) AS end_date,
    round_even(coalesce({col}, 0), 0) AS {col}, coalesce(n_days, 0) AS n_days
    FROM {name}_s LEFT JOIN {name}_i USING (bin_idx))"""


ORDER_DAYS = "od AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders)"
LINE_DAYS = "ld AS (SELECT *, CAST(l_shipdate AS DATE) AS day FROM lineitem)"
N_ORDERS = {"n_orders": "CAST(count(*) AS BIGINT)"}
ITEMS = {"items": "count(l_orderkey)", "returned": "count(CASE WHEN l_returnflag = 'R' THEN l_orderkey END)"}

PLAIN = f"WITH {ORDER_DAYS}, {forward('a', 'od', 30, N_ORDERS)}"
SERIES = f"""{ORDER_DAYS}, {forward('a', 'od', 30, N_ORDERS, ['o_orderstatus'])},
s AS (SELECT o_orderstatus, bin_idx, n_orders FROM a)"""
SPARSE = f"{ORDER_DAYS}, {forward('a', 'od', 30, N_ORDERS, ['o_custkey'], complete=False)}"

SPARSE_DAYS = """WITH od AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders),
s AS (SELECT o_orderstatus, CAST(day - min(day) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS bin_idx, n_orders
    FROM (SELECT o_orderstatus, day, count(*) AS n_orders FROM od GROUP BY 1, 2))"""
FEED_CALENDAR = """WITH od AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders),
e AS (SELECT min(day) AS o, max(day) AS m FROM od),
i AS (SELECT o_custkey, (day - o) // 30 AS bin_idx, count(*) AS n_orders, count(DISTINCT day) AS n_days FROM od JOIN e ON TRUE GROUP BY 1, 2),
g AS (SELECT o_custkey, unnest(range(0, (m - o) // 30 + 1)) AS bin_idx, o, m FROM (SELECT DISTINCT o_custkey FROM od) JOIN e ON TRUE)
SELECT o_custkey, CAST(bin_idx AS BIGINT) AS bin_idx, CAST(o + CAST(bin_idx * 30 AS INTEGER) AS DATE) AS start_date,
    CAST(o + CAST(bin_idx * 30 + 29 AS INTEGER) AS DATE) AS end_date, coalesce(n_orders, 0) AS n_orders, coalesce(n_days, 0) AS n_days,
    CAST(m - o - bin_idx * 30 AS INTEGER) AS days_to_max
FROM g LEFT JOIN i USING (o_custkey, bin_idx) WHERE m - o - bin_idx * 30 >= 30"""


def offence_intervals(suffix: str, prefix: str) -> str:
    """The eleven measures over line items as offence records."""
    rules = {
        f"total_felony_{suffix}": "f",
        f"violent_felony_{suffix}": "f AND (t IN ('HOMICIDE-NEGLIGENT,UNCLASSIFIE', 'FELONY ASSAULT') OR t LIKE '%MURDER & NON-NEGL. MANSLAUGHTER%' OR t LIKE '%ROBBERY%' OR t LIKE '%RAPE%')",
        f"total_misdemeanor_{suffix}": "v = 'M'",
        f"{prefix}murder_homicide_count": "f AND (t = 'HOMICIDE-NEGLIGENT,UNCLASSIFIE' OR t LIKE '%MURDER & NON-NEGL. MANSLAUGHTER%')",
        f"{prefix}robbery_count": "f AND t LIKE '%ROBBERY%'",
        f"{prefix}assault_count": "f AND t LIKE '%ASSAULT%'",
        f"{prefix}burglary_count": "f AND t LIKE '%BURGLARY%'",
        f"{prefix}rape_count": "f AND t LIKE '%RAPE%'",
        f"{prefix}grand_larceny_count": "f AND t = 'GRAND LARCENY'",
        f"{prefix}grand_larceny_vehicle_count": "f AND t = 'GRAND LARCENY OF MOTOR VEHICLE'",
        f"{prefix}weapons_count": "f AND t LIKE '%WEAPON%'",
    }
    counts = {name: f"count(CASE WHEN {rule} THEN l_orderkey END)" for name, rule in rules.items()}
    return f"""WITH ld AS (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS day, l_returnflag = 'R' AS f, CASE l_returnflag WHEN 'A' THEN 'M' END AS v,
        CASE split_part(p_type, ' ', 1) WHEN 'PROMO' THEN 'MURDER & NON-NEGL. MANSLAUGHTER' WHEN 'STANDARD' THEN 'ROBBERY' WHEN 'SMALL' THEN 'FELONY ASSAULT'
            WHEN 'MEDIUM' THEN 'GRAND LARCENY' WHEN 'LARGE' THEN 'GRAND LARCENY OF MOTOR VEHICLE' WHEN 'ECONOMY' THEN 'DANGEROUS WEAPONS' ELSE 'BURGLARY' END AS t
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1995-03-01'),
        {forward('a', 'ld', 30, counts)} SELECT * FROM a"""


ALIGNED = f"""{ORDER_DAYS}, {LINE_DAYS},
cd AS (SELECT day, count(DISTINCT o_custkey) AS customers FROM od GROUP BY day),
{forward('a', 'od', 30, N_ORDERS | {'urgent': "CAST(sum((o_orderpriority = '1-URGENT')::INT) AS BIGINT)"}, origin='1995-01-01')},
{forward('c', 'cd', 30, {'customers': 'CAST(sum(customers) AS BIGINT)'}, origin='1995-01-01')},
{forward('i', 'ld', 30, ITEMS | {'quantity': 'sum(l_quantity)'}, origin='1995-01-01')},
m AS (SELECT a.bin_idx, start_date, end_date, n_orders, urgent, customers, items, returned, quantity
    FROM a JOIN c USING (start_date, end_date) JOIN i USING (start_date, end_date))"""
MEASURES = ["n_orders", "customers", "urgent", "items", "returned", "quantity"]

LEFT = f"""{ORDER_DAYS}, ll AS (SELECT CAST(l_shipdate AS DATE) AS day FROM lineitem),
{forward('a', 'od', 30, N_ORDERS, origin='1994-12-02')},
{forward('i', 'll', 30, {'items': 'count(*)'}, origin='1994-12-02')},
j AS (SELECT start_date, end_date, n_orders, items FROM i LEFT JOIN a USING (start_date, end_date))"""

# lag curve per series: c(o_orderstatus, lag, r, n)
CURVE = f"""{SERIES},
z AS (SELECT o_orderstatus, bin_idx, n_orders - avg(n_orders) OVER w AS z, count(*) OVER w AS n FROM s
    WINDOW w AS (PARTITION BY o_orderstatus)),
v AS (SELECT o_orderstatus, sum(z * z) AS c0, any_value(n) AS n FROM z GROUP BY o_orderstatus),
c AS (SELECT z.o_orderstatus, CAST(l.lag AS INTEGER) AS lag, sum(z.z * y.z) / any_value(v.c0) AS r, any_value(v.n) AS n
    FROM z CROSS JOIN range(0, 25) AS l(lag)
    JOIN z AS y ON y.o_orderstatus = z.o_orderstatus AND y.bin_idx = z.bin_idx - l.lag
    JOIN v ON v.o_orderstatus = z.o_orderstatus GROUP BY z.o_orderstatus, l.lag),
band AS (SELECT *, CASE WHEN lag = 0 THEN 0.0 ELSE {Z95} * sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN r * r END)
    OVER (PARTITION BY o_orderstatus ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END AS half FROM c)"""
# Levinson recursion on the curve: p(o_orderstatus, lag, pacf)
LEVINSON = f"""{CURVE},
arr AS (SELECT o_orderstatus, list(r ORDER BY lag) AS r, any_value(n) AS n FROM c GROUP BY o_orderstatus),
lev(o_orderstatus, r, n, k, phi) AS (
    SELECT o_orderstatus, r, n, 1, [r[2]] FROM arr
    UNION ALL
    SELECT o_orderstatus, r, n, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - q * phi[k + 1 - j]), q)
    FROM (SELECT *, (r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])))
        / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j + 1]))) AS q FROM lev WHERE k < 24)),
p AS (SELECT o_orderstatus, CAST(0 AS INTEGER) AS lag, 1.0::DOUBLE AS pacf, n FROM arr
    UNION ALL SELECT o_orderstatus, CAST(k AS INTEGER), phi[k], n FROM lev)"""

ADF0 = f"""WITH {SERIES},
d AS (SELECT o_orderstatus, n_orders - lag(n_orders) OVER w AS dy, lag(n_orders) OVER w AS y1 FROM s
    WINDOW w AS (PARTITION BY o_orderstatus ORDER BY bin_idx)),
g AS (SELECT o_orderstatus, CAST(regr_count(dy, y1) AS BIGINT) AS nobs, regr_slope(dy, y1) AS b, regr_sxx(dy, y1) AS sxx,
    regr_syy(dy, y1) AS syy, regr_sxy(dy, y1) AS sxy FROM d GROUP BY o_orderstatus)
SELECT o_orderstatus, round(b / sqrt((syy - b * sxy) / (nobs - 2) / sxx), 6) + 0 AS stat, CAST(0 AS INTEGER) AS usedlag, nobs,
    round(-3.43035 - 6.5393 / nobs - 16.786 / nobs ** 2 - 79.433 / nobs ** 3, 6) AS crit_1,
    round(-2.86154 - 2.8903 / nobs - 4.234 / nobs ** 2 - 40.04 / nobs ** 3, 6) AS crit_5,
    round(-2.56677 - 1.5384 / nobs - 2.809 / nobs ** 2, 6) AS crit_10 FROM g"""


# series as lists, differenced 0..2 times: dx(o_orderstatus, d, y, n, dy)
DIFFERENCED = f"""{SERIES},
lv AS (SELECT o_orderstatus, list(n_orders::DOUBLE ORDER BY bin_idx) AS y FROM s GROUP BY o_orderstatus),
df(o_orderstatus, d, y) AS (SELECT o_orderstatus, CAST(0 AS INTEGER), y FROM lv UNION ALL
    SELECT o_orderstatus, d + 1, list_transform(range(2, len(y) + 1), lambda i: y[i] - y[i - 1]) FROM df WHERE d < 2),
dx AS (SELECT o_orderstatus, d, y, len(y) AS n, list_transform(range(2, len(y) + 1), lambda i: y[i] - y[i - 1]) AS dy FROM df)"""


def project_out(name: str, src: str, left: int) -> str:
    """CTE that removes the columns of `src(o_orderstatus, d, r, cols)` from r and from each
    other, one after the other, until `left` remain. `step` counts the removed ones."""
    return f"""{name}(o_orderstatus, d, step, r, cols) AS (SELECT o_orderstatus, d, 0, r, cols FROM {src} UNION ALL
    SELECT o_orderstatus, d, step + 1, list_transform(range(1, len(r) + 1), lambda i: r[i] - q[i] * rf),
        list_transform(range(1, len(rest) + 1), lambda j: list_transform(range(1, len(r) + 1), lambda i: rest[j][i] - q[i] * f[j]))
    FROM (SELECT o_orderstatus, d, step, r, q, rest, list_inner_product(r, q) / list_inner_product(q, q) AS rf,
            list_transform(rest, lambda c: list_inner_product(c, q) / list_inner_product(q, q)) AS f
        FROM (SELECT *, cols[1] AS q, cols[2:] AS rest FROM {name} WHERE len(cols) > {left})))"""


def lag_list(lags: str, first: str) -> str:
    """The lagged differences 1..lags as columns, for rows first..n-1."""
    return f"list_transform(range(1, {lags} + 1), lambda k: list_transform(range({first}, n), lambda i: dy[i - k]))"


ADF = f"""WITH RECURSIVE {DIFFERENCED},
dm AS (SELECT *, CAST(least(ceil(12 * (n / 100.0) ** 0.25), floor(n / 2) - 2) AS BIGINT) AS m FROM dx),
a0 AS (SELECT o_orderstatus, d, dy[m + 1:n - 1] AS r, list_concat([list_transform(range(m + 1, n), lambda i: 1.0::DOUBLE),
    y[m + 1:n - 1]], {lag_list('m', 'm + 1')}) AS cols FROM dm),
{project_out('a1', 'a0', 0)},
ic AS (SELECT o_orderstatus, d, step - 2 AS lag, len(r) * ln(list_inner_product(r, r) / len(r)) + 2 * step AS aic FROM a1 WHERE step >= 2),
pick AS (SELECT o_orderstatus, d, CAST(arg_min(lag, aic) AS BIGINT) AS u FROM ic GROUP BY o_orderstatus, d),
b0 AS (SELECT o_orderstatus, d, dy[u + 1:n - 1] AS r, list_concat([list_transform(range(u + 1, n), lambda i: 1.0::DOUBLE)],
    list_append({lag_list('u', 'u + 1')}, y[u + 1:n - 1])) AS cols FROM dm JOIN pick USING (o_orderstatus, d)),
{project_out('b1', 'b0', 1)},
g AS (SELECT o_orderstatus, d, u, len(r) AS nobs, list_inner_product(r, cols[1]) AS sxy, list_inner_product(cols[1], cols[1]) AS sxx,
    list_inner_product(r, r) AS syy FROM b1 JOIN pick USING (o_orderstatus, d) WHERE step = u + 1)
SELECT o_orderstatus, d, round(sxy / sxx / sqrt((syy - sxy * sxy / sxx) / (nobs - u - 2) / sxx), 5) + 0 AS stat,
    CAST(u AS INTEGER) AS usedlag, CAST(nobs AS BIGINT) AS nobs FROM g"""

# Dickey-Fuller with trend; a series passes where the statistic is at or below the tabulated
# percentile for its length (fixed values: 5 % and 2.5 % columns, n = 25, 50, 100, 250)
NDIFFS = f"""{DIFFERENCED},
dk AS (SELECT *, CAST(floor(cbrt(n - 1) + 1e-9) AS BIGINT) AS m FROM dx WHERE d < 2),
a0 AS (SELECT o_orderstatus, d, dy[m + 1:n - 1] AS r, list_concat([list_transform(range(m + 1, n), lambda i: 1.0::DOUBLE),
    list_transform(range(m + 1, n), lambda i: i::DOUBLE)], list_append({lag_list('m', 'm + 1')}, y[m + 1:n - 1])) AS cols FROM dk),
{project_out('a1', 'a0', 1)},
g AS (SELECT o_orderstatus, d, n - 1 AS size, len(r) - m - 3 AS dof, list_inner_product(r, cols[1]) AS sxy,
    list_inner_product(cols[1], cols[1]) AS sxx, list_inner_product(r, r) AS syy FROM a1 JOIN dk USING (o_orderstatus, d) WHERE step = m + 2),
ts AS (SELECT o_orderstatus, d, size, sxy / sxx / sqrt((syy - sxy * sxy / sxx) / dof / sxx) AS stat FROM g),
crit AS (SELECT * FROM (VALUES (0.05::DOUBLE, [-3.60, -3.50, -3.45, -3.43]), (0.025::DOUBLE, [-3.95, -3.80, -3.73, -3.69])) AS v(alpha, c)),
ok AS (SELECT o_orderstatus, d, alpha, stat <= CASE WHEN size <= 50 THEN c[1] + (c[2] - c[1]) * (size - 25) / 25
    WHEN size <= 100 THEN c[2] + (c[3] - c[2]) * (size - 50) / 50 ELSE c[3] + (c[4] - c[3]) * (size - 100) / 150 END AS pass
    FROM ts JOIN crit ON TRUE),
nd AS (SELECT o_orderstatus, alpha, CAST(coalesce(min(CASE WHEN pass THEN d END), 2) AS INTEGER) AS d FROM ok GROUP BY o_orderstatus, alpha)"""


def autoregressions(src: str, pmax: int, ps: int, ds: int, steps: int) -> str:
    """CTEs that fit every order (p < ps, d < ds) to the lists of `src(o_orderstatus, fold, y)`
    by the normal equations (Gauss-Jordan) and extend them: path(o_orderstatus, fold, p, d, y)."""
    ident = "o_orderstatus, fold, p, d"
    return f"""wd(o_orderstatus, fold, y, d, w) AS (SELECT o_orderstatus, fold, y, CAST(0 AS INTEGER), y FROM {src} UNION ALL
    SELECT o_orderstatus, fold, y, d + 1, list_transform(range(2, len(w) + 1), lambda i: w[i] - w[i - 1]) FROM wd WHERE d < {ds - 1}),
ds AS (SELECT wd.*, CAST(p AS INTEGER) AS p, w[{pmax + 1}:] AS t, list_concat([list_transform(range({pmax}, len(w)), lambda i: 1.0::DOUBLE)],
    list_transform(range(1, p + 1), lambda k: list_transform(range({pmax + 1}, len(w) + 1), lambda i: w[i - k]))) AS cols
    FROM wd CROSS JOIN range(0, {ps}) AS r(p)),
gj(o_orderstatus, fold, p, d, step, m) AS (SELECT {ident}, 1, list_transform(cols, lambda a: list_append(
        list_transform(cols, lambda b: list_inner_product(a, b)), list_inner_product(a, t))) FROM ds UNION ALL
    SELECT {ident}, step + 1, list_transform(range(1, p + 2), lambda i: CASE WHEN i = step THEN lead_row
        ELSE list_transform(range(1, p + 3), lambda j: m[i][j] - m[i][step] * lead_row[j]) END)
    FROM (SELECT *, list_transform(m[step], lambda v: v / m[step][step]) AS lead_row FROM gj WHERE step <= p + 1)),
cf AS (SELECT {ident}, list_transform(m, lambda row: row[p + 2]) AS c FROM gj WHERE step = p + 2),
nx(o_orderstatus, fold, p, d, h, y, w, c) AS (SELECT {ident}, 0, y, w, c FROM ds JOIN cf USING ({ident}) UNION ALL
    SELECT {ident}, h + 1, list_append(y, CASE d WHEN 0 THEN v WHEN 1 THEN y[-1] + v ELSE 2 * y[-1] - y[-2] + v END), list_append(w, v), c
    FROM (SELECT *, c[1] + coalesce(list_sum(list_transform(range(1, p + 1), lambda i: c[1 + i] * w[-i])), 0) AS v FROM nx WHERE h < {steps})),
path AS (SELECT {ident}, y[-{steps}:] AS f FROM nx WHERE h = {steps})"""


def _corr_pairs() -> str:
    logs = ", ".join(f"ln(1 + {c}) AS {c}" for c in MEASURES)
    order = ["n_orders", "customers", "urgent", "items", "returned", "quantity"]
    cells = " UNION ALL ".join(
        f"SELECT '{order[i]}' AS x, '{order[j]}' AS y, "
        + ("1.0::DOUBLE AS r" if i == j else f"round(corr({order[i]}, {order[j]}), 6) + 0 AS r FROM g")
        for i in range(len(order))
        for j in range(i + 1)
    )
    return f"WITH {ALIGNED}, g AS (SELECT {logs} FROM m) {cells}"


def _corr_target() -> str:
    logs = ", ".join(f"ln(1 + {c}) AS {c}" for c in MEASURES)
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS variable, round(corr(n_orders, {c}), 6) + 0 AS r FROM g" for c in MEASURES[1:]
    )
    return f"WITH {ALIGNED}, g AS (SELECT {logs} FROM m) {cells}"


def _partial_three() -> str:
    """Partial correlation with two covariates by the recursion formula."""

    def one(x: str, y: str, z: str) -> str:
        return f"((r_{x}{y} - r_{x}{z} * r_{y}{z}) / sqrt((1 - r_{x}{z} ** 2) * (1 - r_{y}{z} ** 2)))"

    letters = {"t": "n_orders", "a": "urgent", "b": "items", "c": "returned"}
    pairs = ", ".join(
        f"corr({letters[x]}, {letters[y]}) AS r_{x}{y}" for x in letters for y in letters if x != y
    )
    rows = []
    for x, z, w in (("a", "b", "c"), ("b", "a", "c"), ("c", "a", "b")):
        tx, tw, xw = one("t", x, z), one("t", w, z), one(x, w, z)
        rows.append(
            f"SELECT '{letters[x]}' AS variable, round(({tx} - {tw} * {xw}) / sqrt((1 - {tw} ** 2) * (1 - {xw} ** 2)), 5) + 0 AS r FROM g"
        )
    return f"WITH {ALIGNED}, g AS (SELECT {pairs} FROM m) " + " UNION ALL ".join(rows)


def _kde(keys: Sequence[str]) -> str:
    k = _list(keys)
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    join = f"USING ({', '.join(keys)})" if keys else "ON TRUE"
    return f"""WITH st AS (SELECT {k} count(*) AS n, stddev_samp(p_retailprice) * count(*) ** -0.2 AS h,
    min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part {group}),
gr AS (SELECT *, CAST(g AS INTEGER) AS grid, lo - 3 * h + g * (hi - lo + 6 * h) / 199 AS x FROM st CROSS JOIN range(0, 200) AS t(g))
SELECT {k} grid, round(any_value(x), 8) AS x,
    round(sum(exp(-0.5 * ((x - p_retailprice) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) AS density,
    round(any_value(h), 8) AS bandwidth FROM part JOIN gr {join} GROUP BY {k} grid"""


# exact split of one measure into two clusters: q(cut) holds the highest low value
TWO_MEANS = f"""{PLAIN},
u AS (SELECT n_orders AS y, sum(n_orders) OVER w AS s1, sum(n_orders ** 2) OVER w AS s2, count(*) OVER w AS c,
    sum(n_orders) OVER () AS t1, sum(n_orders ** 2) OVER () AS t2, count(*) OVER () AS t FROM a
    WINDOW w AS (ORDER BY n_orders RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
q AS (SELECT y AS cut FROM u WHERE c < t ORDER BY s2 - s1 ** 2 / c + (t2 - s2) - (t1 - s1) ** 2 / (t - c), y LIMIT 1),
k AS (SELECT start_date, end_date, n_orders, CAST(n_orders <= cut AS INTEGER) AS cluster FROM a JOIN q ON TRUE)"""

# exact three clusters of each status: all pairs of cuts, the cheapest pair wins
THREE_MEANS = f"""WITH {SERIES.replace('SELECT o_orderstatus, bin_idx, n_orders FROM a', 'SELECT * FROM a')},
u AS (SELECT DISTINCT o_orderstatus, n_orders AS y, sum(n_orders) OVER w AS s1, sum(n_orders ** 2) OVER w AS s2, count(*) OVER w AS c,
    sum(n_orders) OVER v AS t1, sum(n_orders ** 2) OVER v AS t2, count(*) OVER v AS t FROM s
    WINDOW w AS (PARTITION BY o_orderstatus ORDER BY n_orders RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY o_orderstatus)),
q AS (SELECT a.o_orderstatus, a.y AS low, b.y AS high FROM u AS a JOIN u AS b ON a.o_orderstatus = b.o_orderstatus AND a.y < b.y AND b.c < b.t
    QUALIFY row_number() OVER (PARTITION BY a.o_orderstatus ORDER BY round(a.s2 - a.s1 ** 2 / a.c + (b.s2 - a.s2)
        - (b.s1 - a.s1) ** 2 / (b.c - a.c) + (b.t2 - b.s2) - (b.t1 - b.s1) ** 2 / (b.t - b.c), 6), b.y, a.y) = 1),
k AS (SELECT s.*, CAST(n_orders <= low AS INTEGER) + CAST(n_orders <= high AS INTEGER) AS cluster FROM s JOIN q USING (o_orderstatus))"""

# least squares of n_orders on urgent and items over rows g(y, a, b), solved by Cramer's rule
def two_regressors(rows: str) -> str:
    return f"""{rows},
f AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) * count(*) AS saa,
    covar_pop(b, b) * count(*) AS sbb, covar_pop(a, b) * count(*) AS sab, covar_pop(a, y) * count(*) AS say,
    covar_pop(b, y) * count(*) AS sby, covar_pop(y, y) * count(*) AS syy FROM g WHERE is_train),
e AS (SELECT *, (say * sbb - sby * sab) / det AS ba, (sby * saa - say * sab) / det AS bb
    FROM (SELECT *, saa * sbb - sab * sab AS det FROM f)),
o AS (SELECT *, my - ba * ma - bb * mb AS b0, greatest(syy - ba * say - bb * sby, 0) AS ssr FROM e)"""


ALL_ROWS = f"{ALIGNED}, g AS (SELECT n_orders::DOUBLE AS y, urgent::DOUBLE AS a, items::DOUBLE AS b, true AS is_train FROM m)"
CHRONO = f"""{ALIGNED}, g AS (SELECT n_orders::DOUBLE AS y, urgent::DOUBLE AS a, items::DOUBLE AS b,
    row_number() OVER (ORDER BY bin_idx) <= floor(count(*) OVER () * 0.8) AS is_train FROM m)"""
RANDOM = f"""{ALIGNED}, g AS (SELECT n_orders::DOUBLE AS y, urgent::DOUBLE AS a, items::DOUBLE AS b,
    row_number() OVER (ORDER BY md5('7|' || bin_idx)) > ceil(count(*) OVER () * 0.2) AS is_train FROM m)"""
SCALED = f"""{CHRONO.replace('g AS (', 'g0 AS (')},
g AS (SELECT (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS y,
    (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS a,
    (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS b, is_train FROM g0)"""
HOLDOUT_ERRORS = """SELECT CASE WHEN is_train THEN 'in_sample' ELSE 'out_of_sample' END AS sample, count(*) AS n,
    round(avg((y - b0 - ba * a - bb * b) ** 2), 5) + 0 AS mse, round(avg(abs(y - b0 - ba * a - bb * b)), 5) + 0 AS mae
    FROM g JOIN o ON TRUE GROUP BY is_train"""


def origin_folds(step: int) -> str:
    return f"""{SERIES},
w AS (SELECT *, bin_idx - min(bin_idx) OVER k AS q, count(*) OVER k AS n FROM s WINDOW k AS (PARTITION BY o_orderstatus)),
fo AS (SELECT o_orderstatus, CAST(fold AS BIGINT) AS fold, q - fold * {step} AS r, bin_idx, n_orders
    FROM w JOIN range(0, 100000) AS t(fold) ON fold * {step} <= q AND q < fold * {step} + 42 AND fold <= floor((n - 42) / {step}.0))"""


FOLDS = origin_folds(6)


# AR(1) on levels (d = 0) and on first differences (d = 1), per fold
def ar1(folds: str) -> str:
    return f"""{folds},
lg AS (SELECT *, lag(n_orders) OVER k AS l1, n_orders - lag(n_orders) OVER k AS w0,
    lag(n_orders) OVER k - lag(n_orders, 2) OVER k AS w1 FROM fo WINDOW k AS (PARTITION BY o_orderstatus, fold ORDER BY r)),
ft AS (SELECT o_orderstatus, fold, regr_slope(n_orders, l1) AS s0, regr_intercept(n_orders, l1) AS c0,
    regr_slope(w0, w1) AS s1, regr_intercept(w0, w1) AS c1 FROM lg WHERE r < 36 GROUP BY o_orderstatus, fold),
st AS (SELECT o_orderstatus, fold, n_orders AS y, w0 AS dy FROM lg WHERE r = 35),
rec(o_orderstatus, fold, h, y0, y1, dy, s0, c0, s1, c1) AS (
    SELECT o_orderstatus, fold, 0, y::DOUBLE, y::DOUBLE, dy::DOUBLE, s0, c0, s1, c1 FROM ft JOIN st USING (o_orderstatus, fold)
    UNION ALL SELECT o_orderstatus, fold, h + 1, c0 + s0 * y0, y1 + c1 + s1 * dy, c1 + s1 * dy, s0, c0, s1, c1 FROM rec WHERE h < 6),
er AS (SELECT rec.o_orderstatus, rec.fold, avg(abs(y0 - n_orders)) AS e0, avg(abs(y1 - n_orders)) AS e1
    FROM rec JOIN fo ON fo.o_orderstatus = rec.o_orderstatus AND fo.fold = rec.fold AND fo.r = 35 + rec.h WHERE h > 0
    GROUP BY rec.o_orderstatus, rec.fold)"""


AR1_ERRORS = """SELECT o_orderstatus, fold, 'none' AS exog_set, CAST(1 AS INTEGER) AS p, CAST(0 AS INTEGER) AS d, round(e0, 5) AS mae FROM er
    UNION ALL SELECT o_orderstatus, fold, 'none', CAST(1 AS INTEGER), CAST(1 AS INTEGER), round(e1, 5) FROM er"""


def _two_regressors(rows: str, y: str, a: str, b: str, names: str) -> str:
    """Least squares on two columns per series and fold, as (slope of a, slope of b, constant)."""
    sa, sb, c = names.split()
    return f"""SELECT o_orderstatus, fold, {sa}, {sb}, my - {sa} * ma - {sb} * mb AS {c} FROM (
        SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS {sa}, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS {sb} FROM (
            SELECT o_orderstatus, fold, avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb, var_pop({a}) AS aa, var_pop({b}) AS bb, covar_pop({a}, {b}) AS ab,
                covar_pop({y}, {a}) AS ya, covar_pop({y}, {b}) AS yb FROM {rows} GROUP BY ALL))"""


# ARMA(1, 1) on levels: residuals of two lags as a regressor
ARMA = f"""{FOLDS},
lg AS (SELECT *, n_orders::DOUBLE AS y, lag(n_orders) OVER k AS l1, lag(n_orders, 2) OVER k AS l2, lag(n_orders, 3) OVER k AS l3
    FROM fo WINDOW k AS (PARTITION BY o_orderstatus, fold ORDER BY r)),
tr AS (SELECT * FROM lg WHERE r BETWEEN 3 AND 35),
f1 AS ({_two_regressors("tr", "y", "l1", "l2", "a1 a2 c1")}),
t2 AS (SELECT tr.*, l1 - c1 - a1 * l2 - a2 * l3 AS e1, y - c1 - a1 * l1 - a2 * l2 AS e0 FROM tr JOIN f1 USING (o_orderstatus, fold)),
f2 AS ({_two_regressors("t2", "y", "l1", "e1", "phi theta c2")}),
rec(o_orderstatus, fold, h, v, phi, c2) AS (
    SELECT o_orderstatus, fold, 1, c2 + phi * y + theta * e0, phi, c2 FROM t2 JOIN f2 USING (o_orderstatus, fold) WHERE r = 35
    UNION ALL SELECT o_orderstatus, fold, h + 1, c2 + phi * v, phi, c2 FROM rec WHERE h < 6)"""

FOLD_LISTS = f"""{FOLDS},
fl AS (SELECT o_orderstatus, fold, list(n_orders::DOUBLE ORDER BY r) FILTER (WHERE r < 36) AS y,
    list(n_orders::DOUBLE ORDER BY r) FILTER (WHERE r >= 36) AS ya FROM fo GROUP BY o_orderstatus, fold)"""
GRID = """fe AS (SELECT o_orderstatus, p, d, list_avg(list_transform(range(1, 7), lambda i: abs(f[i] - ya[i]))) AS e
    FROM path JOIN fl USING (o_orderstatus, fold)),
gr AS (SELECT o_orderstatus, 'none' AS exog_set, p, d, avg(e) AS mae, count(e) AS folds FROM fe GROUP BY o_orderstatus, p, d),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY mae, d, p) AS INTEGER) AS rank FROM gr)"""


def _forecast_best() -> str:
    """Order chosen on the folds, then the whole series extended with it."""
    chosen = f"WITH RECURSIVE {FOLD_LISTS}, {autoregressions('fl', 2, 3, 2, 6)}, {GRID} SELECT o_orderstatus, p, d FROM rk WHERE rank = 1"
    return f"""WITH RECURSIVE {SERIES},
    al AS (SELECT o_orderstatus, 0 AS fold, list(n_orders::DOUBLE ORDER BY bin_idx) AS y, max(bin_idx) AS e FROM s GROUP BY o_orderstatus),
    {autoregressions('al', 2, 3, 2, 12)}
    SELECT o_orderstatus, CAST(unnest(range(1, 13)) AS INTEGER) AS step_ahead, e + unnest(range(1, 13)) AS bin_idx,
    unnest(list_transform(f, lambda v: round(v, 4))) AS forecast
    FROM path JOIN ({chosen}) USING (o_orderstatus, p, d) JOIN al USING (o_orderstatus)"""

TEXT_RULES = {
    "total_returned": "l_returnflag = 'R'",
    "grave_returned": "l_returnflag = 'R' AND (p_type = 'PROMO' OR p_type LIKE '%ECON%' OR p_type LIKE '%SMALL%')",
    "total_accepted": "l_returnflag = 'A'",
    "promo_returned": "l_returnflag = 'R' AND p_type = 'PROMO'",
    "ring_returned": "l_returnflag = 'R' AND p_name LIKE '%ring%'",
    "bolt_returned": "l_returnflag = 'R' AND p_name LIKE '%bolt%'",
}


def _text_counts(names: Sequence[str]) -> str:
    cells = ", ".join(f"count(CASE WHEN {TEXT_RULES[n]} THEN l_orderkey END) AS {n}" for n in names)
    return f"""SELECT CAST(l_shipdate AS DATE) AS day, {cells}
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY day"""


def _events_by_type() -> str:
    types = ("click", "error", "purchase", "signup", "view")
    aggs = {t: f"count(CASE WHEN event_type = '{t}' THEN event_id END)" for t in types}
    return f"WITH ed AS (SELECT *, CAST(ts AS DATE) AS day FROM events), {forward('a', 'ed', 7, aggs)} SELECT * FROM a"


ORACLES: dict[str, str] = {
    "weekly_event_counts": _events_by_type(),
    "daily_distinct_count": "SELECT CAST(o_orderdate AS DATE) AS day, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY day",
    "daily_conditional_counts": _text_counts(list(TEXT_RULES)),
    "distinct_rows": "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem",
    "resample_forward_sum": f"""WITH cd AS (SELECT CAST(o_orderdate AS DATE) AS day, count(DISTINCT o_custkey) AS customers
        FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' GROUP BY day),
        {forward('a', 'cd', 30, {'customers': 'CAST(sum(customers) AS BIGINT)'})}
        SELECT *, CAST(month(start_date) AS INTEGER) AS month, CAST(year(start_date) AS INTEGER) AS year FROM a""",
    "resample_forward_mean": f"""WITH sd AS (SELECT DISTINCT l_orderkey, o_orderdate, l_shipdate, CAST(l_shipdate AS DATE) AS day,
        floor(epoch(l_shipdate - o_orderdate) / 86400) AS los FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE l_shipdate >= TIMESTAMP '1995-03-01'),
        {forward('a', 'sd', 30, {'avg_los_days': 'avg(los)'})}
        SELECT * REPLACE (round(avg_los_days, 6) + 0 AS avg_los_days), CAST(month(start_date) AS INTEGER) AS month,
        CAST(year(start_date) AS INTEGER) AS year FROM a""",
    "resample_backward_mean_30": f"""WITH pd AS (SELECT CAST(o_orderdate AS DATE) AS day, o_totalprice AS v FROM orders),
        {backward('a', 'pd', 30, 'mean_price')} SELECT * FROM a""",
    "resample_backward_mean_7": f"""WITH pd AS (SELECT CAST(o_orderdate AS DATE) AS day, o_totalprice AS v FROM orders),
        {backward('a', 'pd', 7, 'mean_price')},
        n AS (SELECT * REPLACE (nullif(mean_price, 0) AS mean_price) FROM a),
        e AS (SELECT *, last_value(CASE WHEN mean_price IS NOT NULL THEN bin_idx END IGNORE NULLS) OVER (ORDER BY bin_idx) AS p0,
            first_value(CASE WHEN mean_price IS NOT NULL THEN bin_idx END IGNORE NULLS) OVER (ORDER BY bin_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1,
            last_value(mean_price IGNORE NULLS) OVER (ORDER BY bin_idx) AS v0,
            first_value(mean_price IGNORE NULLS) OVER (ORDER BY bin_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1 FROM n)
        SELECT bin_idx, start_date, end_date, coalesce(mean_price, v0 + (v1 - v0) / nullif(p1 - p0, 0) * (bin_idx - p0), v0, v1) AS mean_price, n_days FROM e""",
    "complete_bins": f"""WITH ed AS (SELECT event_type, CAST(ts AS DATE) AS day FROM events),
        {forward('a', 'ed', 7, {'n_events': 'CAST(count(*) AS BIGINT)'}, ['event_type'])} SELECT * FROM a""",
    "feed_calendar": f"SELECT * FROM ({FEED_CALENDAR})",
    "feed_calendar_totals": f"WITH {ORDER_DAYS}, {forward('a', 'od', 30, N_ORDERS)} SELECT bin_idx, start_date, n_orders FROM a",
    "late_rule_counts": f"""WITH ld AS (SELECT *, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-03-01'),
        {forward('a', 'ld', 30, {'total_back': "count(CASE WHEN l_returnflag = 'R' THEN l_orderkey END)"})} SELECT * FROM a""",
    "complaint_intervals": offence_intervals("crimes", ""),
    "arrest_intervals": offence_intervals("arrest", "arrest_"),
    "diff_gaps": f"""{SPARSE_DAYS} SELECT x.o_orderstatus, x.bin_idx, x.n_orders - y.n_orders AS n_orders
        FROM s x JOIN s y ON y.o_orderstatus = x.o_orderstatus AND y.bin_idx = x.bin_idx - 1""",
    "trend_gaps": f"""{SPARSE_DAYS} SELECT x.o_orderstatus, x.bin_idx, x.n_orders, round(sum(y.n_orders * CASE WHEN abs(y.bin_idx - x.bin_idx) = 3 THEN 0.5 ELSE 1 END)::DOUBLE / 6, 6) + 0 AS trend
        FROM s x JOIN s y ON y.o_orderstatus = x.o_orderstatus AND y.bin_idx BETWEEN x.bin_idx - 3 AND x.bin_idx + 3 GROUP BY 1, 2, 3 HAVING count(*) = 7""",
    "ols_chrono_gaps": f"""{SPARSE_DAYS},
        g AS (SELECT o_orderstatus, n_orders::DOUBLE AS y, bin_idx::DOUBLE AS a, row_number() OVER w <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.8) AS is_train
            FROM s WINDOW w AS (PARTITION BY o_orderstatus ORDER BY bin_idx)),
        f AS (SELECT o_orderstatus, regr_slope(y, a) AS b, regr_intercept(y, a) AS c FROM g WHERE is_train GROUP BY 1)
        SELECT o_orderstatus, CASE WHEN is_train THEN 'in_sample' ELSE 'out_of_sample' END AS sample, count(*) AS n,
            round(avg((y - c - b * a) ** 2), 5) + 0 AS mse, round(avg(abs(y - c - b * a)), 5) + 0 AS mae FROM g JOIN f USING (o_orderstatus) GROUP BY 1, 2""",
    "gap_fill": f"WITH {SPARSE} SELECT * FROM a",
    "interpolate_linear": f"""WITH {SPARSE},
        n AS (SELECT o_custkey, bin_idx, nullif(n_orders, 0) AS v FROM a),
        e AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN bin_idx END IGNORE NULLS) OVER b AS p0, last_value(v IGNORE NULLS) OVER b AS v0,
            first_value(CASE WHEN v IS NOT NULL THEN bin_idx END IGNORE NULLS) OVER f AS p1, first_value(v IGNORE NULLS) OVER f AS v1 FROM n
            WINDOW b AS (PARTITION BY o_custkey ORDER BY bin_idx),
            f AS (PARTITION BY o_custkey ORDER BY bin_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT o_custkey, bin_idx, round(coalesce(v, v0 + (v1 - v0) / nullif(p1 - p0, 0) * (bin_idx - p0), v0, v1)::DOUBLE, 6) + 0 AS n_orders FROM e""",
    "date_bounds": """SELECT o_orderstatus, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day
        FROM orders GROUP BY o_orderstatus""",
    "union_with_cutover": """WITH h AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'),
        u AS (SELECT 'archive' AS source, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM h UNION ALL
            SELECT 'feed', o_orderkey, CAST(o_orderdate AS DATE) FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01'
            AND CAST(o_orderdate AS DATE) > (SELECT max(CAST(o_orderdate AS DATE)) FROM h))
        SELECT source, day, count(o_orderkey) AS n_orders FROM u GROUP BY source, day""",
    "interval_rule_counts": f"""WITH ld AS (SELECT *, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-03-01'),
        {forward('a', 'ld', 30, {'total_back': "count(CASE WHEN l_returnflag = 'R' THEN l_orderkey END)",
                                 'open_back': "count(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN l_orderkey END)"})}
        SELECT *, total_back - open_back AS closed_back FROM a""",
    "align_inner": f"WITH {ALIGNED} SELECT * REPLACE (round(quantity, 2) + 0 AS quantity) FROM m",
    "align_left": f"WITH {LEFT} SELECT * FROM j",
    "study_table": f"""WITH {LEFT} SELECT start_date, end_date, round(ln(1 + n_orders), 6) + 0 AS n_orders, round(ln(1 + items), 6) + 0 AS items
        FROM j WHERE n_orders IS NOT NULL""",
    "align_by_position": f"""WITH {ORDER_DAYS}, {LINE_DAYS}, {forward('a', 'od', 30, N_ORDERS, origin='1994-12-02')}, {forward('i', 'ld', 30, ITEMS, origin='1994-12-02')}
        SELECT bin_idx, n_orders, items, returned FROM a JOIN i USING (bin_idx)""",
    "era_split": f"""{PLAIN} SELECT CASE WHEN start_date < DATE '1998-06-01' THEN 'pre' ELSE 'post' END AS era, count(*) AS n,
        round(avg(n_orders), 6) AS mean, round(median(n_orders), 6) AS median FROM a GROUP BY era""",
    "mean_median": f"""WITH {SERIES} SELECT o_orderstatus, round(avg(n_orders), 6) AS mean, round(median(n_orders), 6) AS median
        FROM a GROUP BY o_orderstatus""",
    "group_stats": f"""WITH {SERIES} SELECT o_orderstatus, count(*) AS n, round(avg(n_orders), 6) AS mean, min(start_date) AS first_start,
        max(end_date) AS last_end FROM a GROUP BY o_orderstatus""",
    "row_counts": """SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem
        UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'events', count(*) FROM events""",
    "elapsed_days": """WITH e AS (SELECT event_id, ts, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00') AS us FROM events)
        SELECT event_id, CAST(floor(us / 86400000000) AS INTEGER) AS since, CAST(floor(-us / 86400000000) AS INTEGER) AS until,
        CAST(DATE '2024-01-15' - CAST(ts AS DATE) AS INTEGER) AS calendar_days FROM e""",
    "date_columns": """WITH e AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)
        SELECT o_orderkey, day, CAST(day + 29 AS DATE) AS plus_29, CAST(day - 29 AS DATE) AS minus_29,
        CAST(month(day) AS INTEGER) AS month, CAST(year(day) AS INTEGER) AS year FROM e""",
    "derived_columns": f"""WITH {LINE_DAYS}, {forward('i', 'ld', 30, ITEMS)} SELECT start_date, items - returned AS kept,
        round(items / 30, 6) AS items_per_day, round(ln(1 + items), 6) AS log_items FROM i""",
    "round_half_even": """SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS half_quantity,
        nullif(round_even(l_quantity / 8, 0), 0) AS eighth, l_quantity - 1 AS others FROM lineitem""",
    "filter_since": """SELECT count(*) AS n_since, count(*) FILTER (WHERE o_orderdate > TIMESTAMP '2001-01-01') AS n_after
        FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'""",
    "prefix_columns": _text_counts(["total_returned", "total_accepted"]),
    "first_and_last": f"""{PLAIN}, x AS (SELECT start_date, end_date, n_orders FROM a)
        (SELECT *, 'first' AS side FROM x ORDER BY start_date LIMIT 5) UNION ALL
        (SELECT *, 'last' AS side FROM x ORDER BY start_date DESC LIMIT 5)""",
    "drop_and_rename": f"WITH {LEFT} SELECT start_date, n_orders AS orders, items AS lines FROM j WHERE n_orders IS NOT NULL",
    "diff_1": f"""WITH {SERIES}, x AS (SELECT o_orderstatus, bin_idx, n_orders - lag(n_orders) OVER (PARTITION BY o_orderstatus
        ORDER BY bin_idx) AS n_orders FROM s) SELECT * FROM x WHERE n_orders IS NOT NULL""",
    "diff_2": f"""WITH {SERIES}, x AS (SELECT o_orderstatus, bin_idx, n_orders - 2 * lag(n_orders) OVER k + lag(n_orders, 2) OVER k AS n_orders
        FROM s WINDOW k AS (PARTITION BY o_orderstatus ORDER BY bin_idx)) SELECT * FROM x WHERE n_orders IS NOT NULL""",
    "decompose_additive": f"""WITH {SERIES},
        t AS (SELECT o_orderstatus, bin_idx, n_orders AS observed, CASE WHEN count(*) OVER (k ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13
            THEN (sum(n_orders) OVER (k ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
                + 0.5 * (lag(n_orders, 6) OVER k + lead(n_orders, 6) OVER k)) / 12 END AS trend
            FROM s WINDOW k AS (PARTITION BY o_orderstatus ORDER BY bin_idx)),
        f AS (SELECT o_orderstatus, bin_idx % 12 AS phase, avg(observed - trend) AS v FROM t GROUP BY ALL),
        g AS (SELECT o_orderstatus, phase, v - avg(v) OVER (PARTITION BY o_orderstatus) AS seasonal FROM f)
        SELECT o_orderstatus, bin_idx, observed::DOUBLE AS observed, round(trend::DOUBLE, 6) + 0 AS trend, round(seasonal, 6) + 0 AS seasonal,
        round(observed - trend - seasonal, 6) + 0 AS resid FROM t JOIN g ON g.o_orderstatus = t.o_orderstatus AND g.phase = t.bin_idx % 12""".replace(
        "SELECT o_orderstatus, bin_idx, observed::DOUBLE", "SELECT t.o_orderstatus, bin_idx, observed::DOUBLE"
    ),
    "acf24": f"""WITH {CURVE} SELECT o_orderstatus, lag, round(r, 6) + 0 AS acf, round(r - half, 6) + 0 AS ci_lo,
        round(r + half, 6) + 0 AS ci_hi, abs(r) > half AS significant FROM band""",
    "pacf24": f"""WITH RECURSIVE {LEVINSON},
        b AS (SELECT *, CASE WHEN lag = 0 THEN 0.0 ELSE {Z95} / sqrt(n) END AS half FROM p)
        SELECT o_orderstatus, lag, round(pacf, 6) + 0 AS pacf, round(pacf - half, 6) + 0 AS ci_lo,
        round(pacf + half, 6) + 0 AS ci_hi, abs(pacf) > half AS significant FROM b""",
    "order_hint": f"""WITH RECURSIVE {LEVINSON},
        h AS (SELECT o_orderstatus, max(CASE WHEN band.lag = 1 THEN r END) AS acf1,
            CAST(coalesce(min(CASE WHEN band.lag > 0 AND abs(pacf) <= {Z95} / sqrt(band.n) THEN band.lag END), 25) - 1 AS INTEGER) AS ar_cutoff,
            CAST(coalesce(min(CASE WHEN band.lag > 0 AND abs(r) <= half THEN band.lag END), 25) - 1 AS INTEGER) AS ma_cutoff
            FROM band JOIN p USING (o_orderstatus, lag) GROUP BY o_orderstatus)
        SELECT o_orderstatus, round(acf1, 6) + 0 AS acf1, ar_cutoff, ma_cutoff, CASE WHEN acf1 >= 0 THEN 'AR' ELSE 'MA' END AS suggest,
        CASE WHEN acf1 >= 0 THEN ar_cutoff ELSE ma_cutoff END AS terms FROM h""",
    "adf_lag0": ADF0,
    "adf_test": ADF,
    "ndiffs": f"WITH RECURSIVE {NDIFFS} SELECT * FROM nd",
    "stationary_signal": f"""WITH RECURSIVE {NDIFFS},
        first AS (SELECT o_orderstatus, min(bin_idx) AS p0 FROM s GROUP BY o_orderstatus)
        SELECT o_orderstatus, dx.d, p0 + dx.d + unnest(range(0, dx.n)) AS bin_idx, unnest(dx.y) AS y
        FROM dx JOIN nd ON nd.o_orderstatus = dx.o_orderstatus AND nd.d = dx.d AND nd.alpha = 0.05 JOIN first ON first.o_orderstatus = dx.o_orderstatus""".replace(
        "SELECT o_orderstatus, dx.d", "SELECT dx.o_orderstatus, dx.d"
    ),
    "pearson_matrix": _corr_pairs(),
    "corr_with_target": _corr_target(),
    "partial_corr": _partial_three(),
    "kde": _kde([]),
    "kde_by_group": _kde(["p_type"]),
    "kmeans2": f"{TWO_MEANS} SELECT * FROM k",
    "cluster_spans": f"""{TWO_MEANS} SELECT cluster, count(*) AS n, round(avg(n_orders), 6) AS mean, min(start_date) AS first_start,
        max(end_date) AS last_end FROM k GROUP BY cluster""",
    "kmeans3_by_status": f"""{THREE_MEANS} SELECT o_orderstatus, cluster, count(*) AS n, round(avg(n_orders), 6) AS mean,
        min(start_date) AS first_start, max(end_date) AS last_end FROM k GROUP BY o_orderstatus, cluster""",
    "minmax_scale": f"""WITH {SERIES} SELECT o_orderstatus, bin_idx, round((n_orders - min(n_orders) OVER k)
        / (max(n_orders) OVER k - min(n_orders) OVER k), 6) + 0 AS n_orders FROM s WINDOW k AS (PARTITION BY o_orderstatus)""",
    "ols_inference": f"""WITH {two_regressors(ALL_ROWS)},
        x AS (SELECT *, ssr / (n - 3) AS s2, 1 - ssr / syy AS rr, n * (ln(2 * pi()) + ln(ssr / n) + 1) + 6 AS ic FROM o),
        t AS (SELECT n, rr, ic, 'urgent' AS term, ba AS coef, sqrt(s2 * sbb / det) AS se FROM x UNION ALL
            SELECT n, rr, ic, 'items', bb, sqrt(s2 * saa / det) FROM x UNION ALL
            SELECT n, rr, ic, 'const', b0, sqrt(s2 * (1.0 / n + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / det)) FROM x)
        SELECT n, round(rr, 5) AS r2, round(1 - (1 - rr) * (n - 1) / (n - 3), 5) AS adj_r2, round(ic, 5) AS aic, term, round(coef, 5) + 0 AS coef,
        round(se, 5) + 0 AS se, round(coef / se, 5) + 0 AS t FROM t""",
    "ols_chrono": f"WITH {two_regressors(CHRONO)} {HOLDOUT_ERRORS}",
    "ols_random": f"WITH {two_regressors(RANDOM)} {HOLDOUT_ERRORS}",
    "ols_scaled_coefficients": f"""WITH {two_regressors(SCALED)} SELECT 'urgent' AS term, round(ba, 5) + 0 AS coef FROM o UNION ALL
        SELECT 'items', round(bb, 5) + 0 FROM o UNION ALL SELECT 'const', round(b0, 5) + 0 FROM o""",
    "ols_per_series": f"""WITH {SERIES}, g AS (SELECT o_orderstatus, CAST(regr_count(n_orders, bin_idx) AS BIGINT) AS n, regr_slope(n_orders, bin_idx) AS b,
            regr_intercept(n_orders, bin_idx) AS c, regr_sxx(n_orders, bin_idx) AS sxx, regr_syy(n_orders, bin_idx) AS syy,
            regr_sxy(n_orders, bin_idx) AS sxy, regr_avgx(n_orders, bin_idx) AS mx FROM s GROUP BY o_orderstatus),
        x AS (SELECT *, syy - b * sxy AS ssr FROM g),
        t AS (SELECT o_orderstatus, n, 1 - ssr / syy AS rr, n * (ln(2 * pi()) + ln(ssr / n) + 1) + 4 AS ic, 'bin_idx' AS term, b AS coef,
                sqrt(ssr / (n - 2) / sxx) AS se FROM x UNION ALL
            SELECT o_orderstatus, n, 1 - ssr / syy, n * (ln(2 * pi()) + ln(ssr / n) + 1) + 4, 'const', c,
                sqrt(ssr / (n - 2) * (1.0 / n + mx * mx / sxx)) FROM x)
        SELECT o_orderstatus, n, round(rr, 5) + 0 AS r2, round(ic, 5) AS aic, term, round(coef, 5) + 0 AS coef, round(se, 5) AS se,
        round(coef / se, 5) + 0 AS t FROM t""",
    "exact_quantiles": """SELECT l_returnflag, share::DOUBLE AS share, round(q, 4) AS quantile FROM (
        SELECT l_returnflag, unnest([0.1, 0.5, 0.99]) AS share, unnest(quantile_cont(l_extendedprice::DOUBLE, [0.1, 0.5, 0.99])) AS q FROM lineitem GROUP BY l_returnflag)""",
    "split_random": """SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('3|' || o_orderkey))
        > ceil(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) AS is_train FROM orders""",
    "rolling_origin_folds": f"""WITH {FOLDS} SELECT o_orderstatus, fold, CASE WHEN r < 36 THEN 'train' ELSE 'test' END AS role,
        CASE WHEN r >= 36 THEN r - 35 END AS step_ahead, bin_idx, n_orders FROM fo""",
    "backtest_ar1": f"WITH RECURSIVE {ar1(FOLDS)} {AR1_ERRORS}",
    "backtest_every_origin": f"WITH RECURSIVE {ar1(origin_folds(1))} {AR1_ERRORS}",
    "backtest_arma101": f"""WITH RECURSIVE {ARMA}
        SELECT rec.o_orderstatus, rec.fold, CAST(1 AS INTEGER) AS p, CAST(0 AS INTEGER) AS d, CAST(1 AS INTEGER) AS q, round(avg(abs(v - n_orders)), 4) AS mae
        FROM rec JOIN fo ON fo.o_orderstatus = rec.o_orderstatus AND fo.fold = rec.fold AND fo.r = 35 + rec.h GROUP BY rec.o_orderstatus, rec.fold""",
    "backtest_grid": f"""WITH RECURSIVE {FOLD_LISTS}, {autoregressions('fl', 3, 4, 3, 6)}, {GRID}
        SELECT * REPLACE (round(mae, 4) AS mae) FROM rk""",
    "forecast_best": _forecast_best(),
    "forecast12": f"""WITH RECURSIVE {SERIES},
        x AS (SELECT *, lag(n_orders) OVER (PARTITION BY o_orderstatus ORDER BY bin_idx) AS l1 FROM s),
        f AS (SELECT o_orderstatus, regr_slope(n_orders, l1) AS b, regr_intercept(n_orders, l1) AS c, max(bin_idx) AS e,
            arg_max(n_orders, bin_idx)::DOUBLE AS y FROM x GROUP BY o_orderstatus),
        rec(o_orderstatus, b, c, e, y, h) AS (SELECT o_orderstatus, b, c, e, y, 0 FROM f UNION ALL
            SELECT o_orderstatus, b, c, e, c + b * y, h + 1 FROM rec WHERE h < 12)
        SELECT o_orderstatus, CAST(h AS INTEGER) AS step_ahead, e + h AS bin_idx, round(y, 5) AS forecast FROM rec WHERE h > 0""",
    "csv_round_trip": f"{PLAIN} SELECT start_date, end_date, n_orders FROM a",
    "json_round_trip": "SELECT CAST(o_orderdate AS DATE) AS day, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY day",
    "json_array_round_trip": """SELECT event_id, '{"\\' || event_type || '"}, {' || user_id AS note, value FROM events""",
    "object_csv": "SELECT CAST(o_orderdate AS DATE) AS day, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY day",
    "parse_json_records": "SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events",
    "stream_interval_counts": """WITH e AS (SELECT event_type, DATE '2024-01-01' + 7 * CAST(floor((CAST(ts AS DATE) - DATE '2024-01-01') / 7.0) AS INTEGER) AS start_date
            FROM events), x AS (SELECT event_type, CAST(start_date AS DATE) AS start_date, CAST(start_date + 6 AS DATE) AS end_date,
            count(*) AS n_events FROM e GROUP BY ALL)
        SELECT * FROM x WHERE end_date + 1 <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
    "accumulate_snapshots": """SELECT day, CASE WHEN odd > 0 THEN odd ELSE n END AS n_rows FROM (
        SELECT CASE WHEN day(ts) <> 13 THEN CAST(ts AS DATE) END AS day, count(event_id) AS n, count(CASE WHEN user_id % 2 = 1 THEN event_id END) AS odd FROM events GROUP BY 1)""",
    "stream_filled_counts": """WITH w AS (SELECT unnest(range(0, 1 + (SELECT CAST(max(ts) AS DATE) - DATE '2024-01-01' FROM events) // 7)) AS k),
            k AS (SELECT DISTINCT event_type, user_id FROM events),
            c AS (SELECT event_type, user_id, (CAST(ts AS DATE) - DATE '2024-01-01') // 7 AS k, count(*) AS n FROM events GROUP BY ALL)
        SELECT event_type, user_id, CAST(DATE '2024-01-01' + CAST(7 * k AS INTEGER) AS DATE) AS start_date, CAST(DATE '2024-01-07' + CAST(7 * k AS INTEGER) AS DATE) AS end_date,
            coalesce(n, 0) AS n_events FROM k CROSS JOIN w LEFT JOIN c USING (event_type, user_id, k)
        WHERE DATE '2024-01-08' + CAST(7 * k AS INTEGER) <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)""",
}
