"""DuckDB equivalents of the registered queries, written independently of the Spark plans."""

from __future__ import annotations

from .operators.topics import NODE_WORDS
from .sources.contracts import METRICS

LEAF = "region, product_line, channel, segment"

LINES = """
lines AS (
    SELECT cast(date_trunc('week', o_orderdate) AS DATE) + 6 AS week, r_name AS region, p_type AS product_line, o_orderpriority AS channel,
           c_mktsegment AS segment, n_name AS nation, p_brand AS brand, cast(l_quantity AS DECIMAL(18,2)) AS quantity,
           cast(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS amount, l_returnflag = 'R' AS returned,
           cast(l_shipdate AS DATE) <= cast(o_orderdate AS DATE) + 30 AS in_time
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

PANEL = f"""{LINES}, facts AS (
    SELECT week, {LEAF}, coalesce(sum(amount) FILTER (WHERE NOT returned), 0) AS revenue, coalesce(sum(quantity) FILTER (WHERE NOT returned), 0) AS net_units,
           sum(quantity) AS gross_orders, coalesce(sum(quantity) FILTER (WHERE returned), 0) AS cancellations,
           count(*) AS deliveries, count(*) FILTER (WHERE in_time) AS in_time
    FROM lines GROUP BY week, {LEAF}
), tickets AS (
    SELECT week, region, product_line, channel, count(*) AS tickets FROM lines WHERE returned GROUP BY ALL
), panel AS (
    SELECT f.*, cast(revenue AS DOUBLE) / nullif(cast(net_units AS DOUBLE), 0) AS asp, cast(cancellations AS DOUBLE) / nullif(cast(gross_orders AS DOUBLE), 0) AS cancellation_rate,
           cast(in_time AS DOUBLE) / nullif(cast(deliveries AS DOUBLE), 0) AS delivery_sla_pct,
           tickets * coalesce(cast(revenue AS DOUBLE) / nullif(cast(sum(revenue) OVER (PARTITION BY f.week, f.region, f.product_line, f.channel) AS DOUBLE), 0), 0) AS ticket_volume
    FROM facts f LEFT JOIN tickets t ON f.week = t.week AND f.region = t.region AND f.product_line = t.product_line AND f.channel = t.channel
)"""

LATTICE = f"""{PANEL}, slices AS (
    SELECT week, {LEAF}, cast(grouping_id({LEAF}) AS INT) AS level, sum(revenue) AS revenue, sum(net_units) AS net_units, sum(gross_orders) AS gross_orders,
           sum(cancellations) AS cancellations, cast(sum(cancellations) AS DOUBLE) / nullif(cast(sum(gross_orders) AS DOUBLE), 0) AS cancellation_rate
    FROM panel GROUP BY week, CUBE ({LEAF})
)"""

LEAVES = f"""{PANEL}, final_week AS (SELECT max(week) AS aw FROM panel), means AS (
    SELECT {LEAF}, cast(sum(revenue) FILTER (WHERE week = aw) AS DOUBLE) AS actual,
           cast(sum(revenue) FILTER (WHERE week BETWEEN aw - 56 AND aw - 7) AS DOUBLE) / nullif(count(*) FILTER (WHERE week BETWEEN aw - 56 AND aw - 7), 0) AS recent_mean,
           cast(sum(revenue) FILTER (WHERE week BETWEEN aw - 371 AND aw - 357) AS DOUBLE) / nullif(count(*) FILTER (WHERE week BETWEEN aw - 371 AND aw - 357), 0) AS yoy_mean,
           cast(sum(revenue) FILTER (WHERE week BETWEEN aw - 427 AND aw - 371) AS DOUBLE) / nullif(count(*) FILTER (WHERE week BETWEEN aw - 427 AND aw - 371), 0) AS yoy_recent_mean
    FROM panel, final_week GROUP BY {LEAF}
), leaves AS (
    SELECT *, actual - expected AS gap FROM (
        SELECT *, recent_mean * CASE WHEN yoy_mean / nullif(yoy_recent_mean, 0) IS NULL THEN 1 ELSE greatest(0.5::DOUBLE, least(2::DOUBLE, yoy_mean / nullif(yoy_recent_mean, 0))) END AS expected FROM means WHERE actual IS NOT NULL
    ) WHERE expected IS NOT NULL
)"""

_BITS = {"region": 8, "product_line": 4, "channel": 2, "segment": 1}
VALUES = f"""{LEAVES}, groups AS (
    SELECT cast(grouping_id({LEAF}) AS INT) AS open, count(*) AS n, sum(gap) AS g FROM leaves GROUP BY CUBE ({LEAF})
), total AS (SELECT sum(gap * gap) AS total FROM leaves), v AS (
    SELECT 15 - open AS coalition, CASE WHEN open = 15 THEN 0 ELSE coalesce(sum(g * g / n) / any_value(total), 0) END AS v FROM groups, total WHERE n > 0 GROUP BY open
)"""

ANY = lambda d: f"CASE WHEN open & {_BITS[d]} <> 0 THEN 'ALL' ELSE {d} END AS {d}"

_TOTALS = f"""{PANEL}, final_week AS (SELECT max(week) AS aw FROM panel), recent AS (
    SELECT * FROM panel, final_week WHERE week BETWEEN aw - 56 AND aw
)"""

_SLICED = _TOTALS.replace("WHERE week BETWEEN aw - 56 AND aw\n", "WHERE week BETWEEN aw - 56 AND aw AND region = 'ASIA' AND channel = '1-URGENT'\n")


def _pvm(totals: str) -> str:
    return f"""WITH {totals}, k AS (
            SELECT product_line, coalesce(cast(sum(net_units) FILTER (WHERE week = aw) AS DOUBLE), 0) AS u1, coalesce(cast(sum(revenue) FILTER (WHERE week = aw) AS DOUBLE), 0) AS r1,
                   coalesce(cast(sum(net_units) FILTER (WHERE week < aw) AS DOUBLE) / nullif(count(DISTINCT week) FILTER (WHERE week < aw), 0), 0) AS u0,
                   coalesce(cast(sum(revenue) FILTER (WHERE week < aw) AS DOUBLE) / nullif(count(DISTINCT week) FILTER (WHERE week < aw), 0), 0) AS r0
            FROM recent GROUP BY product_line
        ), t AS (SELECT sum(u0) AS tu0, sum(u1) AS tu1, sum(r0) AS tr0, sum(r1) AS tr1 FROM k), o AS (
            SELECT (any_value(tu1) - any_value(tu0)) * any_value(tr0) / any_value(tu0) AS volume, sum((u1 - u0 * tu1 / tu0) * (coalesce(r0 / nullif(u0, 0), 0) - tr0 / tu0)) AS mix,
                   sum(u1 * (coalesce(r1 / nullif(u1, 0), 0) - coalesce(r0 / nullif(u0, 0), 0))) AS price, any_value(tr1 - tr0) AS total_change FROM k, t
        ) SELECT round(volume, 2) AS volume, round(price, 2) AS price, round(mix, 2) AS mix, round(total_change, 2) AS total_change,
                 CASE greatest(abs(volume), abs(price), abs(mix)) WHEN abs(volume) THEN 'volume' WHEN abs(price) THEN 'price' ELSE 'mix' END AS dominant FROM o"""


def _funnel(totals: str) -> str:
    return f"""WITH {totals}, k AS (
            SELECT coalesce(cast(sum(gross_orders) FILTER (WHERE week = aw) AS DOUBLE), 0) AS g1, coalesce(cast(sum(cancellations) FILTER (WHERE week = aw) AS DOUBLE) / cast(sum(gross_orders) FILTER (WHERE week = aw) AS DOUBLE), 0) AS c1,
                   cast(sum(gross_orders) FILTER (WHERE week < aw) AS DOUBLE) / count(DISTINCT week) FILTER (WHERE week < aw) AS g0,
                   cast(sum(cancellations) FILTER (WHERE week < aw) AS DOUBLE) / cast(sum(gross_orders) FILTER (WHERE week < aw) AS DOUBLE) AS c0 FROM recent
        ), o AS (SELECT (g1 - g0) * (1 - c0) AS a, -g0 * (c1 - c0) AS b, -(g1 - g0) * (c1 - c0) AS c FROM k)
        SELECT round(a, 4) AS orders_effect, round(b, 4) AS cancellation_effect, round(c, 4) AS interaction,
               CASE greatest(abs(a), abs(b), abs(c)) WHEN abs(a) THEN 'orders' WHEN abs(b) THEN 'cancellations' ELSE 'interaction' END AS dominant FROM o"""

ASIA = """
    SELECT unit, week, rate AS y, CASE WHEN unit = 'ASIA' AND week >= DATE '2000-06-04' THEN 1.0::DOUBLE ELSE 0.0 END AS d FROM units WHERE week >= DATE '2000-06-04' - 364 AND rate IS NOT NULL
"""
MANY_UNITS = """
    SELECT nation || '|' || brand AS unit, week, coalesce(sum(quantity) FILTER (WHERE returned), 0)::DOUBLE / sum(quantity)::DOUBLE AS y,
           CASE WHEN nation = 'NATION_7' AND week >= DATE '2000-06-04' THEN 1.0::DOUBLE ELSE 0.0 END AS d
    FROM lines WHERE week >= DATE '2000-06-04' - 364 GROUP BY nation, brand, week
"""


def _two_way(rows: str, rounds: int = 120) -> str:
    """fit(e, se, n, free): y on d with effects of units and weeks, by projecting alternately on what units' and weeks'
    means leave; the rank of the dummies is units + weeks - components."""
    return f"""r AS ({rows}), it(k, unit, week, y, d) AS (
        SELECT 0, unit, week, y, d FROM r
        UNION ALL
        SELECT k + 1, unit, week, y - avg(y) OVER (PARTITION BY k, week), d - avg(d) OVER (PARTITION BY k, week)
        FROM (SELECT k, unit, week, y - avg(y) OVER (PARTITION BY k, unit) AS y, d - avg(d) OVER (PARTITION BY k, unit) AS d FROM it WHERE k < {rounds})
    ), near AS (
        SELECT DISTINCT a.week AS x, b.week AS z FROM r a JOIN r b USING (unit)
    ), reach(x, z) AS (
        SELECT x, z FROM near UNION SELECT reach.x, near.z FROM reach JOIN near ON near.x = reach.z
    ), rank AS (
        SELECT (SELECT count(DISTINCT unit) + count(DISTINCT week) FROM r) - (SELECT count(DISTINCT least) FROM (SELECT x, min(z) AS least FROM reach GROUP BY x)) AS rank
    ), s AS (
        SELECT sum(y * d) / sum(d * d) AS e, sum(y * y) - sum(y * d) * sum(y * d) / sum(d * d) AS rss, sum(d * d) AS dd, count(*) AS n FROM it WHERE k = {rounds}
    ), fit AS (
        SELECT e, sqrt(rss / ((n - rank - 1) * dd)) AS se, n, n - rank - 1 AS free FROM s, rank
    )"""



_WHOLE_PANEL = f"""WITH {PANEL} SELECT week, {LEAF}, cast(revenue AS DOUBLE) AS revenue, cast(net_units AS DOUBLE) AS net_units, cast(gross_orders AS DOUBLE) AS gross_orders,
        cast(cancellations AS DOUBLE) AS cancellations, asp, cancellation_rate, delivery_sla_pct, round(ticket_volume, 6) AS ticket_volume FROM panel"""

_ELIGIBLE = f"""WITH {LATTICE}, s AS (
            SELECT level, {LEAF}, count(*) AS n_weeks, max(week) AS latest, stddev_pop(cast(revenue AS DOUBLE)) AS spread FROM slices GROUP BY level, {LEAF}
        ) SELECT level, {LEAF}, n_weeks FROM s WHERE n_weeks >= 10 AND spread > 1e-8 AND latest = (SELECT max(week) FROM slices)"""

ORACLES: dict[str, str] = {
    "panel_from_sources": _WHOLE_PANEL,
    "panel_maintained": _WHOLE_PANEL,
    "iceberg_series": _ELIGIBLE,
    "panel_align": f"""WITH {PANEL} SELECT week, {LEAF}, cast(revenue AS DOUBLE) AS revenue, cast(net_units AS DOUBLE) AS net_units, cast(gross_orders AS DOUBLE) AS gross_orders,
        cast(cancellations AS DOUBLE) AS cancellations, asp, cancellation_rate, delivery_sla_pct FROM panel""",
    "ratio_weighted": f"""WITH {LINES} SELECT week, region, cast(sum(quantity) FILTER (WHERE returned) AS DOUBLE) / cast(sum(quantity) AS DOUBLE) AS cancellation_rate,
        cast(count(*) FILTER (WHERE in_time) AS DOUBLE) / cast(count(*) AS DOUBLE) AS delivery_sla_pct
        FROM lines GROUP BY week, region HAVING sum(quantity) FILTER (WHERE returned) IS NOT NULL""",
    "ticket_allocation": f"WITH {PANEL} SELECT week, {LEAF}, round(ticket_volume, 6) AS ticket_volume FROM panel",
    "source_freshness": f"""WITH {LINES}, s AS (
            SELECT 'warehouse' AS source, max(week) AS latest FROM lines WHERE NOT returned
            UNION ALL SELECT 'order_system', max(week) FROM lines
            UNION ALL SELECT 'logistics', max(week) FROM lines
            UNION ALL SELECT 'tickets', max(week) FROM lines WHERE returned
        ), m AS (SELECT * FROM (VALUES {", ".join(str((m.source, m.grain, m.refresh_minutes, m.tolerance_hours)) for m in METRICS.metrics.values())}) t(source, native_grain, refresh, tolerance_hours)
        ), a AS (SELECT *, (DATE '2001-08-19' - latest) * 24.0 AS behind FROM s JOIN m USING (source))
        SELECT source, native_grain, latest AS latest_period, round(cast(greatest(least(behind, greatest(behind - 168, refresh / 60)), 0) AS DOUBLE), 1) AS age_hours, cast(tolerance_hours AS DOUBLE) AS tolerance_hours,
               CASE WHEN round(cast(greatest(least(behind, greatest(behind - 168, refresh / 60)), 0) AS DOUBLE), 1) > tolerance_hours THEN 'stale' ELSE 'fresh' END AS status FROM a""",
    "source_conflicts": f"""WITH {LINES}, w AS (
            SELECT cast(sum(quantity) AS DOUBLE) * avg(cast(amount AS DOUBLE) / cast(quantity AS DOUBLE)) AS quoted, cast(sum(amount) AS DOUBLE) AS revenue FROM lines WHERE NOT returned GROUP BY week, {LEAF}
        ) SELECT count(*) AS n_conflicts, round(max(abs(quoted - revenue) / revenue), 6) AS largest_gap FROM w WHERE abs(quoted - revenue) / nullif(revenue, 0) > 0.02""",
    "slice_lattice": f"WITH {LATTICE} SELECT week, {LEAF}, level, cast(revenue AS DOUBLE) AS revenue, cancellation_rate FROM slices",
    "lattice_wow": f"""WITH {LATTICE}, w AS (
            SELECT *, lag(cast(revenue AS DOUBLE)) OVER (PARTITION BY level, {LEAF} ORDER BY week) AS before FROM slices
        ) SELECT week, {LEAF}, level, (cast(revenue AS DOUBLE) - before) / nullif(abs(before), 0) * 100 AS wow_pct FROM w""",
    "eligible_series": _ELIGIBLE,
    "leaf_expectation": f"WITH {LEAVES} SELECT {LEAF}, actual, expected, gap FROM leaves",
    "shapley_value_fn": f"WITH {VALUES} SELECT cast(coalition AS INT) AS coalition, round(v, 6) AS v FROM v",
    "shapley_dimensions": f"""WITH {VALUES}, d AS (SELECT * FROM (VALUES ('region', 8), ('product_line', 4), ('channel', 2), ('segment', 1)) t(dimension, bit)), phi AS (
            SELECT dimension, sum([6, 2, 2, 6][bit_count(a.coalition) + 1] / 24 * (b.v - a.v)) AS phi FROM d, v a, v b WHERE a.coalition & bit = 0 AND b.coalition = a.coalition + bit GROUP BY dimension
        ) SELECT dimension, round(100 * phi / sum(phi) OVER (), 2) AS share_pct FROM phi""",
    "pvm_bridge": _pvm(_TOTALS),
    "pvm_bridge_slice": _pvm(_SLICED),
    "funnel_split": _funnel(_TOTALS),
    "funnel_split_slice": _funnel(_SLICED),
    "top_leaves": f"""WITH {LEAVES} SELECT {LEAF}, round(gap, 4) AS gap, round(gap / (SELECT sum(gap) FROM leaves), 6) AS share FROM leaves ORDER BY abs(round(gap, 4)) DESC, {LEAF} LIMIT 10""",
    "shortfall_80": f"""WITH {LEAVES}, c AS (
            SELECT sum(round(gap, 4)) OVER (ORDER BY gap, {LEAF} ROWS UNBOUNDED PRECEDING) / sum(round(gap, 4)) OVER () AS cum FROM leaves WHERE round(gap, 4) < 0
        ) SELECT count(*) AS n_negative, count(*) FILTER (WHERE cum <= 0.8) + CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS n_leaves FROM c""",
    "best_slice_rule": f"""WITH {LEAVES}, g AS (
            SELECT cast(grouping_id({LEAF}) AS INT) AS open, {LEAF}, round(sum(gap), 4) AS gap FROM leaves GROUP BY CUBE ({LEAF})
        ), w AS (SELECT * FROM g WHERE open <> 15 QUALIFY row_number() OVER (PARTITION BY open ORDER BY gap, {LEAF}) = 1), s AS (
            SELECT *, 4 - bit_count(open) AS depth, round(gap / (SELECT round(sum(gap), 4) FROM leaves), 6) AS share FROM w
        ) SELECT {", ".join(ANY(d) for d in _BITS)}, cast(depth AS INT) AS depth, gap, share FROM s
        ORDER BY share >= 0.45 DESC, CASE WHEN share >= 0.45 THEN depth ELSE 0 END DESC, share DESC, open LIMIT 1""",
}

_FLOOR = METRICS.metric("revenue").impact_floor
RESIDUALS = f"""{LATTICE}, moves AS (
    SELECT level, {LEAF}, week, cast(revenue AS DOUBLE) - lag(cast(revenue AS DOUBLE)) OVER (PARTITION BY level, {LEAF} ORDER BY week) AS residual FROM slices
), residuals AS (
    SELECT *, row_number() OVER (PARTITION BY level, {LEAF} ORDER BY week DESC) - 1 AS back FROM moves WHERE residual IS NOT NULL
)"""
TESTS = f"""{RESIDUALS}, last AS (SELECT * FROM residuals WHERE back = 0), tests AS (
    SELECT l.level, l.region, l.product_line, l.channel, l.segment, (1 + count(*) FILTER (WHERE abs(r.residual) >= abs(l.residual))) / (count(*) + 1) AS p_value, count(*) AS n, any_value(l.residual) AS deviation
    FROM last l JOIN residuals r ON r.back > 0 AND r.level = l.level AND r.region IS NOT DISTINCT FROM l.region AND r.product_line IS NOT DISTINCT FROM l.product_line
         AND r.channel IS NOT DISTINCT FROM l.channel AND r.segment IS NOT DISTINCT FROM l.segment GROUP BY l.level, l.region, l.product_line, l.channel, l.segment
)"""
FDR = f"""{TESTS}, ranked AS (SELECT *, row_number() OVER (ORDER BY p_value) AS r, count(*) OVER () AS m FROM tests), q AS (
    SELECT *, least(1.0, min(p_value * m / r) OVER (ORDER BY p_value DESC, r DESC ROWS UNBOUNDED PRECEDING)) AS raw FROM ranked
), found AS (SELECT * EXCLUDE (raw), min(raw) OVER (PARTITION BY p_value) AS q_value FROM q)"""

UNITS = f"""{PANEL}, units AS (
    SELECT region AS unit, week, cast(sum(cancellations) AS DOUBLE) / greatest(cast(sum(gross_orders) AS DOUBLE), 1e-9) AS rate, cast(sum(gross_orders) AS DOUBLE) AS gross_orders,
           cast(sum(revenue) AS DOUBLE) AS revenue, cast(sum(net_units) AS DOUBLE) AS net_units FROM panel GROUP BY region, week
), sided AS (
    SELECT *, FALSE AS post FROM units WHERE week < DATE '2000-06-04' AND week >= DATE '2000-06-04' - 364
    UNION ALL SELECT *, TRUE FROM units WHERE week >= DATE '2000-06-04' QUALIFY row_number() OVER (PARTITION BY unit ORDER BY week) <= 5
)"""

EDGES = f"""sold AS (
    SELECT s_nationkey, c_nationkey, sum(cast(l_quantity AS DECIMAL(18,2))) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    WHERE s_nationkey < c_nationkey GROUP BY ALL
), edges AS (
    SELECT 'NATION_' || s_nationkey AS src, 'NATION_' || c_nationkey AS dst FROM sold QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY n DESC, c_nationkey) <= 2
), walk AS (
    SELECT src, dst, [src, dst] AS path FROM edges
    UNION ALL SELECT w.src, e.dst, list_append(w.path, e.dst) FROM walk w JOIN edges e ON w.dst = e.src WHERE len(w.path) <= 6 AND NOT list_contains(w.path, e.dst)
), short AS (
    SELECT src, dst, len(path) - 1 AS n_edges, array_to_string(path, '>') AS path FROM walk QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY len(path), array_to_string(path, '>')) = 1
)"""

# regions in order are bits 1, 2, 4, 8, 16: the third needs the second; the fifth the first and the realised third
_REALISED = "(relieved & 11) | CASE WHEN relieved & 6 = 6 THEN 4 ELSE 0 END | CASE WHEN relieved & 23 = 23 THEN 16 ELSE 0 END"
_N = 10  # channels and segments
BUNDLES = f"""{LINES}, blocked AS (
    SELECT region, row_number() OVER (ORDER BY region) - 1 AS p, v FROM (SELECT region, floor(coalesce(sum(amount) FILTER (returned), 0) / count(DISTINCT week))::DOUBLE AS v FROM lines GROUP BY region)
), each AS (
    SELECT 'channel' AS family, channel AS lever, region, sum(quantity) AS q, coalesce(sum(amount) FILTER (returned), 0) AS v FROM lines GROUP BY channel, region
    UNION ALL SELECT 'segment', segment, region, sum(quantity), coalesce(sum(amount) FILTER (returned), 0) FROM lines GROUP BY segment, region
), most AS (
    SELECT family, lever, sum(1 << p)::INT AS relieves FROM (SELECT * FROM each QUALIFY row_number() OVER (PARTITION BY family, lever ORDER BY v DESC, region) <= 2) JOIN blocked USING (region) GROUP BY ALL
), levers AS (
    SELECT k, lever, family || ' ' || lever AS label, cost, relieves, ['lead', 'manager', 'director', 'vp'][k % 4 + 1] AS authority, k % 4 AS level, family
    FROM (SELECT *, row_number() OVER (ORDER BY family, lever) - 1 AS k FROM (SELECT family, lever, floor(sum(q) / 10)::DOUBLE AS cost FROM each GROUP BY ALL) JOIN most USING (family, lever))
), budget AS (
    SELECT floor(0.4 * sum(cost)) AS budget FROM levers
), picks AS (
    SELECT b.bundle, l.* FROM range({1 << _N}) b(bundle) LEFT JOIN levers l ON (b.bundle >> l.k) & 1 = 1
), sums AS (
    SELECT bundle, coalesce(string_agg(lever, '+' ORDER BY k), '') AS levers, coalesce(sum(cost), 0)::DOUBLE AS cost, coalesce(bit_or(relieves), 0)::INT AS relieved, count(DISTINCT family)::INT AS n_families, coalesce(max(level), 0) AS level FROM picks GROUP BY bundle
), gated AS (
    SELECT *, {_REALISED} AS realised FROM sums
), bundles AS (
    SELECT gated.*, (SELECT sum(((realised >> p) & 1) * v) FROM blocked)::DOUBLE AS value, cost <= budget AS feasible FROM gated, budget
)"""

CASES = f"""{LINES}, dated AS (SELECT *, max(week) OVER () AS last_week FROM lines), sides AS (
    SELECT *, week = last_week AS is_now, week BETWEEN last_week - 56 AND last_week - 7 AS is_before FROM dated
), cases AS (
    SELECT nation AS "case", coalesce(sum(amount) FILTER (NOT returned AND is_now), 0)::DOUBLE - coalesce(sum(amount) FILTER (NOT returned AND is_before), 0)::DOUBLE / 8 AS total_gap,
           -(coalesce(sum(amount) FILTER (returned AND is_now), 0)::DOUBLE - coalesce(sum(amount) FILTER (returned AND is_before), 0)::DOUBLE / 8) AS explained,
           count(DISTINCT product_line) FILTER (returned AND is_now) AS n_accepted, count(*) FILTER (is_now AND NOT in_time AND returned) AS n_overlaps, (max(last_week) - max(week)) // 7 AS n_stale,
           count(*) FILTER (is_now AND NOT in_time AND quantity > 45) AS n_conflicts, count(DISTINCT week) AS n_weeks, count(DISTINCT segment) FILTER (is_now AND quantity < 5) AS n_excluded, count(DISTINCT week) >= 20 AS out_of_sample
    FROM sides GROUP BY nation
), shares AS (SELECT *, least(coalesce(abs(explained) / nullif(abs(total_gap), 0), 0), 1) AS share FROM cases), fired AS (
    SELECT "case", unnest([{{'code': 'UNEXPLAINED_RESIDUAL', 'fired': 1 - share > 0.40}}, {{'code': 'COMPETING_EXPLANATIONS', 'fired': n_overlaps > 0}}, {{'code': 'STALE_SOURCE', 'fired': n_stale > 0}}, {{'code': 'SOURCE_CONFLICT', 'fired': n_conflicts > 0}},
        {{'code': 'SPARSE_HISTORY', 'fired': n_weeks < 60}}, {{'code': 'GRAIN_POLICY', 'fired': n_excluded > 0}}, {{'code': 'CALIBRATION_INTEGRITY', 'fired': NOT out_of_sample}}], recursive := TRUE) FROM shares
)"""

_RETURNS = f"""{LINES}, counts AS (SELECT nation AS topic, week, count(*) AS n FROM lines WHERE returned GROUP BY ALL), filled AS (
    SELECT t.topic, cast(w.week AS DATE) AS week, coalesce(n, 0) AS n FROM (SELECT DISTINCT topic FROM counts) t CROSS JOIN (SELECT unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS week FROM counts) w LEFT JOIN counts c ON c.topic = t.topic AND c.week = cast(w.week AS DATE)
)"""

FEEDBACK = """feedback AS (
    SELECT CASE WHEN event_type IN ('purchase', 'error') THEN 'hypothesis' ELSE 'action' END AS entity_type, 'H' || user_id AS entity_id,
           CASE event_type WHEN 'purchase' THEN 'confirmed' WHEN 'error' THEN 'rejected' WHEN 'click' THEN 'acted_on' ELSE 'no_effect' END AS verdict, 'cause' || user_id % 20 AS cause_node, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts
    FROM events WHERE event_type IN ('purchase', 'error', 'click', 'view')
)"""
STAGES = """stages AS (
    SELECT value AS latency_ms, CASE event_type WHEN 'signup' THEN 'io' WHEN 'view' THEN 'deterministic' WHEN 'purchase' THEN 'template' ELSE 'statistical' END AS kind, (props->>'$.k')::BIGINT AS rows FROM events
)"""
CALLS = """calls AS (
    SELECT CASE WHEN user_id % 3 = 0 THEN 'large' ELSE 'small' END AS model, event_id % 7 = 0 AS cached, CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 1000 + 100 END AS input_tokens,
           CASE WHEN event_id % 7 = 0 THEN 0 ELSE user_id % 300 END AS output_tokens, value AS latency_ms, CASE WHEN user_id % 3 = 0 THEN 3 ELSE 1 END AS input_price, CASE WHEN user_id % 3 = 0 THEN 15 ELSE 5 END AS output_price
    FROM events WHERE event_type = 'purchase'
)"""

_TOKENS = "list_transform(regexp_extract_all({}, '-?[0-9][0-9,]*\\.?[0-9]*'), lambda t: regexp_replace(replace(t, ',', ''), '\\.$', ''))"

ORACLES |= {
    "conformal_quantile": f"""WITH {RESIDUALS}, s AS (
            SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY level, {LEAF}) AS n FROM residuals WHERE back > 0 WINDOW w AS (PARTITION BY level, {LEAF} ORDER BY abs(residual))
        ) SELECT level, {LEAF}, max(n) AS n_calibration, round(max(abs(residual)) FILTER (WHERE r = ceil((n + 1) * 0.9::DOUBLE)), 4) AS half_width, max(ceil((n + 1) * 0.9::DOUBLE)) <= max(n) AS valid FROM s GROUP BY level, {LEAF}""",
    "median_half_width": f"""WITH {RESIDUALS}, s AS (
            SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY level, {LEAF}) AS n FROM residuals WHERE back > 0 WINDOW w AS (PARTITION BY level, {LEAF} ORDER BY abs(residual))
        ), h AS (SELECT level, max(abs(residual)) FILTER (WHERE r = ceil((n + 1) * 0.9::DOUBLE)) AS half_width, max(ceil((n + 1) * 0.9::DOUBLE)) <= max(n) AS valid FROM s GROUP BY level, {LEAF}
        ) SELECT level, round(median(half_width), 4) AS median_half_width, count(*) AS n FROM h WHERE valid GROUP BY level""",
    "empirical_pvalue": f"WITH {TESTS} SELECT level, {LEAF}, round(p_value, 9) AS p_value, n FROM tests",
    "bh_fdr": f"WITH {FDR} SELECT level, {LEAF}, round(q_value, 9) AS q_value, q_value <= 0.10 AS survives_fdr FROM found",
    "materiality": f"WITH {FDR} SELECT level, {LEAF}, round(abs(deviation), 4) AS business_impact, abs(deviation) >= {_FLOOR} AS meets_threshold, q_value <= 0.10 AND abs(deviation) >= {_FLOOR} AS material FROM found",
    "detection_diagnostics": f"""WITH {FDR} SELECT count(*) AS n_tests, count(*) FILTER (WHERE p_value <= 0.05) AS naive, count(*) FILTER (WHERE q_value <= 0.10) AS survivors,
        count(*) FILTER (WHERE q_value <= 0.10 AND abs(deviation) >= {_FLOOR}) AS material, count(*) FILTER (WHERE p_value <= 0.05) - count(*) FILTER (WHERE q_value <= 0.10) AS alarms_avoided FROM found""",
    "dag_reachability": f"WITH RECURSIVE {EDGES} SELECT src, dst, cast(n_edges AS INT) AS n_edges, path FROM short",
    "corroboration_merge": f"""WITH RECURSIVE {EDGES}, c AS (SELECT 'C' || n_nationkey AS id, ['event', 'topic', 'feed'][n_nationkey % 3 + 1] AS source, n_name AS node FROM nation),
        o AS (SELECT c.*, s.path FROM c LEFT JOIN short s ON s.src = node AND s.dst = 'NATION_24'), m AS (
            SELECT o.*, (SELECT min(e.id) FROM o e WHERE e.source = 'event' AND o.source <> 'event' AND list_contains(string_split(e.path, '>'), o.node)) AS merged_into FROM o
        ) SELECT *, CASE WHEN merged_into IS NOT NULL THEN 'merged' WHEN path IS NULL THEN 'rejected' ELSE 'kept' END AS fate FROM m""",
    "metric_exclusions": f"""WITH {PANEL} SELECT unnest([{{'metric': 'revenue', 'n': count(revenue), 'excluded': FALSE}}, {{'metric': 'cancellation_rate', 'n': count(cancellation_rate), 'excluded': FALSE}}, {{'metric': 'delivery_sla_pct', 'n': count(delivery_sla_pct), 'excluded': FALSE}},
            {{'metric': 'ticket_volume', 'n': count(ticket_volume), 'excluded': FALSE}}, {{'metric': 'nps', 'n': 0, 'excluded': TRUE}}], recursive := TRUE) FROM panel""",
    "topic_node_map": f"""WITH w AS (SELECT doc_id AS topic, list_distinct(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+')) AS words FROM documents), n AS (
            SELECT topic, [{", ".join(f"len(list_intersect(words, {list(ws)}))" for _, ws in NODE_WORDS)}] AS hits FROM w
        ) SELECT topic, CASE WHEN list_max(hits) > 0 THEN {[node for node, _ in NODE_WORDS]}[list_position(hits, list_max(hits))] ELSE 'unmapped_topic' END AS node FROM n""",
    "date_spine_zero_fill": f"WITH {_RETURNS} SELECT topic, week, n FROM filled",
    "topic_spike": f"""WITH {_RETURNS}, b AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY week DESC) - 1 AS back FROM filled), m AS (
            SELECT topic, avg(n) FILTER (WHERE back < 6) AS post, avg(n) FILTER (WHERE back BETWEEN 6 AND 31) AS pre FROM b GROUP BY topic
        ), h AS (SELECT *, round(post / greatest(pre, 0.5), 6) AS ratio FROM m)
        SELECT h.topic, round(pre, 6) AS pre, round(post, 6) AS post, ratio, min(week) FILTER (WHERE back < 6 AND n > pre) AS onset FROM h JOIN b ON b.topic = h.topic WHERE ratio >= 1.05 GROUP BY ALL""",
    "weekly_event_volume": """SELECT cast(date_trunc('week', ts) AS DATE) + 6 AS week, event_type, count(*) AS n, round(cast(sum(cast(value AS DECIMAL(28,6))) AS DOUBLE), 4) AS value FROM events GROUP BY ALL""",
    "unit_series": f"WITH {UNITS} SELECT unit, week, rate, gross_orders FROM units",
    "unit_series_slice": f"WITH {LINES} SELECT region AS unit, week, cast(coalesce(sum(quantity) FILTER (WHERE returned), 0) AS DOUBLE) / cast(sum(quantity) AS DOUBLE) AS rate, cast(sum(quantity) AS DOUBLE) AS gross_orders FROM lines WHERE channel = '1-URGENT' GROUP BY region, week",
    "onset_changepoint": f"""WITH {UNITS}, i AS (SELECT unit, week, gross_orders AS v, row_number() OVER (PARTITION BY unit ORDER BY week) - 1 AS i, count(*) OVER (PARTITION BY unit) AS n FROM units), s AS (
            SELECT *, n - 4 AS stop, greatest(n - 4 - CASE WHEN n >= 31 THEN 26 ELSE greatest(floor(n / 3), 5) END, 0) AS start FROM i
        ), b AS (SELECT *, avg(v) FILTER (WHERE i >= start AND i < stop) OVER (PARTITION BY unit) AS mu, stddev_samp(v) FILTER (WHERE i >= start AND i < stop) OVER (PARTITION BY unit) AS sd FROM s), d AS (
            SELECT *, CASE WHEN v > mu + 3 * sd THEN 1 WHEN v < mu - 3 * sd THEN -1 ELSE 0 END AS side FROM b
        ), l AS (SELECT *, lead(side) OVER (PARTITION BY unit ORDER BY week) AS next_side FROM d)
        SELECT unit, min(week) FILTER (WHERE i >= start AND side <> 0 AND side = next_side) AS onset, max(n) AS n_weeks FROM l GROUP BY unit""",
    "did_twfe": f"WITH RECURSIVE {UNITS}, {_two_way(ASIA)} SELECT round(e, 6) AS estimate, round(se, 6) AS se, n FROM fit",
    "did_twfe_all_weeks": f"WITH RECURSIVE {UNITS}, {_two_way(ASIA)} SELECT round(e, 6) AS estimate, round(se, 6) AS se, n, free FROM fit",
    "did_many_units": f"WITH RECURSIVE {LINES}, {_two_way(MANY_UNITS, 40)} SELECT round(e, 6) AS estimate, round(se, 6) AS se, n, free FROM fit",
    "pretrend_slope": f"""WITH {UNITS}, g AS (
            SELECT week, max(rate) FILTER (WHERE unit = 'ASIA') - avg(rate) FILTER (WHERE unit <> 'ASIA') AS y, (week - DATE '2000-06-04') / 7 AS t FROM sided WHERE NOT post GROUP BY week
        ), f AS (SELECT regr_slope(y, t) AS slope, regr_r2(y, t) AS r2, count(*) AS n FROM g WHERE y IS NOT NULL)
        SELECT round(slope, 8) AS slope, round(sign(slope) * sqrt(r2 * (n - 2) / (1 - r2)), 4) AS t, n FROM f""",
    "synth_two_donor": f"""WITH {UNITS}, w AS (
            SELECT week, post, max(rate) FILTER (WHERE unit = 'ASIA') AS y, max(rate) FILTER (WHERE unit = 'AFRICA') AS a, max(rate) FILTER (WHERE unit = 'EUROPE') AS b FROM sided GROUP BY week, post
        ), k AS (SELECT * FROM w WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL), m AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM k WHERE NOT post), s AS (
            SELECT post, my, y / my AS y, a / ma AS a, b / mb AS b FROM k, m
        ), v AS (SELECT greatest(0.0::DOUBLE, least(1.0::DOUBLE, sum((y - b) * (a - b)) / sum((a - b) * (a - b)))) AS w FROM s WHERE NOT post)
        SELECT round(max(w), 6) AS weight, round(avg((y - w * a - (1 - w) * b) * my) FILTER (WHERE post), 6) AS gap, round(sqrt(avg((y - w * a - (1 - w) * b) * (y - w * a - (1 - w) * b)) FILTER (WHERE NOT post)), 6) AS pre_rmse FROM s, v""",
    "dose_response": f"""WITH {UNITS}, x AS (SELECT unit, max(gross_orders) AS exposure FROM units WHERE week BETWEEN DATE '2000-06-04' AND DATE '2000-06-04' + 28 GROUP BY unit), e AS (
            SELECT unit, avg(rate) FILTER (WHERE post) - avg(rate) FILTER (WHERE NOT post) AS effect FROM sided GROUP BY unit
        ), j AS (SELECT * FROM x JOIN e USING (unit) WHERE effect IS NOT NULL), t AS (SELECT * FROM j ORDER BY round(effect, 9) DESC, unit DESC LIMIT 1)
        SELECT round(corr(exposure, effect), 6) AS correlation, (SELECT unit FROM t) AS most_affected, (SELECT exposure FROM t) < 0.85 * max(exposure) AS inverted, count(*) AS n FROM j""",
    "effect_translation": f"""WITH {UNITS}, b AS (SELECT avg(gross_orders) * avg(revenue / nullif(net_units, 0)) AS base FROM sided WHERE unit = 'ASIA' AND NOT post)
        SELECT round(-0.05::DOUBLE * base, 2) AS impact, round(-(0.05::DOUBLE + 1.96 * 0.01) * base, 2) AS impact_low, round(-(0.05::DOUBLE - 1.96 * 0.01) * base, 2) AS impact_high FROM b""",
    "competing_overlap": f"""WITH {LINES}, w AS (SELECT nation, product_line, week, sum(amount)::DOUBLE AS v FROM lines WHERE NOT returned GROUP BY ALL), e AS (
            SELECT nation AS "case", product_line AS id, avg(v) - 1.96 * stddev_samp(v) / sqrt(count(*)) AS low, avg(v) + 1.96 * stddev_samp(v) / sqrt(count(*)) AS high FROM w GROUP BY ALL
        ), p AS (
            SELECT a."case", a.id AS first, b.id AS second, (least(a.high, b.high) - greatest(a.low, b.low)) / (greatest(a.high, b.high) - least(a.low, b.low)) AS overlap
            FROM e a JOIN e b ON a."case" = b."case" AND a.id < b.id AND a.high > a.low AND b.high > b.low
        ) SELECT "case", first, second, round(overlap, 6) AS overlap FROM p WHERE overlap > 0.6""",
    "shipping_overlaps": """WITH i AS (
            SELECT o_custkey, o_orderkey AS id, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS low, date_diff('day', DATE '1970-01-01', max(l_shipdate)::DATE) AS high
            FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, o_orderdate
        ), p AS (
            SELECT a.o_custkey, a.id AS first, b.id AS second, (least(a.high, b.high) - greatest(a.low, b.low))::DOUBLE / (greatest(a.high, b.high) - least(a.low, b.low)) AS overlap
            FROM i a JOIN i b ON a.o_custkey = b.o_custkey AND a.id < b.id AND a.high > a.low AND b.high > b.low
        ) SELECT o_custkey, first, second, round(overlap, 6) AS overlap FROM p WHERE overlap > 0.6""",
    "abstention_triggers": f'WITH {CASES} SELECT "case", code, fired FROM fired',
    "abstention_mode": f"""WITH {CASES}, g AS (SELECT "case", bool_or(fired AND code IN ('STALE_SOURCE', 'SOURCE_CONFLICT', 'CALIBRATION_INTEGRITY')) AS blocked, bool_or(fired AND code = 'UNEXPLAINED_RESIDUAL') AS rest, bool_or(fired AND code = 'COMPETING_EXPLANATIONS') AS many,
            count(*) FILTER (WHERE fired AND code <> 'GRAIN_POLICY') AS k, count(*) FILTER (WHERE fired) AS n_fired FROM fired GROUP BY "case"
        ), m AS (SELECT g.*, share, CASE WHEN blocked OR rest AND n_accepted = 0 THEN 'abstain' WHEN many THEN 'competing' WHEN n_accepted > 0 THEN 'confident' ELSE 'abstain' END AS mode FROM g JOIN shares USING ("case"))
        SELECT "case", mode, round(cast(greatest(0, least(CASE WHEN mode = 'abstain' THEN least(share * pow(0.82, k), 0.35) ELSE share * pow(0.82, k) END, 0.99)) AS DOUBLE), 4) AS confidence, n_fired FROM m""",
    "feedback_conflict": f"""WITH {FEEDBACK}, c AS (
            SELECT cause_node, count(*) FILTER (verdict = 'confirmed') AS confirmed, count(*) FILTER (verdict = 'rejected') AS rejected, arg_max(verdict, ts || verdict) AS latest FROM feedback WHERE entity_type = 'hypothesis' GROUP BY cause_node
        ), h AS (SELECT DISTINCT user_id, 'H' || user_id AS id, 'cause' || user_id % 20 AS node FROM events)
        SELECT id, node, confirmed, rejected FROM h JOIN c ON cause_node = node WHERE user_id % 2 = 0 AND latest = 'rejected'""",
    "feedback_summary": f"WITH {FEEDBACK} SELECT entity_type, verdict, count(*) AS n, array_to_string(list_sort(list(DISTINCT entity_id)), ',') AS entities FROM feedback GROUP BY ALL",
    "bundle_enumeration": f"WITH {BUNDLES} SELECT bundle, levers, cost, relieved, cast(realised AS INT) AS realised, value, n_families, feasible FROM bundles",
    "bundle_dominance": f"WITH {BUNDLES} SELECT cast(realised AS INT) AS realised, levers, cost, value FROM bundles WHERE feasible QUALIFY row_number() OVER (PARTITION BY realised ORDER BY cost, bundle) = 1",
    "bundle_pruning": f"""WITH {BUNDLES} SELECT bundle, levers, cost, feasible, CASE WHEN NOT feasible THEN 'costs ' || format('{{:,}}', cast(cost - (SELECT budget FROM budget) AS BIGINT)) || ' more than the budget' END AS reason
        FROM bundles QUALIFY NOT feasible OR row_number() OVER (PARTITION BY realised, feasible ORDER BY cost, bundle) = 1""",
    "bundle_rank": f"""WITH {BUNDLES}, u AS (SELECT * FROM bundles WHERE feasible QUALIFY row_number() OVER (PARTITION BY realised ORDER BY cost, bundle) = 1)
        SELECT cast(row_number() OVER (ORDER BY value DESC, cost, bundle) AS INT) AS rank, levers, cost, value, round(cost / nullif(value, 0), 6) AS weeks_to_payback FROM u ORDER BY rank LIMIT 10""",
    "budget_sweep": f"""WITH {BUNDLES} SELECT g.budget, levers, cost, value FROM (SELECT (k * 1e4)::DOUBLE AS budget FROM range(1, 16) r(k)) g JOIN bundles ON cost <= g.budget QUALIFY row_number() OVER (PARTITION BY g.budget ORDER BY value DESC, cost, bundle) = 1""",
    "persona_levers": f"""WITH {BUNDLES}, p AS (SELECT * FROM (VALUES ('asia_desk', 1), ('board', 3)) t(persona, rank))
        SELECT persona, levers, cost, value FROM p JOIN bundles ON level <= rank WHERE feasible QUALIFY row_number() OVER (PARTITION BY persona ORDER BY value DESC, cost, bundle) = 1""",
    "greedy_baselines": f"""WITH RECURSIVE {BUNDLES}, one AS (
            SELECT k, bundles.cost, value FROM bundles JOIN levers ON bundle = 1 << k
        ), orders AS (
            SELECT 'cheapest' AS method, k, cost, row_number() OVER (ORDER BY cost, k) AS r FROM one UNION ALL SELECT 'value_for_cost', k, cost, row_number() OVER (ORDER BY value / cost DESC, k) FROM one
        ), fill(method, r, cost, bundle) AS (
            SELECT DISTINCT method, 0::BIGINT, 0.0::DOUBLE, 0::BIGINT FROM orders
            UNION ALL SELECT o.method, o.r, (CASE WHEN f.cost + o.cost <= (SELECT budget FROM budget) THEN f.cost + o.cost ELSE f.cost END)::DOUBLE,
                             CASE WHEN f.cost + o.cost <= (SELECT budget FROM budget) THEN f.bundle + (1::BIGINT << o.k) ELSE f.bundle END FROM fill f JOIN orders o ON o.method = f.method AND o.r = f.r + 1
        ) SELECT f.method, b.levers, b.cost, b.value FROM fill f JOIN bundles b USING (bundle) WHERE f.r = {_N}""",
    "optimum_by_bounds": f"WITH {BUNDLES} SELECT levers, value FROM bundles WHERE feasible ORDER BY value DESC, cost, bundle LIMIT 1",
    "lever_recommendations": f"""WITH {BUNDLES}, b AS (SELECT * FROM bundles WHERE feasible ORDER BY value DESC, cost, bundle LIMIT 1)
        SELECT l.lever, label, l.cost::DOUBLE AS cost, authority, value AS bundle_value FROM b, levers l WHERE list_contains(string_split(levers, '+'), l.lever)""",
    "number_tokens": f"WITH t AS (SELECT doc_id, unnest(list_distinct({_TOKENS.format('text')})) AS token FROM documents) SELECT token, count(*) AS n FROM t GROUP BY token",
    "grounding_check": f"""WITH k AS (SELECT DISTINCT unnest({_TOKENS.format('text')}) AS token FROM benchmark), t AS (SELECT doc_id, unnest(list_distinct({_TOKENS.format('text')})) AS token FROM documents), m AS (
            SELECT doc_id, string_agg(token, ',' ORDER BY token) AS missing FROM t WHERE token NOT IN ('0', '1', '2', '3', '100', '95', '90') AND token NOT IN (SELECT token FROM k) GROUP BY doc_id
        ) SELECT d.doc_id AS "case", coalesce(missing, '') AS missing, missing IS NULL AS passed FROM documents d LEFT JOIN m USING (doc_id)""",
    "evidence_leaves": """WITH l AS (
            SELECT '$.measure.value' AS path, value::VARCHAR AS v, value AS x FROM events UNION ALL SELECT '$.measure.props.k', props->>'$.k', (props->>'$.k')::DOUBLE FROM events
            UNION ALL SELECT '$.of[0]', event_type, NULL FROM events UNION ALL SELECT '$.of[1].user', user_id::VARCHAR, user_id::DOUBLE FROM events
        ) SELECT path, count(*) AS n, round(sum(x), 4) AS total, count(DISTINCT v) AS n_distinct FROM l GROUP BY path""",
    "evidence_vocabulary": """WITH l AS (
            SELECT event_id, unnest([value, (props->>'$.k')::DOUBLE, user_id::DOUBLE]) AS x FROM events
        ), w AS (
            SELECT event_id, unnest([x, abs(x), abs(x) / 1e5, abs(x) / 1e7, abs(x) / 1e3, abs(x) / 1e6, abs(x) * 100]) AS v FROM l
        ), f AS (
            SELECT DISTINCT event_id, unnest([format('{:.0f}', v), format('{:.1f}', v), format('{:.2f}', v)]) AS token FROM w
        ) SELECT token, count(*) AS n FROM f GROUP BY token""",
    "rls_filtered_panel": f"""WITH {PANEL} SELECT week, {LEAF}, cast(revenue AS DOUBLE) AS revenue, cast(net_units AS DOUBLE) AS net_units, cast(gross_orders AS DOUBLE) AS gross_orders, cast(cancellations AS DOUBLE) AS cancellations, cancellation_rate, delivery_sla_pct
        FROM panel WHERE region = 'ASIA'""",
    "telemetry_by_kind": f"WITH {STAGES} SELECT kind, round(sum(latency_ms), 3) AS latency_ms, count(*) AS n, sum(rows)::BIGINT AS rows FROM stages GROUP BY kind",
    "model_call_costs": f"WITH {CALLS} SELECT model, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, count(*) FILTER (cached) AS cached, round((sum(input_tokens) * any_value(input_price) + sum(output_tokens) * any_value(output_price)) / 1e6, 9)::DOUBLE AS cost FROM calls GROUP BY model",
    "run_summary": f"""WITH {STAGES}, {CALLS}, c AS (SELECT sum(latency_ms) AS waited, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(input_tokens * input_price + output_tokens * output_price)::DOUBLE / 1e6 AS cost FROM calls), t AS (SELECT sum(latency_ms) AS latency_ms, count(*) AS stages FROM stages)
        SELECT round(latency_ms, 3) AS latency_ms, stages, round(waited / latency_ms, 6) AS model_share, input_tokens, output_tokens, round(cost, 6) AS cost, round(cost * 90, 4) AS cost_other FROM c, t""",
    "stage_rows": f"WITH {LATTICE} SELECT 'panel' AS name, count(*) AS rows FROM panel UNION ALL SELECT 'lattice', count(*) FROM slices",
    "method_registry": "SELECT * FROM (VALUES ('relational', 3::BIGINT), ('rule', 9), ('statistical', 6), ('ml', 1), ('causal', 5), ('optimisation', 2), ('template', 1)) t(category, n)",
}
