"""SQL for the registered queries, written independently of the operators: plain range joins,
correlated counts and window functions over the same tables."""

from __future__ import annotations

REORDER_SEEDS = "['1996-07-01', '1997-07-01', '1998-07-01', '1999-07-01', '2000-07-01']"
PURCHASE_SEEDS = "['2024-01-10', '2024-01-15', '2024-01-20', '2024-01-25']"

GRID = f"grid AS (SELECT CAST(unnest({REORDER_SEEDS}) AS TIMESTAMP) AS seed_time)"
REORDER = f"""{GRID},
keyed AS (SELECT c_custkey, seed_time FROM customer CROSS JOIN grid),
task AS (SELECT k.c_custkey, k.seed_time, CAST(count(o.o_orderkey) > 0 AS INTEGER) AS label
  FROM keyed k LEFT JOIN orders o ON o.o_custkey = k.c_custkey AND o.o_orderdate > k.seed_time
    AND o.o_orderdate <= k.seed_time + INTERVAL 180 DAY
  GROUP BY k.c_custkey, k.seed_time)"""
SPEND = f"""{GRID},
keyed AS (SELECT c_custkey, seed_time FROM customer CROSS JOIN grid),
task AS (SELECT k.c_custkey, k.seed_time, coalesce(sum(o.o_totalprice), 0.0) AS label
  FROM keyed k LEFT JOIN orders o ON o.o_custkey = k.c_custkey AND o.o_orderdate > k.seed_time
    AND o.o_orderdate <= k.seed_time + INTERVAL 180 DAY
  GROUP BY k.c_custkey, k.seed_time)"""
PURCHASE = f"""grid AS (SELECT CAST(unnest({PURCHASE_SEEDS}) AS TIMESTAMP) AS seed_time),
task AS (SELECT c_custkey, seed_time FROM customer CROSS JOIN grid
  WHERE c_custkey IN (SELECT user_id FROM events))"""
ORDER_LINES = """task AS (SELECT o.o_orderkey, o.o_orderdate + INTERVAL 30 DAY AS seed_time,
    CAST(coalesce(max(l.l_shipdate) > o.o_orderdate + INTERVAL 30 DAY, false) AS INTEGER) AS label
  FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R'
  GROUP BY o.o_orderkey, o.o_orderdate)"""
SPLIT = """CASE WHEN t.seed_time < TIMESTAMP '1999-01-01' THEN 'train'
    WHEN t.seed_time < TIMESTAMP '2000-01-01' THEN 'val' ELSE 'test' END"""
DAY = "86400000000.0"


def numeric(table: str, column: str, alias: str, functions: str = "mean sum min max", digits: int = 6) -> str:
    calls = {"mean": "avg", "sum": "sum", "min": "min", "max": "max"}
    return ",\n  ".join(
        f"round({calls[f]}(CAST({alias}.{column} AS DOUBLE)), {digits}) AS {table}__{column}__{f}"
        for f in functions.split()
    )


def nunique(table: str, column: str, alias: str) -> str:
    return f"count(DISTINCT {alias}.{column}) AS {table}__{column}__nunique"


def count_and_recency(table: str, key: str, time: str, alias: str) -> str:
    return (
        f"count({alias}.{key}) AS {table}__row_count,\n  "
        f"round(date_diff('microsecond', max({alias}.{time}), t.seed_time) / {DAY}, 6) AS {table}__recency_days"
    )


ORDER_FEATURES = ",\n  ".join(
    [
        count_and_recency("orders", "o_orderkey", "o_orderdate", "o"),
        numeric("orders", "o_orderkey", "o"),
        numeric("orders", "o_totalprice", "o"),
        nunique("orders", "o_orderstatus", "o"),
        nunique("orders", "o_orderpriority", "o"),
    ]
)
EVENT_FEATURES = ",\n  ".join(
    [
        count_and_recency("events", "event_id", "ts", "e"),
        numeric("events", "event_id", "e"),
        numeric("events", "value", "e"),
        nunique("events", "event_type", "e"),
        nunique("events", "props", "e"),
    ]
)


def order_window(days: int | None, extra: str = "") -> str:
    lower = f"AND o.o_orderdate >= t.seed_time - INTERVAL {days} DAY" if days is not None else ""
    return f"""LEFT JOIN orders o ON o.o_custkey = t.c_custkey AND o.o_orderdate <= t.seed_time {lower} {extra}
GROUP BY t.c_custkey, t.seed_time"""


def days_column(days: int | None) -> str:
    return f"CAST({'NULL' if days is None else days} AS BIGINT) AS lookback_days"


def tagg_orders(days: int | None, features: str = ORDER_FEATURES) -> str:
    return f"SELECT t.c_custkey, t.seed_time, {days_column(days)},\n  {features}\nFROM task t {order_window(days)}"


PARTLY_DATED = """dated AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
  CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END AS o_orderdate FROM orders)"""


def tagg_partly_dated(keep: bool) -> str:
    undated = "OR o.o_orderdate IS NULL" if keep else ""
    return f"""WITH {REORDER}, {PARTLY_DATED}
SELECT t.c_custkey, t.seed_time, {days_column(90)},
  {ORDER_FEATURES}
FROM task t LEFT JOIN dated o ON o.o_custkey = t.c_custkey
  AND ((o.o_orderdate <= t.seed_time AND o.o_orderdate >= t.seed_time - INTERVAL 90 DAY) {undated})
GROUP BY t.c_custkey, t.seed_time"""


CUSTOMER = """round(c.c_acctbal, 6) AS customer__c_acctbal, c.c_mktsegment AS customer__c_mktsegment,
  c.c_name AS customer__c_name, c.c_nationkey AS customer__c_nationkey"""
NATION = "n.n_name AS nation__n_name, n.n_regionkey AS nation__n_regionkey"
ORDER_KEYED = "LEFT JOIN customer c ON c.c_custkey = t.c_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey"


def temporal_view(days: int, split: str = "", where: str = "") -> str:
    return f"""WITH {REORDER}, agg AS ({tagg_orders(days)})
SELECT t.c_custkey, t.seed_time, t.label, {split}
  {CUSTOMER}, {NATION}, a.* EXCLUDE (c_custkey, seed_time, lookback_days)
FROM task t {ORDER_KEYED}
JOIN agg a ON a.c_custkey = t.c_custkey AND a.seed_time = t.seed_time {where}"""


NATION_TASK = f"""{GRID},
task AS (SELECT n_nationkey, seed_time, 0 AS label FROM nation CROSS JOIN grid),
nation_orders AS (SELECT o.*, c.c_nationkey FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey)"""
NATION_COUNTS = {
    "customer": """(SELECT count(*) FROM customer c WHERE c.c_nationkey = t.n_nationkey)
    AS graphdeg__customer__static_count""",
    "orders": """(SELECT count(*) FROM nation_orders o WHERE o.c_nationkey = t.n_nationkey
      AND o.o_orderdate <= t.seed_time) AS graphdeg__orders__count_leq_seed""",
    "supplier": """(SELECT count(*) FROM supplier s WHERE s.s_nationkey = t.n_nationkey)
    AS graphdeg__supplier__static_count""",
}

DATES = """ranked AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer),
dates AS (SELECT c_custkey, TIMESTAMP '2015-06-01' + to_days(CAST(floor(i / greatest(n - 1, 1)::DOUBLE * 487) AS INTEGER))
  AS customer_date FROM ranked)"""


def relative(offset: str, days: int, missing: int) -> str:
    return f"""WITH {DATES}
SELECT o.o_orderkey, CASE WHEN o.o_orderkey % {missing} <> 0
  THEN d.customer_date - to_days(CAST(floor(({offset}) * {days}) AS INTEGER)) END AS event_date
FROM orders o LEFT JOIN dates d ON d.c_custkey = o.o_custkey"""


SORTED_IDS = "SELECT c_custkey AS old_id, row_number() OVER (ORDER BY c_custkey) - 1 AS new_id FROM customer"
ORDERED = """ordered AS (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS n FROM {t}
  WHERE {c} IS NOT NULL)"""
LINE_IDS = "lines AS (SELECT *, row_number() OVER () - 1 AS row_id FROM lineitem)"

TRAIN_LINES = "(SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01')"
MEASURED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MEDIANS = " UNION ALL ".join(
    f"SELECT '{c}' AS c, count({c}) AS n, round(median({c}), 6) AS median FROM {TRAIN_LINES}" for c in MEASURED
)


def mode(column: str) -> str:
    return f"""SELECT c, mode, n FROM (SELECT '{column}' AS c, {column} AS mode, count(*) AS n,
  row_number() OVER (ORDER BY count(*) DESC, {column}) AS r FROM orders GROUP BY {column}) WHERE r = 1"""


SCORED = f"""{REORDER},
windows AS (SELECT unnest([7, 30, 90, NULL]) AS w),
scored AS (SELECT t.c_custkey, t.seed_time, t.label, {SPLIT} AS split, c.c_mktsegment,
    CAST(w.w AS BIGINT) AS lookback_days, count(o.o_orderkey) AS row_count,
    round(coalesce(sum(o.o_totalprice), 0.0), 2) AS total
  FROM task t JOIN customer c ON c.c_custkey = t.c_custkey CROSS JOIN windows w
  LEFT JOIN orders o ON o.o_custkey = t.c_custkey AND o.o_orderdate <= t.seed_time
    AND (w.w IS NULL OR o.o_orderdate >= t.seed_time - to_days(CAST(w.w AS INTEGER)))
  GROUP BY t.c_custkey, t.seed_time, t.label, c.c_mktsegment, w.w)"""


def auroc(source: str, score: str, by: str) -> str:
    """AUROC as the rank sum of the positives, with mean ranks for ties."""
    return f"""SELECT {by}, sum(label) AS n_pos, sum(1 - label) AS n_neg,
    CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 THEN
      (sum(label * mean_rank) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label)::DOUBLE * sum(1 - label)) END AS auroc
  FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY {score})
      + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0 AS mean_rank FROM {source})
  GROUP BY {by}"""


def auroc_rows(source: str, score: str, by: str) -> str:
    return f"""SELECT {by}, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg,
  CAST(0 AS BIGINT) AS n_missing, round(auroc, 9) AS auroc
FROM ({auroc(source, score, by)})"""


RUNS = f"""{SCORED},
long AS (SELECT label, c_mktsegment, 'window=' || coalesce(CAST(lookback_days AS VARCHAR), 'all') AS representation,
    'count' AS model_name, CAST(row_count AS DOUBLE) AS score FROM scored WHERE split <> 'train'
  UNION ALL SELECT label, c_mktsegment, 'window=' || coalesce(CAST(lookback_days AS VARCHAR), 'all'),
    'total', total FROM scored WHERE split <> 'train'),
runs AS (SELECT c_mktsegment AS task_name, 'auroc' AS metric_name, representation, model_name, auroc AS metric_value
  FROM ({auroc("long", "score", "c_mktsegment, representation, model_name")})),
best AS (SELECT task_name, metric_name, representation, max(metric_value) AS metric_value FROM runs
  GROUP BY task_name, metric_name, representation),
utilities AS (SELECT *, CASE WHEN abs(max(metric_value) OVER (PARTITION BY task_name) - 0.5) < 1e-12 THEN 0.0
  ELSE (metric_value - 0.5) / (max(metric_value) OVER (PARTITION BY task_name) - 0.5) END AS utility FROM best),
ris AS (SELECT task_name, count(*) AS n_representations, 1 - stddev_pop(utility) AS ris,
  stddev_pop(utility) AS utility_std, min(utility) AS utility_min, max(utility) AS utility_max,
  max(utility) - min(utility) AS utility_gap FROM utilities GROUP BY task_name)"""

COLUMN_RUNS = f"""{REORDER},
scores AS (SELECT t.label, c.c_acctbal, CAST(t.c_custkey AS DOUBLE) AS c_custkey,
    count(o.o_orderkey) FILTER (o.o_orderdate >= t.seed_time - INTERVAL 30 DAY) AS recent, count(o.o_orderkey) AS ever
  FROM task t JOIN customer c ON c.c_custkey = t.c_custkey
  LEFT JOIN orders o ON o.o_custkey = t.c_custkey AND o.o_orderdate <= t.seed_time
  WHERE t.seed_time >= TIMESTAMP '2000-01-01' GROUP BY t.c_custkey, t.seed_time, t.label, c.c_acctbal),
long AS (SELECT label, 'customer__c_acctbal:jt_entity' AS model_name, 'joined-table' AS view_name,
    'joined-table|subview=jt_entity|hops=1' AS representation, c_acctbal AS score FROM scores
  UNION ALL SELECT label, 'customer__c_acctbal:jt_temporalagg', 'joined-table',
    'joined-table|subview=jt_temporalagg|hops=1|window=30', recent FROM scores
  UNION ALL SELECT label, 'c_custkey', 'relational', 'relational', c_custkey FROM scores
  UNION ALL SELECT label, 'graphdeg__orders__count_leq_seed', 'graph-counts',
    'graph-counts|features=incident_degree_counts', ever FROM scores),
runs AS ({auroc("long", "score", "model_name, view_name, representation")})"""

_B_WINDOWS = {7: "7", 30: "30", 90: "90", None: "None"}
_B_LONG = " UNION ALL ".join(
    [
        f"""SELECT label, 'customer__c_acctbal:jt_temporalagg:hops=1:w={w}' AS model_name, 'joined-table' AS view_name,
    'joined-table|subview=jt_temporalagg|hops=1|window={w}' AS representation, CAST(n_{w} AS DOUBLE) AS score FROM scores"""
        for w in _B_WINDOWS.values()
    ]
    + [
        f"""SELECT label, 'customer__c_acctbal:jt_entity:hops={h}:w=None', 'joined-table',
    'joined-table|subview=jt_entity|hops={h}', c_acctbal FROM scores"""
        for h in (1, 2)
    ]
    + [
        f"""SELECT label, 'graphdeg__orders__count_leq_seed:K={k}', 'graph-counts', 'graph-counts|K={k}', CAST(n_None AS DOUBLE) FROM scores"""
        for k in (100, 300, 500)
    ]
)
COLUMN_RUNS_B = f"""{REORDER},
scores AS (SELECT t.label, c.c_acctbal, {", ".join(
    "count(o.o_orderkey)" + (f" FILTER (o.o_orderdate >= t.seed_time - INTERVAL {w} DAY)" if w else "") + f" AS n_{n}" for w, n in _B_WINDOWS.items()
)}
  FROM task t JOIN customer c ON c.c_custkey = t.c_custkey
  LEFT JOIN orders o ON o.o_custkey = t.c_custkey AND o.o_orderdate <= t.seed_time
  WHERE t.seed_time >= TIMESTAMP '2000-01-01' GROUP BY t.c_custkey, t.seed_time, t.label, c.c_acctbal),
long AS ({_B_LONG}),
runs AS ({auroc("long", "score", "model_name, view_name, representation")})"""

ERRORS = f"""{SPEND},
errors AS (SELECT t.seed_time, t.label, coalesce(sum(o.o_totalprice), 0.0) AS prediction
  FROM task t LEFT JOIN orders o ON o.o_custkey = t.c_custkey AND o.o_orderdate <= t.seed_time
    AND o.o_orderdate >= t.seed_time - INTERVAL 180 DAY
  GROUP BY t.c_custkey, t.seed_time, t.label)"""

SWEEP_RESULTS = f"""{SCORED},
by_split AS ({auroc("(SELECT * FROM scored WHERE lookback_days IS NULL)", "row_count", "c_mktsegment, split")}),
results AS (SELECT c_mktsegment AS task, CASE WHEN c_mktsegment < 'F' THEN 'early' ELSE 'late' END AS split,
  CAST(NULL AS BIGINT) AS seed, CAST(1 AS BIGINT) AS n_features,
  CAST(max(CASE WHEN split = 'train' THEN n_pos + n_neg END) AS BIGINT) AS n_train,
  CAST(max(CASE WHEN split = 'val' THEN n_pos + n_neg END) AS BIGINT) AS n_val,
  CAST(max(CASE WHEN split = 'test' THEN n_pos + n_neg END) AS BIGINT) AS n_test,
  max(CASE WHEN split = 'val' THEN auroc END) AS val_auroc, max(CASE WHEN split = 'test' THEN auroc END) AS test_auroc
  FROM by_split GROUP BY c_mktsegment)"""

CSV_TASK = """labelled AS (SELECT c_custkey, CAST(c_acctbal > 5000 AS INTEGER) AS rich,
    row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer WHERE c_nationkey <> 3),
csv_dates AS (SELECT c_custkey, rich, i, n,
  TIMESTAMP '2015-06-01' + to_days(CAST(floor(i / greatest(n - 1, 1)::DOUBLE * 487) AS INTEGER)) AS customer_date FROM labelled)"""

SUMMARY = """SELECT 'table' AS kind, '{t}' AS name, count(*) AS n_rows, CAST({n} AS BIGINT) AS n_columns,
  '{pk}' AS primary_key, '{time}' AS time_col, '{fk}' AS foreign_keys FROM {t}"""


def static_nodes(limit: str) -> str:
    part = """SELECT t.n_nationkey, t.seed_time, '{table}' AS node_type,
  row_number() OVER (PARTITION BY t.n_nationkey, t.seed_time ORDER BY {key}) - 1 AS node_idx,
  round(CAST(CAST({key} AS FLOAT) AS DOUBLE), 6) AS f0, CAST({n} AS BIGINT) AS n_features
FROM task t JOIN {table} ON {link} = t.n_nationkey"""
    both = [
        part.format(table="customer", key="c_custkey", link="c_nationkey", n=3),
        part.format(table="supplier", key="s_suppkey", link="s_nationkey", n=3),
    ]
    return f"WITH {NATION_TASK} SELECT * FROM ({both[0]} UNION ALL {both[1]}) {limit}"


CREDIT_DATES = """labelled AS (SELECT c_custkey, CAST(c_acctbal > 5000 AS INTEGER) AS target, c_acctbal,
    row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer WHERE c_nationkey <> 3),
app AS (SELECT *, TIMESTAMP '2015-06-01' + to_days(CAST(floor(i / greatest(n - 1, 1)::DOUBLE * 487) AS INTEGER)) AS d FROM labelled),
cut AS (SELECT max(CASE WHEN i = floor(0.7::DOUBLE * n) THEN d END) AS a, max(CASE WHEN i = floor(0.85::DOUBLE * n) THEN d END) AS b FROM app),
odd AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 1)"""


def _credit_child(name: str, rows: str, days: str) -> str:
    """Rows and days since the last one of a child whose dates lie ``days`` before the application."""
    return f"""{name} AS (SELECT a.c_custkey, count(*) AS n, round(min(x.days), 6) AS recency
  FROM app a JOIN (SELECT o_custkey, {days} AS days FROM {rows}) x ON x.o_custkey = a.c_custkey
  WHERE x.days IS NULL OR x.days BETWEEN 0 AND 200 GROUP BY a.c_custkey)"""


CREDIT_CHILDREN = {
    "bureau": ("orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 50 <> 0", "CAST(o_orderkey % 977 AS DOUBLE)"),
    "previous_application": ("orders WHERE o_orderkey % 2 = 1", "CAST(o_orderkey % 500 AS DOUBLE)"),
    "pos_cash_balance": ("odd WHERE l_linenumber <= 2", "l_linenumber * 30.0::DOUBLE"),
    "credit_card_balance": ("odd WHERE l_linenumber BETWEEN 3 AND 4", "l_linenumber * 30.0::DOUBLE"),
    "installments_payments": (
        "odd WHERE l_linenumber > 4",
        "CASE WHEN l_partkey % 7 <> 0 THEN CAST(l_partkey % 300 AS DOUBLE) END",
    ),
}
CREDIT_VIEW = f"""WITH {CREDIT_DATES},
{", ".join(_credit_child(f"x_{name}", rows, days) for name, (rows, days) in CREDIT_CHILDREN.items())}
SELECT a.c_custkey AS SK_ID_CURR, a.d AS APPLICATION_DATE, a.target AS TARGET,
  CASE WHEN a.d < cut.a THEN 'train' WHEN a.d < cut.b THEN 'val' ELSE 'test' END AS split,
  round(a.c_acctbal, 6) AS application__AMT_CREDIT,
  {", ".join(f"coalesce(x_{n}.n, 0) AS {n}__row_count, x_{n}.recency AS {n}__recency_days" for n in CREDIT_CHILDREN)}
FROM app a CROSS JOIN cut {" ".join(f"LEFT JOIN x_{n} ON x_{n}.c_custkey = a.c_custkey" for n in CREDIT_CHILDREN)}"""
_COUNTED = "SELECT '{name}' AS table_name, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_bad FROM {rows}"
CREDIT_BAD = f"""WITH {CREDIT_DATES}
{_COUNTED.format(name="application", rows="app")}
UNION ALL SELECT 'bureau', count(*) FILTER (o_orderkey % 50 <> 0), count(*) FILTER (o_orderkey % 50 = 0) FROM orders WHERE o_orderkey % 2 = 0
UNION ALL {_COUNTED.format(name="bureau_balance", rows="lineitem WHERE l_orderkey % 2 = 0")}
UNION ALL {_COUNTED.format(name="previous_application", rows="orders WHERE o_orderkey % 2 = 1")}
UNION ALL {_COUNTED.format(name="pos_cash_balance", rows="odd WHERE l_linenumber <= 2")}
UNION ALL {_COUNTED.format(name="credit_card_balance", rows="odd WHERE l_linenumber BETWEEN 3 AND 4")}
UNION ALL {_COUNTED.format(name="installments_payments", rows="odd WHERE l_linenumber > 4")}"""

ORACLES: dict[str, str] = {
    "asof_last_order": f"""WITH {REORDER},
ranked AS (SELECT t.c_custkey, t.seed_time, o.*, row_number() OVER (PARTITION BY t.c_custkey, t.seed_time
    ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS r
  FROM task t LEFT JOIN orders o ON o.o_custkey = t.c_custkey AND o.o_orderdate <= t.seed_time)
SELECT c_custkey, seed_time, o_orderkey AS last__o_orderkey, o_orderstatus AS last__o_orderstatus,
  round(o_totalprice, 6) AS last__o_totalprice, o_orderdate AS last__o_orderdate, o_orderpriority AS last__o_orderpriority
FROM ranked WHERE r = 1""",
    "asof_tie_break": f"""WITH {PURCHASE},
ranked AS (SELECT t.c_custkey, t.seed_time, e.event_id, e.event_type, row_number() OVER (
    PARTITION BY t.c_custkey, t.seed_time ORDER BY date_trunc('day', e.ts) DESC, e.event_id DESC) AS r
  FROM task t LEFT JOIN events e ON e.user_id = t.c_custkey AND date_trunc('day', e.ts) <= t.seed_time)
SELECT c_custkey, seed_time, event_id AS last__event_id, event_type AS last__event_type FROM ranked WHERE r = 1""",
    "static_lookup_nation": f"SELECT c.c_custkey, c.c_nationkey, {NATION} FROM customer c "
    "LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey",
    "duplicate_line_keys": """SELECT l_orderkey || '-' || l_linenumber AS line_key, count(*) AS n_rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "parent_lookup_2hop": f"""WITH {REORDER}
SELECT t.c_custkey, t.seed_time, t.label, {CUSTOMER}, {NATION}, r.r_name AS region__r_name
FROM task t {ORDER_KEYED} LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""",
    "seed_child_range_counts": f"WITH {REORDER} "
    + tagg_orders(180, count_and_recency("orders", "o_orderkey", "o_orderdate", "o")),
    "tagg_orders_w30": f"WITH {REORDER} {tagg_orders(30)}",
    "tagg_orders_all": f"WITH {REORDER} {tagg_orders(None)}",
    "tagg_orders_selected": f"WITH {REORDER} "
    + tagg_orders(
        90,
        "count(o.o_orderkey) AS orders__row_count, "
        + numeric("orders", "o_orderkey", "o", "max")
        + ", "
        + numeric("orders", "o_totalprice", "o", "max"),
    ),
    "tagg_events_w7": f"""WITH {PURCHASE}
SELECT t.c_custkey, t.seed_time, {days_column(7)}, {EVENT_FEATURES}
FROM task t LEFT JOIN events e ON e.user_id = t.c_custkey AND e.ts <= t.seed_time
  AND e.ts >= t.seed_time - INTERVAL 7 DAY
GROUP BY t.c_custkey, t.seed_time""",
    "tagg_lines_by_order": f"""WITH {ORDER_LINES}
SELECT t.o_orderkey, t.seed_time, {days_column(None)},
  {count_and_recency("lineitem", "l_orderkey", "l_shipdate", "l")},
  {numeric("lineitem", "l_quantity", "l")}, {numeric("lineitem", "l_extendedprice", "l")},
  {numeric("lineitem", "l_discount", "l")}, {numeric("lineitem", "l_tax", "l")},
  {numeric("lineitem", "l_partkey", "l")}, {numeric("lineitem", "l_suppkey", "l")},
  {numeric("lineitem", "l_linenumber", "l")}, {numeric("lineitem", "line_id", "l")},
  {nunique("lineitem", "l_returnflag", "l")}, {nunique("lineitem", "l_linestatus", "l")}
FROM task t LEFT JOIN (SELECT *, row_number() OVER () - 1 AS line_id FROM lineitem) l
  ON l.l_orderkey = t.o_orderkey AND l.l_shipdate <= t.seed_time
GROUP BY t.o_orderkey, t.seed_time""",
    "tagg_moved_task": f"WITH {REORDER.replace('AS TIMESTAMP) AS', 'AS TIMESTAMP) - INTERVAL 500 DAY AS', 1)} "
    + tagg_orders(30)
    + " UNION ALL "
    + tagg_orders(None),
    "tagg_null_time_keep": tagg_partly_dated(True),
    "tagg_null_time_drop": tagg_partly_dated(False),
    "tagg_static_child": f"""WITH {GRID}, task AS (SELECT n_nationkey, seed_time FROM nation CROSS JOIN grid)
SELECT t.n_nationkey, t.seed_time, {days_column(None)}, count(c.c_custkey) AS customer__row_count,
  {numeric("customer", "c_custkey", "c")}, {numeric("customer", "c_acctbal", "c")},
  {nunique("customer", "c_name", "c")}, {nunique("customer", "c_mktsegment", "c")}
FROM task t LEFT JOIN customer c ON c.c_nationkey = t.n_nationkey GROUP BY t.n_nationkey, t.seed_time""",
    "tagg_sweep_7_30_90_all": f"WITH {REORDER} " + " UNION ALL ".join(tagg_orders(w) for w in (7, 30, 90, None)),
    "entity_view": f"WITH {REORDER} SELECT t.c_custkey, t.seed_time, t.label, {CUSTOMER}, {NATION} "
    f"FROM task t {ORDER_KEYED}",
    "entity_view_dated": f"""WITH {ORDER_LINES}
SELECT t.o_orderkey, t.seed_time, t.label, o.o_custkey AS orders__o_custkey, o.o_orderstatus AS orders__o_orderstatus,
  round(o.o_totalprice, 6) AS orders__o_totalprice, o.o_orderpriority AS orders__o_orderpriority, {CUSTOMER}
FROM task t JOIN orders o ON o.o_orderkey = t.o_orderkey LEFT JOIN customer c ON c.c_custkey = o.o_custkey""",
    "temporal_view": temporal_view(30),
    "view_inspection": temporal_view(90, "'test' AS split,", "WHERE t.seed_time >= TIMESTAMP '2000-01-01'"),
    "degree_temporal": f"""WITH {REORDER}
SELECT t.c_custkey, t.seed_time, t.label, count(o.o_orderkey) AS graphdeg__orders__count_leq_seed
FROM task t LEFT JOIN orders o ON o.o_custkey = t.c_custkey AND o.o_orderdate <= t.seed_time
GROUP BY t.c_custkey, t.seed_time, t.label""",
    "degree_static": f"WITH {NATION_TASK} SELECT t.*, {', '.join(NATION_COUNTS.values())} FROM task t",
    "degree_capped": f"WITH {NATION_TASK} SELECT t.*, {NATION_COUNTS['customer']}, {NATION_COUNTS['orders']} FROM task t",
    "neighbors_k5_nodes": f"""WITH {REORDER},
recent AS (SELECT t.c_custkey, t.seed_time, o.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderdate,
    row_number() OVER (PARTITION BY t.c_custkey, t.seed_time ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS r
  FROM task t JOIN orders o ON o.o_custkey = t.c_custkey AND o.o_orderdate <= t.seed_time)
SELECT t.c_custkey, t.seed_time, 'customer' AS node_type, CAST(0 AS BIGINT) AS node_idx,
  round(CAST(CAST(c.c_custkey AS FLOAT) AS DOUBLE), 6) AS f0, round(CAST(CAST(c.c_nationkey AS FLOAT) AS DOUBLE), 6) AS f1,
  round(CAST(CAST(c.c_acctbal AS FLOAT) AS DOUBLE), 6) AS f2, CAST(3 AS BIGINT) AS n_features
FROM task t JOIN customer c ON c.c_custkey = t.c_custkey
UNION ALL
SELECT c_custkey, seed_time, 'orders', row_number() OVER (PARTITION BY c_custkey, seed_time ORDER BY o_orderdate, o_orderkey) - 1,
  round(CAST(CAST(o_orderkey AS FLOAT) AS DOUBLE), 6), round(CAST(CAST(o_custkey AS FLOAT) AS DOUBLE), 6),
  round(CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE), 6), 3
FROM recent WHERE r <= 5""",
    "neighbors_all": f"""WITH {REORDER}
SELECT t.c_custkey, t.seed_time, 'orders' AS node_type,
  row_number() OVER (PARTITION BY t.c_custkey, t.seed_time ORDER BY o.o_orderdate, o.o_orderkey) - 1 AS node_idx,
  round(CAST(CAST(o.o_orderkey AS FLOAT) AS DOUBLE), 6) AS f0, round(CAST(CAST(o.o_custkey AS FLOAT) AS DOUBLE), 6) AS f1,
  round(CAST(CAST(o.o_totalprice AS FLOAT) AS DOUBLE), 6) AS f2, CAST(3 AS BIGINT) AS n_features
FROM task t JOIN orders o ON o.o_custkey = t.c_custkey AND o.o_orderdate <= t.seed_time""",
    "neighbors_static_k3": static_nodes("WHERE node_idx < 3"),
    "neighbors_static_all": static_nodes(""),
    "neighbors_dated_entity": f"""WITH {ORDER_LINES}
SELECT t.o_orderkey, t.seed_time, 'orders' AS node_type, CAST(0 AS BIGINT) AS node_idx,
  round(CAST(CAST(o.o_orderkey AS FLOAT) AS DOUBLE), 6) AS f0, round(CAST(CAST(o.o_custkey AS FLOAT) AS DOUBLE), 6) AS f1,
  round(CAST(CAST(o.o_totalprice AS FLOAT) AS DOUBLE), 6) AS f2, CAST(3 AS BIGINT) AS n_features
FROM task t JOIN orders o ON o.o_orderkey = t.o_orderkey""",
    "edge_type_counts": f"""WITH {PURCHASE},
linked AS (SELECT t.c_custkey, t.seed_time, least(count(*), 3) AS n FROM task t
  JOIN events e ON e.user_id = t.c_custkey AND e.ts <= t.seed_time GROUP BY t.c_custkey, t.seed_time)
SELECT 'customer' AS src_type, 'has_events' AS relation, 'events' AS dst_type, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_edges FROM linked
UNION ALL SELECT 'events', 'in_customer', 'customer', CAST(coalesce(sum(n), 0) AS BIGINT) FROM linked""",
    "neighbors_k5_edges": f"""WITH {PURCHASE},
linked AS (SELECT t.c_custkey, t.seed_time, least(count(*), 5) AS n FROM task t
  JOIN events e ON e.user_id = t.c_custkey AND e.ts <= t.seed_time GROUP BY t.c_custkey, t.seed_time),
nodes AS (SELECT c_custkey, seed_time, unnest(range(n)) AS i FROM linked)
SELECT c_custkey, seed_time, 'customer' AS src_type, CAST(0 AS BIGINT) AS src_idx, 'has_events' AS relation,
  'events' AS dst_type, i AS dst_idx FROM nodes
UNION ALL SELECT c_custkey, seed_time, 'events', i, 'in_customer', 'customer', 0 FROM nodes""",
    "entity_date_spread": f"WITH {DATES} SELECT c_custkey, customer_date FROM dates",
    "relative_day_date": relative("o.o_orderkey % 977 + 0.75", 1, 11),
    "relative_month_date": relative("o.o_orderkey % 37 + 0.5", 30, 13),
    "dense_customer_ids": SORTED_IDS,
    "dense_name_ids": "SELECT c_name AS old_id, row_number() OVER (ORDER BY c_name) - 1 AS new_id "
    "FROM (SELECT DISTINCT c_name FROM customer)",
    "remapped_orders": f"""WITH ids AS ({SORTED_IDS} WHERE c_acctbal > 0)
SELECT o.o_orderkey, i.new_id AS o_custkey FROM orders o LEFT JOIN ids i ON i.old_id = o.o_custkey""",
    "rekeyed_database": """WITH
r AS (SELECT r_regionkey AS k, row_number() OVER (ORDER BY r_regionkey) - 1 AS i FROM region),
n AS (SELECT n_nationkey AS k, n_regionkey AS p, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation),
c AS (SELECT c_custkey AS k, c_nationkey AS p, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer),
o AS (SELECT o_orderkey AS k, o_custkey AS p, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT 'region' AS table_name, count(*) AS n_rows, min(i) AS first_id, max(i) AS last_id, CAST(NULL AS BIGINT) AS parent_id_sum FROM r
UNION ALL SELECT 'nation', count(*), min(n.i), max(n.i), CAST(sum(r.i) AS BIGINT) FROM n LEFT JOIN r ON r.k = n.p
UNION ALL SELECT 'customer', count(*), min(c.i), max(c.i), CAST(sum(n.i) AS BIGINT) FROM c LEFT JOIN n ON n.k = c.p
UNION ALL SELECT 'orders', count(*), min(o.i), max(o.i), CAST(sum(c.i) AS BIGINT) FROM o LEFT JOIN c ON c.k = o.p""",
    "line_row_ids": "SELECT row_number() OVER () - 1 AS line_id, l_orderkey, l_partkey, l_linenumber FROM lineitem",
    "split_70_15_15": f"""WITH {ORDERED.format(c="o_orderdate", t="orders")},
cut AS (SELECT max(CASE WHEN i = floor(0.7::DOUBLE * n) THEN v END) AS a,
  max(CASE WHEN i = floor(0.85::DOUBLE * n) THEN v END) AS b FROM ordered)
SELECT o_orderkey, o_orderdate, CASE WHEN o_orderdate < a THEN 'train' WHEN o_orderdate < b THEN 'val' ELSE 'test' END AS split
FROM orders CROSS JOIN cut""",
    "split_cutoffs": f"""WITH {ORDERED.format(c="l_shipdate", t="lineitem")}
SELECT max(CASE WHEN i = floor(0.7::DOUBLE * n) THEN v END) AS val_cutoff,
  max(CASE WHEN i = floor(0.85::DOUBLE * n) THEN v END) AS test_cutoff FROM ordered""",
    "split_fixed": f"WITH {REORDER} SELECT t.*, {SPLIT} AS split FROM task t",
    "split_ordered": f"WITH {REORDER} SELECT t.*, {SPLIT} AS split FROM task t",
    "split_indexed": f"""WITH {LINE_IDS}
SELECT row_id, CAST(l_returnflag = 'R' AS INTEGER) AS label,
  CASE WHEN row_id % 10 < 6 THEN 'train' WHEN row_id % 10 < 8 THEN 'val' ELSE 'test' END AS split,
  round(CAST(CAST(l_quantity AS FLOAT) AS DOUBLE), 2) AS l_quantity,
  round(CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE), 2) AS l_extendedprice,
  CAST(l_linestatus = 'O' AS DOUBLE) AS is_open, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
  CAST(l_partkey AS DOUBLE) AS l_partkey, CAST(l_suppkey AS DOUBLE) AS l_suppkey
FROM lines""",
    "split_from_block_files": f"""WITH {LINE_IDS}
SELECT row_id, CAST(l_returnflag = 'R' AS INTEGER) AS label,
  CASE WHEN row_id % 10 < 6 THEN 'train' WHEN row_id % 10 < 8 THEN 'val' ELSE 'test' END AS split,
  round(CAST(CAST(l_quantity AS FLOAT) AS DOUBLE), 2) AS l_quantity,
  round(CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE), 2) AS l_extendedprice,
  CAST(l_linestatus = 'O' AS DOUBLE) AS is_open, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
  CAST(l_partkey AS DOUBLE) AS l_partkey, CAST(l_suppkey AS DOUBLE) AS l_suppkey
FROM lines""",
    "available_splits": f"""WITH {LINE_IDS}
SELECT DISTINCT unnest(['by_row', 'by_order']) AS split_name FROM lines""",
    "split_summary": f"""WITH {REORDER}, s AS (SELECT {SPLIT} AS split, t.label FROM task t)
SELECT split, count(*) AS n_rows, round(avg(label), 6) AS positive_rate FROM s GROUP BY split""",
    "future_signal": f"""WITH {REORDER}
SELECT t.*, epoch_us(t.seed_time + INTERVAL 7 DAY) * 1000 AS future_leak_signal FROM task t""",
    "leakage_audit": f"""WITH {GRID}
SELECT count(*) AS n_instances, CAST(0 AS BIGINT) AS n_changed FROM customer CROSS JOIN grid
WHERE seed_time <= TIMESTAMP '1998-07-01'""",
    "leakage_by_seed": f"""WITH {REORDER}
SELECT seed_time AS seed, count(*) AS n_instances, CAST(0 AS BIGINT) AS n_changed FROM task GROUP BY seed_time""",
    "leakage_asof_rows": f"""WITH {REORDER} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_after_seed FROM task""",
    "relational_summary": f"""WITH {REORDER}, s AS (SELECT {SPLIT} AS split FROM task t)
{SUMMARY.format(t="customer", n=5, pk="c_custkey", time="", fk="c_nationkey->nation")}
UNION ALL {SUMMARY.format(t="nation", n=3, pk="n_nationkey", time="", fk="n_regionkey->region")}
UNION ALL {SUMMARY.format(t="region", n=2, pk="r_regionkey", time="", fk="")}
UNION ALL {SUMMARY.format(t="orders", n=6, pk="o_orderkey", time="o_orderdate", fk="o_custkey->customer")}
UNION ALL SELECT 'split', split, count(*), 3, 'c_custkey', 'seed_time', 'c_custkey->customer' FROM s GROUP BY split""",
    "impute_median": MEDIANS,
    "scale_population": " UNION ALL ".join(
        f"SELECT '{c}' AS c, round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 6) "
        f"AS std FROM {TRAIN_LINES}"
        for c in MEASURED
    ),
    "impute_mode": mode("o_orderstatus") + " UNION ALL " + mode("o_orderpriority"),
    "one_hot_counts": """WITH codes AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code
  FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority > '1-URGENT'))
SELECT o.o_orderpriority, c.code AS o_orderpriority__code, count(*) AS n_rows
FROM orders o LEFT JOIN codes c ON c.o_orderpriority = o.o_orderpriority GROUP BY o.o_orderpriority, c.code""",
    "assembled_entries": """WITH train AS (SELECT * FROM customer WHERE c_nationkey <> 3),
scale AS (SELECT avg(c_custkey) AS mk, stddev_pop(c_custkey) AS sk, avg(c_nationkey) AS mn, stddev_pop(c_nationkey) AS sn FROM train),
names AS (SELECT c_name, row_number() OVER (ORDER BY c_name) + 1 AS position FROM (SELECT DISTINCT c_name FROM train)),
segments AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) + 1 + (SELECT count(*) FROM names) AS position
  FROM (SELECT DISTINCT c_mktsegment FROM train))
SELECT c_custkey, 0 AS position, round((c_custkey - mk) / sk, 6) AS value FROM customer, scale
UNION ALL SELECT c_custkey, 1, round((c_nationkey - mn) / sn, 6) FROM customer, scale
UNION ALL SELECT c_custkey, position, 1.0 FROM customer JOIN names USING (c_name)
UNION ALL SELECT c_custkey, position, 1.0 FROM customer JOIN segments USING (c_mktsegment)""",
    "impute_nonfinite": """WITH r AS (SELECT l_linestatus, l_shipdate,
  CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS ratio FROM lineitem),
m AS (SELECT median(ratio) AS fill FROM r WHERE l_shipdate < TIMESTAMP '2000-01-01')
SELECT l_linestatus, count(*) AS n_rows, round(sum(coalesce(ratio, fill)), 6) AS ratio_sum,
  round(max(coalesce(ratio, fill)), 6) AS ratio_max FROM r CROSS JOIN m GROUP BY l_linestatus""",
    "row_cap_sample": """SELECT o_orderkey, o_totalprice FROM orders
ORDER BY substr(md5('7|' || o_orderkey), 1, 15), o_orderkey LIMIT 1000""",
    "class_weight": f"""WITH {REORDER} SELECT CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg,
  round(sum(1 - label) / sum(label)::DOUBLE, 6) AS pos_weight FROM task""",
    "auroc_exact": f"WITH {SCORED} {auroc_rows('scored', 'row_count', 'lookback_days')}",
    "auroc_one_class": f"""WITH {SCORED},
kept AS (SELECT * FROM scored WHERE label = 1 OR c_mktsegment = 'BUILDING')
{auroc_rows('kept', 'row_count', 'c_mktsegment')}""",
    "auroc_missing": f"""WITH {SCORED}
SELECT lookback_days, CAST(coalesce(sum(label) FILTER (row_count > 0), 0) AS BIGINT) AS n_pos,
  CAST(coalesce(sum(1 - label) FILTER (row_count > 0), 0) AS BIGINT) AS n_neg,
  count(*) FILTER (row_count = 0) AS n_missing, CAST(NULL AS DOUBLE) AS auroc
FROM scored WHERE lookback_days IS NOT NULL GROUP BY lookback_days""",
    "mae": f"""WITH {ERRORS} SELECT seed_time, count(*) AS n, CAST(0 AS BIGINT) AS n_missing, round(avg(abs(label - prediction)), 6) AS mae
FROM errors GROUP BY seed_time""",
    "utility": f"""WITH {ERRORS}, e AS (SELECT strftime(seed_time, '%Y-%m-%d %H:%M:%S') AS run, 'mae' AS metric_name,
  avg(abs(label - prediction)) AS metric_value FROM errors GROUP BY seed_time)
SELECT run, metric_name, round(metric_value, 6) AS metric_value, round(-ln(greatest(metric_value, 1e-12)), 6) AS utility FROM e
UNION ALL SELECT * FROM (WITH {RUNS} SELECT task_name || '|' || representation || '|' || model_name, metric_name,
  round(metric_value, 6), round(metric_value, 6) FROM runs)""",
    "best_per_representation": f"""WITH {RUNS}
SELECT task_name, metric_name, representation, round(metric_value, 6) AS metric_value FROM best""",
    "normalized_utilities": f"""WITH {RUNS} SELECT task_name, metric_name, representation,
  round(metric_value, 6) AS metric_value, round(utility, 6) AS utility FROM utilities""",
    "ris_by_task": f"""WITH {RUNS} SELECT task_name, n_representations, round(ris, 6) AS ris,
  round(utility_std, 6) AS utility_std, round(utility_min, 6) AS utility_min, round(utility_max, 6) AS utility_max,
  round(utility_gap, 6) AS utility_gap FROM ris""",
    "macro_ris": f"""WITH {RUNS} SELECT round(avg(ris), 6) AS macro_ris, round(stddev_pop(ris), 6) AS macro_ris_std,
  count(*) AS n_tasks FROM ris""",
    "metric_override": f"""WITH {RUNS} SELECT task_name, representation, model_name,
  CASE WHEN model_name = 'total' THEN 0.77::DOUBLE WHEN task_name = 'BUILDING' THEN 0.66::DOUBLE
    WHEN representation = 'window=all' THEN 0.55::DOUBLE ELSE round(metric_value, 6) END AS metric_value FROM runs""",
    "constant_baseline": f"""WITH {SPEND},
m AS (SELECT avg(label) AS prediction FROM task WHERE seed_time < TIMESTAMP '1999-01-01')
SELECT c_custkey, seed_time, round(label, 6) AS label, round(prediction, 6) AS prediction
FROM task CROSS JOIN m WHERE seed_time >= TIMESTAMP '2000-01-01'""",
    "sweep_json_collect": f"""WITH {SWEEP_RESULTS} SELECT task, split, seed, n_features, n_train, n_val, n_test,
  round(val_auroc, 6) AS val_auroc, round(test_auroc, 6) AS test_auroc FROM results""",
    "sweep_mean_std": f"""WITH {SWEEP_RESULTS} SELECT split, count(*) AS n_runs, round(avg(test_auroc), 6) AS mean_test,
  round(coalesce(stddev_samp(test_auroc), 0), 6) AS std_test FROM results GROUP BY split""",
    "csv_task": f"""WITH {CSV_TASK},
cut AS (SELECT max(CASE WHEN i = floor(0.7::DOUBLE * n) THEN customer_date END) AS a,
  max(CASE WHEN i = floor(0.85::DOUBLE * n) THEN customer_date END) AS b FROM csv_dates)
SELECT c_custkey, customer_date, rich, CASE WHEN customer_date < a THEN 'train' WHEN customer_date < b THEN 'val'
  ELSE 'test' END AS split FROM csv_dates CROSS JOIN cut""",
    "csv_child_dates": f"""WITH {CSV_TASK}
SELECT o.o_orderkey, o.o_custkey AS c_custkey, CASE WHEN o.o_orderkey % 11 <> 0
  THEN d.customer_date - to_days(CAST(o.o_orderkey % 977 AS INTEGER)) END AS event_date
FROM orders o LEFT JOIN csv_dates d ON d.c_custkey = o.o_custkey""",
    "csv_credit_view": CREDIT_VIEW,
    "csv_bad_rows": CREDIT_BAD,
    "csv_row_ids": """SELECT l_orderkey AS SK_ID_BUREAU, -l_linenumber AS MONTHS_BALANCE, l_linestatus AS STATUS,
  row_number() OVER (ORDER BY l_orderkey, -l_linenumber, l_linestatus) - 1 AS _bb_row_id FROM lineitem WHERE l_orderkey % 2 = 0""",
    "exported_tasks": f"""WITH {REORDER}, ids AS ({SORTED_IDS})
SELECT i.new_id AS c_custkey, t.seed_time, t.label, {SPLIT} AS split FROM task t JOIN ids i ON i.old_id = t.c_custkey""",
    "gbt_scores": f"""WITH {REORDER} SELECT c_custkey, seed_time, label, true AS is_probability FROM task
WHERE seed_time >= TIMESTAMP '2000-01-01'""",
    "protocol_a_columns": f"""WITH {COLUMN_RUNS}
SELECT 'customer_reorder' AS task_name, model_name, view_name, 'test' AS split_name, 'auroc' AS metric_name,
  round(auroc, 6) AS metric_value, representation, false AS is_baseline, round(auroc, 6) AS utility_value FROM runs""",
    "protocol_b_columns": f"""WITH {COLUMN_RUNS_B}
SELECT 'customer_reorder' AS task_name, model_name, view_name, 'test' AS split_name, 'auroc' AS metric_name,
  round(auroc, 6) AS metric_value, representation, false AS is_baseline, round(auroc, 6) AS utility_value FROM runs""",
    "sigmoid_scores": "SELECT c_custkey, round(1 / (1 + exp(1 - c_acctbal / 1000.0::DOUBLE)), 6) AS probability FROM customer",
    "summary_json": """SELECT 'customer' AS table_name, count(*) AS n_rows, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns,
  'c_custkey' AS primary_key, CAST(NULL AS VARCHAR) AS time_col, 'c_nationkey->nation' AS foreign_keys, true AS is_entity FROM customer
UNION ALL SELECT 'nation', count(*), 'n_nationkey,n_name,n_regionkey', 'n_nationkey', NULL, 'n_regionkey->region', false FROM nation
UNION ALL SELECT 'region', count(*), 'r_regionkey,r_name', 'r_regionkey', NULL, '', false FROM region
UNION ALL SELECT 'orders', count(*), 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority',
  'o_orderkey', 'o_orderdate', 'o_custkey->customer', false FROM orders""",
    "preview_rows": f"""WITH {REORDER}, s AS (SELECT {SPLIT} AS split FROM task t)
SELECT split, least(count(*), 100) AS n_rows, CAST(0 AS BIGINT) AS n_unlabelled FROM s GROUP BY split
UNION ALL SELECT 'all', least(count(*), 100), 0 FROM s""",
    "block_summary": """SELECT CASE WHEN l_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n_rows,
  round(avg(CAST(l_returnflag = 'R' AS INTEGER)), 6) AS positive_rate, CAST(6 AS BIGINT) AS n_features
FROM lineitem GROUP BY 1""",
    "protocol_a_scores": f"""WITH {COLUMN_RUNS}, ends AS (SELECT max(auroc) AS top FROM runs),
utilities AS (SELECT CASE WHEN abs(top - 0.5) < 1e-12 THEN 0.0 ELSE (auroc - 0.5) / (top - 0.5) END AS u FROM runs, ends)
SELECT 'customer_reorder' AS task_name, (SELECT count(*) FROM runs) AS n_representations,
  round((SELECT 1 - stddev_pop(u) FROM utilities), 6) AS ris, representation, round(auroc, 6) AS score FROM runs""",
    "plugin_scores": f"""WITH {REORDER}, agg AS ({tagg_orders(90, "count(o.o_orderkey) AS orders__row_count")})
SELECT c_custkey, seed_time, orders__row_count, round(orders__row_count / (1.0 + orders__row_count)::DOUBLE, 6) AS prediction FROM agg""",
}
