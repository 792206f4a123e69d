"""Independent SQL statements of every registered query, for DuckDB.

The driver's tables (`customer`, `orders`, ...) are views in the checking
database; `BASE` repeats the fixture mapping of `sources.adapter` in SQL so
each statement starts from the same five tables.  Rounded means are computed
with integer arithmetic, floor((2*sum + n) / (2*n)), i.e. HALF_UP on the
exact quotient, so the check does not depend on either engine's decimal or
floating-point rounding.
"""

from __future__ import annotations

MAPPING = """
WITH
app_downloads AS (
  SELECT 'dl-' || CAST(c_custkey AS VARCHAR) AS app_download_key,
         CASE WHEN c_custkey * 37 % 101 % 10 < 3 THEN 'android'
              WHEN c_custkey * 37 % 101 % 10 < 9 THEN 'ios'
              ELSE 'web' END AS platform,
         TIMESTAMP '1994-01-01 00:00:00' + INTERVAL '1' DAY * (c_custkey % 180) AS download_ts
  FROM customer
),
signups AS (
  SELECT CAST(c_custkey AS BIGINT) AS user_id,
         'dl-' || CAST(c_custkey AS VARCHAR) AS session_id,
         TIMESTAMP '1994-01-01 00:00:00' + INTERVAL '1' DAY * (c_custkey % 180 + c_custkey % 7) AS signup_ts,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '18-24' WHEN 'BUILDING' THEN '25-34'
                           WHEN 'FURNITURE' THEN '35-44' WHEN 'HOUSEHOLD' THEN '45-54'
                           ELSE 'Unknown' END AS age_range
  FROM customer
  WHERE c_custkey * 53 % 103 % 4 <> 3
),
ride_orders AS (
  SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice,
         CASE WHEN o_custkey * 59 % 107 % 10 < 7 THEN o_custkey
              WHEN (o_custkey + 1) * 59 % 107 % 10 < 7 THEN o_custkey + 1
              WHEN (o_custkey + 2) * 59 % 107 % 10 < 7 THEN o_custkey + 2
              ELSE o_custkey + 3 END AS rider
  FROM orders
),
ride_base AS (
  SELECT CAST(o_orderkey AS BIGINT) AS ride_id,
         CAST(rider AS BIGINT) AS user_id,
         CAST(1 + (o_orderkey * 7 + o_custkey) % 997 AS BIGINT) AS driver_id,
         CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' HOUR * (
           CASE WHEN o_orderkey % 5 < 2 THEN 8 + o_orderkey % 3
                WHEN o_orderkey % 5 = 2 THEN 16 + o_orderkey % 4
                ELSE o_orderkey * 7 % 24 END) AS request_ts,
         (o_orderkey * 73 % 137 % 10 < 2 OR rider * 61 % 109 % 2 = 0) AS cancelled,
         o_totalprice
  FROM ride_orders
),
ride_requests AS (
  SELECT ride_id, user_id, driver_id, request_ts,
         CASE WHEN NOT cancelled THEN request_ts + INTERVAL '1' MINUTE * (5 + ride_id % 60) END AS dropoff_ts,
         CASE WHEN cancelled THEN request_ts + INTERVAL '1' MINUTE * (1 + ride_id % 9) END AS cancel_ts
  FROM ride_base
),
transactions AS (
  SELECT ride_id, CAST(o_totalprice AS DOUBLE) AS purchase_amount_usd,
         CASE WHEN ride_id * 71 % 131 % 20 = 0 THEN 'Decline' ELSE 'Approved' END AS charge_status
  FROM ride_base WHERE NOT cancelled
),
reviews AS (
  SELECT 1000000 + ride_id AS review_id, ride_id, user_id,
         CAST(1 + ride_id * 13 % 113 % 5 AS INTEGER) AS rating
  FROM ride_base WHERE NOT cancelled AND ride_id * 67 % 127 % 10 < 7
)
"""

# Derived dimensions every statement may use (after the five tables).
DIMENSIONS = """
user_dim AS (
  SELECT s.user_id, s.signup_ts, s.age_range, d.platform
  FROM signups s LEFT JOIN app_downloads d ON d.app_download_key = s.session_id
),
rider_dim AS (
  SELECT DISTINCT q.user_id, u.age_range, u.platform
  FROM ride_requests q LEFT JOIN user_dim u ON u.user_id = q.user_id
)
"""

# The mapping from the driver's tables followed by the dimensions.
BASE = MAPPING.rstrip() + ",\n" + DIMENSIONS.strip() + "\n"


def _half_up(total: str, n: str) -> str:
    """round(total / n, 2) HALF_UP as DOUBLE; total and n are integers."""
    return (f"CAST((200 * CAST({total} AS HUGEINT) + {n}) // NULLIF(2 * {n}, 0) AS DOUBLE) / 100")


def _double(c: str) -> str:
    """The DOUBLE nearest to a DECIMAL (through its text, so large sums keep
    their last digits)."""
    return f"CAST(CAST({c} AS VARCHAR) AS DOUBLE)"


def _usd(c: str) -> str:
    return f"CAST({c} AS DECIMAL(28,8))"


def _funnel_steps(age: bool, daily: bool, per_user: bool) -> str:
    """The four UNIONed step branches at one grain."""
    a = "age_range, " if age else ""
    s_a = "s.age_range, " if age else ""
    null_age = "CAST(NULL AS VARCHAR) AS age_range, " if age else ""

    def day(expr: str) -> str:
        return f", CAST({expr} AS DATE) AS daily_date" if daily else ""

    def gday(expr: str) -> str:
        return f", CAST({expr} AS DATE)" if daily else ""

    nulls = ("CAST(NULL AS BIGINT) AS total_usd, CAST(NULL AS BIGINT) AS rides, "
             "CAST(NULL AS BIGINT) AS cancellations, CAST(NULL AS BIGINT) AS total_reviews, "
             "CAST(NULL AS DOUBLE) AS avg_rating")
    if per_user:
        step1 = (f"SELECT 1 AS funnel_step, 'downloads' AS funnel_name, app_download_key AS user_ids, "
                 f"platform, {null_age}{nulls}{day('download_ts')} FROM app_downloads")
        step2 = (f"SELECT 2, 'signups', CAST(user_id AS VARCHAR), platform, {a}{nulls}{day('signup_ts')} "
                 f"FROM user_dim")
        step3_id, step3_grp = "CAST(x.user_id AS VARCHAR)", ", x.user_id"
        step4_id, step4_grp = "CAST(q.user_id AS VARCHAR)", ", q.user_id"
    else:
        if daily:
            step1 = (f"SELECT 1 AS funnel_step, 'downloads' AS funnel_name, COUNT(app_download_key) AS users, "
                     f"platform, {null_age}{nulls}{day('download_ts')} FROM app_downloads "
                     f"GROUP BY platform{gday('download_ts')}")
        else:
            filler_age = "age_range" if age else ""
            step1 = (f"SELECT 1 AS funnel_step, 'downloads' AS funnel_name, COUNT(DISTINCT app_download_key) AS users, "
                     f"platform, {null_age}{nulls} FROM app_downloads GROUP BY platform "
                     f"UNION SELECT 1, 'downloads', CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), "
                     f"{filler_age + ', ' if age else ''}{nulls} FROM signups")
        step2 = (f"SELECT 2, 'signups', COUNT(DISTINCT user_id), platform, {a}{nulls}{day('signup_ts')} "
                 f"FROM user_dim GROUP BY {a}platform{gday('signup_ts')}")
        step3_id, step3_grp = "COUNT(DISTINCT x.user_id)", ""
        step4_id, step4_grp = "COUNT(DISTINCT q.user_id)", ""
    step3 = (f"SELECT 3, 'rides_requested', {step3_id}, x.platform, {s_a}"
             f"CAST(NULL AS BIGINT), COUNT(q.ride_id), COUNT(q.cancel_ts), CAST(NULL AS BIGINT), "
             f"CAST(NULL AS DOUBLE){day('q.request_ts')} "
             f"FROM signups s LEFT JOIN rider_dim x ON x.user_id = s.user_id "
             f"LEFT JOIN ride_requests q ON q.user_id = s.user_id "
             f"GROUP BY {s_a}x.platform{gday('q.request_ts')}{step3_grp}")
    step4 = (f"SELECT 4, 'rides_completed', {step4_id}, x.platform, {s_a}"
             f"CAST(ROUND(SUM({_usd('t.purchase_amount_usd')}), 0) AS BIGINT), "
             f"COUNT(q.ride_id), COUNT(q.cancel_ts), COUNT(DISTINCT v.review_id), AVG(v.rating)"
             f"{day('q.dropoff_ts')} "
             f"FROM signups s JOIN ride_requests q ON q.user_id = s.user_id "
             f"LEFT JOIN rider_dim x ON x.user_id = s.user_id "
             f"LEFT JOIN transactions t ON t.ride_id = q.ride_id "
             f"LEFT JOIN reviews v ON v.ride_id = q.ride_id "
             f"WHERE q.dropoff_ts IS NOT NULL AND t.charge_status = 'Approved' "
             f"GROUP BY {s_a}x.platform{gday('q.dropoff_ts')}{step4_grp}")
    return f"{step1}\nUNION {step2}\nUNION {step3}\nUNION {step4}"


def _conversion(segment: str) -> str:
    return (f"SELECT *, LAG(users) OVER w AS previous_users, "
            f"CAST(users AS DOUBLE) / LAG(NULLIF(users, 0)) OVER w AS pct_previous_value, "
            f"CAST(users AS DOUBLE) / FIRST_VALUE(NULLIF(users, 0)) OVER w AS pct_from_top "
            f"FROM steps WINDOW w AS (PARTITION BY {segment} ORDER BY funnel_step)")


def _decline_sql(key: str, other: str, other_name: str) -> str:
    dec = "t.charge_status = 'Decline'"
    return f"""
SELECT q.{key}, COUNT(DISTINCT q.{other}) AS {other_name},
       COUNT(DISTINCT q.ride_id) AS unique_rides,
       CAST(SUM(CASE WHEN {dec} THEN 1 ELSE 0 END) AS BIGINT) AS decline_count,
       {_half_up(f"SUM(CASE WHEN {dec} THEN v.rating END)", f"COUNT(CASE WHEN {dec} THEN v.rating END)")} AS avg_rating,
       {_double(f"SUM(CASE WHEN {dec} THEN {_usd('t.purchase_amount_usd')} ELSE 0 END)")} AS lost_total_usd,
       {_double(f"SUM(CASE WHEN t.charge_status = 'Approved' THEN {_usd('t.purchase_amount_usd')} ELSE 0 END)")} AS gained_total_usd
FROM ride_requests q
LEFT JOIN transactions t ON t.ride_id = q.ride_id
LEFT JOIN reviews v ON v.ride_id = q.ride_id
GROUP BY q.{key}
HAVING SUM(CASE WHEN {dec} THEN 1 ELSE 0 END) > 1"""


_DRIVER_CELLS = """
  SELECT q.driver_id, u.age_range, u.platform,
         COUNT(DISTINCT q.user_id) AS users, COUNT(DISTINCT q.ride_id) AS rides,
         COUNT(q.dropoff_ts) AS rides_completed, COUNT(q.cancel_ts) AS rides_canceled,
         COUNT(v.review_id) AS reviews,
         (200 * CAST(SUM(v.rating) AS HUGEINT) + COUNT(v.rating)) // NULLIF(2 * COUNT(v.rating), 0) AS rating_cents
  FROM ride_requests q
  LEFT JOIN user_dim u ON u.user_id = q.user_id
  LEFT JOIN reviews v ON v.ride_id = q.ride_id
  GROUP BY q.driver_id, u.age_range, u.platform"""


def _with(ctes: list[tuple[str, str]]) -> str:
    return "".join(f",\n{name} AS (\n{sql}\n)" for name, sql in ctes)


def _core() -> dict[str, tuple[list[tuple[str, str]], str]]:
    """name -> (private CTEs, final SELECT) for every core query."""
    steps = {
        "platform": _funnel_steps(False, False, False),
        "age_platform": _funnel_steps(True, False, False),
        "daily": _funnel_steps(True, True, False),
        "daily_user": _funnel_steps(True, True, True),
    }
    driver_cells = [("driver_cells", _DRIVER_CELLS)]
    sums = ", ".join(f"CAST(SUM(CASE WHEN funnel_step = {k} THEN users ELSE 0 END) AS BIGINT) AS funnel_{k}"
                     for k in range(1, 5))
    ratios = ", ".join(f"{_half_up(f'funnel_{k}', 'funnel_1')} AS funnel_{k}_ratio" for k in range(1, 5))
    c: dict[str, tuple[list[tuple[str, str]], str]] = {}
    c["funnel_by_platform"] = ([("steps", steps["platform"])], _conversion("platform"))
    c["funnel_by_age_platform"] = ([("steps", steps["age_platform"])],
                                   _conversion("age_range, platform"))
    c["funnel_daily"] = ([("steps", steps["daily"])], "SELECT * FROM steps")
    c["funnel_daily_user"] = ([("steps", steps["daily_user"])], "SELECT * FROM steps")
    c["funnel_totals"] = ([("steps", steps["platform"]), ("totals", f"SELECT {sums} FROM steps")],
                          f"SELECT funnel_1, funnel_2, funnel_3, funnel_4, {ratios} FROM totals")
    c["requests_by_hour"] = ([], """
SELECT CAST(hour(request_ts) AS INTEGER) AS request_hour, COUNT(*) AS num_requests
FROM ride_requests GROUP BY 1""")
    c["rides_per_user"] = ([], "SELECT user_id, COUNT(ride_id) AS rides FROM ride_requests GROUP BY user_id")
    c["charge_status_stats"] = ([], f"""
SELECT t.charge_status, COUNT(DISTINCT v.user_id) AS users, COUNT(DISTINCT q.driver_id) AS drivers,
       COUNT(q.ride_id) AS rides, COUNT(v.review_id) AS reviews,
       {_double(f"ROUND(SUM({_usd('t.purchase_amount_usd')}), 2)")} AS total_usd
FROM ride_requests q
LEFT JOIN reviews v ON v.ride_id = q.ride_id
LEFT JOIN transactions t ON t.ride_id = q.ride_id
WHERE t.charge_status IS NOT NULL
GROUP BY t.charge_status""")
    c["user_declines"] = ([], _decline_sql("user_id", "driver_id", "unique_drivers"))
    c["driver_declines"] = ([], _decline_sql("driver_id", "user_id", "unique_users"))
    c["driver_rating_distribution"] = (driver_cells, """
SELECT driver_id, users, rides, rides_completed, rides_canceled, age_range, platform, reviews,
       CAST(rating_cents AS DOUBLE) / 100 AS avg_rating
FROM driver_cells""")
    c["driver_rating_summary"] = (driver_cells, """
SELECT driver_id, CAST(SUM(rides) AS BIGINT) AS total_rides, CAST(SUM(users) AS BIGINT) AS total_users,
       CAST(SUM(rides_completed) AS BIGINT) AS rides_completed,
       CAST(SUM(rides_canceled) AS BIGINT) AS rides_canceled, CAST(SUM(reviews) AS BIGINT) AS reviews,
       CAST((2 * SUM(rating_cents) + COUNT(rating_cents)) // NULLIF(2 * COUNT(rating_cents), 0) AS DOUBLE) / 100
         AS avg_ratings
FROM driver_cells GROUP BY driver_id""")
    c["review_rating_stats"] = ([], f"""
SELECT v.rating, COUNT(DISTINCT v.user_id) AS users, COUNT(q.ride_id) AS rides,
       COUNT(v.review_id) AS reviews, {_double(f"SUM({_usd('t.purchase_amount_usd')})")} AS total_usd
FROM reviews v
LEFT JOIN ride_requests q ON q.ride_id = v.ride_id
LEFT JOIN transactions t ON t.ride_id = v.ride_id
GROUP BY v.rating
UNION ALL
SELECT CAST(NULL AS INTEGER), COUNT(DISTINCT q.user_id), COUNT(q.ride_id), CAST(NULL AS BIGINT),
       {_double(f"SUM({_usd('t.purchase_amount_usd')})")}
FROM ride_requests q
LEFT JOIN transactions t ON t.ride_id = q.ride_id
WHERE NOT EXISTS (SELECT 1 FROM reviews v WHERE v.ride_id = q.ride_id)""")
    c["rides_without_reviews"] = ([], """
SELECT q.ride_id FROM ride_requests q
WHERE NOT EXISTS (SELECT 1 FROM reviews v WHERE v.ride_id = q.ride_id)""")
    c["user_ride_status"] = ([], "SELECT user_id, age_range, platform FROM rider_dim")
    c["user_ride_stats"] = ([], """
SELECT user_id, COUNT(ride_id) AS total_rides, COUNT(dropoff_ts) AS rides_completed,
       COUNT(cancel_ts) AS rides_canceled
FROM ride_requests GROUP BY user_id""")
    c["reviews_per_user"] = ([], "SELECT user_id, COUNT(*) AS review_count FROM reviews GROUP BY user_id")
    return c


def _embedded(core: dict, name: str, alias: str) -> tuple[str, str]:
    """A core query as one CTE (its private CTEs nested inside)."""
    ctes, body = core[name]
    if ctes:
        inner = "WITH " + ",\n".join(f"{n} AS (\n{sql}\n)" for n, sql in ctes)
        return alias, f"{inner}\n{body.strip()}"
    return alias, body.strip()


def core_sql(prefix: str = "") -> dict[str, str]:
    """Core statements over tables named app_downloads ... reviews.  With the
    default prefix those are the fixture mapping; pass "WITH " to run them on
    real tables of those names."""
    prefix = prefix or BASE
    if prefix.strip().upper() == "WITH":
        prefix = "WITH " + DIMENSIONS.strip() + "\n"
    return {name: prefix.rstrip() + _with(ctes) + "\n" + body.strip()
            for name, (ctes, body) in _core().items()}


def derived_sql(prefix: str = "") -> dict[str, str]:
    """Panel, exchange and store statements; `prefix` as in `core_sql`."""
    from ridelens.plans.exchange import exchange_sql
    from ridelens.plans.panel_oracle import panel_sql
    from ridelens.plans.store_queries import FROM_FACTS, store_sql
    prefix = prefix or BASE
    if prefix.strip().upper() == "WITH":
        prefix = "WITH " + DIMENSIONS.strip() + "\n"
    core = _core()
    out = {}
    facts_keys = {f"{name}_from_facts" for name in FROM_FACTS}  # core statements, with CTEs of their own
    for name, (sources, body) in {**panel_sql(), **exchange_sql(), **store_sql(core, panel_sql())}.items():
        ctes = sources if name in facts_keys else [_embedded(core, src, alias) for alias, src in sources]
        body = body.strip()
        if body.upper().startswith("WITH "):  # merge the panel's own CTE list
            body = "," + body[len("WITH"):]
        out[name] = prefix.rstrip() + _with(ctes) + "\n" + body
    return out


def oracle_sql() -> dict[str, str]:
    return {**core_sql(), **derived_sql()}
