"""DuckDB statements for the registered dashboard panels.

Each entry is (sources, body): `sources` lists (alias, core query) pairs that
`oracle.oracle_sql` embeds as CTEs, `body` is the panel's own SELECT.  The
parameters are the ones `panels.panel_queries` registers."""

from __future__ import annotations

# The dashboard's defaults, stated here again so that a wrong default in the
# panels does not pass unseen.
FIRST_AGE, LAST_AGE = "18-24", "Unknown"
_DATES = "daily_date IS NOT NULL"
_PLATFORMS = "platform BETWEEN 'android' AND 'web'"
_IOS = "platform = 'ios'"
_AGES = "age_range BETWEEN '18-24' AND 'Unknown'"
_LABEL = ("CASE funnel_name WHEN 'downloads' THEN 'Downloads' WHEN 'signups' THEN 'Signups' "
          "WHEN 'rides_requested' THEN 'Rides Requested' WHEN 'rides_completed' THEN 'Rides Completed' "
          "ELSE funnel_name END")


def _mean_of_means(digits: int) -> str:
    """HALF_UP mean of avg_rating, each taken to 10 decimals, in integers."""
    total = "SUM(CAST(CAST(avg_rating AS DECIMAL(20,10)) * 10000000000 AS HUGEINT))"
    n = "(COUNT(avg_rating) * 10000000000)"
    return f"CAST((2 * {10 ** digits} * {total} + {n}) // NULLIF(2 * {n}, 0) AS DOUBLE) / {10 ** digits}"


def _step(src: str, step: int, ages: bool = True, dates: str = _DATES, platforms: str = _PLATFORMS) -> str:
    cond = f"funnel_step = {step} AND {dates} AND {platforms}"
    if ages:
        cond += f" AND {_AGES}"
    return f"SELECT * FROM {src} WHERE {cond}"


def _dense(cells_sql: str, measure: str, fill: str | None) -> str:
    value = f"COALESCE(c.{measure}, {fill})" if fill is not None else f"c.{measure}"
    return f"""
WITH cells AS ({cells_sql}),
grid AS (SELECT a.age_range, p.platform
         FROM (SELECT DISTINCT age_range FROM cells) a, (SELECT DISTINCT platform FROM cells) p)
SELECT g.age_range, g.platform, {value} AS {measure}, g.age_range || ' - ' || g.platform AS label
FROM grid g LEFT JOIN cells c ON c.age_range = g.age_range AND c.platform = g.platform"""


def _long(keys: str, wide_sql: str, measures: dict[str, str]) -> str:
    parts = [f"SELECT {keys}, '{label}' AS measure, CAST({col} AS DOUBLE) AS value FROM wide"
             for col, label in measures.items()]
    return f"WITH wide AS ({wide_sql})\n" + "\nUNION ALL\n".join(parts)


def _funnel_pct(cells_sql: str, value: str) -> str:
    return f"""
WITH cells AS ({cells_sql})
SELECT *, CAST({value} AS DOUBLE) / FIRST_VALUE(NULLIF({value}, 0))
            OVER (PARTITION BY platform ORDER BY funnel_step) AS pct_initial,
       {_LABEL} AS funnel_label
FROM cells"""


def panel_sql() -> dict[str, tuple[list[tuple[str, str]], str]]:
    daily = [("daily", "funnel_daily")]
    per_user = [("daily_user", "funnel_daily_user")]
    out: dict[str, tuple[list[tuple[str, str]], str]] = {}

    user_cells = (f"SELECT funnel_step, funnel_name, platform, COUNT(DISTINCT user_ids) AS users "
                  f"FROM daily_user WHERE {_DATES} AND {_PLATFORMS} GROUP BY ALL")
    out["panel_user_funnel"] = (per_user, _funnel_pct(user_cells, "users"))

    def pivoted(cells: str, value: str) -> str:
        cols = [f"CAST(SUM(CASE WHEN platform = '{p}' THEN {value} END) AS BIGINT) AS {p}"
                for p in ("android", "ios", "web")]
        cols.append(f"CAST(SUM(CASE WHEN platform IN ('android', 'ios', 'web') THEN NULL ELSE {value} END) "
                    f"AS BIGINT) AS other")
        return f"SELECT funnel_step, {_LABEL} AS funnel_label, {', '.join(cols)} FROM ({cells}) GROUP BY ALL"
    out["panel_user_funnel_pivot"] = (per_user, pivoted(user_cells, "users"))
    rides_cells = (f"SELECT funnel_step, funnel_name, platform, COUNT(DISTINCT user_ids) AS users, "
                   f"CAST(SUM(rides) AS BIGINT) AS rides FROM daily_user "
                   f"WHERE funnel_step IN (3, 4) AND {_DATES} AND {_PLATFORMS} "
                   f"AND (age_range >= '{FIRST_AGE}' OR age_range IS NULL) "
                   f"AND (age_range <= '{LAST_AGE}' OR age_range = 'Unknown') GROUP BY ALL")
    out["panel_rides_funnel"] = (per_user, _funnel_pct(rides_cells, "rides"))

    out["panel_rides_funnel_pivot"] = (per_user, pivoted(rides_cells, "rides"))
    out["panel_user_funnel_ages"] = (per_user, _funnel_pct(
        f"SELECT funnel_step, funnel_name, platform, COUNT(DISTINCT user_ids) AS users FROM daily_user "
        f"WHERE {_DATES} AND {_PLATFORMS} AND age_range BETWEEN '25-34' AND '35-44' GROUP BY ALL", "users"))
    out["panel_daily_downloads"] = (daily, f"""
SELECT daily_date, platform, CAST(SUM(users) AS BIGINT) AS users
FROM ({_step('daily', 1, ages=False)}) GROUP BY daily_date, platform""")
    out["panel_daily_signups"] = (daily, f"""
SELECT daily_date, platform, CAST(SUM(users) AS BIGINT) AS users
FROM ({_step('daily', 2)}) GROUP BY daily_date, platform""")

    def sum_cells(src, step, col):
        return (f"SELECT age_range, platform, CAST(SUM({col}) AS BIGINT) AS {col} "
                f"FROM ({_step(src, step)}) GROUP BY age_range, platform")

    out["panel_signups"] = (daily, _dense(sum_cells("daily", 2, "users"), "users", "0"))
    out["panel_signups_merged"] = (daily, f"""
SELECT platform, CAST(SUM(users) AS BIGINT) AS users FROM ({_step('daily', 2)}) GROUP BY platform""")

    def distinct_cells(step):
        return (f"SELECT age_range, platform, COUNT(DISTINCT user_ids) AS users "
                f"FROM ({_step('daily_user', step)}) GROUP BY age_range, platform")

    out["panel_requesting_users"] = (per_user, _dense(distinct_cells(3), "users", "0"))
    out["panel_requesting_users_merged"] = (per_user, f"""
SELECT platform, COUNT(DISTINCT user_ids) AS users, CAST(SUM(rides) AS BIGINT) AS rides
FROM ({_step('daily_user', 3)}) GROUP BY platform""")
    out["panel_completing_users"] = (per_user, _dense(distinct_cells(4), "users", "0"))
    out["panel_rides_requested"] = (daily, _dense(sum_cells("daily", 3, "rides"), "rides", "0"))
    out["panel_rides_completed"] = (daily, _dense(sum_cells("daily", 4, "rides"), "rides", "0"))
    out["panel_usd"] = (daily, _dense(sum_cells("daily", 4, "total_usd"), "total_usd", "0"))
    rating_cells = (f"SELECT age_range, platform, {_mean_of_means(2)} AS avg_rating "
                    f"FROM ({_step('daily', 4)}) GROUP BY age_range, platform")
    out["panel_avg_rating"] = (daily, _dense(rating_cells, "avg_rating", None))
    out["panel_avg_rating_merged"] = (daily, f"""
SELECT platform, {_mean_of_means(2)} AS avg_rating FROM ({_step('daily', 4)}) GROUP BY platform""")

    def daily_long(step, measures, merged=False, mean=()):
        keys = "daily_date" if merged else "daily_date, platform"
        aggs = ", ".join(f"{_mean_of_means(10)} AS {c}" if c in mean else f"CAST(SUM({c}) AS BIGINT) AS {c}"
                         for c in measures)
        wide = f"SELECT {keys}, {aggs} FROM ({_step('daily', step)}) GROUP BY {keys}"
        return _long(keys, wide, measures)

    rc = {"rides": "Rides", "cancellations": "Cancellations"}
    out["panel_daily_rides_cancellations"] = (daily, daily_long(3, rc))
    out["panel_daily_rides_cancellations_merged"] = (daily, daily_long(3, rc, merged=True))
    out["panel_daily_rides_usd"] = (daily, daily_long(4, {"rides": "Rides", "total_usd": "USD"}))
    out["panel_daily_reviews_rating"] = (daily, daily_long(
        4, {"total_reviews": "Reviews", "avg_rating": "Rating"}, mean=("avg_rating",)))

    out["panel_daily_rides_usd_merged"] = (daily, daily_long(4, {"rides": "Rides", "total_usd": "USD"}, merged=True))
    out["panel_daily_reviews_rating_merged"] = (daily, daily_long(
        4, {"total_reviews": "Reviews", "avg_rating": "Rating"}, merged=True, mean=("avg_rating",)))
    for key, step, ages in (("panel_daily_downloads_merged", 1, False), ("panel_daily_signups_merged", 2, True)):
        out[key] = (daily, f"""
SELECT daily_date, CAST(SUM(users) AS BIGINT) AS users
FROM ({_step('daily', step, ages=ages)}) GROUP BY daily_date""")
    for key, step, col in (("panel_rides_requested_merged", 3, "rides"), ("panel_rides_completed_merged", 4, "rides"),
                           ("panel_usd_merged", 4, "total_usd")):
        out[key] = (daily, f"""
SELECT platform, CAST(SUM({col}) AS BIGINT) AS {col} FROM ({_step('daily', step)}) GROUP BY platform""")
    out["panel_completing_users_merged"] = (per_user, f"""
SELECT platform, COUNT(DISTINCT user_ids) AS users, CAST(SUM(rides) AS BIGINT) AS rides
FROM ({_step('daily_user', 4)}) GROUP BY platform""")
    window = "daily_date BETWEEN DATE '1994-02-01' AND DATE '1995-06-30'"
    out["panel_rides_requested_window"] = (daily, _dense(
        f"SELECT age_range, platform, CAST(SUM(rides) AS BIGINT) AS rides "
        f"FROM ({_step('daily', 3, dates=window)}) GROUP BY age_range, platform", "rides", "0"))
    out["panel_signups_ios"] = (daily, _dense(
        f"SELECT age_range, platform, CAST(SUM(users) AS BIGINT) AS users "
        f"FROM ({_step('daily', 2, platforms=_IOS)}) GROUP BY age_range, platform", "users", "0"))
    out["panel_requests_by_hour"] = ([("hourly", "requests_by_hour")],
                                     "SELECT request_hour, num_requests FROM hourly")
    out["panel_rides_histogram"] = ([("rpu", "rides_per_user")], """
WITH b AS (SELECT CAST(LEAST(rides // 5, 12) AS INTEGER) AS bin, COUNT(DISTINCT user_id) AS users
           FROM rpu GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(13))
SELECT g.bin * 5 AS bin_start, CASE WHEN g.bin < 12 THEN (g.bin + 1) * 5 END AS bin_end,
       CASE WHEN g.bin < 12 THEN CAST(g.bin * 5 AS VARCHAR) || '-' || CAST((g.bin + 1) * 5 AS VARCHAR)
            ELSE '60+' END AS bin_label,
       COALESCE(b.users, 0) AS users
FROM g LEFT JOIN b ON b.bin = g.bin""")
    out["panel_driver_ratings"] = ([("summary", "driver_rating_summary")], """
SELECT driver_id, avg_ratings, reviews, rides_completed,
       'Driver_id: ' || COALESCE(CAST(driver_id AS VARCHAR), 'nan')
       || '<br>AVG.Rating: ' || COALESCE(CAST(avg_ratings AS VARCHAR), 'nan')
       || '<br>Reviews: ' || COALESCE(CAST(reviews AS VARCHAR), 'nan')
       || '<br>Rides Completed: ' || COALESCE(CAST(rides_completed AS VARCHAR), 'nan') AS label
FROM summary
WHERE avg_ratings >= 0 AND avg_ratings <= 2.5 AND reviews >= 17 AND rides_completed >= 21""")
    types = """
SELECT user_id, total_rides, rides_completed, rides_canceled,
       CASE WHEN rides_completed = 0 AND rides_canceled > 0 THEN 'Full Cancellations'
            WHEN rides_completed > 0 AND rides_canceled = 0 THEN 'Full Completed Rides'
            ELSE 'Mixed' END AS user_type,
       CASE WHEN rides_completed = 0 AND rides_canceled > 0 THEN 'Full Cancellations'
            WHEN rides_completed > 0 AND rides_canceled = 0 THEN 'Full Completed Rides'
            ELSE 'Mixed' END || '<br>Rides Canceled: ' || CAST(rides_canceled AS VARCHAR)
         || '<br>Rides Completed: ' || CAST(rides_completed AS VARCHAR) AS label
FROM stats WHERE rides_canceled >= {c} AND rides_completed >= {d} AND total_rides >= {t}"""
    stats = [("stats", "user_ride_stats")]
    out["panel_user_types"] = (stats, types.format(c=0, d=0, t=0))
    out["panel_user_types_bounded"] = (stats, types.format(c=2, d=1, t=4))
    charge = [("cs", "charge_status_stats")]
    out["panel_charge_users_drivers"] = (charge, _long(
        "charge_status", "SELECT * FROM cs", {"users": "Users", "drivers": "Drivers"}))
    out["panel_charge_rides_reviews"] = (charge, _long(
        "charge_status", "SELECT * FROM cs", {"rides": "Rides", "reviews": "Reviews"}))
    out["panel_charge_usd"] = (charge, "SELECT charge_status, total_usd FROM cs")
    usd = {"lost_total_usd": "Lost Total USD", "gained_total_usd": "Gained Total USD"}
    for key, column, source in (("panel_usd_by_user", "user_id", "user_declines"),
                                ("panel_usd_by_driver", "driver_id", "driver_declines")):
        for suffix, lost, gained in (("", 0, 0), ("_bounded", 100000, 200000)):
            out[key + suffix] = ([("points", source)], _long(
                column, f"SELECT * FROM points WHERE lost_total_usd >= {lost} AND gained_total_usd >= {gained}", usd))
    for name in ("panel_signups", "panel_daily_rides_usd", "panel_user_funnel"):
        out[f"{name}_stored"] = out[name]
    for name in ("panel_signups", "panel_user_funnel"):
        out[f"{name}_raw"] = out[name]
    return out
