"""Registered queries and their SQL twins."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The logical tables of larder.sources.views as DuckDB common table expressions.
_VIEWS = {
    "foods": """
  SELECT *, CASE WHEN id % 29 = 0 THEN -price / 10e0 ELSE price / 10e0 END AS calories, size * 0.5e0 AS fat,
    size * 0.2e0 AS saturated_fat, size * 1.5e0 AS carbohydrates, size * 0.7e0 AS sugars,
    CASE WHEN id % 31 = 0 THEN -size * 0.9e0 ELSE size * 0.9e0 END AS proteins,
    CASE WHEN id % 2 = 0 THEN (CASE WHEN id % 29 = 0 THEN -price / 10e0 ELSE price / 10e0 END) / 0.23900573614e0 END AS kilojoules
  FROM (SELECT p_partkey AS id, DATE '2020-01-01' + CAST(p_partkey * 7 % 700 AS INTEGER) AS date_time,
    CASE WHEN p_partkey % 41 <> 0 THEN p_name END AS name, p_brand AS brand, 'g' AS unit, 100e0 AS portion,
    CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN '0' || CAST(p_partkey % 900 + 1000 AS VARCHAR)
      ELSE CAST(p_partkey % 900 + 1000 AS VARCHAR) END AS barcode,
    CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN [p_type, 'organic'] ELSE [p_type] END END AS categories,
    p_partkey % 17 = 0 AS archived, p_partkey % 23 = 0 AS hidden, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part)""",
    "known_foods": "SELECT * FROM foods WHERE id % 37 <> 0",
    "diary": "SELECT o_orderkey AS entry, o_custkey AS \"user\", CAST(o_orderdate AS DATE) AS day FROM orders",
    "diary_items": """
  SELECT entry, "user", day, l_partkey AS food_id, l_quantity * 10 AS portion, CAST(l_linenumber % 3 + 1 AS DOUBLE) AS quantity,
    l_linenumber - 1 AS category FROM lineitem JOIN diary ON l_orderkey = entry""",
    "body_stats": """
  SELECT user_id AS "user", CAST(ts AS DATE) AS day, event_type AS stat, arg_max(value, event_id) AS value FROM events GROUP BY ALL""",
    "goals": """
  SELECT "user", x.stat AS stat, x.seq AS seq, x.effective_from AS effective_from, x.shared AS shared, x.percent AS percent, x.goal AS goal
  FROM (SELECT c_custkey AS "user", unnest([
    {'stat': 'calories', 'seq': CAST(0 AS INTEGER), 'effective_from': CAST(NULL AS DATE), 'shared': true, 'percent': false, 'goal': [c_nationkey * 10 + 1800e0, c_nationkey * 10 + 1800e0, c_nationkey * 10 + 1800e0, c_nationkey * 10 + 1800e0, c_nationkey * 10 + 1800e0, c_nationkey * 10 + 1800e0, c_nationkey * 10 + 1800e0]},
    {'stat': 'calories', 'seq': CAST(1 AS INTEGER), 'effective_from': DATE '1997-06-01' + CAST(c_custkey % 200 AS INTEGER), 'shared': false, 'percent': false, 'goal': [c_nationkey + 2200e0, 2000e0, 2000e0, 2000e0, 2000e0, 2100e0, 2300e0]},
    CASE WHEN c_custkey % 4 = 0 THEN {'stat': 'calories', 'seq': CAST(2 AS INTEGER), 'effective_from': DATE '1996-01-01', 'shared': true, 'percent': false, 'goal': [1700e0, 1700e0, 1700e0, 1700e0, 1700e0, 1700e0, 1700e0]} END,
    {'stat': 'fat', 'seq': CAST(0 AS INTEGER), 'effective_from': CAST(NULL AS DATE), 'shared': true, 'percent': false, 'goal': [70e0, 70e0, 70e0, 70e0, 70e0, 70e0, 70e0]},
    {'stat': 'fat', 'seq': CAST(1 AS INTEGER), 'effective_from': DATE '1998-01-01', 'shared': true, 'percent': true, 'goal': [30e0, 30e0, 30e0, 30e0, 30e0, 30e0, 30e0]},
    CASE WHEN c_custkey % 3 <> 0 THEN {'stat': 'proteins', 'seq': CAST(0 AS INTEGER), 'effective_from': DATE '1996-03-01', 'shared': false, 'percent': false, 'goal': [50e0, 60e0, 60e0, 60e0, 60e0, 60e0, 50e0]} END]) AS x FROM customer) WHERE x IS NOT NULL""",
    "nutrients": """
  SELECT food_id, food_portion, x.k AS nutrient, x.v AS value FROM (SELECT id AS food_id, portion AS food_portion, unnest([
    {'k': 'calories', 'v': calories}, {'k': 'fat', 'v': fat}, {'k': 'saturated-fat', 'v': saturated_fat},
    {'k': 'carbohydrates', 'v': carbohydrates}, {'k': 'sugars', 'v': sugars}, {'k': 'proteins', 'v': proteins},
    {'k': 'kilojoules', 'v': coalesce(kilojoules, calories / 0.23900573614e0)}]) AS x FROM known_foods) WHERE x.v IS NOT NULL""",
    "amounts": """
  SELECT i.*, nutrient, floor(value * ((i.portion / food_portion) * i.quantity) * 100e0 + 0.5e0) / 100e0 AS amount
  FROM diary_items i JOIN nutrients USING (food_id)""",
    "summed": """
  SELECT * FROM amounts UNION ALL SELECT *, 'calories', 0e0 FROM diary_items""",
    "day_totals": """
  SELECT "user", day, nutrient, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM summed
  WHERE amount >= 0 OR nutrient IN ('calories', 'kilojoules') GROUP BY ALL""",
    "goal_asof": """
  SELECT "user", day, stat, arg_max(g, seq) AS g FROM (SELECT DISTINCT "user", day FROM diary) d
  JOIN (SELECT *, {'seq': seq, 'shared': shared, 'percent': percent, 'goal': goal} AS g FROM goals) USING ("user")
  WHERE effective_from IS NULL OR effective_from <= day GROUP BY "user", day, stat""",
    "day_goals": """
  SELECT "user", day, stat, CASE WHEN percent THEN floor(raw / 100 * energy / CASE stat WHEN 'fat' THEN 9e0 WHEN 'proteins' THEN 4e0 END + 0.5e0) ELSE raw END AS value
  FROM (SELECT *, max(CASE WHEN stat = 'calories' THEN raw END) OVER (PARTITION BY "user", day) AS energy FROM
    (SELECT "user", day, stat, g.percent AS percent, CASE WHEN g.shared THEN g.goal[1] ELSE g.goal[dayofweek(day) + 1] END AS raw FROM goal_asof))""",
    "calorie_days": """
  SELECT t."user", t.day, t.total, value AS goal FROM day_totals t JOIN day_goals g ON t."user" = g."user" AND t.day = g.day AND t.nutrient = g.stat WHERE stat = 'calories'""",
    "series": """
  SELECT "user", day, total AS value FROM day_totals WHERE nutrient = 'calories' AND total <> 0""",
    "stat_days": """SELECT "user", stat, day, value FROM body_stats WHERE value <> 0""",
    "filled": """
  SELECT c."user", c.stat, c.day, CAST(date_diff('day', lo, c.day) AS INTEGER) AS "index", floor(value * 100e0 + 0.5e0) / 100e0 AS value
  FROM (SELECT "user", stat, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM
    (SELECT "user", stat, min(day) AS lo, max(day) AS hi FROM stat_days GROUP BY ALL)) c
  LEFT JOIN stat_days s ON c."user" = s."user" AND c.stat = s.stat AND c.day = s.day""",
}
_NEEDS = {
    "known_foods": ["foods"], "diary_items": ["diary"], "nutrients": ["known_foods"], "amounts": ["diary_items", "nutrients"],
    "summed": ["amounts"], "day_totals": ["summed"], "goal_asof": ["diary", "goals"], "day_goals": ["goal_asof"], "calorie_days": ["day_totals", "day_goals"],
    "series": ["day_totals"], "stat_days": ["body_stats"], "filled": ["stat_days"],
}


def _with(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        out += [n for n in (*_with(_NEEDS.get(name, [])), name) if n not in out]
    return out


def query(sql: str | None = None, views: str = ""):
    """Registers a function of (spark, sf_dir) under its name, with its SQL over the named views."""

    def register(function):
        name = function.__name__
        QUERIES[name] = function
        if sql:
            ctes = ", ".join(f"{v} AS ({_VIEWS[v]})" for v in _with(views.split()))
            ORACLES[name] = f"WITH {ctes} {sql}" if ctes else sql
        return function

    return register


# Modules that register queries; at the end, as they import this one.
from larder.plans import changes, diary, documents, exports, foodlists, scalars, texts  # noqa: E402, F401
