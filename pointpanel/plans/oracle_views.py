"""The derived input views as SQL text, used only by the oracle side of the checks."""

from __future__ import annotations

import re

_BARS = """
SELECT sid AS security_id, d AS date,
       max(CASE WHEN rn = 1 THEN px END) AS open, max(px) AS high, min(px) AS low,
       max(CASE WHEN rd = 1 THEN px END) AS close, CAST(sum(q) * 1000 AS BIGINT) AS volume
FROM (SELECT {key} AS sid, CAST(l_shipdate AS DATE) AS d, l_quantity AS q, l_extendedprice / l_quantity AS px,
             row_number() OVER (PARTITION BY {key}, CAST(l_shipdate AS DATE)
               ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn,
             row_number() OVER (PARTITION BY {key}, CAST(l_shipdate AS DATE)
               ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS rd
      FROM lineitem) t
WHERE NOT ({stop} AND d > DATE '2000-06-30')
GROUP BY sid, d"""

_FUND = """
SELECT security_id, fiscal_period_end, CAST(fiscal_period_end + INTERVAL '60' DAY AS DATE) AS reported_date,
       CAST(rev4 AS DOUBLE) / 10000 AS revenue, CAST(rev4 - cost4 AS DOUBLE) / 10000 AS net_income,
       CAST(debt2 AS DOUBLE) / 100 AS total_debt, CAST(equity AS DOUBLE) AS shareholders_equity,
       CAST(shares AS DOUBLE) AS shares_outstanding, CAST(cost4 AS DOUBLE) / 10000 AS cost_of_revenue
FROM (SELECT l_suppkey AS security_id, make_date(CAST(year(l_shipdate) AS INT), 12, 31) AS fiscal_period_end,
             sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS rev4,
             sum(CAST(l_quantity AS BIGINT) * CAST(round(p_retailprice * 100) AS BIGINT) * 200) AS cost4,
             sum(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS debt2,
             max(CAST(round(s_acctbal * 100) AS BIGINT)) AS equity, sum(CAST(l_quantity AS BIGINT)) AS shares
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey {where} GROUP BY 1, 2) t"""

_ACTIONS = """
SELECT security_id, date AS effective_date, action_type,
       CASE action_type WHEN 'Dividend' THEN close * 0.02 END AS dividend_amount,
       CASE action_type
         WHEN 'Split' THEN concat('Sub-division from Rs. 10/- to Re. ', CAST(1 + security_id % 5 AS VARCHAR), '/-')
         WHEN 'Bonus' THEN concat('Bonus issue in the ratio of 1:', CAST(1 + security_id % 3 AS VARCHAR), ' of Rs. 10/-.')
         WHEN 'Rights' THEN concat('Rights equity shares of Rs. 10/- in the ratio of 1 : ', CAST(2 + security_id % 4 AS VARCHAR),
                                   ' @ premium of Rs. ', CAST(300 + security_id % 7 AS VARCHAR), '/-') END AS raw_description
FROM (SELECT b.*, CASE WHEN rn % 97 = 50 THEN 'Split' WHEN rn % 101 = 60 THEN 'Bonus' WHEN rn % 103 = 70 THEN 'Rights'
                       WHEN rn % 53 = 20 THEN 'Dividend' END AS action_type
      FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY date) AS rn FROM {bars}) b) x
WHERE action_type IS NOT NULL"""

_SNAPSHOTS = """
SELECT row_number() OVER (ORDER BY date) AS snapshot_id, date AS as_of_date, n AS price_row_count,
       CASE WHEN day(date) <> 13 THEN date END AS sealed_at
FROM (SELECT date, count(*) AS n FROM {bars} GROUP BY date) t"""

# bars before the same-day action; the action belongs to every bar dated strictly earlier
_ADJUSTED = """
SELECT b.security_id, b.date, b.open, b.high, b.low, b.close, b.volume,
       b.close * coalesce((SELECT product(f.factor) FROM {factors} f
                  WHERE f.security_id = b.security_id AND f.effective_date > b.date AND f.factor > 0), 1) AS adj_close
FROM {bars} b"""

_FACTORS = """
SELECT a.security_id, a.effective_date, a.action_type, a.dividend_amount, a.raw_description, c.close AS cum_close,
       CASE a.action_type
         WHEN 'Split' THEN CAST(regexp_extract(a.raw_description, 'to Re. ([0-9]+)', 1) AS DOUBLE)
                           / CAST(regexp_extract(a.raw_description, 'from Rs. ([0-9]+)', 1) AS DOUBLE)
         WHEN 'Bonus' THEN CAST(regexp_extract(a.raw_description, 'ratio of 1:([0-9]+)', 1) AS DOUBLE)
                           / (1 + CAST(regexp_extract(a.raw_description, 'ratio of 1:([0-9]+)', 1) AS DOUBLE))
         WHEN 'Rights' THEN CASE WHEN c.close > 0 AND sub < c.close
              THEN ((held * c.close + 1 * sub) / (held + 1)) / c.close END END AS factor
FROM (SELECT *, TRY_CAST(regexp_extract(raw_description, 'ratio of 1 : ([0-9]+)', 1) AS DOUBLE) AS held,
             10 + TRY_CAST(regexp_extract(raw_description, 'premium of Rs. ([0-9]+)', 1) AS DOUBLE) AS sub
      FROM {actions}) a
ASOF LEFT JOIN {bars} c ON a.security_id = c.security_id AND a.effective_date > c.date"""



def actions_view(bars: str) -> str:
    return _ACTIONS.format(bars=bars)


def factors_view(actions: str, bars: str) -> str:
    return _FACTORS.format(actions=actions, bars=bars)


VIEWS: dict[str, str] = {
    "fx_bars": _BARS.format(key="l_suppkey", stop="sid % 10 = 3"),
    "fx_bars_dense": _BARS.format(key="(l_suppkey % 10 + 1)", stop="sid = 3"),
    "fx_securities": """
SELECT s_suppkey AS security_id, s_name AS ticker, concat('SUP', CAST(s_suppkey AS VARCHAR)) AS provider_security_id,
       s_name AS name, r_name AS exchange, n_name AS sector, CAST(NULL AS VARCHAR) AS industry, true AS is_active
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "fx_fundamentals_v2": _FUND.format(where=""),
    "fx_fundamentals_v1": _FUND.format(where="WHERE l_linestatus = 'F'"),
    "fx_fundamentals_scd2": """
SELECT *, reported_date AS valid_from, CAST(reported_date + INTERVAL '180' DAY AS DATE) AS valid_to FROM fx_fundamentals_v1
UNION ALL
SELECT *, CAST(reported_date + INTERVAL '180' DAY AS DATE) AS valid_from, DATE '9999-12-31' AS valid_to
FROM fx_fundamentals_v2""",
    "fx_actions": _ACTIONS.format(bars="fx_bars"),
    "fx_actions_dense": _ACTIONS.format(bars="fx_bars_dense"),
    "fx_traded": """
SELECT b.security_id, b.date, b.volume,
       (sum(b.close) OVER m / count(*) OVER m) * coalesce(product(f.factor) OVER r, 1) AS close
FROM fx_bars_dense b LEFT JOIN (SELECT security_id, effective_date AS date,
    CASE action_type WHEN 'Split' THEN (1 + security_id % 5) / 10::DOUBLE ELSE (1 + security_id % 3) / (2 + security_id % 3)::DOUBLE END AS factor
  FROM fx_actions_dense WHERE action_type IN ('Split', 'Bonus')) f USING (security_id, date)
WINDOW m AS (PARTITION BY b.security_id ORDER BY b.date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
       r AS (PARTITION BY b.security_id ORDER BY b.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "fx_actions_traded": _ACTIONS.format(bars="fx_traded"),
    "fx_factors_traded": _FACTORS.format(actions="fx_actions_traded", bars="fx_traded"),
    "fx_factors": _FACTORS.format(actions="fx_actions", bars="fx_bars"),
    "fx_factors_dense": _FACTORS.format(actions="fx_actions_dense", bars="fx_bars_dense"),
    "fx_adjusted": _ADJUSTED.format(factors="fx_factors", bars="fx_bars"),
    "fx_snapshots": _SNAPSHOTS.format(bars="fx_bars"),
    "fx_snapshots_dense": _SNAPSHOTS.format(bars="fx_bars_dense"),
    "fx_benchmark": "SELECT 'MKT' AS ticker, date, avg(close) AS total_return_index_value FROM fx_bars GROUP BY date",
    "fx_symbols": """
SELECT date, security_id, concat(CASE WHEN security_id % 5 = 0 AND date >= DATE '1999-01-01' THEN 'N' ELSE 'S' END,
       CAST(security_id AS VARCHAR)) AS symbol,
       CASE WHEN date < DATE '1998-01-01' THEN concat('INE', CAST(security_id AS VARCHAR)) ELSE '' END AS isin
FROM fx_bars""",
    "fx_rebalance": """
SELECT CAST(k AS INT) AS rebalance_no,
       make_date(CAST(1998 + k // 4 AS INT), CAST(1 + 3 * (k % 4) AS INT), 2) AS signal_date
FROM (SELECT unnest(range(12)) AS k) v""",
    "fx_ratios": """
SELECT f.security_id, f.reported_date, b.close AS price,
       CASE WHEN b.close > 0 AND f.shares_outstanding > 0 THEN b.close * f.shares_outstanding END AS market_cap,
       CASE WHEN f.net_income > 0 AND b.close > 0 AND f.shares_outstanding > 0
            THEN b.close * f.shares_outstanding / f.net_income END AS pe,
       CASE WHEN f.shareholders_equity > 0 AND b.close > 0 AND f.shares_outstanding > 0
            THEN b.close * f.shares_outstanding / f.shareholders_equity END AS pb,
       CASE WHEN f.revenue > 0 AND b.close > 0 AND f.shares_outstanding > 0
            THEN b.close * f.shares_outstanding / f.revenue END AS ps,
       CASE WHEN f.shareholders_equity > 0 THEN f.net_income / f.shareholders_equity * 100 END AS roe,
       CASE WHEN f.shareholders_equity > 0 THEN f.total_debt / f.shareholders_equity END AS debt_to_equity,
       CASE WHEN f.revenue > 0 THEN (f.revenue - f.cost_of_revenue) / f.revenue * 100 END AS gross_margin,
       CAST(NULL AS DOUBLE) AS roic, CAST(NULL AS DOUBLE) AS fcf_yield
FROM fx_fundamentals_v2 f
ASOF LEFT JOIN fx_bars b ON f.security_id = b.security_id AND f.reported_date >= b.date""",
}


def with_views(body: str, **extra: str) -> str:
    """Prefix ``body`` with the CTEs it uses, in dependency order. ``extra`` adds query-local CTEs."""
    pool = {**VIEWS, **extra}
    names = list(pool)
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in names:
            if re.search(rf"\b{name}\b", text) and pool[name] is not text and name not in needed:
                visit(pool[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({pool[n].strip()})" for n in needed)
    return f"WITH {ctes}\n{body.strip()}"


def rnd(expr: str, digits: int = 6) -> str:
    """The same three double operations the Spark side rounds with."""
    return f"(floor(({expr}) * 1e{digits} + 0.5) / 1e{digits})"


def rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(f"{rnd(n, digits)} AS {n}" for n in names)
