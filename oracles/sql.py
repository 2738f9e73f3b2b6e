"""The registered queries written independently in SQL for DuckDB, straight from the definitions.

Shared steps are common table expressions; ``compose`` puts the needed ones in front of a query.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def compose(body: str) -> str:
    """Prefix ``body`` with the CTEs it mentions, dependencies first."""
    order: list[str] = []

    def need(sql: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", sql)):
            if word in CTES and word not in order and CTES[word] is not sql:
                need(CTES[word])
                if word not in order:
                    order.append(word)

    need(body)
    recursive = "RECURSIVE " if "RECURSIVE" in body else ""
    body = body.replace("/*RECURSIVE*/", "")
    parts = [f"{name} AS MATERIALIZED ({CTES[name]})" for name in order]
    if body.lstrip().startswith("WITH"):
        inner = body.lstrip()[4:]
        return f"WITH {recursive}" + (", ".join(parts) + ", " if parts else "") + inner
    return (f"WITH {recursive}" + ", ".join(parts) + " " if parts else "") + body


def r(expr: str, name: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0 AS {name}"


# Panel ---------------------------------------------------------------------------------------------

CTES["bars"] = """
SELECT p_brand AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
       sum(l_extendedprice / l_quantity) AS px_sum, count(*) AS px_count
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""
CTES["bars_m"] = CTES["bars"].replace("'week'", "'month'")
CTES["days"] = """
SELECT date, sum(px_sum) / sum(px_count) AS bench,
       CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS t
FROM bars GROUP BY date"""
CTES["grid"] = """
SELECT k.ticker, d.t, d.date, d.bench, b.px_sum / b.px_count AS close
FROM days d CROSS JOIN (SELECT DISTINCT ticker FROM bars) k
LEFT JOIN bars b ON b.ticker = k.ticker AND b.date = d.date"""
CTES["rets"] = """
SELECT *, close / lag(close) OVER w - 1 AS simple_return, ln(close / lag(close) OVER w) AS log_return,
       lead(close) OVER w / close - 1 AS next_return
FROM grid WINDOW w AS (PARTITION BY ticker ORDER BY t)"""
CTES["vols"] = """
SELECT *, CASE WHEN count(log_return) OVER v = 63 THEN stddev_samp(log_return) OVER v * sqrt(252.0) END AS realized_vol
FROM rets WINDOW v AS (PARTITION BY ticker ORDER BY t ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"""
for h in (1, 4, 5, 21):
    CTES[f"fwd{h}"] = f"""
SELECT a.ticker, a.t, {h} AS horizon, ln(b.close / a.close) - ln(b.bench / a.bench) AS forward
FROM grid a JOIN grid b ON a.ticker = b.ticker AND b.t = a.t + {h}
WHERE a.close IS NOT NULL AND b.close IS NOT NULL"""
CTES["bounds"] = """
SELECT min(CASE WHEN date >= DATE '1995-06-08' THEN t END) AS t_start,
       max(CASE WHEN date < DATE '2001-06-01' THEN t END) AS t_end FROM days"""
CTES["bounds28"] = CTES["bounds"].replace("1995-06-08", "1995-06-29")

ORACLES["price_panel"] = compose(f"SELECT ticker, t, date, {r('ln(close)', 'log_close', 8)}, {r('ln(bench)', 'log_bench', 8)} FROM grid")
ORACLES["price_lookback"] = compose(
    f"SELECT ticker, date, {r('ln(px_sum / px_count)', 'log_close', 8)} FROM bars WHERE date BETWEEN DATE '2001-06-01' - 365 AND DATE '2001-06-01'"
)
ORACLES["aligned_returns"] = compose(f"""
WITH common AS (SELECT date FROM bars GROUP BY date HAVING count(*) = (SELECT count(DISTINCT ticker) FROM bars)),
l AS (SELECT ticker, date, ln(px_sum / px_count / lag(px_sum / px_count) OVER (PARTITION BY ticker ORDER BY date)) AS ret
      FROM bars WHERE date IN (SELECT date FROM common))
SELECT ticker, date, {r('ret', 'ret')} FROM l WHERE ret IS NOT NULL""")
ORACLES["excess_returns"] = compose(f"""
SELECT ticker, t, horizon, {r('forward', 'forward')}
FROM (SELECT * FROM fwd1 UNION ALL SELECT * FROM fwd5 UNION ALL SELECT * FROM fwd21)""")
ORACLES["realized_vol"] = compose(f"""
SELECT ticker, t, {r('simple_return', 'simple_return')}, {r('log_return', 'log_return')}, {r('realized_vol', 'realized_vol')}
FROM vols WHERE close IS NOT NULL""")
ORACLES["trailing_complete"] = compose("""
SELECT ticker, t FROM (SELECT ticker, t, count(log_return) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS c FROM rets)
WHERE c = 252""")
ORACLES["evaluation_window"] = compose("SELECT t_start, t_end FROM bounds")

# News ----------------------------------------------------------------------------------------------

CTES["heads"] = """
SELECT 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS date, positive, negative,
       1.0 - positive - negative AS neutral
FROM (SELECT *, o_totalprice / 500000.0 * (6.0 - CAST(substr(o_orderpriority, 1, 1) AS DOUBLE)) / 6.0 AS positive,
             (1.0 - o_totalprice / 500000.0) * CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) / 6.0 AS negative FROM orders)"""
CTES["splits"] = """
SELECT ticker, date, CASE WHEN n % 2 = 0 THEN 2.0 ELSE 0.5 END AS ratio FROM (
  SELECT 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS ticker, year(o_orderdate) AS y, count(*) AS n,
         CAST(arg_max(o_orderdate, (o_totalprice, o_orderkey)) AS DATE) AS date
  FROM orders GROUP BY 1, 2)"""


def summary(source: str, keys: str) -> str:
    """Recency-weighted summary per key of rows (keys, age, positive, negative, neutral)."""
    return f"""
SELECT {keys}, mu AS score, w1 * w1 / w2 / (w1 * w1 / w2 + 6.0) * (1.0 - 0.5 * least(sd, 1.0)) AS confidence,
       headlines, sd AS dispersion, w1 * w1 / w2 AS effective_count, n_pos AS positive, n_neg AS negative, n_neu AS neutral
FROM (
  SELECT {keys}, max(mu) AS mu, sum(w) AS w1, sum(w * w) AS w2, count(*) AS headlines,
         sqrt(sum(w * (s - mu) * (s - mu)) / sum(w)) AS sd,
         count(*) FILTER (label = 0) AS n_pos, count(*) FILTER (label = 1) AS n_neg, count(*) FILTER (label = 2) AS n_neu
  FROM (
    SELECT *, sum(w * s) OVER (PARTITION BY {keys}) / sum(w) OVER (PARTITION BY {keys}) AS mu FROM (
      SELECT *, pow(0.5, age / 3.0) AS w, positive - negative AS s,
             CASE WHEN positive >= negative AND positive >= neutral THEN 0 WHEN negative >= neutral THEN 1 ELSE 2 END AS label
      FROM {source}))
  GROUP BY {keys})"""


for tag, window, least in (("", 7, 3), ("28", 28, 1)):
    CTES[f"seen{tag}"] = f"""
SELECT h.ticker, d.t, d.date, CAST(d.date - h.date AS DOUBLE) AS age, positive, negative, neutral
FROM days d JOIN heads h ON h.date >= d.date - {window} AND h.date < d.date"""
    CTES[f"news{tag}"] = f"SELECT * FROM ({summary(f'seen{tag}', 'ticker, t, date')}) WHERE headlines >= {least}"

SUMMARY = ", ".join(r(c, c) for c in ("score", "confidence", "dispersion", "effective_count"))
ORACLES["sentiment_panel"] = compose(f"""
SELECT ticker, t, date, {SUMMARY}, headlines, positive, negative, neutral,
       {r('pow(greatest(dispersion, 0.3), 2) / effective_count', 'score_variance')} FROM news""")
CTES["live"] = """
SELECT 'U' || CAST(user_id AS VARCHAR) AS ticker,
       CAST(greatest(CAST(floor(epoch((SELECT max(ts) FROM events))) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT), 0) AS DOUBLE) / 86400.0 AS age,
       value / 500.0 AS positive, (1.0 - value / 500.0) / 2.0 AS negative, (1.0 - value / 500.0) / 2.0 AS neutral FROM events"""
ORACLES["sentiment_live"] = compose(
    f"SELECT ticker, {SUMMARY}, headlines, positive, negative, neutral FROM ({summary('live', 'ticker')})"
)
ORACLES["headline_labels"] = compose("""
SELECT ticker, count(*) FILTER (a = 0) AS positive, count(*) FILTER (a = 1) AS negative, count(*) FILTER (a = 2) AS neutral,
       count(*) FILTER (b = 0) AS last_positive, count(*) FILTER (b = 1) AS last_negative, count(*) FILTER (b = 2) AS last_neutral
FROM (SELECT ticker,
        CASE WHEN positive >= negative AND positive >= neutral THEN 0 WHEN negative >= neutral THEN 1 ELSE 2 END AS a,
        CASE WHEN neutral >= positive AND neutral >= negative THEN 2 WHEN negative >= positive THEN 1 ELSE 0 END AS b
      FROM heads) GROUP BY ticker""")
CTES["span_heads"] = "SELECT * FROM heads WHERE date >= DATE '1995-06-01' AND date < DATE '2001-06-01' AND ticker IN (SELECT ticker FROM bars)"
ORACLES["signal_coverage"] = compose(f"""
WITH c AS (SELECT (SELECT count(*) FROM news, bounds WHERE t BETWEEN t_start AND t_end) AS covered,
                  (SELECT count(*) FROM grid, bounds WHERE t BETWEEN t_start AND t_end) AS cells)
SELECT covered, cells, {r('covered::DOUBLE / cells', 'signal_coverage')}, covered::DOUBLE / cells < 0.3 AS sparse,
  (SELECT count(*) FROM span_heads) AS headlines, NULL::BIGINT AS newly_scored FROM c""")
ORACLES["headlines_in_span"] = compose("""
SELECT k.ticker, count(h.date) AS headlines, (SELECT count(*) FROM span_heads) AS "of", (SELECT count(*) FROM span_heads) AS newly_scored
FROM (SELECT DISTINCT ticker FROM bars) k LEFT JOIN span_heads h USING (ticker) GROUP BY 1""")
ORACLES["headlines_per_ticker"] = compose("""
SELECT k.ticker, count(h.date) AS headlines FROM (SELECT DISTINCT ticker FROM bars) k LEFT JOIN heads h USING (ticker) GROUP BY 1""")
ORACLES["split_factors"] = compose(f"""
SELECT h.ticker, h.date, {r('coalesce(product(s.ratio), 1.0)', 'split_factor', 8)}
FROM (SELECT DISTINCT ticker, date FROM heads) h LEFT JOIN splits s ON s.ticker = h.ticker AND s.date > h.date GROUP BY 1, 2""")

# Signals -------------------------------------------------------------------------------------------

for tag in ("", "28"):
    CTES[f"levels{tag}"] = f"""
SELECT g.ticker, g.t, g.close, n.score AS level,
       CASE WHEN count(n.score) OVER w >= 20 THEN n.score - avg(n.score) OVER w END AS surprise
FROM grid g LEFT JOIN news{tag} n ON n.ticker = g.ticker AND n.t = g.t
WINDOW w AS (PARTITION BY g.ticker ORDER BY g.t ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"""
    CTES[f"exmom{tag}"] = f"""
SELECT ticker, t, level, x AS momentum, CASE WHEN n >= 5 THEN
         level - my - (CASE WHEN sxx > 0 THEN sxy / sxx ELSE 0.0 END) * (x - mx) END AS ex_momentum
FROM (SELECT *, count(*) OVER d AS n, avg(x) OVER d AS mx, avg(level) OVER d AS my, var_pop(x) OVER d AS sxx, covar_pop(level, x) OVER d AS sxy
      FROM (SELECT l.ticker, l.t, l.level, f.forward AS x FROM levels{tag} l
            JOIN fwd5 f ON f.ticker = l.ticker AND f.t = l.t - 5 WHERE l.level IS NOT NULL)
      WINDOW d AS (PARTITION BY t))"""

ORACLES["signal_surprise"] = compose(
    f"SELECT ticker, t, {r('level', 'level')}, {r('surprise', 'surprise')} FROM levels28 WHERE surprise IS NOT NULL"
)
ORACLES["signal_ex_momentum"] = compose(f"""
SELECT ticker, t, {r('level', 'level')}, {r('momentum', 'momentum')}, {r('ex_momentum', 'ex_momentum')}
FROM exmom28 WHERE ex_momentum IS NOT NULL""")

# Fundamentals --------------------------------------------------------------------------------------

CTES["cube"] = """
SELECT lpad(CAST(c_nationkey AS VARCHAR), 10, '0') AS cik, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, o_orderstatus AS status,
       sum(o_totalprice) AS total, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3"""
CTES["yearly"] = """
SELECT cik, CAST(date_trunc('year', q) AS DATE) AS fstart, status, sum(total) AS total, CAST(sum(n) AS BIGINT) AS n,
       CAST(date_trunc('year', q) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS fend
FROM cube GROUP BY 1, 2, 3, 6"""
CTES["quarterly"] = """
SELECT *, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS fend FROM cube"""
_annual = """'USD' AS unit, fstart, fend, {val} AS val,
  CASE status WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-K/A' ELSE '20-F' END AS form,
  fend + CASE status WHEN 'F' THEN 60 WHEN 'O' THEN 150 ELSE 90 END AS filed, CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS pos FROM yearly"""
_instant = """'{unit}' AS unit, CAST(NULL AS DATE) AS fstart, fend, {val} AS val, '10-Q' AS form,
  fend + CASE WHEN status = 'F' THEN 30 ELSE 45 END AS filed, CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS pos FROM quarterly"""
CTES["facts"] = (
    "SELECT cik, 'us-gaap' AS taxonomy, CASE WHEN status = 'P' THEN 'Revenues' ELSE 'RevenueFromContractWithCustomerExcludingAssessedTax' END AS tag, "
    + _annual.format(val="total")
    + " UNION ALL SELECT cik, 'us-gaap', CASE WHEN status = 'P' THEN 'ProfitLoss' ELSE 'NetIncomeLoss' END, "
    + _annual.format(val="total * 0.1 - n * 10000.0")
    + " UNION ALL SELECT cik, 'us-gaap', 'Revenues', "
    + _instant.format(unit="USD", val="total").replace("CAST(NULL AS DATE)", "q")
    + " UNION ALL SELECT cik, 'us-gaap', CASE WHEN status = 'P' THEN 'StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest' ELSE 'StockholdersEquity' END, "
    + _instant.format(unit="USD", val="total - n * 240000.0")
    + " UNION ALL SELECT cik, 'us-gaap', CASE WHEN status = 'O' THEN 'LongTermDebtNoncurrent' ELSE 'LongTermDebt' END, "
    + _instant.format(unit="USD", val="total * 0.2")
    + " UNION ALL SELECT cik, 'us-gaap', 'CommonStockSharesOutstanding', "
    + _instant.format(unit="shares", val="n * 900.0")
    + " UNION ALL SELECT cik, 'dei', 'EntityCommonStockSharesOutstanding', "
    + _instant.format(unit="shares", val="n * 1000.0")
    + " WHERE month(fend) <> 9"
)
CTES["tags"] = """
SELECT * FROM (VALUES
 ('revenue', 'RevenueFromContractWithCustomerExcludingAssessedTax', 'USD', 0), ('revenue', 'Revenues', 'USD', 1),
 ('revenue', 'RevenueFromContractWithCustomerIncludingAssessedTax', 'USD', 2), ('revenue', 'SalesRevenueNet', 'USD', 3),
 ('income', 'NetIncomeLoss', 'USD', 0), ('income', 'ProfitLoss', 'USD', 1),
 ('debt', 'LongTermDebt', 'USD', 0), ('debt', 'LongTermDebtNoncurrent', 'USD', 1), ('debt', 'LongTermDebtAndCapitalLeaseObligations', 'USD', 2),
 ('equity', 'StockholdersEquity', 'USD', 0), ('equity', 'StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest', 'USD', 1),
 ('shares', 'CommonStockSharesOutstanding', 'shares', 0), ('shares', 'WeightedAverageNumberOfDilutedSharesOutstanding', 'shares', 1)
) v(series, tag, unit, tag_rank)"""
CTES["usable"] = """
SELECT f.*, series, tag_rank FROM facts f JOIN tags USING (tag, unit) WHERE taxonomy = 'us-gaap' AND
 CASE WHEN series IN ('revenue', 'income') THEN (form LIKE '10-K%' OR form LIKE '20-F%') AND fend - fstart BETWEEN 350 AND 380
      ELSE form LIKE '10-K%' OR form LIKE '10-Q%' OR form LIKE '20-F%' END"""


def known(name: str, as_ofs: str, point_in_time: bool = True) -> None:
    """CTEs ``<name>``: fundamentals at every (cik, as_of) of ``as_ofs``."""
    see = "AND f.filed <= a.as_of" if point_in_time else ""
    CTES[f"{name}_pts"] = f"""
SELECT cik, as_of, series, tag_rank, fend, val FROM (
  SELECT a.cik, a.as_of, f.series, f.tag_rank, f.fend, f.val,
         row_number() OVER (PARTITION BY a.cik, a.as_of, f.series, f.tag_rank, f.fend ORDER BY f.filed DESC, f.pos) AS k
  FROM {as_ofs} a JOIN usable f ON f.cik = a.cik {see}) WHERE k = 1"""
    CTES[f"{name}_ser"] = f"""
SELECT p.* FROM {name}_pts p JOIN (
  SELECT cik, as_of, series, arg_max(tag_rank, (last, -tag_rank)) AS tag_rank FROM (
    SELECT cik, as_of, series, tag_rank, max(fend) AS last FROM {name}_pts GROUP BY ALL) GROUP BY ALL) b
USING (cik, as_of, series, tag_rank)"""
    CTES[f"{name}_last"] = f"SELECT cik, as_of, series, max(fend) AS fend, arg_max(val, fend) AS val FROM {name}_ser GROUP BY ALL"
    CTES[f"{name}_cover"] = f"""
SELECT cik, as_of, fend, sum(val) AS val FROM (
  SELECT a.cik, a.as_of, f.fend, f.val, rank() OVER (PARTITION BY a.cik, a.as_of ORDER BY f.filed DESC, f.fend DESC) AS k
  FROM {as_ofs} a JOIN facts f ON f.cik = a.cik AND f.taxonomy = 'dei' {see}) WHERE k = 1 GROUP BY ALL HAVING sum(val) > 0"""
    CTES[name] = f"""
SELECT a.*,
  CASE WHEN p.val > 0 AND rev.fend - p.fend BETWEEN 300 AND 430 THEN (rev.val - p.val) / p.val END AS revenue_growth,
  CASE WHEN rev.val > 0 THEN i.val / rev.val END AS net_margin,
  CASE WHEN d.val IS NULL THEN NULL WHEN e.val > 0 THEN d.val / e.val ELSE CAST('inf' AS DOUBLE) END AS debt_to_equity,
  CASE WHEN c.val IS NOT NULL THEN c.val ELSE s.val END AS shares,
  CASE WHEN c.val IS NOT NULL THEN c.fend ELSE s.fend END AS shares_as_of, rev.fend AS fiscal_year_end
FROM {as_ofs} a
LEFT JOIN {name}_last rev ON rev.cik = a.cik AND rev.as_of = a.as_of AND rev.series = 'revenue' AND a.as_of - rev.fend <= 550
LEFT JOIN (SELECT s.cik, s.as_of, max(s.fend) AS fend, arg_max(s.val, s.fend) AS val FROM {name}_ser s
           JOIN {name}_last l USING (cik, as_of, series) WHERE series = 'revenue' AND s.fend < l.fend GROUP BY ALL) p
  ON p.cik = a.cik AND p.as_of = a.as_of
LEFT JOIN {name}_ser i ON i.cik = a.cik AND i.as_of = a.as_of AND i.series = 'income' AND i.fend = rev.fend
LEFT JOIN {name}_last e ON e.cik = a.cik AND e.as_of = a.as_of AND e.series = 'equity' AND a.as_of - e.fend <= 400
LEFT JOIN {name}_ser d ON d.cik = a.cik AND d.as_of = a.as_of AND d.series = 'debt' AND d.fend = e.fend
LEFT JOIN {name}_last s ON s.cik = a.cik AND s.as_of = a.as_of AND s.series = 'shares' AND a.as_of - s.fend <= 400
LEFT JOIN {name}_cover c ON c.cik = a.cik AND c.as_of = a.as_of AND a.as_of - c.fend <= 400"""
    CTES[f"{name}_score"] = f"""
SELECT *, CASE WHEN len(parts) > 0 THEN list_sum(parts) / len(parts) END AS fscore,
       CASE WHEN len(parts) > 0 THEN len(parts) / 3.0 END AS coverage
FROM (SELECT *, list_filter([tanh(revenue_growth / 0.15), tanh((net_margin - 0.08) / 0.10),
                CASE WHEN isinf(debt_to_equity) THEN -1.0 ELSE tanh(1.0 - debt_to_equity) END], lambda x: x IS NOT NULL) AS parts FROM {name})"""


CTES["filers"] = "SELECT 'Brand#' || CAST(n_nationkey + 1 AS VARCHAR) AS ticker, lpad(CAST(n_nationkey AS VARCHAR), 10, '0') AS cik, n_regionkey AS region, n_name FROM nation"
CTES["quarter_ends"] = """
SELECT cik, CAST(unnest(generate_series(a, b, INTERVAL 3 MONTH)) - INTERVAL 1 DAY AS DATE) AS as_of FROM filers, (
  SELECT date_trunc('quarter', min(filed)) AS a, date_trunc('quarter', max(filed)) + INTERVAL 12 MONTH AS b FROM facts)"""
CTES["months"] = """
SELECT date AS as_of, t AS t_from, coalesce(lead(t) OVER (ORDER BY t), (SELECT max(t) + 1 FROM days)) AS t_to
FROM (SELECT date, t, lag(date) OVER (ORDER BY t) AS p FROM days) WHERE p IS NULL OR month(p) <> month(date)"""
CTES["month_asofs"] = "SELECT ticker, cik, as_of, t_from, t_to FROM filers, months"
CTES["one_asof"] = "SELECT cik, DATE '1999-06-30' AS as_of FROM filers"
known("fq", "quarter_ends")
known("fm", "month_asofs")
known("fc", "one_asof", False)
CTES["fpanel"] = "SELECT f.*, d.t FROM fm_score f JOIN days d ON d.t >= f.t_from AND d.t < f.t_to"

FUNDS = ", ".join(r(c, c) for c in ("revenue_growth", "net_margin", "debt_to_equity", "shares"))
ORACLES["facts_dedupe"] = compose(f"""
SELECT cik, tag, unit, fend AS period_end, {r('arg_max(val, (filed, -pos))', 'val', 3)}, max(filed) AS filed FROM facts
WHERE (form LIKE '10-K%' OR form LIKE '20-F%') AND fend - fstart BETWEEN 350 AND 380 GROUP BY 1, 2, 3, 4""")
ORACLES["facts_asof"] = compose(
    f"SELECT cik, as_of, series, tag_rank, fend AS period_end, {r('val', 'val', 3)} FROM fq_pts"
)
ORACLES["share_classes"] = compose(f"""
SELECT cik, filed, max(fend) AS period_end, {r('arg_max(val, fend)', 'val', 2)}
FROM (SELECT cik, filed, fend, sum(val) AS val FROM facts WHERE taxonomy = 'dei' GROUP BY ALL) GROUP BY 1, 2""")
ORACLES["fundamentals_asof"] = compose(f"SELECT cik, as_of, {FUNDS}, shares_as_of, fiscal_year_end FROM fq")
ORACLES["fundamentals_current"] = compose(f"SELECT cik, as_of, {FUNDS}, shares_as_of, fiscal_year_end FROM fc")
ORACLES["fundamental_score"] = compose(f"SELECT cik, as_of, {r('fscore', 'fscore')}, {r('coverage', 'coverage')} FROM fq_score")
ORACLES["fundamental_panel"] = compose(
    f"SELECT ticker, t, as_of, {r('shares', 'shares')}, shares_as_of, {r('fscore', 'fscore')}, {r('coverage', 'coverage')} FROM fpanel"
)
CTES["caps"] = """
SELECT g.ticker, g.t, g.close, any_value(g.close * f.shares) * coalesce(product(s.ratio), 1.0) AS market_cap
FROM grid g LEFT JOIN fpanel f ON f.ticker = g.ticker AND f.t = g.t
LEFT JOIN splits s ON s.ticker = g.ticker AND s.date > f.shares_as_of
WHERE g.close IS NOT NULL GROUP BY 1, 2, 3"""
ORACLES["market_caps"] = compose(f"SELECT ticker, t, {r('market_cap / 1e6', 'cap_millions', 4)} FROM caps")

# Evaluation ----------------------------------------------------------------------------------------

L, U, X, Q = "News sentiment (level)", "News sentiment (surprise vs 60d)", "News sentiment ex 5d momentum", "Fundamentals quality"


def stacked(tag: str, facts: bool) -> str:
    parts = [
        f"SELECT '{L}' AS signal, ticker, t, level AS value FROM levels{tag} WHERE level IS NOT NULL",
        f"SELECT '{U}', ticker, t, surprise FROM levels{tag} WHERE surprise IS NOT NULL",
        f"SELECT '{X}', ticker, t, ex_momentum FROM exmom{tag} WHERE ex_momentum IS NOT NULL",
    ]
    if facts:
        parts.append(f"SELECT '{Q}', ticker, t, fscore FROM fpanel WHERE fscore IS NOT NULL")
    return " UNION ALL ".join(parts)


CTES["variants"] = stacked("", True)
CTES["news_variants"] = stacked("", False)
CTES["variants28"] = stacked("28", True)
CTES["news_variants28"] = stacked("28", False)
ORACLES["signal_variants"] = compose(f"SELECT signal, ticker, t, {r('value', 'value')} FROM variants")
for name, source in (("ics", "variants"), ("news_ics", "news_variants")):
    CTES[name] = f"""
SELECT signal, horizon, t, names, cov / sqrt(vx * vy) AS ic FROM (
  SELECT signal, horizon, t, count(*) AS names, sum(rx * ry) AS cov, sum(rx * rx) AS vx, sum(ry * ry) AS vy FROM (
    SELECT signal, horizon, t,
      rank() OVER (PARTITION BY signal, horizon, t ORDER BY value) + (count(*) OVER (PARTITION BY signal, horizon, t, value) - 1) / 2.0 - (count(*) OVER (PARTITION BY signal, horizon, t) + 1) / 2.0 AS rx,
      rank() OVER (PARTITION BY signal, horizon, t ORDER BY forward) + (count(*) OVER (PARTITION BY signal, horizon, t, forward) - 1) / 2.0 - (count(*) OVER (PARTITION BY signal, horizon, t) + 1) / 2.0 AS ry
    FROM {source} JOIN (SELECT * FROM fwd1 UNION ALL SELECT * FROM fwd5 UNION ALL SELECT * FROM fwd21) USING (ticker, t), bounds
    WHERE t BETWEEN t_start AND t_end)
  GROUP BY 1, 2, 3) WHERE names >= 5 AND vx > 0 AND vy > 0"""
ORACLES["ic_by_date"] = compose(f"SELECT signal, horizon, t, names, {r('ic', 'ic')} FROM news_ics")


def hac(source: str, keys: str, order: str, value: str, lags: str) -> str:
    """(keys, n, mean, lrv) of a series table by explicit lag joins."""
    return f"""
SELECT {keys}, n, mean, greatest(g0 + coalesce(gl, 0.0), 0.0) AS lrv FROM (
  SELECT {keys}, max(n) AS n, max(mean) AS mean, sum(d * d) / max(n) AS g0 FROM {source}_idx GROUP BY {keys})
LEFT JOIN (
  SELECT {keys}, sum(2.0 * (1.0 - l::DOUBLE / (lags + 1)) * g) AS gl FROM (
    SELECT {", ".join("a." + k.strip() for k in keys.split(","))}, a.k - b.k AS l, max(a.lags) AS lags, sum(a.d * b.d) / max(a.n) AS g
    FROM {source}_idx a JOIN {source}_idx b ON {" AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))}
      AND a.k > b.k AND a.k - b.k <= a.lags
    GROUP BY ALL) GROUP BY {keys}) USING ({keys})"""


def indexed(source: str, keys: str, order: str, value: str, lags: str) -> str:
    return f"""
SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS k, {value} - avg({value}) OVER (PARTITION BY {keys}) AS d,
       count(*) OVER (PARTITION BY {keys}) AS n, avg({value}) OVER (PARTITION BY {keys}) AS mean, {lags} AS lags FROM {source}"""


CTES["ics_idx"] = indexed("ics", "signal, horizon", "t", "ic", f"horizon - 1 + CASE WHEN signal = '{Q}' THEN 21 ELSE 5 END")
CTES["ics_hac"] = hac("ics", "signal, horizon", "t", "ic", "")
HAC = f"{r('mean', 'mean')}, {r('lrv', 'long_run_variance')}, {r('sqrt(lrv / n)', 'se')}, {r('CASE WHEN lrv > 0 THEN mean / sqrt(lrv / n) ELSE 0.0 END', 't')}"
ORACLES["ic_table"] = compose(f"""
SELECT signal, horizon, n, {HAC}, {r('hit', 'hit_rate')}, {r('names', 'avg_names')}
FROM ics_hac JOIN (SELECT signal, horizon, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS hit, avg(names) AS names FROM ics GROUP BY 1, 2)
USING (signal, horizon) WHERE n >= 20""")
CTES["weekly"] = "SELECT ticker, t, simple_return FROM rets WHERE simple_return IS NOT NULL"
CTES["weekly_idx"] = indexed("weekly", "ticker", "t", "simple_return", "5")
CTES["weekly_hac"] = hac("weekly", "ticker", "t", "simple_return", "5")
ORACLES["nw_mean"] = compose(f"SELECT ticker, n, {HAC} FROM weekly_hac")

# Calibration: level and fundamentals, four-week horizon.
CTES["sections"] = f"""
SELECT signal, ticker, t, value - avg(value) OVER d AS x, y0 - avg(y0) OVER d AS y, count(*) OVER d AS names FROM (
  SELECT v.signal, v.ticker, v.t, v.value, f.forward * (252.0 / 4.0) / s.realized_vol AS y0
  FROM variants28 v JOIN fwd4 f USING (ticker, t) JOIN vols s USING (ticker, t), bounds28
  WHERE v.signal IN ('{L}', '{Q}') AND s.realized_vol > 0 AND v.t BETWEEN t_start AND t_end)
WINDOW d AS (PARTITION BY signal, t)"""
ORACLES["cross_sections"] = compose(f"SELECT signal, ticker, t, {r('x', 'x')}, {r('y', 'y')} FROM sections WHERE names >= 5")
CTES["sums"] = "SELECT signal, t, sum(x * x) AS sxx, sum(x * y) AS sxy, count(*) AS names FROM sections WHERE names >= 5 GROUP BY 1, 2"
CTES["scores"] = """
SELECT signal, t, sxy - kappa * sxx AS u, kappa, total, observations FROM sums JOIN (
  SELECT signal, sum(sxy) / sum(sxx) AS kappa, sum(sxx) AS total, CAST(sum(names) AS BIGINT) AS observations FROM sums GROUP BY 1) USING (signal)"""
CTES["scores_idx"] = indexed("scores", "signal", "t", "u", "8")
CTES["scores_hac"] = hac("scores", "signal", "t", "u", "8")
CTES["slopes"] = """
SELECT signal, kappa, sqrt(lrv * n) / total AS se, kappa / nullif(sqrt(lrv * n) / total, 0) AS tstat, n AS dates, observations
FROM scores_hac JOIN (SELECT DISTINCT signal, kappa, total, observations FROM scores) USING (signal) WHERE n >= 2"""
ORACLES["pooled_slope"] = compose(
    f"SELECT signal, {r('kappa', 'kappa')}, {r('se', 'se')}, {r('coalesce(tstat, 0.0)', 't')}, dates, observations FROM slopes"
)
ORACLES["shrunk_coefficients"] = compose(f"""
SELECT signal, {r('kappa', 'kappa')}, {r('se', 'se')}, {r('tstat', 't')},
  {r('CASE WHEN abs(tstat) > 1 THEN kappa * (1 - 1 / (tstat * tstat)) ELSE 0.0 END', 'shrunk_kappa')},
  {r('CASE WHEN abs(tstat) > 1 THEN se * sqrt(1 - 1 / (tstat * tstat)) ELSE 0.0 END', 'shrunk_se')} FROM slopes""")

# Walk-forward schedule: first rebalance at max(start, window), every 13 weeks. Without an evaluation
# start the first is at 52.
CTES["rebal"] = """
SELECT CAST(r AS INTEGER) AS r, CAST(least(r + 13, l) AS INTEGER) AS nxt FROM (
  SELECT unnest(generate_series(52, (SELECT max(t) FROM days) - 1, 13)) AS r, (SELECT max(t) FROM days) AS l)"""
CTES["rebal28"] = CTES["rebal"].replace("generate_series(52,", "generate_series(greatest(52, (SELECT t_start FROM bounds28)),")
ORACLES["rebalance_schedule"] = compose("SELECT r, nxt AS next FROM rebal")
CTES["asof_sums"] = "SELECT signal, r, t, sxx, sxy, names FROM sums JOIN rebal28 ON t + 4 <= r"
CTES["upto"] = """
SELECT signal, r, t, sxy - kappa * sxx AS u, kappa, total, observations FROM asof_sums JOIN (
  SELECT signal, r, sum(sxy) / sum(sxx) AS kappa, sum(sxx) AS total, CAST(sum(names) AS BIGINT) AS observations
  FROM asof_sums GROUP BY 1, 2 HAVING sum(sxx) > 0) USING (signal, r)"""
CTES["upto_idx"] = indexed("upto", "signal, r", "t", "u", "8")
CTES["upto_hac"] = hac("upto", "signal, r", "t", "u", "8")
ORACLES["slope_asof"] = compose(f"""
SELECT signal, r, {r('kappa', 'kappa')}, {r('sqrt(lrv * n) / total', 'se')},
  {r('CASE WHEN lrv > 0 THEN kappa / (sqrt(lrv * n) / total) ELSE 0.0 END', 't')}, n AS dates, observations
FROM upto_hac JOIN (SELECT DISTINCT signal, r, kappa, total, observations FROM upto) USING (signal, r) WHERE n >= 2""")

# Long-short ----------------------------------------------------------------------------------------

CTES["ls_days"] = "SELECT t FROM days, bounds28 WHERE t >= t_start AND t < least(t_end, (SELECT max(t) FROM days))"
CTES["legs"] = f"""
SELECT signal, t, ticker, k, next_return, CASE WHEN rn > n - k THEN 1.0 / k WHEN rn <= k THEN -1.0 / k END AS weight FROM (
  SELECT *, CAST(floor(n * (1.0::DOUBLE / 3.0::DOUBLE)) AS INTEGER) AS k FROM (
    SELECT v.signal, v.t, v.ticker, q.next_return, row_number() OVER (PARTITION BY v.signal, v.t ORDER BY v.value, v.ticker) AS rn,
           count(*) OVER (PARTITION BY v.signal, v.t) AS n
    FROM news_variants28 v JOIN rets q USING (ticker, t) JOIN ls_days USING (t)
    WHERE v.signal IN ('{L}', '{X}') AND q.next_return IS NOT NULL)) WHERE k >= 2"""
CTES["held"] = "SELECT * FROM legs WHERE weight IS NOT NULL"
ORACLES["long_short_weights"] = compose(f"SELECT signal, t, ticker, {r('weight', 'weight')} FROM held")
CTES["ls_grid"] = f"SELECT s.signal, d.t, k.ticker FROM (SELECT DISTINCT signal FROM held) s, ls_days d, (SELECT DISTINCT ticker FROM bars) k"
CTES["ls_book"] = """
SELECT signal, t, sum(w * coalesce(next_return, 0.0)) AS gross, CASE WHEN sum(abs(p)) > 0 THEN sum(abs(w - p)) END AS turnover, max(k) AS leg
FROM (SELECT g.signal, g.t, coalesce(h.weight, 0.0) AS w, h.next_return, h.k,
             coalesce(lag(coalesce(h.weight, 0.0)) OVER (PARTITION BY g.signal, g.ticker ORDER BY g.t), 0.0) AS p
      FROM ls_grid g LEFT JOIN held h ON h.signal = g.signal AND h.t = g.t AND h.ticker = g.ticker) GROUP BY 1, 2"""
ORACLES["long_short_daily"] = compose(f"SELECT signal, t, {r('gross', 'gross')}, {r('turnover', 'turnover')}, leg FROM ls_book")
CTES["ls_book_idx"] = indexed("ls_book", "signal", "t", "gross", "5")
CTES["ls_book_hac"] = hac("ls_book", "signal", "t", "gross", "5")
ORACLES["long_short_summary"] = compose(f"""
WITH s AS (SELECT signal, count(*) AS days, count(*) FILTER (gross <> 0) AS act, CAST(sum(leg) AS DOUBLE) AS legs, stddev_samp(gross) * sqrt(252.0) AS vol,
                  coalesce(avg(turnover), 0.0) AS avg_to, coalesce(sum(turnover), 0.0) / count(*) AS per_day FROM ls_book GROUP BY 1)
SELECT signal, {r('1.0::DOUBLE / 3.0::DOUBLE', 'leg_fraction')}, days, {r('legs / greatest(act, 1)', 'avg_names_per_leg')}, {r('mean', 'daily_gross')},
  {r('sqrt(lrv / n)', 'se')}, {r('mean / sqrt(lrv / n)', 't')}, {r('mean * 252.0', 'gross_annual_return')}, {r('vol', 'gross_annual_volatility')},
  {r('mean * 252.0 / vol', 'gross_sharpe')}, {r('avg_to', 'avg_daily_turnover')}, {r('mean / per_day * 1e4', 'break_even_cost_bps')},
  {r('bps', 'cost_bps')}, {r('(mean - bps / 1e4 * per_day) * 252.0', 'net_annual_return')},
  {r('(mean - bps / 1e4 * per_day) * 252.0 / vol', 'net_sharpe')}
FROM s JOIN ls_book_hac USING (signal), (SELECT unnest([10.0::DOUBLE, 25.0::DOUBLE, 50.0::DOUBLE]) AS bps) WHERE days >= 60 AND act >= 30""")

# Risk ----------------------------------------------------------------------------------------------

CTES["win"] = """
SELECT b.r, q.ticker, q.t, q.log_return AS ret FROM rebal b JOIN rets q ON q.t > b.r - 52 AND q.t <= b.r
WHERE q.log_return IS NOT NULL
QUALIFY count(*) OVER (PARTITION BY b.r, q.ticker) = 52"""
CTES["dem"] = "SELECT r, ticker, t, ret - avg(ret) OVER (PARTITION BY r, ticker) AS x FROM win"
CTES["samp"] = "SELECT a.r, a.ticker AS i, b.ticker AS j, sum(a.x * b.x) / 52.0 AS s FROM dem a JOIN dem b ON a.r = b.r AND a.t = b.t GROUP BY 1, 2, 3"
CTES["shrink"] = """
SELECT r, n, m, least(b2, d2) / d2 AS shrinkage FROM (
  SELECT r, max(n) AS n, max(m) AS m, sum(pow(s - CASE WHEN i = j THEN m ELSE 0.0 END, 2)) / max(n) AS d2 FROM (
    SELECT *, sqrt(count(*) OVER (PARTITION BY r)) AS n, sum(CASE WHEN i = j THEN s ELSE 0.0 END) OVER (PARTITION BY r) / sqrt(count(*) OVER (PARTITION BY r)) AS m FROM samp)
  GROUP BY r)
JOIN (SELECT a.r, sum(pow(a.x * b.x - s.s, 2)) / (sqrt(count(*) / 52.0) * 52.0 * 52.0) AS b2 FROM dem a JOIN dem b ON a.r = b.r AND a.t = b.t
      JOIN samp s ON s.r = a.r AND s.i = a.ticker AND s.j = b.ticker GROUP BY a.r) USING (r)"""
CTES["cov"] = """
SELECT r, i, j, ((CASE WHEN i = j THEN shrinkage * m ELSE 0.0 END) + (1.0 - shrinkage) * s) * 252.0 AS value FROM samp JOIN shrink USING (r)"""
CTES["vol"] = "SELECT r, i AS ticker, sqrt(value) AS volatility FROM cov WHERE i = j"
ORACLES["covariance"] = compose(f"SELECT r, i, j, {r('value', 'value')} FROM cov")
ORACLES["covariance_shrinkage"] = compose(
    f"SELECT r, {r('shrinkage', 'shrinkage')}, 52 AS observations, CAST(n AS BIGINT) AS names FROM shrink"
)
ORACLES["correlation"] = compose(f"""
SELECT c.r, c.i, c.j, {r('c.value / (a.volatility * b.volatility)', 'correlation')}
FROM cov c JOIN vol a ON a.r = c.r AND a.ticker = c.i JOIN vol b ON b.r = c.r AND b.ticker = c.j""")
CTES["prior"] = """
SELECT r, ticker, NOT ok AS cap_fallback, CASE WHEN ok THEN market_cap / total ELSE 1.0 / n END AS market_weight, n FROM (
  SELECT w.r, w.ticker, c.market_cap, count(c.market_cap) OVER g = count(*) OVER g AS ok, sum(c.market_cap) OVER g AS total, count(*) OVER g AS n
  FROM (SELECT DISTINCT r, ticker FROM win) w LEFT JOIN caps c ON c.ticker = w.ticker AND c.t = w.r WINDOW g AS (PARTITION BY w.r))"""
ORACLES["market_weights"] = compose(f"SELECT r, ticker, {r('market_weight', 'market_weight')}, cap_fallback FROM prior")
CTES["impl"] = "SELECT c.r, c.i AS ticker, 2.5 * sum(c.value * p.market_weight) AS pi FROM cov c JOIN prior p ON p.r = c.r AND p.ticker = c.j GROUP BY 1, 2"
ORACLES["implied_returns"] = compose(f"SELECT r, ticker, {r('pi', 'pi')} FROM impl")
CTES["simple"] = """
SELECT 'Market cap' AS strategy, r, ticker, market_weight AS weight FROM prior
UNION ALL SELECT 'Equal weight', r, ticker, 1.0 / n FROM prior"""
ORACLES["portfolio_stats"] = compose(f"""
WITH e AS (SELECT strategy, r, sum(weight * pi) AS ret FROM simple JOIN impl USING (r, ticker) GROUP BY 1, 2),
v AS (SELECT a.strategy, a.r, sqrt(greatest(sum(a.weight * c.value * b.weight), 0.0)) AS vol FROM simple a JOIN cov c ON c.r = a.r AND c.i = a.ticker
      JOIN simple b ON b.strategy = a.strategy AND b.r = a.r AND b.ticker = c.j GROUP BY 1, 2)
SELECT r, strategy, {r('ret', 'expected_return')}, {r('vol', 'volatility')}, {r('CASE WHEN vol > 0 THEN ret / vol ELSE 0.0 END', 'sharpe')}
FROM e JOIN v USING (strategy, r)""")

# Views ---------------------------------------------------------------------------------------------

BLEND = """
CASE WHEN ws + wf > 0 THEN (ws * coalesce(score, 0.0) + wf * coalesce(fscore, 0.0)) / (ws + wf) ELSE 0.0 END AS value,
least(ws + wf, 0.95) AS confidence"""
CTES["blend"] = f"""
SELECT ticker, t, {BLEND} FROM (
  SELECT n.ticker, n.t, n.score, f.fscore, 0.7 * n.confidence AS ws, CASE WHEN f.fscore IS NULL THEN 0.0 ELSE (1.0 - 0.7) * 0.35 * f.coverage END AS wf
  FROM news28 n LEFT JOIN fpanel f ON f.ticker = n.ticker AND f.t = n.t)"""
ORACLES["combined_signal"] = compose(f"SELECT ticker, t, {r('value', 'value')}, {r('confidence', 'confidence')} FROM blend")
CTES["vrows"] = """
SELECT i.r, i.ticker, i.pi, v.volatility, n.score, n.confidence AS news_confidence, n.dispersion, n.effective_count, f.fscore, f.coverage
FROM impl i JOIN vol v USING (r, ticker) LEFT JOIN news28 n ON n.ticker = i.ticker AND n.t = i.r LEFT JOIN fpanel f ON f.ticker = i.ticker AND f.t = i.r"""
ORACLES["heuristic_views"] = compose(f"""
WITH b AS (SELECT *, {BLEND} FROM (SELECT *, 0.7 * coalesce(news_confidence, 0.0) AS ws,
             CASE WHEN fscore IS NULL THEN 0.0 ELSE (1.0 - 0.7) * 0.35 * coverage END AS wf FROM vrows))
SELECT r, ticker, {r('pi + 0.25 * value * volatility', 'q')}, {r('0.05 * volatility * volatility * (1.0 - confidence) / confidence', 'omega')}
FROM b WHERE confidence >= 0.02""")
ORACLES["calibrated_views"] = compose(f"""
WITH x AS (SELECT *, score - avg(score) OVER g AS xs, fscore - avg(fscore) OVER g AS xf, pow(greatest(dispersion, 0.3), 2) / effective_count AS sv
           FROM vrows WINDOW g AS (PARTITION BY r)),
k AS (SELECT 0.5 * (1 - 1 / 6.25) AS ks, 0.2 * sqrt(1 - 1 / 6.25) AS ss, -0.4 * (1 - 1 / 2.56) AS kf, 0.25 * sqrt(1 - 1 / 2.56) AS sf),
a AS (SELECT *, coalesce(ks * xs, 0.0) + coalesce(kf * xf, 0.0) AS alpha,
             coalesce(pow(ss * xs, 2) + ks * ks * sv, 0.0) + coalesce(pow(sf * xf, 2), 0.0) AS var, xs IS NOT NULL OR xf IS NOT NULL AS used FROM x, k),
v AS (SELECT r, ticker, pi, volatility, CASE WHEN used THEN pi + volatility * alpha END AS q,
             CASE WHEN used THEN volatility * volatility * var + 1e-6 END AS omega FROM a)
SELECT r, ticker, {r('q', 'q')}, {r('omega', 'omega')}, {r('coalesce((q - pi) / volatility, 0.0)', 'value')},
  {r('coalesce(0.05 * volatility * volatility / (0.05 * volatility * volatility + omega), 0.0)', 'confidence')} FROM v""")

# Absolute views with independent errors enter one after the other, each as a rank-one update of mean and covariance.
CTES["bl_views"] = f"""
SELECT r, ticker, pi, confidence, CASE WHEN confidence >= 0.02 THEN pi + 0.25 * value * volatility END AS q,
  0.05 * volatility * volatility * (1.0 - confidence) / confidence AS omega,
  row_number() OVER (PARTITION BY r ORDER BY ticker) - 1 AS k, count(*) OVER (PARTITION BY r) AS n
FROM (SELECT *, {BLEND} FROM (SELECT *, 0.7 * coalesce(news_confidence, 0.0) AS ws, CASE WHEN fscore IS NULL THEN 0.0 ELSE (1.0 - 0.7) * 0.35 * coverage END AS wf FROM vrows))"""
CTES["bl_start"] = """
SELECT v.r, any_value(v.n) AS n, list(v.pi ORDER BY v.k) AS mu, any_value(c.s) AS s, list(v.q ORDER BY v.k) AS q, list(v.omega ORDER BY v.k) AS omega, list(v.ticker ORDER BY v.k) AS names
FROM bl_views v JOIN (
  SELECT a.r, list(0.05 * c.value ORDER BY a.k, b.k) AS s FROM bl_views a JOIN bl_views b ON b.r = a.r JOIN cov c ON c.r = a.r AND c.i = a.ticker AND c.j = b.ticker GROUP BY a.r
) c ON c.r = v.r GROUP BY v.r"""
ORACLES["bl_posterior"] = compose(f"""
WITH /*RECURSIVE*/u AS (
  SELECT r, 0::BIGINT AS k, n, mu, s, q, omega, names FROM bl_start
  UNION ALL
  SELECT r, k + 1, n,
    CASE WHEN q[k + 1] IS NULL THEN mu ELSE list_transform(mu, lambda m, i: m + s[(i - 1) * n + k + 1] * (q[k + 1] - mu[k + 1]) / (s[k * n + k + 1] + omega[k + 1])) END,
    CASE WHEN q[k + 1] IS NULL THEN s ELSE list_transform(s, lambda x, i: x - s[((i - 1) // n) * n + k + 1] * s[k * n + (i - 1) % n + 1] / (s[k * n + k + 1] + omega[k + 1])) END,
    q, omega, names
  FROM u WHERE k < n
)
SELECT r, unnest(names) AS ticker, round(unnest(mu), 6) + 0.0 AS mu FROM u WHERE k = n""")

# Portfolios: bisection by recursion for the projection, one asset per step for whole shares.
ORACLES["simplex_projection"] = compose(f"""
WITH p AS (SELECT s_nationkey AS portfolio, s_suppkey AS asset, s_acctbal / 10000.0 AS v,
                  greatest(0.3, 1.0 / count(*) OVER (PARTITION BY s_nationkey)) AS cap FROM supplier),
l AS (SELECT portfolio, list(v) AS vs, max(cap) AS cap FROM p GROUP BY portfolio),
/*RECURSIVE*/b AS (
  SELECT portfolio, vs, cap, list_min(vs) - cap AS lo, list_max(vs) AS hi, 0 AS step FROM l
  UNION ALL
  SELECT portfolio, vs, cap, CASE WHEN s > 1 THEN mid ELSE lo END, CASE WHEN s > 1 THEN hi ELSE mid END, step + 1
  FROM (SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(vs, lambda v: least(greatest(v - (lo + hi) / 2, 0.0), cap))) AS s FROM b WHERE step < 60))
SELECT p.portfolio, p.asset, {r('p.v', 'v', 11)}, {r('least(greatest(p.v - (b.lo + b.hi) / 2, 0.0), p.cap)', 'weight', 11)}
FROM p JOIN b ON b.portfolio = p.portfolio AND b.step = 60""")
CTES["orders_in"] = """
SELECT r, ticker, price, w, floor(w * 10000.0 / price) AS base, row_number() OVER (PARTITION BY r ORDER BY w * 10000.0 - floor(w * 10000.0 / price) * price DESC, ticker DESC) AS k
FROM (SELECT p.r, p.ticker, g.close / 100.0 AS price, p.market_weight / sum(p.market_weight) OVER (PARTITION BY p.r) AS w
      FROM prior p JOIN grid g ON g.ticker = p.ticker AND g.t = p.r)"""
ORACLES["share_rounding"] = compose(f"""
WITH /*RECURSIVE*/s AS (
  SELECT r, CAST(0 AS BIGINT) AS k, CAST('' AS VARCHAR) AS ticker, 0.0::DOUBLE AS shares, 10000.0::DOUBLE - sum(base * price) AS cash FROM orders_in GROUP BY r
  UNION ALL
  SELECT o.r, o.k, o.ticker, o.base + CASE WHEN o.w * 10000.0 - o.base * o.price > o.price / 2 AND o.price <= s.cash THEN 1 ELSE 0 END,
         s.cash - CASE WHEN o.w * 10000.0 - o.base * o.price > o.price / 2 AND o.price <= s.cash THEN o.price ELSE 0.0 END
  FROM s JOIN orders_in o ON o.r = s.r AND o.k = s.k + 1)
SELECT r, ticker, CAST(shares AS BIGINT) AS shares, {r('last_value(cash) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)', 'cash_left')}
FROM s QUALIFY k > 0""")

# Walk-forward: the book is carried day by day from its definition of drifting weights.
CTES["bt_days"] = "SELECT t, t - 53 AS idx FROM days WHERE t > 52"
CTES["bt_val"] = """
SELECT s.strategy, s.r, s.ticker, d.t, b.nxt, s.weight * product(1.0 + coalesce(q.simple_return, 0.0)) AS value
FROM simple s JOIN rebal b USING (r) JOIN days d ON d.t > s.r AND d.t <= b.nxt
JOIN rets q ON q.ticker = s.ticker AND q.t > s.r AND q.t <= d.t GROUP BY 1, 2, 3, 4, 5, s.weight"""
CTES["bt_book"] = "SELECT strategy, r, t, sum(value) AS v FROM bt_val GROUP BY 1, 2, 3"
CTES["bt_drift"] = "SELECT a.strategy, a.nxt AS r, a.ticker, a.value / b.v AS old FROM bt_val a JOIN bt_book b USING (strategy, r, t) WHERE a.t = a.nxt"
CTES["bt_turn"] = """
SELECT strategy, r, sum(abs(coalesce(n.weight, 0.0) - coalesce(o.old, 0.0))) AS turnover
FROM simple n FULL JOIN bt_drift o USING (strategy, r, ticker) WHERE r > 52 AND r IN (SELECT r FROM rebal) GROUP BY 1, 2"""
CTES["bt_ret"] = """
SELECT strategy, t, idx, gross, gross - coalesce(turnover * 10.0 / 1e4, 0.0) AS net FROM (
  SELECT strategy, r, t, v / coalesce(lag(v) OVER (PARTITION BY strategy, r ORDER BY t), 1.0) - 1.0 AS gross FROM bt_book)
JOIN bt_days USING (t) LEFT JOIN (SELECT strategy, r + 1 AS t, turnover FROM bt_turn) USING (strategy, t)"""
ORACLES["backtest_returns_capeq"] = compose(f"SELECT strategy, t, idx, {r('gross', 'gross')}, {r('net', 'net')} FROM bt_ret")
ORACLES["turnover"] = compose(f"SELECT strategy, r, {r('turnover', 'turnover')} FROM bt_turn")
CTES["bt_dd"] = """
SELECT strategy, least(min(e / greatest(p, 1.0) - 1.0), 0.0) AS max_drawdown FROM (
  SELECT strategy, t, e, max(e) OVER (PARTITION BY strategy ORDER BY t) AS p FROM (
    SELECT strategy, t, product(1.0 + net) OVER (PARTITION BY strategy ORDER BY t) AS e FROM bt_ret)) GROUP BY 1"""
ORACLES["drawdown"] = compose(f"SELECT strategy, {r('max_drawdown', 'max_drawdown')} FROM bt_dd")
ORACLES["strategy_stats"] = compose(f"""
WITH a AS (SELECT x.*, x.net - y.net AS act FROM bt_ret x JOIN bt_ret y ON y.t = x.t AND y.strategy = 'Market cap'),
s AS (SELECT strategy, count(*) AS days, avg(net) * 252.0 AS ret, stddev_samp(net) * sqrt(252.0) AS vol, avg(act) * 252.0 AS active, stddev_samp(act) * sqrt(252.0) AS te FROM a GROUP BY 1),
u AS (SELECT strategy, avg(turnover) AS avg_t, sum(turnover) AS sum_t FROM bt_turn GROUP BY 1)
SELECT strategy, days, {r('ret', 'annual_return')}, {r('vol', 'annual_volatility')}, {r('ret / vol', 'sharpe')}, {r('max_drawdown', 'max_drawdown')},
  {r('avg_t', 'avg_turnover')}, {r('sum_t * 10.0 / 1e4 / (days / 252.0)', 'annual_cost')}, {r('active', 'active_return')}, {r('te', 'tracking_error')},
  {r('CASE WHEN te > 0 THEN active / te ELSE 0.0 END', 'information_ratio')}
FROM s JOIN bt_dd USING (strategy) JOIN u USING (strategy)""")
U01 = "('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967296.0"
ORACLES["bootstrap_ci"] = compose(f"""
WITH x AS (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY t) - 1 AS idx, count(*) OVER (PARTITION BY ticker) AS n, simple_return
      FROM weekly WHERE simple_return IS NOT NULL),
n AS (SELECT DISTINCT n FROM x),
g AS (SELECT rep, i, n, (i = 0) OR ({U01.format("'42:' || rep || ':' || i || ':break'")}) < 0.1 AS brk,
             CAST(floor(({U01.format("'42:' || rep || ':' || i || ':start'")}) * n) AS BIGINT) AS s
      FROM (SELECT unnest(range(2000)) AS rep), n, LATERAL (SELECT unnest(range(n)) AS i)),
f AS (SELECT rep, i, n, last_value(CASE WHEN brk THEN s END IGNORE NULLS) OVER w AS s, last_value(CASE WHEN brk THEN i END IGNORE NULLS) OVER w AS at0
      FROM g WINDOW w AS (PARTITION BY n, rep ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT rep, n, (s + i - at0) % n AS idx FROM f),
d AS (SELECT ticker, rep, avg(simple_return) AS draw FROM p JOIN x USING (n, idx) GROUP BY 1, 2),
k AS (SELECT ticker, draw, row_number() OVER (PARTITION BY ticker ORDER BY draw, rep) - 1 AS k, count(*) OVER (PARTITION BY ticker) AS c FROM d)
SELECT ticker, {r('max(CASE WHEN k = CAST(round((c - 1) * 0.025) AS INTEGER) THEN draw END)', 'ci_low')},
  {r('max(CASE WHEN k = CAST(round((c - 1) * 0.975) AS INTEGER) THEN draw END)', 'ci_high')}, count(*) AS draws FROM k GROUP BY 1""")

# Texts ---------------------------------------------------------------------------------------------

# Legal suffixes, generic first words and entities, as alternatives and lists of SQL.
SUFFIXES = "incorporated|inc|corporation|corp|company|com|co|ltd|limited|plc|holdings|group|class a|class b|class c|the"
GENERIC = "'american','united','general','first','national','international','global','bank','energy','capital','financial','technologies','systems'"
CTES["companies"] = f"""
SELECT p_partkey, regexp_replace(trim(regexp_replace(lower(replace(replace(raw, ',', ' '), '.', ' ')), '\\s+', ' ', 'g')), '( ({SUFFIXES}))+$', '') AS n
FROM (SELECT p_partkey, p_name || CASE p_type WHEN 'ECONOMY' THEN ' Inc.' WHEN 'LARGE' THEN ' CORP' WHEN 'MEDIUM' THEN ' Inc. Class A'
        WHEN 'PROMO' THEN '.com, Inc.' WHEN 'SMALL' THEN ' Holdings Group plc' ELSE ' American Co' END AS raw FROM part)"""
ORACLES["company_names"] = compose(f"""
SELECT p_partkey, array_to_string(list_transform(string_split(n, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS clean,
  (CASE WHEN strlen(string_split(n, ' ')[1]) >= 4 AND string_split(n, ' ')[1] NOT IN ({GENERIC}) THEN string_split(n, ' ')[1] || '|' ELSE '' END)
   || n || '|amazon|aws' AS terms FROM companies""")
ORACLES["tickers_normalized"] = """
SELECT p_partkey, CASE WHEN p_type = p_brand THEN NULL ELSE upper(p_brand) || ',BRK-B,' || upper(p_type) END AS tickers FROM part"""
ORACLES["csv_dates"] = """
SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN d WHEN '2' THEN CASE WHEN o_orderkey % 2 = 0 THEN d ELSE d - 1 END WHEN '3' THEN d + 1 WHEN '4' THEN d + 1 END AS date
FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)"""
ORACLES["relevance"] = """
WITH h AS (SELECT doc_id, text, CASE lang WHEN 'en' THEN 'Of' WHEN 'fr' THEN 'La' WHEN 'de' THEN 'Der' ELSE 'El' END AS ticker FROM documents)
SELECT doc_id, ticker FROM h
WHERE list_contains(string_split_regex(text, '[^\\p{L}\\p{N}-]+'), ticker)
  OR (ticker = 'Of' AND contains(lower(text), 'american which'))
  OR (ticker = 'La' AND list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'dans'))
  OR (ticker = 'Der' AND list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'nicht'))
  OR (ticker = 'El' AND list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), 'para'))"""
ORACLES["title_keys"] = """
SELECT doc_id, md5(lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g'))) AS key,
  len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) >= 3 AS long_enough FROM documents"""
DECODE = "replace(replace(replace(replace(replace(replace({0}, '&amp;', '&'), '&#39;', ''''), '&apos;', ''''), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>')"
ORACLES["page_titles"] = f"""
SELECT page_id, {DECODE.format('raw')} AS title,
  {DECODE.format("CASE WHEN src <> '' THEN regexp_replace(regexp_replace(rtrim(left(raw, length(raw) - length(src))), '[-|–]+$', ''), '\\s+$', '') ELSE raw END")} AS stripped
FROM (SELECT *, regexp_extract(raw, '(\\S+)$', 1) AS src FROM (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS raw FROM pages))"""
# Documents -----------------------------------------------------------------------------------------

CTES["chart_lines"] = """
SELECT 'P' || p_partkey AS ticker, p_name, p_type, p_retailprice, p_size, l_orderkey, l_linenumber, l_quantity,
  epoch(l_shipdate)::BIGINT + l_linenumber * 5400 AS ts, epoch(l_shipdate)::BIGINT AS day_ts,
  CASE WHEN p_size % 4 <> 0 THEN (p_size % 25 - 12) * 3600 ELSE 0 END AS off,
  CASE WHEN p_size % 2 = 0 THEN CASE WHEN l_linenumber <> 3 THEN l_extendedprice / l_quantity * (1 - l_discount) END
       WHEN l_linenumber = 1 AND l_returnflag = 'R' THEN NULL
       WHEN l_linenumber = 2 THEN -1 ELSE l_extendedprice / l_quantity END AS px
FROM lineitem JOIN part ON l_partkey = p_partkey"""
CTES["chart_closes"] = """
SELECT ticker, CAST(make_timestamp((ts + off) * 1000000) AS DATE) AS date, arg_max(px, {'a': ts, 'b': l_orderkey, 'c': l_linenumber}) AS close
FROM chart_lines WHERE p_size NOT IN (48, 49) AND px > 0 GROUP BY 1, 2"""
ORACLES["chart_prices"] = compose(f"SELECT ticker, date, {r('close', 'close', 9)} FROM chart_closes")
ORACLES["chart_splits"] = compose(f"""
SELECT ticker, CAST(make_timestamp((day_ts + off) * 1000000) AS DATE) AS date, {r('l_linenumber / (l_quantity - 45)', 'ratio')}
FROM chart_lines WHERE p_size NOT IN (48, 49) AND l_quantity > 45""")
ORACLES["chart_instruments"] = compose(f"""
SELECT ticker, CASE WHEN p_size % 3 <> 0 THEN p_name ELSE p_type END AS name, 'USD' AS currency,
  {r('CASE WHEN p_size % 5 = 0 THEN p_retailprice ELSE last END', 'last_price')}
FROM (SELECT DISTINCT ticker, p_name, p_type, p_size, p_retailprice FROM chart_lines)
  JOIN (SELECT ticker, arg_max(close, date) AS last FROM chart_closes GROUP BY ticker) USING (ticker)""")
ORACLES["chart_failures"] = compose("""
SELECT DISTINCT ticker, CASE p_size WHEN 48 THEN 'malformed document' ELSE '{"code":"Not Found"}' END AS reason FROM chart_lines WHERE p_size IN (48, 49)""")
ORACLES["filing_facts"] = f"""
WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS d, regexp_replace(o_orderpriority, '[^A-Z]', '', 'g') AS priority FROM orders), f AS (
  SELECT o_custkey, o_orderkey, 'us-gaap' AS taxonomy, priority AS tag, 'USD' AS unit, d - 90 AS start, d AS until, o_totalprice AS val,
    CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' END AS form, d + 30 AS filed FROM o
  UNION ALL
  SELECT o_custkey, o_orderkey, 'dei', CASE WHEN o_orderkey % 2 = 0 THEN 'URGENT' ELSE 'Shares' END, 'shares', NULL, d, o_orderkey, '10-K', d FROM o WHERE o_orderkey % 5 = 0
), p AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey, taxonomy, tag ORDER BY o_orderkey) - 1 AS INTEGER) AS pos FROM f
)
SELECT lpad(o_custkey::VARCHAR, 10, '0') AS cik, taxonomy, tag, unit, pos, start, until, {r('val', 'val')}, form, filed
FROM p WHERE form IS NOT NULL AND (taxonomy, tag) IN (('us-gaap', 'URGENT'), ('us-gaap', 'HIGH'), ('dei', 'Shares'))"""
ORACLES["filing_entities"] = "SELECT DISTINCT lpad(o_custkey::VARCHAR, 10, '0') AS cik, 'Customer ' || o_custkey AS entity_name FROM orders"
ORACLES["ticker_lookup"] = """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'UNLISTED' ELSE upper(replace(c_name, '#', '-')) END AS ticker,
  CASE WHEN c_custkey % 4 <> 0 THEN lpad(c_custkey::VARCHAR, 10, '0') END AS cik FROM customer"""
ORACLES["share_frame_entries"] = f"""
SELECT o_orderkey // 50 AS frame, o_custkey AS cik, CAST(o_orderdate AS DATE) AS until,
  {r('CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END', 'val')},
  CAST(row_number() OVER (PARTITION BY o_orderkey // 50 ORDER BY o_orderkey) - 1 AS INTEGER) AS pos FROM orders"""
FEED_TITLE = "regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
ORACLES["feed_items"] = f"""
WITH d AS (
  SELECT doc_id, doc_id % 10 AS kind, CASE WHEN doc_id % 10 >= 3 THEN source END AS src, {FEED_TITLE} AS t,
    row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) - 1 AS pos,
    make_timestamp(2021, doc_id % 12 + 1, doc_id % 28 + 1, doc_id % 24, 30, 0) AS stamp
  FROM documents WHERE text IS NOT NULL
), c AS (
  SELECT *, CASE WHEN src IS NULL THEN t ELSE regexp_replace(regexp_replace(t || ' -', '[-|–]+$', ''), '\\s+$', '') END AS cut FROM d WHERE kind NOT IN (7, 8)
)
SELECT 'F' || (doc_id // 50) AS ticker, pos, md5({DECODE.format("cut")}) AS title_md5,
  'https://news.test/' || doc_id AS url, coalesce(src, 'Wire') AS source,
  stamp + CASE kind WHEN 5 THEN INTERVAL 5 HOUR WHEN 6 THEN INTERVAL (-90) MINUTE ELSE INTERVAL 0 HOUR END AS published
FROM c WHERE len(list_filter(string_split_regex(cut, '\\s+'), lambda w: w <> '')) >= 3
"""
ORACLES["headlines_dedup_topk"] = """
WITH f AS (
  SELECT source AS ticker, text AS title, TIMESTAMP '2024-01-10' - to_minutes(CAST(doc_id * 37 % 20160 AS INTEGER)) AS published, doc_id AS pos, 0 AS feed_rank FROM documents
  UNION ALL
  SELECT 'src' || CAST(conv_id % 20 AS VARCHAR), text, TIMESTAMP '2024-01-10' - to_minutes(CAST(conv_id * 37 % 20160 AS INTEGER)), conv_id * 1000 + turn, 1 FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY ticker, lower(regexp_replace(title, '[^\\p{L}\\p{N}]', '', 'g')) ORDER BY feed_rank, pos) AS c
      FROM f WHERE published >= TIMESTAMP '2024-01-10' - INTERVAL 7 DAY)
SELECT ticker, feed_rank, pos, md5(title) AS title_md5 FROM k WHERE c = 1
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY published DESC, feed_rank, pos) <= 5"""
# Ordered fold over weeks carrying the titles already taken.
ORACLES["headlines_week_cap"] = """
WITH RECURSIVE h AS (
  SELECT p_brand AS ticker, p_name AS title, CAST(DATE '2024-01-01' + CAST(p_size * 3 AS INTEGER) AS DATE) AS date, p_partkey AS pos,
         lower(regexp_replace(p_name, '[^\\p{L}\\p{N}]', '', 'g')) AS key FROM part),
u AS (SELECT ticker, CAST(date_trunc('week', date) AS DATE) AS wk, key, min(pos) AS pos FROM h GROUP BY ALL),
w AS (SELECT ticker, wk, list(key ORDER BY pos) AS keys FROM u GROUP BY ALL),
g AS (SELECT k.ticker, CAST((a.wk - (SELECT min(wk) FROM w)) / 7 AS INTEGER) AS n, a.wk, coalesce(w.keys, []) AS keys
      FROM (SELECT DISTINCT ticker FROM w) k CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(wk) FROM w), (SELECT max(wk) FROM w), INTERVAL 7 DAY)) AS DATE) AS wk) a
      LEFT JOIN w ON w.ticker = k.ticker AND w.wk = a.wk),
s AS (SELECT ticker, -1 AS n, CAST(NULL AS DATE) AS wk, CAST([] AS VARCHAR[]) AS seen, CAST([] AS VARCHAR[]) AS took FROM (SELECT DISTINCT ticker FROM w)
      UNION ALL
      SELECT s.ticker, g.n, g.wk, list_concat(s.seen, list_filter(g.keys, lambda x: NOT list_contains(s.seen, x))[1:2]),
             list_filter(g.keys, lambda x: NOT list_contains(s.seen, x))[1:2]
      FROM s JOIN g ON g.ticker = s.ticker AND g.n = s.n + 1),
t AS (SELECT ticker, wk, unnest(took) AS key FROM s)
SELECT h.ticker, h.date, h.pos, h.title FROM t JOIN u USING (ticker, wk, key) JOIN h ON h.ticker = u.ticker AND h.pos = u.pos"""
ORACLES["archive_headlines"] = ORACLES["headlines_week_cap"].replace(
    "SELECT p_brand AS ticker, p_name AS title,", "SELECT * FROM (SELECT p_brand AS ticker, p_name || ' ' || lower(p_type) AS title,"
).replace("lower(regexp_replace(p_name, ", "lower(regexp_replace(p_name || ' ' || lower(p_type), ").replace(
    "AS key FROM part)",
    "AS key FROM part) WHERE date >= DATE '2024-01-15' AND date_trunc('week', date) < DATE '2024-05-02' AND list_contains(string_split(title, ' '), 'gear'))",
)
ORACLES["week_windows"] = compose("""
SELECT a, CAST(a + 7 AS DATE) AS b, count(h.date) AS headlines
FROM (SELECT CAST(unnest(generate_series(DATE '1995-05-29', DATE '2001-05-31', INTERVAL 7 DAY)) AS DATE) AS a) s
LEFT JOIN heads h ON h.date >= s.a AND h.date < s.a + 7 GROUP BY a""")

# Scores --------------------------------------------------------------------------------------------

CTES["store"] = """
SELECT text, p.q * 0.75 AS positive, p.t * 0.25 AS negative, 1.0 - p.q * 0.75 - p.t * 0.25 AS neutral FROM (
  SELECT text, arg_max({'q': quality, 't': toxic}, doc_id) AS p FROM documents JOIN labels USING (doc_id) GROUP BY text)"""
ORACLES["scores_missing"] = compose("SELECT DISTINCT md5(text) AS text_md5 FROM documents WHERE text NOT IN (SELECT text FROM store)")
ORACLES["scores_lookup"] = compose(f"""
SELECT doc_id, {r('coalesce(positive, 0.0)', 'positive')}, {r('coalesce(negative, 0.0)', 'negative')}, {r('coalesce(neutral, 0.0)', 'neutral')}
FROM documents LEFT JOIN store USING (text)""")


def words(positive: str, negative: str, prior: float) -> str:
    return f"""
SELECT text, p / (p + q + {prior}) AS positive, q / (p + q + {prior}) AS negative, {prior} / (p + q + {prior}) AS neutral FROM (
  SELECT text, CAST(len(list_filter(w, lambda x: x IN ({positive}))) AS DOUBLE) AS p, CAST(len(list_filter(w, lambda x: x IN ({negative}))) AS DOUBLE) AS q
  FROM (SELECT text, string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+') AS w FROM (SELECT DISTINCT text FROM documents)))"""


W1 = ("'the','and','la','der','que'", "'of','to','de','die','el'")
W2 = ("'the','in','la','das','en'", "'of','is','le','und','los'")
CTES["lex_ref"] = words(*W1, 1.0)
CTES["lex_smooth"] = words(*W1, 20.0)
CTES["lex_other"] = words(*W2, 1.0)
ORACLES["scores_memoised"] = compose(f"""
SELECT d.doc_id, {r('coalesce(s.positive, l.positive)', 'positive')}, {r('coalesce(s.negative, l.negative)', 'negative')},
  {r('coalesce(s.neutral, l.neutral)', 'neutral')}
FROM documents d LEFT JOIN store s ON s.text = d.text JOIN lex_ref l ON l.text = d.text""")
ORACLES["model_scores"] = f"""
WITH w AS (SELECT text, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
l AS (SELECT text, exp(0.3::DOUBLE * len(list_filter(w, lambda x: x IN ({W1[0]})))) AS p, exp(0.2::DOUBLE * len(list_filter(w, lambda x: x IN ({W1[1]})))) AS q, exp(0.01::DOUBLE * len(w)) AS u FROM w)
SELECT md5(text) AS text_md5, {r('p / (p + q + u)', 'positive')}, {r('q / (p + q + u)', 'negative')}, {r('u / (p + q + u)', 'neutral')} FROM l"""
CTES["landed"] = """
SELECT event_type AS ticker, ts AS published, value / 100.0 - user_id / 1000.0 AS s, event_id % 40 = 0 AS late FROM events"""
# A batch drops rows whose window was final before the batch ahead of it.
CTES["marks"] = """
SELECT max(published) FILTER (NOT late AND published < TIMESTAMP '2024-01-11') - INTERVAL 3 DAY AS old, max(published) - INTERVAL 3 DAY AS final FROM landed"""
ORACLES["stream_closed_weeks"] = compose(f"""
SELECT ticker, CAST(a AS DATE) AS a, count(*) AS headlines, {r('avg(s)', 'score', 9)} FROM (
  SELECT *, date_trunc('week', published) AS a FROM landed), marks
WHERE (NOT late OR a + INTERVAL 7 DAY > old) AND a + INTERVAL 7 DAY <= final GROUP BY ALL""")
ORACLES["stream_sliding_news"] = compose(f"""
SELECT ticker, CAST(e AS DATE) AS as_of, count(*) AS headlines, {r('avg(s)', 'score', 9)} FROM (
  SELECT *, unnest(generate_series(date_trunc('day', published) + INTERVAL 1 DAY, date_trunc('day', published) + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS e FROM landed), marks
WHERE (NOT late OR e > old) AND e <= final GROUP BY ALL""")
LAST = "CASE WHEN {0}.neutral >= {0}.positive AND {0}.neutral >= {0}.negative THEN 2 WHEN {0}.negative >= {0}.positive THEN 1 ELSE 0 END"
ORACLES["model_agreement"] = compose(f"""
WITH m AS (SELECT 'reference' AS model, * FROM lex_ref UNION ALL SELECT 'smooth', * FROM lex_smooth UNION ALL SELECT 'other', * FROM lex_other),
d AS (SELECT v.model, b.positive - b.negative AS a, v.positive - v.negative AS s, abs((b.positive - b.negative) - (v.positive - v.negative)) AS diff,
             CASE WHEN ({LAST.format('b')}) = ({LAST.format('v')}) THEN 1.0 ELSE 0.0 END AS same FROM m v JOIN lex_ref b USING (text)),
k AS (SELECT model, diff, row_number() OVER (PARTITION BY model ORDER BY diff) - 1 AS k, count(*) OVER (PARTITION BY model) AS n FROM d)
SELECT model, count(*) AS texts, {r('avg(same)', 'label_agreement')}, {r('avg(diff)', 'mean_abs_score_diff')}, {r('max(diff)', 'max_abs_score_diff')},
  {r('covar_pop(a, s) / sqrt(var_pop(a) * var_pop(s))', 'score_correlation')},
  {r('(SELECT max(k.diff) FROM k WHERE k.model = d.model AND k.k = CAST(floor((k.n - 1) * 0.99) AS BIGINT))', 'p99_abs_score_diff')}
FROM d GROUP BY model""")
ORACLES["text_sample"] = f"""
SELECT md5(text) AS text_md5, {r(U01.format('text'), 'u', 9)} FROM (SELECT DISTINCT text FROM documents) ORDER BY {U01.format('text')}, text LIMIT 50"""

# Universe ------------------------------------------------------------------------------------------

CTES["listed"] = """
SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, s_suppkey, s_acctbal * 100.0 AS val,
       array_to_string(list_transform([456976, 17576, 676, 26, 1], lambda step: chr(CAST(65 + s_suppkey // step % 26 AS INTEGER))), '') AS ticker
FROM supplier"""
ORACLES["shortest_ticker"] = compose("SELECT cik, ticker FROM listed")
CTES["screened"] = """
SELECT l.ticker, l.cik, CASE WHEN DATE '1999-07-01' - p.last <= 7 THEN p.close * l.val END AS cap,
       coalesce(DATE '1999-07-01' - p.last <= 7 AND p.close * l.val BETWEEN 5e7 AND 3e9 AND p.history >= 300, false) AS eligible
FROM (SELECT * FROM listed WHERE val > 0 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY s_suppkey) = 1) l LEFT JOIN (
  SELECT l_suppkey, max(d) AS last, arg_max(close, d) AS close, count(*) FILTER (d < DATE '1999-07-01') AS history FROM (
    SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, avg(l_extendedprice / l_quantity) AS close FROM lineitem GROUP BY 1, 2)
  WHERE d <= DATE '1999-07-01' GROUP BY 1) p ON p.l_suppkey = l.s_suppkey"""
ORACLES["universe_screen"] = compose(f"SELECT ticker, cik, {r('cap / 1e6', 'cap', 4)}, eligible FROM screened")
CTES["drawn"] = f"""
SELECT row_number() OVER (ORDER BY u, ticker) AS position, ticker, cap, u FROM (
  SELECT ticker, cap, {U01.format("'1:' || ticker")} AS u FROM screened WHERE eligible) ORDER BY u, ticker LIMIT 10"""
ORACLES["universe_sample"] = compose(f"SELECT CAST(position AS INTEGER) AS position, ticker, {r('cap / 1e6', 'cap', 4)} FROM drawn")
ORACLES["universe_summary"] = compose(f"""
SELECT DATE '1999-07-01' AS as_of, 1 AS seed, 'CY1999Q1I' AS share_frame, (SELECT count(*) FROM screened) AS candidates,
  (SELECT count(*) FROM screened WHERE (SELECT count(*) FROM drawn) < 10 OR {U01.format("'1:' || ticker")} <= (SELECT max(u) FROM drawn)) AS screened,
  (SELECT count(*) FROM drawn) AS kept, (SELECT count(*) FROM drawn) = 10 AS filled""")
CTES["screen_splits"] = """
SELECT l.ticker, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_discount >= 0.05 THEN 2.0 ELSE 0.5 END::DOUBLE AS ratio
FROM lineitem JOIN listed l ON l.s_suppkey = l_suppkey WHERE l_quantity = 50 AND l_linenumber = 1"""
CTES["split_caps"] = """
SELECT s.ticker, s.cik, s.cap * coalesce((SELECT product(x.ratio) FROM screen_splits x WHERE x.ticker = s.ticker AND x.date > DATE '1999-03-31'), 1.0) AS cap, s.history
FROM (SELECT l.ticker, l.cik, CASE WHEN DATE '1999-07-01' - p.last <= 7 THEN p.close * l.val END AS cap, CASE WHEN DATE '1999-07-01' - p.last <= 7 THEN p.history END AS history
  FROM listed l LEFT JOIN (
    SELECT l_suppkey, max(d) AS last, arg_max(close, d) AS close, count(*) FILTER (d < DATE '1999-07-01') AS history FROM (
      SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, avg(l_extendedprice / l_quantity) AS close FROM lineitem GROUP BY 1, 2)
    WHERE d <= DATE '1999-07-01' GROUP BY 1) p ON p.l_suppkey = l.s_suppkey WHERE l.val > 0) s"""
ORACLES["universe_screen_splits"] = compose(f"""
SELECT ticker, cik, {r('cap / 1e6', 'cap', 4)}, coalesce(cap BETWEEN 5e7 AND 3e9 AND history >= 300, false) AS eligible FROM split_caps""")
ORACLES["universe_draw_splits"] = compose(f"""
WITH e AS (SELECT ticker, cap, coalesce(cap BETWEEN 2e7 AND 2e9 AND history >= 300, false) AS eligible, {U01.format("'3:' || ticker")} AS u FROM split_caps),
d AS (SELECT * FROM e WHERE eligible ORDER BY u, ticker LIMIT 8)
SELECT DATE '1999-07-01' AS as_of, 3 AS seed, 'CY1999Q1I' AS share_frame, (SELECT count(*) FROM e) AS candidates,
  (SELECT count(*) FROM e WHERE (SELECT count(*) FROM d) < 8 OR u <= (SELECT max(u) FROM d)) AS screened, (SELECT count(*) FROM d) AS kept, (SELECT count(*) FROM d) = 8 AS filled,
  2e7::DOUBLE AS min_cap, 2e9::DOUBLE AS max_cap, {r('(SELECT sum(cap / 1e6) FROM d)', 'caps', 3)}""")
ORACLES["share_frames"] = """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS as_of FROM orders),
q AS (SELECT CAST(unnest(generate_series(DATE '1993-01-01', DATE '2003-01-01', INTERVAL 3 MONTH)) AS DATE) AS s),
e AS (SELECT as_of, max(CAST(s + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)) AS last FROM d JOIN q ON CAST(s + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) <= as_of - 90 GROUP BY 1)
SELECT as_of, 'CY' || year(last) || 'Q' || quarter(last) || 'I' AS share_frame FROM e"""


# Analysis: one run per region, brands as tickers, on the last order day. ---------------------------

CTES["today"] = "SELECT CAST(max(o_orderdate) AS DATE) AS today FROM orders"
CTES["a_prices"] = """
SELECT f.region AS run, b.ticker, b.date, b.px_sum / b.px_count AS close FROM bars b JOIN filers f USING (ticker), today
WHERE b.date >= today - 365 AND b.date <= today"""
CTES["a_rets"] = """
SELECT run, ticker, date, ln(close / lag(close) OVER (PARTITION BY run, ticker ORDER BY date)) AS ret FROM a_prices
WHERE (run, date) IN (SELECT (run, date) FROM a_prices JOIN (SELECT run, count(DISTINCT ticker) AS n FROM a_prices GROUP BY run) USING (run)
                      GROUP BY run, date HAVING count(*) = max(n))"""
CTES["a_dem"] = "SELECT run, ticker, date, ret - avg(ret) OVER (PARTITION BY run, ticker) AS x FROM a_rets WHERE ret IS NOT NULL"
CTES["a_samp"] = """
SELECT a.run, a.ticker AS i, b.ticker AS j, sum(a.x * b.x) / count(*) AS s, count(*) AS t FROM a_dem a JOIN a_dem b ON a.run = b.run AND a.date = b.date GROUP BY 1, 2, 3"""
CTES["a_target"] = "SELECT run, sum(CASE WHEN i = j THEN s ELSE 0.0 END) / sqrt(count(*)) AS m, sqrt(count(*)) AS n, max(t) AS t FROM a_samp GROUP BY run HAVING max(t) >= 30"
CTES["a_shrink"] = """
SELECT run, n, t, m, least(b2, d2) / d2 AS shrinkage FROM a_target
JOIN (SELECT run, sum(pow(s - CASE WHEN i = j THEN m ELSE 0.0 END, 2)) / max(n) AS d2 FROM a_samp JOIN a_target USING (run) GROUP BY run) USING (run)
JOIN (SELECT a.run, sum(pow(a.x * b.x - s.s, 2)) AS q FROM a_dem a JOIN a_dem b ON a.run = b.run AND a.date = b.date
      JOIN a_samp s ON s.run = a.run AND s.i = a.ticker AND s.j = b.ticker GROUP BY a.run) USING (run),
LATERAL (SELECT q / (n * t * t) AS b2)"""
CTES["a_cov"] = """
SELECT run, i, j, ((CASE WHEN i = j THEN shrinkage * m ELSE 0.0 END) + (1.0 - shrinkage) * s) * 252.0 AS value FROM a_samp JOIN a_shrink USING (run)"""
ORACLES["analysis_risk"] = compose(
    f"SELECT run, {r('shrinkage', 'shrinkage')}, t AS observations, CAST(n AS BIGINT) AS names FROM a_shrink"
)
CTES["today_asof"] = "SELECT cik, today AS as_of FROM filers, today"
known("ft", "today_asof", False)
CTES["a_assets"] = """
SELECT run, ticker, name, price, fscore, coverage, cap, count(cap) OVER g = count(*) OVER g AS ok, cap / sum(cap) OVER g AS share, 1.0 / count(*) OVER g AS flat FROM (
  SELECT p.run, p.ticker, f.n_name AS name, p.price, k.fscore, k.coverage, p.price * k.shares * coalesce(product(s.ratio), 1.0) AS cap
  FROM (SELECT run, ticker, arg_max(close, date) / 100.0 AS price FROM a_prices GROUP BY 1, 2) p JOIN filers f USING (ticker)
  LEFT JOIN ft_score k ON k.cik = f.cik LEFT JOIN splits s ON s.ticker = p.ticker AND s.date > k.shares_as_of
  GROUP BY p.run, p.ticker, f.n_name, p.price, k.fscore, k.coverage, k.shares)
WINDOW g AS (PARTITION BY run)"""
CTES["a_heads"] = """
SELECT ticker, CAST(today - date AS DOUBLE) AS age, positive, negative, neutral FROM (
  SELECT 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS date, o_orderkey,
         o_totalprice / 500000.0 AS positive, 0.5 - o_totalprice / 1000000.0 AS negative,
         1.0 - o_totalprice / 500000.0 - (0.5 - o_totalprice / 1000000.0) AS neutral, today
  FROM orders, today WHERE o_orderdate >= today - 7)
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC, o_orderkey) <= 40"""
CTES["a_news"] = summary("a_heads", "ticker")
CTES["a_rows"] = """
SELECT a.*, CASE WHEN a.ok THEN a.share ELSE a.flat END AS market_weight, sqrt(v.value) AS volatility, coalesce(n.score, 0.0) AS score,
  coalesce(n.confidence, 0.0) AS news_confidence, coalesce(n.headlines, 0) AS headlines, n.dispersion, n.effective_count, p.pi
FROM a_assets a JOIN a_cov v ON v.run = a.run AND v.i = a.ticker AND v.j = a.ticker LEFT JOIN a_news n ON n.ticker = a.ticker
JOIN (SELECT c.run, c.i AS ticker, 2.5 * sum(c.value * CASE WHEN b.ok THEN b.share ELSE b.flat END) AS pi
      FROM a_cov c JOIN a_assets b ON b.run = c.run AND b.ticker = c.j GROUP BY 1, 2) p ON p.run = a.run AND p.ticker = a.ticker"""
A_COLUMNS = "run, ticker, name, " + ", ".join(
    r(c, c) for c in ("price", "market_weight", "volatility", "score", "news_confidence", "fscore", "value", "confidence", "pi", "q", "omega")
) + ", headlines"
ORACLES["analysis_signals"] = compose(f"""
WITH b AS (SELECT *, {BLEND} FROM (SELECT *, 0.7 * news_confidence AS ws, CASE WHEN fscore IS NULL THEN 0.0 ELSE (1.0 - 0.7) * 0.35 * coverage END AS wf FROM a_rows)),
v AS (SELECT *, CASE WHEN confidence >= 0.02 THEN pi + 0.25 * value * volatility END AS q,
             CASE WHEN confidence >= 0.02 THEN 0.05 * volatility * volatility * (1.0 - confidence) / confidence END AS omega FROM b)
SELECT {A_COLUMNS}, 'heuristic' AS view_mode FROM v""")
ORACLES["analysis_signals_calibrated"] = compose(f"""
WITH x AS (SELECT *, s0 - avg(s0) OVER g AS xs, fscore - avg(fscore) OVER g AS xf, pow(greatest(dispersion, 0.3), 2) / effective_count AS sv
           FROM (SELECT *, CASE WHEN headlines >= 1 THEN score END AS s0 FROM a_rows) WINDOW g AS (PARTITION BY run)),
k AS (SELECT 0.5 * (1 - 1 / 6.25) AS ks, 0.2 * sqrt(1 - 1 / 6.25) AS ss, 0.3 * (1 - 1 / 9.0) AS kf, 0.1 * sqrt(1 - 1 / 9.0) AS sf),
a AS (SELECT *, coalesce(ks * xs, 0.0) + coalesce(kf * xf, 0.0) AS alpha,
             coalesce(pow(ss * xs, 2) + ks * ks * sv, 0.0) + coalesce(pow(sf * xf, 2), 0.0) AS var, xs IS NOT NULL OR xf IS NOT NULL AS used FROM x, k),
q AS (SELECT *, CASE WHEN used THEN pi + volatility * alpha END AS q, CASE WHEN used THEN volatility * volatility * var + 1e-6 END AS omega FROM a),
v AS (SELECT *, coalesce((q - pi) / volatility, 0.0) AS value,
             coalesce(0.05 * volatility * volatility / (0.05 * volatility * volatility + omega), 0.0) AS confidence FROM q)
SELECT {A_COLUMNS}, 'calibrated' AS view_mode FROM v""")
ORACLES["analysis_facts"] = compose(f"""
SELECT a.run, a.ticker, coalesce(n.headlines, 0) AS headlines, coalesce(n.positive, 0) AS positive, coalesce(n.negative, 0) AS negative, coalesce(n.neutral, 0) AS neutral,
  {r('coalesce(n.effective_count, 0.0)', 'effective_count')}, {r('k.revenue_growth', 'revenue_growth')}, {r('k.net_margin', 'net_margin')}, {r('k.debt_to_equity', 'debt_to_equity')},
  k.shares_as_of, k.fiscal_year_end
FROM a_rows a LEFT JOIN a_news n USING (ticker) JOIN filers f ON f.ticker = a.ticker LEFT JOIN ft_score k ON k.cik = f.cik""")
ORACLES["analysis_books"] = compose(f"""
SELECT run, 'Market-cap prior' AS portfolio, ticker, {r('market_weight', 'weight')} FROM a_rows
UNION ALL SELECT run, 'Equal weight', ticker, {r('1.0 / count(*) OVER (PARTITION BY run)', 'weight')} FROM a_rows""")

# Requests with settings of their own: the tables above, as each run sees them.
CTES["knobs"] = """
SELECT r_regionkey AS run, 5000.0::DOUBLE * (r_regionkey + 1) AS budget, 0.3::DOUBLE + 0.1::DOUBLE * r_regionkey AS max_weight,
  CAST(300 + 200 * r_regionkey AS INTEGER) AS lookback, CAST(5 + 4 * r_regionkey AS INTEGER) AS news, 30 - 6 * r_regionkey AS most,
  2.0::DOUBLE + 0.5::DOUBLE * r_regionkey AS risk, 0.02::DOUBLE + 0.02::DOUBLE * r_regionkey AS tau, 0.1::DOUBLE + 0.2::DOUBLE * r_regionkey AS scale,
  0.9::DOUBLE - 0.15::DOUBLE * r_regionkey AS share, r_regionkey % 2 = 0 AS heuristic
FROM region WHERE r_regionkey <> 3"""
for _name in ("rets", "dem", "samp", "target", "shrink", "cov", "assets", "rows"):
    CTES[f"q_{_name}"] = re.sub(r"\ba_(?=[a-z])", "q_", CTES[f"a_{_name}"])
CTES["q_prices"] = CTES["a_prices"].replace(", today\nWHERE b.date >= today - 365", " JOIN knobs k ON k.run = f.region, today\nWHERE b.date >= today - k.lookback")
CTES["q_heads"] = """
SELECT run, ticker, CAST(today - date AS DOUBLE) AS age, positive, negative, neutral FROM (
  SELECT k.run, k.most, f.ticker, CAST(o_orderdate AS DATE) AS date, o_orderkey, today,
         o_totalprice / 500000.0 AS positive, 0.5 - o_totalprice / 1000000.0 AS negative,
         1.0 - o_totalprice / 500000.0 - (0.5 - o_totalprice / 1000000.0) AS neutral
  FROM orders JOIN filers f ON f.ticker = 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) JOIN knobs k ON k.run = f.region, today WHERE o_orderdate >= today - k.news)
QUALIFY row_number() OVER (PARTITION BY run, ticker ORDER BY date DESC, o_orderkey) <= most"""
CTES["q_news"] = summary("q_heads", "run, ticker")
CTES["q_rows"] = CTES["q_rows"].replace("2.5 * sum(", "max(k.risk) * sum(").replace("FROM q_cov c JOIN q_assets b", "FROM q_cov c JOIN knobs k ON k.run = c.run JOIN q_assets b")
ORACLES["analysis_requests"] = compose(f"""
WITH b AS (SELECT *, {BLEND} FROM (SELECT q.*, k.tau, k.scale, k.budget, k.max_weight, k.heuristic, k.share * news_confidence AS ws, CASE WHEN fscore IS NULL THEN 0.0 ELSE (1.0 - k.share) * 0.35 * coverage END AS wf FROM q_rows q JOIN knobs k USING (run))),
h AS (SELECT *, CASE WHEN confidence >= 0.02 THEN pi + scale * value * volatility END AS q,
             CASE WHEN confidence >= 0.02 THEN tau * volatility * volatility * (1.0 - confidence) / confidence END AS omega FROM b WHERE heuristic),
x AS (SELECT *, s0 - avg(s0) OVER g AS xs, fscore - avg(fscore) OVER g AS xf, pow(greatest(dispersion, 0.3), 2) / effective_count AS sv
      FROM (SELECT * EXCLUDE (value, confidence), CASE WHEN headlines >= 1 THEN score END AS s0 FROM b WHERE NOT heuristic) WINDOW g AS (PARTITION BY run)),
c AS (SELECT 0.5 * (1 - 1 / 6.25) AS ks, 0.2 * sqrt(1 - 1 / 6.25) AS ss, 0.3 * (1 - 1 / 9.0) AS kf, 0.1 * sqrt(1 - 1 / 9.0) AS sf),
a AS (SELECT *, coalesce(ks * xs, 0.0) + coalesce(kf * xf, 0.0) AS alpha,
             coalesce(pow(ss * xs, 2) + ks * ks * sv, 0.0) + coalesce(pow(sf * xf, 2), 0.0) AS var, xs IS NOT NULL OR xf IS NOT NULL AS used FROM x, c),
q AS (SELECT *, CASE WHEN used THEN pi + volatility * alpha END AS q, CASE WHEN used THEN volatility * volatility * var + 1e-6 END AS omega FROM a),
v AS (SELECT *, coalesce((q - pi) / volatility, 0.0) AS value, coalesce(tau * volatility * volatility / (tau * volatility * volatility + omega), 0.0) AS confidence FROM q)
SELECT {A_COLUMNS}, {r('budget', 'budget')}, {r('max_weight', 'max_weight')}, {r('tau', 'tau')}, 'heuristic' AS view_mode FROM h
UNION ALL SELECT {A_COLUMNS}, {r('budget', 'budget')}, {r('max_weight', 'max_weight')}, {r('tau', 'tau')}, 'calibrated' FROM v""")
ORACLES["analysis_orders"] = compose("""
SELECT run, names, names IS NOT NULL OR NULL AS "full", names IS NOT NULL OR NULL AS capped, names IS NOT NULL OR NULL AS affordable, names IS NOT NULL OR NULL AS budgeted, warning FROM (
  SELECT r_regionkey AS run, n.names, CASE WHEN r_regionkey = 3 THEN 'no result: max_weight:in (0, 1.0]' END AS warning
  FROM region LEFT JOIN (SELECT run, count(*) AS names FROM q_rows GROUP BY run) n ON n.run = r_regionkey)""")
ORACLES["request_violations"] = """
WITH q AS (
  SELECT c_custkey AS run, c_custkey AS k, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS budget,
    list_distinct([upper(c_mktsegment), 'N-' || c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN 'BAD#ONE' WHEN c_custkey % 7 = 0 THEN 'A-VERY-LONG-TICKER' ELSE 'N-1' END]) AS t
  FROM customer
), v AS (
  SELECT run, unnest([
    CASE WHEN NOT list_bool_and([regexp_matches(x, '^[A-Za-z0-9^-]{1,12}$') FOR x IN t]) THEN 'tickers:shape' END,
    CASE WHEN len(t) NOT BETWEEN 2 AND 20 THEN 'tickers:count in 2..20' END,
    CASE WHEN k % 2000 NOT BETWEEN 60 AND 1825 THEN 'lookback_days:in [60, 1825]' END,
    CASE WHEN k % 130 NOT BETWEEN 1 AND 100 THEN 'max_headlines:in [1, 100]' END,
    CASE WHEN k % 40 NOT BETWEEN 1 AND 30 THEN 'news_days:in [1, 30]' END,
    CASE WHEN k % 120 < 5 OR k % 120 > 105 THEN 'sentiment_weight:in [0.0, 1.0]' END,
    CASE WHEN k % 250 > 200 THEN 'view_scale:in [0.0, 2.0]' END,
    CASE WHEN budget IS NULL OR budget <= 0 THEN 'budget:in (0, 1.7976931348623157e+308]' END,
    CASE WHEN k % 30 = 0 OR k % 30 > 20 THEN 'max_weight:in (0, 1.0]' END,
    CASE WHEN k % 600 = 0 OR k % 600 > 500 THEN 'risk_aversion:in (0, 50.0]' END,
    CASE WHEN k % 13 = 0 OR k % 130 = 0 OR k % 130 > 100 THEN 'tau:in (0, 1.0]' END]) AS violation FROM q
)
SELECT run, violation FROM v WHERE violation IS NOT NULL"""

# Backtest counters: every solve succeeds; a rebalance is calibrated once a signal has 60 realized dates.
CTES["all_sections"] = CTES["sections"].replace(", bounds28", "").replace(" AND v.t BETWEEN t_start AND t_end", "")
ORACLES["backtest_counters"] = compose("""
WITH d AS (SELECT signal, t FROM all_sections WHERE names >= 5 GROUP BY 1, 2),
c AS (SELECT r FROM rebal JOIN d ON d.t + 4 <= r GROUP BY r, signal HAVING count(*) >= 60)
SELECT (SELECT count(*) FROM rebal) AS rebalances, (SELECT count(DISTINCT r) FROM c) AS calibrated_rebalances,
       (SELECT count(DISTINCT r) FROM prior WHERE cap_fallback) AS market_cap_fallbacks""")

# The flagship: the same table on monthly bars, 90 days of news, one headline enough, whole span.
_monthly = ORACLES["ic_table"]
for _week, _month in (
    ("date_trunc('week', l_shipdate)", "date_trunc('month', l_shipdate)"),
    ("h.date >= d.date - 7 ", "h.date >= d.date - 90 "),
    ("WHERE headlines >= 3", "WHERE headlines >= 1"),
    ("WHERE t BETWEEN t_start AND t_end", "WHERE true"),
):
    assert _week in _monthly
    _monthly = _monthly.replace(_week, _month)
ORACLES["ic_monthly"] = _monthly
