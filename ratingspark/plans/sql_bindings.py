"""Oracle SQL (DuckDB dialect) for the binding views and the statement layer.

These CTE texts are an independent, set-based statement of each operator's
semantics, used only by ``oracle_sql()`` to check the Spark plans.
"""

from __future__ import annotations

from ratingspark.functions import fixed_values as fv
from ratingspark.operators.fundamentals import lookups_variant_b
from ratingspark.operators.items import lookups_variant_a
from ratingspark.sources.bindings import (
    FIRM_YEAR_AMOUNTS, PRICE_GRADE_DEFAULT, PRICE_GRADES, SEGMENT_SECTOR, SEGMENT_SECTOR_DEFAULT, STATEMENT_ITEMS)
from ratingspark.sources.vocabularies import BANK_VOCABULARIES, COMPANY_VOCABULARIES, vocabulary_lines


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values_sql(rows: list[tuple], cols: list[str]) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        return q(v)
    body = ",\n".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(cols)}))"


def case_map(expr: str, pairs: list[tuple[str, str]], default: str | None) -> str:
    whens = " ".join(f"WHEN {expr} = {q(k)} THEN {q(v)}" for k, v in pairs)
    return f"CASE {whens} ELSE {q(default) if default is not None else 'NULL'} END"


FIRM = f"""
firm AS (
  SELECT c.c_custkey AS firm_id, 'F' || CAST(c.c_custkey AS VARCHAR) AS ticker,
         c.c_mktsegment AS sector_raw,
         {case_map('c.c_mktsegment', SEGMENT_SECTOR, SEGMENT_SECTOR_DEFAULT)} AS sector,
         CASE WHEN c.c_nationkey < 12 THEN 'vietnam' ELSE 'kaggle' END AS data_source,
         c.c_name AS company_name, r.r_name AS exchange, c.c_acctbal AS acctbal
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

_P = "CAST(l_extendedprice AS DECIMAL(18,2))"
_D = "CAST(l_discount AS DECIMAL(4,2))"
_T = "CAST(l_tax AS DECIMAL(4,2))"

FIRM_YEAR = f"""
firm_year AS (
  SELECT o_custkey AS firm_id, CAST(year(o_orderdate) AS BIGINT) AS period,
    SUM({_P}) AS total_assets,
    SUM({_P}) FILTER (WHERE l_linestatus = 'O') AS total_liabilities,
    SUM({_P}) FILTER (WHERE l_returnflag = 'A') AS short_term_assets,
    SUM({_P}) FILTER (WHERE l_returnflag = 'R') AS short_term_liabilities,
    SUM({_P} * ({_D} - {_T})) AS net_profit_after_tax,
    SUM({_P} * (1 - {_D})) AS net_revenue,
    SUM({_P} * {_T}) FILTER (WHERE l_returnflag = 'R') AS interest_expense,
    SUM({_P} * (1 - {_D})) FILTER (WHERE l_linestatus = 'F') AS gross_profit,
    SUM({_P} * {_D}) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS operating_profit,
    SUM({_P} * {_D}) FILTER (WHERE l_returnflag = 'N') AS cash,
    SUM({_P} * {_T}) FILTER (WHERE l_linestatus = 'F') AS long_term_debt,
    SUM({_P} * {_D}) FILTER (WHERE l_linestatus = 'F') AS retained,
    SUM({_P}) FILTER (WHERE l_returnflag = 'N') AS deposits,
    SUM({_P} * (1 - {_D})) FILTER (WHERE l_linestatus = 'O') AS loans
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  GROUP BY o_custkey, year(o_orderdate)
)"""


def _grade_case(expr: str) -> str:
    whens = " ".join(f"WHEN {expr} < {b} THEN {q(g)}" for b, g in PRICE_GRADES)
    return f"CASE {whens} ELSE {q(PRICE_GRADE_DEFAULT)} END"


RATING_EVENT = f"""
rating_event AS (
  SELECT o_orderkey AS event_id, o_custkey AS firm_id, 'F' || CAST(o_custkey AS VARCHAR) AS ticker,
         o_orderpriority AS agency, CAST(o_orderdate AS DATE) AS rated_on,
         {_grade_case('o_totalprice')} AS raw_rating
  FROM orders
)"""


def _amount_sql(key: str) -> str:
    if key == "total_equity":
        return "CAST(fy.total_assets - fy.total_liabilities AS DOUBLE)"
    if key == "market_cap":
        return "CAST(fy.total_assets * 2 AS DOUBLE)"
    if key == "price_to_book":
        return "CASE WHEN f.acctbal > 0 THEN f.acctbal / 1000.0 END"
    return f"CAST(fy.{key} AS DOUBLE)"


def _statement_item_sql() -> str:
    parts = []
    for key, stmt, nb, bk, pos in STATEMENT_ITEMS:
        for is_bank, item in ((False, nb), (True, bk)):
            if item is None:
                continue
            cond = "f.sector = 'Banking'" if is_bank else "f.sector <> 'Banking'"
            parts.append(
                f"SELECT f.ticker, {q(stmt)} AS statement, CAST(fy.period AS VARCHAR) AS period, "
                f"{pos} AS item_pos, {q(item)} AS item_id, {_amount_sql(key)} AS value "
                f"FROM firm_year fy JOIN firm f ON fy.firm_id = f.firm_id WHERE {cond}")
    return "statement_item AS (\n  " + "\n  UNION ALL ".join(parts) + "\n)"


STATEMENT_ITEM = _statement_item_sql()


def _dealt_statements_sql() -> str:
    """``statement_item`` under the vocabularies of ``sources/vocabularies.py``."""
    amounts = {k: f"CAST(fy.{k} AS DOUBLE)" for k in FIRM_YEAR_AMOUNTS}
    amounts["total_equity"] = "CAST(fy.total_assets - fy.total_liabilities AS DOUBLE)"
    amounts["long_term_assets"] = "CAST(fy.total_assets - fy.short_term_assets AS DOUBLE)"
    amounts["percent"], amounts["multiple"] = "f.acctbal / 100.0", "f.acctbal / 1000.0"
    lines = vocabulary_lines()
    table = values_sql(lines, ["is_bank", "vocabulary", "statement", "item_id", "item_pos", "amount", "late"])
    pick = " ".join(f"WHEN {q(k)} THEN {amounts[k]}" for k in sorted({line[5] for line in lines}))
    bank = f"f.sector = {q(SEGMENT_SECTOR_DEFAULT)}"
    return f"""
newest_year AS (SELECT firm_id, max(period) AS newest FROM firm_year GROUP BY firm_id),
statement_item AS (
  SELECT f.ticker, v.statement, CAST(fy.period AS VARCHAR) AS period, v.item_pos, v.item_id,
    CASE WHEN v.late AND fy.period = y.newest THEN NULL ELSE CASE v.amount {pick} END END AS value
  FROM firm_year fy JOIN firm f USING (firm_id) JOIN newest_year y USING (firm_id)
  JOIN {table} v ON v.is_bank = ({bank}) AND v.vocabulary = CAST('0x' || substr(md5(f.ticker), 1, 7) AS BIGINT)
    % CASE WHEN {bank} THEN {len(BANK_VOCABULARIES)} ELSE {len(COMPANY_VOCABULARIES)} END
)"""


DEALT_STATEMENTS = _dealt_statements_sql()


def period_key_sql(p: str) -> str:
    return (f"CASE WHEN regexp_full_match(trim({p}), '[0-9]+') THEN CAST(trim({p}) AS BIGINT) "
            f"WHEN regexp_full_match(trim({p}), '[0-9]+-Q[0-9]+') THEN "
            f"CAST(regexp_extract(trim({p}), '^([0-9]+)-Q', 1) AS BIGINT) * 10 + "
            f"CAST(regexp_extract(trim({p}), '-Q([0-9]+)$', 1) AS BIGINT) ELSE 0 END")


RANKED = f"""
period_ranks AS (
  SELECT ticker, statement, period,
         CAST(row_number() OVER (PARTITION BY ticker, statement ORDER BY pkey DESC, period) - 1 AS INTEGER)
           AS period_rank
  FROM (SELECT DISTINCT ticker, statement, period, {period_key_sql('period')} AS pkey FROM statement_item) d
),
ranked AS (
  SELECT s.*, p.period_rank FROM statement_item s JOIN period_ranks p USING (ticker, statement, period)
)"""


def base_ctes(*names: str, dealt: bool = False) -> str:
    """The named CTEs and those that they need; ``dealt`` lands the statements under
    their firms' vocabularies."""
    parts = {"firm": FIRM, "firm_year": FIRM_YEAR, "rating_event": RATING_EVENT,
             "statement_item": DEALT_STATEMENTS if dealt else STATEMENT_ITEM, "ranked": RANKED}
    need = set(names)
    if "ranked" in need:
        need |= {"statement_item"}
    if "statement_item" in need:
        need |= {"firm", "firm_year"}
    order = ["firm", "firm_year", "rating_event", "statement_item", "ranked"]
    return ",\n".join(parts[n].strip() for n in order if n in need)


def resolver_a_sql() -> str:
    """CTEs ``resolved_a`` (ticker, lookup, item_id) and ``wide_a`` (one row
    per ticker, ``<lookup>_0`` columns plus ``is_revenue_1``)."""
    lookups = lookups_variant_a()
    rows = [(n, st, r, c, c.strip().lower()) for n, st, cs in lookups for r, c in enumerate(cs)]
    cands = values_sql(rows, ["lookup", "statement", "cand_rank", "cand", "cand_norm"])
    cols = ",\n    ".join(f"max(value) FILTER (WHERE lookup = {q(n)} AND idx = 0) AS {n}_0"
                           for n, _, _ in lookups)
    return f"""
cands_a AS {cands},
avail_a AS (
  SELECT ticker, statement, item_id, min(CAST(period_rank AS BIGINT) * 1000000 + item_pos) AS seen
  FROM ranked WHERE value IS NOT NULL GROUP BY ticker, statement, item_id
),
keys_a AS (
  SELECT ticker, statement, item_id, lower(trim(item_id)) AS key, seen * 2 AS prod FROM avail_a
  UNION ALL
  SELECT ticker, statement, item_id,
         lower(trim(regexp_replace(item_id, '\\s*\\(.*?\\)\\s*', '', 'g'))) AS key, seen * 2 + 1 AS prod
  FROM avail_a WHERE lower(trim(regexp_replace(item_id, '\\s*\\(.*?\\)\\s*', '', 'g'))) <> ''
),
lookup_a AS (
  SELECT ticker, statement, key, arg_max(item_id, prod) AS owner, min(prod) AS key_pos
  FROM keys_a GROUP BY ticker, statement, key
),
hits_a AS (
  SELECT a.ticker, a.statement, c.lookup, c.cand_rank, 0 AS kind, CAST(0 AS BIGINT) AS key_pos,
         a.item_id AS chosen
  FROM avail_a a JOIN cands_a c ON a.statement = c.statement AND a.item_id = c.cand
  UNION ALL
  SELECT l.ticker, l.statement, c.lookup, c.cand_rank, 1, l.key_pos, l.owner
  FROM lookup_a l JOIN cands_a c ON l.statement = c.statement AND l.key = c.cand_norm
  UNION ALL
  SELECT l.ticker, l.statement, c.lookup, c.cand_rank, 2, l.key_pos, l.owner
  FROM lookup_a l JOIN cands_a c ON l.statement = c.statement AND contains(l.key, c.cand_norm)
),
resolved_a AS (
  SELECT ticker, statement, lookup,
         arg_min(chosen, CAST(cand_rank AS BIGINT) * 1000000000 + kind * 100000000 + key_pos) AS item_id
  FROM hits_a GROUP BY ticker, statement, lookup
),
vals_a AS (
  SELECT r.ticker, r.lookup, 0 AS idx, v.value
  FROM resolved_a r LEFT JOIN ranked v
    ON v.ticker = r.ticker AND v.statement = r.statement AND v.item_id = r.item_id AND v.period_rank = 0
  UNION ALL
  SELECT r.ticker, r.lookup, 1 AS idx, v.value
  FROM resolved_a r LEFT JOIN ranked v
    ON v.ticker = r.ticker AND v.statement = r.statement AND v.item_id = r.item_id AND v.period_rank = 1
  WHERE r.lookup = 'is_revenue'
),
wide_a AS (
  SELECT t.ticker,
    {cols},
    max(value) FILTER (WHERE lookup = 'is_revenue' AND idx = 1) AS is_revenue_1
  FROM (SELECT DISTINCT ticker FROM ranked) t LEFT JOIN vals_a USING (ticker)
  GROUP BY t.ticker
)"""


def resolver_b_sql() -> str:
    """CTE ``wide_b``: one row per ticker, one column per variant-B lookup."""
    lk = lookups_variant_b()
    rows = [(n, st, r, k, k.lower(), idx) for n, st, ks, idx in lk for r, k in enumerate(ks)]
    cands = values_sql(rows, ["lookup", "statement", "cand_rank", "cand", "cand_norm", "idx"])
    cols = ",\n    ".join(f"max(value) FILTER (WHERE lookup = {q(n)}) AS {n}" for n, _, _, _ in lk)
    return f"""
cands_b AS {cands},
order_b AS (
  SELECT ticker, statement, item_id, min(CAST(period_rank AS BIGINT) * 1000000 + item_pos) AS col_pos
  FROM ranked WHERE value IS NOT NULL GROUP BY ticker, statement, item_id
),
hits_b AS (
  SELECT o.ticker, o.statement, o.item_id, c.lookup, c.idx, c.cand_rank, 1 AS pass, CAST(0 AS BIGINT) AS col_pos
  FROM order_b o JOIN cands_b c ON o.statement = c.statement AND o.item_id = c.cand
  UNION ALL
  SELECT o.ticker, o.statement, o.item_id, c.lookup, c.idx, c.cand_rank, 2, o.col_pos
  FROM order_b o JOIN cands_b c ON o.statement = c.statement AND contains(lower(o.item_id), c.cand_norm)
),
vals_b AS (
  SELECT h.ticker, h.lookup,
         arg_min(v.value, h.pass * 100000000000 + CAST(h.cand_rank AS BIGINT) * 1000000000 + h.col_pos) AS value
  FROM hits_b h JOIN ranked v ON v.ticker = h.ticker AND v.statement = h.statement
       AND v.item_id = h.item_id AND v.period_rank = h.idx AND v.value IS NOT NULL
  GROUP BY h.ticker, h.lookup
),
wide_b AS (
  SELECT t.ticker,
    {cols}
  FROM (SELECT DISTINCT ticker FROM ranked) t LEFT JOIN vals_b USING (ticker)
  GROUP BY t.ticker
)"""


def normalize_sector_sql(x: str) -> str:
    exact = " ".join(f"WHEN trim({x}) = {q(k)} THEN {q(v)}" for k, v in fv.SECTOR_NORMALIZE.items())
    ci = {}
    for k, v in fv.SECTOR_NORMALIZE.items():
        ci.setdefault(k.lower(), v)
    cis = " ".join(f"WHEN lower(trim({x})) = {q(k)} THEN {q(v)}" for k, v in ci.items())
    kws = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(trim({x})), {q(w)})" for w in words) + f" THEN {q(t)}"
        for words, t in fv.SECTOR_KEYWORDS)
    return (f"CASE WHEN {x} IS NULL OR trim({x}) = '' THEN 'Other' {exact} {cis} {kws} "
            f"ELSE 'Other' END")
