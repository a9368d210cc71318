"""Registered queries: sources and the statement layer (S*, W1-W3, P13-P14,
D*, B*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratingspark.functions import fixed_values as fv
from ratingspark.operators import fundamentals as fd
from ratingspark.operators import items as it
from ratingspark.plans import sql_bindings as sb
from ratingspark.plans import sql_features as sfe
from ratingspark.plans.registry import register, select_sql
from ratingspark.sources import bindings as b
from ratingspark.sources import ingest
from ratingspark.sources import vocabularies

FEATS = list(fv.FEATURE_NAMES.values())
AUDIT_D = ["_revenue", "_net_income", "_ebit", "_total_assets", "_total_equity", "_total_debt",
           "_current_assets", "_current_liabilities"]


def _adapter(spark, sf):
    return fd.adapter_features(b.statement_cells(spark, sf), b.firm(spark, sf))


def _adapter_ungated(spark, sf):
    return fd.adapter_features(b.statement_cells(spark, sf), b.firm(spark, sf), gate=False)


def _crawl(spark, sf, gate=True):
    return fd.crawl_features(b.statement_cells(spark, sf), b.firm(spark, sf), gate=gate)


ADAPTER_CTES = sb.base_ctes("ranked") + "," + sb.resolver_a_sql() + "," + sfe.adapter_sql()
ADAPTER_CTES_UNGATED = sb.base_ctes("ranked") + "," + sb.resolver_a_sql() + "," + sfe.adapter_sql(gate=False)
CRAWL_CTES = sb.base_ctes("ranked") + "," + sb.resolver_b_sql() + "," + sfe.crawl_sql()
CRAWL_CTES_UNGATED = sb.base_ctes("ranked") + "," + sb.resolver_b_sql() + "," + sfe.crawl_sql(gate=False)

ADAPTER_COLS = ([("ticker", "s"), ("sector", "s"), ("company_name", "s"), ("exchange", "s")]
                + [(c, "d") for c in FEATS] + [(c, "d") for c in AUDIT_D]
                + [("_is_bank", "s"), ("_ebit_path", "s"), ("_current_ratio_path", "s"), ("_n_missing", "i")])


# ---------------------------------------------------------------- S4 / W1
@register("s4_statement_unpivot", sql=select_sql(
    sb.base_ctes("statement_item"), "statement_item WHERE value IS NOT NULL",
    [("ticker", "s"), ("statement", "s"), ("period", "s"), ("item_id", "s"), ("value", "d")]))
def s4_statement_unpivot(spark, sf):
    """Round trip: long statements -> transposed (one column per period) ->
    S4 unpivot; non-null cells must come back unchanged."""
    # both aggregates of the round trip run in the binding's partitions by ticker
    wide = ingest.statement_wide(b.statement_item(spark, sf))
    long = ingest.unpivot_statement(wide)
    return long.filter(F.col("value").isNotNull()).select("ticker", "statement", "period", "item_id", "value")


@register("w1_period_rank", sql=select_sql(
    sb.base_ctes("ranked"), "period_ranks",
    [("ticker", "s"), ("statement", "s"), ("period", "s"), ("period_rank", "i")]))
def w1_period_rank(spark, sf):
    r = it.rank_periods(b.statement_item(spark, sf))
    return r.select("ticker", "statement", "period", "period_rank").distinct()


# ---------------------------------------------------------------- P13 / P14
@register("p13_resolver_a", sql=select_sql(
    sb.base_ctes("ranked") + "," + sb.resolver_a_sql(),
    "resolved_a r LEFT JOIN ranked v ON v.ticker = r.ticker AND v.statement = r.statement "
    "AND v.item_id = r.item_id AND v.period_rank = 0",
    [("r.ticker", "s"), ("r.lookup", "s"), ("r.item_id", "s"), ("v.value", "d")]).replace(
        "round(CAST(v.value AS DOUBLE), 6) + 0.0 AS v.value", "round(CAST(v.value AS DOUBLE), 6) + 0.0 AS value"))
def p13_resolver_a(spark, sf):
    """Chosen line item per (ticker, lookup) and its newest value (may be null)."""
    ranked = fd.materialize(it.rank_periods(b.statement_item(spark, sf)), "ranked")
    res = it.resolve_items_a(ranked, it.lookups_variant_a())
    return it.values_at(ranked, res, 0).select("ticker", "lookup", "item_id", "value")


@register("p14_resolver_b", sql=select_sql(
    sb.base_ctes("ranked") + "," + sb.resolver_b_sql(), "vals_b",
    [("ticker", "s"), ("lookup", "s"), ("value", "d")]))
def p14_resolver_b(spark, sf):
    """First non-null value per (ticker, lookup) at its period index."""
    ranked = fd.materialize(it.rank_periods(b.statement_item(spark, sf)), "ranked")
    return it.resolve_values_b(ranked, fd.lookups_variant_b())


# ---------------------------------------------------------------- W2 / W3
@register("w2_yoy_growth", sql=select_sql(
    sb.base_ctes("ranked") + "," + sb.resolver_a_sql(), "wide_a",
    [("ticker", "s"), ("is_revenue_0", "d"), ("is_revenue_1", "d")]).replace(
        "FROM wide_a", ", " + "round(CAST(CASE WHEN is_revenue_0 IS NOT NULL AND is_revenue_1 IS NOT NULL "
        "AND abs(is_revenue_1) >= 1e-9 THEN " + sfe.clip("(is_revenue_0 - is_revenue_1) / abs(is_revenue_1)", -0.9, 5.0)
        + " END AS DOUBLE), 6) + 0.0 AS growth FROM wide_a"))
def w2_yoy_growth(spark, sf):
    """Revenue growth from the newest two periods of the resolved revenue line."""
    w = fd.resolved_values_a(b.statement_cells(spark, sf))
    v0, v1 = F.col("`is_revenue@0`"), F.col("`is_revenue@1`")
    return w.select("ticker", v0.alias("is_revenue_0"), v1.alias("is_revenue_1"),
                    it.yoy_growth(v0, v1).alias("growth"))


@register("w3_previous_period", sql=select_sql(
    sb.base_ctes("ranked") + "," + sb.resolver_b_sql(), "wide_b",
    [("ticker", "s"), ("prev_revenue", "d"), ("prev_equity", "d")]))
def w3_previous_period(spark, sf):
    """Values read at period index 1 (previous year) by resolver B."""
    ranked = fd.materialize(it.rank_periods(b.statement_item(spark, sf)), "ranked")
    lk = [x for x in fd.lookups_variant_b() if x[3] == 1]
    v = it.resolve_values_b(ranked, lk)
    w = v.groupBy("ticker").pivot("lookup", [x[0] for x in lk]).agg(F.max("value"))
    return ranked.select("ticker").distinct().join(w, "ticker", "left").select(
        "ticker", "prev_revenue", "prev_equity")


# ---------------------------------------------------------------- D15 and its parts
@register("d15_adapter_features", sql=select_sql(ADAPTER_CTES, "adapter", ADAPTER_COLS))
def d15_adapter_features(spark, sf):
    """Full statement-adapter feature rows with audit columns, gate C4."""
    return _adapter(spark, sf)


def _dpart(name, cols):
    def fn(spark, sf):
        return _adapter_ungated(spark, sf).select("ticker", *[c for c, _ in cols])
    fn.__name__ = name
    register(name, sql=select_sql(ADAPTER_CTES_UNGATED, "adapter", [("ticker", "s")] + cols))(fn)


_dpart("d1_ebit", [("_ebit", "d"), ("_ebit_path", "s")])
_dpart("d2_roce", [("roce", "d")])
_dpart("d3_d4_current_ratio", [("current_ratio", "d"), ("_current_ratio_path", "s"), ("wcta", "d")])
_dpart("d5_bank_revenue", [("_is_bank", "s"), ("_revenue", "d")])
_dpart("d6_d9_leverage", [("debt_to_assets", "d"), ("debt_to_equity", "d")])
_dpart("d7_roa_roe", [("roa", "d"), ("roe", "d")])
_dpart("d8_ebit_margin", [("ebit_margin", "d")])
_dpart("d10_net_debt_ebitda", [("net_debt_to_ebitda", "d"), ("_total_debt", "d")])
_dpart("d12_turnover_reta_mb", [("asset_turnover", "d"), ("reta", "d"), ("market_to_book", "d"),
                                ("market_cap", "d"), ("log_revenue", "d")])
_dpart("d13_revenue_growth", [("revenue_growth_yoy", "d")])
_dpart("c4_completeness_gate_a", [("_n_missing", "i")])


# ---------------------------------------------------------------- D1-D14 under dealt vocabularies
def _dealt(spark, sf):
    return fd.adapter_features(vocabularies.dealt_statements(spark, sf), b.firm(spark, sf), gate=False, paths=True)


DEALT_CTES = (sb.base_ctes("ranked", dealt=True) + "," + sb.resolver_a_sql() + "," + sfe.adapter_sql(gate=False))
DEALT_COLS = (ADAPTER_COLS + [(f"_{c}_path", "s") for c in fd.CHAIN_PATHS if c not in ("ebit", "current_ratio")])
EVERY_PATH = sb.values_sql([(c, p) for c, ps in fd.CHAIN_PATHS.items() for p in [*ps, "none"]], ["chain", "path"])
TAKEN = " UNION ALL ".join(f"SELECT '{c}' AS chain, coalesce(_{c}_path, 'none') AS path, _is_bank FROM adapter"
                           for c in fd.CHAIN_PATHS)


@register("d_paths_features", sql=select_sql(DEALT_CTES, "adapter", DEALT_COLS))
def d_paths_features(spark, sf):
    """Adapter rows of firms that file under different vocabularies, with the path
    that each fallback chain took."""
    return _dealt(spark, sf)


@register("d_path_coverage", sql=f"""WITH {DEALT_CTES}
SELECT e.chain, e.path, count(t.chain) AS n_firms, count(CASE WHEN t._is_bank THEN 1 END) AS n_banks
FROM {EVERY_PATH} e LEFT JOIN ({TAKEN}) t ON t.chain = e.chain AND t.path = e.path GROUP BY e.chain, e.path""")
def d_path_coverage(spark, sf):
    """Firms by the path that each fallback chain of D1-D14 took."""
    return fd.path_coverage(_dealt(spark, sf))


# ---------------------------------------------------------------- B1-B7
CRAWL_COLS = [("ticker", "s"), ("sector", "s")] + [(c, "d") for c in FEATS] + [("_n_ok", "i")]


@register("b_crawl_features", sql=select_sql(CRAWL_CTES, "crawl", CRAWL_COLS))
def b_crawl_features(spark, sf):
    """B1-B7 rows with gate C5 (>= 4 non-null features)."""
    return _crawl(spark, sf)


def _bpart(name, cols):
    def fn(spark, sf):
        return _crawl(spark, sf, gate=False).select("ticker", *[c for c, _ in cols])
    fn.__name__ = name
    register(name, sql=select_sql(CRAWL_CTES_UNGATED, "crawl", [("ticker", "s")] + cols))(fn)


_bpart("b2_roa_roe_percent", [("roa", "d"), ("roe", "d")])
_bpart("b3_roce_margin_liquidity", [("roce", "d"), ("ebit_margin", "d"), ("current_ratio", "d"),
                                    ("asset_turnover", "d")])
_bpart("b4_debt_ratios", [("debt_to_assets", "d"), ("debt_to_equity", "d")])
_bpart("b5_net_debt_ebitda", [("net_debt_to_ebitda", "d")])
_bpart("b6_wcta_reta", [("wcta", "d"), ("reta", "d")])
_bpart("b7_growth_log_revenue", [("revenue_growth_yoy", "d"), ("log_revenue", "d")])
_bpart("c5_completeness_gate_b", [("_n_ok", "i")])
