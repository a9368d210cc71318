"""Fixed values.

Everything in this module is a value that must equal the original pipeline's
for results to match: grade scales and folds, sector vocabularies, reference
medians, clip bounds, line-item candidate lists and model parameters. They are
stated plainly, in their natural order, and are turned into small broadcast
dimension tables or literal maps by the operators. No logic lives here.
"""

# --------------------------------------------------------------------------
# FIXED VALUES — rating scales
# --------------------------------------------------------------------------

RATING_SCALE = ["AAA", "AA", "A", "BBB", "BB", "B", "CCC", "CC", "C", "D"]

RATING_SCALE_EXTENDED = [
    "AAA",
    "AA+", "AA", "AA-",
    "A+", "A", "A-",
    "BBB+", "BBB", "BBB-",
    "BB+", "BB", "BB-",
    "B+", "B", "B-",
    "CCC", "CC", "C", "D",
]

RATING_NORMALIZE = {
    "AAA": "AAA",
    "AA+": "AA", "AA": "AA", "AA-": "AA",
    "A+": "A", "A": "A", "A-": "A",
    "BBB+": "BBB", "BBB": "BBB", "BBB-": "BBB",
    "BB+": "BB", "BB": "BB", "BB-": "BB",
    "B+": "B", "B": "B", "B-": "B",
    "CCC+": "CCC", "CCC": "CCC", "CCC-": "CCC",
    "CC": "CC", "C": "C", "D": "D", "SD": "D",
    "AAA.vn": "AAA", "AA+.vn": "AA", "AA.vn": "AA", "AA-.vn": "AA",
}

EXTENDED_TO_STANDARD = {
    "AAA": "AAA",
    "AA+": "AA", "AA": "AA", "AA-": "AA",
    "A+": "A", "A": "A", "A-": "A",
    "BBB+": "BBB", "BBB": "BBB", "BBB-": "BBB",
    "BB+": "BB", "BB": "BB", "BB-": "BB",
    "B+": "B", "B": "B", "B-": "B",
    "CCC": "CCC", "CC": "CC", "C": "C", "D": "D",
}

UNKNOWN_ORDINAL = 99

# Risk band of a grade (display colour).
RISK_BANDS = [
    (["AAA", "AA", "A"], "green"),
    (["BBB", "BB"], "yellow"),
    (["B"], "orange"),
    (["CCC", "CC", "C", "D"], "red"),
]
RISK_BAND_DEFAULT = "white"

# --------------------------------------------------------------------------
# FIXED VALUES — canonical features
# --------------------------------------------------------------------------

# display name -> internal snake_case name
FEATURE_NAMES = {
    "ROA": "roa",
    "ROE": "roe",
    "ROCE": "roce",
    "EBIT_Margin": "ebit_margin",
    "Current_Ratio": "current_ratio",
    "Debt/Assets": "debt_to_assets",
    "Debt/Equity": "debt_to_equity",
    "Net_Debt/EBITDA": "net_debt_to_ebitda",
    "Asset_Turnover": "asset_turnover",
    "WCTA": "wcta",
    "RETA": "reta",
    "Market_to_Book": "market_to_book",
    "Revenue_Growth_YoY": "revenue_growth_yoy",
    "Log_Revenue": "log_revenue",
    "Market_Cap": "market_cap",
}

# Canonical identifier / label columns of a feature file.
CANONICAL_META = ["Ticker", "Sector", "Credit_Rating"]

UNIVERSAL_FEATURES = [
    "ROA", "ROE", "ROCE", "EBIT_Margin",
    "Current_Ratio", "Revenue_Growth_YoY", "Log_Revenue", "Market_Cap",
]
SECTOR_DEPENDENT = [
    "Debt/Assets", "Debt/Equity", "Net_Debt/EBITDA",
    "Asset_Turnover", "WCTA", "RETA", "Market_to_Book",
]

# Features the statement adapter requires (gate C4): 14, max 7 missing.
REQUIRED_FEATURES = [
    "ROA", "ROE", "ROCE", "EBIT_Margin", "Current_Ratio",
    "Revenue_Growth_YoY", "Log_Revenue",
    "Debt/Assets", "Debt/Equity", "Net_Debt/EBITDA",
    "Asset_Turnover", "WCTA", "RETA", "Market_to_Book",
]
MAX_MISSING_REQUIRED = 7
MIN_FEATURES_VARIANT_B = 4
MIN_FILLED_MANUAL = 3

# Manual-input columns.
MANUAL_INPUT_FEATURES = [
    "ROA", "ROE", "ROCE", "EBIT_Margin", "Current_Ratio",
    "Debt/Assets", "Debt/Equity", "Net_Debt/EBITDA", "Asset_Turnover",
    "WCTA", "RETA", "Market_to_Book", "Revenue_Growth_YoY", "Log_Revenue",
]

# --------------------------------------------------------------------------
# FIXED VALUES — sectors
# --------------------------------------------------------------------------

FINANCIAL_SECTORS = ["Banking", "Insurance", "Securities", "FinancialServices", "Finance"]

FOREIGN_SECTOR_MAP = {
    "Finance": "FinancialServices",
    "Capital Goods": "Manufacturing",
    "Basic Industries": "Manufacturing",
    "Consumer Durables": "Manufacturing",
    "Consumer Non-Durables": "Manufacturing",
    "Consumer Services": "Retail",
    "Energy": "Energy",
    "Health Care": "Healthcare",
    "Technology": "Technology",
    "Transportation": "Transportation",
    "Public Utilities": "Energy",
    "Miscellaneous": "Other",
}

FOREIGN_SECTOR_GROWTH = {
    "Technology": 0.15, "Healthcare": 0.08, "Energy": 0.05,
    "Manufacturing": 0.06, "Retail": 0.04, "FinancialServices": 0.07,
    "Transportation": 0.05, "Other": 0.05,
}
FOREIGN_SECTOR_GROWTH_DEFAULT = 0.06

SECTOR_NORMALIZE = {
    "Ngân hàng": "Banking",
    "Ngân Hàng": "Banking",
    "NGÂN HÀNG": "Banking",
    "Tài chính": "FinancialServices",
    "Tài Chính": "FinancialServices",
    "Tài chính - Ngân hàng": "Banking",
    "Bảo hiểm": "Insurance",
    "Chứng khoán": "Securities",
    "Dịch vụ tài chính": "FinancialServices",
    "Công nghệ thông tin": "Technology",
    "Phần mềm & Dịch vụ": "Technology",
    "Phần mềm": "Technology",
    "Công Nghệ": "Technology",
    "Bất động sản": "RealEstate",
    "Bất Động Sản": "RealEstate",
    "Thép": "Manufacturing",
    "Hóa chất": "Manufacturing",
    "Vật liệu xây dựng": "Manufacturing",
    "Dệt may": "Manufacturing",
    "Thực phẩm & Đồ uống": "Manufacturing",
    "Thực phẩm": "Manufacturing",
    "Dược phẩm": "Healthcare",
    "Điện tử & Linh kiện": "Manufacturing",
    "Bán lẻ": "Retail",
    "Dầu khí": "Energy",
    "Dầu Khí": "Energy",
    "Điện & Năng lượng tái tạo": "Energy",
    "Điện lực": "Energy",
    "Năng lượng": "Energy",
    "Vận tải": "Transportation",
    "Vận Tải": "Transportation",
    "Nông nghiệp": "Agriculture",
    "Xây dựng": "Construction",
    "Y tế": "Healthcare",
    "Viễn thông": "Telecom",
    "Du lịch & Giải trí": "Tourism",
    "Banking": "Banking",
    "Banks": "Banking",
    "Bank": "Banking",
    "Finance": "FinancialServices",
    "Financial Services": "FinancialServices",
    "Insurance": "Insurance",
    "Securities": "Securities",
    "Technology": "Technology",
    "Information Technology": "Technology",
    "Software": "Technology",
    "Real Estate": "RealEstate",
    "Real estate": "RealEstate",
    "Manufacturing": "Manufacturing",
    "Industrial": "Manufacturing",
    "Industrials": "Manufacturing",
    "Materials": "Manufacturing",
    "Consumer Staples": "Manufacturing",
    "Consumer Discretionary": "Retail",
    "Retail": "Retail",
    "Energy": "Energy",
    "Oil & Gas": "Energy",
    "Utilities": "Energy",
    "Healthcare": "Healthcare",
    "Health Care": "Healthcare",
    "Pharmaceuticals": "Healthcare",
    "Transportation": "Transportation",
    "Telecommunication": "Telecom",
    "Telecom": "Telecom",
    "Agriculture": "Agriculture",
    "Construction": "Construction",
    "Ngân hàng thương mại": "Banking",
    "Tài chính tiêu dùng": "FinancialServices",
    "Môi giới chứng khoán": "Securities",
    "Quản lý quỹ": "FinancialServices",
    "Bất động sản nhà ở": "RealEstate",
    "Bất động sản thương mại": "RealEstate",
    "Xây dựng & Vật liệu": "Construction",
    "Hàng tiêu dùng": "Retail",
    "Bán lẻ thực phẩm": "Retail",
    "Điện, khí đốt & nước": "Energy",
    "Khai khoáng": "Energy",
    "Thép & Kim loại": "Manufacturing",
    "Hóa chất cơ bản": "Manufacturing",
    "Dược phẩm & Sinh học": "Healthcare",
    "Thiết bị y tế": "Healthcare",
    "Phần mềm & Dịch vụ CNTT": "Technology",
    "Thiết bị công nghệ": "Technology",
    "Vận tải biển": "Transportation",
    "Vận tải hàng không": "Transportation",
    "Logistics": "Transportation",
    "Du lịch & Khách sạn": "Tourism",
    "Truyền thông & Giải trí": "Tourism",
}

# Ordered keyword groups for the substring fallback of the sector normaliser.
SECTOR_KEYWORDS = [
    (["ngân hàng", "bank", "tín dụng"], "Banking"),
    (["bảo hiểm", "insur"], "Insurance"),
    (["chứng khoán", "securit", "môi giới"], "Securities"),
    (["tài chính", "financ"], "FinancialServices"),
    (["bất động sản", "real estate"], "RealEstate"),
    (["công nghệ", "technology", "phần mềm", "software"], "Technology"),
    (["bán lẻ", "retail", "hàng tiêu dùng", "consumer"], "Retail"),
    (["dầu khí", "oil", "gas", "khai khoáng",
      "năng lượng", "energy", "điện lực", "utilities"], "Energy"),
    (["dược phẩm", "y tế", "health", "pharma"], "Healthcare"),
    (["vận tải", "transport", "logist"], "Transportation"),
    (["viễn thông", "telecom"], "Telecom"),
    (["xây dựng", "construct", "vật liệu"], "Construction"),
    (["nông nghiệp", "agri"], "Agriculture"),
    (["thép", "kim loại", "hóa chất", "dệt may",
      "thực phẩm", "đồ uống", "manufactur", "industri"], "Manufacturing"),
]
SECTOR_OTHER = "Other"

# --------------------------------------------------------------------------
# FIXED VALUES — sector reference medians used by feature engineering
# --------------------------------------------------------------------------

SECTOR_MEDIANS_REFERENCE = {
    "Banking": {"ROA": 0.014, "ROE": 0.140, "ROCE": 0.095,
                "Debt/Assets": 0.880, "Debt/Equity": 11.5,
                "Current_Ratio": 1.05, "EBIT_Margin": 0.275,
                "Asset_Turnover": 0.09, "Net_Debt/EBITDA": 0.05},
    "RealEstate": {"ROA": 0.038, "ROE": 0.088, "ROCE": 0.068,
                   "Debt/Assets": 0.620, "Debt/Equity": 2.4,
                   "Current_Ratio": 1.25, "EBIT_Margin": 0.195,
                   "Asset_Turnover": 0.27, "Net_Debt/EBITDA": 5.8},
    "Manufacturing": {"ROA": 0.058, "ROE": 0.115, "ROCE": 0.088,
                      "Debt/Assets": 0.440, "Debt/Equity": 0.95,
                      "Current_Ratio": 1.75, "EBIT_Margin": 0.088,
                      "Asset_Turnover": 1.0, "Net_Debt/EBITDA": 2.6},
    "Technology": {"ROA": 0.088, "ROE": 0.158, "ROCE": 0.128,
                   "Debt/Assets": 0.210, "Debt/Equity": 0.32,
                   "Current_Ratio": 2.4, "EBIT_Margin": 0.175,
                   "Asset_Turnover": 0.88, "Net_Debt/EBITDA": 0.9},
    "Retail": {"ROA": 0.065, "ROE": 0.148, "ROCE": 0.108,
               "Debt/Assets": 0.390, "Debt/Equity": 0.78,
               "Current_Ratio": 1.45, "EBIT_Margin": 0.048,
               "Asset_Turnover": 1.75, "Net_Debt/EBITDA": 2.1},
    "Energy": {"ROA": 0.052, "ROE": 0.108, "ROCE": 0.082,
               "Debt/Assets": 0.495, "Debt/Equity": 1.18,
               "Current_Ratio": 1.48, "EBIT_Margin": 0.148,
               "Asset_Turnover": 0.52, "Net_Debt/EBITDA": 3.2},
    "FinancialServices": {"ROA": 0.032, "ROE": 0.118, "ROCE": 0.088,
                          "Debt/Assets": 0.680, "Debt/Equity": 3.8,
                          "Current_Ratio": 1.22, "EBIT_Margin": 0.195,
                          "Asset_Turnover": 0.16, "Net_Debt/EBITDA": 1.6},
    "Healthcare": {"ROA": 0.072, "ROE": 0.138, "ROCE": 0.108,
                   "Debt/Assets": 0.340, "Debt/Equity": 0.68,
                   "Current_Ratio": 2.05, "EBIT_Margin": 0.118,
                   "Asset_Turnover": 0.72, "Net_Debt/EBITDA": 1.4},
}
REFERENCE_DEFAULT_SECTOR = "Manufacturing"
MIN_SAMPLES_FOR_DYNAMIC_MEDIAN = 5

# --------------------------------------------------------------------------
# FIXED VALUES — sector medians used by merge-time imputation
# --------------------------------------------------------------------------

SECTOR_MEDIANS_IMPUTE = {
    "Banking": {
        "ROA": 0.015, "ROE": 0.14, "ROCE": 0.10,
        "Debt/Assets": 0.88, "Debt/Equity": 12.0,
        "Current_Ratio": 1.10, "EBIT_Margin": 0.28,
        "Asset_Turnover": 0.10, "Net_Debt/EBITDA": 0.03,
        "WCTA": 0.05, "RETA": 0.30, "Market_to_Book": 1.30,
        "Revenue_Growth_YoY": 0.09, "Log_Revenue": 9.0, "Market_Cap": 5e10,
    },
    "RealEstate": {
        "ROA": 0.040, "ROE": 0.09, "ROCE": 0.07,
        "Debt/Assets": 0.65, "Debt/Equity": 2.50,
        "Current_Ratio": 1.20, "EBIT_Margin": 0.20,
        "Asset_Turnover": 0.28, "Net_Debt/EBITDA": 5.50,
        "WCTA": 0.10, "RETA": 0.15, "Market_to_Book": 1.50,
        "Revenue_Growth_YoY": 0.11, "Log_Revenue": 8.5, "Market_Cap": 1e10,
    },
    "Manufacturing": {
        "ROA": 0.060, "ROE": 0.12, "ROCE": 0.09,
        "Debt/Assets": 0.45, "Debt/Equity": 1.00,
        "Current_Ratio": 1.80, "EBIT_Margin": 0.09,
        "Asset_Turnover": 1.00, "Net_Debt/EBITDA": 2.50,
        "WCTA": 0.25, "RETA": 0.25, "Market_to_Book": 1.80,
        "Revenue_Growth_YoY": 0.08, "Log_Revenue": 8.0, "Market_Cap": 5e9,
    },
    "Technology": {
        "ROA": 0.090, "ROE": 0.16, "ROCE": 0.13,
        "Debt/Assets": 0.20, "Debt/Equity": 0.30,
        "Current_Ratio": 2.50, "EBIT_Margin": 0.18,
        "Asset_Turnover": 0.85, "Net_Debt/EBITDA": 0.80,
        "WCTA": 0.35, "RETA": 0.25, "Market_to_Book": 4.00,
        "Revenue_Growth_YoY": 0.20, "Log_Revenue": 8.0, "Market_Cap": 8e9,
    },
    "Retail": {
        "ROA": 0.070, "ROE": 0.15, "ROCE": 0.11,
        "Debt/Assets": 0.40, "Debt/Equity": 0.80,
        "Current_Ratio": 1.50, "EBIT_Margin": 0.05,
        "Asset_Turnover": 1.80, "Net_Debt/EBITDA": 2.00,
        "WCTA": 0.20, "RETA": 0.22, "Market_to_Book": 2.00,
        "Revenue_Growth_YoY": 0.10, "Log_Revenue": 8.5, "Market_Cap": 3e9,
    },
    "Energy": {
        "ROA": 0.050, "ROE": 0.11, "ROCE": 0.08,
        "Debt/Assets": 0.50, "Debt/Equity": 1.20,
        "Current_Ratio": 1.50, "EBIT_Margin": 0.15,
        "Asset_Turnover": 0.50, "Net_Debt/EBITDA": 3.00,
        "WCTA": 0.18, "RETA": 0.20, "Market_to_Book": 1.60,
        "Revenue_Growth_YoY": 0.07, "Log_Revenue": 9.0, "Market_Cap": 2e10,
    },
    "FinancialServices": {
        "ROA": 0.030, "ROE": 0.12, "ROCE": 0.09,
        "Debt/Assets": 0.70, "Debt/Equity": 4.00,
        "Current_Ratio": 1.20, "EBIT_Margin": 0.20,
        "Asset_Turnover": 0.15, "Net_Debt/EBITDA": 1.50,
        "WCTA": 0.10, "RETA": 0.18, "Market_to_Book": 1.50,
        "Revenue_Growth_YoY": 0.10, "Log_Revenue": 8.0, "Market_Cap": 5e9,
    },
    "Healthcare": {
        "ROA": 0.070, "ROE": 0.14, "ROCE": 0.11,
        "Debt/Assets": 0.35, "Debt/Equity": 0.70,
        "Current_Ratio": 2.00, "EBIT_Margin": 0.12,
        "Asset_Turnover": 0.70, "Net_Debt/EBITDA": 1.50,
        "WCTA": 0.28, "RETA": 0.22, "Market_to_Book": 2.50,
        "Revenue_Growth_YoY": 0.12, "Log_Revenue": 7.5, "Market_Cap": 2e9,
    },
    "Construction": {
        "ROA": 0.035, "ROE": 0.10, "ROCE": 0.07,
        "Debt/Assets": 0.60, "Debt/Equity": 1.80,
        "Current_Ratio": 1.30, "EBIT_Margin": 0.07,
        "Asset_Turnover": 0.60, "Net_Debt/EBITDA": 4.00,
        "WCTA": 0.12, "RETA": 0.12, "Market_to_Book": 1.30,
        "Revenue_Growth_YoY": 0.06, "Log_Revenue": 7.8, "Market_Cap": 1e9,
    },
    "Agriculture": {
        "ROA": 0.045, "ROE": 0.10, "ROCE": 0.08,
        "Debt/Assets": 0.40, "Debt/Equity": 0.90,
        "Current_Ratio": 1.60, "EBIT_Margin": 0.08,
        "Asset_Turnover": 0.90, "Net_Debt/EBITDA": 2.50,
        "WCTA": 0.22, "RETA": 0.18, "Market_to_Book": 1.40,
        "Revenue_Growth_YoY": 0.07, "Log_Revenue": 7.5, "Market_Cap": 1e9,
    },
    "Transportation": {
        "ROA": 0.040, "ROE": 0.10, "ROCE": 0.07,
        "Debt/Assets": 0.55, "Debt/Equity": 1.50,
        "Current_Ratio": 1.20, "EBIT_Margin": 0.10,
        "Asset_Turnover": 0.60, "Net_Debt/EBITDA": 3.50,
        "WCTA": 0.08, "RETA": 0.15, "Market_to_Book": 1.40,
        "Revenue_Growth_YoY": 0.08, "Log_Revenue": 8.0, "Market_Cap": 2e9,
    },
    "Telecom": {
        "ROA": 0.055, "ROE": 0.13, "ROCE": 0.10,
        "Debt/Assets": 0.45, "Debt/Equity": 1.10,
        "Current_Ratio": 1.30, "EBIT_Margin": 0.18,
        "Asset_Turnover": 0.55, "Net_Debt/EBITDA": 2.00,
        "WCTA": 0.10, "RETA": 0.20, "Market_to_Book": 2.00,
        "Revenue_Growth_YoY": 0.05, "Log_Revenue": 9.0, "Market_Cap": 5e10,
    },
}
IMPUTE_DEFAULT_SECTOR = "Manufacturing"

# Second adapter's imputation table (I2): 6 sectors x 11 features.
SECTOR_MEDIANS_IMPUTE_B = {
    "Banking": {"ROA": 0.015, "ROE": 0.14, "ROCE": 0.10,
                "Debt/Assets": 0.88, "Debt/Equity": 12.0,
                "Current_Ratio": 0.85, "EBIT_Margin": 0.28,
                "Asset_Turnover": 0.10, "Net_Debt/EBITDA": 0.03,
                "WCTA": 0.05, "RETA": 0.05},
    "RealEstate": {"ROA": 0.04, "ROE": 0.09, "ROCE": 0.07,
                   "Debt/Assets": 0.65, "Debt/Equity": 2.5,
                   "Current_Ratio": 1.2, "EBIT_Margin": 0.20,
                   "Asset_Turnover": 0.28, "Net_Debt/EBITDA": 5.5,
                   "WCTA": 0.10, "RETA": 0.15},
    "Manufacturing": {"ROA": 0.06, "ROE": 0.12, "ROCE": 0.09,
                      "Debt/Assets": 0.45, "Debt/Equity": 1.0,
                      "Current_Ratio": 1.8, "EBIT_Margin": 0.09,
                      "Asset_Turnover": 1.0, "Net_Debt/EBITDA": 2.5,
                      "WCTA": 0.25, "RETA": 0.25},
    "Technology": {"ROA": 0.09, "ROE": 0.16, "ROCE": 0.13,
                   "Debt/Assets": 0.20, "Debt/Equity": 0.3,
                   "Current_Ratio": 2.5, "EBIT_Margin": 0.18,
                   "Asset_Turnover": 0.85, "Net_Debt/EBITDA": 0.8,
                   "WCTA": 0.35, "RETA": 0.25},
    "Retail": {"ROA": 0.07, "ROE": 0.15, "ROCE": 0.11,
               "Debt/Assets": 0.40, "Debt/Equity": 0.8,
               "Current_Ratio": 1.5, "EBIT_Margin": 0.05,
               "Asset_Turnover": 1.8, "Net_Debt/EBITDA": 2.0,
               "WCTA": 0.20, "RETA": 0.22},
    "Energy": {"ROA": 0.05, "ROE": 0.11, "ROCE": 0.08,
               "Debt/Assets": 0.50, "Debt/Equity": 1.2,
               "Current_Ratio": 1.5, "EBIT_Margin": 0.15,
               "Asset_Turnover": 0.5, "Net_Debt/EBITDA": 3.0,
               "WCTA": 0.18, "RETA": 0.20},
}

# Second foreign adapter (P7/G2): column map, sector map and proxy defaults.
FOREIGN_COLUMN_MAP_B = {
    "returnOnAssets": "ROA",
    "returnOnEquity": "ROE",
    "returnOnCapitalEmployed": "ROCE",
    "operatingProfitMargin": "EBIT_Margin",
    "ebitPerRevenue": "EBIT_Margin",
    "currentRatio": "Current_Ratio",
    "debtRatio": "Debt/Assets",
    "debtEquityRatio": "Debt/Equity",
    "assetTurnover": "Asset_Turnover",
    "companyEquityMultiplier": "Market_to_Book",
    "netProfitMargin": "_Net_Profit_Margin",
    "grossProfitMargin": "_Gross_Margin",
    "freeCashFlowOperatingCashFlowRatio": "_FCF_OCF_Ratio",
}
FOREIGN_SECTOR_MAP_B = {
    "Banking": "Banking", "Finance": "FinancialServices",
    "Insurance": "Insurance", "Technology": "Technology",
    "Consumer Durables": "Manufacturing", "Consumer Discretionary": "Retail",
    "Consumer Staples": "Manufacturing", "Healthcare": "Healthcare",
    "Energy": "Energy", "Materials": "Manufacturing",
    "Industrials": "Manufacturing", "Real Estate": "RealEstate",
    "Utilities": "Energy", "Communication Services": "Telecom",
}

# Features normalised against reference medians at merge time.
MERGE_RATIO_FEATURES = [
    "ROA", "ROE", "EBIT_Margin", "Current_Ratio",
    "Debt/Assets", "Asset_Turnover", "Net_Debt/EBITDA",
]
# Features whose sector median feeds the dynamic-median table.
DYNAMIC_MEDIAN_FEATURES = [
    "ROA", "ROE", "Debt/Assets", "Current_Ratio",
    "EBIT_Margin", "Asset_Turnover", "ROCE", "Debt/Equity", "Net_Debt/EBITDA",
]
# Features normalised to sector medians in feature engineering.
SECTOR_RATIO_FEATURES = [
    "ROA", "ROE", "Debt/Assets", "Current_Ratio", "EBIT_Margin", "Asset_Turnover",
]
# Features crossed with sector dummies.
INTERACTION_FEATURES = [
    "ROA", "ROE", "Debt/Assets", "EBIT_Margin", "Current_Ratio", "Revenue_Growth_YoY",
]
# Leverage features exempt from IQR clipping on Banking rows.
BANKING_LEVERAGE = ["Debt/Assets", "Debt/Equity", "Net_Debt/EBITDA"]

# --------------------------------------------------------------------------
# FIXED VALUES — foreign ratio file (P3/P4) and winsorize bounds
# --------------------------------------------------------------------------

FOREIGN_COLUMN_MAP = {
    "Rating": "Credit_Rating",
    "Symbol": "Ticker",
    "Sector": "Sector",
    "returnOnAssets": "ROA",
    "returnOnEquity": "ROE",
    "returnOnCapitalEmployed": "ROCE",
    "operatingProfitMargin": "EBIT_Margin",
    "ebitPerRevenue": "_ebitPerRevenue",
    "netProfitMargin": "_netProfitMargin",
    "grossProfitMargin": "_grossProfitMargin",
    "currentRatio": "Current_Ratio",
    "quickRatio": "_quickRatio",
    "cashRatio": "_cashRatio",
    "debtRatio": "Debt/Assets",
    "debtEquityRatio": "Debt/Equity",
    "companyEquityMultiplier": "_equityMultiplier",
    "assetTurnover": "Asset_Turnover",
    "fixedAssetTurnover": "_fixedAssetTurnover",
    "payablesTurnover": "_payablesTurnover",
    "daysOfSalesOutstanding": "_dso",
    "freeCashFlowOperatingCashFlowRatio": "_fcf_ocf_ratio",
    "operatingCashFlowSalesRatio": "_ocf_sales_ratio",
    "freeCashFlowPerShare": "_fcf_per_share",
    "operatingCashFlowPerShare": "_ocf_per_share",
    "cashPerShare": "_cash_per_share",
    "effectiveTaxRate": "_tax_rate",
    "enterpriseValueMultiple": "_ev_multiple",
    "pretaxProfitMargin": "_pretax_margin",
}

FOREIGN_CLIP_BOUNDS = {
    "ROA": (-0.5, 0.5),
    "ROE": (-2.0, 2.0),
    "ROCE": (-1.0, 1.0),
    "EBIT_Margin": (-1.0, 1.0),
    "Current_Ratio": (0.0, 20.0),
    "Debt/Assets": (0.0, 1.0),
    "Debt/Equity": (-10.0, 30.0),
    "Asset_Turnover": (0.0, 10.0),
    "_quickRatio": (0.0, 20.0),
    "_fixedAssetTurnover": (0.0, 50.0),
    "_payablesTurnover": (0.0, 100.0),
    "_dso": (0.0, 500.0),
    "_fcf_ocf_ratio": (-5.0, 5.0),
    "_ocf_sales_ratio": (-2.0, 5.0),
    "_ev_multiple": (-100.0, 200.0),
    "_tax_rate": (-1.0, 2.0),
}

ADAPTER_COLUMN_MAP = {
    "roa": "ROA", "ROA": "ROA", "returnOnAssets": "ROA",
    "roe": "ROE", "ROE": "ROE", "returnOnEquity": "ROE",
    "roce": "ROCE", "ROCE": "ROCE",
    "ebit_margin": "EBIT_Margin", "EBIT_Margin": "EBIT_Margin",
    "current_ratio": "Current_Ratio", "Current_Ratio": "Current_Ratio",
    "debt_assets": "Debt/Assets", "Debt/Assets": "Debt/Assets",
    "debt_equity": "Debt/Equity", "Debt/Equity": "Debt/Equity",
    "net_debt_ebitda": "Net_Debt/EBITDA", "Net_Debt/EBITDA": "Net_Debt/EBITDA",
    "asset_turnover": "Asset_Turnover", "Asset_Turnover": "Asset_Turnover",
    "wcta": "WCTA", "WCTA": "WCTA",
    "reta": "RETA", "RETA": "RETA",
    "market_to_book": "Market_to_Book", "Market_to_Book": "Market_to_Book",
    "revenue_growth_yoy": "Revenue_Growth_YoY", "Revenue_Growth_YoY": "Revenue_Growth_YoY",
    "log_revenue": "Log_Revenue", "Log_Revenue": "Log_Revenue",
    "market_cap": "Market_Cap", "Market_Cap": "Market_Cap",
    "ticker": "Ticker", "Ticker": "Ticker", "symbol": "Ticker",
    "sector": "Sector", "Sector": "Sector",
    "credit_rating": "Credit_Rating", "Credit_Rating": "Credit_Rating",
}

# Source signatures.
SIGNATURE_FOREIGN = ["returnOnAssets", "returnOnEquity", "debtRatio",
                     "currentRatio", "assetTurnover", "Rating Agency Name"]
SIGNATURE_FOREIGN_MIN = 3
SIGNATURE_ADAPTER = ["_Is_Bank", "Has_Rating", "_Revenue", "_Net_Income"]
SIGNATURE_ADAPTER_MIN = 2
SIGNATURE_CANONICAL = ["ROA", "ROE", "EBIT_Margin", "Current_Ratio", "Debt/Assets"]
SIGNATURE_CANONICAL_MIN = 4

# Domain-adaptation profile.
LOCAL_MARKET_PROFILE = {
    "Debt/Assets": 0.52, "EBIT_Margin": 0.14,
    "Asset_Turnover": 0.65, "ROA": 0.055, "ROE": 0.125,
}
LOCAL_MARKET_STD = {
    "Debt/Assets": 0.25, "EBIT_Margin": 0.12,
    "Asset_Turnover": 0.55, "ROA": 0.05, "ROE": 0.08,
}
DOMAIN_BASE_WEIGHT = 0.5
DOMAIN_MAX_WEIGHT = 2.0

# --------------------------------------------------------------------------
# FIXED VALUES — statement line-item candidates (P15), variant A
# --------------------------------------------------------------------------

BALANCE_CANDIDATES = {
    "total_assets": [
        "total_assets", "total_liabilities_and_owners_equity",
        "total_owners_equity_and_liabilities", "assets",
        "TOTAL ASSETS (Bn. VND)", "totalAssets", "Total Assets", "tong_tai_san",
    ],
    "total_liabilities": [
        "total_liabilities", "a.liabilities", "liabilities",
        "LIABILITIES (Bn. VND)", "totalLiabilities", "Total Liabilities", "TOTAL RESOURCES (Bn. VND)",
    ],
    "total_equity": [
        "b.owners_equity", "viii.capital_and_reserves", "i.owners_equity",
        "total_equity", "equity", "owners_equity",
        "OWNER'S EQUITY(Bn.VND)", "stockholders_equity", "Owner Equity",
        "totalStockholdersEquity", "von_chu_so_huu",
    ],
    "short_term_assets": [
        "a.short_term_assets", "short_term_assets", "current_assets",
        "SHORT-TERM ASSETS (Bn. VND)", "Total Current Assets",
        "currentAssets", "tai_san_ngan_han",
        "Current Assets", "Short-term Assets", "Short Term Assets",
    ],
    "short_term_liabilities": [
        "i.short_term_liabilities", "short_term_liabilities", "current_liabilities",
        "SHORT-TERM LIABILITIES (Bn. VND)", "Total Current Liabilities",
        "currentLiabilities", "no_ngan_han",
        "Current Liabilities", "Short-term Liabilities", "Short Term Liabilities",
    ],
    "long_term_debt": [
        "long_term_borrowings", "long_term_debt", "longTermDebt",
        "ii.long_term_liabilities", "long_term_liabilities",
        "ix.convertible_bonds_cds_and_other_valuable_papers_issued",
        "no_dai_han", "Convertible bonds/CDs and other valuable papers issued",
        "Long-term Debt", "Long Term Borrowings",
    ],
    "short_term_debt": [
        "ii.deposits_and_borrowings_from_other_credit_institutions",
        "deposits_and_borrowings_from_other_credit_institutions",
        "i.due_to_gov_and_borrowings_from_sbv",
        "short_term_borrowings", "short_term_debt",
        "shortTermDebt", "Short Term Borrowings",
        "Deposits and borrowings from other credit institutions",
        "Due to Gov and borrowings from SBV",
        "Short-term Debt", "Short-term Borrowings",
    ],
    "cash": [
        "i.cash_and_cash_equivalents", "i.cash_gold_and_silver_precious_stones",
        "cash_and_cash_equivalents", "cash",
        "Cash and cash equivalents (Bn. VND)", "cashAndCashEquivalents",
        "tien_va_tuong_duong_tien", "CASH (Bn. VND)",
    ],
    "retained_earnings": [
        "n_11.undistributed_earnings_after_tax",
        "n_5.undistributed_earnings_after_tax_accumulated_loss",
        "undistributed_earnings_in_this_period",
        "undistributed_earnings", "retained_earnings", "retainedEarnings",
        "Undistributed earnings (Bn. VND)", "Retained Earnings",
        "loi_nhuan_chua_phan_phoi", "Undistributed Earnings", "Retained Profit",
    ],
    "long_term_assets": [
        "b.long_term_assets", "long_term_assets", "non_current_assets",
        "LONG-TERM ASSETS (Bn. VND)", "Total Non-Current Assets",
        "nonCurrentAssets", "tai_san_dai_han",
    ],
    "customer_deposits": [
        "iii.deposits_from_customers",
        "deposits_from_customers", "customer_deposits", "deposits",
        "Deposits from customers", "Customer Deposits", "Deposits from Customers",
    ],
    "loans_to_customers": [
        "vi.loans_advances_and_finance_leases_to_customers",
        "n_1.loans_advances_and_finance_leases_to_customers",
        "loans_and_advances_to_customers", "loans_to_customers", "net_loans",
        "Loans and advances to customers, net",
        "Loans and advances to customers",
        "Loan and Advances to Customers",
    ],
    "fixed_assets": [
        "ii.fixed_assets", "x.fixed_assets",
        "fixed_assets", "tangible_fixed_assets", "property_plant_and_equipment",
        "Fixed Assets", "Property Plant Equipment",
        "Tangible Fixed Assets", "FIXED ASSETS (Bn. VND)",
    ],
    "inventory": [
        "iv.inventories", "inventories", "inventory",
        "Inventories", "Inventory", "INVENTORIES (Bn. VND)", "hang_ton_kho",
    ],
    "accounts_receivable": [
        "iii.short_term_receivables",
        "short_term_receivables", "trade_receivables", "accounts_receivable",
        "Short-term Receivables", "Accounts Receivable",
        "Trade Receivables", "SHORT-TERM RECEIVABLES (Bn. VND)", "phai_thu_ngan_han",
    ],
    "short_term_investments": [
        "short_term_financial_investments", "short_term_investments",
        "Short-term Investments", "SHORT-TERM INVESTMENTS (Bn. VND)",
        "Short-term Financial Investments",
    ],
    # inline lists of the current-ratio and ROCE fallbacks
    "short_term_liabilities_alt_roce": [
        "SHORT-TERM LIABILITIES (Bn. VND)",
        "short_term_liabilities", "Current Liabilities",
        "Short-term Liabilities", "Short Term Liabilities",
        "no_ngan_han",
    ],
    "short_term_assets_alt": [
        "SHORT-TERM ASSETS (Bn. VND)", "Current Assets", "Short-term Assets",
        "Short Term Assets", "CURRENT ASSETS (Bn. VND)", "tai_san_ngan_han",
    ],
    "short_term_liabilities_alt": [
        "SHORT-TERM LIABILITIES (Bn. VND)", "Current Liabilities", "Short-term Liabilities",
        "Short Term Liabilities", "CURRENT LIABILITIES (Bn. VND)", "no_ngan_han",
    ],
}

INCOME_CANDIDATES = {
    "revenue": [
        "n_3.net_revenue",
        "ix.operating_profit_before_provision_for_credit_losses",
        "i.net_interest_income",
        "net_revenue", "revenue", "net_sales",
        "Revenue (Bn. VND)", "Net Revenue", "Net Sales", "netRevenue",
        "doanh_thu_thuan", "Total operating revenue", "REVENUE (Bn. VND)",
    ],
    "revenue_yoy": [
        "net_revenue", "Revenue YoY (%)",
    ],
    "net_income": [
        "n_18.net_profit_after_tax",
        "xiii.net_profit_after_tax",
        "xv.net_profit_atttributable_to_the_equity_holders_of_the_bank",
        "profit_after_tax_for_shareholders_of_parent_company",
        "profit_after_tax", "net_profit_after_tax", "net_income", "net_profit",
        "Net Profit For the Year", "Attributable to parent company",
        "netIncome", "loi_nhuan_sau_thue", "Net Income", "Profit After Tax",
    ],
    "ebit": [
        "n_11.operating_profit",
        "ix.operating_profit_before_provision_for_credit_losses",
        "operating_profit", "profit_from_operations", "ebit",
        "Operating Profit before Provision", "operating_income", "Operating Income", "EBIT",
        "operatingIncome", "Operating Profit", "Earnings Before Interest and Tax",
        "Operating Profit (Loss)", "EBIT (Bn. VND)", "Profit from Operations",
    ],
    "profit_before_tax": [
        "n_15.profit_before_tax", "xi.profit_before_tax",
        "profit_before_tax", "pre_tax_profit", "earnings_before_tax",
        "Profit before tax", "Pre-tax Profit", "Earnings Before Tax", "EBT",
        "Profit Before Tax (Bn. VND)",
    ],
    "interest_expense": [
        "of_which_interest_expenses", "interest_expense",
        "n_2.interest_expense_and_similar_expenses",
        "Interest and Similar Expenses", "interestExpense", "chi_phi_lai_vay",
        "Finance Costs", "Interest Expense", "Financial Expenses",
    ],
    "gross_profit": [
        "n_5.gross_profit", "gross_profit", "gross_profit_from_sales",
        "Gross Profit", "grossProfit", "Gross Profit (Bn. VND)", "loi_nhuan_gop",
    ],
    "cogs": [
        "n_4.cost_of_goods_sold", "cost_of_goods_sold", "direct_costs", "cogs",
        "Cost of Goods Sold", "COGS", "Cost of Sales", "Direct Costs",
        "COST OF GOODS SOLD (Bn. VND)",
    ],
    "net_interest_income": [
        "i.net_interest_income", "net_interest_income",
        "Net Interest Income", "netInterestIncome", "thu_nhap_lai_thuan",
    ],
    "total_operating_income": [
        "total_operating_income", "total_operating_revenue",
        "Total operating revenue", "totalOperatingIncome",
    ],
    "depreciation": [
        "depreciation_of_fixed_assets_and_properties_investment",
        "depreciation_and_amortization", "depreciation",
        "depreciationAndAmortization", "khau_hao", "D&A",
        "Depreciation & Amortization", "Depreciation And Amortization",
    ],
    "selling_expenses": [
        "n_9.selling_expenses", "selling_expenses", "selling_and_distribution_expenses",
        "Selling Expenses", "Selling and Distribution Expenses",
    ],
    "admin_expenses": [
        "n_10.general_and_administrative_expenses",
        "general_and_administrative_expenses", "admin_expenses", "administrative_expenses",
        "General and Administrative Expenses", "Administrative Expenses", "G&A Expenses",
    ],
    # inline lists of the EBIT bank path and the bank revenue lines
    "bank_operating_profit": ["Operating Profit before Provision", "Profit before tax"],
    "bank_fee_income": ["ii.net_fee_and_commission_income"],
    "bank_fx_income": ["iii.net_gain_loss_from_foreign_currencies_and_gold_trading"],
    "bank_trading_income": ["iv.net_gain_loss_from_trading_securities"],
    "bank_investment_income": ["v.net_gain_loss_from_investment_securities"],
    "bank_other_income": ["vi.net_other_income"],
    "bank_dividend_income": ["vii.income_from_capital_contribution_and_long_term_investments"],
}

CASHFLOW_CANDIDATES = {
    "operating_cashflow": [
        "net_cash_flows_from_operating_activities",
        "i.cash_flows_from_operating_activities",
        "cash_flows_from_operating_activities", "operating_cashflow", "operating_activities",
        "Net Cash From Operating Activities", "netCashOperatingActivities",
        "luong_tien_tu_hoat_dong_kinh_doanh",
    ],
    # depreciation is looked up in the cash flow first, with the income list
    "depreciation": [
        "depreciation_of_fixed_assets_and_properties_investment",
        "depreciation_and_amortization", "depreciation",
        "depreciationAndAmortization", "khau_hao", "D&A",
        "Depreciation & Amortization", "Depreciation And Amortization",
    ],
}

RATIO_CANDIDATES = {
    "ebit_margin_direct": ["ebit_margin"],
    "roe": ["roe", "return_on_equity_roe",
            "Chỉ tiêu khả năng sinh lợi_ROE (%)", "ROE", "returnOnEquity"],
    "roa": ["roa", "return_on_assets_roa",
            "Chỉ tiêu khả năng sinh lợi_ROA (%)", "ROA", "returnOnAssets"],
    "net_profit_margin": ["net_profit_margin", "profit_margin",
                          "Chỉ tiêu khả năng sinh lợi_Net Profit Margin (%)", "netProfitMargin"],
    "market_cap": ["market_cap", "market_capitalization",
                   "Chỉ tiêu định giá_Market Capital (Bn. VND)", "marketCap", "MarketCap"],
    "price_to_book": ["p_b", "price_to_book", "pb",
                      "Chỉ tiêu định giá_P/B", "priceToBook", "P/B"],
    "price_to_earnings": ["p_e", "price_to_earnings", "pe",
                          "Chỉ tiêu định giá_P/E", "P/E"],
    "current_ratio_direct": [
        "short_term_ratio", "current_ratio", "liquidity_ratio",
        "Chỉ tiêu thanh khoản_Current Ratio",
        "Chỉ tiêu thanh khoản_Hệ số thanh toán hiện hành",
        "currentRatio", "Current Ratio", "Liquidity Ratio",
    ],
    "roce_direct": [
        "return_on_capital_employed_roce", "roce", "return_on_capital_employed",
        "Chỉ tiêu sinh lợi_ROCE (%)", "ROCE", "returnOnCapitalEmployed",
    ],
    # inline lists of the revenue-growth lookups
    "revenue_growth_pct": ["net_revenue", "Revenue YoY (%)"],
    "bank_growth_nii": ["net_interest_income"],
    "bank_growth_opp": ["operating_profit_before_provision_for_credit_losses"],
}

# --------------------------------------------------------------------------
# FIXED VALUES — statement line-item keys, variant B (rated-list crawl)
# --------------------------------------------------------------------------

CANDIDATES_B = {
    ("balance", "total_assets", 0): ["total_assets", "total_liabilities_and_owners_equity",
                                     "total_owners_equity_and_liabilities", "assets",
                                     "TOTAL ASSETS (Bn. VND)", "totalAssets"],
    ("balance", "total_liabilities", 0): ["total_liabilities", "a.liabilities", "liabilities",
                                          "LIABILITIES (Bn. VND)", "totalLiabilities"],
    ("balance", "total_equity", 0): ["b.owners_equity", "viii.capital_and_reserves",
                                     "i.owners_equity", "total_equity", "equity",
                                     "OWNER'S EQUITY(Bn.VND)", "totalStockholdersEquity"],
    ("balance", "current_assets", 0): ["a.short_term_assets", "current_assets",
                                       "SHORT-TERM ASSETS (Bn. VND)", "currentAssets"],
    ("balance", "current_liabilities", 0): ["i.short_term_liabilities", "current_liabilities",
                                            "SHORT-TERM LIABILITIES (Bn. VND)", "currentLiabilities"],
    ("balance", "long_term_debt", 0): ["long_term_debt", "long_term_loans", "longTermDebt",
                                       "c.long_term_liabilities", "ii.long_term_liabilities"],
    ("balance", "short_term_debt", 0): ["short_term_loans", "short_term_debt", "shortTermDebt",
                                        "i.2.short_term_loans"],
    ("balance", "retained", 0): ["retained_earnings", "retainedEarnings",
                                 "iv.undistributed_profit_after_tax", "undistributed_profit"],
    ("balance", "cash", 0): ["cash", "cash_and_cash_equivalents",
                             "i.cash_and_cash_equivalents",
                             "i.cash_gold_and_silver_precious_stones"],
    ("balance", "prev_equity", 1): ["b.owners_equity", "viii.capital_and_reserves",
                                    "total_equity", "equity"],
    ("income", "revenue", 0): ["revenue", "net_revenue", "NET REVENUE (Bn. VND)",
                               "net_sales", "1.revenue",
                               "i.1.revenues_from_sales_of_goods"],
    ("income", "ebit", 0): ["ebit", "EBIT (Bn. VND)", "operating_profit",
                            "3.operating_profit"],
    ("income", "net_profit", 0): ["net_profit", "net_income", "NET PROFIT (Bn. VND)",
                                  "profit_after_tax", "net_profit_after_tax",
                                  "9.profit_after_tax", "15.profit_after_tax"],
    ("income", "gross_profit", 0): ["gross_profit", "GROSS PROFIT (Bn. VND)",
                                    "3.gross_profit", "2.gross_profit_on_sales"],
    ("income", "prev_revenue", 1): ["revenue", "net_revenue", "NET REVENUE (Bn. VND)",
                                    "net_sales", "1.revenue"],
    ("ratio", "roa_direct", 0): ["roa", "ROA", "return_on_assets"],
    ("ratio", "roe_direct", 0): ["roe", "ROE", "return_on_equity"],
}

# --------------------------------------------------------------------------
# FIXED VALUES — training parameters
# --------------------------------------------------------------------------

SEED = 42
TEST_SIZE = 0.2
CV_FOLDS = 5
CV_REPEATS = 3
LOCAL_SAMPLE_WEIGHT = 3.0
MERGE_LOCAL_WEIGHT = 3.0
MIN_CLASS_SIZE = 3
LOO_CV_THRESHOLD = 50
MIN_LOCAL_FOR_FINETUNE = 10
FINETUNE_LOCAL_WEIGHT = 5.0
FINETUNE_EXTRA_TREES = 100
FINETUNE_RATE_FACTOR = 0.3
FINETUNE_EXTRA_ROUNDS_BOOSTED = 50
FINETUNE_EXTRA_ROUNDS_GB = 50
FOREST_PARAMS = {"n_trees": 300, "max_depth": 10, "min_samples_split": 5}
BOOSTED_PARAMS = {"n_rounds": 300, "max_depth": 8, "learning_rate": 0.03,
                  "subsample": 0.8, "colsample": 0.8}
GB_PARAMS = {"n_rounds": 200, "max_depth": 6, "learning_rate": 0.05}
ORDINAL_BASE_PARAMS = {"n_rounds": 200, "max_depth": 4, "learning_rate": 0.05, "subsample": 0.8}

# ---------------------------------------------------------------- header aliases of loaded files
RATED_TICKER_ALIASES = ["ticker", "symbol", "ma", "mã"]
RATED_GRADE_ALIASES = ["credit_rating", "rating", "xephangtindung"]
LISTING_TICKER_ALIASES = ["symbol", "ticker", "ma", "mã"]
LISTING_SECTOR_ALIASES = ["industry_name", "ten_nganh", "nganh", "icb_name", "industry"]
EXCHANGE_ALIASES = ["exchange", "Exchange"]
COMPANY_NAME_ALIASES = ["short_name", "shortName", "company_name", "companyName", "organ_name", "organName", "symbol"]
BLANK_SECTORS = ["", "nan", "None"]
