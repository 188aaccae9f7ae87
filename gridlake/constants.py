"""Thresholds, word lists and patterns that results depend on."""

# Values that stand for "no value", case folded and trimmed (cells), upper case (evidence), upper case (extraction).
PLACEHOLDERS_CELL = ("", "?", "-", "na", "n/a", "nm", "#pend", "none", "null")
PLACEHOLDERS_EVIDENCE = ("", "-", "?", "NA", "N/A", "NM", "#PEND", "NULL")
PLACEHOLDERS_EXTRACTION = ("", "-", "NA", "N/A", "NM", "#PEND", "NULL")

# Statuses of an observation; of several the first one holds.
AVAILABLE, INVALID, AMBIGUOUS, MISSING, NOT_MEANINGFUL = "available", "invalid", "ambiguous", "missing", "not_meaningful"
STATUS_PRIORITY = (INVALID, AMBIGUOUS, MISSING, NOT_MEANINGFUL)

# Score bounds: growth, margin; weights of the composite; tiers.
GROWTH_FLOOR, GROWTH_CEILING = -10.0, 12.0
MARGIN_FLOOR, MARGIN_CEILING = -5.0, 15.0
GROWTH_WEIGHT, MARGIN_WEIGHT, STABILITY_WEIGHT = 0.35, 0.35, 0.30
TIERS = (("S", 90.0), ("A", 75.0), ("B", 50.0))
FORECAST_FLOOR, FORECAST_CEILING, FORECAST_YEARS = -0.12, 0.30, 3
CAGR_EDGES, MARGIN_EDGES = (-5, 5, 10, 15, 20, 30), (0, 5, 10, 15, 20, 30)

# Changes in percentage points that part the trend classes.
TREND_STRONG, TREND_WEAK = 2.0, 0.5

# Formulas of derived metrics.
FORMULAS = {
    "operating_margin": "operating_income / revenue * 100",
    "net_margin": "net_income / revenue * 100",
    "free_cash_flow": "operating_cash_flow + capital_expenditure",
    "free_cash_flow_margin": "free_cash_flow / revenue * 100",
    "debt_ratio": "total_liabilities / total_assets * 100",
    "net_debt_ratio": "net_debt / total_assets * 100",
    "net_debt": "total_debt - cash_and_short_term_investments",
}

# Retrieval: RRF constant, depth of branches, bounds of the quantized candidates.
RRF_K, TOP_K = 60, 100
CANDIDATE_FACTOR, CANDIDATE_MIN, CANDIDATE_MAX = 20, 100, 1000
# Keyword hits without a score count as FLOOR_SCORE; candidates that evidence of a metric is chosen from.
FLOOR_SCORE = 0.05
EVIDENCE_FACTOR, EVIDENCE_MIN, EVIDENCE_MAX = 8, 32, 100

# Words of a company's name that only state its legal form.
LEGAL_FORMS = ("co", "company", "corp", "corporation", "inc", "incorporated", "limited", "llc", "ltd", "plc")

# Workbook names that carry a company: pattern, words kept in capitals, names written their own way.
WORKBOOK_NAME = r"(?i)^SPG_Company_KeyStats_[0-9]{2}_([a-z0-9_]+?)(?:_rank_recalibrated)?$"
CAPITAL_WORDS = ("ai", "dx")
OWN_SPELLING = {"amesoft": "AmeSoft"}

# Cards of a question, the first whose word the question has; else stability.
CARD_WORDS = (("revenue_growth", ("매출",)), ("profitability", ("마진", "이익률")), ("cash_flow", ("현금흐름", "fcf")), ("financial_scale", ("자산", "부채", "자본")))

# Units of amounts in won, and the step of a profitability axis.
WON_UNITS = ((1e12, "조"), (1e8, "억"), (1e6, "백만"), (1e3, "천"))
AXIS_STEP, AXIS_TOP = 5, 20

# Suffixes of scales and symbols of currencies in amounts.
SCALE_SUFFIXES = {"ones": "", "thousands": "K", "millions": "M", "billions": "B"}
CURRENCY_SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥"}
