"""The screening vocabulary: metric fields and named strategy concepts."""

from __future__ import annotations

# Metric name, column, source, minimum, maximum, unit.
METRICS = [
    ("PeRatio", "pe", "ratio", 0.0, 1000.0, None),
    ("PbRatio", "pb", "ratio", 0.0, 100.0, None),
    ("PsRatio", "ps", "ratio", 0.0, 100.0, None),
    ("ReturnOnEquity", "roe", "ratio", -100.0, 200.0, "%"),
    ("ReturnOnCapital", "roic", "ratio", -100.0, 200.0, "%"),
    ("DebtToEquity", "debt_to_equity", "ratio", 0.0, 50.0, None),
    ("GrossMargin", "gross_margin", "ratio", -100.0, 100.0, "%"),
    ("FcfYield", "fcf_yield", "ratio", -100.0, 100.0, "%"),
    ("MarketCap", "market_cap", "ratio", 0.0, 100000000.0, "INR_CR"),
    ("Rsi14", "rsi14", "indicator", 0.0, 100.0, None),
    ("Sma50", "sma50", "indicator", 0.0, 1000000.0, "INR"),
    ("Sma200", "sma200", "indicator", 0.0, 1000000.0, "INR"),
    ("Macd", "macd", "indicator", -100000.0, 100000.0, None),
    ("MacdSignal", "macd_signal", "indicator", -100000.0, 100000.0, None),
    ("Atr14", "atr14", "indicator", 0.0, 1000000.0, "INR"),
    ("Volatility30", "vol30", "indicator", 0.0, 10.0, None),
    ("ClosePrice", "close", "bar", 0.0, 1000000.0, "INR"),
    ("Volume", "volume", "bar", 0.0, 1000000000000.0, "shares"),
]

# Operators every numeric metric allows.
ALLOWED_OPERATORS = ["LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual"]

# Concept name, aliases, definition as (field, operator, value).
CONCEPTS = [
    ("cheap", ["value", "undervalued", "low valuation", "bargain"],
     [("PeRatio", "LessThan", 25.0), ("PbRatio", "LessThan", 3.0)]),
    ("expensive", ["pricey", "overvalued", "rich", "high valuation"], [("PeRatio", "GreaterThan", 60.0)]),
    ("profitable", ["makes money", "in profit", "earning"], [("ReturnOnEquity", "GreaterThan", 0.0)]),
    ("high_quality", ["quality", "well run"],
     [("ReturnOnEquity", "GreaterThan", 15.0), ("DebtToEquity", "LessThan", 0.5)]),
    ("low_debt", ["low leverage", "conservative balance sheet", "debt free", "unlevered"],
     [("DebtToEquity", "LessThan", 0.5)]),
    ("high_debt", ["leveraged", "indebted", "high leverage"], [("DebtToEquity", "GreaterThan", 2.0)]),
    ("small_cap", ["small caps", "smallcap", "small companies"], [("MarketCap", "LessThan", 5000.0)]),
    ("mid_cap", ["midcap", "mid caps"],
     [("MarketCap", "GreaterThanOrEqual", 5000.0), ("MarketCap", "LessThan", 20000.0)]),
    ("large_cap", ["largecap", "large caps", "blue chip", "blue chips"],
     [("MarketCap", "GreaterThanOrEqual", 20000.0)]),
    ("oversold", ["beaten down", "sold off"], [("Rsi14", "LessThan", 30.0)]),
    ("overbought", ["overheated", "extended", "run up"], [("Rsi14", "GreaterThan", 70.0)]),
    ("not_overbought", ["not overheated", "not extended"], [("Rsi14", "LessThan", 70.0)]),
    ("volatile", ["high volatility", "choppy", "swingy"], [("Volatility30", "GreaterThan", 0.4)]),
    ("stable", ["low volatility", "steady", "calm"], [("Volatility30", "LessThan", 0.2)]),
    ("high_margin", ["high margins", "good margins"], [("GrossMargin", "GreaterThan", 40.0)]),
    ("cash_generative", ["strong cash flow", "cash rich", "cash generating"], [("FcfYield", "GreaterThan", 5.0)]),
    ("efficient", ["capital efficient", "high roic"], [("ReturnOnCapital", "GreaterThan", 15.0)]),
    ("liquid", ["actively traded", "tradeable", "liquid enough"], [("Volume", "GreaterThan", 100000.0)]),
]

# Limits of the filter language.
MAX_DEPTH = 4
MAX_COMPARISONS = 20
MAX_LIMIT = 1000
DEFAULT_LIMIT = 200
MAX_ALIASES = 12
MAX_NAME_LENGTH = 64

METRIC_COLUMN = {name: column for name, column, *_ in METRICS}
