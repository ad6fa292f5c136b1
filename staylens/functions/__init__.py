"""Column-level functions, all built from Spark SQL expressions."""

from staylens.functions.dates import month_end, month_index, parse_date, stay_days
from staylens.functions.labels import count_label, fixed, money, rate_label, signed_pct, thousands
from staylens.functions.numeric import pct_change, pct_of, round_half_even
from staylens.functions.text import null_tokens, title_case, with_null_tokens

__all__ = [
    "count_label", "fixed", "money", "month_end", "month_index", "null_tokens", "parse_date",
    "pct_change", "pct_of", "rate_label", "round_half_even", "signed_pct", "stay_days",
    "thousands", "title_case", "with_null_tokens",
]
