"""Printed prices as Columns: amount, currency, scale and basis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How sites print units.  Patterns apply to lower-case text; \p{L} bounds keep words whole.
SQUARE_METRE = r"(?:m²|м²|m2|м2|kv\.?\s*m|кв\.?\s*м)\.?"
CURRENCY_PATTERNS = [
    ("AZM", r"azm|köhnə manat|старых манат"),
    ("USD", r"\$|usd|dollar|долл"),
    ("EUR", r"€|eur|avro|евро"),
    ("TRY", r"₺|lir[əae]|лир|(?<!\p{L})(?:try|tl)(?!\p{L})"),
    ("GBP", r"£|gbp|funt|фунт"),
    ("RUB", r"₽|rub|руб"),
    ("AZN", r"₼|azn|manat|манат|qəp|гяп|(?<!\p{L})man(?!\p{L})"),
]
HUNDREDTH = r"qəp|гяп"
THOUSAND = r"(?<!\p{L})(?:min|bin|тыс|k|к)(?!\p{L})"
MILLION = r"(?<!\p{L})(?:mln|млн|milyon|million|m)(?!\p{L})"


def plain(text: Column) -> Column:
    """Lower case, dotted capital I folded, no-break and thin spaces as spaces, runs of spaces as one."""
    return F.regexp_replace(F.lower(F.translate(text, "\u00a0\u202f\u2009\u2007\u0130", "    i")), r"\s+", " ")


def currency_code(text: Column) -> Column:
    """Code of the first unit that the text names, NULL if it names none."""
    out = F.lit(None).cast("string")
    for code, pattern in reversed(CURRENCY_PATTERNS):
        out = F.when(text.rlike(pattern), F.lit(code)).otherwise(out)
    return out


def with_price(df: DataFrame, price: str = "price", currency: str = "currency") -> DataFrame:
    """``df`` with ``amount, code, scale, per_m2, scale_said`` of its printed price.

    A unit in ``price`` goes before ``currency``; no unit at all means manat.
    ``scale`` is 1, 1000, 1000000 or 0.01 as far as the text says so, and
    ``scale_said`` tells whether it does.  An unreadable price has NULL amount.

    Each step is a projection of its own: what later steps use several times
    is computed once.  Texts without a letter skip the patterns of units.
    """
    n, digits = F.col("_n"), F.regexp_replace("_n", r"[., ]", "")
    whole = F.regexp_replace(F.regexp_replace("_n", r"[.,]\d{1,2}$", ""), r"[., ]", "")
    cents = F.regexp_extract("_n", r"[.,](\d{1,2})$", 1)
    said = F.col("_million") | F.col("_thousand")
    amount = (
        F.when(n.rlike(r"^\d+$"), n.try_cast("double"))
        .when((said | n.startswith("0")) & n.rlike(r"^\d+[.,]\d+$"), F.translate(n, ",", ".").try_cast("double"))
        .when(n.rlike(r"^\d{1,3}(?:[., ]\d{3})+$"), digits.try_cast("double"))
        .when(n.rlike(r"^(?:\d+|\d{1,3}(?:[., ]\d{3})+)[.,]\d{1,2}$"), F.concat(whole, F.lit("."), cents).try_cast("double"))
    )
    worded = lambda c: F.col("_words") & c
    return (
        df.withColumn("_p", F.coalesce(plain(F.col(price)), F.lit("")))
        .withColumn("_words", F.col("_p").rlike(r"[^\d., ]"))
        .withColumn("per_m2", worded(F.col("_p").rlike(SQUARE_METRE)))
        .withColumn("_rest", F.when(F.col("per_m2"), F.regexp_replace(F.regexp_replace("_p", r"^\s*1 ?" + SQUARE_METRE, " "), SQUARE_METRE, " ")).otherwise(F.col("_p")))
        .withColumns({
            "_n": F.regexp_replace(F.regexp_extract("_rest", r"\d[\d., ]*", 0), r"[., ]+$", ""),
            "_million": worded(F.col("_rest").rlike(MILLION)),
            "_thousand": worded(F.col("_rest").rlike(THOUSAND)),
            "_hundredth": worded(F.col("_rest").rlike(HUNDREDTH)),
            "_unit": F.when(F.col("_words"), currency_code(F.col("_rest"))),
            "_other": F.lower(currency),
        })
        .withColumns({
            "amount": amount,
            "code": F.coalesce("_unit", F.when(F.col("_other") != "azn", currency_code(F.col("_other"))), F.lit("AZN")),
            "scale": F.when(F.col("_million"), 1e6).when(F.col("_thousand"), 1e3).when(F.col("_hundredth"), 0.01).otherwise(1.0),
            "scale_said": F.col("_million") | F.col("_thousand") | F.col("_hundredth") | F.col("per_m2"),
        })
        .drop("_p", "_words", "_rest", "_n", "_million", "_thousand", "_hundredth", "_unit", "_other")
    )
