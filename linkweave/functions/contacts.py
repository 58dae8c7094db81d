"""Contact and payment column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.functions.util import as_col

# --- Fixed values (must equal the reference's mapping) --------------------------
VERIFIED_STATUS = "verified"
VERIFIED_CONFIDENCE = "high"
UNKNOWN_STATUS = "unknown"
NO_EMAIL_CONFIDENCE = "unavailable"
LABEL_HIGH, LABEL_MEDIUM, LABEL_LOW = "High", "Medium", "Low"
HIGH_AT, MEDIUM_AT = 0.8, 0.5
PAYER_PATH = "$.payload.authorization.from"
# -------------------------------------------------------------------------------


def nullif_empty(c) -> Column:
    """'' -> NULL."""
    return F.nullif(as_col(c), F.lit(""))


def coalesce_empty(c) -> Column:
    """NULL -> ''."""
    return F.coalesce(as_col(c), F.lit(""))


def confidence_of(status) -> Column:
    """provider email status -> confidence text."""
    s = as_col(status)
    return (F.when(s == VERIFIED_STATUS, F.lit(VERIFIED_CONFIDENCE))
            .otherwise(F.coalesce(s, F.lit(UNKNOWN_STATUS))))


def _number(score) -> Column:
    """The score as a number; text with a type letter after the digits is none."""
    typed_text = as_col(score).cast("string").rlike("[dDfF]\\s*$")
    return F.when(~typed_text, as_col(score).try_cast("double"))


def confidence_label(score) -> Column:
    """>=0.8 High, >=0.5 Medium, anything else that is truthy Low, else ''.

    Text is compared as a number when it parses as one (a number followed by a type letter
    does not); any other non-empty text, such as `high`, is truthy and Low, as on the page.
    """
    if isinstance(score, (int, float)):
        x, truthy = F.lit(float(score)), F.lit(score == score and score != 0)
    else:
        number = _number(score)
        x = F.when(~F.isnan(number), number)
        is_text = F.typeof(as_col(score)) == "string"
        truthy = F.when(is_text, as_col(score).cast("string") != "").otherwise(x.isNotNull() & (x != 0))
    return (F.when(x >= HIGH_AT, F.lit(LABEL_HIGH))
            .when(x >= MEDIUM_AT, F.lit(LABEL_MEDIUM))
            .when(truthy, F.lit(LABEL_LOW))
            .otherwise(F.lit("")))


def confidence_pct(score) -> Column:
    """percent display, JavaScript Math.round (half up)."""
    return F.floor(_number(score) * 100 + 0.5).cast("long")


def contact_key(first, last, domain) -> list[Column]:
    """case-folded (first, last, domain) key columns."""
    return [F.lower(as_col(first)).alias("k_first"),
            F.lower(as_col(last)).alias("k_last"),
            F.lower(as_col(domain)).alias("k_domain")]


def with_contact_key(df: DataFrame, first="first_name", last="last_name", domain="domain") -> DataFrame:
    return df.select("*", *contact_key(first, last, domain))


def payer_of(body) -> Column:
    """payer address from a payment JSON body, lower-cased; missing/empty -> NULL."""
    return nullif_empty(F.lower(F.get_json_object(as_col(body), PAYER_PATH)))


def is_found(c) -> Column:
    """found / cached style flags."""
    return as_col(c).isNotNull()
