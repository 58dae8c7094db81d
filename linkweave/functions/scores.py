"""Score functions.

Python's ``round`` is half-to-even; ``bround`` is the same rule, so exact
halves agree with the reference as well.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkweave.functions.util import as_col, lit_or_col

# --- Fixed values (must equal the reference's constants) -----------------------
TOTAL_DOMAINS = 109_000_000   # denominator of the DR log scale (2025 rank release)
AUTHORITY_FACTOR = 15         # authority = round(15 * log10(hosts))
SCORE_MAX = 100
# -------------------------------------------------------------------------------


def derive_dr(rank, total=TOTAL_DOMAINS) -> Column:
    """log-rank DR score 0..100. rank<=0 -> 100, rank>=total -> 0.

    ``total`` may be a number or a Column (for instance a scalar subquery).
    """
    r = as_col(rank)
    t = lit_or_col(total)
    raw = F.bround(F.lit(100.0) * (F.lit(1.0) - F.log10(r.cast("double")) / F.log10(t.cast("double"))))
    clamped = F.greatest(F.lit(0), F.least(F.lit(SCORE_MAX), raw.cast("int")))
    return (F.when(r <= 0, F.lit(SCORE_MAX))
            .when(r >= t, F.lit(0))
            .when(r.isNotNull(), clamped)).cast("int")


def authority_score(n) -> Column:
    """hosts<=0 -> 0, else min(100, round(15*log10(hosts))). NULL stays NULL."""
    x = as_col(n).cast("double")
    scored = F.least(F.lit(SCORE_MAX), F.bround(F.log10(x) * AUTHORITY_FACTOR).cast("int"))
    return F.when(x <= 0, F.lit(0)).when(x > 0, scored).cast("int")


def authority_or_null(n) -> Column:
    """F8: like F7 but NULL or 0 hosts give NULL (the gap report's guard)."""
    c = as_col(n)
    return F.when(c.isNotNull() & (c != 0), authority_score(c)).cast("int")
