"""Domain-name column functions.

All are native Column expressions, so they run inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.functions.util import as_col

# --- Fixed values (must equal the reference's rules) ---------------------------
# Label rule for a normalised domain: letters/digits, inner hyphens, dot-separated.
# The reference anchors with Python's `$`; `\z` is used here so a trailing newline
# cannot slip through.
DOMAIN_PATTERN = r"^[a-zA-Z0-9]([a-zA-Z0-9\-]*[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9\-]*[a-zA-Z0-9])?)*\z"
MAX_DOMAIN_LENGTH = 253
# The same rule with the length bound as a look-ahead, so one regex pass decides validity.
VALID_DOMAIN_PATTERN = r"^(?=.{1,253}\z)" + DOMAIN_PATTERN[1:]
# Characters removed by Python's str.strip(): Unicode white space plus \x1c-\x1f.
STRIP_PATTERN = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
# URL-ish input: scheme prefix and everything from the first slash on.
SCHEME_PATTERN = r"^https?://"
PATH_PATTERN = r"/.*\z"
# -------------------------------------------------------------------------------


def py_strip(c) -> Column:
    """Python ``str.strip()`` with no arguments."""
    return F.regexp_replace(as_col(c), STRIP_PATTERN, "")


def loose_domain(c) -> Column:
    """strip, lower-case, drop every trailing dot; no validation."""
    return F.regexp_replace(F.lower(py_strip(c)), r"\.+\z", "")


def valid_domain(c) -> Column:
    """normalised domain, or NULL when it is not a valid domain name."""
    return F.nullif(F.regexp_extract(loose_domain(c), VALID_DOMAIN_PATTERN, 0), F.lit(""))


def invalid_domains(df: DataFrame, col: str = "target") -> DataFrame:
    """Rows whose ``col`` is rejected by F1 (the reference raises on these)."""
    return df.where(valid_domain(F.col(col)).isNull())


def reverse_domain(c) -> Column:
    """'sub.example.com' -> 'com.example.sub' (empty parts are kept)."""
    return F.array_join(F.reverse(F.split(as_col(c), r"\.", -1)), ".")


def host_rev_to_domain(c) -> Column:
    """reversed host name back to a domain; the same expression as F3."""
    return reverse_domain(c)


def url_to_domain(c) -> Column:
    """URL-ish text -> domain: trim, lower, drop http(s)://, drop from the first '/'."""
    x = F.lower(F.regexp_replace(as_col(c), r"(?U)^[\s\uFEFF]+|[\s\uFEFF]+\z", ""))
    x = F.regexp_replace(x, SCHEME_PATTERN, "")
    return F.regexp_replace(x, PATH_PATTERN, "")
