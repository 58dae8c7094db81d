"""Contact enrichment against a lookup cache (Q6: F17, W5, J11, J12, P8, P9, K10).

The cache is matched case-insensitively on (first, last, domain). It keeps
positives, people without an email and definitive misses; transient provider
errors are never stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions.contacts import NO_EMAIL_CONFIDENCE, coalesce_empty, with_contact_key
from linkweave.functions.timekeys import as_of as as_of_col
from linkweave.operators.dedupe import dedupe_first

KEY = ["k_first", "k_last", "k_domain"]
LOOKUP_COLS = ["first_name", "last_name", "domain", "email", "confidence", "title", "company", "created_at"]


def first_lookup(lookups: DataFrame) -> DataFrame:
    """The first stored row per case-folded contact key (by created_at, then content)."""
    keyed = with_contact_key(lookups).select(*KEY, "email", "confidence", "title", "company", "created_at")
    return dedupe_first(keyed, KEY, ["created_at"])


def lookup_outcome(email, title, company):
    """Hit / person_without_email / no_match from a cached row ('' and NULL both count as empty)."""
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return (F.when(has(email), F.lit("hit"))
            .when(has(company) | has(title), F.lit("person_without_email"))
            .otherwise(F.lit("no_match")))


def enrich_contacts(contacts: DataFrame, lookups: DataFrame) -> DataFrame:
    """Each contact with its cache outcome ('miss' when the cache has no row)."""
    c = with_contact_key(contacts.select("first_name", "last_name", "domain"))
    cache = first_lookup(lookups).select(*KEY, F.lit(True).alias("_cached"),
                                         F.col("email").alias("c_email"),
                                         F.col("confidence").alias("c_confidence"),
                                         F.col("title").alias("c_title"),
                                         F.col("company").alias("c_company"))
    j = c.join(cache, KEY, "left")
    outcome = F.when(F.col("_cached").isNull(), F.lit("miss")).otherwise(
        lookup_outcome(F.col("c_email"), F.col("c_title"), F.col("c_company")))
    j = j.withColumn("outcome", outcome)
    hit = F.col("outcome") == "hit"
    pwe = F.col("outcome") == "person_without_email"
    return j.select(
        "first_name", "last_name", "domain", "outcome",
        F.when(hit, F.col("c_email")).alias("email"),
        hit.alias("email_found"),
        F.when(hit, F.col("c_confidence")).when(pwe, F.lit(NO_EMAIL_CONFIDENCE)).alias("confidence"),
        F.when(hit | pwe, coalesce_empty(F.col("c_title"))).alias("title"),
        F.when(hit | pwe, coalesce_empty(F.col("c_company"))).alias("company"),
        F.col("_cached").isNotNull().alias("cached"),
    )


def contacts_to_fetch(contacts: DataFrame, lookups: DataFrame) -> DataFrame:
    """Contacts the cache cannot answer (provider calls needed)."""
    c = with_contact_key(contacts.select("first_name", "last_name", "domain"))
    keys = with_contact_key(lookups).select(*KEY).distinct()
    return c.join(keys, KEY, "left_anti").select("first_name", "last_name", "domain")


def lookup_rows(parsed_responses: DataFrame, created_at=None) -> DataFrame:
    """Rows to append to the cache from parsed provider responses.

    Matches store email/confidence (both '' without an email), title and company;
    definitive misses store empty fields; transient errors store nothing.
    """
    r = parsed_responses.where(F.col("kind").isin("match", "no_match"))
    match = F.col("kind") == "match"
    has_email = match & (F.col("m_email") != "")
    return r.select(
        "first_name", "last_name", "domain",
        F.when(has_email, F.col("m_email")).otherwise(F.lit("")).alias("email"),
        F.when(has_email, F.col("m_confidence")).otherwise(F.lit("")).alias("confidence"),
        F.when(match, F.col("m_title")).otherwise(F.lit("")).alias("title"),
        F.when(match, F.col("m_company")).otherwise(F.lit("")).alias("company"),
        as_of_col(created_at).alias("created_at"),
    )
