"""People-match provider responses collected as a table, parsed with native JSON functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.functions.contacts import coalesce_empty, confidence_of, nullif_empty

PERSON_SCHEMA = T.StructType([
    T.StructField("email", T.StringType()),
    T.StructField("email_status", T.StringType()),
    T.StructField("first_name", T.StringType()),
    T.StructField("last_name", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("organization", T.StructType([T.StructField("name", T.StringType())])),
])
RESPONSE_SCHEMA = T.StructType([T.StructField("person", PERSON_SCHEMA)])
# JSON values that count as "no person".
_EMPTY_JSON = ["null", "{}", "[]", "false", "0", "0.0", "-0", "\"\""]


def parse_match_responses(df: DataFrame, status: str = "status_code", body: str = "body") -> DataFrame:
    """Adds the parsed match to each (first_name, last_name, domain, status_code, body) row.

    kind: 'error' (no or a non-200 status, or a body that is not a JSON object: transient,
    never cached), 'no_match' (no person: a definitive miss), 'match'. For matches: m_email
    ('' if none), m_confidence, m_first_name / m_last_name, m_title, m_company. A field that
    is missing takes its default (request name, 'unknown', ''); an explicit JSON null stays
    NULL, except the email, where both mean none.
    """
    doc = F.try_parse_json(F.col(body))
    is_object = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    person = F.to_json(F.try_variant_get(doc, "$.person", "variant"))
    p = F.from_json(F.col(body), RESPONSE_SCHEMA)["person"]
    kind = (F.when(F.col(status).isNull() | (F.col(status) != 200) | ~is_object, F.lit("error"))
            .when(person.isNull() | person.isin(*_EMPTY_JSON), F.lit("no_match"))
            .otherwise(F.lit("match")))
    is_match = kind == "match"

    def field(path: str, value, default):
        """The value; the default if the key is missing; NULL if it is there and null."""
        there = F.array_contains(F.json_object_keys(person), path)
        return F.when(there, value).otherwise(default)

    return df.select(
        "*",
        kind.alias("kind"),
        F.when(is_match, coalesce_empty(p["email"])).alias("m_email"),
        F.when(is_match, field("email_status", F.when(p["email_status"].isNotNull(), confidence_of(p["email_status"])),
                               confidence_of(F.lit(None).cast("string")))).alias("m_confidence"),
        F.when(is_match, field("first_name", p["first_name"], F.col("first_name"))).alias("m_first_name"),
        F.when(is_match, field("last_name", p["last_name"], F.col("last_name"))).alias("m_last_name"),
        F.when(is_match, field("title", p["title"], F.lit(""))).alias("m_title"),
        F.when(is_match, coalesce_empty(p["organization"]["name"])).alias("m_company"),
    )


def match_answers(parsed: DataFrame) -> DataFrame:
    """The answer of a fresh (not cached) lookup for each 'match' row."""
    email = nullif_empty(F.col("m_email"))
    return parsed.where(F.col("kind") == "match").select(
        email.alias("email"),
        email.isNotNull().alias("email_found"),
        F.when(email.isNotNull(), F.col("m_confidence")).otherwise(F.lit("unavailable")).alias("confidence"),
        F.col("m_first_name").alias("first_name"),
        F.col("m_last_name").alias("last_name"),
        F.col("m_title").alias("title"),
        F.col("m_company").alias("company"),
        F.col("domain"),
        F.lit(False).alias("cached"),
    )
