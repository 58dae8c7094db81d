"""Keyed contact cache (K10, W5, J11, J12): lookups in hash buckets of the contact key, first rows folded by merging.

The cache is a table of parts (``sinks.parts``) under ``bucket=<hash of the case-folded key mod n>/``. A batch of lookups
is one part; a repeated batch changes nothing. Merging keeps the first row per key (W5) and drops the others. A request reads
the buckets of its contacts only: their numbers, at most ``n_buckets``, are literals in the scan's partition filter. A
row whose key has a null part is kept, and matches no contact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.functions.contacts import with_contact_key
from linkweave.operators.contacts import KEY, LOOKUP_COLS, contacts_to_fetch, enrich_contacts
from linkweave.operators.dedupe import dedupe_first
from linkweave.operators.joins import DEFAULT_BROADCAST_ROWS, broadcast_if_small
from linkweave.sinks import parts
from linkweave.sources.tables import LOOKUPS_SCHEMA

CACHE_BUCKETS = 256
CACHE_SCHEMA = T.StructType([*LOOKUPS_SCHEMA.fields, T.StructField("bucket", T.IntegerType())])
CACHE_TABLES = ["lookups"]


def cache_bucket(n_buckets: int) -> Column:
    """Bucket of a row with the key columns of F17."""
    return F.pmod(F.xxhash64(*KEY), F.lit(n_buckets)).cast("int").alias("bucket")


def append_to_cache(lookups: DataFrame, root: str, epoch: int, n_buckets: int = CACHE_BUCKETS) -> bool:
    """Add a batch of lookups (positive and negative) as epoch ``epoch``; False if it is there already."""
    spark = lookups.sparkSession

    def write(name: str, _: parts.Manifest) -> None:
        _write(with_contact_key(lookups.select(*LOOKUP_COLS)).select(*LOOKUP_COLS, cache_bucket(n_buckets)), root, name)

    added = parts.add(spark, root, epoch, write)
    parts.merge(spark, root, lambda old, name: _merge(spark, root, old, name))
    return added


def fold_cache(spark: SparkSession, root: str) -> bool:
    """Fold the whole cache into one part with one row per key."""
    return parts.fold(spark, root, lambda old, name: _merge(spark, root, old, name))


def _write(rows: DataFrame, root: str, name: str) -> None:
    (rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", F.lower("domain"))
     .write.partitionBy("bucket").parquet(parts.folder(root, "lookups", name)))


def _merge(spark: SparkSession, root: str, old: list[parts.Part], name: str) -> None:
    rows = with_contact_key(parts.read(spark, root, "lookups", CACHE_SCHEMA, old))
    # the columns of W5 come first in the tie order; how the name was spelt does not decide
    rows = rows.select(*KEY, "email", "confidence", "title", "company", "created_at", "first_name", "last_name", "domain", "bucket")
    _write(dedupe_first(rows, KEY, ["created_at"]).select(*LOOKUP_COLS, "bucket"), root, name)


def cached_lookups(contacts: DataFrame, root: str, n_buckets: int = CACHE_BUCKETS,
                   max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """The cache's rows for the keys of ``contacts``, from the buckets of these keys."""
    spark = contacts.sparkSession
    keys = with_contact_key(contacts.select("first_name", "last_name", "domain")).select(*KEY).distinct()
    wanted = sorted(r.bucket for r in keys.select(cache_bucket(n_buckets)).distinct().collect())  # at most n_buckets
    rows = parts.read(spark, root, "lookups", CACHE_SCHEMA, parts.current(spark, root).parts)
    if len(wanted) < n_buckets:
        rows = rows.where(F.col("bucket").isin(wanted))
    return (with_contact_key(rows).join(broadcast_if_small(keys, max_broadcast_rows), KEY, "left_semi").select(*LOOKUP_COLS))


def enrich_from_cache(contacts: DataFrame, root: str, n_buckets: int = CACHE_BUCKETS) -> DataFrame:
    """Q6/J11 against the keyed cache."""
    return enrich_contacts(contacts, cached_lookups(contacts, root, n_buckets))


def to_fetch_from_cache(contacts: DataFrame, root: str, n_buckets: int = CACHE_BUCKETS) -> DataFrame:
    """J12 against the keyed cache."""
    return contacts_to_fetch(contacts, cached_lookups(contacts, root, n_buckets))
