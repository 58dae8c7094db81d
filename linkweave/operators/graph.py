"""Graph operators: resolve targets (J1/P1), edges into targets (J2/P2/P3), inbound linkers.

Plan shape at scale; every target list, short or long, takes the same joins:
  * targets meet the vertices on (name_bucket, rev_domain); a list proven small is broadcast,
    and dynamic partition pruning reads only the name buckets of the targets;
  * the resolved ids meet the edges on (bucket, to_id) the same way, so only the targets'
    bucket directories are read;
  * the inbound edges are written once and, when few enough, broadcast past a
    single scan of the vertex table (which is never shuffled or broadcast).
A list beyond the bound takes the same joins as shuffle joins (AQE splits skew), the vertices
reduced by a bit filter of the linker ids; a handful of names also goes into the scan as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions.domains import reverse_domain
from linkweave.operators.joins import DEFAULT_BROADCAST_ROWS, broadcast_when, is_small, tasks_for
from linkweave.session import materialize

DEFAULT_BUCKETS = 1000
# Directories of the stored vertex table, by a hash of the reversed name (a constant of the layout).
NAME_BUCKETS = 128
# Lists of so few names are pushed into the scan as literals (Spark pushes an IN of up to ten values).
MAX_LITERAL_NAMES = 10
# Size of the bit filter on linker ids: 2 ** 20 rows of 64 bits at most.
FILTER_BITS = 26
# A filter is made only where it can leave out three rows of four.
FILTER_SHARE = 4


def bucket_of(id_col, n: int = DEFAULT_BUCKETS):
    """edge bucket number, non-negative for negative ids as well."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(c, F.lit(n)).cast("int")


def name_bucket_of(rev_domain):
    """Directory of a reversed name in the stored vertex table."""
    return F.pmod(F.xxhash64(rev_domain), F.lit(NAME_BUCKETS)).cast("int")


def resolve_targets(targets: DataFrame, vertices: DataFrame,
                    max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS, small: bool | None = None) -> DataFrame:
    """(target) -> (target, target_id). Unknown, NULL and empty targets drop out (zero results).

    Duplicate vertex names give several ids; all of them contribute. ``small``
    skips the size check when the caller has already made it.
    """
    on = ["rev_domain"]
    t = (targets.where(F.col("target") != "").select("target").distinct()
         .select("target", reverse_domain(F.col("target")).alias("rev_domain")))
    if "name_bucket" in vertices.columns:
        on = ["name_bucket", "rev_domain"]
        t = t.withColumn("name_bucket", name_bucket_of(F.col("rev_domain")))
    v = vertices.select(F.col("id").alias("target_id"), *on)
    named = [r.rev_domain for r in t.select("rev_domain").limit(MAX_LITERAL_NAMES + 1).collect()]
    if len(named) <= MAX_LITERAL_NAMES:
        # A handful of names goes to the scan as literals: row groups whose Bloom filter (see
        # ``sinks.layout.write_vertices``) holds none of them are not read.
        v = v.where(F.col("rev_domain").isin(named))
    t = broadcast_when(t, is_small(targets, max_broadcast_rows) if small is None else small)
    return v.join(t, on).select("target", "target_id")


def edges_into(edges: DataFrame, resolved: DataFrame, n_buckets: int = DEFAULT_BUCKETS,
               max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS, small: bool | None = None) -> DataFrame:
    """Edges whose to_id is a resolved target -> (target, from_id).

    When the edge table carries the `bucket` partition column the join key
    includes it, which lets Spark prune bucket directories.
    """
    r = resolved.select("target", "target_id")
    if "bucket" in edges.columns:
        r = r.withColumn("bucket", bucket_of("target_id", n_buckets))
        cond = ["bucket", "to_id"]
        e = edges.select("bucket", "from_id", "to_id")
    else:
        cond = ["to_id"]
        e = edges.select("from_id", "to_id")
    r = r.withColumnRenamed("target_id", "to_id")
    r = broadcast_when(r, is_small(r, max_broadcast_rows) if small is None else small)
    return e.join(r, cond).select("target", "from_id")


def only_listed(df: DataFrame, column: str, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``df`` without most of the rows whose ``column`` is not among ``ids`` (one column of that name).

    A filter of ``2 ** bits`` bits, one per hash of an id, as rows of 64 bits each: at most ``2 ** (bits - 6)`` rows, so its
    broadcast is bounded whatever the number of ids. Rows that pass by chance are left to the join that
    follows; a filter that would be half full or more is not made, nor one that would keep most rows of ``df``: it
    would go through the driver and save nothing.
    """
    listed = ids.select(F.approx_count_distinct(column)).first()[0]
    if listed > 1 << (bits - 1) or FILTER_SHARE * listed > df.count():
        return df
    place = F.pmod(F.xxhash64(column), F.lit(1 << bits))
    bit = place.bitwiseAND(F.lit(63))
    words = (ids.select(F.shiftright(place, 6).alias("_word"), bit.cast("int").alias("_bit"))
             .groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")))
    kept = df.withColumns({"_word": F.shiftright(place, 6), "_bit": bit.cast("int")}).join(F.broadcast(words), "_word")
    return kept.where(F.getbit(F.col("_bits"), F.col("_bit")) == 1).select(*df.columns)


def bucket_range(edges: DataFrame, first: int, end: int) -> DataFrame:
    """Edges of buckets first <= bucket < end (a partition filter on a bucketed store)."""
    return edges.where(F.col("bucket").between(first, end - 1))


def inbound(edges: DataFrame, vertices: DataFrame, targets: DataFrame,
            n_buckets: int = DEFAULT_BUCKETS, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """For each target, the linking domains and their host counts.

    Output: target, linking_domain, num_hosts. Linker ids without a vertex drop
    out (inner join). A (target, linking_domain) pair appears once; duplicate
    edges or duplicate vertex names keep the largest host count.

    The target list and the resolved ids are counted one after the other (a name may
    have several ids). Beyond the bound, the inbound edges meet the vertices in a
    shuffle join on the linker id, from which a bit filter keeps nearly all vertices that link to no target.
    """
    small = is_small(targets, max_broadcast_rows)
    resolved = resolve_targets(targets, vertices, max_broadcast_rows, small)
    into = edges_into(edges, resolved, n_buckets, max_broadcast_rows, None if small else False)
    v = vertices.select(F.col("id").alias("from_id"), "rev_domain", "num_hosts")
    # The inbound edges are written once (a table in the shared checkpoint folder). When they are few
    # enough to broadcast, the vertex table streams past them: scanned once and never shuffled. Beyond that
    # it is reduced to the linkers by a bit filter before it is shuffled.
    into = materialize(into, "inbound-edges")
    n = into.count()  # from the files' footers
    few = n <= max_broadcast_rows
    into = broadcast_when(into, few)
    if not few:
        v = only_listed(v, "from_id", into.select("from_id"))
    found = into.join(v, "from_id").select("target", reverse_domain(F.col("rev_domain")).alias("linking_domain"), "num_hosts")
    if not few:  # nearly all pairs are distinct, so they are grouped after the shuffle only
        found = found.repartition(tasks_for(edges.sparkSession, n), "target", "linking_domain")
    return found.groupBy("target", "linking_domain").agg(F.max("num_hosts").alias("num_hosts"))


def inbound_order() -> list:
    """Sort order of the response (for `with_positions`)."""
    return [F.desc("num_hosts"), F.asc("linking_domain")]


def order_inbound(df: DataFrame) -> DataFrame:
    """O1: num_hosts DESC, linking_domain (per target)."""
    return df.orderBy("target", F.desc("num_hosts"), "linking_domain")
