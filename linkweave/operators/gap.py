"""Link gap (Q3: J9, U1, U3, A2, A3, O4, F8): linkers of a competitor that do not link to you.

Pairs are answered together: both sides resolve to their latest crawl. Your own linker
set stands once per target, whatever the number of its pairs, and the competitor's linkers
are anti-joined with it on (yours, linking_domain) -- a key that cannot be skewed by a
popular target. The rest is enriched with set joins instead of one lookup per domain. Counts come from
64-bit words of linker ids (``gap_summary``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions.domains import loose_domain
from linkweave.functions.scores import authority_or_null
from linkweave.operators.crawls import latest_crawl
from linkweave.operators.enrich import with_majestic, with_tranco
from linkweave.operators.joins import broadcast_when, is_small
from linkweave.session import materialize

PAIR = ["yours", "competitor"]


def normalise_pairs(pairs: DataFrame) -> DataFrame:
    """F2 on both sides, duplicates removed."""
    return pairs.select(loose_domain(F.col("yours")).alias("yours"),
                        loose_domain(F.col("competitor")).alias("competitor")).distinct()


def _side(pairs: DataFrame, latest: DataFrame, side: str) -> DataFrame:
    return pairs.join(latest.select(F.col("target").alias(side), F.col("release").alias(f"{side}_release")),
                      side)


def _linkers(wanted: DataFrame, backlinks: DataFrame, side: str, cols: list[str], small: bool) -> DataFrame:
    """Backlinks of the ``wanted`` (side, release) rows; a size-checked list is broadcast, so the backlinks
    are never shuffled by a (possibly very popular) target; otherwise AQE splits a skewed target partition."""
    b = backlinks.select(F.col("target").alias(side), F.col("release").alias(f"{side}_release"), *cols)
    return b.join(broadcast_when(wanted, small), [side, f"{side}_release"])


def resolve_pairs(pairs: DataFrame, crawls: DataFrame) -> tuple[DataFrame, bool]:
    """(pairs whose sides are both crawled, with their releases; whether they are few)."""
    p = normalise_pairs(pairs)
    latest = latest_crawl(crawls)
    # Each side resolves to at most one latest crawl, so the resolved list is no larger than the input.
    return _side(_side(p, latest, "yours"), latest, "competitor"), is_small(p)


def own_linkers(resolved: DataFrame, backlinks: DataFrame, side: str, small: bool) -> DataFrame:
    """(side, linking_domain): the linker set of every target on one side, once per target."""
    targets = resolved.select(side, f"{side}_release").distinct()
    return _linkers(targets, backlinks, side, ["linking_domain"], small).select(side, "linking_domain").distinct()


def gap_rows(resolved: DataFrame, backlinks: DataFrame, small: bool) -> DataFrame:
    """Competitor linkers that do not link to you, per pair."""
    theirs = (_linkers(resolved, backlinks, "competitor", ["linking_domain", "num_hosts", "page_rank"], small)
              .select(*PAIR, "linking_domain", "num_hosts", "page_rank"))
    return theirs.join(own_linkers(resolved, backlinks, "yours", small), ["yours", "linking_domain"], "left_anti")


def gap(pairs: DataFrame, crawls: DataFrame, backlinks: DataFrame, majestic: DataFrame,
        tranco: DataFrame) -> DataFrame:
    """Q3 opportunities: one row per (pair, domain) the competitor has and you lack."""
    resolved, small = resolve_pairs(pairs, crawls)
    enriched = with_tranco(with_majestic(gap_rows(resolved, backlinks, small), majestic), tranco)
    return enriched.select(*PAIR, F.col("linking_domain").alias("domain"), "num_hosts",
                           authority_or_null(F.col("num_hosts")).alias("authority_score"),
                           "page_rank", F.col("global_rank").alias("majestic_rank"), "tranco_rank")


def gap_order() -> list:
    """Sort order of the response (for `with_positions`)."""
    return [F.desc(F.coalesce(F.col("num_hosts"), F.lit(0))), F.asc("domain")]


def order_gap(df: DataFrame) -> DataFrame:
    """num_hosts DESC with NULL as 0, then domain."""
    return df.orderBy(*PAIR, F.desc(F.coalesce(F.col("num_hosts"), F.lit(0))), "domain")


def linker_sets(resolved: DataFrame, backlinks: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """(sizes, words) of the linker sets of all targets on either side, from one scan of the backlinks.

    ``sizes(target, size)``: linkers of every target. ``words(target, word, bits)``: those linkers that link to
    another target of the list as well, as words of 64 ids, empty ones left out; only they can be common to two sets. A
    set costs a row per linker at most, however many ids there are. Ids are given in order of popularity, so the popular
    linkers of a large set share their words.
    """
    side = lambda s: resolved.select(F.col(s).alias("target"), F.col(f"{s}_release").alias("target_release"))
    wanted = side("yours").union(side("competitor")).distinct()
    links = materialize(_linkers(wanted, backlinks, "target", ["linking_domain"], small)
                        .select("target", "linking_domain").distinct(), "gap-links")
    sizes = links.groupBy("target").agg(F.count(F.lit(1)).alias("size"))
    shared = links.groupBy("linking_domain").agg(F.count(F.lit(1)).alias("targets")).where("targets > 1")
    order = [F.desc("targets"), F.asc("linking_domain")]
    # numbers without gaps inside a partition; written once, so that every reader sees the same numbers
    ids = materialize(shared.repartitionByRange(*order).sortWithinPartitions(*order)
                      .select("linking_domain", F.monotonically_increasing_id().alias("id")), "gap-ids")
    words = (links.join(ids, "linking_domain").groupBy("target", F.shiftright("id", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(id & 63 AS INT))")).alias("bits")))
    return sizes, materialize(words, "gap-words")


def gap_summary(pairs: DataFrame, crawls: DataFrame, backlinks: DataFrame) -> DataFrame:
    """Q3 header (A2, A3): set sizes and gap count per resolvable pair.

    The gap is the competitor's set without what both have: a pair costs one row per word of its own set, not a copy of
    its linkers' names.
    """
    resolved, small = resolve_pairs(pairs, crawls)
    resolved = materialize(resolved, "gap-pairs")
    sizes, words = linker_sets(resolved, backlinks, small)
    sets = materialize(sizes, "gap-sets")
    asked = broadcast_when(resolved.where("yours <> competitor").select(*PAIR), small)
    own = words.select(F.col("target").alias("yours"), "word", F.col("bits").alias("own_bits")).join(asked, "yours")
    theirs = words.select(F.col("target").alias("competitor"), "word", F.col("bits").alias("their_bits"))
    both = F.bit_count(F.col("own_bits").bitwiseAND(F.col("their_bits")))
    common = own.join(theirs, ["competitor", "word"]).groupBy(*PAIR).agg(F.sum(both).alias("common"))

    def of(side: str, prefix: str) -> DataFrame:
        return sets.select(F.col("target").alias(side), F.col("size").alias(f"{prefix}_size"))

    out = (resolved.select(*PAIR).join(of("yours", "own"), "yours", "left").join(of("competitor", "their"), "competitor", "left")
           .join(common, PAIR, "left"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    # a pair of a target with itself has everything in common, also the linkers that no other target has
    gap_count = F.when(F.col("yours") == F.col("competitor"), F.lit(0)).otherwise(n("their_size") - n("common"))
    return out.select(*PAIR, n("own_size").cast("long").alias("your_backlinks"), n("their_size").cast("long").alias("competitor_backlinks"),
                      gap_count.cast("long").alias("gap_count"))


def gap_missing(pairs: DataFrame, crawls: DataFrame) -> DataFrame:
    """Pairs that cannot be answered, and which side has never been crawled.

    A zero-result crawl is data (an empty set); only a never-crawled name is missing.
    """
    known = crawls.select(F.col("target")).distinct()
    p = normalise_pairs(pairs)
    y = known.select(F.col("target").alias("yours"), F.lit(True).alias("_y"))
    c = known.select(F.col("target").alias("competitor"), F.lit(True).alias("_c"))
    flagged = p.join(y, "yours", "left").join(c, "competitor", "left")
    return (flagged.where(F.col("_y").isNull() | F.col("_c").isNull())
            .select(*PAIR, F.when(F.col("_y").isNull(), F.lit("yours")).otherwise(F.lit("competitor"))
                    .alias("missing")))
