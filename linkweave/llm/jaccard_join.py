"""Exact Jaccard join of word-shingle sets in metric space: pivots, Voronoi regions, triangle-inequality windows.

The Jaccard distance ``1 - J`` is a metric. Distances between unrelated texts are all
1, so whole documents make useless pivots; the pivots here are the single shingles:
the distance of a set ``A`` to the pivot ``{s}`` is ``1 - 1/|A|`` if ``s`` lies in ``A`` and 1
otherwise, so the nearest pivots of ``A`` are its own shingles. A fixed total order of
the pivots (rare ones first, by the load of their hash bucket over all documents)
breaks the ties and makes the Voronoi regions.

* **Windows.** A set linked to ``A`` lies within ``1 - t`` of it, so it misses at most
  ``|A| - ceil(t |A|)`` shingles of ``A``; its nearest pivot, or one that follows, is among the
  first ``|A| - ceil(t |A|) + 1`` pivots of ``A``. ``A`` is replicated to those regions, and two
  linked sets always meet in one. Inside a region sizes are windows too:
  ``|d(A, 0) - d(B, 0)|`` bounds give ``t |A| <= |B| <= |A| / t``, and the parity vector (one bit
  per hash class, 256 classes) gives ``|A xor B| >= hamming``, by the triangle inequality of
  the symmetric difference; for long sets the counts per class give ``|A xor B| >= L1``.
* **Exactness.** What passes is compared set against set in integers
  (``den * |A and B| >= num * |A or B|``); nothing is estimated.
* **Recursion.** In a region of at most ``small`` members all pairs within the windows are
  compared. A larger region takes its smallest member as pivot document and links
  what lies within reach of it; members that are by then in one component need no
  further comparison (a link between them changes nothing). A region with more than one
  component takes further pivots from outside its largest component, ``PIVOTS`` a round, each
  from a component of its own, for ``ROUNDS`` rounds.
* **Levels.** A region that still holds more than ``small`` components belongs to a shingle that unrelated sets share, such
  as a passage many documents quote. Its pivot moves to the end of the order, its members choose their
  nearest pivots anew (all other sets keep theirs, as nothing before those has changed), and the new regions are joined
  in the same way, across components only. Two linked sets meet under the new order as they did under the old one, so
  this is exact at every level, and a shared passage brings two sets together only if they have too little else.
  At most ``LEVELS`` levels are taken, and none after one that has left the open regions as they were.
* **Blocks.** The sets of the regions that are open then are dealt into blocks of about ``BLOCK`` by their first open
  region. Two blocks that meet in a region, one of them with a set outside its largest component, are joined
  in a task of their own: pairs with an open region in common, across components, within all windows. However many
  regions a pair shares, it is made once.
* Equal sets form one class before anything is joined; a class is one node.
* A pair is compared once, in whatever regions and steps it turns up.

A document without words links with nothing. Rows that repeat a ``doc_id`` follow their
own text; a null ``doc_id`` belongs to its class but names no component (its component
is null if no other row shares the class). Null text counts as empty. An empty table
gives an empty result. Other columns are ignored.

Sets are held as 64-bit hashes of the shingles and classes as 128-bit sums of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.llm.tables import FILTER_BITS, filter_place, id_filter, joined_components, passes
from linkweave.llm.words import list_column, mix64, pieces, shingles, signed, word_hashes
from linkweave.session import materialize

ORDER_BITS = 18
BINS = 256
BINNED = 400
ROUNDS = 1
PIVOTS = 8
LEVELS = 3
LESS = 4  # a level must take a quarter of the components out of the mixed regions, or the blocks take over
SMALL = 48
BLOCK = 256
COLUMNS = 4096  # open regions looked at in one step of a task
_U = np.uint64
PARITY = ["par0", "par1", "par2", "par3"]
LOW = (1 << FILTER_BITS) - 1  # a region is a hash already, so its low bits are its place in a filter


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sets(b: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    words, first = word_hashes(b.column("text"))
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        yield shingles(words[a:z], k)


def profiles(docs: DataFrame, k: int, order_bits: int = ORDER_BITS) -> DataFrame:
    """Two kinds of rows: one per document (``n``, class digest ``d1, d2``) and per task the bucket loads."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = np.zeros(1 << order_bits, np.int64)
        names = ["doc_id", "n", "d1", "d2", "bucket", "load"]
        for b in pieces(batches):
            n, d1, d2 = [], [], []
            with np.errstate(over="ignore"):
                for s in _sets(b, k):
                    n.append(len(s))
                    d1.append(int(mix64(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U)))
                    d2.append(int(mix64(s ^ _U(0x14057B7EF767814F)).sum(dtype=_U)))
                    np.add.at(load, (s >> _U(64 - order_bits)).astype(np.int64), 1)
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(signed(np.array(d1, _U))),
                 pa.array(signed(np.array(d2, _U))), none, none], names)
        for lo in range(0, len(load), 1 << 16):
            used = lo + np.flatnonzero(load[lo:lo + (1 << 16)])
            none = pa.nulls(len(used), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(used), pa.array(load[used])], names)

    return docs.mapInArrow(scan, "doc_id bigint, n bigint, d1 bigint, d2 bigint, bucket bigint, load bigint")


def replicas(docs: DataFrame, k: int, num: int, den: int, load: np.ndarray, order_bits: int,
             late: np.ndarray | None = None, before: np.ndarray | None = None, only: np.ndarray | None = None,
             reps: np.ndarray | None = None) -> DataFrame:
    """``(doc_id, n, d1, parity, bins, pivots)``: the first pivots of every set, as many as the window takes.

    ``bins``: shingles per hash class, for sets of ``BINNED`` shingles or more (else empty). ``late``: filter of the
    pivots that come after all others, given with those that did ``before``: then ``pivots`` holds only those that the
    set did not have or that have become late. ``only``: filter of the ids to read; ``reps``: filter of the sets to
    keep (see ``class_place``).
    """
    shared = docs.sparkSession.sparkContext.broadcast((load, late, before, only, reps))

    def first_pivots(s: np.ndarray, take: int, weight: np.ndarray) -> np.ndarray:
        edge = np.partition(weight, take - 1)[take - 1]
        near = np.flatnonzero(weight <= edge)  # ascending hash breaks ties
        return s[near[np.argsort(weight[near], kind="stable")[:take]]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, late, before, only, reps = shared.value
        for b in pieces(batches):
            if only is not None:
                b = b.filter(pa.array(passes(only, b.column("place").to_numpy())))
            if not b.num_rows:
                continue
            n, d1, par, bins, keys, kept = [], [], [], [], [], []
            ids = b.column("doc_id").to_pylist()
            with np.errstate(over="ignore"):
                for at, s in enumerate(_sets(b, k)):
                    size = len(s)
                    digest = mix64(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U)
                    if reps is not None and (ids[at] is None or not passes(reps, np.array([(int(digest) ^ ids[at]) & LOW]))[0]):
                        continue
                    kept.append(at)
                    n.append(size)
                    d1.append(int(digest))
                    counts = np.bincount((s & _U(255)).astype(np.int64), minlength=256)
                    par.append(np.packbits((counts & 1).astype(np.uint8)).view(np.int64))
                    bins.append(counts.astype(np.int32) if size >= BINNED else counts[:0].astype(np.int32))
                    take = size + (-num * size // den) + 1 if size else 0  # size - ceil(num * size / den) + 1
                    if take < size:
                        weight = rank[(s >> _U(64 - order_bits)).astype(np.int64)]
                        if late is None:
                            s = first_pivots(s, take, weight)
                        else:
                            place = (s & _U(LOW)).astype(np.int64)
                            was = passes(before, place) if before is not None else np.zeros(size, bool)
                            now = passes(late, place)
                            had = np.isin(s, first_pivots(s, take, weight + (was.astype(np.int64) << 32))) & ~(now & ~was)
                            has = np.isin(s, first_pivots(s, take, weight + (now.astype(np.int64) << 32)))
                            s = s[has & ~had]
                    elif late is not None:
                        place = (s & _U(LOW)).astype(np.int64)
                        s = s[passes(late, place) & (True if before is None else ~passes(before, place))]
                    keys.append(s)
            if not kept:
                continue
            par = np.array(par).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(kept)), pa.array(n, pa.int64()), pa.array(signed(np.array(d1, _U))),
                 *[pa.array(np.ascontiguousarray(par[:, i])) for i in range(4)],
                 list_column(np.concatenate(bins), np.array([len(x) for x in bins])),
                 list_column(signed(np.concatenate(keys)), np.array([len(x) for x in keys]))],
                ["doc_id", "n", "d1", *PARITY, "bins", "pivots"])

    read = docs if only is None else docs.where("doc_id IS NOT NULL").withColumn("place", filter_place("doc_id"))
    return read.mapInArrow(scan, "doc_id bigint, n bigint, d1 bigint, par0 bigint, par1 bigint, par2 bigint, "
                                 "par3 bigint, bins array<int>, pivots array<bigint>")


def class_place(node: str) -> Column:
    """Place of a set in a filter: of its row's id and its digest ``d1``."""
    return F.col(node).bitwiseXOR(F.col("d1")).bitwiseAND(F.lit(LOW))


def passing(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """The rows whose ``place`` passes the filter."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(passes(shared.value, b.column("place").to_numpy())))

    return rows.mapInArrow(scan, rows.schema)


def representatives(docs: DataFrame, own: DataFrame, nodes: DataFrame, k: int, num: int, den: int, load: np.ndarray,
                    order_bits: int) -> DataFrame:
    """``replicas`` of the classes' own rows, without a shuffle of the pivots.

    A filter of fixed size leaves out nearly all other rows in the scan. Those that it lets through by chance
    are found among the narrow rows ``own`` and taken out.
    """
    bits = id_filter(nodes.select(class_place("node").alias("place")))
    copies = (own.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "d1", "n")
              .join(nodes.select(F.col("node").alias("doc_id"), "d1", "n"), ["doc_id", "d1", "n"], "left_anti")
              .withColumn("place", class_place("doc_id")))
    chance = materialize(passing(copies, bits).select("doc_id", "d1", "n"), "jaccard-chance")
    found = replicas(docs, k, num, den, load, order_bits, reps=bits)
    if not chance.isEmpty():
        found = found.join(chance, ["doc_id", "d1", "n"], "left_anti")
    return materialize(found.where("n > 0").withColumnRenamed("doc_id", "node"), "jaccard-replicas")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def within_windows(num: int, den: int, a: str = "", b: str = "o_") -> Column:
    """Size and parity windows of a pair: columns ``n, par*`` with the two prefixes."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    apart = sum((F.bit_count(F.col(f"{a}{p}").bitwiseXOR(F.col(f"{b}{p}"))) for p in PARITY), F.lit(0))
    return ((F.lit(den) * F.least(na, nb) >= F.lit(num) * F.greatest(na, nb))
            & (F.lit(den + num) * apart <= F.lit(den - num) * (na + nb)))


def within_bins(pairs: DataFrame, placed: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` whose bin counts lie close enough: ``|A xor B| >= sum |bins(A) - bins(B)|``.

    Parity tells too little about sets of many hundred shingles; their counts do. ``pairs`` is a written table, so that
    only the bins of its nodes are shuffled.
    """
    met = placed.where(F.size("bins") > 0).select("node", "n", "bins").join(ends_of(pairs), "node", "left_semi").distinct()
    a, b = (met.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bins").alias(f"bins_{x}")) for x in "ab")
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    apart = F.aggregate(F.zip_with("bins_a", "bins_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda t, x: t + x)
    near = F.lit(den + num) * apart <= F.lit(den - num) * (F.col("na") + F.col("nb"))
    return both.where(F.col("bins_a").isNull() | F.col("bins_b").isNull() | near).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """The pairs ``(a, b)`` whose sets ``sets(node, shingle_set)`` reach the similarity."""
    sets = sets.join(ends_of(pairs), "node", "left_semi")
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingle_set").alias("sa")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingle_set").alias("sb")), "b"))
    common = F.size(F.array_intersect("sa", "sb"))
    ok = F.lit(den) * common >= F.lit(num) * (F.size("sa") + F.size("sb") - common)
    return materialize(both.where(ok).select("a", "b"), name)


def shingle_sets(docs: DataFrame, nodes: DataFrame, k: int, name: str) -> DataFrame:
    """``(node, shingle_set)`` for the listed nodes only.

    Texts are not shuffled: a filter of fixed size tells the tasks which rows to read, and the
    join after it leaves out what passed by chance.
    """
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(nodes.select(filter_place("node").alias("place"))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in pieces(batches):
            b = whole.filter(pa.array(passes(shared.value, whole.column("place").to_numpy())))
            if not b.num_rows:
                continue
            found = list(_sets(b, k))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), list_column(signed(np.concatenate(found)), np.array([len(s) for s in found]))],
                ["node", "shingle_set"])

    read = (docs.where("doc_id IS NOT NULL").withColumn("place", filter_place("doc_id"))
            .mapInArrow(scan, "node bigint, shingle_set array<bigint>"))
    out = materialize(read.join(nodes.select("node").distinct(), "node", "left_semi"), name)
    shared.destroy()
    return out


def region_filter(regions: DataFrame) -> np.ndarray:
    return id_filter(regions.select(F.col("region").bitwiseAND(F.lit(LOW)).alias("place")))


def placed_in(placed: DataFrame, bits: Broadcast, late: Broadcast | None = None) -> DataFrame:
    """``(region, node)`` of the pivots that pass the filter of regions, which keeps all others out of the shuffle.

    What passes by chance must be left out by a join. ``late``: two filters, of the pivots that are late now and of
    those that were when these were chosen (or None); what has become late is left out.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pivots = b.column("pivots")
            region = pivots.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), np.diff(pivots.offsets.to_numpy()))
            keep = passes(bits.value, region & LOW)
            if late is not None:
                now, then = late.value
                keep &= ~passes(now, region & LOW) | (passes(then, region & LOW) if then is not None else False)
            keep = np.flatnonzero(keep)
            node = b.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(region[keep]), pa.array(node[row[keep]])], ["region", "node"])

    return placed.select("node", "pivots").mapInArrow(scan, "region bigint, node bigint")


def shared_rows(rows: DataFrame, shared: DataFrame, placed: DataFrame, name: str = "jaccard-met") -> DataFrame:
    """``(region, node, n, par*, members)`` of the regions with more than one member, written once.

    Most pivots are alone in their region. ``rows``: see ``placed_in``.
    """
    return materialize(rows.join(shared, "region").join(placed.select("node", "n", *PARITY), "node"), name)


def newly_late(placed: DataFrame, late: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """``node`` of the sets with a pivot that is ``late`` but was not ``before``: only their pivots change."""
    bits = placed.sparkSession.sparkContext.broadcast((late, before))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, before = bits.value
        for b in batches:
            pivots = b.column("pivots")
            place = pivots.flatten().to_numpy(zero_copy_only=False) & LOW
            hit = passes(late, place)
            if before is not None:
                hit &= ~passes(before, place)
            row = np.repeat(np.arange(b.num_rows), np.diff(pivots.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(np.unique(row[hit])))], ["node"])

    return placed.select("node", "pivots").mapInArrow(scan, "node bigint")


def open_regions(many: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the regions that still hold more than one component, with ``component`` and the region's largest, ``main``."""
    named = many.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = named.groupBy("region", "component").agg(F.count(F.lit(1)).alias("size"))
    main = (sizes.groupBy("region").agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("size", "component")).alias("main"))
            .where("parts > 1"))
    return named.join(main, "region")


def star_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """The next pivot documents of every open region, members of different components outside its largest one, against
    the members that are not yet in the pivot's component."""
    by_part = (rows.where("component <> main").groupBy("region", "component")
               .agg(F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node"))).alias("first")))
    order = Window.partitionBy("region").orderBy("first")
    pivot = (by_part.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= PIVOTS)
             .select("region", F.col("first.node").alias("pivot")))
    centre = (rows.join(pivot, "region").where("node = pivot")
              .select("region", *[F.col(c).alias(f"o_{c}") for c in ("node", "component", "n", *PARITY)]))
    met = rows.join(centre, "region").where("component <> o_component").where(within_windows(num, den))
    return met.select(F.greatest("node", "o_node").alias("a"), F.least("node", "o_node").alias("b")).distinct()


def meeting(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which sets of the two blocks have an open region in common."""
    out = np.zeros((len(left), len(right)), bool)
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    for lo in range(0, len(both), COLUMNS):
        some = both[lo:lo + COLUMNS]
        tables = []
        for side in (left, right):
            flat = np.concatenate(side)
            row = np.repeat(np.arange(len(side)), [len(x) for x in side])
            at = np.minimum(np.searchsorted(some, flat), len(some) - 1)
            hit = some[at] == flat
            tables.append(np.zeros((len(side), len(some)), np.float32))
            tables[-1][row[hit], at[hit]] = 1
        out |= tables[0] @ tables[1].T > 0
    return out


def block_pairs(rows: DataFrame, placed: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Distinct pairs ``(a, b)`` across components that meet in a region of ``rows`` (see ``open_regions``).

    A task holds two blocks. Pairs outside the size, parity or bin windows never leave it.
    """
    import pandas as pd

    sets = rows.groupBy("node").agg(F.min("region").alias("home"), F.collect_set("region").alias("regions"),
                                    F.first("component").alias("component"))  # as many regions as the set has pivots
    homes = sets.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("bigint").alias("blocks"))
    sets = materialize(sets.join(homes, "home")
                       .withColumn("block", F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("blocks"))))
                       .join(placed.select("node", "n", *PARITY, "bins"), "node")
                       .select("block", "node", "component", "regions", "n", *PARITY, "bins"), "jaccard-blocks")
    held = (rows.join(sets.select("node", "block"), "node").groupBy("region", "block")
            .agg(F.max(F.col("component") != F.col("main")).alias("outside")))
    pairs = (held.where("outside").select("region", F.col("block").alias("x"))
             .join(held.select("region", F.col("block").alias("y")), "region")
             .select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct())
    ends = pairs.select("lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"))

    def join(part: pd.DataFrame) -> pd.DataFrame:
        left = part[part["block"] == part["lo"].iloc[0]]
        right = part[part["block"] == part["hi"].iloc[0]]
        bits = [x[PARITY].to_numpy().view(np.uint64) for x in (left, right)]
        size = [x["n"].to_numpy() for x in (left, right)]
        comp = [x["component"].to_numpy() for x in (left, right)]
        node = [x["node"].to_numpy() for x in (left, right)]
        binned = [np.array([len(v) > 0 for v in x["bins"]], bool) for x in (left, right)]
        bins = [np.stack([v if len(v) else np.zeros(BINS, np.int32) for v in x["bins"]]) if len(x) else None for x in (left, right)]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        meet = meeting(list(left["regions"]), list(right["regions"])) if len(left) and len(right) else np.zeros((0, 0), bool)
        if part["lo"].iloc[0] == part["hi"].iloc[0]:
            meet = np.triu(meet, 1)
        for i in range(len(meet)):
            total = size[0][i] + size[1]
            apart = np.bitwise_count(bits[0][i] ^ bits[1]).sum(axis=1, dtype=np.int64)
            ok = (meet[i] & (comp[1] != comp[0][i]) & (den * np.minimum(size[0][i], size[1]) >= num * np.maximum(size[0][i], size[1]))
                  & ((den + num) * apart <= (den - num) * total))
            j = np.flatnonzero(ok)
            if binned[0][i] and len(j):
                far = (den + num) * np.abs(bins[1][j] - bins[0][i]).sum(axis=1, dtype=np.int64) > (den - num) * total[j]
                j = j[~(far & binned[1][j])]
            a.append(np.full(len(j), node[0][i]))
            b.append(node[1][j])
        a, b = np.concatenate(a), np.concatenate(b)
        return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return sets.join(ends, "block").groupBy("lo", "hi").applyInPandas(join, "a bigint, b bigint")


def jaccard_classes(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, order_bits: int = ORDER_BITS,
                    small: int = SMALL, block: int = BLOCK, rounds: int = ROUNDS, levels: int = LEVELS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row of ``docs``; links are pairs with ``den*|A and B| >= num*|A or B|``."""
    docs = _rows(docs)
    scanned = materialize(profiles(docs, k, order_bits), "jaccard-profiles")
    own = scanned.where("n IS NOT NULL").select("doc_id", "n", "d1", "d2")
    loads = scanned.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("load").alias("load")).toArrow()
    load = np.zeros(1 << order_bits, np.uint32)  # one counter per bucket
    load[loads.column("bucket").to_numpy()] = np.minimum(loads.column("load").to_numpy(), 2**32 - 1)

    classes = own.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("node"))
    nodes = materialize(classes.where("node IS NOT NULL"), "jaccard-classes")
    placed = representatives(docs, own, nodes, k, num, den, load, order_bits)
    shared = materialize(placed.select(F.explode("pivots").alias("region")).groupBy("region")
                         .agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "jaccard-shared")
    context = docs.sparkSession.sparkContext
    bits = context.broadcast(region_filter(shared))
    met = shared_rows(placed_in(placed, bits), shared, placed)
    bits.destroy()

    other = [F.col(c).alias(f"o_{c}") for c in ("node", "n", *PARITY)]
    few = met.where(F.col("members") <= small)
    close = (few.join(few.select("region", *other), "region")
             .where("node > o_node").where(within_windows(num, den)).select(F.col("node").alias("a"), F.col("o_node").alias("b")))
    many = met.where(F.col("members") > small)
    first = many.groupBy("region").agg(F.min("node").alias("pivot"))
    centre = many.join(first, "region").where("node = pivot").select("region", *other)
    star = (many.join(centre, "region").where("node > o_node").where(within_windows(num, den))
            .select(F.col("node").alias("a"), F.col("o_node").alias("b")))
    sets, found, done = None, None, None

    def compare(pairs: DataFrame, name: str) -> bool:
        """Verify the pairs that have not been compared yet, reading only sets that are not at hand, and join the
        components by the new links. Whether there are any."""
        nonlocal sets, found, done
        pairs = pairs.distinct() if done is None else pairs.distinct().join(done, ["a", "b"], "left_anti")
        near = materialize(pairs, f"jaccard-near-{name}")
        if found is not None and near.isEmpty():
            return False
        done = near if done is None else done.union(near)
        pairs = materialize(within_bins(near, placed, num, den), f"jaccard-pairs-{name}")
        if found is not None and pairs.isEmpty():
            return False
        ends = ends_of(pairs)
        fresh = shingle_sets(docs, ends if sets is None else ends.join(sets.select("node"), "node", "left_anti"), k, f"jaccard-sets-{name}")
        sets = fresh if sets is None else sets.union(fresh)
        links = verified(pairs, sets, num, den, f"jaccard-links-{name}")
        before, found = found, joined_components(found, links, f"jaccard-components-{name}")
        return found is not before

    def still_open(rows: DataFrame, name: str) -> DataFrame:
        return materialize(open_regions(rows.select("region", "node", "n", *PARITY), found), f"jaccard-open-{name}")

    compare(close.union(star), "first")
    opened, linked = still_open(many, "first"), True
    for i in range(rounds):
        linked = compare(star_pairs(opened, num, den), f"star-{i}")
        if not linked:
            break
        opened = still_open(opened, f"star-{i}")

    late, layers, width = None, [(placed, None)], None
    for i in range(levels):
        still = materialize(opened.groupBy("region").agg(F.max("parts").alias("parts")), f"jaccard-still-{i}")
        mixed = still.where(F.col("parts") > small).select("region")
        last, width = width, still.where(F.col("parts") > small).agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0]
        if not width or (last is not None and LESS * width > (LESS - 1) * last):
            break
        before, late = late, region_filter(mixed) if late is None else late | region_filter(mixed)
        moved = layers[0][0].select("node").limit(0)
        for layer, _ in layers:
            moved = moved.union(newly_late(layer, late, before))
        moved = materialize(moved.distinct(), f"jaccard-moved-{i}")
        if moved.isEmpty():
            break
        again = (replicas(docs, k, num, den, load, order_bits, late, before, id_filter(moved.select(filter_place("node").alias("place"))))
                 .join(nodes.select(F.col("node").alias("doc_id"), "d1", "n"), ["doc_id", "d1", "n"], "left_semi")
                 .withColumnRenamed("doc_id", "node").join(moved, "node", "left_semi"))
        fresh = materialize(again.select("node", "pivots"), f"jaccard-replicas-{i}")
        layers.append((fresh, late))
        # sets that keep their pivots have met already, but for the regions that are still open
        regions = materialize(fresh.select(F.explode("pivots").alias("region")).union(still.select("region")).distinct(), f"jaccard-regions-{i}")
        held = [context.broadcast(region_filter(regions))]
        rows = None
        for layer, then in layers:
            held.append(context.broadcast((late, then)))
            part = placed_in(layer, held[0], held[-1])
            rows = part if rows is None else rows.union(part)
        rows = materialize(rows.join(regions, "region", "left_semi"), f"jaccard-rows-{i}")
        for b in held:
            b.destroy()
        shared = rows.groupBy("region").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        met = shared_rows(rows, shared, placed, f"jaccard-met-{i}")
        few = (met.where(F.col("members") <= small).join(found, "node", "left")
               .withColumn("component", F.coalesce("component", "node")))
        close = (few.join(few.select("region", F.col("component").alias("o_component"), *other), "region")
                 .where("node > o_node AND component <> o_component").where(within_windows(num, den))
                 .select(F.col("node").alias("a"), F.col("o_node").alias("b")))
        opened = still_open(met.where(F.col("members") > small), f"level-{i}")
        # regions that no link has changed since their last pivots have nothing new to compare
        changed = opened if linked else opened.join(still.select("region"), "region", "left_anti")
        linked = compare(close.union(star_pairs(changed, num, den)), f"level-{i}")
        if linked:
            opened = still_open(opened, f"linked-{i}")

    compare(block_pairs(opened.select("region", "node", "component", "main"), placed, num, den, block), "blocks")
    known = (nodes.join(found, "node", "left")
             .select("d1", "d2", "n", F.coalesce("component", "node").alias("component")))
    return (own.join(known, ["d1", "d2", "n"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))
