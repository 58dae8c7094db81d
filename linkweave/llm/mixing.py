"""Mixing sources to target weights by iterative proportional fitting (raking), DataFrame functions only.

Documents fall into cells (source, language, topic). Each cell's token weight is
scaled until the weighted token totals meet the target share of every source,
every language and every topic; a document is then kept with a probability
proportional to its cell's weight per token. The draw is a hash of ``doc_id``, so a
retry or another run keeps the same documents.

* The marginals come from ``targets(dimension, category, share)``; without it every
  dimension is tempered: share proportional to ``tokens ** temper``. Shares are
  normalised per dimension; a category without a target keeps weight 0 and is
  never sampled, a target without documents is left out.
* ``topic`` is the length register of a text (``brief`` under 128 tokens,
  ``standard`` under 1,024, else ``long``) unless the table has a ``topic`` column.
* A null source, language or topic is the category ``unknown``; a null or empty
  text has no tokens and is kept never; a null ``doc_id`` draws as the text ``''``.
* Rows that repeat a ``doc_id`` draw alike. An empty table gives an empty result.

Only the cell table (number of sources x languages x topics) goes through the
fitting rounds; documents are read once for the counts and once for the draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.session import materialize

DIMENSIONS = ("source", "lang", "topic")
WORD = "[^\\x20\\x09-\\x0D]+"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(doc_id: Column) -> Column:
    """A uniform number in [0, 1) that depends on the id alone."""
    digest = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / F.lit(4294967296.0)


def with_cells(docs: DataFrame) -> DataFrame:
    """The table's columns as ``c0, c1, ...`` (so none can clash) with ``mix_source``, ``mix_lang``, ``mix_topic``,
    ``mix_tokens`` and ``mix_draw``."""
    low = {c.lower(): c for c in docs.columns}

    def col(name: str) -> Column:
        return F.col(f"`{low[name]}`").cast("string") if name in low else F.lit(None).cast("string")

    tokens = n_tokens(col("text"))
    register = F.when(tokens < 128, "brief").when(tokens < 1024, "standard").otherwise("long")
    topic = F.coalesce(col("topic"), F.lit("unknown")) if "topic" in low else register
    return docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)],
        F.coalesce(col("source"), F.lit("unknown")).alias("mix_source"), F.coalesce(col("lang"), F.lit("unknown")).alias("mix_lang"),
        topic.alias("mix_topic"), tokens.alias("mix_tokens"), draw(col("doc_id")).alias("mix_draw"))


def tempered(cells: DataFrame, temper: float) -> DataFrame:
    """Targets with share proportional to tokens ** temper in every dimension."""
    one = [cells.groupBy(F.col(d).alias("category")).agg(F.sum("tokens").alias("t"))
           .select(F.lit(d).alias("dimension"), "category", F.pow(F.col("t").cast("double"), F.lit(temper)).alias("share"))
           for d in DIMENSIONS]
    return one[0].union(one[1]).union(one[2])


def rake(cells: DataFrame, targets: DataFrame, rounds: int = 12, checkpoint_every: int = 4) -> DataFrame:
    """``cells(source, lang, topic, n_docs, tokens)`` with ``weight``: weighted tokens that meet the targets.

    One round scales the weights to each dimension in turn. Weights sum to 1.
    """
    for d in DIMENSIONS:
        share = (targets.where(F.col("dimension") == d)
                 .groupBy(F.col("category").alias(d)).agg(F.sum(F.col("share").cast("double")).alias("share")))
        cells = cells.join(share, d, "left").withColumn(f"want_{d}", F.coalesce("share", F.lit(0.0))).drop("share")
    present = materialize(cells.where("tokens > 0 AND want_source > 0 AND want_lang > 0 AND want_topic > 0"), "rake")
    for d in DIMENSIONS:  # shares among the categories that have documents
        total = present.select(d, f"want_{d}").distinct().agg(F.sum(f"want_{d}")).first()[0] or 1.0
        present = present.withColumn(f"want_{d}", F.col(f"want_{d}") / F.lit(total))
    cur = present.withColumn("weight", F.col("tokens").cast("double"))
    for i in range(rounds):
        for d in DIMENSIONS:
            held = F.sum("weight").over(Window.partitionBy(d))
            cur = cur.withColumn("weight", F.col("weight") * F.col(f"want_{d}") / held)
        if (i + 1) % checkpoint_every == 0 or i + 1 == rounds:
            cur = materialize(cur, f"rake-{i}")
    return cur


def sampling_rates(cells: DataFrame) -> DataFrame:
    """``rate`` per cell: weight per token, scaled so that the largest rate is 1 (no cell is clipped)."""
    per = cells.withColumn("per_token", F.col("weight") / F.col("tokens"))
    top = per.agg(F.max("per_token")).first()[0] or 1.0
    return per.withColumn("rate", F.col("per_token") / F.lit(top)).drop("per_token")


def _drawn(docs: DataFrame, targets: DataFrame | None, temper: float, rounds: int) -> DataFrame:
    """``with_cells`` plus ``mix_weight`` (the cell's share of the mix), ``mix_rate`` and ``mix_kept``."""
    marked = with_cells(docs)
    cells = materialize(
        marked.groupBy(F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("mix_tokens").alias("tokens")), "mix-cells")
    fitted = sampling_rates(rake(cells, tempered(cells, temper) if targets is None else targets, rounds))
    rates = fitted.select(F.col("source").alias("mix_source"), F.col("lang").alias("mix_lang"),
                          F.col("topic").alias("mix_topic"), F.col("weight").alias("mix_weight"), F.col("rate").alias("mix_rate"))
    out = marked.join(rates, ["mix_source", "mix_lang", "mix_topic"], "left")
    rate = F.when(F.col("mix_tokens") > 0, F.coalesce("mix_rate", F.lit(0.0))).otherwise(F.lit(0.0))
    return out.withColumns({"mix_rate": rate, "mix_weight": F.coalesce("mix_weight", F.lit(0.0)), "mix_kept": F.col("mix_draw") < rate})


MIX_COLUMNS = ["mix_source", "mix_lang", "mix_topic", "mix_tokens", "mix_weight", "mix_rate", "mix_kept"]


def mix(docs: DataFrame, targets: DataFrame | None = None, temper: float = 0.7, rounds: int = 12) -> DataFrame:
    """Every row with its cell, weight, rate and draw (columns of the table with the names of ``MIX_COLUMNS`` are replaced)."""
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in MIX_COLUMNS]
    return _drawn(docs, targets, temper, rounds).select(*own, *MIX_COLUMNS)


def sample(docs: DataFrame, targets: DataFrame | None = None, temper: float = 0.7, rounds: int = 12) -> DataFrame:
    """The rows of ``docs`` that the draw keeps, with all their columns."""
    kept = _drawn(docs, targets, temper, rounds).where("mix_kept")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
