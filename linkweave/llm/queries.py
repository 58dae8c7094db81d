"""Registered queries of the training-data operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm import (align, chunk_dedup, collocations, decontaminate, embedding_dedup, hmm, html_extract, jaccard_join,
                           langid, line_dedup, mixing, token_output, url_filter)
from linkweave.llm.tables import hash_fold, ship_package, table
from linkweave.session import scratch_path

END_ID = 0


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


@_shipped
def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and hidden Markov score of every whole text."""
    return hmm.score(hmm.hold_out(table(spark, sf_dir, "documents")), "hmm_held_out")


@_shipped
def op2_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that an earlier document holds already."""
    return chunk_dedup.repeated_spans(table(spark, sf_dir, "documents"))


@_shipped
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector: cosine 0.9 or more in double precision."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@_shipped
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document: 3-word shingles, similarity 0.9 or more."""
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


@_shipped
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and its containment."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_shipped
def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, weight, rate and draw of every document under tempered source, language and topic marginals."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"),
                        F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"),
                        F.round("mix_weight", 9).alias("weight"), F.round("mix_rate", 9).alias("rate"),
                        F.col("mix_kept").alias("kept"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_shipped
def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position, length and checksum of every document's ids, decoded from the written shards."""
    path = scratch_path(spark, "token-shards")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file(), END_ID)
    return token_output.digests(spark.read.parquet(path))


@_shipped
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text, learnt from three of four folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(hash_fold("doc_id", 4) == 2, F.lit(False))
    model = langid.train(docs.where(~held))
    out = langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


@_shipped
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document before and after the global line deduplication."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@_shipped
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document's ids under two tokenizers, with corpus-wide counts of the linked id pairs."""
    out = align.align(table(spark, sf_dir, "documents"), tokenizer_file(), piece_file())
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@_shipped
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of two to four words of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, covered=80, top=2000)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url; without a rule the verdict of its host in the link graph."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.rule_table(spark, url_filter.RULES)).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {q.__name__: q for q in (
    op1_lm_score, op2_chunk_dedup, op3_embedding_dedup, op4_jaccard_join, op5_decontaminate, op6_html_extract,
    op7_mix_sources, op8_token_output, op9_language_id, op10_line_dedup, op11_token_alignment, op12_collocations,
    op13_url_filter)}

_TOKENS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def _mixing_sql(temper: float = 0.7, rounds: int = 12, docs: str = "documents") -> str:
    """The raking rounds written out as a chain of common table expressions."""
    head = f"""
WITH marked AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, {_TOKENS} AS n_tokens
  FROM {docs}),
docs AS (SELECT *, CASE WHEN n_tokens < 128 THEN 'brief' WHEN n_tokens < 1024 THEN 'standard' ELSE 'long' END AS topic FROM marked),
cells AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY ALL),
r0 AS (
  SELECT *, tokens::DOUBLE AS weight,
    pow(sum(tokens) OVER (PARTITION BY source)::DOUBLE, {temper}) AS ws,
    pow(sum(tokens) OVER (PARTITION BY lang)::DOUBLE, {temper}) AS wl,
    pow(sum(tokens) OVER (PARTITION BY topic)::DOUBLE, {temper}) AS wt
  FROM cells WHERE tokens > 0),
n AS (SELECT (SELECT sum(w) FROM (SELECT DISTINCT source, ws AS w FROM r0)) AS ns,
             (SELECT sum(w) FROM (SELECT DISTINCT lang, wl AS w FROM r0)) AS nl,
             (SELECT sum(w) FROM (SELECT DISTINCT topic, wt AS w FROM r0)) AS nt),
s0 AS (SELECT source, lang, topic, tokens, weight, ws / ns AS ws, wl / nl AS wl, wt / nt AS wt FROM r0, n)"""
    prev = "s0"
    for i in range(1, rounds + 1):
        for d, w in (("source", "ws"), ("lang", "wl"), ("topic", "wt")):
            name = f"{w}{i}"
            head += (f",\n{name} AS (SELECT * EXCLUDE (weight), weight * {w} / sum(weight) OVER (PARTITION BY {d}) AS weight "
                     f"FROM {prev})")
            prev = name
    return head + f""",
rates AS (SELECT source, lang, topic, weight, (weight / tokens) / max(weight / tokens) OVER () AS rate FROM {prev})
SELECT doc_id, d.source, d.lang, d.topic, n_tokens::BIGINT AS n_tokens,
  round(coalesce(weight, 0.0), 9) AS weight,
  round(CASE WHEN n_tokens > 0 THEN coalesce(rate, 0.0) ELSE 0.0 END, 9) AS rate,
  (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0)
    < (CASE WHEN n_tokens > 0 THEN coalesce(rate, 0.0) ELSE 0.0 END) AS kept
FROM docs d LEFT JOIN rates r ON d.source = r.source AND d.lang = r.lang AND d.topic = r.topic
"""


_LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
hot AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40 AND doc_id IS NOT NULL
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.line, k.pos, h.key IS NOT NULL AND k.doc_id <> h.holder AS gone
  FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_WORDS = r"""
w AS (
  SELECT {id} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM {table})"""


def _shingle_sql(name: str, id_col: str, source: str, k: int) -> str:
    """``name(id, shingle)``: distinct k-word shingles, or all words of a shorter text."""
    words = _WORDS.format(id=id_col, table=source).strip().removeprefix("w AS ")
    return f"""{name}_w AS {words},
{name} AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {k} THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - {k} + 2), lambda i: array_to_string(words[i:i + {k} - 1], ' ')) END) AS shingle
  FROM {name}_w)"""


_CONTAINED_SQL = f"""
WITH {_shingle_sql("d", "doc_id", "documents", 5)},
{_shingle_sql("i", "item_id", "benchmark", 5)},
n AS (SELECT id, count(*) AS n_item FROM i GROUP BY id),
c AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_common FROM d JOIN i USING (shingle) GROUP BY ALL)
SELECT doc_id, item_id, n_common::BIGINT AS n_common, n_item::BIGINT AS n_item, n_common / n_item AS containment
FROM c JOIN n ON c.item_id = n.id WHERE 10 * n_common >= 8 * n_item
"""

_CLASSES_SQL = f"""
WITH RECURSIVE {_shingle_sql("s", "doc_id", "documents", 3)},
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS m FROM s a JOIN s b ON a.shingle = b.shingle AND a.id < b.id GROUP BY ALL),
link AS (SELECT a, b FROM c JOIN n x ON a = x.id JOIN n y ON b = y.id WHERE 100 * m >= 90 * (x.n + y.n - m)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.id
LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON d.doc_id = r.a
"""

_PHRASES_SQL = r"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM cut),
total AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, size, phrase, count(*)::HUGEINT AS n FROM (
    SELECT lang, k AS size, unnest(list_transform(range(1, greatest(len(words) - k + 1, 0) + 1),
      lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
    FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(words) >= k) GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT lang, size, phrase, n AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head,
    array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM f, (SELECT unnest([1, 2, 3]) AS k) WHERE k < size),
scored AS (
  SELECT c.*, h.n AS l, t.n AS r, 2000000 * c.a // (h.n + t.n) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.rest),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM weakest x WHERE NOT EXISTS (
    SELECT 1 FROM f y WHERE y.lang = x.lang AND y.size > x.size AND 100 * y.n >= 80 * x.a
      AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang)
WHERE rank <= 2000
"""


def _urls_sql(rules: list[tuple[str, str, str]], damping: float, rounds: int, limit: float) -> str:
    """Rules as a list of values; the rounds as a recursive table of both walks."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE rules(rule_host, rule_path, verdict) AS (VALUES {values}),
p AS (
  SELECT page_id, row_number() OVER () AS row, html, coalesce({low.format("regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (
  SELECT row, rule_host || rule_path AS rule, verdict FROM p JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(rule_host || rule_path) DESC, verdict DESC) = 1),
hosts AS (
  SELECT host, count(*) AS pages, count(*) FILTER (verdict = 'allow') AS allowed, count(*) FILTER (verdict = 'block') AS blocked
  FROM p LEFT JOIN ruled USING (row) WHERE host <> '' GROUP BY host),
ends AS (
  SELECT DISTINCT row, host AS src, {low.format("unnest(regexp_extract_all(html, '@LINK@', 1))")} AS dst FROM p),
links AS (SELECT src, dst, count(*) AS n FROM ends WHERE src <> '' AND src <> dst GROUP BY ALL),
ways AS (SELECT 'trust' AS kind, src AS host, dst AS too, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links),
steps AS MATERIALIZED (SELECT kind, host, too, n / sum(n) OVER (PARTITION BY kind, host) AS share FROM ways),
known AS (SELECT host FROM hosts UNION SELECT src FROM links UNION SELECT dst FROM links),
seeds AS MATERIALIZED (
  SELECT kind, host, coalesce(CASE WHEN kind = 'trust' THEN allowed ELSE blocked END, 0)::DOUBLE AS seed
  FROM known CROSS JOIN (SELECT unnest(['trust', 'distrust']) AS kind) LEFT JOIN hosts USING (host)),
moves AS MATERIALIZED (
  SELECT kind, host, too, share FROM steps
  UNION ALL SELECT kind, host, host, 1.0 FROM seeds ANTI JOIN steps USING (kind, host)
  UNION ALL SELECT kind, host, host, 0.0 FROM seeds SEMI JOIN steps USING (kind, host)),
walk AS (
  SELECT 0 AS i, kind, host, seed AS mass FROM seeds
  UNION ALL
  SELECT any_value(i) + 1, w.kind, m.too, any_value(s.seed) * {1 - damping} + {damping} * sum(w.mass * m.share)
  FROM walk w JOIN moves m ON m.kind = w.kind AND m.host = w.host JOIN seeds s ON s.kind = w.kind AND s.host = m.too
  WHERE i < {rounds} GROUP BY w.kind, m.too),
judged AS (
  SELECT host, round(coalesce(sum(mass) FILTER (kind = 'distrust'), 0) - coalesce(sum(mass) FILTER (kind = 'trust'), 0)
    - {limit} * any_value(pages), 9) > 0 AS over
  FROM walk JOIN hosts USING (host) WHERE i = {rounds} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN over THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN ruled USING (row) LEFT JOIN judged USING (host)
""".replace("@LINK@", url_filter.LINK.replace("*+", "*").replace("++", "+").replace("'", "''"))


ORACLE_SQL = {
    "op4_jaccard_join": _CLASSES_SQL,
    "op5_decontaminate": _CONTAINED_SQL,
    "op7_mix_sources": _mixing_sql(),
    "op10_line_dedup": _LINES_SQL,
    "op12_collocations": _PHRASES_SQL,
    "op13_url_filter": _urls_sql(url_filter.RULES, url_filter.DAMPING, url_filter.ROUNDS, url_filter.LIMIT),
}
