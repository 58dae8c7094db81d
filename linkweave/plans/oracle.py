"""DuckDB oracle SQL for every registered query with an SQL form.

The CTEs rebuild the fixture relations of ``linkweave.plans.fixtures`` from the
pre-registered driver views; each query adds its final SELECT. Aliases match
the Spark column names exactly.
"""

from __future__ import annotations

from linkweave.plans import catalog as cat
from linkweave.plans import fixtures as fx
from linkweave.operators.preview import PREVIEW_EXCLUDE

OFF = fx.PART_ID_OFFSET


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _ts(d) -> str:
    return f"TIMESTAMP '{d:%Y-%m-%d %H:%M:%S}'"


def _rev(x: str) -> str:
    return f"array_to_string(list_reverse(string_split({x}, '.')), '.')"


def _dr(rank: str, total: str) -> str:
    return (f"CASE WHEN {rank} <= 0 THEN 100 WHEN {rank} >= {total} THEN 0 "
            f"WHEN {rank} IS NOT NULL THEN greatest(0, least(100, CAST(round_even(CAST(100 AS DOUBLE) * (CAST(1 AS DOUBLE) - "
            f"log10(CAST({rank} AS DOUBLE)) / log10(CAST({total} AS DOUBLE))), 0) AS INTEGER))) END")


def _auth(n: str) -> str:
    return (f"CASE WHEN {n} <= 0 THEN 0 WHEN {n} > 0 THEN least(100, CAST(round_even(log10(CAST({n} AS DOUBLE)) * 15, 0) "
            f"AS INTEGER)) END")


def _values(rows, cols) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return _q(v)
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"


def _vc(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


CTE = {}
CTE["vertices"] = f"""vertices AS (
  SELECT s_suppkey AS id, 'com.example.s' || {_vc('s_suppkey')} AS rev_domain,
         CAST(s_nationkey + 1 AS BIGINT) AS num_hosts FROM supplier
  UNION ALL
  SELECT {OFF} + p_partkey, 'org.example.p' || {_vc('p_partkey')},
         CAST(CASE WHEN p_size > 45 THEN 0 ELSE p_size END AS BIGINT) FROM part)"""
CTE["edges"] = f"""edges AS (SELECT DISTINCT {OFF} + l_partkey AS from_id, l_suppkey AS to_id FROM lineitem)"""
CTE["early_edges"] = f"""early_edges AS (SELECT DISTINCT {OFF} + l_partkey AS from_id, l_suppkey AS to_id
  FROM lineitem WHERE l_shipdate < {_ts(fx.EARLY_CUTOFF)})"""
CTE["rank_rows"] = """rank_rows AS (
  SELECT 'p' || CAST(p_partkey AS VARCHAR) || '.example.org' AS domain, p_partkey * 2 + 1 AS harmonic_rank,
         p_retailprice AS harmonic_val, p_partkey + 1 AS pr_rank, p_retailprice / 1e6 AS pr_val,
         CAST(p_size AS BIGINT) AS n_hosts FROM part
  UNION ALL
  SELECT 's' || CAST(s_suppkey AS VARCHAR) || '.example.com', s_suppkey * 2 + 2, s_acctbal, s_suppkey + 1,
         s_acctbal / 1e6, CAST(s_nationkey + 1 AS BIGINT) FROM supplier)"""
CTE["rank_total"] = """rank_total AS (SELECT count(*) AS n FROM rank_rows)"""
CTE["ranks"] = f"""ranks AS (
  SELECT r.domain, r.harmonic_rank, r.harmonic_val, r.pr_rank, r.pr_val, r.n_hosts,
         {_dr('r.harmonic_rank', 't.n')} AS dr_score, {_ts(fx.RANKS_AT)} AS fetched_at
  FROM rank_rows r, rank_total t WHERE r.harmonic_rank <= t.n)"""
CTE["majestic"] = f"""majestic AS (
  SELECT 'p' || CAST(p_partkey AS VARCHAR) || '.example.org' AS domain, p_partkey + 1 AS global_rank,
         p_partkey * 3 + 1 AS tld_rank, p_partkey * 100 AS ref_subnets, p_partkey * 250 AS ref_ips,
         {_ts(fx.RANKS_AT)} AS fetched_at FROM part WHERE p_size <= 30)"""
CTE["tranco"] = f"""tranco AS (
  SELECT 'p' || CAST(p_partkey AS VARCHAR) || '.example.org' AS domain, p_partkey + 1 AS tranco_rank,
         {_ts(fx.RANKS_AT)} AS fetched_at FROM part WHERE p_size > 20)"""
CTE["targets1"] = f"""targets1 AS (
  SELECT 's' || CAST(s_suppkey AS VARCHAR) || '.example.com' AS target FROM supplier
  UNION ALL SELECT {_q(fx.UNKNOWN_TARGET)})"""
CTE["targets2"] = """targets2 AS (
  SELECT 's' || CAST(s_suppkey AS VARCHAR) || '.example.com' AS target FROM supplier WHERE s_nationkey < 13)"""
CTE["targets3"] = """targets3 AS (
  SELECT 's' || CAST(s_suppkey AS VARCHAR) || '.example.com' AS target FROM supplier WHERE s_nationkey >= 10)"""


def _crawl(name: str, targets: str, edges: str, release: str, at) -> str:
    return f"""bl_{name} AS (
  SELECT t.target, {_q(release)} AS release, {_rev('v.rev_domain')} AS linking_domain,
         max(v.num_hosts) AS num_hosts, CAST(NULL AS DOUBLE) AS page_rank
  FROM {targets} t JOIN vertices tv ON tv.rev_domain = {_rev('t.target')}
  JOIN {edges} e ON e.to_id = tv.id JOIN vertices v ON v.id = e.from_id
  GROUP BY t.target, linking_domain),
c_{name} AS (
  SELECT t.target, {_q(release)} AS release, {_ts(at)} AS crawled_at,
         CAST(count(b.linking_domain) AS BIGINT) AS result_count
  FROM {targets} t LEFT JOIN bl_{name} b ON b.target = t.target GROUP BY t.target)"""


CTE["crawl1"] = _crawl("1", "targets1", "early_edges", fx.REL1, fx.REL1_AT)
CTE["crawl2"] = _crawl("2", "targets2", "edges", fx.REL2, fx.REL2_AT)
CTE["crawl3"] = _crawl("3", "targets3", "edges", fx.REL2, fx.RECRAWL_AT)
CTE["store"] = """crawls AS (SELECT * FROM c_1 UNION ALL SELECT * FROM c_2),
backlinks AS (SELECT * FROM bl_1 UNION ALL SELECT * FROM bl_2)"""
CTE["latest"] = """latest AS (
  SELECT target, release, crawled_at, result_count FROM (
    SELECT *, row_number() OVER (PARTITION BY target ORDER BY crawled_at DESC, release DESC,
                                 result_count DESC) AS rn FROM crawls) WHERE rn = 1)"""
CTE["latest_links"] = """latest_links AS (
  SELECT b.*, l.crawled_at FROM latest l JOIN backlinks b ON b.target = l.target AND b.release = l.release)"""
CTE["report"] = f"""report AS (
  SELECT b.target, b.release, b.crawled_at, b.linking_domain, b.num_hosts, r.dr_score, r.harmonic_rank,
         r.pr_val AS pagerank, {_auth('b.num_hosts')} AS authority_score, m.global_rank AS majestic_rank,
         m.ref_subnets, m.ref_ips, t.tranco_rank
  FROM latest_links b LEFT JOIN ranks r ON r.domain = b.linking_domain
  LEFT JOIN majestic m ON m.domain = b.linking_domain LEFT JOIN tranco t ON t.domain = b.linking_domain)"""
CTE["pairs"] = f"""pairs_raw AS (
  SELECT 'S' || CAST(a.s_suppkey AS VARCHAR) || '.EXAMPLE.com.' AS yours,
         ' s' || CAST(b.s_suppkey AS VARCHAR) || '.example.com' AS competitor
  FROM supplier a JOIN supplier b ON b.s_suppkey - 1 = a.s_suppkey
  UNION ALL SELECT * FROM {_values([("s0.example.com", fx.UNKNOWN_TARGET), ("s0.example.com", fx.NEVER_CRAWLED),
                                    (fx.NEVER_CRAWLED, "s1.example.com")], ["yours", "competitor"])}),
pairs AS (SELECT DISTINCT regexp_replace(lower(trim(yours)), '\\.+$', '') AS yours,
                          regexp_replace(lower(trim(competitor)), '\\.+$', '') AS competitor FROM pairs_raw),
resolved AS (
  SELECT p.yours, p.competitor, ly.release AS yours_release, lc.release AS competitor_release
  FROM pairs p JOIN latest ly ON ly.target = p.yours JOIN latest lc ON lc.target = p.competitor),
own AS (SELECT DISTINCT r.yours, r.competitor, b.linking_domain FROM resolved r
  JOIN backlinks b ON b.target = r.yours AND b.release = r.yours_release),
comp AS (SELECT r.yours, r.competitor, b.linking_domain, b.num_hosts, b.page_rank FROM resolved r
  JOIN backlinks b ON b.target = r.competitor AND b.release = r.competitor_release)"""
CTE["usage_log"] = """payment_bodies AS (
  SELECT o_orderkey, o_orderdate, o_orderstatus,
         CASE WHEN o_custkey % 10 = 0 THEN '{"payload": {}}'
              WHEN o_orderpriority = '1-URGENT' THEN '{"payload": {"authorization": {"from": ""}}}'
              ELSE '{"payload": {"authorization": {"from": "0xAB' || CAST(o_custkey % 7 AS VARCHAR) || 'CD"}}}'
         END AS body FROM orders),
usage_log AS (
  SELECT o_orderkey AS event_id, o_orderdate AS ts,
         nullif(lower(json_extract_string(body, '$.payload.authorization.from')), '') AS payer,
         o_orderstatus <> 'P' AS charged, o_orderstatus FROM payment_bodies),
charged AS (SELECT event_id, ts, payer, strftime(ts, '%Y-%m') AS month FROM usage_log WHERE charged)"""
CTE["lookups"] = f"""lookups AS (
  SELECT initcap_seg AS first_name, c_name AS last_name, 'n' || CAST(c_nationkey AS VARCHAR) || '.example.com' AS domain,
         email, CASE WHEN email <> '' THEN 'high' ELSE '' END AS confidence,
         CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN '' ELSE 'VP' END AS title,
         CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'HOUSEHOLD') THEN '' ELSE 'Acme' END AS company,
         {_ts(fx.LOOKUP_BASE)} + to_seconds(c_custkey) AS created_at
  FROM (SELECT *, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS initcap_seg,
               CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'c' || CAST(c_custkey AS VARCHAR) || '@example.com'
                    ELSE '' END AS email
        FROM customer WHERE c_acctbal >= 0)
  UNION ALL
  SELECT lower(c_mktsegment), upper(c_name), 'N' || CAST(c_nationkey AS VARCHAR) || '.example.com',
         'dup' || CAST(c_custkey AS VARCHAR) || '@example.com', 'low', 'CEO', 'Other',
         {_ts(fx.LOOKUP_BASE)} + to_seconds(c_custkey) + to_days(1)
  FROM customer WHERE c_acctbal >= 0 AND c_nationkey = 0),
contacts AS (SELECT lower(c_mktsegment) AS first_name, upper(c_name) AS last_name,
                    'N' || CAST(c_nationkey AS VARCHAR) || '.Example.com' AS domain FROM customer)"""
CTE["responses"] = """responses AS (
  SELECT lower(c_mktsegment) AS first_name, c_name AS last_name,
         'n' || CAST(c_nationkey AS VARCHAR) || '.example.com' AS domain,
         CASE WHEN c_acctbal < 0 THEN 503 WHEN c_custkey % 31 <> 0 THEN 200 END AS status_code,
         CASE WHEN c_custkey % 11 = 0 THEN '<html>busy</html>'
           WHEN c_custkey % 11 = 1 THEN '["person"]'
           WHEN c_custkey % 11 = 2 THEN '{"person": ""}'
           WHEN c_custkey % 11 = 3 THEN '{"person": {"email": null, "email_status": null, "first_name": null, "title": null}}'
           ELSE CASE c_mktsegment
           WHEN 'AUTOMOBILE' THEN '{"person": null}'
           WHEN 'BUILDING' THEN '{"person": {"email": "c' || CAST(c_custkey AS VARCHAR)
                || '@example.com", "email_status": "verified", "first_name": "First' || CAST(c_custkey AS VARCHAR)
                || '", "last_name": "Last' || CAST(c_custkey AS VARCHAR)
                || '", "title": "CTO", "organization": {"name": "Org' || CAST(c_custkey AS VARCHAR) || '"}}}'
           WHEN 'FURNITURE' THEN '{"person": {"email": "f' || CAST(c_custkey AS VARCHAR)
                || '@example.com", "email_status": "guessed", "title": "Dev", "organization": {}}}'
           WHEN 'HOUSEHOLD' THEN '{"person": {"title": "VP", "organization": {"name": "Acme"}}}'
           ELSE '{"person": {"email": "m' || CAST(c_custkey AS VARCHAR) || '@example.com"}}'
         END END AS body FROM customer),
parsed AS (
  SELECT first_name, last_name, domain, status_code, kind,
         CASE WHEN kind = 'match' THEN coalesce(json_extract_string(body, '$.person.email'), '') END AS m_email,
         CASE WHEN kind = 'match' THEN
           CASE WHEN json_extract_string(body, '$.person.email_status') = 'verified' THEN 'high'
                WHEN json_exists(body, '$.person.email_status') THEN json_extract_string(body, '$.person.email_status')
                ELSE 'unknown' END END AS m_confidence,
         CASE WHEN kind = 'match' THEN CASE WHEN json_exists(body, '$.person.first_name')
           THEN json_extract_string(body, '$.person.first_name') ELSE first_name END END AS m_first_name,
         CASE WHEN kind = 'match' THEN CASE WHEN json_exists(body, '$.person.last_name')
           THEN json_extract_string(body, '$.person.last_name') ELSE last_name END END AS m_last_name,
         CASE WHEN kind = 'match' THEN CASE WHEN json_exists(body, '$.person.title')
           THEN json_extract_string(body, '$.person.title') ELSE '' END END AS m_title,
         CASE WHEN kind = 'match' THEN coalesce(json_extract_string(body, '$.person.organization.name'), '') END
           AS m_company
  FROM (SELECT first_name, last_name, domain, status_code, kind, CASE WHEN kind = 'match' THEN js END AS body FROM (
          SELECT *, CASE WHEN status_code IS NULL OR status_code <> 200 OR js IS NULL OR json_type(js) <> 'OBJECT' THEN 'error'
                         WHEN json_extract(js, '$.person') IS NULL
                              OR CAST(json_extract(js, '$.person') AS VARCHAR) IN ('null', '{}', '[]', 'false', '0', '""')
                           THEN 'no_match'
                         ELSE 'match' END AS kind
          FROM (SELECT *, CASE WHEN json_valid(body) THEN body END AS js FROM responses))))"""


def _with(*names: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names) + "\n"


STORE = ("vertices", "edges", "early_edges", "targets1", "targets2", "crawl1", "crawl2", "store")
RANKS = ("rank_rows", "rank_total", "ranks", "majestic", "tranco")


def _literal_rank_rows() -> str:
    # The literal dump lines that survive F9 (see fixtures.RANK_LITERAL_LINES).
    return _values([("extra-field.com", 11, 1.25, 4, 0.5, 6), ("spaces.com", 13, 2.5, 4, 0.25, 5),
                    ("bbc.co.uk", 15, 3.5, 6, 0.75, 8)],
                   ["domain", "harmonic_rank", "harmonic_val", "pr_rank", "pr_val", "n_hosts"])


def _ranked_dump() -> str:
    """Rows of the rank dump after F9, top-N, DR and last-write-wins (the parse_ranks result)."""
    return f"""dump_rows AS (
  SELECT domain, harmonic_rank, harmonic_val, pr_rank, pr_val, n_hosts FROM rank_rows
  UNION ALL
  SELECT 's' || CAST(s_suppkey AS VARCHAR) || '.example.com', s_suppkey * 2 + 3, s_acctbal, s_suppkey + 2,
         s_acctbal / 1e6, CAST(s_nationkey + 100 AS BIGINT) FROM supplier
  UNION ALL
  SELECT domain, CAST(harmonic_rank AS BIGINT), CAST(harmonic_val AS DOUBLE), CAST(pr_rank AS BIGINT),
         CAST(pr_val AS DOUBLE), CAST(n_hosts AS BIGINT) FROM {_literal_rank_rows()}),
dump_ranked AS (
  SELECT d.*, {_dr('d.harmonic_rank', 't.n')} AS dr_score, {_ts(fx.RANKS_AT)} AS fetched_at,
         row_number() OVER (PARTITION BY d.domain ORDER BY d.harmonic_rank DESC, d.harmonic_val DESC,
                            d.pr_rank DESC, d.pr_val DESC, d.n_hosts DESC) AS rn
  FROM dump_rows d, rank_total t WHERE d.harmonic_rank <= t.n)"""


def _url_sql() -> str:
    host = ("regexp_replace(regexp_replace(lower(regexp_replace(url, '^\\s+|\\s+$', '', 'g')), '^https?://', ''), "
            "'/.*$', '')")
    return host


def build() -> dict[str, str]:
    sql: dict[str, str] = {}
    host = _url_sql()
    loose = "regexp_replace(lower(regexp_replace(h, '^\\s+|\\s+$', '', 'g')), '\\.+$', '')"
    sql["normalize_domains"] = f"""
WITH urls AS (SELECT page_id, url FROM pages
              UNION ALL SELECT * FROM {_values(cat.URL_LITERALS, ['page_id', 'url'])}),
hosts AS (SELECT page_id, url, {host} AS h FROM urls)
SELECT page_id, url, h AS host,
       CASE WHEN length({loose}) > 253 THEN NULL
            WHEN regexp_matches({loose}, '^[a-zA-Z0-9]([a-zA-Z0-9\\-]*[a-zA-Z0-9])?(\\.[a-zA-Z0-9]([a-zA-Z0-9\\-]*[a-zA-Z0-9])?)*$')
            THEN {loose} END AS valid_host,
       {loose} AS loose_host
FROM hosts"""
    sql["rejected_targets"] = f"""
WITH typed AS (
  SELECT 'S' || CAST(s_suppkey AS VARCHAR) || '.Example.COM.' AS target FROM supplier
  UNION ALL SELECT {_q(fx.UNKNOWN_TARGET)} UNION ALL SELECT {_q(fx.INVALID_TARGET)} UNION ALL SELECT url FROM pages),
norm AS (SELECT target, regexp_replace(lower(regexp_replace(target, '^\\s+|\\s+$', '', 'g')), '\\.+$', '') AS t FROM typed)
SELECT target FROM norm WHERE t IS NULL OR length(t) > 253
  OR NOT regexp_matches(t, '^[a-zA-Z0-9]([a-zA-Z0-9\\-]*[a-zA-Z0-9])?(\\.[a-zA-Z0-9]([a-zA-Z0-9\\-]*[a-zA-Z0-9])?)*$')"""
    sql["reverse_domains"] = _with("vertices") + f"""
SELECT id, rev_domain, {_rev('rev_domain')} AS domain FROM (
  SELECT id, rev_domain FROM vertices
  UNION ALL SELECT * FROM {_values(cat.REVERSE_LITERALS, ['id', 'rev_domain'])})"""
    sql["scores"] = _with("rank_rows", "rank_total") + f"""
SELECT r.domain, r.harmonic_rank, r.n_hosts, {_dr('r.harmonic_rank', 't.n')} AS dr_score,
       {_auth('r.n_hosts')} AS authority_score,
       CASE WHEN r.n_hosts IS NOT NULL AND r.n_hosts <> 0 THEN {_auth('r.n_hosts')} END AS authority_or_null
FROM (SELECT domain, harmonic_rank, n_hosts FROM rank_rows
      UNION ALL SELECT domain, CAST(harmonic_rank AS BIGINT), CAST(n_hosts AS BIGINT)
      FROM {_values(cat.SCORE_LITERALS, ['domain', 'harmonic_rank', 'n_hosts'])}) r, rank_total t"""
    sql["parse_ranks"] = _with("rank_rows", "rank_total") + "," + _ranked_dump() + """
SELECT domain, harmonic_rank, harmonic_val, pr_rank, pr_val, n_hosts, dr_score, fetched_at
FROM dump_ranked WHERE rn = 1"""
    sql["scan_vertices_text"] = _with("vertices") + f"""
SELECT id, rev_domain, num_hosts FROM vertices
UNION ALL SELECT CAST(id AS BIGINT), rev_domain, CAST(num_hosts AS BIGINT)
FROM {_values([(3, None, 4), (None, 'com.noid', 5), (8, 'com.space', 9)], ['id', 'rev_domain', 'num_hosts'])}"""
    sql["scan_edges_text"] = _with("edges") + f"""
SELECT from_id, to_id FROM edges
UNION ALL SELECT CAST(from_id AS BIGINT), CAST(to_id AS BIGINT)
FROM {_values([(4, None), (5, 6)], ['from_id', 'to_id'])}"""
    sql["bucketed_edges"] = _with("edges") + f""",
dumped AS (SELECT from_id, to_id FROM edges UNION ALL SELECT 4, NULL UNION ALL SELECT 5, 6)   -- malformed-looking lines that parse
SELECT CAST(to_id % {fx.BUCKETS} AS INTEGER) AS bucket, count(*) AS n_edges, count(DISTINCT to_id) AS n_targets,
       min(to_id) AS min_to_id, max(to_id) AS max_to_id
FROM dumped GROUP BY 1"""
    dumped = _with("edges") + ",\ndumped AS (SELECT from_id, to_id FROM edges UNION ALL SELECT 4, NULL UNION ALL SELECT 5, 6)"
    stored = "SELECT CAST(to_id % {n} AS INTEGER) AS bucket, from_id, to_id FROM dumped"
    sql["stored_vertices"] = sql["scan_vertices_text"]
    sql["stored_edges"] = dumped + stored.format(n=fx.BUCKETS)
    sql["bucket_slice"] = (dumped + stored.format(n=fx.BUCKETS)
                           + f" WHERE to_id % {fx.BUCKETS} >= {cat.SLICE[0]} AND to_id % {fx.BUCKETS} < {cat.SLICE[1]}")
    sql["resume_edges"] = dumped + stored.format(n=cat.RESUME_BUCKETS)
    sql["store_status_checked"] = dumped + f"""
SELECT 'here' AS store, true AS available, count(DISTINCT to_id % {fx.BUCKETS}) AS edge_bucket_count, true AS files_ok,
       true AS has_vertices, true AS has_edges, true AS has_time FROM dumped
UNION ALL SELECT 'nowhere', false, 0, true, NULL, NULL, NULL"""
    sql["inbound"] = _with("vertices", "edges", "targets1") + f"""
SELECT *, row_number() OVER (PARTITION BY target ORDER BY num_hosts DESC, linking_domain ASC) AS pos FROM (
SELECT t.target, {_rev('v.rev_domain')} AS linking_domain, max(v.num_hosts) AS num_hosts
FROM targets1 t JOIN vertices tv ON tv.rev_domain = {_rev('t.target')}
JOIN edges e ON e.to_id = tv.id JOIN vertices v ON v.id = e.from_id
GROUP BY t.target, linking_domain)"""
    sql["inbound_bucketed"] = _with("vertices", "edges", "targets1") + f""",
dumped_edges AS (SELECT from_id, to_id FROM edges UNION ALL SELECT 5, 6),
dumped_vertices AS (SELECT id, rev_domain, num_hosts FROM vertices UNION ALL SELECT 8, 'com.space', 9)
SELECT *, row_number() OVER (PARTITION BY target ORDER BY num_hosts DESC, linking_domain ASC) AS pos FROM (
SELECT t.target, {_rev('v.rev_domain')} AS linking_domain, max(v.num_hosts) AS num_hosts
FROM targets1 t JOIN dumped_vertices tv ON tv.rev_domain = {_rev('t.target')}
JOIN dumped_edges e ON e.to_id = tv.id JOIN dumped_vertices v ON v.id = e.from_id
GROUP BY t.target, linking_domain)"""
    sql["inbound_raw"] = _with("vertices", "edges", "targets1") + f""",
-- the dumps also hold malformed lines; of those, edge (5, 6) and vertices (3, NULL, 4),
-- (NULL, 'com.noid', 5) and (8, 'com.space', 9) parse
dumped_edges AS (SELECT from_id, to_id FROM edges UNION ALL SELECT 5, 6),
dumped_vertices AS (SELECT * FROM vertices UNION ALL
                    SELECT * FROM (VALUES (3, NULL, 4), (NULL, 'com.noid', 5), (8, 'com.space', 9)) AS x(id, rev_domain, num_hosts))
SELECT t.target, {_rev('v.rev_domain')} AS linking_domain, max(v.num_hosts) AS num_hosts
FROM targets1 t JOIN dumped_vertices tv ON tv.rev_domain = {_rev('t.target')}
JOIN dumped_edges e ON e.to_id = tv.id JOIN dumped_vertices v ON v.id = e.from_id
GROUP BY t.target, linking_domain"""
    sql["crawl_store"] = _with(*STORE) + "SELECT * FROM crawls"
    sql["backlinks"] = _with(*STORE, *RANKS, "latest", "latest_links", "report") + """
SELECT *, row_number() OVER (PARTITION BY target ORDER BY dr_score DESC NULLS LAST, num_hosts DESC,
                             linking_domain ASC) AS pos
FROM report"""
    sql["backlinks_on_demand"] = _with(*STORE, *RANKS) + f""",
targets_m AS (SELECT target FROM targets1 WHERE target NOT IN (SELECT target FROM c_2)),
{_crawl('m', 'targets_m', 'edges', fx.REL3, fx.STREAM_AT)},
od_crawls AS (SELECT * FROM c_2 UNION ALL SELECT * FROM c_m),
od_links AS (SELECT * FROM bl_2 UNION ALL SELECT * FROM bl_m),
od_latest AS (
  SELECT target, release, crawled_at FROM (
    SELECT *, row_number() OVER (PARTITION BY target ORDER BY crawled_at DESC, release DESC,
                                 result_count DESC) AS rn FROM od_crawls) WHERE rn = 1)
SELECT b.target, b.release, l.crawled_at, b.linking_domain, b.num_hosts, r.dr_score, r.harmonic_rank,
       r.pr_val AS pagerank, {_auth('b.num_hosts')} AS authority_score, m.global_rank AS majestic_rank,
       m.ref_subnets, m.ref_ips, t.tranco_rank
FROM od_latest l JOIN od_links b ON b.target = l.target AND b.release = l.release
LEFT JOIN ranks r ON r.domain = b.linking_domain
LEFT JOIN majestic m ON m.domain = b.linking_domain LEFT JOIN tranco t ON t.domain = b.linking_domain"""
    sql["bundle_rows"] = _with(*STORE, *RANKS, "latest", "latest_links", "report") + """
SELECT p.*, r.dr_score AS target_dr_score, r.harmonic_rank AS target_harmonic_rank, r.pr_val AS target_pagerank,
       r.n_hosts AS target_n_hosts
FROM report p LEFT JOIN ranks r ON r.domain = p.target"""
    sql["backlinks_nested_flat"] = _with(*STORE, *RANKS, "latest", "latest_links", "report") + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY dr_score DESC NULLS LAST, num_hosts DESC,
                                        linking_domain ASC) AS pos FROM report)
SELECT target, count(*) OVER (PARTITION BY target) AS backlink_count, CAST((pos - 1) // 200 AS INTEGER) AS page,
       CAST((pos - 1) % 200 AS INTEGER) AS slot, pos, linking_domain, num_hosts, dr_score, tranco_rank
FROM placed"""
    sql["bundle"] = _with(*STORE, *RANKS, "latest") + """
SELECT l.target, l.release, l.crawled_at, l.result_count AS backlink_count, r.dr_score AS target_dr_score,
       r.harmonic_rank AS target_harmonic_rank, r.pr_val AS target_pagerank, r.n_hosts AS target_n_hosts
FROM latest l LEFT JOIN ranks r ON r.domain = l.target WHERE l.result_count > 0"""
    excl = ", ".join(_q(x) for x in PREVIEW_EXCLUDE)
    sql["preview"] = _with(*STORE, *RANKS, "latest", "latest_links") + f""",
linked AS (SELECT b.target, b.linking_domain, b.num_hosts, r.dr_score FROM latest_links b
           LEFT JOIN ranks r ON r.domain = b.linking_domain),
pooled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY dr_score DESC NULLS LAST,
             num_hosts DESC, linking_domain ASC) AS rn FROM linked) WHERE rn <= 50),
shown AS (SELECT *, {_auth('num_hosts')} AS authority_score FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY dr_score DESC NULLS LAST,
             num_hosts DESC, linking_domain ASC) AS pos FROM pooled
             WHERE linking_domain NOT IN ({excl})
               AND linking_domain NOT IN (SELECT 'p' || CAST(p_partkey AS VARCHAR) || '.example.org'
                                          FROM part WHERE p_size <= 10)) WHERE pos <= 5),
showing AS (SELECT target, count(*) AS showing FROM shown GROUP BY target)
SELECT l.target AS domain, r.dr_score AS target_dr_score, r.harmonic_rank AS target_harmonic_rank,
       l.result_count AS total_backlinks, coalesce(s.showing, 0) AS showing,
       CAST(sh.pos AS INTEGER) AS pos, sh.linking_domain, sh.num_hosts, sh.dr_score,
       sh.authority_score
FROM latest l LEFT JOIN ranks r ON r.domain = l.target LEFT JOIN showing s ON s.target = l.target
LEFT JOIN shown sh ON sh.target = l.target"""
    gap_base = _with(*STORE, "majestic", "tranco", "latest", "pairs")
    sql["gap"] = gap_base + f"""
SELECT *, row_number() OVER (PARTITION BY yours, competitor ORDER BY coalesce(num_hosts, 0) DESC, domain ASC) AS pos
FROM (
SELECT c.yours, c.competitor, c.linking_domain AS domain, c.num_hosts,
       CASE WHEN c.num_hosts IS NOT NULL AND c.num_hosts <> 0 THEN {_auth('c.num_hosts')} END AS authority_score,
       c.page_rank, m.global_rank AS majestic_rank, t.tranco_rank
FROM comp c LEFT JOIN majestic m ON m.domain = c.linking_domain LEFT JOIN tranco t ON t.domain = c.linking_domain
WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.yours = c.yours AND o.competitor = c.competitor
                  AND o.linking_domain = c.linking_domain))"""
    sql["gap_summary"] = gap_base + """,
cset AS (SELECT DISTINCT yours, competitor, linking_domain FROM comp)
SELECT r.yours, r.competitor,
  (SELECT count(*) FROM own o WHERE o.yours = r.yours AND o.competitor = r.competitor) AS your_backlinks,
  (SELECT count(*) FROM cset c WHERE c.yours = r.yours AND c.competitor = r.competitor) AS competitor_backlinks,
  (SELECT count(*) FROM cset c WHERE c.yours = r.yours AND c.competitor = r.competitor
     AND NOT EXISTS (SELECT 1 FROM own o WHERE o.yours = c.yours AND o.competitor = c.competitor
                     AND o.linking_domain = c.linking_domain)) AS gap_count
FROM (SELECT DISTINCT yours, competitor FROM resolved) r"""
    sql["gap_missing"] = gap_base + """
SELECT p.yours, p.competitor,
       CASE WHEN p.yours NOT IN (SELECT target FROM crawls) THEN 'yours' ELSE 'competitor' END AS missing
FROM pairs p
WHERE p.yours NOT IN (SELECT target FROM crawls) OR p.competitor NOT IN (SELECT target FROM crawls)"""
    sql["latest_crawl"] = _with(*STORE, "latest") + "SELECT * FROM latest"
    sql["list_domains"] = _with(*STORE) + """
SELECT target AS domain, release, crawled_at, result_count AS backlink_count,
       (SELECT count(*) FROM crawls) AS total
FROM crawls"""
    sql["list_domains_ordered"] = _with(*STORE) + """
SELECT target AS domain, release, crawled_at, result_count AS backlink_count, (SELECT count(*) FROM crawls) AS total,
       row_number() OVER (ORDER BY crawled_at DESC, target, release) AS pos
FROM crawls"""
    upsert = _with(*STORE, "targets3", "crawl3")
    sql["upsert_crawls"] = upsert + """
SELECT * FROM crawls c WHERE NOT EXISTS (SELECT 1 FROM c_3 n WHERE n.target = c.target AND n.release = c.release)
UNION ALL SELECT * FROM c_3"""
    sql["upsert_backlinks"] = upsert + """
SELECT * FROM backlinks b WHERE NOT EXISTS (SELECT 1 FROM c_3 n WHERE n.target = b.target AND n.release = b.release)
UNION ALL SELECT * FROM bl_3"""
    sql["merge_seed"] = _with(*STORE) + """
SELECT * FROM c_2 UNION ALL
SELECT * FROM c_1 s WHERE s.target NOT IN (SELECT target FROM c_2)"""
    sql["merge_seed_backlinks"] = _with(*STORE) + """
SELECT * FROM bl_2 UNION ALL
SELECT * FROM bl_1 s WHERE s.target NOT IN (SELECT target FROM c_2)"""
    sql["key_violations"] = _with(*STORE, "targets3", "crawl3", "rank_rows") + f""",
kc AS (SELECT target, release, count(*) AS n FROM (SELECT * FROM crawls UNION ALL SELECT * FROM c_3)
       GROUP BY ALL HAVING count(*) > 1),
kb AS (SELECT target, release, linking_domain, count(*) AS n FROM (SELECT * FROM backlinks UNION ALL SELECT * FROM bl_3)
       GROUP BY ALL HAVING count(*) > 1),
kr AS (SELECT domain, count(*) AS n FROM (
         SELECT domain FROM rank_rows
         UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR) || '.example.com' FROM supplier
         UNION ALL SELECT domain FROM {_literal_rank_rows()}) GROUP BY ALL HAVING count(*) > 1)
SELECT 'crawls' AS table_name, target || '|' || release AS key, n AS n_rows FROM kc
UNION ALL SELECT 'backlinks', target || '|' || release || '|' || linking_domain, n FROM kb
UNION ALL SELECT 'rank_lines', domain, n FROM kr"""
    first_lookup = """first_lookup AS (
  SELECT * FROM (SELECT lower(first_name) AS k_first, lower(last_name) AS k_last, lower(domain) AS k_domain,
                        email, confidence, title, company,
                        row_number() OVER (PARTITION BY lower(first_name), lower(last_name), lower(domain)
                                           ORDER BY created_at, email, confidence, title, company) AS rn
                 FROM lookups) WHERE rn = 1)"""
    sql["enrich_contacts"] = _with("lookups") + "," + first_lookup + """,
j AS (SELECT c.*, f.k_first IS NOT NULL AS cached, f.email AS c_email, f.confidence AS c_confidence,
             f.title AS c_title, f.company AS c_company,
             CASE WHEN f.k_first IS NULL THEN 'miss'
                  WHEN coalesce(length(f.email) > 0, false) THEN 'hit'
                  WHEN coalesce(length(f.company) > 0, false) OR coalesce(length(f.title) > 0, false)
                    THEN 'person_without_email'
                  ELSE 'no_match' END AS outcome
      FROM contacts c LEFT JOIN first_lookup f ON f.k_first = lower(c.first_name)
        AND f.k_last = lower(c.last_name) AND f.k_domain = lower(c.domain))
SELECT first_name, last_name, domain, outcome,
       CASE WHEN outcome = 'hit' THEN c_email END AS email,
       outcome = 'hit' AS email_found,
       CASE WHEN outcome = 'hit' THEN c_confidence WHEN outcome = 'person_without_email' THEN 'unavailable' END
         AS confidence,
       CASE WHEN outcome IN ('hit', 'person_without_email') THEN coalesce(c_title, '') END AS title,
       CASE WHEN outcome IN ('hit', 'person_without_email') THEN coalesce(c_company, '') END AS company,
       cached
FROM j"""
    sql["contacts_to_fetch"] = _with("lookups") + """
SELECT c.first_name, c.last_name, c.domain FROM contacts c
WHERE NOT EXISTS (SELECT 1 FROM lookups l WHERE lower(l.first_name) = lower(c.first_name)
                  AND lower(l.last_name) = lower(c.last_name) AND lower(l.domain) = lower(c.domain))"""
    sql["contact_cache"] = sql["enrich_contacts"]
    sql["contact_cache_to_fetch"] = sql["contacts_to_fetch"]
    sql["contact_cache_folded"] = _with("lookups") + """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(first_name), lower(last_name), lower(domain)
                               ORDER BY created_at, email, confidence, title, company) AS rn FROM lookups) WHERE rn = 1"""
    sql["match_responses"] = _with("responses") + "SELECT * FROM parsed"
    sql["match_answers"] = _with("responses") + """
SELECT nullif(m_email, '') AS email, m_email <> '' AS email_found,
       CASE WHEN m_email <> '' THEN m_confidence ELSE 'unavailable' END AS confidence,
       m_first_name AS first_name, m_last_name AS last_name, m_title AS title, m_company AS company, domain, false AS cached
FROM parsed WHERE kind = 'match'"""
    sql["lookup_rows"] = _with("responses") + f"""
SELECT first_name, last_name, domain,
       CASE WHEN kind = 'match' AND m_email <> '' THEN m_email ELSE '' END AS email,
       CASE WHEN kind = 'match' AND m_email <> '' THEN m_confidence ELSE '' END AS confidence,
       CASE WHEN kind = 'match' THEN m_title ELSE '' END AS title,
       CASE WHEN kind = 'match' THEN m_company ELSE '' END AS company,
       {_ts(fx.LOOKUP_BASE)} AS created_at
FROM parsed WHERE kind IN ('match', 'no_match')"""
    sql["confidence_labels"] = """
SELECT c_custkey,
       CASE WHEN s >= 0.8 THEN 'High' WHEN s >= 0.5 THEN 'Medium'
            WHEN s IS NOT NULL THEN 'Low' ELSE '' END AS label,   -- the score is text there, and any text is truthy
       CAST(floor(s * 100 + 0.5) AS BIGINT) AS pct
FROM (SELECT c_custkey, c_acctbal / 10000.0 AS s FROM customer)"""
    sql["payer_of"] = _with("usage_log") + """
SELECT o_orderkey, nullif(lower(json_extract_string(body, '$.payload.authorization.from')), '') AS payer
FROM payment_bodies"""
    sql["usage_by_month"] = _with("usage_log") + "SELECT month, count(*) AS usage_count FROM charged GROUP BY month"
    sql["usage_by_payer"] = _with("usage_log") + """
SELECT month, payer, count(*) AS usage_count FROM charged WHERE payer IS NOT NULL GROUP BY month, payer"""
    sql["usage_merge"] = _with("usage_log") + """
SELECT month, CAST(sum(usage_count) AS BIGINT) AS usage_count FROM (
  SELECT strftime(ts, '%Y-%m') AS month, count(*) AS usage_count FROM usage_log
  WHERE charged AND o_orderstatus = 'F' GROUP BY 1
  UNION ALL
  SELECT strftime(ts, '%Y-%m'), count(*) FROM usage_log WHERE charged AND o_orderstatus = 'O' GROUP BY 1)
GROUP BY month"""
    sql["usage_totals"] = _with("usage_log") + "SELECT month, payer, count(*) AS usage_count FROM charged GROUP BY month, payer"
    sql["admit"] = _with("usage_log") + f""",
payer_ok AS (
  SELECT event_id, ts, month, payer FROM (
    SELECT *, row_number() OVER (PARTITION BY month, payer ORDER BY ts, event_id) AS rn
    FROM charged WHERE payer IS NOT NULL) WHERE rn <= {fx.ADMIT_PER_PAYER}
  UNION ALL SELECT event_id, ts, month, payer FROM charged WHERE payer IS NULL)
SELECT event_id, ts, month, payer, CAST(month_pos AS INTEGER) AS month_pos FROM (
  SELECT *, row_number() OVER (PARTITION BY month ORDER BY ts, event_id) AS month_pos FROM payer_ok)
WHERE month_pos <= {fx.ADMIT_MONTHLY}"""
    sql["stream_usage"] = """
SELECT strftime(ts, '%Y-%m') AS month, 'u' || CAST(user_id AS VARCHAR) AS payer, count(DISTINCT event_id) AS usage_count
FROM events WHERE event_type = 'purchase' GROUP BY 1, 2"""
    sql["stream_usage_batches"] = sql["stream_usage"]
    sql["stream_ranks_batches"] = _with("rank_rows", "rank_total") + f""",
arrived AS (
  SELECT 0 AS epoch, * FROM rank_rows
  UNION ALL
  SELECT 1, domain, CASE WHEN pr_rank % 2 = 0 THEN 1 ELSE harmonic_rank + 1 END, harmonic_val, pr_rank, pr_val, n_hosts
  FROM rank_rows WHERE pr_rank % 3 = 0)
SELECT domain, harmonic_rank, harmonic_val, pr_rank, pr_val, n_hosts, dr_score, fetched_at FROM (
  SELECT a.*, {_dr('a.harmonic_rank', 't.n')} AS dr_score, {_ts(fx.RANKS_AT)} AS fetched_at,
         row_number() OVER (PARTITION BY a.domain ORDER BY a.epoch DESC) AS rn
  FROM arrived a, rank_total t WHERE a.harmonic_rank <= t.n) WHERE rn = 1"""
    epochs = _with("vertices", "edges", "early_edges") + f""",
targets_n AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) || '.example.com' AS target, s_suppkey % 5 IN (0, 4) AS early FROM supplier),
targets_e AS (SELECT target FROM targets_n WHERE early),
targets_w AS (SELECT target FROM targets_n WHERE NOT early),
{_crawl('e', 'targets_e', 'early_edges', fx.REL3, fx.STREAM_AT)},
{_crawl('w', 'targets_w', 'edges', fx.REL3, fx.STREAM_AT)}
"""
    sql["crawl_epochs"] = epochs + "SELECT * FROM c_e UNION ALL SELECT * FROM c_w"
    sql["crawl_epochs_backlinks"] = epochs + "SELECT * FROM bl_e UNION ALL SELECT * FROM bl_w"
    sql["ranks_replaced"] = _with("rank_rows", "rank_total", "ranks", "tranco") + """
SELECT 'before' AS seen, domain, dr_score FROM ranks
UNION ALL SELECT 'after', domain, dr_score + 1 FROM ranks WHERE n_hosts > 10
UNION ALL SELECT 'tranco', domain, CAST(tranco_rank AS INTEGER) FROM tranco"""
    literal = len(fx.RANK_LITERAL_LINES)
    sql["ingest_summary"] = _with("rank_rows", "rank_total") + f""",
lines AS (
  SELECT domain, harmonic_rank FROM rank_rows
  UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR) || '.example.com', s_suppkey * 2 + 3 FROM supplier
  UNION ALL SELECT domain, harmonic_rank FROM {_literal_rank_rows()}),
runs AS (SELECT 0 AS run, n AS most FROM rank_total UNION ALL SELECT 1, 100),
bad AS (SELECT {literal} - (SELECT count(*) FROM {_literal_rank_rows()}) AS n)
SELECT CAST(run AS BIGINT) AS run, {_ts(fx.RANKS_AT)} AS ingested_at, count(*) + any_value(bad.n) AS rows_read, any_value(bad.n) AS malformed,
       count(*) FILTER (harmonic_rank > most) AS over_limit,
       count(*) FILTER (harmonic_rank <= most) - count(DISTINCT domain) FILTER (harmonic_rank <= most) AS replaced,
       count(DISTINCT domain) FILTER (harmonic_rank <= most) AS kept
FROM lines, runs, bad GROUP BY run"""
    sql["stream_crawls"] = _with("vertices", "edges") + f""",
targets_s AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) || '.example.com' AS target FROM supplier),
{_crawl('s', 'targets_s', 'edges', fx.REL3, fx.STREAM_AT)}
SELECT * FROM c_s"""
    sql["stream_crawls_backlinks"] = sql["stream_crawls"].replace("SELECT * FROM c_s", "SELECT * FROM bl_s")
    sql["stream_ranks"] = sql["parse_ranks"]
    return sql


ORACLE_SQL = build()
