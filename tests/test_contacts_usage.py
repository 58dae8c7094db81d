"""Q6 contact cache, S7/K10 responses, Q7 usage and quota (W4 vs a sequential replay)."""
import datetime as dt
import random

from pyspark.sql import functions as F

from linkweave.functions import confidence_label, confidence_pct, payer_of
from linkweave.operators.contacts import contacts_to_fetch, enrich_contacts, lookup_rows
from linkweave.operators.usage import admit, usage_by_month, usage_by_payer, usage_merge
from linkweave.sources.responses import match_answers, parse_match_responses
from tests.conftest import rows

LOOKUP = "first_name string, last_name string, domain string, email string, confidence string, title string, company string, created_at timestamp"


def _lookups(spark, data):
    return spark.createDataFrame(data, LOOKUP).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def test_cache_outcomes(spark):
    t0 = dt.datetime(2026, 1, 1)
    later = t0 + dt.timedelta(days=3)
    lk = _lookups(spark, [
        ("Ines", "Vidal", "kelp.coop", "i.vidal@kelp.coop", "guessed", "Buyer", "Kelp Coop", t0),
        ("omar", "TANN", "Dune.Museum", "", "", "Archivist", "", t0),
        ("Omar", "Tann", "dune.museum", "omar@dune.museum", "high", "", "", later),
        ("Pia", "Lund", "fjord.id", "", "", "", "", t0)])
    contacts = spark.createDataFrame([("INES", "vidal", "KELP.coop"), ("Omar", "Tann", "DUNE.museum"),
                                      ("pia", "lund", "Fjord.ID"), ("Yusuf", "Ray", "kelp.coop")],
                                     "first_name string, last_name string, domain string")
    out = {r.first_name.lower(): r for r in enrich_contacts(contacts, lk).collect()}
    assert {k: (r.outcome, r.email, r.cached) for k, r in out.items()} == {
        "ines": ("hit", "i.vidal@kelp.coop", True), "omar": ("person_without_email", None, True),
        "pia": ("no_match", None, True), "yusuf": ("miss", None, False)}
    assert out["omar"].confidence == "unavailable" and out["omar"].title == "Archivist"   # the first row wins
    assert rows(contacts_to_fetch(contacts, lk), "first_name") == [("Yusuf",)]


def test_responses_and_negative_caching(spark):
    df = spark.createDataFrame([
        ("a", "b", "x.com", 200, '{"person": {"email": "a@x.com", "email_status": "verified", "title": "CTO", "organization": {"name": "X"}}}'),
        ("c", "d", "x.com", 200, '{"person": null}'),
        ("e", "f", "x.com", 503, "oops"),
        ("g", "h", "x.com", 200, '{"person": {"title": "VP"}}'),
        ("i", "j", "x.com", 200, '{"person": {"email": "i@x.com", "email_status": "guessed"}}'),
        ("k", "l", "x.com", 200, '{"other": 1}'),
    ], "first_name string, last_name string, domain string, status_code int, body string")
    p = parse_match_responses(df)
    kinds = {r.first_name: r.kind for r in p.collect()}
    assert kinds == {"a": "match", "c": "no_match", "e": "error", "g": "match", "i": "match", "k": "no_match"}
    saved = {r.first_name: (r.email, r.confidence, r.title, r.company) for r in lookup_rows(p, "2026-01-01 00:00:00").collect()}
    assert saved == {"a": ("a@x.com", "high", "CTO", "X"), "c": ("", "", "", ""), "g": ("", "", "VP", ""),
                     "i": ("i@x.com", "guessed", "", ""), "k": ("", "", "", "")}   # the transient error is not cached
    ans = {r.first_name: (r.email, r.email_found, r.confidence, r.cached) for r in match_answers(p).collect()}
    assert ans["g"] == (None, False, "unavailable", False) and ans["a"] == ("a@x.com", True, "high", False)


def test_answers_that_are_no_answer(spark):
    body = {"html": "<h1>busy</h1>", "list": '["person"]', "text": '"person"', "none": None, "cut": '{"person": {"em',
            "blank": '{"person": ""}', "zero": '{"person": 0}', "void": '{"person": {}}', "nulls": '{"person": {"email": null, "email_status": null, "title": null, "first_name": null}}'}
    df = spark.createDataFrame([(k, "z", "y.org", 200, v) for k, v in body.items()] + [("nostatus", "z", "y.org", None, '{"person": {"email": "e"}}')],
                               "first_name string, last_name string, domain string, status_code int, body string")
    p = {r.first_name: r for r in parse_match_responses(df).collect()}
    assert {k: r.kind for k, r in p.items()} == {
        "html": "error", "list": "error", "text": "error", "none": "error", "cut": "error", "nostatus": "error",
        "blank": "no_match", "zero": "no_match", "void": "no_match", "nulls": "match"}
    r = p["nulls"]
    assert (r.m_email, r.m_confidence, r.m_title, r.m_first_name, r.m_last_name) == ("", None, None, None, "z")
    assert rows(lookup_rows(parse_match_responses(df)), "first_name") == [("blank",), ("nulls",), ("void",), ("zero",)]


def test_confidence_label_and_pct(spark):
    df = spark.createDataFrame([("0.9",), ("0.5",), ("0.2",), ("0",), ("",), (None,), ("-0.1",), ("0.125",), ("high",), ("0.9d",)], "s string")
    out = [(r.l, r.p) for r in df.select(confidence_label(F.col("s")).alias("l"), confidence_pct(F.col("s")).alias("p")).collect()]
    assert out == [("High", 90), ("Medium", 50), ("Low", 20), ("Low", 0), ("", None), ("", None), ("Low", -10), ("Low", 13),
                   ("Low", None), ("Low", None)]
    numbers = spark.createDataFrame([(0.0,), (0.3,), (float("nan"),), (None,)], "s double")
    assert [r.l for r in numbers.select(confidence_label(F.col("s")).alias("l")).collect()] == ["", "Low", "", ""]


def test_payer_of(spark):
    df = spark.createDataFrame([('{"payload": {"authorization": {"from": "0xABC"}}}',), ('{"payload": {}}',),
                                ('{"payload": {"authorization": {"from": ""}}}',), ("not json",)], "b string")
    assert [r.p for r in df.select(payer_of(F.col("b")).alias("p")).collect()] == ["0xabc", None, None, None]


def _log(spark, n=400, seed=7):
    rnd = random.Random(seed)
    base = dt.datetime(2026, 1, 1)
    data = []
    for i in range(n):
        ts = base + dt.timedelta(hours=rnd.randrange(0, 24 * 70))
        payer = rnd.choice(["p1", "p2", "p3", None])
        data.append((i, ts, payer, rnd.random() < 0.8))
    df = spark.createDataFrame(data, "event_id long, ts timestamp, payer string, charged boolean") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return df, data


def _replay(data, monthly, per_payer):
    month, payer_month, admitted = {}, {}, set()
    for i, ts, payer, charged in sorted(data, key=lambda r: (r[1], r[0])):
        if not charged:
            continue
        m = ts.strftime("%Y-%m")
        if month.get(m, 0) >= monthly:
            continue
        if payer and payer_month.get((m, payer), 0) >= per_payer:
            continue
        admitted.add(i)
        month[m] = month.get(m, 0) + 1
        if payer:
            payer_month[(m, payer)] = payer_month.get((m, payer), 0) + 1
    return admitted


def test_admit_equals_sequential_replay(spark):
    df, data = _log(spark)
    for monthly, per_payer in [(50, 10), (30, 40), (1000, 1000), (5, 1)]:
        got = {r.event_id for r in admit(df, monthly, per_payer).collect()}
        assert got == _replay(data, monthly, per_payer), (monthly, per_payer)


def test_usage_counts_and_merge(spark):
    df, data = _log(spark, n=50)
    months = {}
    for _, ts, payer, charged in data:
        if charged:
            months[ts.strftime("%Y-%m")] = months.get(ts.strftime("%Y-%m"), 0) + 1
    assert {r.month: r.usage_count for r in usage_by_month(df).collect()} == months
    assert usage_by_payer(df).where(F.col("payer").isNull()).count() == 0
    merged = {r.month: r.usage_count for r in usage_merge(usage_by_month(df), usage_by_month(df), ["month"]).collect()}
    assert merged == {k: 2 * v for k, v in months.items()}
    # A4: an empty log counts nothing; three charged calls count three.
    empty = df.limit(0)
    assert usage_by_month(empty).count() == 0
    three = spark.createDataFrame([(i, dt.datetime(2026, 3, 1), None, True) for i in range(3)],
                                  "event_id long, ts timestamp, payer string, charged boolean") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert usage_by_month(three).first().usage_count == 3
