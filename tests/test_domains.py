"""Domain normalisation, validation, reversal, URL to domain."""
import itertools

import pytest
from pyspark.sql import functions as F

from linkweave.functions import loose_domain, reverse_domain, url_to_domain, valid_domain


def _one(spark, fn, value):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


def _all(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


LABELS = ["q", "7", "web", "a-z", "x--y", "0day", "n" * 63]
PADDING = ["", " ", "\n", "\t ", "\u00a0", "\x1f"]


def test_names_of_good_labels_pass_in_any_case_and_padding(spark):
    good = [".".join(pair) for pair in itertools.product(LABELS, LABELS)]
    typed = [left + name.upper() + dots + right for name, (left, right), dots in
             zip(good, itertools.cycle(itertools.product(PADDING, PADDING)), itertools.cycle(["", ".", ".."]))]
    assert _all(spark, valid_domain, typed) == good


@pytest.mark.parametrize("rule,labels", [
    ("hyphen at a label edge", ["-w", "w-", "-"]),
    ("empty label", [""]),
    ("character outside letters, digits and hyphen", ["w w", "w_w", "w:1", "w/1", "w?", "w@", "wü", "w\u0007", "w\nw"]),
])
def test_one_bad_label_anywhere_spoils_the_name(spark, rule, labels):
    names = [f"{bad}.mid.org" for bad in labels] + [f"first.{bad}.org" for bad in labels] + [f"first.mid.{bad}x{bad}" for bad in labels if bad]
    assert _all(spark, valid_domain, names) == [None] * len(names)


def test_empty_and_null_names(spark):
    assert _all(spark, valid_domain, [None, "", " ", ".", "..."]) == [None] * 5


def test_a_line_feed_before_the_last_dot_is_refused(spark):
    assert _one(spark, valid_domain, "q.web\n.") is None  # the end anchor is the end of the text


def test_lenient_points(spark):
    single, long_label = "intranet", "k" * 70 + ".org"  # neither a dot nor short labels are asked for
    assert _all(spark, valid_domain, [single, long_label]) == [single, long_label]


@pytest.mark.parametrize("n,ok", [(252, True), (253, True), (254, False)])
def test_total_length(spark, n, ok):
    tail = ".museum"
    dotted = ("b" * 31 + ".") * 7
    name = dotted + "c" * (n - len(dotted) - len(tail)) + tail
    assert len(name) == n
    assert _one(spark, valid_domain, name) == (name if ok else None)


def test_loose_domain_does_not_validate(spark):
    assert _one(spark, loose_domain, "  Has_Underscore.COM.. ") == "has_underscore.com"


@pytest.mark.parametrize("inp,expected", [
    ("com.facebook", "facebook.com"),
    ("uk.co.bbc", "bbc.co.uk"),
    ("com.xn--mnchen-3ya", "xn--mnchen-3ya.com"),
    ("a..b.", ".b..a"),
    ("", ""),
    ("com", "com"),
])
def test_reverse(spark, inp, expected):
    assert _one(spark, reverse_domain, inp) == expected


@pytest.mark.parametrize("inp,expected", [
    ("  HTTPS://Example.COM/path?q=1", "example.com"),
    ("http://a.b/c/d", "a.b"),
    ("example.com", "example.com"),
    ("ftp://x.com/a", "ftp:"),
    ("https://x.com", "x.com"),
])
def test_url_to_domain(spark, inp, expected):
    assert _one(spark, url_to_domain, inp) == expected
