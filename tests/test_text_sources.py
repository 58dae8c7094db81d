"""Text dumps and rank lines."""
import gzip
import os

import pytest

from linkweave.operators.ranks import ingest_ranks
from linkweave.sources.text import (parse_edge_lines, parse_rank_lines, parse_vertex_lines, read_edges,
                                    read_rank_lines, read_vertices)
from tests.conftest import rows


def _lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_vertex_lines_drop_bad_rows(spark):
    lines = _lines(spark, ["1\tcom.a\t3", "x\tcom.bad\t1", "2\tcom.short", "", "3\tcom.extra\t3\t4",
                           "4\t\t5", "\tcom.noid\t6", "7\tcom.float\t1.5", " 8 \tcom.space\t 9 ",
                           "99999999999999999999\tcom.overflow\t1", "1\tcom.x\t\t5", "\t1\tcom.x\t5"])
    out = parse_vertex_lines(lines)
    got = {(r.id, r.rev_domain, r.num_hosts) for r in out.collect()}
    assert got == {(1, "com.a", 3), (4, None, 5), (None, "com.noid", 6), (8, "com.space", 9)}
    # The same rows survive whatever columns are selected afterwards (the CSV reader's trap).
    assert out.select("id").count() == 4 and out.count() == 4


def test_edge_lines(spark):
    out = parse_edge_lines(_lines(spark, ["1\t2", "1", "1\t2\t3", "a\t2", "", "4\t", " 5 \t6", "7\t8.0", "1\t\t2", "\t1\t2", "1\t2\t"]))
    assert {(r.from_id, r.to_id) for r in out.collect()} == {(1, 2), (4, None), (5, 6)}


def test_strict_mode_raises(spark):
    with pytest.raises(Exception, match="malformed vertex line"):
        parse_vertex_lines(_lines(spark, ["1\tcom.a\t3", "oops"]), strict=True).collect()


def test_gzip_dump_is_read_and_spread(spark, tmp_dir):
    p = os.path.join(tmp_dir, "edges.txt.gz")
    with gzip.open(p, "wt") as fh:
        for i in range(1000):
            fh.write(f"{i}\t{i % 7}\n")
        fh.write("bad line\n")
    df = read_edges(spark, p)
    assert df.count() == 1000
    assert df.rdd.getNumPartitions() > 1
    vp = os.path.join(tmp_dir, "v.txt")
    with open(vp, "w") as fh:
        fh.write("1\tcom.a\t2\r\n2\tcom.b\t3\n")
    # '\r' stays on the last field (split on '\n' only) and is accepted as blank.
    assert {(r.id, r.num_hosts) for r in read_vertices(spark, vp).collect()} == {(1, 2), (2, 3)}


@pytest.mark.parametrize("line", ["#harmonicc_pos\tharmonicc_val", "", "\n", "1\t2.0\t3",
                                  "x\t1.0\t2\t0.1\tcom.a\t3", "1\tabc\t2\t0.1\tcom.a\t3",
                                  "1\t1.0d\t2\t0.1\tcom.a\t3", "1.5\t1.0\t2\t0.1\tcom.a\t3",
                                  "1\t1.0\t2\t0.1\tcom.a"])
def test_rank_line_dropped(spark, line):
    assert parse_rank_lines(_lines(spark, [line])).count() == 0


def test_rank_line_kept(spark):
    fields = (41, 7.5e6, 38, 0.0625, "museum.dune.www", 12)
    r = parse_rank_lines(_lines(spark, ["\t".join(map(str, fields))])).first()
    assert (r.harmonic_rank, r.harmonic_val, r.pr_rank, r.pr_val, r.n_hosts) == (*fields[:4], fields[5])
    assert r.domain == "www.dune.museum"


@pytest.mark.parametrize("line,expected", [
    (" 12 \t+2.5\t+3\t.5\tcom.a\t7\r", (12, 2.5, 3, 0.5, 7)),
    ("1_000\t1_0.5\t2\t1e3\tcom.a\t7", (1000, 10.5, 2, 1000.0, 7)),
    ("1\t2.\t3\t4E-2\tcom.a\t5\textra\tfields", (1, 2.0, 3, 0.04, 5)),
])
def test_rank_line_python_numbers(spark, line, expected):
    r = parse_rank_lines(_lines(spark, [line])).first()
    assert (r.harmonic_rank, r.harmonic_val, r.pr_rank, r.pr_val, r.n_hosts) == expected


def test_rank_line_special_floats(spark):
    r = parse_rank_lines(_lines(spark, ["1\tinf\t2\tNaN\tcom.a\t3"])).first()
    assert r.harmonic_val == float("inf") and r.pr_val != r.pr_val


def test_ingest_cuts_at_the_limit(spark, tmp_dir):
    n, limit = 30, 7
    p = os.path.join(tmp_dir, "scores.gz")
    with gzip.open(p, "wt") as fh:
        fh.write("#made up header\n")
        for rank in range(n, 0, -1):  # worst first: the cut does not rely on the order of the dump
            fh.write(f"{rank}\t{n / rank}\t{rank + 1}\t{1 / rank}\tcoop.site{rank}\t{rank * 2}\n")
    out = {r.domain: r for r in ingest_ranks(read_rank_lines(spark, p), limit=limit, total=n, as_of="2026-01-01 00:00:00").collect()}
    assert set(out) == {f"site{r}.coop" for r in range(1, limit + 1)}
    assert all(r.n_hosts == 2 * r.harmonic_rank for r in out.values())
    scores = [out[f"site{r}.coop"].dr_score for r in range(1, limit + 1)]
    assert scores[0] == 100 and scores == sorted(scores, reverse=True)


def test_ingest_last_write_wins_and_unsorted_input(spark):
    lines = _lines(spark, ["5\t1.0\t1\t0.1\tcom.dup\t1", "3\t1.0\t1\t0.1\tcom.other\t1",
                           "4\t1.0\t1\t0.1\tcom.dup\t2", "0\t1.0\t1\t0.1\tcom.zero\t1",
                           "9\t1.0\t1\t0.1\tcom.late\t1"])
    out = {r.domain: (r.harmonic_rank, r.n_hosts, r.dr_score) for r in ingest_ranks(lines, limit=5, total=100).collect()}
    assert out["dup.com"] == (5, 1, 65)       # the later (larger-rank) duplicate wins
    assert out["zero.com"][2] == 100          # rank <= 0 passes the limit and scores 100
    assert "late.com" not in out and "other.com" in out


def test_ingest_observed_count(spark, tmp_dir):
    from linkweave.operators.ranks import ingest_ranks_observed
    lines = _lines(spark, ["1\t1.0\t1\t0.1\tcom.a\t3", "2\t1.0\t1\t0.1\tcom.b\t3", "bad"])
    df, obs = ingest_ranks_observed(lines, limit=10, total=100)
    df.write.parquet(f"{tmp_dir}/ranks")
    assert obs.get["rows_kept"] == 2
