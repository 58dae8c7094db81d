"""Text sources: tab-separated graph dumps (S1, S2) and rank lines.

The CSV reader is not used on purpose: with DROPMALFORMED it only drops rows for
the columns a query reads, so the set of surviving rows would depend on column
pruning. Reading lines and validating every field in one projection gives the
same rows whatever the query selects afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.functions.domains import host_rev_to_domain

VERTEX_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("rev_domain", T.StringType()),
    T.StructField("num_hosts", T.LongType()),
])
EDGE_SCHEMA = T.StructType([
    T.StructField("from_id", T.LongType()),
    T.StructField("to_id", T.LongType()),
])
RANK_LINE_SCHEMA = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("harmonic_rank", T.LongType()),
    T.StructField("harmonic_val", T.DoubleType()),
    T.StructField("pr_rank", T.LongType()),
    T.StructField("pr_val", T.DoubleType()),
    T.StructField("n_hosts", T.LongType()),
])

# Line grammars. Each dump line is validated by one regex, then split once.
# Blanks around a number; a tab always ends a field, so it is not one of them.
_B = r"[ \x0b\f\r]*"
# DuckDB-style dump fields: empty (NULL) or an integer with optional blanks and sign.
_DUMP_INT = rf"(?:{_B}[+-]?\d+{_B})?"
_DUMP_STR = r"[^\t]*"
# Python int()/float() grammar: digit groups may be joined by single underscores.
_DP = r"\d(?:_?\d)*"
_PY_INT = rf"{_B}[+-]?{_DP}{_B}"
_PY_FLOAT = (rf"{_B}[+-]?(?:(?:{_DP}\.(?:{_DP})?|\.{_DP}|{_DP})(?:[eE][+-]?{_DP})?"
             r"|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])" + _B)
RANK_LINE_PATTERN = "^" + "\t".join([_PY_INT, _PY_FLOAT, _PY_INT, _PY_FLOAT, r"[^\t]*", _PY_INT]) + r"(?:\t[\s\S]*)?\z"
_BLANKS = " \t\n\r\f\u000b"
# Compressed formats that cannot be split (bz2 can).
COMPRESSED_SUFFIXES = (".gz", ".zst", ".deflate", ".lz4", ".snappy")


def read_text_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Lines of a text file/folder split on '\\n' only (as Python iterates a file).

    A single compressed file arrives as one partition, so it is spread out right
    after the scan to keep the parsing and everything after it parallel -- by a hash
    of the line, since a round-robin exchange would first sort the whole file in its one task.
    """
    df = spark.read.option("lineSep", "\n").text(path)
    if path.rstrip("/").endswith(COMPRESSED_SUFFIXES):
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(n, "value")
    elif partitions:
        df = df.repartition(partitions, "value")
    return df


def _num(field: Column, to: str, underscores: bool = False) -> Column:
    if underscores:
        field = F.regexp_replace(field, "_", "")
    return F.trim(field, F.lit(_BLANKS)).try_cast(to)


def _parse_dump(lines: DataFrame, kinds: list[tuple[str, str]], strict: bool, what: str) -> DataFrame:
    """One regex decides whether a line has the right field count and field syntax;
    the fields are then split out once. An integer that overflows 64 bits drops the line."""
    pattern = "^" + "\t".join(_DUMP_INT if k == "long" else _DUMP_STR for _, k in kinds) + r"\z"
    v = F.col("value")
    parts = F.split(v, "\t", -1)
    fits = v.rlike(pattern) & (F.size(parts) == len(kinds))
    if strict:
        guard = F.when(~fits, F.raise_error(F.concat(F.lit(f"malformed {what} line: "), v)))
        lines = lines.where(F.coalesce(guard.cast("boolean"), F.lit(True)))
    cols, overflow = [], []
    for i, (name, kind) in enumerate(kinds):
        field = F.get(parts, i)
        if kind == "long":
            cols.append(F.when(field != "", _num(field, "bigint")).alias(name))
            cols.append((field != "").alias(f"_set{i}"))
            overflow.append(F.col(name).isNotNull() | ~F.col(f"_set{i}"))
        else:
            cols.append(F.nullif(field, F.lit("")).alias(name))
    parsed = lines.where(fits).select(*cols)
    for ok in overflow:
        parsed = parsed.where(ok)
    return parsed.select(*[name for name, _ in kinds])


def parse_vertex_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """S1 on a DataFrame of lines (`value`): id, rev_domain, num_hosts; bad lines dropped.

    ``strict=True`` raises on the first malformed line instead (the slow path's behaviour).
    """
    return _parse_dump(lines, [("id", "long"), ("rev_domain", "string"), ("num_hosts", "long")],
                       strict, "vertex")


def parse_edge_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """S2 on a DataFrame of lines: from_id, to_id; bad lines dropped."""
    return _parse_dump(lines, [("from_id", "long"), ("to_id", "long")], strict, "edge")


def read_vertices(spark: SparkSession, path: str, strict: bool = False, partitions: int | None = None) -> DataFrame:
    """Headerless tab-separated vertex dump (plain or gzip)."""
    return parse_vertex_lines(read_text_lines(spark, path, partitions), strict)


def read_edges(spark: SparkSession, path: str, strict: bool = False, partitions: int | None = None) -> DataFrame:
    """Headerless tab-separated edge dump (plain or gzip)."""
    return parse_edge_lines(read_text_lines(spark, path, partitions), strict)


def read_rank_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """S3: the rank file as lines (`value`), gzip by suffix."""
    return read_text_lines(spark, path, partitions)


def parse_rank_lines(lines: DataFrame) -> DataFrame:
    """rank lines -> (domain, harmonic_rank, harmonic_val, pr_rank, pr_val, n_hosts).

    Blank and '#' lines, lines with fewer than six tab fields and lines with any
    field that Python's int()/float() would refuse are dropped; extra fields are
    ignored; the reversed host becomes a domain.
    """
    v = F.col("value")
    parts = F.split(v, "\t", -1)
    typed = lines.where(v.rlike(RANK_LINE_PATTERN)).select(
        host_rev_to_domain(F.get(parts, 4)).alias("domain"),
        _num(F.get(parts, 0), "bigint", True).alias("harmonic_rank"),
        _num(F.get(parts, 1), "double", True).alias("harmonic_val"),
        _num(F.get(parts, 2), "bigint", True).alias("pr_rank"),
        _num(F.get(parts, 3), "double", True).alias("pr_val"),
        _num(F.get(parts, 5), "bigint", True).alias("n_hosts"),
    )
    # Not dropna(): that would also drop NaN values, which Python's float() accepts.
    keep = F.lit(True)
    for c in ("harmonic_rank", "harmonic_val", "pr_rank", "pr_val", "n_hosts"):
        keep = keep & F.col(c).isNotNull()
    return typed.where(keep)
