"""Site-relative line dedup: a line on too large a share of its host's pages is boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletiq.llm.common import pick, save

#: Trimmed off a line before it is compared; a line of these alone is blank.
BLANKS = " \t\n\x0b\x0c\r"


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANKS)))


def boilerplate_lines(docs: DataFrame, ratio: float, min_pages: int, host_col: str = "source",
                      text_col: str = "text") -> DataFrame:
    """(host, lines): hashes of the lines on more than ``ratio`` of the host's pages, and on ``min_pages`` at least.

    Every row is a page, also where ids repeat, and counts once per line. Counts are partial sums, so neither a host
    nor a line with a third of all rows meets in one task before they are added
    up. A page has A distinct lines on average, so fewer than A / ratio lines of
    a host can pass: the array is small whatever the host's size. A null host is
    a host of its own; null texts count as pages without lines.
    """
    pages = pick(docs, host=host_col, text=text_col)
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    seen = (pages.select("host", F.explode(F.array_distinct(F.transform(lines, _key))).alias("line"))
            .groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages))
    seen = save(seen, "line-pages")
    totals = save(pages.groupBy("host").agg(F.count("*").alias("total")), "host-pages")
    t = totals.select(F.col("host").alias("t_host"), "total")
    common = seen.join(t, F.col("host").eqNullSafe(F.col("t_host"))).where(F.col("pages") > F.lit(ratio) * F.col("total"))
    return common.groupBy("host").agg(F.array_sort(F.collect_list("line")).alias("lines"))


def drop_boilerplate(docs: DataFrame, ratio: float = 0.05, min_pages: int = 5, host_col: str = "source",
                     text_col: str = "text") -> DataFrame:
    """``docs`` without boilerplate lines, all rows and columns kept, plus n_lines and n_dropped.

    Lines are separated by ``\\n`` and compared without surrounding white space;
    blank lines stay. A text that is all boilerplate becomes empty, a null text
    stays null with 0 lines. Columns of the input named n_lines or n_dropped are replaced.
    """
    table = save(boilerplate_lines(docs, ratio, min_pages, host_col, text_col), "boilerplate")
    table = table.select(F.col("host").alias("of_host"), "lines")
    # the whole row is one struct, so no column of it can clash with one that is added here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("every", F.split(F.col("row")[text_col], "\n"))
    joined = rows.join(table, F.col("row")[host_col].eqNullSafe(F.col("of_host")), "left")
    kept = F.filter("every", lambda x: ~F.array_contains(F.col("lines"), _key(x)))
    cut = joined.withColumn("kept", F.when(F.col("lines").isNull(), F.col("every")).otherwise(kept))
    none = F.col("every").isNull()
    n = F.when(none, 0).otherwise(F.size("every")).cast("long")
    dropped = F.when(none, 0).otherwise(F.size("every") - F.size("kept")).cast("long")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    out = [F.array_join("kept", "\n").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names]
    return cut.select(*out, n.alias("n_lines"), dropped.alias("n_dropped"))
