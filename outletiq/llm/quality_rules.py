"""Host-level quality rules, in DataFrame functions only.

Each document is measured on its own; rule failures are added up by host, each
host's failure rates are shrunk towards all hosts by an empirical beta prior,
and the host's verdict is joined back to its documents.

Array steps pass arrays as arguments of ``zip_with``, never as names inside a
lambda, so each array is evaluated once per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outletiq.llm.common import pick, save, words
from outletiq.llm.line_dedup import BLANKS

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A host fails a rule if its shrunken failure rate is over this.
HOST_RATE = 0.5


def rules() -> dict[str, Column]:
    """A document's failures: too short, repetitive, symbols for words, repeated lines, odd word lengths."""
    n = F.col("n_words")
    return {
        "short": n < MIN_WORDS,
        "repetition": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 10 * n),
    }


def _shift(c: str, n: int, by: int) -> Column:
    """The array without its first ``by`` elements, ``n`` minus ``by`` at least none."""
    return F.slice(c, by + 1, F.greatest(F.col("n_words") - n, F.lit(0)).cast("int"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words), no shuffle.

    A null text has no words. Windows of three words are compared by a 64-bit
    hash. The windows of a document are sorted, equal neighbours are repeats, and
    the words they cover are counted from the sorted window starts: a start adds
    three words, or the distance to the next start if that is less.
    """
    d = pick(docs, doc_id=id_col, host=host_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    d = d.select("doc_id", "host", "text", words(F.col("text")).alias("w"), lines.alias("lines"))
    d = d.select("doc_id", "host",
                 F.size("w").cast("long").alias("n_words"),
                 F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                 (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
                 F.size("lines").cast("long").alias("n_lines"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    keep = [c for c in d.columns if c != "h"]
    d = d.select(*keep, F.zip_with(F.zip_with(_shift("h", 2, 0), _shift("h", 2, 1), lambda a, b: F.xxhash64(a, b)),
                                   _shift("h", 2, 2), lambda a, b: F.xxhash64(a, b)).alias("g"))
    d = d.select(*keep, F.when(F.size(F.array_distinct("g")) < F.size("g"),  # most documents repeat nothing
                               F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s"))
    after = F.expr("slice(s, 2, size(s))")
    d = d.select(*keep, "s", F.zip_with("s", after, lambda a, b: F.coalesce(a["x"] == b["x"], F.lit(False))).alias("e"))
    before = F.concat(F.array(F.lit(False)), F.expr("slice(e, 1, size(e) - 1)"))
    d = d.select(*keep, "s", F.zip_with("e", before, lambda a, b: a | b).alias("r"))
    starts = F.filter(F.zip_with("s", "r", lambda a, r: F.when(r, a["i"])), lambda i: i.isNotNull())
    d = d.select(*keep, F.sort_array(starts).alias("p"))
    steps = F.zip_with("p", F.expr("slice(p, 2, size(p))"), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    covered = F.aggregate(steps, F.lit(0), lambda t, x: t + x)
    return d.select(*keep, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def host_verdicts(measured: DataFrame) -> DataFrame:
    """(host, docs, rate_<rule> ..., host_kept): shrunken failure rates and the verdict of every host.

    The prior of a rule is fitted by moments weighted by the hosts' documents
    (one row of sums, whatever the number of hosts). ``rho`` is the share of the variance between
    hosts that is more than chance: the spread of the rates that documents dealt to hosts at random would have
    is taken off, so many small hosts do not look like different ones. The prior's
    strength is (1 - rho) / rho documents; hosts that do not differ all get the mean rate.
    """
    names = list(rules())
    fails = [F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(f"fail_{r}") for r, c in rules().items()]
    hosts = save(measured.groupBy("host").agg(F.count("*").alias("docs"), *fails), "hosts")
    sums = hosts.agg(F.count("*").alias("hosts"), F.sum("docs").alias("docs"),
                     F.sum(F.col("docs").cast("double") * F.col("docs")).alias("squares"),
                     *[F.sum(f"fail_{r}").alias(f"f_{r}") for r in names],
                     *[F.sum(F.col(f"fail_{r}").cast("double") * F.col(f"fail_{r}") / F.col("docs")).alias(f"s_{r}")
                       for r in names]).first()
    n, apart = sums["docs"] or 0, sums["hosts"] - 1
    chance = n - sums["squares"] / n - apart if n else 0.0
    out = {}
    for r in names:
        f, own = sums[f"f_{r}"] or 0, F.col(f"fail_{r}") / F.col("docs")
        m = f / n if n else 0.0
        rho = ((sums[f"s_{r}"] - f * m) / (m * (1 - m)) - apart) / chance if 0 < f < n and chance > 0 else 0.0
        k = (1 - rho) / rho if 0 < rho < 1 else 0.0
        out[r] = F.lit(m) if rho <= 0 else own if rho >= 1 else (F.col(f"fail_{r}") + F.lit(m * k)) / (F.col("docs") + F.lit(k))
    shrunk = hosts.select("host", "docs", *[c.alias(f"rate_{r}") for r, c in out.items()])
    worst = F.greatest(*[F.col(f"rate_{r}") for r in names])
    return shrunk.withColumn("host_kept", worst <= HOST_RATE)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Every row's measures, ``base_failed``, its host's verdict ``host_kept``, and ``kept``.

    A null host is a host of its own; repeated rows count as often as they
    occur; an empty table gives none; other columns of the input are ignored.
    """
    measured = save(measure(docs, id_col, text_col, host_col), "measured")
    hosts = save(host_verdicts(measured), "verdicts").select(F.col("host").alias("h"), "host_kept")
    base = rules()["short"] | rules()["repetition"]
    return (measured.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
            .withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & F.col("host_kept")))
