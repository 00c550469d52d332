"""Site-relative line removal, in DataFrame functions only.

Pages are grouped by host; a line is boilerplate where it is on more than ``ratio`` of the
host's pages, copies of a text counted once. Pages per line are pre-aggregated before the shuffle, and a host has at most
(average distinct lines of a page) / ``ratio`` boilerplate lines, whatever its size. These are
gathered per host as hashes and joined to its pages, with hot hosts split by salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATIO, MIN_PAGES, SALTS = 0.05, 5, 64


def _hash(line: str) -> str:
    return f"xxhash64({line}, octet_length({line}))"


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = True) -> DataFrame:
    """(host, line_hash, n_pages, host_pages) of lines on more than ``ratio`` of a host's pages and on ``min_pages`` at least.

    Pages of a host with the same text are one page, or a page each if ``copies_once`` is false.
    """
    page = F.expr(_hash(f"coalesce({text}, '')")) if copies_once else F.lit(None)
    n = F.count_distinct("_page") if copies_once else F.count("*")
    pages = pages.select(host, text, page.alias("_page"))
    total = pages.groupBy(host).agg(n.alias("host_pages"))
    # A page counts once for a line.
    found = pages.select(host, "_page", F.explode(F.expr(f"array_distinct(transform(filter(split({text}, '\\n'), l -> l rlike '[^ \\t-\\r]'), l -> {_hash('l')}))")).alias("line_hash"))
    counts = found.groupBy(host, "line_hash").agg(n.alias("n_pages")).where(F.col("n_pages") >= min_pages)
    return counts.join(total, host).where(F.col("n_pages") > ratio * F.col("host_pages"))


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = True) -> DataFrame:
    """All columns of ``docs``; boilerplate lines are cut from the text.

    Adds ``_n_lines``, ``_n_removed``. Lines are split at \\n and joined by it; blank lines stay.
    A null host is one host of its own; null text stays null; every line of a page may go,
    which leaves an empty text. Hosts where no line reaches ``min_pages`` pages keep everything. Copies of
    a text in one host count as one page, so they can't make their own lines boilerplate; with ``copies_once`` false
    each counts. An empty table gives no rows.
    """
    names = docs.columns
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.coalesce(F.concat(F.lit("h"), F.col(f"`{host_col}`").cast("string")), F.lit("")).alias("_host"),
                       F.col(f"`{text_col}`").alias("_text"))
    bad = boilerplate(work, "_host", "_text", ratio, min_pages, copies_once).groupBy("_host").agg(F.collect_set("line_hash").alias("_bad"))
    salted = bad.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = work.withColumn("_salt", F.pmod(F.xxhash64("_text"), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_salt"], "left")
    lines = joined.withColumn("_l", F.split("_text", "\n"))
    kept = F.when(F.col("_bad").isNull(), F.col("_l")).otherwise(F.expr(f"filter(_l, l -> not array_contains(_bad, {_hash('l')}))"))
    out = lines.withColumn("_k", F.explode(F.array(F.struct(kept.alias("l"), F.size("_l").alias("n")))))
    fields = [F.array_join("_k.l", "\n").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in names]
    return out.select(*fields, F.greatest(F.coalesce(F.col("_k.n"), F.lit(0)), F.lit(0)).cast("long").alias("_n_lines"),
                      F.greatest(F.coalesce(F.col("_k.n") - F.size("_k.l"), F.lit(0)), F.lit(0)).cast("long").alias("_n_removed"))


def line_report(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 of every document. As in SQL_OP9, every document is a page, copies too."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    return drop_boilerplate(d, "doc_id", "host", "text", ratio, min_pages, copies_once=False).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
