"""Cross-site line dedup by the spread of each line over distinct sites. DataFrame functions only.

Every line is a hash. A HyperLogLog sketch of the sites of each line hash merges by partial aggregation, so a line that
half of the corpus has costs no more than any other. Lines whose estimate is near the threshold get an exact count of
distinct sites; the others are clear either way. Lines spread over ``SITES`` sites or more are boilerplate and go from
every document that has an inked line of its own. A document keeps its boilerplate only if nothing else would remain of
it: such documents are copies of each other, and belong to near-duplicate detection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormrail.llm.common import written

#: Sites from which on a line is boilerplate.
SITES = 10
#: Estimates from the threshold divided by LOW to the threshold times BAND are counted exactly; the sketch's error is a
#: tenth. Sites that share a register lower an estimate: 10 sites fall into 6 of the 128 registers or fewer in one set of
#: about 13000, into 3 or fewer in one of about 6 * 10**10.
LOW, BAND = 2.5, 1.6
ERROR = 0.1


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h"), F.crc32(line.cast("binary")).alias("c"))


def _blank(line: Column) -> Column:
    return F.length(F.trim(line)) == 0


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(key) of the lines spread over ``sites`` distinct sites or more, from rows (key, site). A null site is none."""
    spread = written(lines.groupBy("key").agg(F.approx_count_distinct("site", ERROR).alias("about"))
                     .filter(F.col("about") >= sites / LOW), "spread")
    near = spread.filter(F.col("about") <= sites * BAND).select("key")
    exact = (lines.join(near, "key").filter("site is not null").distinct().groupBy("key").agg(F.count("*").alias("n"))
             .filter(F.col("n") >= sites).select("key"))
    return spread.filter(F.col("about") > sites * BAND).select("key").union(exact)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                sites: int = SITES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``, and columns ``lines`` and ``removed`` (how many lines
    the text had and lost). All rows and other columns stay; columns named ``lines`` or ``removed`` are replaced.

    A document loses its boilerplate if an inked line of its own remains. Blank lines are never boilerplate. A null text
    stays null (no lines), an empty one stays empty (one blank line). Rows that repeat are treated alike. Lines are
    equal if they are equal byte by byte. Other columns may have any names.
    """
    docs = docs.drop("lines", "removed")
    mark = F.xxhash64(id_col, text_col)
    parts = docs.filter(F.col(text_col).isNotNull()).select(
        mark.alias("doc"), F.col(site_col).alias("site"), F.explode(_lines(F.col(text_col))).alias("line"))
    slim = written(parts.filter(~_blank(F.col("line"))).select(
        "doc", "site", _hash(F.col("line")).alias("key"), F.length("line").alias("n")), "lines")
    found = written(boilerplate(slim.select("key", "site"), sites), "boilerplate")
    # one more pass over the slim rows gives each document its own boilerplate; rows that repeat share a mark, so
    # both sums count them as often
    hit = slim.join(found.withColumn("hit", F.lit(True)), "key", "left")
    own = (hit.groupBy("doc").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("hit"), F.col("n"))).alias("gone"),
                                  F.collect_set(F.when(F.col("hit"), F.col("key"))).alias("keys"))
           .filter(F.col("gone") < F.col("all")).select("doc", "keys"))
    # a sort-merge join at every size: the table of removals grows with the corpus, so it is never sent to all tasks
    # the documents' own columns travel in one struct, so no name of theirs meets a name of ours
    whole = docs.select(F.struct(*docs.columns).alias("row"), mark.alias("mark"))
    joined = whole.join(written(own, "removals").hint("merge"), F.col("mark") == F.col("doc"), "left")
    text = F.col("row")[text_col]
    every = _lines(text)
    kept = F.filter(every, lambda x: _blank(x) | ~F.array_contains(F.col("keys"), _hash(x)))
    joined = joined.withColumn("kept", F.when(F.col("keys").isNotNull(), kept))
    n = F.when(text.isNull(), 0).otherwise(F.coalesce(F.size(every), F.lit(0))).cast("long")
    return joined.select(
        *[F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(text).alias(c)
          if c == text_col else F.col("row")[c].alias(c) for c in docs.columns],
        n.alias("lines"), F.coalesce(n - F.size("kept"), F.lit(0)).cast("long").alias("removed"))
