"""Source divergence audit: how the sources of a language differ from each other and from the language in their terms.

Plain relational: terms are exploded from the texts and counted by language, source and term; the groups of a language meet its kept
vocabulary so that missing counts are zeros; shares of two sources meet on language and term and their differences are summed; a
window ranks. Texts are read once; everything after the first aggregation is as large as groups times vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actlake.llm.common import cut, stored

#: A longest run of ASCII letters and of whatever is not ASCII; what stands between such runs is BETWEEN.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCUMENTS = 30
TERMS_SHOWN = 50
SCALE = 1_000_000_000
SMOOTHING = 5
#: Parts of a language's vocabulary where it meets the language's groups.
PARTS = 64


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, ``n`` occurrences and ``documents`` that hold it. An occurrence is marked if it is the first in its row.

    The matches of TERM are what splitting at BETWEEN leaves, which Spark does ten times faster than extracting all matches.
    """
    lower = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    found = F.sort_array(F.split(lower, BETWEEN))
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), found.alias("terms"))
    first = F.transform("terms", lambda t, i: F.struct(t.alias("term"), ((i == 0) | (t != F.get("terms", i - 1))).cast("long").alias("first")))
    each = rows.select("lang", "source", F.inline(first)).where("term != ''")
    return each.groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("first").alias("documents"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 5) / (total + 5 * terms)), exactly and past 64 bits."""
    above = f"cast({SCALE} as decimal(10,0)) * cast({n} + {SMOOTHING} as decimal(20,0))"
    return F.expr(f"1 + ({above}) div cast({total} + {SMOOTHING} * {terms} as decimal(20,0))")


def shares(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """The groups (lang, source), and for each group and kept term of its language lang, source, term, n, p and the language's q."""
    groups = cut(docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct())
    counts = stored(term_counts(docs))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("documents").alias("documents"))
    kept = cut(kept.where(F.col("documents") >= least_documents).drop("documents"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all_n").alias("all_total"))
    counts = counts.drop("documents").join(kept.drop("all_n"), ["lang", "term"], "left_semi")
    totals = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(sizes, "lang")
    # a language is one key of this join: its terms are dealt into parts, and its few groups go to each part
    parts = F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")
    spread = totals.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dense = kept.withColumn("part", parts).join(spread, ["lang", "part"]).join(counts, ["lang", "source", "term"], "left")
    filled = dense.select("lang", "source", "term", "terms", "all_n", "all_total", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "total")))
    return groups, cut(filled.select("lang", "source", "term", "n", share("n", "total", "terms").alias("p"), share("all_n", "all_total", "terms").alias("q")))


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, terms_shown: int = TERMS_SHOWN) -> DataFrame:
    """lang, source, part, item, value, rank: how far each other source of the language is (part ``pair``), and the terms that a
    source uses more than its language (part ``term``, the first ``terms_shown``).

    Null texts, languages and sources count as empty strings; a group without terms has the smoothed share of each kept term; in a
    language that keeps no term its sources differ by 0. Each repeated row counts as a document; ties rank by item; an empty table gives
    an empty one; other columns are not read. A row's terms are held at once, so memory grows with the longest text.
    """
    groups, each = shares(docs, least_documents)
    other = each.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other_p"))
    half = each.select("lang", "term", "source", "p").join(other, ["lang", "term"]).where("source < item")
    half = cut(half.groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("other_p"))).alias("value")))
    both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    beside = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source != item")
    pairs = beside.join(both, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    terms = each.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [rows.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part)) for part, rows in (("pair", pairs), ("term", terms))]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= terms_shown)).select("lang", "source", "part", "item", "value", "rank")
