"""How filters interact: what each removes, alone and behind the others, in every order of them.

The words of all texts are rows: they are counted by (document, word), then by document, which gives its words and its
distinct words. The texts are shuffled once, by document, so both counts need no further shuffle. The other flags
(capitals, symbols, copies) are outer-joined to that by document. What a set of filters does to a part of the corpus
follows from 32 numbers, one for each combination of failed filters: they are counted by (part, combination) first, and
then laid into 32 conditional counts of one row for each part. All orders are read off these, without the documents.

A text is a copy if a smaller id has the same SHA-256. The smallest id of each digest is aggregated before it is joined
by digest and id together, so the rows of a large group of copies are spread over all tasks.

Cases: a null text is empty; a null lang is the part of the empty string; a row without an id has no label, is no copy
and makes no other row one; rows that repeat an id count each for themselves, with the same flags if their texts are the
same; a document has quality or toxicity 1 if any of its label rows says so; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT = 80  # percent of the words
MOST_CAPITALS = 10  # percent of the code points
SYMBOLS = "[#$%&*|]"
_BLANKS = r"[\x20\x09-\x0D]+"


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text): ``h`` tells rows apart that share an id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"), F.coalesce(F.col("lang"), F.lit("")).alias("part"))


def word_totals(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_words, n_distinct) of each text: rows of words, counted by (document, word) and then by document."""
    # a null before the words: its count says how many times the same row occurs, and texts without words stay
    words = F.concat(F.array(F.lit(None).cast("string")), F.split("text", _BLANKS))
    rows = _keyed(docs).select("doc_id", "h", "text").repartition("doc_id", "h").select("doc_id", "h", F.explode(words).alias("word"))
    by_word = rows.groupBy("doc_id", "h", "word").agg(F.count("*").alias("n"))
    real = F.col("word") != ""
    out = by_word.groupBy("doc_id", "h").agg(F.sum(F.when(real, F.col("n"))).alias("words"), F.count_if(real).alias("n_distinct"), F.max(F.when(F.col("word").isNull(), F.col("n"))).alias("rows"))
    return out.select("doc_id", "h", F.coalesce((F.col("words") / F.col("rows")).cast("long"), F.lit(0)).alias("n_words"), "n_distinct")


def failures(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, part, and ``mask``, in which bit i is set if filter i of FILTERS fails."""
    keyed = _keyed(docs)
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    flags = keyed.select(
        "doc_id", "h", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
        (100 * capitals.cast("long") > MOST_CAPITALS * F.length("text").cast("long")).alias("C"), F.rlike("text", F.lit(SYMBOLS)).alias("D"),
    )
    first = flags.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("original", F.lit(True))
    flags = flags.join(first, ["digest", "doc_id"], "left").withColumn("E", F.col("doc_id").isNotNull() & F.col("original").isNull())
    totals = word_totals(docs).withColumnsRenamed({"doc_id": "id", "h": "k"})
    rows = flags.join(totals, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("k")), "left")
    words, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    fails = {"A": words < LEAST_WORDS, "B": 100 * distinct < LEAST_DISTINCT * words, "C": F.col("C"), "D": F.col("D"), "E": F.col("E")}
    return rows.select("doc_id", "part", _mask([fails[f] for f in FILTERS]).alias("mask"))


def _mask(fails: list[Column]) -> Column:
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with whether a label marks the document as good, and as toxic."""
    one = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return rows.join(one, "doc_id", "left").na.fill(False, ["good", "toxic"])


def combination_counts(rows: DataFrame, n_filters: int) -> DataFrame:
    """One row for each part, with arrays ``n``, ``good`` and ``toxic`` that hold a conditional count for each combination of failed filters."""
    few = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    counts = [F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).alias(f"{c}_{m}") for c in ("n", "good", "toxic") for m in range(1 << n_filters)]
    wide = few.groupBy("part").agg(*counts)
    return wide.select("part", *[F.array(*[f"{c}_{m}" for m in range(1 << n_filters)]).alias(c) for c in ("n", "good", "toxic")])


def orders(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """What each step of each order of the filters does to each part, from ``combination_counts``."""
    total = len(list(permutations(names)))
    entries = [F.struct(F.lit("".join(o)).alias("filter_order"), F.array(*[F.lit(1 << names.index(x)) for x in o]).alias("bits")) for o in permutations(names)]
    rows = counts.select("*", F.explode(F.array(*entries)).alias("o")).select("*", "o.filter_order", F.posexplode("o.bits").alias("place", "bit"), F.col("o.bits").alias("bits"))
    # the filters before this one, as a mask
    rows = rows.withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("place")), F.lit(0), lambda acc, b: acc.bitwiseOR(b)))
    here, gone = lambda m: m.bitwiseAND(F.col("bit")) != 0, lambda m: m.bitwiseAND(F.col("before")) != 0

    def summed(column: str, weight) -> Column:
        return F.aggregate(F.transform(column, lambda n, m: n * weight(m)), F.lit(0).cast("long"), lambda acc, n: acc + n)

    one = lambda condition: F.when(condition, 1).otherwise(0)
    removed = lambda m: one(here(m) & ~gone(m))
    return rows.select(
        "part", "filter_order", (F.col("place") + 1).cast("int").alias("step"),
        summed("n", lambda m: one(~here(m) & ~gone(m))).alias("kept"), summed("n", removed).alias("removed"),
        summed("n", lambda m: one(here(m) & gone(m))).alias("redundant"), summed("n", lambda m: one(m == F.col("bit"))).alias("unique_fails"),
        summed("good", removed).alias("good_lost"), summed("toxic", removed).alias("toxic_lost"),
        # of all orders, a document that fails k filters is removed by each of them in one of k
        summed("n", lambda m: F.when(here(m), (total / F.bit_count(m)).cast("long")).otherwise(0)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts for each part, order and step; zeros included."""
    return orders(combination_counts(labelled(failures(docs), labels), len(FILTERS)))
