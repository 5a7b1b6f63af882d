"""Queries of the reply jobs, with their SQL. Replies are stand-ins written from the items of the dialogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerloom.jobs.oracles import _ITEMS
from layerloom.jobs.queries import _passages, _items, query
from layerloom.operators import replies


def _attempts(spark, d) -> DataFrame:
    """A list of objects, a list of texts and an object of objects for the three layers; of some passages the first attempt is cut off."""
    pick = lambda k, x: F.array_sort(F.collect_list(F.when(F.col("layer") == k, x)))
    source = F.when(F.col("p") % 6 == 3, "").when(F.col("p") % 5 == 4, F.replace("content", F.lit(" "), F.lit("  "))).otherwise(F.col("content"))
    rows = _items(spark, d).groupBy("passage_id").agg(
        pick("proposition", F.struct("p", F.col("content").alias("content"), source.alias("source_text"), "needs_lookback")).alias("a"),
        pick("claim", F.struct("p", "content")).alias("b"),
        pick("phrase", F.struct(F.format_string("k%05d", "p").alias("key"), F.struct("content", F.lit(1).alias("needs_lookback")).alias("value"))).alias("c"),
    )
    a = F.transform("a", lambda x: F.struct(x.content.alias("content"), x.source_text.alias("source_text"), x.needs_lookback.alias("needs_lookback")))
    raw = F.to_json(F.struct(a.alias("propositions"), F.transform("b", lambda x: x.content).alias("claims"), F.map_from_entries("c").alias("phrases")))
    cut = F.when(F.col("passage_id") % 4 == 1, F.array(F.expr("substring(raw, 1, 9)"), F.lit("[]"), F.col("raw"))).otherwise(F.array("raw"))
    return rows.select("passage_id", raw.alias("raw")).select("passage_id", F.posexplode(cut).alias("attempt", "raw")).withColumn("attempt", F.col("attempt") + 1)


@query
def parse_replies(spark, d):
    return replies.reply_items(replies.parse_replies(_attempts(spark, d)))


@query
def resolve_spans(spark, d):
    return replies.resolve_spans(parse_replies(spark, d), _passages(spark, d)).select("passage_id", "layer", "p", "source_text", "start_char", "end_char")


_PARSED = """x AS (SELECT passage_id, layer, row_number() OVER (PARTITION BY passage_id, layer ORDER BY p) - 1 AS p, content, p AS q, start_char, needs_lookback FROM items)"""

SQL = {
    "parse_replies": f"WITH {_ITEMS}, {_PARSED} SELECT passage_id, layer, p, content, CASE WHEN layer = 'proposition' AND q % 6 <> 3 AND q % 5 = 4 THEN replace(content, ' ', '  ') ELSE content END AS source_text, needs_lookback AND layer = 'proposition' AS needs_lookback FROM x",
    "resolve_spans": f"WITH {_ITEMS}, {_PARSED} SELECT passage_id, layer, p, content AS source_text, start_char, start_char + length(content) AS end_char FROM x",
}
