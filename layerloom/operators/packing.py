"""Overlapping sentence passages by greedy packing, without a loop over a document in Python.

For a sentence, the tokens before it rise strictly, so the last sentence that fits a passage that starts here is found by
a range frame over them. The real passage starts are the chain from the first sentence on. For a document of up to
IN_A_ROW sentences it is one fold over the array of their ends; for longer ones, which no row should hold, the chain is
found by pointer doubling: joins by (document, sentence), as many as the logarithm of the chain's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerloom import config
from layerloom.functions.text import sentences, token_estimate
from layerloom.scratch import written

#: Sentences that a row holds at most.
IN_A_ROW = 1 << 16


def sentence_rows(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(episode_id, position, paragraph, sentence, tokens): the sentences of each text in order."""
    rows = docs.select(F.col(id_col).alias("episode_id"), F.posexplode(sentences(text_col)).alias("position", "x"))
    return rows.select("episode_id", F.col("position").cast("long").alias("position"), F.col("x.paragraph"), F.col("x.sentence"), token_estimate(F.col("x.sentence")).alias("tokens"))


def _with_ends(rows: DataFrame, max_tokens: int) -> DataFrame:
    """Sentence rows with ``end``, the sentence after the passage that starts here, ``n`` and the ``joint`` to the sentence before."""
    by = Window.partitionBy("episode_id")
    before = F.coalesce(F.sum("tokens").over(by.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("n", F.count("*").over(by)).withColumn("total", F.sum("tokens").over(by))
    fits = F.count("*").over(by.orderBy("before").rangeBetween(1, max_tokens))
    # the end of the document is one more entry of the range, for sentences whose whole rest fits
    fits = fits + F.when(F.col("total") - F.col("before") <= max_tokens, 1).otherwise(0)
    rows = rows.withColumn("end", F.col("position") + F.greatest(F.lit(1), fits))
    text = F.when(F.lag("paragraph").over(by.orderBy("position")) == F.col("paragraph"), F.lit(" ")).otherwise(F.lit("\n\n"))
    return rows.withColumn("joint", text)


def pack(rows: DataFrame, max_tokens: int = config.PASSAGE_MAX_TOKENS, overlap: int = config.PASSAGE_OVERLAP) -> DataFrame:
    """(episode_id, passage_index, content, token_estimate) from sentence rows; one shuffle, by episode. A row holds a document's sentences."""
    rows = _with_ends(rows, max_tokens)
    items = F.array_sort(F.collect_list(F.struct("position", "end", "joint", "sentence")))
    docs = rows.groupBy("episode_id").agg(items.alias("items"), F.max("n").alias("n"))
    start = F.struct(F.lit(0).cast("long").alias("next"), F.array().cast("array<struct<first:bigint,last:bigint>>").alias("passages"))

    def step(acc, x):
        here = acc.next == x.position
        follow = F.when(x.end >= F.col("n"), F.lit(-1)).otherwise(F.greatest(x.end - overlap, x.position + 1))
        grown = F.concat(acc.passages, F.array(F.struct(x.position.alias("first"), x.end.alias("last"))))
        return F.struct(F.when(here, follow).otherwise(acc.next).cast("long").alias("next"), F.when(here, grown).otherwise(acc.passages).alias("passages"))

    passages = docs.withColumn("passages", F.aggregate("items", start, step).passages)
    said = lambda c: F.array_join(F.transform(F.slice("items", (c.first + 1).cast("int"), (c.last - c.first).cast("int")), lambda x, i: F.when(i == 0, x.sentence).otherwise(F.concat(x.joint, x.sentence))), "")
    # the texts are made inside the array, so that no row carries all sentences of its document
    out = passages.select("episode_id", F.transform("passages", said).alias("contents")).select("episode_id", F.posexplode("contents").alias("passage_index", "content"))
    return out.withColumn("passage_index", F.col("passage_index").cast("long")).withColumn("token_estimate", token_estimate("content"))


def chain_starts(links: DataFrame) -> DataFrame:
    """(episode_id, position) of what can be reached from position 0 by the links (episode_id, position, next; null ends a chain).

    With every join the links get twice as long, and what is reached by a link of 2 ** k steps is added.
    """
    reached = links.where("position = 0").select("episode_id", "position")
    jump = written(links.where("next IS NOT NULL").select("episode_id", "position", "next"))
    while not jump.isEmpty():
        more = reached.join(jump, ["episode_id", "position"]).select("episode_id", F.col("next").alias("position"))
        reached = written(reached.unionByName(more))
        then = jump.select("episode_id", F.col("position").alias("next"), F.col("next").alias("after"))
        jump = written(jump.join(then, ["episode_id", "next"]).select("episode_id", "position", F.col("after").alias("next")))
    return reached


def pack_long(rows: DataFrame, max_tokens: int = config.PASSAGE_MAX_TOKENS, overlap: int = config.PASSAGE_OVERLAP) -> DataFrame:
    """As ``pack``, for documents of any length: no row holds more than a passage's sentences."""
    rows = written(_with_ends(rows, max_tokens).select("episode_id", "position", "end", "n", "joint", "sentence"))
    follow = F.when(F.col("end") < F.col("n"), F.greatest(F.col("end") - overlap, F.col("position") + 1))
    starts = chain_starts(rows.select("episode_id", "position", follow.alias("next")))
    first = rows.select("episode_id", "position", "end").join(starts, ["episode_id", "position"])
    index = (F.row_number().over(Window.partitionBy("episode_id").orderBy("position")) - 1).cast("long")
    numbered = first.select("episode_id", index.alias("passage_index"), F.col("position").alias("first"), "end")
    members = numbered.select("episode_id", "passage_index", "first", F.explode(F.sequence("first", F.col("end") - 1)).alias("position"))
    said = members.join(rows.select("episode_id", "position", "joint", "sentence"), ["episode_id", "position"])
    part = F.struct("position", F.when(F.col("position") == F.col("first"), F.col("sentence")).otherwise(F.concat("joint", "sentence")).alias("said"))
    out = said.groupBy("episode_id", "passage_index").agg(F.array_join(F.array_sort(F.collect_list(part))["said"], "").alias("content"))
    return out.withColumn("token_estimate", token_estimate("content"))


def _is_long(text_col: str, in_a_row: int) -> Column:
    """A sentence and the blank after it are two characters at least, so a text's length bounds its sentences."""
    return F.coalesce(F.length(text_col) > 2 * in_a_row, F.lit(False))


def any_long(docs: DataFrame, text_col: str = "text", in_a_row: int = IN_A_ROW) -> bool:
    """Whether a text may have more sentences than one row should hold."""
    return not docs.where(_is_long(text_col, in_a_row)).isEmpty()


def passage(docs: DataFrame, id_col: str = "id", text_col: str = "text", max_tokens: int = config.PASSAGE_MAX_TOKENS, overlap: int = config.PASSAGE_OVERLAP, in_a_row: int = IN_A_ROW, any_long_: bool | None = None) -> DataFrame:
    """Passages of each text; an empty text has none. ``any_long_`` says what ``any_long`` would, where that is known."""
    if not (any_long(docs, text_col, in_a_row) if any_long_ is None else any_long_):
        return pack(sentence_rows(docs, id_col, text_col), max_tokens, overlap)
    is_long = _is_long(text_col, in_a_row)
    out = pack(sentence_rows(docs.where(~is_long), id_col, text_col), max_tokens, overlap)
    return out.unionByName(pack_long(sentence_rows(docs.where(is_long), id_col, text_col), max_tokens, overlap))
