"""Model replies: parsing, one shape for their items, and the place of each item in its passage."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerloom import config
from layerloom.functions.text import BLANK, strip

ATTEMPTS = 3


def parse_replies(attempts: DataFrame, most: int = ATTEMPTS) -> DataFrame:
    """(passage_id, reply variant, attempt) from attempts (passage_id, attempt, raw): the first of ``most`` that is a JSON object; null if none is."""
    v = F.try_parse_json("raw")
    good = F.schema_of_variant(v).startswith("OBJECT") & (F.col("attempt") <= most)
    first = F.min(F.when(good, F.struct("attempt", "raw"))).alias("first")
    return attempts.groupBy("passage_id").agg(first).select("passage_id", F.try_parse_json("first.raw").alias("reply"), F.col("first.attempt").alias("attempt"))


def _said(v: Column, field: str) -> Column:
    return strip(F.coalesce(F.try_variant_get(v, f"$.{field}", "string"), F.lit("")))


def _truthy(v: Column) -> Column:
    """True, numbers but 0, texts but the empty one, and filled arrays and objects."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    return F.coalesce(F.when(kind == "BOOLEAN", text == "true").when(kind == "STRING", text != "").when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), number != 0).when(kind.rlike("^(ARRAY|OBJECT)"), ~text.isin("[]", "{}")), F.lit(False))


def reply_items(replies: DataFrame) -> DataFrame:
    """(passage_id, layer, p, content, source_text, needs_lookback) of parsed replies.

    A layer is a list, or an object whose values are the items (in order of their keys); other values are no items. A
    text is content and source at once; an object needs content, and its source falls back to it; other items go.
    Phrases are never flagged.
    """
    out = None
    for layer, plural in config.LAYERS.items():
        at = f"$.{plural}"
        found = F.coalesce(F.try_variant_get("reply", at, "array<variant>"), F.map_values(F.try_variant_get("reply", at, "map<string,variant>")))
        rows = replies.select("passage_id", F.lit(layer).alias("layer"), F.posexplode(found).alias("p", "v"))
        out = rows if out is None else out.unionByName(rows)
    kind = F.schema_of_variant("v")
    text = strip(F.try_variant_get("v", "$", "string"))
    content = F.when(kind == "STRING", text).when(kind.startswith("OBJECT"), _said(F.col("v"), "content"))
    source = F.when(kind == "STRING", text).otherwise(_said(F.col("v"), "source_text"))
    flag = F.when(kind.startswith("OBJECT"), _truthy(F.try_variant_get("v", "$.needs_lookback", "variant"))).otherwise(F.lit(False))
    rows = out.select("passage_id", "layer", F.col("p").cast("long").alias("p"), content.alias("content"), source.alias("source_text"), (flag & (F.col("layer") != "phrase")).alias("needs_lookback"))
    return rows.where("content <> ''").withColumn("source_text", F.when(F.col("source_text") == "", F.col("content")).otherwise(F.col("source_text")))


_PLAIN = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."})


def plain(text: str) -> str:
    """As ``match_normal``."""
    return " ".join(text.translate(_PLAIN).split())


def _collapsed(text: str) -> tuple[str, list[int]]:
    """``text`` in plain letters with single spaces, and how many letters of that stand before each character (one entry more)."""
    out, at, blank = [], [0], False
    for c in text:
        new = " " if c.isspace() else c.translate(_PLAIN)
        out.append("" if new == " " and blank else new)
        blank = new == " "
        at.append(at[-1] + len(out[-1]))
    return "".join(out), at


def _common_lengths(text: str, where: dict[str, int], n: int) -> list[int]:
    """The length of the longest common subsequence of each beginning of ``text`` (one entry more) with a text of ``n`` letters, whose places are bits of ``where``."""
    full = (1 << n) - 1
    rows, out = full, [0]
    for c in text:
        hit = rows & where.get(c, 0)
        rows = ((rows + hit) | (rows - hit)) & full
        out.append(n - rows.bit_count())
    return out


#: Starts of windows that the first filter looks at together.
STARTS = 32


def best_window(text: str, source: str, least: float = config.FUZZY_THRESHOLD) -> tuple[int, int] | None:
    """The span of ``text`` most like ``source``, both in plain letters: the earliest and then shortest of the best, or None below ``least``.

    Windows of many starts are excluded together by the pairs of letters that they share with ``source``: what turns one
    text into the other by d insertions and deletions spoils at most 2 d of them. Of the others, all sizes of a start are
    bounded by one pass over their longest common subsequences, and the exact ratio, twice the matched letters by all letters,
    is taken only where that bound passes: matched blocks are a common subsequence.
    """
    wanted, n = plain(source), len(source.strip())
    if len(wanted) < 8:
        return None
    letters, at = _collapsed(text)
    where: dict[str, int] = {}
    for i, c in enumerate(wanted):
        where[c] = where.get(c, 0) | 1 << i
    pairs = Counter(map("".join, zip(wanted, wanted[1:])))
    low, high, end = max(8, n - 15), n + 24, len(text)
    best, span, match = 0.0, None, SequenceMatcher()
    match.set_seq2(wanted)
    for block in range(0, end - low + 1, STARTS):
        starts = range(block, min(block + STARTS, end - low + 1))
        near = letters[at[block] : at[min(starts[-1] + high, end)]]
        shared = (Counter(map("".join, zip(near, near[1:]))) & pairs).total()
        spoiled = -(-(len(wanted) - 1 - shared) // 2)
        most = len(wanted) + max(at[min(i + high, end)] - at[i] for i in starts)
        if 1 - max(0, spoiled) / most < max(best, least - 1e-9) - 1e-9:
            continue
        for i in starts:
            a = at[i] + (letters[at[i] : at[i] + 1] == " ")
            common = _common_lengths(letters[a : at[min(i + high, end)]], where, len(wanted))
            for size in range(low, min(high, end - i) + 1):
                b = at[i + size] - a
                # a blank at the end counts for nothing
                bare = b - (b > 0 and letters[a + b - 1] == " ")
                bound = 2.0 * common[max(0, bare)] / (max(0, bare) + len(wanted))
                if bound <= best or bound < least - 1e-9:
                    continue
                match.set_seq1(letters[a : a + bare])
                got = match.ratio()
                if got > best:
                    best, span = got, (i, i + size)
    return span if best >= least else None


def resolve_spans(items: DataFrame, passages: DataFrame) -> DataFrame:
    """``items`` with start_char and end_char in the passage (id, content), source_text as it stands there; null where it does not.

    Exact first, then with any white space between words; only what is left goes to the fuzzy search, in Arrow batches.
    """
    rows = items.join(passages.select(F.col("id").alias("passage_id"), F.col("content").alias("passage")), "passage_id")
    quoted = F.transform(F.filter(F.split("source_text", rf"{BLANK}+"), lambda w: w != ""), lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    loose = F.when(F.size(quoted) > 1, F.regexp_substr("passage", F.array_join(quoted, rf"{BLANK}+")))
    rows = rows.withColumn("hit", F.when(F.col("source_text") == "", None).when(F.expr("locate(source_text, passage)") > 0, F.col("source_text")).otherwise(loose))
    found = rows.where("hit IS NOT NULL").withColumn("start_char", (F.expr("locate(hit, passage)") - 1).cast("long")).withColumn("end_char", F.col("start_char") + F.length("hit"))
    plain = ["passage_id", "layer", "p", "content", "needs_lookback", "source_text", "start_char", "end_char"]
    found = found.drop("source_text").withColumnRenamed("hit", "source_text").select(plain)
    rest = rows.where("hit IS NULL").select("passage_id", "layer", "p", "content", "needs_lookback", "source_text", "passage")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = [best_window(c, w or "") for c, w in zip(b["passage"], b["source_text"])]
            b["source_text"] = [c[s[0] : s[1]] if s else t for c, s, t in zip(b["passage"], spans, b["source_text"])]
            b["start_char"] = pd.array([s[0] if s else None for s in spans], dtype="Int64")
            b["end_char"] = pd.array([s[1] if s else None for s in spans], dtype="Int64")
            yield b[plain]

    return found.unionByName(rest.mapInPandas(search, found.schema))


def placed(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with a place in their passage, kept and dropped items of each passage)."""
    there = F.col("start_char").isNotNull()
    return resolved.where(there), resolved.groupBy("passage_id").agg(F.count_if(there).alias("kept"), F.count_if(~there).alias("dropped"))


def lookback_answers(replies: DataFrame) -> DataFrame:
    """(item_id, reply) from replies (raw): JSON objects whose ``resolved`` lists item_id and content. Of repeated ids the last counts; other shapes are skipped."""
    found = F.coalesce(F.try_variant_get(F.try_parse_json("raw"), "$.resolved", "array<variant>"), F.array().cast("array<variant>"))
    rows = replies.select(F.posexplode(found).alias("p", "v")).select("p", F.try_variant_get("v", "$.item_id", "string").alias("item_id"), F.try_variant_get("v", "$.content", "string").alias("reply"))
    return rows.where("item_id IS NOT NULL").groupBy("item_id").agg(F.max_by("reply", "p").alias("reply"))


def extraction_requests(passages: DataFrame, template: str = "Extract the layers of this passage:\n{content}") -> DataFrame:
    """(id, request): the template with each passage's text in place of ``{content}``, wherever it stands."""
    parts = [F.lit(x) for x in template.split("{content}")]
    said = F.coalesce("content", F.lit(""))
    return passages.select("id", F.concat(*[c for x in parts for c in (x, said)][:-1]).alias("request"))


def request_replies(requests: DataFrame, ask: Callable[[list[str]], list[str]], batch: int = config.EMBED_BATCH) -> DataFrame:
    """(id, raw): the answers of a model, a plug-in, to requests (id, request), asked in batches inside the tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                yield pd.DataFrame({"id": part["id"], "raw": ask(part["request"].tolist())})

    return requests.select("id", "request").mapInPandas(run, "id long, raw string")
