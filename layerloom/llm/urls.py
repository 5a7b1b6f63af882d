"""URL filters: explicit host and path rules, then association rules that FP-growth mines from labelled URLs.

A URL's transaction is the set of its host's labels and of its path's words. FP-growth in its parallel form (a token's
conditional base is what its pages hold of more frequent tokens; ``grow`` grows patterns from it in a task) finds the
combinations that are rules: their share of bad pages reaches ``confidence``, their support with the item that marks a
bad page reaches ``support``, and the share is beyond chance: the lower end of its Wilson interval (``z`` standard
errors) lies above the share of bad pages among all. That asks few pages of a clear rule and many of a doubtful one, at
every size of the table; the least number of pages that can pass follows from it.

No rule is lost, and correlated words do not multiply: tokens of exactly the same pages are one item, which a page has
if it has any of its tokens; a pattern is not grown where even the best that may come of it (all its bad pages, and only
the good ones that hold every token that is left) is no rule; and ``judge`` needs no rule that a smaller one covers.
Rules match through an inverted index: a rule is posted under its rarest item, a page looks up its tokens, and the few
rules found are tested whole. A page with a rule is blocked, all others are allowed.

``rules_of`` by itself takes tokens whose pages are nearly the same (a Jaccard index of ``alike`` or more with a token
that stands for them) as one, for a short list to read; such a list lacks the rules of the tokens that are stood for.

The label of a page is its document's: the last number of the path is the document's id; a page is bad where its
document has quality 0 or is toxic. Pages without such a number, or whose document has no label, do not train.

Cases: a null url, or one without ``://``, has empty host and path and is allowed unless a rule says otherwise;
repeated pages and repeated labels count as often as they stand; empty tables give no rules; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerloom.llm.common import written

#: verdict, host, path; a rule fits the host and all its subdomains if the url's path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SUPPORT = 0.002
CONFIDENCE = 0.6
#: Standard errors between a rule's confidence and the lower end that must lie above the base rate.
Z = 3.0
#: Jaccard index of the pages of tokens that are one in a list of rules to read.
ALIKE = 0.75
#: Groups of two minimum hashes of a token's pages; tokens that share one are compared. At 0.75 a pair shares none once in 2.3e8.
BANDS = 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else null; of equally long ones the first in order of host."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1]))
    name = verdict = None
    for v, h, p in ranked:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.filter(F.split(F.translate(path, _UPPER, _LOWER), r"[^a-z0-9]+"), lambda x: (x != "") & ~x.rlike(r"^\d+$")), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, words))


def split_urls(pages: DataFrame) -> DataFrame:
    host, path = host_and_path()
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("tokens", tokens(F.col("host"), F.col("path")))


RULE = "rule_id long, antecedent array<string>, confidence double, support double, classes array<array<string>>"


def baskets(urls: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, bad) of each labelled page."""
    doc = F.expr(r"try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS bigint)")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), True).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), False)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), bad.alias("bad")).where(F.col("bad").isNotNull())
    return urls.where(F.size("tokens") > 0).select(doc.alias("doc_id"), "tokens").join(marked, "doc_id").select("tokens", "bad")


def mine(urls: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, z: float = Z) -> DataFrame:
    """Rules (rule_id, antecedent, confidence, support, classes) of the labelled pages: with any token of each class, a page meets the rule."""
    return rules_of(baskets(urls, labels), support, confidence, z, alike=1.0, least_only=True)


def wilson_low(share: float, n: float, z: float) -> float:
    """The lower end of the Wilson interval of a share of ``n``."""
    return (share + z * z / (2 * n) - z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def same_pages(each: DataFrame) -> DataFrame:
    """(token, item) of the distinct (page, token) rows ``each``: tokens of exactly the same pages have one item, by 128 bits of hashes."""
    of = each.groupBy("token").agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64("page", F.lit(i))).alias(f"h{i}") for i in range(2)])
    item = of.groupBy("n", "h0", "h1").agg(F.max("token").alias("item"))
    return of.join(item, ["n", "h0", "h1"]).select("token", "item")


def stand_ins(each: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(token, item) of the distinct (page, token) rows ``each``: the token that stands for each one.

    Of every band the most frequent token leads; a token takes the first, by frequency, of the leaders that share enough of its
    pages, which is counted exactly. A leader of others stands for itself if no one leads it; so links do not chain.
    """
    numbered = [F.min(F.xxhash64("page", F.lit(i))).alias(f"m{i}") for i in range(2 * BANDS)]
    signed = written(each.groupBy("token").agg(F.count("*").alias("n"), *numbered))
    bands = F.array(*[F.xxhash64(F.lit(i), f"m{2 * i}", f"m{2 * i + 1}") for i in range(BANDS)])
    held = signed.select("token", "n", F.explode(bands).alias("band"))
    lead = held.groupBy("band").agg(F.max(F.struct("n", "token")).alias("lead"))
    pairs = held.join(lead, "band").where(F.col("lead.token") != F.col("token")).select("token", "n", F.col("lead.token").alias("item"), F.col("lead.n").alias("item_n")).distinct()
    shared = each.join(pairs.select("token", "item"), "token").join(each.select("page", F.col("token").alias("item")), ["page", "item"]).groupBy("token", "item").agg(F.count("*").alias("shared"))
    near = pairs.join(shared, ["token", "item"]).where(F.col("shared") >= alike * (F.col("n") + F.col("item_n") - F.col("shared")))
    best = near.groupBy("token").agg(F.max(F.struct("item_n", "item")).alias("best")).select("token", "best.item")
    # a token whose leader is led itself stands for itself
    led = best.select(F.col("token").alias("item"), F.lit(True).alias("led"))
    best = best.join(led, "item", "left").where("led IS NULL").select("token", "item")
    return signed.select("token").join(best, "token", "left").select("token", F.coalesce("item", "token").alias("item"))


def grow(base: pd.DataFrame, need: int, is_rule, least_only: bool) -> Iterator[tuple[list[str], int, int]]:
    """(antecedent, pages, bad pages) of the rules in a conditional base: rows (head, rest, n, bad), of one head."""
    names = np.array(sorted({t for rest in base["rest"] for t in rest}), dtype=object)
    at = {t: k for k, t in enumerate(names)}
    holds = np.zeros((len(base), len(names)), bool)
    for i, rest in enumerate(base["rest"]):
        holds[i, [at[t] for t in rest]] = True
    n, bad = base["n"].to_numpy(), base["bad"].to_numpy()
    todo = [([base["head"].iloc[0]], np.arange(len(base)), np.arange(len(names)))]
    while todo:
        some, rows, more = todo.pop()
        pages, hit = int(n[rows].sum()), int(bad[rows].sum())
        if is_rule(hit, pages):
            yield some, pages, hit
            if least_only or hit == pages:
                continue
        # tokens that keep too few bad pages lead nowhere; one that all of the pages have changes nothing
        held = holds[np.ix_(rows, more)]
        hits = bad[rows] @ held
        live = (hits >= need) & ~held.all(0)
        order = np.flatnonzero(live)[np.argsort(hits[live], kind="stable")]
        more, held, hits = more[order], held[:, order], hits[order]
        if not len(more):
            continue
        core, best = int((n - bad)[rows][held.all(1)].sum()), int(hits.max())
        if is_rule(best, best + core):
            todo += [([*some, names[t]], rows[held[:, k]], more[k + 1 :]) for k, t in enumerate(more)]


def rules_of(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, z: float = Z, alike: float = ALIKE, least_only: bool = False) -> DataFrame:
    """Rules of (tokens, bad); with ``alike`` 1 no rule is left out but those that others cover, and ``least_only`` grows no rule further."""
    spark = labelled.sparkSession
    held = written(labelled.withColumn("page", F.monotonically_increasing_id()))
    n, n_bad = held.agg(F.count("*"), F.count_if("bad")).first()
    if not n_bad or n_bad == n:  # nothing is beyond a base rate of one
        return spark.createDataFrame([], RULE)
    base = n_bad / n
    # the fewest pages, all of them bad, that pass: n / (n + z * z) > base
    need = max(int(base * z * z / (1 - base)) + 1, math.ceil(support * n - 1e-9))
    each = held.select("page", "bad", F.explode(F.array_distinct("tokens")).alias("token"))
    often = each.where("bad").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= need).select("token")
    each = written(each.join(often, "token"))
    pairs = each.select("page", "token")
    items = written(same_pages(pairs) if alike >= 1 else stand_ins(pairs, alike))
    own = each.join(items.where("token = item").select("token"), "token")
    sized = own.groupBy("token").agg(F.count("*").alias("size"))
    # patterns: the items of a page, rare ones first
    patterns = own.join(sized, "token").groupBy("page", "bad").agg(F.array_sort(F.collect_list(F.struct("size", "token"))).alias("items"))
    patterns = patterns.groupBy("items").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    heads = patterns.select(F.posexplode("items.token").alias("k", "head"), "items", "n", "bad")
    heads = heads.select("head", F.expr("slice(items.token, k + 2, size(items))").alias("rest"), "n", "bad").groupBy("head", "rest").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def is_rule(hit: int, pages: int) -> bool:
        return hit >= need and hit / pages >= confidence and wilson_low(hit / pages, pages, z) > base

    def grown(conditional: pd.DataFrame) -> pd.DataFrame:
        rows = [(sorted(some), hit / pages, hit / n) for some, pages, hit in grow(conditional, need, is_rule, least_only)]
        return pd.DataFrame(rows, columns=["antecedent", "confidence", "support"])

    found = written(heads.groupBy("head").applyInPandas(grown, "antecedent array<string>, confidence double, support double"))
    # a rule is needless if one of its tokens less is a rule of no lower confidence
    shorter = found.select(F.col("antecedent").alias("kept"), F.col("confidence").alias("kept_confidence"))
    less = found.withColumn("kept", F.explode(F.expr("transform(antecedent, x -> array_remove(antecedent, x))"))).join(shorter, "kept").where(F.col("kept_confidence") >= F.col("confidence"))
    found = found.join(less.select("antecedent").distinct(), "antecedent", "left_anti").withColumn("rule_id", F.xxhash64("antecedent"))
    classes = found.select("rule_id", F.explode("antecedent").alias("item")).join(items, "item").groupBy("rule_id", "item").agg(F.collect_list("token").alias("tokens")).groupBy("rule_id").agg(F.collect_list("tokens").alias("classes"))
    return found.join(classes, "rule_id").select("rule_id", "antecedent", "confidence", "support", "classes")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host and path of the URLs that hold a token of each class of a rule."""
    held = urls.select("host", "path", "tokens").distinct().withColumn("token", F.explode("tokens"))
    common = held.groupBy("token").agg(F.count("*").alias("n"))
    posted = rules.select("rule_id", "classes", F.posexplode("classes").alias("k", "some")).withColumn("token", F.explode("some")).join(common, "token")
    rare = posted.groupBy("rule_id", "k").agg(F.sum("n").alias("n")).groupBy("rule_id").agg(F.min(F.struct("n", "k")).alias("rare")).select("rule_id", "rare.k")
    index = posted.join(rare, ["rule_id", "k"]).select("token", "classes")
    return held.join(index, "token").where(F.forall("classes", lambda c: F.arrays_overlap(c, F.col("tokens")))).select("host", "path").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, z: float = Z) -> DataFrame:
    """Per page: host, path, the explicit rule that fits, and the verdict: the rule's, else the mined rules'."""
    urls = split_urls(pages)
    blocked = matched(urls, mine(urls, labels, support, confidence, z)).withColumn("mined", F.lit(True))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = urls.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said")).join(blocked, ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"))
