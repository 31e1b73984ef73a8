"""URL filters: explicit host and path rules first, then association rules between URL tokens and verdicts.

Spark's FP-growth mines token combinations of the URLs whose verdict the explicit rules give (their labels). Rules whose
consequent is a verdict are pruned by support and confidence and kept in an inverted index under their rarest token; a URL
looks up its tokens there and takes the verdict of the most confident rule that it contains. DataFrame operations only.

FP-growth lists every subset of tokens that go together, so a URL gives it at most MAX_ITEMS of its frequent tokens, the most
frequent ones; then the support and confidence of each rule found are counted anew over all labelled rows and all their tokens.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: An index of at most so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 20_000
LABEL = "verdict="
MAX_ITEMS = 12  # tokens of a row that FP-growth lists all subsets of
LONGEST = 2  # tokens of an antecedent that is found in rows of any length
LEAST_ROWS = 5  # rows that hold a rule, whatever min_support says


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def _rest(url: Column) -> Column:
    """What follows the first ://; empty for null and where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and where there is no ://."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty for null and where there is no ://."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """A struct of rule and verdict: of the rules that fit, the longest by host and path; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: labels of the host, its ending, and segments of the path."""
    tag = lambda p, c: F.transform(F.filter(c, lambda x: x != ""), lambda x: F.concat(F.lit(p), x))
    return F.array_distinct(F.concat(tag("host=", F.split(host, r"\.")), tag("path=", F.split(path, "/"))))


def mined_items(labelled: DataFrame, least: int, max_items: int, longest: int) -> DataFrame:
    """(items): the verdict and the frequent tokens of each row.

    A row of more than max_items frequent tokens gives one of its max_items most frequent tokens, and one of each `longest` of its
    tokens. So any `longest` of its tokens meet in a row, often in more than one: counts of sets are too high, never too low.
    Only tokens of `least` rows or more come to the driver, at most (tokens of a row) / min_support of them.
    """
    counts = labelled.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= least)
    frequent = [r["token"] for r in counts.orderBy(F.desc("count"), "token").select("token").collect()]
    inside = F.array_intersect(F.lit(frequent) if frequent else F.array().cast("array<string>"), "tokens")
    rows = labelled.select(inside.alias("tokens"), F.array(F.concat(F.lit(LABEL), "verdict")).alias("label"))
    first = rows.select(F.concat(F.slice("tokens", 1, max_items), "label").alias("items"))
    cut = rows.where(F.size("tokens") > max_items).withColumn("n", F.size("tokens"))
    for i in range(longest):
        start = F.col(f"at{i - 1}") + 1 if i else F.lit(0)
        cut = cut.withColumn(f"at{i}", F.explode(F.sequence(start, F.col("n") - (longest - i))))
    return first.unionByName(cut.select(F.concat(F.array(*(F.get("tokens", F.col(f"at{i}")) for i in range(longest))), "label").alias("items")))


def with_rarest(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """Add `rare`, the rarest token of each rule's antecedent; counts is (token, base)."""
    rare = rules.select("rule_id", F.explode("antecedent").alias("token")).join(counts, "token").groupBy("rule_id").agg(F.min(F.struct("base", "token")).alias("x"))
    return rules.join(rare.select("rule_id", F.col("x.token").alias("rare")), "rule_id")


def mine_rules(labelled: DataFrame, *, min_support: float, min_confidence: float, least_rows: int = LEAST_ROWS, max_items: int = MAX_ITEMS, longest: int = LONGEST) -> DataFrame:
    """(rule_id, antecedent, rare, confidence, support, verdict) from (tokens, verdict); `rare` is its rarest token.

    A rule is held by min_support of the rows and least_rows of them at least; support and confidence are counted over all rows.
    All rules of up to `longest` tokens are found; longer ones as far as rows hold them often enough among their max_items most
    frequent tokens. Rows without tokens or verdict are left out; no rows give no rules.
    """
    if not 1 <= longest <= max_items:
        raise ValueError("longest is between 1 and max_items")
    labelled = materialize(labelled.where("verdict is not null and size(tokens) > 0").select("tokens", "verdict"))
    total = labelled.count()
    least = max(least_rows, math.ceil(min_support * total), 1)
    items = materialize(mined_items(labelled, least, max_items, longest))
    # Half a row less, so that rounding never asks for one more.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(items.count(), 1)), minConfidence=min_confidence).fit(items)
    found = model.freqItemsets.where(F.exists("items", lambda x: x.startswith(LABEL)) & (F.size("items") > 1))
    ante = materialize(found.select(F.array_sort(F.filter("items", lambda x: ~x.startswith(LABEL))).alias("antecedent")).distinct())
    ones = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("base"))
    indexed = with_rarest(ante.withColumn("rule_id", F.concat_ws(" ", "antecedent")), ones)
    rows = labelled.groupBy("tokens", "verdict").agg(F.count(F.lit(1)).alias("n"))
    held = holding(rows, indexed).groupBy("rule_id", "antecedent", "rare", "verdict").agg(F.sum("n").alias("freq"))
    base = held.groupBy("rule_id").agg(F.sum("freq").alias("base"))
    rules = held.join(base, "rule_id").withColumn("confidence", F.col("freq") / F.col("base")).where((F.col("confidence") >= min_confidence) & (F.col("freq") >= least))
    name = F.concat_ws(" ", "antecedent", F.concat(F.lit(LABEL), "verdict"))
    return rules.select(name.alias("rule_id"), "antecedent", "rare", "confidence", (F.col("freq") / F.lit(float(max(total, 1)))).alias("support"), "verdict")


def holding(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows with `tokens`, each beside every rule whose whole antecedent it holds: looked up by the rule's rarest token."""
    rules = materialize(rules)
    if rules.count() <= BROADCAST_ROWS:
        rules = F.broadcast(rules)
    return rows.withColumn("rare", F.explode("tokens")).join(rules, "rare").where(F.size(F.array_except("antecedent", "tokens")) == 0)


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined) for the (url, tokens) that hold a rule's whole antecedent: the verdict of the most confident one.

    Ties go to the larger support, then to the longer antecedent, then to the rule's text.
    """
    met = holding(urls, rules)
    best = F.max(F.struct("confidence", "support", F.size("antecedent").alias("n"), "rule_id", "verdict"))
    return met.groupBy("url").agg(best.alias("x")).select("url", F.col("x.verdict").alias("mined"), F.col("x.rule_id").alias("mined_rule"), F.col("x.confidence").alias("confidence"))


def filter_urls(pages: DataFrame, rules: list[Rule], *, url: str = "url", default: str = "allow", min_support: float = 0.002, min_confidence: float = 0.9, **mining: int) -> DataFrame:
    """Add host, path, rule, verdict, mined_rule and confidence to each row of pages; columns of these names are replaced.

    The longest explicit rule that fits decides; else the most confident mined rule; else `default`. Null urls and such
    without :// have empty host and path and get `default`. Repeated rows get equal values. `mining` are options of mine_rules.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "mined_rule", "confidence")
    judged = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    tokens = url_tokens(F.col("host"), F.col("path"))
    mined = mine_rules(judged.select(tokens.alias("tokens"), "fit.verdict"), min_support=min_support, min_confidence=min_confidence, **mining)
    open_urls = judged.where("fit is null").select(F.col(url).alias("url"), "host", "path").distinct().select("url", tokens.alias("tokens"))
    found = match_rules(open_urls, mined).withColumnRenamed("url", "mined_url")
    joined = judged.join(found, (F.col(url) == F.col("mined_url")) & F.col("fit").isNull(), "left")
    return joined.select(
        *pages.columns,
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "mined", F.lit(default)).alias("verdict"),
        F.when(F.col("fit").isNull(), F.col("mined_rule")).alias("mined_rule"),
        F.when(F.col("fit").isNull(), F.col("confidence")).alias("confidence"),
    )
