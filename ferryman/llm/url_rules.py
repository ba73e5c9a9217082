"""URL filter: fixed host/path rules, else association rules mined from labels.

*Fixed rules.* A rule fits its host and all subdomains if the path starts with the rule's
path; the longest wins.

*Mined rules.* Spark's FP-growth mines combinations of URL tokens (scheme, host, host names,
path words, file ending, query keys, fragment) together with the label of the page. A page is
labelled if the last number in its path (not in host, query or fragment) is a labelled document:
``block`` if that is toxic or of low quality. Rules "tokens -> block" are kept above a support, a confidence and a lift, and
if no rule with fewer of their tokens is as sure. They are matched by an inverted index: each
rule is filed under its rarest token, and a URL looks up its own tokens only.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; path: then up
to ``?``, ``#`` or end. Defined cases: a null url or one without ``://`` has empty host and path
and, as no mined rule speaks against it, the verdict allow; repeated rows are judged alike;
without labels no rule is mined; further columns are not read.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from .tables import drop, keep

#: fixed values: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.005, 0.5, 1.2
#: a rule rests on at least so many labelled pages, however few there are
MIN_PAGES = 20
BLOCK, ALLOW = "=block", "=allow"


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host, path and tail (query and fragment)."""
    at = F.locate("://", F.col("url"))
    rest = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    out = pages.withColumn("rest", rest)
    out = out.withColumn("host", F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase))
    out = out.withColumn("path", F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1))
    return out.withColumn("tail", F.regexp_extract("rest", r"(?s)^[^?#]*(.*)$", 1)).drop("rest")


def fixed_rule(rules=RULES):
    """(rule, verdict) as a column; null where no rule fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens():
    """Distinct tokens of a URL, numbers left out, so that URLs of one make share them."""
    names = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("name:"), x))
    words = F.transform(F.filter(F.split("path", r"[/._-]+"), lambda x: (x != "") & ~x.rlike("^[0-9]+$")), lambda x: F.concat(F.lit("path:"), x))
    keys = F.transform(F.regexp_extract_all("tail", F.lit(r"[?&]([^=&#]+)"), 1), lambda x: F.concat(F.lit("query:"), x))
    rest = F.array(F.concat(F.lit("host:"), "host"), F.concat(F.lit("scheme:"), F.coalesce(F.regexp_extract("url", r"^([^:]*)://", 1), F.lit(""))))
    mark = F.when(F.col("tail").contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(names, words, keys, rest, mark)))


def mine(pages: DataFrame, labels: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, lift: float = MIN_LIFT) -> DataFrame:
    """rule_id, tokens, confidence, support of the rules "tokens -> block"."""
    number = F.expr("try_cast(try_element_at(regexp_extract_all(path, '[0-9]+', 0), -1) as bigint)")
    bad = F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad")
    label = labels.groupBy("doc_id").agg(bad)
    baskets = pages.withColumn("doc_id", number).join(label, "doc_id").select(F.array_append("tokens", F.when(F.col("bad") == 1, BLOCK).otherwise(ALLOW)).alias("items"))
    baskets = keep(baskets, "baskets")
    n = baskets.count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, (MIN_PAGES - 0.5) / max(n, 1))), minConfidence=confidence).fit(baskets)
    rules = model.associationRules.filter((F.col("consequent") == F.array(F.lit(BLOCK))) & (F.col("support") * n > MIN_PAGES - 1) & (F.col("lift") >= lift))
    rules = keep(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "mined-rules")
    # a rule goes if one with some of its tokens only is as sure: it has the token that the shorter is filed under
    short = rules.select(F.explode("tokens").alias("token"), F.col("tokens").alias("fewer"), F.col("confidence").alias("sure")).filter(F.col("token") == F.element_at("fewer", 1))
    wide = rules.select("tokens", "confidence", F.explode("tokens").alias("token"))
    beaten = wide.join(short, "token").filter((F.size("fewer") < F.size("tokens")) & (F.size(F.array_except("fewer", "tokens")) == 0) & (F.col("sure") >= F.col("confidence"))).select("tokens").distinct()
    kept = keep(rules.join(beaten, "tokens", "left_anti").withColumn("rule_id", F.xxhash64("tokens")), "rules")
    drop(pages.sparkSession, baskets, rules)
    return kept


def matches(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens of the sets that hold all tokens of a rule, with the surest rule's confidence, by inverted index."""
    posting = token_sets.select("tokens", F.explode("tokens").alias("token"))
    frequency = posting.join(rules.select(F.explode("tokens").alias("token")).distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    filed = rules.select("rule_id", "confidence", F.col("tokens").alias("need"), F.explode("tokens").alias("token")).join(frequency, "token")
    index = filed.groupBy("rule_id", "need", "confidence").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    hit = posting.join(index, "token").filter(F.size(F.array_except("need", "tokens")) == 0)
    return hit.groupBy("tokens").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence (of the surest mined rule that fits, else null) of every row."""
    spark = pages.sparkSession
    parts = with_parts(pages.select("page_id", "url")).withColumn("tokens", tokens())
    mined = mine(parts.select("path", "tokens"), labels)
    found = keep(matches(parts.select("tokens").distinct(), mined), "rule-matches")
    drop(spark, mined)
    out = parts.join(found, "tokens", "left").withColumn("fixed", fixed_rule(rules))
    method = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", method).alias("verdict"), "confidence")
