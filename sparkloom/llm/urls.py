"""URL filters: rules mined by FP-growth from labelled URLs, matched by an inverted index, under rules given by hand.

A labelled URL is a set of tokens (its host's suffixes, path folders, extension, parameter names) and its mark. FP-growth
finds token sets with enough support; association rules from tokens to the mark `block` with enough confidence are kept,
unless a rule with a subset of its tokens is as confident. A rule is posted under its least frequent token; a URL looks
up its own tokens there, and a rule fires if the URL has all of its tokens. A rule given by hand goes before.

Defined results: a null url, or one without `://`, has an empty host and path, no tokens and is allowed; repeated rows
are judged alike; labels without a URL are left out, so are those of pages without a page_id, which are judged like others; without labels nothing is mined and all is allowed but by hand; of
several rules that fire the most confident is named, of those the last by its tokens; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import join_hot, settle

#: (host, path, verdict)
GIVEN = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Share of labelled URLs that a mined rule is right about at least, how many these are at least (a share of a small table
#: is no evidence), the rule's confidence, and how far that lies above the average.
SUPPORT, LEAST, CONFIDENCE, LIFT = 0.01, 10, 0.75, 1.3
BLOCK = "=block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """All of a URL's tokens: host suffixes, folders with their depth, extension, parameter names; numbers are masked."""
    labels = F.reverse(F.split(host_of(url), r"\."))
    suffixes = F.transform(labels, lambda x, i: F.concat(F.lit("h:"), F.array_join(F.reverse(F.slice(labels, 1, i + 1)), ".")))
    folders = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    folders = F.transform(folders, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), F.regexp_replace(x, r"[0-9]+", "0")))
    ending = F.regexp_extract(path_of(url), r"\.([A-Za-z0-9]{1,8})$", 1)
    names = F.regexp_extract_all(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), 1)
    names = F.transform(names, lambda x: F.concat(F.lit("q:"), x))
    out = F.concat(suffixes, folders, names, F.array(F.concat(F.lit("e:"), ending), F.when(F.instr(url, "#") > 0, F.lit("f:")).otherwise(F.lit("e:"))))
    return F.when(F.instr(url, "://") > 0, F.array_distinct(F.filter(out, lambda x: ~x.isin("e:", "h:")))).otherwise(F.array().cast("array<string>"))


def mine_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, least: int = LEAST) -> DataFrame:
    """url, bad -> rules (tokens, confidence, support), no rule with a subset that is as confident. A rule is right about
    `support` of the labelled URLs and about `least` of them.

    Support bounds the number of frequent tokens: with n tokens a URL on average, n / support. Of a host's suffixes the
    longest in a set implies the others, which say nothing more, so sets hold one suffix at most: sets without a host are
    mined on the other tokens, those with one on a copy of the URL for each suffix. What is left is not bounded by length: k
    frequent tokens of different kinds that stand together in enough URLs make 2^k sets.
    """
    host = lambda t: t.startswith("h:")
    marked = labelled.select("bad", tokens_of(F.col("url")).alias("tokens"))
    n, n_bad = marked.agg(F.count("*"), F.count_if("bad")).head()
    none = labelled.sparkSession.createDataFrame([], "tokens array<string>, confidence double, support double")
    if n < least or not n_bad:
        return none
    mark = F.when(F.col("bad"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))
    others = F.concat(F.filter("tokens", lambda t: ~host(t)), mark)
    need = max(math.ceil(support * n - 1e-9), least, 1)

    def mined(items: DataFrame, with_host: bool) -> DataFrame:
        total = items.count()
        if total < need:
            return none
        #: half a URL less, so that rounding can't ask for one more
        model = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / total, minConfidence=confidence).fit(items)
        fits = (F.element_at("consequent", 1) == BLOCK) & (F.col("confidence") * n >= lift * n_bad) & (F.exists("antecedent", host) == F.lit(with_host))
        return model.associationRules.where(fits).select(F.array_sort("antecedent").alias("tokens"), "confidence", (F.col("support") * (total / n)).alias("support"))

    each = marked.select(others.alias("others"), F.explode(F.filter("tokens", host)).alias("h"))
    rules = mined(marked.select(others.alias("items")), False).unionByName(mined(each.select(F.array_append("others", F.col("h")).alias("items")), True))
    smaller = rules.select(F.col("tokens").alias("t"), F.col("confidence").alias("c"))
    #: rules share a token with each of their subsets: an equi-join on it
    pairs = rules.select("tokens", "confidence", F.explode("tokens").alias("k")).join(smaller.select("t", "c", F.explode("t").alias("k")), "k")
    beaten = pairs.where((F.size("t") < F.size("tokens")) & (F.size(F.array_except("t", "tokens")) == 0) & (F.col("c") >= F.col("confidence"))).select("tokens").distinct()
    return rules.join(beaten, "tokens", "left_anti")


def given_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = GIVEN) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None)
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def urls_of(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("url").cast("string").alias("url")).where("url IS NOT NULL")


def filter_urls(pages: DataFrame, mined: DataFrame, rules: Sequence[tuple[str, str, str]] = GIVEN) -> DataFrame:
    """page_id, url -> page_id, host, path, rule, verdict, mined_rule (tokens of the most confident mined rule that fires).

    A URL has few tokens, so it meets few rules; equal URLs are looked up once.
    """
    url = F.col("url").cast("string")
    urls = urls_of(pages).distinct()
    #: the least frequent token is that of the rules which fewest rules have; ties by the token
    posted = mined.select("tokens", "confidence", F.explode("tokens").alias("t"))
    many = posted.groupBy("t").count()
    index = posted.join(many, "t").groupBy("tokens", "confidence").agg(F.min_by("t", F.struct("count", "t")).alias("t"))
    found = urls.select("url", tokens_of(F.col("url")).alias("own")).withColumn("t", F.explode("own")).join(index, "t").where(F.size(F.array_except("tokens", "own")) == 0)
    fired = found.groupBy("url").agg(F.max_by("tokens", F.struct("confidence", "tokens")).alias("mined_rule"))
    given = given_rule(host_of(url), path_of(url), rules)
    #: pages are told by their url; one that a great part of them have is dealt to many tasks
    fired = settle(urls_of(pages).groupBy("url").agg(F.count("*").alias("__n")).join(fired, "url"))
    out = join_hot(pages.select("page_id", url.alias("url")), fired, ["url"], F.col("page_id"), "left").withColumn("given", given)
    learned = F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("given.rule").alias("rule"), F.coalesce(F.col("given.verdict"), learned).alias("verdict"), F.array_join("mined_rule", " ").alias("mined_rule"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, bad: pages whose id is labelled; bad if the quality is 0 or the text toxic."""
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    bad = (F.coalesce(F.col("q"), F.lit(1)) == 0) | (F.coalesce(F.col("t"), F.lit(0)) == 1)
    return pages.where(F.col("url").isNotNull()).select("page_id", F.col("url").cast("string").alias("url")).join(marks, "page_id").select("url", bad.alias("bad"))
