"""URL filters: association rules mined by FP-growth from labelled URLs, after a list of fixed rules."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import settle

#: (verdict, host, path) in the order of the list; the longest that fits wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MIN_SUPPORT = 0.004
MIN_CONFIDENCE = 0.6
#: A rule rests on so many bad pages at least.
MIN_COUNT = 5
#: The expected share of rules that are none: of all mined combinations, those are kept whose
#: share of bad pages would be so rare by chance that no more than this share of them is wrong.
FALSE_SHARE = 0.05
_BAD = "label=block"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))


def tokens_of(url: Column) -> Column:
    """The distinct words of the lower-cased URL; number words count as one token."""
    parts = F.split(F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER), "[^\\p{L}\\p{N}]+")
    return F.array_distinct(F.transform(F.filter(parts, lambda t: t != ""), lambda t: F.when(t.rlike("^[0-9]+$"), F.lit("0")).otherwise(t)))


def fixed_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does. A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def mine(
    labelled: DataFrame, url: str, bad: str, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT, false_share: float = FALSE_SHARE
) -> DataFrame:
    """Rules (words, confidence, support): the token combinations that imply a bad label.

    ``bad`` is a boolean column, null where there is no label. All labelled rows are mined. Every
    frequent combination is tested: the chance that so many of its pages are bad, were the bad
    ones dealt at random (a hypergeometric tail). Benjamini and Hochberg's procedure over all
    of them sets the greatest chance that is accepted, so the threshold follows from the data and
    from how much was tried. Words that all rows have tell nothing and are left out. A rule is
    left out if a part of it has at least its confidence. Rules stay distributed: they are pruned
    by a join on the rarest word of the possible part. Without a bad row there are none.
    """
    known = labelled.where(F.col(bad).isNotNull())
    n, n_bad = known.agg(F.count(F.lit(1)), F.count_if(bad)).first()
    if n_bad < min_count:
        return labelled.sparkSession.createDataFrame([], "words array<string>, confidence double, support double")
    words = known.select(tokens_of(F.col(url)).alias("words"), F.col(bad).alias("bad"))
    # at most as many as one URL has
    everywhere = [r["word"] for r in words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n).collect()]
    telling = F.array_except("words", F.array(*[F.lit(w) for w in everywhere]).cast("array<string>"))
    items = words.select(F.when(F.col("bad"), F.concat(telling, F.array(F.lit(_BAD)))).otherwise(telling).alias("items"))
    # half a row below the count, so that rounding does not lose a set that has just the count
    least = max(min_support, (min_count - 0.5) / n)
    sets = settle(FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(items).freqItemsets, "url-sets")
    tried = sets.where(~F.array_contains("items", _BAD)).select(F.array_sort("items").alias("words"), F.col("freq").alias("of"))
    hits = sets.where(F.array_contains("items", _BAD)).select(F.array_sort(F.array_remove("items", _BAD)).alias("words"), F.col("freq").alias("hits"))
    tested = settle(with_chance(tried.join(hits, "words", "left"), n, n_bad), "url-tests")
    most = greatest_chance(tested, false_share)
    found = tested.where((F.col("chance") <= most) & (F.col("hits") >= min_count)).select("words", (F.col("hits") / F.col("of")).alias("confidence"), (F.col("hits") / n).alias("support"))
    found = found.where(F.col("confidence") >= min_confidence)
    parts = _by_rarest(found).select("_word", F.col("words").alias("_part"), F.col("confidence").alias("_confidence"))
    wider = found.select("words", "confidence", F.explode("words").alias("_word")).join(parts, "_word")
    wider = wider.where((F.size("_part") < F.size("words")) & (F.col("_confidence") >= F.col("confidence")) & (F.size(F.array_except("_part", "words")) == 0))
    return found.join(wider.select("words"), "words", "left_anti")


def chance(hits: int, of: int, bad: int, n: int) -> float:
    """How likely at least ``hits`` of ``of`` rows are bad, if ``bad`` of n rows are, dealt at random; 1 where the share is no higher than among all."""
    if hits * n <= bad * of:
        return 1.0
    last = min(of, bad)
    log = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    term = math.exp(log(bad, hits) + log(n - bad, of - hits) - log(n, of)) if of - hits <= n - bad else 0.0
    total, i = 0.0, hits
    # above the mean the terms fall faster and faster
    while i <= last and term > total * 1e-17:
        total += term
        term *= (bad - i) * (of - i) / ((i + 1) * (n - bad - of + i + 1))
        i += 1
    return min(1.0, total)


def with_chance(tried: DataFrame, n: int, n_bad: int) -> DataFrame:
    """(words, of, hits, chance); null hits are too few to have been mined and count as chance 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("hits").to_pylist(), batch.column("of").to_pylist(), strict=True)
            chances = pa.array([1.0 if h is None else chance(h, of, n_bad, n) for h, of in pairs], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, chances], names=["words", "of", "hits", "chance"])

    return tried.select("words", "of", "hits").mapInArrow(run, "words array<string>, of long, hits long, chance double")


def greatest_chance(tested: DataFrame, false_share: float) -> float:
    """Benjamini and Hochberg's threshold: the greatest t with t <= false_share * (tests at or below t) / tests.

    Found from above: each pass counts the tests below the last threshold, which can only fall.
    """
    n, most = tested.count(), false_share
    while n:
        below = tested.where(F.col("chance") <= most).count()
        tighter = false_share * below / n
        if tighter >= most:
            break
        most = tighter
    return most


def _by_rarest(rules: DataFrame) -> DataFrame:
    """The rules with the word, as _word, that the fewest of them have."""
    uses = rules.select(F.explode("words").alias("_word")).groupBy("_word").agg(F.count(F.lit(1)).alias("_uses"))
    index = rules.select("words", "confidence", F.explode("words").alias("_word")).join(uses, "_word")
    index = index.groupBy("words").agg(F.min(F.struct("_uses", "_word")).alias("_least"), F.first("confidence").alias("confidence"))
    return index.select("words", "confidence", F.col("_least._word").alias("_word"))


def match(urls: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """(url, words) of every distinct url and rule whose words it all has.

    The inverted index holds each rule under its rarest word, so common words such as a
    scheme do not join; Catalyst broadcasts the rules where their size is below its threshold.
    """
    distinct = urls.select(F.col(url).alias("_url")).distinct().withColumn("_tokens", tokens_of(F.col("_url")))
    hits = distinct.select("_url", "_tokens", F.explode("_tokens").alias("_word")).join(_by_rarest(rules), "_word")
    return hits.where(F.size(F.array_except("words", "_tokens")) == 0).select(F.col("_url").alias(url), "words")


def filter_urls(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", rules: tuple = RULES) -> DataFrame:
    """(key, url, host, path, rule, verdict, n_rules) of every page.

    labels: (key, bad boolean). The verdict is that of the longest fixed rule, else block if a
    mined rule matches, else allow. Null URLs have an empty host and path, no rule, and are
    allowed; repeated rows and keys come back as they are, and a repeated URL is judged once.
    A null key has no label; of several labels of a key the worse counts.
    """
    rows = pages.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"))
    marks = labels.select(F.col(key).alias("_of"), F.col("bad").alias("_bad")).groupBy("_of").agg(F.max("_bad").alias("_bad"))
    mined = mine(rows.join(marks, F.col("_key") == F.col("_of")), "_url", "_bad")
    hits = match(rows, "_url", mined).groupBy(F.col("_url").alias("_hit")).agg(F.count(F.lit(1)).alias("n_rules"))
    rows = rows.join(hits, F.col("_url") == F.col("_hit"), "left")
    host, path = host_of(F.col("_url")), path_of(F.col("_url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    return rows.select(
        F.col("_key").alias(key),
        F.col("_url").alias(url),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("n_rules") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("n_rules", F.lit(0)).alias("n_rules"),
    )
