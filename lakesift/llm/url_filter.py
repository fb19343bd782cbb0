"""URL filters: allow and block rules, and gradient-boosted trees for the rest
(native DataFrame expressions and Spark's own tree learner only).

Rules name a host (with all its subdomains) and a path prefix; the longest
that fits decides.  Labelled urls are those whose host has a listed word
(block) and those that a rule allows or blocks.  A listed word decides where no
rule does; the trees are trained on lexical features of a bounded sample of the
labelled urls and judge every other url.  They block only from ``BLOCK_SCORE``
on, as a clean site lost costs more than a bad one kept.

Features: lengths, depth, digit ratio, character entropy, parameter counts,
labels of the host, and smoothed block rates of the host's last and last two
labels among all labelled urls (host suffix statistics).  Words that make
labels are no features, or the trees would learn nothing but them.  A url of
the sample has the rates of the half of the labelled urls that it isn't in:
leaving out its own label alone would tell the label by the difference.

Edge cases: a null url or one without ``://`` has empty host and path, fits no
rule and is judged by its (empty) features; repeated rows are judged alike;
with labelled urls of one verdict only, that is the verdict, with none it is
``allow``; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import lower_ascii, small_side, staged

#: Labelled urls that the trees are trained on, about, at most (distinct urls).
SAMPLE_URLS = 10_000
#: Weight of the labelled urls' block rate in that of a suffix, in urls; an
#: unknown suffix has that rate.
PRIOR_URLS = 10
#: Bytes of a suffix and its rates when broadcast.
RATE_ROW_BYTES = 200
_HASHES = 1 << 30

#: Probability from which the trees block.
BLOCK_SCORE = 0.8

# Words of a host that label it as blocked.
BLOCKED_WORDS = (
    "adult", "ads", "adserver", "bet", "bets", "betting", "casino", "escort", "gambling", "jackpot", "lottery", "pharmacy",
    "phishing", "pills", "poker", "porn", "sex", "slots", "spam", "tracker", "viagra", "warez", "xxx",
)

FEATURES = (
    "length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "query_length",
    "has_fragment", "hyphens", "host_labels", "longest_segment", "last_rate", "last_two_rate",
)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(lines: list[str]) -> list[Rule]:
    """Rules from lines like ``block example.org/es/``; longest first."""
    out = []
    for line in lines:
        verdict, target = line.split()
        host, slash, path = target.partition("/")
        out.append(Rule(verdict, host, slash + path))
    return sorted(out, key=lambda r: (-len(r.text), r.text, r.verdict))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), "^[\\s\\S]*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^[\\s\\S]*?://[^/?#]*([^?#]*)", 1)


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))


def decided(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The rule that decides (its text) and its verdict; null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(rules):
        text = F.when(_fits(r, host, path), F.lit(r.text)).otherwise(text)
        verdict = F.when(_fits(r, host, path), F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _array(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def blocked_words(host: Column) -> Column:
    """Number of listed words in a host."""
    return F.size(F.array_intersect(F.split(host, "[^a-z0-9]+"), _array(BLOCKED_WORDS)))


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.char_length(text)

    def term(total, c):
        p = (n - F.char_length(F.replace(text, c, F.lit("")))) / n
        return total - p * F.log2(p)

    chars = F.array_remove(F.array_distinct(F.split(text, "")), "")
    return F.when(n > 0, F.aggregate(chars, F.lit(0.0), term)).otherwise(F.lit(0.0))


def _half(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("half"), F.coalesce(url, F.lit(""))), F.lit(2))


def suffix_rates(labelled: DataFrame) -> tuple[DataFrame, int, float]:
    """(kind, suffix, rate, rate_0, rate_1), their number, and the block rate of
    all labelled urls: rates over all distinct labelled urls (url, host, label),
    and for each half of them the rate over the other half."""
    at, bad = _half(F.col("url")), F.col("label")
    urls = labelled.select("url", "host", "label").distinct()
    suffixes = urls.select(bad, at.alias("half"), F.explode(F.array(*(
        F.struct(F.lit(kind).alias("kind"), _suffix(F.col("host"), n).alias("suffix"))
        for kind, n in (("last", 1), ("last_two", 2))))).alias("s")).select("label", "half", "s.*")
    sums = staged(suffixes.groupBy("kind", "suffix").agg(*(
        F.sum(F.when(F.col("half") == half, what).otherwise(0.0)).alias(f"{name}_{half}")
        for half in (0, 1) for name, what in (("n", F.lit(1.0)), ("bad", bad)))), "url-suffixes")
    total = sums.where("kind = 'last'").agg(F.sum(F.expr("bad_0 + bad_1")), F.sum(F.expr("n_0 + n_1"))).first()
    base = total[0] / total[1]

    def rate(bad: str, n: str) -> Column:
        return (F.expr(bad) + PRIOR_URLS * base) / (F.expr(n) + PRIOR_URLS)

    rates = sums.select("kind", "suffix", rate("bad_0 + bad_1", "n_0 + n_1").alias("rate"),
                        rate("bad_1", "n_1").alias("rate_0"), rate("bad_0", "n_0").alias("rate_1"))
    return rates, sums.count(), base


def lexical(df: DataFrame, rates: DataFrame, n_rates: int, base: float, train: bool = False) -> DataFrame:
    """``df`` (url, host, path) with the feature columns; for training with the
    suffix rates of the other half of the labelled urls."""
    text = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(text, "\\?([^#]*)", 1)
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    length = F.char_length(text)
    df = df.withColumns({
        "last": _suffix(F.col("host"), 1), "last_two": _suffix(F.col("host"), 2),
        "length": length, "host_length": F.char_length("host"), "path_length": F.char_length("path"),
        "depth": F.size(segments),
        "digit_ratio": F.when(length > 0, F.regexp_count(text, F.lit("[0-9]")) / length).otherwise(F.lit(0.0)),
        "entropy": _entropy(text),
        "parameters": F.size(F.filter(F.split(query, "[&;]"), lambda s: s != "")),
        "query_length": F.char_length(query), "has_fragment": F.contains(text, F.lit("#")).cast("int"),
        "hyphens": F.regexp_count(text, F.lit("[-_]")), "host_labels": F.size(F.split("host", "\\.")),
        "longest_segment": F.coalesce(F.array_max(F.transform(segments, F.char_length)), F.lit(0)),
    })
    known = F.when(_half(F.col("url")) == 0, F.col("rate_0")).otherwise(F.col("rate_1")) if train else F.col("rate")
    for name in ("last", "last_two"):
        side = rates.where(F.col("kind") == name).select(F.col("suffix").alias(name), "rate", "rate_0", "rate_1")
        df = df.join(small_side(side, n_rates, RATE_ROW_BYTES), name, "left").withColumn(
            f"{name}_rate", F.coalesce(known, F.lit(base))).drop("rate", "rate_0", "rate_1")
    return df


def labelled_of(urls: DataFrame) -> DataFrame:
    """(url, host, path, label): the urls that a rule or a listed word labels."""
    listed = blocked_words(F.col("host")) > 0
    label = (listed | F.coalesce(F.col("verdict") == "block", F.lit(False))).cast("double").alias("label")
    return urls.where(F.col("rule").isNotNull() | listed).select("url", "host", "path", label)


def sample_of(labelled: DataFrame, limit: int) -> DataFrame:
    """About ``limit`` distinct labelled urls at most, by hash."""
    n = labelled.agg(F.approx_count_distinct("url")).first()[0]
    part = min(_HASHES, _HASHES * limit // max(n, 1))
    return labelled.where(F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(_HASHES)) < part).distinct()


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url",
                sample_urls: int = SAMPLE_URLS) -> DataFrame:
    """Per row: id, ``host``, ``path``, ``rule``, ``verdict`` and ``block_score``
    (the trees' probability; null where a rule decides).  A listed word blocks
    where no rule decides, whatever the trees say."""
    host, path = F.col("host"), F.col("path")
    rule, verdict = decided(rules, host, path)
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    urls = urls.withColumns({"rule": rule, "verdict": verdict})

    labelled = labelled_of(urls)
    sample = staged(sample_of(labelled, sample_urls), "url-sample")
    labels = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(labels) < 2:
        only = "block" if labels.get(1.0) else "allow"
        return urls.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(only)).alias("verdict"),
                           F.lit(None).cast("double").alias("block_score"))

    rates, n_rates, base = suffix_rates(labelled)
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    # the sample is bounded and ordered, so the trees are the same in every run
    train = vector.transform(lexical(sample, rates, n_rates, base, train=True)).orderBy("url").select("features", "label").coalesce(1)
    trees = GBTClassifier(maxIter=15, maxDepth=4, stepSize=0.3, seed=17, subsamplingRate=1.0).fit(train)
    rest = vector.transform(lexical(urls, rates, n_rates, base))
    scored = trees.transform(rest).select(
        "id", "host", "path", "rule", "verdict", F.element_at(_probability("probability"), 2).alias("p"))
    bad = (blocked_words(host) > 0) | (F.col("p") >= BLOCK_SCORE)
    return scored.select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("p")).alias("block_score"))


def _probability(name: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(name))
