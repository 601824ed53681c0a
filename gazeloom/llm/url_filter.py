"""URL filters: rules first, then logistic regression on hashed character n-grams.

``parts`` splits a URL into host and path, ``rule_of`` finds the longest fitting rule,
and a model fitted on a small labelled URL table judges what no rule decides. Features
are the distinct character n-grams of host and path, each marked with its side and
hashed to ``FEATURES`` numbers; everything is built-in functions and ``pyspark.ml``.

Fitting reads each distinct labelled URL once, at most about ``max_labelled`` of them
(chosen by a hash of host and path, so retries read the same ones), in one sorted
partition: the result doesn't depend on how the table was dealt out.

Edge cases: a URL that is null or has no ``://`` has an empty host and path, and the
model judges it by its bias; a path is compared as it stands (case, escapes); ports and
user names stay part of the host; of rules of one length the first given wins; of
contradicting labels of one URL ``block`` counts; without labels of both kinds all get
the only label known, ``allow`` if there is none; an empty table gives no rows; columns
named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import free_name

ALLOW, BLOCK = "allow", "block"
ORDERS = (3, 4)
FEATURES = 1 << 14
MAX_LABELLED = 4000
#: First ``://``; host up to a slash, question mark or hash; path up to the latter two.
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, below a path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(whole, _SPLIT, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(whole, _SPLIT, 2)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null where none does."""
    name = verdict = F.lit(None).cast("string")
    # what is looked at last wins: ascending by length, of one length the first given last
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def grams(host: Column, path: Column, orders: Sequence[int] = ORDERS) -> Column:
    """Distinct character n-grams of host and path, marked by side; a full stop ends the host on both sides."""
    sides = (("h", F.concat(F.lit("."), host, F.lit("."))), ("p", path))

    # a look-ahead matches at every character, so one pass finds overlapping n-grams
    def found(side: str, whole: Column, n: int) -> Column:
        return F.transform(F.regexp_extract_all(whole, F.lit(rf"(?s)(?=(.{{{n}}}))"), 1), lambda g: F.concat(F.lit(f"{side}{n}"), g))

    return F.array_distinct(F.concat(*[found(side, whole, n) for side, whole in sides for n in orders]))


@dataclass
class UrlModel:
    """A fitted model, or the one verdict that is known."""

    regression: LogisticRegressionModel | None
    otherwise: str
    orders: Sequence[int]
    features: int


def _hashed(df: DataFrame, grams_col: str, out: str, features: int) -> DataFrame:
    return HashingTF(inputCol=grams_col, outputCol=out, numFeatures=features, binary=True).transform(df)


def fit(labelled: DataFrame, url: str = "url", verdict: str = "verdict", max_labelled: int = MAX_LABELLED, orders: Sequence[int] = ORDERS, features: int = FEATURES, penalty: float = 1e-3) -> UrlModel:
    """Fit on a labelled URL table (``verdict`` allow or block; other values are left out)."""
    host, path = parts(F.col(url))
    known = labelled.where(F.col(verdict).isin(ALLOW, BLOCK)).groupBy(host.alias("host"), path.alias("path")).agg(F.max((F.col(verdict) == BLOCK).cast("double")).alias("label"))
    share = min(1.0, max_labelled / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("host", "path"), F.lit(1 << 20)) < share * (1 << 20))
    rows = chosen.select("label", "host", "path", grams(F.col("host"), F.col("path"), orders).alias("grams")).orderBy("host", "path").coalesce(1)
    kinds = [r["label"] for r in chosen.select("label").distinct().collect()]
    if len(kinds) < 2:
        return UrlModel(None, BLOCK if kinds == [1.0] else ALLOW, orders, features)
    return UrlModel(LogisticRegression(regParam=penalty, standardization=False, maxIter=100).fit(_hashed(rows, "grams", "features", features)), ALLOW, orders, features)


def judge(df: DataFrame, model: UrlModel, rules: Sequence[Rule] = (), url: str = "url") -> DataFrame:
    """Add ``host, path, rule, verdict string``: the rule's verdict, else the model's. Columns of these names are replaced."""
    names = ["host", "path", "rule", "verdict"]
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    host, path = parts(F.col(f"`{url}`"))
    rule, ruled = (free_name(df, c) for c in ("rule_name", "rule_verdict"))
    split = df.select(*kept, host.alias("host"), path.alias("path"))
    found, decided = rule_of(F.col("host"), F.col("path"), rules)
    split = split.select("*", found.alias(rule), decided.alias(ruled))
    if model.regression is None:
        verdict = F.lit(model.otherwise)
    else:
        made, vector, raw, odds, guess = (free_name(df, c) for c in ("url_grams", "url_features", "url_raw", "url_probability", "url_guess"))
        # only what no rule decides needs features
        open_grams = F.when(F.col(ruled).isNull(), grams(F.col("host"), F.col("path"), model.orders)).otherwise(F.array().cast("array<string>"))
        scored = _hashed(split.withColumn(made, open_grams), made, vector, model.features)
        regression = model.regression.copy()
        for setter, name in ((regression.setFeaturesCol, vector), (regression.setRawPredictionCol, raw), (regression.setProbabilityCol, odds), (regression.setPredictionCol, guess)):
            setter(name)
        split = regression.transform(scored)
        verdict = F.when(F.col(guess) == 1, BLOCK).otherwise(ALLOW)
    return split.select(*kept, "host", "path", F.col(rule).alias("rule"), F.coalesce(ruled, verdict).alias("verdict"))
