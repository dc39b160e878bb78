"""Operator 2: URL filter by rules and by empirical-Bayes host reputation.

Labelled pages give each host a beta-binomial posterior of the share of good pages.  Its prior is the
posterior mean of the registered domain, whose prior is that of the suffix, whose prior is the mean
of all labelled pages; the strength of each prior is estimated from the spread below it (Kleinman's
moments).  A host is blocked if its posterior is nearly sure that its good share is below a limit, that is, if
the upper quantile of the beta distribution is below it.
The suffix is the longest one in a list of public suffixes, else the last label; the registered
domain has one label more.  It is DataFrame code, aggregates by host and joins on host, domain and suffix,
besides the beta distribution's chances, one for each host.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import staged

#: A host goes if its good share is below LEAST_GOOD with at least this posterior probability: its quantile is then below, too.
SURE = 0.95
LEAST_GOOD = 0.5
#: Prior strength (in pages) where the spread tells nothing, and its limits.
STRENGTH, STRENGTH_RANGE = 10.0, (1.0, 1000.0)

#: Usual public suffixes of several labels; a caller with the whole public suffix list passes that.
SUFFIXES = [f"{kind}.{land}" for land, kinds in {
    "uk": "co org me ac gov ltd plc net sch nhs", "au": "com net org edu gov id asn", "nz": "co net org ac govt geek school", "za": "co org net ac gov web",
    "jp": "co ne or ac go ad ed gr lg", "kr": "co or ne re pe go ac", "in": "co net org firm gen ind ac gov", "br": "com net org gov edu blog", "ar": "com net org gob edu",
    "mx": "com net org gob edu", "co": "com net org gov edu", "pe": "com net org gob edu", "ve": "com net org gob co", "uy": "com net org gub edu", "ec": "com net org gob edu",
    "cn": "com net org gov edu ac", "hk": "com net org gov edu idv", "tw": "com net org gov edu idv", "sg": "com net org gov edu", "my": "com net org gov edu",
    "ph": "com net org gov edu", "th": "co or ac go in net", "id": "co or ac go web sch", "vn": "com net org gov edu", "tr": "com net org gov edu gen", "il": "co org net ac gov muni",
    "ua": "com net org gov edu", "pl": "com net org gov edu", "ru": "com org net", "es": "com org nom gob edu", "pt": "com org gov edu", "gr": "com net org gov edu",
    "eg": "com net org gov edu", "ng": "com net org gov edu", "ke": "co or ne go ac", "pk": "com net org gov edu", "bd": "com net org gov edu", "sa": "com net org gov edu", "ae": "co net org gov ac",
}.items() for kind in kinds.split()] + ["github.io", "gitlab.io", "blogspot.com", "wordpress.com", "netlify.app", "vercel.app", "pages.dev", "web.app", "herokuapp.com", "appspot.com"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first ``://`` up to /, ?, # with A-Z lowered; then up to ?, #.  Empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_fits(rule: str, host: Column, path: Column) -> Column:
    """``rule`` is a host and the beginning of a path; it fits the host and its subdomains."""
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def _spread(child_prior: str) -> Column:
    """Prior strength from the children's rates around their parent's mean: 1 / rho - 1, within limits."""
    residual = F.sum(F.when(F.col("n") > 0, F.pow(F.col("good") - F.col("n") * F.col(child_prior), 2) / F.col("n")))
    expected = F.sum(F.when(F.col("n") > 0, F.col(child_prior) * (1 - F.col(child_prior))))
    room = F.sum(F.when(F.col("n") > 0, F.col(child_prior) * (1 - F.col(child_prior)) * (F.col("n") - 1)))
    rho = (residual - expected) / room
    strength = F.when((room > 0) & (rho > 0), F.greatest(F.lit(STRENGTH_RANGE[0]), F.least(F.lit(STRENGTH_RANGE[1]), 1 / rho - 1)))
    return F.coalesce(strength, F.when(room > 0, F.lit(STRENGTH_RANGE[1])), F.lit(STRENGTH))


def with_domain(hosts: DataFrame, suffixes: DataFrame | list[str] | None = None) -> DataFrame:
    """``hosts`` (distinct hosts) with ``domain`` and ``suffix``; user names, ports and a last dot are left out.  A numeric address is its own domain.

    ``suffixes``: SUFFIXES if not given; names or a table (suffix) in the form of the public suffix list: lower case, written as
    in hosts; ``*.x`` stands for each label before x, and ``!y.x`` takes y.x out of that.  Suffixes of one label need no entry.
    """
    if not isinstance(suffixes, DataFrame):
        suffixes = hosts.sparkSession.createDataFrame([(x,) for x in (SUFFIXES if suffixes is None else suffixes)], "suffix string")
    plain = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), "[.]?(:[0-9]*)?$", "")
    numeric = plain.rlike("^[0-9.]+$")
    size = F.when(numeric, 0).otherwise(F.size(F.split(plain, "\\.")))
    names = hosts.columns
    tail = lambda n: F.call_function("substring_index", plain, F.lit("."), -n)
    entry = lambda key, n, rank: F.struct(key.alias("key"), rank.alias("rank"), n.alias("labels"))
    forms = F.flatten(F.transform(F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array()), lambda n: F.array(
        entry(tail(n), n, F.lit(0)), entry(F.concat(F.lit("*."), tail(n - 1)), n, F.lit(0)), entry(F.concat(F.lit("!"), tail(n)), n - 1, F.lit(1)))))
    listed = suffixes.select(F.col("suffix").alias("listed")).filter("listed is not null").distinct()
    found = hosts.select("*", F.explode_outer(forms).alias("form")).join(listed, F.col("form.key") == F.col("listed"), "left") \
        .groupBy("host").agg(*[F.first(c).alias(c) for c in names if c != "host"],
                             F.max(F.when(F.col("listed").isNotNull(), F.struct("form.rank", "form.labels"))).alias("best"))
    labels = F.coalesce(F.col("best.labels"), F.lit(1))
    return found.select(*names, F.when(numeric, plain).otherwise(tail(labels + 1)).alias("domain"), tail(labels).alias("suffix"))


def chance_below(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Probability that a beta(a, b) share is below ``limit``, by the continued fraction of the incomplete beta function."""
    logs = np.vectorize(math.lgamma, otypes=[float])
    turned = limit > (a + 1) / (a + b + 2)  # the fraction converges fast on the other side of the mean
    p, q, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - limit, limit)
    tiny = 1e-300
    c, d = np.ones_like(p), 1 / np.where(abs(e := 1 - (p + q) * x / (p + 1)) < tiny, tiny, e)
    whole, m = d.copy(), 0
    while len(p):
        m += 1
        before = whole.copy()
        for step in (m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / np.where(abs(e := 1 + step * d) < tiny, tiny, e)
            c = np.where(abs(e := 1 + step / c) < tiny, tiny, e)
            whole = whole * c * d
        if (abs(whole - before) <= 1e-13 * abs(whole)).all():
            break
    front = np.exp(logs(p + q) - logs(p) - logs(q) + p * np.log(x) + q * np.log1p(-x)) / p if len(p) else p
    return np.where(turned, 1 - front * whole, front * whole)


def reputation(pages: DataFrame, outcomes: DataFrame, suffixes: DataFrame | list[str] | None = None) -> DataFrame:
    """(host, mean, doubt) of every host of ``pages`` (page_id, host): posterior mean and P(share < LEAST_GOOD), from ``outcomes`` (page_id, good 0/1; null ids or goods don't count)."""
    labelled = pages.join(outcomes.filter("good is not null"), "page_id").groupBy("host") \
        .agg(F.count("*").cast("double").alias("n"), F.sum(F.col("good").cast("double")).alias("good"))
    counted = pages.select("host").distinct().join(labelled, "host", "left").fillna(0.0, ["n", "good"])
    hosts = staged(with_domain(counted, suffixes), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    overall = suffixes.agg(F.sum("good") / F.nullif(F.sum("n"), F.lit(0.0))).first()[0]

    def shrunk(children: DataFrame) -> DataFrame:
        """Children with their prior's strength (one number for a level) and their posterior mean."""
        strength = children.agg(_spread("prior")).first()[0]
        return children.withColumn("strength", F.lit(strength)) \
            .withColumn("mean", (F.col("prior") * F.col("strength") + F.col("good")) / (F.col("strength") + F.col("n")))

    by_suffix = shrunk(suffixes.withColumn("prior", F.lit(LEAST_GOOD if overall is None else overall))).select("suffix", F.col("mean").alias("prior"))
    by_domain = shrunk(domains.join(by_suffix, "suffix")).select("suffix", "domain", F.col("mean").alias("prior"))
    by_host = shrunk(hosts.join(by_domain, ["suffix", "domain"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mean, total = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mean", "total"))
            doubt = (mean <= 0).astype(float)  # a share of 0 or 1 for sure
            some = (mean > 0) & (mean < 1)
            doubt[some] = chance_below(mean[some] * total[some], (1 - mean[some]) * total[some], LEAST_GOOD)
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("mean"), pa.array(doubt)], ["host", "mean", "doubt"])

    return by_host.select("host", "mean", (F.col("strength") + F.col("n")).alias("total")).mapInArrow(run, "host string, mean double, doubt double")


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], suffixes: DataFrame | list[str] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url).

    The longest fitting rule decides; else the host's reputation.  Null urls and urls without ``://``
    have empty host and path and share the reputation of the empty host.  Without any outcome all
    hosts stay.  ``suffixes``: see ``with_domain``.  Repeated rows stay repeated; an empty table gives an empty table; other columns are not read.
    """
    host, path = url_parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    fitting = [(F.lit(r), F.lit(v), rule_fits(r, F.col("host"), F.col("path"))) for r, v in sorted(rules, key=lambda x: -len(x[0]))]
    none = F.lit(None).cast("string")
    first = lambda k: reduce(lambda rest, f: F.when(f[2], f[k]).otherwise(rest), reversed(fitting), none)
    known = reputation(split.select("page_id", "host"), outcomes, suffixes).select(F.col("host").alias("of"), (F.col("doubt") >= SURE).alias("bad"))
    return split.join(known, split.host == known.of, "left") \
        .select("page_id", "host", "path", first(0).alias("rule"), F.coalesce(first(1), F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
