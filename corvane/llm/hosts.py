"""Host reputation by empirical Bayes, in DataFrame functions only.

A page's outcome is bad or good where its document is labelled. Rates of bad
outcomes are shrunk through beta-binomial priors: the corpus is the prior of a
public suffix, the suffix of a registered domain, the domain of a host. Each
level's prior strength is its intra-class correlation by the method of moments.
Levels are those of the name alone, without user and port. A public suffix is
the last label; a registry's second-level label and a country's; or the name of
a service whose customers have subdomains. An IPv4 address is a level of its
own throughout.
A host is blocked where the lower bound of its posterior rate lies above a
limit; rules on host suffix and path prefix come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.skew import join_hot
from corvane.storage import materialize

#: Labels under which registries of countries give out names, and services that give out subdomains.
SECOND = ("ac", "co", "com", "edu", "gen", "go", "gob", "gov", "govt", "gouv", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
SERVICES = ("appspot.com", "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "tumblr.com", "vercel.app", "web.app", "wordpress.com")
_LONG = rf"(^|\.)(({'|'.join(SECOND)})\.[a-z][a-z]|{'|'.join(s.replace('.', chr(92) + '.') for s in SERVICES)})$"
_ADDRESS = r"^[0-9]+(\.[0-9]+){3}$"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]  # verdict, host, path


def parse_rules(text: str) -> tuple[Rule, ...]:
    """``block com/en/, allow example.com/en/7``: verdict, then host, then path."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        verdict, where = part.split(" ", 1)
        if verdict not in ("allow", "block"):
            raise ValueError(f"rule {part!r} starts with neither allow nor block")
        host, slash, path = where.partition("/")
        out.append((verdict, host.lower(), slash + path))
    return tuple(out)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_fit(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits a host or one it is a subdomain of and starts the path; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def name_of(host: Column) -> Column:
    """The host without user, port and final dot."""
    return F.regexp_extract(host, r"^(?:.*@)?(.*?)(?::[0-9]*)?\.?$", 1)


def _last(host: Column, labels: int) -> Column:
    """That many last labels of the name under a plain suffix, one more under a long one; an address whole."""
    name = name_of(host)
    short, long = (F.substring_index(name, ".", -n) for n in (labels, labels + 1))
    return F.when(name.rlike(_ADDRESS), name).when(name.rlike(_LONG), long).otherwise(short)


def suffix_of(host: Column) -> Column:
    return _last(host, 1)


def domain_of(host: Column) -> Column:
    """The public suffix and the label before it, where there is one."""
    return _last(host, 2)


def _strength(cells: DataFrame) -> float:
    """1/rho - 1 for the intra-class correlation rho of ``cells(n, k)``, held within 1 and 1000; never above the number of outcomes, which is all that a prior can know."""
    r = cells.where("n > 0").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk")).first()
    most = min(1000.0, max(1.0, float(r["n"] or 0)))
    if not r["n"] or r["groups"] < 2:
        return most
    p = r["k"] / r["n"]
    between = r["kk"] - r["n"] * p * p  # sum of n_i (p_i - p)^2
    room = (r["n"] - r["nn"] / r["n"]) * p * (1 - p)
    if room <= 0:
        return most
    rho = (between - (r["groups"] - 1) * p * (1 - p)) / room
    rho = round(min(max(rho, 1 / 1001), 0.5), 6)  # rounded, so that the order of summing cannot show
    return min(most, 1 / rho - 1)


def reputation(cells: DataFrame, z: float = 1.645) -> DataFrame:
    """Posterior of every host in ``cells(host, n, k)``: ``host, n, k, rate, low``; n outcomes, k of them bad."""
    named = cells.select("host", "n", "k", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    domains = named.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = ((total["k"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)
    s3, s2, s1 = _strength(suffixes), _strength(domains), _strength(named)
    suffix_rate = suffixes.select("suffix", ((F.col("k") + s3 * mean) / (F.col("n") + s3)).alias("suffix_rate"))
    domain_rate = domains.join(suffix_rate, "suffix").select("suffix", "domain", ((F.col("k") + s2 * F.col("suffix_rate")) / (F.col("n") + s2)).alias("domain_rate"))
    a = F.col("k") + s1 * F.col("domain_rate")
    size = F.col("n") + s1
    rate = a / size
    return named.join(domain_rate, ["suffix", "domain"]).select("host", "n", "k", rate.alias("rate"), (rate - z * F.sqrt(rate * (1 - rate) / (size + 1))).alias("low"))


def judge_pages(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...], limit: float = 0.4, z: float = 1.645) -> DataFrame:
    """One row per row of ``pages(page_id, url)``: ``page_id, host, path, rule, verdict, rate``.

    ``labels(doc_id, quality, toxic)`` holds outcomes: bad where quality is 0
    or toxic is 1. A page belongs to the document whose number ends the first
    path part that is one (``/en/825``); a document labelled more than once
    counts as bad if any label is. Null urls, and urls without ``://``, have an
    empty host, which is judged like any other. Without labels nothing but
    rules blocks. Repeated rows and null ids pass through; other columns are
    not read.
    """
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    number = F.regexp_extract("path", r"/([0-9]{1,18})(?:[/.]|$)", 1)
    outcome = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)).alias("bad"))
    # pages of one host and number count together, so that hot hosts shrink before they move; pages without a number have no outcome
    visits = named.select("host", F.when(number != "", number.cast("long")).alias("number")).where("number is not null").groupBy("host", "number").agg(F.count(F.lit(1)).alias("pages"))
    counted = visits.join(outcome.where("bad is not null"), F.col("number") == F.col("doc_id")).groupBy("host").agg(F.sum("pages").alias("n"), F.sum(F.col("pages") * F.col("bad")).alias("k"))
    seen = named.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    cells = materialize(seen.join(counted, "host", "left").select("host", "pages", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k")), "hosts")
    rule, verdict = first_fit(rules, F.col("host"), F.col("path"))
    known = reputation(cells, z).join(cells.select("host", "pages"), "host")
    known = materialize(known.select("host", "rate", "low", "pages"), "reputation")
    total = cells.agg(F.sum("pages").alias("n")).first()["n"] or 0
    return join_hot(named, known, ["host"], "pages", total).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("low") > limit, "block").otherwise("allow")).alias("verdict"), F.round("rate", 6).alias("rate"))
