"""URL filters: block and allow rules, and empirical-Bayes reputation of hosts.

Rules decide first.  Where none fits, a host's labelled pages decide, shrunk through beta-binomial priors: the corpus is
the prior of a suffix, the suffix of its registered domains, a domain of its hosts.  The strength of each prior is
estimated from how much the units of its level scatter (moments of the beta-binomial).  A host is blocked when the
lower bound of its posterior share of bad pages is above a threshold, by default the share in the whole corpus: so a
host must be worse than the corpus beyond doubt, and hosts with few labels pass.

Rules are joined to hosts by the ends of their names, so there may be as many as a table holds.  DataFrame functions
only; hosts are aggregated before they are joined back, those of very many pages are broadcast, and no group is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import join_hot, staged

#: Below a country's label, names are registered under these labels (the caller may give others).
SECOND_LEVEL = ("ac", "co", "com", "ed", "edu", "gen", "go", "gob", "gouv", "gov", "gv", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch")
#: Numeric hosts are domains of their own, below this suffix.
NUMERIC = "(numeric)"
#: A prior is worth this many labelled pages at most, so hosts with far more are judged by their own.
MOST = 99


def host_of(url: Column) -> Column:
    """What stands between the first :// and /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    return F.translate(
        F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user information, port and a dot at its end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.$", "")


def _is_numeric(name: Column) -> Column:
    return name.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^\[")


def suffix_of(host: Column, second_level: Sequence[str] = SECOND_LEVEL) -> Column:
    """What names are registered under: the last label, or the last two below a country's; NUMERIC for IP addresses."""
    name = name_of(host)
    public = rf"(?:(?<=\.)(?:{'|'.join(second_level)})\.[a-z]{{2}}|[^.]*)$"
    return F.when(_is_numeric(name), F.lit(NUMERIC)).otherwise(F.regexp_extract(name, public, 0))


def domain_of(host: Column, second_level: Sequence[str] = SECOND_LEVEL) -> Column:
    """The registered domain: the suffix and one more label; an IP address; the whole name if it has no more labels."""
    name, suffix = name_of(host), suffix_of(host, second_level)
    before = F.substring(name, F.lit(1), F.char_length(name) - F.char_length(suffix) - 1)
    owner = F.when(F.char_length(before) > 0, F.concat(F.substring_index(before, ".", -1), F.lit("."), suffix)).otherwise(name)
    return F.when(_is_numeric(name), name).otherwise(owner)


def rules_of(hosts: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """hosts (host) -> host and rules: those whose host fits, longest first (of equal ones, the longer host)."""
    parts = [(verdict, rule, *rule.partition("/")) for verdict, rule in rules]
    table = [(verdict, rule, name, slash + rest) for verdict, rule, name, slash, rest in parts]
    table = hosts.sparkSession.createDataFrame(table, "verdict string, rule string, name string, rest string")
    most = max([name.count(".") + 1 for _, _, name, *_ in parts], default=1)
    ends = F.expr(f"transform(sequence(1, {most}), i -> substring_index(host, '.', -i))")
    each = hosts.select("host", F.explode(F.array_distinct(ends)).alias("name")).join(table, "name")
    place = F.struct((-F.length("rule")).alias("l"), (-F.length("name")).alias("m"), "rule", "verdict", "rest")
    return each.groupBy("host").agg(F.array_sort(F.collect_set(place)).alias("rules"))


def _shrunk(units: DataFrame, parent_mean: str) -> DataFrame:
    """units (n, k, the mean of their prior) with a, b: the posterior, under a prior as strong as the units' scatter says."""
    p, n, k = F.col(parent_mean), F.col("n"), F.col("k")
    scatter = F.sum((k - n * p) * (k - n * p)) - F.sum(n * p * (1 - p))
    least = F.lit(1 / (MOST + 1))
    rho = F.least(F.lit(0.9), F.greatest(least, F.coalesce(F.try_divide(scatter, F.sum(n * (n - 1) * p * (1 - p))), least)))
    strength = units.agg((1 / rho - 1).alias("strength"))
    # one row
    units = units.join(F.broadcast(strength), F.lit(True))
    return units.withColumn("a", F.col("strength") * p + k).withColumn("b", F.col("strength") * (1 - p) + n - k).drop("strength")


def host_reputation(pages: DataFrame, z: float = 1.645) -> DataFrame:
    """pages (host, bad: 0, 1 or null where unlabelled) -> host, pages, n, k, mean, low (the posterior's lower bound), corpus_mean."""
    counts = [F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k")]
    hosts = staged(pages.groupBy("host").agg(*counts), "hosts")
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    both = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = hosts.groupBy("suffix", "domain").agg(*both)
    suffixes = domains.groupBy("suffix").agg(*both)
    corpus = suffixes.agg(((F.sum("k") + 0.5) / (F.sum("n") + 1)).alias("corpus_mean"))
    suffixes = _shrunk(suffixes.join(F.broadcast(corpus), F.lit(True)), "corpus_mean")
    suffixes = suffixes.select("suffix", (F.col("a") / (F.col("a") + F.col("b"))).alias("suffix_mean"))
    domains = _shrunk(domains.join(suffixes, "suffix"), "suffix_mean")
    domains = domains.select("suffix", "domain", (F.col("a") / (F.col("a") + F.col("b"))).alias("domain_mean"))
    hosts = _shrunk(hosts.join(domains, ["suffix", "domain"]), "domain_mean")
    mean, total = F.col("a") / (F.col("a") + F.col("b")), F.col("a") + F.col("b")
    low = F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1 - mean) / (total + 1)))
    return hosts.join(F.broadcast(corpus), F.lit(True)).select("host", "pages", "n", "k", mean.alias("mean"), low.alias("low"), "corpus_mean")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], threshold: float | None = None, z: float = 1.645) -> DataFrame:
    """pages (id, url, bad) -> id, host, path, rule, verdict, and the host's n (labelled pages), k (bad ones), mean and low.

    threshold: what low must exceed for a host to be blocked; None: the share of bad pages in the corpus.  z: of the
    bound, by default so that it holds with 95 %.  Null urls and such without :// have an empty host and path and are
    judged as one host.  Without labels every host passes; an empty table gives no rows; ids may repeat or be null.
    """
    split = staged(
        pages.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("bad").cast("int").alias("bad")), "urls"
    )
    known = host_reputation(split, z)
    limit = F.col("corpus_mean") if threshold is None else F.lit(threshold)
    known = known.withColumn("own", F.when(F.col("low") > limit, "block").otherwise("allow")).drop("corpus_mean")
    known = staged(known.join(rules_of(known.select("host"), rules), "host", "left"), "reputation")
    total = known.agg(F.sum("pages")).first()[0] or 0
    found = join_hot(split, known, ["host"], "pages", total)
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["rest"]))
    found = found.withColumn("found", F.get(fits, F.lit(0)))
    return found.select("id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", "own").alias("verdict"), "n", "k", "mean", "low")
