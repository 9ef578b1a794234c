"""URL filters: rules first, then empirical-Bayes reputation of the host.

Rules name a host and the beginning of a path. A rule fits its host and all
subdomains; of the rules that fit, the longest decides.

Where no rule fits, the host's reputation decides. The share of bad pages of a host is given
a beta prior around the share of its registered domain, that one a prior around its
public suffix, and that one around the share of all pages. How much a prior weighs is
estimated from the data, per level, by moments of the beta-binomial distribution: if the
children of a level differ no more than chance, they are drawn together, and where they truly
differ each stands for itself. A host without labelled pages has its domain's prior. A page is
blocked where the lower bound of the posterior share (mean less ``z`` deviations) passes ``limit``.

DataFrame functions only. Labelled outcomes are counted per host before anything is
shuffled by it. Reputation is looked up by broadcast for the keys that have at least
1/``HOT_SHARE`` of all rows, which are ``HOT_SHARE`` at most, and by a shuffled join for the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsilt.llm.common import stored

LIMIT = 0.25            # a page is blocked if its host's share of bad pages is surely above
Z = 1.645               # one-sided bound of 95 %
HOT_SHARE = 1000
MAX_RULES = 500         # rules become one expression; longer lists belong into a table and a join
LEVELS = ("suffix", "domain", "host")
#: Bounds of the correlation of pages with one parent (prior weights 1 and 9999).
CORRELATION = (1e-4, 0.5)
#: Public suffixes of two labels that are told from registered domains.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk",
            "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, else null. ``rules``: (allow or block,
    host and path). Of equally long ones the longer host decides, then the first in the list."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are made into one expression")
    ranked = sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0])))
    tests = []
    for verdict, rule in ranked:
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        tests.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    nothing = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*tests, nothing)


def domain_parts(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host; user and port do not count. Addresses
    are their own domain and have the empty suffix, as have names without a dot."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")
    address = name.rlike(r"^([0-9]+\.){3}[0-9]+$|^\[") | ~name.contains(".")
    two = F.substring_index(name, ".", -2)
    suffix = F.when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))
    labels = F.when(two.isin(*SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)
    return F.when(address, name).otherwise(labels), F.when(address, F.lit("")).otherwise(suffix)


def looked_up(rows: DataFrame, key: str, table: DataFrame, weight: str) -> DataFrame:
    """``rows`` left-joined with ``table`` (one row per ``key``; ``weight``: how many of ``rows``
    have it). Keys with at least 1/HOT_SHARE of all weight are broadcast; the rows of the others are
    shuffled, and rows that are settled spread over all tasks by keys that no table has."""
    values = [c for c in table.columns if c not in (key, weight)]
    total = table.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_SHARE >= total
    pack = lambda t, name: t.select(F.col(key).alias(f"{name}_key"), F.struct(*values).alias(name))
    found = rows.join(F.broadcast(pack(table.filter(is_hot), "hot")), F.col(key) == F.col("hot_key"), "left")
    spread = F.concat(F.lit("/"), F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)).cast("string"))
    open_key = F.when(F.col("hot_key").isNull(), F.col(key)).otherwise(spread)
    found = found.withColumn("open_key", open_key).join(
        pack(table.filter(~is_hot), "rest"), F.col("open_key") == F.col("rest_key"), "left")
    pick = lambda c: F.coalesce(F.col(f"hot.{c}"), F.col(f"rest.{c}")).alias(c)
    return found.select(*rows.columns, *[pick(c) for c in values])


def _prior_weight(children: DataFrame) -> float:
    """How much a prior of this level weighs, in pages, from ``children(n, bad, mean)``: mean is
    the parent's. Moments are summed as whole millionths, so that no order of rows changes them."""
    spread = F.col("n") * F.col("mean") * (1 - F.col("mean"))
    beyond = (F.col("bad") - F.col("n") * F.col("mean")) * (F.col("bad") - F.col("n") * F.col("mean")) - spread
    units = lambda c: F.sum(F.rint(c * 1_000_000).cast("decimal(38,0)"))
    got = children.agg(units(beyond).alias("over"), units(spread * (F.col("n") - 1)).alias("most")).first()
    correlation = float(got.over) / float(got.most) if got.most else CORRELATION[0]
    low, high = CORRELATION
    return 1 / min(max(correlation, low), high) - 1


def reputations(hosts: DataFrame) -> DataFrame:
    """``host, rows, n, bad, mean, deviation`` of the posterior share of bad pages, for
    ``hosts(host, rows, n, bad)``: rows of the host, how many are labelled, how many of these bad."""
    domain, suffix = domain_parts(F.col("host"))
    level = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "rows", "n", "bad")
    tables = {"host": level}
    tables["domain"] = stored(level.groupBy("domain", "suffix").agg(
        F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    tables["suffix"] = stored(tables["domain"].groupBy("suffix").agg(
        F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    all_of = tables["suffix"].agg(F.sum("n"), F.sum("bad")).first()
    n, bad = all_of[0] or 0, all_of[1] or 0
    above = None
    for name in LEVELS:
        rows = tables[name]
        rows = rows.withColumn("mean", F.lit((bad + 1.0) / (n + 2.0))) if above is None else looked_up(
            rows, above[0], above[1], "below")
        rows = stored(rows, f"{name}-priors")
        weight = F.lit(_prior_weight(rows))
        one = F.col("bad") + weight * F.col("mean")
        other = F.col("n") - F.col("bad") + weight * (1 - F.col("mean"))
        share = one / (one + other)
        if name == LEVELS[-1]:
            deviation = F.sqrt(one * other / ((one + other) * (one + other) * (one + other + 1)))
            return rows.select("host", "rows", "n", "bad", share.alias("mean"), deviation.alias("deviation"))
        above = name, rows.select(name, F.col("rows").alias("below"), share.alias("mean"))
    raise AssertionError("unreachable")


def url_verdicts(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), limit: float = LIMIT,
                 z: float = Z) -> DataFrame:
    """``page_id, host, path, rule, verdict, bound`` of every row of ``pages(page_id, url)``; rule and bound
    may be null: rule where none fits, bound (of the host's posterior) never.

    ``outcomes(page_id, bad)``: labelled pages, bad 0 or 1; rows with a null are left out, and of several for a
    page the highest counts. Repeated rows of pages are judged each; a null page_id has no outcome. Urls that are null or
    have no ``://`` share the empty host, which has a reputation like any other. Other columns are not read.
    An empty table of pages gives no rows; where no page has an outcome, bounds are 0 and rules alone block.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = outcomes.select(F.col("page_id").cast("long").alias("page_id"), F.col("bad").cast("int").alias("bad")).dropna()
    known = known.groupBy("page_id").agg(F.max("bad").alias("bad"))
    counted = rows.select("page_id", "host").join(known, "page_id", "left")
    hosts = stored(counted.groupBy("host").agg(
        F.count("*").alias("rows"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "hosts")
    bound = F.greatest(F.lit(0.0), F.col("mean") - z * F.col("deviation"))
    if not hosts.agg(F.sum("n")).first()[0]:
        bound = F.lit(0.0)      # nothing is known of any page
    table = stored(reputations(hosts).select("host", "rows", bound.alias("bound")), "reputations")
    judged = looked_up(rows, "host", table, "rows")
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return judged.withColumn("matched", rule).select(
        "page_id", "host", "path", F.col("matched.rule").alias("rule"),
        F.coalesce(F.col("matched.verdict"), by_host).alias("verdict"), "bound")
