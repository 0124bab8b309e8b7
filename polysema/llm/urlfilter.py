"""URL filter: rules first, else the host's reputation. DataFrame functions only.

Reputation: labelled page outcomes (1 good, 0 bad) are counted for each host and
shrunk through beta-binomial priors: a suffix towards all pages, a registered
domain towards its suffix, a host towards its registered domain. The strength of
each level's prior comes from the data by the method of moments (how much the
shares of the children of one parent differ beyond chance). A host is blocked if
the upper bound of its posterior share of good pages lies below LEAST_GOOD, so
that only hosts that are surely bad go.

Defined results: a null url or one without ``://`` has an empty host and path
and is judged by the prior of all pages; hosts without outcomes take their
domain's, suffix's or all pages' posterior; repeated rows get equal verdicts;
without any outcome everything that no rule blocks is allowed; an empty table
gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysema.tables import Scratch

# Second-level labels under which countries register domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Width of the posterior bound in standard deviations; share of good pages that
#: the bound must reach; strength of a prior that the data do not tell, and the
#: limits of the intra-class correlation that they do tell.
Z, LEAST_GOOD, STRENGTH, RHO = 1.645, 0.5, 10.0, (1e-4, 0.5)
#: Parts into which each host's rows are dealt for the join with reputations.
SALT = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """Public suffix by a plain rule (the last label; two under a country with a
    second-level label) and the registered domain, one label more."""
    labels = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.")
    n = F.size(labels)
    two = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(1)), 1).isin(*SECOND_LEVEL)
    k = F.when(two, 2).otherwise(1)
    tail = lambda m: F.array_join(F.slice(labels, F.greatest(n - m + 1, F.lit(1)), m), ".")
    return tail(k), tail(k + 1)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, else null. The rules
    stand in the expression, so their number is bounded by the caller's list."""
    fits = []
    for verdict, rule in rules:
        name, _, start = rule.partition("/")
        fit = ((host == F.lit(name)) | host.endswith("." + name)) & path.startswith("/" + start)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    none = F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    return F.array_max(F.array(none, *fits))


def _strength(child: DataFrame, parent: str) -> DataFrame:
    """One row: the strength of the prior of the children (n, k, parent)."""
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    by = child.groupBy(parent).agg(F.count(F.lit(1)).alias("g"), F.sum(n).alias("nn"), F.sum(k).alias("kk"), F.sum(n * n).alias("n2"), F.sum(k * k / n).alias("k2n"))
    p = F.col("kk") / F.col("nn")
    terms = by.select(
        (F.col("k2n") - F.col("kk") * p).alias("s"),
        (p * (1 - p) * (F.col("g") - 1)).alias("e"),
        (p * (1 - p) * (F.col("nn") - F.col("n2") / F.col("nn") - (F.col("g") - 1))).alias("v"),
    ).agg(*(F.sum(c).alias(c) for c in "sev"))
    rho = F.greatest(F.least((F.col("s") - F.col("e")) / F.col("v"), F.lit(RHO[1])), F.lit(RHO[0]))
    return terms.select(F.when(F.col("v") > 1e-9, 1 / rho - 1).otherwise(F.lit(STRENGTH)).alias("strength"))


def reputations(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """outcomes: host, good (0/1). Posterior (a, b of a beta distribution) of all pages
    (one row), of suffixes, of registered domains and of hosts.

    Counts of hosts and domains and the domains' posteriors are kept as tables, as several
    branches of the plan read them."""
    scratch = Scratch(outcomes.sparkSession, "hosts")
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = scratch.keep(outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("k")).withColumns({"suffix": suffix, "domain": domain, "all": F.lit(1)}), "hosts")
    domains = scratch.keep(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.first("all").alias("all")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.first("all").alias("all"))
    total = suffixes.agg((F.coalesce(F.sum("k"), F.lit(0)) + 1.0).alias("a"), (F.coalesce(F.sum(F.col("n") - F.col("k")), F.lit(0)) + 1.0).alias("b"))

    def shrunk(child: DataFrame, key: list[str], parent: DataFrame, on: list[str], group: str) -> DataFrame:
        """A child's posterior under a prior with its parent's mean. parent: a, b."""
        up = parent.select(*on, (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"))
        up = child.join(up, on) if on else child.crossJoin(F.broadcast(up))  # one row
        strength = F.broadcast(_strength(child, group))  # one row
        m, s = F.col("mean"), F.col("strength")
        return up.crossJoin(strength).select(*key, (m * s + F.col("k")).alias("a"), ((1 - m) * s + F.col("n") - F.col("k")).alias("b"))

    by_suffix = shrunk(suffixes, ["suffix"], total, [], "all")
    by_domain = scratch.keep(shrunk(domains, ["domain", "suffix"], by_suffix, ["suffix"], "suffix"), "posteriors")
    by_host = shrunk(hosts, ["host"], by_domain.select("domain", "a", "b"), ["domain"], "domain")
    return total, by_suffix, by_domain.select("domain", "a", "b"), by_host


def upper_bound(a: Column, b: Column) -> Column:
    n = a + b
    return a / n + Z * F.sqrt(a * b / (n * n * (n + 1)))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url: str = "url") -> DataFrame:
    """id_col, host, path, rule, verdict, good_upper for every row of pages.

    outcomes: url, good (0/1), the labelled pages. The distinct hosts are judged once
    (a partial aggregate makes a hot host one row a task); the rows then fetch
    their host's bound by a join in which every host is dealt into SALT parts.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("salt", F.pmod(F.xxhash64(id_col, "path"), F.lit(SALT)).cast("int"))
    known = outcomes.select(host_and_path(F.col("url"))[0].alias("host"), F.col("good").cast("long").alias("good")).where("good in (0, 1)")
    total, by_suffix, by_domain, by_host = reputations(known)
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = rows.select("host").distinct().withColumns({"suffix": suffix, "domain": domain})
    named = lambda df, x: df.withColumnsRenamed({"a": f"a_{x}", "b": f"b_{x}"})
    best = hosts.join(named(by_host, "h"), "host", "left").join(named(by_domain, "d"), "domain", "left").join(named(by_suffix, "s"), "suffix", "left").crossJoin(F.broadcast(named(total, "t")))  # one row
    bound = best.select("host", F.round(upper_bound(*(F.coalesce(*(F.col(f"{x}_{y}") for y in "hdst")) for x in "ab")), 6).alias("good_upper"))
    spread = bound.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    hit = matched_rule(F.col("host"), F.col("path"), rules)
    judged = rows.join(spread, ["host", "salt"]).withColumn("hit", hit)
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("good_upper") < LEAST_GOOD, "block").otherwise("allow"))
    return judged.select(id_col, "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "good_upper")


# The rules of the registered query.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

_RULE_SQL = ", ".join(
    f"case when (host = '{r.partition('/')[0]}' or ends_with(host, '.{r.partition('/')[0]}')) and starts_with(path, '/{r.partition('/')[2]}') then {{'length': {len(r)}, 'rule': '{r}', 'verdict': '{v}'}} end" for v, r in RULES
)


def _strength_sql(child: str, parent: str) -> str:
    return f"""(select case when v > 1e-9 then 1 / greatest(least((s - e) / v, {RHO[1]}), {RHO[0]}) - 1 else {STRENGTH} end from (
      select sum(k2n - kk * kk / nn) as s, sum(kk / nn * (1 - kk / nn) * (g - 1)) as e, sum(kk / nn * (1 - kk / nn) * (nn - n2 / nn - (g - 1))) as v from (
        select {parent}, count(*)::DOUBLE as g, sum(n)::DOUBLE as nn, sum(k)::DOUBLE as kk, sum(n * n)::DOUBLE as n2, sum(k * k / n::DOUBLE) as k2n from {child} group by {parent})))"""


_PARTS_SQL = f"""
  case when length(h[len(h)]) = 2 and len(h) >= 3 and h[len(h) - 1] in ({", ".join(f"'{x}'" for x in SECOND_LEVEL)}) then 2 else 1 end as m,
  array_to_string(h[greatest(len(h) - m + 1, 1):len(h)], '.') as suffix, array_to_string(h[greatest(len(h) - m, 1):len(h)], '.') as domain"""

ORACLE_SQL = f"""
with cut as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages
), named as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from cut
), rows as (
  select page_id, coalesce(host, '') as host, coalesce(path, '') as path from named
), outcome as (
  select doc_id, min(case when quality = 1 and toxic = 0 then 1 else 0 end) as good from labels group by doc_id
), h0 as (
  select host, count(*) as n, sum(good) as k from rows join outcome on page_id = doc_id group by host
), h1 as (
  select *, string_split(regexp_replace(host, ':\\d*$', ''), '.') as h from h0
), hosts as (
  select host, n, k, {_PARTS_SQL} from h1
), domains as (
  select domain, suffix, sum(n) as n, sum(k) as k from hosts group by domain, suffix
), suffixes as (
  select suffix, 1 as everything, sum(n) as n, sum(k) as k from domains group by suffix
), total as (
  select coalesce(sum(k), 0) + 1.0::DOUBLE as a, coalesce(sum(n - k), 0) + 1.0::DOUBLE as b from suffixes
), s_post as (
  select suffix, a / (a + b) * s + k as a_s, (1 - a / (a + b)) * s + n - k as b_s from (select *, {_strength_sql("suffixes", "everything")} as s from suffixes, total)
), d_post as (
  select domain, a_s / (a_s + b_s) * s + k as a_d, (1 - a_s / (a_s + b_s)) * s + n - k as b_d from (select *, {_strength_sql("domains", "suffix")} as s from domains join s_post using (suffix))
), h_post as (
  select host, a_d / (a_d + b_d) * s + k as a_h, (1 - a_d / (a_d + b_d)) * s + n - k as b_h from (select *, {_strength_sql("hosts", "domain")} as s from hosts join d_post using (domain))
), all0 as (
  select host, string_split(regexp_replace(host, ':\\d*$', ''), '.') as h from (select distinct host from rows)
), all1 as (
  select host, {_PARTS_SQL} from all0
), best as (
  select host, coalesce(a_h, a_d, a_s, a) as aa, coalesce(b_h, b_d, b_s, b) as bb
  from all1 left join h_post using (host) left join d_post using (domain) left join s_post using (suffix), total
), bound as (
  select host, round(aa / (aa + bb) + {Z} * sqrt(aa * bb / ((aa + bb) * (aa + bb) * (aa + bb + 1))), 6) as good_upper from best
), judged as (
  select page_id, host, path, good_upper, list_max(list_filter([{_RULE_SQL}], lambda x: x is not null)) as hit from rows join bound using (host)
)
select page_id, host, path, hit.rule as rule, coalesce(hit.verdict, case when good_upper < {LEAST_GOOD} then 'block' else 'allow' end) as verdict, good_upper from judged
"""
