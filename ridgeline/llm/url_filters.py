"""URL filters: empirical-Bayes host reputation by beta-binomial shrinkage from host to registered domain to suffix."""

from __future__ import annotations

import pkgutil
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import Work, hidden, shared_dir

#: The number of the document that a page shows, in its url: last of its path, after a language.
DOCUMENT_NUMBER = "[.][a-z]+/[a-z]+/([0-9]+)"
#: Up to so many hosts are broadcast to their pages; of more, only those with a ten-thousandth of all pages or more, which are 10,000 at most.
BROADCAST_HOSTS = 200_000

_HOST = "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
_NUMBERS = "^[0-9.]+$"


@cache
def public_suffixes() -> tuple[str, ...]:
    """The registries' rules of more than one label of the public suffix list (x.y, *.x and !a.x). They lie beside this file: not every Spark has the library that brings them along."""
    text = pkgutil.get_data(__package__, "public_suffixes.txt").decode()
    return tuple(line for line in text.splitlines() if line and not line.startswith("//"))


def _host_sql(url: str) -> str:
    """SQL (of either engine) for a URL's host: lower case, without user, port, closing dot and www."""
    return f"nullif(regexp_replace(regexp_replace(regexp_extract(lower({url}), '{_HOST}', 1), '[.]+$', ''), '^www[.]', ''), '')"


def _pages(pages: DataFrame, number: str) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.expr(_host_sql("url")).alias("host"), F.expr(f"try_cast(regexp_extract(url, '{number}', 1) AS bigint)").alias("doc_id"))


def registered(hosts: DataFrame, rules: tuple[str, ...] | None = None) -> DataFrame:
    """Hosts with `suffix`, the longest public suffix by the list's rules (the last label where none holds), and `domain`, the suffix and one label
    more if there is one. Hosts of numbers are their own."""
    listed = hosts.sparkSession.createDataFrame([(r,) for r in (public_suffixes() if rules is None else rules)], "key string")
    cut = hosts.select("host").withColumn("l", F.split("host", "[.]"))
    keys = """flatten(transform(sequence(1, size(l)), i -> array(
        named_struct('key', array_join(slice(l, i, size(l)), '.'), 'k', size(l) - i + 1, 'not', false),
        named_struct('key', concat('*.', array_join(slice(l, i + 1, size(l)), '.')), 'k', size(l) - i + 1, 'not', false),
        named_struct('key', concat('!', array_join(slice(l, i, size(l)), '.')), 'k', size(l) - i, 'not', true))))"""
    matches = cut.select("host", F.explode(F.expr(keys)).alias("x")).select("host", "x.*").join(F.broadcast(listed), "key")
    best = matches.groupBy("host").agg(F.coalesce(F.max(F.when(F.col("not"), F.col("k"))), F.max("k")).alias("k"))
    own = hosts.join(best, "host", "left").withColumns({"l": F.split("host", "[.]"), "k": F.coalesce("k", F.lit(1))})
    numbers = F.col("host").rlike(_NUMBERS)
    suffix = F.when(numbers, F.col("host")).otherwise(F.expr("array_join(slice(l, size(l) - k + 1, k), '.')"))
    domain = F.when(numbers, F.col("host")).otherwise(F.expr("array_join(slice(l, greatest(size(l) - k, 1), k + 1), '.')"))
    return own.withColumns({"suffix": suffix, "domain": domain}).drop("l", "k")


def host_reputation(pages: DataFrame, labels: DataFrame, number: str = DOCUMENT_NUMBER, rules: tuple[str, ...] | None = None) -> DataFrame:
    """(host, domain, suffix, n_pages, n_labelled, n_good, posterior_mean, posterior_sd) of every host in `pages`.

    A page's outcome is good if the document it shows (the first group of `number` in its url) is labelled of quality and not toxic. A document with
    several label rows counts once, as good if all rows say so; a label row with a null in either column gives no outcome.
    The strength of each level's prior is the moment estimate of the beta-binomial's overdispersion around the parents' rates.
    """
    shared_dir(pages.sparkSession)
    work = Work(pages.sparkSession)
    p = _pages(pages, number).where("host IS NOT NULL").groupBy("host", "doc_id").agg(F.count("*").alias("n_pages"))  # so that no host or document is hot below
    p = work.table(p)
    outcome = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("good"))
    known = p.where("doc_id IS NOT NULL").join(outcome, "doc_id").groupBy("host").agg(F.sum("n_pages").alias("n"), F.sum(F.col("n_pages") * F.col("good")).alias("y"))
    host = p.groupBy("host").agg(F.sum("n_pages").alias("n_pages")).join(known, "host", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "y": F.coalesce("y", F.lit(0))})
    host = work.table(registered(host, rules))
    domain = work.table(host.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("y").alias("y")))
    suffix = work.table(domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y")))
    world = suffix.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("wn"), F.coalesce(F.sum("y"), F.lit(0)).alias("wy")).select(((F.col("wy") + 1) / (F.col("wn") + 2)).alias("m0"))

    def strength(children: DataFrame, parents: DataFrame, on: list[str], name: str) -> DataFrame:
        rate = parents.where("n > 0").select(*on, (F.col("y") / F.col("n")).alias("r"), F.col("n").alias("rn"))
        c = children.where("n > 0")
        c = c.join(rate, on) if on else c.crossJoin(rate)
        x = c.agg(
            F.sum(F.col("n") * (F.col("y") / F.col("n") - F.col("r")) * (F.col("y") / F.col("n") - F.col("r"))).alias("s"),
            F.sum(F.col("r") * (1 - F.col("r")) * (1 - F.col("n") / F.col("rn"))).alias("e"),
            F.sum(F.col("r") * (1 - F.col("r")) * (F.col("n") - 1) * (1 - F.col("n") / F.col("rn"))).alias("w"),
        )
        return x.select(F.expr("CASE WHEN w > 0 THEN 1 / greatest(least((s - e) / w, 0.999), 0.001) - 1 ELSE 999.0 END").alias(name))

    total = suffix.agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    k = strength(suffix, total, [], "k1").crossJoin(strength(domain, suffix, ["suffix"], "k2")).crossJoin(strength(host, domain, ["suffix", "domain"], "k3")).crossJoin(world)
    s = suffix.crossJoin(k).select("suffix", "k2", "k3", F.expr("(y + k1 * m0) / (n + k1)").alias("m1"))
    d = domain.join(s, "suffix").select("suffix", "domain", "k3", F.expr("(y + k2 * m1) / (n + k2)").alias("m2"))
    h = host.join(d, ["suffix", "domain"]).select("host", "domain", "suffix", "n_pages", F.col("n").alias("n_labelled"), F.col("y").alias("n_good"), F.expr("(y + k3 * m2) / (n + k3)").alias("posterior_mean"), (F.col("n") + F.col("k3")).alias("a"))
    h = h.withColumn("posterior_sd", F.expr("sqrt(posterior_mean * (1 - posterior_mean) / (a + 1))")).drop("a").checkpoint()
    work.drop()
    return h


def url_filter(pages: DataFrame, labels: DataFrame, z: float = 1.645, least: float = 0.5, number: str = DOCUMENT_NUMBER, rules: tuple[str, ...] | None = None, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """One row for each row of `pages`: page_id, host, domain, suffix, the host's figures, upper_bound and keep.

    A page goes only when its host is bad beyond doubt: the posterior's upper bound, mean + z standard deviations, is under `least`.
    Hosts without labelled pages get their domain's rate, wide bounds and are kept unless the domain is as bad.
    Null, empty or host-less URLs: null host and figures, kept (nothing is known against them). Null page_ids and repeated rows stay
    as they are; urls may have any length. Empty tables: no rows, or prior figures only. Other columns aren't read.
    """
    p = _pages(pages, number).select("page_id", "host")
    h = host_reputation(pages, labels, number, rules)
    (of,) = hidden(p, "of")
    bound = F.expr(f"least(1.0, posterior_mean + {z} * posterior_sd)")
    h = h.select(F.col("host").alias(of), "domain", "suffix", "n_pages", "n_labelled", "n_good", F.round("posterior_mean", 6).alias("posterior_mean"), F.round(bound, 6).alias("upper_bound"), (bound >= least).alias("keep"))
    n, total = h.agg(F.count("*"), F.coalesce(F.sum("n_pages"), F.lit(0))).first()
    if n <= broadcast_hosts:
        out = p.join(F.broadcast(h), F.col("host") == F.col(of), "left")
    else:
        large = F.col("n_pages") * 10_000 >= total
        hot = h.where(large)
        rest = p.join(F.broadcast(hot.select(of)), F.col("host") == F.col(of), "left_anti")
        out = p.join(F.broadcast(hot), F.col("host") == F.col(of)).unionByName(rest.join(h.where(~large), F.col("host") == F.col(of), "left"))
    return out.select("page_id", "host", "domain", "suffix", "n_labelled", "n_good", "posterior_mean", "upper_bound", F.coalesce("keep", F.lit(True)).alias("keep"))


def url_filter_sql(z: float = 1.645, least: float = 0.5, number: str = DOCUMENT_NUMBER, rules: tuple[str, ...] | None = None) -> str:
    """The same in DuckDB's SQL over tables pages and labels."""
    listed = " ".join(public_suffixes() if rules is None else rules)

    def strength(children: str, parents: str, on: str) -> str:
        return f"""(SELECT CASE WHEN w > 0 THEN 1 / greatest(least((s - e) / w, 0.999), 0.001) - 1 ELSE 999.0 END FROM (
            SELECT sum(c.n * (c.y / c.n - r) * (c.y / c.n - r)) s, sum(r * (1 - r) * (1 - c.n / rn)) e, sum(r * (1 - r) * (c.n - 1) * (1 - c.n / rn)) w
            FROM {children} c JOIN (SELECT *, y / n AS r, n AS rn FROM {parents} WHERE n > 0) p ON {on} WHERE c.n > 0))"""

    return f"""
WITH p0 AS (SELECT page_id, {_host_sql("url")} AS host, try_cast(regexp_extract(url, '{number}', 1) AS bigint) AS doc_id FROM pages),
hl AS (SELECT host, string_split(host, '.') AS l FROM (SELECT DISTINCT host FROM p0 WHERE host IS NOT NULL)),
cd AS (SELECT host, l, len(l) AS n, unnest(range(1, len(l) + 1)) AS i FROM hl),
ck AS (SELECT host, array_to_string(l[i:], '.') AS key, n - i + 1 AS k, 0 AS no FROM cd UNION ALL SELECT host, '*.' || array_to_string(l[i + 1:], '.'), n - i + 1, 0 FROM cd
  UNION ALL SELECT host, '!' || array_to_string(l[i:], '.'), n - i, 1 FROM cd),
sx AS (SELECT host, coalesce(max(CASE WHEN no = 1 THEN k END), max(k)) AS k FROM ck JOIN (SELECT unnest(string_split('{listed}', ' ')) AS key) USING (key) GROUP BY host),
hp AS (SELECT host, CASE WHEN regexp_matches(host, '{_NUMBERS}') THEN host ELSE array_to_string(l[len(l) - coalesce(k, 1) + 1:], '.') END AS suffix,
  CASE WHEN regexp_matches(host, '{_NUMBERS}') THEN host ELSE array_to_string(l[greatest(len(l) - coalesce(k, 1), 1):], '.') END AS domain FROM hl LEFT JOIN sx USING (host)),
pg AS (SELECT page_id, host, suffix, domain, doc_id FROM p0 LEFT JOIN hp USING (host)),
outcome AS (SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
h AS (SELECT suffix, domain, host, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS y FROM pg LEFT JOIN outcome USING (doc_id) WHERE host IS NOT NULL GROUP BY ALL),
d AS (SELECT suffix, domain, sum(n) AS n, sum(y) AS y FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(y) AS y FROM d GROUP BY ALL),
w AS (SELECT sum(n) AS n, sum(y) AS y FROM s),
k AS (SELECT {strength("s", "w", "true")} AS k1, {strength("d", "s", "c.suffix = p.suffix")} AS k2, {strength("h", "d", "c.suffix = p.suffix AND c.domain = p.domain")} AS k3, (SELECT (coalesce(y, 0) + 1) / (coalesce(n, 0) + 2) FROM w) AS m0),
s1 AS (SELECT suffix, (y + k1 * m0) / (n + k1) AS m1 FROM s, k),
d1 AS (SELECT suffix, domain, (y + k2 * m1) / (n + k2) AS m2 FROM d JOIN s1 USING (suffix), k),
h1 AS (SELECT host, domain, suffix, n, y, (y + k3 * m2) / (n + k3) AS m, n + k3 AS a FROM h JOIN d1 USING (suffix, domain), k),
h2 AS (SELECT *, least(1.0, m + {z} * sqrt(m * (1 - m) / (a + 1))) AS bound FROM h1)
SELECT page_id, pg.host, h2.domain, h2.suffix, n::BIGINT AS n_labelled, y::BIGINT AS n_good, round(m, 6) AS posterior_mean, round(bound, 6) AS upper_bound, coalesce(bound >= {least}, true) AS keep
FROM pg LEFT JOIN h2 ON pg.host = h2.host"""
