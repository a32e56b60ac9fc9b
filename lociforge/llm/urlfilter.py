"""URL lists that change over time, joined to captures as of their fetch day.

List entries are dated: a domain is added to a list or taken off it. They become validity intervals,
and each capture is judged by the entries valid on the day of its fetch. Only DataFrame functions:
the as-of join is an equi-join on domain and a stretch of days with the interval as a further
condition. Captures are reduced to distinct hosts and days before it, so a host with a third of all
captures is as many rows as it has days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a stretch: an interval is repeated once for each that it touches.
STRETCH = 64
#: What stands around or inside a URL without being part of it.
AROUND, INSIDE = r"^[\x00-\x20]+|[\x00-\x20]+$", r"[\t\n\r]"
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@\[]+)"
#: Hosts without domains above them: numeric and bracketed addresses.
ADDRESS = r"^\[|^[0-9.]+$"
FAR = "9999-12-31"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; empty if there is none.

    As browsers read it: blanks around it go, back slashes are slashes, the scheme may be missing before ``//``, an
    address in brackets keeps them, final dots of the host go.
    """
    clean = F.translate(F.regexp_replace(F.regexp_replace(url, AROUND, ""), INSIDE, ""), "\\", "/")
    return F.coalesce(plain_name(F.regexp_extract(clean, HOST, 1)), F.lit(""))


def plain_name(name: Column) -> Column:
    """A host or a listed domain in lower case, without blanks around it and final dots."""
    return F.rtrim(F.trim(F.lower(name)), F.lit("."))


def domains_of(host: Column) -> Column:
    """A host and the domains above it that have two labels or more; an address alone."""
    labels = F.split(host, r"\.")
    size = F.size(labels)
    above = F.transform(
        F.sequence(F.lit(1), size - 1), lambda i: F.array_join(F.slice(labels, i, size - i + 1), ".")
    )
    return F.when((size > 1) & ~host.rlike(ADDRESS), above).when(host != "", F.array(host)).otherwise(F.array().cast("array<string>"))


def validity(entries: DataFrame) -> DataFrame:
    """``list, domain, since, until`` from entries ``list, domain, day, added``.

    An entry holds until the next one of its domain and list. Several on one day count as one, a
    removal if there is any. Domains are compared as :func:`plain_name` writes them, without ``*.`` or a dot in
    front. Rows with a null in any of these columns say nothing and are left out.
    """
    domain = F.regexp_replace(plain_name(F.col("domain")), r"^\*?\.+", "")
    daily = (
        entries.select("list", domain.alias("domain"), "day", "added").dropna()
        .groupBy("list", "domain", "day").agg(F.bool_and("added").alias("added"))
    )
    following = F.lead("day").over(Window.partitionBy("list", "domain").orderBy("day"))
    return daily.withColumn("until", F.coalesce(following, F.lit(FAR).cast("date"))).filter("added").select(
        "list", "domain", F.col("day").alias("since"), "until"
    )


def _stretch(day: Column) -> Column:
    return F.floor(F.unix_date(day) / STRETCH).cast("int")


def verdicts(captures: DataFrame, entries: DataFrame, allow_lists: tuple[str, ...] = ("allow",)) -> DataFrame:
    """``captures`` (with ``url`` and ``fetched_on``) with ``host, blocked, domain, lists``.

    Of the entries valid on the day of fetch, those of the longest domain that is the host or above it decide:
    blocked unless one of their lists is an allowing one. ``domain`` and ``lists`` (sorted, comma-joined)
    are theirs, null if no entry holds. A null or broken URL has the empty host; it and a null day match nothing and are not
    blocked. Rows and other columns stay, columns of these four names are replaced; repeated rows give repeated rows.
    """
    rows = captures.select(
        F.struct("*").dropFields("host", "blocked", "domain", "lists").alias("row"), host_of(F.col("url")).alias("host"),
        F.col("fetched_on").cast("date").alias("day"),
    )
    cases = rows.select(F.col("host").alias("_host"), F.col("day").alias("_day")).distinct()
    cases = cases.filter("_host != '' and _day is not null")
    span = cases.agg(F.min("_day").alias("a"), F.max("_day").alias("b")).first()
    span = {end: F.lit(span[end]).cast("date") for end in ("a", "b")}
    held = validity(entries).filter((F.col("since") <= span["b"]) & (F.col("until") > span["a"]))
    first = _stretch(F.greatest("since", span["a"]))
    last = _stretch(F.least(F.date_sub("until", 1), span["b"]))
    held = held.withColumn("_stretch", F.explode(F.sequence(first, last)))
    asked = cases.withColumn("domain", F.explode(domains_of(F.col("_host")))).withColumn("_stretch", _stretch(F.col("_day")))
    met = asked.join(held, ["domain", "_stretch"]).filter("_day >= since and _day < until")
    allowed = F.col("list").isin(*allow_lists)
    by_domain = met.groupBy("_host", "_day", "domain").agg(
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.bool_or(allowed).alias("allowed")
    )
    decided = by_domain.groupBy("_host", "_day").agg(
        F.max_by(F.struct("domain", "lists", "allowed"), F.length("domain")).alias("_best")
    )
    joined = rows.join(decided, (F.col("host") == F.col("_host")) & (F.col("day") == F.col("_day")), "left")
    return joined.select(
        "row.*", "host", F.coalesce(~F.col("_best.allowed"), F.lit(False)).alias("blocked"),
        F.col("_best.domain").alias("domain"), F.col("_best.lists").alias("lists"),
    )
