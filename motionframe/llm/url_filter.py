"""URL filter by dated list entries (operator 1).

A list entry says that from a moment on a pattern (a domain with its subdomains, or one URL) is
on or off a list. The entries of a pattern become validity intervals; a capture is judged by the
intervals that hold its fetch time, whatever was listed before or after. A blocked capture that
an allow list names as well is kept.

Intervals of a pattern do not overlap, so the as-of join is an equality on the pattern with a
range on the time. Entries at one second are folded first (off wins over on), so a pattern has
86,400 changes a day at most; the next change is sought within a day and then over the days with
changes: no window sees more than that. A domain with a third of all captures is an ordinary
skewed join key: neither side is grouped by it.

Cases: captures with a null or unreadable URL or a null fetch time match nothing and are kept;
captures that repeat a key, or have none, are
judged each; columns named like the results are replaced; entries with a null pattern, list or time are void, an entry
repeated is one; empty captures give no rows, empty lists keep all.
"""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from motionframe.llm import common

ENTRY = ["list", "kind", "pattern"]


def host(url):
    """Host in lower case without user, port and a final dot; empty where there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    return F.lower(F.regexp_replace(bare, r"\.$", ""))


def plain_url(url):
    """URL as URL patterns name it: host, path and query, without scheme and fragment."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\]*([^#]*)", 1)
    return F.concat(host(url), rest)


def intervals(entries):
    """Validity intervals [since, until) of the patterns that are listed: ``entries`` has list,
    kind ('domain' or 'url'), pattern, at (timestamp) and listed (boolean)."""
    second = F.date_trunc("second", "at")
    known = entries.select(*ENTRY, second.alias("at"), "listed").dropna()
    changes = known.groupBy(*ENTRY, "at").agg(F.min("listed").alias("listed")).withColumn("day", F.to_date("at"))
    in_day = Window.partitionBy(*ENTRY, "day").orderBy("at")
    later = F.lead("at").over(in_day)
    days = changes.groupBy(*ENTRY, "day").agg(F.min("at").alias("first"))
    next_day = days.withColumn("next_first", F.lead("first").over(Window.partitionBy(*ENTRY).orderBy("day"))).drop("first")
    spans = changes.withColumn("later", later).join(next_day, [*ENTRY, "day"])
    return spans.filter("listed").select(*ENTRY, F.col("at").alias("since"), F.coalesce("later", "next_first").alias("until"))


def probes(url):
    """Every pattern that would name the URL: its host, the domains above it, the URL itself."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    tails = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    named = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("pattern"))
    all_tails = F.transform(tails, lambda t: named("domain", t))
    return F.when(host(url) != "", F.concat(all_tails, F.array(named("url", plain_url(url)))))


def judge(captures, entries, block=("block",), allow=("allow",)):
    """``captures`` (url, fetched_at and any other columns) with n_block, n_allow (intervals that
    hold at fetch time) and kept. Each row is judged by itself, by a number of its own."""
    made = ["n_block", "n_allow", "kept"]
    whole = F.struct(*[F.col(f"`{c}`") for c in captures.columns if c not in made])
    rows = captures.select(whole.alias("capture"), F.monotonically_increasing_id().alias("row"))
    rows = common.written(captures.sparkSession, rows, "op1-captures")
    keys = rows.select("row", "capture.fetched_at", F.inline(probes(F.col("capture.url")))).filter("fetched_at is not null")
    spans = intervals(entries.filter(F.col("list").isin(*block, *allow)))
    held = (F.col("fetched_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until")))
    hits = keys.join(spans, ["kind", "pattern"]).filter(held)
    count = lambda names: F.count(F.when(F.col("list").isin(*names), 1))
    found = hits.groupBy("row").agg(count(block).alias("n_block"), count(allow).alias("n_allow"))
    out = rows.join(found, "row", "left").select("capture.*", *[F.coalesce(c, F.lit(0)).alias(c) for c in made[:2]])
    return out.withColumn("kept", (F.col("n_block") == 0) | (F.col("n_allow") > 0))
