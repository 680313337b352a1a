"""URL filter: sort-merge range joins of urls with nested rules, in DataFrame functions only.

A host is turned round, label by label (``www.example.com`` becomes ``com.example.www.``). In the order of these
canonical keys a rule's host is the interval from its key to the key with ``/`` for the last dot (the next
character, which no host holds), and the intervals nest. At each end of an interval the innermost host with rules that
is active from there on is known from the rules alone. Urls and interval ends are sorted together; sweeping over them,
a url takes the host of the last end before it: its rules are those of that host and of the hosts above.

Paths nest in the same way. All rules of one such host and the hosts above it are sorted by path, and each carries the
stack of those whose path begins its own. In a second sweep a url takes the stack of the last path at or before its own.
Every rule that fits is on that stack: what lies between a path and one that it begins begins with it too. The
longest one on the stack that begins the url's path wins, so the work for a url grows with the depth of the
nesting and not with the number of rules.

A url needs no other url, only the marks of its site or host, so where these have many urls they are dealt over several
sweeps that each get the marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmeter.llm.shared import partitions_of
from gistmeter.session import materialize

#: The rules of the registered query, as (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), *_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from last to first, each followed by a dot; the empty host has the empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def site_of(key: Column) -> Column:
    return F.substring_index(key, ".", 2)


def _above(key: str) -> Column:
    """The key and the keys of the hosts above it."""
    return F.expr(f"transform(sequence(1, size(split({key}, '[.]')) - 1), n -> concat(substring_index({key}, '.', n), '.'))")


def _host_marks(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ends of the intervals of hosts with two labels or more, with the innermost host active after each; and the rest."""
    up = keys.select("key", F.explode(_above("key")).alias("above")).where("above <> key")
    outer = up.join(keys.select(F.col("key").alias("above")), "above").groupBy("key").agg(F.max_by("above", F.char_length("above")).alias("outer"))
    known = keys.join(outer, "key", "left")
    deep = known.where(F.size(F.split("key", r"\.")) > 2).withColumn("site", site_of(F.col("key")))
    start = deep.select("site", "key", F.struct(F.col("key").alias("anchor")).alias("active"))
    end = deep.select("site", F.regexp_replace("key", r"\.$", "/").alias("key"), F.struct(F.col("outer").alias("anchor")).alias("active"))
    return start.union(end), known.where(F.size(F.split("key", r"\.")) == 2).select("key")


def _path_marks(rules: DataFrame, keys: DataFrame) -> DataFrame:
    """For each host with rules and each path of its own rules and those above: the stack of rules whose path begins it."""
    entry = F.struct(
        (F.char_length("host") + F.char_length("path")).alias("size"),
        F.char_length("host").alias("host_size"),
        F.concat("host", "path").alias("rule"),
        "path",
        "verdict",
    )
    by_host = rules.select(host_key(F.col("host")).alias("above"), "path", entry.alias("entry"))
    up = keys.select(F.col("key").alias("anchor"), F.explode(_above("key")).alias("above"))
    all_rules = materialize(up.join(by_host, "above").select("anchor", "path", "entry"), "entries")
    begins = F.explode(F.transform(F.sequence(F.lit(0), F.char_length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)))
    begun = all_rules.select("anchor", "path").distinct().select("anchor", "path", begins.alias("begin"))
    met = begun.join(all_rules.select("anchor", F.col("path").alias("begin"), "entry"), ["anchor", "begin"])
    return met.groupBy("anchor", "path").agg(F.collect_set("entry").alias("stack"))


def _salted(urls: DataFrame, by: str, target: int) -> tuple[DataFrame, DataFrame]:
    """``urls`` with a salt, and the number of salts of every value of ``by``; a salt holds about ``target`` urls.

    Values with more salts than one are at most rows / target, and only these are broadcast.
    """
    counts = materialize(urls.groupBy(by).agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(1, min(target, total // partitions_of(urls)))
    salts = counts.select(by, F.ceil(F.col("n") / F.lit(share)).alias("salts"))
    crowded = F.broadcast(salts.where("salts > 1"))
    placed = urls.join(crowded, by, "left")
    return placed.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.coalesce("salts", F.lit(1)))).drop("salts"), salts


def _swept(urls: DataFrame, marks: DataFrame, by: str, order: str, take: str) -> DataFrame:
    """``urls`` with ``take`` of the last mark of their value of ``by`` that is not behind them in ``order``."""
    all_salts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))
    ends = marks.withColumn("salt", all_salts).drop("salts").withColumn("kind", F.lit(0))
    both = urls.withColumn("kind", F.lit(1)).unionByName(ends, allowMissingColumns=True)
    window = Window.partitionBy(by, "salt").orderBy(order, "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_taken", F.last(take, ignorenulls=True).over(window)).where("kind = 1").drop(take, "kind", "salt").withColumnRenamed("_taken", take)


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", target: int = 1_000_000) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``.

    ``rules`` has ``verdict, host, path``; a rule fits its host and all subdomains if the url's path starts with
    the rule's. The longest rule wins, of equally long ones that with the longer host. Where none fits, the
    verdict is ``otherwise``. A null url, or one without ``://``, has empty host and path and fits no rule.
    Repeated rows are judged each; other columns, the page's html among them, are not read; empty tables give
    empty results. A sweep holds about ``target`` urls. A stack holds the rules, of one host and the hosts above it,
    whose paths begin each other; rules are copied to every host below theirs that has rules of its own.
    """
    rules = rules.select("verdict", F.translate("host", *_LOWER).alias("host"), "path").where("host <> ''").distinct()
    rules = materialize(rules, "rules")
    keys = materialize(rules.select(host_key(F.col("host")).alias("key")).distinct(), "hosts")
    marks, tops = (materialize(df, "marks") for df in _host_marks(keys))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("site", site_of(F.col("key")))
    placed, salts = _salted(urls, "site", target)
    # A site's sweep opens with the host of its last label, if that has rules.
    label = F.concat(F.substring_index("site", ".", 1), F.lit("."))
    opening = salts.withColumn("top", label).join(tops.withColumnRenamed("key", "top"), "top")
    opening = opening.select("site", F.lit("").alias("key"), F.struct(F.col("top").alias("anchor")).alias("active"), "salts")
    inside = marks.join(salts, "site").select("site", "key", "active", "salts")
    hosted = _swept(placed, opening.union(inside), "site", "key", "active")
    hosted = materialize(hosted.select("page_id", "host", "path", F.col("active.anchor").alias("anchor")), "hosted")
    none = hosted.where("anchor is null")
    placed, salts = _salted(hosted.where("anchor is not null"), "anchor", target)
    stacks = _path_marks(rules, keys).join(salts, "anchor")
    swept = _swept(placed, stacks, "anchor", "path", "stack")
    fitting = F.filter("stack", lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["size"].alias("size"), r["host_size"].alias("host_size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    judged = swept.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    rest = none.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return judged.union(rest).withColumn("verdict", F.coalesce("verdict", F.lit(otherwise)))
