"""URL filters: pattern rules indexed by their rarest literal token.

A rule applies only to URLs that hold all of its literal tokens, so it is filed under the one that
the fewest URLs hold. The tokens of a URL fetch the rules filed under them, and only those run their
regular expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.llm.common import ascii_lower, dealt_out

TOKEN = "[a-z0-9]+"
#: Fixed rules by host and path.
HOST_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Words that mark a host as unwanted when no host rule fits: each a label or a part between hyphens.
BLOCKED_WORDS = [
    "ads", "adserver", "adservice", "adult", "betting", "bingo", "casino", "cams", "doubleclick", "escort", "escorts", "gambling", "hentai", "jackpot", "keygen", "lottery",
    "malware", "payday", "phishing", "poker", "popads", "popunder", "porn", "roulette", "spam", "spyware", "telemetry", "torrent", "viagra", "warez", "xxx",
]
#: Folders of advertisements and of what only programs call: a whole step of the path that isn't the last.
BLOCKED_FOLDERS = [
    "adclick", "adframe", "ads", "adserver", "adserving", "adsystem", "advert", "adverts", "affiliate", "banners", "beacon", "cgi-bin", "click-tracking", "pagead", "popunder", "popups", "promo-banner", "sponsored", "telemetry", "tracking", "wp-admin", "wp-json",
]
#: Pages that hold no text of their own: the last step of the path, with or without a file ending.
BLOCKED_PAGES = [
    "add-to-cart", "basket", "cart", "checkout", "compare-products", "forgot-password", "login", "log-in", "logout", "lost-password", "my-account", "order-history", "password-reset", "payment", "register", "reset-password", "shopping-cart", "sign-in", "sign-up",
    "signin", "signout", "signup", "subscribe", "unsubscribe", "wishlist", "wp-login", "xmlrpc",
]
PAGE_ENDINGS = ["asp", "aspx", "cgi", "do", "htm", "html", "jsp", "php"]
#: Files that count visits: a part of the file's name, with one of these endings.
COUNTING = ["adview", "analytics", "beacon", "collect", "counter", "hitcount", "impression", "pageview", "pixel", "spacer", "telemetry", "tracker", "tracking", "webbug"]
COUNTING_ENDINGS = ["ashx", "gif", "js", "php", "png", "svg"]
#: More rules than this are joined by shuffles instead of being sent to every task.
SENT_RULES = 20_000
RULES = "rule_name string, verdict string, regex string, tokens array<string>, weight int, is_host_rule boolean"


@dataclass(frozen=True)
class Rule:
    """regex must match somewhere in ``host + path``; weight decides between fitting rules, then name."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    weight: int
    is_host_rule: bool


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for the host and its subdomains and the paths that start with ``path``."""
    name = host + path
    ended = name if re.search(r"[^a-z0-9]$", name) else re.sub(rf"{TOKEN}$", "", name)
    return Rule(name, verdict, rf"^([^/?#]*\.)?{re.escape(name)}", tuple(re.findall(TOKEN, ended)), len(name), True)


def word_rule(word: str) -> Rule:
    return Rule(word, "block", rf"^([^/?#]*[.-])?{re.escape(word)}([.:/-]|$)", (word,), len(word), False)


def folder_rule(name: str) -> Rule:
    return _path_rule(f"/{name}/", rf"(?is)^[^/?#]*/(.*/)?{re.escape(name)}/.", name)


def page_rule(name: str, ending: str | None = None) -> Rule:
    """The last step of a path: ``name``, or a file of that name."""
    file = f"{name}.{ending}" if ending else name
    return _path_rule(f"/{file}", rf"(?is)^[^/?#]*/(.*/)?{re.escape(file)}/?\z", file)


def file_rule(part: str, ending: str) -> Rule:
    """A file with ``part`` between marks in its name, and an ending."""
    return _path_rule(f"*{part}*.{ending}", rf"(?is)^[^/?#]*/(.*/)?([^/]*[^a-z0-9/])?{part}([^a-z0-9/][^/]*)?\.{ending}\z", f"{part}.{ending}")


def _path_rule(name: str, regex: str, literals: str) -> Rule:
    return Rule(name, "block", regex, tuple(re.findall(TOKEN, literals)), len(name), False)


def default_rules() -> list[Rule]:
    """The fixed host rules and some hundred patterns, made from the lists above."""
    pages = [page_rule(p, e) for p in BLOCKED_PAGES for e in (None, *PAGE_ENDINGS)]
    files = [file_rule(p, e) for p in COUNTING for e in COUNTING_ENDINGS]
    return [host_rule(*x) for x in HOST_RULES] + [word_rule(w) for w in BLOCKED_WORDS] + [folder_rule(f) for f in BLOCKED_FOLDERS] + pages + files


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as the table that ``judge`` takes."""
    return spark.createDataFrame([(r.name, r.verdict, r.regex, list(r.tokens), r.weight, r.is_host_rule) for r in rules], RULES)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(name: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_lower(name), F.lit(TOKEN), 0))


def _sent(side: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(side) if few else side


def rule_index(rules: DataFrame, urls: DataFrame, few: bool = True) -> DataFrame:
    """(rule columns, token): each rule under its literal token that the fewest ``urls`` (column key) hold.

    Rules without a literal token are filed under null and meet every URL. ``few``: the rules may be sent to every task.
    """
    listed = rules.withColumn("token", F.explode_outer("tokens"))
    wanted = _sent(listed.where("token is not null").select("token").distinct(), few)
    counts = urls.select(F.explode(_tokens(F.col("key"))).alias("token")).join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    known = listed.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return known.groupBy("rule_name", "verdict", "regex", "weight", "is_host_rule").agg(F.min_by("token", F.struct("n", "token")).alias("token"))


def fetched(urls: DataFrame, index: DataFrame, few: bool = True) -> DataFrame:
    """(columns of both): each URL (column key) with the rules filed under one of its tokens, and with those under null.

    These alone run their regular expressions.
    """
    each = urls.select("*", F.explode(F.concat(_tokens(F.col("key")), F.array(F.lit(None).cast("string")))).alias("url_token"))
    return each.join(_sent(index, few), F.col("url_token").eqNullSafe(F.col("token")))


def judge(pages: DataFrame, rules: DataFrame | list[Rule] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each row of ``pages``.

    A host rule wins over a pattern rule, then the longest wins, equal lengths by name; ``rule`` is
    null unless a host rule fits. Nothing fits: allow. Null URLs and URLs without ``://`` have empty
    host and path. Null and repeated page ids keep their rows. Each distinct host and path is judged
    once, so a URL or host that a third of all pages have is no hot group, and the join that hands the
    verdicts to the pages shuffles both sides for itself, so that Spark can split a hot URL; the html is
    never read.
    Rules may be a list or a table with the columns of RULES (``rule_table``), names and patterns not null; up to
    SENT_RULES of them are broadcast, more are joined by shuffles. The expressions are matched as Spark's rlike does.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = rows.select("host", "path").distinct().withColumn("key", F.concat("host", "path"))
    if not isinstance(rules, DataFrame):
        rules = rule_table(spark, default_rules() if rules is None else rules)
    few = rules.limit(SENT_RULES + 1).count() <= SENT_RULES
    tried = fetched(urls, rule_index(rules, urls, few), few).where(F.rlike("key", F.col("regex")))
    best = tried.groupBy("host", "path").agg(F.max_by(F.struct("rule_name", "verdict", "is_host_rule"), F.struct("is_host_rule", "weight", "rule_name")).alias("best"))
    judged = rows.join(dealt_out(best), ["host", "path"], "left")
    return judged.select(
        "page_id", "host", "path",
        F.when(F.col("best.is_host_rule"), F.col("best.rule_name")).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
    )


def sql(rules: list[Rule] | None = None) -> str:
    """DuckDB SQL for judge() over the table pages."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(r.name)}, {quote(r.verdict)}, {quote(r.regex)}, {r.weight}, {str(r.is_host_rule).lower()})" for r in (default_rules() if rules is None else rules))
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with rules(name, verdict, regex, weight, is_host) as (values {values}),
p as (select row_number() over () as k, page_id,
        {lower.format("coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')")} as host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
f as (select k, name, verdict, is_host, row_number() over (partition by k order by is_host desc, weight desc, name desc) as place
      from p join rules on regexp_matches(host || path, regex))
select p.page_id, host, path, case when is_host then name end as rule, coalesce(f.verdict, 'allow') as verdict
from p left join f on f.k = p.k and f.place = 1"""
