"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression and the tokens that every URL it fits must hold. Tokens are counted over
all URLs of the table, and each rule is filed under its rarest one. A URL's tokens fetch the rules filed
under them, and only those run. The index grows with the list of rules, which the driver holds anyway.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch

TOKEN = "[a-z0-9]+"
_TOKEN = re.compile(TOKEN)
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = str.maketrans(_UPPER, _SMALL)


@dataclass(frozen=True)
class Rule:
    """``rank``: a fitting rule of the largest (rank, text) decides; ``site``: it is named in the result, and sees the path as it is written."""

    text: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    site: bool


def site_rule(verdict: str, text: str) -> Rule:
    """``host/path``: fits the host and its subdomains where the URL's path starts with /path. The longest text wins."""
    host, slash, path = text.partition("/")
    host = host.translate(_LOWER)
    # a token counts if the rule shows both its ends, for a token of the URL may go on beyond the rule's last character
    whole = [m[0] for m in _TOKEN.finditer((host + slash + path).translate(_LOWER)) if m.end() < len(text)]
    return Rule(text, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(whole), len(text), True)


def pattern_rule(verdict: str, text: str) -> Rule:
    """A filter pattern over host and path, A-Z lower-cased: ``*`` is any run, ``^`` one character other than a-z and 0-9, or an end.

    Weaker than every site rule; among patterns ``allow`` is stronger. A token counts if no ``*`` or open end
    stands beside it, for there a token of the URL may go on.
    """
    low = text.translate(_LOWER)
    parts = {"*": "(?s:.*)", "^": "(?:^|[^a-z0-9]|$)"}
    pattern = "".join(parts.get(c) or re.escape(c) for c in low)
    closed = lambda k: 0 <= k < len(low) and low[k] != "*"
    whole = [m[0] for m in _TOKEN.finditer(low) if closed(m.start() - 1) and closed(m.end())]
    return Rule(text, verdict, pattern, tuple(whole), -1 if verdict == "block" else 0, False)


#: The site rules of the query.
SITE_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words that stand alone in hosts and paths of unwanted pages, and words that do so in pairs.
_ALONE = "adserver adserving adult-x adware affiliates blackjack camgirls casino casinos cialis clickbait doubleclick escorts gambling hentai jackpot keygen payday nulled phishing poker popunder porn porno ransomware roulette sportsbook spyware sweepstakes tramadol viagra warez webcams xxx".split()
_OFFER, _GOODS = "best buy cheap discount free instant online win".split(), "bets betting bingo followers loans lottery meds pharmacy pills slots".split()
_AD, _ADDING = "ad ads banner click pixel".split(), "network server sync track tracker tracking".split()
_SPAM, _MILL = "content link seo spam".split(), "farm farms mill network wheel".split()
_ADULT, _SHOWN = "adult nude sex".split(), "cam cams chat dating pics video videos".split()
#: Folders that hold no pages for readers, and words beside which a topic is treated and not sold.
_FOLDERS, _EARNEST = ("/ads/", "/adclick/", "/banners/", "/beacon/", "/popup/", "/sponsored/", "/track/click/"), (("gambling", "help"), ("gambling", "addiction"), ("poker", "history"), ("phishing", "awareness"))
PATTERNS = (
    *(("block", f"^{w}^") for w in _ALONE),
    *(("block", f"^{a}^{b}^") for x, y in ((_OFFER, _GOODS), (_AD, _ADDING), (_SPAM, _MILL), (_ADULT, _SHOWN)) for a, b in product(x, y)),
    *(("block", f) for f in _FOLDERS),
    *(("allow", f"^{a}^{b}^") for a, b in _EARNEST),
)
RULES = tuple(site_rule(*r) for r in SITE_RULES) + tuple(pattern_rule(*r) for r in PATTERNS)
DEFAULT = "allow"


def read_rules(spark: SparkSession, path: str) -> tuple[Rule, ...]:
    """Rules from text files: ``verdict kind text`` a line, kind ``site`` or ``pattern``; blank lines and those that begin with # say nothing.

    A list of rules is small beside any table; the driver holds it whole.
    """
    made = {"site": site_rule, "pattern": pattern_rule}
    out = []
    for r in spark.read.text(path).where("trim(value) <> '' AND value NOT LIKE '#%'").collect():
        verdict, kind, text = r.value.split(None, 2)
        if verdict not in ("allow", "block") or kind not in made:
            raise ValueError(f"not a rule: {r.value!r}")
        out.append(made[kind](verdict, text.strip()))
    return tuple(sorted(out, key=lambda r: (r.site, r.text, r.verdict)))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path


def token_counts(urls: DataFrame, column: str, tokens: list[str]) -> dict[str, int]:
    """How many URLs hold each of ``tokens``, over the whole table; at most as many rows as ``tokens`` reach the driver."""
    held = F.array_distinct(F.regexp_extract_all(F.translate(F.col(column).cast("string"), _UPPER, _SMALL), F.lit(TOKEN), F.lit(0)))
    found = urls.select(F.explode(held).alias("token")).where(F.col("token").isin(tokens))
    return {r.token: r["count"] for r in found.groupBy("token").count().collect()}


class Index:
    def __init__(self, rules: tuple[Rule, ...], counts: dict[str, int]):
        self.by_token: dict[str, list] = defaultdict(list)
        self.always: list = []
        for r in rules:
            entry = (re.compile(r.pattern), r)
            if r.tokens:
                self.by_token[min(r.tokens, key=lambda t: (counts.get(t, 0), t))].append(entry)
            else:
                self.always.append(entry)

    def fetch(self, subject: str) -> list:
        """The rules that may fit a lower-cased host and path."""
        return [e for t in set(_TOKEN.findall(subject)) for e in self.by_token.get(t, ())] + self.always

    def decide(self, host: str, path: str) -> Rule | None:
        """The rule that decides over a URL, if any fits."""
        subject, low = host + path, host + path.translate(_LOWER)
        return max((r for p, r in self.fetch(low) if p.search(subject if r.site else low)), key=lambda r: (r.rank, r.text), default=None)


#: The index of the run that this worker serves, by the run's tag.
_INDEXES: dict[str, Index] = {}


def _shared(pages: DataFrame, column: str, rules: tuple[Rule, ...]):
    """A function that gives each worker the index over ``rules``, made once there."""
    counts = token_counts(pages, column, sorted({t for r in rules for t in r.tokens})) if rules else {}
    sent, tag = pages.sparkSession.sparkContext.broadcast((rules, counts)), uuid.uuid4().hex

    def index() -> Index:
        if tag not in _INDEXES:
            _INDEXES.clear()
            _INDEXES[tag] = Index(*sent.value)
        return _INDEXES[tag]

    return index


def judge_urls(pages: DataFrame, key: str = "page_id", column: str = "url", rules: tuple[Rule, ...] = RULES, default: str = DEFAULT) -> DataFrame:
    """``key``, host, path, rule (the deciding site rule, else null) and verdict of every row.

    A null URL, or one without ``://``, has an empty host and path, which no rule with a token fits. URLs of
    any length are judged whole; of rules that tie in rank the one with the largest text decides. Null and
    repeated keys keep their rows, other columns are ignored, whatever their names; an empty table gives no rows.
    """
    shared = _shared(pages, column, rules)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, out = shared(), []
        for url in batch.column(1).to_pylist():
            host, path = split_url(url)
            r = index.decide(host, path)
            out.append((host, path, r.text if r and r.site else None, r.verdict if r else default))
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[k] for x in out], pa.string()) for k in range(4)]], ["key", "host", "path", "rule", "verdict"])

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(pages[key].alias("key"), F.col(column).cast("string").alias("url"))
    return per_batch(rows, run, f"key {kind}, host string, path string, rule string, verdict string").withColumnRenamed("key", key)


def rules_run(pages: DataFrame, column: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row: urls, rules, and the mean and largest number of rules that ran for a URL."""
    shared = _shared(pages, column, rules)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = shared()
        n = [len(index.fetch(h + p.translate(_LOWER))) for h, p in map(split_url, batch.column(0).to_pylist())]
        return pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n"])

    found = per_batch(pages.select(F.col(column).cast("string").alias("url")), run, "n long")
    return found.agg(F.count(F.lit(1)).alias("urls"), F.lit(len(rules)).alias("rules"), F.avg("n").alias("mean_run"), F.max("n").alias("most_run"))
