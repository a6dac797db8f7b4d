import itertools
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kestrelgrid.llm import sql
from kestrelgrid.llm import url_rules as ur

from ..oracle import DATA

CASES = [
    ("http://x.NET/a", ("x.net", "/a", "net/", "block")), ("http://net", ("net", "", None, "allow")), ("http://m.example.net/en/5", ("m.example.net", "/en/5", "example.net/en/", "allow")),
    ("http://example.net/eng", ("example.net", "/eng", "net/", "block")), ("http://myexample.net/en/", ("myexample.net", "/en/", "net/", "block")), ("http://example.com/de/1", ("example.com", "/de/1", "example.com/de/", "block")),
    ("http://example.com/DE/1", ("example.com", "/DE/1", None, "allow")), ("http://a.org/fr/x?y#z", ("a.org", "/fr/x", "org/fr/", "allow")), ("x://a.org?u=/fr/", ("a.org", "", None, "allow")),
    ("http://u.com/http://v.net/", ("u.com", "/http://v.net/", None, "allow")), ("no scheme", ("", "", None, "allow")), (None, ("", "", None, "allow")), ("", ("", "", None, "allow")), ("http://", ("", "", None, "allow")),
    ("http://big-Casino.com/x", ("big-casino.com", "/x", None, "block")), ("http://casinoss.com/", ("casinoss.com", "/", None, "allow")), ("http://casino.example.net/en/", ("casino.example.net", "/en/", "example.net/en/", "allow")),
    ("http://x.net:80/a", ("x.net:80", "/a", None, "allow")), ("http://.net/", (".net", "/", "net/", "block")), ("http://ÄRZTE.net/\n", ("Ärzte.net", "/\n", "net/", "block")), ("http://" + "a." * 3000 + "org/fr/", ("a." * 3000 + "org", "/fr/", "org/fr/", "allow")),
]


def frame(spark):
    return spark.createDataFrame([(i, u) for i, (u, _) in enumerate(CASES)] + [(None, "http://x.net/"), (0, CASES[0][0])], "page_id long, url string").withColumns({"host": F.lit("x"), "key": F.lit("x")})


def test_hard_rows(spark):
    rows = ur.judge_urls(frame(spark)).collect()
    assert len(rows) == len(CASES) + 2
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    for i, (url, want) in enumerate(CASES):
        assert got[i] == want, url
    assert ur.judge_urls(frame(spark).limit(0)).count() == 0
    assert {r.verdict for r in ur.judge_urls(frame(spark), rules=()).collect()} == {"allow"}


def all_rules(url):
    """What running every rule over the URL decides."""
    host, path = ur.split_url(url)
    fits = lambda r: re.search(r.pattern, host + path if r.site else host + path.translate(ur._LOWER))
    return max(filter(fits, ur.RULES), key=lambda r: (r.rank, r.text), default=None)


def test_rules_stand_under_their_rarest_token():
    index = ur.Index(tuple(ur.site_rule(*r) for r in ur.SITE_RULES), {"example": 5, "net": 90, "en": 1, "com": 50, "de": 60, "org": 2, "fr": 3})
    assert {r.text for _, r in index.by_token["en"]} == {"example.net/en/"}
    assert {r.text for _, r in index.by_token["example"]} == {"example.com/de/"}
    assert {r.text for _, r in index.by_token["org"]} == {"org/fr/"}


WORDS = sorted({t for r in ur.RULES for t in r.tokens})


@pytest.mark.parametrize("counts", [{}, {"example": 9}, {"net": 9, "en": 9, "de": 9}, {w: len(w) for w in WORDS}])
def test_the_index_decides_as_all_rules_would(counts):
    index = ur.Index(ur.RULES, counts)
    for url, _ in CASES:
        assert index.decide(*ur.split_url(url)) == all_rules(url)

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.sampled_from([*WORDS, *"./-?#\n", "://", "poKer", "ca\u017fino", "\u212a", "X", "é", "/EN/", "free", "Bets"]), max_size=9).map("".join))
    def any_url(text):
        url = f"http://{text}"
        assert index.decide(*ur.split_url(url)) == all_rules(url)

    any_url()


def test_letters_beyond_ascii_are_not_folded(spark):
    urls = ["http://a.com/po\u212aer", "http://a.com/ca\u017fino", "http://a.com/PoKer", "http://\u212aeygen.com/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [r.verdict for r in ur.judge_urls(df).orderBy("page_id").collect()] == ["allow", "allow", "block", "allow"]


def test_the_sql_decides_as_the_index_does(spark, tmp_path):
    words = [f"http://{'WWW.' if k % 3 else ''}x.com/{a}{'-._'[k % 3]}{b}{'/' if k % 2 else 'z'}" for k, (a, b) in enumerate(itertools.product(WORDS[::9], WORDS[::11]))]
    extra = ["http://a.com/po\u212aer", "http://poker-history.org/", "http://x.com/ADS/1", "http://free.bets", "free-bets", None]
    rows = list(enumerate([u for u, _ in CASES] + words + extra))
    df = spark.createDataFrame(rows, "page_id long, url string")
    df.write.parquet(f"{tmp_path}/pages")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    want = {r[0]: r[1:] for r in con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({sql.OP7})").fetchall()}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in ur.judge_urls(df).collect()}
    assert got == want
    assert {v[3] for v in got.values()} == {"allow", "block"}


def test_few_rules_run_for_a_url(spark):
    r = ur.rules_run(spark.read.parquet(f"{DATA}/pages.parquet")).first()
    assert r.rules == len(ur.RULES) >= 200
    assert r.mean_run < 5


def test_rules_from_a_file(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("# a list\n\nblock site net/\nallow pattern ^poker^night^\nblock pattern ^poker*\n")
    rules = ur.read_rules(spark, str(tmp_path / "rules.txt"))
    assert [(r.verdict, r.text, r.tokens) for r in rules] == [("block", "^poker*", ()), ("allow", "^poker^night^", ("poker", "night")), ("block", "net/", ("net",))]
    urls = ["http://pokers.com/", "http://a.com/poker-night", "http://poker-night.net/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [(r.rule, r.verdict) for r in ur.judge_urls(df, rules=rules).orderBy("page_id").collect()] == [(None, "block"), (None, "allow"), ("net/", "block")]
    (tmp_path / "bad.txt").write_text("deny site net/\n")
    with pytest.raises(ValueError, match="not a rule"):
        ur.read_rules(spark, str(tmp_path / "bad.txt"))


def test_a_rule_with_an_open_end_has_no_token_there():
    assert ur.site_rule("block", "a.com/eng").tokens == ("a", "com")
    assert ur.site_rule("block", "a.com/en/").tokens == ("a", "com", "en")
    assert ur.pattern_rule("block", "^a*b^c").tokens == ()
