import pytest

from framekit.llm import url_filter as U
from framekit.llm.queries import ORACLE_SQL

ODD = [None, "", "no scheme", "http://", "HTTP://EX.Net", "http://a.net/x", "http://net/", "http://net", "https://m.example.net/en/1?q=/fr/", "https://example.net/en", "http://example.com/de/x#y", "http://b.org/fr/", "http://org/fr/z", "http://notnet/", "http://x.com/a?b://c.net/d", "http://x\ny.net/z", "http://É.NET/", "https://casino-win.com/", "http://mycasinos.com", "http://x.com/win/bet", "http://x.com/win/win"]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([i for i in (rest.find(c) for c in "?#") if i >= 0] or [len(rest)])]
    rule = None
    for r, _ in U.RULES:
        d, p = r.split("/", 1)
        if (host == d or host.endswith("." + d)) and path.startswith("/" + p) and (rule is None or len(r) > len(rule)):
            rule = r
    low, hits = (url or "").lower(), [set(), set()]
    for k, terms in enumerate((U.STRICT, U.SOFT)):
        for t in terms:
            i = low.find(t)
            while i >= 0:
                j = i + len(t)
                if (i == 0 or not low[i - 1].isalnum()) and (j == len(low) or not low[j].isalnum()):
                    hits[k].add(t)
                i = low.find(t, i + 1)
    verdict = dict(U.RULES).get(rule) or ("block" if hits[0] or len(hits[1]) >= U.SOFT_HITS else "allow")
    return host, path, rule, verdict


def test_against_plain_code(spark):
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(ODD)] + [(None, ODD[5], None, "x")], "page_id bigint, url string, `HOST` string, `Verdict` string")
    out = U.judge_urls(pages)
    assert out.count() == len(ODD) + 1 and out.columns == ["page_id", "url", "host", "path", "rule", "strict_terms", "soft_terms", "verdict"]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.where("page_id is not null").collect()}
    assert got == {i: plain(u) for i, u in enumerate(ODD)}
    assert U.judge_urls(pages.limit(0)).count() == 0


def test_terms():
    v = U.Vocabulary(["bad"], ["one", "two"], 2)
    assert v.hits("BAD-one.ONE/twofold") == (["bad"], ["one"]) and v.rejects("bad") and not v.rejects("one/one") and v.rejects("one/two")
    assert not U.Vocabulary([], []).rejects("anything") and v.hits(None) == ([], [])
    assert v.hits("notbad badly") == ([], [])


@pytest.mark.parametrize("text", ["a" * 100000 + "-casino", "casino " * 3])
def test_long(text):
    assert U.Vocabulary().rejects(text)


def test_query_and_sql(spark):
    from tests.oracle_check import connect, differ

    sf = "/root/testdata/sf0.001"
    df = U.op9_urls(spark, sf)
    assert differ(df, connect(sf), ORACLE_SQL["op9_urls"]) == ""
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    assert {r["page_id"]: tuple(r)[1:] for r in df.select("page_id", "host", "path", "rule", "verdict").collect()} == {i: plain(u) for i, u in urls.items()}


def test_vocabulary_file():
    rows = [line.split("\t") for line in U.TERMS.read_text().splitlines()[1:]]
    assert len({r[0] for r in rows}) == len(rows) > 100 and {r[1] for r in rows} == {"strict", "soft"}
    assert all(t == t.lower() and t.isalnum() for t, _, _ in rows)
    assert set(U.STRICT) | set(U.SOFT) == {r[0] for r in rows} and not set(U.STRICT) & set(U.SOFT)
    assert not U.Vocabulary(U.STRICT, U.SOFT).rejects("https://www.example.org/en/free/software.html")
