import random
import re

from fathomite.llm import url_rules as op


def brute(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(str.maketrans(op.UPPER, op.LOWER))
    fits = [r for r in op.HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.text))
        return host, path, best.text, best.verdict, None
    low = (url or "").translate(str.maketrans(op.UPPER, op.LOWER))
    hits = [(r.verdict != "allow", i, r) for i, r in enumerate(op.PATTERN_RULES) if re.search(r.regex, low)]
    if hits:
        r = min(hits, key=lambda x: x[:2])[2]
        return host, path, None, r.verdict, r.pattern
    return host, path, None, "allow", None


def test_matches_brute_force(spark):
    rng = random.Random(7)
    urls = [None, "", "no scheme", "://", "http://", "https://COM/en/", "http://xcom/en/", "http://a.b.example.com/en/7x?y#z", "http://example.net/de/8", "http://q.net/de/8", "ftp://h.org/es/#x", "x://y://net/de/", "http://a.org:80/es/",
            "http://casino.museum.fr/", "http://mycasino.fr/", "http://x.fr/free/x/download/y.EXE", "http://x.fr/?u=doubleclicked", "a\nb://h.fr/cheap\npills", "http://é.fr/Casino"]
    parts = ["example.com", "net", "org", "fr", "/en/7", "/de/8", "/es/", "/", "?", "#", "casino", "-", ".", "cheap", "pills", "free", "download", ".exe", "://", "http://"]
    urls += ["".join(rng.choices(parts, k=rng.randint(1, 8))) for _ in range(400)]
    pages = spark.createDataFrame([(i if i else None, u, "?") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = op.judge_urls(pages).collect()
    assert len(got) == len(urls)
    for r in got:
        assert tuple(r)[1:] == brute(urls[r.page_id or 0]), urls[r.page_id or 0]


def test_index_takes_the_rarest_token(spark):
    pages = spark.createDataFrame([(1, "http://cheap.fr/cheap"), (2, "http://cheap.de/pills")], "page_id long, url string")
    assert op.rarest_tokens(pages, "url", (op.PatternRule("block", "^cheap^pills^"),)) == {"cheap": 2, "pills": 1}
    assert op.PatternRule("block", "^free^*^download^*.exe^").tokens == ["free", "download", "exe"]
    assert op.PatternRule("block", "abc^de*").tokens == []


def test_plan_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.fr")], "page_id long, url string")
    assert not re.search("Python|Arrow|Exchange|Join", op.judge_urls(pages)._jdf.queryExecution().executedPlan().toString())
    assert op.judge_urls(pages.limit(0)).count() == 0
    assert op.judge_urls(pages, host_rules=(), pattern_rules=()).first().verdict == "allow"
