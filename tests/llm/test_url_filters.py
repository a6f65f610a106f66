import math
import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from pointweave import shared
from pointweave.llm import queries
from pointweave.llm import url_filters as uf

RULES = queries.URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def tokens(host, path):
    return list(dict.fromkeys(["h:" + x for x in host.split(".") if x] + ["s:" + x for x in path.split("/") if x]))


def listed(host, path, given=RULES):
    fit = [(len(r), r, a) for r, a in given if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(fit)[1:] if fit else (None, None)


def surely(c, n):
    z = uf.SURE**2 / n
    return (c + z / 2 - (z * (c * (1 - c) + z / 4)) ** 0.5) / (1 + z)


def brute(pages, labels, min_support, min_count, min_confidence, given=RULES, key=lambda p, u: p):
    """All sets of all tokens that are frequent themselves, of any size."""
    bad = {}
    for d, q, t in labels:
        if d is not None:
            bad[d] = bad.get(d, False) or q == 0 or t == 1
    rows = []
    for p, u in pages:
        own = parts(u)
        action = listed(*own, given)[1]
        if own != ("", "") and (action or key(p, u) in bad):
            rows.append((tokens(*own), action == "block" if action else bad[key(p, u)]))
    single = Counter(t for own, b in rows if b for t in own)
    least = max(1, min_count, math.ceil(min_support * len(rows)))
    every, hits = Counter(), Counter()
    for own, b in rows:
        own = sorted(t for t in own if single[t] >= least)
        for k in range(1, len(own) + 1):
            for s in combinations(own, k):
                every[s] += 1
                hits[s] += b
    base = sum(b for _, b in rows) / max(1, len(rows))
    rules = {s: c for s in hits if hits[s] >= least and (c := hits[s] / every[s]) >= min_confidence and surely(c, every[s]) > base}
    out = []
    for p, u in pages:
        host, path = parts(u)
        own = set(tokens(host, path))
        found = [c for s, c in rules.items() if own.issuperset(s)]
        rule, action = listed(host, path, given)
        out.append((p, host, path, rule, action or ("block" if found else "allow"), max(found, default=None)))
    return out


def same(got, want):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    own = ([(r.page_id, r.url) for r in pages.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    number = lambda p, u: int(m[1]) if (m := re.match(r"/[^/]+/(\d+)", parts(u)[1])) else None
    for setting in ((0.002, 8, 0.6), (0.002, 3, 0.45)):
        got = uf.judge(pages, labels, RULES, *setting, label_key=uf.document_of(F.col("url"))).collect()
        same(got, brute(*own, *setting, key=number))
        assert any(r.confidence is not None for r in got) and any(r.rule is None and r.verdict == "block" for r in got)


def test_planted_hosts_are_blocked(spark, monkeypatch):
    """Bad pages share a host label and a segment; unlisted pages with both are blocked, those with one of them are not. Also with all keys hot."""
    urls = [f"http://{'win' if k % 2 else 'calm'}.x{k % 5}.net/{'play' if k % 3 else 'read'}/{k}" for k in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = [(k, int(not (k % 2 and k % 3)), 0) for k in range(200)]
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute(list(enumerate(urls)), labels, 0.002, 8, 0.9)
    same(uf.judge(pages, given, RULES, 0.002, 8, 0.9).collect(), want)
    assert [w[4] == "block" for w in want] == [bool(k % 2 and k % 3) for k in range(400)]
    monkeypatch.setattr(shared, "FEW_ROWS", 0)
    monkeypatch.setattr(shared, "LEAST_HOT", 3)
    same(uf.judge(pages, given, RULES, 0.002, 8, 0.9).collect(), want)


def test_odd_urls(spark):
    urls = [None, "", "nothing", "http://", "HTTP://EXAMPLE.ORG", "http://Example.org/es/x", "http://a.example.org/en/12?q#f", "x?u=http://fr.com/fr/", "http://com/fr/1", "http://xcom/fr/", "http://b.com/de", "http://b.com:80/de/", "://org/", "http://c.org#/x", "http://é.ORG/É/", "http://d.com/de/\nx"]
    pages = spark.createDataFrame([(k // 2, u, "rule", "h", "b", 1, "c") for k, u in enumerate(urls * 2)] + [(None, "http://e.org/", "r", None, None, None, None)], "page_id long, url string, rule string, host string, bad string, key int, confidence string")
    labels = spark.createDataFrame([(k, k % 2, None, "u") for k in range(10)] + [(None, 0, 0, None), (3, None, 1, None)], "doc_id long, quality int, toxic int, url string")
    own = ([(r.page_id, r.url) for r in pages.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    for given in (RULES, []):
        same(uf.judge(pages, labels, given, 0.0, 2, 0.3).collect(), brute(*own, 0.0, 2, 0.3, given))
    assert uf.judge(pages.where("false"), labels, RULES).count() == 0
    assert {r.verdict for r in uf.judge(pages, labels.where("false"), []).collect()} == {"allow"}


def test_main_path_is_native(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = uf.judge(pages, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), RULES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_all_labels_and_segments_count(spark):
    """Telling tokens in the 5th label from the end and in the 5th and a later segment, held against brute force over all tokens."""
    urls = [f"http://{'casino.' if k % 3 == 0 else ''}a{k % 7}.b.c.d.net/1/2/3/4/{'spam' if k % 4 == 0 else 'fine'}/6/7/{'pills' if k % 5 == 0 else 'x'}/{k}" for k in range(120)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = [(k, int(not (k % 3 == 0 or k % 4 == 0 or k % 5 == 0)), 0) for k in range(100)]
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for setting in ((0.1, 2, 0.6), (0.0, 9, 0.9)):
        same(uf.judge(pages, given, [], *setting).collect(), brute(list(enumerate(urls)), labels, *setting, given=[]))
    verdicts = {r.page_id: r.verdict for r in uf.judge(pages, given, [], 0.002, 8, 0.9).collect()}
    assert all(verdicts[k] == ("block" if k % 3 == 0 or k % 4 == 0 or k % 5 == 0 else "allow") for k in range(100, 120))


def test_long_urls_of_common_tokens(spark):
    """Tokens that always come together are one item: all sets of these 42 tokens would be 2^42. A URL with any of them has the item."""
    path = "/".join(f"t{k}" for k in range(40))
    urls = [f"http://x.com/{path}" if k < 10 else f"http://y.net/{k}" for k in range(20)] + ["http://z.org/t7"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k >= 10), 0) for k in range(20)], "doc_id long, quality int, toxic int")
    rules, classes = uf.mine(pages.where("page_id < 20").select(uf.tokens_of(uf.host_of(F.col("url")), uf.path_of(F.col("url"))).alias("tokens"), (F.col("page_id") < 10).alias("bad")), 0.0, 8, 0.6)
    assert [tuple(r) for r in rules.collect()] == [(["h:com"], 10, 0.5, 1.0)] and classes.count() == 42
    assert {r.page_id for r in uf.judge(pages, labels, []).where("verdict = 'block'").collect()} == {*range(10), 20}
