import math
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from folioforge.llm import common, url_filter


@pytest.fixture(scope="module")
def weights(spark):
    return url_filter.train(url_filter.default_examples(spark))


def cut(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute(url, w):
    host, path = cut(url)
    best = None
    for rule, verdict in url_filter.RULES:
        own, _, under = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + under) and len(rule) > len(best[0] if best else ""):
            best = rule, verdict
    z = w[-1]
    for part, salt, base in ((host, "host", 0), (path, "path", url_filter.BUCKETS)):
        s = f"^{part}$"
        grams = [s[i : i + n] for n in url_filter.SIZES for i in range(max(len(s) - n + 1, 1))] if part else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), xxhash.xxh64_intdigest(salt.encode(), 42)) for g in grams]
        at = [(h - 2**64 if h >= 2**63 else h) % url_filter.BUCKETS + base for h in hashes]
        z += sum(w[b] for b in at) / len(at) if at else 0
    p = 1 / (1 + math.exp(-z))
    return host, path, best[0] if best else None, best[1] if best else ("block" if p >= 0.4 else "allow"), p


def test_whole_table_against_brute_force(spark, sf, weights):
    pages = common.table(spark, sf.replace("0.001", "0.01"), "pages")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge_urls(pages, weights).collect()}
    for r in pages.select("page_id", "url").collect():
        want = brute(r.url, weights)
        assert got[r.page_id][:4] == want[:4], r.url
        assert abs(got[r.page_id][4] - want[4]) < 1e-9


def test_model_on_addresses_it_has_not_seen(spark, weights):
    bad = ["https://casino-palace.example.org/en/1", "http://m.cheap-pills.example.org/de/77", "https://free-bets.example.org/es/3", "http://www.adult-cams.example.net/en/9"]
    good = ["https://thertion.example.org/en/685", "http://blog.ththan.example.net/de/3", "https://botany.example.org/en/plants", "http://www.ththst.example.org/fr/90"]
    df = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    got = [r.verdict for r in url_filter.judge_urls(df, weights, rules=()).orderBy("page_id").collect()]
    assert got == ["block"] * 4 + ["allow"] * 4


def test_edge_rows_and_no_python_in_the_plan(spark, weights):
    urls = [None, "", "no scheme", "http://", "x://COM/", "a://www.EXAMPLE.com/en/", "a://example.com/en/x", "a://wexample.com/en/x", "a://x.com?u=://y.net/fr/", "a://é.net/es/ü#f", "a://com", "ftp://net/fr/\n", "a://" + "x" * 50000 + ".org/"]
    df = spark.createDataFrame(list(enumerate(urls + [urls[5]])), "page_id long, url string").selectExpr("*", "'h' as host", "1 as rule")
    out = url_filter.judge_urls(df, weights)
    for r in out.collect():
        assert tuple(r)[1:5] == brute((urls + [urls[5]])[r.page_id], weights)[:4]
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan.split("Physical Plan")[1])
    assert url_filter.judge_urls(df.limit(0), weights).count() == 0
    assert url_filter.train(url_filter.default_examples(spark).limit(0)) == [0.0] * (2 * url_filter.BUCKETS + 1)
    assert df.filter(F.col("url").isNull()).count() == 1


def test_training_against_a_plain_version(spark):
    """The same gradient steps on a dense matrix."""
    import numpy as np

    table = url_filter.default_examples(spark).filter("url like '%page%' or label = 1")
    rows = [(r.url, r.label) for r in table.collect()]
    x = np.zeros((len(rows), 2 * url_filter.BUCKETS))
    for i, (url, _) in enumerate(rows):
        for part, salt, base in zip(cut(url), ("host", "path"), (0, url_filter.BUCKETS)):
            s = f"^{part}$"
            grams = [s[k : k + n] for n in url_filter.SIZES for k in range(max(len(s) - n + 1, 1))] if part else []
            for g in grams:
                h = xxhash.xxh64_intdigest(g.encode(), xxhash.xxh64_intdigest(salt.encode(), 42))
                x[i, (h - 2**64 if h >= 2**63 else h) % url_filter.BUCKETS + base] += 1 / len(grams)
    y, n, ridge = np.array([y for _, y in rows], float), len(rows), 2e-5
    w, bias = np.zeros(x.shape[1]), 0.0
    curve = x.sum(axis=0) * 0.5 / n + ridge
    for _ in range(20):
        off = (1 / (1 + np.exp(-(x @ w + bias))) - y) / n
        w, bias = w - (x.T @ off + ridge * w) / curve, bias - off.sum()
    got = url_filter.train(table)
    assert len(rows) > 100 and np.abs(np.array(got) - np.append(w, bias)).max() < 1e-8
