"""Operators 1, 3: URL filters and benchmark decontamination."""
import random

import pytest

from leadspark.llm import decontaminate as D
from leadspark.llm import url_filter as U

URLS = [
    (1, "https://Example.ORG/es/x?q=1"), (2, "http://a.b.example.org/en/1234#top"), (3, "https://x.com/fr/a/b"),
    (4, "https://x.com/de/"), (5, "https://other.net/"), (6, None), (7, "no scheme"), (8, "http://"), (9, "http://org"),
    (10, "http://org/"), (11, "ftp://notexample.org/es/"), (12, "http://h.org?x://y/z"), (13, "http://x.com/d"),
    (None, "https://a.org/p"), (3, "https://x.com/fr/a/b"), (14, "http://ÀB.Org/é"), (15, "x" * 5000 + "://" + "a." * 90 + "org/"),
]


def _judge(url, rules):
    url = url or ""
    if "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = []
    for verdict, rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fit.append((len(rule), rule, verdict))
    _, rule, verdict = max(fit, default=(0, None, "allow"))
    return host, path, rule, verdict


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, "h", "r", "v", "k") for i, u in rows],
                                 "page_id long, url string, host string, rule string, verdict string, key string")


def _rules(spark, rules):
    return spark.createDataFrame([(r, v) for v, r in rules], "rule string, verdict string")


def test_url_rules(spark):
    got = U.judge(_pages(spark, URLS), _rules(spark, U.RULES))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    exp = [(i, *_judge(u, U.RULES)) for i, u in URLS]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(exp, key=repr)


def test_many_rules_and_a_full_filter(spark, monkeypatch):
    monkeypatch.setattr(U, "MAX_BLOCKS", 2)  # nearly every key passes the filter: the join decides
    r = random.Random(2)
    rules = [(r.choice(["allow", "block"]), f"h{i}.net/{'p' * r.randrange(4)}") for i in range(300)]
    urls = [(i, f"http://{r.choice(['', 'a.', 'b.a.'])}h{r.randrange(600)}.net/{'p' * r.randrange(5)}") for i in range(200)]
    got = U.judge(_pages(spark, urls), _rules(spark, rules))
    assert sorted(map(tuple, got.collect())) == sorted((i, *_judge(u, rules)) for i, u in urls)


def test_bloom_filter_loses_nothing(spark):
    keys = spark.range(2000).selectExpr("concat('k', id) as key")
    blocks, n = U.build_filter(keys, 2000)
    assert U.maybe_listed(keys, blocks, n).count() == 2000
    other = spark.range(20000).selectExpr("concat('z', id) as key")
    assert U.maybe_listed(other, blocks, n).count() < 2000


def test_url_empty_tables(spark):
    assert U.judge(_pages(spark, []), _rules(spark, U.RULES)).count() == 0
    got = U.judge(_pages(spark, URLS), _rules(spark, []))
    assert got.count() == len(URLS) and {r.verdict for r in got.collect()} == {"allow"}


def _grams(text, k):
    w = "".join(c.lower() if c.isascii() else c for c in (text or "")).replace("\x0b", " ").replace("\x0c", " ").split()
    w = [x for x in w if x]
    return {" ".join(w[i:i + k]) for i in range(len(w) - k + 1)}, len(w)


def _contained(docs, items):
    out = set()
    for j, t in items:
        n = _grams(t, 1)[1]
        if not n:
            continue
        own = _grams(t, min(5, n))[0]
        for i, d in docs:
            shared = len(own & _grams(d, min(5, n))[0])
            if shared >= 0.8 * len(own) - 1e-9:
                out.add((i, j, shared, len(own)))
    return out


@pytest.fixture
def bench(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "w", 5) for i, t in rows], "item_id long, text string, w string, width int")
    return make


def test_contained_equals_brute_force(docs, bench):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    items = [(j, " ".join(r.choices(words, k=r.choice([1, 2, 3, 4, 5, 9, 30])))) for j in range(40)]
    rows = []
    for i in range(60):
        w = r.choices(words, k=r.randrange(0, 300))
        for _ in range(3):
            own = items[r.randrange(40)][1].split()
            for _ in range(r.randrange(3)):
                own[r.randrange(len(own))] = r.choice(words)
            w[len(w) // 2:len(w) // 2] = own
        rows.append((i, " ".join(w).upper() if i % 5 == 0 else "  ".join(w)))
    got = D.contained(docs(rows), bench(items))
    assert {tuple(x) for x in got.collect()} == _contained(rows, items)


def test_contained_odd_rows(odd, empty, bench):
    items = bench([(1, "the same text here twice"), (2, None), (3, ""), (4, "x"), (5, "word word word word word word"),
                   (None, "document without"), (1, "the same text here twice")])
    got = {(r.doc_id, r.item_id) for r in D.contained(odd, items).collect()}
    assert got == {(5, 1), (6, 1), (7, 1), (4, 4), (8, 5), (None, None)}
    clean = D.clean(odd, items)
    assert clean.columns == odd.columns and {r.doc_id for r in clean.collect()} == {1, 2, 3, 9, 10}
    assert D.contained(empty, items).count() == 0
    assert D.contained(odd, bench([])).count() == 0 and D.clean(odd, bench([])).count() == odd.count()


def test_candidate_search_is_native(docs, bench):
    plan = D.contained(docs([(1, "a b c d e f")]), bench([(1, "a b c d e f")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_rows_are_judged_by_their_own_text(spark, docs):
    item = "the seven small wolves ran over the frozen lake at dawn"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, "clean words about bread and butter"), (None, f"before {item} after"), (None, "more clean words of ours"),
            (4, f"again {item}"), (4, "clean text of the same id"), (None, None), (5, f"before {item} after")]
    got = D.clean(docs(rows), items)
    assert got.columns == docs(rows).columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(
        [rows[0], rows[2], rows[4], rows[5]], key=repr)
