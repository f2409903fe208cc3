import re
from itertools import combinations

from linewright.llm import urls
from linewright.llm.queries import URL_RULES, op4_url_filters


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def fixed(host, path):
    best = None
    for text, verdict in URL_RULES:
        h, p = text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[0])):
            best = text, verdict
    return best or (None, None)


def tokens(url):
    host, path = plain(url)
    parts = [("host:", x) for x in host.split(".")] + [("part:", x) for x in re.split("[.-]", host)] + [("path:", x) for x in re.split("[^a-z0-9]+", path.lower())]
    return {k + x for k, x in parts if not re.fullmatch("[0-9]*", x)}


def mined(labelled, support, confidence, lift, most):
    """Every combination of tokens, counted one by one."""
    rows = [(tokens(u), b) for u, b in labelled]
    n, bad = len(rows), sum(b for _, b in rows)
    seen = {}
    for held, b in rows:
        for k in range(1, most + 1):
            for c in combinations(sorted(held), k):
                a = seen.setdefault(c, [0, 0])
                a[0] += 1
                a[1] += b
    rules = {}
    for c, (a, b) in seen.items():
        if b == 0 or b < support * n:
            continue
        p, z = b / a, urls.Z2
        bound = (p + z / (2 * a) - (z * (p * (1 - p) / a + z / (4 * a * a))) ** 0.5) / (1 + z / a)
        if p >= confidence and p / (bad / n) >= lift and bound >= urls.LEAST_BOUND:
            rules[c] = p
    return {c: p for c, p in rules.items() if not any(set(d) < set(c) and q >= p for d, q in rules.items())}


def check(rows, pages, rules):
    assert len(rows) == len(pages)
    by_id = dict(pages)
    for r in rows:
        host, path = plain(by_id[r.page_id])
        rule, verdict = fixed(host, path)
        hit = any(set(c) <= tokens(by_id[r.page_id]) for c in rules)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if hit else "allow")), r


def test_query(spark, sf_dir):
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    labels = {r.doc_id: bool(r.quality == 0 or r.toxic == 1) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    numbers = [(u, re.search(r"/([0-9]+)(?:\.html)?/?$", plain(u)[1])) for _, u in pages]
    labelled = [(u, labels[int(m[1])]) for u, m in numbers if m and int(m[1]) in labels]
    assert labelled
    check(op4_url_filters(spark, sf_dir).collect(), pages, mined(labelled, 0.002, 0.8, 2.0, 3))


def test_rules_are_mined_and_odd_urls_pass(spark):
    bad = [f"http://{h}.spam-farm.example.org/offer/{i}" for i in range(12) for h in ("a", "www")]
    good = [f"https://www.site{i % 5}.example.org/news/{i}" for i in range(60)] + [f"https://shop.example.org/offer/{i}" for i in range(20)]
    labelled = [(u, True) for u in bad] + [(u, False) for u in good]
    odd = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.COM/EN/7?x", "x://Example.com/en/7#a", "http://evilcom/en/", "http://a.com?/en/", "ftp://sub.net/de/", "http://x.spam-farm.example.org/other", "http://é.org/es/ü", "a\nb://c.com/en/"]
    pages = list(enumerate(odd + bad[:3] + bad[:1] + good[:3]))
    rules = mined(labelled, 0.002, 0.8, 2.0, 3)
    assert rules
    frame = spark.createDataFrame(pages, "page_id long, url string")
    got = urls.filter_urls(frame, spark.createDataFrame(labelled, "url string, bad boolean"), URL_RULES)
    check(got.collect(), pages, rules)
    empty = spark.createDataFrame([], "url string, bad boolean")
    check(urls.filter_urls(frame, empty, URL_RULES).collect(), pages, {})


def test_long_urls_are_mined_in_bounded_time(spark):
    """One labelled url of 200 path words, and six that share most of theirs."""
    long = "http://long.example.org/" + "/".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200))
    wide = [f"http://wide.example.org/" + "/".join(f"v{chr(97 + i)}" for i in range(24) if i % 8 != k) for k in range(8)]
    labelled = [(long, True), *((u, True) for u in wide)] + [(f"https://www.site{i % 5}.example.org/news/{i}", False) for i in range(100)]
    pages = list(enumerate([long, *wide, wide[0] + "/more", "http://other.example.org/va/vb"]))
    got = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labelled, "url string, bad boolean"), URL_RULES)
    check(got.collect(), pages, mined([x for x in labelled if x[0] != long] + [("x", True)], 0.002, 0.8, 2.0, 3))


def test_long_rows_are_mined_as_several(spark, monkeypatch):
    rows = [(f"http://{'abc'[i % 3]}.x{'yz'[i % 2]}.example.org/{'klm'[i % 5 % 3]}/{'pq'[i % 7 % 2]}", i % 3 == 0) for i in range(60)]
    pages = spark.createDataFrame(list(enumerate(u for u, _ in rows)), "page_id long, url string")
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    grown = sorted(map(tuple, urls.filter_urls(pages, labelled, URL_RULES).collect()))
    for most, group in ((1, 1), (1, 2), (3, 5)):
        monkeypatch.setattr(urls, "MOST_ITEMS", most)
        monkeypatch.setattr(urls, "GROUP", group)
        assert sorted(map(tuple, urls.filter_urls(pages, labelled, URL_RULES).collect())) == grown and any(r[-1] for r in grown)


def test_growth_is_used_whatever_the_longest_row(spark, monkeypatch):
    """One row of 40 frequent items among ordinary ones: FP-growth still runs, and the rules are those of every combination counted."""
    word = lambda i: f"w{chr(97 + i // 26)}{chr(97 + i % 26)}"
    long = "http://long.example.org/" + "/".join(map(word, range(40)))
    labelled = [(long, True)] + [(f"http://s{i % 9}.example.org/{word(i % 40)}/{word((i * 7 + i // 40) % 40)}/{word((i * 3 + 1) % 40)}", i % 40 < 14) for i in range(400)] + [("http://fine.example.org/a", False)] * 600
    fits, fit = [], urls.FPGrowth.fit
    monkeypatch.setattr(urls.FPGrowth, "fit", lambda self, df: fits.append(df.count()) or fit(self, df))
    pages = list(enumerate(u for u, _ in labelled[:200]))
    got = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labelled, "url string, bad boolean"), URL_RULES)
    rules = mined(labelled, 0.002, 0.8, 2.0, 3)
    check(got.collect(), pages, rules)
    assert len(fits) == 1 and fits[0] > 400 and rules
