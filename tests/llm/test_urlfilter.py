"""Rules, features and training against numpy."""

import numpy as np
import pytest
import xxhash

from panel360.llm import urlfilter as u
from panel360.llm.queries import URL_RULES, op9_url_filter

URLS = [None, "", "no scheme", "http://", "://Net", "http://a.NET/x?y", "http://net", "http://example.net/en/a",
        "https://m.example.net/en/", "http://notexample.net/en/", "http://example.com/de/1#z",
        "http://example.com/DE/1", "http://x.org/fr/", "http://org/fr/", "http://forg/fr/", "http://é.org?x",
        "http://a/b://c/d", "http://u@h.net:80/p\nq", "https://spam-farm.example.org/en/728", "http://" + "x" * 20000]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    stop = min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))
    return host, path[:stop]


def ruled(host, path):
    best = None
    for verdict, on, start in URL_RULES:
        if (host == on or host.endswith("." + on)) and path.startswith(start):
            if best is None or len(on + start) > len(best[0]):
                best = on + start, verdict
    return best or (None, None)


def features(host, path):
    out = []
    for space, text in (("host", f"^{host}$"), ("path", f"^{path}$")):
        start = xxhash.xxh64_intdigest(space.encode(), 42)
        for n in u.GRAMS:
            for i in range(len(text) - n + 1):
                h = xxhash.xxh64_intdigest(text[i:i + n].encode(), start)
                out.append((h - (1 << 64) if h >> 63 else h) % u.BUCKETS)
    return np.bincount(out, minlength=u.BUCKETS) / np.sqrt(max(1, len(out)))


def descend(rows, epochs):
    x = np.array([features(*split(url)) for url, _ in rows])
    y = np.array([label for _, label in rows], float)
    w, b = np.zeros(u.BUCKETS), 0.0
    for _ in range(epochs):
        missed = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - u.RATE * (x.T @ missed / len(y) + u.DECAY * w), b - u.RATE * missed.sum() / len(y)
    return w, b


@pytest.fixture(scope="module")
def labelled(spark):
    return [(r.url, r.label) for r in u.labelled_urls(spark).collect()]


@pytest.fixture(scope="module")
def weights(spark):
    return u.train(u.labelled_urls(spark))


def test_training_and_judgement(spark, labelled, weights):
    assert len(labelled) == len(set(labelled)) < u.MAX_LABELLED
    w, b = descend(sorted(labelled), u.EPOCHS)
    mine = np.array(weights.first()[0])
    assert np.allclose(mine, [*w, b], atol=1e-8)
    right = [(1 / (1 + np.exp(-(features(*split(url)) @ w + b))) > 0.5) == bool(label) for url, label in labelled]
    assert np.mean(right) > 0.97
    df = spark.createDataFrame([(i, x, "h", 3.0) for i, x in enumerate([*URLS, URLS[5]])],
                               "page_id long, url string, HOST string, w double")
    rows = u.judge(df, URL_RULES, weights).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path = split(r.url)
        rule, verdict = ruled(host, path)
        score = 1 / (1 + np.exp(-(features(host, path) @ w + b)))
        assert (r.host, r.path, r.rule, r.w) == (host, path, rule, 3.0), r.url
        assert abs(r.score - score) < 1e-8
        assert r.verdict == (verdict or ("block" if score > 0.5 else "allow"))
    filtered = u.judge(df, URL_RULES, weights).where("verdict = 'block'").count()
    assert filtered == sum(r.verdict == "block" for r in rows)


def test_unseen_hosts(spark, weights):
    urls = [("https://best-casino-online.net/", "block"), ("http://cheap.pills24.com/", "block"),
            ("https://spam-farm.example.org/en/728", "block"), ("https://casino-bonus.biz/x", "block"),
            ("http://free-warez.example.com/", "block"), ("https://ththre.example.com/en/825", "allow"),
            ("http://citynews.example.org/", "allow"), ("https://tionsh.example.net/a/9", "allow"),
            ("http://blog.ththan.example.net/en/960", "allow"), ("http://mywiki.org/", "allow")]
    got = u.judge(spark.createDataFrame(urls, "url string, want string"), [], weights).collect()
    assert sum(r.verdict == r.want for r in got) >= 9


HELD_OUT = {
    "block": ["casino-win", "free-bets", "cheap-pills", "jackpot-slot", "gamble-online", "prize-lotto", "porn-cams",
              "adult-cam", "casino-jackpot", "phish-malwares", "spam-mail", "freebie-gifts", "wager-bets", "pokers",
              "pharmacies", "discount-tabs", "popup-clicks", "warezz-cracks", "winners-prize", "trackers"],
    "allow": ["librarian", "museums-guide", "gardener", "newsroom", "theron", "ththre", "tionsh", "schooling",
              "healthy-kitchens", "travels", "historic", "weathers", "villages", "stationer", "cookery", "harbours",
              "musical-evenings", "therat", "letterbox", "student-forums"]}


def test_held_out_hosts(spark, weights):
    """Hosts of other words than the labelled table has: precision and recall of at least 0.9."""
    used = {*u.BLOCKED, *u.ALLOWED}
    rows = []
    for want, hosts in HELD_OUT.items():
        assert not used & {w for h in hosts for w in h.split("-")}
        for n, host in enumerate(hosts):
            for k, path in enumerate(("/", "/en/825", "/de/40.html?page=2", "/fr/7/")):
                sub, suffix = ("", "www.", "m.", "blog.")[(n + k) % 4], ("com", "org", "net")[(n + k) % 3]
                rows.append((f"https://{sub}{host}.example.{suffix}{path}", want))
    got = u.judge(spark.createDataFrame(rows, "url string, want string"), [], weights).collect()
    hit = sum(r.want == r.verdict == "block" for r in got)
    blocked = sum(r.verdict == "block" for r in got)
    wrong = sorted({(r.host, round(r.score, 2)) for r in got if r.want != r.verdict})
    assert hit / blocked >= 0.9 and hit / (4 * len(HELD_OUT["block"])) >= 0.9, wrong


def test_small_and_odd_tables(spark, weights):
    none = spark.createDataFrame([], "url string, label int")
    assert set(u.train(none).first()[0]) == {0.0}
    odd = spark.createDataFrame([(None, 1), ("http://a", None), ("http://b.c/d", 0), ("http://b.c/d", 0)],
                                "url string, label int")
    w, b = descend([("", 1), ("http://b.c/d", 0), ("http://b.c/d", 0)], 5)
    assert np.allclose(u.train(odd, epochs=5).first()[0], [*w, b])
    assert u.judge(none, URL_RULES, weights).collect() == []
    with pytest.raises(ValueError):
        u.judge(none, URL_RULES * 300, weights)


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, None, None), (None, "http://a.net/", "x")], "page_id long, url string, html string") \
        .write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in op9_url_filter(spark, str(tmp_path)).collect()}
    assert (got[None].rule, got[None].verdict, got[1].host, got[1].rule) == ("net/", "block", "", None)
