import zlib

import numpy as np

from tidecast.llm import url_filter as U


def brute(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
    m = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    path = rest[n:m]
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = [
    "http://Example.com/en/1", "https://www.example.com/en/x?y#z", "https://a.example.com/en/", "https://example.com/de/", "https://example.net/es/1", "http://x.net/fr/2#f", "http://net/fr/",
    "http://notexample.com/en/", "http://com", "http://com?x=/en/", "http://com/", "mailto:x@y", "", None, "://", "http://", "http://ÄB.net/es/é", "http://a.net\n/es/", "x://y://z.com/a", "http://planet/es/",
    "http://casino-slots-bonus.example/jackpot", "http://www.museum.example/en/guide",
]


def test_rules_and_edges(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[0], "h"), (0, URLS[0], "h")]
    got = U.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute(URLS[r.page_id or 0])
        assert (r.host, r.path, r.rule) == (host, path, rule), URLS[r.page_id or 0]
        assert r.verdict == (verdict or ("block" if r.p_block >= U.THRESHOLD else "allow")) and (r.p_block is None) == (rule is not None)
        assert rule or abs(r.p_block - brute_score(host, path)) < 1e-9
    assert {r.page_id: r.verdict for r in got}[len(URLS) - 2] == "block" and {r.page_id: r.verdict for r in got}[len(URLS) - 1] == "allow"
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def brute_grams(host, path):
    """The distinct n-grams as (part, text), without hashes."""
    out = set()
    for mark, part in (("h", host), ("p", path)):
        raw = b"^" + part.encode() + b"$"
        out |= {(mark, raw[i : i + n]) for n in (3, 4, 5) for i in range(len(raw) - n + 1)}
    return out


def index_of(gram):
    """A gram's number by integers of any size."""
    mark, raw = gram
    value = {"h": 1, "p": 2}[mark]
    for b in raw:
        value = value * 257 + b
    return ((value + (len(raw) << 48)) * 0x9E3779B97F4A7C15 % 2**64) >> 48


def brute_score(host, path):
    model = U.default_model()
    found = {index_of(g) for g in brute_grams(host, path)}
    total = model.bias + sum(model.weights[i] for i in found) / max(1, len(found)) ** 0.5
    return 1 / (1 + np.exp(-total))


def test_grams():
    hosts, paths = ["a.example", "", "éa", "aaaaaa"], ["/x", "", "/" + "ab" * 500, "/aaa"]
    at, index = U.grams(hosts, paths, 16)
    for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        assert set(index[at == i].tolist()) == {index_of(g) for g in brute_grams(h, p)}


def held_out(fold):
    table = U.labelled()
    fold, label, p = np.array([fold(i, r) % 5 for i, r in enumerate(table)]), np.array([r[2] for r in table]), np.zeros(len(table))
    for k in range(5):
        asked = [r for r, f in zip(table, fold, strict=True) if f == k]
        p[fold == k] = U.train([r for r, f in zip(table, fold, strict=True) if f != k]).score([r[0] for r in asked], [r[1] for r in asked])
    return (p[label == 1] >= U.THRESHOLD).mean(), (p[label == 0] >= U.THRESHOLD).mean()


def test_held_out():
    """Urls of words that the model has seen in other urls, and of words that it has never seen."""
    caught, wrong = held_out(lambda i, r: zlib.crc32((r[0] + r[1]).encode()))
    assert caught > 0.85 and wrong < 0.03
    caught, wrong = held_out(lambda i, r: zlib.crc32(r[3].encode()))
    assert caught > 0.78 and wrong < 0.05


def test_long_urls_and_many(spark):
    rows = [(i, f"https://casino-{'a' * 70_000 if i == 5 else i}.example.org/{'b' * 90_000 if i == 6 else ''}") for i in range(5000)]
    got = U.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == 5000 and np.mean([r.verdict == "block" for r in got]) > 0.99
    assert abs(got[6].p_block - brute_score(got[6].host, got[6].path)) < 1e-9
