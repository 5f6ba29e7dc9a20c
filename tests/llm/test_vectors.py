"""Search and near-duplicates of vectors, and URL verdicts: odd inputs, empty tables, brute-force versions."""

import math
import random

import numpy as np
import pytest

from jobscope.llm import meeting, polytope, topk, urls
from jobscope.llm.common import table

SCHEMA = "vec_id bigint, embedding array<float>, label int, score bigint, node string, visit int, `a.b` int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "n", 2, 3) for i, v, label in rows], SCHEMA)


def as_float(x):
    return float(np.float32(x))


ODD = [
    (0, [0.5, -0.25, 0.125], 1),
    (50, [0.5, -0.25, 0.125], 1),
    (50, [0.5, -0.25, 0.125], 1),
    (100, [0.1, 0.2, 0.3], 1),
    (1, [0.1, 0.2, 0.3], 1),
    (2, [0.2, 0.4, 0.6], 1),
    (3, [0.1, 0.2, 0.3], 2),
    (4, [0.1, 0.2, 0.3], None),
    (5, None, 1),
    (6, [0.0, 0.0, 0.0], 1),
    (7, [float("nan"), 1.0, 1.0], 1),
    (8, [float("inf"), 1.0, 1.0], 1),
    (9, [1.0, None, 1.0], 1),
    (None, [0.1, 0.2, 0.3], 1),
    (11, [0.1, 0.2], 1),
    (12, [], 1),
    (13, [3e38, -3e38, 1.0], 1),
    (150, [-3e38, 3e38, 1.0], 1),
]


def plain_top(rows, k=5, step=50):
    """Sorted result rows; every row but the query's own is a candidate."""
    whole = []
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [max(-(2**63), min(2**63 - 1, math.floor(256 * as_float(x)))) for x in v]))
    out = []
    for n, (i, q) in enumerate(whole):
        if i % step == 0:
            scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, w)))), j) for m, (j, w) in enumerate(whole) if m != n]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("width,few,at_once", [(8, 1 / 16, 64), (3, 0, 2), (24, 0.2, 3)])
def test_search_equals_brute_force(spark, monkeypatch, width, few, at_once):
    """Ties, repeated rows and ids, several shards and blocks; stopping early, late and never."""
    monkeypatch.setattr(topk, "FEW", few)
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", at_once)
    rng = np.random.default_rng(width)
    rows = [(int(i), np.round(rng.normal(size=width) / 4, 1).tolist(), 1) for i in range(700)]
    rows += [(50, (rng.normal(size=width) * 2).tolist(), 1), rows[50], rows[50], (7, rows[100][1], 1), (7, rows[100][1], 1), (60, [0.0] * width, 1)]
    quantised = topk.numbered(vectors(spark, rows))
    index, shards = topk.build_index(quantised, shard_rows=100)
    assert shards == 8
    assert index.where("dimension = -1").selectExpr("sum(size(values))").first()[0] == len(rows)
    queries = quantised.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    got = topk.search(index, shards, queries, query_rows=5)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows)


def test_rows_that_share_an_id(spark):
    rows = [(1, [0.1], 1), (1, [5.0], 1), (2, [1.0], 1), (50, [1.0], 1)]
    got = sorted(tuple(r) for r in topk.top_k(vectors(spark, rows), topk.F.col("vec_id") % 50 == 0).collect())
    assert got == [(50, 1, 1, 1280 * 256), (50, 2, 2, 256 * 256), (50, 3, 1, 25 * 256)] == plain_top(rows)


def test_few_rows_are_scored_in_full():
    """Most rows are out by proof before the last segment where some vectors are alike."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=64)
    data = np.concatenate([rng.normal(size=(2000, 64)), centre + rng.normal(size=(20, 64)) * 0.1])
    data = np.floor(256 * data / np.linalg.norm(data, axis=1)[:, None]).astype(np.int64)
    table = topk.pa.table({"shard": [0] * len(data), "number": np.arange(len(data)), "vec_id": np.arange(len(data)), "vector": data.tolist()})
    shard = topk._Shard(topk._segments(table), 256)
    rows, scores = next(shard.search(np.array([2000]), data[2000:2001], 5))
    assert len(rows) <= len(data) / 16 and 2000 not in rows
    exact = data @ data[2000]
    exact[2000] = -(10**9)
    assert set(np.argsort(-exact)[:5]) <= set(rows) and (exact[rows] == scores).all()


def test_search_of_odd_rows(spark):
    got = topk.top_k(vectors(spark, ODD), topk.F.col("vec_id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in got) == plain_top(ODD)
    assert topk.top_k(vectors(spark, []), topk.F.col("vec_id") % 50 == 0).count() == 0


def plain_links(rows):
    def good(v, label):
        return v is not None and label is not None and any(x for x in v if x) and all(x is not None and math.isfinite(x) for x in v)

    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if good(v, a) and good(w, b) and a == b and len(v) == len(w):
                x, y = (np.array([as_float(c) for c in u]) for u in (v, w))
                x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
                if x @ y >= 0.98 or (x == y).all():
                    n[i] += 1
                    n[j] += 1
                    parent[find(i)] = find(j)
    out = []
    for i, (key, _, _) in enumerate(rows):
        ids = [r[0] for j, r in enumerate(rows) if find(j) == find(i) and r[0] is not None]
        component = min(ids, default=None)
        out.append((key, n[i], component, key == component))
    return sorted(out, key=repr)


def test_links_of_odd_rows(spark):
    got = polytope.near_duplicates(vectors(spark, ODD))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_links(ODD)
    assert polytope.near_duplicates(vectors(spark, [])).count() == 0


@pytest.mark.parametrize("block", [2048, 4])
def test_links_and_recall(spark, block):
    """Every link found is right, and nearly all are found; crowded buckets give the same."""
    rng = np.random.default_rng(3)
    rows = []
    for c in range(30):
        centre = rng.normal(size=32)
        for _ in range(8):
            near = centre + rng.normal(size=32) * 0.11
            rows.append((len(rows), near.tolist(), c % 3))
    rows += [(1000 + i, rows[0][1], 0) for i in range(20)]
    got = sorted(tuple(r) for r in polytope.near_duplicates(vectors(spark, rows), block=block).collect())
    want = plain_links(rows)
    found, true = ({r[0]: r[1] for r in x} for x in (got, want))
    assert all(found[i] <= true[i] for i in true)
    assert sum(found.values()) >= 0.97 * sum(true.values()) > 0


def test_rows_that_meet_across_batches():
    """Meetings give each pair of a living row and a later row of its key once, however batches are cut."""
    rng = np.random.default_rng(1)
    key = np.sort(rng.integers(0, 12, 200))
    visit = rng.integers(0, 2, 200)
    order = np.lexsort((visit, key))
    key, visit, name = key[order], visit[order], np.arange(200)
    want = {(int(a), int(b)) for a in range(200) for b in range(a) if key[a] == key[b] and visit[b] == 0}
    for size in (1, 7, 64, 200):
        m, got = meeting.Meetings(pairs_at_once=10), []
        for at in range(0, 200, size):
            s = slice(at, at + size)
            columns, pairs = m.take(key[s], np.zeros(len(key[s]), dtype=int), visit[s], name[s])
            for mine, theirs in pairs:
                got += zip(columns[3][mine].tolist(), columns[3][theirs].tolist())
        assert len(got) == len(want) and set(got) == want


# URLs


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.index(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def plain_rule(host, path):
    best = None
    for verdict, rule in urls.RULES:
        domain, _, start = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best or (None, None)


URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "http://ORG/x", "HTTP://A.Example.ORG/es/1", "https://example.org/es", "https://example.org/es/",
    "https://xexample.org/en/1", "https://x.example.org/en/12?a=b", "https://example.org/en/2", "http://b.com/fr/1#x", "http://b.com/fr?x=/fr/", "http://com/de/",
    "http://c.com/DE/", "http://d.net/de/1", "x://y?z://com/de/", "http://É.com/fr/", "http://a.com#/fr/", "http://a\n.com/fr/", "http://" + "a" * 50000 + ".com/de/" + "1" * 50000,
]


def test_rules_equal_brute_force(spark):
    rng = random.Random(8)
    more = [f"http{rng.choice(['', 's'])}://{rng.choice(['a.', '', 'b.c.'])}example.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.randint(1, 99)}{rng.choice(['', '?p=1', '#t'])}" for _ in range(600)]
    rows = [(i, u, "h", "q") for i, u in enumerate(URLS + more)] + [(None, "http://x.net/", None, None), (0, None, "h", "q")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, rule string")
    got = urls.judge(pages).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for i, url, _, _ in rows[:-2]:
        host, path = plain_parts(url)
        verdict, rule = plain_rule(host, path)
        assert (by_id[i].host, by_id[i].path, by_id[i].rule) == (host, path, rule), url
        assert by_id[i].verdict == verdict if verdict else by_id[i].verdict in ("allow", "block")


def test_trees_learn_and_degenerate_tables(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, f"http://s{rng.randint(1, 40)}.example.{'org' if i % 2 else 'com'}/{rng.choice(['x', 'es', 'fr']) if i % 2 else 'de'}/{rng.randint(1, 9)}") for i in range(800)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    features = urls.featured(pages)
    judged = urls.train(features).verdicts(features).where("decided is not null")
    assert judged.where("judged = decided").count() / judged.count() > 0.9
    none = spark.createDataFrame([(1, "http://x.net/a"), (2, None)], "page_id bigint, url string")
    assert [r.verdict for r in urls.judge(none).collect()] == ["allow", "allow"]
    only = spark.createDataFrame([(1, "http://x.com/de/"), (2, "http://x.net/a")], "page_id bigint, url string")
    assert [r.verdict for r in urls.judge(only).collect()] == ["block", "block"]
    assert urls.judge(pages.limit(0)).count() == 0


def test_tables_are_read_by_spark(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    assert table(spark, str(tmp_path), "t").count() == 3


def test_suffixes_are_counted_on_all_labelled_urls(spark):
    rows = [(i, f"https://d{i}.com/{('fr', 'de')[i % 2]}/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    model = urls.train(urls.featured(pages), sample_rows=40)
    shares = {r.suffix2: r.suffix2_share for r in model.suffixes["suffix2"].collect()}
    assert shares == {f"d{i}.com": pytest.approx((i % 2 + urls.PRIOR_WEIGHT * 0.5) / (1 + urls.PRIOR_WEIGHT)) for i in range(400)}
