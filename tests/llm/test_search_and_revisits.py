"""Top-k search and revisit resolution against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riskloom.llm import revisit, tables, topk


@pytest.fixture(scope="module")
def ship(spark):
    return tables.ship(spark)


VECTORS = "vec_id long, embedding array<float>, ids string, block long, score double"


def vectors(n, width, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(width)], "x", 1, 0.5) for i in range(n)]
    rows += [(n + i, list(rows[i % min(n, 7)][1]), "x", 1, 0.5) for i in range(40)]  # ties
    rows += [(5000, None, "x", 1, 0.5), (5050, [float("nan")] * width, "x", 1, 0.5), (5100, [None] + [0.1] * (width - 1), "x", 1, 0.5),
             (5150, [float("inf")] * width, "x", 1, 0.5), (None, [0.1] * width, "x", 1, 0.5), (5200, [], "x", 1, 0.5), (5250, [0.5], "x", 1, 0.5),
             (5251, [0.5], "x", 1, 0.5), (5251, [0.5], "x", 1, 0.5)]
    return rows


def brute(rows, k):
    kept = {}
    for vec_id, vector, *_ in rows:
        if vec_id is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept[vec_id] = [math.floor(256 * x) for x in vector]
    out = []
    for q in kept:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(kept[q], v, strict=False)), c) for c, v in kept.items() if c != q)[:k]
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("n,width,k", [(700, 16, 5), (700, 64, 5), (3, 4, 5)])
def test_top_k(ship, n, width, k, monkeypatch):
    frame = ship.createDataFrame(vectors(n, width, n), VECTORS)
    rows = [(r[0], r[1]) for r in frame.collect()]  # as floats
    found = topk.top_k(frame.repartition(4), F.col("vec_id") % 50 == 0, k)
    assert sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, k)


def test_large_components(ship):
    rows = [(0, [1e6, 2.0]), (1, [1e6, -1.0]), (2, [-1e6, 3.0]), (3, [1e18, 1.0])]
    found = topk.top_k(ship.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 3).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])][1:] == [(1, 256000000 ** 2 - 512 * 256), (2, -(256000000 ** 2) + 512 * 768)]
    assert found and max(r["score"] for r in found) == (1 << 63) - 1


def test_no_vectors_or_no_queries(ship):
    assert topk.top_k(ship.createDataFrame([], VECTORS), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(ship.createDataFrame(vectors(20, 4, 1), VECTORS), F.lit(False)).count() == 0


RECORDS = "record_id long, url string, fetched long, kind string, status int, headers map<string,string>, part int, stored string"


def crawl(n, seed):
    rng = random.Random(seed)
    urls = ["http://www.A.example/x/", "https://a.example/x", "http://m.a.example:80/x.html#top", "https://b.example/y?utm_source=q&p=1", "b.example/y?p=1", "c.example", None]
    rows = []
    for i in range(n):
        kind = rng.choice(["response", "revisit", "revisit"])
        headers = {k: v for k, v in (("etag", rng.choice(["1", "2", None])), ("last-modified", rng.choice(["m1", "m2"])), ("date", str(i)), ("server", f"s{i}")) if v}
        rows.append((i, rng.choice(urls[:1] * 6 + urls), rng.choice([rng.randrange(60), None]) if i % 13 == 0 else rng.randrange(60), kind, rng.choice([200, 200, 404]) if kind == "response" else 304,
                     headers if i % 17 else None, 7, "x"))
    return rows


KEYS = {"http://www.A.example/x/": "a.example/x", "https://a.example/x": "a.example/x", "http://m.a.example:80/x.html#top": "a.example/x",
        "https://b.example/y?utm_source=q&p=1": "b.example/y?p=1", "b.example/y?p=1": "b.example/y?p=1", "c.example": "c.example", None: None}


def test_revisits(ship):
    rows = crawl(600, 3)
    expected = []
    for r in rows:
        if r[3] != "revisit":
            continue
        own = r[5] or {}
        earlier = [s for s in rows if s[3] == "response" and s[4] == 200 and None not in (s[2], r[2], r[1], s[1]) and KEYS[s[1]] == KEYS[r[1]] and (s[2], s[0]) < (r[2], r[0])]
        if not earlier:
            expected.append((r[0], KEYS[r[1]], None, "missing", sorted(own.items())))
            continue
        best = max(earlier, key=lambda s: (s[2], s[0]))
        old = best[5] or {}
        if "etag" in own and "etag" in old:
            good = own["etag"] == old["etag"]
        else:
            good = "last-modified" not in own or "last-modified" not in old or own["last-modified"] == old["last-modified"]
        merged = {**old, **{k: v for k, v in own.items() if k in revisit.UPDATABLE}} if good else own
        expected.append((r[0], KEYS[r[1]], best[0], "resolved" if good else "changed", sorted(merged.items())))
    found = revisit.resolve(ship.createDataFrame(rows, RECORDS).repartition(5)).collect()
    assert sorted(((r["record_id"], r["url_key"], r["response_id"], r["outcome"], sorted(r["headers"].items())) for r in found), key=str) == sorted(expected, key=str)
    assert {r["outcome"] for r in found} == {"missing", "resolved", "changed"}


def test_no_records(ship):
    assert revisit.resolve(ship.createDataFrame([], RECORDS)).count() == 0
