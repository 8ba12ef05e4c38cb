import hashlib
import random
import zlib

import pytest

from siftstone.llm import exact_dedup, sharding, urlfilter

TEXTS = [(1, "a"), (2, "a"), (3, "a "), (4, None), (5, ""), (6, "é" * 70_000), (7, "é" * 70_000), (7, "é" * 70_000), (None, "a"), (None, "solo")]


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "x", 0) for a, b in rows], "doc_id long, text string, _sha string, keep_id int")


def test_exact_dedup(spark):
    rows = TEXTS + [(100 + i, "hot") for i in range(500)]
    got = exact_dedup.exact_dedup(frame(spark, rows), salts=4).collect()
    groups = {}
    for k, t in rows:
        groups.setdefault(t or "", []).append(k)
    want = []
    for k, t in rows:
        ids = [i for i in groups[t or ""] if i is not None]
        keep = max(ids) if ids else None
        want.append((k, keep, len(groups[t or ""]), k == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kept = exact_dedup.keep_distinct(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "_sha", "keep_id"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(k, t) for (k, t), w in zip(rows, want) if w[3]], key=str)
    assert exact_dedup.exact_dedup(frame(spark, rows).limit(0)).count() == 0


def smallest_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, load = (low + high) // 2, 1, 0
        for s in sizes:
            if load + s > mid:
                used, load = used + 1, 0
            load += s
        if used <= shards:
            high = mid
        else:
            low = mid + 1
    return low


@pytest.mark.parametrize("seed", range(3))
def test_sharding(spark, monkeypatch, seed):
    monkeypatch.setattr(sharding, "FIRST", 1)
    monkeypatch.setattr(sharding, "STEP", 1)  # coarse ranges, so that several are split
    rng = random.Random(seed)
    rows = [(5000 + i, "t" * rng.choice([0, 1, 5, 80, 900]) + str(rng.randrange(90))) for i in range(300)]
    rows += TEXTS[:6] + [(1000 + i, "copy " * (7 if seed else 200)) for i in range(150)]
    got = sharding.assign_shards(frame(spark, rows), 8).collect()
    assert sorted(r.doc_id for r in got) == sorted(k for k, _ in rows) and {r.law for r in got} == {"bytes"}
    text = dict(rows)
    by_group, slots, loads = {}, {}, {}
    for r in got:
        t = text[r.doc_id] or ""
        assert r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode()) and r.grown_shard is None
        by_group.setdefault(t, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    assert all(len(s) == 1 for s in by_group.values()) and set(slots) <= set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = {}
    for _, t in rows:
        h = hashlib.sha256((t or "").encode()).hexdigest()
        sizes[h] = sizes.get(h, 0) + len((t or "").encode()) + 1
    assert max(loads.values()) <= smallest_capacity([sizes[h] for h in sorted(sizes)], 8)


def test_sharding_of_little(spark):
    assert sharding.assign_shards(frame(spark, []), 8).count() == 0
    few = sharding.assign_shards(frame(spark, [(1, "a"), (1, "a"), (None, None)]), 8).collect()
    assert len(few) == 3 and all(0 <= r.shard < 8 for r in few)


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(h.count("."), len(p), a, h, p) for a, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] + best[4] if best else None, best[2] if best else "allow"


def test_url_filters(spark):
    rng = random.Random(8)
    hosts = ["com", "example.com", "www.example.com", "net", "a.net", "b.a.net", "xexample.com", "WWW.Example.COM", "", "é.net", "example.com:80"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/es/", "/es", "/fr/y?q=/en/", "/en/#/es/", "?a", "#b", "/%65n/"]
    rules = [*urlfilter.DEFAULT_RULES, ("block", "net", "/"), ("block", "a.net", "/e"), ("allow", "a.net", "/en/x"), ("allow", "a.net", ""), ("block", "com", "/en")]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + [None, "", "no scheme", "://", "http:///en/", "x://com/" + "y" * 50_000]
    urls += ["https://hot.example.com/en/1"] * 200
    rows = [(i % 590, u, "z") for i, u in enumerate(urls)] + [(None, "http://a.net/en/x", "z")]
    for chosen in (rules, list(urlfilter.DEFAULT_RULES), []):
        got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), urlfilter.rule_table(spark, chosen)).collect()
        assert sorted(map(tuple, got), key=str) == sorted([(k, *judge(u, chosen)) for k, u, _ in rows], key=str)
    assert urlfilter.filter_urls(spark.createDataFrame([], "page_id long, url string"), urlfilter.rule_table(spark, rules)).count() == 0
