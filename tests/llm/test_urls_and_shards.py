import zlib
from collections import Counter, defaultdict

import check_queries
import numpy as np

from ticketloom.llm import sharding, url_filters
from ticketloom.llm.queries import ORACLES, QUERIES, URL_RULES

FOLDER = "/root/testdata/sf0.001"

URLS = [
    None,
    "",
    "no scheme.net/en/",
    "http://EXAMPLE.net",
    "http://a.Example.NET/en/x?y#z",
    "http://a.example.net/enx",
    "http://notexample.net/en/",
    "http://net/",
    "http://.net/",
    "http://b.example.com/de/1",
    "http://b.example.com/de",
    "http://x.org/fr/",
    "http://x.org?u=http://y.net/",
    "x://y://z.net/",
    "http://x.net:80/",
    "http://a.net\n/en/",
    "http://" + "a." * 3_000 + "net/" + "p/" * 3_000,
]


def by_hand(url, rules):
    tail = (url or "").partition("://")[2]
    end = min([tail.find(c) for c in "/?#" if c in tail], default=len(tail))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in tail[:end])
    rest = tail[end:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [
        (len(h + p), v == "block", h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, False, None, "allow"))
    return host, path, best[2], best[3]


def test_url_verdicts_by_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(0, None), (3, URLS[3])]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id LONG, url STRING, host STRING, rule STRING")
    more = [*URL_RULES, ("a.net", "", "allow"), ("net", "/e", "allow"), ("a.net", "", "allow")]
    for rules in (URL_RULES, more):
        table = spark.createDataFrame([*rules, (None, "/", "block")], "host STRING, path STRING, verdict STRING")
        found = url_filters.url_verdicts(pages, table).collect()
        want = [(i, *by_hand(u, rules)) for i, u in rows]
        assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert {r["verdict"] for r in url_filters.url_verdicts(pages, table.limit(0)).collect()} == {"allow"}
    assert url_filters.url_verdicts(pages.limit(0), table).collect() == []


def test_many_rules_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", 0)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id LONG, url STRING")
    rules = spark.createDataFrame(URL_RULES, "host STRING, path STRING, verdict STRING")
    found = url_filters.url_verdicts(pages, rules)
    assert sorted(map(tuple, found.collect())) == sorted((i, *by_hand(u, URL_RULES)) for i, u in enumerate(URLS))


def test_url_query_agrees_with_sql(spark):
    name = "op5_url_filters"
    assert check_queries.compare(QUERIES[name](spark, FOLDER), check_queries.connect(FOLDER), ORACLES[name]) == ""


def test_shards_of_all_kinds_of_rows(edge, none):
    texts = Counter((r["doc_id"], r["text"] or "") for r in edge.collect())
    found = sharding.sharded(edge).collect()
    key = lambda i, t: (i, len(t.encode()) + 1, zlib.crc32(t.encode()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        key(i, t) for (i, t), n in texts.items() for _ in range(n)
    )
    assert {(r["law"], r["grown_shard"]) for r in found} == {("bytes", None)}
    assert sharding.sharded(none).collect() == [] and sharding.sharded(none).columns == sharding.sharded(edge).columns


def shards(found):
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in found:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    return sizes, slots


def test_shards_are_even_and_slots_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LANE_ROWS", 3)
    sizes, slots = shards(QUERIES["op6_sharding"](spark, FOLDER).collect())
    assert set(sizes) == set(range(8))
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_copies_stay_together_unless_their_group_is_large(spark):
    rows = [(i, "hot text") for i in range(400)] + [(1_000 + i, f"text {i // 2}") for i in range(800)]
    found = sharding.sharded(spark.createDataFrame(rows, "doc_id LONG, text STRING"), shards=4, grains=64).collect()
    sizes, _ = shards(found)
    assert max(sizes.values()) - min(sizes.values()) < 0.1 * sum(sizes.values()) / 4
    where = defaultdict(set)
    text = dict(rows)
    for r in found:
        where[text[r["doc_id"]]].add(r["shard"])
    assert where.pop("hot text") == {0, 1, 2, 3} and all(len(s) == 1 for s in where.values())


def test_placing_follows_the_dot_product():
    sizes = np.array([[8, 1, 1], [1, 8, 1], [1, 1, 8], [4, 4, 4], [2, 2, 2], [2, 2, 2]], float)
    placed = sharding.place(sizes, 2)
    room = np.full((2, 3), 0.5)
    shares = sizes / sizes.sum(axis=0)
    for i in sorted(range(6), key=lambda i: (-shares[i, 0], i)):
        fits = [s for s in range(2) if room[s, 0] >= shares[i, 0] - 1e-12]
        best = max(fits, key=lambda s: (round(room[s] @ shares[i], 12), -s)) if fits else int(np.argmax(room[:, 0]))
        assert placed[i] == best
        room[best] -= shares[i]
