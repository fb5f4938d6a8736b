"""Mixing, the Jaccard join, exact search, WARC, URL filters and the pipeline."""

import base64
import hashlib
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import common, jaccard, mixing, topk, urlfilter, warc
from lexmill.llm.common import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- mixing


def test_targets():
    t = mixing.targets({"b": 100, "a": 10, None: 50, "c": 40})
    assert sum(t.values()) == pytest.approx(300)
    assert t["a"] == 20 and all(t[n] <= 2 * s + 1e-9 for n, s in {"a": 10, "b": 100, "c": 40, None: 50}.items())
    assert mixing.targets({}) == {} and mixing.targets({"x": 0}) == {"x": 0.0}


def test_tree_splits_exactly():
    quota = np.array([7, 0, 120, 33])
    runs = [mixing.split(quota, 5, k, 3) for k in range(5)]
    assert (sum(n for _, n in runs) == quota).all()
    for s in range(4):
        at = 0
        for begin, n in sorted((int(b[s]), int(n[s])) for b, n in runs if n[s]):
            assert begin == at
            at += n
    assert {int(n.sum()) for _, n in runs} == {32}


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.choice([1, 5, 30, 200]))), None if i % 50 == 0 else "hot" if i % 3 else f"s{i % 7}") for i in range(1500)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mixing(sources):
    sized = cut(mixing.sizes(sources))
    plan = mixing.Plan(sized)
    got = plan.taken(sized).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    assert target == mixing.targets(dict(size))
    assert all(abs(taken[s] - t) <= 30 for s, t in target.items())
    assert sorted((r.doc_id, r.taken) for r in mixing.Plan(cut(mixing.sizes(sources.repartition(5)))).taken(sized).collect()) == sorted((r.doc_id, r.taken) for r in got)
    rows = plan.mixed(sources, 5000).collect()
    times = Counter(r.doc_id for r in rows)
    assert all(times[r.doc_id] * r["size"] == r.taken for r in got)
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows) and len({r.shard for r in rows}) > 5


def test_mixing_against_brute_force(spark, sources):
    """Block choice by plain loops, and the tree by splitting whole lists of draws from the root."""
    sized = cut(mixing.sizes(sources))
    plan = mixing.Plan(sized, seed=5)
    rows = plan.placed(sized).collect()
    words, subs = Counter(), Counter()
    for r in rows:
        words[r[mixing.MIX], r[mixing.BLOCK]] += r["size"]
        subs[r[mixing.MIX], r[mixing.BLOCK], r[mixing.SUB]] += r["size"]
    total = Counter()
    for (s, _), n in words.items():
        total[s] += n
    goal = mixing.targets({None if s == "none" else s[1:]: n for s, n in total.items()})
    draws, part = {}, {}  # lists of (block, copy, whole) by source; sub-blocks of the block drawn in part
    for s in total:
        target = goal[None if s == "none" else s[1:]]
        order = sorted((b for x, b in words if x == s), key=lambda b: mixing.hash_of(5, s, b))
        times = int(target // total[s])
        room, extra = target - times * total[s], []
        for b in order:
            if words[s, b] <= room:
                extra.append(b)
                room -= words[s, b]
        draws[s] = [(b, k, True) for k in range(times) for b in order] + [(b, times, True) for b in order if b in extra]
        rest = [b for b in order if b not in extra]
        if room > 0 and rest:
            b = min(rest, key=lambda b: words[s, b])
            draws[s].append((b, times, False))
            chosen, left = set(), []
            for x in sorted((x for y, z, x in subs if (y, z) == (s, b)), key=lambda x: mixing.hash_of(6, s, x)):
                if subs[s, b, x] <= room:
                    chosen.add(x)
                    room -= subs[s, b, x]
                else:
                    left.append(x)
            if left and subs[s, b, min(left, key=lambda x: subs[s, b, x])] - room < room:
                chosen.add(min(left, key=lambda x: subs[s, b, x]))
            part[s, b] = chosen
    shards = plan.shards(5000)
    assert shards > 8

    def deal(low, high, lists):
        if high - low == 1:
            return {low: lists}
        mid, names = (low + high) // 2, sorted(lists)
        n = sum(map(len, lists.values())) * (mid - low) // (high - low)
        left = np.random.default_rng([5, low, high]).multivariate_hypergeometric([len(lists[x]) for x in names], n, method="marginals")
        return deal(low, mid, {x: lists[x][:k] for x, k in zip(names, left, strict=True)}) | deal(mid, high, {x: lists[x][k:] for x, k in zip(names, left, strict=True)})

    want = Counter()
    for shard, lists in deal(0, shards, draws).items():
        for s, own in lists.items():
            for b, _, whole in own:
                want.update((r.doc_id, shard) for r in rows if (r[mixing.MIX], r[mixing.BLOCK]) == (s, b) and (whole or r[mixing.SUB] in part[s, b]))
    assert Counter((r.doc_id, r.shard) for r in plan.mixed(sources, 5000).collect()) == want
    times = Counter()
    for (k, _), n in want.items():
        times[k] += n
    assert {r.doc_id: r.taken for r in plan.taken(sized, 5000).collect()} == {r.doc_id: r["size"] * times[r.doc_id] for r in rows}


def test_mixing_replaces_own_columns(sources):
    clash = sources.withColumns({x: F.lit("mine") for x in ("source_size", "target", "taken", "size", "copies", "draw", "room", "words")})
    sized = cut(mixing.sizes(clash))
    got = mixing.Plan(sized).taken(sized)
    assert got.count() == 1500 and dict(got.dtypes)["target"] == "double" and got.filter("copies <> 'mine' or draw <> 'mine'").count() == 0
    assert mixing.Plan(sized).mixed(clash).filter("words <> 'mine'").count() == 0


def test_mixing_odd_rows(odd, empty):
    sized = cut(mixing.sizes(odd))
    by_id = {r.doc_id: r["size"] for r in sized.collect()}
    assert by_id[1] == by_id[2] == by_id[3] == 0 and by_id[5] == 30_000
    plan = mixing.Plan(sized)
    assert plan.taken(sized).count() == 11 and plan.mixed(odd).columns[-3:] == ["copy", "shard", "place"]
    none = cut(mixing.sizes(empty))
    assert mixing.Plan(none).taken(none).count() == 0 and mixing.Plan(none).mixed(empty).count() == 0


# ---- n-gram Jaccard join


def grams(text):
    w = [x.lower() for x in WORD.findall(text or "")]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [grams(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), k), k)
    return sorted((k, low[find(i)], links[i]) for i, (k, _) in enumerate(rows))


def near_copies(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(200)]
    rows = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(200)] = word()
        rows.append((i, " ".join(t)))
    return rows


def test_jaccard_join(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 8)  # several tiles for one group
    rows = near_copies(40, 1) + [(100 + i, t) for i, (_, t) in enumerate(near_copies(5, 2))] + [(200, near_copies(1, 1)[0][1])] + [(300 + i, f"one two three four five six {i} eight nine ten") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(df).collect())
    assert got == brute(rows)
    first = {c for _, c, _ in got}
    assert sorted(r.doc_id for r in jaccard.deduplicate(df).collect()) == sorted(first)


def test_jaccard_odd_rows(odd, empty):
    got = jaccard.join(odd).collect()
    assert len(got) == 11
    by = {r.doc_id: (r.class_id, r.n_links) for r in got}
    assert by[1] == by[2] == by[3] == (1, 2) and by[7] == by[8] == (7, 2) and by[5][1] == 0
    assert jaccard.join(empty).count() == 0 and jaccard.deduplicate(empty).count() == 0
    assert set(odd.columns) - {"text"} <= set(jaccard.join(odd).columns) and {r.node for r in jaccard.join(odd).collect()} == {"mine"}
    kept = jaccard.deduplicate(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id is None, r.doc_id, r.text is None) for r in kept.collect()) == [(False, 1, True), (False, 4, False), (False, 5, False), (False, 6, False), (False, 7, False), (False, 9, False), (True, None, False)]


def test_one_row_of_each_class_stays(spark):
    a, b = near_copies(2, 7)[0][1], "other words " * 9
    rows = [(5, a), (9, a), (9, b), (9, b), (None, b), (None, "lone text of some words"), (None, "lone text of some words"), (11, a + " more"), (12, "x")]
    got = jaccard.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, [r for r in spark.createDataFrame([(5, a), (9, b), (None, "lone text of some words"), (12, "x")], "doc_id long, text string").collect()]))


def test_many_homes(spark, monkeypatch):
    """Groups that hang together by chains, tiles and hubs of any size: as by brute force."""
    monkeypatch.setattr(jaccard, "TILE", 4)
    monkeypatch.setattr(jaccard, "HEAVY", 3)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 5)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, text = [], [word() for _ in range(120)]
    for i in range(60):  # each differs a little from the one before
        text = text[2:] + [word(), word()]
        rows.append((i, " ".join(text)))
    rows += [(100 + i, t) for i, t in near_copies(25, 9)] + [(200 + i, rows[3][1]) for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(df).collect()) == brute(rows)


def test_banding_and_components(spark):
    b, r = jaccard.banding(0.8, 0.9999, 128)
    assert (b, r) == (24, 5) and 1 - (1 - 0.8**r) ** b >= 0.9999
    chain = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("x", "y")], "a string, b string")
    got = {r.node: r.root for r in jaccard.components(chain).collect()}
    assert got == {**{f"{i:03d}": "000" for i in range(41)}, "x": "x", "y": "x"}


# ---- exact search


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "FAN", 2)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(150, 6)).astype(np.float32)
    m[40:80] = m[0]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(500, None), (520, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (540, [float("nan")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    got = sorted(map(tuple, topk.search(df, F.col("vec_id") % 20 == 0, k=5).collect()))
    whole = np.floor(64 * m.astype(float)).astype(np.int64)
    want = []
    for q in range(0, 150, 20):
        s = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(150), -s)) if i != q][:5]
        want += [(q, r, int(i), int(s[i])) for r, i in enumerate(order, 1)]
    assert got == sorted(want)
    few = topk.search(df.filter("vec_id < 3"), F.col("vec_id") == 0, k=5).collect()
    assert len(few) == 2
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_repeated_ids(spark):
    """Rows of one id are candidates of each other and queries of their own; columns named like results don't matter."""
    rows = [(0, [1.0, 0.0], 7), (0, [2.0, 0.0], 7), (1, [1.0, 1.0], 7), (2, [0.5, 0.0], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").withColumns({"rank": F.lit("x"), "query_id": F.lit("y")})
    got = topk.search(df, F.col("vec_id") == 0, k=3).collect()
    assert sorted((r.vec_id, r.score) for r in got) == sorted([(0, 2 * 64 * 64), (1, 64 * 64), (2, 32 * 64), (0, 2 * 64 * 64), (1, 2 * 64 * 64), (2, 2 * 32 * 64)])


def test_products_of_any_size():
    q = np.array([[1e15, -3.0], [2.0, 5.0]])
    c = np.array([[1e4, 7.0], [1e15, 1.0]])
    got = topk.products(q, c)
    assert got[0, 0] == 10**19 - 21 if 10**19 - 21 < topk.HIGH else got[0, 0] == topk.HIGH
    assert got[0, 1] == topk.HIGH and got[1].tolist() == [20_035, 2 * 10**15 + 5]


def moved(spark, run):
    """Bytes of all rows that the exchanges of run's queries sent, shuffled or broadcast, before compression."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(60_000)
    before = store.executionsCount()
    run()
    bus.waitUntilEmpty(60_000)
    total, found = 0.0, store.executionsList(before, 10_000)
    for i in range(found.size()):
        values, nodes = store.executionMetrics(found.apply(i).executionId()), store.planGraph(found.apply(i).executionId()).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            for m in (node.metrics().apply(j) for j in range(node.metrics().size())):
                if m.name() == "data size" and values.contains(m.accumulatorId()):
                    number, unit = re.search(r"([\d.,]+) ([KMG]?i?B)", values.apply(m.accumulatorId())).groups()
                    total += float(number.replace(",", "")) * {"B": 1, "KiB": 2**10, "MiB": 2**20, "GiB": 2**30}[unit]
    return total


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_top_k_moves_no_copies(spark, monkeypatch, threshold):
    """What is sent follows the vectors and the lists, not the pairs of blocks, whether Spark takes a side for small or not (F1)."""
    monkeypatch.setattr(topk, "SHARD", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = np.random.default_rng(3)
    m = rng.normal(size=(4000, 64)).astype(np.float32)
    df = cut(spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(4000), "embedding": list(m)})))
    monkeypatch.setattr(topk, "PART_BYTES", 40_000, raising=False)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = []
        sent = moved(spark, lambda: got.extend(topk.search(df, F.col("vec_id") % 20 == 0, k=3).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    whole = np.floor(64 * m.astype(float)).astype(np.int64)
    want = []
    for q in range(0, 4000, 20):
        s = whole @ whole[q]
        s[q] = -(2**62)
        want += [(q, r, int(i), int(s[i])) for r, i in enumerate(np.lexsort((np.arange(4000), -s))[:3], 1)]
    assert sorted(map(tuple, got)) == want
    assert sent < 2 * m.size * 4


def test_lists_over_tiles():
    """Tiles of many equal scores, in any order of ids, as floats or longs."""
    rng = np.random.default_rng(4)
    for kind, low, high in ((np.float32, -3, 3), (np.float32, -500, 500), (np.int64, -2, 2), (np.int64, topk.LOW, topk.LOW + 2)):
        scores, ids = rng.integers(low, high, (5, 900)).astype(kind), rng.permutation(900)
        if kind is np.int64:
            ids[ids == 899] = topk.HIGH
        lists = topk.Lists(5, 4)
        for size, at in ((2, 0), (98, 2), (300, 100), (500, 400)):
            part = np.argsort(ids[at : at + size]) + at
            lists.add(np.ascontiguousarray(scores[:, part]), ids[part])
        for row, s, i in zip(scores.astype(np.int64), lists.scores, lists.ids, strict=True):
            first = np.lexsort((ids, ~row))[:4]
            assert (s.tolist(), i.tolist()) == (row[first].tolist(), ids[first].tolist())


def test_top_k_of_wide_and_narrow_blocks(spark, monkeypatch):
    """Blocks stored as bytes, shorts and doubles meet, and vectors of other lengths are no candidates of each other."""
    monkeypatch.setattr(topk, "SHARD", 8)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=3 + i % 2) * 10 ** (i // 20)]) for i in range(160)]
    got = sorted(map(tuple, topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") % 20 < 2, k=3).collect()))
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    want = []
    for q in (i for i in whole if i % 20 < 2):
        score = {i: sum(map(int.__mul__, whole[q], v)) for i, v in whole.items() if i != q and len(v) == len(whole[q])}
        want += [(q, r, i, score[i]) for r, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:3], 1)]
    assert got == sorted(want)


# ---- WARC


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(5, "http://a/x", "p" * 150), (3, "http://a/y\nz", "p" * 150), (9, None, "p" * 150), (9, "http://a/r", "p" * 150), (4, "u", "short"), (6, "u", "short"), (1, "u", None), (2, "u", ""), (None, "u", "é" * 99), (8, "u", "é" * 99), (7, "u", "q" * 200_000), (3, "u", "p" * 150)]
    return spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, archive string")


def test_warc(pages, tmp_path):
    archives = warc.write(pages, "page_id", "url", "html", archive_bytes=1000)
    got = warc.read(archives, payloads=True).collect()
    assert len(got) == 12
    rows = {(r.page_id, r.payload_digest): r for r in got}
    p = hashlib.sha256(b"p" * 150).hexdigest()
    assert rows[3, p].record_type == "response" and rows[3, p].payload == b"p" * 150 and rows[3, p].refers_to is None
    assert all((rows[k, p].record_type, rows[k, p].refers_to, rows[k, p].payload_bytes) == ("revisit", 3, 150) for k in (5, 9))
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 100)
    e = hashlib.sha256(("é" * 99).encode()).hexdigest()
    assert rows[8, e].record_type == "response" and (rows[None, e].record_type, rows[None, e].refers_to) == ("revisit", 8)
    assert warc.export(archives, str(tmp_path)) == len(list(tmp_path.iterdir()))
    files = archives.sparkSession.read.format("binaryFile").load(str(tmp_path))
    assert warc.read(files).count() == 12
    assert warc.write(pages.limit(0), "page_id", "url", "html").count() == 0


def test_archives_are_checked():
    made = [warc.record(i, f"http://x/{i}", b"some payload %d " % i * 60, "response", hashlib.sha256(b"some payload %d " % i * 60).hexdigest(), None) for i in range(20)]
    good = warc.archive(made)
    size = struct.unpack_from("<I", good, 4)[0]
    assert [h["WARC-Record-ID"] for h, _ in warc.records(good)] == [warc.record_id(i) for i in range(20)]
    plain = zstandard.ZstdCompressor()
    packed = plain.compress(good[8 : 8 + size])
    again = struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + good[8 + size :]
    assert len(list(warc.records(again))) == 20
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(good[8 : 8 + size]))
    for bad in (good[8 + size :], good[:-5], good[:100] + b"\x00" + good[101:], good[: 8 + size] + b"junkjunk", good[: 8 + size] + frame.compress(made[0][:-4]), good[: 8 + size] + frame.compress(made[0] + made[1]), good[: 8 + size] + frame.compress(made[0].replace(b"WARC-Date", b"WARC-Dote")), good[: 8 + size] + frame.compress(made[0].replace(b"payload 0 ", b"payload 9 "))):
        with pytest.raises(warc.Invalid):
            for h, b in warc.records(bad):
                warc.http_payload(h, b)


def foreign(kind, block, version="WARC/1.0", **more):
    head = {"warc-type": kind, "WARC-RECORD-ID": "<urn:uuid:5f0c>", "Warc-Date": "2020-01-01T00:00:00Z", "content-length": len(block), **{k.replace("_", "-"): v for k, v in more.items()}}
    return (version + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def test_archives_of_others(spark):
    body = b"<p>hi</p>"
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\ncontent-type: text/html\r\n\r\n" + body
    made = [
        foreign("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"),
        foreign("response", http, Content_Type="application/http; msgtype=response", WARC_Payload_Digest=f"sha1:{sha1}", WARC_Target_URI="http://x/"),
        foreign("response", http, "WARC/1.1", Content_Type="application/http;msgtype=response", WARC_Payload_Digest="blake3:00", WARC_Block_Digest="sha1:" + hashlib.sha1(http).hexdigest()),
        foreign("revisit", b"HTTP/1.1 200 OK\r\n\r\n", Content_Type="application/http", WARC_Refers_To="<urn:uuid:77>", WARC_Payload_Digest=f"sha1:{sha1}"),
        foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n9\r\n<p>hi</p>\r\n0\r\n\r\n", Content_Type="application/http", WARC_Payload_Digest=f"sha1:{sha1}"),
        foreign("resource", b"plain", Content_Type="text/plain"),
    ]
    press = zstandard.ZstdCompressor()
    data = b"".join(press.compress(x) for x in made)
    got = warc.read(spark.createDataFrame([(bytearray(data),)], "content binary"), payloads=True).collect()
    assert [r.record_type for r in got] == ["warcinfo", "response", "response", "revisit", "response", "resource"]
    assert {r.record_id for r in got} == {"<urn:uuid:5f0c>"} and {r.page_id for r in got} == {None}
    assert got[1].payload_digest == hashlib.sha256(body).hexdigest() and got[1].payload == body and got[1].target_uri == "http://x/"
    assert (got[3].refers_to, got[3].refers_to_id, got[3].payload_digest) == (None, "<urn:uuid:77>", f"sha1:{sha1}") and got[5].payload == b"plain"
    for bad in (foreign("response", http, Content_Type="application/http", WARC_Payload_Digest="sha1:" + "A" * 32), foreign("response", http, WARC_Block_Digest="md5:" + "0" * 32), foreign("response", http, "WARC/2.0")):
        with pytest.raises(warc.Invalid):
            for h, b in warc.records(press.compress(bad)):
                warc.http_payload(h, b)


# ---- URL filters


def test_intervals(spark):
    e = spark.createDataFrame([("block", "host", "a.com", "add", "2024-01-01"), ("block", "host", "a.com", "add", "2024-01-01"), ("block", "host", "a.com", "remove", "2024-02-01"), ("block", "host", "a.com", "add", "2024-03-01"), ("block", "host", "b.com", "add", "2024-01-01"), ("block", "host", "b.com", "remove", "2024-01-01"), ("block", "host", None, "add", "2024-01-01")], "list string, kind string, pattern string, action string, day string")
    got = sorted((r.pattern, str(r["from"]), str(r.until)) for r in urlfilter.intervals(e).collect())
    assert got == [("a.com", "2024-01-01", "2024-02-01"), ("a.com", "2024-03-01", "None")]


def test_evaluate(spark):
    e = spark.createDataFrame([("block", "host", "bad.com", "add", "2024-01-01"), ("block", "host", "bad.com", "remove", "2024-02-01"), ("allow", "host", "ok.bad.com", "add", "2024-01-10"), ("block", "path", "x.org/a/b", "add", "2024-01-01"), ("allow", "path", "x.org/a/b", "add", "2024-06-01")], "list string, kind string, pattern string, action string, day string")
    rows = [(1, "http://bad.com/", "2024-01-15"), (2, "http://bad.com/", "2023-12-31"), (3, "http://bad.com/", "2024-02-01"), (4, "https://u:p@www.Sub.BAD.com:80/x?y#z", "2024-01-15"), (5, "http://ok.bad.com", "2024-01-15"), (6, "http://ok.bad.com", "2024-01-05"), (7, "http://x.org/a//b/c", "2024-03-01"), (8, "http://x.org/a/bc", "2024-03-01"), (9, "http://x.org/a/b", "2024-07-01"), (10, None, "2024-01-15"), (11, "nonsense", "2024-01-15"), (12, "http://bad.com/", None), (1, "http://bad.com/", "2024-01-15")]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "id long, url string, fetched string, verdict string").withColumn("fetched", F.col("fetched").cast("date"))
    got = [(r.id, r.verdict) for r in urlfilter.evaluate(df, e).orderBy("id").collect()]
    blocked = {1, 4, 6, 7}
    assert got == sorted((i, "block" if i in blocked else "allow") for i, *_ in rows)
    assert {r.verdict for r in urlfilter.evaluate(df, e.limit(0)).collect()} == {"allow"} and urlfilter.evaluate(df.limit(0), e).count() == 0


# ---- pipeline


def test_pipeline_stages(spark, prose, tmp_path):
    langs = ["aa", "bb", "cc", "dd"]
    rows = [(i, prose(langs[i % 4], 90), langs[i % 4], f"s{i % 3}") for i in range(120)]
    rows += [(200 + i, rows[i][1] + " Ende", rows[i][2], rows[i][3]) for i in range(10)]  # near copies
    rows += [(300, "too short", "aa", "s0"), (301, None, "aa", "s0"), (302, "12 34 " * 60, "aa", "s0"), (303, "kato kato " * 60, "aa", "s0")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    names, kept = [], docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = kept
        kept = cut(stage(spark, kept, str(tmp_path)))
        names.append(name)
        assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.collect()}
        if len(names) <= 2:
            assert ids == set(range(120)) | set(range(200, 210))
        elif len(names) == 3:
            known = [(r.doc_id, r.text) for r in before.collect()]
            assert ids == {c for _, c, _ in brute(known)} == set(range(120))
        else:
            words = sum(len(WORD.findall(r.text)) for r in kept.collect())
            assert words == pytest.approx(1.5 * sum(len(WORD.findall(r.text)) for r in before.collect()), rel=0.02)
    last = corpus_pipeline.STAGES[4][1](spark, kept, str(tmp_path))
    assert last.count() == kept.count() and last.filter("n_tokens <> size(ids) or n_tokens = 0").count() == 0
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.n_tokens) for r in whole.collect()) == sorted((r.doc_id, r.n_tokens) for r in last.collect())
