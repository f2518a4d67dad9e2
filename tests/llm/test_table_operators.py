"""Operators on whole tables: join, mixing, repeats, shards, sketches, search."""

from __future__ import annotations

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_samples import prose

from trajspark.llm import fingerprints, graph, hashing, jaccard_join, mixing, sharding, suffix_dedup, topk


def shingles(text):
    w = (text or "").split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_join(rows):
    sets = [shingles(t) for _, t in rows]
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    top, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if near(sets[i], sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = top[i], top[j]
                top = [min(a, b) if t in (a, b) else t for t in top]
    least = {t: min((rows[k][0] for k in range(len(rows)) if top[k] == t and rows[k][0] is not None), default=None) for t in top}
    return sorted(((rows[k][0], least[top[k]], links[k]) for k in range(len(rows))), key=str)


@pytest.mark.parametrize("block", [512, 3])
def test_jaccard_join(spark, edge, edge_rows, block):
    got = jaccard_join.jaccard_join(edge, block=block).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute_join([(r[0], r[1]) for r in edge_rows])


def test_jaccard_join_of_a_crowd(spark):
    """Many near copies of one text and one common passage: blocks of ten make many tasks and lose nothing."""
    base, rows = prose(3, 120).split(), []
    for k in range(60):
        w = list(base)
        w[(k * 7) % 110] = f"changed{k}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, prose(50 + k, 30) + " " + prose(4, 40)) for k in range(20)]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), block=10).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == brute_join(rows)


def test_keep_one_each(edge, empty, edge_rows):
    kept = jaccard_join.keep_one_each(edge)
    assert kept.columns == edge.columns
    classes = {(c, None if c is not None else l) for _, c, l in brute_join([(r[0], r[1]) for r in edge_rows])}
    assert kept.count() == len(classes)
    assert jaccard_join.keep_one_each(empty).count() == 0 and jaccard_join.jaccard_join(empty).count() == 0


def test_pruning_table():
    for n in (32, 64, 128):
        m = jaccard_join.needed(n)
        tail = lambda k: sum(math.comb(n + 1, j) * .8 ** j * .2 ** (n + 1 - j) for j in range(k + 1))
        assert tail(m) >= jaccard_join.TOLERANCE > tail(m - 1)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (7, 3)] + [(20 + k, 21 + k) for k in range(30)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {2: 1, 3: 1, 7: 1, 9: 8, **{21 + k: 20 for k in range(30)}}


def test_word_hashes_follow_words():
    texts = ["a bb  a", "", None, " x\ty\n", "bb"]
    (raw,) = list(hashing.pieces(texts))
    h, n = hashing.words(raw)
    assert n.tolist() == [3, 0, 0, 2, 1] and h[0] == h[2] != h[1] == h[5] and len(set(h.tolist())) == 4
    s, m = hashing.shingles(*hashing.words([b"a b c d e f", b"a b c d e", b"a b", b""]))
    assert m.tolist() == [2, 1, 1, 0] and s[0] == s[2] and len(set(s.tolist())) == 3


def water_level(sizes, weights, share=1.5, epochs=2):
    """Share by weight; full ones stop and the excess is shared anew."""
    target, open_, left = {}, dict(sizes), share * sum(sizes.values())
    while open_:
        total = sum(weights[s] for s in open_)
        full = {s: epochs * n for s, n in open_.items() if left * weights[s] / total >= epochs * n}
        if not full:
            target.update({s: left * weights[s] / total for s in open_})
            break
        target.update(full)
        left -= sum(full.values())
        open_ = {s: n for s, n in open_.items() if s not in full}
    return target


def test_mix(edge, empty, edge_rows):
    mixed = mixing.mix(edge)
    assert sorted(mixed.columns) == sorted({*edge.columns, "size", "source_size", "target", "taken"})
    got = mixed.collect()
    assert len(got) == len(edge_rows)
    sizes = collections.Counter()
    for r in edge_rows:
        sizes[r[3]] += len((r[1] or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_level(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    taken = collections.Counter()
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    assert {s: taken[s] for s in sizes} == {s: math.floor(want[s] + 1e-9) for s in sizes}
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(edge.repartition(3)).collect()))
    assert mixing.mix(empty).count() == 0


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    times = collections.Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if times[r[i:i + length]] > 1:
                gone[i:i + length] = True
        out.append(bytes(np.frombuffer(r, np.uint8)[~gone]))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=24, max_size=60).map(lambda b: bytes(97 + x % 2 for x in b)), st.integers(1, 2)), min_size=1, max_size=8), st.sampled_from([8, 20]), st.sampled_from([40, 10_000]))
def test_suffix_arrays_find_equal_windows(parts, length, piece):
    bodies, weights = [b for b, _ in parts], [w for _, w in parts]
    times = collections.Counter()
    for b, w in parts:
        for i in range(len(b) - length + 1):
            times[b[i:i + length]] += w
    got = suffix_dedup.repeated(bodies, weights, length, piece)
    assert [g.tolist() for g in got] == [[times[b[i:i + length]] > 1 for i in range(len(b) - length + 1)] for b in bodies]


def test_suffix_array_and_prefixes():
    data = np.frombuffer(b"mississippi_mississippi", np.uint8)
    order, first = suffix_dedup.suffix_array(data)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:].tobytes())
    lcp = suffix_dedup.common_prefixes(data, order, first, 6)
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert lcp[1:].tolist() == [min(6, common(data[a:], data[b:])) for a, b in zip(order, order[1:])]


@pytest.mark.parametrize("crowd", [1000, 2])
def test_remove_repeats(edge, edge_rows, crowd):
    length, gram = 60, 20
    got = suffix_dedup.remove_repeats(edge, length=length, gram=gram, crowd=crowd).collect()
    want = sorted(map(str, zip([r[0] for r in edge_rows], brute_repeats([r[1] for r in edge_rows], length))))
    assert sorted(str((r["doc_id"], bytes(r["kept"]))) for r in got) == want
    assert all(r["n_bytes"] - len(r["kept"]) == sum(x["end"] - x["start"] for x in r["runs"]) for r in got)


def test_remove_repeats_of_a_common_passage(spark, empty):
    passage = prose(7, 30)
    rows = [(k, prose(200 + k, 25) + passage + prose(300 + k, 25)) for k in range(40)]
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=80, gram=24, crowd=5).collect()}
    assert [got[k] for k in range(40)] == brute_repeats([t for _, t in rows], 80)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_shards(spark, edge, empty, edge_rows):
    got = sharding.shard_documents(edge, shards=4).collect()
    assert len(got) == len(edge_rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    assert sharding.shard_documents(empty).count() == 0


def test_shards_are_even_with_one_text_in_a_third_of_rows(spark):
    rows = [(k, "the same text again" if k % 3 == 0 else prose(k, 5 + k % 40)) for k in range(6000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    size = collections.Counter()
    for r in got:
        size[r["shard"]] += len(r["text"].encode()) + 8
    assert len(size) == 24 and max(size.values()) - min(size.values()) < 1200
    again = sharding.shard_documents(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shards_cut_equal_rows_without_ids(spark):
    rows = [(None, "the same line again")] * 3000 + [(k, f"line {k:07d} of many") for k in range(3000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards=8).collect()
    size, slots = dict.fromkeys(range(8), 0), {k: [] for k in range(8)}
    for r in got:
        size[r["shard"]] += len(r["text"]) + 8
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 6000 and len(size) == 8 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(size.values()) - min(size.values()) <= 2 * 30


def jaccard(a, b):
    keys = lambda t: collections.Counter(fingerprints.PARAGRAPH.findall(t))
    x, y = keys(a), keys(b)
    return 1.0 if not x and not y else sum((x & y).values()) / sum((x | y).values())


def test_fingerprints(spark, edge, empty, edge_rows):
    got = fingerprints.fingerprint_versions(edge).collect()
    assert len(got) == len(edge_rows)
    rows = sorted(((r[0], r[1] or "") for r in edge_rows if r[0] is not None))
    want = []
    for (i, t), (_, f) in zip(rows, rows[1:] + rows[:1]):
        q = len(t) // 4
        e = t[:len(t) - q] + f[:q]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), jaccard(t, e), jaccard(t, f)))
    mine = sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got if r["doc_id"] is not None)
    assert [m[:3] for m in mine] == [w[:3] for w in sorted(want)] and np.allclose([m[3:] for m in mine], [w[3:] for w in sorted(want)])
    prints = collections.defaultdict(set)
    texts = {r[0]: r[1] for r in edge_rows}
    for r in got:
        prints[texts[r["doc_id"]] if r["doc_id"] is not None else r["n_chars"]].add(r["fingerprint"])
    assert all(len(p) == 1 for t, p in prints.items() if t is not None)
    assert fingerprints.fingerprint_versions(empty).count() == 0


def test_sketches_peel_and_retry():
    a = np.arange(100, dtype=np.uint64) * np.uint64(977) + np.uint64(5)
    s = fingerprints.Sketches(1, 24)
    s.add(np.zeros(100, int), a)
    s.add(np.zeros(97, int), a[:97], -1)
    row, key, sign, empty = s.peel()
    assert empty.all() and sorted(key.tolist()) == a[97:].tolist() and (sign == 1).all()
    s = fingerprints.Sketches(1, 24)
    s.add(np.zeros(100, int), a)
    assert not s.peel()[3].any()
    zero = np.zeros(100, int)
    assert fingerprints.likeness(1, (zero, a), (zero[:50], a[50:])).tolist() == [0.5]


def test_ranges_of_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 5)
    rows = [(k * 3, prose(k, 20)) for k in range(60)] + [(30, "twice"), (30, "twice")]
    got = fingerprints.fingerprint_versions(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    order = sorted(rows)
    want = sorted(hashlib.sha256((t[:len(t) - len(t) // 4] + f[:len(t) // 4]).encode()).hexdigest() for (_, t), (_, f) in zip(order, order[1:] + order[:1]))
    assert sorted(r["edited_sha256"] for r in got) == want


def brute_top(rows, every, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        v = min(((len(w), w) for i, w in ok if i == q))[1]
        found = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v)))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=4).astype("f4")]) for k in range(300)]
    rows += [(300 + k, [0.5, 0.5, 0.5, 0.5]) for k in range(80)] + [(10, [9.0, 0.0, 0.0, 0.0]), (10, [9.0, 0.0, 0.0, 0.0])]
    rows += [(None, [1.0] * 4), (400, None), (410, [1.0, None, 0.0, 0.0]), (420, [float("nan")] * 4), (430, [float("inf"), 0.0, 0.0, 0.0]), (440, []), (450, [1.0, 2.0]), (451, [2.0, 2.0])]
    monkeypatch.setattr(topk, "BLOCK_VECTORS", 100)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 10)
    monkeypatch.setattr(topk, "PAGE", 8)
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int").repartition(4)
    got = topk.top_k(df, every=10).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 10, 5)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_beside_many_rows_of_the_query(spark, monkeypatch):
    """Id 0 has ten equal rows and thirty others of its own; each of these vectors is also another id's."""
    rows = [(0, [2.0, 1.0])] * 10 + [(7, [2.0, 1.0])] * 3 + [(k, [2.0, 1.0]) for k in (3, 11)] + [(0, [9.0 + k, 5.0]) for k in range(30)] + [(20 + k, [1.0, k / 64]) for k in range(9)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10).filter("query_id = 0").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [3, 7, 7, 7, 11]
    for ids in ([1] * 10 + [2], [1] * 10 + [2] * 9 + [3], [1, 2, 3], [1, 1, 2, 2, 3, 3, 4, 4, 5], list(range(20))):
        kept = topk.enough(np.array(ids), 3).tolist()
        assert all([i for i in kept if i != q][:3] == [i for i in ids if i != q][:3] for q in [*ids, 99]) and len(kept) <= 6


def test_mtree_skips_what_bounds_rule_out():
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (20, 3))
    v = np.concatenate([c + rng.integers(-9, 9, (400, 3)) for c in centres])
    tree = topk.MTree(np.arange(len(v)), v, 5)
    got = tree.search(-1, v[0], 5)
    s = v @ v[0]
    best = np.lexsort((np.arange(len(v)), -s))[:5]
    assert got == [(int(s[i]), int(i)) for i in best] and tree.computed < len(v) / 2


def brute_whole(rows, every=50, k=5, scale=256):
    ints = [(i, [math.floor(v * scale) for v in x]) for i, x in rows]
    out = []
    for i, q in ints:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ints if j != i)[:k]
            out += [(i, r + 1, j, -s if abs(s) <= topk.LONG else None) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def test_top_k_of_large_components(spark, monkeypatch):
    """Scores beyond 2^53 are whole numbers, those beyond 64 bits are in order though null; no component is too large."""
    monkeypatch.setattr(topk, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(topk, "PAGE", 4)
    r = np.random.default_rng(5)
    for size in (1e7, 8e6, 1e10):
        rows = [(k, (r.normal(size=6) * size).round(2).tolist()) for k in range(120)] + [(200, [8e6, 0.1, 0.0, 0.0, 0.0, 0.0]), (201, [8e6, 0.1, 0.0, 0.0, 0.0, 0.0])]
        got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
        assert sorted(map(tuple, got)) == brute_whole(rows)
    rows = [(0, [1e200, 1.0]), (1, [1e200, 2.0]), (2, [-1e200, 2.0]), (3, [1.0, 1.0]), (4, [1.7e308, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("query_id = 0").orderBy("rank").collect()
    assert [(g["vec_id"], g["score"] is None) for g in got] == [(1, True), (3, True), (2, True)]


@given(st.lists(st.integers(-(1 << 300), 1 << 300), max_size=30))
def test_sortable_scores(values):
    assert [topk.sortable(v) for v in sorted(values)] == sorted(map(topk.sortable, values))


def test_repeats_query_equals_brute_force(spark, tmp_path):
    """The columns of the query, on texts with shared passages."""
    shared = prose(7, 90)
    rows = [(k, prose(30 + k, 20 + 5 * k) + (" " + shared + " " if k % 3 == 0 else "") + ("ü" * 450 if k in (4, 8) else "")) for k in range(12)] + [(20, None), (21, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    raws = {i: (t or "").encode() for i, t in rows}
    seen = collections.Counter(raw[a:a + 400] for raw in raws.values() for a in range(len(raw) - 399))
    for got in suffix_dedup.op6(spark, str(tmp_path)).collect():
        raw = raws[got["doc_id"]]
        gone = [any(seen[raw[a:a + 400]] > 1 for a in range(max(0, b - 399), min(b, len(raw) - 400) + 1)) for b in range(len(raw))]
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (b and gone[b - 1]) for b, g in enumerate(gone))
        assert (got["n_bytes"], got["n_removed"], got["n_spans"]) == (len(raw), sum(gone), spans)
        assert got["kept_sha256"] == hashlib.sha256(kept).hexdigest() and got["kept_text"] == kept.decode("utf-8", "replace")
        assert got["removed_share"] == (sum(gone) / len(raw) if raw else 0)


def brute_shared_words(texts, width):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    holders = collections.defaultdict(set)
    for k, w in enumerate(split):
        for i in range(len(w) - width + 1):
            holders[tuple(w[i:i + width])].add(k)
    out = []
    for w in split:
        hit = [i for i in range(len(w) - width + 1) if len(holders[tuple(w[i:i + width])]) > 1]
        out.append(len({j for i in hit for j in range(i, i + width)}))
    return out


@pytest.mark.parametrize("crowd", [1000, 1])
def test_passages_of_over_50_words(spark, crowd):
    """Passages too short to be removed are counted where another row holds them too, whatever white space parts their words."""
    short = [" ".join(f"{'abcdefg'[(k * j + j) % 7]}{j % 10}" for j in range(51 + k)) for k in range(3)]
    assert all(len(p) < 200 for p in short)
    rows = [(k, prose(500 + k, 12 + k) + " " + short[k % 3] + " " + prose(600 + k, 9)) for k in range(12)]
    rows += [(20, short[0].replace(" ", "\n\t")), (21, " ".join(short[1].split()[:50])), (22, prose(77, 30) + " " + short[1][:-3])]
    twice = " ".join(f"once{j}" for j in range(60))
    rows += [(30, twice + " x " + twice), (31, prose(88, 60)), (32, prose(88, 60)), (33, None), (34, ""), (None, prose(89, 70)), (None, prose(89, 70) + " end"), (35, prose(89, 70)[1:])]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), crowd=crowd, word_crowd=crowd).collect()
    want = sorted(zip([str(r[0]) for r in rows], brute_shared_words([r[1] for r in rows], 51)))
    assert sorted((str(r["doc_id"]), r["n_shared_words"]) for r in got) == want
    counts = dict(want)
    assert all(counts[str(k)] >= 51 for k in (*range(12), 20, 31, 32)) and not any(counts[str(k)] for k in (21, 30, 33, 34))
    assert sorted(str((r["doc_id"], bytes(r["kept"]))) for r in got) == sorted(map(str, zip([r[0] for r in rows], brute_repeats([r[1] for r in rows], 400))))


@pytest.mark.parametrize("crowd", [1000, 2])
def test_short_runs_of_shared_words(edge, edge_rows, crowd):
    got = suffix_dedup.remove_repeats(edge, length=60, gram=20, crowd=crowd, word_crowd=crowd, words=9).collect()
    assert sorted((str(r["doc_id"]), r["n_shared_words"]) for r in got) == sorted(zip([str(r[0]) for r in edge_rows], brute_shared_words([r[1] for r in edge_rows], 9)))
