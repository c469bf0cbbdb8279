import random

import numpy as np

from sextant.llm import neardup as n


def sets(text, width):
    w = n.WORDS.findall((text or "").lower())
    return set(zip(*[w[i:] for i in range(min(width, len(w)))]))


def brute(rows, width, threshold, least):
    kept = [(i, s) for i, t in rows if t is not None and len(s := sets(t, width)) >= least and s]
    return {(min(a, b), max(a, b)) for x, (a, s) in enumerate(kept) for b, t in kept[x + 1 :] if len(s & t) >= threshold * len(s | t) - 1e-9}


def edited(rng, words, share):
    out = []
    for w in words:
        r = rng.random()
        if r < share / 2:
            continue
        out.append(rng.choice(words) if r < share else w)
    return out


def corpus(rng, families=60, sizes=(12, 14, 20, 33, 60, 130, 300)):
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice(sizes))]
        for _ in range(rng.choice([1, 2, 4])):
            rows.append((len(rows) + 1, " ".join(edited(rng, base, rng.choice([0, 0.03, 0.06, 0.1, 0.14])))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(a, b, 1) for a, b in rows], "seq bigint, text string, size int")


def test_equal_to_brute_force(spark):
    rng = random.Random(12)
    rows = corpus(rng)
    for width, threshold, least in ((3, 0.6, 10), (5, 0.8, 1)):
        got = [(r["seq_a"], r["seq_b"]) for r in n.near_pairs(*n.near_classes(frame(spark, rows), width, threshold, least)).collect()]
        want = brute(rows, width, threshold, least)
        assert len(got) == len(set(got)) and set(got) == want


def test_edge_cases(spark):
    base = " ".join(f"a{i}" for i in range(40))
    rows = [(1, base), (2, base.upper()), (3, base), (4, None), (5, ""), (6, "too short"), (7, base + " more words here"), (8, "same same same same same same same same same same same same")]
    members, links = n.near_classes(frame(spark, rows), 3, 0.6, 10)
    assert sorted((r["seq"], r["rep"]) for r in members.collect()) == [(1, 1), (2, 1), (3, 1), (7, 7)]
    assert [(r["rep_a"], r["rep_b"]) for r in links.collect()] == [(1, 7)]
    assert sorted(map(tuple, n.near_pairs(members, links).collect())) == [(1, 2), (1, 3), (1, 7), (2, 3), (2, 7), (3, 7)]
    facts = {r["seq"]: (r["class_id"], r["copies"], r["links"]) for r in n.linked_members(members, links).collect()}
    assert facts == {1: (1, 3, 1), 2: (1, 3, 1), 3: (1, 3, 1), 7: (7, 1, 1)}
    members, links = n.near_classes(frame(spark, rows).limit(0), 3, 0.6, 10)
    assert n.near_pairs(members, links).count() == 0


def test_popcounts_bound_the_distance():
    rng = np.random.default_rng(3)
    for _ in range(50):
        common, a, b = (rng.integers(0, 2**63, size=k).astype(np.uint64) for k in rng.integers(1, 200, size=3))
        x, y = np.union1d(common, a), np.union1d(common, b)
        bound = np.abs(n.popcounts(x).astype(int) - n.popcounts(y).astype(int)).sum()
        assert bound <= len(np.setxor1d(x, y)) and n.popcounts(x).sum() == len(x)


def test_sets_of_unequal_sizes_at_the_threshold(spark):
    rng = random.Random(5)
    rows = []
    for size in (6, 9, 30, 306, 511):
        words = [f"x{rng.randrange(10**9)}" for _ in range(int(size / 0.6) + 2)]
        rows += [(len(rows) + 1, " ".join(words)), (len(rows) + 2, " ".join(words[: size + 2]))]
    rows += [(len(rows) + 1 + i, t) for i, (_, t) in enumerate(corpus(rng))]
    for width, threshold, least in ((3, 0.6, 6), (5, 0.8, 1)):
        got = [(r["seq_a"], r["seq_b"]) for r in n.near_pairs(*n.near_classes(frame(spark, rows), width, threshold, least)).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, width, threshold, least)


def test_any_counts_give_every_pair(spark, monkeypatch):
    rng = random.Random(6)
    rows = corpus(rng, families=30)
    counts = np.random.default_rng(1).integers(0, 9, n.BUCKETS)
    monkeypatch.setattr(n, "frequencies", lambda *_: counts)
    got = [(r["seq_a"], r["seq_b"]) for r in n.near_pairs(*n.near_classes(frame(spark, rows), 3, 0.6, 10)).collect()]
    assert set(got) == brute(rows, 3, 0.6, 10)


def test_short_texts_and_hot_classes(spark, monkeypatch):
    monkeypatch.setattr(n, "PART", 7)
    rows = [(i, "see the wiki") for i in range(1, 31)] + [(31, "see the"), (32, "See, the!"), (33, "..."), (34, "one two three four five")]
    members, links = n.near_classes(frame(spark, rows), 5, 0.8, 1)
    facts = {r["seq"]: (r["class_id"], r["copies"], r["links"]) for r in n.linked_members(members, links).collect()}
    assert facts == {i: (1, 30, 0) for i in range(1, 31)} | {31: (31, 2, 0), 32: (31, 2, 0), 34: (34, 1, 0)}
    got = sorted(map(tuple, n.near_pairs(members, links).collect()))
    assert got == [(a, b) for a in range(1, 31) for b in range(a + 1, 31)] + [(31, 32)]
