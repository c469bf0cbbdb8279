import pytest

from sextant.llm import mixing as m

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def text(n, size=60):
    return " ".join(WORDS[(n * 7 + i * (n % 5 + 1)) % len(WORDS)] for i in range(size)) + f" {n}"


def test_flow_prefers_few_repetitions_and_fills_quotas():
    patterns = {("a",): 100, ("b",): 10, ("a", "b"): 40}
    targets = {"a": (0.5, 1), "b": (0.5, 3)}
    total = m.largest_total(patterns, targets)
    routing = m.Routing(patterns, targets, total).solve()
    assert routing.got == sum(routing.quota.values()) and 249 <= total <= 250
    uses = routing.amounts()
    assert all(r == 1 for parts in uses.values() for r, s, n in parts if s == "a")
    few = m.Routing(patterns, targets, 60).solve().amounts()
    assert {r for parts in few.values() for r, _, _ in parts} == {1}


def test_shares_repeats_and_report(spark):
    docs = []
    for n in range(400):
        docs.append((n, text(n), "Big " if n % 2 else "big"))
    for n in range(400, 430):
        docs.append((n, text(n), "small"))
    for n in range(430, 440):  # copies of texts of big
        docs.append((n, text(n - 430), "SMALL"))
    docs += [(900, None, "big"), (901, "", "big"), (902, text(902), None), (903, text(903), "unlisted")]
    documents = spark.createDataFrame([(a, b, c, "x") for a, b, c in docs], "doc_id bigint, text string, source string, tokens string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    mixed, report = m.mix(documents, targets)
    rows = mixed.collect()
    facts = {r["source"]: r for r in report.collect()}
    assert facts["absent"]["actual_share"] == 0.0 and facts["absent"]["uses"] == 0
    assert facts["big"]["actual_share"] == pytest.approx(0.5 / 0.9, abs=0.03) and facts["small"]["actual_share"] == pytest.approx(0.4 / 0.9, abs=0.03)
    used = {}
    for r in rows:
        used[r["doc_id"], r["source"]] = used.get((r["doc_id"], r["source"]), 0) + 1
    assert max(n for (_, s), n in used.items() if s == "small") <= 3 and all(n == 1 for (_, s), n in used.items() if s == "big")
    assert not {900, 901, 902, 903} & {d for d, _ in used}
    again = m.mix(documents.repartition(5), targets)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    fixed = m.mix(documents, targets, total_tokens=2000)[1].agg({"tokens": "sum"}).first()[0]
    assert fixed == pytest.approx(2000, rel=0.2)
    none, report = m.mix(documents.limit(0), targets)
    assert none.count() == 0 and report.count() == 3


def test_uses_go_to_the_copies_in_turn_and_no_pattern_is_dropped(spark, monkeypatch):
    monkeypatch.setattr(m, "SLICE", 3)
    docs = [(n, text(0), "a") for n in range(4)] + [(10 + n, text(10 + n), "a") for n in range(20)]
    names = "bcdefghij"
    for i in range(9):  # every pair of neighbours shares one text
        docs += [(100 + 2 * i, text(50 + i), names[i]), (101 + 2 * i, text(50 + i), names[(i + 1) % 9])]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.1, 3)] + [(s, 0.1, 1) for s in names], "source string, target_share double, max_repeats int")
    mixed, report = m.mix(documents, targets)
    rows = mixed.collect()
    uses = {}
    for r in rows:
        uses[r["doc_id"]] = uses.get(r["doc_id"], 0) + 1
        assert r["repetition"] <= (3 if r["source"] == "a" else 1)
    assert max(uses.values()) <= 3
    repeated = m.mix(documents, targets.filter("source = 'a'"))[0].filter("doc_id < 4").collect()
    assert sorted((r["repetition"], r["doc_id"]) for r in repeated) == [(1, 0), (2, 1), (3, 2)]
    assert {r["source"]: r["uses"] for r in report.collect() if r["source"] != "a"} == dict.fromkeys(names, 1)


def test_token_counts_round_trip():
    enc = m.encoder(m.VOCABULARY)
    for t in ("hello wörld", "", " \n\n x", "𝄞 <|endoftext|>"):
        assert enc.decode(enc.encode_ordinary(t)) == t
