import random

from sextant.llm import leakage


def plain_leaks(docs, items, window=12):
    """Brute force on word lists."""
    out = set()
    for d, text in docs:
        w = leakage.words(text)
        for i, item in items:
            v = leakage.words(item)
            n = min(window, len(v))
            if n and any(v[p : p + n] == w[q : q + n] for p in range(len(v) - n + 1) for q in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def test_words_ignore_case_form_and_invisible_characters():
    assert leakage.words("Ｔhe qu­i​ck ﬁsh, STRASSE straße ２０１") == ["the", "quick", "fish", "strasse", "strasse", "201"]
    assert leakage.words(None) == leakage.words("") == leakage.words(" .,") == []


def test_equal_to_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["the", "of", "row", "When", "Alpha", "Beta", "x1", "ms", "42", "queue", "İstanbul", "reads"]
    items = [(n, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 12, 13, 30])))) for n in range(30)] + [(90, None), (91, "")]
    docs = [(n, " ".join(rng.choice(vocabulary) for _ in range(60))) for n in range(60)]
    for n in range(60, 120):
        words = leakage.words(rng.choice(items)[1] or "x")
        a = rng.randrange(len(words))
        docs.append((n, "zz " + " ".join(w.upper() if rng.random() < 0.3 else w for w in words[a : a + rng.choice([4, 11, 12, 14, 40])]) + " zz"))
    docs += [(200, None), (201, ""), (60, docs[60][1])]
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    want = plain_leaks(docs, items)
    assert want
    for parts in (1, 7):
        got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, i.repartition(parts)).filter("verbatim").collect()}
        assert got == want
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def test_renamed_passages_are_told_apart(spark):
    item = "When Alpha reads the old queue of the row, Beta keeps 12 copies for Alpha."
    same = "so: when alpha reads the old queue of the row beta keeps 12 copies for alpha"
    renamed = "When Gamma reads the old queue of the row, Delta keeps 77 copies for Gamma."
    mixed = "When Gamma reads the old queue of the row, Delta keeps 77 copies for Delta."
    d = spark.createDataFrame([(1, same), (2, renamed), (3, mixed)], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, item), (8, "the old queue of the row keeps copies for when reads when reads")], "item_id bigint, text string")
    got = {(r["doc_id"], r["verbatim"]) for r in leakage.leaks(d, i).filter("item_id = 7").collect()}
    assert (1, True) in got and (2, False) in got
    full = {r["doc_id"]: r["windows"] for r in leakage.leaks(d, i).filter("item_id = 7").collect()}
    assert full[2] > full.get(3, 0)


def test_added_items_and_their_order_change_nothing(spark):
    item = "When Alpha reads the old queue of the row, Beta keeps 12 copies for Alpha."
    renamed = "When Gamma reads the old queue of the row, Delta keeps 77 copies for Gamma."
    others = [(n, f"Name{n} holds a shelf of {n} green bottles and nobody in the house counts them at night") for n in range(20, 60)]
    d = spark.createDataFrame([(2, renamed), (4, item)], "doc_id bigint, text string")
    schema = "item_id bigint, text string"
    found = [
        sorted((r["doc_id"], r["item_id"], r["verbatim"]) for r in leakage.leaks(d, spark.createDataFrame(rows, schema).repartition(parts)).collect())
        for parts, rows in ((1, [(7, item), *others]), (5, [*others[::-1], (7, item)]))
    ]
    assert found[0] == found[1] == [(2, 7, False), (4, 7, True)]


def test_windows_count_documents_windows(spark):
    item = "Alpha Beta Gamma Delta Alpha Beta Gamma Delta Alpha Beta Gamma Delta Alpha"  # names only: word by word
    d = spark.createDataFrame([(1, item), (2, item.replace("Alpha", "Omega")), (3, item + " Beta")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["verbatim"], r["windows"]) for r in leakage.leaks(d, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()}
    assert got == {1: (True, 2), 3: (True, 2)}
