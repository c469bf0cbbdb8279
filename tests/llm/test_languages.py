import pickle
import random

import pytest

from sextant.llm import languages as g
from pyspark.sql import functions as F

TEXTS = {
    "en": "the queue reads every row of the table before it closes and the worker writes the result to the file when the night is over because nobody needs it in the morning",
    "de": "der dienst liest jede zeile der tabelle bevor er sie schließt und die arbeit schreibt das ergebnis in die datei wenn die nacht vorbei ist weil niemand es am morgen braucht",
    "fr": "le service lit chaque ligne de la table avant de la fermer et le travail écrit le résultat dans le fichier quand la nuit est finie parce que personne ne le demande au matin",
}


def sentence(lang, rng, n=12):
    w = TEXTS[lang].split()
    return " ".join(rng.choice(w) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    rows = []
    for lang in TEXTS:
        for _ in range(60):
            label = lang if rng.random() < 0.9 else "en"
            rows.append((label, [" ".join(sentence(lang, rng) for _ in range(3)) for _ in range(3)]))
    return g.fit(rows)


def test_held_out_accuracy(model):
    rng = random.Random(9)
    right = 0
    for n in range(150):
        lang = list(TEXTS)[n % 3]
        ((_, _, found, confidence, words),) = g._segments(model, [sentence(lang, rng, 14)])
        right += found == lang
        assert 0 < confidence <= 1 and words == 14
    assert right >= 147


def test_segments_and_runs(model, spark):
    rng = random.Random(5)
    long_ = lambda lang: " ".join(sentence(lang, rng) for _ in range(3))
    rows = [
        (1, "EN-us", long_("en") + "\n\n" + long_("fr")),
        (2, "deu", long_("de") + ' "' + sentence("fr", rng, 8)[:-1] + '" ' + long_("de")),
        (3, None, long_("de") + "\n```\n" + long_("en") + "\n```\n"),
        (4, "unknown", long_("fr")),
        (5, "French", long_("fr").replace(" ", " `CodeName` 42 ")),
        (6, "en", None), (7, "en", ""), (8, "en", "```\nx\n```"), (9, "en", "42 `a` B2"), (10, "en; German", long_("de") + "\n" + long_("en")),
    ]
    docs = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "doc_id bigint, lang string, text string, words string")
    got = sorted((r["doc_id"], r["lang"]) for r in g.unnamed_languages(docs, model).collect())
    assert got == [(1, "fr"), (3, "de"), (4, "fr")]
    main = {r["doc_id"]: r["lang"] for r in g.main_languages(g.segments(docs, model)).collect()}
    assert main[2] == "de" and main[4] == "fr" and not {6, 7, 8, 9} & set(main)
    assert g.segments(docs.limit(0), model).count() == 0


def test_training_draws_a_bounded_sample(spark):
    rng = random.Random(2)
    rows = [(n, lang, " ".join(sentence(lang, rng) for _ in range(6))) for n, lang in enumerate(list(TEXTS) * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    model = g.train(docs, per_language=20)
    assert model.languages == ["de", "en", "fr"]
    assert g.unnamed_languages(docs, model).count() == 0
    assert pickle.loads(pickle.dumps(model)).scores is None
    none = g.train(docs.withColumn("lang", F.lit("??")))
    assert none.languages == [] and g.segments(docs, none).count() == 0


def test_labels_in_any_notation(spark):
    rows = [("en",), ("EN_us",), ("eng",), (" English ",), ("de-AT",), ("ger",), ("pt-BR",), ("??",), ("",), (None,), ("fr, nld",), ("xx",), ("nl-Latn-BE",)]
    got = [r[0] for r in spark.createDataFrame(rows, "lang string").select(g.named_languages(F.col("lang"))).collect()]
    assert got == [["en"], ["en"], ["en"], ["en"], ["de"], ["de"], ["pt"], [], [], [], ["fr", "nl"], [], ["nl"]]


def test_confidence_is_reliable():
    """Held-out units from languages that share most words, under dirty labels: the mean confidence is the accuracy."""
    rng = random.Random(3)
    common = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru") for b in ("ta", "so", "vi", "pe", "du")]
    own = {"aa": ["zork", "zilk", "zamp"], "bb": ["quof", "quin", "quap"], "cc": ["wyth", "wexl", "wudd"]}

    def unit(lang):
        return " ".join(rng.choice(own[lang]) if rng.random() < 0.12 else rng.choice(common) for _ in range(6)) + "."

    def labelled(n, noise):
        for _ in range(n):
            lang = rng.choice(list(own))
            yield rng.choice(list(own)) if rng.random() < noise else lang, lang, [unit(lang) for _ in range(4)]

    model = g.fit([(label, units) for label, _, units in labelled(600, 0.1)])
    confidence, right = [], []
    for _, lang, units in labelled(250, 0):
        for text in units:
            _, best, _, p, _, _ = g._label_units(model, [text])
            confidence.append(float(p[0, best[0]]))
            right.append(model.languages[best[0]] == lang)
    assert abs(sum(confidence) / len(confidence) - sum(right) / len(right)) < 0.08
    sure = [r for c, r in zip(confidence, right) if c >= 0.9]
    unsure = [r for c, r in zip(confidence, right) if c < 0.6]
    assert sure and sum(sure) / len(sure) >= 0.85 and sum(unsure) / len(unsure) < 0.7


def test_temperature_finds_the_share_of_wrong_labels():
    import numpy as np

    rng = np.random.default_rng(4)
    scores = rng.normal(size=(4000, 5)) * 2
    p = np.exp(scores / 0.5)
    p /= p.sum(axis=1, keepdims=True)
    labels = np.array([rng.choice(5, p=x) for x in p])
    wrong = rng.random(4000) < 0.2
    labels[wrong] = rng.integers(5, size=wrong.sum())
    t, noise = g.temperature(scores, labels)
    assert 0.4 < t < 0.65 and 0.12 < noise < 0.28


def test_stretches_come_from_the_whole_text():
    text = "\n".join(f"line number {n} of a long enough document" for n in range(400))
    assert any(int(x.split()[2]) > 100 for x in g.stretches(5, text)) and len(g.stretches(5, text)) == g.STRETCHES
    assert g.stretches(5, None) == [] and all(len(x) <= g.STRETCH for x in g.stretches(1, "word " * 9000))


def test_unsure_units_make_a_run_together(model):
    rng = random.Random(8)
    glossary = "\n".join(f"{a} {b}" for a, b in zip(*[iter(TEXTS["de"].split() * 2)] * 2))
    text = " ".join(sentence("en", rng) for _ in range(4)) + "\n\n" + glossary
    found = [(lang, words) for _, _, lang, _, words in g._segments(model, [text])]
    assert [x for x, _ in found] == ["en", "de"] and found[1][1] >= 30
    shouted = " ".join(sentence("en", rng) for _ in range(4)) + "\n\n" + " ".join(sentence("en", rng) for _ in range(4)).upper()
    assert {lang for _, _, lang, _, _ in g._segments(model, [shouted])} == {"en"}
