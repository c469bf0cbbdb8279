"""Languages of documents and of their mixed-language segments, with confidence.

A sparse multinomial logistic regression on TF-IDF weights of character n-grams (one to
four characters inside words), trained with follow-the-regularised-leader updates and
elastic-net penalties on a bounded sample of labelled documents, then calibrated by a
temperature on units held out. The weights of a word's n-grams add up, so documents are
scored through a table of word scores.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The classifier is fitted on about so many labelled documents of each language at most.
DOCS_PER_LANGUAGE = 200
#: Of each of them so many stretches (lines, long ones in parts) are drawn by a hash from the whole text.
STRETCHES, STRETCH = 4, 1000
#: Temperature under which segments are decided; the confidence reported has its own, fitted one.
DECISION = 0.18
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
MIN_RUN = 30
#: A worker keeps scores of at most so many different tokens.
CACHE = 300_000

# Two-letter code, three-letter codes, English name.
NOTATIONS = """
en eng english
de deu ger german
fr fra fre french
es spa spanish castilian
pt por portuguese
nl nld dut dutch flemish
it ita italian
sv swe swedish
da dan danish
no nor norwegian
fi fin finnish
pl pol polish
cs ces cze czech
ro ron rum romanian
hu hun hungarian
tr tur turkish
ru rus russian
uk ukr ukrainian
el ell gre greek
ca cat catalan
ja jpn japanese
zh zho chi chinese mandarin
ko kor korean
ar ara arabic
"""
CODE_OF = {name: line.split()[0] for line in NOTATIONS.strip().splitlines() for name in line.split()}


def named_languages(label: Column) -> Column:
    """Array of the two-letter codes a label names in any notation; empty for null, blank and unknown labels."""
    parts = F.split(F.lower(F.trim(label)), r"\s*[,;/|+&]\s*|\s+")
    table = F.create_map(*[F.lit(x) for pair in CODE_OF.items() for x in pair])
    codes = F.transform(parts, lambda p: table[F.regexp_extract(p, r"^([a-z]+)(?:[-_][a-z0-9]+)*$", 1)])
    return F.coalesce(F.array_distinct(F.filter(codes, lambda c: c.isNotNull())), F.array().cast("array<string>"))


# ---------------------------------------------------------------- text to units and tokens
FENCE = re.compile(r"^```[^\n]*\n.*?(?:^```[^\n]*$|\Z)", re.MULTILINE | re.DOTALL)
END = re.compile(r"(?:[.!?;:][\"'”’»)\]]*|[\"”»])$")
PART = re.compile(r"[^\W\d_]+")
RUN = re.compile(r"[^\W_]+")
NAME = re.compile(r"`|\d|_|[a-zß-ÿ][A-Z]|\w-\w|\w[./:@#]\w|^#?[A-Z]{2,}\b|[{}\[\]<>=()/\\]\w")


# Five words or more in capitals are text, not abbreviations.
CAPITALS = re.compile(r"(?:(?<!\w)[A-ZÀ-ÖØ-Þ]+(?!\w)[^\w\n]*){5,}")
# Without it a text has none of these; much the faster to look for.
SHOUTING = re.compile(r"[A-ZÀ-ÖØ-Þ]+[^\w\n]+[A-ZÀ-ÖØ-Þ]+[^\w\n]+[A-ZÀ-ÖØ-Þ]")


def without_fences(text: str) -> str:
    return FENCE.sub("\n", text) if "```" in text else text


def prose(text: str) -> str:
    """The text outside fenced code, sentences in capitals in lower case."""
    text = without_fences(text)
    return CAPITALS.sub(lambda m: m[0].lower(), text) if SHOUTING.search(text) else text


def ngrams(token: str) -> list[int]:
    """Buckets of the character n-grams of each of a token's words, none for names and numbers."""
    if NAME.search(token):
        return []
    out = []
    for word in PART.findall(token.lower()):
        padded = f" {word} "
        for n in ORDERS:
            out += [zlib.crc32(padded[i : i + n].encode()) % BUCKETS for i in range(n > 1 and 0 or 1, len(padded) - n + (n > 1))]
    return out


# ---------------------------------------------------------------- training
def _features(unit: str, known: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and length-scaled counts of a unit's n-grams; known remembers the tokens of one fit."""
    grams = []
    for t in unit.split():
        if t not in known:
            known[t] = ngrams(t)
        grams += known[t]
    ids, counts = np.unique(np.asarray(grams, np.int64), return_counts=True)
    return ids, counts / np.sqrt(max(1, len(grams)))


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int, seed: int, alpha=0.3, beta=1.0, l1=0.3, l2=0.2) -> np.ndarray:
    """Weights (BUCKETS, classes) after follow-the-regularised-leader steps with elastic-net penalties."""
    z = np.zeros((BUCKETS, classes))
    n = np.zeros((BUCKETS, classes))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, x = rows[k]
            if not len(ids):
                continue
            zi, ni = z[ids], n[ids]
            w = weights(zi, ni)
            logit = x @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[k]] -= 1.0
            g = x[:, None] * p
            sq = ni + g * g
            z[ids] = zi + g - (np.sqrt(sq) - np.sqrt(ni)) / alpha * w
            n[ids] = sq
    return weights(z, n)


class Scores(dict):
    """Row of each token in a growing table: score for every language, then n-grams, words, scored words, and 1 if a unit ends here."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights
        self.table = np.zeros((1024, weights.shape[1] + 4))

    def __missing__(self, token: str) -> int:
        row = len(self)
        if row == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        grams, n = ngrams(token), len(RUN.findall(token))
        if grams:
            self.table[row, :-4] = self.weights[grams].sum(axis=0)
        self.table[row, -4:] = len(grams), n, n if grams else 0, END.search(token) is not None
        self[token] = row
        return row


@dataclass
class Model:
    languages: list[str]
    #: weight of every n-gram bucket, its inverse document frequency multiplied in
    weights: np.ndarray
    temperature: float
    scores: Scores | None = None

    def __getstate__(self):
        return {"languages": self.languages, "weights": self.weights, "temperature": self.temperature, "scores": None}

    def rows(self, tokens: list[str]) -> np.ndarray:
        if self.scores is None or len(self.scores) > CACHE:
            self.scores = Scores(self.weights)
        at = np.fromiter(map(self.scores.__getitem__, tokens), np.int64, len(tokens))
        return self.scores.table[at]

    def probabilities(self, scores: np.ndarray, grams: np.ndarray, temperature: float) -> np.ndarray:
        logit = scores / np.sqrt(np.maximum(grams, 1))[:, None] / temperature
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def stretches(doc_id: int, text: str | None, most: int = STRETCHES) -> list[str]:
    """Lines outside fenced code of more than 20 characters, longer ones in parts, drawn by a hash."""
    found = []
    for line in without_fences(text or "").split("\n"):
        parts = [line] if len(line) <= STRETCH else [line[a : a + STRETCH].partition(" ")[2].rpartition(" ")[0] for a in range(0, len(line), STRETCH)]
        found += [p for p in parts if len(p) > 20]
    if len(found) <= most:
        return found
    drawn = sorted(range(len(found)), key=lambda n: zlib.crc32(b"%d %d" % (doc_id, n)))[:most]
    return [found[n] for n in sorted(drawn)]


def temperature(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """The temperature of best likelihood for held-out units, and the share of wrong labels found with it.

    Labels are dirty and texts mixed: a unit carries its label with the model's probability, or, with
    the fitted share, any label at all. No unit is left out for what the model says of it.
    """
    best, found = np.inf, (1.0, 0.0)
    own = np.arange(len(labels))
    for t in np.geomspace(0.1, 10, 61):
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        p = np.exp(s[own, labels]) / np.exp(s).sum(axis=1)
        for noise in np.linspace(0.0, 0.5, 51):
            loss = -np.log(np.maximum((1 - noise) * p + noise / scores.shape[1], 1e-12)).mean()
            if loss < best:
                best, found = loss, (float(t), float(noise))
    return found


def fit(sample: list[tuple[str, list[str]]], seed: int = 11, epochs: int = 2) -> Model:
    """A model from (label, stretches of a text) rows; labels may be wrong and texts mixed for a part of them.

    A first fit marks the units that clearly belong to another language than their
    document's label; the second fit leaves them out. Units of every fifth document are
    held out of both, and all of them set the temperature.
    """
    languages = sorted({label for label, _ in sample})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), 1.0)
    raw, labels, held, known = [], [], [], {}
    for doc, (label, units) in enumerate(sample):
        for unit in units:
            raw.append(_features(unit, known))
            labels.append(languages.index(label))
            held.append(doc % 5 == 0)
    labels, held = np.asarray(labels, np.int64), np.asarray(held, bool)
    df = np.zeros(BUCKETS)
    for ids, _ in raw:
        df[ids] += 1
    idf = np.log((1 + len(raw)) / (1 + df)) + 1
    rows = [(ids, x * idf[ids] / 4) for ids, x in raw]

    def logits(w):
        return np.array([x @ w[ids] if len(ids) else np.zeros(len(languages)) for ids, x in rows]).reshape(len(rows), len(languages))

    def training(mask, epochs):
        picked = np.flatnonzero(mask)
        return _ftrl([rows[i] for i in picked], labels[picked], len(languages), epochs, seed)

    clean = logits(training(~held, 1)).argmax(axis=1) == labels
    w = training(clean & ~held if (clean & ~held).any() else ~held, epochs)
    scored = held & np.asarray([len(ids) > 0 for ids, _ in rows], bool)
    t = temperature(logits(w)[scored], labels[scored])[0] if scored.any() else 1.0
    return Model(languages, (w * idf[:, None] / 4).astype(np.float32), t)


def train(documents: DataFrame, per_language: int = DOCS_PER_LANGUAGE, seed: int = 11) -> Model:
    """Fit on at most about per_language documents for each language the labels name, STRETCHES stretches of each.

    One aggregate counts the labels; a hash of doc_id then draws the sample, so it is
    the same whatever the partitioning, and its size does not grow with the table.
    """
    named = documents.select("doc_id", "text", named_languages(F.col("lang")).alias("codes")).filter((F.size("codes") == 1) & (F.length("text") > 40) & F.col("doc_id").isNotNull())
    labelled = named.select("doc_id", "text", F.col("codes")[0].alias("code"))
    counts = {r["code"]: r["n"] for r in labelled.groupBy("code").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([])
    share = F.create_map(*[F.lit(x) for code, n in counts.items() for x in (code, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["doc_id", "code"]].assign(units=[stretches(i, t) for i, t in zip(pdf["doc_id"], pdf["text"])])

    rows = labelled.filter(draw < share[F.col("code")]).mapInPandas(drawn, "doc_id long, code string, units array<string>").collect()
    return fit([(r["code"], r["units"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["code"], r["units"]))], seed)


# ---------------------------------------------------------------- application
def _label_units(model: Model, texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """For all units of a batch: document, best language, sharp and calibrated probabilities, words, scored words.

    Units are sentences and lines outside fenced code, the smallest stretches that get a language.
    """
    doc, lengths, tokens = [], [], []
    for d, text in enumerate(texts):
        for line in prose(text or "").split("\n"):
            got = line.split()
            if got:
                doc.append(d)
                lengths.append(len(got))
                tokens += got
    k = len(model.languages)
    if not tokens or not k:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, k)), np.empty((0, k)), np.empty(0), np.empty(0)
    rows = model.rows(tokens)
    ends = rows[:, k + 3] > 0
    ends[np.cumsum(lengths) - 1] = True
    starts = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])
    sums = np.add.reduceat(rows, starts, axis=0)
    p, calibrated = (model.probabilities(sums[:, :k], sums[:, k], t) for t in (DECISION, model.temperature))
    return np.repeat(doc, lengths)[starts], p.argmax(axis=1), p, calibrated, sums[:, k + 1], sums[:, k + 2]


#: Units with fewer scored words, or a flatter distribution, cannot start a segment by themselves.
SURE_WORDS, SURE = 3, 0.8
#: Cost of a change of language between two units, in nats of calibrated probability.
SWITCH = 3.0


def _path(p: np.ndarray, scored: np.ndarray) -> np.ndarray:
    """The most probable sequence of languages of a document's units when each change costs SWITCH."""
    gain = np.where(scored[:, None] > 0, np.log(np.maximum(p, 1e-6)), 0.0)
    best, back = gain[0], []
    for g in gain[1:]:
        top = int(best.argmax())
        change = best[top] - SWITCH > best
        back.append(np.where(change, top, np.arange(len(best))))
        best = np.where(change, best[top] - SWITCH, best) + g
    out = [int(best.argmax())]
    for step in reversed(back):
        out.append(int(step[out[-1]]))
    return np.asarray(out[::-1])


def _segments(model: Model, texts: list[str | None]) -> list[tuple[int, int, str, float, int]]:
    """(doc, segment, language, confidence, words): maximal runs of units in one language."""
    doc, best, p, calibrated, n_words, scored = _label_units(model, texts)
    out = []
    if not len(doc):
        return out
    sure = (scored >= SURE_WORDS) & (p[np.arange(len(doc)), best] >= SURE)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]])
    for i, j in zip(edges.tolist(), edges[1:].tolist()):
        seen = best[i:j][sure[i:j]]
        if not scored[i:j].any():
            continue
        # Units that are not sure by themselves can make a run of another language only together.
        if len(seen) and (seen == seen[0]).all() and scored[i:j][best[i:j] != seen[0]].sum() < MIN_RUN:
            langs = np.full(j - i, seen[0])
        else:
            langs = _path(p[i:j], scored[i:j])
        cuts = [0, *(np.flatnonzero(np.diff(langs)) + 1).tolist(), j - i]
        for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
            weight = np.maximum(scored[i + a : i + b], 1e-9)
            confidence = float((calibrated[i + a : i + b, langs[a]] * weight).sum() / weight.sum())
            out.append((int(doc[i]), s, model.languages[langs[a]], confidence, int(n_words[i + a : i + b].sum())))
    return out


def segments(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, segment, lang, confidence, words: the segments of each document in one language each.

    Sentences and lines outside fenced code get a language; those too short or made of
    names and numbers follow the one before. Null, empty and code-only texts give no
    rows. Copies get the same segments each. The model is broadcast: its size is fixed
    (BUCKETS times the number of languages).
    """
    model = train(documents) if model is None else model
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["doc_id"].tolist()
            found = [(ids[d], s, lang, c, w) for d, s, lang, c, w in _segments(shared.value, pdf["text"].tolist())]
            yield pd.DataFrame(found, columns=["doc_id", "segment", "lang", "confidence", "words"])

    texts = documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return texts.mapInPandas(label, "doc_id long, segment int, lang string, confidence double, words long")


def main_languages(found: DataFrame) -> DataFrame:
    """doc_id, lang, confidence, share: the language with most words of each document, ties to the first code."""
    per = found.groupBy("doc_id", "lang").agg(F.sum("words").alias("words"), (F.sum(F.col("confidence") * F.col("words")) / F.greatest(F.sum("words"), F.lit(1))).alias("confidence"))
    top = F.max_by(F.struct("lang", "confidence", "words"), F.struct(F.col("words"), F.translate("lang", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"))).alias("top")
    return per.groupBy("doc_id").agg(top, F.sum("words").alias("all")).select("doc_id", "top.lang", F.round("top.confidence", 6).alias("confidence"), F.round(F.col("top.words") / F.greatest("all", F.lit(1)), 6).alias("share"))


def unnamed_languages(documents: DataFrame, model: Model | None = None, min_run: int = MIN_RUN) -> DataFrame:
    """doc_id, lang, confidence, words of each language with a segment of at least min_run words that the document's label does not name."""
    labels = documents.select("doc_id", named_languages(F.col("lang")).alias("codes"))
    runs = segments(documents, model).filter(F.col("words") >= min_run)
    best = runs.groupBy("doc_id", "lang").agg(F.max("words").alias("words"), F.max_by("confidence", "words").alias("confidence"))
    return best.join(labels, "doc_id").filter(~F.array_contains("codes", F.col("lang"))).select("doc_id", "lang", "confidence", "words")
