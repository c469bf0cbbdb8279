"""Evaluation texts leaking into training text, found through canonical templates.

Words of the held-out items and of the documents become template symbols: numbers,
units and names turn into typed placeholders, every other word of the items keeps its
own symbol. A placeholder also says how far back in the window the same word stands, so
windows whose slots are renamed consistently, and only these, have equal canonical forms.
The hashes of the canonical windows of items and documents are joined; a second hash of
the words themselves tells verbatim passages from re-parameterised ones.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.session import materialize

WINDOW = 12
#: A window with fewer words that are not slots is compared word by word only: almost any text would fit its template.
ANCHORS = 6
#: Bits of the table that lets document windows pass to the join; a fixed 2 MB. More items let more windows pass, and lose none.
TABLE_BITS = 24
#: A worker remembers at most about so many different words.
CACHE = 500_000
WORDS = re.compile(r"[^\W_]+")
SENTENCE_START = re.compile(r"(?:^|[.!?:]\s+|\n\s*)[^\w\s]*([^\W_]+)")
# Unit words that become the placeholder UNIT.
UNITS = frozenset("ms s sec secs second seconds min mins minute minutes hour hours h day days kb mb gb tb kib mib gib byte bytes px percent pct km m cm mm kg g mg".split())
NUMBER, UNIT, NAME = 1, 2, 3
SEPARATOR = "\n"  # between documents; no word is like it
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _invisible() -> re.Pattern:
    """Characters without appearance: the format category, and fillers and selectors that are marks or letters."""
    runs = []
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        if unicodedata.category(chr(cp)) == "Cf" or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= cp <= 0xFE0F or 0x180B <= cp <= 0x180F or 0xE0100 <= cp <= 0xE01EF:
            if runs and runs[-1][1] == cp - 1:
                runs[-1][1] = cp
            else:
                runs.append([cp, cp])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs) + "]")


INVISIBLE = _invisible()


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, without regard to case, compatibility form and invisible characters."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text))
        text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text.casefold()))
        return WORDS.findall(text)
    return WORDS.findall(text.lower())


# ---------------------------------------------------------------- lexicon
def _word_facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text in pdf["text"]:
            plain = unicodedata.normalize("NFKC", INVISIBLE.sub("", text))
            out += [(w.casefold(), 1, 0) for w in {w for w in WORDS.findall(plain) if w[0].islower()}]
            out += [(m[1].casefold(), 0, 1) for m in SENTENCE_START.finditer(plain)]
        yield pd.DataFrame(out, columns=["word", "lower", "starts"])


def lexicon(items: DataFrame) -> frozenset[str]:
    """Words that the items also write in lower case, or that begin three sentences or more; all others are slots.

    It is one for all items, whatever their order and number, and grows with their vocabulary only.
    """
    facts = items.select("text").filter("text is not null").mapInPandas(_word_facts, "word string, lower int, starts int")
    known = facts.groupBy("word").agg(F.max("lower").alias("lower"), F.sum("starts").alias("starts")).filter("lower > 0 or starts >= 3")
    return frozenset(w for (w,) in known.select("word").collect() if w not in UNITS and not w[0].isdigit())


class Table(dict):
    """Number of each word, with its hash, and the kind of slot it is (0: none)."""

    def __init__(self, known: frozenset[str]):
        super().__init__()
        self.known, self.hashes, self.slots = known, [], []

    def __missing__(self, word: str) -> int:
        import xxhash

        n = self[word] = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")))
        digits = word[0].isdigit() and not word.isalpha() and any(map(str.isdigit, word))
        self.slots.append(0 if word in self.known or word == SEPARATOR else UNIT if word in UNITS else NUMBER if digits else NAME)
        return n


# ---------------------------------------------------------------- windows
def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass
class Windows:
    """Cuts texts into windows and hashes them."""

    known: frozenset[str]
    table: Table | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"known": self.known, "table": None}

    def of(self, texts: list[list[str]]) -> Batch:
        if self.table is None or len(self.table) > CACHE:
            self.table = Table(self.known)
        flat, starts = [], []
        for w in texts:
            starts.append(len(flat))
            flat += w
            flat.append(SEPARATOR)
        codes = np.fromiter(map(self.table.__getitem__, flat), np.int64, len(flat))
        hashes, slots = np.asarray(self.table.hashes, np.uint64)[codes], np.asarray(self.table.slots, np.uint64)[codes]
        order = np.argsort(codes, kind="stable")
        same = codes[order[1:]] == codes[order[:-1]]
        back = np.full(len(codes), 1 << 40, np.uint64)
        back[order[1:][same]] = (order[1:][same] - order[:-1][same]).astype(np.uint64)
        before = lambda which: np.concatenate([[0], np.cumsum(which)])
        return Batch(np.asarray(starts, np.int64), hashes, slots > 0, slots * B, back, before(codes == self.table[SEPARATOR]), before(slots > 0))


@dataclass
class Batch:
    starts: np.ndarray
    hashes: np.ndarray
    filled: np.ndarray  # whether a slot stands there
    placeholders: np.ndarray
    back: np.ndarray  # how far back the same word stands
    ends: np.ndarray  # separators before each position
    slots_before: np.ndarray

    def cut(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, key and hash of the words of every window of that length inside a text.

        The key is the hash of the canonical form, or of the words where too few are not slots.
        """
        n = len(self.hashes) - length + 1
        at = np.flatnonzero(self.ends[length:] == self.ends[:n]) if n > 0 else np.empty(0, np.int64)
        if not len(at):
            return at, np.empty(0, np.uint64), np.empty(0, np.uint64)
        exact, canonical = np.full(n, length, np.uint64), np.full(n, length, np.uint64)
        for j in range(length):  # over all positions: consecutive ones cost less than chosen ones
            h, back = self.hashes[j : j + n], self.back[j : j + n]
            exact *= A
            exact += h
            canonical *= A
            canonical += np.where(self.filled[j : j + n], self.placeholders[j : j + n] + np.where(back <= j, back, 0), h)
        slots = self.slots_before[length:] - self.slots_before[:n]
        exact = _mixed(exact[at])
        key = np.where(length - slots[at] >= ANCHORS, _mixed(canonical[at] ^ B), exact)
        return np.searchsorted(self.starts, at, "right") - 1, key, exact


def _bucket(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


ITEM_WINDOWS = "item_id long, length int, key long, exact long, bucket int"


def item_windows(items: DataFrame, cutter: Windows, window: int) -> DataFrame:
    """The windows of every item; an item of fewer words than a window is one window of its own length."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lists = [words(t) for t in pdf["text"]]
            lengths, ids, parts = np.asarray([min(window, len(w)) for w in lists]), pdf["item_id"].to_numpy(), []
            batch = cutter.of(lists)
            for length in sorted({int(x) for x in lengths if x}):
                text, key, exact = batch.cut(length)
                mine = lengths[text] == length
                parts.append(pd.DataFrame({"item_id": ids[text[mine]], "length": length, "key": key[mine].view(np.int64), "exact": exact[mine].view(np.int64), "bucket": _bucket(key[mine])}))
            yield pd.concat(parts) if parts else pd.DataFrame(columns=["item_id", "length", "key", "exact", "bucket"])

    return items.mapInPandas(cut, ITEM_WINDOWS).distinct()


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, verbatim, windows: every document with a window of an item, or with a whole shorter item.

    verbatim: some window has all words equal. Otherwise its slots were renamed consistently; such
    passages need ANCHORS words in a window that are not slots. windows counts the windows of the
    document that match the item. Documents and items with null or empty texts give no rows; each
    copy of a document gives its own (rows of one doc_id count together). Items may have any number:
    the documents are read once, and only windows that may be an item's are joined.
    """
    spark = documents.sparkSession
    schema = "doc_id long, item_id long, verbatim boolean, windows long"
    usable = items.select("item_id", "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    cutter = Windows(lexicon(usable))
    wanted = materialize(item_windows(usable, cutter, window), "items")
    lengths = sorted(r["length"] for r in wanted.select("length").distinct().collect())  # at most window of them
    if not lengths:
        return spark.createDataFrame([], schema)
    bits = np.zeros(1 << TABLE_BITS, bool)
    bits[wanted.select("bucket").distinct().toPandas()["bucket"].to_numpy(np.int64)] = True  # at most 2 ** TABLE_BITS
    shared = spark.sparkContext.broadcast((cutter, np.packbits(bits)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter, packed = shared.value
        for pdf in batches:
            batch, ids = cutter.of([words(t) for t in pdf["text"]]), pdf["doc_id"].to_numpy()
            for length in lengths:
                text, key, exact = batch.cut(length)
                at = _bucket(key)
                passed = (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
                found = pd.DataFrame({"doc_id": ids[text[passed]], "length": length, "key": key[passed].view(np.int64), "said": exact[passed].view(np.int64)})
                yield found.groupby(["doc_id", "length", "key", "said"], as_index=False).size().rename(columns={"size": "n"})

    docs = documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    passed = docs.mapInPandas(cut, "doc_id long, length int, key long, said long, n long")
    # an item's windows of one canonical form are one row, so that each window of a document counts once
    forms = wanted.groupBy("item_id", "length", "key").agg(F.collect_set("exact").alias("exacts"))
    matched = passed.join(forms, ["length", "key"])
    return matched.groupBy("doc_id", "item_id").agg(F.max(F.array_contains("exacts", F.col("said"))).alias("verbatim"), F.sum("n").alias("windows"))
