"""Language identification by word-first backoff (operator 2)."""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_schema, map_rows, resident, scattered

#: Runs of letters (digits and the underscore end a word).
WORD = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
#: Characters of labelled text that a model is fitted on: of each language, and of all together.
PER_LANGUAGE, IN_ALL = 2_000_000, 60_000_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(w.isalpha() for w in words) or any(c.isalpha() for w in words for c in w)


def count_words(docs: DataFrame, flush: int = 300_000) -> DataFrame:
    """(lang, word, n) over every row with a language: counted in the workers, at most `flush` words at a time, then summed."""
    arrow = arrow_schema("lang string, word string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def out():
            for lang, c in counts.items():
                words = list(c)
                for at in range(0, len(words), 50_000):
                    part = words[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part), pa.array([c[w] for w in part])], schema=arrow)
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang is not None and text:
                    counts[lang].update(words_of(text))
            if sum(map(len, counts.values())) > flush:
                yield from out()
        yield from out()

    partial = scattered(docs, "lang", "text").filter("lang is not null and text is not null").mapInArrow(run, "lang string, word string, n long")
    return partial.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _gram_hashes(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the 64-bit hashes of the words' character n-grams, both ends marked, and the word of each."""
    marked = [f"^{w}$" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    word = np.repeat(np.arange(len(marked)), sizes)
    left = (np.cumsum(sizes)[word] if len(word) else word) - np.arange(len(codes))  # characters up to the word's end
    for order in ORDERS:
        h = np.full(max(len(codes) - order + 1, 0), order, dtype=np.uint64)
        for k in range(order):
            h = (h ^ codes[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        whole = left[: len(h)] >= order
        yield h[whole], word[: len(h)][whole]


class Model:
    """Known words and character n-grams with a log probability for each language.

    A known word scores its own log frequency. An unseen word, whatever its length, scores the mean over its longest known
    n-grams: those of five characters, else of four, and so on down to single characters; a word without any known n-gram
    says nothing. The n-grams of all known words are kept, as sorted arrays of hashes.
    """

    def __init__(self, langs: list[str], counts: dict[str, dict[str, int]]):
        """counts: word -> lang -> occurrences."""
        self.langs = langs
        at = {lang: i for i, lang in enumerate(langs)}
        words = list(counts)
        self.words = {w: i for i, w in enumerate(words)}
        n = np.zeros((len(words), len(langs)))
        for i, w in enumerate(words):
            for lang, c in counts[w].items():
                n[i, at[lang]] = c
        self.matrix = np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * (len(words) + 1))).astype(np.float32)
        self.grams = []
        for h, word in _gram_hashes(words):
            keys, of = np.unique(h, return_inverse=True)
            m = np.stack([np.bincount(of, weights=n[word, k], minlength=len(keys)) for k in range(len(langs))], axis=1) if langs else np.zeros((len(keys), 0))
            self.grams.append((keys, np.log((m + 0.5) / (m.sum(axis=0) + 0.5 * (len(keys) + 1))).astype(np.float32)))

    def unseen(self, words: list[str]) -> np.ndarray:
        """A row for each of some words that are not known."""
        out = np.zeros((len(words), len(self.langs)), dtype=np.float32)
        todo = np.ones(len(words), dtype=bool)
        for order, (h, word), (keys, m) in zip(ORDERS, _gram_hashes(words), self.grams):
            if not len(keys) or not len(h):
                continue
            row = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            known = (keys[row] == h) & todo[word]
            row, word = row[known], word[known]
            n = np.bincount(word, minlength=len(words))
            if order == 1:  # the marks of both ends are always known
                n[n <= 2] = 0
            own = np.flatnonzero(n)
            for k in range(len(self.langs)):
                out[own, k] = np.bincount(word, weights=m[row, k], minlength=len(words))[own] / n[own]
            todo[own] = False
        return out


class Scorer:
    """Scores of words, remembered in a worker for at most `keep` unseen words at a time."""

    def __init__(self, model: Model, keep: int = 120_000):
        self.model, self.keep = model, keep
        self.clear()

    def clear(self) -> None:
        self.memo = dict(self.model.words)
        self.rows = np.concatenate([self.model.matrix, np.zeros((self.keep, len(self.model.langs)), dtype=np.float32)])

    def learn(self, words: list[str]) -> None:
        """Makes room for the unseen ones of some words and scores them."""
        new = list(dict.fromkeys(w for w in words if w not in self.memo))
        if len(self.memo) + len(new) > len(self.rows):
            self.clear()
            new = list(dict.fromkeys(w for w in words if w not in self.memo))
        at = len(self.memo)
        self.rows[at : at + len(new)] = self.model.unseen(new)
        self.memo.update(zip(new, range(at, at + len(new))))

    def of(self, words: list[str]) -> np.ndarray:
        """Sum of the words' scores."""
        total = np.zeros(len(self.model.langs))
        for a in range(0, len(words), self.keep):
            part = words[a : a + self.keep]
            ids = list(map(self.memo.get, part))
            if None in ids:
                self.learn(part)
                ids = list(map(self.memo.get, part))
            total += self.rows[ids].sum(axis=0, dtype=np.float64)
        return total


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> Model:
    """Learns from rows with a language: every word of a sample of whole texts.

    Of each language texts of about `per_language` characters are taken, or of less where all languages together would
    pass `in_all`; of a language with no more than that all. The sample is of distinct texts, so a text has the same chance
    whatever the number of its copies, and by hash, so it is the same however the rows are dealt out. A row for each
    language, and the sample's words, come to the driver.
    """
    own = scattered(docs, "lang", "text").filter("lang is not null and text is not null")
    key = F.xxhash64("text")
    sizes = own.select("lang", key.alias("k"), F.char_length("text").alias("size")).groupBy("lang", "k").agg(F.max("size").alias("size"))
    totals = {r[0]: r[1] for r in sizes.groupBy("lang").agg(F.sum("size")).collect()}
    if not totals:
        return Model([], {})
    each = min(per_language, in_all // len(totals))
    # of the keys' range from -2**63 to 2**63 a language takes a share from the bottom
    shares = docs.sparkSession.createDataFrame([(lang, -(1 << 63) + min((1 << 64) - 1, int(each / max(n, 1) * (1 << 64)))) for lang, n in totals.items()], "lang string, most long")
    some = own.withColumn("k", key).join(F.broadcast(shares), "lang").filter("k <= most").groupBy("lang", "k").agg(F.first("text").alias("text"))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    found = count_words(some).select("word", "lang", "n").toArrow()
    for w, lang, n in sorted(zip(*(c.to_pylist() for c in found.columns))):
        counts[w][lang] = n
    return Model(sorted(totals), counts)


def predict(docs: DataFrame, model: Model, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score) and the columns `also` as they are. The score is the share of the posterior of the winning language, from the evidence of
    at most 20 words, between 0 and 1. Null text, text without a letter and a model without languages give `und` and 0.
    Ties go to the first language in order. Whole texts, each row by itself, and whole words, however long; repeated rows
    repeat, null ids stay null, other columns are ignored; an empty table gives no rows."""
    told = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def of(batch):
        scorer = resident(("scorer", key), lambda: Scorer(told.value))
        langs, preds, scores = scorer.model.langs, [], []
        for text in batch.column(1).to_pylist():
            words = words_of(text) if text else []
            if not langs or not has_letter(words):
                preds.append("und")
                scores.append(0.0)
                continue
            s = scorer.of(words) * min(1.0, 20 / len(words))
            best = int(s.argmax())
            preds.append(langs[best])
            scores.append(float(1 / np.exp(s - s[best]).sum()))
        return {"doc_id": batch.column(0), "lang_pred": preds, "score": scores} | {c: batch.column(2 + k) for k, c in enumerate(also)}

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in also)
    rows = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"_also_{k}") for k, c in enumerate(also)])
    return map_rows(rows, of, f"doc_id long, lang_pred string, score double{kinds}")


def held_out():
    """The contract's split: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fits on the rows with a language that are not held out and predicts every row,
    as `fit` and `predict` have it. A null doc_id is not held out. Without a row to learn from every prediction is `und`."""
    model = fit(docs.filter(~held_out()))
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
