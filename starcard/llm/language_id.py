"""Language identification, words first, backing off to character n-grams.

A known word scores its log frequency in each language. A word the model doesn't know is looked at
through its character n-grams, longest first: the first order of which any n-gram is known decides,
with the mean log frequency of its known n-grams.

How well a text fits any language is told apart from how far one is ahead of the others: the mean over its words of 1 for
a word seen in the language, else of the share of its 4-grams seen there.

The model is bounded by documented parameters (``words``, ``grams``), so it can travel to every task.
The counts it is picked from cover all training rows.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starcard.llm.common import fold_of, largest
from starcard.session import stored

def _kinds(of: tuple[str, ...], stop: int = sys.maxunicode + 1) -> str:
    """A character class's inside with all characters below ``stop`` whose category starts with one of ``of``."""
    held = [c for c in range(stop) if unicodedata.category(chr(c)).startswith(of)]
    spans = [[c for _, c in run] for _, run in groupby(enumerate(held), lambda x: x[1] - x[0])]
    return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in spans)


#: A word: a letter and the letters and marks behind it, so digits, numerals like ² or Ⅷ, and a mark alone are none.
LETTERS = re.compile(f"[{_kinds(('L',))}][{_kinds(('L', 'M'))}]*")
#: Where a text has neither marks nor numerals beside digits, and nothing far up, this finds the same faster.
_PLAIN, _ODD = re.compile(r"[^\W\d_]+"), re.compile(f"[{_kinds(('M', 'Nl', 'No'), 1 << 16)}\U00010000-\U0010ffff]")


def words_of(text: str) -> list[str]:
    """The words of a text in lower case."""
    text = text.lower()
    return (LETTERS if _ODD.search(text) else _PLAIN).findall(text)


ORDERS = (4, 3, 2, 1)
UNKNOWN = "und"
#: Bytes of words' values that a task remembers, words looked up together, rows whose words are counted together.
MEMO_BYTES, WORDS_TOGETHER, TOGETHER = 48 << 20, 100_000, 10_000


@dataclass
class LanguageModel:
    langs: list[str]
    words: dict[str, int] = field(default_factory=dict)
    word_logs: np.ndarray | None = None
    grams: dict[str, int] = field(default_factory=dict)
    gram_logs: np.ndarray | None = None
    word_has: np.ndarray | None = None  # seen in the language at all
    gram_has: np.ndarray | None = None



class Reader:
    """Judges texts by a model. What a word adds to a text is worked out once and remembered.

    Without ``fitting`` words that aren't known count nothing towards the fit.
    """

    def __init__(self, model: LanguageModel, evidence: int = 20, fitting: bool = True):
        self.model, self.evidence, self.fitting, self.width = model, evidence, fitting, 2 * len(model.langs) + 1
        self.memo: dict[str, int] = {}
        self.table = np.zeros((0, self.width))

    def _means(self, known: list[list[int]], of: np.ndarray) -> np.ndarray:
        """Sums of ``of`` over each list of n-grams (none of them empty)."""
        starts = np.cumsum([0] + [len(k) for k in known[:-1]])
        return np.add.reduceat(of[np.fromiter(chain.from_iterable(known), np.int64)], starts, axis=0)

    def rows(self, words: list[str]) -> np.ndarray:
        """Per word: log frequency in each language, fit to each language, and 1 if the model can say anything at all."""
        model, n_langs, get = self.model, len(self.model.langs), self.model.grams.get
        out = np.zeros((len(words), self.width))
        logs, fits, counted = out[:, :n_langs], out[:, n_langs:-1], out[:, -1]
        at = [model.words.get(w) for w in words]
        left = [i for i, k in enumerate(at) if k is None]
        partly = [i for i, k in enumerate(at) if k is not None and not model.word_has[k].all()] if self.fitting else []
        for n in ORDERS:
            if n == ORDERS[0] and self.fitting:  # fit is the share of all n-grams that is known in a language
                self._spell([*left, *partly], words, fits)
            padded = [f"^{words[w]}$" if n > 1 else words[w] for w in left]
            found = [[g for g in map(get, [p[i : i + n] for i in range(len(p) - n + 1)]) if g is not None] for p in padded]
            hit = [(w, k) for w, k in zip(left, found, strict=True) if k]
            if hit:
                places, lists = [w for w, _ in hit], [k for _, k in hit]
                logs[places] = self._means(lists, model.gram_logs) / np.array([len(k) for k in lists])[:, None]
                counted[places] = 1.0
            left = [w for w, k in zip(left, found, strict=True) if not k]
        known = [i for i, k in enumerate(at) if k is not None]
        if known:
            entries = [at[i] for i in known]
            logs[known], counted[known] = model.word_logs[entries], 1.0
            fits[known] = np.where(model.word_has[entries], 1.0, fits[known])
        return out

    def _spell(self, places: list[int], words: list[str], fits: np.ndarray) -> None:
        n, get = ORDERS[0], self.model.grams.get
        hit = []
        for i in places:
            p = f"^{words[i]}$"
            k = [g for g in map(get, [p[j : j + n] for j in range(max(1, len(p) - n + 1))]) if g is not None]
            if k:
                hit.append((i, k, max(1, len(p) - n + 1)))
        if hit:
            sums = self._means([k for _, k, _ in hit], self.model.gram_has.astype(float))
            fits[[i for i, *_ in hit]] = sums / np.array([size for *_, size in hit])[:, None]

    def _sums(self, texts: list[list[str]]) -> np.ndarray:
        """Sums of ``rows`` over the words of every text."""
        memo, sums = self.memo, np.zeros((len(texts), self.width))
        if len(memo) * self.width * 8 > MEMO_BYTES:
            memo.clear()
            self.table = np.zeros((0, self.width))
        new = sorted(set(chain.from_iterable(texts)).difference(memo))
        if new:
            memo.update(zip(new, range(len(memo), len(memo) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.rows(new)])
        at = np.fromiter(map(memo.__getitem__, chain.from_iterable(texts)), np.int64)
        sizes = np.array([len(t) for t in texts])
        full = np.flatnonzero(sizes)
        if len(full):
            sums[full] = np.add.reduceat(self.table[at], (np.cumsum(sizes) - sizes)[full], axis=0)
        return sums

    def _judged(self, words: int, sums: np.ndarray) -> tuple[str, float, float]:
        langs = self.model.langs
        if not words or not langs:
            return UNKNOWN, 0.0, 0.0
        total, fit, rest = sums[: len(langs)], float(sums[len(langs) : -1].max()) / words, sums[-1]
        if not rest:
            return langs[0], 1.0 / len(langs), fit
        total = total * min(1.0, self.evidence / rest)
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return langs[best], float(odds[best] / odds.sum()), fit

    def judge(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float, float]]:
        """Language, its posterior, and how well the words fit the language they fit best, of every text.

        Evidence beyond ``evidence`` words only sharpens the mean. Texts are taken together until they have ``WORDS_TOGETHER`` words;
        the words of a longer one are summed up part by part.
        """
        held: list[list[str]] = []
        size = 0

        def done() -> Iterator[tuple[str, float, float]]:
            yield from (self._judged(len(w), s) for w, s in zip(held, self._sums(held), strict=True))

        for text in texts:
            words = words_of(text) if text else []
            if size + len(words) > WORDS_TOGETHER and held:
                yield from done()
                held, size = [], 0
            if len(words) > WORDS_TOGETHER:
                parts = [self._sums([words[i : i + WORDS_TOGETHER]])[0] for i in range(0, len(words), WORDS_TOGETHER)]
                yield self._judged(len(words), np.sum(parts, axis=0))
                continue
            held.append(words)
            size += len(words)
        yield from done()


def word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) over all rows of (text, lang); counted per batch before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), TOGETHER):
                part = batch.iloc[start : start + TOGETHER]
                found: dict[str, Counter] = {}
                for text, lang in zip(part["text"], part["lang"], strict=True):
                    found.setdefault(lang, Counter()).update(words_of(text))
                for lang, words in found.items():
                    yield pd.DataFrame({"lang": lang, "word": list(words), "n": list(words.values())})

    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    partial = rows.mapInPandas(count, "lang string, word string, n long")
    return partial.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts_of(counts: DataFrame) -> DataFrame:
    """(lang, item, n): n-grams of all words of (lang, item, n), each word weighing what it was counted; counted per batch before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, word, times in zip(batch["lang"], batch["item"], batch["n"], strict=True):
                own, padded = found.setdefault(lang, Counter()), f"^{word}$"
                for n in ORDERS:
                    for i in range(len(padded) - n + 1):
                        own[padded[i : i + n]] += times
            for lang, grams in found.items():
                yield pd.DataFrame({"lang": lang, "item": list(grams), "n": list(grams.values())})

    partial = counts.select("lang", "item", "n").mapInPandas(count, "lang string, item string, n long")
    return partial.filter("item NOT IN ('^', '$')").groupBy("lang", "item").agg(F.sum("n").alias("n"))


def _table(chosen: DataFrame, langs: list[str], totals: dict[str, float], alpha: float) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Entries of (item, ns) as log frequencies with ``alpha`` added to every count, and which counts there are.

    The rows come as columns of numbers: as objects they would take ten times the room.
    """
    of = [F.coalesce(F.try_element_at("ns", F.lit(lang)), F.lit(0)).cast("double").alias(f"n{i}") for i, lang in enumerate(langs)]
    rows = chosen.select("item", *of).toArrow()
    items = rows.column("item").to_pylist()
    order = sorted(range(len(items)), key=items.__getitem__)
    counts = np.column_stack([rows.column(f"n{i}").to_numpy() for i in range(len(langs))])[order]
    sizes = np.array([totals.get(lang, 0.0) for lang in langs]) + alpha * (len(items) + 1)
    return {items[i]: at for at, i in enumerate(order)}, np.log((counts + alpha) / sizes), counts > 0


def _shares(sizes: dict[str, int], keep: int) -> dict[str, int]:
    """``keep`` slots dealt evenly; what a language can't fill goes to the others."""
    out, left = {}, keep
    for i, (lang, size) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(size, left // (len(sizes) - i))
        left -= out[lang]
    return out


def _most_telling(counts: DataFrame, totals: dict[str, float], keep: int) -> DataFrame:
    """About ``keep`` items (item, ns: counts by language) with the largest share in their language, the slots shared out evenly.

    An item belongs to the language where its share is largest, so a language of few rows can't push out the others' items.
    """
    total = F.create_map(*[F.lit(x) for pair in totals.items() for x in pair])[F.col("lang")]
    items = counts.groupBy("item").agg(
        F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("ns"),
        F.max(F.struct((F.col("n") / total).alias("top"), "lang")).alias("best"),
    ).select("item", "ns", F.col("best.lang").alias("of"), F.col("best.top").alias("top"))
    items = stored(items, "language-items")
    slots = _shares({r["of"]: r["count"] for r in items.groupBy("of").count().collect()}, keep)
    chosen = [largest(items.filter(F.col("of") == lang), "top", "item", n).select("item", "ns") for lang, n in sorted(slots.items())]
    return stored(reduce(DataFrame.unionByName, chosen), "language-model")


def _totals(counts: DataFrame) -> dict[str, float]:
    return {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").cast("double").alias("n")).collect()}


def fit(labelled: DataFrame, words: int = 100_000, grams: int = 200_000, alpha: float = 0.5) -> LanguageModel:
    """Learn from (text, lang). ``words`` and ``grams`` bound the model, not the rows it is learnt from.

    The n-grams are those of all words, each word weighing what it was counted.
    """
    counts = stored(word_counts(labelled), "language-words").withColumnRenamed("word", "item")
    sizes = _totals(counts)
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([])

    def table(of: DataFrame, totals: dict[str, float], keep: int) -> tuple:
        return _table(_most_telling(of, totals, keep), langs, totals, alpha)

    word_at, word_logs, word_has = table(counts, sizes, words)
    gram_counts = stored(gram_counts_of(counts), "language-grams")
    gram_at, gram_logs, gram_has = table(gram_counts, _totals(gram_counts), grams)
    return LanguageModel(langs, word_at, word_logs, gram_at, gram_logs, word_has, gram_has)


def with_language(docs: DataFrame, model: LanguageModel, name: str, text_col: str = "text", evidence: int = 20,
                  fitting: bool = True) -> DataFrame:
    """``docs`` with a struct (lang, score, fit) as ``name``; null or letterless text is ``und`` with score and fit 0.

    One pass of Python over the rows, whatever is read of the struct later. Without ``fitting`` the fit isn't worked out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    at = docs.columns.index(text_col)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("fit", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(LanguageModel(**sent.value), evidence, fitting)
        for batch in batches:
            found = list(reader.judge(t.as_py() for t in batch.column(at)))
            langs, scores, fits = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
            told = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.float64())], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, told], [*batch.schema.names, name])

    added = StructType().add("lang", "string").add("score", "double").add("fit", "double")
    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, added))


def identify(docs: DataFrame, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", **bounds: int) -> DataFrame:
    """Learn from the documents outside the held-out fold, predict all: doc_id, held_out, lang_pred, score.

    Rows with a null text or lang teach nothing; a null text, an empty one or one without a letter is ``und``.
    A null doc_id counts as fold 0. Repeated rows are each predicted. Equal scores go to the language first in
    the alphabet. Without any labelled row everything is ``und``.
    """
    out = (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    )
    model = fit(rows.filter(~out), **bounds)
    return with_language(rows.select("doc_id", "text"), model, "p", fitting=False).select(
        "doc_id", out, F.col("p.lang").alias("lang_pred"), "p.score"
    )
