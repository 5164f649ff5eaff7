"""Language identification: words first, then ever shorter character n-grams.

A known word adds its log frequency in each language. A word that no language knows is scored by the
longest of its character n-grams that are known: all 5-grams of the bounded word, else its 4-grams, and so
on down to single characters; the word then adds the mean log frequency of the known n-grams of that
order. The language with the largest sum wins.

The model is sparse: a word or n-gram has an entry for each language that it was seen in, so its size is that
of the sample's vocabulary, whatever the number of languages. Nothing of the sample's vocabulary is left out;
words, of which there are many, are held by 60 bits of their MD5.

Defined cases: a null text, a text without a letter and any text when nothing was learned (an empty table,
or no row with text, lang and doc_id) get ``und`` and score 0. A letter that no language knows adds nothing; a
text of such letters alone gets the most frequent language with score 1 / languages. Equal sums go to the
language with more labelled rows, then to the smaller name. Very long texts are read whole. Rows are kept as
they are, repeated ones too. A row whose doc_id is null is never learned from and counts as held out. Extra
columns pass through, but for those with the names of the results, which these replace.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociscale.llm.common import hash60, replaced, small_batches, spread, uniform

ORDERS = (5, 4, 3, 2, 1)
TOKEN = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Numbers (one a language) that a task remembers of the scores of unseen words.
MEMO = 1 << 19
#: Words whose rows a task remembers.
WORDS = 1 << 16


def grams(word: str, n: int) -> list[str]:
    """The character n-grams of a word with its bounds marked."""
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


def word_key(word: str) -> int:
    """What ``hash60`` gives in the plan."""
    return int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:15], 16)


class LogTable:
    """Log frequencies of the words, or n-grams of one order, by language: one entry for each that a language
    has, above what the language gives to all that it lacks."""

    def __init__(self, rows: np.ndarray, langs: np.ndarray, seen: np.ndarray, languages: int):
        """Entries by row (of a word or n-gram; they ascend), language and how often it was seen there."""
        n = int(rows[-1]) + 1 if len(rows) else 0
        self.starts = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
        self.langs = langs.astype(np.int32)
        self.above = np.log(seen + 0.5) - np.log(0.5)
        self.lacking = np.log(0.5) - np.log(np.bincount(langs, weights=seen, minlength=languages) + 0.5 * (n + 1))

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the entries of ``rows``, one after the other, and how many each row has."""
        first = self.starts[rows].astype(np.int64)
        sizes = self.starts[rows + 1] - first
        ends = np.cumsum(sizes)
        return np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0), sizes

    def total(self, rows: np.ndarray) -> np.ndarray:
        """The sums over ``rows``, which may repeat."""
        at, _ = self.entries(rows)
        return len(rows) * self.lacking + np.bincount(self.langs[at], weights=self.above[at], minlength=len(self.lacking))


class BackoffModel:
    """Per-language log frequencies of words and of character n-grams."""

    def __init__(self, seen: pa.Table, prior: dict[str, int]):
        """seen: (n, gram, key, lang, seen), n being 0 for words, which come by key, n-grams by gram; prior: labelled
        rows by language."""
        self.langs = sorted(prior, key=lambda x: (-prior[x], x))
        place = pa.array(self.langs, pa.string())
        self.tables: dict[int, LogTable] = {}
        self.grams: dict[int, dict[str, int]] = {}
        for order in (0, *ORDERS):
            own = seen.filter(pc.equal(seen["n"], order))
            langs = pc.index_in(own["lang"], value_set=place).to_numpy().astype(np.int64)
            if order:
                coded = own["gram"].combine_chunks().dictionary_encode()
                self.grams[order], rows = {g: i for i, g in enumerate(coded.dictionary.to_pylist())}, coded.indices.to_numpy().astype(np.int64)
            else:
                self.words, rows = np.unique(own["key"].to_numpy().astype(np.int64).view(np.uint64), return_inverse=True)
            by = np.argsort(rows, kind="stable")
            self.tables[order] = LogTable(rows[by], langs[by], own["seen"].to_numpy().astype(float)[by], len(self.langs))
        self._known: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        """An empty memo of scored unseen words: their rows in a table that grows to MEMO numbers."""
        self._rows: dict[str, int] = {}
        self._scores = np.zeros((64, len(self.langs)))

    def _word_rows(self, tokens: list[str]) -> np.ndarray:
        """The rows of words in their table, -1 where they aren't known; those of the latest are remembered."""
        at = np.fromiter(map(self._known.get, tokens, repeat(-2)), dtype=np.int64, count=len(tokens))
        new = np.flatnonzero(at == -2)
        if len(new):
            words = [tokens[i] for i in new]
            if len(self.words):
                own = np.fromiter(map(word_key, words), dtype=np.uint64, count=len(words))
                place = np.minimum(np.searchsorted(self.words, own), len(self.words) - 1)
                at[new] = np.where(self.words[place] == own, place, -1)
            else:
                at[new] = -1
            if len(self._known) > WORDS:
                self._known.clear()
            self._known.update(zip(words, at[new].tolist(), strict=True))
        return at

    def unseen(self, words: list[str]) -> np.ndarray:
        """Scores of words that are not known, one row each: of the longest n-grams of each that are."""
        out, size = np.zeros((len(words), len(self.langs))), len(self.langs)
        left = list(range(len(words)))
        for n in ORDERS:
            find, table = self.grams[n].get, self.tables[n]
            found = [(i, r) for i in left for g in grams(words[i], n) if (r := find(g)) is not None]
            if not found:
                continue
            own, rows = np.array(found).T
            count = np.bincount(own, minlength=len(words))
            at, sizes = table.entries(rows)
            above = np.bincount(np.repeat(own, sizes) * size + table.langs[at], weights=table.above[at], minlength=out.size).reshape(out.shape)
            hit = np.flatnonzero(count)
            out[hit] = above[hit] / count[hit, None] + table.lacking
            left = [i for i in left if not count[i]]
            if not left:
                break
        return out

    def _unseen_total(self, words: list[str]) -> np.ndarray:
        if len(self._rows) * len(self.langs) > MEMO:  # a word that is gone is scored anew
            self._forget()
        if new := list(dict.fromkeys(w for w in words if w not in self._rows)):
            at = len(self._rows)
            while at + len(new) > len(self._scores):
                self._scores = np.concatenate([self._scores, np.zeros_like(self._scores)])
            self._scores[at : at + len(new)] = self.unseen(new)
            self._rows.update(zip(new, range(at, at + len(new)), strict=True))
        return self._scores[[self._rows[w] for w in words]].sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        tokens = TOKEN.findall(text.lower()) if text else []
        if not self.langs or not (any(map(str.isalpha, tokens)) or any(c.isalpha() for t in tokens for c in t)):
            return UNKNOWN, 0.0
        at = self._word_rows(tokens)
        known = at >= 0
        score = self.tables[0].total(at[known])
        if not known.all():
            score = score + self._unseen_total([tokens[i] for i in np.flatnonzero(~known)])
        score = (score - score.max()) / np.sqrt(len(tokens))
        chances = np.exp(score)
        best = int(np.argmax(score))
        return self.langs[best], float(chances[best] / chances.sum())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], Counter] = defaultdict(Counter)

    def out() -> pa.RecordBatch:
        rows = [(lang, order, g, n) for (lang, order), own in found.items() for g, n in own.items()]
        found.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64())],
            names=["lang", "n", "gram", "seen"],
        )

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                found[lang, 0].update(own := Counter(TOKEN.findall(text.lower())))
                for n in ORDERS:
                    into = found[lang, n]
                    for word, count in own.items():
                        for g in grams(word, n):
                            into[g] += count
        if sum(map(len, found.values())) > 150_000:
            yield out()
    yield out()


def train(docs: DataFrame, *, docs_per_lang: int = 2_000, sample: int = 100_000, text: str = "text", lang: str = "lang", key: str = "doc_id") -> BackoffModel:
    """Fit on rows of ``docs`` with a language.

    docs_per_lang and sample bound the labelled rows that are fitted on: of a language with more than
    docs_per_lang, or than its even part of sample, about that many are drawn by a hash of key and text. All
    words and n-grams of the drawn texts are in the model; only one row a language is collected besides.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(key).alias("key")).where("lang IS NOT NULL AND key IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("lang", F.nullif("lang", F.lit(UNKNOWN))).where("lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    prior = {r["lang"]: r["n"] for r in sizes.collect()}
    if not prior:
        return BackoffModel(pa.table({c: pa.array([], k) for c, k in (("n", pa.int32()), ("gram", pa.string()), ("key", pa.int64()), ("lang", pa.string()), ("seen", pa.int64()))}), {})
    most = max(1, min(docs_per_lang, sample // len(prior)))
    limits = spark.createDataFrame([(k, int(min(1.0, most / n) * (1 << 40))) for k, n in prior.items()], "lang string, upto long")
    drawn = spread(rows).join(F.broadcast(limits), "lang").where(uniform(F.col("key"), F.col("text"), seed=10) < F.col("upto")).select("lang", "text")  # a row for each language
    seen = drawn.mapInArrow(_counts, "lang string, n int, gram string, seen long").groupBy("n", "gram", "lang").agg(F.sum("seen").alias("seen"))
    slim = seen.select("n", F.when(F.col("n") > 0, F.col("gram")).alias("gram"), F.when(F.col("n") == 0, hash60(F.col("gram"))).alias("key"), "lang", "seen")
    return BackoffModel(slim.toArrow(), prior)  # bounded by the vocabulary of the sample


def identify(docs: DataFrame, model: BackoffModel, *, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, in place of columns of those names."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the vocabulary of train()'s sample
    plain = replaced(spread(docs), lang_pred=F.lit(None).cast("string"), score=F.lit(None).cast("double"))
    at = [c.lower() for c in docs.columns].index(text.lower())
    source = docs.columns[at]

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(x) for x in batch.column(batch.schema.get_field_index(source)).to_pylist()]
            columns = [*batch.columns[:-2], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return plain.mapInArrow(predicted, plain.schema)


def held_out(key: str = "doc_id") -> Column:
    """True for the rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def language_id(docs: DataFrame) -> DataFrame:
    """Predictions for all of ``docs`` from a model of those that are not held out."""
    marked = replaced(docs, held_out=held_out())
    model = train(marked.where(~F.col("held_out")))
    return identify(marked, model)
