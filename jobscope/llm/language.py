"""Language of whole texts: known words by per-language log frequency, unseen words by character n-grams.

A word that the model knows adds its log frequency in each language.  For any other word the longest n-grams
that the model knows are used (4 letters, then 3, 2, 1): their mean log frequency stands for the word.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.llm.common import discard, map_text, stored

#: Frequencies are counted over about this many labelled documents, an equal share for each language, chosen by a hash.
SAMPLE_ROWS = 12000
#: Words that the model keeps by themselves, an equal share for each language, the most frequent first; all words of
#: the sample count for the n-grams.
KNOWN_WORDS = 60000
#: Every language has at least this many documents of the sample and words, however many languages there are.
LEAST_ROWS, LEAST_WORDS = 200, 1000
LONGEST = 4
#: Evidence is capped at this many words, so that scores of long texts stay comparable.
EVIDENCE_WORDS = 25
MIN_SCORE = 0.5
UNDETERMINED = "und"
#: Unseen words whose sums a task remembers.
REMEMBERED = 100000

_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: bytes | None) -> Counter:
    """Lower-cased letter runs of a text; empty when it has no letter."""
    found = Counter(_WORDS.findall(text.decode("utf-8", "replace").lower())) if text else Counter()
    return found if any(c.isalpha() for w in found for c in w) else Counter()


def _grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _table(counts: dict[str, np.ndarray], number: int) -> tuple[dict[str, int], np.ndarray]:
    """The place of each entry, and log frequencies per language; unseen ones count one half."""
    names = sorted(counts)
    seen = np.array([counts[k] for k in names]).reshape(len(names), number)
    totals = seen.sum(axis=0) + 0.5 * len(names)
    return {k: i for i, k in enumerate(names)}, np.log((seen + 0.5) / totals).astype(np.float32)


@dataclass
class Model:
    """Log frequencies [entry, language] of known words and of n-grams, with the place of each entry."""

    languages: list[str]
    words: dict[str, int]
    word_table: np.ndarray
    grams: list[dict[str, int]]
    gram_tables: list[np.ndarray]

    def unseen(self, words: list[str]) -> np.ndarray:
        """Per word the mean row of its longest n-grams that are known; zeros if not even a letter is."""
        out = np.zeros((len(words), len(self.languages)), dtype=np.float32)
        open_ = np.arange(len(words))
        for n in range(LONGEST, 0, -1):
            if not len(open_) or not self.grams[n - 1]:
                continue
            grams = [_grams(words[i], n) for i in open_.tolist()]
            number = np.fromiter(map(len, grams), dtype=np.int64, count=len(grams))
            get = self.grams[n - 1].get
            at = np.fromiter((get(g, -1) for word in grams for g in word), dtype=np.int64, count=int(number.sum()))
            word = np.repeat(np.arange(len(grams)), number)[at >= 0]
            if not len(word):
                continue
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sums = np.add.reduceat(self.gram_tables[n - 1][at[at >= 0]], first, axis=0, dtype=np.float64)
            times = np.diff(np.append(first, len(word)))
            out[open_[word[first]]] = sums / times[:, None]
            open_ = np.delete(open_, word[first])
        return out

    def predictor(self):
        """texts -> (languages, scores); rows of unseen words are remembered behind those of known words."""
        places, table = dict(self.words), self.word_table

        def predict(texts: list[bytes | None]) -> tuple[list[str], list[float]]:
            nonlocal places, table
            counts = [words_of(t) if self.languages else {} for t in texts]
            if len(places) > len(self.words) + REMEMBERED:
                places, table = dict(self.words), self.word_table
            new = list(dict.fromkeys(w for c in counts for w in c if w not in places))
            places.update(zip(new, range(len(places), len(places) + len(new))))
            table = np.concatenate([table, self.unseen(new)]) if new else table
            names, scores = [], []
            for found in counts:
                if not found:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                times = np.fromiter(found.values(), dtype=np.float64, count=len(found))
                mean = times @ table[list(map(places.__getitem__, found))] / times.sum()
                weight = np.exp((mean - mean.max()) * min(times.sum(), EVIDENCE_WORDS))
                best = int(mean.argmax())
                names.append(self.languages[best])
                scores.append(float(weight[best] / weight.sum()))
            return names, scores

        return predict


def held_out() -> F.Column:
    """Whether a row must not be learned from; false without a doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _count(batches):
    """Partial (language, word) counts of each batch."""
    for batch in batches:
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            counts[lang].update(words_of(text))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        lang, word, n = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])


def _shares(sizes: dict[str, int], total: int, least: int) -> dict[str, int]:
    """How much of ``total`` each language gets: the same, or all it has, and never less than ``least`` of it."""
    out, left = {}, total
    for i, lang in enumerate(sorted(sizes, key=lambda x: (sizes[x], x))):
        out[lang] = min(sizes[lang], max(least, left // (len(sizes) - i)))
        left = max(0, left - out[lang])
    return out


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, known_words: int = KNOWN_WORDS) -> Model:
    """Count words of about ``sample_rows`` documents that have a language, a doc_id and are not held out.

    Every language that stands on such a document is learned, from a sample of its own.  Without such documents the
    model knows no language, and every prediction is ``und``.
    """
    empty = np.zeros((0, 0), dtype=np.float32)
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    # One row per language goes to the driver.
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], {}, empty, [], [])
    languages = sorted(sizes)
    wanted = _shares(sizes, sample_rows, LEAST_ROWS)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, wanted[lang] / sizes[lang])])
    chosen = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(2)), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(chosen < share[F.col("lang")]).select("lang", F.col("text").cast("binary"))
    counts = stored(sample.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    found = {r["lang"]: r["count"] for r in counts.groupBy("lang").count().collect()}
    keep = _shares(found, known_words, LEAST_WORDS) if found else {}
    place_of = {lang: i for i, lang in enumerate(languages)}
    tables: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(len(languages))) for _ in range(LONGEST + 1)]
    for lang in found:
        for r in counts.where(F.col("lang") == lang).orderBy(F.desc("n"), "word").limit(keep[lang]).collect():
            tables[0][r["word"]][place_of[lang]] += r["n"]
    gram = F.explode(F.flatten(F.array(*[_gram_column(n) for n in range(1, LONGEST + 1)])))
    grams = counts.select("lang", "n", gram.alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    for r in grams.toLocalIterator():
        text = r["gram"]
        tables[int(text[0])][text[1:]][place_of[r["lang"]]] += r["n"]
    discard(counts)
    places, numbers = zip(*[_table(t, len(languages)) for t in tables])
    return Model(languages, places[0], numbers[0], list(places[1:]), list(numbers[1:]))


def _gram_column(n: int) -> F.Column:
    """The word's n-grams as ``_grams`` makes them, with n in front."""
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$")) if n > 1 else F.col("word")
    places = F.sequence(F.lit(1), F.length(padded) - n + 1)
    return F.when(F.length(padded) >= n, F.transform(places, lambda i: F.concat(F.lit(str(n)), F.substring(padded, i, F.lit(n))))).otherwise(F.array())


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` (or its columns ``keep``) with a predicted language and a score from 0 to 1.

    Texts that are null or have no letter are ``und`` with score 0.  Ties go to the language that sorts first.
    A text whose letters the model has never seen gets that language too, with score 1 / number of languages.
    """
    fields = [T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())]
    return map_text(docs, fields, model.predictor, keep=keep)
