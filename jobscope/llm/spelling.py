"""Spelling variants by a dictionary of trie-node pairs.

All words stand in two tries, one from the front and one from the back, whose nodes are numbered.  A word without
its i-th character is the pair (node of what stands before, node of what stands after); a word cut at a gap is such
a pair too.  Two words that differ in one replaced character skip to the same pair at the same place; a word that
lacks one character of another is cut at a gap into the pair that the other skips to.  So integer pairs, joined by
equality, give exactly the words at distance one, and never more than one word per letter meets at a pair.

Numbering: words are dealt to ranges in order, and each range walks its words with the path of the word before.
Nodes that go on over the edge of a range are numbered on the driver from the first and last word of each range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobscope.llm.common import discard, small, stored

#: Words are runs of these characters (fixed by the contract), of at least so many, seen at least so often.
LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT = 6, 5
#: One run in so many loses a character, by the checksum of its document and itself.
DAMAGED = 199
#: A word is a form of another if it is at least so many times as frequent.
FORM_FACTOR = 5

_SKIP, _SKIP_FIRST, _GAP = 0, 1, 2


def damaged(word: Column, doc_id: Column, every: int = DAMAGED) -> Column:
    """``word`` without the character that its document's checksum names, where the checksum names one."""
    mark = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), word).cast("binary"))
    length = F.length(word)
    at = (mark % length).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, length))
    return F.when((mark % every == 0) & (length > 0), cut).otherwise(word)


def words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the distinct words of whole texts with their occurrences.

    Runs shorter than ``min_length`` cannot give a word and are passed over.  A null text has no words; in a row
    without a doc_id no run is damaged; a repeated row counts again.
    """
    runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", lower.alias("run"))
    word = F.when(F.col("doc_id").isNull(), F.col("run")).otherwise(damaged(F.col("run"), F.col("doc_id")))
    counted = found.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").count()
    return counted.where(F.col("count") >= min_count).select("word", F.col("count").alias("n"))


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _borders(edges: list[tuple[int, str, str]]) -> dict[int, tuple[list[int], str, list[int]]]:
    """Per range (its place, first word, last word): nodes that its first word's prefixes have from ranges before,
    its last word, and the nodes of that word's prefixes which the next range shares.  All have negative numbers."""
    out, made = {}, 0
    before: list[int] = []
    for k, (place, first, last) in enumerate(edges):
        through = min(_common(first, last), len(before) - 1) if before else -1
        after: list[int] = []
        if k + 1 < len(edges):
            shared = _common(last, edges[k + 1][1])
            after = before[: min(through, shared) + 1]
            while len(after) <= shared:
                made -= 1
                after.append(made)
        out[place] = (before, last, after)
        before = after
    return out


def _walk(column: str, borders: dict):
    """Per word of ranges in order: the nodes of its prefixes, from the empty one to the whole word."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, number, path, last_word = None, 0, [], ""
        for batch in batches:
            paths = []
            for part, word in zip(batch.column("part").to_pylist(), batch.column(column).to_pylist()):
                if part != place:
                    place, number = part, 0
                    before, last, after = borders[part]
                    path = list(before)
                    shared = len(path) - 1
                else:
                    shared = _common(last_word, word)
                del path[shared + 1 :]
                known = min(_common(word, last), len(after) - 1) if after else -1
                while len(path) <= len(word):
                    if len(path) <= known:
                        path.append(after[len(path)])
                    else:
                        path.append((part << 36) + number)
                        number += 1
                last_word = word
                paths.append(np.array(path, dtype=np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int32)
            values = np.concatenate(paths) if paths else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "path"])

    return walk


def _edges(sorted_: DataFrame, column: str) -> dict:
    """One row per range goes to the driver."""
    by = sorted_.groupBy("part").agg(F.min(column).alias("first"), F.max(column).alias("last"))
    return _borders(sorted((r["part"], r["first"], r["last"]) for r in by.collect()))


def _numbered(sorted_: DataFrame, column: str) -> DataFrame:
    """(id, path) of words whose ranges ``part`` follow the order of ``column``."""
    walk = _walk(column, _edges(sorted_, column))
    ordered = sorted_.repartition("part").sortWithinPartitions("part", column)
    return ordered.select("id", "part", column).mapInArrow(walk, "id long, path array<long>")


def _ranged(df: DataFrame, column: str) -> DataFrame:
    return df.repartitionByRange(column).sortWithinPartitions(column).withColumn("part", F.spark_partition_id().cast("long"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node pairs (p, s) of each word: one per skipped character and one per gap."""
    for batch in batches:
        if not batch.num_rows:
            continue
        front, back = batch.column("front"), batch.column("back")
        # Lists have one node more than the word has characters, on both sides.
        size = np.diff(front.offsets.to_numpy()).astype(np.int64)
        start, back_start = (x.offsets.to_numpy()[:-1].astype(np.int64) for x in (front, back))
        f, b = front.values.to_numpy(), back.values.to_numpy()
        ids, n = batch.column("id").to_numpy(), batch.column("n").to_numpy()

        def spread(number):
            row = np.repeat(np.arange(len(size)), number)
            return row, np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)

        row, i = spread(size)
        gap = pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (f[start[row] + i], b[back_start[row] + size[row] - 1 - i], ids[row], n[row], np.full(len(row), _GAP, dtype=np.int32))],
            names=["p", "s", "id", "n", "kind"],
        )
        yield gap
        row, i = spread(size - 1)
        # Of a run of equal characters each skip leaves the same word; the first stands for it.
        text = "".join(batch.column("word").to_pylist())
        chars = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        first = np.ones(len(chars), dtype=bool)
        first[1:] = chars[1:] != chars[:-1]
        first[i == 0] = True
        kind = np.where(first, _SKIP_FIRST, _SKIP).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (f[start[row] + i], b[back_start[row] + size[row] - 2 - i], ids[row], n[row], kind)],
            names=["p", "s", "id", "n", "kind"],
        )


def _near(rows: list[np.ndarray]) -> list[np.ndarray]:
    """(id, near, best_n, best) of whole groups of rows (p, s, id, n, kind) that stand together."""
    p, s, ids, n, kind = rows
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
    group = np.cumsum(new) - 1
    keep = np.bincount(group)[group] > 1
    group, ids, n, kind = group[keep], ids[keep], n[keep], kind[keep]
    if not len(group):
        return [np.zeros(0, dtype=np.int64)] * 4
    group = np.unique(group, return_inverse=True)[1]
    number = group[-1] + 1
    gap = kind == _GAP
    out = []

    def best_of(chosen):
        """Places of the best and second best chosen row per group: largest n, then smallest id; -1 for none."""
        at = np.flatnonzero(chosen)
        at = at[np.lexsort((ids[at], -n[at], group[at]))]
        g = group[at]
        top = np.ones(len(at), dtype=bool)
        top[1:] = g[1:] != g[:-1]
        best, second = np.full(number, -1), np.full(number, -1)
        best[g[top]] = at[top]
        follows = np.flatnonzero(top) + 1
        follows = follows[(follows < len(at)) & ~np.append(top, True)[follows]]
        second[g[follows]] = at[follows]
        return best, second

    # Words that skip to the pair: one replaced character apart.
    best, second = best_of(~gap)
    skips = np.bincount(group[~gap], minlength=number)
    at = np.flatnonzero(~gap)
    other = np.where(best[group[at]] == at, second[group[at]], best[group[at]])
    at, other = at[other >= 0], other[other >= 0]
    out.append((ids[at], skips[group[at]] - 1, n[other], ids[other]))
    # The word that the pair makes without anything between: one missing character apart.
    cut, _ = best_of(gap)
    at = np.flatnonzero(kind == _SKIP_FIRST)
    at = at[cut[group[at]] >= 0]
    other = cut[group[at]]
    out.append((ids[at], np.ones(len(at), dtype=np.int64), n[other], ids[other]))
    longer, _ = best_of(kind == _SKIP_FIRST)
    many = np.bincount(group[kind == _SKIP_FIRST], minlength=number)
    at = np.flatnonzero(gap)
    at = at[longer[group[at]] >= 0]
    other = longer[group[at]]
    out.append((ids[at], many[group[at]], n[other], ids[other]))
    return [np.concatenate(c).astype(np.int64) for c in zip(*out)]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of rows sorted by pair; a group that a batch cuts waits for its rest (one word per letter at most)."""
    waiting: list[np.ndarray] | None = None

    def out(rows):
        found = _near(rows)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["id", "near", "best_n", "best"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy() for c in batch.columns]
        if waiting:
            rows = [np.concatenate(c) for c in zip(waiting, rows)]
        p, s = rows[:2]
        same = (p == p[-1]) & (s == s[-1])
        whole = int(np.argmax(same))
        waiting = [c[whole:] for c in rows]
        if whole:
            yield out([c[:whole] for c in rows])
    if waiting:
        yield out(waiting)


def neighbours(counted: DataFrame) -> DataFrame:
    """(id, near, best_n, best) of numbered words (id, word, n) that have a neighbour at distance one.

    ``best`` is the id of the most frequent neighbour, on ties the smallest; ids follow the order of words.
    """
    front = _numbered(counted, "word")
    reversed_ = stored(_ranged(counted.select("id", F.reverse("word").alias("drow")), "drow"), "reversed")
    back = _numbered(reversed_, "drow")
    both = counted.select("id", "word", "n").join(front.withColumnRenamed("path", "front"), "id")
    both = both.join(back.withColumnRenamed("path", "back"), "id").select("id", "word", "n", "front", "back")
    pairs = both.mapInArrow(_pairs, "p long, s long, id long, n long, kind int")
    dealt = pairs.repartition("p", "s").sortWithinPartitions("p", "s")
    met = dealt.mapInArrow(_meet, "id long, near long, best_n long, best long")
    best = F.max(F.struct(F.col("best_n").alias("n"), (-F.col("best")).alias("id"))).alias("b")
    found = met.groupBy("id").agg(F.sum("near").alias("near"), best)
    found = stored(found.select("id", "near", F.col("b.n").alias("best_n"), (-F.col("b.id")).alias("best")), "near")
    discard(reversed_)
    return found


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) of links (id, form), following forms to the last; counts grow along them, so there are no cycles.

    Each round doubles the steps that are known.  A form is at least ``FORM_FACTOR`` times as frequent as its word,
    so a chain has at most log(largest n) steps and a handful of rounds ends it.
    """
    roots = stored(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = roots.join(small(on), "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        new = stored(step, "roots")
        moved = not new.where("moved").isEmpty()
        discard(roots)
        roots = new.select("id", "root")
        if not moved:
            return roots


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FORM_FACTOR) -> DataFrame:
    """One row per word of the texts: word, n, n_near, form, form_n, root.

    ``n_near`` counts the words that differ by exactly one inserted, deleted or replaced character.  ``form`` is the
    most frequent of them (on ties the smallest in code-point order) if it is at least ``factor`` times as frequent
    as the word; ``root`` is where following forms ends, the word itself if it has none.  Empty tables give no rows;
    other columns of ``docs`` are ignored.
    """
    # Ids follow the ranges and the order within them, so they stand in code-point order of the words.
    counted = stored(_ranged(words(docs, min_length, min_count), "word").withColumn("id", F.monotonically_increasing_id()), "words")
    near = neighbours(counted)
    own = counted.select("id", "n")
    forms = near.join(own, "id").where(F.col("best_n") >= F.col("n") * factor).select("id", F.col("best").alias("form"), F.col("best_n").alias("form_n"))
    forms = stored(forms, "forms")
    links = forms.join(_roots(forms), "id")
    names = counted.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    links = links.join(names, "form").join(names.toDF("root", "root_word"), "root").select("id", "form_word", "root_word", "form_n")
    rows = counted.join(near.select("id", "near"), "id", "left").join(links, "id", "left")
    return rows.select(
        "word",
        F.col("form_word").alias("form"),
        F.coalesce("root_word", "word").alias("root"),
        "n",
        F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
        F.col("form_n").cast("long").alias("form_n"),
    )

