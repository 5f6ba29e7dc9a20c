"""Quality rules with an isolation forest over their statistics.

Every text gets the counts that quality rules look at.  Fixed rules reject the plain failures.  Of the rest, forests
of random splits isolate rows by the rules' ratios, one forest per ratio and one over all of them: a row that few
splits set apart from a sample is an anomaly, whatever the direction.  The score is ``2 ** (-path / expected path)``.

Where a forest's score starts to mean a bad document is calibrated from labels, over all labelled rows: the cut of
one forest that parts good from bad best is taken, the rows it rejects leave, and the next cut is looked for among
what is left, until no cut gains enough.  A ratio that is unusual without being bad gets no cut.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.llm.common import col, discard, map_text, stored

#: Forests grow on about this many labelled rows that pass the fixed rules, chosen by a hash.
SAMPLE_ROWS = 20_000
TREES, ROWS_PER_TREE = 100, 256
#: Scores lie between 0 and 1 and are compared in steps of this size.
STEPS = 2000
#: A cut must raise (share of bad rejected) - (share of good rejected) by so much, and may reject so many of the good.
LEAST_GAIN, MOST_GOOD = 0.02, 0.01
SEED = 42
#: Fixed by the contract: characters that count as symbols, the least words, the most percent of repeated words.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MOST_REPEATED = 50, 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("mean_word", "symbol_share", "dup_lines", "repeat_share")


def _repeated(words: list[bytes], width: int = 3) -> int:
    """How many words stand in a window of ``width`` words that the text has at least twice."""
    if len(words) <= width:
        return 0
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    if len(numbers) > len(words) - width:
        return 0
    window = codes
    for k in range(1, width):
        both = window[:-1] * len(numbers) + codes[k:]
        distinct, window = np.unique(both, return_inverse=True)
    if len(distinct) == len(window):
        return 0
    again = np.bincount(window)[window] > 1
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, np.flatnonzero(again), 1)
    np.add.at(covered, np.flatnonzero(again) + width, -1)
    return int((np.cumsum(covered) > 0).sum())


def counts(text: bytes | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text in UTF-8; words lie between ASCII white space."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()
    data = np.frombuffer(text, dtype=np.uint8)
    # Code points start at bytes that do not continue one.
    points = int(np.count_nonzero((data & 0xC0) != 0x80))
    white = int(np.count_nonzero((data == 32) | ((data >= 9) & (data <= 13))))
    lines = [line for line in text.split(b"\n") if line.strip()]
    symbols = sum(text.count(bytes([s])) for s in SYMBOLS)
    return len(words), points - white, symbols, len(lines) - len(set(lines)), _repeated(words)


def statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with ``COUNTS`` and ``base_failed``, the verdict of the fixed rules.

    A null text has no words, like an empty one, so it fails.
    """

    def start():
        return lambda texts: list(zip(*map(counts, texts)))

    found = map_text(docs, [T.StructField(c, T.LongType()) for c in COUNTS], start, keep=keep)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def ratios(table: np.ndarray) -> np.ndarray:
    """Rows of ``COUNTS`` as rows of ``RATIOS``."""
    words = np.maximum(table[:, 0], 1).astype(float)
    # Lines are few and long or many and short: their repeats count against the words, on a flat scale.
    return np.stack([table[:, 1] / words, table[:, 2] / words, np.log1p(table[:, 3]), table[:, 4] / words], axis=1)


def expected_path(n: np.ndarray | int) -> np.ndarray:
    """Mean depth at which a random search tree of ``n`` rows isolates one."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays [tree, node]: the ratio looked at (-1: a leaf), the border, and the path that ends here."""

    ratio: np.ndarray
    border: np.ndarray
    path: np.ndarray
    scale: float

    @classmethod
    def grow(cls, data: np.ndarray, allowed: list[int], rng: np.random.Generator, trees: int = TREES, rows: int = ROWS_PER_TREE) -> "Forest":
        """Each tree parts its own sample at random borders of random ratios, down to the mean depth or single rows."""
        rows = min(rows, len(data))
        depth = max(1, int(np.ceil(np.log2(max(2, rows)))))
        nodes = 2 ** (depth + 1) - 1
        ratio = np.full((trees, nodes), -1, dtype=np.int64)
        border = np.zeros((trees, nodes))
        path = np.zeros((trees, nodes))
        for t in range(trees):
            inside = {0: rng.choice(len(data), size=rows, replace=False)}
            for node in range(nodes):
                at = inside.pop(node, None)
                if at is None:
                    continue
                level = int(np.log2(node + 1))
                low, high = data[at][:, allowed].min(axis=0), data[at][:, allowed].max(axis=0)
                open_ = np.flatnonzero(high > low)
                path[t, node] = level + expected_path(len(at))
                if level == depth or not len(open_):
                    continue
                k = rng.choice(open_)
                cut = rng.uniform(low[k], high[k])
                left = data[at, allowed[k]] <= cut
                if left.all() or not left.any():
                    continue
                ratio[t, node], border[t, node] = allowed[k], cut
                inside[2 * node + 1], inside[2 * node + 2] = at[left], at[~left]
        return cls(ratio, border, path, float(max(expected_path(rows), 1e-9)))

    def score(self, data: np.ndarray) -> np.ndarray:
        """Between 0 and 1 per row; high where few splits isolate it."""
        total = np.zeros(len(data))
        levels = int(np.log2(self.ratio.shape[1] + 1))
        rows = np.arange(len(data))
        for ratio, border, path in zip(self.ratio, self.border, self.path):
            node = np.zeros(len(data), dtype=np.int64)
            for _ in range(levels - 1):
                at = ratio[node]
                inner = at >= 0
                if not inner.any():
                    break
                right = data[rows, np.maximum(at, 0)] > border[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += path[node]
        return 2.0 ** (-total / len(self.path) / self.scale)


@dataclass
class Model:
    """Forests and the calibrated cuts: (forest, least step that is rejected), in the order they were found."""

    forests: list[Forest]
    cuts: list[tuple[int, int]] = field(default_factory=list)

    def steps(self, table: np.ndarray) -> np.ndarray:
        """Scores of rows of ``COUNTS`` per forest, as whole steps."""
        data = ratios(table)
        return np.stack([np.floor(f.score(data) * STEPS) for f in self.forests], axis=1).astype(np.int32)


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (with ``COUNTS``) and an array ``steps`` with each forest's score."""
    others = [f for f in rows.schema.fields if f.name not in COUNTS]
    carried = [f"__c{i}" for i in range(len(others))]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([batch.column(i).to_numpy() for i in range(len(COUNTS))], axis=1)
            steps = model.steps(table)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, steps.size + 1, steps.shape[1], dtype=np.int32)), pa.array(steps.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*COUNTS, *carried, "__steps"])

    schema = [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, f.dataType) for c, f in zip(carried, others)]
    schema.append(T.StructField("__steps", T.ArrayType(T.IntegerType())))
    data = rows.select(*COUNTS, *[col(f.name).alias(c) for c, f in zip(carried, others)])
    return data.mapInArrow(run, T.StructType(schema)).toDF(*COUNTS, *[f.name for f in others], "steps")


def _rejected(cuts: list[tuple[int, int]], steps: Column) -> Column:
    out = F.lit(False)
    for forest, least in cuts:
        out = out | (steps[forest] >= least)
    return out


def best_cut(found: list[tuple[int, int, int, int]], good: int, bad: int, allowed: float) -> tuple[float, int, int, float] | None:
    """(gain, forest, least step, share of good rejected) of the best cut.

    ``found`` has (forest, step, good rows, bad rows); shares are of all ``good`` and ``bad`` rows.  Ties go to the
    earlier forest and to the higher step, which rejects less.
    """
    best = None
    for forest in sorted({f for f, *_ in found}):
        lost = caught = 0
        for _, step, g, b in sorted((r for r in found if r[0] == forest), reverse=True):
            lost, caught = lost + g, caught + b
            if lost <= allowed * good:
                gain = caught / bad - lost / good
                if best is None or gain > best[0]:
                    best = (gain, forest, step, lost / good)
    return best


def calibrate(rows: DataFrame, model: Model) -> Model:
    """The model with cuts from ``rows`` (steps, quality): rows per forest and step are counted over all of them."""
    counts_ = rows.groupBy("quality").count().collect()
    number = {r["quality"]: r["count"] for r in counts_}
    good, bad = number.get(1, 0), number.get(0, 0)
    cuts: list[tuple[int, int]] = []
    lost = 0.0
    while good and bad:
        left = rows.where(~_rejected(cuts, F.col("steps"))).select("quality", F.posexplode("steps").alias("forest", "step"))
        table = left.groupBy("forest", "step").agg(F.count_if(F.col("quality") == 1).alias("g"), F.count_if(F.col("quality") == 0).alias("b"))
        # At most one row per forest and step goes to the driver.
        best = best_cut([tuple(r) for r in table.collect()], good, bad, MOST_GOOD - lost)
        if best is None or best[0] < LEAST_GAIN:
            break
        lost += best[3]
        cuts.append(best[1:3])
    return Model(model.forests, cuts)


def train(stats: DataFrame, labels: DataFrame) -> Model:
    """Forests and cuts from ``stats`` (doc_id, ``COUNTS``, base_failed) and ``labels`` (doc_id, quality 0 or 1).

    A document with several labels has the least of them; null labels and documents without an id teach nothing.
    Without labelled rows that pass the fixed rules, or without both kinds of them, there are no cuts.
    """
    quality = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = stored(stats.where("not base_failed").select("doc_id", *COUNTS).join(quality, "doc_id").select(*COUNTS, "quality", F.xxhash64("doc_id", *COUNTS).alias("place")), "labelled")
    sample = known.orderBy("place", *COUNTS).limit(SAMPLE_ROWS).select(*COUNTS).collect()
    if not sample:
        return Model([])
    data = ratios(np.array([tuple(r) for r in sample], dtype=np.int64))
    rng = np.random.default_rng(SEED)
    forests = [Forest.grow(data, [k], rng) for k in range(len(RATIOS))]
    forests.append(Forest.grow(data, list(range(len(RATIOS))), rng))
    model = Model(forests)
    scored = stored(_scored(known.select(*COUNTS, "quality"), model).select("quality", "steps"), "scores")
    model = calibrate(scored, model)
    for table in (known, scored):
        discard(table)
    return model


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, ``COUNTS``, base_failed, kept, and ``score``, the forest's over all ratios.

    ``kept`` is false where a fixed rule fails or a calibrated cut rejects the row.  Rows that share a doc_id are
    judged each by its own text; a null doc_id is judged like any other; other columns are ignored.
    """
    stats = stored(statistics(docs, keep=["doc_id"]), "statistics")
    model = train(stats, labels)
    if not model.forests:
        return stats.withColumn("kept", ~F.col("base_failed")).withColumn("score", F.lit(None).cast("double"))
    found = _scored(stats, model)
    kept = ~F.col("base_failed") & ~_rejected(model.cuts, F.col("steps"))
    return found.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), (F.col("steps")[len(RATIOS)] / STEPS).alias("score"))
