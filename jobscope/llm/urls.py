"""URL verdicts: rules first, and gradient-boosted trees on lexical features for everything else.

The trees learn from the URLs that a rule decides.  Features: lengths, depths, digit shares, entropies, parameter
counts, and how often the last one and two labels of the host are blocked among the labelled URLs.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.llm.common import small, stored

#: (verdict, host and path); fits the host and its subdomains where the path starts with the rule's.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: The trees are fitted on about this many labelled URLs, chosen by a hash of page_id.
SAMPLE_ROWS = 20000
TREES = 10
DEPTH = 4
#: Labelled URLs that an unseen suffix counts as, at the overall share of blocked ones.
PRIOR_WEIGHT = 5.0


def parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_of(host: F.Column, path: F.Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[F.Column, F.Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def lexical(url: str, host: str, path: str) -> list[float]:
    """Numbers that describe one URL."""
    query = url.partition("?")[2].partition("#")[0]
    digits = sum(map(str.isdigit, url))
    segments = [s for s in path.split("/") if s]
    labels = [x for x in host.split(".") if x]
    return [
        float(len(url)),
        float(len(host)),
        float(len(path)),
        float(len(labels)),
        float(len(segments)),
        float(max(map(len, segments), default=0)),
        float(max(map(len, labels), default=0)),
        digits / max(1, len(url)),
        sum(map(str.isdigit, host)) / max(1, len(host)),
        float(max(map(len, re.findall(r"[0-9]+", url)), default=0)),
        _entropy(url),
        _entropy(host),
        _entropy(path),
        float(len([p for p in query.split("&") if p])),
        float(len(query)),
        float("#" in url),
        float(url.startswith("https:")),
        float(url.count("-") + url.count("_")),
        float("." in (segments[-1] if segments else "")),
        float(path.endswith("/")),
    ]


def _with_features(batches):
    for batch in batches:
        url, host, path = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__url", "host", "path"))
        found = [lexical(u, h, p) for u, h, p in zip(url, host, path)]
        keep = [i for i, n in enumerate(batch.schema.names) if n != "__url"]
        arrays = [batch.column(i) for i in keep] + [pa.array(found, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=[batch.schema.names[i] for i in keep] + ["lexical"])


def featured(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, decided, lexical, suffix1, suffix2); a null url counts as empty."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("__url"), host.alias("host"), path.alias("path"))
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("decided", decided)
    fields = [f for f in rows.schema.fields if f.name != "__url"] + [T.StructField("lexical", T.ArrayType(T.DoubleType()))]
    rows = rows.mapInArrow(_with_features, T.StructType(fields))
    return rows.withColumn("suffix1", F.substring_index("host", ".", -1)).withColumn("suffix2", F.substring_index("host", ".", -2))


class Model:
    """Trees with the suffix statistics that they use, or one verdict where only one was seen."""

    def __init__(self, trees, suffixes: dict[str, DataFrame], overall: float):
        self.trees, self.suffixes, self.overall = trees, suffixes, overall

    def assemble(self, rows: DataFrame) -> DataFrame:
        for name, counts in self.suffixes.items():
            rows = rows.join(small(counts), name, "left")
        shares = [F.coalesce(f"{name}_share", F.lit(self.overall)) for name in self.suffixes]
        return rows.withColumn("features", array_to_vector(F.concat("lexical", F.array(*shares))))

    def verdicts(self, rows: DataFrame) -> DataFrame:
        """``rows`` with column ``judged``, the trees' verdict."""
        if self.trees is None:
            return rows.withColumn("judged", F.lit("block" if self.overall > 0.5 else "allow"))
        scored = self.trees.transform(self.assemble(rows))
        blocked = vector_to_array("probability")[1] > 0.5
        return scored.withColumn("judged", F.when(blocked, "block").otherwise("allow"))


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on about ``sample_rows`` featured rows that a rule decides; suffixes are counted on all such rows.

    With no labelled row every verdict is allow; with rows of one verdict only, that one.
    """
    known = rows.where("decided is not null and page_id is not null").withColumn("label", (F.col("decided") == "block").cast("double"))
    counts = stored(known.groupBy("suffix1", "suffix2").agg(F.sum("label").alias("blocked"), F.count("*").alias("n")), "suffixes")
    total, blocked = counts.agg(F.sum("n"), F.sum("blocked")).first()
    if not total:
        return Model(None, {}, 0.0)
    overall = blocked / total
    if overall in (0.0, 1.0):
        return Model(None, {}, overall)
    place = F.pmod(F.xxhash64(F.col("page_id"), F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    sample = stored(known.where(place < sample_rows / total), "labelled")
    if sample.agg(F.countDistinct("label")).first()[0] < 2:
        return Model(None, {}, overall)
    suffixes = {}
    for name in ("suffix1", "suffix2"):
        share = (F.sum("blocked") + PRIOR_WEIGHT * overall) / (F.sum("n") + PRIOR_WEIGHT)
        suffixes[name] = stored(counts.groupBy(name).agg(share.alias(f"{name}_share")), name)
    model = Model(None, suffixes, overall)
    boost = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=7)
    model.trees = boost.fit(model.assemble(sample).select("features", "label").coalesce(2))
    return model


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; the rule's verdict, or else the trees'.

    Null urls and urls without ``://`` have an empty host and path, which no rule fits.  Repeated rows are judged
    each; other columns are not read.  ``rules`` is a short list: each is a condition of the plan.
    """
    rows = featured(pages, rules)
    judged = train(rows).verdicts(rows)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("decided", "judged").alias("verdict"))
