"""Quality score of a text by a sparse ensemble of rules.

Every whole text gives a row of statistics.  Boosted trees over labelled rows
yield rules: each path from a root is a conjunction of bounds on statistics.
A lasso logistic regression weighs the rules and drops most.  What is left is
compiled into one Spark column expression over the statistics, so scoring
needs no model object.

The learner takes the labelled rows whose hash is under a bound that leaves
about ``SAMPLE`` of them, or all if there are fewer.

Defined results: a null text has the statistics of the empty text and is
scored; rows are independent, so repeated rows repeat; of several labels of an
identifier each counts as a row; with no usable label every score is 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import trees
from quire.llm.scratch import trimmed

SAMPLE = 20_000
THRESHOLD = 0.3
STATS = (
    "log_bytes", "upper", "lower", "digit", "space", "pipe", "bang", "symbol", "comma", "stop", "other_mark", "high", "top_byte",
    "entropy", "words_log", "word_len", "word_dev", "distinct", "top_word", "marked", "capital", "line_len", "line_same", "line_top", "line_ended",
)


def statistics(text: str | None) -> list[float]:
    """Values of ``STATS``; shares are of bytes, words or lines."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(1, len(raw))
    c = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    part = lambda s: sum(int(c[b]) for b in s) / n
    p = c[c > 0] / n
    words = raw.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x]
    k = max(1, len(lines))
    lined: dict[bytes, int] = {}
    for x in lines:
        lined[x] = lined.get(x, 0) + 1
    return [
        math.log1p(len(raw)), c[65:91].sum() / n, c[97:123].sum() / n, c[48:58].sum() / n, part(b" \t\n\r\v\f"), part(b"|"), part(b"!"), part(b"#$%&*"),
        part(b","), part(b"."), part(b"\"'()-/:;<=>?@[\\]^_`{}~+"), c[128:].sum() / n, float(c.max()) / n,
        float(-(p * np.log2(p)).sum()) if len(raw) else 0.0, math.log1p(len(words)), float(lengths.mean()), float(lengths.std()), len(counts) / m,
        max(counts.values(), default=0) / m, sum(v for w, v in counts.items() if not w[-1:].isalpha() and w[-1] < 128) / m,
        sum(v for w, v in counts.items() if w[:1].isupper()) / m,
        math.log1p(len(raw) / k), 1 - len(lined) / k, max(lined.values(), default=0) / k, sum(v for x, v in lined.items() if x[-1:] in b".!?") / k,
    ]


def with_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and a double column for each of ``STATS``."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(x.as_py()) for x in batch.column(1)], dtype=float).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(v)) for v in found.T)], ["id", *STATS])

    return rows.mapInArrow(trimmed(run), f"id {kind}, " + ", ".join(f"{s} double" for s in STATS)).withColumnRenamed("id", id_col)


@dataclass
class RuleModel:
    bias: float = 0.0
    #: (weight, conditions), each condition (statistic, "<=" or ">", bound).
    rules: list[tuple[float, tuple[tuple[str, str, float], ...]]] = field(default_factory=list)

    def score(self) -> Column:
        """Probability of label 1 as a column expression over the statistics."""
        margin = F.lit(float(self.bias))
        for weight, conditions in self.rules:
            holds = None
            for stat, sign, bound in conditions:
                one = F.col(stat) <= bound if sign == "<=" else F.col(stat) > bound
                holds = one if holds is None else holds & one
            margin = margin + F.when(holds, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-margin))


def _holds(x: np.ndarray, path: tuple) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, sign, cut in path:
        out &= x[:, f] <= cut if sign == "<=" else x[:, f] > cut
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, n_trees: int = 30, depth: int = 3, strength: float = 2e-3, steps: int = 400) -> RuleModel:
    """Rules from boosted trees, weighted by logistic regression with an L1 penalty (FISTA)."""
    if not len(y) or y.min() == y.max():
        return RuleModel(0.0 if not len(y) else (4.0 if y[0] else -4.0))
    forest = trees.fit(x, y, n_trees=n_trees, depth=depth, share=0.7)
    paths, columns, seen = [], [], set()
    for path in (p for t in forest.trees for p in t.paths()):
        held = _holds(x, path)
        key = held.tobytes()
        if 0 < held.sum() < len(y) and key not in seen:
            seen.add(key)
            paths.append(path)
            columns.append(held)
    a = np.array(columns, dtype=float).T
    spread = a.std(axis=0)
    a = a / spread
    n, k = a.shape
    step = 4 * n / (np.linalg.norm(np.hstack([a, np.ones((n, 1))]), 2) ** 2)
    w = z = np.zeros(k + 1)
    t = 1.0
    ones = np.hstack([a, np.ones((n, 1))])
    for _ in range(steps):
        grad = ones.T @ (1 / (1 + np.exp(-(ones @ z))) - y) / n
        new = z - step * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * strength, 0)
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_next * (new - w)
        w, t = new, t_next
    kept = np.flatnonzero(w[:-1])
    rules = [(float(w[i] / spread[i]), tuple((STATS[f], sign, cut) for f, sign, cut in paths[i])) for i in kept]
    return RuleModel(float(w[-1]), rules)


def train(stats: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> RuleModel:
    """Rules learnt from about ``sample`` rows of ``stats`` that are ``usable`` and have a label of 0 or 1."""
    marked = labels.select(F.col(id_col), F.col(label_col).alias("__label")).where("__label in (0, 1)")
    known = stats.where(usable).join(marked, id_col)
    # A share that is near the sample's size keeps what is sent and ranked small at any size.
    share = min(1.0, sample / max(1, known.count()))
    near = known.where(F.pmod(F.xxhash64(id_col, *STATS), F.lit(1 << 40)) < share * (1 << 40))
    rows = near.select("__label", *STATS).collect()
    data = np.array(sorted(tuple(r) for r in rows), dtype=float).reshape(-1, len(STATS) + 1)
    return fit_rules(data[:, 1:], data[:, 0])


def learnable(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row may be learnt from, by its identifier; a row without one is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != 0, F.lit(False))
