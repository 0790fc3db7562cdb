"""Language of a text: family first, then one language of that family.

A text becomes a vector of hashed byte n-grams (1 to 4) of the whole text,
without digits and punctuation, as square roots of counts at unit length.
Linear support vector machines (squared hinge, dual coordinate descent) are
fitted in numpy: one a family against the rest, and one for each pair of
languages in a family, which vote by margin.

The learner takes at most ``PER_LANG`` documents a language, those with the
smallest hash of identifier and text; everything else is over all rows.

Defined results: a null text, or one without a letter, is ``und`` with score 0,
as is every text if there was nothing to learn from.  Rows are independent;
repeated rows repeat and columns not named in ``keep`` are dropped.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.scratch import trimmed

UNKNOWN = "und"
PER_LANG = 600
DIMS = 1 << 13
#: Families of languages; one that is not named is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_TABLE = np.arange(256, dtype=np.uint32)
_TABLE[:128] = 32
for _c in range(26):
    _TABLE[97 + _c] = _TABLE[65 + _c] = 97 + _c
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def features(text: str) -> np.ndarray:
    b = _TABLE[np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)]
    counts = np.zeros(DIMS)
    code = np.zeros(len(b), dtype=np.uint32)
    for n in range(1, 5):
        if len(b) < n:
            break
        code = (code[: len(b) - n + 1] << np.uint32(8)) | b[n - 1 :]
        counts += np.bincount((code * _MIX[n - 1]) >> np.uint32(32 - 13), minlength=DIMS)
    out = np.sqrt(counts)
    size = np.sqrt(counts.sum())
    return (out / size if size else out).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 8.0, rounds: int = 15) -> np.ndarray:
    """Weights, the bias last, of a linear machine for labels of -1 and 1."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    rng, alpha, w = np.random.default_rng(7), np.zeros(len(x)), np.zeros(x.shape[1])
    square = (x.astype(float) ** 2).sum(axis=1) + 1 / (2 * c)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            step = (y[i] * (x[i] @ w) - 1 + alpha[i] / (2 * c)) / square[i]
            new = max(0.0, alpha[i] - step)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    langs: dict[str, list[str]] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMS + 1), dtype=np.float32))
    #: Row of ``weights`` of each family and of each pair of languages.
    rows: dict[tuple, int] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.families:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        near = lambda m: 1 / (1 + np.exp(-np.clip(3 * m, -50, 50)))
        by_family = near(margins[:, [self.rows[f,] for f in self.families]]) if len(self.families) > 1 else np.ones((len(x), 1))
        by_family /= by_family.sum(axis=1, keepdims=True)
        first = by_family.argmax(axis=1)
        names, scores = [""] * len(x), by_family[np.arange(len(x)), first]
        for k, family in enumerate(self.families):
            own, langs = np.flatnonzero(first == k), self.langs[family]
            votes = np.zeros((len(own), len(langs)))
            for (i, a), (j, b) in itertools.combinations(enumerate(langs), 2):
                p = near(margins[own, self.rows[family, a, b]])
                votes[:, i] += p
                votes[:, j] += 1 - p
            best = votes.argmax(axis=1)
            for at, to in zip(own, best, strict=True):
                names[at] = langs[to]
            if len(langs) > 1:
                scores[own] *= votes[np.arange(len(own)), best] / (len(langs) - 1)
        return names, scores


def fit(texts: Sequence[str], langs: Sequence[str]) -> Model:
    model = Model()
    if not len(texts):
        return model
    x, langs = np.stack([features(t) for t in texts]), np.array(langs)
    family = np.array([_FAMILY.get(v, f"alone:{v}") for v in langs])
    model.families = sorted(set(family.tolist()))
    weights = []
    if len(model.families) > 1:
        for f in model.families:
            model.rows[f,] = len(weights)
            weights.append(fit_svm(x, np.where(family == f, 1.0, -1.0)))
    for f in model.families:
        model.langs[f] = sorted(set(langs[family == f].tolist()))
        for a, b in itertools.combinations(model.langs[f], 2):
            pair = (langs == a) | (langs == b)
            model.rows[f, a, b] = len(weights)
            weights.append(fit_svm(x[pair], np.where(langs[pair] == a, 1.0, -1.0)))
    model.weights = np.array(weights, dtype=np.float32).reshape(-1, DIMS + 1)
    return model


def learnable(id_col: str = "doc_id") -> Column:
    """Whether a row may be learnt from, by its identifier."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def train(docs: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Model:
    """Model fitted on at most ``per_lang`` documents of each language."""
    rows = docs.where(usable if usable is not None else F.lit(True)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("lang is not null and text is not null and text <> ''")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return fit([], [])
    # A share of each language that is near three times the sample keeps the ranking small at any size.
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 3 * per_lang / n))])
    near = rows.withColumn("h", F.xxhash64("id", "text")).where(F.pmod("h", F.lit(1 << 40)) < F.element_at(share, F.col("lang")) * (1 << 40))
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "id", "text")
    sample = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang).orderBy("lang", "n").select("text", "lang").collect()
    sample = [r for r in sample if has_letter(r["text"])]
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(text_col).alias("__text"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column(0).to_pylist()
                known = [i for i, t in enumerate(texts) if has_letter(t)]
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if known:
                    found, scores[known] = shared.value.predict(np.stack([features(texts[i]) for i in known]))
                    for i, name in zip(known, found, strict=True):
                        names[i] = name
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names), pa.array(scores)], [*batch.schema.names[1:], "lang_pred", "score"])

    return rows.mapInArrow(trimmed(run), f"{kinds}, lang_pred string, score double")
