"""Language ID by a string kernel, Nystroem landmarks and one-versus-rest kernel ridge regression.

The kernel of two texts is the cosine of their sets of character n-grams, a blended
spectrum of n = 1, 2, 3 over the code points of lower-cased letters (and marks that go
with them), all else being one space.  A bounded sample of labelled rows (``SAMPLE`` a
language and ``MOST`` in all, in expectation, by a hash of the row) is projected on
``LANDMARKS`` of its texts and a ridge regression for each language is solved in closed
form.  Scoring is two matrix products for each batch: presence of the landmarks' n-grams
by landmarks, landmarks by languages.  N-grams are told apart by 64-bit hashes; those
that no landmark has count in the size of a text's set only, as the kernel wants it.

Defined results: a null text or one without a letter is ``und`` with score 0; rows
with a null key or language are never learned from; without labelled rows all is
``und``; ties go to the first language by code point; texts are read whole, long ones
too; repeated rows and equal texts are judged alike; other columns are not read.
"""

from __future__ import annotations

import unicodedata
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold_is, pieces, strings, table
from ._text import mix

#: Labelled rows learned from, for each language and in all, in expectation: the bounds of the fit.
SAMPLE, MOST = 500, 8000
LANDMARKS, RIDGE = 192, 1e-2
#: Bytes of text and rows that are judged at once.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 1024


@cache
def _kinds() -> np.ndarray:
    """For the basic plane: 0 none, 1 a mark, 2 a letter."""
    return np.array([_kind(c) for c in range(1 << 16)], np.uint8)


def _kind(c: int) -> int:
    return 2 if chr(c).isalpha() else int(unicodedata.category(chr(c))[0] == "M")


def spectrum(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of each n-gram, repeats included, and whether each text has a letter."""
    joined = "\0".join("" if t is None else t.replace("\0", " ") for t in texts).lower() + "\0"
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    end = code == 0
    doc = np.cumsum(end) - end
    kind = _kinds()[np.minimum(code, 0xFFFF)]
    far = code > 0xFFFF
    if far.any():
        some, at = np.unique(code[far], return_inverse=True)
        kind[far] = np.array([_kind(c) for c in some.tolist()], np.uint8)[at]
    has = np.bincount(doc[kind == 2], minlength=len(texts))[: len(texts)] > 0
    inside = kind > 0
    keep = inside | end
    keep[1:] |= inside[:-1]
    c = np.where(inside, code, 0)[keep].astype(np.uint64)
    doc = doc[keep]
    two, three = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    shift, longer = np.uint64(21), np.uint64(22)
    grams = [c, (c[:-1] << shift | c[1:])[two] + (np.uint64(1) << np.uint64(62)), mix((c[:-2] << longer | c[1:-1])[three]) + c[2:][three]]
    return np.concatenate([doc, doc[1:][two], doc[2:][three]]), np.concatenate([mix(g + np.uint64(i)) for i, g in enumerate(grams)]), has


def distinct(doc: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    return doc[new], gram[new]


class Vocabulary:
    """Numbers of n-grams by open tables: what a table has no room for goes to the next."""

    def __init__(self, grams: np.ndarray) -> None:
        self.grams = grams
        self.bits = max(8, int(np.ceil(np.log2(len(grams) + 1))) + 3)
        self.tables, left = [], np.arange(len(grams))
        while len(left):
            slot = self._slot(grams[left], len(self.tables))
            table_ = np.full(1 << self.bits, -1, np.int32)
            table_[slot[::-1]] = left[::-1]
            self.tables.append(table_)
            left = left[table_[slot] != left]

    def _slot(self, gram: np.ndarray, level: int) -> np.ndarray:
        return ((gram * np.uint64(2 * level + 1) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def number(self, gram: np.ndarray) -> np.ndarray:
        """The number of each n-gram, or -1."""
        out = np.full(len(gram), -1, np.int32)
        left = np.arange(len(gram))
        for level, table_ in enumerate(self.tables):
            got = table_[self._slot(gram[left], level)]
            hit = (got >= 0) & (self.grams[got] == gram[left])
            out[left[hit]] = got[hit]
            left = left[~hit]
        return out

    def presence(self, doc: np.ndarray, gram: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Which known n-grams each text has, and the size of its whole set."""
        at = self.number(gram)
        out = np.zeros((rows, len(self.grams)), np.float32)
        known = at >= 0
        out[doc[known], at[known]] = 1
        other, _ = distinct(doc[~known], gram[~known])
        return out, out.sum(axis=1) + np.bincount(other, minlength=rows)


@dataclass
class Model:
    languages: list[str]
    vocabulary: Vocabulary
    landmarks: np.ndarray  #: n-grams x landmarks, presence over the root of the set's size
    weights: np.ndarray  #: landmarks (and a last row, the bias) x languages

    def decide(self, doc: np.ndarray, gram: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        x, size = self.vocabulary.presence(doc, gram, rows)
        f = ((x @ self.landmarks) / np.sqrt(np.maximum(1, size))[:, None]) @ self.weights[:-1] + self.weights[-1]
        return f.argmax(axis=1), np.clip((f.max(axis=1) + 1) / 2, 0, 1)


def train(sets: list[np.ndarray], language: np.ndarray) -> Model:
    """Closed-form fit to sets of n-grams; they are to come in an order that says nothing about them."""
    languages = sorted(set(language.tolist()))
    # Landmarks are dealt out over the languages in turn.
    turn = np.zeros(len(language), np.int64)
    for name in languages:
        own = language == name
        turn[own] = np.arange(own.sum())
    marks = np.argsort(turn, kind="stable")[:LANDMARKS]
    vocabulary = Vocabulary(np.unique(np.concatenate([sets[i] for i in marks])))
    m = np.zeros((len(marks), len(vocabulary.grams)), np.float32)
    for k, i in enumerate(marks):
        m[k, vocabulary.number(sets[i])] = 1 / np.sqrt(max(1, len(sets[i])))
    kernel = np.zeros((len(sets), len(marks)))
    for at in range(0, len(sets), 256):
        part = sets[at : at + 256]
        x, size = vocabulary.presence(np.repeat(np.arange(len(part)), [len(s) for s in part]), np.concatenate(part), len(part))
        kernel[at : at + 256] = (x @ m.T) / np.sqrt(np.maximum(1, size))[:, None]
    value, vector = np.linalg.eigh(kernel[marks])
    good = value > 1e-6
    root = vector[:, good] / np.sqrt(value[good])
    phi = np.concatenate([kernel @ root, np.ones((len(kernel), 1))], axis=1)
    y = np.where(language[:, None] == np.array(languages, dtype=object)[None, :], 1.0, -1.0)
    # Languages weigh alike, however many rows the sample has of each.
    w = np.array([1.0 / (language == name).sum() for name in languages])[np.array([languages.index(v) for v in language.tolist()])]
    w *= len(language) / w.sum()
    a = (phi * w[:, None]).T @ phi + RIDGE * np.eye(phi.shape[1])
    beta = np.linalg.solve(a, (phi * w[:, None]).T @ y)
    return Model(languages, vocabulary, m.T.copy(), np.concatenate([root @ beta[:-1], beta[-1:]]).astype(np.float32))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", BATCH_BYTES):
        for at in range(0, len(batch), BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model | None:
    """A model of the rows for which ``learn`` holds and text and language are known."""
    rows = docs.where(learn).select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null AND text is not null")
    many = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not many:
        return None
    sample = min(SAMPLE, MOST / len(many))
    rate = F.create_map(*(x for k, n in sorted(many.items()) for x in (F.lit(k), F.lit(min(1.0, sample / n)))))
    draw = F.xxhash64("doc_id", "text", F.lit("sample"))
    rows = rows.withColumn("draw", draw).where(F.pmod("draw", F.lit(1 << 30)) / float(1 << 30) < rate[F.col("lang")])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rows(batches):
            doc, gram, has = spectrum(batch.column("text").to_pylist())
            doc, gram = distinct(doc, gram)
            off = np.searchsorted(doc, np.arange(len(batch) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(gram.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("lang"), lists], ["draw", "lang", "grams"]).filter(pa.array(has))

    got = rows.select("draw", "lang", "text").mapInArrow(grams, "draw long, lang string, grams array<long>").dropDuplicates(["draw", "lang"]).toArrow()
    if not len(got):
        return None
    got = got.sort_by([("draw", "ascending"), ("lang", "ascending")])
    return train([x.values.to_numpy().view(np.uint64) for x in got.column("grams")], got.column("lang").to_numpy())


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for each row of ``docs``."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in _rows(batches):
            doc, gram, has = spectrum(strings(batch.column("text")).to_pylist())
            best, score = m.decide(doc, gram, len(batch))
            best, score = np.where(has, best, len(m.languages)), np.where(has, score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score.astype(np.float64))], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold_is(F.col("doc_id"), 0)
    model = fit(docs, ~held & F.col("doc_id").isNotNull())
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
