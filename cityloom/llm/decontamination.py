"""Benchmark decontamination: test items found inside documents of any length.

Size-partitioned MinHash containment search.  Items are partitioned by the number
of their distinct shingles into classes (U/2, U]; for each class a document is read
as a run of blocks of U shingles, so a block and an item have like sizes and the
Jaccard similarity that a contained item implies stays high (0.15 at least), however
long the document is.  One-permutation MinHash signatures of ``BINS`` bins that agree
in any bin make a candidate (all of 128 bins part with a probability of 0.85 ** 128, or
1e-9), and a candidate is verified by exact shingle containment over the whole document.

Items are handled in blocks of bounded size, each broadcast in turn, so the number
of items is not bounded; each block beyond the first reads the documents once more.
Words have A-Z lower-cased.

Defined results: null or empty texts and texts or items under ``size`` words match
nothing; a document that holds several items, or one that several item rows repeat, is
reported for each; containment of exactly ``percent`` is a match; repeated rows are each
reported; null keys are kept; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._common import cut, pieces, strings, table

#: Shingles of items that one pass holds on each executor (8 bytes each, and as much again).
PASS_SHINGLES = 2_000_000
#: Bins of a signature, a power of two.
BINS = 128
_LOW = np.uint64(20)
_BIN_SHIFT = np.uint64(44 - int(np.log2(BINS)))
#: Shingles of candidate items that are verified at once.
_AT_ONCE = 2_000_000


def signatures(h: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-permutation MinHash: for each block and bin the least hash.  Hashes are
    read as 44 bits, of which the top ones are the bin.  Returns blocks and values."""
    packed = np.sort((block.astype(np.uint64) << np.uint64(44)) | (h >> _LOW))
    bins = packed >> _BIN_SHIFT
    first = np.ones(len(packed), bool)
    first[1:] = bins[1:] != bins[:-1]
    packed = packed[first]
    return (packed >> np.uint64(44)).astype(np.int64), packed & np.uint64((1 << 44) - 1)


@dataclass
class Index:
    """Items of one pass: shingles, and for each class the signature values with their items."""

    first: np.ndarray
    shingle: np.ndarray
    classes: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def build(h: np.ndarray, first: np.ndarray) -> Index:
        n = np.diff(first)
        upper = 2 ** np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
        classes = []
        for u in np.unique(upper[n > 0]):
            items = np.flatnonzero((upper == u) & (n > 0))
            pick = np.concatenate([np.arange(first[i], first[i + 1]) for i in items])
            who, value = signatures(h[pick], np.repeat(np.arange(len(items)), n[items]))
            order = np.argsort(value, kind="stable")
            value = value[order]
            bits = np.zeros(1 << 20, bool)
            bits[(value & np.uint64(0xFFFFF)).astype(np.int64)] = True
            classes.append((int(u), value, items[who[order]], bits))
        return Index(first, h, classes)


def _items(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        h, first = _text.distinct_sorted(*_text.shingles(_text.words(strings(batch.column("text"))), size, short_whole=False))
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))], ["item_id", "h"])


def _held(own: np.ndarray, ix: Index, d: np.ndarray, i: np.ndarray) -> np.ndarray:
    """How many shingles of item i[k] document d[k] holds; ``own`` has the sorted hashes of
    all pairs of a document and a shingle."""
    n = ix.first[i + 1] - ix.first[i]
    out = np.zeros(len(i), np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // _AT_ONCE)) + 1
    for part in np.split(np.arange(len(i)), cuts):
        m = n[part]
        at = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(ix.first[i[part]], m)
        want = _of_document(ix.shingle[at], np.repeat(d[part], m))
        hit = own[np.minimum(np.searchsorted(own, want), len(own) - 1)] == want
        out[part] = np.bincount(np.repeat(np.arange(len(part)), m), weights=hit, minlength=len(part))
    return out


def _of_document(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return _text.mix(h + _text.mix(doc.astype(np.uint64) + np.uint64(1)))


def matches(column: pa.Array, size: int, percent: int, ix: Index) -> tuple[np.ndarray, ...]:
    """Document and item numbers of the matches, shingles of the item, and how many are found."""
    h, first = _text.shingles(_text.words(strings(column)), size, short_whole=False)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(h)) - first[:-1][doc]
    found = [np.zeros((0, 2), np.int64)]
    for upper, value, item, bits in ix.classes:
        blocks = -(-n // upper)
        base = np.cumsum(blocks) - blocks
        of_block = np.repeat(np.arange(len(n)), blocks)
        block, sig = signatures(h, base[doc] + pos // upper)
        maybe = bits[(sig & np.uint64(0xFFFFF)).astype(np.int64)]
        block, sig = block[maybe], sig[maybe]
        lo, hi = np.searchsorted(value, sig, "left"), np.searchsorted(value, sig, "right")
        many = hi - lo
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        found.append(np.unique(np.stack([of_block[np.repeat(block, many)], item[at]], axis=1), axis=0))
    d, i = np.unique(np.concatenate(found), axis=0).T
    if not len(d):
        return d, i, d, d
    some = np.isin(doc, d)
    shared = _held(np.sort(_of_document(h[some], doc[some])), ix, d, i)
    want = ix.first[i + 1] - ix.first[i]
    ok = 100 * shared >= percent * want
    return d[ok], i[ok], want[ok], shared[ok]


def _search(batches: Iterator[pa.RecordBatch], size: int, percent: int, index) -> Iterator[pa.RecordBatch]:
    ids, ix = index.value
    for batch in pieces(batches, "text"):
        d, i, q, s = matches(batch.column("text"), size, percent, ix)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), ids.take(pa.array(i)), pa.array(q), pa.array(s), pa.array(s / np.maximum(q, 1))], ["doc_id", "item_id", "item_shingles", "found_shingles", "containment"])


def _indexes(items: DataFrame, item_key: str, item_text: str, size: int) -> Iterator:
    """A broadcast of item keys and their index for each block of items."""
    items = items.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    # A shingle takes 2 bytes a word at least, so lengths bound the number of shingles.
    bound = items.agg(F.sum(F.length("text") / 2)).first()[0] or 0
    passes = max(1, int(-(-bound // PASS_SHINGLES)))
    made = items.mapInArrow(partial(_items, size=size), f"item_id {kind}, h array<long>")
    made = cut(made) if passes > 1 else made
    for p in range(passes):
        got = made.where(F.pmod(F.xxhash64("item_id", "h"), F.lit(passes)) == p).toArrow()
        lists = got.column("h").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        first = lists.offsets.to_numpy().astype(np.int64)
        first, h = first - (first[0] if len(first) else 0), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        ids = got.column("item_id").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        yield items.sparkSession.sparkContext.broadcast((ids, Index.build(h, first)))


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Pairs of a document and an item of whose distinct shingles it holds ``percent`` or more."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, item_shingles long, found_shingles long, containment double"
    return reduce(DataFrame.unionAll, [docs.mapInArrow(partial(_search, size=size, percent=percent, index=index), schema) for index in _indexes(items, item_key, item_text, size)])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "list_filter(string_split_regex(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(c="text")} AS w FROM documents),
i AS (SELECT row_number() OVER () AS k, item_id, {_WORDS.format(c="text")} AS w FROM benchmark),
ds AS (SELECT DISTINCT r, doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d)),
s AS (SELECT DISTINCT k, item_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT k, item_id, w, unnest(range(1, len(w) - 3)) AS p FROM i)),
q AS (SELECT k, count(*) AS n FROM s GROUP BY k),
f AS (SELECT r, k, any_value(doc_id) AS doc_id, any_value(item_id) AS item_id, count(*) AS c FROM ds JOIN s USING (g) GROUP BY r, k)
SELECT doc_id, item_id, n AS item_shingles, c AS found_shingles, c / n AS containment FROM f JOIN q USING (k) WHERE 100 * c >= 80 * n
"""


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that match no item, with all their columns.  Each row is judged by
    its own text, so keys may be null or repeated, and nothing is shuffled."""
    for index in _indexes(items, item_key, item_text, size):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in pieces(batches, text):
                keep = np.ones(len(batch), bool)
                keep[matches(batch.column(text), size, percent, index.value[1])[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
