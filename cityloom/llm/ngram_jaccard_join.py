"""N-gram Jaccard join: documents whose word-shingle sets overlap by a threshold.

Partitioning.  Sets are dealt into size classes so wide that a partner at the threshold
is in the same class or the next.  Two linked sets of a class differ in at most ``k``
shingles, so if the shingles are dealt into P > k parts, at least P - k parts of the two
are equal.  The parts of a set are its keys, each with an inverted list of the documents
that have it, and a link needs P - k common keys: no link is lost, whatever the hashes.

Long lists.  As in DivideSkip, a set leaves out its longest lists, one fewer than it shares
with any linked set.  All sets order lists alike, so of the keys that a linked pair shares
the one with the shortest list remains in both.  Sets that share only a few keys, by chance
or by a passage, are not brought together.  Lists that remain link their members to the
least one, and so cut the corpus into candidate clusters.

Search.  First each member is searched against the least member of its lists, so a large
group of near copies is linked in linear time.  Where a cluster is not one component yet,
its members outside the largest component search the whole cluster, in bounded blocks.
Each search is a T-occurrence search on the full sets: the short inverted lists of a set
are merged, long ones are probed by binary search, and documents that reach the required
overlap are links.  A block gives back a spanning set of its links, never all pairs.

Defined results: a null or word-less text has an empty set and is its own component;
repeated rows and equal texts share a component; a null ``doc_id`` is never the least id
of a component that has another; rows that repeat a key with different texts are joined
each for itself; an empty table gives no rows; columns other than the two named are not
read.  Shingles, sets and keys are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text
from ._bloom import only_keys, without_keys
from ._common import cut, pieces, release, strings, table
from ._graph import components

#: Members of a list that is long: longer ones are ordered by their hashes alone.
LONG = 64
#: Bounds of a block of a search: documents, and shingles in all.
BLOCK_DOCS, BLOCK_SHINGLES = 4096, 4_000_000


def _sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    return _text.distinct_sorted(*_text.shingles(_text.words(strings(column)), size))


def _digest(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set; 0 is never used for a set with members."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    if len(h):
        full = n > 0
        out[full] = np.add.reduceat(_text.mix(h + np.uint64(0x5851F42D4C957F2D)), first[:-1][full])
    return _text.mix(out + n.astype(np.uint64)) | np.uint64(1)


@cache
def size_classes(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each size class its least size, the most shingles ``k`` in which a set of it and
    a linked set that is no smaller differ, and the parts that its sets are dealt into."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(100 * low[-1] // percent + 1)
    low = np.array(low, np.int64)
    k = (low[1:] - 1) * (100 - percent) // percent
    spare = np.ones(len(k), np.int64)
    for _ in range(8):
        # Empty parts are no keys, so there are as many spare parts as are likely to be empty.
        parts = k + 1 + spare
        empty = parts * np.exp(-low[:-1] / parts)
        spare = np.where(k < 16, 1, np.ceil(empty + 5 * np.sqrt(empty) + 1).astype(np.int64))
    return low[:-1], k, k + 1 + spare


def keys(h: np.ndarray, first: np.ndarray, cls: np.ndarray, k: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and key of the parts of each set, dealt as size class ``cls`` says, with
    ``k`` and ``parts`` of that class, and how many keys each document can do without.
    Documents with k = 0 have none: they link with equal sets only.  ``h`` ascends in each
    document, and so do its parts."""
    n = np.where(k > 0, np.diff(first), 0)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    own = h[at]
    part = ((own >> np.uint64(32)) * parts[doc].astype(np.uint64)) >> np.uint64(32)
    new = np.ones(len(own), bool)
    new[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    value = np.add.reduceat(_text.mix(own ^ np.uint64(0x2545F4914F6CDD1D)), begin) if len(begin) else np.zeros(0, np.uint64)
    who, part = doc[begin], part[begin]
    filled = np.bincount(who, minlength=len(n))
    # So many parts are empty that all equal parts of a linked pair may be: those count as well.
    extra = [(np.full(int(parts[d]), d), np.setdiff1d(np.arange(parts[d]), part[who == d])) for d in np.flatnonzero((k > 0) & (parts - filled >= parts - k))]
    if extra:
        lost = np.concatenate([np.full(len(p), d[0]) for d, p in extra])
        who, part, value = np.concatenate([who, lost]), np.concatenate([part, *(p.astype(np.uint64) for _, p in extra)]), np.concatenate([value, np.zeros(len(lost), np.uint64)])
        order = np.argsort(who, kind="stable")
        who, part, value = who[order], part[order], value[order]
    return who, np.maximum(0, filled - k - 1), _text.mix(_text.mix(value + part * np.uint64(0x9E3779B97F4A7C15)) + cls[who].astype(np.uint64))


def _profiles(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """doc_id, set size, digest, and (once for each digest and piece) the keys: those of the
    own size class, then those of the class before it, with the most that may be left out of each."""
    low, most, all_parts = size_classes(percent)
    for batch in pieces(batches, "text"):
        h, first = _sets(batch.column("text"), size)
        n = np.diff(first)
        digest = _digest(h, first)
        _, once = np.unique(digest, return_index=True)
        new = np.zeros(len(n), bool)
        new[once] = True
        own = np.searchsorted(low, n, side="right") - 1
        columns = []
        for cls in (own, own - 1):
            ok = new & (n > 0) & (cls >= 0)
            cls = np.maximum(cls, 0)
            k = np.where(ok, most[cls], 0)
            who, skip, key = keys(h, first, cls, k, all_parts[cls])
            off = np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(n))))).astype(np.int32)
            columns += [pa.ListArray.from_arrays(pa.array(off), pa.array(key.view(np.int64))), pa.array(skip)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(digest.view(np.int64), mask=n == 0), *columns], ["doc_id", "n", "cls", "own", "own_skip", "below", "below_skip"])


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def t_occurrence(query: np.ndarray, lists: np.ndarray, at: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of at least ``need`` of the inverted lists ``query``: their numbers and counts.

    ``lists[at[i]:at[i + 1]]`` is list i in ascending order.  DivideSkip: of the lists by
    length, the longest L are left out of the merge, candidates need ``need - L`` of
    the others, and are then looked up in each long list by binary search."""
    size = at[query + 1] - at[query]
    longest = int(size.max(initial=0))
    skip = min(need - 1, int(need / (np.log2(longest + 1) + 1)), len(query)) if longest > 16 else 0
    order = np.argsort(size, kind="stable")
    short, long = query[order[: len(query) - skip]], query[order[len(query) - skip :]]
    size = at[short + 1] - at[short]
    total = int(size.sum())
    take = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[short], size)
    # The lists are ascending runs, which a stable sort merges as they are.
    merged = np.sort(lists[take], kind="stable")
    new = np.ones(len(merged), bool)
    new[1:] = merged[1:] != merged[:-1]
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(merged)))
    enough = count >= max(1, need - skip)
    found, count = merged[begin[enough]], count[enough]
    for k, i in enumerate(long):
        if not len(found):
            break
        one = lists[at[i] : at[i + 1]]
        p = np.minimum(np.searchsorted(one, found), len(one) - 1)
        count = count + (one[p] == found)
        alive = count >= need - (len(long) - k - 1)
        found, count = found[alive], count[alive]
    return found, count


def _block_links(got: pa.Table, size: int, percent: int) -> pa.Table:
    """Links of the sets that search (``asks``) with those that are indexed, as a spanning
    set of (member, least linked member)."""
    h, first = _sets(got.column("text"), size)
    asks = np.asarray(got.column("asks").combine_chunks().to_numpy(zero_copy_only=False), bool)
    cls, number = np.unique(_digest(h, first), return_inverse=True)
    once = np.zeros(len(cls), np.int64)
    once[number] = np.arange(len(number))
    n = np.diff(first)[once]
    searched, indexed = np.zeros(len(cls), bool), np.zeros(len(cls), bool)
    searched[number[asks]] = True
    indexed[number[~asks]] = True
    pick = np.concatenate([np.arange(first[i], first[i + 1]) for i in once]) if len(once) else np.zeros(0, np.int64)
    shingle, ids = np.unique(h[pick], return_inverse=True)
    owner = np.repeat(np.arange(len(n)), n)
    stops = np.concatenate(([0], np.cumsum(n)))
    by = np.lexsort((owner, ids))
    by = by[indexed[owner[by]]]
    lists, at = owner[by], np.searchsorted(ids[by], np.arange(len(shingle) + 1))
    parent = list(range(len(n)))
    for x in np.flatnonzero(searched & (n > 0)):
        found, count = t_occurrence(ids[stops[x] : stops[x + 1]], lists, at, int(-(-percent * n[x] // 100)))
        for y in found[100 * count >= percent * (n[x] + n[found] - count)]:
            a, b = _find(parent, int(x)), _find(parent, int(y))
            if a != b:
                parent[max(a, b)] = min(a, b)
    root = np.array([_find(parent, x) for x in range(len(n))], np.int64)
    linked = np.flatnonzero(root != np.arange(len(n)))
    return pa.table({"a": pa.array(cls[linked].view(np.int64)), "b": pa.array(cls[root[linked]].view(np.int64))})


def _with_digest(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        yield pa.RecordBatch.from_arrays([pa.array(_digest(*_sets(batch.column("text"), size)).view(np.int64)), batch.column("text")], ["cls", "text"])


def _search(docs: DataFrame, roles: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between the members of each group.  ``roles``: group, block of the searching
    sets (qb) and of the indexed ones (ib), asks, cls, and the doc_id of a text with that set."""
    roles = cut(roles)
    named = roles.where("doc_id is not null").withColumnRenamed("doc_id", "id").drop("cls")
    near = only_keys(docs, "doc_id", named.select(F.col("id").alias("key")).distinct())
    routed = near.join(named, F.col("doc_id") == F.col("id")).select("group", "qb", "ib", "asks", "text")
    nameless = roles.where("doc_id is null").drop("doc_id")
    if not nameless.isEmpty():  # texts that only rows with a null key have
        own = docs.where("doc_id is null").select("text").mapInArrow(partial(_with_digest, size=size), "cls long, text string")
        own = own.join(nameless.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"])
        routed = routed.unionByName(own.join(nameless, "cls").select("group", "qb", "ib", "asks", "text"))
    return cut(routed.groupBy("group", "qb", "ib").applyInArrow(lambda got: _block_links(got, size, percent), "a long, b long"))


def _blocks() -> Column:
    return F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")


def _block_of(many: str) -> Column:
    return F.pmod(F.xxhash64("cls"), F.col(many)).cast("int")


def _every(many: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(many) - 1))


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """One row for each row of ``docs``: its key, ``n_shingles`` and ``component_id``.

    Two documents link when 100 * intersection >= percent * union of their sets of
    distinct ``size``-word shingles."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    release(docs.sparkSession)  # many small queries follow, whose plans the driver holds until it collects garbage
    made = cut(docs.mapInArrow(partial(_profiles, size=size, percent=percent), f"doc_id {kind}, n long, cls long, own array<long>, own_skip long, below array<long>, below_skip long"))
    classes = made.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))

    one = lambda side, skip: F.transform(side, lambda h: F.struct(h.alias("h"), F.lit(side).alias("side"), F.col(skip).alias("skip")))
    rows = made.where("size(own) > 0 OR size(below) > 0").select("cls", F.explode(F.concat(one("own", "own_skip"), one("below", "below_skip"))).alias("k")).select("cls", "k.*")
    slim = made.select("cls", F.explode(F.concat("own", "below")).alias("h"))
    lists = cut(slim.groupBy("h").agg(F.min("cls").alias("least"), F.max("cls").alias("most"), F.count("*").alias("many")).where("least < most").select("h", "least", F.least("many", F.lit(LONG)).alias("long")))
    mine = only_keys(rows, "h", lists.select(F.col("h").alias("key"))).join(lists, "h").groupBy("cls", "side").agg(F.sort_array(F.collect_set(F.struct("long", "h", "least")), asc=False).alias("lists"), F.max("skip").alias("skip"))
    kept = mine.where("size(lists) > skip").select("cls", F.explode(F.expr("slice(lists, cast(skip as int) + 1, size(lists))")).alias("k")).select("cls", "k.least").where("cls <> least")
    edges = cut(kept.distinct())
    release(docs.sparkSession)

    cluster = components(edges.select(F.col("cls").alias("a"), F.col("least").alias("b"))).withColumnsRenamed({"node": "cls", "component": "cluster"})
    member = cut(cluster.join(classes, "cls"))
    hub = edges.groupBy("cls").agg(F.min("least").alias("group"))
    asking = member.join(hub, "cls").select("group", "cls", "doc_id", "n")
    # Tables of groups are materialised, so that joins with a very large group can be split.
    many = cut(asking.groupBy("group").agg(_blocks().alias("blocks")))
    hubs = many.join(member.withColumnRenamed("cls", "group"), "group").select("group", _every("blocks").alias("qb"), F.lit(0).alias("ib"), F.lit(False).alias("asks"), F.col("group").alias("cls"), "doc_id")
    asking = asking.join(many, "group").select("group", _block_of("blocks").alias("qb"), F.lit(0).alias("ib"), F.lit(True).alias("asks"), "cls", "doc_id")
    links = _search(docs, hubs.unionByName(asking), size, percent)

    release(docs.sparkSession)
    part = components(links).withColumnsRenamed({"node": "cls"})
    member = cut(member.join(part, "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    per = member.groupBy("cluster", "component").agg(F.count("*").alias("many"))
    open_ = cut(per.groupBy("cluster").agg(F.max_by("component", F.struct("many", "component")).alias("largest"), F.count("*").alias("parts")).where("parts > 1").drop("parts"))
    member = member.join(open_, "cluster")
    outside = member.where("component <> largest")
    size_of = cut(member.groupBy("cluster").agg(_blocks().alias("ibs")).join(outside.groupBy("cluster").agg(_blocks().alias("qbs")), "cluster"))
    indexed = member.join(size_of, "cluster").select(F.col("cluster").alias("group"), _every("qbs").alias("qb"), _block_of("ibs").alias("ib"), F.lit(False).alias("asks"), "cls", "doc_id")
    asking = outside.join(size_of, "cluster").select(F.col("cluster").alias("group"), _block_of("qbs").alias("qb"), _every("ibs").alias("ib"), F.lit(True).alias("asks"), "cls", "doc_id")
    links = links.unionAll(_search(docs, indexed.unionByName(asking), size, percent))

    release(docs.sparkSession)
    root = components(links).withColumnsRenamed({"node": "cls"})
    linked = cut(classes.select("cls", "doc_id").join(root, "cls", "left").select("cls", F.coalesce("component", "cls").alias("component"), "doc_id"))
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = linked.join(least, "component").select("cls", "component_id")
    out = made.select("doc_id", "n", "cls").join(of_class, "cls", "left")
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller key.  Of repeated
    rows with one key all stay; rows with a null key stay unless linked to another; columns
    of ``docs`` may have any names."""
    comps = link(docs, key, text, size, percent).groupBy(F.col(key).alias("key")).agg(F.min("component_id").alias("least"))
    return without_keys(docs, key, cut(comps.where(~F.col("key").eqNullSafe(F.col("least"))).select("key")))
