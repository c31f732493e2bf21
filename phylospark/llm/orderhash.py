"""Near-dedup with order MinHash.

A text's k-mers are its five-word shingles, each labelled with its occurrence. For each of `SKETCHES` hash functions
the `PICKED` smallest labelled k-mers are sampled and kept in text order; a sketch is the hash of that sequence, so it
is sensitive to order as edit distance is. Two texts of similarity s share a sketch with a chance of about
s ** PICKED each, so at s = 0.8 one of 12 is shared in 99.98 of 100 cases.

Texts that share a sketch are a bucket. Buckets are taken sketch by sketch, in the groups of PHASES. In each phase the
members of a bucket that are of one component by then count as one: of each component one member is verified against
the bucket's hub, a member of its most frequent component. Verifying is by banded alignment: of the labelled k-mers
that both have, at most `band` places apart, the longest chain that rises in both texts; similarity is its length over
the k-mers of both less that length, and a link needs 0.8 or more. Members of a hub are dealt to parts of PART, each
with the hub's text once. What phases link is contracted before the next one, so a group of copies soon is one row in
each of its buckets. Phases only find most links cheaply; what decides is the rest: in each bucket of three or more
whose members are not one component by then, all pairs of different components are compared, in blocks of about BLOCK
k-mers a side. First k-mers that both have are counted, and only pairs with enough of them are aligned. Members of
different components cost a comparison per pair, which is the job. Equal texts are one node throughout.

All texts at 0.8 or more that share a sketch are so in one class. Only a link between texts that share none is lost;
the tests hold the classes of a star, a drift, bridged communities and a template family against brute force over all
pairs.

Nulls: a null text is an empty one; documents without a word are alike only if their texts are equal. Texts under five
words have one k-mer, all they have. A null doc_id is a document too, but names no class. Repeated rows are copies.
Empty tables give empty results. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.llm import common as c
from phylospark.llm.components import components

WORDS, SKETCHES, PICKED, SIMILARITY = 5, 12, 3, 0.8
#: Places of the sketches that are taken together.
PHASES = ((0, 1, 2, 3), (4, 5, 6, 7, 8, 9, 10, 11))
PART, BLOCK = 256, 400_000
_RANDOM = np.random.default_rng(20240601).integers(0, 2**63, size=(2, SKETCHES), dtype=np.uint64)
_XOR, _MULTIPLY = _RANDOM[0], _RANDOM[1] | np.uint64(1)


def labelled(raw: bytes) -> np.ndarray:
    """Hashes of the k-mers with their occurrence numbers, in text order; all different."""
    words, _, _ = c.word_hashes(raw)
    if not len(words):
        return words
    h = c.window_hashes(words, min(WORDS, len(words)))
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    starts = np.flatnonzero(first)
    occurrence = np.empty(len(h), dtype=np.uint64)
    occurrence[order] = np.arange(len(h)) - starts[np.cumsum(first) - 1]
    with np.errstate(over="ignore"):
        return np.where(occurrence > 0, c.mixed(h + occurrence * np.uint64(0x9E3779B97F4A7C15)), h)


def sketches(kmers: np.ndarray) -> np.ndarray:
    """One sketch for each hash function, as signed integers."""
    n = len(kmers)
    picked = min(PICKED, n)
    at = np.empty((SKETCHES, picked), dtype=np.int64)
    step = max(1, 1_000_000 // n)
    with np.errstate(over="ignore"):
        for t in range(0, SKETCHES, step):
            order = (kmers[None, :] ^ _XOR[t : t + step, None]) * _MULTIPLY[t : t + step, None]
            order ^= order >> np.uint64(32)
            at[t : t + step] = np.argpartition(order, picked - 1, axis=1)[:, :picked]
        at.sort(axis=1)
        out = np.arange(SKETCHES, dtype=np.uint64)
        for column in kmers[at].T:
            out = c.mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """By banded alignment; below `least` the value is a bound, not exact."""
    total = len(a) + len(b)
    if not total:
        return 0.0
    need = least * total / (1 + least)
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(at_a) < need - 1e-9:
        return len(at_a) / (total - len(at_a))
    # an alignment this good leaves out no more than total - 2 * need k-mers, so it stays in this band
    near = np.abs(at_a - at_b) <= total - 2 * need + 1e-9
    at_b = at_b[near][np.argsort(at_a[near])]
    if len(at_b) < 2 or (np.diff(at_b) > 0).all():
        chain = len(at_b)
    else:
        tails: list[int] = []
        for x in at_b.tolist():
            i = bisect_left(tails, x)
            if i == len(tails):
                tails.append(x)
            else:
                tails[i] = x
        chain = len(tails)
    return chain / (total - chain)


def _sketch(batches):
    for batch in batches:
        nodes, found, sizes = [], [], []
        for node, raw in zip(batch.column("node"), batch.column("text").cast(pa.binary()), strict=True):
            kmers = labelled(raw.as_py())
            if len(kmers):
                nodes.append(node.as_py())
                found.append(sketches(kmers))
                sizes.append(len(kmers))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=["node", "s", "size"])


def _verify(batches):
    """Rows come sorted by hub and part, the hub's own text first."""
    of, held = None, None
    for batch in batches:
        a, b = [], []
        for hub, part, node, raw in zip(batch.column("hub"), batch.column("part"), batch.column("node"), batch.column("text").cast(pa.binary()), strict=True):
            hub, part, node = hub.as_py(), part.as_py(), node.as_py()
            if node == hub:
                of, held = (hub, part), labelled(raw.as_py())
            elif of != (hub, part):
                raise ValueError("a part without its hub")
            elif similarity(labelled(raw.as_py()), held) >= SIMILARITY:
                a.append(node)
                b.append(hub)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (node, hub), all different, that are alike, as (a, b)."""
    sizes = c.stored(pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts")), "hubs")
    members = pairs.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("node"), "parts").alias("part"), "node")
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("hub").alias("node"))
    rows = members.unionAll(hubs).join(texts.hint("merge"), "node").repartition("hub", "part")
    return rows.sortWithinPartitions("hub", "part", F.col("node") != F.col("hub")).select("hub", "part", "node", "text").mapInArrow(_verify, "a binary, b binary")


def _to_hubs(state: DataFrame, places: tuple[int, ...]) -> DataFrame:
    """(node, hub): of each component in a bucket of these sketches one member, with the bucket's hub."""
    rows = state.select("node", "root", F.explode(F.array(*(F.get("s", F.lit(i)) for i in places))).alias("key"))
    parts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.xxhash64("key", "node").alias("rank"), "node"))["node"].alias("node"))
    hubs = parts.groupBy("key").agg(F.max(F.struct("n", F.xxhash64("key", "node").alias("rank"), "node"))["node"].alias("hub"), F.count(F.lit(1)).alias("roots"))
    hubs = c.stored(hubs.where("roots > 1").select("key", "hub"), "mixed")
    return parts.select("key", "node").join(hubs, "key").where("node != hub").select("node", "hub").distinct()


def _across(block: pa.Table) -> pa.Table:
    """Links between the left and the right texts of a block that have different roots, until those are one."""
    nodes, roots = block.column("node").to_pylist(), block.column("root").to_pylist()
    outer, side = block.column("outer").to_pylist(), np.array(block.column("is_left").to_pylist())
    lefts, rights = np.flatnonzero(side), np.flatnonzero(~side)
    a, b = [], []
    if len(lefts) and len(rights):
        kmers = [labelled(raw) for raw in block.column("text").cast(pa.binary()).to_pylist()]
        sizes = np.array([len(x) for x in kmers])
        vocabulary, ids = np.unique(np.concatenate(kmers), return_inverse=True)
        own = np.split(ids, np.cumsum(sizes)[:-1])
        theirs, starts = np.concatenate([own[r] for r in rights]), np.cumsum(sizes[rights]) - sizes[rights]
        has, parent = np.zeros(len(vocabulary), dtype=np.int32), {r: r for r in roots}

        def top(x: bytes) -> bytes:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i in lefts:
            has[own[i]] = 1
            both = np.add.reduceat(has[theirs], starts)
            has[own[i]] = 0
            for j in rights[both >= SIMILARITY * (sizes[i] + sizes[rights]) / (1 + SIMILARITY) - 1e-9]:
                # two texts outside of the main component meet twice, once from either side
                if (nodes[i] < nodes[j] or not outer[j]) and top(roots[i]) != top(roots[j]) and similarity(kmers[i], kmers[j]) >= SIMILARITY:
                    parent[top(roots[i])] = top(roots[j])
                    a.append(nodes[i])
                    b.append(nodes[j])
    return pa.Table.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _rest(state: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of links between components in buckets of three members or more: every member outside of a bucket's main
    component (the one with most k-mers) meets every member, in blocks."""
    rows = state.select("node", "root", "size", F.explode("s").alias("key"))
    whole = rows.groupBy("key", "root").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).groupBy("key")
    mixed = whole.agg(F.max(F.struct("size", "root")).alias("main"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n")).where("roots > 1 AND n > 2")
    mixed = c.stored(mixed.select("key", F.col("main.root").alias("main"), F.ceil(F.col("size") / BLOCK).alias("n_right"), F.ceil((F.col("size") - F.col("main.size")) / BLOCK).alias("n_left")), "mixed")
    members = c.stored(rows.drop("size").join(mixed, "key").withColumn("outer", F.col("root") != F.col("main")), "members")
    at_left, at_right = (F.pmod(F.xxhash64("node", F.lit(n)), F.col(n)) for n in ("n_left", "n_right"))
    every_left, every_right = (F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)) for n in ("n_left", "n_right"))
    left = members.where("outer").select("key", at_left.alias("i"), every_right.alias("j"), "node", "root", "outer", F.lit(True).alias("is_left"))
    right = members.select("key", every_left.alias("i"), at_right.alias("j"), "node", "root", "outer", F.lit(False).alias("is_left"))
    return left.unionAll(right).join(texts.hint("merge"), "node").groupBy("key", "i", "j").applyInArrow(_across, "a binary, b binary")


def _named(docs: DataFrame) -> DataFrame:
    text = c.text_of(docs)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("node"), text.alias("text"))


def _roots(docs: DataFrame) -> DataFrame:
    """node (MD5 of the text), root (the least node of its class) of every text that is linked to another."""
    named = _named(docs).select("node", "text")
    with c.temporary(docs.sparkSession):
        sketched = c.stored(named.mapInArrow(_sketch, "node binary, s array<long>, size long").dropDuplicates(["node"]), "sketches")
        shared = sketched.select(F.explode("s").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
        state = sketched.select("node", "s", "size", F.explode("s").alias("key")).join(shared, "key", "left_semi").dropDuplicates(["node"]).select("node", "s", "size", F.col("node").alias("root"))
        state = c.stored(state, "state")
        texts = c.stored(named.join(state.select("node").hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "texts")
        roots = None
        for places in PHASES:
            linked = c.stored(_verified(c.stored(_to_hubs(state, places), "pairs"), texts), "linked")
            roots, state = _contracted(linked, roots, state)
        roots, _ = _contracted(c.stored(_rest(state, texts), "rest"), roots, None)
        return c.stored(roots, "roots", kept=True)


def _contracted(linked: DataFrame, roots: DataFrame | None, state: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Components of new links (a, b) and of those that made roots, and the state with the new roots."""
    if roots is not None:
        linked = linked.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = components(linked)
    if state is None:
        return roots, None
    return roots, c.stored(state.drop("root").join(roots, "node", "left").select("node", "s", "size", F.coalesce("root", "node").alias("root")), "state")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, node, root (the least node of its class) of every row."""
    return _named(docs).select("doc_id", "node").join(_roots(docs), "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), class_size of every row."""
    found = c.stored(classes(docs), "classes")
    sizes = c.stored(found.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "sizes")
    return found.join(sizes, "root").select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of docs, one for each class: the least doc_id's (null last), of equal ids the least text hash's."""
    found = classes(docs)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("x")).select(F.coalesce("x.doc_id", F.lit(c.NO_ID)).alias("_k1"), F.col("x.node").alias("_node"))
    keyed = docs.withColumns({"_k1": F.coalesce(docs["doc_id"].cast("long"), F.lit(c.NO_ID)), "_node": F.unhex(F.md5(c.text_of(docs).cast("binary")))})
    return keyed.join(first, ["_k1", "_node"], "left_semi").dropDuplicates(["_k1", "_node"]).select(*docs.columns)
