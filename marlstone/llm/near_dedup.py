"""Near-duplicates by a multi-index Hamming join of MinHash signatures.

Signature.  64 MinHash values of the set of word shingles, 16 bits each.
Index.      The signature is split into 16 chunks of 4 values.  If two signatures
            differ in at most 31 values, some chunk differs in one at most, so
            the pair meets under one of that chunk's keys with one value left
            out: 64 keys a document find every pair under the threshold.  Two
            sets at similarity 0.8 differ in more than 31 of 64 values with a
            probability below one in a million.
Join.       Equal sets are one class.  The classes under a key form a group; groups
            of the same classes count once.  In a group, pairs under the signature
            distance are links, of which a search keeps enough to connect what is
            connected, so no group's pairs are all emitted and no link is lost.
Confirm.    Components of these links are groups again, within which all links of
            full sets lie.  Each class's set travels to its group, and the same
            search confirms links by exact intersections.  Confirmed links make the
            final components.

A group over BLOCK is dealt out.  Each member meets PIVOTS members of its group,
copies of which are in every cell; members that hang together with the most central
pivot need not meet one another again, and only the rest meets everybody, in tiles
of two blocks.  A group of near copies thus costs a copy of each member, whatever
its size.

Defined results: a null or blank text has an empty set and is linked with
nothing; a text of fewer words than a shingle is one shingle; rows that repeat a
doc_id are one document and pool their links; rows with a null doc_id are linked
with nothing, have no component and are kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.graph import components
from marlstone.llm.runtime import documents, mark, release, ship, stash
from marlstone.llm.textcore import chunks, mix, text_column, words_of

VALUES, CHUNK = 64, 4
#: Most values that may differ: some chunk then has one error at most.
DISTANCE = 2 * (VALUES // CHUNK) - 1
#: What a group may hold before it is dealt out (classes under a key, shingles of a component), and the members that all others meet then.
BLOCK_CLASSES, BLOCK_SHINGLES, PIVOTS = 256, 50_000, 8
_U = np.uint64
_rng = np.random.default_rng(20240301)
_MUL = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(1, 2**63, VALUES, dtype=np.uint64)


def _sets(chunk: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shingle hashes of each text, one after the other, and where they start."""
    w = words_of(text_column(chunk, "text"), lower=True)
    n = len(chunk)
    grams, doc, size = w.ngrams(), w.doc_of_word(), np.diff(w.first)
    begin = np.arange(len(w.hash))
    whole = begin + words <= w.first[doc + 1]
    short = (size[doc] < words) & (begin == w.first[doc])
    begin, doc = begin[whole | short], doc[whole | short]
    h = grams.hash(begin, np.minimum(begin + words, w.first[doc + 1]))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])


def _sums(h: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Two sums of hashes of each set: with its size they tell sets apart."""
    sums = [np.concatenate([[_U(0)], np.cumsum(x, dtype=np.uint64)]) for x in (mix(h), mix(h + _U(0x5851F42D4C957F2D)))]
    return [(s[starts[1:]] - s[starts[:-1]]).view(np.int64) for s in sums]


def _signatures(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    full = np.diff(starts) > 0
    out = np.zeros((len(full), VALUES), np.uint64)
    if full.any():
        for k in range(VALUES):
            out[full, k] = np.minimum.reduceat((h * _MUL[k] + _ADD[k]) >> _U(20), starts[:-1][full])
    return (mix(out) & _U(0xFFFF)).astype(np.uint16)


def _profile(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, "text"):
                h, starts = _sets(chunk, words)
                one, two = _sums(h, starts)
                signature = pa.array([x.tobytes() for x in _signatures(h, starts)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [chunk.column("doc_id"), pa.array(np.diff(starts)), pa.array(one), pa.array(two), signature], names=["doc_id", "n_shingles", "one", "two", "signature"]
                )

    return run


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, two sums of the set's hashes and signature of each row of documents (doc_id, text)."""
    ship(docs.sparkSession)
    return docs.mapInArrow(_profile(words), "doc_id long, n_shingles long, one long, two long, signature binary")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One key for each chunk and value left out of it."""
    for batch in batches:
        for a in range(0, len(batch), 4096):
            part = batch.slice(a, 4096)
            s = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(len(part), -1).astype(np.uint64)
            keys = []
            for c in range(0, VALUES, CHUNK):
                for q in range(CHUNK):
                    packed = np.full(len(part), c + q, np.uint64)
                    for v in range(CHUNK):
                        if v != q:
                            packed = packed << _U(16) | s[:, c + v]
                    keys.append(mix(packed))
            set_id = np.asarray(part.column("set_id"))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(set_id, VALUES))], names=["key", "set_id"])


def links_of(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is connected at the similarity: a search that leaves out pairs already connected.

    Sets are ordered by size, and a set is compared only with those whose size allows the similarity.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    ids, sets = ids[order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    open_ = np.ones(len(sets), bool)
    active = np.arange(len(sets))  # sets still laid out in flat, by size
    flat, ends = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])
    out, queue, seed = [], [], 0
    while True:
        if not queue:
            while seed < len(sets) and not open_[seed]:
                seed += 1
            if seed == len(sets):
                return out
            queue.append(seed)
            open_[seed] = False
        u = queue.pop()
        if 2 * open_[active].sum() < len(active):
            keep = open_[active]
            flat = flat[np.repeat(keep, sizes[active])]
            active = active[keep]
            ends = np.concatenate([[0], np.cumsum(sizes[active])])
        fits = sizes[active]
        lo, hi = np.searchsorted(100 * fits, percent * sizes[u]), np.searchsorted(percent * fits, 100 * sizes[u], side="right")
        if not open_[active[lo:hi]].any():
            continue
        near, mine = flat[ends[lo] : ends[hi]], sets[u]
        at = np.minimum(np.searchsorted(mine, near), len(mine) - 1)
        hits = np.concatenate([[0], np.cumsum(mine[at] == near)])
        common = hits[ends[lo + 1 : hi + 1] - ends[lo]] - hits[ends[lo:hi] - ends[lo]]
        found = active[lo:hi][open_[active[lo:hi]] & (100 * common >= percent * (fits[lo:hi] + sizes[u] - common))]
        for v in found.tolist():
            out.append((int(ids[u]), int(ids[v])))
        open_[found] = False
        queue.extend(found.tolist())


def near_of(ids: np.ndarray, signatures: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected by pairs of signatures that differ in DISTANCE values at most."""
    if len(ids) == 2:
        return [(int(ids[0]), int(ids[1]))] if (signatures[0] != signatures[1]).sum() <= DISTANCE else []
    out, open_ = [], np.ones(len(ids), bool)
    for seed in range(len(ids)):
        if not open_[seed]:
            continue
        open_[seed] = False
        queue = [seed]
        while queue:
            u = queue.pop()
            left = np.flatnonzero(open_)
            if not len(left):
                return out
            found = left[(signatures[left] != signatures[u]).sum(axis=1) <= DISTANCE]
            out.extend((int(ids[u]), int(ids[v])) for v in found.tolist())
            open_[found] = False
            queue.extend(found.tolist())
    return out


@dataclass(frozen=True)
class _Signatures:
    """Bodies are signatures; near ones differ in DISTANCE values at most."""

    def forest(self, ids: list[int], bodies: list[bytes]) -> list[tuple[int, int]]:
        return near_of(np.array(ids), np.frombuffer(b"".join(bodies), np.uint16).reshape(len(ids), -1))

    def near(self, pivot: bytes, bodies: list[bytes]) -> np.ndarray:
        every = np.frombuffer(b"".join(bodies), np.uint16).reshape(len(bodies), -1)
        return (every != np.frombuffer(pivot, np.uint16)).sum(axis=1) <= DISTANCE


@dataclass(frozen=True)
class _Sets:
    """Bodies are sorted sets of shingle hashes; linked ones have the similarity."""

    percent: int

    def forest(self, ids: list[int], bodies: list[bytes]) -> list[tuple[int, int]]:
        return links_of(np.array(ids), [np.frombuffer(x, np.uint64) for x in bodies], self.percent)

    def near(self, pivot: bytes, bodies: list[bytes]) -> np.ndarray:
        mine, sizes = np.frombuffer(pivot, np.uint64), np.array([len(x) // 8 for x in bodies])
        every = np.frombuffer(b"".join(bodies), np.uint64)
        hit = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
        common = np.bincount(np.repeat(np.arange(len(bodies)), sizes), hit, len(bodies))
        return 100 * common >= self.percent * (sizes + len(mine) - common)


def _solved(solver):
    """Reads rows ordered by tile; holds one tile at a time, and yields links that connect it."""
    keys = ["group", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, bodies = None, [], []

        def links() -> list[tuple[int, int]]:
            return solver.forest(ids, bodies) if len(ids) > 1 else []

        for batch in batches:
            found: list[tuple[int, int]] = []
            for *at, node, body in zip(*(batch.column(c).to_pylist() for c in (*keys, "node", "body")), strict=True):
                if at != key:
                    found += links()
                    key, ids, bodies = at, [], []
                ids.append(node)
                bodies.append(body)
            yield _edges(found)
        yield _edges(links())

    return run


def _edges(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _hung(masks: np.ndarray, pivot: int) -> int:
    """The pivots, as bits, that hang together with one, through members that are linked with several."""
    reached, before = 1 << pivot, 0
    while reached != before:
        before = reached
        reached |= int(np.bitwise_or.reduce(masks[(masks & before) != 0], initial=0))
    return reached


def _met(solver):
    """Reads rows ordered by cell, its pivots first, and yields for each member the pivot that stands for those it hangs together with, if
    the central one is among them: that which is linked with most others. Each cell has all pivots, so all agree on it. Holds one cell."""
    names = ["group", "node", "hub"]

    def settled(group: int, pivots: list[tuple[int, bytes]], nodes: list[int], bodies: list[bytes]) -> pa.RecordBatch:
        mask, every, near = np.zeros(len(nodes), np.int64), [body for _, body in pivots], []
        for i, pivot in enumerate(every):
            mask |= solver.near(pivot, bodies).astype(np.int64) << i
            near.append(solver.near(pivot, every).sum())
        central = int(np.argmax(near))
        done = (mask & _hung(mask, central)) != 0
        hub = pa.array(np.full(len(nodes), pivots[central][0]), pa.int64(), mask=~done)
        return pa.RecordBatch.from_arrays([pa.array([group] * len(nodes), pa.int64()), pa.array(nodes, pa.int64()), hub], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivots, nodes, bodies = None, [], [], []
        for batch in batches:
            for group, cell, pivot, node, body in zip(*(batch.column(c).to_pylist() for c in ("group", "cell", "pivot", "node", "body")), strict=True):
                if (group, cell) != key:
                    if nodes:
                        yield settled(key[0], pivots, nodes, bodies)
                    key, pivots, nodes, bodies = (group, cell), [], [], []
                if pivot is not None:
                    pivots.append((node, body))
                else:
                    nodes.append(node)
                    bodies.append(body)
        if nodes:
            yield settled(key[0], pivots, nodes, bodies)

    return run


def spanning(members: DataFrame, with_body: Callable[[DataFrame], DataFrame], solver) -> DataFrame:
    """Pairs (a, b) that connect what links connect in each group, and nothing else. members: group, blocks (of the size a task may hold) and node, a thin
    table; with_body adds body to rows of it.

    A group of one block is one tile. Of a larger one, each member meets the group's pivots; those that hang together through pivots
    are done with one another, and the rest meets them, and itself, in tiles of two blocks.
    """
    shape, tile = "a long, b long", ["group", "left", "right"]
    deal = lambda df: df.select(*tile, "node", "body").repartition(*tile).sortWithinPartitions(*tile, "node").mapInArrow(_solved(solver), shape)
    none = F.lit(0)
    members = stash(members, "members")
    small = deal(with_body(members.filter("blocks = 1")).withColumns({"left": none, "right": none}))
    large = members.filter("blocks > 1")
    if large.isEmpty():
        return small
    large = stash(with_body(large), "large")
    order = Window.partitionBy("group").orderBy(F.xxhash64("node"), "node")
    # A limit on the rank itself is applied by every task before rows move, so no task gets a group's nodes.
    first = large.select("group", "node").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PIVOTS)
    chosen = stash(first.select("group", "node", (F.col("rank") - 1).alias("pivot")), "pivots")
    own = large.withColumn("cell", F.pmod(F.xxhash64("node"), "blocks").cast("int")).select("group", "cell", F.lit(None).cast("int").alias("pivot"), "node", "body")
    told = large.join(chosen, ["group", "node"]).withColumn("cell", F.explode(F.sequence(none, F.col("blocks").cast("int") - 1))).select("group", "cell", "pivot", "node", "body")
    meeting = own.unionByName(told).repartition("group", "cell").sortWithinPartitions("group", "cell", F.asc_nulls_last("pivot"), "node")
    met = stash(meeting.mapInArrow(_met(solver), "group long, node long, hub long"), "met").withColumn("done", F.col("hub").isNotNull())
    hung = met.filter("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b"))

    # Groups with a rest, and how many blocks it and the others make.
    rest = met.groupBy("group").agg(F.count("*").alias("n"), F.count_if(~F.col("done")).alias("n_rest")).filter("n_rest > 0")
    sized = rest.join(large.groupBy("group").agg(F.max("blocks").alias("blocks")), "group")
    share = lambda n: F.greatest(F.ceil(2 * F.col("blocks") * n / F.col("n")), F.lit(1)).cast("int")
    sized = sized.select("group", share(F.col("n_rest")).alias("r"), share(F.col("n") - F.col("n_rest")).alias("m"))
    placed = met.join(sized, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("done"), F.col("m")).otherwise(F.col("r"))).cast("int"))
    tiles = F.expr(
        "CASE WHEN done THEN transform(sequence(0, r - 1), i -> named_struct('left', i, 'right', block)) "
        "ELSE concat(transform(sequence(0, m - 1), j -> named_struct('left', block, 'right', j)), "
        "transform(filter(sequence(0, r - 1), i -> i <> block), i -> named_struct('left', least(i, block), 'right', -1 - greatest(i, block)))) END"
    )
    crossed = placed.withColumn("t", F.explode(tiles)).select("group", "node", "t.left", "t.right").join(large.select("group", "node", "body"), ["group", "node"])
    return small.unionByName(hung).unionByName(deal(crossed))


def _send_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, "text"):
                h, starts = _sets(chunk, words)
                raw = [h[a:z].tobytes() for a, z in zip(starts, starts[1:], strict=False)]
                names = ["group", "blocks", "node", "body"]
                out = pa.RecordBatch.from_arrays([*(chunk.column(c) for c in names[:3]), pa.array(raw, pa.binary())], names=names)
                # A doc_id may have several texts; only the one that makes the set is sent for it.
                same = [np.asarray(chunk.column(c)) == x for c, x in zip(("n_shingles", "one", "two"), (np.diff(starts), *_sums(h, starts)), strict=True)]
                yield out.filter(pa.array(np.logical_and.reduce(same)))

    return run


def near_duplicates(df: DataFrame, words: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept of each document."""
    docs = documents(df, id_col, text_col)
    profile = stash(profiles(docs, words), "profiles")
    same = ["n_shingles", "one", "two"]
    # Several classes may have the same smallest doc_id, so each gets an id of its own, which the stash holds fast.
    classes = profile.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature"))
    classes = stash(classes.withColumn("set_id", F.monotonically_increasing_id()), "classes")

    spark, joined = df.sparkSession, mark()
    keys = classes.select("set_id", "signature").mapInArrow(_keys, "key long, set_id long")
    busy = keys.groupBy("key").agg(
        F.count("*").alias("n"), F.min("set_id").alias("least"), F.max("set_id").alias("most"), F.bit_xor(F.xxhash64("set_id")).alias("all"), F.bit_xor(F.xxhash64(F.lit(1), "set_id")).alias("also")
    ).filter("least < most")
    # Keys over the same classes are one group, under the least of them.
    groups = busy.groupBy("n", "least", "most", "all", "also").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BLOCK_CLASSES).alias("blocks"))
    members = keys.join(groups, "key").select(F.col("key").alias("group"), "blocks", F.col("set_id").alias("node"))
    signatures = classes.select(F.col("set_id").alias("node"), F.col("signature").alias("body"))
    near = spanning(members, lambda df: df.join(signatures, "node"), _Signatures())
    parts = components(near)
    release(spark, joined, parts)

    sizes = classes.select(F.col("set_id").alias("node"), F.col("n_shingles").alias("n")).join(parts, "node")
    total = sizes.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"))
    placed = parts.join(total, "component").select("node", F.col("component").alias("group"), "blocks")
    owner = classes.select(F.col("set_id").alias("node"), F.col("rep").alias("doc_id"), *same)
    known, shape = docs.filter("doc_id IS NOT NULL"), "group long, blocks long, node long, body binary"
    send = lambda df: known.join(df.join(owner, "node"), "doc_id").select("group", "blocks", "node", *same, "text").mapInArrow(_send_sets(words), shape)
    confirmed = spanning(placed, send, _Sets(percent))

    # A doc_id with several sets, also an empty one, is one document: its sets are linked.
    kind = F.struct(*same)
    several = profile.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(kind).alias("least"), F.max(kind).alias("most")).filter("least <> most").select("doc_id")
    several = stash(several, "several")
    sets = profile.join(several, "doc_id").select("doc_id", *same).distinct().join(classes.select(*same, "set_id"), same).select("doc_id", "set_id")
    pooled = sets.join(sets.groupBy("doc_id").agg(F.min("set_id").alias("a")), "doc_id").select("a", F.col("set_id").alias("b"))
    final = components(confirmed.unionByName(pooled))
    release(spark, joined, final, several)
    final = final.withColumnRenamed("node", "set_id")

    linked = classes.select("set_id", "rep").join(final, "set_id")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    linked = final.join(least, "component").select("set_id", "least")
    found = classes.select(*same, "set_id", "rep").join(linked, "set_id", "left").select(*same, F.coalesce("least", "rep").alias("component"))
    member = profile.select("doc_id", *same).join(found, same, "left").select("doc_id", "n_shingles", "component")
    whole = member.join(several, "doc_id").groupBy("doc_id").agg(F.min("component").alias("whole"))
    result = member.join(whole, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("whole", "component", "doc_id").alias("component_id"))
    return result.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
