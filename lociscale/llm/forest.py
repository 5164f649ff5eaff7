"""N-gram Jaccard self-join through a MinHash LSH forest, and the classes of its links.

Texts are compared by their sets of five-word shingles (words are lower-cased runs between white space; a
text of fewer words is one shingle). Equal sets are one class from the start, so copies cost one row each.

A signature holds ``TREES`` labels of ``DEPTH`` MinHash values. The labels of a tree in sorted order are its
prefix trie: sets that share a prefix are a run of neighbours, a node. One sweep over the sorted labels gives each
the longest prefix that it shares with a neighbour, and so the nodes that it is in. All sets start at the full length,
where they meet the sets of their nodes. Whoever hasn't reached the target recall shortens its prefixes by
one value and meets the larger nodes, and so on. The recall of a set is estimated from what it has met: a
partner of similarity s is met at length d with the chance 1 - (1 - s**d)**TREES, so each one stands for
1 / chance partners. A set that has met nobody has no estimate and goes on. The shortest length is the
longest at which any pair at the threshold meets with the target chance (4 at 0.8), so nobody need go
below it. A pair is met where either of its sets walks, at the longest prefix that it shares and there in
the first tree, so links are counted once.

Nodes are compared in blocks of bounded size (a hot node becomes many pairs of blocks), and what comes
back is one row a member. Pairs of documents are never emitted. Signatures only rule pairs out (six
standard errors under the threshold); every link is verified on the whole shingle sets, by 64-bit hashes.
A link at the threshold of which neither set stopped early is missed with a chance of about one in ten
million; if both stopped early, because their other partners are nearer, with at most six in 100,000.

Defined cases: a null text has no shingles and no links, and is a class by itself; texts without words are
copies of each other; short texts are compared like others; very long texts are taken whole; repeated rows
are copies; an empty table gives no rows; a class is named by its least doc_id, nulls aside (null if it has
no other). Extra columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociscale.llm.common import cut, small_batches, spread, streamed_groups

TREES, DEPTH = 32, 6
WORDS = 5
#: Members of a node, and their shingles, that are compared with each other or with as many others at a time.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
#: Sets with a partner up to which their keys are broadcast to find their texts (some 50 bytes each).
BROADCAST_SETS = 200_000

_random = np.random.RandomState(17)
_A = _random.randint(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _random.randint(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)
_MIX = [int(x) | 1 for x in _random.randint(1 << 62, (1 << 63) - 1, WORDS, dtype=np.int64)]


def chance(similarity: float | np.ndarray, length: int) -> float | np.ndarray:
    """That two sets of this similarity share a prefix of this length in some tree."""
    return 1 - (1 - similarity**length) ** TREES


def prefix_lengths(threshold: float, target: float) -> list[int]:
    """The lengths that are walked, from the full one to the longest that meets the target at the threshold."""
    least = next((d for d in range(DEPTH, 1, -1) if chance(threshold, d) >= target), 1)
    return list(range(DEPTH, least - 1, -1))


class Shingler:
    """Sets of word shingles as sorted arrays of 64-bit hashes."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        if len(self.known) > 200_000:  # a memo of hashes
            self.known.clear()
        value = self.known[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().encode("utf-8", "surrogatepass").split()  # of bytes: at the space and the controls from tab to carriage return
        if not words:
            return np.empty(0, dtype=np.uint64)
        get, new = self.known.get, self._hash
        own = np.fromiter((get(w) or new(w) for w in words), dtype=np.uint64, count=len(words))
        n = max(1, len(words) - WORDS + 1)
        out = np.full(n, len(words) if len(words) < WORDS else WORDS, dtype=np.uint64)
        for i in range(min(WORDS, len(words))):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(_MIX[i]) + own[i : i + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(_MIX[0])
        out ^= out >> np.uint64(32)
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES * DEPTH MinHash values, of each its lower 16 bits."""
    low = (shingles >> np.uint64(16)).astype(np.uint32)
    out = np.full(TREES * DEPTH, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(out, (low[None, i : i + 2048] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return (out & np.uint32(0xFFFF)).astype(np.uint16)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        sids, signatures, sizes = [], [], []
        for text in batch.column(2).to_pylist():
            if text is None:
                sids.append(None)
                signatures.append(None)
                sizes.append(None)
            else:
                own = shingler(text)
                sids.append(hashlib.md5(own.tobytes()).digest())
                signatures.append(signature(own).tobytes())
                sizes.append(len(own))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sids, pa.binary()), pa.array(signatures, pa.binary()), pa.array(sizes, pa.int32())], names=["doc_id", "body", "sid", "signature", "size"])


def _least(threshold: float) -> float:
    """The estimated similarity under which a pair is ruled out."""
    return threshold - 6 * np.sqrt(threshold * (1 - threshold) / (TREES * DEPTH))


def meeting(sig: np.ndarray, block: np.ndarray, walks: np.ndarray, across: bool, tree: int, length: int, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each member, the indices of later ones that it may be linked to and meets here first, and their
    estimated similarities: within a block or across two, of pairs of which at least one set still walks,
    in the first tree of those in which they share ``length`` values, if they share no more in any."""
    for i in range(len(sig) - 1):
        same = sig[i + 1 :] == sig[i]
        near = same.mean(axis=1)
        keep = near >= least
        if across:
            keep &= block[i + 1 :] != block[i]
        if not walks[i]:
            keep &= walks[i + 1 :]
        at = np.flatnonzero(keep)
        if not len(at):
            continue
        shared = same[at].reshape(-1, TREES, DEPTH)
        met = shared[:, :, :length].all(axis=2)
        first = met[:, tree] & ~met[:, :tree].any(axis=1)
        if length < DEPTH:
            first &= ~(met & shared[:, :, length]).any(axis=1)
        if first.any():
            yield i, at[first] + i + 1, near[at[first]]


def _met(threshold: float, length: int, weighed: list[int]):
    """The members of each pair of blocks that may have a link there: with how many, and for each of the
    lengths in ``weighed`` for how many partners these stand."""
    least = _least(threshold)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "one", "two", "tree", "block", "id", "walks"]
        for (_, one, two), rows in streamed_groups(batches, names[:3], 1 << 40):
            sig = np.frombuffer(b"".join(rows.column("signature").to_pylist()), dtype=np.uint16).reshape(-1, TREES * DEPTH)
            block, walks = rows.column("block").to_numpy(), rows.column("walks").to_numpy()
            n, stand = np.zeros(len(sig), dtype=np.int64), np.zeros((len(weighed), len(sig)))
            for i, js, near in meeting(sig, block, walks, one != two, rows.column("tree")[0].as_py(), length, least):
                n[i] += len(js)
                n[js] += 1
                for own, d in zip(stand, weighed, strict=True):
                    for_each = 1 / chance(np.maximum(near, threshold), d)
                    own[i] += for_each.sum()
                    own[js] += for_each
            if n.any():
                hit = n > 0
                kept = rows.select(names).filter(pa.array(hit)).combine_chunks()
                yield pa.RecordBatch.from_arrays([*[c.chunk(0) for c in kept.columns], pa.array(n[hit]), *[pa.array(x[hit]) for x in stand]], names=[*names, "n", *[f"w{d}" for d in weighed]])

    return met


def shared_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values rows of labels (tree, then DEPTH values of two bytes) share from the first on; of different
    trees none."""
    same = (a[:, 1:] == b[:, 1:]).reshape(-1, DEPTH, 2).all(axis=2)
    return np.where(a[:, 0] == b[:, 0], np.logical_and.accumulate(same, axis=1).sum(axis=1), 0).astype(np.int32)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last label of a part."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first, last = first or batch.column(0)[0].as_py(), batch.column(0)[batch.num_rows - 1].as_py()
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first]), pa.array([last])], names=["part", "first", "last"])


def _swept(ends: dict[int, tuple[bytes, bytes]], least: int):
    """Sorted labels with the longest prefix that each shares with a neighbour; what stands alone goes. The labels
    before and after a part are the ends of the parts beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before = max((p for p in ends if p < part), default=None)
        after = min((p for p in ends if p > part), default=None)
        as_rows = lambda labels: np.frombuffer(b"".join(labels), np.uint8).reshape(-1, 1 + 2 * DEPTH)
        nothing = np.full((1, 1 + 2 * DEPTH), 255, np.uint8)
        last = nothing if before is None else as_rows([ends[before][1]])
        held: pa.Table | None = None  # the last row so far, which the next one is still to meet
        known = np.zeros(0, np.int32)  # what it shares with the one before it

        def out(rows: pa.Table, longest: np.ndarray) -> pa.RecordBatch:
            keep = longest >= least
            labels = as_rows(rows.column("label").to_pylist())[keep]
            own = rows.filter(pa.array(keep)).combine_chunks()
            kept = [pa.array(labels[:, 0].astype(np.int32)), pa.array([x.tobytes() for x in labels[:, 1:]], pa.binary()), *[pa.array(own.column(c).to_numpy(), t) for c, t in (("id", pa.int64()), ("size", pa.int32()))], pa.array(longest[keep])]
            return pa.RecordBatch.from_arrays(kept, names=["tree", "label", "id", "size", "longest"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            labels = as_rows(rows.column("label").to_pylist())
            up = shared_values(labels[1:], labels[:-1])
            first = shared_values(labels[:1], last) if held is None else known
            up = np.concatenate([first, up])
            if len(labels) > 1:
                yield out(rows.slice(0, len(labels) - 1), np.maximum(up[:-1], up[1:]))
            held, known = rows.slice(len(labels) - 1), up[-1:]
        if held is not None:
            following = nothing if after is None else as_rows([ends[after][0]])
            yield out(held, np.maximum(known, shared_values(as_rows(held.column("label").to_pylist()), following)))

    return run


def tries(sets: DataFrame, least: int) -> DataFrame:
    """tree, label, id, size, longest: all trees' labels of ``sets`` in sorted order, in which the sets of a prefix are
    neighbours. One sweep tells each label the longest prefix that it shares with another (its neighbour has it);
    labels that share less than ``least`` values are in no node."""
    tree = F.sequence(F.lit(0), F.lit(TREES - 1))
    label = lambda t: F.concat(F.substring(F.lit(bytes(range(TREES))), t + 1, F.lit(1)), F.substring(F.col("signature"), t * (2 * DEPTH) + 1, F.lit(2 * DEPTH)))
    labels = sets.select(F.explode(F.transform(tree, label)).alias("label"), "id", "size")
    trie = cut(labels.repartitionByRange("label", "id").sortWithinPartitions("label", "id"))
    ends = {r["part"]: (bytes(r["first"]), bytes(r["last"])) for r in trie.select("label").mapInArrow(_ends, "part int, first binary, last binary").collect()}  # a row for each part
    return cut(trie.mapInArrow(_swept(ends, least), "tree int, label binary, id long, size int, longest int"))


def walk(sets: DataFrame, *, threshold: float = 0.8, recall: float = 0.9999999) -> tuple[list[DataFrame], DataFrame]:
    """Walks the forest of ``sets`` (id, signature, size) from full prefixes to shorter ones.

    Gives, for each length, the members of pairs of blocks in which candidates were met there (node, one,
    two, tree, block, id, walks), and (id, length) of the sets that reached the target recall before the
    shortest length. At a length only the labels are read that share as much with a neighbour.
    """
    lengths = prefix_lengths(threshold, recall)
    trie = tries(sets, lengths[-1])
    group = ["node", "one", "two"]
    found: list[DataFrame] = []
    stopped: DataFrame | None = None
    for place, length in enumerate(lengths):
        weighed = lengths[place:-1]
        prefix = F.substring("label", 1, 2 * length)
        rows = trie.where(F.col("longest") >= length).select("tree", F.xxhash64("tree", prefix).alias("node"), F.substring("label", 1, 2 * length + 2).alias("longer"), "label", "id", "size")
        walks = F.lit(True)
        if stopped is not None:
            rows, walks = rows.join(stopped.select("id", F.lit(True).alias("__stopped")), "id", "left"), F.col("__stopped").isNull()
        rows = rows.withColumn("walks", walks)
        members = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1 << 40))).alias("s")]
        tallied = rows.groupBy("node").agg(*members, F.min("tree").alias("tree"), F.sum("size").alias("shingles"), F.max("walks").alias("any"), (F.min("longer") != F.max("longer")).alias("parts"))
        # below the full length only where two longer prefixes come together; there nobody met before
        nodes = tallied.where("n > 1 AND any" + " AND parts" * (length < DEPTH))
        # of nodes with the same members only that of the first tree, where all their pairs meet
        nodes = nodes.groupBy("n", "x", "s").agg(F.min(F.struct("tree", "node", "shingles")).alias("m")).select("n", "m.node", "m.shingles")
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
        own = rows.join(nodes.select("node", blocks.alias("blocks")), "node").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        own = own.join(sets.select("id", "signature"), "id")  # a row a member; only then it is dealt to the pairs of its block
        other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = other.select("node", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "tree", "block", "id", "walks", "label", "signature")
        signed = dealt.repartition(*group).sortWithinPartitions(*group, "label")
        schema = "node long, one int, two int, tree int, block int, id long, walks boolean, n long" + "".join(f", w{d} double" for d in weighed)
        found.append(cut(signed.drop("label").mapInArrow(_met(threshold, length, weighed), schema)))
        if weighed:
            sums = None
            for f in found:
                one = f.select("id", "n", f"w{length}")
                sums = one if sums is None else sums.unionByName(one)
            reached = sums.groupBy("id").agg(F.sum("n").alias("n"), F.sum(f"w{length}").alias("stands_for")).where(F.col("n") >= F.lit(recall) * F.col("stands_for"))
            now = reached.select("id", F.lit(length).alias("length"))
            stopped = cut(now if stopped is None else stopped.unionByName(now.join(stopped, "id", "left_anti")))
    if stopped is None:
        stopped = sets.select("id", F.lit(lengths[0]).alias("length")).where("false")
    return [f.select("node", "one", "two", "tree", "block", "id", "walks", F.lit(d).alias("length")) for d, f in zip(lengths, found, strict=True)], stopped


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def _verified(threshold: float):
    least = _least(threshold)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a member of each pair of blocks: its links there, and the least member linked to it."""
        for (length, _, one, two), rows in streamed_groups(batches, ["length", "node", "one", "two"], 1 << 40):
            ids = rows.column("id").to_pylist()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("shingles").to_pylist()]
            copies = rows.column("copies").to_pylist()
            sig = np.stack([signature(x) for x in sets])
            links, texts, root = [0] * len(ids), [0] * len(ids), list(range(len(ids)))

            def find(i: int, root: list[int] = root) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            block, walks = rows.column("block").to_numpy(), rows.column("walks").to_numpy()
            for i, js, _ in meeting(sig, block, walks, one != two, rows.column("tree")[0].as_py(), length, least):
                for j in js:
                    a, b = sets[i], sets[j]
                    if min(len(a), len(b)) >= threshold * max(len(a), len(b)) and jaccard(a, b) >= threshold:
                        links[i] += copies[j]
                        links[j] += copies[i]
                        texts[i] += 1
                        texts[j] += 1
                        x, y = sorted((find(i), find(j)), key=lambda k: ids[k])
                        root[y] = x
            out = [(ids[i], ids[find(i)], links[i], texts[i]) for i in range(len(ids)) if texts[i]]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4, strict=True)], names=["id", "root", "links", "texts"])

    return verified


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        own = [shingler(x).tobytes() for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(own, pa.binary())], names=["id", "copies", "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for the nodes of ``edges`` (``a``, ``b``): the least node reachable.

    Alternating large and small stars until a round changes nothing; each round is two aggregations and
    joins, and is materialised.
    """
    flip = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, before = cut(flip), None
    parts = max(8, now.count() // 500_000)  # a round's result never has more edges: few files for few edges
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # materialised, so that the join below shuffles both sides itself and can split a hub's edges
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).coalesce(parts))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        now = cut(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct().coalesce(parts))
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def _linked(docs: DataFrame, threshold: float, recall: float, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, body, sid) of all documents, and for each shingle set sid: class_id, pick (the row that
    stands for its class), copies, links and texts."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text"))
    rows = cut(spread(slim).mapInArrow(_signed, "doc_id long, body long, sid binary, signature binary, size int"))
    pick = F.struct(F.col("doc_id").isNull().alias("unkeyed"), "doc_id", "body")
    sets = rows.where("sid IS NOT NULL").groupBy("sid").agg(F.count("*").alias("copies"), F.min(pick).alias("pick"), F.max("signature").alias("signature"), F.max("size").alias("size"))
    sets = cut(sets.withColumn("id", F.monotonically_increasing_id()))  # fixed once it is written
    met, _ = walk(sets.select("id", "signature", "size"), threshold=threshold, recall=recall)
    active = met[0]
    for more in met[1:]:
        active = active.unionByName(more)
    wanted = cut(active.select("id").distinct().join(sets.select("id", "copies", "pick.doc_id", "pick.body"), "id"))
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_SETS else wanted
    a, b = slim.alias("a"), side.alias("b")
    picked = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.body") == F.col("b.body"))).select("a.text", "b.id", "b.copies")
    shingled = picked.mapInArrow(_shingled, "id long, copies long, shingles binary").dropDuplicates(["id"])
    group = ["length", "node", "one", "two"]
    # a node's member meets its shingles once, whatever the pairs of blocks it is compared in
    members = active.groupBy("length", "node", "tree", "block", "id", "walks").agg(F.collect_list(F.struct("one", "two")).alias("pairs"))
    dealt = members.join(shingled, "id").select("*", F.inline("pairs")).drop("pairs")
    compared = dealt.repartition(*group).sortWithinPartitions(*group)
    found = cut(compared.mapInArrow(_verified(threshold), "id long, root long, links long, texts long"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    linked = counts.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).join(sets.select("id", "pick"), "id")
    heads = linked.groupBy("root").agg(F.min("pick").alias("head"))
    joined = cut(linked.join(heads, "root").select("id", "head", "links", "texts"))
    none = F.lit(0).cast("long")
    classes = sets.select("sid", "id", "copies", "pick").join(joined, "id", "left").select(
        "sid", F.coalesce("head", "pick").alias("pick"), "copies", F.coalesce("links", none).alias("links"), F.coalesce("texts", none).alias("texts")
    )
    return rows.select("doc_id", "body", "sid"), classes


def similarity_classes(docs: DataFrame, *, threshold: float = 0.8, recall: float = 0.9999999, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, class_id (linked documents share it), n_links (other documents at
    ``threshold`` or above, copies included) and n_texts (different shingle sets among those)."""
    rows, classes = _linked(docs, threshold, recall, text, key)
    out = rows.join(classes, "sid", "left")
    null = F.col("sid").isNull()
    return out.select(
        "doc_id", F.when(null, F.col("doc_id")).otherwise(F.col("pick.doc_id")).alias("class_id"),
        F.when(null, 0).otherwise(F.col("copies") - 1 + F.col("links")).cast("long").alias("n_links"), F.when(null, 0).otherwise(F.col("texts")).cast("long").alias("n_texts"),
    )


def one_of_each(docs: DataFrame, *, threshold: float = 0.8, recall: float = 0.9999999, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id. Rows without a text all stay.

    What leaves is joined to the documents, not what stays: it is the smaller side. Only where rows of one
    key and text repeat, those alone are gathered to keep one.
    """
    rows, classes = _linked(docs, threshold, recall, text, key)
    own = (F.col("doc_id").eqNullSafe(F.col("pick.doc_id"))) & (F.col("body") == F.col("pick.body"))
    placed = rows.join(classes.select("sid", "pick"), "sid").select("doc_id", "body", own.alias("stays"))
    tally = cut(placed.groupBy("doc_id", "body", "stays").agg(F.count("*").alias("n")).where("NOT stays OR n > 1"))
    side = tally.select(F.col("doc_id").alias("__d"), F.col("body").alias("__b"), F.col("stays").alias("__again"))
    side = F.broadcast(side) if tally.count() <= BROADCAST_SETS else side
    body = F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text)))
    met = docs.withColumn("__body", body).join(side, F.col(key).cast("long").eqNullSafe(F.col("__d")) & (F.col("__body") == F.col("__b")), "left")
    names = [f"`{c}`" for c in docs.columns]
    alone = met.where("__again IS NULL").select(*names)
    if not tally.where("stays").limit(1).count():
        return alone
    return alone.unionByName(met.where("__again").dropDuplicates(["__d", "__b"]).select(*names))
