"""Removal of passages that repeat word for word, found by fixed-block anchors.

Every document is cut into blocks of ``block`` words that don't overlap; these are the index. With blocks of half a
window, rounded up, each window of ``window`` words holds exactly one block of its document whole. So a window
can only repeat if its block also stands, at any offset, somewhere else. All rolling windows of ``block`` words probe
the index for that: tasks pass on sorted fingerprints, dealt to buckets by the hash, each hash of a span of
documents once, with those met twice named. Blocks that are met again are hits.

Around a hit the repeat is extended: the windows that hold the block (at most ``block``) are hashed to 95 bits
and counted over all documents. Windows counted twice are repeats, and runs of these are the maximal exact ones; the
words they cover go. No pairs are formed: a passage that stands n times costs n rows, and inside a task one.
Documents are known by 95 bits of hash of their text, so copies share their hits.

Defined cases: words are runs of anything but space and the controls from tab to carriage return, compared
unchanged; a null text has no words and stays null; an empty one, or one shorter than a window, keeps all its words; equal
windows in one document are repeats, overlapping ones too; copies of a document of a window or more lose all
words; windows are judged on the input. Repeated rows are rows; very long texts are taken whole; an empty table gives
no rows; other columns pass through, but for those with the names of the results, which these replace.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociscale.llm.common import cut, fresh, replaced

#: Words after which a task passes on what it has met.
SPAN = 600_000
#: Bytes of text for one bucket of fingerprints.
BUCKET_BYTES = 16 << 20
#: Bytes up to which hits and spans are broadcast; beyond it, they are joined by exchange.
BROADCAST_BYTES = 32 << 20
#: Words whose hashes a task remembers.
WORDS = 300_000

ODD = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD))


class _Hashes(dict):
    """64 bits of each word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = out = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out


def _mixed(left: np.ndarray, right: np.ndarray, seed: int) -> np.ndarray:
    x = left * ODD[seed] + (right ^ (right >> np.uint64(32))) * ODD[seed + 1]
    return x ^ (x >> np.uint64(29))


def rolling(h: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of each window of ``size`` values: windows of powers of two, put together."""
    out, at, width, own = None, 0, 1, h
    while True:
        if size & width:
            part = own[at:]
            out = part if out is None else _mixed(out[: len(part)], part, seed)
            at += width
        width *= 2
        if width > size:
            return out[: max(0, len(h) - size + 1)]
        own = _mixed(own[: -(width // 2)], own[width // 2 :], seed) if len(own) > width // 2 else own[:0]


def _read(batches: Iterator[pa.RecordBatch], window: int, extra: int = 0) -> Iterator[list[tuple]]:
    """Spans of documents as (word hashes, hash 1, hash 2 of the text, what the extra column has); of documents
    that are shorter than a window none, of copies two at most."""
    known = _Hashes()
    span, seen, words = [], {}, 0  # seen: the hashes of a text, None from its second copy on
    for batch in batches:
        k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        more = batch.column(3).to_pylist() if extra else [None] * batch.num_rows
        texts = batch.column(2).cast(pa.binary())
        for i in range(batch.num_rows):
            text, key = texts[i].as_py(), (k1[i], k2[i])
            if key in seen:
                if (own := seen[key]) is None:
                    continue
                seen[key] = None
            else:
                found = text.split()
                if len(found) < window:
                    continue
                own = seen[key] = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
            span.append((own, *key, more[i]))
            words += len(own)
            if words >= SPAN:
                yield span
                span, seen, words = [], {}, 0
    if span:
        yield span


def _probes(window: int, block: int, buckets: int):
    """A span's rolling hashes and blocks, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for span in _read(batches, window):
            rolled = [rolling(d[0], block) for d in span]
            blocks = np.concatenate([r[::block] for r in rolled])
            n = [len(r[::block]) for r in rolled]
            k1, k2 = (np.repeat(np.array([d[i] for d in span], t), n) for i, t in ((1, np.int64), (2, np.int32)))
            at = np.concatenate([np.arange(x, dtype=np.int32) for x in n])
            met, times = np.unique(np.concatenate(rolled), return_counts=True)
            sure = times[np.searchsorted(met, blocks)] > 1
            # hits within the span go by their documents, so that a passage that is everywhere isn't one bucket's
            bucket = np.where(sure, k1.view(np.uint64) % np.uint64(buckets), _bucket(blocks, buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            parts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            cuts = np.searchsorted(_bucket(met, buckets), np.arange(buckets + 1))
            short, again = met.astype(np.uint32), times > 1
            blocks = blocks.astype(np.uint32)
            rows = []
            for b in range(buckets):
                p, own = slice(cuts[b], cuts[b + 1]), order[parts[b] : parts[b + 1]]
                if p.stop > p.start or len(own):
                    rows.append((b, short[p].tobytes(), np.packbits(again[p]).tobytes(), blocks[own].tobytes(), sure[own].tobytes(), k1[own].tobytes(), k2[own].tobytes(), at[own].tobytes()))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["bucket", "met", "again", "blocks", "sure", "k1", "k2", "at"])

    return run


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """By the high half of a hash; the low half tells hashes of a bucket apart."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks that were met more than once, from rows sorted by bucket."""

    def found(rows: list[dict]) -> pa.RecordBatch:
        met = [np.frombuffer(r["met"], np.uint32) for r in rows]
        again = [m[np.unpackbits(np.frombuffer(r["again"], np.uint8), count=len(m)).astype(bool)] for r, m in zip(rows, met, strict=True)]
        ordered = np.sort(np.concatenate(met))
        hot = np.union1d(ordered[1:][ordered[1:] == ordered[:-1]], np.concatenate(again))
        whole = lambda name, t: np.frombuffer(b"".join(r[name] for r in rows), t)
        hit = whole("sure", bool) | np.isin(whole("blocks", np.uint32), hot)
        return pa.RecordBatch.from_arrays([pa.array(whole(c, t)[hit]) for c, t in (("k1", np.int64), ("k2", np.int32), ("at", np.int32))], names=["k1", "k2", "at"])

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield found(held)
                held = []
            held.append(row)
    if held:
        yield found(held)


def _windows(window: int, block: int):
    """The windows around hits; of those that a span has more than once, one that counts for two, the others apart
    from it and from each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for span in _read(batches, window, extra=3):
            parts = []
            for h, k1, k2, hits in span:
                start = np.asarray(hits, np.int64) * block
                near = np.zeros(len(h) - window + 2, np.int32)
                np.add.at(near, np.clip(start - (window - block), 0, len(near) - 1), 1)
                np.add.at(near, np.clip(start + 1, 0, len(near) - 1), -1)
                at = np.flatnonzero(np.cumsum(near)[:-1] > 0)
                parts.append((rolling(h, window)[at], rolling(h, window, 2)[at] >> np.uint64(33), np.full(len(at), k1, np.int64), (np.int64(k2) << 32) + at))
            w1, w2, k1, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((w2, w1))
            same = np.zeros(len(w1) + 1, bool)
            same[1:-1] = (w1[order][1:] == w1[order][:-1]) & (w2[order][1:] == w2[order][:-1])
            # rows stay in the order of documents, whose hashes then shrink well where they are exchanged
            n, apart = np.empty(len(w1), np.int32), np.empty(len(w1), np.int32)
            n[order] = np.where(same[1:] | same[:-1], 2, 1)
            apart[order] = np.where(same[:-1], np.arange(1, len(w1) + 1), 0)
            w1, w2 = w1.view(np.int64), w2.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w1, w2, apart, k1, at, n)], names=["w1", "w2", "apart", "k1", "at", "n"])

    return run


def _spans(window: int):
    """Runs of repeated windows of a document, as words from ``low`` to before ``high``. A run that reaches over
    batches comes in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (at[1:] - at[:-1] > window)))
            last = np.append(new[1:], len(at)) - 1
            low, high = at[new] & 0xFFFFFFFF, (at[last] & 0xFFFFFFFF) + window
            yield pa.RecordBatch.from_arrays([pa.array(k1[new]), pa.array((at[new] >> 32).astype(np.int32)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=["k1", "k2", "low", "high"])

    return run


def _kept(text: int, spans: int, results: int):
    """Texts without the words in spans, and the columns from ``results`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts, gone, removed = [], [], [], []
            for body, own in zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column(spans).to_pylist(), strict=True):
                found = [] if body is None else body.split()
                counts.append(len(found))
                stay = np.ones(len(found), bool)
                for s in own or []:
                    stay[s["low"] : s["high"]] = False
                edges = np.flatnonzero(np.diff(np.concatenate([[False], ~stay, [False]]).astype(np.int8)))
                removed.append([{"low": int(a), "high": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                gone.append(int(len(found) - stay.sum()))
                kept.append(None if body is None else b" ".join(found if not gone[-1] else [x for x, s in zip(found, stay, strict=True) if s]))
            columns, schema = list(batch.columns), batch.schema
            made = [pa.array(kept, pa.binary()).cast(schema.field(results).type), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, schema.field(results + 3).type)]
            columns[results : results + 4] = made
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def small(df: DataFrame, array: str) -> DataFrame:
    """``df``, for broadcast if its rows and their arrays are small."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.size(array)).alias("m")).first()
    return F.broadcast(df) if r["n"] * 40 + (r["m"] or 0) * 16 <= BROADCAST_BYTES else df


def repeated_spans(docs: DataFrame, *, window: int = 35, text: str = "text") -> DataFrame:
    """k1, k2, spans: for each text with repeats (by two hashes of it) the spans of words that these cover."""
    block = (window + 1) // 2
    slim = docs.select(*text_keys(text), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1)
    probes = slim.mapInArrow(_probes(window, block, buckets), "bucket int, met binary, again binary, blocks binary, sure binary, k1 binary, k2 binary, at binary")
    hits = probes.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_hits, "k1 long, k2 int, at int")
    flagged = cut(hits.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("at")).alias("hits")))
    around = slim.join(small(flagged, "hits"), ["k1", "k2"]).select("k1", "k2", "text", "hits").mapInArrow(_windows(window, block), "w1 long, w2 int, apart int, k1 long, at long, n int")
    counted = around.withColumn("times", F.sum("n").over(W.partitionBy("w1", "w2", "apart"))).where("times > 1").select("k1", "at")
    spans = counted.repartition("k1").sortWithinPartitions("k1", "at").mapInArrow(_spans(window), "k1 long, k2 int, low int, high int")
    return cut(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high")).alias("spans")))


def text_keys(text: str) -> list:
    """Two hashes of a text, 95 bits."""
    body = F.col(text).cast("string")
    return [F.xxhash64(body).alias("k1"), F.shiftrightunsigned(F.xxhash64(F.lit(12), body), 33).cast("int").alias("k2")]


def remove_repeats(docs: DataFrame, *, window: int = 35, text: str = "text") -> DataFrame:
    """``docs`` with kept (the words that stay, joined by spaces), n_words, n_removed and removed (spans of words
    that went) at the end."""
    found = repeated_spans(docs, window=window, text=text)
    own = replaced(docs, kept=F.lit(None).cast("string"), n_words=F.lit(0).cast("long"), n_removed=F.lit(0).cast("long"), removed=F.lit(None).cast("array<struct<low:int,high:int>>"))
    names, keys = own.columns, text_keys(text)
    k1, k2, spans = fresh(own, "k1", "k2", "spans")
    marked = own.withColumns({k1: keys[0], k2: keys[1]}).join(small(found, "spans").toDF(k1, k2, spans), [k1, k2], "left").select(*[F.col(f"`{c}`") for c in names], spans)
    at = {c: i for i, c in enumerate(marked.columns)}
    out = marked.mapInArrow(_kept(at[next(c for c in names if c.lower() == text.lower())], at[spans], len(names) - 4), marked.schema)
    return out.select(*[F.col(f"`{c}`") for c in names])
