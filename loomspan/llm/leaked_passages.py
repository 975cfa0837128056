"""Evaluation passages inside a corpus, by a prefix-filtered set join.

The items are the windows of ``window`` consecutive words of each held-out passage. A window is the set of its runs of
``shingle`` words with their places. As a document must contain all of them, the necessary prefix is a single one: the
rarest in the corpus. Documents are joined on these prefix shingles only; positional bounds then say where in the
document the window would have to begin, length bounds whether it fits, and the words of exactly that window are
compared.

The probes go to the executors only while they stay below ``broadcast_rows``; beyond that the same join runs as a
shuffle join on the prefix shingle, of those shingles and windows of the corpus only that pass a bitmap of fixed size of the wanted ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .words import WordHashes, hash_words, ngram_hashes, words


def _windows(batches, window: int, shingle: int):
    """(item, win, words, shingles): each window with its hash, and the hashes of its shingles in order."""
    cache = WordHashes()
    for b in batches:
        lists = [words(t) for t in b.column(1).to_pylist()]
        flat, n = hash_words(lists, cache)
        win, owner, _ = ngram_hashes(flat, n, window)
        if not len(win):
            continue
        sh, so, _ = ngram_hashes(flat, n, shingle)
        first = np.concatenate(([0], np.cumsum(np.bincount(so, minlength=len(n)))))[:-1]
        _, wo, at = ngram_hashes(flat, n, window)
        k = window - shingle + 1
        idx = (first[wo] + at)[:, None] + np.arange(k)[None, :]
        yield pa.record_batch(
            [b.column(0).take(pa.array(owner)), pa.array(win.view(np.int64)), pa.array([" ".join(lists[o][i : i + window]) for o, i in zip(wo.tolist(), at.tolist())], pa.string()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(win) * k + 1, k), pa.int32()), pa.array(sh[idx].ravel().view(np.int64)))],
            names=["item", "win", "words", "shingles"],
        )


def _count(batches, wanted: np.ndarray, shingle: int):
    """Partial document frequencies of the wanted shingles."""
    cache, total = WordHashes(), np.zeros(len(wanted), np.int64)
    for batch in batches:
        for off in range(0, batch.num_rows, 2048):
            flat, n = hash_words([words(t) for t in batch.slice(off, 2048).column(1).to_pylist()], cache)
            h, owner, _ = ngram_hashes(flat, n, shingle)
            at, hit = _lookup(wanted, h)
            pair = np.unique(np.stack([owner[hit], at[hit]], axis=1), axis=0)
            total += np.bincount(pair[:, 1], minlength=len(wanted))
    live = np.nonzero(total)[0]
    yield pa.record_batch([pa.array(wanted[live].view(np.int64)), pa.array(total[live])], names=["shingle", "df"])


def _lookup(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in the sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def _probe(batches, prefix: np.ndarray, offset: np.ndarray, win: np.ndarray, text: list[str], window: int, shingle: int):
    """(doc, words): windows found whole in a document. ``prefix`` is sorted and may repeat."""
    cache = WordHashes()
    unique = np.unique(prefix)
    first, last = np.searchsorted(prefix, unique, "left"), np.searchsorted(prefix, unique, "right")
    for batch in batches:
        for off in range(0, batch.num_rows, 2048):
            b = batch.slice(off, 2048)
            lists = [words(t) for t in b.column(1).to_pylist()]
            flat, n = hash_words(lists, cache)
            h, owner, at = ngram_hashes(flat, n, shingle)
            u, hit = _lookup(unique, h)
            u, owner, at = u[hit], owner[hit], at[hit]
            fan = last[u] - first[u]
            row = np.repeat(first[u] - np.concatenate(([0], np.cumsum(fan)[:-1])), fan) + np.arange(fan.sum()) if len(u) else np.empty(0, np.int64)
            doc, start = np.repeat(owner, fan), np.repeat(at, fan) - offset[row]
            ok = (start >= 0) & (start + window <= n[doc])  # positional and length bounds
            row, doc, start = row[ok], doc[ok], start[ok]
            if not len(row):
                continue
            w, wo, _ = ngram_hashes(flat, n, window)
            base = np.concatenate(([0], np.cumsum(np.bincount(wo, minlength=len(n)))))[:-1]
            ok = w[base[doc] + start] == win[row]
            found = {(d, text[r]) for d, i, r in zip(doc[ok].tolist(), start[ok].tolist(), row[ok].tolist()) if " ".join(lists[d][i : i + window]) == text[r]}
            if found:
                d, t = zip(*found)
                yield pa.record_batch([b.column(0).take(pa.array(d)), pa.array(t)], names=["doc_id", "words"])


_BITS, _PIECE = 27, 15  # bits of a bitmap and of a piece of it, as powers of two


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap of 2**27 bits (16 MB, whatever the input) in which the places of all hashes are set."""

    def place(batches):
        for b in batches:
            at = np.unique(b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - _BITS)).astype(np.int64)
            piece, start = np.unique(at >> _PIECE, return_index=True)
            for p, part in zip(piece.tolist(), np.split(at, start[1:])):
                bits = np.zeros(1 << _PIECE, np.uint8)
                bits[part & ((1 << _PIECE) - 1)] = 1
                yield pa.record_batch([pa.array([p]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["piece", "bits"])

    def union(batches):
        piece, bits = None, None
        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(x, np.uint8)
                if p != piece:
                    if piece is not None:
                        yield pa.record_batch([pa.array([piece]), pa.array([bits.tobytes()], pa.binary())], names=["piece", "bits"])
                    piece, bits = p, x.copy()
                else:
                    bits |= x
        if piece is not None:
            yield pa.record_batch([pa.array([piece]), pa.array([bits.tobytes()], pa.binary())], names=["piece", "bits"])

    out = np.zeros(1 << (_BITS - 3), np.uint8)
    pieces = hashes.mapInArrow(place, "piece long, bits binary").repartition("piece").sortWithinPartitions("piece").mapInArrow(union, "piece long, bits binary")
    for p, x in pieces.collect():  # at most 2**12 rows of 4 kB
        out[p << (_PIECE - 3) : (p + 1) << (_PIECE - 3)] = np.frombuffer(x, np.uint8)
    return out


def leaked_passages(documents: DataFrame, passages: DataFrame, window: int = 12, shingle: int = 5, broadcast_rows: int = 2_000_000) -> DataFrame:
    """(doc_id, item): the documents that contain ``window`` consecutive words of one passage of an item.

    ``documents`` has ``doc_id`` and ``text``, ``passages`` has ``item`` and ``text``; further columns are ignored. Null or
    short texts contain nothing and are contained nowhere; empty inputs give no rows, repeated rows one row a pair.
    A document whose id is null is left out.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null and doc_id is not null")
    items = passages.select(F.col("item").cast("long").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null and item is not null")
    windows = materialize(items.mapInArrow(lambda it: _windows(it, window, shingle), "item long, win long, words string, shingles array<long>"), "windows")
    distinct = materialize(windows.groupBy("words").agg(F.first("win").alias("win"), F.first("shingles").alias("shingles")), "windows-distinct")
    each = distinct.select("words", "win", F.posexplode("shingles").alias("place", "shingle"))
    k = window - shingle + 1
    small = distinct.count() * k <= broadcast_rows  # of held-out items, not of the corpus
    if small:
        wanted = np.unique(np.array([r[0] for r in each.select("shingle").distinct().collect()], np.int64).view(np.uint64))
        df = docs.mapInArrow(lambda it: _count(it, wanted, shingle), "shingle long, df long").groupBy("shingle").agg(F.sum("df").alias("df"))
    else:
        df = _shingled(docs, shingle, bitmap(each.select("shingle"))).select("doc_id", "shingle").distinct().join(each.select("shingle").distinct(), "shingle", "left_semi").groupBy("shingle").agg(F.count("*").alias("df"))
    ranked = each.join(df, "shingle", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "place", "shingle", "win")).alias("p"))
    # a window whose rarest shingle is in no document can't be found
    probes = ranked.where("p.df > 0").select("words", "p.win", F.col("p.place").alias("place"), F.col("p.shingle").alias("prefix"))
    if small:
        rows = probes.toPandas()
        prefix = rows["prefix"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(prefix, kind="stable")
        prefix, offset, win = prefix[order], rows["place"].to_numpy(np.int64)[order], rows["win"].to_numpy(np.int64).view(np.uint64)[order]
        text = rows["words"].to_numpy()[order].tolist()
        hits = docs.mapInArrow(lambda it: _probe(it, prefix, offset, win, text, window, shingle), "doc_id long, words string")
    else:
        probes = materialize(probes, "probes")
        at = _shingled(docs, shingle, bitmap(probes.select("prefix")))
        start = at.join(probes, at["shingle"] == probes["prefix"]).withColumn("start", F.col("at") - F.col("place")).where("start >= 0").select("doc_id", probes["words"], "start")
        whole = _shingled(docs, window, bitmap(probes.select("win")), True).select("doc_id", "words", F.col("at").alias("start"))
        hits = start.join(whole, ["doc_id", "words", "start"]).select("doc_id", "words").distinct()
    return hits.join(windows.select("item", "words").distinct(), "words").select("doc_id", "item").distinct()


def _shingled(docs: DataFrame, k: int, wanted: np.ndarray, spell: bool = False) -> DataFrame:
    """(doc_id, shingle, at, words): the runs of ``k`` words whose hashes pass the bitmap; their words where asked for."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        cache, bits = WordHashes(), sent.value
        for batch in batches:
            for off in range(0, batch.num_rows, 2048):
                b = batch.slice(off, 2048)
                lists = [words(t) for t in b.column(1).to_pylist()]
                flat, n = hash_words(lists, cache)
                h, owner, at = ngram_hashes(flat, n, k)
                place = (h >> np.uint64(64 - _BITS)).astype(np.int64)
                ok = np.nonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)[0]
                if len(ok):
                    h, owner, at = h[ok], owner[ok], at[ok]
                    text = pa.array([" ".join(lists[o][i : i + k]) for o, i in zip(owner.tolist(), at.tolist())], pa.string()) if spell else pa.nulls(len(ok), pa.string())
                    yield pa.record_batch([b.column(0).take(pa.array(owner)), pa.array(h.view(np.int64)), pa.array(at), text], names=["doc_id", "shingle", "at", "words"])

    return docs.mapInArrow(run, "doc_id long, shingle long, at long, words string")
