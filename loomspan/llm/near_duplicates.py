"""Near-duplicate records with small edits, by bit-sliced comparison of sketches.

Every text becomes the set of its distinct runs of ``shingle`` words. Texts with equal sets form a *class*; one
entry stands for a class, so copies cost nothing further on. A class gets ``HASHES`` min-hashes: their low bits form
a sketch of 128 bits, whose Hamming distance estimates the Jaccard similarity, and groups of ``rows`` min-hashes form
``bands`` block keys. Blocks of entries that share a key are compared as bit planes: plane *p* holds bit *p* of all
entries of the block, so one XOR compares 64 pairs at once; full adders (carry-save) keep the distances as vertical
counters, and words of which all pairs exceed the radius are abandoned after each group of planes. Pairs within the
radius are verified exactly on their texts.

A block larger than ``most`` entries is cut into chunks of up to ``SIDE`` times as many. Every chunk is sent to the tiles
(pairs of chunks of its block) that it is part of, each of them a group of its own, so that a hot block is spread over all tasks and
none holds more than two chunks. A pair of similarity 0.5 is missed with a probability of (1 - 0.5**rows)**bands, 1.4 % with the
defaults, one of 0.6 with 0.04 %.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_counts
from ..scratch import materialize
from .words import WordHashes, hash_words, mix, ngram_hashes, words

PLANES = 128
SIDE = 8
_SALTS = 16
SEED = 20240607


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(1, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 2**32, n, dtype=np.uint32)


def shingle_sets(lists: list[list[str]], k: int, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit shingle hashes of each list, sorted, and the number of them per list (below 65,536 lists)."""
    flat, n = hash_words(lists, cache)
    h, owner, _ = ngram_hashes(flat, n, k)
    key = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    counts = np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=len(lists)) if len(key) else np.zeros(len(lists), np.int64)
    return key & np.uint64(2**48 - 1), counts


def min_hashes(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``PLANES`` min-hashes for each list; every count is at least 1."""
    a, b = _hash_family(PLANES)
    x = (mix(sets + np.uint64(SEED)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(counts), PLANES), np.uint32)
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(counts):  # blocks that stay in the cache of a core
        begin = ends[lo] - counts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, begin + 65_536)))
        part, starts = x[begin : ends[hi - 1]], (ends[lo:hi] - counts[lo:hi] - begin).astype(np.int64)
        for j in range(PLANES):
            out[lo:hi, j] = np.minimum.reduceat(part * a[j] + b[j], starts)
        lo = hi
    return out


def _sketch(sig: np.ndarray) -> np.ndarray:
    """Low bits of the mixed min-hashes: 128 bits as two words."""
    bits = (mix(sig.astype(np.uint64) + np.arange(PLANES, dtype=np.uint64) * np.uint64(2**33)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _signatures(batches, shingle: int, least: int, bands: int, rows: int):
    cache, seen = WordHashes(), set()
    for batch in batches:
        for off in range(0, batch.num_rows, 4096):
            b = batch.slice(off, 4096)
            lists = [words(t) for t in b.column(2).to_pylist()]
            keep = [i for i, ws in enumerate(lists) if len(ws) >= max(least, shingle)]
            if not keep:
                continue
            sets, counts = shingle_sets([lists[i] for i in keep], shingle, cache)
            starts = np.cumsum(counts) - counts
            table = [b.column(0)[i].as_py() for i in keep]
            salt = np.fromiter((cache[t] for t in table), np.uint64, len(table))
            cls = mix(np.add.reduceat(mix(sets), starts) + salt).view(np.int64)
            fresh = []
            for c in cls.tolist():  # a class is entered once a task: copies are pre-aggregated before the shuffle
                fresh.append(c not in seen)
                seen.add(c)
                if len(seen) > 500_000:
                    seen.clear()
            sig = min_hashes(sets, counts)
            g = sig[:, : bands * rows].astype(np.uint64).reshape(len(keep), bands, rows)
            key = np.broadcast_to(salt[:, None] + np.arange(bands, dtype=np.uint64)[None, :], (len(keep), bands)).copy()
            for r in range(rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + g[:, :, r])
            sk, key = _sketch(sig).view(np.int64), key.view(np.int64)
            fresh = np.array(fresh)
            offs = np.concatenate(([0], np.cumsum(np.where(fresh, bands, 0)))).astype(np.int32)
            yield pa.record_batch(
                [
                    b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep)), pa.array(cls),
                    pa.ListArray.from_arrays(pa.array(offs), pa.array(key[fresh].ravel())), pa.array(sk[:, 0]), pa.array(sk[:, 1]),
                ],
                names=["table_name", "id", "cls", "keys", "s0", "s1"],
            )


def _planes(s: np.ndarray) -> np.ndarray:
    """Bit planes of sketches: row p holds bit p of all entries, 64 entries a word."""
    n = len(s)
    bits = np.unpackbits(np.ascontiguousarray(s).view(np.uint8).reshape(n, 16), axis=1, bitorder="little")
    padded = np.zeros((PLANES, -(-n // 64) * 64), np.uint8)
    padded[:, :n] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _add(counter: list[np.ndarray], x: list[np.ndarray]) -> list[np.ndarray]:
    """Add one-bit planes to vertical counters, three planes of a weight at a time (carry-save adders)."""
    level, out = x, []
    weight = 0
    while level or weight < len(counter):
        level = level + ([counter[weight]] if weight < len(counter) else [])
        carry = []
        while len(level) >= 3:
            a, b, c = level[:3]
            u = a ^ b
            carry.append((a & b) | (u & c))
            level = level[3:] + [u ^ c]
        if len(level) == 2:
            carry.append(level[0] & level[1])
            level = [level[0] ^ level[1]]
        out.append(level[0] if level else np.zeros_like(x[0]))
        level, weight = carry, weight + 1
    return out


def _exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits of the pairs whose vertical counter is above ``radius``."""
    gt, eq = np.zeros_like(counter[0]), np.full_like(counter[0], ~np.uint64(0))
    for w in range(max(len(counter), radius.bit_length()) - 1, -1, -1):
        c = counter[w] if w < len(counter) else np.zeros_like(gt)
        if radius >> w & 1:
            eq = eq & c
        else:
            gt, eq = gt | (eq & c), eq & ~c
    return gt


def within_radius(xor, valid: np.ndarray, radius: int, group: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Words and bits of the pairs within the radius; ``xor(p, words)`` gives plane ``p`` of the pairs' differences."""
    at, counter = np.nonzero(valid)[0], []
    valid = valid[at]
    for lo in range(0, PLANES, group):
        if not len(at):
            break
        counter = _add(counter, [xor(p, at) for p in range(lo, lo + group)])
        valid = valid & ~_exceeds(counter, radius)
        live = np.nonzero(valid)[0]
        if len(live) < len(at):  # abandon the words of which all pairs exceed the radius
            at, valid, counter = at[live], valid[live], [c[live] for c in counter]
    return at, valid


def _bits(at: np.ndarray, valid: np.ndarray) -> np.ndarray:
    if not len(at):
        return np.empty(0, np.int64)
    b = np.unpackbits(valid.view(np.uint8).reshape(len(at), 8), axis=1, bitorder="little")
    w, k = np.nonzero(b)
    return at[w] * 64 + k


def compare_runs(key: np.ndarray, cls: np.ndarray, s: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of different classes within the radius, of entries that lie in one run of equal keys (sorted)."""
    out = []
    run = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, bool)
    size = np.diff(np.append(np.nonzero(run)[0], len(key)))
    keep = np.repeat(size > 1, size)
    key, cls, s = key[keep], cls[keep], s[keep]
    if not len(key):
        return out
    size = size[size > 1]
    of = np.repeat(size, size)
    order = np.argsort(-of, kind="stable")  # long runs first: a pass only covers those that have entries so far apart
    key, cls, s, of = key[order], cls[order], s[order], of[order]
    planes = _planes(s)
    width = planes.shape[1]
    padded = np.concatenate([planes, np.zeros((PLANES, 2), np.uint64)], axis=1)
    for d in range(1, int(of[0])):  # entry i against entry i + d, for all i at once
        m = int(np.searchsorted(-of, -d, "left"))  # entries of runs longer than d
        same = np.zeros(-(-m // 64) * 64, np.uint8)
        same[: m - d] = (key[d:m] == key[: m - d]) & (cls[d:m] != cls[: m - d])
        valid = np.packbits(same, bitorder="little").view(np.uint64)
        hop, bit = d // 64, np.uint64(d % 64)

        def xor(p, at, hop=hop, bit=bit):
            lo = padded[p][np.minimum(at + hop, width)]
            if bit:
                lo = (lo >> bit) | (padded[p][np.minimum(at + hop + 1, width)] << (np.uint64(64) - bit))
            return planes[p][at] ^ lo

        i = _bits(*within_radius(xor, valid, radius))
        if len(i):
            out.append((cls[i], cls[i + d]))
    return out


def compare_chunks(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], radius: int, same: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs within the radius of an entry of ``a`` and one of ``b``; within one chunk each pair once."""
    (ca, sa), (cb, sb) = a, b
    planes, out = _planes(sb), []
    bits = np.unpackbits(np.ascontiguousarray(sa).view(np.uint8).reshape(len(sa), 16), axis=1, bitorder="little")
    ones = np.where(bits, ~np.uint64(0), np.uint64(0))
    width = planes.shape[1]
    for lo in range(0, len(ca), 64):  # 64 rows of a against all of b
        q = ones[lo : lo + 64]
        pair = ca[lo : lo + 64, None] != cb[None, :]
        if same:
            pair &= np.arange(lo, lo + len(q))[:, None] < np.arange(len(cb))[None, :]
        full = np.zeros((len(q), width * 64), np.uint8)
        full[:, : len(cb)] = pair
        valid = np.packbits(full, axis=1, bitorder="little").view(np.uint64).ravel()
        hit = _bits(*within_radius(lambda p, at, q=q: planes[p][at % width] ^ q[at // width, p], valid, radius))
        if len(hit):
            out.append((ca[lo + hit // (width * 64)], cb[hit % (width * 64)]))
    return out


_BLOCK = "a long, b long, key long, chunk int, n int, packed binary"


def _found_batch(pairs):
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    u = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    none = lambda t: pa.nulls(len(u), t)
    return pa.record_batch([pa.array(u[:, 0]), pa.array(u[:, 1]), none(pa.int64()), none(pa.int32()), none(pa.int32()), none(pa.binary())], names=["a", "b", "key", "chunk", "n", "packed"])


def _chunk_batch(key: int, number: int, cls: np.ndarray, s: np.ndarray):
    none = pa.nulls(1, pa.int64())
    return pa.record_batch([none, none, pa.array([key]), pa.array([number], pa.int32()), pa.array([len(cls)], pa.int32()), pa.array([cls.tobytes() + s.tobytes()], pa.binary())], names=["a", "b", "key", "chunk", "n", "packed"])


def _unpack(x: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(x, np.int64, n), np.frombuffer(x, np.int64, 2 * n, 8 * n).reshape(n, 2)


def _blocks(batches, radius: int, most: int):
    """Compare the runs of a stream sorted by key; longer runs than ``most`` leave as chunks."""
    left, hot, chunk, side = None, None, 0, SIDE * most

    def done(key, cls, s, last):
        """Complete runs; of a run that began as chunks the rest is a chunk too."""
        nonlocal hot, chunk
        if hot is not None and len(key) and key[0] == hot:
            end = int(np.searchsorted(key, hot, "right"))
            yield _chunk_batch(hot, chunk, cls[:end], s[:end])
            key, cls, s, hot = key[end:], cls[end:], s[end:], None
        order = np.lexsort((cls, key))
        key, cls, s = key[order], cls[order], s[order]
        if len(key):
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])))
            key, cls, s = key[new], cls[new], s[new]
            begin = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0]
            size = np.diff(np.append(begin, len(key)))
            for i in np.nonzero(size > most)[0]:
                for c, lo in enumerate(range(begin[i], begin[i] + size[i], side)):
                    hi = min(lo + side, begin[i] + size[i])
                    yield _chunk_batch(int(key[begin[i]]), c, cls[lo:hi], s[lo:hi])
            small = np.repeat(size <= most, size)
            if pairs := compare_runs(key[small], cls[small], s[small], radius):
                yield _found_batch(pairs)

    for batch in batches:
        key, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        s = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()], axis=1)
        if left is not None:
            key, cls, s = np.concatenate([left[0], key]), np.concatenate([left[1], cls]), np.concatenate([left[2], s])
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1], "left"))
        yield from done(key[:cut], cls[:cut], s[:cut], False)
        key, cls, s = key[cut:], cls[cut:], s[cut:]
        while len(key) > side:
            if hot != key[0]:
                hot, chunk = int(key[0]), 0
            yield _chunk_batch(hot, chunk, cls[:side], s[:side])
            key, cls, s, chunk = key[side:], cls[side:], s[side:], chunk + 1
        left = (key, cls, s)
    if left is not None:
        yield from done(*left, True)


def _tiles(batches, radius: int):
    """Compare the chunks of each tile; rows are sorted by tile, one or two of each."""
    tile, first = None, None
    for batch in batches:
        for r in batch.to_pylist():
            at = (r["key"], r["c1"], r["c2"])
            chunk = _unpack(r["packed"], r["n"])
            if at != tile:
                tile, first = at, chunk
                if r["c1"] != r["c2"]:
                    continue
            pairs = compare_chunks(first, chunk, radius, r["c1"] == r["c2"])
            if pairs:
                a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _verify(batches, shingle: int, threshold: float):
    cache = WordHashes()
    for batch in batches:
        for off in range(0, batch.num_rows, 2048):
            b = batch.slice(off, 2048)
            n = b.num_rows
            sets, counts = shingle_sets([words(t) for c in (2, 3) for t in b.column(c).to_pylist()], shingle, cache)
            pair = np.repeat(np.arange(2 * n) % n, counts).astype(np.uint64)
            both = np.sort((pair << np.uint64(48)) | sets)
            twice = both[1:][both[1:] == both[:-1]] if len(both) else both
            shared = np.bincount((twice >> np.uint64(48)).astype(np.int64), minlength=n)
            sim = shared / np.maximum(counts[:n] + counts[n:] - shared, 1)
            ok = np.nonzero(sim >= threshold)[0]
            if len(ok):
                yield pa.record_batch([b.column(0).take(pa.array(ok)), b.column(1).take(pa.array(ok)), pa.array(sim[ok])], names=["a", "b", "similarity"])


def _salt(column: str):
    return F.pmod(F.xxhash64(column), F.lit(_SALTS)).cast("int")


def _copies() -> list:
    """A copy of a row for each salt: a label that many classes share is looked up in many tasks."""
    return [F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")]


class NearDuplicates:
    """Classes of equal shingle sets and the verified links between them.

    ``records`` has the columns ``table_name``, ``id`` and ``text``; records of different tables are never linked.
    Null texts and texts of fewer than ``least_words`` words (or than one shingle) belong to no class. Other columns are
    ignored. Two texts are linked when their similarity is at least ``threshold``; an empty input gives empty results.
    """

    def __init__(self, records: DataFrame, shingle: int = 5, threshold: float = 0.8, least_words: int = 1, bands: int = 32, rows: int = 3, radius: int | None = None, most: int = 1024):
        self.shingle, self.threshold, self.most = shingle, threshold, most
        expect = PLANES * (1 - threshold) / 2
        self.radius = radius if radius is not None else int(expect + 3.3 * (PLANES * (1 - threshold) / 2 * (1 + threshold) / 2) ** 0.5 + 0.5)
        self.records = records.select(F.col("table_name").cast("string").alias("table_name"), F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null and id is not null")
        self.signatures = materialize(
            self.records.mapInArrow(lambda it: _signatures(it, shingle, least_words, bands, rows), "table_name string, id long, cls long, keys array<long>, s0 long, s1 long"),
            "signatures",
        )
        self.members = self.signatures.select("table_name", "id", "cls")

    def representatives(self) -> DataFrame:
        """(table_name, cls, id, copies): the smallest id of each class and the number of its records."""
        return self.members.groupBy("cls").agg(F.first("table_name").alias("table_name"), F.min("id").alias("id"), F.count("*").alias("copies"))

    def candidates(self) -> DataFrame:
        """(a, b): classes within the radius in some block, each pair once."""
        radius, most = self.radius, self.most
        entries = self.signatures.select(F.explode("keys").alias("key"), "cls", "s0", "s1")
        blocks = materialize(entries.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _blocks(it, radius, most), _BLOCK), "blocks")
        small = blocks.where("packed is null").select("a", "b")
        chunks = blocks.where("packed is not null").select("key", "chunk", "n", "packed")
        if chunks.limit(1).count():
            many = chunks.groupBy("key").agg(F.count("*").alias("many"))
            x = chunks.join(many, "key").repartition("key", "chunk").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many").cast("int") - 1)))
            tiles = x.select("key", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"), "n", "packed").repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2")
            small = small.union(tiles.mapInArrow(lambda it: _tiles(it, radius), "a long, b long"))
        return small.distinct()

    def links(self) -> DataFrame:
        """(a, b, similarity): every pair of classes of at least the threshold, verified on the texts of their representatives."""
        shingle, threshold = self.shingle, self.threshold
        pairs = materialize(self.candidates(), "candidates")
        needed = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
        texts = self.records.join(self.representatives().join(needed, "cls", "left_semi").select("cls", "table_name", "id"), ["table_name", "id"]).select("cls", "text").groupBy("cls").agg(F.first("text").alias("text"))
        texts = materialize(texts, "texts")
        joined = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
        return materialize(joined.select("a", "b", "ta", "tb").mapInArrow(lambda it: _verify(it, shingle, threshold), "a long, b long, similarity double"), "links")

    def ranked(self) -> DataFrame:
        """(table_name, id, cls, place): the place of each record among those of its class, by id, from 1."""
        reps = materialize(self.representatives(), "representatives")
        copies = self.members.join(reps.where("copies > 1").select("cls"), "cls", "left_semi").groupBy("table_name", "cls", "id").agg(F.lit(1).alias("one"))
        places = running_counts(copies, ["cls"], "id", "one").select("table_name", "id", "cls", F.col("upto").cast("long").alias("place"))
        return places.union(reps.where("copies = 1").select("table_name", "id", "cls", F.lit(1).cast("long")))

    def found(self, expand: int = 64) -> DataFrame:
        """(table_name, id_a, id_b): the linked pairs of records, ``id_a < id_b``.

        Of a class every record is paired with the ``expand`` records before it, by id; of two linked classes the first
        ``expand`` records of either are paired with one another. So all pairs come out of classes of no more copies, and of
        larger groups of copies enough to tie all records together: no link between different texts is lost, and the result grows with
        the records, not with their square. ``groups`` gives the membership of all.
        """
        x = materialize(self.ranked(), "places")
        block = F.floor(F.col("place") / expand)
        late = x.select("cls", "table_name", F.col("id").alias("id_b"), F.col("place").alias("later"), F.explode(F.array(block, block - 1)).alias("block"))
        early = x.select("cls", F.col("id").alias("id_a"), "place", block.alias("block"))
        inner = early.join(late, ["cls", "block"]).where(F.col("later").between(F.col("place") + 1, F.col("place") + expand)).select("table_name", "id_a", "id_b")
        few = x.where(F.col("place") <= expand)
        a, b = few.select(F.col("cls").alias("a"), F.col("id").alias("ia"), "table_name"), few.select(F.col("cls").alias("b"), F.col("id").alias("ib"))
        outer = self.links().select("a", "b").join(a, "a").join(b, "b").select("table_name", F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
        return inner.unionByName(outer)

    def groups(self, rounds: int = 50) -> DataFrame:
        """(table_name, id, class_id, copies, links, group_id): one row a record that has at least one shingle.

        ``class_id`` is the smallest id of the records with the same shingle set, ``links`` the number of other
        classes that class is linked to, ``group_id`` the smallest id of its connected component. Components
        spread the smallest label along links and shortcut through labels, one written table a round.
        """
        links = self.links().select("a", "b")
        both = materialize(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
        reps = materialize(self.representatives(), "representatives")
        label = materialize(both.select(F.col("a").alias("cls")).distinct().select("cls", F.col("cls").alias("label")), "label")
        for _ in range(rounds):
            near = both.join(label.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("label").alias("near"))
            step = label.join(near, "cls").select("cls", "label", F.least("label", "near").alias("new"))
            far = label.select(F.col("cls").alias("new"), F.col("label").alias("far"), *_copies())
            step = materialize(step.withColumn("salt", _salt("cls")).join(far, ["new", "salt"]).select("cls", "label", F.least("new", "far").alias("new")), "label")
            moved = step.where("new < label").limit(1).count()
            label = step.select("cls", F.col("new").alias("label"))
            if not moved:
                break
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        label = materialize(label.join(reps.select("cls", "id"), "cls"), "components")
        least = label.groupBy("label").agg(F.min("id").alias("least")).select("label", "least", *_copies())
        label = label.withColumn("salt", _salt("cls")).join(least, ["label", "salt"]).select("cls", F.col("least").alias("label"))
        degree = both.groupBy(F.col("a").alias("cls")).agg(F.count("*").alias("links"))
        info = reps.select("cls", F.col("id").alias("class_id"), "copies").join(degree, "cls", "left").join(label, "cls", "left")
        return self.members.join(info, "cls").select("table_name", "id", "class_id", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("label", "class_id").alias("group_id"))
