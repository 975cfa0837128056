"""Deduplication: exact by hash, near by min-hash bands, exact Jaccard pairs by a prefix filter."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import WordHashes, shingle_hashes
from ..scratch import materialize


def exact_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Add ``duplicate``: false for the first row of each text in the order of ids. Null texts are each their own.

    The first id of a text comes from a partial aggregation, so a text repeated very often meets no single task.
    """
    h = F.sha2(text_column, 256)
    first = df.where(F.col(text_column).isNotNull()).groupBy(h.alias("__h")).agg(F.min(id_column).alias("__first"))
    x = df.withColumn("__h", h).join(first, "__h", "left")
    return x.withColumn("duplicate", F.coalesce(F.col("__first") < F.col(id_column), F.lit(False))).drop("__h", "__first")


def exact_dedup(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return exact_duplicates(df, id_column, text_column).where(~F.col("duplicate")).drop("duplicate")


def signatures(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", permutations: int = 128, ngram: int = 5, seed: int = 42) -> DataFrame:
    """(id, signature): min-hashes of the shingles of each text that isn't null."""
    r = np.random.default_rng(seed)
    a, b = r.integers(1, 2**31, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, permutations, dtype=np.uint64)

    def run(batches):
        for batch in batches:
            out, cache = [], WordHashes()
            for t in batch.column(1).to_pylist():
                x = shingle_hashes(t.lower().split(), ngram, cache)
                out.append(((x[:, None] * a + b) >> np.uint64(32)).min(axis=0).astype(np.int64))
            flat = np.concatenate(out) if out else np.empty(0, np.int64)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, permutations, dtype=np.int32)), pa.array(flat))], names=["id", "signature"])

    return df.where(F.col(text_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, "id long, signature array<long>")


def bands_for(threshold: float, permutations: int) -> tuple[int, int]:
    """Bands and rows with the least false positives plus false negatives at a threshold."""
    best, out = math.inf, (1, permutations)
    grid = (np.arange(1000) + 0.5) / 1000
    for b in range(1, permutations + 1):
        for r in range(1, permutations // b + 1):
            hit = 1 - (1 - grid**r) ** b
            e = hit[grid < threshold].sum() + (1 - hit[grid >= threshold]).sum()
            if e < best:
                best, out = e, (b, r)
    return out


def band_table(sig: DataFrame, bands: int = 9, rows: int = 13) -> DataFrame:
    """(band, key, id): the persisted index of near-duplicate search."""
    keys = F.array(*(F.xxhash64(F.slice("signature", k * rows + 1, rows)) for k in range(bands)))
    return sig.select("id", F.posexplode(keys).alias("band", "key"))


def bucket_drops(table: DataFrame) -> DataFrame:
    """(id): rows dropped when each in the order of ids is dropped if it shares a bucket with an earlier kept one.

    Rounds over buckets of several open rows: a row that is the smallest of each of its buckets is kept and drops the
    others of them. The smallest open row always is, so the rounds come to an end, and no pairs are listed.
    """
    spark = table.sparkSession
    out = spark.createDataFrame([], "id long")
    alive = materialize(table.select("band", "key", F.col("id").cast("long").alias("id")).distinct(), "buckets")
    while True:
        firsts = alive.groupBy("band", "key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        x = materialize(alive.join(firsts, ["band", "key"]), "buckets")
        if x.isEmpty():
            return out
        kept = x.groupBy("id").agg(F.bool_and(F.col("id") == F.col("first")).alias("kept")).where("kept").select("id")
        dropped = materialize(x.join(kept.withColumnRenamed("id", "first"), "first", "left_semi").where("id > first").select("id").distinct(), "dropped")
        out = out.union(dropped)
        alive = x.select("band", "key", "id").join(dropped, "id", "left_anti").join(kept, "id", "left_anti")


def save_index(index: DataFrame, path: str) -> None:
    """Add bands to a stored index."""
    index.write.mode("append").parquet(path)


def reset_index(spark, path: str) -> bool:
    """Delete a stored index; whether there was one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))


def query_similar(index: DataFrame, probes: DataFrame, bands: int = 9, rows: int = 13) -> DataFrame:
    """(probe, id): indexed rows that share a bucket with a probe (signatures)."""
    p = band_table(probes, bands, rows).withColumnRenamed("id", "probe")
    return p.join(index, ["band", "key"]).select("probe", "id").distinct()


def _shingle_rows(df: DataFrame, ngram: int, id_column: str, text_column: str) -> DataFrame:
    """(id, key, s): the sorted shingle hashes of each text that isn't null, and a digest of them."""
    ws = df.where(F.col(text_column).isNotNull()).select(F.col(id_column).alias("id"), T.words(F.col(text_column)).alias("ws"))
    sets = ws.select("id", F.array_sort(F.array_distinct(F.transform(T.shingles(F.col("ws"), ngram), lambda s: F.xxhash64(s)))).alias("s"))
    return sets.select("id", F.sha2(F.array_join(F.transform("s", lambda x: x.cast("string")), ","), 256).alias("key"), "s")


def _set_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of at least the threshold among different sets (id, s, n)."""
    each = sets.select("id", "n", F.explode("s").alias("g"))
    df_ = each.groupBy("g").agg(F.count("*").alias("df"))
    ranked = each.join(df_, "g").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("df", "g")))
    prefix = ranked.where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1) & (F.col("df") > 1)).select("g", "id", "n")
    a, b = prefix.select("g", F.col("id").alias("a"), F.col("n").alias("na")), prefix.select("g", F.col("id").alias("b"), F.col("n").alias("nb"))
    cand = a.join(b, "g").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))).select("a", "b").distinct()
    x = cand.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return x.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("similarity")).where(F.col("similarity") >= threshold)


def jaccard_classes(df: DataFrame, threshold: float = 0.8, ngram: int = 5, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Membership (id, class) of each text that isn't null, and the pairs of ``jaccard_pairs``, whose ids are classes.

    A class is a shingle set, named by its smallest id: its members have similarity 1 to one another and the same to any other text.
    """
    rows = materialize(_shingle_rows(df, ngram, id_column, text_column), "shingles")
    sets = materialize(rows.groupBy("key").agg(F.min("id").alias("id"), F.first("s").alias("s")).withColumn("n", F.size("s")), "sets")
    return rows.select("id", "key").join(sets.select("key", F.col("id").alias("class")), "key").select("id", "class"), _set_pairs(sets, threshold)


def jaccard_pairs(df: DataFrame, threshold: float = 0.8, ngram: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(a, b, similarity): pairs of *different shingle sets* of at least the threshold, a and b being the smallest ids of their sets.

    Shingles are ordered by rarity; two sets above the threshold share one of their first n - ceil(t * n) + 1. Sets
    that are equal are one entry, so copies cost nothing; ``jaccard_classes`` also gives who is in which set.
    """
    return jaccard_classes(df, threshold, ngram, id_column, text_column)[1]


def jaccard_keep(df: DataFrame, threshold: float = 0.8, ngram: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id): rows kept when each in the order of ids is dropped if similar to an earlier kept one. Null texts are kept.

    The first row of a class decides for it: the others are dropped, as it or what dropped it is similar to them too.
    """
    members, pairs = jaccard_classes(df, threshold, ngram, id_column, text_column)
    kept = greedy_keep(members.select(F.col("class").alias("id")).distinct(), pairs)
    return kept.union(df.where(F.col(text_column).isNull()).select(F.col(id_column).alias("id")))


def greedy_keep(ids: DataFrame, edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(id): rows kept when each in the order of ids is dropped if linked to an earlier kept one.

    Rounds: a row without an undecided or kept earlier neighbour is kept; one with a kept earlier neighbour is dropped.
    """
    e = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = materialize(e.select(F.col("a").alias("id")).union(e.select("b")).distinct().withColumn("kept", F.lit(None).cast("boolean")), "state")
    for _ in range(rounds):
        if not state.where("kept is null").limit(1).count():
            break
        near = e.join(state.withColumnRenamed("id", "a").withColumnRenamed("kept", "ka"), "a").groupBy(F.col("b").alias("id")).agg(F.bool_or(F.coalesce("ka", F.lit(False))).alias("hit"), F.bool_or(F.col("ka").isNull()).alias("open"))
        x = state.join(near, "id", "left")
        decided = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("hit", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True))
        state = materialize(x.select("id", decided.alias("kept")), "state")
    else:
        raise RuntimeError(f"undecided rows after {rounds} rounds")
    return ids.join(state.where("not kept").select("id"), "id", "left_anti")


def minhash_dedup(df: DataFrame, threshold: float = 0.8, permutations: int = 128, ngram: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows that remain when near-duplicates of earlier kept rows are dropped."""
    bands, rows = bands_for(threshold, permutations)
    dropped = bucket_drops(band_table(signatures(df, id_column, text_column, permutations, ngram), bands, rows))
    keep = df.select(F.col(id_column).cast("long").alias("id")).join(dropped, "id", "left_anti")
    return df.join(keep.withColumnRenamed("id", id_column), id_column, "left_semi")
