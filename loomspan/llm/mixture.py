"""Sources mixed to target weights, by a multivariate-hypergeometric splitting tree.

Sizes are tokens of a public tokenizer. The documents of a source fall by a hash into blocks of about ``block_tokens``; as
many whole rounds of all blocks as fit are used, then blocks in a drawn order, and of the last of these the documents that
still fit. So every source comes within one document of its quota. The uses of blocks (units) are dealt to the output
shards: a binary tree over the shards splits the exact numbers of units of all sources by multivariate-hypergeometric
draws; every leaf takes its numbers from the permuted units of each source, disjoint from those of other leaves. Within a
shard documents are shuffled by a hash. Blocks and units are tables: their drawn orders are running counts over ranges of
a hash. The driver holds numbers by source and shard only.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import running_counts
from ..scratch import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def source_name(column: str = "source"):
    """One spelling of a source: lower case, no blanks around, underscores between."""
    return F.regexp_replace(F.lower(F.trim(column)), "[- ]", "_")


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens): tokens of each text; a null text has none. The executors need no copy of the file."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(spec.value)
        t.encode_special_tokens = True  # special tokens in a text are ordinary text
        for batch in batches:
            for off in range(0, batch.num_rows, 1000):
                b = batch.slice(off, 1000)
                texts = [x or "" for x in b.column(2).to_pylist()]
                n = [len(e) for e in t.encode_batch(texts, add_special_tokens=False)]
                yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    src = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_name().alias("source"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, source string, tokens long")


def split_quotas(units: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Units of each source for each shard: rows are shards, columns sources, column sums ``units``."""
    out = np.zeros((shards, len(units)), np.int64)

    def node(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        total = int(have.sum())
        take = round(total * (mid - lo) / (hi - lo))
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if total else have
        node(lo, mid, left)
        node(mid, hi, have - left)

    node(0, shards, np.asarray(units, np.int64))
    return out


@dataclass
class Quota:
    source: str
    share: float
    most: int
    have: int
    want: float = 0.0

    @property
    def rounds(self) -> int:
        return int(min(self.want / self.have, self.most)) if self.have else 0

    @property
    def rest(self) -> float:
        return 0.0 if self.rounds >= self.most else max(0.0, self.want - self.rounds * self.have)


def quotas(have: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> list[Quota]:
    """What each source is to give. Without a total, the largest at which all sources that have documents reach their shares.

    A source that can't give its share under a given total gives what it may; targets of sources without documents stay empty.
    """
    out = [Quota(s, float(w), int(m), int(have.get(s, 0))) for s, w, m in targets if s is not None and w and w > 0 and m and m > 0]
    able = [q for q in out if q.have]
    if total is None:
        total = min((q.most * q.have / q.share for q in able), default=0.0)
    for q in able:
        q.want = min(total * q.share, q.most * q.have)
    return out


class Mixture:
    """A drawn mixture of ``documents`` (doc_id, source, text) to ``targets`` (source, target_share, max_repeats).

    Documents of null sources, of sources without a target or without tokens are not used. Repeated rows count as
    several documents; other columns are ignored. Without documents or targets all results are empty. Targets are one
    row a source.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total: float | None = None, shards: int = 16, seed: int = 7, tokenizer: str = TOKENIZER, block_tokens: int = 5_000):
        self.shards, self.seed = shards, seed
        spark = documents.sparkSession
        goals = [(r[0], r[1], r[2]) for r in targets.select(source_name(), "target_share", "max_repeats").collect()]  # one row a source
        tokens = materialize(token_counts(documents, tokenizer).where("source is not null and tokens > 0 and doc_id is not null"), "tokens")
        names = spark.createDataFrame([(s,) for s in sorted({g[0] for g in goals if g[0]})], "source string")
        used = tokens.join(F.broadcast(names), "source", "left_semi")  # a row a target
        have = {r[0]: r[1] for r in used.groupBy("source").agg(F.sum("tokens")).collect()}  # a row a target
        self.quotas = quotas(have, goals, total)
        plan = spark.createDataFrame([(q.source, max(1, q.have // block_tokens), q.rounds, float(q.rest)) for q in self.quotas], "source string, blocks long, rounds int, rest double")
        plan = F.broadcast(plan)  # a row a target
        docs = used.join(plan.select("source", "blocks"), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks"))).drop("blocks")
        blocks = docs.groupBy("source", "block").agg(F.sum("tokens").alias("size")).withColumn("drawn", F.struct(F.xxhash64("block", F.lit(seed + 3)), "block"))
        order = running_counts(blocks, ["source"], "drawn", "size").join(plan, "source").withColumn("before", F.col("upto") - F.col("size"))
        uses = F.transform(F.sequence(F.lit(1), F.col("rounds") + (F.col("before") < F.col("rest")).cast("int")), lambda c: F.struct(c.alias("copy"), F.when((c > F.col("rounds")) & (F.col("upto") > F.col("rest")), F.col("rest") - F.col("before")).alias("room")))
        units = order.where((F.col("rounds") > 0) | (F.col("before") < F.col("rest"))).select("source", "block", F.explode(uses).alias("use")).select("source", "block", "use.copy", "use.room")
        units = materialize(units.withColumn("drawn", F.struct(F.xxhash64("block", "copy", F.lit(seed + 4)), "block", "copy")).withColumn("one", F.lit(1)), "units")
        number = {r[0]: r[1] for r in units.groupBy("source").count().collect()}  # a row a target
        sources = sorted(number)
        deal = split_quotas(np.array([number[s] for s in sources], np.int64), shards, np.random.default_rng(seed))
        ends = spark.createDataFrame([(s, np.cumsum(deal[:, k]).tolist()) for k, s in enumerate(sources)], "source string, ends array<long>")
        shard = F.size(F.filter("ends", lambda e: e < F.col("upto")))  # the leaf that the unit's place falls to
        dealt = running_counts(units, ["source"], "drawn", "one").join(F.broadcast(ends), "source").select("source", "block", "copy", "room", shard.alias("shard"))
        placed = docs.join(dealt, ["source", "block"])
        whole = placed.where("room is null").drop("room")
        # of the last block of a source the documents that fit, by a drawn order; one block a source, of about block_tokens
        w = Window.partitionBy("source").orderBy("order", "doc_id")
        part = placed.where("room is not null").withColumn("order", F.xxhash64("doc_id", F.lit(seed + 1))).withColumn("upto", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        part = part.where(F.col("upto") - F.col("tokens") / 2 <= F.col("room")).select(*whole.columns)
        self.placed = materialize(whole.unionByName(part), "placed")

    def chosen(self) -> DataFrame:
        """(doc_id, source, tokens, times): every chosen document and how often it is used."""
        return self.placed.groupBy("doc_id", "source").agg(F.max("tokens").alias("tokens"), F.count("*").alias("times"))

    def layout(self) -> DataFrame:
        """(shard, place, doc_id, copy, source, tokens): the output order, shuffled within each shard."""
        x = self.placed.select("shard", F.xxhash64("doc_id", "copy", F.lit(self.seed + 2)).alias("place"), "doc_id", "copy", "source", "tokens")
        return x.repartition("shard").sortWithinPartitions("shard", "place")

    def shares(self) -> DataFrame:
        """(source, target_share, share, tokens, documents, uses, max_times): what every target source really gives."""
        spark = self.placed.sparkSession
        goals = spark.createDataFrame([(q.source, q.share, q.want) for q in self.quotas], "source string, target_share double, wanted double")
        got = self.chosen().groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.count("*").alias("documents"), F.sum("times").alias("uses"), F.max("times").alias("max_times"))
        total = got.agg(F.sum("tokens")).first()[0] or 0
        n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return goals.join(got, "source", "left").select("source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.lit(max(total, 1))).alias("share"), n("tokens"), n("documents"), n("uses"), n("max_times"))
