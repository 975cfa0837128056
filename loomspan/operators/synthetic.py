"""Synthetic instructions: prompts, parsing, diversity, evolution, combination."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stems import stem
from ..scratch import materialize

# Phrases of failed evolutions.
EVOLUTION_FAILURES = ["i cannot", "i'm sorry", "as an ai", "i don't understand"]
# Requests for each kind of evolution, with the place of the instruction.
EVOLUTIONS = {
    "add_constraints": """I want you to add constraints or requirements to the given instruction, making it more complex. The new instruction should be reasonable and can be understood and responded to by humans.

Original Instruction: {instruction}

Please add constraints or requirements to the instruction to make it more complex. Only output the new instruction, nothing else.""",
    "deepen": """I want you to deepen the given instruction by asking for more depth or details. The new instruction should be reasonable and can be understood and responded to by humans.

Original Instruction: {instruction}

Please deepen the instruction by requiring more in-depth analysis or explanation. Only output the new instruction, nothing else.""",
    "concretize": """I want you to make the given instruction more concrete and specific. Replace general concepts with specific examples or scenarios.

Original Instruction: {instruction}

Please make the instruction more concrete and specific. Only output the new instruction, nothing else.""",
    "increase_reasoning": """I want you to rewrite the instruction to require more step-by-step reasoning or logical thinking.

Original Instruction: {instruction}

Please rewrite the instruction to require more reasoning and logical steps. Only output the new instruction, nothing else.""",
    "complicate_input": """I want you to complicate the input of the given instruction by adding more context, data, or conditions that need to be considered.

Original Instruction: {instruction}

Please complicate the input while keeping the core task similar. Only output the new instruction, nothing else.""",
}


def evolution_prompt(instruction: Column, kind: str) -> Column:
    head, tail = EVOLUTIONS[kind].split("{instruction}")
    return F.concat(F.lit(head), instruction, F.lit(tail))


def valid_evolution(original: Column, evolved: Column) -> Column:
    """Long enough, different, not much shorter, and without phrases of failure."""
    e = F.coalesce(evolved, F.lit(""))
    same = T.trimmed(F.lower(e)) == T.trimmed(F.lower(F.coalesce(original, F.lit(""))))
    return (F.length(e) >= 10) & ~same & (F.length(e) >= F.length(F.coalesce(original, F.lit(""))) * 0.5) & ~T.contains_any(F.lower(e), EVOLUTION_FAILURES)


def few_shot_examples(examples: Column) -> Column:
    """Numbered examples from an array of (instruction, input, output)."""
    has = lambda x: F.length(F.coalesce(x, F.lit(""))) > 0

    def one(e, i):
        return F.concat(
            F.lit("Example "), (i + 1).cast("string"), F.lit(":\n### Instruction:\n"), F.coalesce(e["instruction"], F.lit("")),
            F.when(has(e["input"]), F.concat(F.lit("\n\n### Input:\n"), e["input"])).otherwise(""), F.when(has(e["output"]), F.concat(F.lit("\n\n### Output:\n"), e["output"])).otherwise(""),
        )

    return F.array_join(F.transform(examples, one), "\n\n")


def response_prompt(instruction: Column, extra: Column) -> Column:
    return F.concat(F.lit("Instruction: "), instruction, F.when(F.length(F.coalesce(extra, F.lit(""))) > 0, F.concat(F.lit("\n\nInput: "), extra)).otherwise(""), F.lit("\n\nResponse:"))


def section(text: Column, name: str) -> Column:
    """The body of a ``### Name`` section, empty if there is none."""
    return T.trimmed(F.regexp_extract(text, rf"(?is)###\s*{name}:?\s*\n(.*?)(?=###|\z)", 1))


def parse_instruction(text: Column) -> Column:
    """A struct (instruction, input, output); null without an instruction."""
    i, x, o = section(text, "Instruction"), section(text, "Input"), section(text, "Output")
    blank = F.when(x.isin("N/A", "None", "none"), "").otherwise(x)
    return F.when(F.length(i) > 0, F.struct(i.alias("instruction"), blank.alias("input"), o.alias("output")))


def rouge_l(a: list[str], b: list[str]) -> float:
    """F1 of the longest common subsequence of two word lists."""
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    lcs = row[-1]
    return 0.0 if not lcs else 2 * lcs / (len(a) + len(b))


class _Stems(dict):
    """Stems of words of more than three letters; shorter ones stay. Emptied when it has grown too large."""

    def __missing__(self, w: str) -> str:
        if len(self) >= 500_000:
            self.clear()
        x = self[w] = stem(w) if len(w) > 3 else w
        return x


def _common(a: Counter, b: Counter) -> int:
    if len(a) > len(b):
        a, b = b, a
    return sum(min(n, b[w]) for w, n in a.items() if w in b)


def diverse(df: DataFrame, id_column: str = "id", text_column: str = "instruction", limit: float = 0.7, history: int = 100, shards: int | None = None, rows: int = 2000) -> DataFrame:
    """Rows that are not too similar (F1 of the longest common subsequence of word stems) to any of the last ``history`` accepted ones before them (in the order of ids).

    The rule is sequential. Chunks of at most ``rows`` rows in order are judged at once, at first as if nothing came before
    them; a chunk is judged again while the accepted rows it began with aren't those its predecessor ends with, up to where its
    earlier decisions must follow. The result depends neither on ``rows`` nor on ``shards``, the ranges that are sorted at once.
    """
    kinds = dict(df.dtypes)
    schema = f"chunk long, kind int, r long, id {kinds[id_column]}, text string, keep boolean, digest string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, own = pdf[pdf["kind"] == 1].sort_values("r"), pdf[pdf["kind"] == 0].sort_values("r")
        k = int(own["chunk"].iloc[0])
        ends = list(zip(state["id"], state["text"]))
        digest = lambda x: hashlib.sha1(repr([(str(i), t) for i, t in x]).encode()).hexdigest() if x else ""
        began, stems = digest(ends), _Stems()

        def entry(t):
            ws = [stems[w] for w in re.findall(r"[a-z0-9]+", (t or "").lower())]
            return ws, Counter(ws)

        window = deque((entry(t) for _, t in ends), maxlen=history)
        keep, agreed, earlier = [], 0, own["keep"].tolist()
        for t, old in zip(own["text"], earlier):
            if agreed >= history:  # the last accepted rows are those of the earlier run, so the rest is as well
                keep += earlier[len(keep) :]
                break
            ws, bag = entry(t)
            # lengths and words in common bound the subsequence from above
            ok = all(2 * min(len(ws), len(x)) <= (most := limit * (len(ws) + len(x))) or 2 * _common(bag, b) <= most or rouge_l(ws, x) <= limit for x, b in window)
            keep.append(ok)
            agreed = 0 if old is None or bool(old) != ok else agreed + ok
            if ok:
                window.append((ws, bag))
        ends = (ends + [e for e, ok in zip(zip(own["id"], own["text"]), keep) if ok])[-history:]
        decided = own.assign(keep=[bool(x) for x in keep], digest=began)
        tail = pd.DataFrame({"chunk": k + 1, "kind": 1, "r": range(len(ends)), "id": [i for i, _ in ends], "text": [t for _, t in ends], "keep": None, "digest": digest(ends)})
        return pd.concat([decided.astype({"keep": object}), tail.astype({"keep": object})])[list(pdf.columns)]

    n = shards or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = materialize(df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).repartitionByRange(n, "id").withColumn("part", F.spark_partition_id()), "ordered")
    chunks = x.groupBy("part").agg(F.ceil(F.count("*") / rows).alias("c"))  # a row a range
    before = chunks.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"))
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("id", "text")).cast("long")).join(F.broadcast(before), "part")
    x = x.select((F.col("before") + F.floor((F.col("r") - 1) / rows)).cast("long").alias("chunk"), F.lit(0).alias("kind"), "r", "id", "text", F.lit(None).cast("boolean").alias("keep"), F.lit("").alias("digest"))
    judged = materialize(x.groupBy("chunk").applyInPandas(run, schema), "judged")
    while True:
        used = judged.where("kind = 0").select("chunk", F.col("digest").alias("used")).distinct()
        stale = materialize(judged.where("kind = 1").select("chunk", "digest").distinct().join(used, "chunk").where("digest <> used").select("chunk"), "stale")
        if stale.isEmpty():
            return judged.where("kind = 0 and keep").select(F.col("id").alias(id_column), F.col("text").alias(text_column))
        again = judged.join(stale, "chunk", "left_semi").groupBy("chunk").applyInPandas(run, schema)
        rest = judged.withColumn("by", F.col("chunk") - F.col("kind")).join(stale.withColumnRenamed("chunk", "by"), "by", "left_anti").drop("by")
        judged = materialize(rest.unionByName(again), "judged")


def combine(generated: DataFrame, evolved: DataFrame) -> DataFrame:
    """Generated rows and truly evolved ones (depth above 0) with their source."""
    a = generated.withColumn("source", F.lit("self_instruct"))
    b = evolved.where("evolution_depth > 0").withColumn("source", F.lit("evol_instruct"))
    return a.unionByName(b, allowMissingColumns=True)


def evolve(df: DataFrame, generator, kinds: Iterable[str], id_column: str = "id", text_column: str = "instruction", most: int | None = None) -> DataFrame:
    """Originals (depth 0) and the chain of valid evolutions by a generator (prompts to texts), one round a kind; a chain stops at its first failure.

    With ``most`` the rounds stop once there are as many rows, and the first ``most`` in the order of depth and id are given.
    """
    from .models import generate

    level = df.select(id_column, F.col(text_column).alias("instruction"), F.lit(0).alias("evolution_depth"), F.lit(None).cast("string").alias("evolution_type"))
    out, have = level, level.count() if most is not None else 0
    for depth, kind in enumerate(kinds, 1):
        if most is not None and have >= most:
            break
        x = generate(level.withColumn("__prompt", evolution_prompt(F.col("instruction"), kind)), generator, "__prompt", "__new")
        level = x.where(valid_evolution(F.col("instruction"), F.col("__new"))).select(id_column, F.col("__new").alias("instruction"), F.lit(depth).alias("evolution_depth"), F.lit(kind).alias("evolution_type"))
        if most is not None:
            level = materialize(level, "evolved")  # counted, and the ground of the next round
            have += level.count()
        out = out.unionByName(level)
    return out if most is None else out.orderBy("evolution_depth", id_column).limit(most)


def sample_examples(seeds: DataFrame, generated: DataFrame | None, k: int, salt: int = 0, recent: int = 20) -> DataFrame:
    """(instruction, input, output): ``k`` examples, no more than there are seeds, drawn by a hash from the seeds and the ``recent`` last generated instructions (by ``seq``)."""
    pool = seeds.select("instruction", F.coalesce("input", F.lit("")).alias("input"), F.coalesce("output", F.lit("")).alias("output"))
    if generated is not None:
        last = generated.orderBy(F.desc("seq")).limit(recent).select("instruction", F.lit("").alias("input"), F.lit("").alias("output"))
        pool = pool.unionByName(last)
    return pool.orderBy(F.md5(F.concat_ws(":", "instruction", F.lit(str(salt)))), "instruction").limit(min(k, seeds.count()))


def generation_prompt(examples: DataFrame, head: str = "Come up with a new task, in the form of these examples.\n\n") -> str:
    """One request from a few examples (a handful of rows)."""
    rows = F.array_sort(F.collect_list(F.struct("instruction", "input", "output")))
    one = examples.agg(rows.alias("e")).select(few_shot_examples(F.col("e"))).first()[0]
    return f"{head}{one}\n\n### Instruction:\n"


def generate_until(seeds: DataFrame, generator, wanted: int, examples: int = 3, per_round: int = 64, rounds: int = 50, retries: int = 3, limit: float = 0.7, respond=None) -> DataFrame:
    """(seq, instruction, input, output): ``wanted`` new instructions that parse and are diverse, in rounds of ``per_round`` requests.

    A request that doesn't parse is asked again, up to ``retries`` times. Every round draws other examples; what it accepts is
    written, and judged for diversity after all that were accepted before. Missing outputs come from ``respond``, if given. Fewer
    rows come out when the rounds run out.
    """
    from .models import generate

    spark, have, accepted = seeds.sparkSession, 0, None
    for k in range(rounds):
        if have >= wanted:
            break
        asks = [(k * per_round + i, generation_prompt(sample_examples(seeds, accepted, examples, k * 7 + i % 7))) for i in range(min(per_round, 7))]  # seven draws of examples a round
        todo = spark.createDataFrame([(k * per_round + i, asks[i % len(asks)][1]) for i in range(per_round)], "seq long, prompt string")
        good = None
        for _ in range(retries):
            x = materialize(generate(todo, generator, "prompt", "raw").withColumn("p", parse_instruction(F.col("raw"))), "generated")
            ok = x.where("p is not null").select("seq", "p.instruction", "p.input", "p.output")
            good, todo = (ok if good is None else good.unionByName(ok)), x.where("p is null").select("seq", "prompt")
            if todo.isEmpty():
                break
        new = good if accepted is None else accepted.unionByName(good)
        keep = diverse(new.select(F.col("seq").alias("id"), "instruction"), limit=limit).select(F.col("id").alias("seq"))
        accepted = materialize(new.join(keep, "seq", "left_semi"), "accepted")
        have = accepted.count()
    if accepted is None:
        return spark.createDataFrame([], "seq long, instruction string, input string, output string")
    out = accepted.orderBy("seq").limit(wanted)
    if respond is not None:
        x = generate(out.withColumn("__ask", response_prompt(F.col("instruction"), F.col("input"))), respond, "__ask", "__answer")
        out = x.withColumn("output", F.when(F.length("output") > 0, F.col("output")).otherwise(F.col("__answer"))).drop("__ask", "__answer")
    return out
