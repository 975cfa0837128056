"""Preference pairs from ratings, rankings and other shapes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import materialize
from .models import Generator, Scorer, generate, score
from .ordering import running_counts

# Fixed value: form of a rating in a judge's answer.
RATING = r"Response {side}:\s*(\d+(?:\.\d+)?)"


def pairs_from_ratings(items: DataFrame, margin: float = 1.0) -> DataFrame:
    """(prompt, chosen, rejected, chosen_score, rejected_score) of rated items (prompt, response, rating, seq).

    Every two items of a prompt whose ratings differ by at least the margin; with a margin of 0 or less, ties go by ``seq``.
    An equi-join on the prompt with a range condition; AQE splits a prompt that holds many rows.
    """
    a = items.select("prompt", F.col("response").alias("chosen"), F.col("rating").alias("chosen_score"), F.col("seq").alias("sa"))
    b = items.select("prompt", F.col("response").alias("rejected"), F.col("rating").alias("rejected_score"), F.col("seq").alias("sb"))
    first = (F.col("chosen_score") > F.col("rejected_score")) | ((F.col("chosen_score") == F.col("rejected_score")) & (F.col("sa") < F.col("sb")))
    return a.join(b, "prompt").where((F.col("chosen_score") - F.col("rejected_score") >= margin) & (F.col("sa") != F.col("sb")) & first).select("prompt", "chosen", "rejected", "chosen_score", "rejected_score")


def ranked(items: DataFrame) -> DataFrame:
    """Add ``rank`` within the prompt by score, ties by ``seq`` (unique), and ``n``, the items of the prompt.

    Ranks are running counts over ranges of (prompt, score), so a prompt of very many items is spread over tasks.
    """
    at = F.struct(F.col("score").isNull(), -F.col("score"), F.col("seq"))
    x = running_counts(items.withColumn("__at", at).withColumn("__one", F.lit(1)), ["prompt"], "__at", "__one")
    return x.select(*items.columns, F.col("upto").cast("int").alias("rank"), "n")


def rank_pairs(items: DataFrame, per_prompt: int = 1, margin: float | None = None) -> DataFrame:
    """Pairs of the i-th best and i-th worst item of each prompt, i up to ``per_prompt``; inverted ones only without a margin."""
    r = ranked(items)
    a = r.select("prompt", F.col("response").alias("chosen"), F.col("score").alias("chosen_score"), "rank", "n")
    b = r.select("prompt", F.col("response").alias("rejected"), F.col("score").alias("rejected_score"), F.col("rank").alias("other"))
    out = a.where((F.col("n") >= 2) & (F.col("rank") <= F.least(F.lit(per_prompt), F.col("n") - 1))).withColumn("other", F.col("n") - F.col("rank") + 1).join(b, ["prompt", "other"])
    if margin is not None:
        out = out.where(F.col("chosen_score") - F.col("rejected_score") >= margin)
    return out.where("rank <> other").select("prompt", "chosen", "rejected", "chosen_score", "rejected_score")


def tournament(judged: DataFrame) -> DataFrame:
    """(prompt, response, score): sums of ratings over judged pairs (prompt, response_a, response_b, score_a, score_b), relative to the best of the prompt."""
    x = judged.select("prompt", F.explode(F.array(F.struct(F.col("response_a").alias("response"), F.col("score_a").alias("s")), F.struct(F.col("response_b").alias("response"), F.col("score_b").alias("s")))).alias("x"))
    total = x.groupBy("prompt", F.col("x.response").alias("response")).agg(F.sum("x.s").alias("total"))
    best = total.groupBy("prompt").agg(F.max("total").alias("best")).withColumnRenamed("prompt", "__prompt")
    x = total.join(best, F.col("prompt").eqNullSafe(F.col("__prompt")))
    return x.select("prompt", "response", F.when(F.col("best") > 0, F.col("total") / F.col("best")).otherwise(F.col("total")).alias("score"))


def parse_rating(text: Column, side: str, default: float = 5.0) -> Column:
    x = F.regexp_extract(text, RATING.format(side=side), 1)
    return F.coalesce(F.nullif(x, F.lit("")).cast("double"), F.lit(default))


def temperature(i: Column, schedule: list[float]) -> Column:
    """The temperature of the i-th response, going round the schedule."""
    return F.element_at(F.array(*(F.lit(t) for t in schedule)), (F.pmod(i, F.lit(len(schedule))) + 1).cast("int"))


def critique_score(critiques: DataFrame) -> DataFrame:
    """(prompt, response, score): mean over principles of 1 / (1 + length of the critique / 100)."""
    return critiques.groupBy("prompt", "response").agg(F.avg(1 / (1 + F.length("critique") / 100)).alias("score"))


def normalize_pairs(df: DataFrame) -> DataFrame:
    """(prompt, chosen, rejected) from pairs of texts or messages, from A/B responses with a preference, or the first two columns."""
    c = df.columns
    kinds = dict(df.dtypes)
    prompt = F.coalesce(F.col("prompt"), F.lit("")) if "prompt" in c else F.lit("")

    def text(name: str) -> Column:
        if kinds[name].startswith("array<struct"):
            return F.array_join(F.transform(F.col(name), lambda m: F.coalesce(m["content"], F.lit(""))), " ")
        return F.col(name).cast("string")

    if "chosen" in c and "rejected" in c:
        a, b = text("chosen"), text("rejected")
    elif "response_a" in c and "response_b" in c:
        first = F.col("preference") == 0
        a, b = F.when(first, text("response_a")).otherwise(text("response_b")), F.when(first, text("response_b")).otherwise(text("response_a"))
    else:
        a, b = text(c[0]), text(c[1])
    return df.select(prompt.alias("prompt"), a.alias("chosen"), b.alias("rejected"))


def usable_pairs(df: DataFrame) -> DataFrame:
    return df.where((F.length("chosen") > 0) & (F.length("rejected") > 0))


def extract_prompt(df: DataFrame) -> Column:
    """Prompt of rows of any shape: a prompt column, the first human turn of a transcript, or its first 200 characters."""
    for name in ("prompt", "question", "instruction"):
        if name in df.columns:
            return F.col(name)
    turn = F.trim(F.split(F.element_at(F.split(F.col("chosen"), "Human:"), 2), "Assistant:")[0])
    return F.when(F.contains("chosen", F.lit("Human:")), turn).otherwise(F.substring("chosen", 1, 200))


def pair_text(prompt: Column, answer: Column, sep: str = "\n") -> Column:
    return F.concat(F.coalesce(prompt, F.lit("")), F.lit(sep), F.coalesce(answer, F.lit("")))


# Requests to a critic, a reviser and a judge.
CRITIQUE = """You are a helpful assistant that critiques responses.

Given this response to a prompt, critique it based on the following principle:
Principle: {principle}

Prompt: {prompt}

Response: {response}

Provide a brief critique identifying any issues with the response based on the principle.
Critique:"""
REVISION = """You are a helpful assistant that improves responses.

Given the original response and critique, provide an improved version.

Prompt: {prompt}

Original Response: {response}

Critique: {critique}

Improved Response:"""
RANKING = """You are a helpful assistant that evaluates response quality.

Given the prompt and two responses, rate each response from 1-10 based on:
- Helpfulness and relevance
- Accuracy and correctness
- Clarity and coherence
- Completeness

Prompt: {prompt}

Response A:
{response_a}

Response B:
{response_b}

Output your ratings in this exact format:
Response A: [score]
Response B: [score]

Ratings:"""
# Principles of a critic.
PRINCIPLES = ["Please choose the response that is the most helpful, harmless, and honest.", "Please choose the response that is less harmful or toxic.", "Please choose the response that is more accurate and factual.", "Please choose the response that is more respectful and considerate."]
# Way of making pairs by strategy; others rank by a model.
STRATEGIES = {"model_ranking": "model_ranking", "reward_model": "reward_model", "constitutional": "constitutional"}


def filled(template: str, **columns: Column) -> Column:
    """A request with its slots filled; a null counts as empty."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), F.coalesce(columns[name], F.lit(""))]
    return F.concat(*out, F.lit(rest))


def long_enough(response: Column, least: int = 10) -> Column:
    """More than ``least`` characters without surrounding white space; false for null."""
    return F.coalesce(F.length(T.trimmed(response)) > least, F.lit(False))


def principle_of(key: Column, principles: list[str] = PRINCIPLES) -> Column:
    """A principle for each row, drawn by a hash of its key."""
    return F.element_at(F.array(*(F.lit(p) for p in principles)), (F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("long") % len(principles) + 1).cast("int"))


def constitutional_pairs(df: DataFrame) -> DataFrame:
    """(prompt, chosen, rejected, metadata) of (prompt, response, principle, critique, revision): the revision is chosen over the response.

    Rows with an empty response or revision give no pair.
    """
    ok = (F.length("response") > 0) & (F.length("revision") > 0)
    meta = F.create_map(F.lit("principle"), F.col("principle"), F.lit("critique"), F.col("critique"))
    return df.where(ok).select("prompt", F.col("revision").alias("chosen"), F.col("response").alias("rejected"), meta.alias("metadata"))


def constitutional(prompts: DataFrame, respond: Generator, critic: Generator, reviser: Generator, key: str = "prompt", principles: list[str] = PRINCIPLES) -> DataFrame:
    """Pairs of prompts (``prompt``): a response, its critique by a drawn principle, and its revision, by injected generators."""
    x = generate(prompts, respond, "prompt", "response").where(F.length("response") > 0).withColumn("principle", principle_of(F.col(key), principles))
    x = x.withColumn("__ask", filled(CRITIQUE, principle=F.col("principle"), prompt=F.col("prompt"), response=F.col("response")))
    x = generate(x, critic, "__ask", "critique").withColumn("__ask", filled(REVISION, prompt=F.col("prompt"), response=F.col("response"), critique=F.col("critique")))
    return constitutional_pairs(generate(x, reviser, "__ask", "revision"))


def way_of(strategy: Column) -> Column:
    """How pairs of a strategy are made: by ranking, unless it names another way."""
    out = F.lit("model_ranking")
    for name, way in STRATEGIES.items():
        out = F.when(F.lower(strategy) == name, way).otherwise(out)
    return out


def from_human_labels(df: DataFrame) -> DataFrame:
    """Labelled pairs as they are; a missing column raises ``ValueError``."""
    missing = {"prompt", "chosen", "rejected"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}")
    return df


def flattened(df: DataFrame, keys: list[str], column: str = "metadata") -> DataFrame:
    """Pairs with the wanted keys of their metadata as columns, names that are taken already left out."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *(F.col(column)[k].alias(k) for k in keys if k not in rest))


def item(df: DataFrame, tokenizer: Callable[[str], list[int]], max_length: int, prompt_column: str | None = "prompt", sep: str = "\n") -> DataFrame:
    """Add the tokens of both texts of each pair (``chosen_ids``, ``rejected_ids``) of equal length with their masks; without a prompt column the prompt is empty."""
    from . import token_arrays as K

    prompt = F.col(prompt_column) if prompt_column else F.lit("")
    x = df
    for side in ("chosen", "rejected"):
        x = K.tokenize(x.withColumn("__text", pair_text(prompt, F.col(side), sep)), tokenizer, "__text", f"{side}_ids", max_length).drop("__text")
    return x.withColumns({f"{s}_ids": K.pad(F.col(f"{s}_ids"), F.lit(max_length)) for s in ("chosen", "rejected")}).withColumns({f"{s}_mask": K.attention_mask(F.col(f"{s}_ids")) for s in ("chosen", "rejected")})


def reward_temperatures(n: int, schedule: list[float]) -> list[float]:
    """Temperatures of a reward ranking: each of the schedule ``n // len`` times, so perhaps fewer than ``n``."""
    return [t for t in schedule for _ in range(n // len(schedule))]


def responses(prompts: DataFrame, respond: Callable[[float], Generator], schedule: list[float], n: int) -> DataFrame:
    """(prompt, seq, temperature, response): ``n`` responses to each prompt (``prompt``), temperatures going round the schedule; too short ones are left out."""
    out = None
    for i in range(n):
        t = schedule[i % len(schedule)]
        x = generate(prompts.select("prompt"), respond(t), "prompt").select("prompt", F.lit(i).cast("long").alias("seq"), F.lit(float(t)).alias("temperature"), "response")
        out = x if out is None else out.unionByName(x)
    return out.where(long_enough(F.col("response")))


def judged(candidates: DataFrame, judge: Generator) -> DataFrame:
    """(prompt, response_a, response_b, score_a, score_b): every two responses of a prompt (a handful each, see ``responses``), rated by an injected judge."""
    a = candidates.select("prompt", F.col("seq").alias("sa"), F.col("response").alias("response_a"))
    b = candidates.select("prompt", F.col("seq").alias("sb"), F.col("response").alias("response_b"))
    x = a.join(b, "prompt").where("sa < sb").withColumn("__ask", filled(RANKING, prompt=F.col("prompt"), response_a=F.col("response_a"), response_b=F.col("response_b")))
    x = generate(x, judge, "__ask", "__said")
    return x.select("prompt", "response_a", "response_b", parse_rating(F.col("__said"), "A").alias("score_a"), parse_rating(F.col("__said"), "B").alias("score_b"))


def generate_pairs(prompts: DataFrame, strategy: str, respond: Callable[[float], Generator], judge: Generator | None = None, scorer: Scorer | None = None, critic: Generator | None = None, reviser: Generator | None = None, n: int = 4, per_prompt: int = 1, margin: float | None = None, schedule: tuple[float, ...] = (0.3, 0.7, 1.0)) -> DataFrame:
    """(prompt, chosen, rejected, chosen_score, rejected_score) of prompts, each once, by a strategy: rewards of a scorer, critique and revision (no scores), or else ratings of a judge.

    A missing model raises ``ValueError``.
    """
    way, prompts = STRATEGIES.get(strategy.lower(), "model_ranking"), prompts.select("prompt").distinct()
    need = {"reward_model": (scorer,), "constitutional": (critic, reviser)}.get(way, (judge,))
    if any(m is None for m in need):
        raise ValueError(f"{way} needs another model")
    if way == "constitutional":
        x = constitutional(prompts, respond(0.7), critic, reviser)
        return x.select("prompt", "chosen", "rejected", F.lit(None).cast("double").alias("chosen_score"), F.lit(None).cast("double").alias("rejected_score"))
    temperatures = reward_temperatures(n, list(schedule)) if way == "reward_model" else [schedule[i % len(schedule)] for i in range(n)]
    c = materialize(responses(prompts, respond, temperatures, len(temperatures)), "responses")  # ranked, and read by the pairs
    if way == "reward_model":
        return rank_pairs(score(c.withColumn("__text", pair_text(F.col("prompt"), F.col("response"))), scorer, "__text").drop("__text"), per_prompt, margin)
    rated = tournament(judged(c, judge)).join(c.groupBy("prompt", "response").agg(F.min("seq").alias("seq")), ["prompt", "response"])
    return rank_pairs(rated, per_prompt, margin)
