"""Judged benchmarks: heuristics, ratings, roll-ups, win rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import share
from .models import Generator, generate


def parse_rating(text: Column, default: float = 5.0) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"\[\[(\d+(\.\d+)?)\]\]", 1), F.lit("")).cast("double"), F.lit(default))


def local_judge(question: Column, answer: Column) -> Column:
    """A score from 1 to 10 from length, overlap with the question and a proper end."""
    q, a = F.array_distinct(T.words(question)), F.array_distinct(T.words(answer))
    n = F.length(answer)
    overlap = F.size(F.array_intersect(q, a)) / F.greatest(F.size(q), F.lit(1))
    s = F.lit(5.0) + F.when(n < 50, -2.0).when(n > 100, 1.0).otherwise(0.0) + F.when(overlap > 0.2, 1.0).otherwise(0.0) + F.when(answer.rlike(r"(?s)(?:[.!?]|```)\z"), 0.5).otherwise(0.0)
    return F.least(F.greatest(s, F.lit(1.0)), F.lit(10.0))


def turn_scores(questions: DataFrame) -> DataFrame:
    """(question_id, category, turn, score): one row a scored turn."""
    return questions.select("question_id", "category", F.posexplode("scores").alias("turn", "score")).where("score is not null")


def rollup(turns: DataFrame) -> DataFrame:
    """(category, turn, mean, n): means by category, by turn and overall in one pass."""
    c, t = F.col("category"), F.col("turn")
    return turns.groupingSets([[c], [t], []], c, t).agg(F.avg("score").alias("mean"), F.count("*").alias("n"))


def question_scores(turns: DataFrame) -> DataFrame:
    """(question_id, category, mean_score, turns): a row a question."""
    return turns.groupBy("question_id", "category").agg(F.avg("score").alias("mean_score"), F.count("*").alias("turns"))


# Questions where none are given, and a set of instructions with references.
QUESTIONS = [
    (1, "writing", ["Write a persuasive email to convince your introverted friend to join you for a weekend camping trip.", "Now write a follow-up email addressing their concerns about being uncomfortable in nature and around too many people."]),
    (2, "roleplay", ["Act as a pirate captain and describe your most recent adventure.", "Now, describe the treasure you found in that adventure."]),
    (3, "reasoning", ["What is the sum of all the prime numbers less than 50?", "Now, calculate the product of the first five prime numbers."]),
    (4, "math", ["If a train travels at 60 mph for 2 hours, how far does it travel?", "If the train then travels at 80 mph for another hour, what is the total distance traveled?"]),
    (5, "coding", ["Write a Python function to check if a number is prime.", "Now modify the function to return all prime numbers up to n."]),
]
INSTRUCTIONS = [("What is the capital of France?", "Paris"), ("Write a haiku about coding.", "Lines of code flow free\nBugs hide in logic's shadows\nDebuggers unite")]


def default_questions(spark) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "question_id int, category string, turns array<string>")


def default_instructions(spark) -> DataFrame:
    return spark.createDataFrame(INSTRUCTIONS, "instruction string, reference_output string")


def answer_turns(questions: DataFrame, generator: Generator) -> DataFrame:
    """Add ``answers``: one answer a turn, each prompt holding the turns and answers before it."""
    most = questions.agg(F.max(F.size("turns"))).first()[0] or 0
    x = questions.withColumn("__talk", F.lit("")).withColumn("answers", F.array().cast("array<string>"))
    for k in range(most):
        x = x.withColumn("__talk", F.concat("__talk", F.lit("User: "), F.coalesce(F.get("turns", F.lit(k)), F.lit("")), F.lit("\nAssistant:")))
        x = generate(x, generator, "__talk", "__answer")
        x = x.withColumn("answers", F.when(F.size("turns") > k, F.concat("answers", F.array("__answer"))).otherwise(F.col("answers")))
        x = x.withColumn("__talk", F.concat("__talk", F.lit(" "), F.coalesce("__answer", F.lit("")), F.lit("\n"))).drop("__answer")
    return x.drop("__talk")


def judged_turns(questions: DataFrame, judge: Callable[[Column, Column], Column] = local_judge, general: str = "general") -> DataFrame:
    """(question_id, category, turn, score) of questions with answers: turns and answers meet in order, the shorter list ends."""
    n = F.least(F.size("turns"), F.size("answers"))
    both = F.arrays_zip(F.slice("turns", 1, n).alias("q"), F.slice("answers", 1, n).alias("a"))
    x = questions.where("turns is not null and answers is not null").select("question_id", F.coalesce("category", F.lit(general)).alias("category"), F.posexplode(both).alias("turn", "x"))
    return x.select("question_id", "category", "turn", judge(F.coalesce("x.q", F.lit("")), F.coalesce("x.a", F.lit(""))).alias("score"))


def multi_turn_benchmark(questions: DataFrame, generator: Generator | None = None, judge: Callable[[Column, Column], Column] = local_judge, model: str = "model") -> DataFrame:
    """(model, scope, key, score, n): overall, by category, by turn and by question. Without a generator the questions bring their answers."""
    turns = judged_turns(answer_turns(questions, generator) if generator else questions, judge)
    r = rollup(turns)
    scope = F.when(F.col("category").isNotNull(), "category").when(F.col("turn").isNotNull(), "turn").otherwise("overall")
    key = F.coalesce("category", F.col("turn").cast("string"), F.lit(""))
    by_question = question_scores(turns).select(F.lit("question").alias("scope"), F.col("question_id").cast("string").alias("key"), F.col("mean_score").alias("score"), F.col("turns").alias("n"))
    return r.select(scope.alias("scope"), key.alias("key"), F.col("mean").alias("score"), "n").unionByName(by_question).select(F.lit(model).alias("model"), "*")


def instruction_rows(df: DataFrame, output: str, reference: str, instruction: str = "instruction") -> DataFrame:
    """(instruction, model_length, reference_length, win) a row; instructions are cut at 100 characters."""
    a, b = F.coalesce(output, F.lit("")), F.coalesce(reference, F.lit(""))
    return df.select(T.shortened(F.col(instruction), 100).alias("instruction"), F.length(a).alias("model_length"), F.length(b).alias("reference_length"), annotate(a, b).alias("win"))


def instruction_benchmark(df: DataFrame, output: str, reference: str, model: str = "model", generator: Generator | None = None, instruction: str = "instruction") -> DataFrame:
    """(model, win_rate, length_controlled_win_rate, n): outputs against references; a generator writes the outputs."""
    x = generate(df, generator, instruction, output) if generator else df
    x = x.withColumns({c: F.coalesce(c, F.lit("")) for c in (output, reference)})
    w, lc = win_rate(x, output, reference), length_controlled_win_rate(x, output, reference).withColumnRenamed("win_rate", "length_controlled_win_rate")
    return w.join(F.broadcast(lc)).join(F.broadcast(x.agg(F.count("*").alias("n")))).select(F.lit(model).alias("model"), F.coalesce("win_rate", F.lit(0.0)).alias("win_rate"), "length_controlled_win_rate", "n")


def compare_models(runs: dict[str, DataFrame]) -> DataFrame:
    """One table of the results of several models (name to result); a result keeps its columns, ``model`` names the run."""
    out = None
    for name, df in runs.items():
        x = df.withColumn("model", F.lit(name))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def annotate(a: Column, b: Column) -> Column:
    """Whether the first answer wins: by length and a proper end."""
    s = lambda x: F.length(x) + F.when(F.endswith(x, F.lit(".")), 10).otherwise(0)
    return s(a) > s(b)


def win_rate(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg((share(annotate(F.col(a), F.col(b))) * 100).alias("win_rate"))


def length_controlled_win_rate(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean of the win rates of shorter, similar and longer answers, empty groups left out."""
    r = F.length(a) / F.greatest(F.length(b), F.lit(1))
    g = df.groupBy(F.when(r < 0.8, "shorter").when(r > 1.2, "longer").otherwise("similar").alias("bucket")).agg(share(annotate(F.col(a), F.col(b))).alias("w"))
    return g.agg(F.coalesce(F.avg("w") * 100, F.lit(0.0)).alias("win_rate"))
