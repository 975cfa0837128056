"""Pairs, token arrays, losses and statistics against closed forms."""

import math

import pytest
from pyspark.sql import functions as F

from loomspan.operators import benchmarks, chat, comparison, human_eval, losses, preference, rewards, scaling, synthetic
from loomspan.operators import token_arrays as K
from loomspan.operators.models import generate, score


def one(df):
    return df.collect()[0]


def test_pairs_from_ratings(spark):
    x = spark.createDataFrame([("p", "a", 5.0, 1), ("p", "b", 2.0, 2), ("p", "c", 4.0, 3), ("q", "d", 1.0, 4), ("q", "d", 1.0, 5)], "prompt string, response string, rating double, seq int")
    assert {(r.chosen, r.rejected) for r in preference.pairs_from_ratings(x).collect()} == {("a", "b"), ("a", "c"), ("c", "b")}
    assert {(r.chosen, r.rejected) for r in preference.rank_pairs(x.withColumnRenamed("rating", "score")).where("prompt = 'p'").collect()} == {("a", "b")}
    assert preference.pairs_from_ratings(x.limit(0)).count() == 0


def test_normalize_messages(spark):
    x = spark.createDataFrame([([("user", "hi"), ("assistant", "yo")], [("user", "no")])], "chosen array<struct<role:string,content:string>>, rejected array<struct<role:string,content:string>>")
    assert one(preference.normalize_pairs(x))[1:] == ("hi yo", "no")


def test_token_arrays(spark):
    x = spark.createDataFrame([([1, 2, 3, 4, 5, 10, 11, 20, 21, 22],), ([7, 8],), ([],)], "ids array<int>")
    got = [r[0] for r in x.select(K.completion_labels(F.col("ids"), [10, 11])).collect()]
    assert got == [[-100] * 7 + [20, 21, 22], [7, 8], []]
    got = [r[0] for r in x.select(K.pad(F.col("ids"), F.lit(4))).collect()]
    assert got == [[1, 2, 3, 4], [7, 8, 0, 0], [0, 0, 0, 0]]


def test_pack_next_fit(spark):
    x = spark.createDataFrame([(1, [1, 1, 1]), (2, [2, 2]), (3, [3] * 5), (4, [4] * 20), (5, [5])], "id long, ids array<int>")
    got = [(r.input_ids, r.starts) for r in K.pack(x, 8, 0).orderBy("pack").collect()]
    assert got == [([1, 1, 1, 0, 2, 2], [0, 4]), ([3] * 5, [0]), ([4] * 8, [0]), ([5], [0])]


def test_losses(spark):
    x = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0), (3.0, 1.0)], "c double, r double")
    c, r = F.col("c"), F.col("r")
    want = sum(math.log1p(math.exp(-d)) for d in (1, 1, 2)) / 3
    assert one(x.agg(F.avg(losses.bradley_terry(c, r))))[0] == pytest.approx(want)
    assert one(x.select(losses.bradley_terry(F.lit(1.0), F.lit(1.0))))[0] == pytest.approx(math.log(2))
    assert one(x.select(losses.bradley_terry(F.lit(-1000.0), F.lit(0.0))))[0] == pytest.approx(1000)
    g = spark.createDataFrame([([1.0, 2.0, 3.0], [0.0, 0.0, 0.0])], "r array<double>, v array<double>")
    assert one(g.select(losses.gae(F.col("r"), F.col("v"), 1.0, 1.0)))[0] == [6.0, 5.0, 3.0]
    k = spark.createDataFrame([([1.0, 0.0, 0.02],)], "k array<double>")
    assert one(k.select(losses.adaptive_coefficient(F.col("k"), 0.1, 0.02)))[0] == pytest.approx(0.1)


def test_distribution_and_constant_histogram(spark):
    x = spark.createDataFrame([(float(v),) for v in range(1, 6)], "r double")
    d = one(rewards.distribution(x, "r"))
    assert (d["mean"], d["std"], d["p50"], d["p25"]) == (3.0, pytest.approx(math.sqrt(2)), 3.0, 2.0)
    h = rewards.histogram(spark.createDataFrame([(2.0,)] * 3, "r double"), "r", 4).orderBy("bin").collect()
    assert [r.n for r in h] == [0, 0, 3, 0] and (h[0].lo, h[-1].hi) == (1.5, 2.5)


def test_paired_tests(spark):
    x = spark.createDataFrame([(1.0, 0.5), (2.0, 2.5), (3.0, 1.0), (4.0, 4.0)], "a double, b double")
    s = one(comparison.paired_stats(x, "a", "b"))
    d = [0.5, -0.5, 2.0, 0.0]
    m = sum(d) / 4
    sd = math.sqrt(sum((v - m) ** 2 for v in d) / 3)
    assert s.t == pytest.approx(m / (sd / 2))
    w = one(comparison.wilcoxon(x, "a", "b"))
    assert (w.n, w.w_plus, w.w_minus) == (3, 4.5, 1.5)
    assert comparison.t_p_value(2.0, 11) == pytest.approx(0.07338803477074037)
    assert comparison.t_p_value(0.0, 11) == pytest.approx(1.0)


def test_wilson_and_majority_ties(spark):
    a = spark.createDataFrame([("t", "x", 1), ("t", "y", 0), ("u", "x", None)], "task_id string, annotator_id string, preference int")
    assert [(r.task_id, r.preference) for r in human_eval.majority(a).collect()] == [("t", 0)]
    w = one(human_eval.win_intervals(human_eval.majority(a.limit(0))))
    assert w.n == 0 and w.a_lo == 0.0
    assert one(human_eval.fleiss_kappa(a.limit(0)))[0] == 0.0


def test_scaling():
    law = scaling.power_law([1.0, 2.0, 4.0, 8.0], [3 * x**0.5 + 1 for x in (1, 2, 4, 8)])
    assert law["b"] == pytest.approx(0.5, abs=0.02) and scaling.predict(law, 16.0) == pytest.approx(13, abs=0.1)


def test_chat_templates(spark):
    m = [("system", "S"), ("user", "U"), ("assistant", "A"), ("user", "V")]
    x = spark.createDataFrame([(m,)], "m array<struct<role:string,content:string>>")
    messages, system = chat.normalize(F.col("m"))
    show = lambda t: one(x.select(chat.conversation(t, messages, system)))[0]
    assert show("chatml") == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nU<|im_end|>\n<|im_start|>assistant\nA<|im_end|>\n<|im_start|>user\nV<|im_end|>\n<|im_start|>assistant\n"
    assert show("llama2") == "<s>[INST] <<SYS>>\nS\n<</SYS>>\n\nU [/INST] A </s><s>[INST] V [/INST]"
    assert show("vicuna") == "S\n\nUSER: U\nASSISTANT: A</s>\nUSER: V\nASSISTANT:"
    assert chat.template_for_model("Mistral-7B-Instruct") == "mistral" and chat.template_for_model("unknown") == "chatml"
    with pytest.raises(Exception, match="unknown role"):
        bad = spark.createDataFrame([([("robot", "x")],)], "m array<struct<role:string,content:string>>")
        bad.select(chat.conversation("chatml", *chat.normalize(F.col("m")))).collect()


def test_sft_shapes(spark):
    assert "### Response:\nout" in one(chat.sft_text(spark.createDataFrame([("do", "", "out")], "instruction string, input string, output string"), "alpaca")).text
    assert one(chat.sft_text(spark.createDataFrame([("a", "b")], "question string, answer string"))).text == "a\n\nb"


def test_synthetic(spark):
    t = "### Instruction:\nDo it\n### Input: \nN/A\n### Output:\nDone\n"
    x = spark.createDataFrame([(t,), ("nothing",)], "t string")
    assert [r[0] and tuple(r[0]) for r in x.select(synthetic.parse_instruction(F.col("t"))).collect()] == [("Do it", "", "Done"), None]
    d = spark.createDataFrame([(1, "write a poem about rain"), (2, "write a poem about rain now"), (3, "sum two numbers")], "id long, instruction string")
    assert sorted(r.id for r in synthetic.diverse(d, shards=1).collect()) == [1, 3]
    e = synthetic.evolve(d, lambda ps: [p + " and then explain every step" for p in ps], ["deepen"])
    assert e.where("evolution_depth = 1").count() == 3


def test_models_and_judges(spark):
    x = spark.createDataFrame([("p",)], "prompt string")
    r = one(score(generate(x, lambda ps: [p + " answer" for p in ps], "prompt"), lambda ts: [float(len(t)) for t in ts], "response"))
    assert (r.response, r.score) == ("answer", 6.0)
    j = spark.createDataFrame([("what is rain", "rain is water. " * 10)], "q string, a string")
    assert one(j.select(benchmarks.local_judge(F.col("q"), F.col("a"))))[0] == 7.0
