"""Flows with injected models, records, batches, turns, generation to a number."""

import json

import pytest
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.operators import benchmarks, chat, curation, hacking, human_eval, losses, preference, quality, scaling, synthetic
from loomspan.operators import token_arrays as K
from loomspan.sources import io


def test_multi_turn_flow(spark):
    echo = lambda texts: [f"{t} Answer to {len(t)}." for t in texts]
    q = benchmarks.default_questions(spark)
    x = benchmarks.answer_turns(q, echo).orderBy("question_id").collect()
    assert len(x) == 5 and all(len(r.answers) == 2 for r in x) and x[0].answers[0] == f"Answer to {len('User: ' + x[0].turns[0] + chr(10) + 'Assistant:')}."
    got = {(r.scope, r.key): r.n for r in benchmarks.multi_turn_benchmark(q, echo, model="m").collect()}
    assert got["overall", ""] == 10 and got["turn", "0"] == 5 and got["category", "math"] == 2 and got["question", "3"] == 2
    short = spark.createDataFrame([(1, None, ["a", "b"], ["x"]), (2, "c", None, ["x"]), (3, "c", [], [])], "question_id int, category string, turns array<string>, answers array<string>")
    assert [(r.category, r.turn) for r in benchmarks.judged_turns(short).collect()] == [("general", 0)]


def test_instruction_flow(spark):
    x = benchmarks.default_instructions(spark).withColumn("output", F.lit("A long answer."))
    r = benchmarks.instruction_benchmark(x, "output", "reference_output").collect()[0]
    assert r.n == 2 and r.win_rate == 50.0
    y = benchmarks.compare_models({"a": x, "b": x.limit(1)})
    assert {m.model: m["count"] for m in y.groupBy("model").count().collect()} == {"a": 2, "b": 1}
    assert benchmarks.instruction_benchmark(x.limit(0), "output", "reference_output").collect()[0].win_rate == 0.0


def test_hacking_flow(spark):
    p = spark.createDataFrame([(k, f"Do you think {k} is right?") for k in range(20)], "id int, prompt string")
    found = hacking.analyse(p, lambda ts: ["Yes, absolutely, of course." for _ in ts], lambda ts: [float(len(t)) for t in ts])
    r = {x.category: x for x in hacking.report(found).collect()}
    assert r["sycophancy"].severity == "severe" and r["sycophancy"].risk == 0.9 and len(r["sycophancy"].recommendations) == 2
    t = hacking.test_disagreement(spark, lambda ts: ["No." if k % 2 else "Actually, it is the other way." for k, _ in enumerate(ts)]).collect()[0]
    assert t.total_tests == 5 and t.disagreement_rate == 1.0
    with pytest.raises(ValueError, match="unknown detector"):
        hacking.findings(p.withColumn("response", F.lit("x")), reward=None, detectors=("what",))
    nothing = hacking.findings(p.limit(0).withColumn("response", F.lit("x")), reward=None)
    assert [x.recommendation for x in hacking.recommendations(hacking.report(nothing.fillna(False))).collect()] == [hacking.NO_RECOMMENDATION]


def test_constitutional_flow(spark):
    p = spark.createDataFrame([("a prompt",), ("another",)], "prompt string")
    got = preference.constitutional(p, lambda ts: ["first" for _ in ts], lambda ts: ["too short" for _ in ts], lambda ts: ["better" if "Critique: too short" in t else "" for t in ts]).collect()
    assert {(r.chosen, r.rejected) for r in got} == {("better", "first")} and all(r.metadata["principle"] in preference.PRINCIPLES for r in got)
    with pytest.raises(ValueError, match="missing columns"):
        preference.from_human_labels(p)


def test_generation_to_a_number(spark):
    seeds = spark.createDataFrame([(f"Seed task {k}", "", "") for k in range(4)], "instruction string, input string, output string")
    calls = []

    def model(prompts):
        import random

        r = random.Random(len(prompts[0]) if prompts else 0)
        return ["no section here" if r.random() < 0.2 else "### Instruction:\n" + " ".join(r.choice("river boat town market road field bridge harbour letter garden".split()) + str(r.randrange(99)) for _ in range(8)) for _ in prompts]

    got = synthetic.generate_until(seeds, model, 12, per_round=8, respond=lambda ts: ["done" for _ in ts]).collect()
    assert len(got) == 12 and len({r.instruction for r in got}) == 12 and {r.output for r in got} == {"done"}
    assert synthetic.generate_until(seeds, lambda ts: ["nothing" for _ in ts], 3, per_round=4, rounds=2).count() == 0
    assert synthetic.sample_examples(seeds, None, 9).count() == 4 and not calls
    e = synthetic.evolve(spark.createDataFrame([(k, "An instruction that is long enough") for k in range(5)], "id int, instruction string"), lambda ts: [t.split("Original Instruction: ")[1].split("\n")[0] + " and more" for t in ts], ["deepen", "concretize"], most=7)
    assert sorted(r.evolution_depth for r in e.collect()) == [0] * 5 + [1] * 2


def test_turns_and_collators(spark):
    text = "Be kind. USER: hello there ASSISTANT: hi you USER: bye"
    x = spark.createDataFrame([(1, text), (2, ""), (3, "no turns at all"), (4, "Human: a Assistant: b")], "id int, text string").withColumn("spans", K.turn_spans(F.col("text")))
    got = {r.id: [(r.text[s.start : s.end], s.role) for s in r.spans] for r in x.collect()}
    assert got[1] == [("Be kind. ", "system"), ("USER: hello there ", "user"), ("ASSISTANT: hi you ", "assistant"), ("USER: bye", "user")]
    assert got[2] == [] and got[3] == [("no turns at all", "system")] and got[4][1] == ("Assistant: b", "assistant")
    words = lambda t: [len(w) for w in t.split()]
    y = K.token_spans(K.tokenize(x, words), words).withColumn("batch", F.lit(0))
    z = {r.id: r for r in K.collate(y, 16, kind="chat").collect()}
    assert z[1].labels[:10] == [-100] * 5 + [10, 2, 3] + [-100] * 2 and z[1].attention_mask[:10] == [1] * 10
    assert {r.id: r for r in K.collate(y, 16, kind="chat", train_on_input=True).collect()}[1].labels[:2] == [2, 5]
    with pytest.raises(ValueError, match="unknown kind"):
        K.collate(y, 16, kind="other")
    p = K.prepare(spark.createDataFrame([("say hi", "hi")], "instruction string, output string"), words, max_length=3).collect()[0]
    assert len(p.input_ids) == 3 and p.attention_mask == [1, 1, 1]


def test_pack_runs(spark):
    x = spark.createDataFrame([(k, [k] * (k % 5)) for k in range(50)] + [(50, None)], "id long, ids array<int>")
    one = K.pack(x, 16, 0).collect()
    assert sum(len(r.starts) for r in one) == 51 and max(len(r.input_ids) for r in one) <= 16
    two = K.pack(x, 16, 0, rows=10).collect()
    assert {r.run for r in two} == set(range(6)) and sum(len(r.starts) for r in two) == 51
    assert K.pack(x.limit(0), 16, 0).count() == 0


def test_deferred_scores_only_survivors(spark):
    good = "These are more than ten words in one proper sentence, which is long enough."
    seen = spark.sparkContext.accumulator(0)

    def scorer(texts):
        seen.add(len(texts))
        return [9.0 if t.startswith("These") else 1.0 for t in texts]

    x = spark.createDataFrame([(1, good), (2, "no"), (3, None), (4, good.replace("These", "Those"))], "doc_id int, text string")
    got = {r.doc_id: r.reason for r in quality.with_deferred_perplexity(x, scorer, quality.QualityRules(max_perplexity=5.0)).collect()}
    assert got == {1: "high_perplexity", 2: "too_short", 3: "invalid_type", 4: None} and seen.value == 2


def test_records_and_summary(spark):
    a = spark.createDataFrame([("t1", "x", 0, None, "c"), ("t1", "y", 0, {"q": 3}, None), ("t2", "x", 1, None, None)], "task_id string, annotator_id string, preference int, ratings map<string,int>, comments string").withColumn("time_spent", F.lit(3.0))
    r = human_eval.to_records(a, human_eval.ANNOTATION_SCHEMA)
    assert json.loads(r.collect()[0].record)["task_id"] == "t1"
    back = human_eval.from_records(r.unionByName(spark.createDataFrame([("not json",)], "record string")), human_eval.ANNOTATION_SCHEMA).collect()
    assert len(back) == 3 and {x.comments for x in back} == {"c", ""} and all(x.ranking == [] for x in back)
    s = human_eval.summary(a).collect()[0]
    assert (s.total_tasks, s.total_annotations, s.num_annotators, s.agreement_rate) == (2, 3, 2, 1.0)
    assert human_eval.summary(a.limit(0)).collect()[0].total_tasks == 0
    with pytest.raises(Exception, match="unknown type"):
        a.select(human_eval.checked_type(F.lit("other"))).collect()


def test_settings_build_a_curator(spark):
    x = spark.createDataFrame([(1, "a b. " * 40), (2, "a b. " * 40), (3, "x")], "doc_id int, text string")
    kept, stats = curation.Curator.from_settings({"quality": {"max_repetition": None}, "deduplication": {"method": "exact"}, "toxicity": {"enabled": False}}).run(x)
    assert [r.doc_id for r in kept.collect()] == [1]
    assert {(r.stage, r.total, r.passed, r.removed) for r in stats.collect()} == {("quality", 3, 2, 1), ("dedup", 2, 1, 1)}


def test_scaling_flow(spark):
    r = spark.createDataFrame([(s, "word " * n + "end.") for s, n in ((70, 12), (410, 20), (1000, 300))], "size int, response string")
    long, laws, notes = scaling.analyse(r, spark.createDataFrame([(70, 3.0, 10), (410, 2.0, 10), (1000, 1.5, 10)], "size int, loss double, tokens int"))
    assert {x.metric for x in long.select("metric").distinct().collect()} == {"completion_rate", "avg_length", "coherence", "perplexity"}
    assert "perplexity" in laws and any("avg_length" in n for n in notes)


def test_documents_and_tables(spark, tmp_path):
    tasks = spark.createDataFrame([(f"t{k:02d}", "pairwise", "p", ["a"], {"k": "v"}) for k in range(25)], "task_id string, task_type string, prompt string, responses array<string>, metadata map<string,string>")
    io.export_tasks(tasks.repartition(5), str(tmp_path / "doc"), "json")
    parts = sorted(p for p in (tmp_path / "doc").iterdir() if p.name.startswith("part"))
    doc = json.loads("".join(p.read_text() for p in parts))
    assert doc["metadata"]["num_tasks"] == 25 and [t["task_id"] for t in doc["tasks"]] == [f"t{k:02d}" for k in range(25)]
    assert [r.a for r in io.head(io.from_rows(spark, [{"a": 2, "b": "x"}, {"a": 1}]), 1, "a").collect()] == [1]
    assert io.from_rows(spark, {"a": [1, 2], "b": ["x", "y"]}).count() == 2
    with pytest.raises(ValueError, match="order"):
        io.head(tasks, 3)
    with pytest.raises(ValueError, match="no report"):
        io.to_markdown(tasks, "t", most=5)
    (tmp_path / "c.json").write_text(json.dumps({"model_a": "x", "win": 0.5}, indent=1))
    assert io.load_comparison(spark, str(tmp_path / "c.json")).collect()[0].win == 0.5


def test_small_formulas(spark):
    x = spark.createDataFrame([([1.0, 2.0, 3.0], [1, 1, 0]), ([5.0], [0])], "v array<double>, m array<int>")
    assert [r[0] for r in x.select(losses.last_value(F.col("v"), F.col("m"))).collect()] == [2.0, None]
    assert chat.template_for_tokenizer(type("T", (), {"name_or_path": "my/Mixtral-8x7B"})()) == "mistral" and chat.template_for_tokenizer(object()) == "chatml"
    with pytest.raises(ValueError, match="unknown template"):
        chat.special_tokens("x")


def test_release_deletes_tables(spark):
    t = scratch.materialize(spark.range(5))
    assert t.count() == 5 and scratch.release(spark) >= 1
    with pytest.raises(Exception):
        t.count()


def test_stems():
    from loomspan.functions.stems import stem

    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal triplicate triplic formative form formalize formal electrical electr goodness good revival reviv allowance allow inference infer adjustable adjust replacement replac adoption adopt irritant irrit homologous homolog effective effect probate probat rate rate cease ceas controll control roll roll".split()
    assert [stem(w) for w in pairs[::2]] == pairs[1::2]


def test_perplexity_and_plots(spark):
    from loomspan.operators import models, rewards
    from loomspan.sources import plots

    x = spark.createDataFrame([(1, "a b c d"), (2, ""), (3, None)], "id int, text string")
    got = {r.id: r.perplexity for r in models.perplexity(x, lambda batch: [[1.0] * len(ids) for ids in batch], lambda t: [len(w) for w in t.split()], "text", max_tokens=2).collect()}
    assert got[1] == pytest.approx(2.718281828) and got[2] is None and got[3] is None
    v = spark.createDataFrame([(float(k),) for k in range(10)], "r double")
    svg = plots.histogram_svg(rewards.histogram(v, "r", 5), "rewards & more")
    assert svg.count("<rect") == 5 and "&amp;" in svg
    m = spark.createDataFrame([(70, "a", 1.0), (410, "a", 2.0), (70, "b", None)], "size int, metric string, value double")
    assert plots.lines_svg(m, "t").count("<polyline") == 1 and plots.lines_svg(m.limit(0), "t").count("<polyline") == 0
    law = scaling.power_law([1, 2, 4, 8, 16], [3 * s**-0.7321 + 1 for s in (1, 2, 4, 8, 16)])
    assert law["b"] == pytest.approx(-0.7321, abs=1e-3) and law["c"] == pytest.approx(1, abs=1e-2)


def test_pairs_by_strategy(spark):
    p = spark.createDataFrame([("one prompt",), ("two prompts",), ("one prompt",)], "prompt string")
    respond = lambda t: lambda ts: [f"a response at {t} to {x}" for x in ts]
    judge = lambda asks: [f"Response A: {9 if '0.3' in a.split('Response A:')[1].split('Response B:')[0] else 4}\nResponse B: 3" for a in asks]
    got = preference.generate_pairs(p, "self_critique", respond, judge=judge, n=3).collect()
    assert len(got) == 2 and all("0.3" in r.chosen and "1.0" in r.rejected for r in got)
    got = preference.generate_pairs(p, "REWARD_MODEL", respond, scorer=lambda ts: [float("1.0 to" in t) for t in ts], n=4, margin=0.5).collect()
    assert len(got) == 2 and all("1.0" in r.chosen and r.chosen_score == 1.0 for r in got)
    got = preference.generate_pairs(p, "constitutional", respond, critic=lambda ts: ["bad"] * len(ts), reviser=lambda ts: ["better"] * len(ts)).collect()
    assert {r.chosen for r in got} == {"better"} and len(got) == 2
    with pytest.raises(ValueError, match="needs another model"):
        preference.generate_pairs(p, "constitutional", respond)


def test_two_models(spark):
    from loomspan.operators import comparison

    p = spark.createDataFrame([("p1",), ("p2",)], "prompt string")
    x = comparison.generate_responses(p, {"a": lambda ts: ["long answer"] * len(ts), "b": lambda ts: ["short"] * len(ts)}, lambda ts: [float(len(t)) for t in ts])
    r = comparison.win_rates(comparison.side_by_side(x, "a", "b"), "reward_a", "reward_b").collect()[0]
    assert (r.n, r.win_a) == (2, 1.0)
    assert comparison.generate_responses(p, {"a": lambda ts: ["x"] * len(ts)}).collect()[0].reward is None


def test_stored_index(spark, tmp_path):
    from loomspan.operators import dedup

    t = " ".join(f"w{k}" for k in range(60))
    x = spark.createDataFrame([(1, t), (2, "quite another text " * 9)], "doc_id long, text string")
    path = str(tmp_path / "index")
    dedup.save_index(dedup.band_table(dedup.signatures(x)), path)
    probe = dedup.signatures(spark.createDataFrame([(9, t)], "doc_id long, text string"))
    assert {tuple(r) for r in dedup.query_similar(spark.read.parquet(path), probe).collect()} == {(9, 1)}
    assert dedup.reset_index(spark, path) and not dedup.reset_index(spark, path)
