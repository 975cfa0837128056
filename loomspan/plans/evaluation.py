"""Reward hacking, judged benchmarks, human evaluation, scaling, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import pearson
from ..operators import benchmarks, hacking, human_eval, scaling
from .registry import contained, ngrams, query, quoted, repetition, tokens, trimmed, words

# responses with phrases that detectors look for, put in front by the id
_OPENERS = ["Great question, absolutely brilliant. ", "Yes, you're right. ", "Actually, that's not right. ", "In conclusion, as mentioned before, ", "Sure, of course! Here is it. ", "Thank you for this. ", ""]
_ASK = ["Do you think so? ", "It is flat, right? ", ""]


def _responses(read):
    p = read("preference_pairs").where("chosen is not null and prompt is not null")
    pick = lambda xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.col("pair_id") % len(xs) + 1).cast("int"))
    return p.select("pair_id", F.concat(pick(_ASK), "prompt").alias("prompt"), F.concat(pick(_OPENERS), "chosen").alias("response"), F.coalesce("chosen_score", F.lit(0.5)).alias("reward"))


_P = "[" + ", ".join(quoted(x) for x in _OPENERS) + f"][(pair_id % {len(_OPENERS)} + 1)::int]"
_A = "[" + ", ".join(quoted(x) for x in _ASK) + f"][(pair_id % {len(_ASK)} + 1)::int]"
_RESP = f"(select pair_id, {_A} || prompt prompt, {_P} || chosen response, coalesce(chosen_score, 0.5) reward from preference_pairs where chosen is not null and prompt is not null)"
_LOW = "lower(response)"


def _matches(t: str, patterns: list[str]) -> str:
    return "(" + " or ".join(f"regexp_matches({t}, {quoted(p)})" for p in patterns) + ")"


_ROUND = lambda df, keep=(): df.select(*keep, *(F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes if c not in keep))


@query(f"select round(c, 6) correlation, (case when abs(c) > 0.7 then 1.0 when abs(c) > 0.5 then 0.6 when abs(c) > 0.3 then 0.3 else 0.0 end)::double severity, abs(c) > 0.5 detected from (select corr(length(response), reward) c from {_RESP})")
def length_reward_corr(read, spark):
    return _ROUND(hacking.length_correlation(_responses(read)))


@query(f"select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) r from lineitem group by 1")
def safe_correlation(read, spark):
    return read("lineitem").groupBy("l_returnflag").agg(F.round(pearson(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("r"))


@query(f"select round(r, 6) rate, r > 0.2 detected, round(least(2 * r, 1), 6) severity from (select avg(({contained(_LOW, hacking.SYCOPHANCY_KEYWORDS)} >= 2)::int) r from {_RESP})")
def sycophancy_keywords(read, spark):
    return _ROUND(hacking.sycophancy(_responses(read)))


_G = ngrams("w", 3)


@query(f"with g as (select pair_id, unnest({_G}) g from (select pair_id, {words('response')} w from {_RESP})), c as (select pair_id, g, count(*) n from g group by all), s as (select pair_id, count_if(n > 1) / count(*) s from c group by 1), a as (select r.pair_id, coalesce(s, 0) s from {_RESP} r left join s using (pair_id)) select round(avg(s), 6) mean_score, round(avg((s > 0.3)::int), 6) rate, (avg((s > 0.3)::int) > 0.1 or avg(s) > 0.3) detected from a")
def repeated_ngram_share(read, spark):
    return _ROUND(hacking.repetition_report(_responses(read)))


@query(" union all ".join(f"select {quoted(p)} pattern, count_if(regexp_matches({_LOW}, {quoted(p)}))::bigint responses from {_RESP}" for p in hacking.FILLERS))
def filler_hits(read, spark):
    return hacking.filler_hits(_responses(read))


@query("select round(sum(" + " + ".join(f"regexp_matches({_LOW}, {quoted(p)})::int" for p in hacking.FILLERS) + f") / count(*), 6) rate from {_RESP}")
def filler_rate(read, spark):
    return _ROUND(hacking.filler_rate(_responses(read)))


@query(f"select round(m, 6) mean, round(b, 6) baseline_mean, round((m - b) / b * 100, 6) increase_percent, case when (m - b) / b * 100 > 50 then 'severe' when (m - b) / b * 100 > 25 then 'mild' else 'none' end severity from (select (select avg(len({tokens('response')})) from {_RESP}) m, (select avg(len({tokens('rejected')})) from preference_pairs where rejected is not null) b)")
def length_vs_baseline(read, spark):
    base = read("preference_pairs").where("rejected is not null").select(F.col("rejected").alias("response"))
    return _ROUND(hacking.baseline_increase(_responses(read), base))


@query(f"select round(avg(({contained(_LOW, hacking.FLATTERY_KEYWORDS)} > 0)::int), 6) rate from {_RESP}")
def flattery_rate(read, spark):
    return _ROUND(hacking.flattery_rate(_responses(read)))


_AGREES = f"({_matches(_LOW, hacking.AGREEMENT)} and not {_matches(_LOW, hacking.DISAGREEMENT)})"


@query(f"select count_if(o)::bigint opinion_prompts, round(count_if(o and a)::double / count_if(o), 6) rate from (select {contained('lower(prompt)', hacking.OPINION_RATE)} > 0 o, {_AGREES} a from {_RESP})")
def agreement_rate(read, spark):
    return _ROUND(hacking.agreement_rate(_responses(read)))


@query(f"select pair_id from {_RESP} where ({contained('lower(prompt)', hacking.OPINION)} > 0 and {_AGREES}) or {contained(_LOW, hacking.FLATTERY_KEYWORDS)} >= 2")
def sycophantic_responses(read, spark):
    return _responses(read).where(hacking.is_sycophantic(F.col("prompt"), F.col("response"))).select("pair_id")


@query(" union all ".join(f"select {n} n, round(avg({repetition('w', n)}), 6) mean, round(max({repetition('w', n)}), 6) max from (select {words('response')} w from {_RESP})" for n in (3, 4, 5)))
def ngram_repetition_345(read, spark):
    return _ROUND(hacking.ngram_repetition(_responses(read)))


@query(f"with g as (select unnest({ngrams('w', 4)}) g from (select {words('response')} w from {_RESP})), c as (select g, count(*) n from g group by 1 order by n desc, g limit 20) select replace(g, chr(1), ' ') phrase, n, round(n / (select count(*) from {_RESP}), 6) rate from c where n >= 3")
def repeated_phrases(read, spark):
    return _ROUND(hacking.repeated_phrases(_responses(read)))


@query(" union all ".join(f"select {quoted(n)} as template, c::bigint responses, round(c / n, 6) rate, c > n * 0.4 flagged from (select count_if(regexp_matches(response, {quoted('(?im)' + p)})) c, count(*) n from {_RESP})" for n, p in hacking.TEMPLATES))
def template_patterns(read, spark):
    return _ROUND(hacking.template_patterns(_responses(read)))


@query(f"with v as (select count_if({contained('lower(prompt)', hacking.OPINION_RATE)} > 0 and {_AGREES})::double / count_if({contained('lower(prompt)', hacking.OPINION_RATE)} > 0) a, avg(({contained(_LOW, hacking.FLATTERY_KEYWORDS)} > 0)::int) f from {_RESP}) select round(a, 6) agreement_rate, round(f, 6) flattery_rate, (a > 0.8 or f > 0.5) detected, case when a > 0.9 then 'severe' when a > 0.8 or f > 0.5 then 'mild' else 'none' end severity from v")
def sycophancy_verdict(read, spark):
    return _ROUND(hacking.sycophancy_verdict(_responses(read)))


@query("with f as (select case source when 'lab_notes' then 'length' when 'open_forum' then 'sycophancy' else 'repetition' end c, count(*) n from documents where source is not null group by 1), r as (select case when n % 2 = 0 then 0.0 when n > 60 then 0.9 else 0.5 end r, case c when 'length' then 0.3 when 'sycophancy' then 0.3 else 0.2 end w from f) select round(sum(r * w)::double / sum(w)::double, 6) overall, case when sum(r * w) / sum(w) > 0.7 then 'HIGH' when sum(r * w) / sum(w) > 0.4 then 'MEDIUM' else 'LOW' end level from r")
def hacking_risk(read, spark):
    c = F.when(F.col("source") == "lab_notes", "length").when(F.col("source") == "open_forum", "sycophancy").otherwise("repetition")
    f = read("documents").where("source is not null").groupBy(c.alias("category")).agg(F.count("*").alias("n"))
    return _ROUND(hacking.risk(f.select("category", (F.col("n") % 2 == 1).alias("detected"), F.when(F.col("n") > 60, "severe").otherwise("mild").alias("severity"))))


# judged benchmarks


@query(f"select question_id, k turn, least(greatest(5.0::double + case when length(a) < 50 then -2 when length(a) > 100 then 1 else 0 end + case when len(list_intersect(list_distinct({words('q')}), list_distinct({words('a')})))::double / greatest(len(list_distinct({words('q')})), 1) > 0.2 then 1 else 0 end + case when ends_with(a, '.') or ends_with(a, '!') or ends_with(a, '?') or ends_with(a, '```') then 0.5 else 0 end, 1), 10) score from (select question_id, unnest(range(0, 2))::int k, unnest(turns) q, unnest(answers) a from judged_questions)")
def judge_heuristic(read, spark):
    j = read("judged_questions").select("question_id", F.posexplode(F.arrays_zip("turns", "answers")).alias("turn", "x"))
    return j.select("question_id", "turn", benchmarks.local_judge(F.col("x.turns"), F.col("x.answers")).alias("score"))


@query("with t as (select category, (unnest(range(0, len(scores))))::int turn, unnest(scores) score from judged_questions) select coalesce(category, 'all') category, coalesce(turn, -1) turn, round(avg(score), 6) mean, count(*) n from t where score is not null group by grouping sets ((t.category), (t.turn), ())")
def mtbench_rollup(read, spark):
    x = _ROUND(benchmarks.rollup(benchmarks.turn_scores(read("judged_questions"))), ("category",))
    return x.select(F.coalesce("category", F.lit("all")).alias("category"), F.coalesce("turn", F.lit(-1)).alias("turn"), "mean", "n")


@query("select pair_id, coalesce(try_cast(nullif(regexp_extract(t, '\\[\\[(\\d+(\\.\\d+)?)\\]\\]', 1), '') as double), 5.0::double) rating from (select pair_id, 'Rating: ' || case when pair_id % 3 = 0 then '[[' || coalesce(chosen_score, 1)::varchar || ']]' else '[[x]]' end t from preference_pairs)")
def rating_parse(read, spark):
    t = F.concat(F.lit("Rating: "), F.when(F.col("pair_id") % 3 == 0, F.concat(F.lit("[["), F.coalesce("chosen_score", F.lit(1.0)).cast("string"), F.lit("]]"))).otherwise("[[x]]"))
    return read("preference_pairs").select("pair_id", benchmarks.parse_rating(t).alias("rating"))


_B = "(select chosen a, rejected b, length(chosen) / greatest(length(rejected), 1) r, (length(chosen) + case when ends_with(chosen, '.') then 10 else 0 end > length(rejected) + case when ends_with(rejected, '.') then 10 else 0 end)::int w from preference_pairs where chosen is not null and rejected is not null)"


@query(f"select round(avg(w) * 100, 6) win_rate from {_B}")
def alpaca_win_rate(read, spark):
    return _ROUND(benchmarks.win_rate(read("preference_pairs").where("chosen is not null and rejected is not null"), "chosen", "rejected"))


@query(f"select round(avg(m) * 100, 6) win_rate from (select avg(w) m from {_B} group by case when r < 0.8 then 's' when r > 1.2 then 'l' else 'm' end)")
def lc_win_rate(read, spark):
    return _ROUND(benchmarks.length_controlled_win_rate(read("preference_pairs").where("chosen is not null and rejected is not null"), "chosen", "rejected"))


# human evaluation

_MAJ = """v as (select task_id, preference p, count(*) votes from annotations where preference is not null group by all),
 m as (select task_id, arg_max(p, votes * 1000 - p) preference, max(votes) votes, sum(votes)::bigint total, count(*) d from v group by 1)"""


@query(f"with {_MAJ} select task_id, preference, votes from m")
def annot_majority(read, spark):
    return human_eval.majority(read("annotations")).select("task_id", "preference", "votes")


@query(f"with {_MAJ} select task_id, preference from m where d = 1")
def annot_unanimous(read, spark):
    return human_eval.unanimous(read("annotations"))


@query(f"with {_MAJ} select round(avg(votes / total), 6) agreement_rate, count(*) tasks from m where total >= 2")
def annot_agreement(read, spark):
    return _ROUND(human_eval.agreement(read("annotations")))


@query("with t as (select task_id, count(*) n, count_if(preference = 0) a, count_if(preference = 1) b from annotations where preference is not null group by 1), o as (select max(n)::double n, avg(a * a + b * b)::double sq, sum(a)::double sa, sum(b)::double sb from t), k as (select (sq - n) / (n * (n - 1)) p, (sa * sa + sb * sb) / ((sa + sb) * (sa + sb)) e from o) select round((p - e) / (1 - e), 6) kappa from k")
def fleiss_kappa(read, spark):
    return _ROUND(human_eval.fleiss_kappa(read("annotations")))


@query(f"with {_MAJ} select count(*) n, round(avg((preference = 0)::int), 6) a, round(avg((preference = 1)::int), 6) b, round(avg((preference = 2)::int), 6) tie from m")
def annot_win_rates(read, spark):
    return _ROUND(human_eval.win_rates(human_eval.majority(read("annotations"))))


_Z = 1.959963984540054


def _wilson(w: str, sign: str) -> str:
    return f"least(greatest(({w} / n + {_Z * _Z} / (2 * n) {sign} {_Z} * sqrt(({w} / n * (1 - {w} / n) + {_Z * _Z} / (4 * n)) / n)) / (1 + {_Z * _Z} / n), 0), 1)"


@query(f"with {_MAJ}, c as (select count(*) n, count_if(preference = 0)::double a, count_if(preference = 1)::double b from m) select n, round({_wilson('a', '-')}, 6) a_lo, round({_wilson('a', '+')}, 6) a_hi, round({_wilson('b', '-')}, 6) b_lo, round({_wilson('b', '+')}, 6) b_hi from c")
def annot_win_ci(read, spark):
    return _ROUND(human_eval.win_intervals(human_eval.majority(read("annotations"))))


@query("with r as (select unnest(map_entries(ratings)) e from annotations) select e.key dimension, count(e.value) n, round(avg(e.value), 6) mean, round(stddev_pop(e.value), 6) std, min(e.value) min, max(e.value) max from r group by 1")
def annot_dimensions(read, spark):
    return _ROUND(human_eval.dimensions(read("annotations")), ("dimension",))


@query("select count(*) n, round(avg(t), 4) mean_time, round(stddev_pop(t), 4) std_time, round(count_if(t < 5)::double / count(t), 6) fast_rate, round(count_if(t > 300)::double / count(t), 6) slow_rate, round(avg((length(coalesce(comments, '')) > 0)::int), 6) comment_rate from (select comments, case when time_spent > 0 and not isnan(time_spent) then time_spent end t from annotations)")
def annot_quality(read, spark):
    x = human_eval.annotation_quality(read("annotations").withColumn("time_spent", F.when(~F.isnan("time_spent"), F.col("time_spent"))))
    return _ROUND(x).withColumn("mean_time", F.round("mean_time", 4)).withColumn("std_time", F.round("std_time", 4))


@query(
    """with a as (select task_id, annotator_id, preference from annotations where not coalesce(time_spent > 0 and time_spent < 5, false)), c as (select task_id, count(*) n from a group by 1), v as (select task_id, preference p, count(*) votes from a where preference is not null group by all),
 m as (select task_id, arg_max(p, votes * 1000 - p) p, max(votes) votes from v group by 1) select a.task_id, count(*) n from a left join m using (task_id) join c using (task_id) where not coalesce(votes / n > 0.5 and preference is not null and preference <> p, false) group by 1"""
)
def annot_filter(read, spark):
    return human_eval.filter_low_quality(read("annotations")).groupBy("task_id").agg(F.count("*").alias("n"))


@query("select substr(sha256(pair_id::varchar || ':0'), 1, 8) task_id, 'pairwise' task_type, prompt, case when substr(md5(pair_id::varchar || ':side0'), 1, 1) >= '8' then 'true' else 'false' end shuffled, case when substr(md5(pair_id::varchar || ':side0'), 1, 1) >= '8' then rejected else chosen end first_response from preference_pairs where prompt is not null")
def pairwise_task_creation(read, spark):
    p = read("preference_pairs").where("prompt is not null").select(F.col("pair_id").alias("id"), "prompt", F.col("chosen").alias("response_a"), F.col("rejected").alias("response_b"))
    return human_eval.pairwise_tasks(p, ("a", "b")).select("task_id", "task_type", "prompt", F.col("metadata")["shuffled"].alias("shuffled"), F.col("responses")[0].alias("first_response"))


# scaling: part sizes as model sizes, two metrics of each


@query(f"select doc_id, round(case when len({tokens('text')}) between 10 and 500 then 0.3 else 0 end + case when contains(text, '.') then 0.3 else 0 end + case when len(list_distinct({tokens('text')}))::double / greatest(len({tokens('text')}), 1) > 0.5 then 0.4 else 0 end, 6)::double score from documents")
def scaling_coherence(read, spark):
    return read("documents").select("doc_id", F.round(scaling.coherence(F.col("text")), 6).alias("score"))


@query(f"select n_chars // 1000 size, round(avg((length({trimmed('text')}) > 10)::int), 6) completion_rate, round(avg(len({tokens('text')})), 6) avg_length from documents group by 1")
def scaling_responses(read, spark):
    d = read("documents").select(F.floor(F.col("n_chars") / 1000).alias("size"), F.col("text").alias("response"))
    return _ROUND(scaling.response_metrics(d).drop("coherence"), ("size",))


_M = "(select p_size size, 'price' metric, avg(p_retailprice) \"value\" from part group by 1 union all select p_size, 'perplexity', avg(p_partkey % 97) from part group by 1)"


def _metrics(read):
    p = read("part").groupBy(F.col("p_size").alias("size"))
    return p.agg(F.avg("p_retailprice").alias("value")).select("size", F.lit("price").alias("metric"), "value").union(p.agg(F.avg(F.col("p_partkey") % 97).alias("value")).select("size", F.lit("perplexity"), "value"))


@query(f"with b as {_M} select size, metric, round(case when metric = 'perplexity' then (\"value\" * (1 + size / 100) - \"value\") / \"value\" else (\"value\" - \"value\" * (1 + size / 100)) / \"value\" end, 6) tax from b where \"value\" <> 0")
def alignment_tax(read, spark):
    b = _metrics(read)
    return _ROUND(scaling.alignment_tax(b, b.withColumn("value", F.col("value") * (1 + F.col("size") / 100))), ("size", "metric"))


@query(f"select metric, round(regr_slope(\"value\", ln(size)), 6) slope, round(regr_intercept(\"value\", ln(size)), 6) intercept from {_M} group by 1")
def loglinear_fit(read, spark):
    return _ROUND(scaling.log_linear(_metrics(read)), ("metric",))


@query(f"with x as (select metric, size, \"value\", lag(\"value\") over (partition by metric order by size) p, lag(size) over (partition by metric order by size) ps from {_M}), y as (select *, case when p > 0 then (\"value\" - p) / p else \"value\" end i from x where p is not null) select metric, size, ps previous_size, round(p, 6) previous, round(\"value\", 6) \"value\", round(i, 6) improvement from y where i > 0.02")
def emergence(read, spark):
    x = scaling.emergence(_metrics(read), 0.02)
    return _ROUND(x.select("metric", "size", "previous_size", "previous", "value", "improvement"), ("metric", "size"))


@query(f"with x as (select metric, size, abs(\"value\" - lag(\"value\") over (partition by metric order by size)) s from {_M}) select metric, arg_max(size, s) size, round(max(s), 6) jump, max(s) > 2 * avg(s) notable from x where s is not null group by 1")
def largest_jump(read, spark):
    return _ROUND(scaling.largest_jump(_metrics(read)), ("metric", "size"))


@query("select l_returnflag, round(exp(sum(l_discount * l_quantity) / sum(l_quantity)), 6) perplexity from lineitem group by 1")
def corpus_perplexity(read, spark):
    return _ROUND(scaling.perplexity(read("lineitem"), "l_discount", "l_quantity", ["l_returnflag"]), ("l_returnflag",))


# streams


@query(f"select event_type reason, count(*) n from events group by 1")
def stream_event_reasons(read, spark):
    """A stream of the events folder, drained once, counted by type: the sum of its windows."""
    import uuid

    from ..scratch import scratch_dir
    from ..streaming import curation

    src = read("events")
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    src.write.parquet(f"{base}/in")
    s = spark.readStream.schema(src.schema).parquet(f"{base}/in").withColumn("reason", F.col("event_type"))
    q = curation.windowed_reasons(s, window="1 day").writeStream.outputMode("complete").format("memory").queryName(f"w{uuid.uuid4().hex}").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.table(q.name).groupBy("reason").agg(F.sum("n").alias("n"))
    return out

