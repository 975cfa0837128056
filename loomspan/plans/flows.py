"""Whole flows and what goes around the operators: benchmarks, reports, records, batches, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import benchmarks, chat, comparison, curation, hacking, human_eval, losses, models, preference, quality, rewards, scaling, screening, synthetic
from ..operators import token_arrays as K
from ..sources import io
from .curation import _C, _CONV, _DOCS, _LEXICON, _REASON, _conversations
from .evaluation import _AGREES, _LOW, _M, _MAJ, _RESP, _ROUND, _metrics, _responses, _wilson
from .pairs import _IDS, _LONG, _ids, _long
from .registry import contained, ngrams, query, quoted, repetition, tokens, trimmed, words

# rows


@query("select doc_id, source from documents order by doc_id limit 50")
def ordered_head(read, spark):
    return io.head(read("documents").select("doc_id", "source"), 50, "doc_id")


@query("select source, count(distinct text) texts, count(distinct model_name) writers, count(*) n from documents group by 1")
def distinct_counts(read, spark):
    return read("documents").groupBy("source").agg(F.count_distinct("text").alias("texts"), F.count_distinct("model_name").alias("writers"), F.count("*").alias("n"))


@query("select 'both' part, count(*) n from (select chosen from preference_pairs where chosen is not null intersect select rejected from preference_pairs where rejected is not null) union all select 'chosen', count(*) from (select chosen from preference_pairs where chosen is not null except select rejected from preference_pairs where rejected is not null) union all select 'all', count(*) from (select chosen from preference_pairs where chosen is not null union select rejected from preference_pairs where rejected is not null)")
def set_operations(read, spark):
    p = read("preference_pairs")
    a, b = p.select(F.col("chosen").alias("x")).where("x is not null"), p.select(F.col("rejected").alias("x")).where("x is not null")
    n = lambda name, x: x.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return n("both", a.intersect(b)).union(n("chosen", a.exceptAll(b).distinct().join(b, "x", "left_anti"))).union(n("all", a.union(b).distinct()))


@query(f"select pair_id, coalesce(length({trimmed('chosen')}) > 10, false) long_enough from preference_pairs")
def response_min_length(read, spark):
    return read("preference_pairs").select("pair_id", preference.long_enough(F.col("chosen")).alias("long_enough"))


@query("select pair_id, (row_number() over (order by pair_id) - 1) // 32 batch from preference_pairs")
def mini_batches(read, spark):
    return K.batches(read("preference_pairs").select("pair_id"), 32, "pair_id")


@query("select pair_id, (row_number() over (order by md5(pair_id::varchar || ':7'), pair_id) - 1) // 32 batch from preference_pairs")
def shuffled_batches(read, spark):
    return K.batches(read("preference_pairs").select("pair_id"), 32, "pair_id", shuffle=7)


@query("select batch, count(*) n, array_to_string(list(pair_id order by pair_id), ' ') pair_ids from (select pair_id, (row_number() over (order by pair_id) - 1) // 8 batch, count(*) over () c from preference_pairs) where (batch + 1) * 8 <= c group by 1")
def collated_batches(read, spark):
    x = K.stack(K.batches(read("preference_pairs").select("pair_id"), 8, "pair_id", drop_last=True), ["pair_id"], "pair_id")
    return x.select("batch", F.size("pair_id").cast("long").alias("n"), F.array_join(F.col("pair_id").cast("array<string>"), " ").alias("pair_ids"))


# token arrays

def _word_lengths(text: str) -> list[int]:
    return [len(w) for w in text.split()]


@query("select pair_id, length(trim(regexp_replace(coalesce(prompt, '') || ' ' || coalesce(chosen, ''), '[ \\n\\t\\r]+', ' ', 'g'), ' ')) > 0 has_tokens, 48 n from preference_pairs")
def preference_items(read, spark):
    x = preference.item(read("preference_pairs"), _word_lengths, 48)
    return x.select("pair_id", (F.array_max("chosen_mask") == 1).alias("has_tokens"), F.size("rejected_ids").alias("n"))


@query(
    f"""with x as (select pair_id, ids[1:40] ids, pair_id // 8 b from {_IDS}), y as (select *, (ceil(max(len(ids)) over (partition by b) / 8.0) * 8)::int n from x)
 select pair_id, n length, len(ids)::int kept, list_sum(ids)::bigint total, (list_sum(ids[6:]))::bigint labelled from y where len(ids) > 0"""
)
def collator_chat(read, spark):
    """The first five tokens are a user's turn, so they are not labelled."""
    user = F.array(F.struct(F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit("user").alias("role")))
    x = _ids(read).withColumn("batch", F.floor(F.col("pair_id") / 8)).withColumn("turns", user)
    y = K.collate(x, 40, kind="chat", ids="ids", spans="turns").where(F.size("ids") > 0)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    seen = F.filter("labels", lambda v: v != K.IGNORE)
    kept = F.size(F.filter("attention_mask", lambda v: v == 1))
    return y.select("pair_id", F.size("input_ids").alias("length"), kept.alias("kept"), total(F.col("input_ids")).alias("total"), F.when(F.size(seen) > 0, total(seen)).alias("labelled"))


@query(f"select pair_id, length(coalesce(prompt, '')) + 8 user_chars, length(coalesce(chosen, '')) + 13 assistant_chars from preference_pairs where not regexp_matches(coalesce(prompt, '') || coalesce(chosen, ''), 'INST|USER:|ASSISTANT:|Human:|Assistant:|<.(im_start|user|assistant)')")
def turn_boundaries(read, spark):
    none = ~F.concat(F.coalesce("prompt", F.lit("")), F.coalesce("chosen", F.lit(""))).rlike("INST|USER:|ASSISTANT:|Human:|Assistant:|<.(im_start|user|assistant)")
    text = F.concat(F.lit("<|user|>"), F.coalesce("prompt", F.lit("")), F.lit("<|assistant|>"), F.coalesce("chosen", F.lit("")))
    x = read("preference_pairs").where(none).select("pair_id", K.turn_spans(text).alias("s"))
    of = lambda role: F.aggregate(F.filter("s", lambda t: t["role"] == role), F.lit(0), lambda a, t: a + t["end"] - t["start"])
    return x.select("pair_id", of("user").alias("user_chars"), of("assistant").alias("assistant_chars"))


# requests and pairs


def _sql_fill(template: str, **values: str) -> str:
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [quoted(before), f"coalesce({values[name]}, '')"]
    return " || ".join([*out, quoted(rest)])


@query(f"select pair_id, {_sql_fill(preference.CRITIQUE, principle=quoted(preference.PRINCIPLES[0]), prompt='prompt', response='chosen')} as request from preference_pairs")
def critique_requests(read, spark):
    return read("preference_pairs").select("pair_id", preference.filled(preference.CRITIQUE, principle=F.lit(preference.PRINCIPLES[0]), prompt=F.col("prompt"), response=F.col("chosen")).alias("request"))


@query(f"select pair_id, {_sql_fill(preference.REVISION, prompt='prompt', response='rejected', critique='chosen')} as request from preference_pairs")
def revision_requests(read, spark):
    return read("preference_pairs").select("pair_id", preference.filled(preference.REVISION, prompt=F.col("prompt"), response=F.col("rejected"), critique=F.col("chosen")).alias("request"))


@query(f"select pair_id, {_sql_fill(preference.RANKING, prompt='prompt', response_a='chosen', response_b='rejected')} as request from preference_pairs")
def ranking_requests(read, spark):
    return read("preference_pairs").select("pair_id", preference.filled(preference.RANKING, prompt=F.col("prompt"), response_a=F.col("chosen"), response_b=F.col("rejected")).alias("request"))


_PRINCIPLES = "[" + ", ".join(quoted(p) for p in preference.PRINCIPLES) + "][(('0x' || substr(md5(pair_id::varchar), 1, 7))::bigint % 4 + 1)::int]"


@query(f"select prompt, chosen, rejected, {_PRINCIPLES} principle from preference_pairs where length(chosen) > 0 and length(rejected) > 0")
def constitutional_pairs(read, spark):
    p = read("preference_pairs")
    x = p.select("prompt", F.col("rejected").alias("response"), preference.principle_of(F.col("pair_id")).alias("principle"), F.lit("too short").alias("critique"), F.col("chosen").alias("revision"))
    return preference.flattened(preference.constitutional_pairs(x), ["principle"])


@query("select coalesce(strategy, '') strategy, case when lower(strategy) = 'reward_model' then 'reward_model' when lower(strategy) = 'constitutional' then 'constitutional' else 'model_ranking' end way, count(*) n from preference_pairs group by all")
def strategy_dispatch(read, spark):
    return read("preference_pairs").select(F.coalesce("strategy", F.lit("")).alias("strategy"), preference.way_of(F.col("strategy")).alias("way")).groupBy("strategy", "way").agg(F.count("*").alias("n"))


@query("select pair_id, prompt, chosen, rejected from preference_pairs")
def human_label_pairs(read, spark):
    return preference.from_human_labels(read("preference_pairs").select("pair_id", "prompt", "chosen", "rejected"))


@query("select task_id, prompt, metadata['shuffled'] shuffled, metadata['model_names'] model_names from annotation_tasks where metadata is not null")
def flattened_metadata(read, spark):
    return preference.flattened(read("annotation_tasks").where("metadata is not null").select("task_id", "prompt", "metadata"), ["shuffled", "model_names", "prompt"])


@query("select unnest([0.3, 0.7, 1.0]::double[]) temperature, 1::bigint n")
def reward_temperatures(read, spark):
    return spark.createDataFrame([(t,) for t in preference.reward_temperatures(4, [0.3, 0.7, 1.0])], "temperature double").groupBy("temperature").agg(F.count("*").alias("n"))


# chat


@query("select t template, b bos_token, e eos_token, '' sep_token from (values ('chatml', '', '<|im_end|>'), ('alpaca', '', ''), ('llama2', '<s>', '</s>'), ('vicuna', '', '</s>'), ('zephyr', '', '</s>'), ('mistral', '<s>', '</s>')) v(t, b, e)")
def special_token_table(read, spark):
    x = spark.createDataFrame([(t,) for t in chat.RESPONSE_MARKERS], "template string")
    return x.select("template", chat.special_token_columns(F.col("template")).alias("s")).select("template", "s.*")


@query("select pair_id, '<|im_start|>user\n' || coalesce(prompt, '') || '<|im_end|>\n<|im_start|>assistant\n' || case when coalesce(chosen, '') <> '' then chosen || '<|im_end|>\n' else '' end as text from preference_pairs")
def sft_script_text(read, spark):
    return chat.script_text(read("preference_pairs").select("pair_id", "prompt", F.col("chosen").alias("response"))).select("pair_id", "text")


@query(f"select question_id, {_CONV['chatml'][0]} as text from {_C}")
def sft_messages(read, spark):
    return chat.sft_text(_conversations(read)).select("question_id", "text")


@query("select question_id, coalesce(turns[1], '') || chr(10) || chr(10) || coalesce(answers[1], '') as text from judged_questions")
def sft_other_columns(read, spark):
    c = lambda x: F.coalesce(F.get(x, F.lit(0)), F.lit(""))
    return chat.sft_text(read("judged_questions").select("question_id", c("turns").alias("question"), c("answers").alias("answer"))).select("question_id", "text")


@query("select doc_id, text, text formatted_text from documents")
def formatted_column(read, spark):
    return chat.format_dataset(read("documents").select("doc_id", "text"))


@query("select question_id, 'user: ' || turns[1] || chr(10) || 'assistant: ' || answers[1] as text from judged_questions where length(turns[1]) > 0 and length(answers[1]) > 0")
def built_conversations(read, spark):
    x = read("judged_questions").where("length(turns[0]) > 0 and length(answers[0]) > 0")
    return x.select("question_id", chat.plain_conversation(chat.user_conversation(F.col("turns")[0], F.col("answers")[0], F.lit(""))).alias("text"))


# quality and screening


@query(f"select doc_id, case when text is not null then {_REASON} end reason from {_DOCS}")
def quick_checks(read, spark):
    d = read("documents").withColumn("w", T.words(F.col("text")))
    return d.select("doc_id", quality.quick_reason(F.col("text"), F.col("w")).alias("reason"))


def _length_score(texts: list[str]) -> list[float]:
    return [float(len(t)) for t in texts]


@query(f"select doc_id, coalesce({_REASON}, case when length(text) > 800 then 'high_perplexity' end) reason from {_DOCS}")
def deferred_perplexity(read, spark):
    return quality.with_deferred_perplexity(read("documents").select("doc_id", "text"), _length_score, quality.QualityRules(max_perplexity=800.0)).select("doc_id", "reason")


_TOX = f"least(1.0, {contained('lower(text)', _LEXICON)} / 1.0)"


@query(f"select id, case when {_TOX} > 0.7 then 1 else 0 end toxic, 2 scores from quality_texts where text is not null")
def score_rows(read, spark):
    x = read("quality_texts").where("text is not null").select("id", F.least(F.lit(1.0), T.count_contained(F.lower("text"), _LEXICON) / 1.0).alias("toxicity"), F.lit(None).cast("double").alias("threat"), F.lit(0.1).alias("insult"))
    m = screening.score_map(x)
    return m.select("id", F.when(F.col("scores")["toxicity"] > 0.7, 1).otherwise(0).alias("toxic"), F.size("scores").alias("scores"))


@query(f"with r as (select case when text is null or length({trimmed('text')}) = 0 then 'invalid_type' when {_TOX} > 0.7 then 'toxic_toxicity' else 'kept' end reason from quality_texts), g as (select reason, count(*) n from r group by 1) select (select sum(n) from g)::bigint total, (select sum(n) from g where reason = 'kept')::bigint passed, (select sum(n) from g where reason <> 'kept')::bigint removed, reason, n from g")
def toxicity_removal(read, spark):
    x = read("quality_texts").select("id", "text", F.create_map(F.lit("toxicity"), F.least(F.lit(1.0), T.count_contained(F.lower("text"), _LEXICON) / 1.0)).alias("scores"))
    return screening.remove_toxic(x)[1]


@query(
    f"""with q as (select doc_id, text, case when text is null then 'invalid_type' when length(text) < 200 then 'too_short' when length(text) > 100000 then 'too_long' when len(w) < 10 then 'too_few_words' when not regexp_matches(text, '[.!?]') then 'no_punctuation' when {repetition('w')} > 0.3 then 'too_repetitive' end reason from {_DOCS})
 select doc_id from (select doc_id, row_number() over (partition by sha256(text) order by doc_id) r from q where reason is null) where r = 1"""
)
def curated_by_settings(read, spark):
    c = curation.Curator.from_settings({"quality": {"min_length": 200}, "deduplication": {"enabled": True, "method": "exact"}, "toxicity": False})
    return c.run(read("documents"))[0].select("doc_id")


# losses


@query("select pair_id, round(chosen_score / greatest(coalesce(length(chosen), 0), 1), 9) reward from preference_pairs where chosen_score is not null")
def length_normalised_reward(read, spark):
    p = read("preference_pairs").where("chosen_score is not null")
    return p.select("pair_id", F.round(losses.length_normalised(F.col("chosen_score"), F.coalesce(F.length("chosen"), F.lit(0))), 9).alias("reward"))


@query("select l_orderkey, l_linenumber, l_discount::double as returns, round((d - avg(d) over ()) / (stddev_samp(d) over () + 1e-8), 6) advantage from (select l_orderkey, l_linenumber, l_discount, (l_discount - l_tax)::double d from lineitem)")
def ppo_advantages(read, spark):
    x = read("lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").cast("double").alias("r"), F.col("l_tax").cast("double").alias("v"))
    return losses.advantages(x, "r", "v").select("l_orderkey", "l_linenumber", "returns", F.round("advantage", 6).alias("advantage"))


@query("select round(avg(chosen_score), 6) mean_reward, round(stddev_samp(chosen_score), 6) std_reward, round(avg(length(chosen)), 6) mean_length from preference_pairs")
def ppo_evaluation(read, spark):
    return _ROUND(losses.policy_evaluation(read("preference_pairs"), "chosen_score", "chosen"))


_DPO = "(select l_orderkey // 512 b, 0.1 * (-l_quantity / 10 + l_quantity / 11) c, 0.1 * (-l_discount * 20 + l_tax * 30) r, 0.1 * ((-l_quantity / 10 + l_quantity / 11) - (-l_discount * 20 + l_tax * 30)) z from lineitem)"


@query(f"select round(avg(l), 6) loss, round(avg(a), 6) accuracy, round(avg(c), 6) chosen_reward, round(avg(r), 6) rejected_reward from (select b, avg(greatest(-z, 0) + ln(1 + exp(-abs(z)))) l, avg((c > r)::int) a, avg(c) c, avg(r) r from {_DPO} group by 1)")
def dpo_evaluation(read, spark):
    x = read("lineitem").select(F.floor(F.col("l_orderkey") / 512).alias("b"), (-F.col("l_quantity") / 10).alias("pc"), (-F.col("l_discount") * 20).alias("pr"), (-F.col("l_quantity") / 11).alias("rc"), (-F.col("l_tax") * 30).alias("rr"))
    return _ROUND(losses.dpo_evaluation(x, "b", "pc", "pr", "rc", "rr"))


# reward hacking

_FILLS = "(" + " + ".join(f"regexp_matches({_LOW}, {quoted(p)})::int" for p in hacking.FILLERS) + ")"
_TMPL = "greatest(" + ", ".join(f"(count_if(regexp_matches(response, {quoted('(?im)' + p)})) > count(*) * 0.4)::int" for _, p in hacking.TEMPLATES) + ")"
_FOUND = f"""len_ as (select abs(coalesce(corr(len({tokens('response')}), reward), 0)) c, sum({_FILLS}) / count(*) f from {_RESP}),
 syc as (select count_if({contained('lower(prompt)', hacking.OPINION_RATE)} > 0 and {_AGREES})::double / count_if({contained('lower(prompt)', hacking.OPINION_RATE)} > 0) a, avg(({contained(_LOW, hacking.FLATTERY_KEYWORDS)} > 0)::int) f from {_RESP}),
 grams as (select unnest({ngrams('w', 4)}) g from (select {words('response')} w from {_RESP})),
 phr as (select count(*) n from (select g, count(*) n from grams group by 1 order by n desc, g limit 20) where n >= 3),
 rep as (select {', '.join(f"avg({repetition('w', n)}) m{n}" for n in (3, 4, 5))} from (select {words('response')} w from {_RESP})),
 tmp as (select {_TMPL} t from {_RESP}),
 found as (select 'length' category, case when c > 0.7 then 'severe' when c > 0.5 or f > 0.3 then 'mild' else 'none' end severity, (c > 0.5 or f > 0.3) detected from len_
  union all select 'sycophancy', case when a > 0.9 then 'severe' when a > 0.8 or f > 0.5 then 'mild' else 'none' end, (a > 0.8 or f > 0.5) from syc
  union all select 'repetition', case when coalesce(case when m5 > 0.3 then m5 when m4 > 0.3 then m4 when m3 > 0.3 then m3 end, 0) > 0.5 then 'severe' when greatest(m3, m4, m5) > 0.3 or n > 5 then 'mild' else 'none' end, (greatest(m3, m4, m5) > 0.3 or n > 5 or t > 0) from rep, phr, tmp)"""
_RISK = "(case when not detected then 0.0 when severity = 'severe' then 0.9 when severity = 'mild' then 0.5 else 0.2 end)::double"


@query(f"with {_FOUND} select category, detected, severity, {_RISK} risk, case when detected then category || ': ' || severity end issue, case when {_RISK} >= 0.3 then 2 else 0 end advice from found")
def hacking_report(read, spark):
    r = hacking.report(hacking.findings(_responses(read)))
    return r.select("category", "detected", "severity", "risk", "issue", F.size("recommendations").alias("advice"))


_ADVICE = "(values " + ", ".join(f"({quoted(k)}, {quoted(t)})" for k, v in hacking.RECOMMENDATIONS.items() for t in v) + ") v(k, t)"


@query(f"with {_FOUND}, advice as (select t recommendation from found join {_ADVICE} on k = category where {_RISK} >= 0.3) select recommendation from advice union all select {quoted(hacking.NO_RECOMMENDATION)} where not exists (select 1 from advice)")
def hacking_recommendations(read, spark):
    return hacking.recommendations(hacking.report(hacking.findings(_responses(read))))


@query(
    f"""with {_FOUND}, x as (select 'length' category, 'filler_content' as "type", row_number() over (order by pair_id) k, response from {_RESP} where {_FILLS} > 0
 union all select 'sycophancy', 'sycophantic_responses', row_number() over (order by pair_id), response from {_RESP} where ({contained('lower(prompt)', hacking.OPINION)} > 0 and {_AGREES}) or {contained(_LOW, hacking.FLATTERY_KEYWORDS)} >= 2)
 select category, "type", k "rank", case when length(response) > 200 then response[1:200] || '...' else response end sample from x where k <= 3 and category in (select category from found where detected)
 union all select 'repetition', 'repeated_phrases', k, replace(g, chr(1), ' ') from (select g, row_number() over (order by n desc, g) k from (select g, count(*) n from grams group by 1 having count(*) >= 3)) where k <= 5 and exists (select 1 from found where category = 'repetition' and detected)"""
)
def hacking_evidence(read, spark):
    x = _responses(read)
    return hacking.evidence(x, hacking.report(hacking.findings(x)), "pair_id").withColumn("rank", F.col("rank").cast("long"))


_DIS = "(" + " or ".join(f"regexp_matches({_LOW}, {quoted(p)})" for p in hacking.DISAGREEMENT) + f" or contains({_LOW}, 'actually') or contains({_LOW}, 'incorrect'))"


@query(f"select round(avg({_DIS}::int), 6) disagreement_rate, count_if({_DIS})::bigint correct_corrections, count(*) total_tests from {_RESP}")
def disagreement_rate(read, spark):
    return _ROUND(hacking.disagreement_test(_responses(read)))


@query(f"select pair_id, length(response) length from {_RESP} order by length(response) desc, pair_id limit 5")
def longest_samples(read, spark):
    return hacking.longest_samples(_responses(read), "pair_id").withColumn("length", F.col("length").cast("long"))


# judged benchmarks

_JUDGE = lambda q, a: f"least(greatest(5.0::double + case when length({a}) < 50 then -2 when length({a}) > 100 then 1 else 0 end + case when len(list_intersect(list_distinct({words(q)}), list_distinct({words(a)})))::double / greatest(len(list_distinct({words(q)})), 1) > 0.2 then 1 else 0 end + case when ends_with({a}, '.') or ends_with({a}, '!') or ends_with({a}, '?') or ends_with({a}, '```') then 0.5 else 0 end, 1), 10)"
_TURNS = f"t as (select question_id, coalesce(category, 'general') category, k turn, {_JUDGE('q', 'a')} score from (select question_id, category, unnest(range(0, least(len(turns), len(answers)))) k, coalesce(unnest(turns[1:least(len(turns), len(answers))]), '') q, coalesce(unnest(answers[1:least(len(turns), len(answers))]), '') a from judged_questions))"


@query(f"with {_TURNS} select 'given' model, case when category is not null then 'category' when turn is not null then 'turn' else 'overall' end \"scope\", coalesce(category, turn::varchar, '') \"key\", round(avg(score), 6) score, count(*) n from t group by grouping sets ((category), (turn), ()) union all select 'given', 'question', question_id::varchar, round(avg(score), 6), count(*) from t group by question_id, category")
def multi_turn_benchmark(read, spark):
    return _ROUND(benchmarks.multi_turn_benchmark(read("judged_questions"), model="given"), ("model", "scope", "key"))


_PAIR = "(select pair_id, coalesce(prompt, '') p, coalesce(chosen, '') a, coalesce(rejected, '') b, length(coalesce(chosen, '')) + case when ends_with(chosen, '.') then 10 else 0 end > length(coalesce(rejected, '')) + case when ends_with(rejected, '.') then 10 else 0 end w from preference_pairs where prompt is not null)"


@query(f"select case when length(p) > 100 then p[1:100] || '...' else p end instruction, length(a)::int model_length, length(b)::int reference_length, coalesce(w, length(a) + case when ends_with(a, '.') then 10 else 0 end > length(b) + case when ends_with(b, '.') then 10 else 0 end) win from {_PAIR}")
def instruction_rows(read, spark):
    return benchmarks.instruction_rows(read("preference_pairs").where("prompt is not null"), "chosen", "rejected", "prompt")


_WIN = "(length(a) + case when ends_with(a, '.') then 10 else 0 end > length(b) + case when ends_with(b, '.') then 10 else 0 end)::int"


@query(f"with x as (select {_WIN} w, length(a) / greatest(length(b), 1) r from {_PAIR}) select 'chosen' model, round(avg(w) * 100, 6) win_rate, (select round(avg(m) * 100, 6) from (select avg(w) m from x group by case when r < 0.8 then 's' when r > 1.2 then 'l' else 'm' end)) length_controlled_win_rate, count(*) n from x")
def instruction_benchmark(read, spark):
    return _ROUND(benchmarks.instruction_benchmark(read("preference_pairs").where("prompt is not null"), "chosen", "rejected", "chosen"))


@query(f"select m model, round(avg({_JUDGE('p', 'x')}), 6) score, count(*) n from (select 'chosen' m, p, a x from {_PAIR} union all select 'rejected', p, b from {_PAIR}) group by 1")
def model_comparison(read, spark):
    p = read("preference_pairs").where("prompt is not null")
    one = lambda c: p.select(benchmarks.local_judge(F.col("prompt"), F.coalesce(c, F.lit(""))).alias("score")).agg(F.avg("score").alias("score"), F.count("*").alias("n"))
    return _ROUND(benchmarks.compare_models({c: one(c) for c in ("chosen", "rejected")}), ("model",))


@query(f"select model, m metric, round(v, 6) \"value\" from (select model, unnest(['mean', 'std', 'chars']) m, unnest([avg(reward), stddev_samp(reward), avg(length(response))]) v from {_LONG} group by 1)")
def merged_metrics(read, spark):
    x = _long(read)
    a, b = comparison.summary(x, "reward").select("model", "mean", "std"), comparison.char_lengths(x, "response").select("model", F.col("mean").alias("chars"))
    return comparison.merged_metrics(a, b).select("model", "metric", F.round("value", 6).alias("value"))


# human evaluation


@query(
    f"""with {_MAJ}, c as (select count(*) n, count_if(preference = 0)::double a, count_if(preference = 1)::double b, count_if(preference = 2)::double t from m), w as (select n, round(a / n, 6) a, round(b / n, 6) b, round(t / n, 6) tie, round({_wilson('a', '-')}, 6) a_lo, round({_wilson('a', '+')}, 6) a_hi, round({_wilson('b', '-')}, 6) b_lo, round({_wilson('b', '+')}, 6) b_hi from c)
 select (select count(distinct task_id) from annotations) total_tasks, (select count(*) from annotations) total_annotations, (select count(distinct annotator_id) from annotations) num_annotators, (select round(avg(votes / total), 6) from m where total >= 2) agreement_rate, a, b, tie, a_lo, a_hi, b_lo, b_hi from w"""
)
def human_eval_summary(read, spark):
    x = _ROUND(human_eval.summary(read("annotations")))
    return x.select("total_tasks", "total_annotations", "num_annotators", "agreement_rate", "a", "b", "tie", "a_lo", "a_hi", "b_lo", "b_hi")


@query("select task_id, annotator_id, coalesce(preference, -1) preference, coalesce(comments, '') comments, coalesce(ratings is not null and cardinality(ratings) > 0, false) rated from annotations where task_id is not null")
def annotation_records(read, spark):
    x = human_eval.from_records(human_eval.to_records(read("annotations"), human_eval.ANNOTATION_SCHEMA), human_eval.ANNOTATION_SCHEMA)
    return x.select("task_id", "annotator_id", F.coalesce("preference", F.lit(-1)).alias("preference"), "comments", (F.size("ratings") > 0).alias("rated"))


@query("select lower(trim(task_type)) task_type, count(*) n from annotation_tasks where task_type is not null group by 1")
def checked_task_types(read, spark):
    return read("annotation_tasks").where("task_type is not null").groupBy(human_eval.checked_type(F.col("task_type")).alias("task_type")).agg(F.count("*").alias("n"))


# scaling


@query(f"select s.size size, m metric, round(\"value\", 6) \"value\" from (select unnest([1, 7, 1000]) size) s cross join (select unnest(['price', 'perplexity']) m) left join {_M} x on x.size = s.size and x.metric = m")
def metric_lookup(read, spark):
    wanted = spark.createDataFrame([(s, m) for s in (1, 7, 1000) for m in ("price", "perplexity")], "size int, metric string")
    return _ROUND(scaling.metric_at(_metrics(read), wanted), ("size", "metric"))


@query(f"with x as (select metric, size, abs(\"value\" - lag(\"value\") over (partition by metric order by size)) s, count(*) over (partition by metric) n from {_M}) select metric, metric || ': Potential emergence detected at size ' || arg_max(size, s) note from x where s is not null and n >= 3 group by metric having max(s) > 2 * avg(s)")
def jump_notes(read, spark):
    return scaling.jump_notes(_metrics(read))


# flows with injected models; the models are functions that SQL can say as well


def _shout(texts: list[str]) -> list[str]:
    return [t.upper() for t in texts]


def _tail(texts: list[str]) -> list[str]:
    return [t.split("Original Instruction: ", 1)[-1].rsplit("\n\n", 1)[0] + " Say why." for t in texts]


@query("select pair_id, trim(upper(prompt), ' ') response, round(length(trim(upper(prompt), ' ')), 6)::double reward from preference_pairs where prompt is not null and not starts_with(upper(prompt), prompt) and not regexp_matches(prompt, '[^\\x00-\\x7F]')")
def generated_and_scored(read, spark):
    p = read("preference_pairs").where("prompt is not null and not startswith(upper(prompt), prompt)").where(~F.col("prompt").rlike(r"[^\x00-\x7F]")).select("pair_id", "prompt")
    return models.score(models.generate(p, _shout, "prompt"), _length_score, "response", "reward").select("pair_id", "response", "reward")


@query(
    """with o as (select pair_id, prompt p from preference_pairs where prompt is not null), a as (select pair_id, trim(p || ' Say why.', ' ') p1, p from o),
 v as (select pair_id, p1 from a where length(p1) >= 10 and not regexp_matches(lower(p1), 'i cannot|i''m sorry|as an ai|i don''t understand')),
 b as (select pair_id, trim(p1 || ' Say why.', ' ') p2 from v) select 0 depth, count(*) n, sum(length(p))::bigint chars from o union all select 1, count(*), sum(length(p1))::bigint from v union all select 2, count(*), sum(length(p2))::bigint from b"""
)
def evolution_chain(read, spark):
    p = read("preference_pairs").where("prompt is not null").select(F.col("pair_id").alias("id"), F.col("prompt").alias("instruction"))
    x = synthetic.evolve(p, _tail, ["deepen", "concretize"])
    return x.groupBy(F.col("evolution_depth").alias("depth")).agg(F.count("*").alias("n"), F.sum(F.length("instruction")).alias("chars"))


@query("select i instruction, '' \"input\", '' \"output\" from (select distinct turns[1] i from judged_questions where turns[1] is not null) order by md5(i || ':3'), i limit 5")
def sampled_examples(read, spark):
    seeds = read("judged_questions").where("turns[0] is not null").select(F.col("turns")[0].alias("instruction")).distinct().select("instruction", F.lit("").alias("input"), F.lit("").alias("output"))
    return synthetic.sample_examples(seeds, None, 5, salt=3)


@query("select 3.0::double a, -0.7::double b, 1.0::double c")
def power_law_fit(read, spark):
    """A law that the sizes of parts follow exactly is found again."""
    m = read("part").select(F.col("p_size").alias("size")).distinct().select("size", F.lit("loss").alias("metric"), (3 * F.pow("size", F.lit(-0.7)) + 1).alias("value"))
    law = scaling.fit_laws(m)["loss"]
    return spark.createDataFrame([tuple(round(law[k], 2) for k in "abc")], "a double, b double, c double")


@query("select count(length(chosen)) n, round(avg(length(chosen)), 6) mean, round(quantile_cont(length(chosen), 0.5), 6) p50 from preference_pairs where chosen is not null")
def scored_distribution(read, spark):
    p = read("preference_pairs").where("chosen is not null").select("pair_id", "chosen")
    return _ROUND(rewards.distribution_of(p, _length_score, "chosen").select("n", "mean", "p50"))
