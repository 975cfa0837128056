"""Quality, deduplication, screening and chat formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chat, dedup, models, quality, screening, synthetic
from ..operators.curation import Curator
from .registry import contained, query, quoted, repetition, trimmed, words

_REASON = f"""case when text is null then 'invalid_type' when length(text) < 50 then 'too_short' when length(text) > 100000 then 'too_long'
 when len(w) < 10 then 'too_few_words' when not regexp_matches(text, '[.!?]') then 'no_punctuation' when {repetition('w')} > 0.3 then 'too_repetitive' end"""
_DOCS = f"(select doc_id, text, {words('text')} w from documents)"


@query(f"with r as (select coalesce(reason, 'kept') reason, count(*) n from (select {_REASON} reason from {_DOCS}) group by 1) select (select sum(n)::bigint from r) total, (select coalesce(sum(n) filter (where reason = 'kept'), 0)::bigint from r) passed, (select coalesce(sum(n) filter (where reason <> 'kept'), 0)::bigint from r) removed, reason, n from r")
def quality_stats(read, spark):
    return quality.filter_stats(quality.with_reason(read("documents")))


@query(f"select doc_id, {_REASON} reason from {_DOCS}")
def quality_reasons(read, spark):
    return quality.with_reason(read("documents")).select("doc_id", "reason")


@query(f"select id, {_REASON} reason from (select id, text, {words('text')} w from quality_texts)")
def quality_reasons_dirty(read, spark):
    return quality.with_reason(read("quality_texts")).select("id", "reason")


@query(f"select doc_id, round({repetition('w')}, 6) score from {_DOCS}")
def repetition_score(read, spark):
    d = read("documents").withColumn("w", T.words(F.col("text")))
    return d.select("doc_id", F.round(T.repetition(F.col("w")), 6).alias("score"))


_SENTS = f"list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: {trimmed('s')}), lambda s: s <> ''), lambda s: list_distinct({words('s')}))"
_COHERENCE = "case when len(s) < 2 then 1.0::double else list_sum(list_transform(range(1, len(s)), lambda i: case when len(s[i]) > 0 and len(s[i + 1]) > 0 then len(list_intersect(s[i], s[i + 1]))::double / least(len(s[i]), len(s[i + 1])) else 0 end)) / (len(s) - 1) end"


@query(f"select doc_id, round({_COHERENCE}, 6) score from (select doc_id, {_SENTS} s from documents)")
def coherence_score(read, spark):
    d = read("documents").select("doc_id", T.sentence_sets(F.col("text")).alias("sets"))
    return d.select("doc_id", F.round(T.coherence(F.col("sets")), 6).alias("score"))


@query("select doc_id from (select doc_id, row_number() over (partition by sha256(text) order by doc_id) r from documents) where r = 1")
def exact_dedup(read, spark):
    return dedup.exact_dedup(read("documents")).select("doc_id")


@query(
    f"""with q as (select doc_id, text, {_REASON} reason from {_DOCS}), k as (select doc_id, text from q where reason is null),
 x as (select case when row_number() over (partition by sha256(text) order by doc_id) > 1 then 'exact_duplicate' end reason from k),
 s as (select 0 "position", 'quality' stage, coalesce(reason, 'kept') reason, count(*) n from q group by all union all select 1, 'dedup', coalesce(reason, 'kept'), count(*) from x group by all)
 select "position", stage, (sum(n) over w)::bigint total, (coalesce(sum(n) filter (where reason = 'kept') over w, 0))::bigint passed, (coalesce(sum(n) filter (where reason <> 'kept') over w, 0))::bigint removed, reason, n from s window w as (partition by stage)"""
)
def curation_stage_stats(read, spark):
    return Curator().quality().deduplicate("exact").run(read("documents"))[1]


_SHINGLES = f"""with d as (select id, {words('text')} w from quality_texts where text is not null),
 s as (select id, list_sort(list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) s from d),
 u as (select s, min(id) id, len(s) n from s group by s), e as (select id, n, unnest(s) g from u),
 c as (select a.id a, b.id b, count(*)::double shared, any_value(a.n) na, any_value(b.n) nb from e a join e b on a.g = b.g and a.id < b.id group by a.id, b.id)"""


@query(_SHINGLES + " select a, b, round(shared / (na + nb - shared), 6) similarity from c where shared / (na + nb - shared) >= 0.8")
def near_dup_pairs_exact(read, spark):
    return dedup.jaccard_pairs(read("quality_texts"), id_column="id").select("a", "b", F.round("similarity", 6).alias("similarity"))


@query()
def minhash_dedup(read, spark):
    return dedup.minhash_dedup(read("quality_texts").where("text is not null"), id_column="id").select("id")


@query(
    _SHINGLES
    + """, p as (select b, list(a) near from c where shared / (na + nb - shared) >= 0.8 group by b), l as (select list({'b': b, 'near': near, 'gone': []::bigint[]} order by b) x from p),
 g as (select unnest(case when len(x) > 0 then list_reduce(list_prepend({'b': null::bigint, 'near': []::bigint[], 'gone': []::bigint[]}, x), lambda s, r: {'b': r.b, 'near': r.near, 'gone': case when len(list_filter(r.near, lambda v: not list_contains(s.gone, v))) > 0 then list_append(s.gone, r.b) else s.gone end}).gone end) id from l)
 select id from u where id not in (select id from g) union all select id from quality_texts where text is null"""
)
def near_dup_greedy_keep(read, spark):
    return dedup.jaccard_keep(read("quality_texts"), id_column="id")


_LEXICON = ["idiot", "moron", "scumbag", "shit", "fuck", "naked", "vermin"]


@query(
    f"""select count_if(f and y)::bigint tp, count_if(f and not y)::bigint fp, count_if(not f and y)::bigint fn, count_if(not f and not y)::bigint tn, round(count_if(f and y)::double / nullif(count_if(f), 0), 6) "precision", round(count_if(f and y)::double / nullif(count_if(y), 0), 6) recall
 from (select {contained('lower(text)', _LEXICON)} > 0 f, toxic = 1 y from toxicity_labels join quality_texts on row_id = id where table_name = 'quality_texts' and text is not null)"""
)
def lexicon_vs_labels(read, spark):
    labels = read("toxicity_labels").where("table_name = 'quality_texts'")
    x = labels.join(read("quality_texts").select("id", "text"), F.col("row_id") == F.col("id")).where("text is not null")
    flagged = x.withColumn("flag", T.count_contained(F.lower("text"), _LEXICON) > 0)
    out = screening.evaluate(flagged, "flag", "toxic")
    return out.select("tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    f"""select id, case when text is null or length({trimmed('text')}) = 0 then 'invalid_type' when s1 > 0.7 then 'toxic_toxicity' when s2 > 0.7 then 'toxic_threat' end reason
 from (select id, text, least(1.0, {contained('lower(text)', _LEXICON)} / 1.0) s1, least(1.0, {contained('lower(text)', ['break your jaw', 'drop dead'])} / 1.0) s2 from quality_texts)"""
)
def screening_reasons(read, spark):
    low = F.lower("text")
    scores = F.create_map(F.lit("threat"), F.least(F.lit(1.0), T.count_contained(low, ["break your jaw", "drop dead"]) / 1.0), F.lit("toxicity"), F.least(F.lit(1.0), T.count_contained(low, _LEXICON) / 1.0))
    return read("quality_texts").withColumn("scores", scores).select("id", screening.reason(F.col("text"), F.col("scores")).alias("reason"))


_PPL = f"""with w as (select doc_id id, unnest({words('text')}) w from documents where text is not null), c as (select w, count(*) c from w group by w), t as (select sum(c) n, count(*) v from c),
 b as (select id, w, count(*) k from w group by all)
 select id, round(exp(sum(-k * ln((c + 1)::double / (n + v))) / sum(k)), 4) perplexity from b join c using (w), t group by id"""


@query(_PPL)
def unigram_perplexity(read, spark):
    return models.unigram_perplexity(read("documents")).select("id", F.round("perplexity", 4).alias("perplexity"))


# chat formats: two turns of the judged questions, and prompts with their chosen answers


def _conversations(read):
    m = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    c = lambda x, k: F.coalesce(F.get(x, F.lit(k)), F.lit(""))
    j = read("judged_questions")
    msgs = F.array(m("system", F.concat(F.lit("You answer about "), F.col("category"))), m("user", c("turns", 0)), m("assistant", c("answers", 0)), m("user", c("turns", 1)), m("assistant", c("answers", 1)))
    return j.select("question_id", msgs.alias("messages"))


_C = """(select question_id, 'You answer about ' || category s, coalesce(turns[1], '') u1, coalesce(answers[1], '') a1, coalesce(turns[2], '') u2, coalesce(answers[2], '') a2 from judged_questions)"""
_CONV = {
    "chatml": ("'<|im_start|>system\n' || s || '<|im_end|>\n<|im_start|>user\n' || u1 || '<|im_end|>\n<|im_start|>assistant\n' || a1 || '<|im_end|>\n<|im_start|>user\n' || u2 || '<|im_end|>\n<|im_start|>assistant\n' || a2 || '<|im_end|>\n'", "<|im_start|>assistant\n"),
    "vicuna": ("s || '\n\nUSER: ' || u1 || '\nASSISTANT: ' || a1 || '</s>\nUSER: ' || u2 || '\nASSISTANT: ' || a2 || '</s>\n'", "ASSISTANT:"),
    "zephyr": ("'<|system|>\n' || s || '</s>\n<|user|>\n' || u1 || '</s>\n<|assistant|>\n' || a1 || '</s>\n<|user|>\n' || u2 || '</s>\n<|assistant|>\n' || a2 || '</s>\n'", "<|assistant|>\n"),
    "mistral": ("'<s>[INST] ' || u1 || ' [/INST]' || a1 || '</s>[INST] ' || u2 || ' [/INST]' || a2 || '</s>'", ""),
    "llama2": ("'<s>[INST] <<SYS>>\n' || s || '\n<</SYS>>\n\n' || u1 || ' [/INST] ' || a1 || ' </s><s>[INST] ' || u2 || ' [/INST] ' || a2 || ' </s>'", " "),
    "alpaca": (f"{quoted(chat.PREAMBLE)} || '\n\n### Instruction:\n' || u1 || '\n' || u2 || '\n\n### Response:\n'", ""),
}
_INSTR = {
    "chatml": "'<|im_start|>user\n' || p || '<|im_end|>\n<|im_start|>assistant\n' || case when r <> '' then r || '<|im_end|>\n' else '' end",
    "alpaca": f"{quoted(chat.PREAMBLE)} || '\n\n### Instruction:\n' || p || '\n\n### Response:\n' || r",
    "llama2": "'<s>[INST] ' || p || ' [/INST]' || case when r <> '' then ' ' || r || ' </s>' else '' end",
    "mistral": "'<s>[INST] ' || p || ' [/INST]' || case when r <> '' then ' ' || r || '</s>' else '' end",
    "vicuna": "'USER: ' || p || '\nASSISTANT:' || case when r <> '' then ' ' || r || '</s>' else '' end",
    "zephyr": "'<|user|>\n' || p || '</s>\n<|assistant|>\n' || case when r <> '' then r || '</s>' else '' end",
}


def _format(template: str):
    body, prompt = _CONV[template]

    @query(f"select question_id, {body} || {quoted(prompt)} as text from {_C}", name=f"fmt_{template}")
    def conversation(read, spark):
        x = _conversations(read)
        messages, system = chat.normalize(F.col("messages"))
        return x.select("question_id", chat.conversation(template, messages, system).alias("text"))

    @query(f"select pair_id, {_INSTR[template]} as text from (select pair_id, coalesce(prompt, '') p, coalesce(chosen, '') r from preference_pairs)", name=f"fmt_{template}_instruction")
    def instruction(read, spark):
        p = read("preference_pairs")
        return p.select("pair_id", chat.instruction(template, F.coalesce("prompt", F.lit("")), F.lit(""), F.coalesce("chosen", F.lit(""))).alias("text"))


for _t in _CONV:
    _format(_t)


@query(f"select pair_id, {_INSTR['chatml']} as text from (select pair_id, coalesce(prompt, '') p, coalesce(chosen, '') r from preference_pairs)")
def sft_adapter(read, spark):
    return chat.sft_text(read("preference_pairs").select("pair_id", "prompt", F.col("chosen").alias("response"))).select("pair_id", "text")


_TEMPLATE = "case " + " ".join(f"when contains(lower(m), '{a}') then '{b}'" for a, b in chat.MODEL_TEMPLATES) + " else 'chatml' end"


@query(f"select template, count(*) n from (select {_TEMPLATE} template from (select coalesce(model_name, 'none') || case when doc_id % 3 = 0 then '-Llama-2' when doc_id % 3 = 1 then '-mixtral' else '' end m from documents)) group by 1")
def template_resolution(read, spark):
    m = F.concat(F.coalesce("model_name", F.lit("none")), F.when(F.col("doc_id") % 3 == 0, "-Llama-2").when(F.col("doc_id") % 3 == 1, "-mixtral").otherwise(""))
    return read("documents").select(chat.template_of(m).alias("template")).groupBy("template").agg(F.count("*").alias("n"))


# synthetic instructions

_FAIL = contained("lower(coalesce(prompt, '') || ' ' || coalesce(chosen, ''))", quality.GENERATION_FAILURES)


@query(f"select pair_id from preference_pairs where length(coalesce(prompt, '')) >= 10 and not (length(coalesce(chosen, '')) > 0 and length(coalesce(chosen, '')) < 10) and {_FAIL} = 0")
def synth_quality_filter(read, spark):
    return read("preference_pairs").where(quality.synthetic_ok(F.col("prompt"), F.col("chosen"))).select("pair_id")


_EV = contained("lower(e)", synthetic.EVOLUTION_FAILURES)


@query(f"select pair_id, (length(e) >= 10 and {trimmed('lower(e)')} <> {trimmed('lower(o)')} and length(e) >= length(o) * 0.5 and {_EV} = 0) ok from (select pair_id, coalesce(prompt, '') o, coalesce(chosen, '') e from preference_pairs)")
def evol_validate(read, spark):
    return read("preference_pairs").select("pair_id", synthetic.valid_evolution(F.col("prompt"), F.col("chosen")).alias("ok"))


_HEAD, _TAIL = synthetic.EVOLUTIONS["deepen"].split("{instruction}")


@query(f"select pair_id, {quoted(_HEAD)} || prompt || {quoted(_TAIL)} as prompt from preference_pairs where prompt is not null")
def evol_prompts(read, spark):
    return read("preference_pairs").where("prompt is not null").select("pair_id", synthetic.evolution_prompt(F.col("prompt"), "deepen").alias("prompt"))


@query("select question_id, 'Example 1:\n### Instruction:\n' || u1 || case when a1 <> '' then '\n\n### Output:\n' || a1 else '' end || '\n\nExample 2:\n### Instruction:\n' || u2 || case when a2 <> '' then '\n\n### Output:\n' || a2 else '' end as text from " + _C)
def few_shot_prompt(read, spark):
    c = lambda x, k: F.coalesce(F.get(x, F.lit(k)), F.lit(""))
    ex = F.array(*(F.struct(c("turns", k).alias("instruction"), F.lit("").alias("input"), c("answers", k).alias("output")) for k in range(2)))
    return read("judged_questions").select("question_id", synthetic.few_shot_examples(ex).alias("text"))


_SECTION = lambda name: trimmed(f"coalesce(split_part(regexp_extract(text, '(?is)###\\s*{name}:?\\s*\\n(.*)', 1), '###', 1), '')")


_PARSED = f"select doc_id, {_SECTION('Instruction')} instruction, case when {_SECTION('Input')} in ('N/A', 'None', 'none') then '' else {_SECTION('Input')} end \"input\", {_SECTION('Output')} \"output\", {_SECTION('Response')} response from documents where {_SECTION('Instruction')} <> ''"


@query(_PARSED)
@query(_PARSED, name="parse_sections")
def parse_instructions(read, spark):
    """All documents with an instruction section; both names stand for the same."""
    x = read("documents").select("doc_id", synthetic.parse_instruction(F.col("text")).alias("p"), synthetic.section(F.col("text"), "Response").alias("response"))
    return x.where("p is not null").select("doc_id", "p.instruction", "p.input", "p.output", "response")


@query()
def diverse_instructions(read, spark):
    p = read("preference_pairs").where("prompt is not null")
    return synthetic.diverse(p.select(F.col("pair_id").alias("id"), F.col("prompt").alias("instruction")))


