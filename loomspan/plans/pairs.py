"""Preference pairs, token arrays, losses and reward distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import comparison, losses, models, preference, rewards
from ..operators import token_arrays as K
from .registry import query, tokens, trimmed

# rated items: both answers of each pair with their scores, in tenths


def _items(read):
    p = read("preference_pairs").where("prompt is not null")
    x = lambda c, k: p.select("prompt", F.col(c).alias("response"), F.round(F.col(f"{c}_score") * 10).alias("rating"), (F.col("pair_id") * 2 + k).alias("seq"))
    return x("chosen", 0).union(x("rejected", 1)).where("response is not null and rating is not null")


_ITEMS = """items as (select * from (select prompt, chosen response, round(chosen_score * 10) rating, pair_id * 2 seq from preference_pairs union all select prompt, rejected, round(rejected_score * 10), pair_id * 2 + 1 from preference_pairs) where prompt is not null and response is not null and rating is not null)"""


@query(f"with {_ITEMS} select a.prompt, a.response chosen, b.response rejected, a.rating chosen_score, b.rating rejected_score from items a join items b on a.prompt = b.prompt and a.rating - b.rating >= 1")
def pairs_from_ratings(read, spark):
    return preference.pairs_from_ratings(_items(read), 1.0)


_RANKED = f"with {_ITEMS}, r as (select prompt, response, rating score, row_number() over (partition by prompt order by rating desc, seq) k, count(*) over (partition by prompt) n from items)"


@query(f"{_RANKED} select prompt, response, score, k \"rank\" from r")
def rank_by_reward(read, spark):
    return preference.ranked(_items(read).withColumnRenamed("rating", "score")).select("prompt", "response", "score", F.col("rank").cast("long").alias("rank"))


@query(f"{_RANKED} select a.prompt, a.response chosen, b.response rejected, a.score chosen_score, b.score rejected_score from r a join r b on a.prompt = b.prompt and b.k = a.n - a.k + 1 where a.n >= 2 and a.k <= least(2, a.n - 1) and a.k <> b.k")
def rank_pairs(read, spark):
    return preference.rank_pairs(_items(read).withColumnRenamed("rating", "score"), per_prompt=2)


@query(f"{_RANKED} select a.prompt, a.response chosen, b.response rejected, a.score chosen_score, b.score rejected_score from r a join r b on a.prompt = b.prompt and b.k = a.n - a.k + 1 where a.n >= 2 and a.k <= least(2, a.n - 1) and a.k <> b.k and a.score - b.score >= 1")
def rank_pairs_margin(read, spark):
    return preference.rank_pairs(_items(read).withColumnRenamed("rating", "score"), per_prompt=2, margin=1.0)


@query(
    """with j as (select prompt, chosen, rejected, coalesce(chosen_score, 0.5) a, coalesce(rejected_score, 0.5) b from preference_pairs where prompt is not null and chosen is not null and rejected is not null),
 t as (select prompt, response, sum(s) total from (select prompt, chosen response, a s from j union all select prompt, rejected, b from j) group by all)
 select prompt, response, round(case when max(total) over (partition by prompt) > 0 then total / max(total) over (partition by prompt) else total end, 6) score from t"""
)
def tournament_scores(read, spark):
    p = read("preference_pairs").where("prompt is not null and chosen is not null and rejected is not null")
    j = p.select("prompt", F.col("chosen").alias("response_a"), F.col("rejected").alias("response_b"), F.coalesce("chosen_score", F.lit(0.5)).alias("score_a"), F.coalesce("rejected_score", F.lit(0.5)).alias("score_b"))
    return preference.tournament(j).select("prompt", "response", F.round("score", 6).alias("score"))


@query("select pair_id, coalesce(try_cast(nullif(regexp_extract(t, 'Response A:\\s*(\\d+(?:\\.\\d+)?)', 1), '') as double), 5.0::double) a, coalesce(try_cast(nullif(regexp_extract(t, 'Response B:\\s*(\\d+(?:\\.\\d+)?)', 1), '') as double), 5.0::double) b from (select pair_id, 'Response A: ' || coalesce(chosen_score::varchar, 'n/a') || chr(10) || 'Response B: ' || (pair_id % 10)::varchar t from preference_pairs)")
def judge_ratings(read, spark):
    t = F.concat(F.lit("Response A: "), F.coalesce(F.col("chosen_score").cast("string"), F.lit("n/a")), F.lit("\nResponse B: "), (F.col("pair_id") % 10).cast("string"))
    return read("preference_pairs").select("pair_id", preference.parse_rating(t, "A").alias("a"), preference.parse_rating(t, "B").alias("b"))


@query("select pair_id, (case pair_id % 3 when 0 then 0.3 when 1 then 0.7 else 1.0 end)::double temperature from preference_pairs")
def temperature_schedule(read, spark):
    return read("preference_pairs").select("pair_id", preference.temperature(F.col("pair_id"), [0.3, 0.7, 1.0]).alias("temperature"))


@query("select prompt, chosen response, round(avg(1 / (1 + length(rejected) / 100)), 6) score from preference_pairs where prompt is not null and chosen is not null and rejected is not null group by all")
def critique_scores(read, spark):
    p = read("preference_pairs").where("prompt is not null and chosen is not null and rejected is not null")
    return preference.critique_score(p.select("prompt", F.col("chosen").alias("response"), F.col("rejected").alias("critique"))).select("prompt", "response", F.round("score", 6).alias("score"))


@query("select coalesce(prompt, '') prompt, case when pair_id % 2 = 0 then chosen else rejected end chosen, case when pair_id % 2 = 0 then rejected else chosen end rejected from preference_pairs where length(chosen) > 0 and length(rejected) > 0")
def normalize_pairs(read, spark):
    p = read("preference_pairs").select("prompt", F.col("chosen").alias("response_a"), F.col("rejected").alias("response_b"), (F.col("pair_id") % 2).cast("int").alias("preference"))
    return preference.usable_pairs(preference.normalize_pairs(p))


@query("select doc_id, case when contains(text, 'Human:') then trim(split_part(split_part(text, 'Human:', 2), 'Assistant:', 1), ' ') else substring(text, 1, 200) end prompt from documents")
def extract_prompt(read, spark):
    d = read("documents").select("doc_id", F.col("text").alias("chosen"))
    return d.select("doc_id", preference.extract_prompt(d).alias("prompt"))


@query("select pair_id, coalesce(prompt, '') || chr(10) || coalesce(chosen, '') as text from preference_pairs")
def pair_texts(read, spark):
    return read("preference_pairs").select("pair_id", preference.pair_text(F.col("prompt"), F.col("chosen")).alias("text"))


# token arrays: the lengths of words stand for token ids


def _ids(read, column="prompt"):
    return read("preference_pairs").where(f"{column} is not null").select("pair_id", F.transform(T.tokens(F.col(column)), lambda w: F.length(w)).alias("ids"))


_IDS = f"(select pair_id, list_transform({tokens('prompt')}, lambda w: length(w)) ids from preference_pairs where prompt is not null)"


@query(
    f"""with x as (select pair_id, ids, pair_id // 8 b from {_IDS}), y as (select *, (ceil(least(max(len(ids)) over (partition by b), 60) / 8.0) * 8)::int n from x),
 z as (select pair_id, list_concat(ids[1:n], list_transform(range(greatest(n - len(ids), 0)), lambda i: 0::bigint)) p from y)
 select pair_id, array_to_string(p, ' ') input_ids, array_to_string(list_transform(p, lambda v: (v <> 0)::int), ' ') mask, array_to_string(list_transform(p, lambda v: case when v = 0 then -100 else v end), ' ') labels from z"""
)
def pad_and_mask(read, spark):
    x = _ids(read).withColumn("batch", F.floor(F.col("pair_id") / 8)).withColumn("n", K.batch_length(F.size("ids"), F.col("batch"), 60)).withColumn("p", K.pad(F.col("ids"), F.col("n")))
    text = lambda a: F.array_join(a.cast("array<string>"), " ")
    return x.select("pair_id", text(F.col("p")).alias("input_ids"), text(K.attention_mask(F.col("p"))).alias("mask"), text(K.labels(F.col("p"))).alias("labels"))


@query(
    f"""with x as (select pair_id, ids, list_filter(range(1, greatest(len(ids), 1)), lambda i: ids[i] = 3 and ids[i + 1] = 5)[1] k from {_IDS}), y as (select pair_id, ids, case when k is null then 0 else k + 1 end s from x)
 select pair_id, array_to_string(list_transform(ids, lambda v, i: case when i - 1 < s or v = 0 then -100 else v end), ' ') labels from y"""
)
def completion_mask(read, spark):
    x = _ids(read)
    return x.select("pair_id", F.array_join(K.completion_labels(F.col("ids"), [3, 5]).cast("array<string>"), " ").alias("labels"))


@query(f"select pair_id, array_to_string(list_transform(ids, lambda v, i: case when i - 1 < 7 then -100 else v end), ' ') labels from {_IDS}")
def dpo_prompt_mask(read, spark):
    return _ids(read).select("pair_id", F.array_join(K.prompt_labels(F.col("ids"), F.lit(7)).cast("array<string>"), " ").alias("labels"))


@query(f"select pair_id, array_to_string(list_transform(ids, lambda v, i: case when i > 20 then i - 21 when i > 8 then i - 9 else i - 1 end), ' ') positions from {_IDS}")
def packed_positions(read, spark):
    return _ids(read).select("pair_id", F.array_join(K.position_ids(F.col("ids"), F.array(F.lit(0), F.lit(8), F.lit(20))).cast("array<string>"), " ").alias("positions"))


@query(
    f"""select pair_id, round(coalesce(list_sum(list_transform(range(1, len(ids)), lambda i: case when ids[i + 1] % 3 <> 0 then -1.0 / ids[i] else 0 end)), 0) / greatest(len(list_filter(range(1, len(ids)), lambda i: ids[i + 1] % 3 <> 0)), 1), 6) logp from {_IDS}"""
)
def masked_logp(read, spark):
    x = _ids(read)
    label = F.transform("ids", lambda v: F.when(v % 3 == 0, K.IGNORE).otherwise(v))
    return x.select("pair_id", F.round(K.masked_mean_logp(F.transform("ids", lambda v: -1.0 / v), label), 6).alias("logp"))


@query(f"select round(sum(len(list_filter(ids, lambda v: v % 3 <> 0 and v % 5 = v % 7)))::double / sum(len(list_filter(ids, lambda v: v % 3 <> 0))), 6) accuracy from {_IDS}")
def token_accuracy(read, spark):
    x = _ids(read).withColumn("label", F.transform("ids", lambda v: F.when(v % 3 == 0, K.IGNORE).otherwise(v % 7))).withColumn("predicted", F.transform("ids", lambda v: v % 5))
    right, n = K.token_accuracy(F.col("predicted"), F.col("label"))
    return x.select(right.alias("r"), n.alias("n")).agg(F.round(F.sum("r") / F.sum("n"), 6).alias("accuracy"))


@query(
    f"""with s as (select pair_id, len(ids) n from {_IDS}), l as (select list(n order by pair_id) ns from s),
 p as (select list_reduce(list_transform(ns, lambda n: {{'u': n, 'k': 0, 'out': [0]}}), lambda a, b: case when a.u + b.u + 1 > 256 then {{'u': b.u, 'k': a.k + 1, 'out': list_append(a.out, a.k + 1)}} else {{'u': a.u + 1 + b.u, 'k': a.k, 'out': list_append(a.out, a.k)}} end) x, ns from l),
 z as (select unnest(x.out) pack, unnest(ns) n from p)
 select pack::bigint pack, least(sum(n) + count(*) - 1, 256)::bigint tokens, count(*) sequences from z group by 1"""
)
def pack_sequences(read, spark):
    return K.pack(_ids(read), 256, 0, id_column="pair_id").select("pack", F.size("input_ids").cast("long").alias("tokens"), F.size("starts").cast("long").alias("sequences"))


# losses: scores of the pairs as rewards, prices as log-probabilities

_R = "(select pair_id, chosen_score * 4 c, rejected_score * 4 r from preference_pairs where chosen_score is not null and rejected_score is not null)"


def _rewards(read):
    return read("preference_pairs").where("chosen_score is not null and rejected_score is not null").select("pair_id", (F.col("chosen_score") * 4).alias("c"), (F.col("rejected_score") * 4).alias("r"))


_SP = "(greatest({0}, 0) + ln(1 + exp(-abs({0}))))"


@query(f"select round(avg({_SP.format('(r - c)')}), 6) bt, round(avg(0.9 * {_SP.format('(r - c)')} + 0.1 * {_SP.format('(c - r)')}), 6) smoothed, round(avg(greatest(0.5 - (c - r), 0)), 6) margin, round(avg(greatest(1 - (c - r), 0)), 6) hinge from {_R}")
def reward_losses(read, spark):
    c, r = F.col("c"), F.col("r")
    return _rewards(read).agg(*(F.round(F.avg(x), 6).alias(n) for n, x in (("bt", losses.bradley_terry(c, r)), ("smoothed", losses.bradley_terry(c, r, smoothing=0.1)), ("margin", losses.margin_loss(c, r, 0.5)), ("hinge", losses.hinge(c, r)))))


@query(f"select round(avg((c > r)::int), 6) accuracy, round(avg(c), 6) chosen_mean, round(stddev_samp(c), 6) chosen_std, round(avg(r), 6) rejected_mean, round(stddev_samp(r), 6) rejected_std, round(avg(c - r), 6) margin from {_R}")
def pref_accuracy(read, spark):
    x = losses.preference_metrics(_rewards(read), "c", "r")
    return x.select(*(F.round(c, 6).alias(c) for c in x.columns))


@query(f"select round(avg(m), 6) \"value\" from (select pair_id // 64 b, avg({_SP.format('(r - c)')}) m from {_R} group by 1)")
def batch_mean_loss(read, spark):
    x = losses.mean_of_batches(_rewards(read).withColumn("b", F.floor(F.col("pair_id") / 64)), "b", losses.bradley_terry(F.col("c"), F.col("r")))
    return x.select(F.round("value", 6).alias("value"))


_L = "(select *, (pc - rc) - (pr - rr) z from (select -l_quantity / 10 pc, -l_discount * 20 pr, -l_quantity / 11 rc, -l_tax * 30 rr from lineitem))"


def _logps(read):
    x = read("lineitem").select((-F.col("l_quantity") / 10).alias("pc"), (-F.col("l_discount") * 20).alias("pr"), (-F.col("l_quantity") / 11).alias("rc"), (-F.col("l_tax") * 30).alias("rr"))
    return x.withColumn("z", losses.dpo_logits(*(F.col(c) for c in ("pc", "pr", "rc", "rr"))))


@query(f"select round(avg({_SP.format('(-0.1 * z)')}), 6) sigmoid, round(avg(greatest(1 - 0.1 * z, 0)), 6) hinge, round(avg(power(z - 5, 2)), 4) ipo, round(avg((0.1 * (pc - rc) > 0.1 * (pr - rr))::int), 6) accuracy, round(avg(0.1 * (pc - rc)), 6) chosen_reward, round(avg(0.1 * (pr - rr)), 6) rejected_reward from {_L}")
def dpo_losses(read, spark):
    z = F.col("z")
    cr, rr = 0.1 * (F.col("pc") - F.col("rc")), 0.1 * (F.col("pr") - F.col("rr"))
    return _logps(read).agg(F.round(F.avg(losses.dpo_sigmoid(z)), 6).alias("sigmoid"), F.round(F.avg(losses.dpo_hinge(z)), 6).alias("hinge"), F.round(F.avg(losses.dpo_ipo(z)), 4).alias("ipo"), F.round(F.avg((cr > rr).cast("int")), 6).alias("accuracy"), F.round(F.avg(cr), 6).alias("chosen_reward"), F.round(F.avg(rr), 6).alias("rejected_reward"))


@query("select l_orderkey, l_linenumber, round((x - avg(x) over ()) / (stddev_samp(x) over () + 1e-8), 6) w from (select l_orderkey, l_linenumber, least(greatest(l_extendedprice / 10000, 0.5), 6) x from lineitem)")
def ppo_whiten(read, spark):
    x = read("lineitem").select("l_orderkey", "l_linenumber", losses.clip(F.col("l_extendedprice") / 10000, 0.5, 6.0).alias("x"))
    return losses.whitened(x, "x", "w").select("l_orderkey", "l_linenumber", F.round("w", 6).alias("w"))


_PPO = "(select l_quantity / 50 lp, l_discount * 6 old, l_tax * 20 - 0.5 adv, l_extendedprice / 50000 v, l_quantity / 40 ov, l_discount * 15 ret from lineitem)"


@query(f"select round(avg(greatest(-adv * exp(lp - old), -adv * least(greatest(exp(lp - old), 0.8), 1.2))), 6) policy, round(avg((abs(exp(lp - old) - 1) > 0.2)::int), 6) clipped, round(avg(0.5 * greatest(power(v - ret, 2), power(ov + least(greatest(v - ov, -0.2), 0.2) - ret, 2))), 6) \"value\", round(-avg(lp), 6) entropy, round(avg(lp - old), 6) kl, round(avg(abs(lp - old)), 6) kl_abs, round(avg(0.5 * power(lp - old, 2)), 6) kl_mse from {_PPO}")
def ppo_losses(read, spark):
    x = read("lineitem").select((F.col("l_quantity") / 50).alias("lp"), (F.col("l_discount") * 6).alias("old"), (F.col("l_tax") * 20 - 0.5).alias("adv"), (F.col("l_extendedprice") / 50000).alias("v"), (F.col("l_quantity") / 40).alias("ov"), (F.col("l_discount") * 15).alias("ret"))
    lp, old = F.col("lp"), F.col("old")
    loss, hit = losses.ppo_policy(lp, old, F.col("adv"))
    cols = (("policy", loss), ("clipped", hit), ("value", losses.ppo_value(F.col("v"), F.col("ov"), F.col("ret"))), ("entropy", -lp), ("kl", losses.kl(lp, old)), ("kl_abs", losses.kl(lp, old, "abs")), ("kl_mse", losses.kl(lp, old, "mse")))
    return x.agg(*(F.round(F.avg(c), 6).alias(n) for n, c in cols))


@query("select l_orderkey, round(list_reduce(list_prepend(0.1::double, list(l_discount::double order by l_linenumber)), lambda c, k: least(greatest(case when k > 0.05 * 1.5 then c * 1.5 when k < 0.05 / 1.5 then c / 1.5 else c end, 0.001), 10)), 6) coefficient from lineitem group by 1")
def adaptive_kl(read, spark):
    x = read("lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_discount"))), lambda s: s["l_discount"]).alias("kls"))
    return x.select("l_orderkey", F.round(losses.adaptive_coefficient(F.col("kls"), 0.1, 0.05), 6).alias("coefficient"))


@query("select vec_id, round(list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i] * ln((p[i] + 1e-10) / (q[i] + 1e-10)))), 5) kl from (select vec_id, list_transform(e, lambda v: v / list_sum(e)) p, list_transform(list_reverse(e), lambda v: v / list_sum(e)) q from (select vec_id, list_transform(embedding, lambda v: exp(v::double)) e from embeddings))")
def full_vocab_kl(read, spark):
    e = read("embeddings").select("vec_id", F.transform("embedding", lambda v: F.exp(v.cast("double"))).alias("e")).withColumn("s", F.aggregate("e", F.lit(0.0), lambda a, b: a + b))
    p = F.transform("e", lambda v: v / F.col("s"))
    return e.select("vec_id", F.round(losses.full_kl(p, F.reverse(p)), 5).alias("kl"))


@query("select doc_id, length(text) / 100 reward from documents")
def fallback_reward(read, spark):
    return read("documents").select("doc_id", models.length_reward(F.col("text")).alias("reward"))


# distributions

_DIST = "count({0}) n, round(avg({0}), 6) mean, round(stddev_pop({0}), 6) std, round(min({0}), 6) min, round(max({0}), 6) max, " + ", ".join(f"round(quantile_cont({{0}}, {p / 100}), 6) p{p}" for p in rewards.PERCENTILES)


def _rounded(df, keep=()):
    return df.select(*keep, *(F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes if c not in keep))


@query(f"select {_DIST.format('l_extendedprice')} from lineitem")
def reward_distribution(read, spark):
    return _rounded(rewards.distribution(read("lineitem"), "l_extendedprice"))


@query(f"select l_returnflag, {_DIST.format('l_extendedprice')} from lineitem group by 1")
def reward_by_category(read, spark):
    return _rounded(rewards.distribution(read("lineitem"), "l_extendedprice", ["l_returnflag"]), ("l_returnflag",))


_HIST = "(select bin, count(*) n from (select least(floor((x - a) / ((b - a) / 50)), 49)::int bin from {0}, (select min(x) a, max(x) b from {0})) group by 1)"


@query(f"with v as (select l_extendedprice x from lineitem) select g.bin::int bin, round(a + g.bin * (b - a) / 50, 4) lo, round(a + (g.bin + 1) * (b - a) / 50, 4) hi, coalesce(n, 0) n from (select unnest(range(50)) bin) g left join {_HIST.format('v')} h on g.bin = h.bin, (select min(x) a, max(x) b from v)")
def reward_histogram(read, spark):
    return rewards.histogram(read("lineitem"), "l_extendedprice").select("bin", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "n")


@query(
    f"""with p as (select l_extendedprice x from lineitem where l_returnflag = 'R'), q as (select l_extendedprice * 1.2 x from lineitem where l_returnflag <> 'R'), hp as {_HIST.format('p')}, hq as {_HIST.format('q')},
 k as (select sum((coalesce(b.n, 0) / tq + 1e-10) * ln((coalesce(b.n, 0) / tq + 1e-10) / (coalesce(a.n, 0) / tp + 1e-10))) kl from (select unnest(range(50)) bin) g left join hp a on a.bin = g.bin left join hq b on b.bin = g.bin, (select sum(n) tp from hp), (select sum(n) tq from hq)),
 s as (select (select avg(x) from q) - (select avg(x) from p) d, (select avg(x) from p) m, (select stddev_pop(x) from q) / (select stddev_pop(x) from p) sr, (select max(x) - min(x) from q) / (select max(x) - min(x) from p) rr)
 select round(d, 6) mean_shift, round(d / abs(m), 6) relative_shift, round(sr, 6) std_ratio, round(rr, 6) range_ratio, round(kl, 6) kl, (abs(d / m) > 0.1 or kl > 0.5) significant from s, k"""
)
def reward_drift(read, spark):
    x = read("lineitem")
    return _rounded(rewards.drift(x.where("l_returnflag = 'R'").select("l_extendedprice"), x.where("l_returnflag <> 'R'").select((F.col("l_extendedprice") * 1.2).alias("l_extendedprice")), "l_extendedprice"))


# two models: the chosen and the rejected answers

_V = "(select pair_id, chosen, rejected, chosen_score a, rejected_score b from preference_pairs)"


@query(f"select count(*) n, round(avg((a > b)::int), 6) win_a, round(avg((b > a)::int), 6) win_b, round(avg((a = b)::int), 6) tie from {_V} where a is not null and b is not null")
def win_rates(read, spark):
    return _rounded(comparison.win_rates(read("preference_pairs"), "chosen_score", "rejected_score"))


def _long(read):
    p = read("preference_pairs")
    x = lambda c: p.select(F.lit(c).alias("model"), F.col(c).alias("response"), F.col(f"{c}_score").alias("reward"))
    return x("chosen").union(x("rejected"))


_LONG = "(select 'chosen' model, chosen response, chosen_score reward from preference_pairs union all select 'rejected', rejected, rejected_score from preference_pairs)"


@query(f"select model, count(reward) n, round(avg(reward), 6) mean, round(stddev_samp(reward), 6) std, min(reward) min, max(reward) max from {_LONG} group by 1")
def reward_summary(read, spark):
    return _rounded(comparison.summary(_long(read), "reward"), ("model",))


@query(f"select model, round(avg(length(response)), 6) mean, round(stddev_pop(length(response)), 6) std, min(length(response)) min, max(length(response)) max from {_LONG} group by 1")
def char_length_stats(read, spark):
    return _rounded(comparison.char_lengths(_long(read), "response"), ("model",))


@query(f"select model, round(avg(n), 6) mean, round(stddev_pop(n), 6) std, min(n) min, max(n) max, round(avg((length({trimmed('r')}) = 0)::int), 6) empty_rate from (select model, coalesce(response, '') r, len({tokens('coalesce(response, chr(32))')}) n from {_LONG}) group by 1")
def word_length_stats(read, spark):
    return _rounded(comparison.word_lengths(_long(read), "response"), ("model",))


@query(f"select n, round(m, 6) mean_diff, round(m / (s / sqrt(n)), 6) t, round(m / p, 6) cohens_d, case when abs(m / p) < 0.2 then 'negligible' when abs(m / p) < 0.5 then 'small' when abs(m / p) < 0.8 then 'medium' else 'large' end effect from (select count(*) n, avg(a - b) m, stddev_samp(a - b) s, stddev_pop(a - b) p from {_V} where a - b is not null)")
def paired_test_stats(read, spark):
    return _rounded(comparison.paired_stats(read("preference_pairs"), "chosen_score", "rejected_score"))


@query(f"with d as (select round(a - b, 3) d from {_V} where a is not null and b is not null and round(a - b, 3) <> 0), r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2 r from d) select count(*) n, sum(case when d > 0 then r else 0 end)::double w_plus, sum(case when d < 0 then r else 0 end)::double w_minus from r")
def wilcoxon_ranks(read, spark):
    x = read("preference_pairs").select(F.round(F.col("chosen_score") - F.col("rejected_score"), 3).alias("d"), F.lit(0.0).alias("z"))
    return comparison.wilcoxon(x, "d", "z")


@query(
    f"""with d as (select pair_id k, round(a - b, 6) diff from {_V} where a is not null and b is not null), s as (select *, row_number() over (order by diff, k) i, count(*) over () n from d)
 select k "key", diff, 'A' winner, 'top' region from s where i > n - 4 union all select k, diff, 'B', 'bottom' from s where i <= 3
 union all select k, diff, case when abs(diff) < 0.1 then 'Tie' when diff > 0 then 'A' else 'B' end, 'middle' from s where i > n // 2 - 1 and i <= n // 2 + 1"""
)
def comparison_samples(read, spark):
    x = read("preference_pairs").withColumn("d", F.round(F.col("chosen_score") - F.col("rejected_score"), 6)).withColumn("z", F.lit(0.0))
    return comparison.samples(x, "d", "z", "pair_id")


@query("select pair_id, case when contains(upper(v), 'A') and not contains(upper(v), 'B') then 'A' when contains(upper(v), 'B') and not contains(upper(v), 'A') then 'B' else 'tie' end verdict from (select pair_id, case pair_id % 4 when 0 then 'a' when 1 then 'B wins' when 2 then 'A or B' else 'no' end v from preference_pairs)")
def judge_verdicts(read, spark):
    v = F.when(F.col("pair_id") % 4 == 0, "a").when(F.col("pair_id") % 4 == 1, "B wins").when(F.col("pair_id") % 4 == 2, "A or B").otherwise("no")
    return read("preference_pairs").select("pair_id", comparison.verdict(v).alias("verdict"))
