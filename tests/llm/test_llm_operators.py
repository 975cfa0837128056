"""Operators for training data: brute force, round trips, odd inputs."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomspan.llm import broken_pairs as bp
from loomspan.llm import near_duplicates as nd
from loomspan.llm import template_residue as tr
from loomspan.llm import text_quality as tq
from loomspan.llm import toxicity as tx
from loomspan.llm.consensus import Consensus, agreement
from loomspan.llm.leaked_passages import leaked_passages
from loomspan.llm.mixture import Mixture, quotas, split_quotas
from loomspan.llm.ranking import consensus_comparisons, rank, stronger, task_models
from loomspan.llm.toxicity import toxic_passages, toxic_rates
from loomspan.llm.votes import valid_votes
from loomspan.llm.words import words

R = random.Random(5)
VOCAB = [f"w{i}" for i in range(400)]


def text(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


def edited(t, k):
    ws = t.split()
    for _ in range(k):
        ws[R.randrange(len(ws))] = R.choice(VOCAB)
    return " ".join(ws)


def triples(t):
    w = words(t)
    return frozenset(zip(w, w[1:], w[2:]))


def true_pairs(rows, least=20, threshold=0.5):
    sets = {(a, k): triples(t) for a, k, t in rows if t and len(words(t)) >= least}
    keys = sorted(sets)
    return {(a[0], min(a[1], b[1]), max(a[1], b[1])) for i, a in enumerate(keys) for b in keys[i + 1 :] if a[0] == b[0] and a[1] != b[1] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


# 1


def test_bit_sliced_distances():
    r = np.random.default_rng(1)
    s = r.integers(0, 2**63, (150, 2)).astype(np.int64)
    s[1::3] = s[::3]
    s[1::3, 0] ^= np.int64(0b10110)
    cls, key = np.arange(150), np.zeros(150, np.int64)
    dist = lambda i, j: sum(int(x ^ y).bit_count() for x, y in zip(s[i].view(np.uint64).tolist(), s[j].view(np.uint64).tolist()))
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if dist(i, j) <= 48}
    got = {(int(a), int(b)) for x, y in nd.compare_runs(key, cls, s, 48) for a, b in zip(x, y)}
    assert got == want
    got = {(int(a), int(b)) for x, y in nd.compare_chunks((cls, s), (cls, s), 48, True) for a, b in zip(x, y)}
    assert got == want


@pytest.mark.parametrize("most", [1024, 8])
def test_near_duplicates_against_brute_force(spark, most):
    rows = []
    for k in range(25):
        t = text(60)
        rows += [("a", 10 * k, t), ("a", 10 * k + 1, edited(t, 2)), ("b", 10 * k, edited(t, 1))]
        if k < 4:
            rows += [("a", 10 * k + j, t.upper()) for j in range(2, 5)]
    rows += [("a", 900, None), ("a", 901, ""), ("a", 902, "few words"), ("b", 903, "x " * 5000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "table_name string, id long, text string, cls int")
    x = nd.NearDuplicates(df, shingle=3, threshold=0.5, least_words=20, most=most)
    assert {tuple(r) for r in x.found().collect()} == true_pairs(rows)
    g = x.groups().collect()
    assert len(g) == len([r for r in rows if r[2] and len(words(r[2])) >= 20])
    by = {(r.table_name, r.id): r for r in g}
    assert by["a", 0].class_id == by["a", 2].class_id == 0 and by["a", 0].copies == 4 and by["a", 0].links >= 1
    assert by["a", 1].group_id == 0 and by["b", 0].group_id == 0


def test_large_copy_groups_stay_linear(spark):
    t = text(50)
    df = spark.createDataFrame([("a", k, t) for k in range(300)] + [("a", 300, edited(t, 1))], "table_name string, id long, text string")
    got = {tuple(r) for r in nd.NearDuplicates(df, 3, 0.5, 20).found(expand=10).collect()}
    inner = {("a", i, j) for i in range(300) for j in range(i + 1, min(i + 11, 300))}
    assert got == inner | {("a", k, 300) for k in range(10)}


def test_hot_blocks_are_cut_into_tiles(spark):
    t = text(40)
    rows = [("a", k, edited(t, 1)) for k in range(150)]
    x = nd.NearDuplicates(spark.createDataFrame(rows, "table_name string, id long, text string"), 3, 0.5, 20, most=2)
    assert {tuple(r) for r in x.found().collect()} == true_pairs(rows)
    assert {r.group_id for r in x.groups().collect()} == {0}


def test_repeated_rows_make_no_pairs_of_themselves(spark):
    t = text(40)
    df = spark.createDataFrame([("a", 1, t), ("a", 1, t), ("a", 2, t), ("b", 1, t), (None, 3, t)], "table_name string, id long, text string").where("table_name is not null")
    assert sorted(tuple(r) for r in nd.NearDuplicates(df, 3, 0.5, 20).found().collect()) == [("a", 1, 2)]


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "table_name string, id long, text string")
    assert nd.NearDuplicates(df).found().count() == 0
    assert nd.NearDuplicates(df).groups().count() == 0


# 2 and 6


def simulate(seed, tasks=600, people=24):
    r = random.Random(seed)
    names = ["alpha", "beta", "gamma", "delta"]
    strength = dict(zip(names, (1.2, 0.4, -0.4, -1.2)))
    skill = {f"ann-{i}": (0.95 if i % 4 else 0.35) for i in range(people)}
    votes, meta, truth = [], [], {}
    for t in range(tasks):
        a, b = r.sample(names, 2)
        p = 0.5 * (1 + math.erf((strength[a] - strength[b]) / math.sqrt(2)))
        z = 0 if r.random() < p else 1
        swap = r.random() < 0.5
        truth[f"t{t}"] = z
        first, second = (b, a) if swap else (a, b)
        meta.append((f"t{t}", "pairwise", {"model_names": f'["{first.upper()} ", "{second}"]', "shuffled": str(swap).lower()}))
        for who in r.sample(sorted(skill), 5):
            v = z if r.random() < skill[who] else r.choice([x for x in (0, 1, 2) if x != z])
            votes.append((f"t{t}", who, v, "2025-01-01T10:00:00.5", None))
    return votes, meta, truth, strength


VOTES = "task_id string, annotator_id string, preference int, annotated_at string, received_at timestamp"
TASKS = "task_id string, task_type string, metadata map<string,string>"


def test_latest_valid_vote_counts(spark):
    rows = [("t", "A ", 0, "2025-01-01T10:00:00", None), ("t", " a", 1, "2025-01-01 11:00:00.25Z", None), ("t", "a", 9, "2025-01-02T00:00:00", None), ("t", "b", 2, None, None), ("t", None, 1, None, None), ("u", "a", 1, None, None), (None, "a", 1, None, None)]
    tasks = [("t", "pairwise", None), ("u", "likert", None)]
    got = valid_votes(spark.createDataFrame(rows, VOTES), spark.createDataFrame(tasks, TASKS)).collect()
    assert {(r.task_id, r.annotator, r.label) for r in got} == {("t", "a", 1), ("t", "b", 2)}


@pytest.mark.parametrize("limit", [500_000, 1])
def test_consensus_beats_majority_and_ranks(spark, limit):
    rows, meta, truth, strength = simulate(3)
    v = valid_votes(spark.createDataFrame(rows, VOTES), spark.createDataFrame(meta, TASKS))
    c = Consensus(v, broadcast_annotators=limit, tolerance=0.02 if limit > 1 else 0.2)
    got = {r.task_id: r for r in c.labels(least_votes=3).collect()}
    by = defaultdict(Counter)
    for t, _, p, *_ in rows:
        by[t][p] += 1
    majority = sum(min(k for k, n in c.items() if n == max(c.values())) == truth[t] for t, c in by.items())
    assert sum(got[t].label == z for t, z in truth.items()) >= majority
    assert all(abs(r.p0 + r.p1 + r.p2 - 1) < 1e-9 for r in got.values())
    people = {r.annotator: r.reliability for r in c.annotators().collect()}
    assert max(people[f"ann-{i}"] for i in range(0, 24, 4)) < min(people[f"ann-{i}"] for i in range(24) if i % 4)
    k = agreement(v).collect()[0]
    assert 0 < k.kappa < 1 and k.tasks == 600
    r = rank(consensus_comparisons(c.labels(), spark.createDataFrame(meta, TASKS))).orderBy("rank").collect()
    assert [x.item for x in r] == ["alpha", "beta", "gamma", "delta"]
    for x in r:
        assert abs(x.strength - strength[x.item]) < 4 * x.std_error + 0.25


def test_consensus_settles(spark):
    rows, meta, *_ = simulate(8, tasks=300)
    v = valid_votes(spark.createDataFrame(rows, VOTES), spark.createDataFrame(meta, TASKS))
    a = Consensus(v, tolerance=1e-3)
    assert a.rounds_used < 100 and a.last_change < 1e-3
    b = Consensus(v, rounds=a.rounds_used + 1, tolerance=1e-4 if a.rounds_used < 5 else a.last_change * 0.999)
    x, y = ({r.annotator: (r.ability, r.bias_0, r.reliability) for r in c.annotators().collect()} for c in (a, b))
    assert b.objective >= a.objective - 1e-6 and all(abs(p - q) < 2e-3 for k in x for p, q in zip(x[k], y[k]))  # one round more changes nothing
    with pytest.raises(RuntimeError, match="did not settle"):
        Consensus(v, rounds=2, tolerance=1e-3)


def test_gradient_of_the_consensus_is_that_of_its_likelihood():
    from loomspan.llm import consensus as cs

    r = np.random.default_rng(3)
    n = r.integers(1, 6, 40)
    m = int(n.sum())
    label, at, prior = r.integers(0, 3, m), r.normal(0, 0.7, (4, m)), np.array([0.5, 0.3, 0.2])
    of = lambda x: cs.solve_tasks(n, label, x, prior)[2]
    vote = of(at)
    for v in range(0, m, 7):
        for c in range(4):
            up, down = at.copy(), at.copy()
            up[c, v] += 1e-4
            down[c, v] -= 1e-4
            slope = (of(up)["ll"].sum() - of(down)["ll"].sum()) / 2e-4
            assert abs(slope - vote[f"g{c}"][v]) < 0.02


def newton_ranking(rows, ridge=0.01):
    """Probit strengths and errors by dense algebra."""
    names = sorted({x for a, b, *_ in rows for x in (a, b)})
    k, cdf = {x: i for i, x in enumerate(names)}, np.vectorize(lambda m: 0.5 * (1 + math.erf(m / math.sqrt(2))))
    x = np.zeros((len(rows), len(names) + 1))
    for i, (a, b, *_) in enumerate(rows):
        x[i, k[a]], x[i, k[b]], x[i, -1] = 1, -1, 1
    y, n, s = np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.zeros(len(names) + 1)
    for _ in range(60):
        m = x @ s
        p, dens = cdf(m), np.exp(-m * m / 2) / math.sqrt(2 * math.pi)
        h = (x * (n * dens**2 / (p * (1 - p)))[:, None]).T @ x + ridge * np.eye(len(s))
        s = s + np.linalg.solve(h, x.T @ (n * (y - p) * dens / (p * (1 - p))) - ridge * s)
    c = np.append(np.eye(len(names)) - 1 / len(names), np.zeros((len(names), 1)), axis=1)
    return {a: (v, e) for a, v, e in zip(names, c @ s, np.sqrt(np.diag(c @ np.linalg.inv(h) @ c.T)))}


def test_ranking_against_dense_algebra(spark):
    r = random.Random(9)
    rows = [(f"m{a}", f"m{b}", o, r.randint(1, 9)) for a in range(6) for b in range(6) if a != b for o in (1.0, 0.0, 0.5)]
    df = spark.createDataFrame([*rows, ("m1", "m1", 1.0, 3), (None, "m1", 1.0, 1), ("m1", "m2", None, 4)], "first string, second string, outcome double, n int")
    got, want = {x.item: x for x in rank(df).collect()}, newton_ranking(rows)
    for k, (s, e) in want.items():
        assert abs(got[k].strength - s) < 1e-5 and abs(got[k].std_error - e) < 1e-5
    assert len(stronger(rank(df)).collect()) == 15
    assert rank(df.limit(0)).count() == 0


def test_more_items_than_probes(spark):
    r = random.Random(10)
    rows = [(f"m{a:02d}", f"m{b:02d}", float(r.random() < 0.5), 5) for a in range(20) for b in range(20) if a != b]
    df = spark.createDataFrame(rows, "first string, second string, outcome double, n int")
    got, want = {x.item: x for x in rank(df, probes=8).collect()}, newton_ranking(rows)
    assert all(abs(got[k].strength - s) < 1e-5 and 0.4 * e < got[k].std_error < 2.5 * e for k, (s, e) in want.items())


def test_consensus_of_nothing(spark):
    v = spark.createDataFrame([], "task_id string, annotator string, label int")
    c = Consensus(v)
    assert c.labels().count() == 0 and c.annotators().count() == 0
    assert agreement(v).collect()[0].kappa is None
    assert task_models(spark.createDataFrame([("t", "pairwise", None)], TASKS)).count() == 0


# 3

PROSE = "The river was high after the rain, and nobody had crossed the bridge since the morning. We waited for the boat, but it did not come.\nIn the end they told us that the road would be open again before the evening."
LIST = "Shopping:\n- fresh bread\n- two bottles of milk\n- green apples\n- butter\n- salt and pepper\n- a bag of rice\n- tomatoes"
TABLE = "name,amount,share\nbread,12.50,10%\nmilk,8.10,7%\nrice,99,80%\nsalt,3,2%\nsugar,7,1%"


def test_kinds():
    kind = lambda t: tq.finish(tq.measure(t), len(t.strip()))["kind"]
    assert kind(PROSE) == "prose" and kind(LIST) == "list" and kind(TABLE) == "table"
    assert kind("xkqj zzvw qpfl mmrt " * 8) == "junk"
    assert kind("a1f09bc2 77cd012e " * 10) == "junk"
    assert kind("#$%^ &*() " * 12) == "junk"
    assert kind("short") is None
    assert kind(PROSE + "\n- one thing\n- another thing\n- a third") == "prose"


def test_chunks_give_the_same_statistics(spark):
    texts = [PROSE * 20, LIST * 15, TABLE * 10, "word" * 3000, "é " * 900, "a\n" * 800]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(0, texts[0], 1)], "id long, text string, kind int")
    row = lambda r: (r.words, round(r.mean_word_length, 9), round(r.symbol_ratio, 9), round(r.closing_share, 9), round(r.common_share, 9), r.kind)
    a = sorted((r.id, row(r)) for r in tq.text_quality(df).collect())
    for chunk, segment, fan_in in ((101, 1 << 20, 32), (17, 101, 3), (64, 64, 2)):
        b = sorted((r.id, row(r)) for r in tq.text_quality(df, chunk, segment, fan_in).collect())
        assert a == b and len(b) == 7


def test_states_join_to_the_same_anywhere():
    r = random.Random(1)

    def full(t, chunk):
        s = tq.measured(t, chunk)
        return tq.finish(s, len(t.strip())), s.n, s.cells, s.types

    for _ in range(3000):
        t = "".join(r.choice("ab .,!?)\"'\n\t    -1A*|;é") for _ in range(r.randint(0, 40)))
        assert full(t, r.choice((1, 2, 3, 5, 11))) == full(t, 1 << 20), t


def test_quality_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "  \n ")], "id long, text string")
    assert [(r.words, r.kind) for r in tq.text_quality(df).collect()] == [(0, None)] * 3
    assert tq.text_quality(df.limit(0)).count() == 0


# 4


def test_disguises():
    assert tx.tokens("You are, s c u m b a g and an 1d10t") == ["you", "are", "scumbag", "and", "an", "idiot"]
    m = tx.Model(single={"scumbag": 5.0})
    assert m.scores(tx.tokens("a s c u m b a g"))[0] == 5.0
    assert tx.tokens("m.o.r.o.n сrеtin") == ["moron", "cretin"]
    assert tx.tokens("f***k") == [tx.MASK]
    assert tx.tokens("Room 42, 2*3") == ["room", "42", "2*3"]


def test_maximal_segments_against_brute_force():
    r = random.Random(2)
    for _ in range(300):
        s = [round(r.uniform(-3, 3), 2) for _ in range(r.randint(0, 14))]
        best = max([sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)], default=0)
        lo, hi, v = tx.best_segment(s)
        assert abs(v - max(best, 0)) < 1e-9 and abs(sum(s[lo:hi]) - v) < 1e-9
        segs = tx.maximal_segments(s)
        assert all(a[1] <= b[0] for a, b in zip(segs, segs[1:]))
        if best > 0:
            assert abs(max(v for *_, v in segs) - best) < 1e-9


def test_toxic_passages(spark):
    r = random.Random(4)
    bad = ["you are a filthy gronk", "shut up you stupid gronk", "every gronk deserves to be beaten"]
    rows, labels = [], []
    for k in range(300):
        t = " ".join(r.choice(VOCAB) for _ in range(40))
        toxic = k % 6 == 0
        rows.append(("q", k, t + (" " + r.choice(bad) if toxic else "") + " the end is near", "src-a" if k % 2 else "SRC_A "))
        if k < 200:
            labels.append(("q", k, int(toxic)))
    rows += [("q", 900, None, None), ("q", 901, "", "x")]
    df = spark.createDataFrame(rows, "table_name string, row_id long, text string, source string")
    got = toxic_passages(df, spark.createDataFrame(labels, "table_name string, row_id long, toxic int"))
    hit = {x.row_id for x in got.where("toxic").collect()}
    want = {k for k in range(300) if k % 6 == 0}
    assert len(hit & want) >= 0.9 * len(want) and len(hit - want) <= 3
    assert got.count() == 302
    rates = toxic_rates(got, df).collect()
    assert {x.source for x in rates} == {"src_a", None, "x"}
    none = toxic_passages(df, spark.createDataFrame([], "table_name string, row_id long, toxic int"))
    assert none.where("toxic").count() == 0


def test_passages_of_common_words_are_scored():
    import pyarrow as pa

    model = tx.Model(single={"a": 0.9, "b": 0.9, "c": 0.9, "d": -0.2}, pair={("a", "b"): 1.5, ("b", "c"): 1.5, ("x", "d"): 1.5}, cut=4.0)
    texts = ["so a b c then", "x d", "so then", "", None, "a"]
    n = len(texts)
    batch = pa.record_batch([pa.array(["q"] * n), pa.array(range(n)), pa.array(texts, pa.string())], names=["table_name", "row_id", "text"])
    got = [x for b in tx._score([batch], model) for x in b.to_pylist()]
    for x, t in zip(got, texts):
        ts = tx.tokens(t or "")
        want = max([0.0] + [sum(model.scores(ts)[i:j]) for i in range(len(ts)) for j in range(i + 1, len(ts) + 1)])
        assert abs(x["score"] - want) < 1e-9
        assert x["significance"] == (model.significance(x["score"], len(ts)) if ts else None)
    assert [x["toxic"] for x in got] == [True, False, False, False, False, False]
    assert got[0]["passage"] == "a b c" and [x["passages"] for x in got] == [1, 0, 0, 0, 0, 0]


# 5


def test_defects():
    p = bp.Prompt("Explain why the river is higher in the spring than in the rest of the year.")
    d = lambda a: (lambda x: "truncated" if x == (None, "open") else x[0])(bp.classify(p, a))
    for e in (None, "", "  ", "​", "...", "N/A", "<empty>", "[no response]", '""'):
        assert d(e) == "empty"
    assert d("I'm sorry, but I can't help with that. Thank you for understanding.") == "refusal"
    assert d("Es tut mir leid, aber dabei kann ich nicht helfen.") == "refusal"
    assert d("I'm sorry, I can't say much about the sea. In general the snow melts in the spring, and the water runs into the river for some weeks.") is None
    assert d("Explain why the river is higher in the spring than in the rest of the year.") == "copy"
    assert d("La nieve se derrite en la primavera y el agua llega al río durante muchas semanas.") == "other_language"
    assert bp.classify(bp.Prompt("Translate into Spanish: the snow melts and the water is in the river."), "La nieve se derrite y el agua está en el río.")[0] is None
    assert d("The snow melts in the spring and the water runs into the") == "truncated"
    for ok in ("Yes.", "42", "About two weeks.", "The snow melts.\n1. in the north\n2. in the south", "The snow melts. x = 12", "See here.\n```\nprint(1)\n```"):
        assert d(ok) is None


def test_shortened_versions_and_odd_rows(spark):
    whole = "The snow melts and fills the lake\n1. in the north of the country, near the sea\n2. in the south"
    rows = [(1, "p", whole, whole[:70]), (2, None, "Yes.", None), (3, "p", "x = 5", "Yes."), (3, "p", "x = 5", "Yes.")]
    got = {tuple(r) for r in bp.broken_pairs(spark.createDataFrame(rows, "pair_id long, prompt string, chosen string, rejected string")).collect()}
    assert got == {(1, "rejected", "truncated", "neighbour"), (2, "rejected", "empty", None)}
    for n in (2, 7, 30):
        h = bp.shortened(spark.createDataFrame([(f"prefix number {k:03d}" + " tail" * (k % 3), f"prefix number {k:03d}") for k in range(60)], "chosen string, rejected string"), n)
        assert h.count() == 40
    r = random.Random(6)
    texts = [" ".join(r.choice(("a", "b")) for _ in range(r.randint(1, 6))) for _ in range(150)]
    want = {t for t in texts if any(u.startswith(t) and u != t for u in texts)}
    h = bp.shortened(spark.createDataFrame([(t, t.upper()) for t in texts], "chosen string, rejected string"), 5)
    assert {x.h for x in h.collect()} == {bp._hash(u) for t in want for u in (t, t.upper())}
    assert bp.broken_pairs(spark.createDataFrame([], "pair_id long, prompt string, chosen string, rejected string")).count() == 0


def test_evidence_of_open_endings(spark):
    rows = [(1, "Why is the river high?", "The snow melts in the spring and the water runs into the", "It rains. " * 3000 + "And then"), (2, "p", "The snow melts.", "The snow melts in the spring and the water runs into the lake")]
    got = {tuple(r) for r in bp.broken_pairs(spark.createDataFrame(rows, "pair_id long, prompt string, chosen string, rejected string")).collect()}
    assert (1, "chosen", "truncated", "neighbour") in got and (1, "rejected", "truncated", "ending") in got and not any(k == 2 and side == "chosen" for k, side, *_ in got)


def test_length_limits(spark):
    r = random.Random(7)
    cut = lambda n: " ".join(["The"] + [r.choice(VOCAB) for _ in range(60)])[:n].strip().ljust(n, "x")
    rows = [(k, "p", "Yes.", "\n".join(["Entries", cut(200), "- " + cut(90)])) for k in range(40)] + [(100 + k, "p", "Yes.", "\n".join(["Entries", cut(120 + k), "- one more"])) for k in range(60)]
    got = bp.broken_pairs(spark.createDataFrame(rows, "pair_id long, prompt string, chosen string, rejected string")).collect()
    assert {(x.pair_id, x.evidence) for x in got} == {(k, "limit") for k in range(40)}


# 7


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_leaks_against_brute_force(spark, limit):
    items = [(k, text(30)) for k in range(12)] + [(50, "too short"), (51, None), (0, text(20))]
    stock = text(14)
    items += [(60, stock + " " + text(5)), (61, text(5) + " " + stock)]
    docs = []
    for k in range(80):
        q = R.choice(items)[1] or ""
        w = q.split()
        cut = w[3 : 3 + R.choice([0, 8, 11, 12, 20])]
        docs.append((k, text(20) + " " + ", ".join(cut).upper() + " " + text(15)))
    docs += [(100, None), (101, ""), (102, stock), (None, stock), (102, stock)]
    win = defaultdict(set)
    for k, t in items:
        w = words(t)
        for i in range(len(w) - 11):
            win[tuple(w[i : i + 12])].add(k)
    want = {(d, q) for d, t in docs if d is not None and t for w in [words(t)] for i in range(len(w) - 11) for q in win.get(tuple(w[i : i + 12]), ())}
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item int")
    got = leaked_passages(d, spark.createDataFrame(items, "item long, text string"), broadcast_rows=limit)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert leaked_passages(d.limit(0), spark.createDataFrame(items, "item long, text string"), broadcast_rows=limit).count() == 0


# 8


def test_quotas_and_splits():
    rng = np.random.default_rng(0)
    units = np.array([100, 3, 0, 57])
    deal = split_quotas(units, 7, rng)
    assert (deal.sum(axis=0) == units).all() and deal.sum(axis=1).max() - deal.sum(axis=1).min() <= 2
    q = quotas({"a": 100, "b": 10}, [("a", 0.5, 1), ("b", 0.5, 4), ("c", 0.0, 1)])
    assert [(x.source, x.want, x.rounds, x.rest) for x in q] == [("a", 40.0, 0, 40.0), ("b", 40.0, 4, 0.0)]


def test_mixture(spark):
    docs = [(k, text(R.randint(5, 60)), "Big-Source") for k in range(400)] + [(1000 + k, text(30), "small_source ") for k in range(12)] + [(2000, None, "small_source"), (2001, "x", None), (2002, "y", "other")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, source string, copy int")
    t = spark.createDataFrame([("big_source", 0.8, 1), ("small_source", 0.2, 3)], "source string, target_share double, max_repeats int")
    m = Mixture(d, t, shards=4)
    s = {r.source: r for r in m.shares().collect()}
    assert abs(s["big_source"].share - 0.8) < 0.01 and s["small_source"].max_times <= 3
    c = m.chosen().collect()
    assert max(r.times for r in c if r.source == "big_source") == 1 and len({r.doc_id for r in c}) == len(c)
    lay = m.layout().collect()
    assert len(lay) == sum(r.times for r in c) and len({(r.doc_id, r.copy) for r in lay}) == len(lay) and {r.shard for r in lay} == {0, 1, 2, 3}
    again = Mixture(d.repartition(7), t, shards=4)
    assert sorted(map(tuple, again.chosen().collect())) == sorted(map(tuple, c))
    assert Mixture(d.limit(0), t).chosen().count() == 0
    small = Mixture(d, t, shards=4, block_tokens=200)  # other blocks, the same shares
    assert all(abs(r.share - s[r.source].share) < 0.01 for r in small.shares().collect())
    lay = small.layout().groupBy("source", "shard").count().where("source = 'big_source'").collect()
    assert len(lay) == 4 and max(r["count"] for r in lay) < 2 * min(r["count"] for r in lay)


# 9


def test_residue(spark):
    docs = [
        (1, "The river was high after the rain. We waited for the boat, and in the evening it came at last."),
        (2, "404 Not Found\nThe requested page could not be found on this server."),
        (3, "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore."),
        (4, "Please enable JavaScript to view this page."),
        (5, "Dear {{ customer_name }}, the boat leaves in the morning and comes back before the night."),
        (6, "The placeholder [NAME] stands for the speaker in our examples. " + "The rest of the text is about the river and the boats in the old harbour of the town. " * 4),
        (7, "A missing page returns the 404 status, and the crawler drops it. " + "The river was high after the rain, and the boats waited for us in the harbour until the evening. " * 4),
        (8, None), (9, ""), (10, "{}"),
    ]
    prose = [(100 + k, f"The {R.choice(VOCAB)} of the town was open in the morning, but we had to wait for the {R.choice(VOCAB)} until they came back.") for k in range(200)]
    got = {r.doc_id: r for r in tr.template_residue(spark.createDataFrame(docs + prose, "doc_id long, text string")).collect()}
    assert {k for k, r in got.items() if r.excluded} == {2, 3, 4, 5}
    assert got[5].kind == "slot" and got[3].kind == "filler"
    assert tr.template_residue(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_residue_is_the_same_across_seams():
    r = np.random.default_rng(1)
    ratios = np.concatenate([tr.log_ratios(tr.seed_counts()[:-1], tr.counts_of(PROSE)), tr.log_ratios(tr.seed_counts()[-1:], tr.counts_of(PROSE, True))])
    error = "The requested page could not be found on this server."
    texts = [" ".join([PROSE, error, "{{ name }}"] * 5).replace("\n", " "), error, None, "", "[NAME]", "x", error + "\n" + PROSE, " ".join(str(x) for x in r.integers(0, 99, 300)) + " " + error]
    whole = tr.measure(texts, ratios)
    assert whole["covered"].max() > 0 and whole["near"].any()
    for size in (1, 30, 64, 500):
        part = tr.measure(texts, ratios, size)
        assert all((whole[k] == part[k]).all() for k in ("covered", "slots", "kind", "near"))
        if size >= 200:  # what a heading is, is asked of whole lines
            assert np.allclose(whole["share"], part["share"])


def test_slot_windows_find_every_form():
    natural = tr.counts_of(PROSE * 50, True)
    ratios = np.concatenate([np.zeros((len(tr.KINDS), 1 << tr.BITS), np.float32) - 1, tr.log_ratios(tr.seed_counts()[-1:], natural)])
    forms = ["{{ name }}", "${user}", "<%= x %>", "[[topic]]", "{city}", "%FIRST_NAME%", "__TITLE__", "[YOUR NAME]", "<insert name>", "XX/XX/XXXX", "TODO: write", "TBD TBD", "%s", "XXXX"]
    got = tr.measure([f"The boat of {f} leaves in the morning." for f in forms] + [PROSE], ratios)
    assert got["slots"].tolist() == [1] * len(forms) + [0]


def test_queries_are_registered():
    from loomspan.llm import queries

    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 9)} <= set(queries.queries()) and "p8_mix" in queries.queries()
