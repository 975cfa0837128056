"""Text columns and quality rules against plain Python restatements."""

import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import dedup, quality, synthetic
from loomspan.operators.curation import Curator
from loomspan.plans import curation as plans


def repetition(text, n=3):
    w = text.lower().split()
    g = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    return 1 - len(set(g)) / len(g) if len(w) >= n else 0.0


def coherence(text):
    s = [x.strip() for x in re.split(r"[.!?]+", text) if x.strip()]
    if len(s) < 2:
        return 1.0
    out = 0.0
    for a, b in zip(s, s[1:]):
        a, b = set(a.lower().split()), set(b.lower().split())
        if a and b:
            out += len(a & b) / min(len(a), len(b))
    return out / (len(s) - 1)


def reason(t):
    if t is None:
        return "invalid_type"
    if len(t) < 50:
        return "too_short"
    if len(t) > 100_000:
        return "too_long"
    if len(t.split()) < 10:
        return "too_few_words"
    if not re.search("[.!?]", t):
        return "no_punctuation"
    return "too_repetitive" if repetition(t) > 0.3 else None


TEXTS = [
    None, "", "   ", "Hello", "word " * 10, "a b c d e f g h i j k l m n o p q r s t u v w x y z and on it goes.", "A" * 200, "x. " * 40, "This is a sentence. " * 1000,
    "One two three four five six. Seven eight nine ten, eleven! Twelve words are in here.", "A" * 100_001 + " b" * 20 + ".", "No stop here but there are more than ten words in this text at all",
    "The cat sat. The cat ran. A dog ran!", "Zeus \U0001f389 Γειά σου Κόσμε. And many more words to come after this one, ten at least.",
]


def test_reasons_and_scores(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.with_reason(df).withColumn("w", T.words(F.col("text"))).select("doc_id", "reason", T.repetition(F.col("w")).alias("r"), T.coherence(T.sentence_sets(F.col("text"))).alias("c")).collect()}
    for k, t in enumerate(TEXTS):
        assert got[k].reason == reason(t)
        if t is not None:
            assert abs(got[k].r - repetition(t)) < 1e-12
            assert abs(got[k].c - coherence(t)) < 1e-9


def test_words_on_any_text(spark):
    @settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.text(alphabet=st.sampled_from("abc \t\n  .!"), max_size=30), min_size=20, max_size=20))
    def check(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
        for r in df.select("k", T.words(F.col("t")).alias("w"), T.shingles(T.words(F.col("t")), 3).alias("s")).collect():
            w = texts[r.k].lower().split()
            assert r.w == w
            assert r.s == [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]

    check()


def test_exact_dedup_keeps_first_and_nulls(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 2), (2, "b", 3), (4, None, 4), (5, None, 5)], "doc_id long, text string, duplicate_of int")
    assert sorted(r.doc_id for r in dedup.exact_dedup(df).collect()) == [1, 2, 4, 5]
    assert dedup.exact_dedup(df.limit(0)).count() == 0


def test_greedy_keep_chain(spark):
    ids = spark.createDataFrame([(k,) for k in range(1, 7)], "id long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a long, b long")
    assert sorted(r.id for r in dedup.greedy_keep(ids, edges).collect()) == [1, 3, 4, 6]


def test_jaccard_pairs_against_brute_force(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base[:30] + ["x"] + base[31:]), " ".join(base[:20] + ["y", "z"] + base[22:40]), " ".join(reversed(base)), " ".join(base), "short", ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(9, None)], "doc_id long, text string")

    def sh(t):
        w = t.split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    want, seen = set(), {}
    for k, t in enumerate(texts):
        seen.setdefault(frozenset(sh(t)), k)
    keys = list(seen)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if len(a & b) / len(a | b) >= 0.8:
                want.add((seen[a], seen[b]))
    assert {(r.a, r.b) for r in dedup.jaccard_pairs(df).collect()} == want and want


def test_jaccard_keep_against_brute_force(spark):
    base = [f"w{i}" for i in range(60)]
    near = base[:30] + ["x"] + base[31:]
    texts = [" ".join(near), " ".join(base).upper(), "  ".join(base), "\u00a0".join(near), " ".join(base), "short", "Short ", "", " ", "\u00a0", " ".join(near[:59]), " ".join(reversed(base))]
    df = spark.createDataFrame([*enumerate(texts), (20, None), (21, None)], "doc_id long, text string")

    def sh(t):
        w = t.lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    kept = []
    for k, t in enumerate(texts):
        if all(len(sh(t) & sh(texts[j])) / len(sh(t) | sh(texts[j])) < 0.8 for j in kept):
            kept.append(k)
    assert sorted(r.id for r in dedup.jaccard_keep(df).collect()) == [*kept, 20, 21]
    members, _ = dedup.jaccard_classes(df)
    assert {r.id: r["class"] for r in members.collect()} == {0: 0, 1: 1, 2: 1, 3: 0, 4: 1, 5: 5, 6: 5, 7: 7, 8: 7, 9: 7, 10: 10, 11: 11}


def test_minhash_bands_and_index(spark):
    assert dedup.bands_for(0.8, 128) == (9, 13)
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words), " ".join(words[:99]), " ".join(f"v{i}" for i in range(100))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in dedup.minhash_dedup(df).collect()) == [0, 2]
    sig = dedup.signatures(df)
    hits = dedup.query_similar(dedup.band_table(sig), sig.where("id = 0")).collect()
    assert {(r.probe, r.id) for r in hits} >= {(0, 0), (0, 1)} and (0, 2) not in {(r.probe, r.id) for r in hits}


def test_curator_counts_only_survivors(spark):
    good = "These are more than ten words in one proper sentence, which is long enough. "
    df = spark.createDataFrame([(1, good), (2, good), (3, "no"), (4, None)], "doc_id long, text string")
    kept, stats = Curator().quality().deduplicate().run(df)
    assert [r.doc_id for r in kept.collect()] == [1]
    assert {(r.stage, r.reason, r.n) for r in stats.collect()} == {("quality", "kept", 2), ("quality", "too_short", 1), ("quality", "invalid_type", 1), ("dedup", "kept", 1), ("dedup", "exact_duplicate", 1)}
    merged = quality.merge_stats(stats.select("reason", "n"), stats.select("reason", "n"))
    assert {r.reason: r.n for r in merged.collect()}["kept"] == 6


def test_lexicon_is_judged_by_all_verdicts(spark):
    ids = spark.range(30_000)
    tables = {"toxicity_labels": ids.select(F.lit("quality_texts").alias("table_name"), F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("toxic")), "quality_texts": ids.select("id", F.when(F.col("id") % 4 < 2, "an idiot").otherwise("a text").alias("text"))}
    r = plans.lexicon_vs_labels(tables.get, spark).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (7500, 7500, 7500, 7500)


def test_parse_instructions_of_all_documents(spark):
    texts = [
        "### Instruction:\nDo it\n\n### Response:\nDone", "Below is a task.\n### instruction\nDo it\n### Input:\nN/A\n### Output:\nDone", "###Instruction: \n a\nb \n### INPUT:\nx y\n### Response:\nr\n### Note:\nz",
        "### Instruction:\nNo response", "### Instruction:\n\n### Response:\nr", "plain", "", None,
    ]

    def sec(t, name):
        m = re.search(rf"###\s*{name}:?\s*\n(.*?)(?=###|\Z)", t or "", re.DOTALL | re.IGNORECASE)
        return m[1].strip() if m else ""

    want = set()
    for k, t in enumerate(texts):
        i, x, o, r = (sec(t, n) for n in ("Instruction", "Input", "Output", "Response"))
        if i:
            want.add((k, i, "" if x in ("N/A", "None", "none") else x, o, r))
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert {tuple(r) for r in plans.parse_instructions(lambda _: df, spark).collect()} == want and len(want) == 4


def test_bucket_drops_against_the_sequential_rule(spark):
    r = random.Random(3)
    cases = [[(0, 1, 1), (0, 1, 2), (1, 7, 2), (1, 7, 3), (1, 7, 4), (2, 5, 3), (2, 5, 4)]]  # 2 is dropped for 1, so 3 is kept and drops 4
    cases += [[(b, r.randrange(12), k) for b in range(3) for k in range(40)]]
    for rows in cases:
        buckets, kept = {}, set()
        for b, key, k in rows:
            buckets.setdefault(k, set()).add((b, key))
        for k in sorted(buckets):
            if not any(buckets[k] & buckets[j] for j in kept):
                kept.add(k)
        got = {x.id for x in dedup.bucket_drops(spark.createDataFrame(rows, "band int, key long, id long")).collect()}
        assert set(buckets) - got == kept


def test_diverse_is_sequential_across_chunks(spark):
    r = random.Random(8)
    families = [[f"f{k}x{i}" for i in range(8)] for k in range(12)]
    texts = []
    for _ in range(150):
        ws = list(r.choice(families))
        for _ in range(r.randrange(4)):
            ws[r.randrange(8)] = f"z{r.randrange(9)}"
        texts.append(" ".join(ws))
    texts[70:73] = ["", None, "one"]
    kept = []
    for k, t in enumerate(texts):
        ws = (t or "").split()
        if all(synthetic.rouge_l(ws, (texts[j] or "").split()) <= 0.7 for j in kept[-10:]):
            kept.append(k)
    df = spark.createDataFrame([*enumerate(texts)], "id long, instruction string")
    for rows in (7, 40):
        assert sorted(x.id for x in synthetic.diverse(df, history=10, rows=rows).collect()) == kept
    assert synthetic.diverse(df.limit(0)).count() == 0
