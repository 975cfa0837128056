"""Abusive, hateful and sexual passages, by maximum-scoring segments of token log-odds.

Tokens are words after undoing disguises: look-alike letters, digits for letters, letters spaced out, drawn out or
masked. A bounded sample of reviewed rows gives the counts of tokens and of pairs of neighbouring tokens in toxic
passages; all rows of all tables give the background. Log-odds with a Dirichlet prior (the background) make every
position of a text a score, negative where nothing points to toxicity. A linear scan finds the maximal segments
(each the best in its surroundings); their scores follow an extreme-value law under the background, which turns the
best one into an expected number of chance segments, comparable between texts of any length. Toxic passages are
learned in rounds: at first whole toxic texts count, afterwards only the segments found in them.

Reviewed texts stay on the executors, the driver gets counts and scores. Beside the model of all of them there is one for each
fold, fitted without the fold's texts; what counts as a significant score is read off texts that the scoring model has not seen.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize

# Cyrillic and Greek letters that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
# Digits and signs that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

MASK = "\x01mask"
_TOKEN = re.compile(r"[^\W_]+(?:[*@$!]+[^\W_]+)*")
_DOTTED = re.compile(r"(?<![^\W_])[^\W\d_](?:[.\-_·][^\W_]){2,}(?![^\W_])|(?<![^\W_])[^\W_](?:[.\-_·][^\W_]){3,}(?![^\W_])")
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?: [^\W_]){3,}(?![^\W_])")
_DRAWN = re.compile(r"(.)\1{2,}")
_RUN = re.compile(r"(.)\1+")
_TO_LATIN, _FROM_LEET = str.maketrans(LOOK_ALIKES), str.maketrans(LEET)
_PLAIN_MOST = 500_000
_ODD = re.compile(r"\d|[*@$!]|[Ͱ-ӿԀ-֏ɡ]")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")


def _plain(t: str) -> str:
    """One token without its disguise."""
    if _ODD.search(t) and not t.isdigit():
        if "*" in t:
            return MASK if any(c.isalpha() for c in t) else t
        latin = t.translate(_TO_LATIN)
        if not latin.isascii() and any("Ͱ" <= c <= "֏" for c in latin):
            latin = t  # a word of another script
        t = latin
        if any(c.isalpha() for c in t):
            t = t.translate(_FROM_LEET)
    if _DRAWN.search(t):
        t = "\x02" + _RUN.sub(r"\1", t)  # drawn out: compared without doubled letters
    return t


class _Plain(dict):
    """Tokens by how they are written, emptied when it has grown too large."""

    def __missing__(self, t: str) -> str:
        if len(self) >= _PLAIN_MOST:
            self.clear()
        x = self[t] = t if t.isalpha() and t.isascii() and not _DRAWN.search(t) else _plain(t)
        return x


_plain_of = _Plain()


def tokens(text: str) -> list[str]:
    """Tokens of a text, disguises undone."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower()
    if "." in text or "-" in text or "_" in text:
        text = _DOTTED.sub(lambda m: re.sub(r"[.\-_·]", "", m[0]), text)
    text = _SPACED.sub(lambda m: m[0].replace(" ", ""), text)  # an article before may be caught, see Model.known
    return [_plain_of[t] for t in _TOKEN.findall(text)]


@dataclass
class Model:
    """Scores of tokens and pairs, and the law of the best segment under the background."""

    single: dict = field(default_factory=dict)
    pair: dict = field(default_factory=dict)
    drawn: dict = field(default_factory=dict)
    base: float = -1.5
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    cut: float = 0.0  # least log of 1 / expected number of chance segments
    precision: float | None = None  # of the cut, on reviewed texts that the scoring model has not seen
    recall: float | None = None
    _firsts: list = field(default_factory=list, repr=False)

    def scores(self, ts: list[str]) -> list[float]:
        single, base = self.single, self.base
        ts = [t if t in single else self.known(t) for t in ts]
        out = [single.get(t, base) for t in ts]
        pair, first = self.pair, self.firsts
        for i, t in enumerate(ts[:-1]):
            if t in first and (p := pair.get((t, ts[i + 1]))) is not None:
                out[i + 1] += p
        return out

    @property
    def firsts(self) -> set:
        """First tokens of the pairs."""
        if len(self._firsts) != 1 or self._firsts[0][0] is not self.pair:
            self._firsts[:] = [(self.pair, {a for a, _ in self.pair})]
        return self._firsts[0][1]

    def known(self, t: str) -> str:
        """The scored token that a drawn-out one, or one joined with the article before it, stands for."""
        c = t[0]
        if c == "\x02":
            return self.drawn.get(t, t)
        if c in "aioy" and len(t) > 4 and self.single.get(t[1:], 0.0) > 1:
            return t[1:]
        return t

    def significance(self, score: float, n: int) -> float:
        """Log of 1 / expected number of chance segments of at least this score in ``n`` tokens."""
        return self.rate * score - math.log(max(self.scale * max(n, 1), 1e-300))


def maximal_segments(scores: list[float], least: float = 0.0) -> list[tuple[int, int, float]]:
    """All maximal segments (start, end, score) of more than ``least``, from left to right, in linear time."""
    cum, stack = 0.0, []
    for i, s in enumerate(scores):
        before, cum = cum, cum + s
        if s <= 0:
            continue
        lo, left, right = i, before, cum
        while stack:
            j = len(stack) - 1
            while j >= 0 and stack[j][1] >= left:  # nearest segment that begins lower
                j -= 1
            if j < 0 or stack[j][2] >= right:
                break
            lo, left = stack[j][0], stack[j][1]
            del stack[j:]
        stack.append((lo, left, right, i + 1))
    return [(a, e, r - x) for a, x, r, e in stack if r - x > least]


def best_segment(scores: list[float]) -> tuple[int, int, float]:
    """The segment of greatest score: (start, end, score)."""
    best, at, cum, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        cum += s
        if cum <= 0:
            cum, start = 0.0, i + 1
        elif cum > best:
            best, at = cum, (start, i + 1)
    return (*at, best)


def _background(batches, single: frozenset, pair: frozenset):
    """Partial counts of the wanted tokens and pairs, and the number of all tokens."""
    counts: Counter = Counter()
    n = 0
    for b in batches:
        for t in b.column(0).to_pylist():
            if not t:
                continue
            ts = tokens(t)
            n += len(ts)
            counts.update([x for x in ts if x in single])
            counts.update([x for x in zip(ts, ts[1:]) if x in pair])
    keys = [k if isinstance(k, str) else "\x03".join(k) for k in counts]
    yield pa.record_batch([pa.array([*keys, ""]), pa.array([*counts.values(), n], pa.int64())], names=["key", "n"])


DRIFT, FLOOR, BOUND = 0.4, -1.5, 1.3  # cost of a position, least score of one, standard errors taken off


def _weigh(inside: dict, size: int, background: dict, total: int, prior: float) -> dict:
    """Log-odds of each feature in toxic passages against the background, which also is the Dirichlet prior.

    Of each the lower confidence bound counts, less the cost of a position, so that chance and topic add up to nothing.
    """
    a = prior * size
    out = {}
    for f, c in inside.items():
        n = max(background.get(f, 0), c) + 0.5
        p = n / (total + 1.0)
        w = math.log((c + a * p) / ((size + a) * p)) - BOUND * math.sqrt(1 / (c + a * p) + 1 / n)
        out[f] = max(w - DRIFT, FLOOR)
    return out


def _key(f) -> str:
    return f if isinstance(f, str) else "\x03".join(f)


def _feature(key: str):
    return tuple(key.split("\x03")) if "\x03" in key else key


_COUNTS = "part int, what string, key string, n long"


def _counted(counts: dict):
    """Counters by part (a fold or a model) and kind as rows."""
    rows = [(m, what, _key(f), n) for (m, what), c in counts.items() for f, n in c.items()]
    m, what, key, n = zip(*rows) if rows else ((), (), (), ())
    return pa.record_batch([pa.array(m, pa.int32()), pa.array(what, pa.string()), pa.array(key, pa.string()), pa.array(n, pa.int64())], names=["part", "what", "key", "n"])


def _tokenized(batches):
    for b in batches:
        yield pa.record_batch([pa.array([" ".join(tokens(t)) for t in b.column(0).to_pylist()], pa.string()), b.column(1), b.column(2)], names=["tokens", "toxic", "fold"])


def _sample(batches):
    """(tokens, toxic, fold) of reviewed rows."""
    for b in batches:
        for t, toxic, fold in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if t:
                yield t.split(" "), toxic, fold


def _first_counts(batches):
    """For every fold, texts and tokens by verdict: in how many texts a token and a pair stands, and how often in toxic ones."""
    out: dict = {}
    for ts, toxic, fold in _sample(batches):
        for what, fs in ((f"texts{toxic}", [""]), (f"in{toxic}", {*ts, *zip(ts, ts[1:])}), *((("all", ts), ("all", zip(ts, ts[1:]))) if toxic else ())):
            out.setdefault((fold, what), Counter()).update(fs)
    yield _counted(out)


def _segment_counts(batches, models: list[Model], least: list[float], pairs: frozenset):
    out: dict = {}
    for ts, toxic, fold in _sample(batches):
        for m, model in enumerate(models):
            if m == fold + 1 or not toxic:
                continue
            for lo, hi, _ in maximal_segments(model.scores(ts), least[m]):
                c = out.setdefault((m, "all"), Counter())
                c.update(ts[lo:hi])
                c.update([x for x in zip(ts[lo:hi], ts[lo + 1 : hi]) if x in pairs])
    yield _counted(out)


def _best_scores(batches, which):
    """Best score and length of reviewed texts by the models that ``which`` (toxic, fold) names."""
    rows = []
    for ts, toxic, fold in _sample(batches):
        for m, model in which(toxic, fold):
            rows.append((m, toxic, best_segment(model.scores(ts))[2], len(ts)))
    m, toxic, score, n = zip(*rows) if rows else ((), (), (), ())
    yield pa.record_batch([pa.array(m, pa.int32()), pa.array(toxic, pa.int32()), pa.array(score, pa.float64()), pa.array(n, pa.int64())], names=["model", "toxic", "score", "n"])


_BEST = "model int, toxic int, score double, n long"


def fit(texts: DataFrame, reviewed: DataFrame, rounds: int = 4, prior: float = 0.3, folds: int = 5) -> Model:
    """Model from reviewed texts (``text``, ``toxic``), whose number must be bounded, and all ``texts`` as background.

    Tokens and pairs of reviewed texts come to the driver as counts; pairs that stand in one text only are of no use and stay.
    """
    rows = reviewed.where("text is not null and toxic is not null").select("text", F.col("toxic").cast("int").alias("toxic"), F.pmod(F.xxhash64("text", F.lit(5)), F.lit(folds)).cast("int").alias("fold"))
    rows = materialize(rows.mapInArrow(_tokenized, "tokens string, toxic int, fold int"), "reviewed")
    by_fold = F.array(*(F.sum(F.when(F.col("part") == k, F.col("n")).otherwise(0)) for k in range(folds)))
    got = rows.mapInArrow(_first_counts, _COUNTS).groupBy("what", "key").agg(by_fold.alias("n"), F.sum("n").alias("total"))
    pair = F.contains("key", F.lit("\x03"))
    counts: dict = {}
    for what, key, n in got.where(~pair | (F.col("total") >= F.when(F.col("what") == "in0", 3).otherwise(2))).select("what", "key", "n").collect():
        counts.setdefault(what, {})[_feature(key)] = n
    if "texts1" not in counts:
        return Model(cut=math.inf)
    if min(counts["texts1"][""][k] for k in range(folds)) == 0 or sum(counts["texts1"][""]) < 2 * folds:
        folds = 0  # too few to leave any out
    models = [Model(base=FLOOR) for _ in range(folds + 1)]
    features, inside = [], []
    for m in range(len(models)):
        of = lambda what, m=m: {f: c for f, n in counts.get(what, {}).items() if (c := sum(n) - (n[m - 1] if m else 0))}
        positive, negative, seen, plain = of("texts1")[""], of("texts0").get("", 0), of("in1"), of("in0")
        single = {t for t in seen if isinstance(t, str)}
        # pairs that harmless texts make of telling tokens speak against toxicity, even where no toxic text has them
        telling = {t for t in single if seen[t] / positive > 2 * (plain.get(t, 0) + 1) / (negative + 1)}
        harmless = {p for p, c in plain.items() if not isinstance(p, str) and c >= 3 and (p[0] in telling or p[1] in telling)}
        features.append((single, {p for p, c in seen.items() if not isinstance(p, str) and c >= 2} | harmless))
        inside.append(of("all"))
    del counts
    single, pairs = frozenset().union(*(x for x, _ in features)), frozenset().union(*(x for _, x in features))
    got = texts.select("text").mapInArrow(lambda it: _background(it, single, pairs), "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    background = {_feature(r[0]): r[1] for r in got}
    total = background.pop("", 0) or 1
    for k in range(rounds):
        for m, model in enumerate(models):
            model.single, model.pair, model.drawn = _weights(inside[m], features[m][1], background, total, prior)
        if k == rounds - 1:
            break
        # passages that harmless reviewed texts hardly ever have, read off a fold for each model, one that it was fitted with
        which = lambda toxic, fold: [(m, x) for m, x in enumerate(models) if not toxic and (not folds or m % folds == fold)]
        scores = rows.mapInArrow(lambda it, which=which: _best_scores(it, which), _BEST).toPandas()
        least = []
        for m in range(len(models)):
            harmless = sorted(scores["score"][scores["model"] == m].tolist())
            least.append(harmless[int(0.97 * (len(harmless) - 1))] if harmless else 0.0)
        segments: dict = {}
        for m, key, n in rows.mapInArrow(lambda it, least=least: _segment_counts(it, models, least, pairs), _COUNTS).groupBy("part", "key").agg(F.sum("n").alias("n")).collect():
            segments.setdefault(m, {})[_feature(key)] = n
        if 0 not in segments:
            break
        inside = [segments.get(m, inside[m]) for m in range(len(models))]
    model = models[0]
    model.rate = _rate(model, background, total)
    unseen = lambda toxic, fold: [(fold + 1, models[fold + 1]) if folds else (0, model)]
    _calibrate(model, rows.mapInArrow(lambda it: _best_scores(it, unseen), _BEST).toPandas())
    return model


def _weights(inside: dict, pairs: set, background: dict, total: int, prior: float) -> tuple[dict, dict, dict]:
    """Scores of tokens, of pairs beyond their tokens, and the tokens that drawn-out ones stand for."""
    alone = {f: c for f, c in inside.items() if isinstance(f, str)}
    size = sum(alone.values())
    single, pair, drawn = _weigh(alone, size, background, total, prior), {}, {}
    for f, w in _weigh({f: inside.get(f, 0) for f in pairs}, size, background, total, prior).items():
        v = w - single.get(f[0], FLOOR) - single.get(f[1], FLOOR)
        if v < -0.3 or (w > 0 and v > 0.3):  # a pair adds what its tokens don't say; half, as pairs overlap
            pair[f] = max(-3.0, min(1.5, 0.5 * v))
    for t, w in sorted(single.items()):
        if w > 0 and t[0] > "\x03":
            drawn.setdefault("\x02" + _RUN.sub(r"\1", t), t)
    return single, pair, drawn


def _rate(model: Model, background: dict, total: int) -> float:
    """Lambda: the rate at which best scores thin out under the background distribution of scores."""
    known = [((background.get(t, 0) + 0.5) / (total + 1.0), w) for t, w in model.single.items()]
    rest = max(0.0, 1 - sum(p for p, _ in known))

    def excess(x: float) -> float:
        return sum(p * math.exp(min(x * w, 600)) for p, w in known) + rest * math.exp(x * model.base) - 1

    lo, hi = 1e-3, 1.0
    while excess(hi) < 0 and hi < 8:
        hi *= 2
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if excess(mid) > 0 else (mid, hi)
    return hi


def _calibrate(model: Model, best) -> None:
    """K from the best scores of harmless reviewed texts, the cut from those of all, by models that have not seen them."""
    none, some = ([(s, n) for s, n, t in zip(best["score"].tolist(), best["n"].tolist(), best["toxic"].tolist()) if t == k] for k in (0, 1))
    if none:
        mass = sum(n * math.exp(-model.rate * s) for s, n in none)
        model.scale = len(none) / max(mass, 1e-12)
    y = sorted([(model.significance(*x), 0) for x in none] + [(model.significance(*x), 1) for x in some], reverse=True)
    # the cut with the best balance of precision and recall; harmless rows weigh more, as toxic ones are over-represented
    hit = wrong = 0
    top, model.cut = -1.0, y[0][0] if y else 0.0
    for k, (v, toxic) in enumerate(y):
        hit, wrong = hit + toxic, wrong + (1 - toxic)
        f = 2 * hit / (hit + 2 * wrong + len(some))
        if f > top and (k + 1 == len(y) or y[k + 1][0] < v):
            top, model.precision, model.recall = f, hit / (hit + wrong), hit / max(len(some), 1)
            model.cut = (v + (y[k + 1][0] if k + 1 < len(y) else v)) / 2


def _score(batches, model: Model):
    for b in batches:
        rows = []
        for t in b.column(2).to_pylist():
            ts = tokens(t) if t else []
            if not ts:
                rows.append((0.0, None, 0, None, False))
                continue
            s = model.scores(ts)
            if max(s) <= 0:  # no segment at all
                rows.append((0.0, model.significance(0.0, len(ts)), 0, None, False))
                continue
            a, e, v = best_segment(s)
            z = model.significance(v, len(ts))
            n = sum(model.significance(x, len(ts)) >= model.cut for _, _, x in maximal_segments(s))
            rows.append((v, z, n, " ".join(ts[a:e]) if z >= model.cut else None, z >= model.cut))
        score, z, n, passage, toxic = zip(*rows) if rows else ((), (), (), (), ())
        yield pa.record_batch(
            [b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array(z, pa.float64()), pa.array(n, pa.int64()), pa.array(passage, pa.string()), pa.array(toxic, pa.bool_())],
            names=["table_name", "row_id", "score", "significance", "passages", "passage", "toxic"],
        )


def toxic_passages(records: DataFrame, reviewed: DataFrame, most_reviewed: int = 20_000) -> DataFrame:
    """(table_name, row_id, score, significance, passages, passage, toxic): one row a row of ``records`` (table_name, row_id, text).

    ``reviewed`` has ``table_name``, ``row_id`` and ``toxic`` (0 or 1); null verdicts and rows that aren't in ``records`` are left
    out. Null or empty texts score 0 with a null significance; without a toxic verdict nothing is toxic. Other
    columns are ignored, repeated rows stay, an empty input gives an empty result.
    """
    src = records.select(F.col("table_name").cast("string").alias("table_name"), F.col("row_id").cast("long").alias("row_id"), F.col("text").cast("string").alias("text"))
    verdicts = reviewed.select("table_name", "row_id", "toxic").where("toxic in (0, 1)").orderBy(F.xxhash64("table_name", "row_id"), "toxic").limit(most_reviewed)
    sample = src.join(F.broadcast(verdicts), ["table_name", "row_id"])  # at most most_reviewed rows
    model = fit(src, sample)
    return src.mapInArrow(lambda it: _score(it, model), "table_name string, row_id long, score double, significance double, passages long, passage string, toxic boolean")


def toxic_rates(scored: DataFrame, sources: DataFrame) -> DataFrame:
    """(table_name, source, texts, toxic, rate): rates per source; spellings of a source are one, null is its own group."""
    name = F.regexp_replace(F.lower(F.trim("source")), "[- ]", "_")
    x = scored.join(sources.select("table_name", "row_id", name.alias("source")), ["table_name", "row_id"])
    return x.groupBy("table_name", "source").agg(F.count("*").alias("texts"), F.count_if("toxic").alias("toxic")).withColumn("rate", F.col("toxic") / F.col("texts"))
