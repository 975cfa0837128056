"""Broken prompt and response pairs: empty, truncated, refusing, copying and foreign answers.

All answers are sorted by text, backwards, so that a text comes right after the ones that begin with it: an answer whose
neighbour goes on where it stops is a shortened version. Answer lengths are counted, and a length at which unusually many
answers stop without an end is a limit. Where no longer version was delivered and no limit shows, neither says anything; then the
ending itself decides whether an answer stops within a sentence. Every truncated answer names its evidence (``neighbour``, ``limit``,
``ending``). Rules find the empty ones, copies of the prompt, refusals and other languages.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .common_words import ANY, BY_LANGUAGE
from .words import WORD

# Stand-ins for no answer, without brackets, quotes and points.
STAND_INS = frozenset(
    (
        "null|none|nil|nan|na|n/a|n.a|undefined|empty|blank|missing|no response|no answer|no content|no output|no reply|not available|not applicable|no data|response missing|empty response|"
        "aucune réponse|pas de réponse|sans réponse|vide|néant|keine antwort|keine angabe|leer|k.a|sin respuesta|ninguna respuesta|vacío|vacio|nessuna risposta"
    ).split("|")
)
# Names of languages.
LANGUAGE_NAMES = {
    "en": r"english|anglais|englisch\w*|inglés|ingles|inglese",
    "fr": r"french|français|francais|französisch\w*|francés|frances|francese",
    "de": r"german|allemand|deutsch\w*|alemán|aleman|tedesco",
    "es": r"spanish|espagnol|spanisch\w*|español|espanol|castellano|castilian|spagnolo",
    "it": r"italian|italien|italienisch\w*|italiano",
    "pt": r"portuguese|portugais|portugiesisch\w*|portugués|português",
    "nl": r"dutch|néerlandais|niederländisch\w*|holländisch\w*|neerlandés|holandés",
}
# What refusals say.
REFUSALS = re.compile(
    r"""\b(?:
    (?:i|we)\s+(?:really\s+|simply\s+|just\s+)?(?:can\s?not|can'?t|could\s+not|couldn'?t|won'?t|will\s+not|am\s+not\s+able|are\s+not\s+able|am\s+unable|must\s+(?:decline|refuse)|have\s+to\s+(?:decline|refuse|pass)|need\s+to\s+decline|decline|refuse|prefer\s+not|prefer\s+to\s+leave|would\s+prefer\s+not|would\s+rather\s+not|am\s+not\s+(?:allowed|permitted|comfortable|in\s+a\s+position|the\s+right))
    |i'?m\s+(?:not\s+able|unable|not\s+allowed|not\s+permitted|not\s+comfortable|not\s+in\s+a\s+position|not\s+the\s+right|going\s+to\s+have\s+to\s+(?:decline|pass))|i'?d\s+(?:rather|prefer)\s+not
    |against\s+(?:my|our)\s+(?:guidelines|rules|polic(?:y|ies)|principles)|outside\s+(?:of\s+)?what\s+i|beyond\s+what\s+i|nothing\s+i\s+can\s+say|(?:do\s+not|don'?t)\s+have\s+(?:an?\s+|any\s+)?(?:opinions?|views?)|n'ai\s+pas\s+d'(?:avis|opinion)|(?:habe|hab)\s+(?:ich\s+)?(?:\w+\s+)?keine\s+meinung|no\s+tengo\s+(?:una\s+)?opini(?:ón|ones)|not\s+something\s+i(?:'?m|\s+am|\s+can|\s+feel|\s+want)|(?:guidelines|rules|polic(?:y|ies)|instructions)\s+(?:do\s+not|don'?t|forbid|prevent|prohibit)|not\s+(?:be\s+)?appropriate\s+for\s+me|not\s+(?:be\s+)?possible\s+for\s+me|rather\s+not\s+(?:respond|answer|say|discuss|talk)
    |je\s+(?:ne\s+(?:peux|puis|suis|saurais|veux|souhaite)|dois\s+(?:refuser|décliner)|refuse|décline|préfère\s+(?:ne|laisser|m'abstenir))|dépasse\s+ce\s+que|m'est\s+impossible|(?:es\s+ist\s+mir|ist\s+(?:es\s+)?mir|mir\s+ist)\s+(?:es\s+)?(?:leider\s+)?(?:nicht\s+möglich|unmöglich)|me\s+(?:es|resulta)\s+imposible|(?:am|is)\s+impossible\s+for\s+me|(?:règles|consignes)\s+ne\s+me|ce\s+n'est\s+pas\s+à\s+moi|contraire\s+à\s+mes
    |(?:dabei|damit|hier(?:bei|zu)?|dazu|darauf|darüber)\s+(?:kann|darf|möchte|will)\s+ich\s+(?:\w+\s+)?(?:nicht|nichts|keine)|(?:ich\s+(?:kann|darf|möchte|will|werde)\b[^.!?]{0,80}\b(?:nicht|nichts|kein\w*))|(?:kann|darf|möchte|muss)\s+ich\s+(?:\w+\s+){0,4}(?:nicht|nichts|ablehnen|kein\w*)|(?:regeln|richtlinien|vorgaben)\s+(?:erlauben|verbieten|lassen)|(?:muss|möchte)\s+(?:ich\s+)?(?:das\s+)?ablehnen|bin\s+ich\s+nicht\s+(?:in\s+der\s+lage|befugt|berechtigt)|ich\s+bin\s+nicht\s+(?:in\s+der\s+lage|befugt|berechtigt)|überlasse\s+ich
    |no\s+(?:puedo|podemos|podré|me\s+está|me\s+es\s+posible|estoy\s+en\s+condiciones|quiero|debo|deseo|me\s+permiten|me\s+siento)|tengo\s+que\s+(?:negarme|rechazar)|debo\s+(?:negarme|rechazar)|me\s+niego|prefiero\s+(?:no|dejar)|(?:reglas|normas|pautas)\s+no\s+me|va\s+en\s+contra\s+de\s+mis|fuera\s+de\s+lo\s+que
    )""",
    re.X | re.I,
)
# Turns of phrase that look like refusals and are none.
NO_REFUSALS = re.compile(r"\b(?:can\s?not|can'?t|couldn'?t)\s+(?:\w+\s+){0,12}?enough\b|\bcan\s?not\s+go\s+wrong|\bcan'?t\s+go\s+wrong|\b(?:can'?t|can\s?not)\s+(?:wait|help\s+but|be\s+wrong|complain|deny|agree\s+more)|\bcouldn'?t\s+agree\s+more|\bne\s+(?:peux|puis)\s+(?:que|qu')|\bno\s+puedo\s+(?:esperar|sino|dejar)|\bkann\s+ich\s+nur\b", re.I)
# Courtesies around refusals.
COURTESIES = re.compile(
    r"\b(?:thank\s+you|thanks|is\s+there\s+(?:anything|something)\s+else|anything\s+else\s+(?:i\s+can|you)|please\s+consult|consult\s+a|apologi[sz]e|apologies|sorry\s+(?:about|for)\s+(?:that|the\s+inconvenience|any)|let\s+me\s+know|feel\s+free|hope\s+you\s+understand|i\s+hope|as\s+an?\s+(?:ai|language\s+model|assistant)|merci|désolé\w*|veuillez|puis-je|y\s+a-t-il\s+autre|n'hésitez|danke|vielen\s+dank|entschuldig\w*|verständnis|bitte\s+wenden|kann\s+ich\s+sonst|gibt\s+es\s+sonst|haben\s+sie\s+(?:noch|weitere)|gracias|comprensión|lo\s+siento|perdón|disculp\w*|consulte|hay\s+algo\s+más|puedo\s+ayudar\w*\s+en\s+otra)\b",
    re.I,
)

_EDGES = re.compile(r"\A[\W_]+|[\W_]+\Z")
_INVISIBLE = re.compile("[​-‏⁠﻿­‪-‮]")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|\n+")
_CLOSED = re.compile(r"[.!?…。！？][\"'”’»)\]*_~`]*$")
_LIST_LINE = re.compile(r"^\s*(?:[-*•·–+]|\d{1,3}[.)]|[A-Za-z][.)]|\[[ xX]?\])\s+\S")
_VALUE = re.compile(r"(?:[=:<>≈]\s*[-+]?[\d.,]+\s*(?:%|[a-zA-Z°€$£]{1,4})?|^[-+]?[\d.,:/\s]+(?:%|[a-zA-Z°€$£]{1,6})?)$")
_CODE_LINE = re.compile(r"[;{}]$|^\s*(?:def |class |return |import |from \w+ import|for .*:$|if .*:$|while .*:$|#include|</?\w+[^>]*>$|\$ |>>> )|\w\([^()]*\)$|^\s{4,}\S")
_EDITED = re.compile(r"\((?:last\s+)?edited[^()]*\)\s*$", re.I)
_LANGUAGES_OF = {w: [k for k, v in BY_LANGUAGE.items() if w in v] for w in ANY}
EMPTY, TRUNCATED, REFUSAL, COPY, OTHER = "empty", "truncated", "refusal", "copy", "other_language"


def clean(text: str | None) -> str:
    return _INVISIBLE.sub("", text).strip() if text else ""


def is_empty(t: str) -> bool:
    if not t:
        return True
    if not any(c.isalnum() for c in t):
        return all(ord(c) < 0x2190 for c in t)  # pictures say something, points and strokes don't
    return _EDGES.sub("", t).lower() in STAND_INS


def language(ws: list[str]) -> str | None:
    """The language of lower-cased words, where there is enough to tell."""
    if len(ws) < 4:
        return None
    n = dict.fromkeys(BY_LANGUAGE, 0)
    for w, c in Counter(ws).items():
        for k in _LANGUAGES_OF.get(w, ()):
            n[k] += c
    (a, x), (_, y) = sorted(n.items(), key=lambda kv: -kv[1])[:2]
    return a if x >= 2 and x >= 1.4 * y and x >= 0.12 * len(ws) else None


def is_copy(prompt: list[str], answer: list[str]) -> bool:
    """The answer says what the prompt says, nearly all of it, and nearly nothing else."""
    if len(prompt) < 4 or len(answer) < 4:
        return bool(prompt) and prompt == answer and len(prompt) >= 2
    said = set(answer)
    if len(said.intersection(prompt)) >= 0.6 * len(said):
        p, a = set(zip(prompt, prompt[1:])), set(zip(answer, answer[1:]))
        both = len(p & a)
        return both >= 0.7 * len(p) and both >= 0.8 * len(a) - 3 and both >= 0.65 * len(a)
    return False


_HINTS = frozenset("cannot cant wont couldnt impossible imposible unmöglich möglich can t unable decline refuse pass not rather prefer nothing against outside beyond don ne n refuser refuse décliner préfère dépasse nicht nichts ablehnen kein keine überlasse no negarme niego rechazar prefiero contra fuera".split())


def is_refusal(t: str, ws: list[str]) -> bool:
    """It declines, and apart from courtesies says nothing else."""
    if _HINTS.isdisjoint(ws):
        return False
    t = t.replace("’", "'")
    found, rest = False, 0
    for s in _SENTENCE.split(t):
        if not s.strip():
            continue
        if REFUSALS.search(s) and not NO_REFUSALS.search(s):
            words = len(WORD.findall(s))
            found = True
            rest += max(0, words - 28)
        elif not COURTESIES.search(s):
            rest += len(WORD.findall(s))
        if rest > 8:
            return False
    return found and rest <= 8


def ending(t: str) -> str:
    """``closed``, also where it is very short; ``open``, stopped within a sentence; or ``unsure``."""
    t = _EDITED.sub("", t).rstrip()
    if not t or _CLOSED.search(t):
        return "closed"
    last = t.rsplit("\n", 1)[-1]
    if "```" in t and (t.endswith("```") or t.count("```") % 2):
        return "closed" if t.endswith("```") else "unsure"
    words = len(t.split())
    if words <= 3:
        return "closed"
    if _LIST_LINE.match(last) or _CODE_LINE.search(last) and "\n" in t:
        return "unsure"
    if _VALUE.search(last) or _VALUE.search(" ".join(last.split()[-3:])):
        return "unsure"
    if "\n" in t and len(last.split()) <= 6 and not re.search(r"[.!?…]\s", last):
        return "unsure"  # a closing heading, name or entry
    if t.split()[-1].lower() in ANY and not last.isupper():
        return "open"  # no sentence ends with an article, a preposition or a conjunction
    if not re.search(r"[.!?…]", t) and words < 40:
        return "unsure" if t[-1] not in ",;:-–—(/" else "open"  # a writer without full stops
    return "open"


def asked_for(prompt: str, lang: str) -> bool:
    return lang in LANGUAGE_NAMES and re.search(rf"(?i)\b(?:{LANGUAGE_NAMES[lang]})\b", prompt) is not None


def sort_key(t: str) -> str:
    """What is compared between neighbours: lower case, single blanks, no signs at the end."""
    return re.sub(r"[^\w]+$", "", " ".join(t.lower().split()))


class Prompt:
    """A prompt with its words and, once asked for, its language."""

    def __init__(self, text: str | None):
        self.text = clean(text)
        self.words = WORD.findall(self.text.lower())
        self._language: tuple | None = None

    def language(self) -> str | None:
        if self._language is None:
            self._language = (language(self.words),)
        return self._language[0]


def classify(prompt: Prompt, answer: str | None) -> tuple[str | None, str]:
    """Defect, and how the answer ends."""
    a = clean(answer)
    if is_empty(a):
        return EMPTY, "closed"
    aw = WORD.findall(a.lower())
    if is_copy(prompt.words, aw):
        return COPY, "closed"
    if is_refusal(a, aw):
        return REFUSAL, "closed"
    la = language(aw)
    if la is not None:
        lp = prompt.language()
        if lp is not None and lp != la and not asked_for(prompt.text, la):
            return OTHER, "closed"
    return None, ending(a)


_ROWS = "pair_id long, side string, defect string, ending string, n long, h long"


def _classify(batches):
    for b in batches:
        prompts = [Prompt(p) for p in b.column(1).to_pylist()]
        for k, side in ((2, "chosen"), (3, "rejected")):
            answers = b.column(k).to_pylist()
            got = [classify(p, a) for p, a in zip(prompts, answers)]
            yield pa.record_batch(
                [
                    b.column(0), pa.array([side] * b.num_rows), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got]),
                    pa.array([len(clean(a)) for a in answers], pa.int64()), pa.array([_hash(a) for a in answers], pa.int64()),
                ],
                names=["pair_id", "side", "defect", "ending", "n", "h"],
            )


def _hash(a: str | None) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest((a or "").encode("utf-8", "surrogatepass"))).view(np.int64))


def _keys(batches, most: int = 500_000):
    """(key, h) of all answers, each once a task: copies are pre-aggregated before the shuffle."""
    seen: set = set()
    for b in batches:
        keys, hashes = [], []
        for k in (0, 1):
            for a in b.column(k).to_pylist():
                h = _hash(a)
                if a and h not in seen:
                    seen.add(h)
                    if t := sort_key(clean(a)):
                        keys.append(t)
                        hashes.append(h)
        if len(seen) > most:
            seen.clear()
        if keys:
            yield pa.record_batch([pa.array(keys), pa.array(hashes, pa.int64())], names=["key", "h"])


_SEEN = "h long, part int, first string, last string"


def _neighbours(batches):
    """Of a partition sorted backwards the hashes of texts that the text before continues.

    Rows of the first text, which only the partition before can continue, leave with the number of the partition; one row
    more holds its first and last text. Nothing is kept but these two.
    """
    from pyspark import TaskContext

    part, first, before, key, hit = TaskContext.get().partitionId(), None, None, None, False
    for b in batches:
        sure, edge = [], []
        for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if t != key:
                before, key = key, t
                first = t if first is None else first
                hit = before is not None and before.startswith(t)
            if hit:
                sure.append(h)
            elif key == first:
                edge.append(h)
        if sure or edge:
            yield pa.record_batch([pa.array([*sure, *edge], pa.int64()), pa.array([None] * len(sure) + [part] * len(edge), pa.int32()), pa.nulls(len(sure) + len(edge), pa.string()), pa.nulls(len(sure) + len(edge), pa.string())], names=["h", "part", "first", "last"])
    if first is not None:
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.array([part], pa.int32()), pa.array([first]), pa.array([key])], names=["h", "part", "first", "last"])


def shortened(pairs: DataFrame, partitions: int | None = None) -> DataFrame:
    """(h): hashes of answers which another answer continues."""
    spark = pairs.sparkSession
    n = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = materialize(pairs.select("chosen", "rejected").mapInArrow(_keys, "key string, h long"), "keys")
    seen = materialize(keys.repartitionByRange(n, F.desc("key")).sortWithinPartitions(F.desc("key")).mapInArrow(_neighbours, _SEEN), "neighbours")
    ends = seen.where("h is null")
    parts = sorted(r[0] for r in ends.select("part").collect())  # a number a partition
    follows = spark.createDataFrame(list(zip(parts, parts[1:])), "part int, next int")
    last = ends.join(follows, "part").select(F.col("next").alias("part"), F.col("last").alias("before"))
    crossing = ends.join(last, "part").where(F.col("before").startswith(F.col("first")) & (F.col("before") != F.col("first"))).select("part")
    return seen.where("h is not null and part is null").select("h").union(seen.where("h is not null and part is not null").join(crossing, "part", "left_semi").select("h")).distinct()


def length_limits(rows: DataFrame, spike: float = 8.0, least: int = 20) -> DataFrame:
    """(n): lengths at which at least ``least`` answers stop without a sure end, and ``spike`` times as many as at those around."""
    lengths = rows.where("ending <> 'closed'").groupBy("n").agg(F.count("*").alias("c"))
    near = lengths.select(F.explode(F.array(*(F.col("n") + k for k in (-3, -2, -1, 1, 2, 3)))).alias("n"), "c").groupBy("n").agg((F.sum("c") / 6).alias("around"))
    return lengths.join(near, "n", "left").where((F.col("c") >= least) & (F.col("c") >= spike * F.greatest(F.coalesce("around", F.lit(0.0)), F.lit(1.0)))).select("n")


def broken_pairs(pairs: DataFrame, spike: float = 8.0, least_spike: int = 20) -> DataFrame:
    """(pair_id, side, defect, evidence): the defective answers of ``pairs`` (pair_id, prompt, chosen, rejected), one defect each.

    A null or blank answer is ``empty``, whatever the prompt. With a null or blank prompt an answer is neither copy nor in
    another language. Repeated rows are reported as often as they come; other columns are ignored; an empty
    input gives an empty result. A truncated answer is one that ends without a sure end and has a longer neighbour
    (evidence ``neighbour``) or the length of a limit (``limit``), see ``length_limits``, or whose ending stops within a sentence (``ending``).
    Other defects have no evidence beside their rule.
    """
    src = pairs.select(F.col("pair_id").cast("long").alias("pair_id"), *(F.col(c).cast("string").alias(c) for c in ("prompt", "chosen", "rejected")))
    rows = materialize(src.mapInArrow(_classify, _ROWS), "answers")
    other = rows.where("defect is not null").select("pair_id", "side", "defect", F.lit(None).cast("string").alias("evidence"))
    loose = rows.where("defect is null and ending <> 'closed'")
    x = loose.join(shortened(src).withColumn("longer", F.lit(True)), "h", "left").join(length_limits(rows, spike, least_spike).withColumn("limit", F.lit(True)), "n", "left")
    evidence = F.when(F.col("longer"), "neighbour").when(F.col("limit"), "limit").when(F.col("ending") == "open", "ending")
    return other.union(x.withColumn("evidence", evidence).where("evidence is not null").select("pair_id", "side", F.lit(TRUNCATED), "evidence"))
