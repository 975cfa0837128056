"""Token id arrays: padding, masks, labels, packing. Tokenizers are passed in as functions from text to ids."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running_counts

IGNORE = -100


def pad(ids: Column, length: Column, value: int = 0) -> Column:
    """Cut or padded at the right to a length."""
    return F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(value), F.greatest(length - F.size(ids), F.lit(0))))


def batch_length(sizes: Column, batch: Column, max_length: int, multiple: int = 8) -> Column:
    """Padded length of a batch: the longest row up to the maximum, rounded up to a multiple (and so perhaps above the maximum)."""
    longest = F.least(F.max(sizes).over(Window.partitionBy(batch)), F.lit(max_length))
    return (F.ceil(longest / multiple) * multiple).cast("int")


def attention_mask(ids: Column, pad_id: int = 0) -> Column:
    return F.transform(ids, lambda x: F.when(x != pad_id, 1).otherwise(0))


def labels(ids: Column, pad_id: int = 0) -> Column:
    return F.transform(ids, lambda x: F.when(x == pad_id, IGNORE).otherwise(x))


def response_start(ids: Column, marker: list[int]) -> Column:
    """0-based place after the first occurrence of the marker; null if there is none."""
    m, k = F.array(*(F.lit(x) for x in marker)), len(marker)
    at = F.when(F.size(ids) >= k, F.filter(F.sequence(F.lit(1), F.size(ids) - (k - 1)), lambda i: F.slice(ids, i, k) == m))
    return F.get(at, F.lit(0)) + (k - 1)


def completion_labels(ids: Column, marker: list[int], pad_id: int = 0) -> Column:
    """Labels of what follows the marker; without a marker all is trained on."""
    start = F.coalesce(response_start(ids, marker), F.lit(0))
    return F.transform(labels(ids, pad_id), lambda x, i: F.when(i < start, IGNORE).otherwise(x))


def prompt_labels(ids: Column, prompt_length: Column, pad_id: int | None = None) -> Column:
    """Labels without the prompt."""
    base = ids if pad_id is None else labels(ids, pad_id)
    return F.transform(base, lambda x, i: F.when(i < prompt_length, IGNORE).otherwise(x))


def span_labels(ids: Column, spans: Column) -> Column:
    """Labels inside the spans (start, end) only."""
    return F.transform(ids, lambda x, i: F.when(F.exists(spans, lambda s: (i >= s["start"]) & (i < s["end"])), x).otherwise(IGNORE))


def position_ids(ids: Column, boundaries: Column) -> Column:
    """Positions that begin anew at every boundary (0-based starts of documents)."""
    return F.transform(ids, lambda x, i: i - F.coalesce(F.array_max(F.filter(boundaries, lambda b: b <= i)), F.lit(0)))


def masked_mean_logp(logp: Column, label: Column) -> Column:
    """Mean log-probability of the labels that count: the label one ahead of each place, ignored ones left out."""
    ahead = F.slice(label, 2, F.greatest(F.size(label) - 1, F.lit(0)))
    x = F.zip_with(F.slice(logp, 1, F.greatest(F.size(label) - 1, F.lit(0))), ahead, lambda p, y: F.when(y != IGNORE, p))
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    n = F.size(F.filter(x, lambda v: v.isNotNull()))
    return total / F.greatest(n, F.lit(1))


def token_accuracy(predicted: Column, label: Column) -> tuple[Column, Column]:
    """(right, counted) tokens, ignored labels left out."""
    x = F.zip_with(predicted, label, lambda p, y: F.when(y != IGNORE, (p == y).cast("int")))
    return F.aggregate(x, F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0))), F.size(F.filter(x, lambda v: v.isNotNull()))


def tokenize(df: DataFrame, tokenizer: Callable[[str], list[int]], column: str = "text", out: str = "input_ids", max_length: int | None = None) -> DataFrame:
    """Add token ids of a text column by an injected tokenizer, Arrow batch by batch."""
    fields = df.schema

    def run(batches):
        for b in batches:
            ids = [tokenizer(t) if t else [] for t in b.column(b.schema.get_field_index(column)).to_pylist()]
            yield b.append_column(out, pa.array(ids if max_length is None else [x[:max_length] for x in ids], pa.list_(pa.int32())))

    from pyspark.sql import types as t

    return df.mapInArrow(run, t.StructType([*fields.fields, t.StructField(out, t.ArrayType(t.IntegerType()))]))


def pack(df: DataFrame, max_length: int, separator: int, rows: int = 100_000, id_column: str = "id", ids_column: str = "ids") -> DataFrame:
    """(run, pack, input_ids, starts): sequences packed in the order of ids, a separator between two.

    A sequence that doesn't fit with one more token closes the pack; one longer than a pack is cut, yet counts in full.
    ``rows`` sequences in order are a run; a run begins a new pack, so at most one pack a run is closed early. Runs are packed
    row by row, only the open pack is held. Null sequences are empty ones.
    """
    source = df.select(F.struct(F.col(id_column), F.xxhash64(ids_column)).alias("__at"), F.col(ids_column).cast("array<int>").alias("ids"), F.lit(1).alias("one"))
    x = running_counts(source, [], "__at", "one").select(F.floor((F.col("upto") - 1) / rows).cast("long").alias("run"), "__at", "ids")

    def fill(batches):
        run, number, now, starts, used = None, 0, [], [], 0
        for b in batches:
            out = []
            for r, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = ids or []
                if r != run or (now and used + len(ids) + 1 > max_length):
                    if run is not None:
                        out.append((run, number, now, starts))
                    number = number + 1 if r == run else 0
                    run, now, starts, used = r, [], [], 0
                if now:
                    now.append(separator)
                    used += 1
                starts.append(len(now))
                now.extend(ids[: max_length - used])
                used += len(ids)
            if out:
                yield _packs(out)
        if run is not None:
            yield _packs([(run, number, now, starts)])

    return x.repartition("run").sortWithinPartitions("run", "__at").select("run", "ids").mapInArrow(fill, "run long, pack long, input_ids array<int>, starts array<int>")


def _packs(rows: list[tuple]) -> pa.RecordBatch:
    r, k, ids, starts = zip(*rows)
    return pa.record_batch([pa.array(r, pa.int64()), pa.array(k, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int32()))], names=["run", "pack", "input_ids", "starts"])


# Markers that begin a turn.
USER_MARKERS = ["<|im_start|>user", "[INST]", "USER:", "<|user|>", "Human:"]
ASSISTANT_MARKERS = ["<|im_start|>assistant", "[/INST]", "ASSISTANT:", "<|assistant|>", "Assistant:"]


def turn_spans(text: Column, user: list[str] | None = None, assistant: list[str] | None = None) -> Column:
    """Turns of a formatted conversation as (start, end, role) in characters: a turn goes from its marker to the next; what comes before the first is the system's.

    A marker within the one before it (by one character on) begins nothing new of the same role; empty turns are left out.
    """
    marks = [(m, r) for r, ms in (("user", user or USER_MARKERS), ("assistant", assistant or ASSISTANT_MARKERS)) for m in ms]
    quoted = "|".join("\\Q" + m + "\\E" for m, _ in marks)
    hits = F.regexp_extract_all(text, F.lit(f"({quoted})"), F.lit(1))
    gaps = F.split(text, quoted, -1)
    role = lambda m: _role_of(m, marks)
    lengths = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"), role(m).alias("role")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,role:string>>").alias("out"))
    step = lambda s, x: F.struct((s["at"] + x["g"] + x["m"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["g"]).alias("at"), x["role"].alias("role")))).alias("out"))
    begins = F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit("system").alias("role"))), F.aggregate(lengths, start, step, lambda s: s["out"]))
    ends = F.concat(F.slice(F.transform(begins, lambda b: b["at"]), 2, F.size(begins)), F.array(F.length(text)))
    return F.filter(F.zip_with(begins, ends, lambda b, e: F.struct(b["at"].alias("start"), e.alias("end"), b["role"].alias("role"))), lambda t: t["end"] > t["start"])


def _role_of(m: Column, marks: list[tuple[str, str]]) -> Column:
    out = F
    for text, role in marks:
        out = out.when(m == text, role)
    return out


def token_spans(df: DataFrame, tokenizer: Callable[[str], list[int]], text: str = "text", spans: str = "spans", out: str = "token_spans") -> DataFrame:
    """Add the spans in tokens: a place in characters is the number of tokens of the text before it."""
    from pyspark.sql import types as t

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("role", pa.string())]))

    def run(batches):
        for b in batches:
            got = []
            for x, ss in zip(b.column(b.schema.get_field_index(text)).to_pylist(), b.column(b.schema.get_field_index(spans)).to_pylist()):
                at = {p: len(tokenizer(x[:p])) for p in {p for s in ss or [] for p in (s["start"], s["end"])}}
                got.append([{"start": at[s["start"]], "end": at[s["end"]], "role": s["role"]} for s in ss or []])
            yield b.append_column(out, pa.array(got, kind))

    item = t.StructType([t.StructField("start", t.IntegerType()), t.StructField("end", t.IntegerType()), t.StructField("role", t.StringType())])
    return df.mapInArrow(run, t.StructType([*df.schema.fields, t.StructField(out, t.ArrayType(item))]))


def assistant_labels(label: Column, spans: Column) -> Column:
    """Labels with all turns but the assistant's masked; what lies in no turn stays."""
    others = F.filter(spans, lambda s: s["role"] != "assistant")
    return F.transform(label, lambda x, i: F.when(F.exists(others, lambda s: (i >= s["start"]) & (i < s["end"])), IGNORE).otherwise(x))


def batches(df: DataFrame, size: int, order: str = "id", shuffle: int | None = None, drop_last: bool = False) -> DataFrame:
    """Add ``batch``, the number of the mini-batch: in the order of a column, or shuffled by a hash of it with a seed."""
    key = F.struct(F.md5(F.concat_ws(":", F.col(order).cast("string"), F.lit(str(shuffle)))), F.col(order)) if shuffle is not None else F.struct(order)
    x = running_counts(df.withColumn("__at", key).withColumn("__one", F.lit(1)), [], "__at", "__one")
    x = x.withColumn("batch", F.floor((F.col("upto") - 1) / size).cast("long"))
    if drop_last:
        x = x.where((F.col("batch") + 1) * size <= F.col("n"))
    return x.select(*df.columns, "batch")


def stack(df: DataFrame, columns: list[str], order: str, batch: str = "batch") -> DataFrame:
    """One row a mini-batch with the columns as lists in order; no larger than the batch."""
    rows = F.array_sort(F.collect_list(F.struct(order, *(c for c in columns if c != order))))
    return df.groupBy(batch).agg(rows.alias("__rows")).select(batch, *(F.col(f"__rows.{c}").alias(c) for c in columns))


def collate(df: DataFrame, max_length: int, pad_id: int = 0, batch: str = "batch", ids: str = "input_ids", kind: str = "base", marker: list[int] | None = None, spans: str | None = None, train_on_input: bool = False) -> DataFrame:
    """Add ``input_ids`` padded by batch, ``attention_mask`` and ``labels``.

    ``base`` labels all tokens; ``completion`` those after the marker; ``chat`` those of assistant turns (``spans`` in tokens),
    all with ``train_on_input``. Another kind raises ``ValueError``.
    """
    if kind not in ("base", "completion", "chat"):
        raise ValueError(f"unknown kind {kind!r}")
    x = df.withColumn("__n", batch_length(F.least(F.size(ids), F.lit(max_length)), F.col(batch), max_length)).withColumn("input_ids", pad(F.slice(ids, 1, max_length), F.col("__n"), pad_id)).drop("__n")
    out = labels(F.col("input_ids"), pad_id)
    if kind == "completion":
        out = completion_labels(F.col("input_ids"), marker or [], pad_id)
    elif kind == "chat" and not train_on_input:
        out = assistant_labels(out, F.col(spans or "token_spans"))
    return x.withColumn("attention_mask", attention_mask(F.col("input_ids"), pad_id)).withColumn("labels", out)


def prepare(df: DataFrame, tokenizer: Callable[[str], list[int]], template: str = "chatml", max_length: int = 2048) -> DataFrame:
    """Rows of any shape with ``text`` (formatted only where there is none), cut token ids and their mask."""
    from .chat import sft_text

    x = df if "text" in df.columns else sft_text(df, template)
    return tokenize(x, tokenizer, "text", "input_ids", max_length).withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))
