"""Chat templates as column functions over arrays of messages (role, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant", "function")

# Texts that open an instruction with and without an input.
PREAMBLE_INPUT = "Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request."
PREAMBLE = "Below is an instruction that describes a task. Write a response that appropriately completes the request."
# Template by part of a model's name, the first that fits.
MODEL_TEMPLATES = [("llama-2", "llama2"), ("llama2", "llama2"), ("mistral", "mistral"), ("mixtral", "mistral"), ("zephyr", "zephyr"), ("vicuna", "vicuna"), ("alpaca", "alpaca"), ("chatml", "chatml"), ("openai", "chatml"), ("gpt", "chatml")]
# Marker before a response.
RESPONSE_MARKERS = {"chatml": "<|im_start|>assistant\n", "alpaca": "### Response:\n", "llama2": "[/INST]", "vicuna": "ASSISTANT:", "zephyr": "<|assistant|>\n", "mistral": "[/INST]"}


def normalize(messages: Column) -> tuple[Column, Column]:
    """Messages without system ones, and the last system message (null if none). A missing role is a user's; an unknown one raises."""
    role = lambda m: F.lower(F.coalesce(m["role"], F.lit("user")))
    checked = F.transform(messages, lambda m: F.struct(F.when(role(m).isin(*ROLES), role(m)).otherwise(F.raise_error(F.concat(F.lit("unknown role "), role(m))).cast("string")).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    systems = F.filter(checked, lambda m: m["role"] == "system")
    return F.filter(checked, lambda m: m["role"] != "system"), F.when(F.size(systems) > 0, F.element_at(systems, -1)["content"])


def _filled(x: Column) -> Column:
    return F.length(F.coalesce(x, F.lit(""))) > 0


def _joined(messages: Column, user, assistant) -> Column:
    return F.array_join(F.transform(messages, lambda m, i: F.when(m["role"] == "user", user(m["content"], i)).when(m["role"] == "assistant", assistant(m["content"])).otherwise("")), "")


def _wrapped(before: str, after: str):
    return lambda c, *_: F.concat(F.lit(before), c, F.lit(after))


def conversation(template: str, messages: Column, system: Column, generation_prompt: bool = True) -> Column:
    """A conversation in a template; see the templates for what each does with system messages and open answers."""
    none = F.lit("")
    if template == "chatml":
        head = F.when(_filled(system), F.concat(F.lit("<|im_start|>system\n"), system, F.lit("<|im_end|>\n"))).otherwise(none)
        return F.concat(head, _joined(messages, _wrapped("<|im_start|>user\n", "<|im_end|>\n"), _wrapped("<|im_start|>assistant\n", "<|im_end|>\n")), F.lit("<|im_start|>assistant\n" if generation_prompt else ""))
    if template == "vicuna":
        head = F.when(_filled(system), F.concat(system, F.lit("\n\n"))).otherwise(none)
        return F.concat(head, _joined(messages, _wrapped("USER: ", "\n"), _wrapped("ASSISTANT: ", "</s>\n")), F.lit("ASSISTANT:" if generation_prompt else ""))
    if template == "zephyr":
        head = F.when(_filled(system), F.concat(F.lit("<|system|>\n"), system, F.lit("</s>\n"))).otherwise(none)
        return F.concat(head, _joined(messages, _wrapped("<|user|>\n", "</s>\n"), _wrapped("<|assistant|>\n", "</s>\n")), F.lit("<|assistant|>\n" if generation_prompt else ""))
    if template == "mistral":
        return F.concat(F.lit("<s>"), _joined(messages, _wrapped("[INST] ", " [/INST]"), _wrapped("", "</s>")))
    if template == "llama2":
        def user(c, i):
            plain = F.concat(F.lit("[INST] "), c, F.lit(" [/INST]"))
            first = F.when(_filled(system), F.concat(F.lit("[INST] <<SYS>>\n"), system, F.lit("\n<</SYS>>\n\n"), c, F.lit(" [/INST]"))).otherwise(plain)
            return F.when(i == 0, first).otherwise(F.concat(F.lit("<s>"), plain))

        body = F.concat(F.lit("<s>"), _joined(messages, user, _wrapped(" ", " </s>")))
        if not generation_prompt:
            return body
        # the last part decides: after an open instruction nothing is added
        last = F.element_at(F.filter(messages, lambda m: m["role"].isin("user", "assistant")), -1)
        open_end = F.when(F.size(F.filter(messages, lambda m: m["role"].isin("user", "assistant"))) > 0, (last["role"] == "user") | (last["role"].isNull())).otherwise(False)
        return F.when(open_end, body).otherwise(F.concat(body, F.lit(" ")))
    if template == "alpaca":
        of = lambda role: F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: m["content"]), "\n")
        answer = F.lit(None).cast("string") if generation_prompt else of("assistant")
        return instruction("alpaca", of("user"), F.lit(""), answer)
    raise ValueError(f"unknown template {template!r}")


def instruction(template: str, text: Column, extra: Column, response: Column) -> Column:
    """An instruction with an optional input and response in a template; an empty one counts as none."""
    with_input = F.when(_filled(extra), F.concat(text, F.lit("\n\n"), extra)).otherwise(text)
    has = _filled(response)
    none = F.lit("")
    if template == "chatml":
        return F.concat(F.lit("<|im_start|>user\n"), with_input, F.lit("<|im_end|>\n<|im_start|>assistant\n"), F.when(has, F.concat(response, F.lit("<|im_end|>\n"))).otherwise(none))
    if template == "alpaca":
        head = F.when(_filled(extra), F.concat(F.lit(PREAMBLE_INPUT + "\n\n### Instruction:\n"), text, F.lit("\n\n### Input:\n"), extra)).otherwise(F.concat(F.lit(PREAMBLE + "\n\n### Instruction:\n"), text))
        return F.concat(head, F.lit("\n\n### Response:\n"), F.when(has, response).otherwise(none))
    if template == "llama2":
        return F.concat(F.lit("<s>[INST] "), with_input, F.lit(" [/INST]"), F.when(has, F.concat(F.lit(" "), response, F.lit(" </s>"))).otherwise(none))
    if template == "mistral":
        return F.concat(F.lit("<s>[INST] "), with_input, F.lit(" [/INST]"), F.when(has, F.concat(F.lit(" "), response, F.lit("</s>"))).otherwise(none))
    if template == "vicuna":
        return F.concat(F.lit("USER: "), with_input, F.lit("\nASSISTANT:"), F.when(has, F.concat(F.lit(" "), response, F.lit("</s>"))).otherwise(none))
    if template == "zephyr":
        return F.concat(F.lit("<|user|>\n"), with_input, F.lit("</s>\n<|assistant|>\n"), F.when(has, F.concat(response, F.lit("</s>"))).otherwise(none))
    raise ValueError(f"unknown template {template!r}")


def template_for_model(name: str, default: str = "chatml") -> str:
    return next((t for part, t in MODEL_TEMPLATES if part in name.lower()), default)


def template_of(model: Column, default: str = "chatml") -> Column:
    """Template of each model name in a column."""
    out = F
    for part, t in MODEL_TEMPLATES:
        out = out.when(F.contains(F.lower(model), F.lit(part)), t)
    return out.otherwise(default)


def sft_text(df: DataFrame, template: str = "chatml") -> DataFrame:
    """Add ``text`` by the shape of the data: instruction, messages, prompt with response, text, or what there is of known columns."""
    c = set(df.columns)
    col = lambda x: F.coalesce(F.col(x), F.lit("")) if x in c else F.lit("")
    if "instruction" in c:
        out = instruction(template, col("instruction"), col("input"), F.coalesce(*(F.nullif(col(x), F.lit("")) for x in ("output", "response") if x in c), F.lit("")))
    elif "messages" in c:
        messages, system = normalize(F.col("messages"))
        out = conversation(template, messages, system, generation_prompt=False)
    elif "prompt" in c and "response" in c:
        out = instruction(template, col("prompt"), F.lit(""), col("response"))
    elif "text" in c:
        out = F.col("text")
    else:
        known = [x for x in ("question", "query", "answer", "response", "completion") if x in c]
        out = F.concat_ws("\n\n", *(F.col(x) for x in known))
    return df.withColumn("text", out)


def plain_conversation(messages: Column) -> Column:
    """``role: content``, one message a line."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


# Tokens that begin and end a text and separate messages, by template.
SPECIAL_TOKENS = {"chatml": ("", "<|im_end|>", ""), "alpaca": ("", "", ""), "llama2": ("<s>", "</s>", ""), "vicuna": ("", "</s>", ""), "zephyr": ("", "</s>", ""), "mistral": ("<s>", "</s>", "")}


def special_tokens(template: str) -> dict[str, str]:
    """The special tokens of a template; an unknown one raises ``ValueError``."""
    if template not in SPECIAL_TOKENS:
        raise ValueError(f"unknown template {template!r}")
    return dict(zip(("bos_token", "eos_token", "sep_token"), SPECIAL_TOKENS[template]))


def template_for_tokenizer(tokenizer, default: str = "chatml") -> str:
    """The template of a tokenizer by its ``name_or_path``; one without a name has the default."""
    return template_for_model(getattr(tokenizer, "name_or_path", "") or "", default)


def special_token_columns(template: Column) -> Column:
    """A struct of the special tokens of each template in a column; null for unknown ones."""
    out = F
    for name, (bos, eos, sep) in SPECIAL_TOKENS.items():
        out = out.when(template == name, F.struct(F.lit(bos).alias("bos_token"), F.lit(eos).alias("eos_token"), F.lit(sep).alias("sep_token")))
    return out


def script_text(df: DataFrame, template: str = "chatml") -> DataFrame:
    """Add ``text`` from instruction with output, prompt with response, text, or else the first column."""
    c = set(df.columns)
    col = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("")) if x in c else F.lit("")
    if {"instruction", "output"} <= c:
        out = instruction(template, col("instruction"), col("input"), col("output"))
    elif {"prompt", "response"} <= c:
        out = instruction(template, col("prompt"), F.lit(""), col("response"))
    else:
        out = col("text" if "text" in c else df.columns[0])
    return df.withColumn("text", out)


def format_dataset(df: DataFrame, template: str = "chatml", out: str = "formatted_text") -> DataFrame:
    """Add the formatted text under another name, the columns as they are."""
    x = sft_text(df.withColumn("__text", F.col("text")) if "text" in df.columns else df, template).withColumn(out, F.col("text"))
    return x.withColumn("text", F.col("__text")).drop("__text") if "text" in df.columns else x.drop("text")


def user_conversation(prompt: Column, response: Column | None = None, system: Column | None = None) -> Column:
    """Messages of one exchange: an optional system message, the user's, an optional answer; empty ones are left out."""
    m = lambda role, x: F.when(_filled(x), F.struct(F.lit(role).alias("role"), x.alias("content")))
    return F.filter(F.array(*(m(r, x) for r, x in (("system", system), ("user", prompt), ("assistant", response)) if x is not None)), lambda x: x.isNotNull())
