"""Summaries and tags by a language model behind an injectable client.

A client is a factory: called once a task it gives a function from a prompt to
a reply.  No client comes with the library; tests use a deterministic one.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Client = Callable[[], Callable[[str], str]]
LEAST_PROMPT_BYTES, LEAST_REPLY_BYTES, MOST_PROMPT_CHARS = 50, 25, 62_000


def prompt(model: str, instruction: Column, body: Column) -> Column:
    """The prompt in the form that the model's family expects."""
    name = model.lower()
    if "llama" in name:
        return F.concat(F.lit("<|start_header_id|>system<|end_header_id|>"), instruction, F.lit("<|eot_id|><|start_header_id|>user<|end_header_id|>"), body, F.lit("<|eot_id|><|start_header_id|>assistant<|end_header_id|>"))
    if "gemma" in name:
        return F.concat(F.lit("<start_of_turn>user\n"), instruction, F.lit("\n"), body, F.lit("<end_of_turn>\n<start_of_turn>model\n"))
    return F.concat(instruction, F.lit("\n"), body)


def capped(body: Column) -> Column:
    return F.substring(body, 1, MOST_PROMPT_CHARS)


def ask(df: DataFrame, prompt_column: str, client: Client, out: str) -> DataFrame:
    """Add the reply to each prompt; null for prompts that are null or too short, or where the client fails."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = client()
        for batch in batches:
            replies = []
            for p in batch.column(names.index(prompt_column)).to_pylist():
                try:
                    replies.append(answer(p) if p and len(p.encode()) >= LEAST_PROMPT_BYTES else None)
                except Exception:  # a failed call costs one reply, as in any such service
                    replies.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string())], names=[*names, out])

    return df.mapInArrow(run, ", ".join([f"`{n}` {t}" for n, t in df.dtypes] + [f"`{out}` string"]))


#: Least seconds between two calls to a provider.
SPACING = 6.0


def spaced(client: Client, seconds: float = SPACING, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Client:
    """A client whose calls in one task begin at least so many seconds apart."""

    def make() -> Callable[[str], str]:
        answer, last = client(), [-seconds]

        def call(p: str) -> str:
            wait = last[0] + seconds - clock()
            if wait > 0:
                sleep(wait)
            last[0] = clock()
            return answer(p)

        return call

    return make


def ask_spaced(df: DataFrame, prompt_column: str, client: Client, out: str, seconds: float = SPACING) -> DataFrame:
    """:func:`ask` for a provider that allows one call at a time: all prompts go through one task, so its pace holds for the whole cluster."""
    return ask(df.repartition(1), prompt_column, spaced(client, seconds), out)


def with_summaries(parts: Column, summaries: Column) -> Column:
    """Parts (id, text) with the summary at the same position; null where there are fewer summaries."""
    both = F.arrays_zip(parts.alias("part"), summaries.alias("summary"))
    known = F.filter(both, lambda x: x["part"].isNotNull())
    return F.transform(known, lambda x: F.struct(x["part"]["id"].alias("id"), x["part"]["text"].alias("text"), x["summary"].alias("summary")))


def tag(df: DataFrame, model: str, instruction: str, client: Client, key: str = "metadata") -> DataFrame:
    """generated_content[key] from the model unless it has 25 bytes already."""
    have = F.coalesce("generated_content", F.create_map().cast("map<string,string>"))
    need = F.coalesce(F.octet_length(F.try_element_at(have, F.lit(key))), F.lit(0)) < LEAST_REPLY_BYTES
    asked = ask(df.withColumn("__prompt", F.when(need, prompt(model, F.lit(instruction), capped(F.col("text"))))), "__prompt", client, "__reply")
    merged = F.map_concat(F.map_filter(have, lambda k, _: k != key), F.create_map(F.lit(key), F.col("__reply")))
    return asked.withColumn("generated_content", F.when(F.col("__reply").isNotNull(), merged).otherwise(F.col("generated_content"))).drop("__prompt", "__reply")


def payload(provider: str, model: str, text: Column, temperature: float = 0.0) -> Column:
    """The JSON request body of a provider."""
    message = F.array(F.struct(F.lit("user").alias("role"), text.alias("content")))
    if provider == "ollama":
        body = F.struct(F.lit(model).alias("model"), text.alias("prompt"), F.lit(False).alias("stream"), F.struct(F.lit(temperature).alias("temperature")).alias("options"))
    elif provider in ("gemini", "google_genai"):
        body = F.struct(F.array(F.struct(F.array(F.struct(text.alias("text"))).alias("parts"))).alias("contents"), F.struct(F.lit(temperature).alias("temperature")).alias("generationConfig"))
    else:
        body = F.struct(F.lit(model).alias("model"), message.alias("messages"), F.lit(temperature).alias("temperature"))
    return F.to_json(body)


#: Where a provider's answer has its text.
REPLY_PATHS = {"ollama": "$.response", "chatgpt": "$.choices[0].message.content", "gemini": "$.candidates[0].content.parts[0].text", "google_genai": "$.candidates[0].content.parts[0].text"}


def reply_text(provider: str, body: Column) -> Column:
    return F.get_json_object(body, REPLY_PATHS[provider])


def summarise(df: DataFrame, model: str, instruction: str, client: Client, key: str, context_tokens: int, words_per_token: float = 1.333) -> DataFrame:
    """Add ``summary``: of the whole text if its estimated tokens fit, else of the summaries of its parts.

    ``key`` names the documents; ``text_parts`` holds their parts.  All parts of
    all documents are summarised in one pass, then joined in order.
    """
    fits = F.size(F.split(F.trim("text"), r"\s+")) * words_per_token <= context_tokens
    marked = df.withColumn("__fits", F.coalesce(fits, F.lit(True)))
    ask_for = lambda body: prompt(model, F.lit(instruction), capped(body))
    parts = marked.where("not __fits").select(key, F.posexplode("text_parts").alias("at", "part")).select(key, "at", ask_for(F.col("part.text")).alias("__p"))
    replies = ask(parts, "__p", client, "__s").where("__s is not null")
    joined = replies.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "__s"))), lambda x: x["__s"]), "\n").alias("__joined"))
    whole = marked.join(joined, key, "left").withColumn("__prompt", ask_for(F.when(F.col("__fits"), F.col("text")).otherwise(F.col("__joined"))))
    return ask(whole, "__prompt", client, "summary").drop("__fits", "__joined", "__prompt")
