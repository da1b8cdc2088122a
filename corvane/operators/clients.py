"""Leaves that call models: pluggable encoders and chat clients, batched in Arrow, with retries inside the leaf."""

from __future__ import annotations

import atexit
import hashlib
import json
import subprocess
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import dot


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class ChatClient(Protocol):
    def complete(self, prompt: str) -> str: ...


class HashEncoder:
    """A deterministic stand-in: hashed character trigrams, L2-normalised."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for i, t in enumerate(texts):
            for j in range(max(1, len(t) - 2)):
                h = int.from_bytes(hashlib.blake2b(t[j : j + 3].encode(), digest_size=8).digest(), "big")
                out[i, h % self.size] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class ReplayClient:
    """Answers from a table of prompts; an unknown prompt is an error."""

    def __init__(self, replies: dict[str, str]):
        self.replies = replies

    def complete(self, prompt: str) -> str:
        return self.replies[prompt]


class CallFailed(Exception):
    """A call that failed, with its HTTP status if it has one."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def may_retry(error: Exception) -> bool:
    """The rule of ``parsing.retryable`` on the status of an exception; a value error, such as a malformed reply, may pass."""
    status = getattr(error, "status", None)
    return isinstance(error, ValueError) or status is None or status in (408, 429) or status >= 500


def encode(df: DataFrame, text: str, into: str, encoder: Callable[[], Encoder], instruction: Column | None = None) -> DataFrame:
    """``df`` with vectors. Each distinct text, behind its instruction if there is one, is encoded once, the texts of a
    partition in order of length, and joined back."""
    full = F.col(text) if instruction is None else F.concat(F.lit("Instruct: "), instruction, F.lit("\nQuery: "), F.col(text))
    keyed = df.withColumn("_t", full)
    once = keyed.select("_t").filter("_t is not null").distinct().withColumn("_n", F.length("_t")).sortWithinPartitions("_n").drop("_n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for b in batches:
            yield pd.DataFrame({"_t": b["_t"], into: list(model.encode(b["_t"].tolist()))})

    vectors = once.mapInPandas(run, f"_t string, {into} array<float>")
    return keyed.join(vectors, "_t", "left").drop("_t")


def call(model: ChatClient, prompt: str, attempts: int, wait: float, factor: float, longest: float, accept: Callable[[str], bool] | None) -> tuple[str | None, int, str | None, bool]:
    """One call with retries: reply, attempts, error, and whether the failure is fatal."""
    error, pause = None, wait
    for tried in range(1, attempts + 1):
        try:
            reply = model.complete(prompt)
            if accept is not None and not accept(reply):
                raise ValueError("unusable reply")
            return reply, tried, None, False
        except Exception as e:  # noqa: BLE001 - the client's failures become a column
            error = f"{type(e).__name__}: {e}"
            if not may_retry(e):
                return None, tried, error, True
            if tried < attempts:
                time.sleep(min(pause, longest))
                pause *= factor
    return None, attempts, error, False


def complete(
    df: DataFrame, key: list[str], prompt: str, client: Callable[[], ChatClient], attempts: int = 3, wait: float = 1.0, factor: float = 2.0, longest: float = 30.0, workers: int = 1, accept: Callable[[str], bool] | None = None, abort: bool = False
) -> DataFrame:
    """``key``, ``reply``, ``attempts`` and ``error``. Transient failures, and replies that ``accept`` refuses, are tried
    again with growing, capped waits; fatal ones are not, and with ``abort`` they end the job. Each task has one client, and
    ``workers`` calls at a time in order of its rows. A failed call has a null reply, never a score of zero; so has a null
    prompt, which is not sent. Write the result before it is used twice: a call costs, so Spark's own retries must not be
    the mechanism."""
    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()
        one = lambda p: (None, 0, "no prompt", False) if p is None else call(model, p, attempts, wait, factor, longest, accept)
        with ThreadPoolExecutor(max(1, workers)) as pool:
            for b in batches:
                prompts = [None if pd.isna(p) else p for p in b[prompt]]
                rows = list(pool.map(one, prompts))
                if abort and (fatal := [e for _, _, e, f in rows if f]):
                    raise CallFailed(f"the endpoint refuses calls: {fatal[0]}")
                yield b[key].reset_index(drop=True).join(pd.DataFrame([r[:3] for r in rows], columns=["reply", "attempts", "error"]))

    return df.select(*key, prompt).mapInPandas(run, f"{fields}, reply string, attempts int, error string")


class ChildProcessClient:
    """Sends prompts to a program of its own, so that what it imports stays out of this process: a JSON line with the prompt
    on its standard input, a JSON line with ``reply`` or ``error`` on its standard output."""

    def __init__(self, command: list[str]):
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, encoding="utf-8")
        self.lock = threading.Lock()
        atexit.register(self.close)

    def complete(self, prompt: str) -> str:
        with self.lock:  # one question at a time
            self.process.stdin.write(json.dumps({"prompt": prompt}, ensure_ascii=False) + "\n")
            self.process.stdin.flush()
            line = self.process.stdout.readline()
        if not line:
            raise CallFailed(f"the child process ended with {self.process.poll()}")
        found = json.loads(line)
        if "reply" not in found:
            raise CallFailed(str(found.get("error")))
        return found["reply"]

    def close(self) -> None:
        if self.process.poll() is None:
            self.process.stdin.close()
            self.process.wait(10)


def two_judges(rows: DataFrame, primary: Column, secondary: Column, answer: Column) -> DataFrame:
    """``status`` and ``failure_stage``: without an answer a row failed in generation, without the primary judge's scores
    in judge_primary; the secondary judge is optional."""
    stage = F.when(answer.isNull(), "generation").when(primary.isNull(), "judge_primary")
    return rows.withColumn("failure_stage", stage).withColumn("status", F.when(stage.isNull(), "ok").otherwise("failed")).withColumn("has_secondary", secondary.isNotNull())


def encoder_parity(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """The least cosine between two encoders' vectors of the same rows."""
    j = a.select(key, F.col(vector).alias("_a")).join(b.select(key, F.col(vector).alias("_b")), key)
    return j.agg(F.min(dot(F.col("_a"), F.col("_b")) / F.sqrt(dot(F.col("_a"), F.col("_a")) * dot(F.col("_b"), F.col("_b")))).alias("least_cosine"))
