"""Labelling providers behind one interface, and bounded, retried calls to them."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame

Provider = Callable[[str, str], str]

RESPONSES = "custom_id string, response string, error string, n_attempts int"


class OfflineProvider:
    """A deterministic stand-in for a remote model: label by hash; some first attempts fail."""

    def __init__(self, labels: list[str], tag: str = "c", fail_every: int = 0) -> None:
        self.labels, self.tag, self.fail_every = labels, tag, fail_every
        self.tries: dict[str, int] = {}

    def __call__(self, custom_id: str, prompt: str) -> str:
        digest = int(hashlib.md5(prompt.encode()).hexdigest()[:8], 16)
        self.tries[custom_id] = self.tries.get(custom_id, 0) + 1
        if self.fail_every and digest % self.fail_every == 0 and self.tries[custom_id] == 1:
            raise ConnectionError("try again")
        return f"<{self.tag}>{self.labels[digest % len(self.labels)]}</{self.tag}>"


def call_with_retries(provider: Provider, custom_id: str, prompt: str, retries: int, wait: float) -> tuple[str | None, str | None, int]:
    """(response, error, attempts); waits double after each failure."""
    problem = ""
    for attempt in range(1, retries + 2):
        try:
            return provider(custom_id, prompt), None, attempt
        except Exception as e:  # whatever a provider raises becomes the row's error
            problem = f"{type(e).__name__}: {e}"
            if attempt <= retries:
                time.sleep(wait * 2 ** (attempt - 1))
    return None, problem, retries + 1


def label(requests: DataFrame, provider: Provider, parallel: int = 4, threads: int = 5, retries: int = 2, wait: float = 0.0) -> DataFrame:
    """Responses of (custom_id, prompt): ``parallel`` partitions of ``threads`` calls are in flight at most.

    Raw responses are kept, so parsers can run again without new calls. Delivery
    is at least once: a retried task asks again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                found = list(pool.map(lambda r: call_with_retries(provider, r[0], r[1], retries, wait), zip(pdf["custom_id"], pdf["prompt"], strict=True)))
                yield pd.DataFrame({"custom_id": pdf["custom_id"], "response": [f[0] for f in found], "error": [f[1] for f in found], "n_attempts": [f[2] for f in found]})

    return requests.select("custom_id", "prompt").repartition(parallel).mapInPandas(run, RESPONSES)
