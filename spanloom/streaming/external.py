"""External stages: generators, judges and models behind a batch interface.

A stage is a function from a list of request strings to a list of replies. It runs
inside ``mapInPandas``, so executors call in parallel, and a result cache keeps
requests that were answered from being sent again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Client = Callable[[Sequence[str]], Sequence[str]]


def offline_client(requests: Sequence[str]) -> list[str]:
    """The default client: answers without any network, always the same way."""
    return [json.dumps({"verdict": "keep", "length": len(r)}) for r in requests]


def run_stage(requests: DataFrame, client: Client = offline_client, batch: int = 8, attempts: int = 3, check: Callable[[str], str | None] | None = None, corrections: int = 2) -> DataFrame:
    """Key, reply, error and calls for every request (key, payload).

    A call that raises is tried again; then the requests of its batch are asked one by
    one, so that one bad request fails alone, and as a row, not as a job. A reply that ``check`` finds fault with is asked for again with that fault, at most
    ``corrections`` times.
    """

    def ask(payloads: list[str]) -> tuple[list[str | None], str | None, int]:
        error = None
        for n in range(1, attempts + 1):
            try:
                replies = list(client(payloads))
                if len(replies) == len(payloads):
                    return replies, None, n
                error = "reply count"
            except Exception as e:  # noqa: BLE001  a client may raise anything; it becomes a row
                error = f"{type(e).__name__}: {e}"[:400]
        return [None] * len(payloads), error, attempts

    def work(frames):
        for frame in frames:
            out = []
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                replies, error, calls = ask(part["payload"].tolist())
                errors, counts = [error] * len(part), [calls] * len(part)
                if error and len(part) > 1:
                    alone = [ask([p]) for p in part["payload"]]
                    replies, errors, counts = [r[0] for r, _, _ in alone], [e for _, e, _ in alone], [calls + c for _, _, c in alone]
                for key, payload, reply, error, calls in zip(part["key"], part["payload"], replies, errors, counts):
                    fault = check(reply) if check and reply is not None else None
                    for _ in range(corrections):
                        if not fault:
                            break
                        again, error, more = ask([json.dumps({"request": payload, "reply": reply, "fault": fault})])
                        reply, calls = again[0], calls + more
                        fault = check(reply) if reply is not None else None
                    out.append((key, reply, fault or error, calls))
            yield pd.DataFrame(out, columns=["key", "reply", "error", "calls"])

    return requests.select("key", "payload").mapInPandas(work, "key string, reply string, error string, calls int")


def unanswered(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests whose key the cache does not answer."""
    return requests.join(cache.filter("error IS NULL").select("key"), "key", "left_anti")


def with_cache(requests: DataFrame, cache: DataFrame, client: Client = offline_client, **args) -> DataFrame:
    """Cached replies of these requests and new ones for the rest."""
    fresh = run_stage(unanswered(requests, cache), client, **args)
    known = cache.filter("error IS NULL").join(requests.select("key"), "key", "left_semi")
    return known.select(*fresh.columns).unionByName(fresh)


def score_tokens(windows: DataFrame, scorer: Callable[[list[list[str]]], list[tuple[list[str], list[float]]]]) -> DataFrame:
    """Id, w, labels, probs of token windows by a pluggable tagger."""

    def work(frames):
        for frame in frames:
            scored = scorer([list(t) for t in frame["tokens"]])
            yield pd.DataFrame({"id": frame["id"], "w": frame["w"], "labels": [s[0] for s in scored], "probs": [s[1] for s in scored]})

    rows = windows.select("id", "w", F.transform("content", lambda t: t["tok"]).alias("tokens"))
    return rows.mapInPandas(work, "id string, w int, labels array<string>, probs array<double>")


def pattern_scorer(labels: dict[str, str]) -> Callable[[list[list[str]]], list[tuple[list[str], list[float]]]]:
    """An offline tagger: words with a label of their own, anything else outside."""

    def score(batches: list[list[str]]) -> list[tuple[list[str], list[float]]]:
        return [([labels.get(t.lower(), "O") for t in words], [0.9 if t.lower() in labels else 0.99 for t in words]) for words in batches]

    return score
