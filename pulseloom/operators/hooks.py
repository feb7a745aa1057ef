"""Extension points: bring an embedder, a pair scorer, a reply provider or a page parser.

An embedder is a vectorised UDF text -> array<double> (``operators.embedding.embed``), a pair scorer a vectorised UDF
(query, text) -> double (``operators.ranking.rerank``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, types as T

from pulseloom.functions.pages import parsed

REPLY = "session_id {key}, cluster_id bigint, reply string, prompt_tokens bigint, output_tokens bigint"


def provide_replies(prompts: DataFrame, provider: Callable[[list[str]], list[tuple[str | None, int, int]]]) -> DataFrame:
    """Ask ``provider`` for a reply to every prompt, a batch at a time; per prompt it gives (reply, prompt tokens, output
    tokens). A batch it fails on is asked again prompt by prompt: only those it fails on then have no reply, which
    downstream stages treat as failed calls."""
    key = prompts.schema["session_id"].dataType.simpleString()

    def asked(texts: list[str]) -> list[tuple[str | None, int, int]]:
        try:
            answers = list(provider(texts))
            if len(answers) == len(texts):
                return answers
        except Exception:  # noqa: BLE001 - one bad prompt must not fail the job
            pass
        return [(None, 0, 0)] if len(texts) == 1 else [answer for text in texts for answer in asked([text])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = asked(batch["prompt"].tolist()) if len(batch) else []
            replies = pd.DataFrame(answers, columns=["reply", "prompt_tokens", "output_tokens"], index=batch.index)
            yield pd.concat([batch[["session_id", "cluster_id"]], replies], axis=1)

    return prompts.select("session_id", "cluster_id", "prompt").mapInPandas(run, REPLY.format(key=key))


def parse_pages(pages: DataFrame, parser: Callable[[str], Iterator[dict]], schema: str, keys: list[str], html: str = "html") -> DataFrame:
    """Rows that ``parser`` finds in each page. ``schema`` describes keys and rows; if it has a column ``error``, a page that
    the parser fails on gives a row with its keys and the error, else none."""
    out = T.StructType.fromDDL(schema)

    def rows_of(key, text):
        try:
            found = list(parser(text or ""))
        except Exception as failure:  # noqa: BLE001
            found = [{"error": f"{type(failure).__name__}: {failure}"}] if "error" in out.names else []
        for row in found:
            row = {**dict(zip(keys, key)), **row}
            yield tuple(row.get(name) for name in out.names)

    return parsed(pages, keys, html, out, rows_of)
