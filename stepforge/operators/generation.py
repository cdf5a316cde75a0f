"""Generation by an external model: requests, replies, validation, resuming and accounting.

The model is any Python callable (prompt) -> (text, usage); nothing here calls a network. Rows go to it in Arrow batches
inside mapInPandas, after an anti-join has removed what the log already holds. A reply that lacks the wanted text counts
as a failed call and is asked for again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepforge.functions import text as T

LOG = "id string, error_type string, status string, reply string, attempts int, prompt_tokens long, completion_tokens long, total_tokens long, error string"


def reply_fields(reply: Column, kind: Column) -> dict[str, Column]:
    """error (not_json, missing_key, missing_rejected, not_string or null) and rejected of a reply {type: {rejected: text}}."""
    value = T.json_variant(reply)
    top = F.concat(F.lit('$["'), kind, F.lit('"]'))
    inner = F.try_variant_get(value, top, "variant")
    found = F.try_variant_get(inner, "$.rejected", "variant")
    is_text = F.schema_of_variant(found) == "STRING"
    error = F.when(value.isNull(), "not_json").when(inner.isNull(), "missing_key").when(found.isNull(), "missing_rejected").when(~is_text, "not_string")
    return {"error": error, "rejected": F.when(error.isNull(), F.try_variant_get(found, "$", "string"))}


def reply_error(reply: str | None, kind: str) -> str | None:
    """The error of reply_fields() for one reply, for use next to the model's call."""
    text = reply or ""
    for part in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            value = json.loads(part)
            break
        except ValueError:
            continue
    else:
        return "not_json"
    if not isinstance(value, dict) or kind not in value:
        return "missing_key"
    if not isinstance(value[kind], dict) or "rejected" not in value[kind]:
        return "missing_rejected"
    return None if isinstance(value[kind]["rejected"], str) else "not_string"


def pending(items: DataFrame, log: DataFrame) -> DataFrame:
    """Items (id, error_type) that the log does not hold as done."""
    return items.join(log.filter("status = 'ok'").select("id", "error_type").distinct(), ["id", "error_type"], "left_anti")


def generate(
    requests: DataFrame,
    model: Callable[[str], tuple[str, dict]],
    tries: int = 3,
    pause: float = 1.5,
    sleep: Callable[[float], None] = time.sleep,
    check: Callable[[str | None, str], str | None] | None = reply_error,
) -> DataFrame:
    """Log rows for requests (id, error_type, prompt): up to ``tries`` calls each, usage summed over all of them.

    A call that raises, or whose reply ``check`` (reply, error_type) finds fault with, is made again after a growing
    pause. Status is ok or, after the last try, failed; reply and error are those of the last try.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                used = {"prompt_tokens": 0, "completion_tokens": 0, "total_tokens": 0}
                reply, error, n = None, None, 0
                for n in range(1, tries + 1):
                    reply = None
                    try:
                        reply, usage = model(r.prompt)
                        for k in used:
                            used[k] += int(usage.get(k, 0) or 0)
                        error = check(reply, r.error_type) if check else None
                    except Exception as problem:  # noqa: BLE001  a failed call is tried again
                        error = str(problem) or type(problem).__name__
                    if error is None:
                        break
                    if n < tries:
                        sleep(pause * n)
                rows.append((str(r.id), r.error_type, "failed" if error else "ok", reply, n, *used.values(), error))
            yield pd.DataFrame(rows, columns=[x.strip().split()[0] for x in LOG.split(",")])

    return requests.select(F.col("id").cast("string").alias("id"), "error_type", "prompt").mapInPandas(run, LOG)


def candidates(problems: DataFrame, model: Callable[[str, int], list[str]], k: int, prompt: str = "prompt", key: str = "id") -> DataFrame:
    """k rows (key, j, txt) a problem from a callable (prompt, k) -> texts."""

    def run(frames):
        for frame in frames:
            rows = [(getattr(r, key), j, t) for r in frame.itertuples(index=False) for j, t in enumerate(model(getattr(r, prompt), k))]
            yield pd.DataFrame(rows, columns=[key, "j", "txt"])

    kind = problems.schema[key].dataType.simpleString()
    return problems.select(key, prompt).mapInPandas(run, f"{key} {kind}, j long, txt string")


def token_usage(log: DataFrame) -> DataFrame:
    return log.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")])
