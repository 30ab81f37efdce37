"""The weekly validation job: review sample, drift check, metrics, and rotation of both keys, in this order."""

from __future__ import annotations

import secrets
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame

from veilspan.operators import drift


def rotate_key(current: str, retired_folder: str, kind: str = "key") -> dict:
    """Moves the current key to a file of its own and writes a new one of 32 bytes. Old pseudonyms stay valid under the old
    key; tokens stay resolvable by the store, which also keeps the tokens of known values."""
    at, retired = datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ"), None
    Path(retired_folder).mkdir(parents=True, exist_ok=True)
    if Path(current).exists():
        retired = Path(retired_folder, f"{kind}_retired_{at}.txt")
        retired.write_text(Path(current).read_text().strip())
    key = secrets.token_hex(32)
    Path(current).write_text(key)
    return {"rotated_at": at, "retired_key_path": str(retired) if retired else None, "new_key_length_bytes": len(key) // 2}


def run(
    processed: DataFrame, baseline: DataFrame, current: DataFrame, keys_folder: str, push: Callable[[DataFrame], None] | None = None,
    rate: float = 0.05, seed: int = 0, threshold: float = 0.05,
) -> dict:
    """Gives the sample, the drift summary and metric rows as DataFrames, and what the rotations did. ``push`` sends the
    metric rows on; without it nothing is sent."""
    sample = drift.review_sample(processed, rate, seed)
    compared = drift.compare_all(drift.field_stats(baseline), drift.field_stats(current), threshold)
    metrics = drift.metric_rows(compared)
    if push:
        push(metrics)
    return {
        "sample": sample, "summary": drift.summary(baseline, current, threshold), "metrics": metrics,
        "pseudonym_key": rotate_key(f"{keys_folder}/pseudonym.key", f"{keys_folder}/retired", "pseudonym"),
        "token_key": rotate_key(f"{keys_folder}/token.key", f"{keys_folder}/retired", "token"),
    }
