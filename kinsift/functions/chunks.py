"""Chunks of texts for vectors: by tokens, sentences, recursive separators or lines of code."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = ("none", "code", "token", "sentence", "recursive", "fast")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")


def chunk_text(text: str | None, method: str = "none", size: int = 200, overlap: int = 0, most: int | None = None) -> list[str]:
    """Non-blank chunks of about `size` words (or characters for fast), at least [""]. The cuts are this library's
    own; only the contract (options, truncation to `most`, no blanks) follows a rule."""
    if method not in METHODS:
        raise ValueError(f"Unsupported chunking method: {method}")
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("the size is at least 1, the overlap at least 0 and less than the size")
    value = text or ""
    if method == "none":
        parts = [value]
    elif method == "token":
        words = value.split()
        parts = [" ".join(words[i : i + size]) for i in range(0, max(1, len(words) - overlap), size - overlap)]
    elif method == "fast":
        parts = [value[i : i + size] for i in range(0, len(value), size - overlap)]
    else:
        units = _SENTENCE.split(value) if method == "sentence" else re.split(r"\n\s*\n", value) if method == "recursive" else value.split("\n")
        parts, held, count = [], [], 0
        for unit in units:
            n = len(unit.split())
            if held and count + n > size:
                parts.append("\n".join(held))
                held, count = [], 0
            held.append(unit)
            count += n
        parts.append("\n".join(held))
    kept = [p for p in parts if p.strip()][:most]
    return kept or [""]


def chunks(text: Column | str, method: str = "none", size: int = 200, overlap: int = 0, most: int | None = None) -> Column:
    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: chunk_text(t, method, size, overlap, most))

    chunk_text("", method, size, overlap, most)  # options are checked before any job
    return run(text)
