"""Text and formatting columns."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_text(t: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) < 1) | (F.size(b) < 1), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


@F.pandas_udf(T.DoubleType())
def text_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; 0 if either text is empty."""
    return pd.Series([SequenceMatcher(a=x, b=y).ratio() if x and y else 0.0 for x, y in zip(a, b)], dtype="float64")


def format_time(seconds: Column) -> Column:
    """m:ss.t, rounded down."""
    safe = F.greatest(seconds, F.lit(0.0))
    whole = F.floor(safe)
    return F.format_string("%d:%02d.%d", F.floor(whole / 60), F.pmod(whole, F.lit(60)), F.floor((safe - whole) * 10))


def resolve_url(url: Column, api_base: str, artifact_base: str) -> Column:
    """Absolute URL of an artifact; null for none."""
    return (
        F.when(url.isNull() | (url == ""), F.lit(None).cast("string"))
        .when(url.startswith("data:") | url.startswith("http://") | url.startswith("https://"), url)
        .when(url.startswith("/artifacts/"), F.concat(F.lit(artifact_base), F.substring(url, len("/artifacts") + 1, 1 << 30)))
        .when(url.startswith("artifacts/"), F.concat(F.lit(api_base + "/"), url))
        .otherwise(url)
    )


def artifact_path(url: Column, root: str, base: str = "/artifacts") -> Column:
    """Path below ``root`` of an artifact URL; null for URLs elsewhere."""
    return F.when(url.startswith(base + "/"), F.concat(F.lit(root), F.substring(url, len(base) + 1, 1 << 30)))


def artifact_url(path: Column, root: str, base: str = "/artifacts") -> Column:
    """URL of a path below ``root``; null for paths elsewhere."""
    return F.when(path.startswith(root + "/"), F.concat(F.lit(base), F.substring(path, len(root) + 1, 1 << 30)))
