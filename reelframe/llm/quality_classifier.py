"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic regression over surface features gives every document its own evidence. Grouped
aggregation sums that evidence by host and by path within host; the spread of the group rates beyond
sampling noise gives each level's prior strength (method of moments). A path's rate is shrunk toward
its host's, a host's toward the global rate, a document's own evidence left out of both, so sparse
sites fall back to the global prior. The document's log-odds plus its site's log-odds relative to the
global ones decide.

Documents without URLs use ``source`` as host and ``lang`` as path. The regression is fitted on at
most FIT_ROWS labelled rows (the ones least by hash); everything else covers all rows.

Defined results: null text is scored as empty text; texts of any length are read whole; null hosts and paths are groups of their own;
labels with a null id or quality are ignored, contradicting labels count as bad; with no label of
either class every document is kept; repeated rows get equal results; an empty table gives an empty
result; extra columns are ignored or carried, whatever their names.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_small, nest, shared

FIT_ROWS = 20_000
#: A document is rejected where the probability of good quality is below this.
CUT = 0.5
FEATURES = ("log_words", "word_length", "distinct", "symbols", "digits", "upper", "dup_lines", "runs", "bars", "marked_words")
_SYMBOLS = b"#*$%&|<>"
_DIGITS = b"0123456789"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_features(text: bytes) -> list[float]:
    """Surface features of a whole text in UTF-8."""
    words = text.split()
    n = max(len(words), 1)
    chars = max(sum(map(len, words)), 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    drop = lambda some: len(text) - len(text.translate(None, some))
    ends = sum(w[-1:] in (b"#", b"*", b"$", b"%", b"&", b"|") for w in words)
    return [
        np.log1p(len(words)),
        min(chars / n, 40.0) / 10,
        len(set(words)) / n,
        drop(_SYMBOLS) / chars,
        drop(_DIGITS) / chars,
        drop(_UPPER) / chars,
        1 - len(set(lines)) / max(len(lines), 1),
        sum(map(bytes.__eq__, words, words[1:])) / n,
        words.count(b"|") / n,
        ends / n,
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _features(text: pa.Array) -> pa.Array:
    return pa.array([text_features(t.as_py() or b"") for t in text.cast(pa.large_binary())], pa.list_(pa.float64()))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Logistic regression by damped Newton steps; weights of (bias, features) on the raw scale."""
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / std])
    penalty = ridge * len(z) * np.eye(z.shape[1])
    penalty[0, 0] = 1e-9
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    raw = w[1:] / std
    return np.concatenate([[w[0] - raw @ mean], raw])


def train(found: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> np.ndarray | None:
    """Weights from at most ``rows`` labelled documents; None without both classes."""
    said = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("quality"))
    held = found.select("id", "features").join(said, "id").orderBy(F.xxhash64("id"), "id", "features").limit(rows).select("features", "quality")
    got = held.collect()
    y = np.array([float(r.quality >= 1) for r in got])
    if not len(y) or y.min() == y.max():
        return None
    return fit(np.array([r.features for r in got]), y)


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, n: str, s: str, prior: Column) -> float:
    """Prior observations k of a level: rates p of groups of n documents vary as prior*(1-prior)*(1/(k+1) + 1/n).

    ``prior`` is the rate of the level above. Without spread beyond noise k is large, and groups agree with it.
    """
    noise = prior * (1 - prior)
    row = groups.agg(
        F.sum(F.col(n) * (F.col(s) / F.col(n) - prior) ** 2).alias("between"),
        F.sum(noise).alias("sampling"),
        F.sum(F.col(n) * noise).alias("scale"),
    ).first()
    if not row or not row.scale:
        return 1e6
    extra = max((row.between - row.sampling) / row.scale, 1e-6)  # = 1 / (k + 1)
    return max(1 / extra - 1, 1.0)


def classify(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", host: Column | None = None, path: Column | None = None, cut: float = CUT, carry: bool = False) -> DataFrame:
    """doc_id, p_text, p_path (the site's rate without the document), p_good and ``kept`` for every document.

    With ``carry`` the row is kept as struct ``row``; its features are then computed a second time
    rather than shuffled or stored with the text.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    base = [F.col(f"`{id_col}`").cast("long").alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"), _features(F.col(f"`{text_col}`").cast("string")).alias("features")]
    found = shared(docs.select(*base), "classifier-features")
    weights = train(found, labels)
    if weights is None:
        weights = np.concatenate([[30.0], np.zeros(len(FEATURES))])
    z = F.lit(float(weights[0]))
    for i, w in enumerate(weights[1:]):
        z = z + F.element_at("features", i + 1) * F.lit(float(w))
    p_text = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))

    # Sites: partial sums in every task first, so a host with a third of all rows costs no more than another.
    paths = shared(found.select("host", "path", p_text.alias("p")).groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "classifier-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = min(max((total.s / total.n) if total.n else 0.5, 1e-6), 1 - 1e-6)
    k_host = _strength(hosts, "host_n", "host_s", F.lit(rate))
    shrunk = (F.col("host_s") + k_host * rate) / (F.col("host_n") + k_host)
    sites = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k_path = _strength(sites.withColumn("m", shrunk), "n", "s", F.col("m"))
    sites = shared(sites.select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), "n", "s", "host_n", "host_s"), "classifier-sites")

    rows = docs.select(*base, nest(docs).alias("row")) if carry else found
    scored = join_small(rows.withColumn("p_text", p_text).drop("features"), sites, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")))
    # leave the document's own evidence out of its site's
    p_host = (F.col("host_s") - F.col("p_text") + k_host * rate) / (F.col("host_n") - 1 + k_host)
    p_path = (F.col("s") - F.col("p_text") + k_path * p_host) / (F.col("n") - 1 + k_path)
    odds = _logit(F.col("p_text")) + _logit(F.col("p_path")) - float(np.log(rate / (1 - rate)))
    out = scored.withColumn("p_path", p_path).withColumn("p_good", 1 / (1 + F.exp(-odds)))
    return out.select(F.col("id").alias("doc_id"), "p_text", "p_path", "p_good", (F.col("p_good") >= cut).alias("kept"), *(["row"] if carry else []))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their own columns."""
    return classify(docs, labels, carry=True, **options).where("kept").select("row.*")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels)
