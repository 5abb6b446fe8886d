"""Language identification in two steps: the family first, then the languages within it.

Features are hashed byte trigrams of the letters, as square roots of their shares. Linear support vector machines
(squared hinge loss) tell each pair of families apart, and within a family each pair of its languages; votes and
then margins decide. The machines are trained in NumPy on a bounded sample of labelled texts
(``per_language`` texts of each language at most); prediction covers every whole text.

Texts that are null or have no letter are ``und`` with score 0, as is everything when there is no labelled text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import words as W

BUCKETS = 2048
PER_LANGUAGE = 800
#: Families of language codes; a language that isn't named is a family of its own. Fixed values.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")

#: Lower case for ASCII letters, the byte itself beyond ASCII, a space for all else.
_FOLD = np.full(256, 32, np.uint32)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def features(column: pa.Array) -> np.ndarray:
    """A row of length one per text: square roots of the shares of its trigram buckets; zeros without trigrams."""
    data, at = W.raw(column)
    n = len(column)
    out = np.zeros((n, BUCKETS), np.float32)
    if len(data) < 3:
        return out
    folded = _FOLD[data]
    grams = folded[:-2] | (folded[1:-1] << np.uint32(8)) | (folded[2:] << np.uint32(16))
    grams = (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    owner = np.repeat(np.arange(n), np.diff(at))
    inside = owner[:-2] == owner[2:]
    counts = np.bincount(owner[:-2][inside] * BUCKETS + grams[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
    total = counts.sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1), dtype=np.float32)


def blocks(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with bounded text and bounded rows."""
    for part in W.slices(batch, "text"):
        for k in range(0, part.num_rows, rows):
            yield part.slice(k, rows)


def _separate(x: np.ndarray, y: np.ndarray, cost: float = 20.0, rounds: int = 150) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, last one the bias; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    rate = 1 / (1 + 4 * cost)  # a bound on the curvature: rows have length sqrt(2)
    for k in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - rate * (ahead - 2 * cost * (x.T @ (share * gap * y)))
        ahead = new + (k / (k + 3)) * (new - w)
        w = new
    return w


@dataclass
class LanguageModel:
    """Languages by family, and a machine for each pair of families and of languages within one."""

    families: dict[str, list[str]]
    machines: dict[tuple[str, str], np.ndarray]

    def _choose(self, names: list[str], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the winner among the names, and how sure that is."""
        votes, margins = np.zeros((len(x), len(names))), np.full((len(x), len(names)), np.inf)
        for (i, a), (j, b) in combinations(enumerate(names), 2):
            w = self.machines[a, b]
            m = x @ w[:-1] + w[-1]
            votes[:, i] += m > 0
            votes[:, j] += m <= 0
            margins[:, i] = np.minimum(margins[:, i], m)
            margins[:, j] = np.minimum(margins[:, j], -m)
        best = np.argmax(votes + 0.5 / (1 + np.exp(-np.clip(margins, -30, 30))), axis=1)
        sure = 1 / (1 + np.exp(-3 * np.clip(margins[np.arange(len(x)), best], -10, 10)))
        return best, sure

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row of features."""
        names = sorted(self.families)
        if not names:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        family, sure = self._choose(names, x)
        out, score = np.empty(len(x), object), np.zeros(len(x))
        for k, name in enumerate(names):
            own = np.flatnonzero(family == k)
            if len(own):
                best, within = self._choose(self.families[name], x[own])
                out[own] = np.array(self.families[name], object)[best]
                score[own] = sure[own] * within
        return out.tolist(), score


def train(x: np.ndarray, langs: list[str]) -> LanguageModel:
    """Machines from features and their languages."""
    of = {lang: name for name, members in FAMILIES.items() for lang in members}
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(of.get(lang, f"~{lang}"), []).append(lang)
    labels = np.array(langs, object)
    members = {**{name: np.isin(labels, own) for name, own in families.items()}, **{lang: labels == lang for lang in set(langs)}}
    machines = {}
    for group in (sorted(families), *families.values()):
        for a, b in combinations(group, 2):
            rows = members[a] | members[b]
            machines[a, b] = _separate(x[rows], np.where(members[a][rows], 1, -1).astype(np.float32))
    return LanguageModel(families, machines)


def collect_features(texts: DataFrame, *names: str) -> tuple[np.ndarray, list[list]]:
    """Features of a bounded number of texts on the driver, with other columns."""
    kinds = dict(texts.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", x binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                x = pa.array([row.tobytes() for row in features(part.column("text")).astype(np.float16)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], x], [*names, "x"])

    rows = texts.select("text", *names).mapInArrow(run, schema).toArrow()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    return x, [rows.column(n).to_pylist() for n in names]


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """A model from (text, lang) rows with an id column ``doc_id``: at most about ``per_language`` texts of each language.

    Rows are chosen by a hash of their id, at a rate set by the language's count.
    """
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel({}, {})
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, per_language / n)])
    chosen = labelled.filter(draw < F.element_at(rate, F.col("lang"))).limit(2 * per_language * len(counts))
    x, (langs,) = collect_features(chosen, "lang")
    # the order in which tasks end must not matter
    order = np.lexsort((x[:, 0], x[:, 1], x @ np.arange(BUCKETS, dtype=np.float32), np.array(langs)))
    return train(x[order], [langs[i] for i in order])


def no_letter(column: pa.Array) -> np.ndarray:
    return np.array([t is None or not _LETTER.search(t) for t in column.to_pylist()], bool)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                langs, score = model.predict(features(part.column("text")))
                none = no_letter(part.column("text"))
                langs = [UNKNOWN if u else lang for u, lang in zip(none, langs, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(np.where(none, 0, score))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
