"""Language identification in two steps: the family, then the language in it.

A text becomes a unit vector of hashed byte n-grams.  Linear support vector
machines (squared hinge loss, one against the rest) choose the language family
first; within the family a machine for each pair of its closely related
languages, trained on these two alone, gives one of them its vote.  Most votes
win, of equal votes the largest sum of margins.

A text is of a known language if enough of its n-grams are usual in the
predicted one: those that make up ``USUAL`` of its training texts.  Enough is
half-way from what the training texts of other families have on average (or,
without any, random n-grams) to what all but ``UNUSUAL`` of its own have.

Training reads a bounded, labelled sample (``PER_LANGUAGE`` distinct texts of each
language, fewer beyond ``MOST_SAMPLED`` in all, at least one, drawn by a hash of
the text from the training fold); its vectors, a few
kilobytes each, go to the driver.  Everything else is one pass over the
documents without a shuffle.

Defined results
  * null text, or text without any letter, is ``und`` with score 0;
  * a language outside ``FAMILIES`` is a family of its own;
  * a language is learned if the sample has a document of it; without any
    labelled document every text is ``und``;
  * equal texts have equal predictions; lang, source and doc_id are no inputs
    of a prediction; rows that repeat a text and a language count once in the
    sample, whatever their doc_id;
  * extra columns are carried by :func:`with_language`; a column whose name
    starts with ``lid_`` is refused; an empty table stays empty.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketwise.llm.common import no_columns, returns_memory

UNDETERMINED = "und"
#: Labelled documents of each language that the classifiers are fitted on, at most.
PER_LANGUAGE = 500
#: Documents that the classifiers are fitted on; more languages have fewer each, at least one.
MOST_SAMPLED = 64 * PER_LANGUAGE
#: Share of a language's n-grams that are its usual ones; share of its training
#: texts that its least fit leaves aside.
USUAL, UNUSUAL = 0.8, 0.002
GRAMS = (2, 3, 4)
BINS = 4096
FOLDS, HELD_OUT_FOLD = 4, 2

FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa"),
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
#: ASCII other than letters counts as one kind of gap.
_FOLD = bytes(
    32 if b < 128 and not chr(b).isalpha() else (b + 32 if 65 <= b <= 90 else b) for b in range(256)
)


def family(lang: str) -> str:
    return _FAMILY_OF.get(lang, lang)


def held_out(key: Column) -> Column:
    """Whether a document is in the fold that nothing is learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def vector(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed n-gram counts of a whole text."""
    data = b" ".join((" " + text + " ").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split())
    codes = np.frombuffer(b" " + data + b" ", dtype=np.uint8).astype(np.uint32)
    bins = np.zeros(BINS, dtype=np.float32)
    gram = codes
    for n in range(2, max(GRAMS) + 1):
        if len(gram) < 2:
            break
        gram = (gram[:-1] << np.uint32(8)) | codes[n - 1 :]
        if n in GRAMS:
            at = ((gram + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(20)
            bins += np.bincount(at, minlength=BINS)[:BINS]
    np.sqrt(bins, out=bins)
    size = float(np.sqrt((bins * bins).sum()))
    return bins / size if size else bins


def fit_svm(x: np.ndarray, y: np.ndarray, classes: int, regular: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """One-against-the-rest linear machines: weights (classes, features) and
    offsets, by accelerated gradient descent on the squared hinge loss."""
    sign = np.where(y[:, None] == np.arange(classes)[None, :], 1.0, -1.0)
    share = np.stack([(sign > 0).mean(axis=0), (sign < 0).mean(axis=0)])
    weight = np.where(sign > 0, 0.5 / np.maximum(share[0], 1e-9), 0.5 / np.maximum(share[1], 1e-9)) / len(x)
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = ahead = np.zeros((classes, x1.shape[1]))
    step, t = 1.0 / (4.0 + regular), 1.0
    for _ in range(rounds):
        slack = np.maximum(0.0, 1.0 - sign * (x1 @ ahead.T))
        slope = -2.0 * (weight * sign * slack).T @ x1 + regular * ahead
        after = ahead - step * slope
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = after + (t - 1) / t_after * (after - w), after, t_after
    return w[:, :-1], w[:, -1]


def fit_pairs(x: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """A machine for each pair of classes, trained on their rows alone, with a
    positive margin for the first of them: weights (pairs, features), offsets."""
    machines = []
    for i, j in combinations(range(classes), 2):
        rows = np.flatnonzero((y == i) | (y == j))
        w, b = fit_svm(x[rows], (y[rows] == j).astype(np.int64), 2)
        machines.append((w[0], b[0]))
    return np.stack([w for w, _ in machines]), np.array([b for _, b in machines])


def vote(margins: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Of margins (rows, pairs): the class with most votes, then the largest sum
    of margins, then the first; and its mean share against each other class."""
    votes, total, shares = (np.zeros((len(margins), classes)) for _ in range(3))
    for k, (i, j) in enumerate(combinations(range(classes), 2)):
        votes[:, i] += margins[:, k] >= 0
        votes[:, j] += margins[:, k] < 0
        total[:, i] += margins[:, k]
        total[:, j] -= margins[:, k]
        shares[:, [i, j]] += _share(np.stack([margins[:, k], -margins[:, k]], axis=1))
    most = votes == votes.max(axis=1, keepdims=True)
    best = np.where(most, total, -np.inf).argmax(axis=1)
    return best, shares[np.arange(len(best)), best] / (classes - 1)


def _share(margins: np.ndarray) -> np.ndarray:
    e = np.exp(3.0 * (margins - margins.max(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def _fit(x: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """Share of the n-grams of vectors that are ``usual``."""
    return (x**2)[:, usual].sum(axis=1) / np.maximum((x**2).sum(axis=1), 1e-12)


@dataclass
class LanguageModel:
    families: list[str]
    top: tuple[np.ndarray, np.ndarray]
    langs: list[list[str]]
    within: list[tuple[np.ndarray, np.ndarray] | None]
    #: Of each language: its usual n-grams, and the least fit of a known text.
    usual: dict[str, tuple[np.ndarray, float]] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str]) -> "LanguageModel":
        families = sorted({family(v) for v in labels})
        of = np.array([families.index(family(v)) for v in labels])
        top = fit_svm(x, of, len(families)) if len(families) > 1 else None
        langs, within = [], []
        for i in range(len(families)):
            rows = np.flatnonzero(of == i)
            own = sorted({labels[r] for r in rows})
            langs.append(own)
            within.append(
                fit_pairs(x[rows], np.array([own.index(labels[r]) for r in rows]), len(own)) if len(own) > 1 else None
            )
        model, of = cls(families, top, langs, within), np.array(labels)
        for lang in sorted(set(labels)):
            own = x[of == lang]
            mean = (own**2).mean(axis=0)
            order = np.argsort(-mean, kind="stable")
            usual = np.zeros(len(mean), dtype=bool)
            usual[order[: int(np.searchsorted(np.cumsum(mean[order]), USUAL * mean.sum())) + 1]] = True
            fits = _fit(own, usual)
            foreign = np.array([family(v) != family(lang) for v in labels])
            other = _fit(x[foreign], usual).mean() if foreign.any() else usual.mean()
            model.usual[lang] = usual, float((np.quantile(fits, UNUSUAL, method="lower") + other) / 2)
        return model

    def knows(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        """Whether vectors are of the languages that they were taken for."""
        known, names = np.zeros(len(x), dtype=bool), np.array(names)
        for lang in set(names.tolist()):
            usual, least = self.usual[lang]
            rows = np.flatnonzero(names == lang)
            known[rows] = _fit(x[rows], usual) >= least
        return known

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages of vectors, and the chosen shares of family and language multiplied."""
        n = len(x)
        shares = _share(x @ self.top[0].T + self.top[1]) if self.top else np.ones((n, 1))
        chosen = shares.argmax(axis=1)
        score, names = shares[np.arange(n), chosen], [""] * n
        for i, own in enumerate(self.langs):
            rows = np.flatnonzero(chosen == i)
            if not len(rows):
                continue
            best, inner = np.zeros(len(rows), dtype=np.int64), np.ones(len(rows))
            if self.within[i]:
                best, inner = vote(x[rows] @ self.within[i][0].T + self.within[i][1], len(own))
            score[rows] *= inner
            for r, b in zip(rows.tolist(), best.tolist()):
                names[r] = own[b]
        return names, score


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Fit on at most ``per_language`` documents of every language of the training fold."""
    draw = F.xxhash64(F.lit("sample"), F.col(text)).bitwiseAND(F.lit(2**52 - 1)) / F.lit(float(2**52))
    labelled = docs.where(F.col(lang).isNotNull() & ~held_out(F.col(key)))
    labelled = labelled.select(draw.alias("draw"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n"), F.min("draw").alias("least")).collect()
    if not counts:
        return None
    per_language = max(1, min(per_language, MOST_SAMPLED // len(counts)))
    # a somewhat larger draw by hash, of which the first per_language are taken; one at least
    most = {r.lang: max(r.least, min(1.0, (1.3 * per_language + 50) / max(1, r.n))) for r in counts}
    share = F.create_map(*(F.lit(v) for pair in most.items() for v in pair))

    @returns_memory
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [vector(t.as_py() or "").astype(np.float16).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(vectors, pa.binary())], names=["draw", "lang", "vector"]
            )

    drawn = (
        labelled.where(F.col("draw") <= F.element_at(share, F.col("lang")))
        .dropDuplicates(["lang", "draw"])
        .mapInArrow(rows, "draw double, lang string, vector binary")
        .collect()
    )
    drawn.sort(key=lambda r: (r.lang, r.draw, r.vector))
    taken, seen = [], {}
    for r in drawn:
        seen[r.lang] = seen.get(r.lang, 0) + 1
        if seen[r.lang] <= per_language:
            taken.append(r)
    x = np.stack([np.frombuffer(r.vector, dtype=np.float16) for r in taken]).astype(np.float64)
    return LanguageModel.fit(x, [r.lang for r in taken])


def with_language(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lid_lang`` and ``lid_score``.  The model has
    BINS weights for each family and each pair of languages of a family.
    ``lid_known``: whether the text looks like one of the predicted language."""
    no_columns(docs, "lid_")
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("lid_lang", T.StringType()), T.StructField("lid_score", T.DoubleType()), T.StructField("lid_known", T.BooleanType())])

    @returns_memory
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                piece = batch.slice(first, 256)
                texts = piece.column(at).to_pylist()
                names, scores, sure = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
                known = [i for i, t in enumerate(texts) if own is not None and t and any(map(str.isalpha, t))]
                if known:
                    x = np.stack([vector(texts[i]) for i in known])
                    found, score = own.predict(x)
                    for i, name in zip(known, found):
                        names[i] = name
                    scores[known], sure[known] = score, own.knows(x, found)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sure)],
                    names=[*piece.schema.names, "lid_lang", "lid_score", "lid_known"],
                )

    return docs.mapInArrow(rows, schema)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    return with_language(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("lid_lang").alias("lang_pred"),
        F.col("lid_score").alias("score"),
    )
