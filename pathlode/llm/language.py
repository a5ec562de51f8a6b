"""Language identification in two steps: the language family, then the language within it.

Features are hashed byte n-grams of the lower-cased whole text. One linear machine per
family, each against the rest, picks the family; one linear support vector machine per
pair of languages of that family then votes for the language. The model is fitted on a
bounded sample of labelled rows; every row is predicted on its whole text.
"""

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# Families of language codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "semitic": ("am", "ar", "he", "mt"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "austronesian": ("id", "jv", "ms", "su", "tl"),
}

# Hashed features, and labelled rows that a model is fitted on: of a language, and in all (about).
FEATURES, SAMPLE, ALL_SAMPLED = 4096, 500, 20_000
UNDETERMINED = "und"
# Texts with fewer letters are not judged by their score. The least score is so many times the score of
# chance, and at most this share of what any labelled held-out row has.
JUDGED_LETTERS, ABOVE_CHANCE, BELOW_CLEAN = 150, 1.5, 0.9

# Bytes whose grams are counted at once.
_COUNTED = 1 << 20
_BLANKED = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def has_letter(text: str | None) -> bool:
    """Whether a character of the text is a letter; numerals such as fractions are none."""
    return bool(text) and any(map(str.isalpha, text))


def features(text: str, size: int = FEATURES) -> np.ndarray:
    """Unit vector of the square roots of hashed counts of 1-, 2- and 3-byte grams."""
    line = b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANKED).split())
    line = b" " + line + b" "
    counts = np.zeros(size)
    for at in range(0, len(line), _COUNTED):
        # Grams that begin in this stretch; arrays stay small however long the text is.
        b = np.frombuffer(line[at : at + _COUNTED + 2], dtype=np.uint8).astype(np.uint32)
        for n in (1, 2, 3):
            starts = min(len(b) - n + 1, _COUNTED)
            grams = np.full(max(starts, 0), n, dtype=np.uint32)
            for k in range(n):
                grams = grams * np.uint32(0x9E3779B1) + b[k : k + len(grams)]
            counts += np.bincount((grams * np.uint32(0x85EBCA6B)) >> np.uint32(20), minlength=size)
    counts = np.sqrt(counts)
    return counts / max(np.sqrt((counts**2).sum()), 1e-12)


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 50.0, steps: int = 80) -> np.ndarray:
    """Weights (the last one a bias) of a linear support vector machine; ``y`` is -1 or 1.

    Squared hinge loss with both classes weighing the same, by accelerated gradient steps.
    """
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    # Rows have length sqrt(2) with the bias, which bounds the curvature.
    rate = np.float32(1 / (1 + 4 * cost))
    share, y = share.astype(np.float32), y.astype(np.float32)
    w = np.zeros(x.shape[1], dtype=np.float32)
    ahead = w
    for k in range(steps):
        gap = np.maximum(1 - y * (x @ ahead), 0)
        step = ahead - rate * (ahead - np.float32(2 * cost) * (x.T @ (share * y * gap)))
        ahead, w = step + np.float32(k / (k + 3)) * (step - w), step
    return w


def _odds(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(3 * margin, -30, 30)))


@dataclass
class Model:
    """Machines by family, and by pair of languages within a family."""

    members: dict[str, list[str]] = field(default_factory=dict)
    families: dict[str, np.ndarray] = field(default_factory=dict)
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score; ``und`` and 0 for texts without a letter or without a model."""
        if not self.members or not has_letter(text):
            return UNDETERMINED, 0.0
        x = np.append(features(text), 1.0)
        odds = {f: float(_odds(w @ x)) for f, w in self.families.items()}
        family = max(sorted(odds), key=odds.get)
        votes = dict.fromkeys(self.members[family], 0.0)
        for a, b in combinations(self.members[family], 2):
            share = float(_odds(self.pairs[a, b] @ x))
            votes[a] += share
            votes[b] += 1 - share
        language = max(sorted(votes), key=votes.get)
        within = votes[language] / (len(votes) - 1) if len(votes) > 1 else 1.0
        return language, min(odds[family] / max(sum(odds.values()), 1e-12) * within, 1.0)


def family_of(language: str, families: Mapping[str, Sequence[str]] = FAMILIES) -> str:
    return next((f for f, codes in families.items() if language in codes), language)


def fit(x: np.ndarray, languages: Sequence[str], families=FAMILIES) -> Model:
    """A model from feature rows and their languages."""
    model, labels = Model(), np.array(languages, dtype=object)
    for language in sorted(set(languages)):
        model.members.setdefault(family_of(language, families), []).append(language)
    family = np.array([family_of(c, families) for c in languages], dtype=object)
    for name, members in model.members.items():
        model.families[name] = fit_machine(x, np.where(family == name, 1.0, -1.0))
        for a, b in combinations(members, 2):
            rows = (labels == a) | (labels == b)
            model.pairs[a, b] = fit_machine(x[rows], np.where(labels[rows] == a, 1.0, -1.0))
    return model


def fold(key: str) -> Column:
    """The key's fold, 0 to 3; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4


def train(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    held_out: int = 2,
    sample: int = SAMPLE,
    families: Mapping[str, Sequence[str]] = FAMILIES,
) -> Model:
    """A model from about ``sample`` labelled rows of each language, fewer if there are many.

    Rows are chosen by a digest of the key. Rows of the held-out fold, with a null text, label
    or key, and texts without a letter are never used. No usable rows give a model that knows
    no language.
    """
    usable = (fold(key) != held_out) & F.col(lang).isNotNull() & F.col(text).isNotNull()
    rows = docs.filter(usable).select(
        F.col(lang).alias("lang"),
        F.col(text).alias("text"),
        F.md5(F.col(key).cast("string")).alias("mark"),
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model()
    sample = min(sample, ALL_SAMPLED // len(counts))
    # A row takes part if its digest is below its language's share.
    share = F.create_map(
        *[F.lit(v) for c, n in counts.items() for v in (c, min(int(sample / n * 0xFFFFFFF), 0xFFFFFFF))]
    )
    chosen = rows.filter(F.conv(F.substring("mark", 1, 7), 16, 10).cast("long") <= share[F.col("lang")])
    bound = int(1.3 * sample * len(counts)) + 100
    taken = (
        chosen.mapInPandas(_feature_rows, "lang string, mark string, at array<int>, value array<float>")
        .limit(bound)
        .collect()
    )
    taken.sort(key=lambda r: (r["mark"], r["lang"]))
    if not taken:
        return Model()
    x = np.zeros((len(taken), FEATURES), dtype=np.float32)
    for row, to in zip(taken, x, strict=True):
        to[row["at"]] = row["value"]
    return fit(x, [r["lang"] for r in taken], families)


def _feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch = batch[batch["text"].map(has_letter)]
        rows = [features(t) for t in batch["text"]]
        at = [np.nonzero(r)[0].astype(np.int32) for r in rows]
        yield pd.DataFrame(
            {
                "lang": batch["lang"].to_numpy(),
                "mark": batch["mark"].to_numpy(),
                "at": at,
                "value": [r[i].astype(np.float32) for r, i in zip(rows, at, strict=True)],
            }
        )


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), from the text alone.

    Columns of these names are replaced. Null texts and texts without a letter are ``und``
    with score 0.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        rows = [held.value.predict(t) for t in texts]
        return pd.DataFrame(rows, columns=["lang_pred", "score"])

    # Otherwise a filter on the result would have texts predicted once more below it.
    predicted = predicted.asNondeterministic()
    return docs.withColumn("_llm_lang", predicted(F.col(text))).withColumns(
        {"lang_pred": F.col("_llm_lang.lang_pred"), "score": F.col("_llm_lang.score")}
    ).drop("_llm_lang")


def least_score(
    docs: DataFrame,
    model: Model,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    held_out: int = 2,
) -> float:
    """The score below which a text of ``JUDGED_LETTERS`` is in no language of the model.

    It is measured on all labelled rows of the held-out fold that have so many letters, and
    rejects none of them. A model of one language, or no such row, gives 0: nothing is rejected.
    """
    languages = sum(map(len, model.members.values()))
    if languages < 2:
        return 0.0
    held = (fold(key) == held_out) & F.col(lang).isNotNull() & _judged(F.col(text))
    rows = docs.filter(held).select(F.col(text).alias("text"))
    clean = predict(rows, model).agg(F.min("score")).first()[0]
    return 0.0 if clean is None else min(BELOW_CLEAN * clean, ABOVE_CHANCE / languages)


@F.pandas_udf(BooleanType())
def _has_letter(texts: pd.Series) -> pd.Series:
    return pd.Series([has_letter(t) for t in texts], dtype=bool)


def _judged(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}+", "")) >= JUDGED_LETTERS


def reject_undetermined(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id"
) -> DataFrame:
    """``docs`` without the rows whose language cannot be told; null labels are filled in.

    Rows without a letter go, and so do texts of ``JUDGED_LETTERS`` whose score is below
    ``least_score``. Where nothing could be learnt, all rows with a letter stay, and null
    labels stay null.
    """
    model = train(docs, key, text, lang)
    if not model.members:
        return docs.filter(_has_letter(F.col(text)))
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text).alias("text"))
    named = predict(whole, model).filter(F.col("lang_pred") != UNDETERMINED)
    least = least_score(docs, model, key, text, lang)
    if least:
        named = named.filter((F.col("score") >= least) | ~_judged(F.col("text")))
    filled = F.coalesce(F.col("doc")[lang], "lang_pred")
    return named.select(
        *[(filled if c == lang else F.col("doc")[c]).alias(c) for c in docs.columns]
    )
