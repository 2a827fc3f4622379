"""Language identification by string kernels.

A text's blended spectrum is the set of its letter n-grams, n = 1 to 3, over lower-cased letters with runs of anything
else as one boundary. The presence kernel of two texts is |common grams| / sqrt(|grams a| |grams b|), all grams counted.
Nystroem features on m landmarks and one-versus-rest ridge regression (targets +1 and -1) are fitted in closed form on the
driver, and texts are scored by batched matrix products: presence matrix x landmarks, then x weights. Any letter of any
script is a letter of its own; the grams of the landmarks are looked up in a hash table.

Bounds (parameters): the classifier is fitted on at most per_lang texts of each label and most_texts in all, one of each
label at least, each of at most max_chars code points. Scoring reads every whole text.

A margin is a comparison of the learned languages and says nothing of texts in none of them. Evidence of a learned language is
the share of a text's distinct grams that the landmarks hold. The training texts that are no landmarks give the share that is
usual; a text is rejected if it has far more unknown grams, with an allowance for the chance in short texts.

Defined results: `und` with score 0 for a null text, a text without letters, or if nothing is labelled; null labels are
not learned from; equal margins go to the label that sorts first; rows with equal ids stay separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import fold_of, forget_shuffles
from quillgraph.session import bound_batches

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)


def _spectrum(text: str) -> np.ndarray:
    """Numbers of the text's 1-, 2- and 3-grams, with repeats; a boundary alone is no gram."""
    points = _points(text)
    c = np.where(_is_letter()[points], points, 0).astype(np.uint64)
    if len(c):
        c = c[(c > 0) | np.concatenate(([True], c[:-1] > 0))]
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:] if len(c) > 2 else two[:0]
    # A code point has 21 bits; the lengths are kept apart by odd factors and addends.
    with np.errstate(over="ignore"):
        return np.concatenate([(g + np.uint64(k)) * m for k, (g, m) in enumerate(zip((c[c > 0], two, three), _FACTORS, strict=True))])


_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class GramTable:
    """gram -> column, in open addressing; at most one place in eight is taken."""

    def __init__(self, grams: np.ndarray):
        self.bits = max(6, (8 * len(grams)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.columns = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(grams), dtype=np.int32)
        at = self._home(grams)
        while len(left):
            free = self.columns[at] < 0
            first = np.unique(np.where(free, at, -1), return_index=True)
            won = first[1][first[0] >= 0]
            self.keys[at[won]], self.columns[at[won]] = grams[left[won]], left[won]
            lost = np.ones(len(left), bool)
            lost[won] = False
            left, at = left[lost], (at[lost] + 1) & (len(self.keys) - 1)

    def _home(self, grams: np.ndarray) -> np.ndarray:
        return ((grams ^ (grams >> np.uint64(29))) >> np.uint64(max(0, 35 - self.bits)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def look_up(self, grams: np.ndarray) -> np.ndarray:
        """The column of each gram, or -1."""
        at = self._home(grams)
        out = self.columns[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[at] != grams))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            out[open_] = self.columns[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[at[open_]] != grams[open_])]
        return out


@dataclass
class Model:
    """landmarks: presence of each gram in each landmark; sizes: roots of their numbers of grams; weights: kernel values -> margins."""

    langs: list[str]
    grams: GramTable
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray
    unknown: float = 0.5

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which of the landmarks' grams each text has, and how many distinct other grams."""
        out, other = np.zeros((len(texts), self.landmarks.shape[1]), np.float32), np.zeros(len(texts))
        for i, t in enumerate(texts):
            g = _spectrum(t)
            ids = self.grams.look_up(g)
            out[i, ids[ids >= 0]] = 1
            other[i] = len(np.unique(g[ids < 0]))
        return out, other

    def foreign(self, presence: np.ndarray, unknown: np.ndarray) -> np.ndarray:
        """Whether a text has more unknown grams than its length explains, by three deviations."""
        usual = self.unknown * (presence.sum(1) + unknown)
        return unknown > usual + 3 * np.sqrt(usual)

    def kernel(self, presence: np.ndarray, unknown: np.ndarray) -> np.ndarray:
        n = np.sqrt(np.maximum(presence.sum(1, dtype=np.float64) + unknown, 1))
        return (presence @ self.landmarks.T).astype(np.float64) / n[:, None] / self.sizes[None, :]


def fit(texts: list[str], labels: list[str], n_landmarks: int = 96, ridge: float = 1e-3) -> Model | None:
    """texts in a stable order; landmarks are dealt from it evenly over the labels."""
    if not texts:
        return None
    langs = sorted(set(labels))
    by = {lang: [t for t, x in zip(texts, labels, strict=True) if x == lang] for lang in langs}
    each = max(1, n_landmarks // len(langs))
    marks = [t for lang in langs for t in by[lang][:each]]
    found = np.unique(np.concatenate([_spectrum(t) for t in marks]))
    m = Model(langs, GramTable(found), np.zeros((1, max(1, len(found))), np.float32), np.ones(1), np.zeros(0))
    m.landmarks, none = m.presence(marks)
    m.sizes = np.sqrt(np.maximum(m.landmarks.sum(1, dtype=np.float64), 1))
    mm = m.kernel(m.landmarks, none)
    values, vectors = np.linalg.eigh((mm + mm.T) / 2)
    keep = values > 1e-8 * values[-1]
    half = vectors[:, keep] / np.sqrt(values[keep])
    k = np.concatenate([m.kernel(*m.presence(texts[i : i + 128])) for i in range(0, len(texts), 128)]) @ half
    y = np.where(np.array(labels)[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    others = [t for lang in langs for t in by[lang][each:] if any(map(str.isalpha, t))]
    shares = []
    for i in range(0, len(others), 128):
        known, unknown = m.presence(others[i : i + 128])
        shares.extend(unknown / (known.sum(1) + unknown))
    if len(shares) >= 20:  # fewer tell nothing: then a text needs half of its grams known
        m.unknown = float(min(0.5, max(0.05, 2 * np.quantile(shares, 0.99, method="higher"))))
    m.weights = half @ np.linalg.solve(k.T @ k + ridge * len(texts) * np.eye(k.shape[1]), k.T @ y)
    return m


def training_sample(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, most_texts: int, max_chars: int
) -> tuple[list[str], list[str]]:
    """At most per_lang texts of each label, fewer if all would be over most_texts, by the order of a hash of the id."""
    rows = docs.select(
        F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where("lang is not null and text is not null")
    rows = rows.where(F.length("text") <= max_chars)
    counts = rows.groupBy("lang").count().collect()  # one row for each language
    if not counts:
        return [], []
    per_lang = max(1, min(per_lang, most_texts // len(counts)))
    # Per label a threshold on the hash lets about twice per_lang texts through; only those reach the sort.
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 2.0 * per_lang / r["count"])))])
    chance = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    some = rows.where(chance < F.coalesce(share[F.col("lang")], F.lit(0.0))).orderBy("h", "lang", "text").limit(2 * per_lang * len(counts) + 1000)
    got: dict[str, list[str]] = {}
    for r in some.collect():
        mine = got.setdefault(r["lang"], [])
        if len(mine) < per_lang:
            mine.append(r["text"])
    return [t for x in sorted(got) for t in got[x]], [x for x in sorted(got) for _ in got[x]]


def predict(model: Model | None, texts: list[str | None], batch: int = 128, reject: bool = False) -> tuple[list[str], list[float]]:
    """The best label and its margin mapped from -1..1 to 0..1; reject: `und` without evidence of a learned language."""
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if model is None:
        return langs, scores
    real = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    for at in range(0, len(real), batch):
        part = real[at : at + batch]
        presence, unknown = model.presence([texts[i] for i in part])
        margins = model.kernel(presence, unknown) @ model.weights
        foreign = model.foreign(presence, unknown) if reject else np.zeros(len(part), bool)
        for i, row, out in zip(part, margins, foreign, strict=True):
            if out:
                continue
            top = int(row.argmax())
            langs[i], scores[i] = model.langs[top], float(min(1.0, max(0.0, (row[top] + 1) / 2)))
    return langs, scores


def _scorer(shared, at: int, cut: int, reject: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                lang, score = predict(shared.value, batch.column(at).to_pylist(), reject=reject)
                kept = list(batch.columns)[:cut]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[f"c{i}" for i in range(len(kept) + 2)]
                )

    return run


def identify(
    docs: DataFrame,
    learn_from: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_lang: int = 400,
    most_texts: int = 8_000,
    max_chars: int = 20_000,
    reject: bool = False,
) -> DataFrame:
    """docs with lang_pred and score appended; any other columns pass through unread, whatever their names.

    reject: texts without evidence of a learned language are `und` with score 0.
    """
    bound_batches(docs.sparkSession)
    model = fit(*training_sample(learn_from, id_col, text_col, lang_col, per_lang, most_texts, max_chars))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the landmarks
    n = len(docs.columns)
    plain = docs.toDF(*[f"c{i}" for i in range(n)])
    schema = ", ".join([f"c{i} {t}" for i, (_, t) in enumerate(plain.dtypes)] + [f"c{n} string", f"c{n + 1} double"])
    return plain.mapInArrow(_scorer(shared, docs.columns.index(text_col), n, reject), schema).toDF(*docs.columns, "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.25) -> DataFrame:
    """Documents in a learned language; rejected are `und`, texts without evidence of one and scores under min_score."""
    forget_shuffles(docs.sparkSession)
    n = len(docs.columns)
    at = {c: f"c{docs.columns.index(c)}" for c in ("doc_id", "text", "lang")}
    plain = docs.toDF(*[f"c{i}" for i in range(n)])
    columns = {"id_col": at["doc_id"], "text_col": at["text"], "lang_col": at["lang"]}
    found = identify(plain, plain.where(fold_of(at["doc_id"]) != 0), reject=True, **columns)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).drop("lang_pred", "score").toDF(*docs.columns)


def op3(docs: DataFrame) -> DataFrame:
    """The contract's query: learns from folds 1 to 4 and predicts every document."""
    held = fold_of("doc_id") == 0
    return identify(docs.select("doc_id", "text"), docs.where(~held)).select(
        "doc_id", (fold_of("doc_id") == 0).alias("held_out"), "lang_pred", "score"
    )
