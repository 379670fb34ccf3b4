"""Language identification by hierarchical discrimination.

A linear classifier first picks the language family; inside the family, one-versus-one linear support vector
machines separate the closely related languages. Features are the square roots of hashed byte n-gram counts (one to
three bytes of the lower-cased text), scaled to unit length. Models are trained with numpy on squared hinge loss.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusflow.llm.common import arrow_map, fold
from locusflow.session import prepare

BITS = 12
#: Bound of the training sample, over all languages, in documents.
SAMPLE = 4000
UNKNOWN = "und"
#: Families by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {"germanic": ("en", "de", "nl", "sv", "da", "no"), "romance": ("fr", "es", "it", "pt", "ro", "ca"), "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr")}
#: Least likeness of a document that ``keep`` keeps. In learned languages even texts of three letters reach 0.23; other scripts and random letters stay under 0.2.
FLOOR = 0.2
_LETTER = re.compile(r"[^\W\d_]")


def lettered(text: str | None) -> bool:
    """Whether a text has a letter; numerals such as ½, ² or Ⅻ are none."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text or ""))


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text, in steps of a million bytes."""
    raw = np.frombuffer(b"  " + text.lower().encode() + b" ", np.uint8)
    out = np.zeros(1 << BITS)
    for lo in range(0, len(raw), 1 << 20):
        b = raw[max(0, lo - 2) : lo + (1 << 20)].astype(np.uint32)
        one, two, three = b[2:], b[1:-1], b[:-2]
        g = one + 1
        for x in (None, two, three):
            if x is not None:
                g = g * np.uint32(257) + x + np.uint32(1)
            out += np.bincount((g * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out


def _unit(c: np.ndarray) -> np.ndarray:
    r = np.sqrt(c)
    return (r / max(float(np.sqrt((r * r).sum())), 1e-9)).astype(np.float32)


def _svm(x: np.ndarray, y: np.ndarray, steps: int = 150, l2: float = 1e-4) -> np.ndarray:
    """Weights and bias (last) of a linear support vector machine: balanced squared hinge, Adam on the whole sample."""
    w = np.zeros(x.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    for t in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (x @ w[:-1].astype(np.float32) + w[-1]))
        d = -2 * weight * y * slack
        g = np.r_[x.T @ d.astype(np.float32), d.sum()] + l2 * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _squash(z):
    return 1 / (1 + np.exp(-np.clip(3 * z, -40, 40)))


@dataclass
class Model:
    families: list[list[str]] = field(default_factory=list)
    family: np.ndarray | None = None  # a row of weights for each family
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    means: np.ndarray | None = None  # a row for each language: the unit vector of all its texts

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score."""
        return self.recognise(text)[:2]

    def recognise(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and likeness: the cosine of the text's features and those of the learned language nearest to it."""
        if not self.families or not lettered(text):
            return UNKNOWN, 0.0, 0.0
        x = np.append(_unit(counts(text)), np.float32(1))
        p = np.ones(len(self.families))
        if self.family is not None:
            p = _squash(self.family @ x)
            p = p / p.sum()
        best = int(np.argmax(p))
        langs = self.families[best]
        won = dict.fromkeys(langs, 0.0)
        for a, b in combinations(langs, 2):
            q = float(_squash(self.pairs[a, b] @ x))
            won[a] += q
            won[b] += 1 - q
        lang = max(langs, key=lambda k: (won[k], k))
        share = won[lang] / sum(won.values()) if len(langs) > 1 else 1.0
        return lang, float(min(1.0, p[best] * share)), float((self.means @ x[:-1]).max())


def train(rows: list[tuple[str, np.ndarray]]) -> Model:
    """From (language, counts): without rows every prediction is ``und``."""
    langs = sorted({a for a, _ in rows})
    if not langs:
        return Model()
    of = {k: f for f, ks in FAMILIES.items() for k in ks}
    fam: dict[str, list[str]] = {}
    for k in langs:
        fam.setdefault(of.get(k, k), []).append(k)
    names = sorted(fam)
    x, y = np.stack([_unit(c.astype(float)) for _, c in rows]), np.array([a for a, _ in rows])
    model = Model([fam[n] for n in names], means=np.stack([_unit(sum(c.astype(float) for a, c in rows if a == k)) for k in langs]))
    if len(names) > 1:
        model.family = np.stack([_svm(x, np.where(np.isin(y, fam[n]), 1.0, -1.0)) for n in names]).astype(np.float32)
    for n in names:
        for a, b in combinations(fam[n], 2):
            z = (y == a) | (y == b)
            model.pairs[a, b] = _svm(x[z], np.where(y[z] == a, 1.0, -1.0)).astype(np.float32)
    return model


def fit(docs: DataFrame, learn, sample: int = SAMPLE) -> Model:
    """Train from documents for which ``learn`` holds and whose lang is not null: per language an equal part of ``sample``, the first by a hash of the id."""
    prepare(docs.sparkSession)
    known = docs.where(learn).where(f"lang is not null and lang != '{UNKNOWN}' and text is not null")
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    each = max(20, sample // max(1, len(n)))
    cut = F.create_map(*[F.lit(x) for k, c in n.items() for x in (k, int(min(1.0, 1.5 * each / c + 50 / c) * (1 << 20)))]) if n else None
    if cut is None:
        return Model()
    h = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20))
    near = known.select("lang", "text", F.xxhash64("doc_id", F.lit(7)).alias("h"), h.alias("part")).where(F.col("part") < F.element_at(cut, F.col("lang")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))  # over at most about 1.5 times the sample
    took = near.select("lang", "text", rank.alias("r")).where(F.col("r") <= each).select("lang", "text")

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        c = [np.minimum(counts(t), 65535).astype(np.uint16).tobytes() for t in b.column("text").to_pylist()]
        return pa.record_batch({"lang": b.column("lang"), "c": pa.array(c, pa.binary())})

    got = arrow_map(took, f, "lang string, c binary").toArrow()
    rows = sorted(zip(got["lang"].to_pylist(), got["c"].to_pylist(), strict=True))
    return train([(a, np.frombuffer(c, np.uint16)) for a, c in rows])


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score of each row's text, read whole whatever its length; null texts and texts without a letter are ``und`` with score 0.

    Ties of families go to the first, of languages to the later name. Equal texts get equal predictions, one row per row; an empty table gives
    no rows, further columns play no part. No shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)  # 16 KB a family and pair of languages

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [sent.value.predict(t) for t in b.column("text").to_pylist()]
        return pa.record_batch({"id": b.column("id"), "lang_pred": pa.array([a for a, _ in got], pa.string()), "score": pa.array([s for _, s in got], pa.float64())})

    return arrow_map(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), f, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", key)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from the two folds that are not held out."""
    model = fit(docs, fold("doc_id", 3) != 1)
    return predict(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def keep(docs: DataFrame, model: Model, languages: set[str] | None = None, floor: float = FLOOR, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose predicted language is one of ``languages`` (None: any that was learned) and whose text is like a learned language, by ``floor`` or more.

    A null ``lang`` becomes the predicted language; other columns stay as they are. Texts that are null or have no letter go. Where nothing could
    be learned there is no prediction: every text with a letter stays unchanged. Repeated rows fare alike. No shuffle.
    """
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, learned = b.column(text).to_pylist(), bool(sent.value.families)
        if not learned:
            return b.filter(pa.array([lettered(t) for t in texts], pa.bool_()))
        got = [sent.value.recognise(t) for t in texts]
        at = b.schema.get_field_index(lang)
        b = b.set_column(at, b.schema.field(at), pa.array([k if k is not None else p for k, (p, _, _) in zip(b.column(at).to_pylist(), got, strict=True)], pa.string()).cast(b.schema.field(at).type))
        return b.filter(pa.array([p != UNKNOWN and s >= floor and (languages is None or p in languages) for p, _, s in got], pa.bool_()))

    return arrow_map(docs, f, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
