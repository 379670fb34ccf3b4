"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

A linear classifier over the distinct words of a text (and word beginnings, which inflected insults share) is
trained from confirmed toxic texts and unlabelled texts alone. With class prior p, positive risk R+ and
unlabelled risk Ru the estimator is p * R+(+1) + max(0, Ru(-1) - p * R+(-1)); where the second part turns
negative its gradient is reversed. The loss is logistic at first and the bounded sigmoid loss after that.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import arrow_map, fold
from locusflow.session import cut, prepare

#: Bounds of the training sample: confirmed toxic texts and unlabelled texts.
POSITIVES, UNLABELLED = 3000, 8000
THRESHOLD = 0.3
#: A feature's least chi-square statistic and lift, and how many features are kept at most, those of the greatest statistic.
CHI2, LIFT, FEATURES = 15.0, 2.5, 20_000
#: Ranks, as multiples of the prior, between which the threshold is placed.
GAP = (0.7, 1.1)
BEGINNINGS = (4, 5, 7)
#: A beginning is dense where at least two distinct words, and one of so many distinct words of the text, have it.
DENSE = 100
_WORD = re.compile(r"\w+")


def features(word: str) -> list[int]:
    """Ids of a word and, after it, of its beginnings."""
    return [zlib.crc32(word.encode())] + [zlib.crc32(b"%d:" % n + word[:n].encode()) for n in BEGINNINGS if len(word) >= n]


def dense(beginning: int) -> int:
    """Id of a beginning's being dense."""
    return zlib.crc32(b"dense:%d" % beginning)


def text_features(text: str | None) -> np.ndarray:
    """Sorted distinct feature ids of a whole text: its words, their beginnings, and which of these are dense."""
    words = set(_WORD.findall((text or "").lower()))
    own, count = [], {}
    for w in words:
        one, *more = features(w)
        own.append(one)
        for f in more:
            count[f] = count.get(f, 0) + 1
    own += count
    own += [dense(f) for f, k in count.items() if k > 1 and k * DENSE >= len(words)]
    return np.unique(np.array(own, np.uint32))


@dataclass
class Model:
    weights: dict[int, float]
    bias: float

    def scorer(self):
        weights, bias = self.weights, self.bias

        class Memo(dict):
            def __missing__(self, word):
                if len(self) > 150_000:
                    self.clear()
                one, *more = features(word)
                self[word] = got = ((one,) if one in weights else (), tuple(f for f in more if f in weights or dense(f) in weights))
                return got

        memo = Memo()
        nothing = ((), ())

        def score(text: str | None) -> float:
            words = set(_WORD.findall((text or "").lower()))
            own, count = {}, {}
            for word in words:
                if (got := memo[word]) != nothing:
                    for f in got[0]:
                        own[f] = weights[f]
                    for f in got[1]:
                        count[f] = count.get(f, 0) + 1
            for f, k in count.items():
                own[f] = weights.get(f, 0.0)
                if k > 1 and k * DENSE >= len(words):
                    d = dense(f)
                    own[d] = weights.get(d, 0.0)
            return float(1 / (1 + np.exp(-np.clip(bias + sum(sorted(own.values())), -40, 40))))

        return score


def _statistics(a, b, n: int, m: int):
    """Chi-square statistic and lift test of features that ``a`` of ``n`` toxic and ``b`` of ``m`` unlabelled texts have. Columns or numpy.

    A word that only toxic texts use has a lift of one over the prior, since unlabelled texts hold their share of toxic ones.
    """
    p, u, both = a / n, b / m, (a + b) / (n + m)
    return (p - u) * (p - u) / (both * (1 - both) * (1 / n + 1 / m) + 1e-12), p >= LIFT * u


def _least(positives: int) -> int:
    """Texts that a feature must be in."""
    return 3 if positives >= 100 else 2


def _select(pos: list[np.ndarray], unl: list[np.ndarray]) -> np.ndarray:
    """Ids, sorted, of the features kept: seen often enough, at least ``LIFT`` times as frequent in toxic texts as in unlabelled ones, and beyond chance."""
    (ip, cp), (iu, cu) = (np.unique(np.concatenate(x) if x else np.empty(0, np.uint32), return_counts=True) for x in (pos, unl))
    ids = np.union1d(ip, iu)
    a, b = np.zeros(len(ids)), np.zeros(len(ids))
    a[np.searchsorted(ids, ip)], b[np.searchsorted(ids, iu)] = cp, cu
    stat, lifted = _statistics(a, b, max(1, len(pos)), max(1, len(unl)))
    good = np.flatnonzero((a + b >= _least(len(pos))) & (stat > CHI2) & lifted)
    return np.sort(ids[good[np.lexsort((ids[good], -stat[good]))][:FEATURES]])


def train(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, epochs: int = 150, warm: int = 30, rate: float = 1.0, l2: float = 1e-3, keep: np.ndarray | None = None, fits: int = 3, seed: int = 0) -> Model:
    """Fit the linear model with AdaGrad on the non-negative risk, over the features ``keep`` (sorted ids). Without positives every score is the prior."""
    base = float(np.log(max(prior, 1e-4) / (1 - min(prior, 0.9999))))
    if not pos or not unl:
        return Model({}, base)
    keep = _select(pos, unl) if keep is None else keep

    def rows(sets):
        hit = [np.searchsorted(keep, x[np.isin(x, keep, assume_unique=True)]) for x in sets]
        return hit

    P, U = rows(pos), rows(unl)

    def margin(sets, w, b):
        lens = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate(sets) if lens.sum() else np.empty(0, np.int64)
        return b + np.bincount(np.repeat(np.arange(len(sets)), lens), w[flat], len(sets)), flat, lens

    def once(rng):
        w, b = np.zeros(len(keep)), base
        gw, gb = np.full(len(keep), 1e-6), 1e-6
        steps = 8
        for epoch in range(epochs):
            soft = epoch < warm  # logistic loss first, whose gradient reaches every text; then the sigmoid loss, whose bound keeps single texts from weighing much
            op, ou = np.array_split(rng.permutation(len(P)), steps), np.array_split(rng.permutation(len(U)), steps)
            for ip, iu in zip(op, ou, strict=True):
                if not len(ip) or not len(iu):
                    continue
                zp, fp, lp = margin([P[i] for i in ip], w, b)
                zu, fu, lu = margin([U[i] for i in iu], w, b)
                sp, su = 1 / (1 + np.exp(-np.clip(zp, -40, 40))), 1 / (1 + np.exp(-np.clip(zu, -40, 40)))
                if soft:
                    negative, hp, hu, gain = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean(), sp, su, 1 - sp
                else:
                    hp, hu = sp * (1 - sp), su * (1 - su)
                    negative, gain = su.mean() - prior * sp.mean(), hp
                if negative < 0:  # reversed gradient of the negative part alone
                    dp, du = prior * hp / len(ip), -hu / len(iu)
                else:
                    dp, du = -prior * (gain + hp) / len(ip), hu / len(iu)
                g = np.bincount(fp, np.repeat(dp, lp), len(keep)) + np.bincount(fu, np.repeat(du, lu), len(keep)) + l2 * w
                g0 = dp.sum() + du.sum()
                gw += g * g
                gb += g0 * g0
                w -= rate * g / np.sqrt(gw)
                b -= rate * g0 / np.sqrt(gb)
        return w, b

    # the mean of a few fits that see the texts in different orders
    rng = np.random.default_rng(seed)
    fits = [once(rng) for _ in range(fits)]
    w, b = np.mean([f[0] for f in fits], 0), float(np.mean([f[1] for f in fits]))
    # The clamp holds the bias where the negative risk is nought, not where classes part. So that THRESHOLD parts them, the scores are shifted to
    # put it into the widest gap among the unlabelled scores near the rank that the prior predicts; where they are all equal there, above them.
    z = np.sort(margin(U, w, b)[0])[::-1]
    lo, hi = int(GAP[0] * prior * len(z)), int(GAP[1] * prior * len(z)) + 2
    above = int((z > z[lo] + 1e-9).sum()) if lo < len(z) else len(z)
    if lo < len(z) and z[lo] - z[min(hi, len(z)) - 1] <= 1e-9:  # all equal: between them and the next higher score
        at = (z[above - 1] + z[lo]) / 2 if above else z[lo] + 1.0
        b += float(np.log(THRESHOLD / (1 - THRESHOLD)) - at)
    else:
        top = z[lo:hi]
        i = int(np.argmax(top[:-1] - top[1:])) if len(top) > 1 else -1
        if i >= 0:
            b += float(np.clip(np.log(THRESHOLD / (1 - THRESHOLD)) - (top[i] + top[i + 1]) / 2, -1.5, 1.5))
    return Model({int(f): float(x) for f, x in zip(keep, w, strict=True) if abs(x) > 1e-3}, float(b))


def fit(docs: DataFrame, labels: DataFrame, learn, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Train from the documents for which ``learn`` (a column) holds.

    ``labels.toxic`` = 1 confirms; any document is unlabelled text. The prior is the toxic share of the labelled
    ones. Each side is a hash sample of distinct texts of at most the given bound, so the driver's share is bounded
    whatever the input; conflicting labels of one id count as toxic.
    """
    prepare(docs.sparkSession)
    lab = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lab = lab.where(learn)
    n, pos = lab.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    prior = min(0.9, max(0.001, pos / n)) if n else 0.05
    # both sides by the same law: a hash of the id under a share that gives a fourth more than the bound, before equal texts fall together
    text = docs.where(learn).select("doc_id", "text")
    total = text.select("doc_id").count()
    share = lambda want, have: F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < F.lit(int(min(1.0, 1.25 * want / max(have, 1)) * (1 << 20)))
    sure = lab.where("toxic = 1").where(share(positives, pos)).select("doc_id")
    known = text.join(F.broadcast(sure), "doc_id")  # about 1.25 * positives ids at most, whatever the input
    rest = text.where(share(unlabelled, total))  # the whole corpus is the unlabelled side: the prior is its share, so confirmed texts stay in

    def coded(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch({"h": b.column("h"), "f": pa.array([text_features(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())})

    def take(df: DataFrame, n: int) -> DataFrame:
        """h, f of the first ``n`` distinct texts by hash: the bound holds where one id (or null) has very many texts, which share its hash."""
        got = cut(arrow_map(df.groupBy(F.xxhash64("text").alias("h")).agg(F.min_by("text", "doc_id").alias("text")), coded, "h long, f binary"))
        last = got.select("h").orderBy("h").limit(n).agg(F.max("h")).first()[0]
        return got.where(F.col("h") <= F.lit(last))

    def counted(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, c = np.unique(np.frombuffer(b"".join(b.column("f").to_pylist()), np.uint32), return_counts=True)
        return pa.record_batch({"id": pa.array(ids.astype(np.int64)), "c": pa.array(c.astype(np.int64))})

    # features are counted and chosen where the texts are; the driver gets the ids of the chosen ones and, of each text, which it has
    sides = [take(known, positives), take(rest, unlabelled)]
    n, m = (max(1, d.count()) for d in sides)
    counts = [arrow_map(d, counted, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")) for d in sides]
    both = counts[0].join(counts[1].withColumnRenamed("c", "u"), "id", "left").select("id", F.col("c").cast("double").alias("a"), F.coalesce("u", F.lit(0)).cast("double").alias("b"))  # a feature without toxic texts has no lift
    stat, lifted = _statistics(F.col("a"), F.col("b"), n, m)
    chosen = both.where((F.col("a") + F.col("b") >= _least(n)) & (stat > CHI2) & lifted).select("id", stat.alias("s")).orderBy(F.desc("s"), "id").limit(FEATURES).select("id").toArrow()
    keep = np.sort(chosen["id"].to_numpy().astype(np.uint32))

    def kept(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = (np.frombuffer(x, np.uint32) for x in b.column("f").to_pylist())
        return pa.record_batch({"h": b.column("h"), "f": pa.array([x[np.isin(x, keep, assume_unique=True)].tobytes() for x in sets], pa.binary())})

    def rows(d: DataFrame) -> list[np.ndarray]:
        got = arrow_map(d, kept, "h long, f binary").toArrow().sort_by("h")
        return [np.frombuffer(x, np.uint32) for x in got["f"].to_pylist()]

    return train(rows(sides[0]), rows(sides[1]), prior, keep=keep)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of each text, read whole whatever its length; null and empty texts get the model's bias. Equal texts score alike, one row
    per row, an empty table gives none, further columns play no part. No shuffle."""
    kind = docs.schema[key].dataType.simpleString()
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)  # bounded: at most the features of the training sample
    state: dict = {}

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        if "s" not in state:
            state["s"] = sent.value.scorer()
        return pa.record_batch({"id": b.column("id"), "score": pa.array([state["s"](t) for t in b.column("text").to_pylist()], pa.float64())})

    return arrow_map(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), f, f"id {kind}, score double").withColumnRenamed("id", key)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels are learned from the three folds that are not held out."""
    model = fit(docs, labels, fold("doc_id", 4) != 2)
    return score(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores under ``threshold``, all columns as they are. No shuffle."""
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)
    state: dict = {}

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        if "s" not in state:
            state["s"] = sent.value.scorer()
        return b.filter(pa.array([state["s"](t) < threshold for t in b.column(text).to_pylist()], pa.bool_()))

    return arrow_map(docs, f, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
