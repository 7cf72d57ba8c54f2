r"""Language identification with error-correcting output codes.

Every learned language has a codeword; a binary classifier per code bit tells
from byte n-grams on which side of the bit a text lies.  The classifiers are
naive Bayes: for bit b, the weight of an n-gram is the log ratio of its mean
share in the languages with b = 1 to that in the languages with b = 0.  The
n-gram counts come from all training documents by one distributed sum.

Decoding is loss-weighted: a codeword pays log(1 + exp(-z)) for every bit,
where z is the bit's evidence in favour of the codeword; the cheapest codeword
wins.  ``score`` is its weight exp(-cost) among all codewords, and a text whose
score is below ``sure`` is flagged ambiguous.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
without any learned language every text is ``und``; rows with a null language
are not learned from; ties go to the alphabetically first language; repeated
rows are judged alike; extra columns are kept, but the result replaces one of its
own name (``_lang``, or as ``out`` says); an empty table gives no rows.  Any number of
languages is learned: the model holds a weight per n-gram and code bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covgrid.llm import common
from covgrid.session import materialize

ORDERS = (2, 3, 4)
DIM = 1 << 17
#: Up to this many languages codes are chosen by their smallest distance, which costs a
#: comparison of all pairs; beyond, random codes of twice the length are far apart anyhow.
COMPARED = 64
#: Shares are summed as whole multiples of 1 / UNIT.
UNIT = 1 << 60
SMOOTHING = 0.5
CLIP = 6.0
#: Evidence of a text grows with its n-grams up to this many.
FULL_EVIDENCE = 60
SURE = 0.6
UNKNOWN = "und"

_FOLD = common.LOWER.copy()
_FOLD[:128][~np.isin(np.arange(128), np.r_[65:91, 97:123])] = 32
_LETTER = np.zeros(256, bool)
_LETTER[np.r_[65:91, 97:123]] = True


def codewords(n: int) -> np.ndarray:
    """``n`` codewords of +1/-1: the exhaustive code for few languages, the best of some
    random codes by smallest distance for more, a longer random code for very many."""
    if n <= 1:
        return np.ones((n, 0), np.float32)
    if n <= 5:
        cols = [[1 if i == 0 or not (b >> (i - 1)) & 1 else -1 for i in range(n)] for b in range(1, 1 << (n - 1))]
        return np.array(cols, np.float32).T
    rng = np.random.default_rng(7)
    if n > COMPARED:
        while True:
            code = rng.choice(np.array([-1, 1], np.float32), (n, 10 * ceil(log2(n))))
            if len(np.unique(code, axis=0)) == n and (np.abs(code.sum(0)) < n).all():
                return code
    best, most = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (n, 5 * ceil(log2(n))))
        apart = (code[:, None] != code[None]).sum(2)[np.triu_indices(n, 1)].min()
        mixed = (np.abs(code.sum(0)) < n).all()
        if mixed and apart > most:
            best, most = code, apart
    return best


def ngrams(data: np.ndarray, order: int) -> np.ndarray:
    """Feature of the n-gram at every byte position of a block."""
    c = _FOLD[data].astype(np.uint32)
    n = len(c) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = np.full(n, 0x9E37 * order, np.uint32)
    for j in range(order):
        h = h * np.uint32(0x01000193) + c[j: j + n]
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(15)


def _row_sums(values: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``values`` (one row per n-gram) over each text, and the n-grams of each."""
    lo, hi = bounds[:-1], np.maximum(bounds[1:] - order + 1, bounds[:-1])
    total = np.zeros((len(lo), values.shape[1]), np.float64)
    full = np.flatnonzero(hi > lo)
    if len(full):
        cuts = np.stack([lo[full], hi[full]], 1).ravel()
        if cuts[-1] == len(values):
            cuts = cuts[:-1]
        total[full] = np.add.reduceat(values, cuts, axis=0, dtype=np.float64)[::2]
    return total, hi - lo


def count_ngrams(labelled: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``lang, feature, n`` summed over all labelled documents."""

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def flush():
            for lang, counts in held.items():
                f = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(f), pa.string()), pa.array(f.astype(np.int32)), pa.array(counts[f])],
                    ["lang", "feature", "n"])
            held.clear()

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, j, data, bounds in common.text_blocks(batch.column(0)):
                for order in ORDERS:
                    f = ngrams(data, order)
                    for r in range(i, j):
                        own = f[bounds[r - i]: max(bounds[r - i + 1] - order + 1, bounds[r - i])]
                        counts = held.setdefault(langs[r], np.zeros(DIM, np.int64))
                        if len(own) > DIM // 8:
                            counts += np.bincount(own, minlength=DIM)
                        else:
                            u, c = np.unique(own, return_counts=True)
                            counts[u] += c
                if len(held) > 16:
                    yield from flush()
        yield from flush()

    parts = (labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
             .mapInArrow(run, "lang string, feature int, n long"))
    return parts.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


class Model:
    """Languages, their code and the weights of its bits."""

    def __init__(self, langs: list[str], weights: np.ndarray):
        self.langs, self.weights = langs, weights

    @property
    def code(self) -> np.ndarray:
        return codewords(len(self.langs))


def bit_sums(counts: DataFrame, totals: list[tuple[str, int]], code: np.ndarray) -> DataFrame:
    """``feature, bits``: per code bit the smoothed shares of the n-gram summed over the
    languages on the bit's side, then over all of them; as exact decimals, so the order of
    rows does not matter."""
    rows = [(lang, float(n + SMOOTHING * DIM), (row > 0).tolist()) for (lang, n), row in zip(totals, code)]
    sides = counts.sparkSession.createDataFrame(rows, "lang string, total double, side array<boolean>")
    share = (F.col("n") / F.col("total") * F.lit(float(UNIT))).cast("decimal(20,0)")
    at = counts.join(sides, "lang").select("feature", "side", share.alias("share"))
    of = [F.sum(F.when(F.col("side")[b], F.col("share"))) for b in range(code.shape[1])] + [F.sum("share")]
    return at.groupBy("feature").agg(F.array(*[F.coalesce(c, F.lit(0)).cast("double") for c in of]).alias("bits"))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from all rows of ``labelled`` with a language."""
    common.prepare(labelled.sparkSession)
    counts = materialize(count_ngrams(labelled, text_col, lang_col), "ngrams")
    known = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang")).distinct()
    totals = (known.join(counts.groupBy("lang").agg(F.sum("n").alias("n")), "lang", "left")
              .select("lang", F.coalesce("n", F.lit(0)).alias("n")).collect())  # one row per language
    totals = sorted((r["lang"], r["n"]) for r in totals)
    code = codewords(len(totals))
    bits = code.shape[1]
    if not bits:
        return Model([lang for lang, _ in totals], np.zeros((DIM, 0), np.float32))
    sums = np.zeros((DIM, bits + 1))
    found = bit_sums(counts, totals, code).toPandas()  # DIM x (bits + 1) numbers at most
    if len(found):
        sums[found["feature"].to_numpy()] = np.stack(found["bits"].to_numpy())
    smooth = SMOOTHING / (np.array([n for _, n in totals], float) + SMOOTHING * DIM)
    side = code > 0
    one = (sums[:, :bits] / UNIT + smooth @ side) / side.sum(0)
    zero = ((sums[:, bits:] - sums[:, :bits]) / UNIT + smooth @ ~side) / (~side).sum(0)
    return Model([lang for lang, _ in totals], np.clip(np.log(one / zero), -CLIP, CLIP).astype(np.float32))


def predict(docs: DataFrame, model: Model, text_col: str = "text", sure: float = SURE, out: str = "_lang") -> DataFrame:
    """``docs`` plus a struct column ``out``: ``lang, score, ambiguous``."""
    spark = docs.sparkSession
    common.prepare(spark)
    sent = spark.sparkContext.broadcast((model.langs, model.weights))  # DIM x code bits, about 10 log2(languages)

    @F.arrow_udf("struct<lang:string,score:double,ambiguous:boolean>")
    def judge(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        langs, weights = sent.value
        code = codewords(len(langs)).astype(np.float64)
        ones = (code > 0).astype(np.float64).T
        for texts in column:
            best, score = [], []
            for i, j, data, bounds in common.text_blocks(texts, 1 << 18):
                total, grams = np.zeros((j - i, code.shape[1])), np.zeros(j - i)
                for order in ORDERS:
                    f = ngrams(data, order)
                    for a in range(0, max(len(f), 1), 1 << 20):  # one very long text at a time
                        if len(f) > 1 << 20:
                            total[0] += weights[f[a: a + (1 << 20)]].sum(0, dtype=np.float64)
                            grams[0] += len(f[a: a + (1 << 20)])
                        else:
                            s, n = _row_sums(weights[f], bounds, order)
                            total += s
                            grams += n
                z = total / np.maximum(grams, 1)[:, None] * np.minimum(grams, FULL_EVIDENCE)[:, None]
                # log(1 + exp(-z)) = log(1 + exp(z)) - z, so only the bits that are one differ
                loss = np.logaddexp(0, z).sum(1)
                letter = np.add.reduceat(np.append(_LETTER[data], False).astype(np.int64), bounds[:-1]) > 0
                letter &= bounds[1:] > bounds[:-1]
                for r in range(j - i):
                    known = bool(langs) and (letter[r] or any(map(str.isalpha, texts[i + r].as_py() or "")))
                    if known:
                        cost = loss[r] - z[r] @ ones
                        at = int(cost.argmin())
                        w = np.exp(cost[at] - cost)
                        best.append(langs[at])
                        score.append(float(1 / w.sum()))
                    else:
                        best.append(UNKNOWN)
                        score.append(0.0)
            yield pa.StructArray.from_arrays(
                [pa.array(best, pa.string()), pa.array(score, pa.float64()),
                 pa.array([s < sure for s in score], pa.bool_())], ["lang", "score", "ambiguous"])

    return docs.withColumn(out, judge(F.col(text_col)))
