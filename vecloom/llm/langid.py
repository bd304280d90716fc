"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its character n-grams (1 to 4, within words and across one
word edge), hashed into BUCKETS rows; a linear layer and softmax follow. Both layers are trained by
stochastic gradient descent in numpy on the driver, on a sample of labelled rows whose size is the
parameter ``sample_rows`` whatever the input (the executors hash the sampled texts; the driver gets
bucket counts). A fifth of the sample calibrates: a temperature is fitted to it, and the rejection
threshold is the score that all but ``reject`` of its rightly predicted rows exceed.

For prediction both layers fold into one table (BUCKETS x languages, broadcast, its size fixed by
the parameters), so a text costs one gather and sum, over the whole text.

Defined cases: a null text or one without a letter (Unicode category L) is ``und`` with score 0; so
is every text if no labelled row can be learned from; a null doc_id is not held out and not learned
from; a null lang is not learned from; repeated rows get equal answers; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, pick

BUCKETS = 1 << 15
DIMENSIONS = 16
CHUNK_CHARS = 200_000
BROADCAST_LANGUAGES = 10_000
_PRIMES = np.array([1, 1000003, 19260817, 122949823], np.uint64)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all n-grams text by text, number of n-grams of each text, number of letters of each)."""
    low = [f" {t.lower()} " for t in texts]  # spaces of its own on both sides: no n-gram reaches into a neighbour
    lengths = np.array([len(t) for t in low])
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    p = np.where(letter, points, 0).astype(np.uint64)
    pad = np.concatenate([p, np.zeros(3, np.uint64)])
    solid = np.concatenate([letter, np.zeros(3, bool)])
    n = len(p)
    keep = [letter, solid[:n] | solid[1 : n + 1], solid[1 : n + 1], solid[1 : n + 1] & solid[2 : n + 2]]
    # An n-gram belongs to the text of its first place; none has two characters in a row that are no letters.
    where, buckets = [], []
    for size in range(4):
        at = np.flatnonzero(keep[size])
        h = np.full(len(at), size + 1, np.uint64)
        for j in range(size + 1):
            h = (h * np.uint64(31) + pad[at + j]) * _PRIMES[j] if j else h * np.uint64(31) + pad[at]
        where.append(at)
        buckets.append(((h * _SPREAD) >> np.uint64(49)).astype(np.int32))
    text_of = np.repeat(np.arange(len(texts)), lengths)
    owner = np.concatenate([text_of[w] for w in where])
    order = np.argsort(owner, kind="stable")
    letters = np.bincount(text_of, weights=letter, minlength=len(texts)).astype(np.int64)
    return np.concatenate(buckets)[order], np.bincount(owner, minlength=len(texts)), letters


@dataclass(frozen=True)
class Model:
    """``table`` folds both layers; ``languages`` empty: nothing was learned."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(counts), len(self.languages)))
        some = np.flatnonzero(counts)
        if len(some):
            starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
            out[some] = np.add.reduceat(self.table[buckets], starts, axis=0, dtype=np.float64) / counts[some, None] + self.bias
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        buckets, counts, letters = features(texts)
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        p = softmax(self.logits(buckets, counts) / self.temperature)
        best = p.argmax(axis=1)
        known = letters > 0
        score = np.where(known, p[np.arange(len(p)), best], 0.0)
        return [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], score.tolist(), (score < self.threshold).tolist()


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def remainder(doc_id="doc_id"):
    """crc32 of the id as text, mod 4; 2 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, lang, text) -> (u, lang, buckets, counts) of each text, and of a stretch of 80 characters from
    its middle, so that short texts are learned too."""
    for batch in batches:
        for u, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            middle = max(0, len(text) // 2 - 40)
            for t in (text, text[middle : middle + 80]):
                found, n = np.unique(features([t])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([u]), pa.array([lang]), pa.array([found.astype(np.int32)]), pa.array([n.astype(np.int32)])], ["u", "lang", "buckets", "counts"])


def sample(docs: DataFrame, sample_rows: int) -> DataFrame:
    """(u, lang, text) of about sample_rows learnable rows, shared out evenly over the languages; chosen by u, a
    hash of the id, which only rows of one id share."""
    d = pick(docs, doc_id="doc_id", text="text", lang="lang")
    d = d.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = d.where((remainder() != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = Table(usable.groupBy("lang").agg(F.count("*").alias("n")), "languages").df
    languages = max(1, counts.count())
    chance = counts.select("lang", (F.lit(float(sample_rows / languages)) / F.col("n")).alias("chance"))
    if languages <= BROADCAST_LANGUAGES:  # texts stay where they are; beyond it, they are shuffled to their language
        chance = F.broadcast(chance)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(11), "doc_id"), 11) / F.lit(float(2**53))
    return usable.withColumn("u", u).join(chance, "lang").where("u < chance").select("u", "lang", "text")


def train(docs: DataFrame, sample_rows: int = 2400, epochs: int = 6, rate: float = 4.0, reject: float = 0.0005, seed: int = 5) -> Model:
    # Texts are hashed where they are. Twice the expected number is taken at most, in order of the hash: that binds only
    # where one id repeats so often that its hash cannot thin it.
    hashed = sample(docs, sample_rows).mapInArrow(_hashed, "u double, lang string, buckets array<int>, counts array<int>")
    rows = hashed.orderBy("u", F.xxhash64("buckets", "counts")).limit(4 * sample_rows).toArrow()
    langs = rows["lang"].to_pylist()
    languages = sorted(set(langs))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    out = np.zeros((DIMENSIONS, len(languages)))
    bias = np.zeros(len(languages))
    at = {c: i for i, c in enumerate(languages)}
    lists = [rows[c].combine_chunks() for c in ("buckets", "counts")]
    (edges, every), (_, times) = ((x.offsets.to_numpy(), x.values.to_numpy()) for x in lists)  # views of what Arrow holds
    part = lambda i: slice(edges[i], edges[i + 1])
    data = []
    for i in sorted(range(len(langs)), key=lambda i: (langs[i], every[part(i)].tobytes())):
        b, n = every[part(i)], times[part(i)]
        if len(b):
            data.append((at[langs[i]], b, (n / n.sum()).astype(np.float32)))
    folds = rng.permutation(len(data))
    held, learn = folds[: len(data) // 5], folds[len(data) // 5 :]
    steps, step = max(1, epochs * len(learn)), 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            y, b, w = data[i]
            h = w @ emb[b]
            g = softmax((h @ out + bias)[None])[0]
            g[y] -= 1
            lr = rate * (1 - step / steps)
            down = out @ g
            out -= lr * np.outer(h, g)
            bias -= 0.05 * lr * g
            emb[b] -= lr * np.outer(w, down)
            step += 1
    table = emb @ out
    if not len(held):
        held = learn
    z = np.array([data[i][2] @ table[data[i][1]] + bias for i in held]).reshape(-1, len(languages))
    y = np.array([data[i][0] for i in held], int)
    temperature, threshold = 1.0, 0.0
    if len(y):
        grid = np.geomspace(0.1, 10, 60)
        loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
        if len(right):
            threshold = min(0.5, float(right[int(reject * len(right))]))
    return Model(tuple(languages), table.astype(np.float32), bias, temperature, threshold)


def annotate(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected appended (replacing columns so named)."""
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    rows = pick(docs, **{f"c{i}": c for i, c in enumerate(names)})
    where = names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"c{i} {t}" for i, (_, t) in enumerate(rows.dtypes)), "lang_pred string, score double, rejected boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(where).to_pylist()]
            made: tuple[list, list, list] = ([], [], [])
            first = 0
            while first < len(texts):
                size, last = 0, first
                while last < len(texts) and (last == first or size + len(texts[last]) <= CHUNK_CHARS):
                    size += len(texts[last])
                    last += 1
                for whole, part in zip(made, m.predict(texts[first:last]), strict=True):
                    whole.extend(part)
                first = last
            columns = [pa.array(made[0], pa.string()), pa.array(made[1], pa.float64()), pa.array(made[2], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, schema).toDF(*names, "lang_pred", "score", "rejected")


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; the model is learned from ``docs`` if not given."""
    model = model or train(docs)
    d = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The text stays in the worker: only the id comes back with the answer.
    found = annotate(d, model)
    return found.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def known(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not rejected."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    where = names.index("text")
    found = annotate(plain.withColumn(f"c{where}", F.col(f"c{where}").cast("string")), model or train(docs), f"c{where}")
    return found.where(~F.col("rejected")).drop("lang_pred", "score", "rejected").toDF(*names)
