"""Quality classifier: nearest-neighbour voting in a latent semantic space.

A text's terms are its words (lower case, hashed), the rough shapes of its words and marks for words
that repeat the one before them or a run of three words seen earlier in the text.  Term counts are damped,
weighted by inverse document frequency, and reduced by a truncated singular value decomposition fitted
on the labelled sample (at most ``SAMPLE`` labelled rows).  The labelled vectors, at most ``SAMPLE`` times
``DIM`` numbers, are broadcast; for every document the cosines with all of them are computed in blocks,
and the ``NEIGHBOURS`` nearest vote with their labels, weighted by a power of the cosine.

The sample is the labelled rows with the smallest seeded hashes of doc_id; only their sparse term counts
reach the driver.  Scoring covers whole texts of all documents in one pass without a shuffle.

Defined cases: null and empty texts have no terms and get the share of label 1 in the sample; without any
label the score is 0.5; a doc_id labelled more than once counts with its mean label; repeated rows are
scored alike; an empty table gives an empty table; columns other than doc_id and text are never read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import chunks, column, hash_words, rolling, words_of

WORDS, SHAPES, MARKS = 2048, 512, 2
TERMS = WORDS + SHAPES + MARKS
#: Weights of the three families of terms.
FAMILY = (1.0, 2.0, 3.0)
DIM, NEIGHBOURS, POWER = 48, 25, 4
SAMPLE, SEED, BLOCK = 8192, 71, 1024
CHUNK_CHARS = 1_500_000



class _Kinds(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        return kind


KINDS, REPEAT = _Kinds(), re.compile(r"(.)\1+", re.S)


def shape(word: str) -> str:
    """Letters and digits of the whole word as runs: ``A`` for capitals, ``a`` for other letters, ``0``; runs of one sign as one.

    Over 40 runs stand as a hash of all of them.
    """
    runs = REPEAT.sub(r"\1", word.translate(KINDS))
    return runs if len(runs) <= 40 else str(hash_words([runs])[0])


def terms(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse damped term counts of a chunk of texts: text numbers, terms, values."""
    offsets, ids, names = words_of(texts)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    h = hash_words(names)
    low = (hash_words([w.lower() for w in names]) % np.uint64(WORDS)).astype(np.int64)
    shapes: dict[str, int] = {}
    kind = [shapes.setdefault(shape(w), len(shapes)) for w in names]
    form = (hash_words(list(shapes)) % np.uint64(SHAPES)).astype(np.int64)[kind] + WORDS if names else low
    again = np.zeros(len(ids), bool)
    again[1:] = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
    key = [doc * TERMS + low[ids], doc * TERMS + form[ids], doc[again] * TERMS + WORDS + SHAPES]
    if len(ids) >= 3:
        tri = rolling(h[ids], 3)
        at = np.nonzero(doc[2:] == doc[:-2])[0]
        both = tri[at] ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(both, kind="stable")
        later = np.zeros(len(at), bool)
        later[order[1:]] = both[order[1:]] == both[order[:-1]]
        key.append(doc[at[later]] * TERMS + WORDS + SHAPES + 1)
    key, count = np.unique(np.concatenate(key), return_counts=True)
    doc, term = key // TERMS, key % TERMS
    size = np.maximum(np.diff(offsets), 1)[doc]
    family = np.array(FAMILY)[(term >= WORDS).astype(int) + (term >= WORDS + SHAPES)]
    # Shapes and marks as shares of the text, so that length does not matter; words damped.
    value = np.where(term < WORDS, (1 + np.log(count)) / (1 + np.log(size)), np.sqrt(count / size)) * family
    return doc, term, value.astype(np.float32)


class Model:
    """Inverse document frequencies, projection, and the labelled vectors with their labels."""

    def __init__(self, idf, project, vectors, labels):
        self.idf, self.project, self.vectors, self.labels = idf, project, vectors, labels
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def dense(self, doc, term, value, n):
        x = np.zeros((n, TERMS), np.float32)
        x[doc, term] = value * self.idf[term]
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
        return x

    def score(self, doc, term, value, n) -> np.ndarray:
        out = np.full(n, self.prior)
        if not len(self.labels):
            return out
        z = self.dense(doc, term, value, n) @ self.project
        norm = np.linalg.norm(z, axis=1)
        some = np.nonzero(norm > 1e-6)[0]
        z = z[some] / norm[some, None]
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(some), 512):
            cos = z[i : i + 512] @ self.vectors.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cos, near, axis=1), 0).astype(np.float64) ** POWER
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1)
            out[some[i : i + 512]] = np.where(total > 0, vote / np.maximum(total, 1e-12), self.prior)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``labels`` (doc_id, quality) and the texts in ``docs`` that they name."""
    some = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
        .orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most ``sample`` rows

    def sparse(batches):
        for b in chunks(batches, chars=CHUNK_CHARS):
            doc, term, value = terms(column(b, "text"))
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (term.astype(np.int32), value)]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "quality"), *lists], ["doc_id", "quality", "term", "value"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(sparse, f"doc_id {kind}, quality double, term array<int>, value array<float>")
    found = found.groupBy("doc_id").agg(F.min_by(F.struct("quality", "term", "value"), F.xxhash64("term")).alias("x")).select("doc_id", "x.*").toArrow()
    found = found.sort_by("doc_id").combine_chunks()
    n = found.num_rows
    label = found.column("quality").to_numpy() if n else np.empty(0)
    if not n:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, DIM), np.float32), np.zeros((0, DIM), np.float32), label)
    lists = found.column("term").combine_chunks()
    doc = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
    term = lists.flatten().to_numpy().astype(np.int64)
    value = found.column("value").combine_chunks().flatten().to_numpy()
    df = np.bincount(term, minlength=TERMS)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
    model = Model(idf, None, None, label)
    cut = np.searchsorted(doc, np.arange(0, n + BLOCK, BLOCK))

    def blocks():
        """Dense rows of the sample, a block at a time."""
        for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            yield slice(i * BLOCK, min(n, (i + 1) * BLOCK)), model.dense(doc[a:b] - i * BLOCK, term[a:b], value[a:b], min(BLOCK, n - i * BLOCK))

    rng = np.random.default_rng(SEED)
    q = rng.standard_normal((TERMS, DIM + 16)).astype(np.float32)
    for _ in range(4):  # subspace iteration
        q, _ = np.linalg.qr(sum(x.T @ (x @ q) for _, x in blocks()))
    seen = np.empty((n, q.shape[1]), np.float32)
    for part, x in blocks():
        seen[part] = x @ q
    _, _, vt = np.linalg.svd(seen, full_matrices=False)
    model.project = (q @ vt.T)[:, :DIM].astype(np.float32)
    z = (seen @ vt.T)[:, :DIM]
    norm = np.linalg.norm(z, axis=1)
    keep = norm > 1e-6
    model.vectors, model.labels = (z[keep] / norm[keep, None]).astype(np.float32), label[keep]
    return model


def scores(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every document and its ``_lw_score``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    cols = list(dict.fromkeys([*keep, "text"]))

    def run(batches):
        model = shipped.value
        for b in chunks(batches, chars=CHUNK_CHARS):
            value = model.score(*terms(column(b, "text")), b.num_rows)
            yield pa.RecordBatch.from_arrays([*[column(b, c) for c in keep], pa.array(value, pa.float64())], [*keep, "_lw_score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*cols).mapInArrow(run, f"{kinds}, _lw_score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def accept(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, with their columns, that score at least ``threshold``; trained without held-out rows."""
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return scores(docs, model, tuple(docs.columns)).filter(F.col("_lw_score") >= threshold).select(*docs.columns)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return scores(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lw_score").alias("score"), (F.col("_lw_score") >= 0.5).cast("int").alias("predicted"))
