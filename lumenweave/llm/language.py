"""Language identification by hyperdimensional profiles.

Every letter has a seeded random vector of +1 and -1 in ``DIM`` dimensions.  A trigram's vector binds
its letters: the elementwise product of the first letter's vector permuted (rotated) twice, the second's
permuted once and the third's as it is.  A text's vector bundles (adds) the vectors of its trigrams,
each by the square root of its count; word edges count as a letter.  A language's prototype bundles the
unit vectors of its training texts, less the mean over languages, and a text gets the language whose
prototype has the largest cosine.

Letters fall into 128 slots: a to z and other frequent Latin letters have their own, all others share by
hash.  Prototypes are learned from all documents with a language, or, beyond ``TRAIN_DOCS`` of them, from a seeded
hash sample of each language: an equal share of ``TRAIN_DOCS`` (``LANG_DOCS`` at least) in expectation, and all
documents of a language that has no more, so that none drops out as the table grows; per partition only sums in ``DIM`` dimensions leave a task.
Prediction covers whole texts of all documents in one pass without a shuffle.

Defined cases: a null text or one without a letter is ``und`` with score 0; ties go to the language
first in order; if no language can be learned all texts are ``und``; repeated rows are predicted alike;
an empty table gives an empty table; columns other than doc_id, text and lang are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import chunks, column
from .common import P, broadcast_if_small, save

DIM, SEED, SLOTS = 512, 20_240, 128
TRAIN_DOCS = 40_000
#: Rows of each language in the sample at least, if it has as many.
LANG_DOCS, BROADCAST_LANGS = 5_000, 100_000
CHUNK_CHARS = 1_500_000
EDGE = 0


def _slots() -> np.ndarray:
    """Slot of every code point up to 0xFFFF: 0 for what is no letter, 1 to 127 for lower-case letters."""
    own = "abcdefghijklmnopqrstuvwxyzßàáâäãåæçèéêëìíîïñòóôöõøùúûüýÿœ"
    table = np.zeros(0x10000, np.uint8)
    for i in range(0x10000):
        if not 0xD800 <= i < 0xE000 and (c := chr(i)).isalpha():
            k = own.find(c)
            table[i] = 1 + k if k >= 0 else 1 + len(own) + (i * 2654435761 >> 7) % (SLOTS - 1 - len(own))
    return table


class Space:
    """Trigram vectors and counts."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.letters = rng.choice(np.array([-1, 1], np.int8), (SLOTS, DIM))
        self.twice, self.once = np.roll(self.letters, 2, axis=1), np.roll(self.letters, 1, axis=1)
        self.table = _slots()

    def vectors(self, tri: np.ndarray) -> np.ndarray:
        return (self.twice[tri >> 14] * self.once[tri >> 7 & 127] * self.letters[tri & 127]).astype(np.float32)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text numbers, trigrams and their counts, sorted; and whether each text has a letter."""
        lower = [t.lower() for t in texts]
        size = np.array([len(t) + 2 for t in lower])
        code = np.frombuffer((" " + "  ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        slot = self.table[np.minimum(code, 0xFFFF)]
        high = code > 0xFFFF
        if high.any():
            at = np.nonzero(high)[0]
            slot[at] = [100 + int(c) % 27 if chr(int(c)).isalpha() else 0 for c in code[at]]
        doc = np.repeat(np.arange(len(texts)), size)
        keep = np.ones(len(slot), bool)
        keep[1:] = (slot[1:] != EDGE) | (slot[:-1] != EDGE) | (doc[1:] != doc[:-1])  # runs of other characters are one edge
        slot, doc = slot[keep].astype(np.int64), doc[keep]
        letters = np.bincount(doc[slot != EDGE], minlength=len(texts)) > 0
        tri = slot[:-2] << 14 | slot[1:-1] << 7 | slot[2:]
        inside = (doc[:-2] == doc[2:]) & (slot[1:-1] != EDGE)
        key = doc[:-2][inside] << 21 | tri[inside]
        key, n = np.unique(key, return_counts=True)
        return key >> 21, key & (1 << 21) - 1, n, letters

    def bundles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector of each text (zero without letters), and whether it has a letter."""
        doc, tri, n, letters = self.counts(texts)
        kinds, place = np.unique(tri, return_inverse=True)
        vec = self.vectors(kinds)
        out = np.empty((len(texts), DIM), np.float32)
        step = max(1, 8_000_000 // max(1, len(kinds)))
        cut = np.searchsorted(doc, np.arange(0, len(texts) + step, step))
        for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            rows = min(step, len(texts) - i * step)
            if rows <= 0:
                break
            dense = np.zeros((rows, len(kinds)), np.float32)
            dense[doc[a:b] - i * step, place[a:b]] = np.sqrt(n[a:b])
            out[i * step : i * step + rows] = dense @ vec
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(norm, 1e-9), letters


_SPACE: list[Space] = []


def space() -> Space:
    if not _SPACE:
        _SPACE.append(Space())
    return _SPACE[0]


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from rows with a language."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = save(rows.groupBy(F.col("lang").alias(P + "lang")).agg(F.count(F.lit(1)).alias(P + "n")), "lang-sizes")
    n, kinds = sizes.select(F.coalesce(F.sum(P + "n"), F.lit(0)), F.count(F.lit(1))).first()
    if n > train_docs:
        most = max(train_docs // kinds, LANG_DOCS)
        rows = rows.join(broadcast_if_small(sizes, BROADCAST_LANGS), F.col("lang") == F.col(P + "lang"))
        rows = rows.filter((F.col(P + "n") <= most) | (F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < F.lit(most) / F.col(P + "n") * (1 << 30)))

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for b in chunks(batches, chars=CHUNK_CHARS):
            vec, letters = space().bundles(column(b, "text").to_pylist())
            lang = np.array(column(b, "lang").to_pylist(), object)
            for k in set(lang.tolist()):
                mine = vec[(lang == k) & letters]
                total[k] = total.get(k, 0) + np.concatenate((mine.sum(axis=0, dtype=np.float64), [len(mine)]))
        if total:
            names = sorted(total)
            size = DIM + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(names, object), size).tolist(), pa.string()), pa.array(np.tile(np.arange(size), len(names)), pa.int32()), pa.array(np.concatenate([total[k] for k in names]), pa.float64())],
                ["lang", "at", "x"],
            )

    parts = rows.select("text", "lang").mapInArrow(sums, "lang string, at int, x double")
    found = parts.groupBy("lang", "at").agg(F.sum("x").alias("x")).toPandas()
    if found.empty:
        return [], np.empty((0, DIM), np.float32)
    table = found.pivot(index="lang", columns="at", values="x").sort_index()
    seen = table[DIM].to_numpy() > 0
    names = [k for k, ok in zip(table.index, seen, strict=True) if ok]
    proto = table.to_numpy()[seen][:, :DIM] / table[DIM].to_numpy()[seen][:, None]
    if len(names) > 1:
        proto = proto - proto.mean(axis=0)
    norm = np.linalg.norm(proto, axis=1, keepdims=True)
    return names, (proto / np.maximum(norm, 1e-9)).astype(np.float32)


def predict(docs: DataFrame, names: list[str], proto: np.ndarray) -> DataFrame:
    """Per document: doc_id, ``lang_pred`` and ``score`` (the best cosine, 0 if negative)."""
    shipped = docs.sparkSession.sparkContext.broadcast((names, proto))

    def run(batches):
        names, proto = shipped.value
        for b in chunks(batches, chars=CHUNK_CHARS):
            vec, letters = space().bundles(pc.fill_null(column(b, "text"), "").to_pylist())
            known = letters & bool(names)
            cos = vec @ proto.T if names else np.zeros((len(vec), 1))
            best = cos.argmax(axis=1)
            lang = [names[i] if ok else "und" for i, ok in zip(best.tolist(), known.tolist(), strict=True)]
            score = np.where(known, np.clip(cos.max(axis=1), 0, 1), 0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    names, proto = learn(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, names, proto).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
