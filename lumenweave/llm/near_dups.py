"""MinHash near-duplicates by ProbMinHash, banding and exact verification.

Shingles are runs of five words (a shorter text is one shingle), weighted by how often the text holds them.
Similarity is the probability Jaccard of these weights: the sum over shared shingles i of 1 / sum over all j of
max(x_j / x_i, y_j / y_i).  For texts that hold each of their shingles equally often it is plain Jaccard.  Every
shingle sends a seeded Poisson process of arrivals, of a rate equal to its weight, to random registers; a
register keeps the shingle of its earliest arrival.  A process is cut off beyond a bound, and the bound is
doubled for the texts that still have an empty register, so no later arrival could have counted.  Two texts
agree in a register with the probability of their similarity.  ``weighted=False`` gives every distinct shingle
the weight 1.

Equal texts are collapsed first.  Registers form bands; texts that agree in a band share a bucket.  In
each bucket every member is paired with one representative, so rows stay linear in a bucket's size:
first each text with the representative that it shares most bands with, then with its others as far as
they lie in other components.  Pairs are verified by the exact similarity (0.8 or more); verified pairs
make links, and classes are their connected components, found by minimum labels with pointer jumping.
Later links only merge the classes known so far.  Buckets that still hold several components are then
searched whole: the members outside a bucket's largest component meet all its members, dealt into blocks
of bounded size, each pair of blocks a task that compares all their shingles at once and returns only links
that join components.  So every pair that shares a bucket is either in one class or verified, and no task
or row count holds all pairs.  Hot buckets meet only joins that Spark can split and aggregates that
combine before the shuffle; nothing is collected.

Defined cases: a null text is in a class of its own; texts without words are copies of each other if
equal; repeated rows share a class; an empty table gives an empty table; ``class_id`` is the smallest
doc_id of the class (null only if all are null); other columns pass through ``keep_one`` untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import chunks, column, give_back, hash_words, mix64, rolling, words_of
from .common import P, broadcast_if_small, save, with_nodes

SHINGLE, SIMILARITY = 5, 0.8
#: 32 bands of 4 registers find a pair of similarity 0.8 with probability 1 - 5e-8.
BANDS, ROWS = 32, 4
#: Members of a bucket in one block of the whole search, and bands that are searched between two updates.
BLOCK, BANDS_AT_ONCE = 256, 8
BROADCAST_TEXTS = 1_000_000


def shingles(texts, k: int = SHINGLE, weighted: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers, hashes and weights of distinct shingles (sorted), and the count for each text."""
    offsets, ids, names = words_of(texts)
    n = len(offsets) - 1
    size = np.diff(offsets)
    h = hash_words(names)[ids] if len(ids) else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(n), size)
    roll = rolling(h, k)
    at = np.nonzero(doc[: len(roll)] == doc[k - 1 :])[0] if len(roll) else np.empty(0, np.int64)
    docs, marks = [doc[at]], [roll[at]]
    for i in np.nonzero((size > 0) & (size < k))[0].tolist():
        x = np.uint64(size[i])
        for w in h[offsets[i] : offsets[i + 1]]:
            x = mix64(np.array([x ^ w], np.uint64))[0]
        docs.append(np.array([i]))
        marks.append(np.array([x], np.uint64))
    doc, mark = np.concatenate(docs), np.concatenate(marks)
    order = np.lexsort((mark, doc))
    doc, mark = doc[order], mark[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
    weight = np.diff(np.append(np.nonzero(first)[0], len(doc))).astype(np.float64) if weighted else np.ones(int(first.sum()))
    doc, mark = doc[first], mark[first]
    return doc, mark, weight, np.bincount(doc, minlength=n)


def probability_jaccard(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
    """Similarity of two weighted sets, given as sorted hashes and weights.

    For a shared shingle of ratio r = y_i / x_i, a shingle j counts x_j / x_i if its own ratio is at most r, else
    y_j / y_i; running sums over the sorted ratios give both parts.
    """
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    hit = y[at] == x
    a, b = wx[hit], wy[at[hit]]
    if not len(a):
        return 0.0
    if (wx == wx[0]).all() and (wy == wy[0]).all():
        return len(a) / (len(x) + len(y) - len(a))
    ratio = b / a
    order = np.argsort(ratio)
    below = np.concatenate(([0.0], np.cumsum(a[order])))[np.searchsorted(ratio[order], ratio, side="right")] + (wx.sum() - a.sum())
    above = np.concatenate((np.cumsum(b[order][::-1])[::-1], [0.0]))[np.searchsorted(ratio[order], ratio, side="right")] + (wy.sum() - b.sum())
    return float((1 / (below / a + above / b)).sum())


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def probminhash(doc: np.ndarray, mark: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Registers (n, m) of texts 0..n-1: hashes of winning shingles; 0 for a text without shingles."""
    out = np.zeros(n * m, np.uint64)
    rate = np.bincount(doc, weights=weight, minlength=n)
    bound = np.where(rate > 0, m * (np.log(m) + 4) / np.maximum(rate, 1e-300), 0)
    todo = rate > 0
    while todo.any():
        live = todo[doc]
        d, s, w, t = doc[live], mark[live], weight[live], np.zeros(int(live.sum()))
        best = np.full(n * m, np.inf)
        i = 0
        while len(d):
            i += 1
            t = t - np.log(_uniform(mix64(s + np.uint64(2 * i)))) / w
            on = t <= bound[d]
            d, s, w, t = d[on], s[on], w[on], t[on]
            slot = d * m + (mix64(s ^ mix64(np.array([2 * i + 1], np.uint64))) % np.uint64(m)).astype(np.int64)
            np.minimum.at(best, slot, t)
            won = best[slot] == t
            out[slot[won]] = s[won]
        filled = np.isfinite(best.reshape(n, m)).all(axis=1)
        todo &= ~filled
        bound = np.where(todo, 2 * bound, bound)
    return out.reshape(n, m)


def most_alike(x, y, xc, yc):
    """An upper bound of the similarity from the total and the shared weights of both: exact for equal weights.

    A shared shingle's term is at most 1 / (x / x_i + (y - yc) / y_i), which is concave and homogeneous in its weights,
    so that the sum of terms is at most the term of the sums.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((xc > 0) & (yc > 0), 1 / (x / xc + y / yc - 1), 0.0)


def alike(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray, similarity: float = SIMILARITY) -> bool:
    if min(len(x), len(y)) == 0:
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    hit = y[at] == x
    if most_alike(wx.sum(), wy.sum(), wx[hit].sum(), wy[at[hit]].sum()) < similarity - 1e-9:
        return False
    return probability_jaccard(x, wx, y, wy) >= similarity - 1e-12


def signatures(rows: DataFrame, bands: int = BANDS, per: int = ROWS, weighted: bool = True) -> DataFrame:
    """doc_id, node and band hashes of every row with a text and a word."""

    def run(batches):
        for b in chunks(batches):
            doc, mark, weight, size = shingles(column(b, "text"), weighted=weighted)
            reg = probminhash(doc, mark, weight, b.num_rows, bands * per).reshape(b.num_rows, bands, per)
            x = np.zeros((b.num_rows, bands), np.uint64)
            for i in range(per):
                x = mix64(x ^ reg[:, :, i]) + np.arange(bands, dtype=np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * bands), pa.array(x.reshape(-1).view(np.int64)))
            lists = pc.if_else(pa.array(size > 0), lists, pa.nulls(b.num_rows, lists.type))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, P + "t"), lists], ["doc_id", "t", "bands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", P + "t", "text").mapInArrow(run, f"doc_id {kind}, t long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, weighted: bool = True, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    both = pairs.select("a", "b").join(texts.select(F.col("t").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("t").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches):
        for batch in batches:
            for b in chunks([batch], "ta"):
                n = b.num_rows
                base = column(b, "tb").dictionary_encode()
                doc, mark, weight, size = shingles(pa.concat_arrays([column(b, "ta"), base.dictionary.cast(column(b, "ta").type)]), weighted=weighted)
                cut = np.searchsorted(doc, np.arange(len(size) + 1))
                part = lambda i: (mark[cut[i] : cut[i + 1]], weight[cut[i] : cut[i + 1]])  # noqa: B023, E731
                other = base.indices.to_numpy() + n
                ok = np.array([alike(*part(i), *part(j), similarity) for i, j in enumerate(other.tolist())], bool)
                keep = pa.array(ok)
                yield pa.RecordBatch.from_arrays([column(b, "a").filter(keep), column(b, "b").filter(keep)], ["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Node ``t`` and ``label``, the smallest node of its connected component, for all nodes of the edges."""
    edges = save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = save(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("t"), F.least("a", "m").alias("label")), "near-labels")
    while True:
        near = edges.join(labels.withColumnRenamed("t", "b"), "b").groupBy("a").agg(F.min("label").alias("m")).withColumnRenamed("a", "t")
        low = labels.join(near, "t").select("t", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("t").alias("label"), F.col("label").alias("top"))
        fresh = save(low.join(up, "label", "left").select("t", "old", F.least("label", F.coalesce("top", "label")).alias("label")), "near-labels")
        done = fresh.filter("old <> label").limit(1).count() == 0
        labels = fresh.select("t", "label")
        if done:
            return labels


def _products(doc: np.ndarray, place: np.ndarray, value: np.ndarray, other: np.ndarray, left: np.ndarray, width: int = 8192) -> np.ndarray:
    """Inner products of the rows that ``left`` marks, by ``value``, with the others, by ``other``; ``place`` is sorted."""
    rows, cols = (np.cumsum(z) - 1 for z in (left, ~left))
    out = np.zeros((int(left.sum()), int((~left).sum())), np.float32)
    cut = np.searchsorted(place, np.arange(0, (place[-1] + 1 if len(place) else 0) + width, width))
    for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        if b > a:
            x, y = np.zeros((out.shape[0], width), np.float32), np.zeros((out.shape[1], width), np.float32)
            d, at, mine = doc[a:b], place[a:b] - i * width, left[doc[a:b]]
            x[rows[d[mine]], at[mine]] = value[a:b][mine]
            y[cols[d[~mine]], at[~mine]] = other[a:b][~mine]
            out += x @ y.T
    return out


def _spanning(doc: np.ndarray, mark: np.ndarray, weight: np.ndarray, left: np.ndarray, label: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links from texts that ``left`` marks to others that join different labels: as few as connect them.

    Products of weights with shared shingles bound all similarities at once (exactly where a text's weights are
    equal); only pairs within the bound are computed one by one.
    """
    n = len(left)
    size = np.bincount(doc, minlength=n)
    cut = np.searchsorted(doc, np.arange(n + 1))
    total = np.bincount(doc, weights=weight, minlength=n)
    plain = np.bincount(doc, weights=weight * weight, minlength=n) * size == total * total
    order = np.argsort(mark, kind="stable")
    new = np.concatenate(([True], mark[order][1:] != mark[order][:-1])) if len(mark) else np.empty(0, bool)
    place = np.cumsum(new) - 1
    shared = np.bincount(place) > 1 if len(place) else np.empty(0, bool)
    keep = shared[place]
    place, d, w = (np.cumsum(shared) - 1)[place[keep]], doc[order][keep], weight[order][keep]
    one = np.ones(len(d))
    rows, cols = np.nonzero(left)[0], np.nonzero(~left)[0]
    both = plain[rows][:, None] & plain[cols]
    if both.all():
        common = _products(d, place, one, one, left)
        near = (common > 0) & (common >= similarity * (size[rows][:, None] + size[cols] - common))
    else:
        near = most_alike(total[rows][:, None], total[cols], _products(d, place, w, one, left), _products(d, place, one, w, left)) >= similarity - 1e-4
    sure = bool(both.all())
    root = np.unique(label, return_inverse=True)[1]
    out = []
    for r, i in enumerate(rows.tolist()):
        for c in np.nonzero(near[r])[0].tolist():
            j = int(cols[c])
            if root[i] != root[j]:
                x, y = slice(cut[i], cut[i + 1]), slice(cut[j], cut[j + 1])
                if sure or alike(mark[x], weight[x], mark[y], weight[y], similarity):
                    out.append((i, j))
                    root[root == root[j]] = root[i]
    return out


def _searched(buckets: DataFrame, texts: DataFrame, weighted: bool = True, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between components inside whole buckets (h, t, label; main: the largest component, n and m: all members and those outside it)."""
    block = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    mine = lambda c: F.pmod(F.xxhash64(F.lit(3), "t"), block(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), block(c) - 1))
    outside = buckets.filter("label <> main").select("h", "t", "label", F.lit(True).alias("left"), mine("m").alias("i"), every("n").alias("j"))
    members = buckets.select("h", "t", "label", F.lit(False).alias("left"), mine("n").alias("j"), every("m").alias("i"))
    rows = outside.unionByName(members).join(texts, "t")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("t", "ascending"), ("left", "ascending")])
        doc, mark, weight, _ = shingles(table.column("text").combine_chunks(), weighted=weighted)
        t = table.column("t").to_numpy()
        pairs = _spanning(doc, mark, weight, table.column("left").to_numpy(), table.column("label").to_numpy(), similarity)
        a, b = ([int(t[p[k]]) for p in pairs] for k in (0, 1))
        give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("h", "i", "j").applyInArrow(run, "a long, b long")


def _links(rows: DataFrame, sig: DataFrame, weighted: bool = True) -> DataFrame:
    """Labels of all texts that share a bucket with another."""
    own = save(sig.filter("t is not null and bands is not null").groupBy("t").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("doc_id")), "near-texts")
    member = own.select("t", F.posexplode("bands").alias("k", "h")).select("t", "k", F.xxhash64("k", "h").alias("h"))
    # Written first, so that the join below is of plain exchanges and Spark can split a hot bucket.
    full = save(member.groupBy("h").agg(F.min("t").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "rep", "n"), "near-full")
    member = save(member.join(full, "h"), "near-buckets")
    pairs = save(member.filter("t <> rep").groupBy(F.col("t").alias("a"), F.col("rep").alias("b")).agg(F.count(F.lit(1)).alias("n")), "near-pairs")
    labels = save(member.select("t").distinct().select("t", F.col("t").alias("label")), "near-labels")
    named = save(labels.join(own.select("t", "doc_id"), "t").select(F.col("t").alias("c"), F.col("doc_id").alias("d")), "near-named")
    texts = rows.select(P + "t", "doc_id", "text").join(broadcast_if_small(named, BROADCAST_TEXTS), (F.col(P + "t") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("d")))
    texts = save(texts.groupBy(F.col(P + "t").alias("t")).agg(F.first("text").alias("text")), "near-pair-texts")
    lab = lambda c: labels.select(F.col("t").alias(c), F.col("label").alias("l" + c))

    def link(found: DataFrame) -> None:
        """Merge the classes that verified pairs join."""
        nonlocal labels
        found = save(found, "near-verified")
        between = save(found.join(lab("a"), "a").join(lab("b"), "b").filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "near-between")
        if between.limit(1).count():
            merged = broadcast_if_small(components(between).select(F.col("t").alias("label"), F.col("label").alias("top")), BROADCAST_TEXTS)
            labels = save(labels.join(merged, "label", "left").select("t", F.coalesce("top", "label").alias("label")), "near-labels")

    best = pairs.groupBy("a").agg(F.max(F.struct("n", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    link(verified(best, texts, weighted))
    todo = pairs.select("a", "b").join(best, ["a", "b"], "left_anti").join(lab("a"), "a").join(lab("b"), "b")
    link(verified(todo.filter("la <> lb"), texts, weighted))
    several = member.filter("n > 2")  # the one pair of a bucket of two is verified
    for k in range(0, BANDS, BANDS_AT_ONCE):
        here = several.filter(F.col("k").between(k, k + BANDS_AT_ONCE - 1)).select("h", "t").join(labels, "t")
        held = here.groupBy("h", "label").agg(F.count(F.lit(1)).alias("x"))
        mixed = held.groupBy("h").agg(F.max(F.struct("x", "label")).alias("top"), F.sum("x").alias("n"), F.count(F.lit(1)).alias("c")).filter("c > 1")
        mixed = save(mixed.select("h", F.col("top.label").alias("main"), "n", (F.col("n") - F.col("top.x")).alias("m")), "near-several")
        here = save(here.join(mixed, "h"), "near-mixed")
        if here.limit(1).count():
            link(_searched(here, texts, weighted))
    return labels


def classes(docs: DataFrame, weighted: bool = True) -> DataFrame:
    """Per row: doc_id, node ``t`` (null without text), ``label`` of its class and ``class_id``."""
    rows = with_nodes(docs.select("doc_id", "text"))
    sig = save(signatures(rows, weighted=weighted), "near-signatures")
    labels = _links(rows, sig, weighted)
    own = sig.filter("t is not null").groupBy("t").agg(F.min("doc_id").alias("first"))
    named = own.join(labels, "t", "left").select("t", "first", F.coalesce("label", "t").alias("label"))
    named = save(named, "near-texts-named")
    top = save(named.groupBy("label").agg(F.min("first").alias("class_id")), "near-tops")
    named = named.select("t", "label").join(top, "label")
    out = sig.select("doc_id", "t").join(named, "t", "left")
    return out.select("doc_id", "t", "label", F.when(F.col("t").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def class_report(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()).alias("kept"))


def keep_one(docs: DataFrame, weighted: bool = True) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id.  Rows with a null text all stay."""
    cls = save(classes(docs, weighted), "near-classes")
    kept = cls.filter("t is not null and doc_id <=> class_id").groupBy("doc_id", "label").agg(F.min("t").alias("t"), F.count(F.lit(1)).alias("n"))
    kept = save(kept, "near-kept")
    want = kept.select(F.col("doc_id").alias(P + "d"), F.col("t").alias(P + "k"), (F.col("n") > 1).alias(P + "again"))
    rows = with_nodes(docs)
    joined = rows.join(want, rows[P + "t"].eqNullSafe(F.col(P + "k")) & rows["doc_id"].eqNullSafe(F.col(P + "d")), "left")
    null, once = rows[P + "t"].isNull(), F.col(P + "again") == F.lit(False)
    out = joined.filter(null | once).select(*[docs[c] for c in docs.columns])
    if kept.filter("n > 1").limit(1).count():  # repeated rows: one of each
        again = joined.filter(F.col(P + "again")).dropDuplicates([P + "d", P + "k"]).select(*[docs[c] for c in docs.columns])
        out = out.unionByName(again)
    return out
