"""Substring deduplication with suffix automata of reference shards.

A window is ``WINDOW`` consecutive words.  Every word covered by a window that also starts anywhere else in
the corpus is removed.  The corpus is its own reference, so sending automata of all its shards to all
documents would be quadratic; instead, what a document streams against a shard is only what can match it.

1. Each window has a minimizer: the smallest hash among its runs of ``GRAM`` words, leftmost on ties.  Equal
   windows have equal minimizers.  Consecutive windows with one minimizer form a segment (at most 28 windows).
2. Minimizers that occur in one segment only are dropped; what is left is a small part of the corpus.
3. Segments go to the shard of their minimizer, equal ones collapsed into one with a weight.  A task reads
   its shard in bounded blocks of whole minimizer groups, builds the block's suffix automaton over words with
   occurrence weights, streams each segment through it for matching statistics (the longest suffix at each
   position that occurs twice or more) and reports the windows that reach the threshold.
4. Per document, reported windows merge into maximal spans, which are removed from the text in one last pass.

A minimizer with more than ``MAX_VARIANTS`` distinct segments is split further: its segments are cut into the
windows that reach 16 words or more to the left of the minimizer and those that reach fewer, and dealt by the words
that all such windows share.  Equal cuts collapse, and groups that are still too large are cut again, by 8, 4, 2 and
1, which leaves equal windows.  A step makes at most two rows of one, and no group grows with the corpus.  Lists of regions and
spans per text are broadcast only if a count shows that they are few, and joined by a shuffle otherwise.

Defined cases: null text is empty, with no words; texts shorter than a window keep all words; copies and
repeated rows count as occurrences of their own; an empty table gives an empty table; ``remove`` passes
other columns through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import chunks, column, give_back, hash_words, rolling, words_of
from .common import P, broadcast_if_small, save, with_nodes

WINDOW, GRAM = 35, 8
MAX_VARIANTS = 400
#: Words of segments in one block of a shard.
BLOCK_WORDS = 40_000
#: Units (rows and regions or spans) up to which these are broadcast.
BROADCAST_TEXTS = 1_000_000
_LOW = np.uint64((1 << 26) - 1)


def segments(offsets: np.ndarray, h: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Segments of a chunk of texts: text number, minimizer, first window, number of windows, words before the minimizer.

    ``h`` holds the hashes of all words.  A segment ends where the place of the minimizer changes.
    """
    g = rolling(h, gram)
    n = len(h) - window + 1
    if n <= 0:
        z = np.empty(0, np.int64)
        return z, np.empty(0, np.uint64), z, z, z
    low = (g & ~_LOW) | np.arange(len(g), dtype=np.uint64)
    span, best, width = window - gram + 1, low, 1
    while 2 * width <= span:
        best = np.minimum(best[: len(best) - width], best[width:])
        width *= 2
    best = np.minimum(best[:n], best[span - width : span - width + n])
    place = (best & _LOW).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.nonzero(doc[:n] == doc[window - 1 :])[0]
    if not len(at):
        return at, np.empty(0, np.uint64), at, at, at
    d, p = doc[at], place[at]
    first = np.nonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (p[1:] != p[:-1]))))[0]
    count = np.diff(np.concatenate((first, [len(at)])))
    return d[first], g[p[first]], at[first] - offsets[d[first]], count, p[first] - at[first]


class Automaton:
    """Suffix automaton of several word sequences, each with a weight."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.weight = [-1], [0], [0.0]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.len.append(length)
        self.link.append(link)
        self.weight.append(0.0)
        return len(self.len) - 1

    def _split(self, p: int, c, q: int) -> int:
        """A state for the shorter strings of ``q`` that are reached from ``p`` by ``c``."""
        nxt, link = self.next, self.link
        clone = self._state(self.len[p] + 1, dict(nxt[q]), link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def add(self, seq, weight: float) -> None:
        nxt, link, size = self.next, self.link, self.len
        last = 0
        for c in seq:
            q = nxt[last].get(c)
            if q is not None:
                last = q if size[q] == size[last] + 1 else self._split(last, c, q)
            else:
                cur, p = self._state(size[last] + 1, {}, 0), last
                while p != -1 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p != -1:
                    q = nxt[p][c]
                    link[cur] = q if size[q] == size[p] + 1 else self._split(p, c, q)
                last = cur
            self.weight[last] += weight

    def finish(self, least: float = 1.5) -> None:
        """Sums weights over suffix links; ``best``: length of each state's longest suffix that occurs twice."""
        order = sorted(range(len(self.len)), key=self.len.__getitem__)
        for s in reversed(order):
            if self.link[s] >= 0:
                self.weight[self.link[s]] += self.weight[s]
        self.best = [0] * len(order)
        for s in order[1:]:
            self.best[s] = self.len[s] if self.weight[s] >= least else self.best[self.link[s]]

    def matching(self, seq) -> list[int]:
        """For each position of a sequence that was added: the longest suffix there that occurs twice or more."""
        s, out = 0, []
        for c in seq:
            s = self.next[s][c]
            out.append(self.best[s])
        return out


def block_masks(groups: list[list[tuple[str, float]]], window: int = WINDOW) -> list[list[int]]:
    """For each segment (words, weight) of each minimizer group: a bit for each window that occurs twice or more."""
    auto, number, coded = Automaton(), {}, []
    for group in groups:
        one = len(group) == 1
        seqs = [] if one else [[number.setdefault(w, len(number)) for w in words.split(" ")] for words, _ in group]
        for seq, (_, weight) in zip(seqs, group, strict=False):
            auto.add(seq, weight)
        coded.append(seqs)
    auto.finish()
    out = []
    for group, seqs in zip(groups, coded, strict=True):
        if not seqs:  # one segment alone: all its windows occur as often as it does, and differ
            words, weight = group[0]
            out.append([(1 << (words.count(" ") + 2 - window)) - 1 if weight >= 1.5 else 0])
            continue
        out.append([sum(1 << i for i, m in enumerate(auto.matching(s)[window - 1 :]) if m >= window) for s in seqs])
    return out


def _runs(rows: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for b in chunks(batches):
            offsets, ids, names = words_of(column(b, "text"))
            doc, low, start, n, _ = segments(offsets, hash_words(names)[ids] if len(ids) else np.empty(0, np.uint64), window)
            t = column(b, P + "t").to_numpy(zero_copy_only=False)[doc].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(low.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["t", "m", "start", "n"])

    return rows.filter("text is not null").select(P + "t", "text").mapInArrow(run, "t long, m long, start int, n int")


def _merged(pieces: DataFrame) -> DataFrame:
    """Per ``t``: the array of maximal spans (s, e) of pieces (t, s, e) that touch or overlap."""
    by = Window.partitionBy("t").orderBy("s", "e")
    rows = pieces.withColumn("top", F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("island", F.sum(F.when(F.col("s") <= F.col("top"), 0).otherwise(1)).over(by))
    rows = rows.groupBy("t", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return rows.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))


def _segment_texts(rows: DataFrame, regions: DataFrame, window: int) -> DataFrame:
    """Segments that lie in the regions, with their words and weight."""
    picked = rows.join(regions, (F.col(P + "t") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("rep")))

    def run(batches):
        for b in chunks(batches):
            offsets, ids, names = words_of(column(b, "text"))
            doc, low, start, n, left = segments(offsets, hash_words(names)[ids], window)
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            spans, t, w = column(b, "spans").to_pylist(), column(b, "t").to_pylist(), column(b, "weight").to_pylist()
            for i in range(b.num_rows):
                mine = slice(cut[i], cut[i + 1])
                s = start[mine]
                begin = np.array([x["s"] for x in spans[i]])
                k = np.searchsorted(begin, s, side="right") - 1
                inside = (k >= 0) & (s < np.array([x["e"] for x in spans[i]])[k])
                words = [names[j] for j in ids[offsets[i] : offsets[i + 1]].tolist()]
                s, c, m, before = s[inside], n[mine][inside], low[mine][inside], left[mine][inside]
                texts = [" ".join(words[x : x + y + window - 1]) for x, y in zip(s.tolist(), c.tolist(), strict=True)]
                size = len(texts)
                if size:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t[i]] * size, pa.int64()), pa.array(m.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(texts, pa.string()), pa.array(before.astype(np.int32)), pa.array([w[i]] * size, pa.float64())],
                        ["t", "m", "start", "words", "left", "weight"],
                    )

    return picked.select("t", "text", "spans", "weight").mapInArrow(run, "t long, m long, start int, words string, left int, weight double")


def _shard_masks(segs: DataFrame, window: int) -> DataFrame:
    """Masks of segments, from the suffix automata of their shards."""

    def run(batches):
        groups: list[list] = []
        keys: list[list] = []
        size, last = 0, None

        def flush():
            masks = [x for g in block_masks(groups, window) for x in g]
            k = [x for g in keys for x in g]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in k], pa.int64()), pa.array([x[1] for x in k], pa.int64()), pa.array(masks, pa.int64())], ["k1", "k2", "mask"])

        for b in batches:
            for m, k1, k2, words, weight in zip(*(column(b, c).to_pylist() for c in ("m", "k1", "k2", "words", "weight")), strict=True):
                if m != last or not groups:
                    if size >= BLOCK_WORDS:
                        yield flush()
                        groups, keys, size = [], [], 0
                    groups.append([])
                    keys.append([])
                    last = m
                groups[-1].append((words, weight))
                keys[-1].append((k1, k2))
                size += words.count(" ") + 1
        if groups:
            yield flush()
        groups.clear()
        keys.clear()
        give_back()

    dealt = segs.repartition("m").sortWithinPartitions("m")
    return dealt.select("m", "k1", "k2", "words", "weight").mapInArrow(run, "k1 long, k2 long, mask long")


def _halves(pieces: DataFrame, window: int, width: int) -> DataFrame:
    """Pieces cut by the number of words that their windows have before the minimizer: ``width`` such numbers a cut.

    ``up1``, ``up2`` name the piece of a cut, ``i`` is the cut's first window there.
    """
    left, low = F.col("left"), F.col("c") * width
    high = F.least(low + width - 1, F.lit(window - GRAM))
    rows = pieces.select("m", F.col("k1").alias("up1"), F.col("k2").alias("up2"), "weight", "left", F.split("words", " ").alias("w"))
    rows = rows.withColumn("last", left - F.size("w") + window)
    rows = rows.withColumn("c", F.explode(F.sequence(F.floor(F.col("last") / width).cast("int"), F.floor(left / width).cast("int"))))
    rows = rows.select("*", F.least(left, high).alias("top"), F.greatest("last", low).alias("bottom"))
    shared = F.array_join(F.slice("w", left - low + 1, low - high + window), " ")
    words = F.array_join(F.slice("w", left - F.col("top") + 1, F.col("top") - F.col("bottom") + window), " ")
    rows = rows.select("up1", "up2", "weight", (left - F.col("top")).alias("i"), F.col("top").alias("left"), F.xxhash64("m", "c", shared).alias("m"), words.alias("words"))
    return rows.withColumn("k1", F.xxhash64("words")).withColumn("k2", F.xxhash64(F.lit(1), "words"))


def _masks(pieces: DataFrame, window: int, width: int) -> DataFrame:
    """Masks of distinct pieces, whose windows differ by less than ``width`` in the words before the minimizer."""
    hot = pieces.groupBy("m").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > MAX_VARIANTS).select("m")
    hot = save(hot, "repeat-hot")
    if width == 1 or hot.limit(1).count() == 0:
        return _shard_masks(pieces, window)
    hot, width = broadcast_if_small(hot, BROADCAST_TEXTS), width // 2
    cuts = save(_halves(pieces.join(hot, "m", "left_semi"), window, width), "repeat-halves")
    found = save(_masks(_distinct(cuts), window, width).filter("mask <> 0"), "repeat-masks")
    masks = cuts.select("up1", "up2", "i", "k1", "k2").join(found, ["k1", "k2"])
    masks = masks.groupBy("up1", "up2").agg(F.bit_or(F.call_function("shiftleft", F.col("mask"), F.col("i"))).alias("mask"))
    return _shard_masks(pieces.join(hot, "m", "left_anti"), window).unionByName(masks.withColumnsRenamed({"up1": "k1", "up2": "k2"}))


def _distinct(pieces: DataFrame) -> DataFrame:
    same = pieces.groupBy("m", "k1", "k2").agg(F.sum("weight").alias("weight"), F.first("words").alias("words"), F.first("left").alias("left"))
    return save(same, "repeat-distinct")


def spans(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per text of ``rows`` (doc_id, text and its node): the maximal spans (s, e) of words to remove."""
    rows = rows.select("doc_id", "text", P + "t")
    runs = save(_runs(rows, window), "repeat-runs")
    # Written first, the counts join as a plain exchange, of which Spark can split a hot minimizer.
    often = save(runs.groupBy("m").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("m"), "repeat-often")
    found = runs.join(often, "m").groupBy("t", "start").agg(F.max("n").alias("n"))
    own = rows.filter("text is not null").groupBy(P + "t", "doc_id").agg(F.count(F.lit(1)).alias("c")).groupBy(F.col(P + "t").alias("t2")).agg(F.sum("c").alias("all"), F.min(F.struct("doc_id", "c")).alias("x"))
    regions = _merged(found.select("t", F.col("start").alias("s"), (F.col("start") + F.col("n")).alias("e")))
    regions = save(regions.join(own, F.col("t") == F.col("t2")).select("t", "spans", F.col("x.doc_id").alias("rep"), (F.col("all") / F.col("x.c")).alias("weight")), "repeat-regions")
    segs = _segment_texts(rows, broadcast_if_small(regions, BROADCAST_TEXTS), window)
    segs = save(segs.withColumn("k1", F.xxhash64("words")).withColumn("k2", F.xxhash64(F.lit(1), "words")), "repeat-segments")
    masks = _masks(_distinct(segs), window, 1 << (window - GRAM).bit_length())
    masks = save(masks.filter("mask <> 0"), "repeat-masks")
    bits = F.filter(F.sequence(F.lit(0), F.lit(window - GRAM)), lambda i: F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    # Windows of one mask that follow each other are one piece; the rest merges per text.
    hits = segs.select("t", "start", "k1", "k2").join(masks, ["k1", "k2"]).select("t", "start", "mask", bits.alias("b"))
    hits = hits.select("t", F.explode(F.filter("b", lambda i: ~F.array_contains("b", i - 1))).alias("i"), "start", "b")
    end = F.array_min(F.filter("b", lambda i: (i >= F.col("i")) & ~F.array_contains("b", i + 1)))
    pieces = hits.select("t", (F.col("start") + F.col("i")).alias("s"), (F.col("start") + end + window).alias("e"))
    return save(_merged(pieces), "repeat-spans")


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``, the words that stay, joined by one space.

    Columns of ``docs`` pass through as they are; a new column whose name one of them has gets the prefix ``_lw_``.
    """
    rows = with_nodes(docs)
    cut = spans(rows, window)
    cut = broadcast_if_small(cut.select(F.col("t").alias(P + "cut_t"), F.col("spans").alias(P + "spans")), BROADCAST_TEXTS)
    joined = rows.join(cut, F.col(P + "t") == F.col(P + "cut_t"), "left").select(*[rows[c] for c in docs.columns], P + "spans")
    keep = docs.columns
    extra = [P + c if c in keep else c for c in ("n_words", "n_removed", "kept")]

    def run(batches):
        for b in chunks(batches):
            offsets, ids, names = words_of(column(b, "text"))
            size, at, gone, kept = np.diff(offsets), offsets.tolist(), [], []
            for i, x in enumerate(column(b, P + "spans").to_pylist()):
                mine = ids[at[i] : at[i + 1]]
                if x:
                    stay = np.ones(len(mine), bool)
                    for y in x:
                        stay[y["s"] : y["e"]] = False
                    mine = mine[stay]
                gone.append(at[i + 1] - at[i] - len(mine))
                kept.append(" ".join([names[j] for j in mine.tolist()]))
            yield pa.RecordBatch.from_arrays([*[column(b, c) for c in keep], pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [*keep, *extra])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return joined.mapInArrow(run, ", ".join([*kinds, *[f"`{c}` {kind}" for c, kind in zip(extra, ("long", "long", "string"), strict=True)]]))


def repeat_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    return remove(docs.select("doc_id", "text"), window).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
