import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from lumenweave.llm import near_dups, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
AWKWARD = [(10**7, None), (10**7 + 1, ""), (10**7 + 1, ""), (None, "x y z"), (10**7 + 2, ("x y z " * 40).strip()), (10**7 + 3, "a " * 34 + "b"), (10**7 + 4, "q " * 36), (10**7 + 4, "q " * 36), (10**7 + 5, " ".join(map(str, range(60)))), (10**7 + 6, "z\n" + " ".join(map(str, range(60)))), (10**7 + 7, "long " * 30_000)]


@pytest.fixture(scope="module")
def docs(spark):
    mine = spark.createDataFrame([(*r, "en", "s", 1, "t", "rep") for r in AWKWARD], "doc_id long, text string, lang string, source string, n_chars long, t string, rep string")
    return spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'t' as t", "'r' as rep").unionByName(mine)


def removed(rows, window=35):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = Counter()
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out[(i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("variants", [400, 1])
def test_removal_equals_brute_force(docs, variants, monkeypatch):
    monkeypatch.setattr(repeats, "MAX_VARIANTS", variants)  # 1: every minimizer takes the way of hot ones
    got = Counter(map(tuple, repeats.repeat_report(docs).collect()))
    assert got == removed((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def test_removal_without_broadcasts(docs, monkeypatch):
    monkeypatch.setattr(repeats, "BROADCAST_TEXTS", -1)
    got = Counter(map(tuple, repeats.repeat_report(docs).collect()))
    assert got == removed((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def generated(spark, run):
    """The most rows that one Generate of the queries of ``run`` made."""
    store, rows = spark._jsparkSession.sharedState().statusStore(), [0]
    before = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    run()
    for i in range((done := store.executionsList()).size()):
        k = done.apply(i).executionId()
        nodes = store.planGraph(k).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size()) if k not in before):
            values = [node.metrics().apply(j) for j in range(node.metrics().size()) if node.name().startswith("Generate")]
            got = [store.executionMetrics(k).get(x.accumulatorId()) for x in values if x.name() == "number of output rows"]
            rows += [int(x.get().replace(",", "")) for x in got if x.isDefined()]
    return max(rows)


def test_near_copies_of_one_text_make_few_rows(spark, monkeypatch):
    """Variants of one minimizer: a step of the way of hot ones makes two rows of a segment at most, not one a window."""
    monkeypatch.setattr(repeats, "MAX_VARIANTS", 20)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(200):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    docs, got = spark.createDataFrame(rows, "doc_id long, text string"), Counter()
    most = generated(spark, lambda: got.update(map(tuple, repeats.repeat_report(docs).collect())))
    assert got == removed(rows)
    parts = [repeats.segments(np.array([0, 60]), repeats.hash_words(t.split(" "))) for _, t in rows]
    distinct = {(t, int(start)) for (_, t), part in zip(rows, parts, strict=True) for start in part[2]}
    assert 0 < most <= 2 * len(distinct)


def test_removal_on_small_windows(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 120)))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, repeats.repeat_report(df, window=12).collect()))
    assert got == removed(rows, 12)


def test_removal_keeps_columns_and_empty_tables(docs):
    out = repeats.remove(docs)
    assert out.columns == [*docs.columns, "n_words", "n_removed", "kept"]
    assert repeats.repeat_report(docs.limit(0)).count() == 0


def test_removal_leaves_columns_of_its_own_names(spark):
    df = spark.createDataFrame([(1, "a b c " * 40, 7, True), (2, None, 8, None)], "doc_id long, text string, kept long, n_removed boolean")
    out = repeats.remove(df)
    assert out.columns == ["doc_id", "text", "kept", "n_removed", "n_words", "_lw_n_removed", "_lw_kept"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].kept == 7 and rows[1].n_removed is True and rows[1]["_lw_n_removed"] == 120 and rows[1]["_lw_kept"] == "" and rows[2].kept == 8


def test_automaton_equals_plain_search():
    rng = random.Random(7)
    for _ in range(30):
        seqs = [[rng.randint(0, 2) for _ in range(rng.randint(1, 14))] for _ in range(5)]
        weights = [rng.choice([1.0, 2.0]) for _ in seqs]
        auto = repeats.Automaton()
        for s, w in zip(seqs, weights, strict=True):
            auto.add(s, w)
        auto.finish()
        count = Counter()
        for s, w in zip(seqs, weights, strict=True):
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1):
                    count[tuple(s[i:j])] += w
        for s in seqs:
            want = [max((e - b for b in range(e) if count[tuple(s[b:e])] >= 2), default=0) for e in range(1, len(s) + 1)]
            assert auto.matching(s) == want


# ---- near-duplicates ----
def shingles(t, weighted=True):
    w = WORD.findall(t)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    return Counter(runs) if weighted else Counter(set(runs))


def similarity(x, y):
    """Probability Jaccard by its definition."""
    common = x.keys() & y.keys()
    if len(set(x.values())) == len(set(y.values())) == 1:
        return len(common) / len(x.keys() | y.keys())
    every = x.keys() | y.keys()
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in every) for i in common)


def classes(rows, weighted=True):
    texts = sorted({t for _, t in rows if t is not None})
    sets = {t: shingles(t, weighted) for t in texts}
    root = {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = defaultdict(set)
    for t, s in sets.items():
        for x in s:
            index[x].add(t)
    for a, b in {p for ts in index.values() for p in combinations(sorted(ts), 2)}:
        x, y = sets[a], sets[b]
        # No more than the shared shares: spares the long sum for most pairs.
        if sum(min(x[i] / x.total(), y[i] / y.total()) for i in x.keys() & y.keys()) >= 0.79 and similarity(x, y) >= 0.8 - 1e-12:
            root[find(b)] = find(a)
    first = {}
    for i, t in rows:
        if t is not None and i is not None:
            first[find(t)] = min(first.get(find(t), i), i)
    return Counter((i, i if t is None else first.get(find(t))) for i, t in rows)


def test_classes_equal_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter((r.doc_id, r.class_id) for r in near_dups.class_report(docs).collect()) == classes(rows)


def test_chains_and_groups(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    rows = []
    for i in range(60):  # near copies of one text, each changed in a place or two
        w = base[:]
        for _ in range(2):
            w[rng.randrange(len(w))] = f"n{i}"
        rows.append((i, " ".join(w)))
    w = base[:]
    for i in range(100, 112):  # a chain: neighbours are alike, the ends are not
        w = w[4:] + [f"c{i}{k}" for k in range(4)]
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(f"u{i}{k}" for k in range(80))) for i in range(40)] + [(300, "same text"), (301, "same text"), (302, "same  text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.class_id) for r in near_dups.class_report(df).collect()) == classes(rows)


def repeated_lines():
    """Texts with the same shingles, held unequally often, and texts with equal shares."""
    rng = random.Random(11)
    rows = []
    for g in range(12):
        line = " ".join(f"l{g}{rng.randint(0, 99)}" for _ in range(9))
        body = " ".join(f"b{g}{rng.randint(0, 9999)}" for _ in range(60))
        rows += [(g * 10 + k, body + f"\n{line}" * n) for k, n in enumerate((2, 2, 3, 8, 9, 30, 31))]
        rows.append((g * 10 + 8, f"{body}\n{line} x\n{line}\n{line}"))
    return rows


@pytest.mark.parametrize("weighted", [True, False])
def test_repeated_shingles_weigh_more(spark, weighted):
    rows = repeated_lines()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id) for r in near_dups.classes(df, weighted).collect())
    assert got == classes(rows, weighted) and classes(rows, True) != classes(rows, False)


def test_similarity_equals_its_definition():
    rng = random.Random(4)
    for _ in range(200):
        x, y = (Counter({i: rng.randint(1, 4) for i in range(12) if rng.random() < 0.6}) for _ in range(2))
        arrays = [(np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)], float)) for c in (x, y)]
        got = near_dups.probability_jaccard(*arrays[0], *arrays[1])
        assert got == pytest.approx(similarity(x, y) if x and y else 0.0, abs=1e-12)


def test_whole_buckets_equal_all_pairs():
    """Links among unlike components, against every pair, for equal and unequal weights."""
    rng = random.Random(9)
    for weighted in (True, False):
        for _ in range(20):
            base = [rng.randint(1, 10**9) for _ in range(30)]
            sets = []
            for _ in range(14):
                c = Counter(rng.sample(base, rng.randint(22, 30)))
                if weighted:
                    c.update(rng.choices(base, k=rng.randint(0, 9)))
                sets.append(c)
            left = np.array([i < 6 for i in range(14)])
            doc = np.repeat(np.arange(14), [len(c) for c in sets])
            mark = np.concatenate([np.array(sorted(c), np.uint64) for c in sets])
            weight = np.concatenate([np.array([c[k] for k in sorted(c)], float) for c in sets])
            got = near_dups._spanning(doc, mark, weight, left, np.arange(14), 0.8)
            root = list(range(14))
            for i, j in ((i, j) for i in range(6) for j in range(6, 14) if similarity(sets[i], sets[j]) >= 0.8 - 1e-12):
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
            mine = list(range(14))
            for i, j in got:
                assert similarity(sets[i], sets[j]) >= 0.8 - 1e-12
                a, b = mine[i], mine[j]
                mine = [a if r == b else r for r in mine]
            assert len(set(mine)) == len(set(root)) and all((mine[i] == mine[j]) == (root[i] == root[j]) for i in range(14) for j in range(14))


def test_one_of_each_class_stays(docs):
    again = docs.unionByName(docs.limit(5))
    out = near_dups.keep_one(again)
    assert out.columns == docs.columns
    n = docs.select("doc_id", "text").collect()
    kept = [r.doc_id for r in out.collect()]
    want = {c for (i, c) in classes([(r.doc_id, r.text) for r in n])}
    assert set(kept) == want and Counter(kept).most_common(1)[0][1] == 1
    assert near_dups.keep_one(docs.limit(0)).count() == 0 and near_dups.class_report(docs.limit(0)).count() == 0


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    marks = near_dups.mix64(np.arange(1, 301, dtype=np.uint64))
    wa, wb = rng.random(300) + 0.1, rng.random(300) + 0.1
    wa[200:], wb[:50] = 0, 0
    a, b = np.nonzero(wa)[0], np.nonzero(wb)[0]
    m = 4096
    sig = near_dups.probminhash(np.repeat([0, 1], [len(a), len(b)]), marks[np.concatenate((a, b))], np.concatenate((wa[a], wb[b])), 2, m)
    both = np.nonzero((wa > 0) & (wb > 0))[0]
    jp = sum(1 / np.maximum(wa / wa[i], wb / wb[i]).sum() for i in both)
    assert abs((sig[0] == sig[1]).mean() - jp) < 4 * np.sqrt(jp * (1 - jp) / m)
