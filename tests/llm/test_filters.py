import hashlib
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenweave.llm import classifier, language, mixing, pii, quality_rules

DOC = "doc_id long, text string, lang string, source string, n_chars long, size string, bucket string, base string, score string"
SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, None, "x", "x", "x", "x") for r in rows], DOC)


AWKWARD = [(1, None, None, None), (None, "a b c", None, None), (2, "", "en", "s"), (2, "", "en", "s"), (3, " \t\n\x0b", "en", None), (4, "w" * 200_000, "de", "s"), (5, "a b c " * 20_000, "de", "t"), (6, "é😀 #x", "fr", "é")]


@pytest.fixture(scope="module")
def awkward(spark):
    return docs_of(spark, AWKWARD)


def against_sql(spark, sql, frame, docs):
    con = duckdb.connect()
    table = docs.select("doc_id", "text", "lang", "source").toArrow()  # noqa: F841
    con.register("documents", table)
    want = con.sql(sql).df()
    got = frame.toPandas()
    norm = lambda f: sorted(tuple("" if pd.isna(v) else format(float(v), ".9g") for v in r) for r in f[sorted(f.columns)].itertuples(index=False))
    assert norm(got) == norm(want)


# ---- mixing ----
def test_mixing_equals_sql(spark, awkward):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    against_sql(spark, mixing.ORACLE, mixing.mix_report(docs), docs)
    named = awkward.filter("doc_id is not null")
    against_sql(spark, mixing.ORACLE, mixing.mix_report(named), named)
    assert mixing.mix_report(awkward).count() == len(AWKWARD) and mixing.mix_report(awkward.limit(0)).count() == 0


def test_mixing_meets_targets_and_caps(spark):
    docs = docs_of(spark, [(i, "w " * (1 + i % 7), "en", f"s{i % 3}" if i % 10 else "a") for i in range(3000)] + [(9999, "one", "en", "b")])
    rows = mixing.mix_report(docs).toPandas()
    total = rows["size"].sum()
    first = rows.merge(docs.select("doc_id", "source").toPandas(), on="doc_id").groupby("source")
    assert (rows.taken <= 3 * rows["size"]).all() and abs(first.target.first().sum() - total) < 1e-6
    for _, g in first:
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(0.01 * g.target.iloc[0], 7)
        assert g.target.iloc[0] <= 3 * g.source_size.iloc[0] + 1e-9
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    n = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(n.get(r.doc_id, 0) == (r.taken // r.size) for r in rows.rename(columns={"size": "sz"}).assign(size=rows["size"]).itertuples())


# ---- quality rules ----
def test_rules_equal_sql(spark, awkward):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    against_sql(spark, quality_rules.ORACLE, quality_rules.quality_report(docs), docs)
    against_sql(spark, quality_rules.ORACLE, quality_rules.quality_report(awkward), awkward)
    assert quality_rules.quality_report(awkward.limit(0)).count() == 0


def test_rules_find_outliers_and_keep_the_rest(spark):
    clean = lambda i: " ".join(f"word{(i * 31 + k * 7) % 997}x" for k in range(80)) + "."
    rows = [(i, clean(i), "en", "s") for i in range(200)] + [(1000, clean(1).replace(" ", " ### "), "en", "s"), (1001, "\n".join(["a long line of words here"] * 12), "en", "s"), (1002, clean(3).upper(), "en", "s"), (1003, "few words", "en", "s")]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_report(docs_of(spark, rows)).collect()}
    assert all(kept[i] for i in range(200)) and not any(kept[i] for i in (1000, 1001, 1002, 1003))


def test_sketches_set_the_fence_of_every_measure(spark):
    """Two sources unlike in every measure get unlike fences, and the same text is judged by its source."""
    plain = lambda i: " ".join(f"word{(i * 31 + k * 7) % 997}x" for k in range(80))
    rich = lambda i: "\n".join(["AB same line of CODE here#"] * (i % 5) + [f"Long{'x' * (i % 40)}{(i * 13 + k) % 997} $v{k}|{i % 9} = #{k};" for k in range(30)])
    rows = [(i, plain(i), "en", "prose") for i in range(400)] + [(1000 + i, rich(i), "en", "code") for i in range(400)] + [(5000, rich(4), "en", "prose"), (5001, rich(4), "en", "code")]
    counted = quality_rules.counts(docs_of(spark, rows)).cache()
    limits = {r["_lw_source"]: r for r in quality_rules.thresholds(counted, quality_rules.typical_sizes(counted), min_group=100).collect()}
    assert all(limits["code"][f"_lw_max_{k}"] > limits["prose"][f"_lw_max_{k}"] for k in quality_rules.MEASURES)
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs_of(spark, rows), min_group=100).collect()}
    assert kept[5001] and not kept[5000] and all(kept[i] for i in range(400))


def test_sketch_buckets_are_bounded_and_close(spark):
    vals = [0, 1, 127, 128, 129, 255, 256, 10**6, 10**12, 2**62]
    got = {r.v: r.b for r in spark.createDataFrame([(v,) for v in vals], "v long").withColumn("b", quality_rules.bucket("v")).collect()}
    assert all(b <= v and v - b <= v / 64 for v, b in got.items()) and all(got[v] == v for v in vals if v < 128)


def test_rules_run_no_python(spark, awkward):
    plan = quality_rules.quality_report(awkward)._jdf.queryExecution().toString() + pii.pii_report(awkward)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- personal data ----
FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    out = []
    for k, p in FORMS.items():
        for x in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", x.group())
            if {"email": True, "ip": k != "ip" or all(int(q) <= 255 for q in x.group().split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[k]:
                out.append(f"{k}:{x.start()}:{x.end()}")
    return out


def test_base_spans_equal_plain_regular_expressions(spark, awkward):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**6 + i, t) for i, t in enumerate(["a@b.c_x@y.z 1.2.3.4.5.6.7.8 +1 (23) 456-7890 4111 1111 1111 1111 4111-1111-1111-1111x", "é😀 a@b.co 😀 001.2.3.255 1.2.3.256", "1 " * 20_000, "a" * 200_000, "1" * 50_000, "@@a@b a@-.- x@y..z", "+12345678 +1.2.3.4.5.6.7.8 ++1234567890", "1.2.3.4\n5@6.7\r\n+1 2345678", "a@b.co, " * 3000, "x +1 2345678901; 4111111111111111, " * 700, "1.2.3.4 " * 256, "1.2.3.4 " * 257, None, ""])]
    got = {r.doc_id: r for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        want = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert set(want) <= set(filter(None, got[i].spans.split(",")))
    assert pii.pii_report(awkward).count() == len(AWKWARD) and pii.pii_report(awkward.limit(0)).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"please write to customer{i}@mail.example.com for details") for i in range(30)]
    rows += [(100 + i, f"please write to customer{i}@intranet for details") for i in range(3)]
    rows += [(200 + i, f"there were {i} apples in 20{i:02d} and more") for i in range(40)]
    got = {r.doc_id: r.spans for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i].startswith("email:16:") for i in range(3))
    assert not any(got[200 + i] for i in range(40))


def test_discovered_identifiers_make_further_patterns(spark):
    """An account found through its context induces the context in which others are found, a round later."""
    name = lambda i: f"acct{i:03d}x@intra{'q' * (i % 9)}"
    rows = [(1000 + i, f"please write to c{i}@mail.example.com for details {'z' * (i % 7)}") for i in range(400)]
    rows += [(100 + i, f"please write to {name(i)} for details") for i in range(20)] + [(200 + i, f"forward everything towards {name(i)} during holidays") for i in range(20)]
    rows += [(300, "forward everything towards another@place9 during holidays")] + [(400 + i, f"there were {i} apples in 20{i:02d} and more") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.pii_report(df).collect()}
    assert all("email" in got[i] for i in (*range(100, 120), *range(200, 220), 300)) and not any(got[400 + i] for i in range(40))
    once = {r.doc_id: bool(r.added) for r in pii.find(df, rounds=1).collect()}
    assert once[100] and not once[300]


def test_hidden_seeds_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = pii.hidden_recall(docs).collect()
    hidden, right, beyond = (sum(r[c] for r in rows) for c in ("hidden", "right", "beyond_base"))
    print(rows, file=open("/tmp/res3", "w"))
    assert hidden > 100 and right >= 0.5 * hidden and beyond <= 0.1 * (right + 1)


def plain_redaction(t, spans):
    out, at = [], 0
    for s, e, k in sorted((int(s), int(e), list(FORMS).index(k)) for k, s, e in (x.split(":") for x in spans.split(",") if x)):
        if s >= at:
            out += [t[at:s], f"<{list(FORMS)[k]}>"]
        at = max(at, e)
    return "".join(out) + t[at:]


def test_redaction_equals_a_plain_loop(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += [" ".join(f"u{i}@mail{i % 7}.example.com{'é😀' * (i % 3)}" for i in range(5000)), "x" * 511 + " a@b.co", "x" * 509 + " a@b.co 1.2.3.4 +1 2345678901@x.yz", "a" * 3000 + "@b.co", "\n" * 600 + "4111 1111 1111 1111"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.pii_report(docs).collect()}
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (t if t is None else plain_redaction(t, spans[i]))


def test_redaction(spark, awkward):
    docs = docs_of(spark, [(1, "mail a@b.co or +1 2345678901, ok", "en", "s"), (1, None, "en", "s"), (2, "clean", "en", "s"), (3, "a@b.co", "en", "s"), (3, "a@b.co", "en", "s")])
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, ""), (1, "mail <email> or <phone>, ok"), (2, "clean"), (3, "<email>"), (3, "<email>")]
    assert pii.redact(awkward).count() == len(AWKWARD)


# ---- quality classifier and language ----
def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = classifier.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (rows.predicted == rows.quality).mean() >= 0.97 and rows.score.between(0, 1).all()
    kept = classifier.accept(docs, labels)
    assert kept.columns == docs.columns and 0.8 < kept.count() / docs.count() < 0.95


def test_classifier_awkward(spark, awkward):
    labels = spark.createDataFrame([(2, 1), (5, 0), (5, 1), (None, 1), (6, None), (4, 0)], "doc_id long, quality int")
    out = classifier.quality_scores(awkward, labels)
    assert out.count() == len(AWKWARD) and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert {r.score for r in classifier.quality_scores(awkward, labels.limit(0)).collect()} == {0.5}
    assert classifier.quality_scores(awkward.limit(0), labels).count() == 0


def test_neighbours_vote_as_a_plain_loop():
    import numpy as np
    import pyarrow as pa

    texts = [f"{w} " * (3 + i) + "and more" for i, w in enumerate("alpha beta gamma delta alpha beta Alpha".split())]
    doc, term, value = classifier.terms(pa.array(texts))
    rng = np.random.default_rng(0)
    m = classifier.Model(np.ones(classifier.TERMS, np.float32), rng.standard_normal((classifier.TERMS, 5)).astype(np.float32), None, np.array([1.0, 0, 1, 0, 1, 1, 0]))
    z = m.dense(doc, term, value, len(texts)) @ m.project
    m.vectors = z / np.linalg.norm(z, axis=1, keepdims=True)
    got = m.score(doc, term, value, len(texts))
    for i, v in enumerate(m.vectors):
        w = np.maximum(m.vectors @ v, 0).astype(float) ** classifier.POWER
        assert got[i] == pytest.approx((w * m.labels).sum() / w.sum(), rel=1e-4)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (rows.lang == rows.lang_pred).mean() >= 0.97 and rows.score.between(0, 1).all()


def test_rare_language_keeps_its_prototype(spark, monkeypatch):
    monkeypatch.setattr(language, "LANG_DOCS", 5, raising=False)
    rows = [(i, f"the house and the garden number {i}", "en") for i in range(3000)] + [(5000 + i, f"huset og haven på øen {i}", "da") for i in range(3)]
    names, _ = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 20)
    assert names == ["da", "en"]


def test_shape_reads_the_whole_word():
    assert classifier.shape("a" * 60 + "#9") == "a#0" and classifier.shape("Ab9--é") == "Aa0-a"
    assert classifier.shape("a1" * 30 + "!") != classifier.shape("a1" * 30 + "?") and len(classifier.shape("a1" * 300)) <= 40


def test_language_awkward(spark, awkward):
    got = {(r.doc_id, r.lang_pred) for r in language.language_report(awkward).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and all(p in ("en", "de", "fr") for i, p in got if i in (4, 5, 6))
    assert language.language_report(awkward.limit(0)).count() == 0
    assert {r.lang_pred for r in language.language_report(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_trigram_bundles_equal_plain_sums():
    import numpy as np

    s = language.Space()
    text = "Ab cé!"
    chars = " ab cé "
    slot = [int(s.table[ord(c)]) for c in chars]
    counts = {}
    for a, b, c in zip(slot, slot[1:], slot[2:], strict=False):
        if b:
            counts[(a, b, c)] = counts.get((a, b, c), 0) + 1
    want = sum(np.sqrt(n) * (np.roll(s.letters[a], 2) * np.roll(s.letters[b], 1) * s.letters[c]).astype(float) for (a, b, c), n in counts.items())
    vec, letters = s.bundles([text, "", "1 2"])
    assert np.allclose(vec[0], want / np.linalg.norm(want), atol=1e-5) and letters.tolist() == [True, False, False]
