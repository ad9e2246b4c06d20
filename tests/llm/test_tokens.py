import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenweave.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")
EDGE = ["", " ", "   ", " a", "a  ", "x\ny", "\n", "\n\n x", " \n", "Hello   world\n\tfoo", "日本語 テスト 😀😀 x", "é ﬁ\xa0y", "\x00a b", " " * 37 + "x", "x" + " " * 40 + "y", "a" * 3000, "ааа привет мир", "a▁b", "▁"]


def test_equals_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    seg = pieces.Segmenter(*pieces.load(pieces.model_path()))
    rng = random.Random(1)
    texts = EDGE + ["".join(rng.choice("abcdehinorst   -.\n<é日") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    offsets, ids = seg.encode(pa.array(texts))
    back = seg.decode(offsets, ids)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == sp.encode(t), t
        assert back[i] == t.replace("▁", " ")


def test_frames(spark):
    rows = [(i, t, "de") for i, t in enumerate(EDGE)] + [(None, "x y", None), (1, None, None), (1, None, None), (7, "w " * 30_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.encode(docs)
    assert out.columns == ["doc_id", "ids", "decoded"] and out.count() == len(rows)
    assert out.filter("ids is null").count() == 2 == out.filter("decoded is null").count()
    again = pieces.decode(out.select("doc_id", "ids"))
    assert sorted(map(str, again.select("text").collect())) == sorted(map(str, docs.select(F.translate("text", "▁", " ").alias("text")).collect()))
    assert pieces.encode(docs.limit(0)).count() == 0


def test_other_kinds_of_models_are_refused():
    import pytest
    import sentencepiece

    given = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()).serialized_model_proto()
    pieces.check_model(given)
    field = lambda n, body: bytes([n << 3 | 2, len(body)]) + body
    merges, keeps = bytes([3 << 3, 2]), bytes([4 << 3, 0])
    pieces.check_model(field(2, merges) + field(3, keeps))
    for trainer, rules in ((bytes([3 << 3, 1]), keeps), (b"", keeps), (merges, b""), (merges, keeps + field(2, b"x")), (merges, keeps + bytes([3 << 3, 0]))):
        with pytest.raises(ValueError):
            pieces.check_model(field(2, trainer) + field(3, rules))
