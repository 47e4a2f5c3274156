"""Ids against the model's own library."""

import random

import public_tokenizers

from quillstack.llm import pieces


def test_ids_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    texts = [x.text or "" for x in docs.collect()]
    texts += ["", " ", "  a  b ", "andaneringha", "don't\n\n x \t y  ", "日本語🙂 né 12３４ ½ \x85z", "x" * 700, "ab" * 300, "internationalisation" * 9, "\x00", "a\U0001f642\U0001f642b"]
    texts += ["".join(r.choice("  \n\tabcdeinorst.,!?é日🙂") for _ in range(r.randrange(1, 200))) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in pieces.encode(frame, path, decoded="decoded").collect():
        assert x.ids == library.encode(texts[x.doc_id]), repr(texts[x.doc_id][:200])
        assert x.decoded == texts[x.doc_id]


def test_long_words_merge_as_short_ones():
    p = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(4)
    words = ["▁" + "".join(r.choice("abeinorst日🙂") for _ in range(40)) for _ in range(50)]
    got = {i: row for rows, places in p.merge(words, 41) for i, row in zip(rows.tolist(), places.tolist())}
    assert [got[i] for i in range(50)] == p.merge_long(words, 41)
