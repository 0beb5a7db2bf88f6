import random

import numpy as np
import public_tokenizers
import sentencepiece

from strandloom.llm.pieces import PieceEncoder, PieceModel, decode_pieces, encode_pieces

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = ["Hello world", "", None, " lead  two   three ", "a\nb\n\n c\t d", "naïve Ünïcode 執 \U0001f600 ▁ x", "<s> </s> <0x0A> <unk>", "same", "same", "  ", "\n", "nospaces" * 3000, "é ⁇"]


def held(path, texts, step=20):
    """Ids and decoded texts of whole texts by both libraries."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    encoder = PieceEncoder(path)
    for at in range(0, len(texts), step):
        batch = texts[at : at + step]
        found = encoder.encode(batch)
        assert encoder.parity(batch, found) == [True] * len(batch)
        for text, ids, said in zip(batch, found, encoder.decode(found), strict=True):
            assert ids.tolist() == sp.encode(text) and said == sp.decode(ids.tolist()), repr(text)
            assert said == encoder.tokenizer.decoder.decode(encoder.names[ids].tolist())


def drawn(seed, n=500, alphabet="abcdefg hi\n.,é執\u0301 THE  the"):
    rng = random.Random(seed)
    return [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_parity_with_the_other_library():
    held(PATH, drawn(2))


def test_unigram_model(tmp_path):
    """Of a model trained here, with bytes for what it doesn't know and with an unknown piece."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgTHEé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    (tmp_path / "in.txt").write_text("\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(2000)))
    for fallback in (True, False):
        name = f"{tmp_path}/m{fallback}"
        sentencepiece.SentencePieceTrainer.train(input=f"{tmp_path}/in.txt", model_prefix=name, vocab_size=600, model_type="unigram", byte_fallback=fallback, hard_vocab_limit=False, minloglevel=2)
        model = PieceModel(name + ".model")
        assert model.type == 1 and model.byte_fallback == fallback
        if fallback:
            held(name + ".model", drawn(3, 300, "abcdefg hi\n.,é執 THE  the"))
        else:
            held(name + ".model", [" ".join(rng.choice(words) for _ in range(20)) for _ in range(200)])


def test_model_file():
    model = PieceModel(PATH)
    assert model.pieces[:3] == ["<unk>", "<s>", "</s>"] and model.byte_fallback and len(model.merges()) > 30000


def test_tables(spark):
    docs = spark.createDataFrame([(i, t, 5, True, "d") for i, t in enumerate(TEXTS)] + [(None, "no id", 1, None, None)], "doc_id long, text string, n_ids int, parity boolean, decoded string")
    for table in (encode_pieces(docs, PATH, decoded=True), decode_pieces(encode_pieces(docs, PATH), PATH)):
        assert sorted(table.columns) == ["decoded", "doc_id", "ids", "n_ids", "parity", "text"]
        got = {r.doc_id: r for r in table.collect()}
        for i, t in [*enumerate(TEXTS), (None, "no id")]:
            assert got[i].text == t and got[i].decoded == (t or "").replace("▁", " ") and got[i].parity and got[i].n_ids * 4 == len(got[i].ids)
    assert encode_pieces(docs.limit(0), PATH).collect() == []
    odd = spark.createDataFrame([(None,), (np.array([1, 40000, 2, 22172], "<u4").tobytes(),)], "ids binary")
    assert sorted(r.decoded for r in decode_pieces(odd, PATH).collect()) == sorted(["", sentencepiece.SentencePieceProcessor(model_file=PATH).decode([22172])])


def test_parity_is_of_whole_texts(monkeypatch):
    encoder = PieceEncoder(PATH)
    texts = ["two  blanks", "plain", "", " lead\nline "]
    assert encoder.parity(texts, encoder.encode(texts)) == [True] * 4
    squeezed = PieceEncoder.marked
    monkeypatch.setattr(PieceEncoder, "marked", lambda self, text: squeezed(self, text.replace("  ", " ")))
    assert encoder.parity(texts, encoder.encode(texts)) == [False, True, True, True]


def test_registered_query(spark, tmp_path):
    import zlib
    from hashlib import sha256

    from strandloom.llm.queries import QUERIES

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (7, "same")]
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        ids = sp.encode(t or "")
        said = (t or "").replace("▁", " ")
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True, True, sha256(said.encode()).hexdigest()))
    assert sorted(map(tuple, QUERIES["op10_sentencepiece"](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
