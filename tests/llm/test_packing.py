import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from strandloom.llm.packing import Encoder, best_fit_decreasing, pack_documents, settle

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
TEXTS = ["Hello world, it's   a TEST\n\n1234 don't!", "", None, "é é  ñ x <|endoftext|> a<|startoftext|>b", "a\x1cb c\x1fd", "  ", "word " * 9000, "ΑΣ ς İ ſ ̀abc", "same", "same"]


def naive(lengths, window):
    free, out = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [w for w in range(len(free)) if free[w] >= lengths[i]]
        w = min(fits, key=lambda w: free[w], default=None)
        if w is None:
            w = len(free)
            free.append(window)
            out.append([])
        free[w] -= lengths[i]
        out[w].append(i)
    return sorted(free)


def test_best_fit_is_tightest():
    rng = random.Random(3)
    for window in (8, 10, 64):
        for _ in range(200):
            lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 40))]
            windows = best_fit_decreasing(lengths, window)
            assert sorted(i for w in windows for i in w) == list(range(len(lengths)))
            assert sorted(window - sum(lengths[i] for i in w) for w in windows) == naive(lengths, window)


def test_settle_pads_little():
    rng = random.Random(4)
    for n in (1, 2, 7, 300):
        pieces = [(i, 0, rng.randint(1, 4096)) for i in range(n)]
        windows = settle(pieces)
        spread = defaultdict(list)
        for w in windows:
            used = sum(p[2] for p in w)
            assert used >= 15 / 16 * 4096 or not used & (used - 1)
            for d, start, length in w:
                spread[d].append((start, length))
        for d, _, length in pieces:
            at = 0
            for start, size in sorted(spread[d]):
                assert start == at
                at += size
            assert at == length


def test_words_give_the_ids_of_whole_texts():
    tok = Tokenizer.from_file(PATH)
    for text, ids in zip(TEXTS, Encoder(PATH, None, 10)([t or "" for t in TEXTS]), strict=True):
        assert list(np.frombuffer(ids, "<u4")) == tok.encode(text or "", add_special_tokens=False).ids


def test_pieces_cover_every_document(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = pack_documents(docs, PATH, shard_tokens=5000).collect()
    tok = Tokenizer.from_file(PATH)
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _ in rows}
    seen, places = defaultdict(list), defaultdict(list)
    for r in got:
        seen[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
        places[r.sequence_id].append((r.offset, r.length))
    for doc_id, ids in want.items():
        whole = b"".join(x for _, x, _ in sorted(seen[doc_id]))
        assert whole == np.array(ids, "<u4").tobytes() and {n for *_, n in seen[doc_id]} == {len(ids)}
        assert zlib.crc32(whole) >= 0
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_other_tokenizers():
    """Ids are the tokenizer's own, whether or not its rules are those that are known here."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from strandloom.llm.packing import PROBE, Encoder

    said = [PROBE, "", " two  blanks\n", "Plain words 123 and don't", "\x1c odd"]
    for name, known in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        path = str(public_tokenizers.path(name))
        encoder, whole = Encoder(path, None), Tokenizer.from_file(path)
        assert encoder.by_words == known
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder(said)] == [whole.encode(t, add_special_tokens=False).ids for t in said]
