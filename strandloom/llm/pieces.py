"""SentencePiece models encoded and decoded by the tokenizers library.

The model file's protobuf is parsed here: pieces with scores and kinds, the model type, the normaliser's character map and its flags. From it a
tokenizer is rebuilt: precompiled normaliser, metaspace marker, and either a unigram model with the pieces' scores or, for a BPE model,
merges in the order of the merged pieces' scores, both with byte fallback.

Whole texts are encoded, a batch in one multithreaded call. Decoding joins what the library's decoder makes of single pieces and of runs of bytes. On request the sentencepiece library encodes each whole text
too, and `parity` says whether it finds the same ids; the ids are the tokenizers library's own in any case. One known difference: with a character
map, its normaliser takes a letter with several accents as one and may lose all but the first.

Defined cases: null is empty and has no ids; repeated rows are encoded each; null ids decode to an empty text; ids out of range and control ids decode
to nothing; an empty table stays empty; extra columns are kept (a clash with a column that is added drops the input's).
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .columnar import slices, texts, widened

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in the file format
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """What a model file says."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.path, self.pieces, self.scores, self.kinds = path, [], [], []
        self.type, self.byte_fallback, self.unknown = UNIGRAM, False, 0
        self.charsmap, self.dummy_prefix, self.squeeze, self.mark_spaces = b"", True, True, True
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
                self.type, self.byte_fallback, self.unknown = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), trainer.get(40, 0)
            elif number == 3:
                spec = dict(fields(value))
                self.charsmap, self.dummy_prefix, self.squeeze, self.mark_spaces = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, the best score first."""
        known = {p for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER)}
        order = sorted((-s, i) for i, (s, k) in enumerate(zip(self.scores, self.kinds, strict=True)) if k == NORMAL)
        return [(p[:cut], p[cut:]) for p in (self.pieces[i] for _, i in order) for cut in range(1, len(p)) if p[:cut] in known and p[cut:] in known]

    def tokenizer(self):
        """Of the tokenizers library, for text that is normalised and marked already. Names of pieces that a text can't hold by itself are hidden from
        a unigram model, which would match them; PieceEncoder then spells unknown characters in bytes."""
        from tokenizers import Tokenizer, decoders, models

        if self.type == BPE:
            ids = {p: i for i, p in enumerate(self.pieces)}
            model = models.BPE(ids, self.merges(), unk_token=self.pieces[self.unknown], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            model = models.Unigram([(p if k in (NORMAL, USER) else f"\0hidden {i}\0", s) for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds, strict=True))], self.unknown, False)
        out = Tokenizer(model)
        strip = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
        return out


class PieceEncoder:
    def __init__(self, path: str, parity: bool = True):
        """`parity` asks for the other library beside."""
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        from tokenizers import normalizers

        self.model = PieceModel(path)
        self.tokenizer = self.model.tokenizer()
        self.normalizer = normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None
        names = [" \u2047 " if k == UNKNOWN else "" if k == CONTROL else p for p, k in zip(self.model.pieces, self.model.kinds, strict=True)]
        decode = self.tokenizer.decoder.decode
        self.names = np.array(names, object)
        # what the library's decoder makes of each piece inside a text; it is asked again for the first piece and for bytes in a row
        self.inside = np.array([decode(["|", n])[1:] for n in names], object)
        self.byte, self.silent = (np.array([k == kind for k in self.model.kinds]) for kind in (BYTE, CONTROL))
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.model.pieces, self.model.kinds, strict=True)) if k == BYTE}
        self.spells = self.model.type == UNIGRAM and self.model.byte_fallback
        self.reference = None
        if parity:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_file=path)

    def marked(self, text: str) -> str:
        """Normalised, with markers for blanks."""
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        if self.model.squeeze:
            text = re.sub(" {2,}", " ", text).strip(" ")
        if text and self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.model.mark_spaces else text

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        marked = [self.marked(t) for t in batch]
        found = [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(marked, add_special_tokens=False)]
        if self.spells:
            found = [self._spelled(t) if self.model.unknown in ids else ids for t, ids in zip(marked, found, strict=True)]
        return found

    def _spelled(self, marked: str) -> np.ndarray:
        """The ids of a text, those of bytes for characters that the model doesn't know."""
        found, out = self.tokenizer.encode(marked, add_special_tokens=False), []
        for i, (a, b) in zip(found.ids, found.offsets, strict=True):
            out += [self.byte_ids[x] for x in marked[a:b].encode()] if i == self.model.unknown else [i]
        return np.array(out, "<u4")

    def parity(self, batch: list[str], ids: list[np.ndarray]) -> list[bool]:
        """Whether the other library, given a text as it is, finds these ids."""
        return [np.array_equal(np.array(want, "<u4"), have) for want, have in zip(self.reference.encode(batch, num_threads=1), ids, strict=True)]

    def decode(self, batch: list[np.ndarray]) -> list[str]:
        return [self._decoded(ids[ids < len(self.names)]) for ids in batch]

    def _decoded(self, ids: np.ndarray) -> str:
        ids = ids[~self.silent[ids]]
        if not len(ids):
            return ""
        decode, said, byte = self.tokenizer.decoder.decode, self.inside[ids], self.byte[ids]
        if (byte[1:] & byte[:-1]).any():
            edge = np.flatnonzero(np.diff(byte, prepend=False, append=False)).reshape(-1, 2)
            for a, b in edge[edge[:, 1] > edge[:, 0] + 1].tolist():
                said[a:b] = ""
                said[a] = decode(["|", *self.names[ids[a:b]]])[1:]
        if not byte[0]:
            said[0] = decode([self.names[ids[0]]])
        return "".join(said.tolist())


def encode_pieces(docs: DataFrame, model_path: str, parity: bool = True, decoded: bool = False) -> DataFrame:
    """`docs` with `ids` (binary, little-endian uint32) and `n_ids`; on request with `parity`, and with the text that the ids decode to."""
    kinds = {"ids": "binary", "n_ids": "long"} | ({"parity": "boolean"} if parity else {}) | ({"decoded": "string"} if decoded else {})
    kept = docs.drop(*kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(model_path, parity)
        for batch in slices(batches):
            said = texts(batch.column("text"))
            ids = encoder.encode(said)
            more = [pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())]
            if parity:
                more.append(pa.array(encoder.parity(said, ids), pa.bool_()))
            if decoded:
                more.append(pa.array(encoder.decode(ids), pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *kinds])

    return kept.mapInArrow(run, widened(kept.schema, **kinds))


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """`encoded` with `decoded`, the text of its `ids`."""
    kept = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(model_path, False)
        for batch in slices(batches, "ids"):
            found = encoder.decode([np.frombuffer(x or b"", "<u4") for x in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, widened(kept.schema, decoded="string"))
