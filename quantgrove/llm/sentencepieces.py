"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over all pieces reads a text once. At each place it
follows its output links through the pieces that end there, longest first, and
relaxes the best score of the prefix that ends there; walking back from the
end gives the best segmentation. The score of a segmentation is the sum of its
pieces' scores in the model file; of two that are equal the one whose last
piece is longer wins, as in the library's own lattice. A character without a
piece becomes its UTF-8 bytes' pieces.

No piece of a supported model holds a word mark after another character (this
is checked on loading), so words are segmented one by one and a worker
remembers the words it has met; the result is that of the whole text.

Decoding joins pieces, turns word marks into spaces and bytes into characters,
and drops the one space that encoding put in front. A text comes back as it
was, but for word marks that it held itself, which become spaces.

Defined results: a null text counts as empty; an empty text has no ids.
Null doc_ids and repeated rows are carried along. Columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quantgrove.llm.common import batch_of, documents_of

MARK = "▁"
#: Words that a worker remembers at most; beyond, it starts anew.
REMEMBERED = 700_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Automaton, scores and bytes of a model's pieces."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton = ahocorasick.Automaton()
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        chars = set()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_ids[b] = i
                self.bytes_of.append(bytes([b]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"a word mark inside piece {i}")
                self.automaton.add_word(piece, (len(piece), model.get_score(i), i))
                self.bytes_of.append(piece.replace(MARK, " ").encode())
                if len(piece) == 1:
                    chars.add(piece)
        for piece in self.automaton:
            if not chars.issuperset(piece):
                raise ValueError(f"a piece with a character that is no piece: {piece}")
        self.automaton.make_automaton()
        self.chars = chars
        self.unknown = re.compile(f"([^{''.join(map(re.escape, sorted(chars)))}])")
        self.words: dict[str, bytes] = {}

    def best(self, text: str) -> list[int]:
        """Ids of the best segmentation of a text of known characters: one pass, then back."""
        n = len(text)
        scores, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        for end, piece in self.automaton.iter(text):
            s = scores[end + 1 - piece[0]] + piece[1]
            if s > scores[end + 1]:
                scores[end + 1], back[end + 1] = s, piece
        ids = []
        while n:
            length, _, i = back[n]
            ids.append(i)
            n -= length
        ids.reverse()
        return ids

    def word(self, text: str) -> bytes:
        if self.chars.issuperset(text):
            ids = self.best(text)
        else:
            ids = []
            for i, part in enumerate(self.unknown.split(text)):
                ids += [self.byte_ids[b] for b in part.encode("utf-8", "surrogatepass")] if i % 2 else self.best(part)
        return np.array(ids, "<u2").tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<u2")
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            parts = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + text.replace(" ", MARK))
        else:
            parts = [MARK + w for w in text.split(" ")]
        ids = list(map(self.words.get, parts))
        at = -1
        while True:
            try:
                at = ids.index(None, at + 1)
            except ValueError:
                break
            p = parts[at]
            ids[at] = self.words.get(p)
            if ids[at] is None:
                ids[at] = self.words[p] = self.word(p)
        return np.frombuffer(b"".join(ids), "<u2")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


@cache
def pieces(path: str) -> Pieces:
    """One automaton per worker process and file."""
    return Pieces(path)


def encode_decode(documents: DataFrame, model: str | None = None, keep: bool = False) -> DataFrame:
    """Per document: how many ids, their crc32, the decoded text's digest, whether it is the text again.

    With ``keep`` the ids (unsigned 32-bit, little-endian) and the decoded text come along.
    """
    path = model or default_model()
    fields = [("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())]
    out = pa.schema(fields + ([("ids", pa.binary()), ("decoded", pa.string())] if keep else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in batches:
            doc_ids, texts = (b.column(i).to_pylist() for i in range(2))
            for i in range(0, len(texts), 500):
                cols: dict[str, list] = {f.name: [] for f in out}
                for doc_id, text in zip(doc_ids[i : i + 500], texts[i : i + 500], strict=True):
                    ids = p.encode(text)
                    back = p.decode(ids)
                    raw = ids.astype("<u4").tobytes()
                    row = (doc_id, len(ids), crc32(raw), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text.replace(MARK, " "), raw, back)
                    for k, v in zip(cols, row):
                        cols[k].append(v)
                yield batch_of(out, cols)

    ddl = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + (", ids binary, decoded string" if keep else "")
    return documents_of(documents).mapInArrow(run, ddl)
