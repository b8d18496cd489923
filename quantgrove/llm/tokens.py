"""Token ids of whole texts, exactly as the tokenizers library gives them, at several times its speed.

The ids of a part of a text (a run of letters, a digit, a run of marks) do not
depend on the parts around it. So plain texts are cut into the parts that the
tokenizer itself cuts them into, many texts at once and by numpy on their
bytes; each distinct part goes through the library once per worker, and the
ids of all parts are gathered by number. A text with other characters is cut
at white space only, where the same holds, and its distinct chunks go through
the library.
"""

from __future__ import annotations

import re
from functools import cache, cached_property

import numpy as np
import pyarrow as pa

#: The end id that follows every document.
END = 2
#: Letters whose class no Unicode version changes: Basic Latin, Latin-1 and Latin Extended A and B.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: What a plain text may hold: no apostrophe, as the tokenizer cuts after some of them.
_PLAIN = re.compile(rf"[\t\n\r -&(-~{_LETTERS}]*")
#: What ends a plain text among others, its blanks, and what may be cut after: only a run of letters or of marks stays whole.
_STOP, _BLANK = b"\0", b"\t\n\r "
_CUT = re.compile(rb"[\0\t\n\r 0-9]|[a-z](?=[!-/:-@\[-`{-~])")
#: Kind of every byte of lower-cased plain texts; digits and stops are parts of their own. Letters may lower to ones outside _LETTERS, so all beyond ASCII are letters but the dot that an İ leaves.
_SPACE, _LETTER, _MARK, _DIGIT, _END = 0, 1, 2, 4, 8
_KINDS = bytes(_SPACE if b in _BLANK else _END if b == 0 else _DIGIT if 48 <= b < 58 else _LETTER if b > 127 or chr(b).isalpha() else _MARK for b in range(256))
_DOT = "\u0307".encode()
#: White space for str.split that is none for the tokenizer.
_ODD = re.compile("[\x1c-\x1f]")
#: Parts of each of two generations, and chunks, that a worker remembers; parts in use move to the younger generation.
REMEMBERED = 400_000
#: Bytes of plain texts that are cut into parts at once, and what follows them up to a cut.
PIECE = 1 << 22


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _bytes_of(values: pa.BinaryArray) -> list[bytes]:
    """to_pylist(), without an object of Arrow for every value."""
    _, offsets, data = values.buffers()
    at, whole = np.frombuffer(offsets, np.int32, len(values) + 1, 4 * values.offset).tolist() if len(values) else [], data.to_pybytes() if data else b""
    return [whole[a:b] for a, b in zip(at, at[1:])]


class WordEncoder:
    """Encoder for a BPE file whose pre-tokenizer drops white space and ends words by ``</w>``."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # The same model for lower-case parts between blanks, without the passes that change nothing there; ASCII marks and letters stand for themselves.
        blanks = {"type": "WhitespaceSplit"}
        by_bytes = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.bare, self.bare_ascii = (Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": p})) for p in ({"type": "Sequence", "pretokenizers": [blanks, by_bytes]}, blanks))
        vocabulary = spec["model"]["vocab"]
        size = max(max(vocabulary.values()), *(t["id"] for t in spec["added_tokens"])) + 1
        if size > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        self.size = size
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        self.ends = np.zeros(size, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.chunks: dict[str, bytes] = {}
        self.end = np.array([END], "<u2").tobytes()
        self.parts: dict[bytes, bytes] = {_STOP: self.end}
        self.older: dict[bytes, bytes] = {}

    @cached_property
    def library(self):
        """The file as it is, for texts that aren't plain; many workers never need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _learn(self, todo: list[bytes]) -> None:
        """Ids of new parts, 500 to a call; a part's ids end where a word ends."""
        for bare, parts in ((self.bare_ascii, [p for p in todo if p.isascii()]), (self.bare, [p for p in todo if not p.isascii()])):
            for i in range(0, len(parts), 500):
                some = parts[i : i + 500]
                ids = np.array(bare.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u2")
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) != len(some):  # the file cuts parts otherwise than supposed
                    self.parts.update((p, self._library(p.decode())) for p in some)
                else:
                    whole, starts = ids.tobytes(), [0, *(2 * stops).tolist()]
                    self.parts.update(zip(some, (whole[a:b] for a, b in zip(starts, starts[1:]))))

    def _known(self, parts: list[bytes]) -> list[bytes]:
        """Ids of every part; those not in the younger generation are put there."""
        if len(self.parts) > REMEMBERED:
            self.older, self.parts = self.parts, {_STOP: self.end}
        known = list(map(self.parts.get, parts))
        if new := [i for i, ids in enumerate(known) if ids is None]:
            had = [(parts[i], self.older.get(parts[i])) for i in new]
            self.parts.update((p, ids) for p, ids in had if ids is not None)
            self._learn([p for p, ids in had if ids is None])
            for i in new:
                known[i] = self.parts[parts[i]]
        return known

    def _piece(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids, places where texts end among them) of plain texts, lower-cased, each with a stop after it."""
        kinds = np.frombuffer(bytearray(data.translate(_KINDS)), np.uint8)
        if _DOT in data:
            at = np.flatnonzero(np.frombuffer(data, np.uint8) == _DOT[0])  # no other letter begins with this byte
            kinds[at] = kinds[at + 1] = _MARK
        starts = np.concatenate([[0], np.flatnonzero((kinds[1:] != kinds[:-1]) | (kinds[1:] >= _DIGIT)) + 1])
        kind = kinds[starts]
        offsets = np.concatenate([[0], np.cumsum(np.diff(starts, append=len(data))[kind != _SPACE])]).astype(np.int32)
        solid = data.translate(None, _BLANK)
        parts = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(solid)]).dictionary_encode()
        known, which = self._known(_bytes_of(parts.dictionary)), parts.indices.to_numpy()
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 2
        begins, n = np.cumsum(sizes) - sizes, sizes[which]
        stops = np.cumsum(n)
        ids = np.frombuffer(b"".join(known), "<u2")[np.arange(n.sum()) + np.repeat(begins[which] - (stops - n), n)]
        return ids, stops[kind[kind != _SPACE] == _END]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        data = "".join(f"{t}\0" for t in texts).lower().encode()
        got, ends, at, before = [], [], 0, 0
        while at < len(data):
            cut = _CUT.search(data, at + PIECE)
            stop = cut.end() if cut else len(data)
            ids, places = self._piece(data[at:stop])
            got.append(ids)
            ends.extend((before + places).tolist())
            at, before = stop, before + len(ids)
        ids = np.concatenate(got)
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def _other(self, text: str) -> bytes:
        """A text that isn't plain: by chunks, or whole if even those could differ."""
        if _ODD.search(text) or any(s in text for s in self.special):
            return self._library(text)
        if len(self.chunks) > REMEMBERED:
            self.chunks.clear()
        chunks = text.split()
        self.chunks.update((c, self._library(c)) for c in set(chunks).difference(self.chunks))
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, each with the end id after it, as 16-bit integers."""
        plain = [bool(_PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        cut = iter(self._plain([t for t, p in zip(texts, plain) if p]) if any(plain) else ())
        return [next(cut) if p else np.frombuffer(self._other(t) + self.end, "<u2") for t, p in zip(texts, plain)]


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    return WordEncoder(path)
