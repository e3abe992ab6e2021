"""Token ids of whole texts through the tokenizers library, with a bounded memory of words.

The tokenizers of these operators never join text across the start of a run of white
space, so a text is cut before each such run, each piece is looked up in a table of
pieces seen before, and only new pieces go through the library, a batch at a time.
Texts whose white space leaves that in doubt are cut more carefully or not at all.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Memory of a worker: so many pieces, each of at most so many characters.
CACHE_PIECES = 600_000
LONGEST_PIECE = 48
#: Pieces that go through the library together.
AT_ONCE = 32_768
JOINED = 4096

_run_then_space = re.compile(r"\s ")
_separators = re.compile(r"[\x1c-\x1f]")
#: letters of one code point that no normalization form C composes further
_latin = re.compile(r"[\t\n\r -~\xa1-\u024f]*")
_careful = re.compile(r"\s*\S+|\s+")


class PieceEncoder:
    """Encodes texts to the bytes of their ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.cache_pieces = cache_pieces
        #: whether the tokenizer lower-cases, so that texts may be lower-cased before they are looked up
        self.lowers = '"Lowercase"' in json.dumps(json.loads(self.tokenizer.to_str())["normalizer"])
        #: bytes of text that each id stands for; a token's characters are bytes but for a mark of the word's end
        self.stands_for = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.stands_for[i] = len(token.removesuffix("</w>"))
        #: whether a token's characters are bytes, so that this holds beyond ASCII
        self.of_bytes = '"ByteLevel"' in json.dumps(json.loads(self.tokenizer.to_str())["pre_tokenizer"])
        self.drops_space = int(self.stands_for[self.tokenizer.encode(" a", add_special_tokens=False).ids].sum()) == 1
        #: parts that follow a space (or, marked, the start of a text); whole pieces of doubtful texts
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({"\0": b""}, {})

    #: what marks the first part of a text, which no space precedes
    mark = "\0"

    def doubtful(self, text: str) -> bool:
        """Whether the white space is such that cutting at each space might be wrong."""
        return "\0" in text or _run_then_space.search(text) is not None

    def careful(self, text: str) -> list[str]:
        """The pieces of a doubtful text."""
        return [text] if _separators.search(text) else _careful.findall(text)

    def fresh(self, pieces: list[str]) -> Iterable[bytes]:
        """The ids of pieces not seen before.

        ASCII pieces that follow a space go through the library joined, those of Latin letters
        too where tokens are of bytes, and the ids are dealt out by the bytes that each stands
        for; should these not come out even, and for all other pieces, each goes alone.
        """
        out: list[bytes | None] = [None] * len(pieces)
        joined: tuple[list[int], list[int]] = ([], [])
        for i, p in enumerate(pieces):
            if p[:1] == " " and not p[-1].isspace():
                if p.isascii():
                    joined[0].append(i)
                elif self.of_bytes and _latin.fullmatch(p):
                    joined[1].append(i)
        for part in (x[at : at + JOINED] for x in joined for at in range(0, len(x), JOINED)):
            texts = [pieces[i] for i in part]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, "<u4")
            reach = np.cumsum(self.stands_for[ids])
            plain = ["".join(t.split()) for t in texts] if self.drops_space else texts
            if not plain[0].isascii():
                plain = [(t.lower() if self.lowers else t).encode() for t in plain]
            wanted = np.cumsum([len(t) for t in plain])
            stops = np.searchsorted(reach, wanted)
            if len(reach) and reach[-1] == wanted[-1] and (reach[stops] == wanted).all():
                data, bounds = ids.tobytes(), ((stops + 1) * 4).tolist()
                for i, a, b in zip(part, [0, *bounds], bounds):
                    out[i] = data[a:b]
        alone = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(alone, self._alone([pieces[i] for i in alone])):
            out[i] = ids
        return out

    def _alone(self, pieces: list[str]) -> Iterable[bytes]:
        for at in range(0, len(pieces), AT_ONCE):  # the library's results are large
            for e in self.tokenizer.encode_batch_fast(pieces[at : at + AT_ONCE], add_special_tokens=False):
                yield array("I", e.ids).tobytes()

    def _ids_of(self, words: list[str], doubtful: bool) -> list[bytes]:
        """The ids of different parts; unknown ones go through the library together."""
        known = self.known[doubtful]
        found = list(map(known.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            new = [words[i] for i in missing]
            whole = new if doubtful else [w[1:] if self.mark and w[:1] == self.mark else " " + w for w in new]
            for i, w, ids in zip(missing, new, self.fresh(whole)):
                found[i] = ids
                if len(w) <= LONGEST_PIECE and len(known) < self.cache_pieces:
                    known[w] = ids
        return found

    def _spaced(self, texts: pa.Array) -> list[bytes]:
        """Texts whose only white space before a space is none: cut at spaces, looked up once per different part."""
        if self.lowers:
            texts = pc.ascii_lower(texts)
        marked = pc.binary_join_element_wise(self.mark, texts, "")
        lists = pc.split_pattern(marked, " ")
        coded = lists.flatten().dictionary_encode()
        ids = self._ids_of(coded.dictionary.to_pylist(), False)
        codes = coded.indices.to_numpy()
        flat = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        starts = np.cumsum(sizes) - sizes
        each = sizes[codes]
        ends = np.cumsum(each)
        at = np.repeat(starts[codes] - (ends - each), each)
        at += np.arange(len(at))
        bounds = np.concatenate(([0], ends))[lists.offsets.to_numpy() - lists.offsets[0].as_py()] * 4
        data = flat[at].tobytes()
        return [data[a:b] for a, b in pairwise(bounds.tolist())]

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        out: list[bytes] = [b""] * len(column)
        values = column.to_pylist()
        doubtful = np.array([self.doubtful(t) for t in values], bool)
        if not doubtful.all():
            plain = np.flatnonzero(~doubtful)
            for i, ids in zip(plain.tolist(), self._spaced(column if len(plain) == len(column) else column.take(pa.array(plain)))):
                out[i] = ids
        for i in np.flatnonzero(doubtful).tolist():
            out[i] = b"".join(self._ids_of(self.careful(values[i]), True))
        return out


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str, cache_pieces: int = CACHE_PIECES) -> PieceEncoder:
    """The encoder of this worker, with a table of so many pieces; it outlives a task, as workers are used again."""
    if (path, cache_pieces) not in _encoders:
        _encoders[path, cache_pieces] = PieceEncoder(path, cache_pieces)
    return _encoders[path, cache_pieces]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(sizes: list[int], most: int):
    """Ranges of rows whose sizes sum to ``most`` or are a single row."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_sizes(texts: pa.Array) -> list[int]:
    """Bytes of each text; 0 for null."""
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()
