"""SentencePiece encoding and decoding with a unigram model.

A text's spaces become the white-space marker, one marker goes before the text, and the
pieces of largest summed log score are found by Viterbi over a double-array trie. Characters
in no piece, and markers that stand in the text itself, become byte pieces. No piece holds a
marker after another character, so a text is cut before each run of spaces, and pieces of
text seen before are looked up; new ones go through Viterbi together, all words of one
length at once. Decoding joins pieces and bytes, turns markers into spaces and drops the
first; it gives back every text exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, require
from .tokenization import CACHE_PIECES, PieceEncoder, slices, text_sizes, tokenizer_path

MARKER = "▁"
#: A character in no piece scores the least piece's score less this.
UNKNOWN_PENALTY = 10.0
#: Shift of ranks in the law log p = -log(rank + shift), up to a constant.
RANK_SHIFT = 2.7
_chunks = re.compile(" +[^ ]*|[^ ]+")


@dataclass
class PieceTable:
    """Pieces by id, spaces for markers; ``bytes_of[b]`` is the id of byte b."""

    pieces: list[bytes]
    scores: np.ndarray  # float32, of normal pieces; others are never matched
    normal: np.ndarray
    byte_ids: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    longest: int
    unknown: np.float32


def log_scores(scores: np.ndarray) -> np.ndarray:
    """Log scores of pieces: their own, but where a vocabulary stores merge ranks, the log of a Zipf law of the rank.

    Scores that are all whole numbers are ranks; equal ones rank in the order of ids.
    """
    if len(scores) > 1 and (scores == np.round(scores)).all():
        rank = np.empty(len(scores))
        rank[np.argsort(-scores.astype(np.float64), kind="stable")] = np.arange(len(scores))
        law = -np.log(rank + RANK_SHIFT)
        return (law - np.log(np.exp(law).sum())).astype(np.float32)
    return scores.astype(np.float32)


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A double-array trie: from state s, byte c leads to base[s] + c + 1 if check there is s; value is -1 inside."""
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for key, v in zip(keys, values):
        node = 0
        for c in key:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
            node = children[node][c]
        ends[node] = v
    size = 2 * len(children) + 512
    base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    used = bytearray(size)
    used[0] = 1
    used[1:257] = b"\1" * 256  # so that a single child can always take the lowest gap
    queue, lowest, hint = [(0, 0)], 257, 257
    for node, state in queue:
        value[state] = ends.get(node, -1)
        if not children[node]:
            continue
        codes = sorted(children[node])
        # single children fill the gaps; families look on from where the last one went
        at = lowest - codes[0] - 1 if len(codes) == 1 else hint
        while any([used[at + c + 1] for c in codes]):
            at += 1
            if at + 600 > len(used):
                used.extend(bytes(size))
                base, check, value = (np.concatenate((a, np.full(size, f, np.int64))) for a, f in ((base, 0), (check, -1), (value, -1)))
        if len(codes) > 1:
            hint = at + 1
        base[state] = at
        for c in codes:
            used[at + c + 1] = 1
            check[at + c + 1] = state
            queue.append((children[node][c], at + c + 1))
        while used[lowest]:
            lowest += 1
    pad = np.full(300, -1, np.int64)
    return np.concatenate((base, pad)), np.concatenate((check, pad)), np.concatenate((value, pad))


def piece_table(path: str) -> PieceTable:
    """Read a SentencePiece model's pieces and build the trie of the normal ones."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    text = [model.id_to_piece(i) for i in range(n)]
    is_byte = np.array([model.is_byte(i) for i in range(n)])
    normal = np.array([not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)])
    if int(is_byte.sum()) != 256:
        raise ValueError("the model has no byte pieces")
    if any(MARKER in t.lstrip(MARKER) for t, k in zip(text, normal) if k):
        raise ValueError("a piece holds a white-space marker after another character")
    byte_ids = np.zeros(256, np.int64)
    pieces = []
    for i, t in enumerate(text):
        if is_byte[i]:
            byte_ids[int(t[3:5], 16)] = i
            pieces.append(bytes([int(t[3:5], 16)]))
        else:
            pieces.append(t.replace(MARKER, " ").encode() if normal[i] else b"")
    at = np.flatnonzero(normal)
    scores = np.full(n, -np.inf, np.float32)
    scores[at] = log_scores(np.array([model.get_score(int(i)) for i in at]))
    keys = [pieces[i] for i in at]
    base, check, value = double_array(keys, at.tolist())
    return PieceTable(pieces, scores, normal, byte_ids, base, check, value, max(map(len, keys)), np.float32(scores[at].min() - UNKNOWN_PENALTY))


def viterbi(words: np.ndarray, t: PieceTable) -> tuple[np.ndarray, np.ndarray]:
    """Best pieces of words of one byte length (words x length): ids from the last to the first, and their number.

    -1 stands for a byte of a character in no piece.
    """
    count, length = words.shape
    best = np.full((count, length + 1), -np.inf, np.float32)
    best[:, 0] = 0
    step = np.zeros((count, length + 1), np.int32)
    piece = np.full((count, length + 1), -1, np.int64)
    starts = (words & 0xC0) != 0x80
    sizes = np.select([words < 0x80, words < 0xE0, words < 0xF0], [1, 2, 3], 4)
    for i in range(length):
        rows = np.flatnonzero(starts[:, i])
        ends = np.minimum(i + sizes[rows, i], length)  # a character in no piece
        score = best[rows, i] + t.unknown
        better = score > best[rows, ends]
        r, e = rows[better], ends[better]
        best[r, e], step[r, e], piece[r, e] = score[better], e - i, -1
        state = np.zeros(len(rows), np.int64)
        for end in range(i + 1, min(i + t.longest, length) + 1):
            to = t.base[state] + words[rows, end - 1] + 1
            alive = t.check[to] == state
            rows, state = rows[alive], to[alive]
            if not len(rows):
                break
            found = t.value[state]
            hit = found >= 0
            r, ids = rows[hit], found[hit]
            score = best[r, i] + t.scores[ids]
            better = score > best[r, end]
            r, ids = r[better], ids[better]
            best[r, end], step[r, end], piece[r, end] = score[better], end - i, ids
    at, rows = np.full(count, length), np.arange(count)
    columns = []
    while len(rows):
        column = np.full(count, -2, np.int64)
        column[rows] = piece[rows, at[rows]]
        back = step[rows, at[rows]]
        unknown = rows[column[rows] == -1]
        columns.append(column)
        if len(unknown):  # a byte at a time
            at[unknown] -= 1
            known = column[rows] != -1
            at[rows[known]] -= back[known]
            inner = unknown[(at[unknown] > 0) & ~starts[unknown, np.minimum(at[unknown], length - 1)]]
            piece[inner, at[inner]], step[inner, at[inner]] = -1, 1
        else:
            at[rows] -= back
        rows = rows[at[rows] > 0]
    ids = np.stack(columns, 1) if columns else np.zeros((count, 0), np.int64)
    return ids, (ids != -2).sum(1)


class UnigramEncoder(PieceEncoder):
    """Encodes texts with a piece table; see ``PieceEncoder`` for how words are remembered."""

    mark = ""  # a marker goes before every text, so its first word follows a space like the others

    def __init__(self, table: PieceTable, cache_pieces: int = CACHE_PIECES):
        self.table = table
        self.cache_pieces = cache_pieces
        self.lowers = False
        self.known = ({}, {})

    def doubtful(self, text: str) -> bool:
        return "  " in text or text.startswith(" ")

    def careful(self, text: str) -> list[str]:
        return _chunks.findall(" " + text) if text else []

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        return [ids if text else b"" for ids, text in zip(super().encode(texts), texts.to_pylist() if isinstance(texts, pa.Array) else texts)]

    def fresh(self, pieces: list[str]) -> Iterable[bytes]:
        raw = [p.encode() for p in pieces]
        out: list[bytes] = [b""] * len(raw)
        by_length: dict[int, list[int]] = {}
        for i, r in enumerate(raw):
            by_length.setdefault(len(r), []).append(i)
        for length, at in by_length.items():
            room = max(1, 4_000_000 // (length + 1))
            for lo in range(0, len(at), room):
                part = at[lo : lo + room]
                words = np.frombuffer(b"".join([raw[i] for i in part]), np.uint8).reshape(len(part), length).astype(np.int64)
                ids, counts = viterbi(words, self.table)
                flat = ids[:, ::-1]
                odd = (flat == -1).any(1)
                packed = np.ascontiguousarray(flat[flat != -2]).astype("<u4")
                ends = np.cumsum(counts)
                data = packed.tobytes()
                for i, a, b, o in zip(part, (4 * (ends - counts)).tolist(), (4 * ends).tolist(), odd.tolist()):
                    out[i] = self._with_bytes(raw[i], packed[a // 4 : b // 4]) if o else data[a:b]
        return out

    def _with_bytes(self, raw: bytes, ids: np.ndarray) -> bytes:
        """Fill in the ids of single bytes."""
        at, filled = 0, []
        for i in ids.astype(np.int64).tolist():
            if i == 0xFFFFFFFF:
                filled.append(int(self.table.byte_ids[raw[at]]))
                at += 1
            else:
                filled.append(i)
                at += len(self.table.pieces[i])
        return np.array(filled, "<u4").tobytes()


def decode_pieces(ids: bytes, table: PieceTable) -> str:
    """The text of ids: pieces and bytes joined, markers as spaces, the first one dropped."""
    pieces = table.pieces
    text = b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])
    return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


_workers: dict[str, UnigramEncoder] = {}


def _encoder(key: str, table: PieceTable) -> UnigramEncoder:
    if key not in _workers:
        _workers[key] = UnigramEncoder(table)
    return _workers[key]


def encode_documents(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(doc_id, token_ids binary, n_tokens, n_bytes) per row, and with ``decode`` (decoded) from the ids.

    ``token_ids`` are little-endian unsigned 32-bit; ``n_bytes`` counts byte pieces. Null and
    empty texts have no ids and decode to empty. Repeated rows and null ids stay; other
    columns are not read. A piece of text without a space is held in memory whole.
    """
    require(docs, id_col, text_col)
    path = model or tokenizer_path("piece_bpe_32k.model")
    shared = docs.sparkSession.sparkContext.broadcast(piece_table(path))
    names = ["doc_id", "token_ids", "n_tokens", "n_bytes", *["decoded"] * decode]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        encode = _encoder(path, table).encode
        is_byte = np.zeros(len(table.pieces), bool)
        is_byte[table.byte_ids] = True
        for batch in batches:
            for lo, hi in slices(text_sizes(batch.column(1)), 4_000_000):
                got = encode(batch.column(1).slice(lo, hi - lo))
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(got, pa.binary()), pa.array([len(g) // 4 for g in got], pa.int64())]
                columns.append(pa.array([int(is_byte[np.frombuffer(g, "<u4")].sum()) for g in got], pa.int64()))
                if decode:
                    columns.append(pa.array([decode_pieces(g, table) for g in got], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    out = f"doc_id {kind}, token_ids binary, n_tokens bigint, n_bytes bigint" + ", decoded string" * decode
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), out)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Encodes and decodes all documents: ids' digest, and the digest of the text decoded from them."""
    found = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), decode=True)
    return found.select("doc_id", "n_tokens", "n_bytes", F.crc32("token_ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"))
