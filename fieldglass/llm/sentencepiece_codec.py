"""SentencePiece encoding and decoding that keeps the place of every piece.

The model's compiled character map is read here and applied by longest prefix,
so that every normalised byte knows the source byte it came from. Pieces are
then laid over the normalised bytes and projected to spans of source bytes.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import columns_only, whole

MARK = "▁"
_MARK3 = MARK.encode()
#: Encoded words that a worker keeps; the store is emptied when it is full.
STORE = 200_000
#: Documents whose words are looked up together.
SLICE = 256


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind)
            n = varint() if n is None else n
            yield key >> 3, buf[at : at + n]
            at += n


class CharacterMap:
    """Longest-prefix rewriting by a compiled character map (a double-array trie).

    The map is a little-endian length, the trie's units and the zero-ended
    replacements that its leaves point to. An empty map changes nothing.
    """

    def __init__(self, blob: bytes = b"") -> None:
        self.units = np.zeros(0, dtype=np.uint32).tolist()
        self.out = b""
        if blob:
            n = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4 : 4 + n], dtype="<u4").tolist()
            self.out = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest rule that starts at ``at``, and its replacement."""
        units, found, node = self.units, None, 0
        if not units:
            return None
        node ^= self._child(units[0])
        for k in range(at, len(data)):
            b = data[k]
            node ^= b
            if node >= len(units) or units[node] & 0x800000FF != b:
                break
            unit = units[node]
            node ^= self._child(unit)
            if unit >> 8 & 1:
                found = (k + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.out.index(b"\0", found[1])
        return found[0], self.out[found[1] : end]

    @staticmethod
    def _child(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def apply(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Rewritten bytes, and the source offset of each of them and of the end."""
        if not self.units:
            return data, np.arange(len(data) + 1, dtype=np.int64)
        out, places, at = bytearray(), [], 0
        while at < len(data):
            rule = self.longest(data, at)
            if rule is None:
                lead = data[at]
                n = 1 if lead < 192 else 2 if lead < 224 else 3 if lead < 240 else 4
                rule = n, data[at : at + n]
            out += rule[1]
            places += [at] * len(rule[1])
            at += rule[0]
        return bytes(out), np.array([*places, len(data)], dtype=np.int64)


class PieceCodec:
    """One model: exact ids of whole texts, their spans and their decoding.

    No piece of a byte-pair model that this class accepts holds a space mark
    after another character (checked here), so merges never cross the border
    before a run of marks. Texts are cut at those borders and every distinct
    word is encoded once by the model; ids, piece lengths and decoded text of
    a document are joined from its words.
    """

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        spec: dict[int, object] = {}
        trainer: dict[int, object] = {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.kinds.append(int(piece.get(3, 1)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                spec = dict(_fields(value))
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix = bool(spec.get(3, 1))
        self.squeeze = bool(spec.get(4, 1))
        self.plain = (
            not self.map.units and self.prefix and not self.squeeze and bool(spec.get(5, 1))
            and trainer.get(3, 1) == 2 and not trainer.get(24, 0)
            and not any(k in (4,) for k in self.kinds)
            and not any(MARK in p.lstrip(MARK) for p in self.pieces)
        )
        #: Bytes of normalised text under each piece, and text of each piece.
        self.width = np.array([1 if k == 6 else len(p.encode()) for p, k in zip(self.pieces, self.kinds)], dtype=np.int64)
        self.raw = [bytes([int(p[3:5], 16)]) if k == 6 else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds)]
        #: Decimal ids, each with a comma behind it, padded by zero bytes.
        self.names = np.zeros((len(self.pieces), 6), dtype=np.uint8)
        for i in range(min(len(self.pieces), 65536)):
            self.names[i, : len(f"{i},")] = list(f"{i},".encode())
        self.plain = self.plain and len(self.pieces) <= 65536
        self.mark = self.sp.piece_to_id(MARK)
        self.store: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Stores the ids of words, packed.

        Each word starts with a space, which stands for the mark that the
        model itself puts before a text.
        """
        found = self.sp.encode([w[1:] for w in words], num_threads=1)
        self.store.update(zip(words, [np.array(ids, dtype=np.uint16).tobytes() if len(ids) > 60 else array("H", ids).tobytes() for ids in found]))
        if " " in self.store:
            self.store[" "] = array("H", [self.mark]).tobytes()

    def encode(self, text: str) -> tuple[str, int, np.ndarray, str]:
        return next(self.encode_many([text]))

    def encode_many(self, texts: list[str]) -> Iterator[tuple[str, int, np.ndarray, str]]:
        """For each text the ids joined by commas, their number, piece borders in source bytes, decoded text.

        Piece i covers source bytes borders[i] to borders[i + 1].
        """
        cut = [_WORD.findall(" " + t) if t and self.plain and MARK not in t else None for t in texts]
        wanted = set().union(*[words for words in cut if words])
        new = wanted.difference(self.store)
        if len(self.store) + len(new) > STORE:
            self.store.clear()
            new = wanted
        if new:
            self._learn(list(new))
        for text, words in zip(texts, cut):
            if not text:
                yield "", 0, np.zeros(1, dtype=np.int64), ""
            elif words is None:
                yield self._general(text)
            else:
                ids = np.frombuffer(b"".join(map(self.store.__getitem__, words)), dtype=np.uint16)
                borders = self.borders(text, self.width[ids])
                digits = self.names[ids].ravel()
                joined = digits[digits != 0][:-1].tobytes().decode()
                yield joined, len(ids), borders, self.decode(ids)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids that started with the added mark, as the model decodes it."""
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]

    def borders(self, text: str, widths: np.ndarray) -> np.ndarray:
        """Source bytes where the pieces of a text begin, and its end, by the normalised bytes under each piece."""
        _, places = self._normal(text.encode(), False)
        return places[np.minimum(np.concatenate([[0], np.cumsum(widths)]), len(places) - 1)]

    def _general(self, text: str) -> tuple[str, int, np.ndarray, str]:
        """The same for any model and text: the model's ids, laid over the mapped text."""
        ids = self.sp.encode(text)
        normal, _ = self._normal(text.encode())
        widths, at = [], 0
        for i in ids:
            width = int(self.width[i])
            if self.kinds[i] == 2:  # unknown: one character of the normalised text
                lead = normal[at]
                width = 1 if lead < 192 else 2 if lead < 224 else 3 if lead < 240 else 4
            widths.append(width)
            at += width
        return ",".join(map(str, ids)), len(ids), self.borders(text, np.array(widths, dtype=np.int64)), self.sp.decode(ids)

    def _normal(self, data: bytes, wanted: bool = True) -> tuple[bytes, np.ndarray]:
        """Bytes rewritten by the character map, marks for spaces (if ``wanted``), and the source place of each of them and of the end."""
        mapped, places = self.map.apply(data)
        raw = np.frombuffer(mapped, dtype=np.uint8)
        space = raw == 32
        at, end = places[:-1], places[-1:]
        if self.squeeze and len(raw):
            keep = np.ones(len(raw), dtype=bool)
            word = np.flatnonzero(~space)
            keep[: word[0] if len(word) else len(raw)] = False
            keep[word[-1] + 1 if len(word) else 0 :] = False
            keep[1:] &= ~(space[1:] & space[:-1])
            if keep.any():
                end = places[np.flatnonzero(keep)[-1] + 1 :][:1]
            raw, space, at = raw[keep], space[keep], at[keep]
        times = np.where(space, 3, 1).astype(np.int8)
        if self.prefix and len(at):
            at, times = np.concatenate([at[:1], at]), np.concatenate([[3], times])
        out = b""
        if wanted:
            marked = np.concatenate([[32], raw]) if len(times) > len(raw) else raw
            wide = np.repeat(marked, times)
            first = (np.cumsum(times, dtype=np.int64) - times)[times == 3]
            for k, b in enumerate(_MARK3):
                wide[first + k] = b
            out = wide.astype(np.uint8).tobytes()
        return out, np.concatenate([np.repeat(at, times), end])


#: A run of spaces and the word behind it, or the spaces that end a text.
_WORD = re.compile(r" +[^ ]+| +$")


def encode_documents(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_pieces: bool = True
) -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    With ``keep_pieces`` also ``ids`` (comma-joined), ``starts`` and ``ends``
    (source byte span of every piece) and ``decoded``; otherwise the spans are
    told by ``spans_sha256`` (of their borders, as 64-bit little-endian
    numbers) and ``spans_ok``: they lie end to end over the whole source. Every
    text goes through the model's character map, which records where each
    normalised byte comes from; a map without rules keeps all bytes.
    Ids are those of the model without begin or end ids and without sampling.

    Null text is the empty text: no ids. Whole texts are encoded, however
    long. Repeated rows give repeated results, an empty table an empty one;
    other columns are ignored. The model is a file of fixed size that is
    broadcast once.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = columns_only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), whole(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    extra = ", ids string, starts array<long>, ends array<long>, decoded string" if keep_pieces else ", spans_sha256 string, spans_ok boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(shared.value)
        for whole_batch in batches:
            for at in range(0, max(whole_batch.num_rows, 1), SLICE):
                b = whole_batch.slice(at, SLICE)
                out: dict[str, list] = {k: [] for k in ("n", "ids_sha", "dec_sha", "ids", "starts", "ends", "decoded", "spans", "ok")}
                texts = b.column(1).to_pylist()
                for text, (ids, n, borders, decoded) in zip(texts, codec.encode_many(texts)):
                    out["n"].append(n)
                    out["ids_sha"].append(hashlib.sha256(ids.encode()).hexdigest())
                    out["dec_sha"].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if keep_pieces:
                        out["ids"].append(ids)
                        out["starts"].append(borders[:-1])
                        out["ends"].append(borders[1:])
                        out["decoded"].append(decoded)
                    else:
                        out["spans"].append(hashlib.sha256(borders.astype("<i8").tobytes()).hexdigest())
                        out["ok"].append(bool(borders[0] == 0 and borders[-1] == len(text.encode()) and (np.diff(borders) >= 0).all()))
                cols = [b.column(0), pa.array(out["n"], pa.int64()), pa.array(out["ids_sha"], pa.string()), pa.array(out["dec_sha"], pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_pieces:
                    cols += [pa.array(out["ids"], pa.string()), pa.array(out["starts"], pa.list_(pa.int64())),
                             pa.array(out["ends"], pa.list_(pa.int64())), pa.array(out["decoded"], pa.string())]
                    names += ["ids", "starts", "ends", "decoded"]
                else:
                    cols += [pa.array(out["spans"], pa.string()), pa.array(out["ok"], pa.bool_())]
                    names += ["spans_sha256", "spans_ok"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    out = rows.mapInArrow(run, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
    return out.withColumnRenamed("id", id_col)
