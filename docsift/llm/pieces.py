"""SentencePiece encoding and decoding of a BPE model with byte fallback, without the library.

A model is read into arrays once and sent to the tasks (its size is that of the vocabulary). Texts are cut
into words in front of spaces, because no piece goes on behind a space; the different words of a chunk of texts
go through the merge rounds of ``merges`` together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docsift.llm.common import batch_of, chunks, shipped
from docsift.llm.merges import CachedEncoder, PairTable, merged_words

SPACE = "▁"
_NORMAL, _BYTE = 1, 6


class PieceModel:
    """Arrays of a SentencePiece BPE model: characters, pair ranks, and the bytes of every id."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, pieces = model.normalizer_spec, model.pieces
        plain = {p.piece: n for n, p in enumerate(pieces) if p.type == _NORMAL}
        if (
            model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap
            or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or {p.type for p in pieces} - {1, 2, 3, 6}
            or any(SPACE in piece.lstrip(SPACE) for piece in plain)
        ):
            raise ValueError("only BPE models with byte fallback, plain pieces and no normalisation are supported")
        self.size = len(pieces)
        byte_ids = {int(p.piece[3:5], 16): n for n, p in enumerate(pieces) if p.type == _BYTE}
        self.byte_ids = np.array([byte_ids[b] for b in range(256)], np.int32)
        self.byte_of = {n: bytes([b]) for b, n in byte_ids.items()}
        self.bytes_of = [
            self.byte_of.get(n, b"" if p.type == 3 else " ⁇ ".encode() if p.type == 2 else p.piece.replace(SPACE, " ").encode())
            for n, p in enumerate(pieces)
        ]
        # a symbol is the id of a piece, or size + code point for another character
        self.symbol_of = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for piece, n in plain.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = n
        scores = {score: rank for rank, score in enumerate(sorted({pieces[n].score for n in plain.values()}, reverse=True))}
        pairs = [
            (self._symbol(plain, piece[:cut]), self._symbol(plain, piece[cut:]), scores[pieces[n].score], n)
            for piece, n in plain.items()
            for cut in range(1, len(piece))
        ]
        pairs = [p for p in pairs if p[0] is not None and p[1] is not None]
        self.table = PairTable(*(np.array(column, np.int64) for column in zip(*pairs, strict=True)))

    def _symbol(self, plain: dict[str, int], text: str) -> int | None:
        return plain.get(text, self.size + ord(text) if len(text) == 1 else None)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that each stand behind a space, and how many ids each has."""
        text = SPACE + SPACE.join(words).replace(" ", SPACE) if words else ""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        symbols, lengths = merged_words(self.symbol_of[points], lengths, self.table)
        other = np.flatnonzero(symbols >= self.size)
        if len(other):
            symbols, lengths = self._with_bytes(symbols, lengths, other)
        return symbols, lengths

    def _with_bytes(self, symbols, lengths, other):
        raw = [chr(s - self.size).encode() for s in symbols[other].tolist()]
        width = np.ones(len(symbols), np.int64)
        width[other] = [len(r) for r in raw]
        out = np.repeat(symbols, width)
        ends = np.concatenate([[0], np.cumsum(width)])
        is_byte = np.repeat(np.isin(np.arange(len(symbols)), other), width)
        out[is_byte] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        return out, np.diff(ends[bounds])

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, runs of byte pieces read as UTF-8, the leading space taken off."""
        joined = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            text = joined.decode()
        except UnicodeDecodeError:
            text = self._decode_broken(ids)
        first = next((n for n in ids if self.bytes_of[n]), None)
        return text[1:] if text.startswith(" ") and first not in self.byte_of else text

    def _decode_broken(self, ids: list[int]) -> str:
        parts, run = [], b""
        for n in [*ids, None]:
            if n in self.byte_of:
                run += self.byte_of[n]
                continue
            # every byte of an invalid sequence becomes one replacement character
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        parts.append(run[:size].decode())
                        run = run[size:]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    parts.append("�")
                    run = run[1:]
            if n is not None:
                parts.append(self.bytes_of[n].decode())
        return "".join(parts)


def words_of(text: str) -> list[str]:
    """The words of a text, each without the one space (or the dummy prefix) in front of it."""
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if "  " in text or text[:1] == " ":
        return [word[1:] for word in re.findall(" +[^ ]*", " " + text)]
    return text.split(" ") if text else []


class PieceCodec:
    """Encodes and decodes lists of texts; remembers words between calls."""

    def __init__(self, model: PieceModel):
        self.model, self.encoder = model, CachedEncoder(model.encode_words)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text; null counts as empty."""
        words, counts = [], []
        for text in texts:
            own = words_of(text) if text else []
            words += own
            counts.append(len(own))
        return self.encoder(words, np.array(counts, np.int64))


def encode_decode(docs: DataFrame, id_column: str, text_column: str, model_path: str) -> DataFrame:
    """Ids of every text by the model, and the text that they decode to.

    Returns ``doc`` (the id), ``ids`` array<int> and ``decoded``, a row per input row. Null texts count as empty,
    which has no ids and decodes to the empty text. Memory of a task: about 4 million characters, or one text.
    """
    return _mapped(docs, id_column, text_column, model_path, digest=False)


def digests(docs: DataFrame, id_column: str, text_column: str, model_path: str) -> DataFrame:
    """As ``encode_decode``, but the count of the ids and SHA-256 digests instead of ids and texts.

    Returns ``doc``, ``n_tokens``, ``ids_sha256`` (of decimal ids joined by commas) and ``decoded_sha256``.
    """
    return _mapped(docs, id_column, text_column, model_path, digest=True)


def _mapped(docs: DataFrame, id_column: str, text_column: str, model_path: str, digest: bool) -> DataFrame:
    spark = docs.sparkSession
    model = shipped(spark, PieceModel(model_path))
    rows = docs.select(docs[f"`{id_column}`"].alias("doc"), docs[f"`{text_column}`"].alias("text"))
    kind = dict(rows.dtypes)["doc"]
    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model())
        decimal = [b"%d" % n for n in range(codec.model.size)]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in chunks(texts):
                ids, lengths = codec.encode(texts[begin:end])
                ends = np.cumsum(lengths).tolist()
                done, start = [], 0
                for stop in ends:
                    own = ids[start:stop].tolist()
                    decoded, start = codec.model.decode(own), stop
                    if digest:
                        listed = b",".join(map(decimal.__getitem__, own))
                        done.append((len(own), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                    else:
                        done.append((own, decoded))
                names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
                types = [pa.int64(), pa.string(), pa.string()] if digest else [pa.list_(pa.int32()), pa.string()]
                schema = pa.schema([batch.schema.field(0), *map(pa.field, names, types)])
                yield batch_of(schema, [batch.column(0)[begin:end], *map(list, zip(*done, strict=True))])

    return rows.mapInArrow(work, f"doc {kind}, {columns}")
