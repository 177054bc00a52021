"""Ids of a lower-casing word-level BPE tokenizer file, many texts at a time.

Texts are cut at ASCII white space, which the tokenizer drops and never merges over. Words of ASCII and of
plain Latin letters are lower-cased, cut into letters, single digits and symbols, and merged in rounds by
``merges``. Words with any other character, or with a part of a special token, go to the library itself.
"""

from __future__ import annotations

import json
import re

import numpy as np

from docsift.llm.merges import CachedEncoder, PairTable, merged_words

END_OF_TEXT = b" "  # stands for the id behind each text; no word is a space
_ODD = re.compile(r"[^!-~\nÀ-ÖØ-öø-įı-ķĹ-ňŊ-ž]|<\|")
_PART = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_NORMALIZER = ["NFC", "Replace", "Lowercase"]


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printing else chr(next(rest)) for b in range(256)]


class WordModel:
    """Arrays of the tokenizer file; sent to the tasks once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.text = file.read()
        parts = json.loads(self.text)
        model, suffix = parts["model"], parts["model"]["end_of_word_suffix"]
        if [n["type"] for n in parts["normalizer"]["normalizers"]] != _NORMALIZER or not suffix or parts["post_processor"]:
            raise ValueError("only lower-casing word-level BPE tokenizers are supported")
        vocab, characters = model["vocab"], _byte_characters()
        self.inner = np.array([vocab[c] for c in characters], np.int32)
        self.final = np.array([vocab[c + suffix] for c in characters], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.table = PairTable(
            [vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], np.arange(len(pairs)), [vocab[a + b] for a, b in pairs]
        )


class WordCodec:
    """Encodes lists of texts, each followed by ``end_id``; remembers words between calls."""

    def __init__(self, model: WordModel, end_id: int):
        self.model, self.end_id, self._library = model, end_id, None
        self.parts = CachedEncoder(self._encode_parts, 200_000)
        self.words = CachedEncoder(self._encode_words, 300_000)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        words, counts = [], []
        for text in texts:
            own = text.encode().split() if text else []
            words += own
            words.append(END_OF_TEXT)
            counts.append(len(own) + 1)
        return self.words(words, np.array(counts, np.int64))

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [part.encode() for part in parts]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        values = np.frombuffer(b"".join(raw), np.uint8)
        symbols, last = self.model.inner[values], np.cumsum(lengths) - 1
        symbols[last] = self.model.final[values[last]]
        return merged_words(symbols, lengths, self.model.table)

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [word.decode() for word in words]
        own: dict[int, list[int]] = {}
        if _ODD.search("\n".join(texts)):
            odd = [at for at, text in enumerate(texts) if _ODD.search(text)]
            own = dict(zip(odd, self._by_library([texts[at] for at in odd]), strict=True))
        for at in own:
            texts[at] = ""
        found = _PART.findall("\n".join(texts).lower() + "\n")
        breaks = np.flatnonzero(np.fromiter(map("\n".__eq__, found), bool, len(found)))
        per_word = np.diff(breaks, prepend=-1) - 1
        ids, lengths = self.parts([part for part in found if part != "\n"], per_word)
        if own:
            pieces, starts = [], np.cumsum(lengths) - lengths
            before = 0
            for at in sorted(own):
                pieces += [ids[before : starts[at]], np.array(own[at], np.int32)]
                before, lengths[at] = starts[at], len(own[at])
            ids = np.concatenate([*pieces, ids[before:]])
        return ids.astype(np.int32), lengths

    def _by_library(self, words: list[str]) -> list[list[int]]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.model.text)
        return [
            [self.end_id] if word == " " else self._library.encode(word, add_special_tokens=False).ids for word in words
        ]
