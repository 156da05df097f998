"""Token ids of whole texts, exactly as the tokenizers library gives them.

The tokenizer file's content is broadcast (a fixed file of a few MB), so executors
need no file of that name. Two kinds of file are recognised and encoded by a faster
way to the same ids; all others, and all texts the faster way doesn't cover, go
through ``Tokenizer.encode``.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words whose ids are remembered in a worker process; beyond, memory starts anew.
REMEMBERED = 1 << 20
_LOADED: dict[int, "Encoder"] = {}


def encoder(content: str) -> Encoder:
    """The encoder of a tokenizer file's content, made once in each process."""
    key = hash(content)
    if key not in _LOADED:
        _LOADED[key] = Encoder(content)
    return _LOADED[key]


class Encoder:
    def __init__(self, content: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        spec = json.loads(content)
        self.specials = [t["content"].encode() for t in spec.get("added_tokens") or []]
        self.n_ids = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.fast = self._byte_ranks(spec) or self._ascii_words(spec)

    def ids(self, text: bytes | None) -> np.ndarray:
        """The ids of a text (null: none), as unsigned 32-bit ints."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast and not any(s in text for s in self.specials):
            return self.fast(text)
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def _byte_ranks(self, spec: dict):
        """For byte-level BPE whose ids number bytes and merges in order: tiktoken with the same ranks."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            return None
        vocab = model["vocab"]
        merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(vocab["".join(m)] != 256 + k for k, m in enumerate(merged)):
            return None
        import tiktoken

        byte_of = _byte_of_char()
        added = {t["content"] for t in spec.get("added_tokens") or []}
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in vocab.items() if token not in added}
        # the fixed pattern of byte-level pre-tokenisation
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: np.array(encoding.encode_ordinary(text.decode()), np.uint32)

    def _ascii_words(self, spec: dict):
        """For BPE with word ends that lower-cases and drops white space: ids by word, remembered."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"] or model.get("type") != "BPE" or not model.get("end_of_word_suffix"):
            return None
        splits = pre.get("pretokenizers") or [{}, {}]
        # the fixed pattern of this kind of file; pieces never reach over white space
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        if (splits[0].get("pattern") or {}).get("Regex") != pattern or splits[1].get("type") != "ByteLevel" or splits[1].get("use_regex", True):
            return None
        pieces = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^a-z0-9]+")
        tokenize, known_pieces, known_words = self.tokenizer.model.tokenize, {}, {}

        def of_piece(piece: bytes) -> bytes:
            if piece not in known_pieces:
                if len(known_pieces) > REMEMBERED:
                    known_pieces.clear()
                chars = piece.decode()
                if not all("!" <= c <= "~" for c in chars):  # only these stand for themselves among byte-level characters
                    return np.array(self.tokenizer.encode(chars, add_special_tokens=False).ids, np.uint32).tobytes()
                known_pieces[piece] = np.array([t.id for t in tokenize(chars)], np.uint32).tobytes()
            return known_pieces[piece]

        def of_word(word: bytes) -> bytes:
            if word.isascii():
                out = b"".join(map(of_piece, pieces.findall(word)))
            else:
                out = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, np.uint32).tobytes()
            known_words[word] = out
            return out

        def ids(text: bytes) -> np.ndarray:
            if len(known_words) > REMEMBERED:
                known_words.clear()
            words = text.lower().split()  # ASCII letters and white space only
            out = [known_words.get(w) for w in words]
            if None in out:
                out = [of_word(w) if x is None else x for w, x in zip(words, out, strict=True)]
            return np.frombuffer(b"".join(out), np.uint32)

        return ids


def _byte_of_char() -> dict[str, int]:
    """Byte-level characters: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}
