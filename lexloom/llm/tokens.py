"""Ids of whole texts by a vocabulary file in JSON, whose path is a parameter."""

from __future__ import annotations

import json
from functools import cache

#: Fixed value: how byte-level vocabularies split a text into pieces before they merge bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible ones stand for themselves, the rest follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of(vocabulary: dict) -> dict[bytes, int] | None:
    """The ids by bytes of a byte-level vocabulary whose merges come in the order of their ids; None for any other."""
    before, model = vocabulary.get("pre_tokenizer") or {}, vocabulary["model"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "byte_fallback", "ignore_merges", "unk_token"))
    level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not plain or not level or vocabulary.get("normalizer"):
        return None
    letters, ids = byte_of_letter(), model["vocab"]
    merged = [ids.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    if any(a >= b for a, b in zip([-1, *merged], merged, strict=False)) or any(ch not in letters for t in ids for ch in t):
        return None
    ranks = {bytes(letters[ch] for ch in t): i for t, i in ids.items()}
    return ranks if len(ranks) == len(ids) and all(bytes([b]) in ranks for b in range(256)) else None


class ByteBpe:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    A space before a character that isn't white space always begins a new piece of a byte-level
    vocabulary's pattern, so a text is the concatenation of its words, each encoded with the
    space before it; words repeat, and the cache (cleared at ``cache_words``) holds their ids.
    Texts in which a space is followed by white space, or with the string of a special token, and
    all texts of other kinds of vocabularies are encoded whole.
    """

    def __init__(self, vocabulary: str | None = None, cache_words: int = 150_000):
        from tokenizers import Tokenizer

        path = vocabulary or default_vocabulary()
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        self.whole = cache(lambda: Tokenizer.from_file(path))
        self.special = tuple(t["content"] for t in content.get("added_tokens") or ())
        self.cache_words, self.words, ranks = cache_words, _Words(), ranks_of(content)
        if ranks is not None:
            import tiktoken

            self.words.encode = tiktoken.Encoding("lexloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        import numpy as np

        if not text:
            return b""
        first, *rest = text.split(" ")
        if self.words.encode is None or any(s in text for s in self.special) or not all(rest) or any(w[0].isspace() for w in rest):
            return np.asarray(self.whole().encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self.words) > self.cache_words:
            self.words.clear()
        head = np.asarray(self.words.encode(first), dtype="<u4").tobytes() if first else b""
        return head + b"".join(map(self.words.__getitem__, rest))


class _Words(dict):
    """The ids of a word with a space before it."""

    encode = None

    def __missing__(self, word: str) -> bytes:
        out = b"".join([i.to_bytes(4, "little") for i in self.encode(" " + word)])
        if len(word) <= 64:
            self[word] = out
        return out
