"""Token ids of whole texts, as the `tokenizers` library gives them for a tokenizer file.

A byte-level BPE file whose texts are divided by the byte-level pattern alone is also a table of ranks, which
`tiktoken` applies several times faster with equal ids: the merges must be in order of their ids, and both libraries
divide texts by one pattern. Texts that hold a special token's string, those `tiktoken` refuses (very long runs of white
space), and every text of any other tokenizer go to the `tokenizers` library itself.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The byte-level pattern, and the bytes that stand for themselves as characters of a vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VISIBLE = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_ranks(rules: dict) -> dict[bytes, int] | None:
    """The vocabulary of a byte-level BPE file as ranks of byte strings, or None where ranks do not say all of it."""
    model, before = rules["model"], rules["pre_tokenizer"] or {}
    plain = rules["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if not plain or odd or model.get("type") != "BPE":
        return None
    hidden = [b for b in range(256) if b not in set(VISIBLE)]
    byte_of = {chr(b): b for b in VISIBLE} | {chr(256 + i): b for i, b in enumerate(hidden)}
    vocabulary = model["vocab"]
    special = {t["content"] for t in rules["added_tokens"] or ()}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [vocabulary.get(m, -1) for m in merged]
    base = [t for t in vocabulary if t not in special and len(t) == 1]
    known = set(base) | set(merged) | special
    if ids != sorted(ids) or -1 in ids or len(base) != 256 or set(vocabulary) - known or any(c not in byte_of for t in set(base) | set(merged) for c in t):
        return None
    if max(vocabulary[t] for t in base) > min(ids, default=1 << 32):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in special}


@lru_cache(8)
def vocabulary_size(path: str) -> int:
    """One more than the largest id, from the file alone."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    vocabulary = rules["model"]["vocab"]
    largest = max(vocabulary.values(), default=-1) if isinstance(vocabulary, dict) else len(vocabulary) - 1
    return 1 + max([largest, *(t["id"] for t in rules["added_tokens"] or ())])


class TextTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = vocabulary_size(path)
        ranks = byte_ranks(json.loads(self.tokenizer.to_str()))
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str, plain: bool = True) -> np.ndarray:
        """plain: no special token's string is in the text."""
        if plain and self.fast:
            if len(text) <= 100_000:
                return np.array(self.fast.encode_ordinary(text), np.uint32)
            try:
                return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
            except ValueError:  # its pattern gives up on runs of several hundred thousand
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in turn; null is empty."""
        plain = np.ones(len(text), bool)
        for s in self.special:
            plain &= ~pc.fill_null(pc.match_substring(text, s), False).to_numpy(zero_copy_only=False)
        for t, p in zip(text, plain.tolist(), strict=True):
            yield self.ids(t.as_py() or "", p)


@lru_cache(2)
def shared_tokenizer(path: str) -> TextTokenizer:
    """One tokenizer per worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return TextTokenizer(path)
