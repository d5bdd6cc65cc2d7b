"""Encoding with a byte-level BPE vocabulary file (``tokenizers`` JSON), loaded once per process."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Fixed value: the word pattern of this kind of tokenizer.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids exactly as the ``tokenizers`` library gives them (no truncation, padding or added tokens).

    Where the file is a plain byte-level BPE whose ids follow the merges, the faster ``tiktoken`` core does
    the merging with the file's own vocabulary; texts that it refuses, and other files, go to ``tokenizers``.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, model, symbols = path, spec["model"], byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.size = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pre = spec.get("pre_tokenizer") or {}
        plain = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not model.get("dropout")
            and all(vocab.get(a + b, -1) == 256 + i for i, (a, b) in enumerate(merges))
            and not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))
        )
        self.plain, self._fast, self._slow = plain, None, None
        if plain:
            import tiktoken

            ranks = {self.bytes[i]: i for i in vocab.values()}
            self._fast = tiktoken.Encoding("wayfault", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def slow(self):
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
            self._slow.no_truncation()
            self._slow.no_padding()
        return self._slow

    def encode(self, text: str) -> np.ndarray:
        if self._fast is not None:
            try:
                return self._fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
            except BaseException as e:  # the core panics where its word pattern backtracks too far
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.array(self.slow().encode(text, add_special_tokens=False).ids, "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """As ``decode(ids, skip_special_tokens=False)``: the tokens' bytes, ill-formed UTF-8 replaced."""
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)
