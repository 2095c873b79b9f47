"""A byte-level BPE tokenizer file as a fast encoder and decoder with the tokenizers library's results.

For a plain byte-level file (no normalizer, no prefix space, no dropout) the file's own vocabulary drives tiktoken's
merge loop, which gives the same ids several times faster; any other file goes to the tokenizers library itself.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

# Fixed value: the pattern that byte-level pre-tokenization is defined by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level files: printable Latin-1 bytes stand for themselves, others follow from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.plain = (
            model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
            and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges") and not model.get("byte_fallback")
            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
        )
        if self.plain:
            import tiktoken

            byte = _byte_of_char()
            ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
            self._fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
            self.bytes_of = [b""] * (max([*ranks.values(), *added.values()]) + 1)
            for t, i in ranks.items():
                self.bytes_of[i] = t
            for t, i in added.items():
                self.bytes_of[i] = t.encode()
            self.lengths = np.array([len(x) for x in self.bytes_of], np.int64)
        else:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(path)
            self._slow.no_truncation()
            self._slow.no_padding()

    def encode(self, text: str) -> np.ndarray:
        if self.plain:
            return self._fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        if self.plain:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return self._slow.decode(ids.tolist(), skip_special_tokens=False)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)
