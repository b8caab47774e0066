"""Token ids of whole texts by a public byte-level tokenizer.

The ids are those of the tokenizer's file (tested against it on whole documents); tiktoken
finds them from the file's vocabulary several times faster than the file's own library.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .common import sole_cache


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bytes_of_letters() -> dict[str, int]:
    """A byte-level vocabulary writes printable bytes as themselves, and the others, in order, as letters from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokenizer:
    """Little-endian unsigned 32-bit ids of a text, as bytes."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        if file["model"]["type"] != "BPE" or (file["pre_tokenizer"] or {}).get("type") != "ByteLevel" or file["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{os.path.basename(path)} is no plain byte-level tokenizer")
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        letters = bytes_of_letters()
        ranks = {bytes(map(letters.__getitem__, token)): k for token, k in file["model"]["vocab"].items() if token not in added}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


_loaded: dict[str, ByteTokenizer] = {}


def worker_byte_tokenizer(path: str) -> ByteTokenizer:
    sole_cache("byte tokens", _loaded.clear)
    if path not in _loaded:
        _loaded[path] = ByteTokenizer(path)
    return _loaded[path]


def as_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u4")
