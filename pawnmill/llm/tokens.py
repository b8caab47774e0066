"""Token ids of whole texts by a public tokenizer, cached by whitespace-delimited word.

The tokenizer's normaliser, splitter and merges never look across white space, so a text's
ids are its words' ids in order. Words already seen cost one dictionary lookup; unseen words
of a batch are encoded together, parted by a word of one control character.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

import numpy as np

from .byte_tokens import bytes_of_letters
from .common import sole_cache

#: Separators for Python's split() that the tokenizer does not take for white space.
ODD_SPACES = ("\x1c", "\x1d", "\x1e", "\x1f")
PART = "\x01"
#: Words kept by each worker (two generations of half as many), and the longest that is kept.
CACHE_WORDS, LONGEST_WORD = 400_000, 64
#: Punctuation that forms one piece after letters; letters below U+0250 are in composed form.
TAIL, PLAIN_BELOW = ".,!?;:#$%&*|)", "\u0250"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _letters(path: str):
    """An encoder of pieces that end in PART, from the tokenizer's own vocabulary, and which ids end a piece; None if the vocabulary has no word ends.

    A piece's last byte and its end mark are one symbol before any merge, so these symbols have
    the ranks after the plain bytes; merges follow in the order of their ids.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    mark, vocab, letters = model.get("end_of_word_suffix"), model["vocab"], bytes_of_letters()
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model.get("merges", [])]
    if not mark or any(vocab.get(a + b) != 512 + k for k, (a, b) in enumerate(merges)):
        return None
    ranks, last = {}, np.zeros(len(vocab) + 1, dtype=bool)
    for token, k in vocab.items():
        if k < 512 + len(merges):
            ends = token.endswith(mark) and token != mark
            ranks[bytes(map(letters.__getitem__, token.removesuffix(mark) if ends else token)) + (PART.encode() if ends else b"")] = k
            last[k] = ends
    if len(ranks) != 512 + len(merges):
        return None
    return tiktoken.Encoding("letters", pat_str=rf"[^{PART}]+{PART}", mergeable_ranks=ranks, special_tokens={}), last


class Recent:
    """A dictionary of two generations: full, it forgets what was not asked for since the last time."""

    def __init__(self, most: int):
        self.half = max(1, most // 2)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def look_up(self, words: Iterable[str]) -> tuple[dict[str, bytes], list[str]]:
        """What is known, and the words that are not."""
        young, old, known, missing = self.young, self.old, {}, []
        for w in words:
            v = young.get(w)
            if v is None and (v := old.get(w)) is not None:
                young[w] = v
            if v is None:
                missing.append(w)
            else:
                known[w] = v
        return known, missing

    def age(self) -> None:
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}


class WordCachedTokenizer:
    """Little-endian unsigned 32-bit ids of a text, as bytes."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.cores, self.tails = Recent(cache_words), Recent(cache_words), Recent(10_000)
        parts = self._ids(PART)
        self.part = parts[0] if len(parts) == 1 else None
        self.letters = _letters(path)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _encode(self, words: list[str]) -> list[bytes]:
        if self.part is not None and len(words) > 1:
            ids = np.array(self._ids(f" {PART} ".join(words)), dtype="<u4")
            ends = np.flatnonzero(ids == self.part)
            if len(ends) == len(words) - 1:
                starts = [0, *(ends + 1).tolist()]
                raw = ids.tobytes()
                return [raw[4 * a : 4 * b] for a, b in zip(starts, [*ends.tolist(), len(ids)])]
        return [np.array(self._ids(w), dtype="<u4").tobytes() for w in words]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """The same for lower-case words of letters alone, each of which is one piece."""
        encoding, last = self.letters
        ids = encoding.encode_to_numpy(PART.join(words) + PART, disallowed_special=()).astype("<u4", copy=False)
        ends = (np.flatnonzero(last[ids]) + 1).tolist()
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]

    def _learn(self, cache: Recent, words: Iterable[str], encode) -> dict[str, bytes]:
        known, missing = cache.look_up(words)
        for at in range(0, len(missing), 4000):
            some = missing[at : at + 4000]
            for w, v in zip(some, encode(some)):
                known[w] = cache.young[w] = v
        cache.age()
        return known

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of all these words; those worth keeping go into the cache.

        A word of letters and a tail of punctuation is split by the tokenizer at that place,
        and its letters are lower-cased, so many unseen words have seen letters.
        """
        known, missing = self.words.look_up(words)
        parted, whole, young = [], [], self.words.young
        for w in missing:
            if len(w) > LONGEST_WORD or PART in w:
                known[w] = np.array(self._ids(w), dtype="<u4").tobytes()
                continue
            low = w.lower()
            core = low.rstrip(TAIL)
            if core.isalpha() and max(core) < PLAIN_BELOW:
                parted.append((w, core, low[len(core) :]))
            else:
                whole.append(w)
        tails = self._learn(self.tails, {tail for _, _, tail in parted if tail}, self._encode)
        if self.letters is None:
            cores = self._learn(self.cores, {core for _, core, _ in parted}, self._encode)
            found = [cores[core] for _, core, _ in parted]
        else:  # encoding letters anew costs no more than looking them up
            found = self._encode_letters([core for _, core, _ in parted]) if parted else []
        for (w, _, tail), v in zip(parted, found):
            known[w] = young[w] = v + tails[tail] if tail else v
        for at in range(0, len(whole), 4000):
            some = whole[at : at + 4000]
            for w, v in zip(some, self._encode(some)):
                known[w] = young[w] = v
        self.words.age()
        return known

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        split = [None if any(c in t for c in ODD_SPACES) else t.split() for t in texts]
        words: set[str] = set()
        for s in split:
            if s:
                words.update(s)
        known = self.learn(words)
        return [np.array(self._ids(t), dtype="<u4").tobytes() if s is None else b"".join(map(known.__getitem__, s)) for t, s in zip(texts, split)]


_loaded: dict[tuple[str, int], WordCachedTokenizer] = {}


def worker_tokenizer(path: str, cache_words: int = CACHE_WORDS) -> WordCachedTokenizer:
    """One tokenizer for a Python worker's lifetime, or until the worker serves another operator."""
    sole_cache("tokens", _loaded.clear)
    if (path, cache_words) not in _loaded:
        _loaded[path, cache_words] = WordCachedTokenizer(path, cache_words)
    return _loaded[path, cache_words]
