"""Exact whole-text tokenization at corpus speed.

The vocabulary's normaliser and splitter never let a token cross ASCII white space, so a text's ids are its words' ids
put together. The words of a group of texts are encoded once by the ``tokenizers`` library and kept by the worker process;
where other stages share the worker, only those that come again in another group, since most distinct words hardly ever do.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from struct import pack

import numpy as np

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Words kept by one worker process at most, and distinct punctuation tails (bounds on memory, not on results).
CACHE_WORDS, MAX_TAILS = 1_200_000, 10_000
#: Words kept by a sparing encoder.
SPARING_WORDS = 300_000
#: Places that mark words as seen once, by hash (words that share one are kept a group too early, which costs memory alone).
SEEN = 1 << 22
#: Bytes of texts whose words are looked up together; a longer text is a group of its own.
GROUP_BYTES = 1 << 18
_TAIL = ",.!*#%&$;:?)"

_encoders: dict[tuple[str, bool], "WordEncoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _plain_words(description: dict) -> dict | None:
    """The same vocabulary for words of lower-case letters alone, or None if its normaliser and splitter are not those
    known to leave such words whole and unchanged (fixed values of the public file)."""
    steps = [n["type"] for n in (description.get("normalizer") or {}).get("normalizers", [])]
    parts = (description.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    if steps != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in parts] != ["Split", "ByteLevel"] or r"|[\p{L}]+|" not in parts[0]["pattern"].get("Regex", ""):
        return None
    return description | {"normalizer": None, "pre_tokenizer": parts[1]}


class WordEncoder:
    """``encode(text)`` gives the ids of a UTF-8 text as packed little-endian integers, without special tokens.

    Words are kept in two generations of half of ``cache_words`` each: when the newer is full the older is dropped, so
    words in use stay known. With ``sparing`` they are kept only from the second group on that has them.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, sparing: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            plain = _plain_words(json.load(f))
        self.plain = Tokenizer.from_str(json.dumps(plain)) if plain else None
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self.cache_words = cache_words
        self.seen, self.marks = bytearray(SEEN if sparing else 0), 0

    def _library(self, tokenizer, words: list[str]) -> list[bytes]:
        return [pack(f"<{len(ids)}{self.code}", *ids) for ids in (e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False))]

    def _learn(self, missing: set[bytes]) -> list[bytes]:
        """Add words to the newer generation; a sparing encoder gives those seen for the first time, to be taken out after the group. Letters followed by ASCII punctuation are two separate pre-tokens, so Latin-1
        letters are encoded without normaliser and splitter, lower-cased, and their tail is looked up on its own."""
        words, heads, tails, others, once, seen = [], [], [], [], [], self.seen
        if 2 * self.marks > SEEN:
            seen[:], self.marks = bytes(SEEN), 0
        for word in missing:
            known = self.older.get(word)
            if known is not None:
                self.cache[word] = known
                continue
            if seen and not seen[place := hash(word) % SEEN]:
                seen[place] = 1
                once.append(word)
            s = word.decode("utf-8", "replace")
            core = s.rstrip(_TAIL)
            if self.plain and core.isalpha() and (core.isascii() or max(core) < "\u0100"):
                words.append(word)
                heads.append(core.lower())
                tails.append(s[len(core) :])
            else:
                others.append(word)
        if others:
            self.cache.update(zip(others, self._library(self.tokenizer, [w.decode("utf-8", "replace") for w in others])))
        if words:
            if len(self.tails) > MAX_TAILS:
                self.tails = {"": b""}
            for tail in {t for t in tails if t not in self.tails}:
                self.tails[tail] = self._library(self.tokenizer, [tail])[0]
            distinct = list(dict.fromkeys(heads))
            packed = dict(zip(distinct, self._library(self.plain, distinct)))
            for word, head, tail in zip(words, heads, tails):
                self.cache[word] = packed[head] + self.tails[tail]
        self.marks += len(once)
        return once

    def _encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The packed ids of a group of texts."""
        if 2 * len(self.cache) > self.cache_words:  # before the lookups: they need what is kept
            self.older, self.cache = self.cache, {}
        split = [(text or b"").split() for text in texts]
        once = self._learn(set().union(*split).difference(self.cache))
        out = [b"".join(map(self.cache.__getitem__, words)) for words in split]
        for word in once:
            del self.cache[word]
        if len(once) > self.cache_words:  # gives back the room of a very long text
            self.cache = dict(self.cache)
        return out

    def encode(self, text: bytes | None) -> bytes:
        return self._encode([text])[0]

    def documents(self, texts: list[bytes | None], end_id: int = END_ID) -> Iterator[np.ndarray]:
        """The ids of each text followed by the end id; the texts are taken in groups, which is faster than one by one."""
        end, at = np.array([end_id], self.dtype).tobytes(), 0
        while at < len(texts):
            stop, size = at + 1, len(texts[at] or b"")
            while stop < len(texts) and size + len(texts[stop] or b"") <= GROUP_BYTES:
                size += len(texts[stop] or b"")
                stop += 1
            for ids in self._encode(texts[at:stop]):
                yield np.frombuffer(ids + end, self.dtype)
            at = stop

    def document(self, text: bytes | None, end_id: int = END_ID) -> np.ndarray:
        """The ids of a text followed by the end id."""
        return next(self.documents([text], end_id))


def encoder(path: str, sparing: bool = False) -> WordEncoder:
    """The worker process's encoder for a vocabulary file."""
    if (path, sparing) not in _encoders:
        _encoders[path, sparing] = WordEncoder(path, SPARING_WORDS if sparing else CACHE_WORDS, sparing)
    return _encoders[path, sparing]
