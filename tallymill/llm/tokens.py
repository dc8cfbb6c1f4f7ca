"""Token ids of a byte-pair tokenizer whose pre-tokens are words.

The merges of such a tokenizer never cross a pre-token, so the ids of a text are
the ids of its pre-tokens in order. Texts of plain Latin characters are split
here and each distinct pre-token is encoded once for as long as it stays in a
bounded memory; every other text goes through the tokenizer whole. Both ways
give the same ids.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Pre-tokens remembered by a task before it forgets all of them.
REMEMBERED = 300_000

# Texts of these characters need no composing, and their lower case does not
# depend on the neighbours.
_PLAIN = re.compile("[\t-\r -~\xa0-įı-ɏ]*")
_LETTERS = "a-zªµºß-öø-ɏⱥⱦ"
_NUMBERS = "0-9²³¹¼½¾"
# The split pattern of the vocabulary's pre-tokenizer.
_PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t-\r \xa0{_LETTERS}{_NUMBERS}]+"
)


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.steps = {
            "whole": (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer),
            # pre-tokens are in lower case, composed and split already
            "each": (None, pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)),
        }
        self.known: dict[str, bytes] = {}

    def _as(self, kind: str):
        """The one tokenizer, set up for whole texts or for pre-tokens; two would take twice the memory."""
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.steps[kind]
        return self.tokenizer

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self._as("whole").encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _each(self, words: list[str]) -> list[bytes]:
        found = self._as("each").encode(words, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        ends = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(words) + 1)) * 4
        return [ids[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        words, others = {}, []
        for i, text in enumerate(texts):
            if "<|" not in text and _PLAIN.fullmatch(text):
                words[i] = _PIECES.findall(text.lower())
            else:
                others.append(i)
        if others:
            for i, ids in zip(others, self._whole([texts[i] for i in others])):
                out[i] = ids
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = set().union(*words.values()).difference(self.known)
        if fresh:
            fresh = list(fresh)
            self.known.update(zip(fresh, self._each(fresh)))
        get = self.known.__getitem__
        for i, split in words.items():
            out[i] = b"".join(map(get, split))
        return out
