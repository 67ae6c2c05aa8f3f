"""Tokenizer access shared by packing (5) and binary output (7)."""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Parts of words whose ids one worker keeps; then it starts anew, so its memory is bounded.
CACHE_PARTS = 300_000
#: Characters of texts that are encoded at once, and parts that make one text for the library.
_GROUP_CHARS, _TOGETHER = 1 << 20, 8192
#: Printable ASCII and Latin-1 letters, without what a tokenizer may join across kinds of characters.
_PLAIN_CHARS = r"!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Blanks, tabs and line ends separate words under every definition of white space.
_PLAIN = re.compile(rf"(?!.*<\|)[{_PLAIN_CHARS} \t\r\n]*", re.S)
#: A plain text's runs of letters, digits and runs of other characters.
_PARTS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[0-9]|[^A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff \t\r\n]+")
_BLANK = re.compile("[ \t\r\n]+")

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Encodes texts with a tokenizer file.

    A lower-casing tokenizer that drops white space, splits letters, digits and signs, and marks the
    ends of words gives a text the concatenated ids of its blank-separated words. There plain words
    further split where letters, digits and other characters meet, as the tokenizer itself splits
    them; words with apostrophes (contractions), special tokens or other characters stay whole. So
    each distinct part is encoded once by the tokenizers library and looked up afterwards. Unseen
    parts are encoded together as one blank-joined text, whose ids are cut behind each end of a
    word. Texts of any other tokenizer are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4")
        with open(path) as f:
            rules = json.load(f)
        suffix = rules["model"].get("end_of_word_suffix")
        self.by_word = bool(suffix) and all(x in json.dumps([rules["normalizer"], rules["pre_tokenizer"]]) for x in ('"Lowercase"', "[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+", '"Removed"'))
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if self.by_word:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.ids: dict[str, bytes] = {}

    def encode(self, texts: list[str | None], end_id: int) -> list[np.ndarray]:
        """Ids of each text (null: empty), each followed by end_id."""
        end = np.array([end_id], self.dtype).tobytes()
        out: list[bytes] = []
        group: list[str] = []
        for i, text in enumerate(texts):
            group.append(text or "")
            if i + 1 == len(texts) or sum(map(len, group)) >= _GROUP_CHARS:
                out += self._group(group) if self.by_word else self._whole(group)
                group = []
        return [np.frombuffer(ids + end, self.dtype) for ids in out]

    def _group(self, texts: list[str]) -> list[bytes]:
        odd: set[str] = set()
        parts = [self._split(text, odd) for text in texts]
        if len(self.ids) > CACHE_PARTS:
            self.ids.clear()
        new = list(set().union(*parts).difference(self.ids, odd))
        for at in range(0, len(new), _TOGETHER):
            some = new[at : at + _TOGETHER]
            self.ids.update(zip(some, self._together(some), strict=True))
        new = list(odd.difference(self.ids))
        self.ids.update(zip(new, self._whole(new), strict=True))
        return [b"".join(map(self.ids.__getitem__, some)) for some in parts]

    def _split(self, text: str, odd: set[str]) -> list[str]:
        """Parts of a text in order; words that aren't plain stay whole and are noted."""
        if _PLAIN.fullmatch(text):
            return _PARTS.findall(text.lower())
        out: list[str] = []
        for word in filter(None, _BLANK.split(text)):
            if _PLAIN.fullmatch(word):
                out += _PARTS.findall(word.lower())
            else:
                out.append(word)
                odd.add(word)
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _together(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, from one text; part by part where the ends of words don't come out even."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(parts) or len(ids) and cuts[-1] != len(ids):
            return self._whole(parts)
        raw, size = ids.tobytes(), self.dtype.itemsize
        cuts = (cuts * size).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
