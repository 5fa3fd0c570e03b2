"""Token ids of whole texts, by a given tokenizer file."""

from __future__ import annotations

import json
import re
import sys

import numpy as np
import tiktoken
import tokenizers

# Fixed value: the pattern of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer runs of white space, and longer words, are left to the file's own library.
LONGEST_RUN = 10_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it prints, else one of those from 256 on, in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + n) for n, b in enumerate(others)}


class Encoder:
    """Encodes texts with a tokenizer file, with the same ids as its ``encode(text, add_special_tokens=False)``.

    A byte-level file with the usual pattern is also given to a second library, which
    merges by the ids of the results instead of a list of pairs, and faster. Both give the
    same ids if the results' ids rise along the list and every piece of the vocabulary,
    encoded alone, is itself: then no two neighbours can make up a piece other than
    by its pair. Both are checked here. Texts that hold an added token or one of the
    separators 1C to 1F, on which the two disagree, or a very long run without or of
    white space are encoded by the file's own library, and so are all texts under
    another kind of file.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        described = json.loads(self.tokenizer.to_str())
        self.added = [token["content"] for token in described["added_tokens"]]
        self.apart = re.compile(rf"[\x1c-\x1f]|\s{{{LONGEST_RUN}}}|\S{{{LONGEST_RUN}}}").search
        self.quick = self._second(described)

    def _second(self, described: dict) -> tiktoken.Encoding | None:
        """The file for the second library, if both must agree."""
        split, model = described["pre_tokenizer"] or {}, described["model"]
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if not usual.items() <= split.items() or described["normalizer"] or described["post_processor"]:
            return None
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(rule) for rule in plain):
            return None
        vocabulary = {piece: n for piece, n in model["vocab"].items() if piece not in self.added}
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        made = [vocabulary[left + right] for left, right in pairs]
        byte = {letter: b for b, letter in _byte_letters().items()}
        single = [n for piece, n in vocabulary.items() if len(piece) == 1]
        alone = all([token.id for token in self.tokenizer.model.tokenize(piece)] == [n] for piece, n in vocabulary.items())
        if len(single) != 256 or max(single) > min(made) or sorted(set(made)) != made or not alone:
            return None
        ranks = {bytes(byte[letter] for letter in piece): n for piece, n in vocabulary.items()}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        """Ids of a text; null is empty."""
        if not text:
            return np.empty(0, self.dtype)
        if self.quick is None or any(token in text for token in self.added) or self.apart(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
        return self.quick.encode_to_numpy(text, disallowed_special=()).astype(self.dtype)


def encoder(path: str) -> Encoder:
    """The encoder of ``path`` that this process keeps from task to task."""
    kept = sys.__dict__.setdefault("_kept_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
