"""Exact encoding with a SentencePiece model of merge type, by backtracking, and decoding.

A merge model joins the best pair of neighbours until none is left. The result is
also the only cut of the text in which merging each two neighbouring tokens alone
gives these two again. So the cut is searched from the left: an Aho-Corasick
automaton finds the vocabulary's pieces that start at each place, the longest is
taken that goes with the token before it, and where none does, the place is marked
in a bitfield of failed positions and the token before it gives way to a shorter
one. A place fails once at most, since only one cut of the text before it is valid.
Whether two tokens go together is found by merging them, and remembered.

Most vocabularies join neither a letter and another sign nor anything and a space
after it. Where the given one does not, a text is cut there first, and the parts,
which repeat, are remembered.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

#: Parts of texts that a worker remembers, twice as many at most; longer ones are not remembered.
REMEMBERED, LONGEST = 300_000, 48
#: Pairs of tokens whose fit a worker remembers.
PAIRS = 1_000_000
SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
PART = regex.compile(rf"{SPACE}*\p{{L}}+|{SPACE}*[^\p{{L}}{SPACE}]+|{SPACE}+")


class _Remembered(dict):
    """Values by text; the less used half is forgotten when there are too many."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make
        self.older: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            found = self.make(text)
        if len(text) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


class PieceEncoder:
    """The ids of texts under a model file, the same as the sentencepiece library's, and their texts again.

    Models of another type than merges, without byte fallback, with a normalizer
    that changes more than spaces, or with pieces set by users are refused.
    """

    def __init__(self, path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto.FromString(self.library.serialized_model_proto())
        rules, trained = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        odd = rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces
        if trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix or odd or kinds & {4, 5}:
            raise ValueError(f"not a plain merge model: {path}")
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.bytes = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[1:-1], 16)] = i
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            # Single characters are tokens anyway.
            if len(piece) > 1:
                self.automaton.add_word(piece, (len(piece) - 1, piece))
        self.automaton.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.apart = all(PART.fullmatch(p) for p in self.ids)
        self.parts = _Remembered(self._part)
        self.words = _Remembered(lambda word: b"".join(map(self.parts.__getitem__, PART.findall(word))))

    def merged(self, text: str) -> list[str]:
        """The tokens of ``text`` by merging the best pair, the first of equal ones, as long as there is one."""
        tokens = list(text)
        while True:
            pairs = [(self.score[a + b], -i) for i, (a, b) in enumerate(zip(tokens, tokens[1:], strict=False)) if a + b in self.score]
            if not pairs:
                return tokens
            at = -max(pairs)[1]
            tokens[at : at + 2] = [tokens[at] + tokens[at + 1]]

    def _fit(self, left: str, right: str) -> bool:
        """Whether merging ``left`` and ``right`` together gives the two; with no ``left``, whether ``right`` is made at all."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.merged(left + right) == ([left, right] if left else [right])
            self.fits[left, right] = known
        return known

    def cut(self, text: str) -> list[str]:
        """The tokens of ``text`` by backtracking; a character that is no piece is a token too."""
        n = len(text)
        # At most the longest piece's length of options for each place, shortest first.
        options: list[list[str]] = list(map(list, text))
        for end, (back, piece) in self.automaton.iter(text):
            options[end - back].append(piece)
        options.append([])
        failed = bytearray((n >> 3) + 1)
        known, tokens, last = self.fits.get, [], ""
        # Options that are left at the places before.
        tried: list[list[str]] = []
        at, left = 0, options[0]
        while at < n:
            while left:
                piece = left.pop()
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (known((last, piece)) or self._fit(last, piece)):
                    tokens.append(piece)
                    tried.append(left)
                    at, left, last = end, options[end], piece
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(tokens.pop())
                left, last = tried.pop(), tokens[-1] if tokens else ""
        return tokens

    def _part(self, text: str) -> bytes:
        found: list[int] = []
        for token in self.cut(text):
            known = self.ids.get(token)
            found += [known] if known is not None else [self.bytes[b] for b in token.encode()]
        return np.array(found, "<i4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; null and empty texts have none."""
        if not text:
            return np.empty(0, "<i4")
        text = self.prefix + text.replace(" ", SPACE)
        found = b"".join(map(self.words.__getitem__, WORD(text))) if self.apart else self._part(text)
        return np.frombuffer(found, "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, by the library."""
        return self.library.decode(ids.tolist()) if len(ids) else ""


def piece_encoder(path: str) -> PieceEncoder:
    """The encoder of ``path`` that this process keeps from task to task."""
    kept = sys.__dict__.setdefault("_kept_piece_encoders", {})
    if path not in kept:
        kept[path] = PieceEncoder(path)
    return kept[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(``doc_id``, ``ids``, ``decoded``) of every row of ``docs``, whose texts are taken whole; no shuffle.

    A null text is empty: no ids, an empty decoded text. Repeated rows are encoded
    each; extra columns are ignored. ``path`` names a model file that every worker has.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        for batch in batches:
            # One text at a time is turned into objects.
            ids = [encoder.encode(text.as_py()) for text in batch.column("text")]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
            texts = pa.array([encoder.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, texts], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, ids array<int>, decoded string")
