"""Byte-level BPE tokenisers from public vocabulary files, and token counts with the whole-token shortcut.

Counting: offline, once on the driver, every vocabulary string that is one pre-token by itself and whose merges end
in that one token is proved to be a whole token; the tasks get the proved set, which the vocabulary bounds. A text is cut into pre-tokens; those in the proved set count one each, the
distinct rest is merged once per batch by the vocabulary's own merge rules and remembered in a bounded table.

Defined results: null and empty texts have no tokens; a special token's string inside a text counts as that one
token, as the tokenizers library reads it by default.
"""

from __future__ import annotations

import base64
import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1024
REMEMBERED = 400_000


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, more = [""] * 256, 256
    for b in range(256):
        letters[b], more = (chr(b), more) if b in plain else (chr(more), more + 1)
    return letters


class WholeTokens:
    """Token counts of a byte-level BPE vocabulary file (.json of the tokenizers library)."""

    def __init__(self, path: str, whole: frozenset[str] | None = None):
        from tokenizers import Tokenizer

        import public_tokenizers

        tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model = tok.model
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.specials = special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        letters = byte_letters()
        self.letters = dict(enumerate(letters))
        self.whole = whole if whole is not None else self.prove(spec["model"]["vocab"], {c: b for b, c in enumerate(letters)})
        self.rest: dict[str, int] = {}

    def prove(self, vocab: dict[str, int], byte_of: dict[str, int]) -> frozenset[str]:
        """Strings that are valid text, one pre-token as a whole, and one token after all merges."""
        out = []
        for s in vocab:
            try:
                text = bytes(byte_of[c] for c in s).decode()
            except (UnicodeDecodeError, KeyError):
                continue
            m = self.pieces.match(text)
            if m and m.end() == len(text) and len(self.model.tokenize(s)) == 1:
                out.append(text)
        return frozenset(out)

    def merged(self, piece: str) -> int:
        """Tokens of one pre-token by the vocabulary's merges."""
        return len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))

    def count(self, text: str) -> int:
        if any(s in text for s in self.specials):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(self._count(p) for p in parts)
        return self._count(text)

    def _count(self, text: str) -> int:
        total, whole, rest = 0, self.whole, self.rest
        for piece, n in Counter(self.pieces.findall(text)).items():
            if piece in whole:
                total += n
            else:
                if (k := rest.get(piece)) is None:
                    k = self.merged(piece)
                    if len(piece) <= 64:
                        if len(rest) >= REMEMBERED:
                            rest.clear()
                        rest[piece] = k
                total += n * k
        return total


@lru_cache(2)
def whole_tokens(path: str, whole: frozenset[str] | None = None) -> WholeTokens:
    return WholeTokens(path, whole)


def _counts(name: str, limit: int, whole: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = whole_tokens(vocabulary_path(name), whole)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [counter.count(t) for t in texts]
            cols = [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_counts(vocabulary, limit, whole_tokens(vocabulary_path(vocabulary)).whole), schema)


class Encoder:
    """Ids of a byte-level BPE vocabulary, by its rank file, with the tokenizers library for what that cannot take."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        self.name = name
        with open(vocabulary_path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(vocabulary_path(f"{name}.json"), encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"] if t["special"]}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.specials = list(special)
        self.letters = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for s, i in ranks.items():
            self.letters[i] = s

    def ids(self, text: str) -> list[int]:
        try:
            return self.fast.encode(text, allowed_special="all") if any(s in text for s in self.specials) else self.fast.encode_ordinary(text)
        except BaseException as e:
            if type(e).__name__ != "PanicException":  # its regular expressions overflow on very long runs, and it panics, which is no Exception
                raise
            return _library(self.name).encode(text, add_special_tokens=False).ids


@lru_cache(2)
def encoder(name: str) -> Encoder:
    return Encoder(name)


@lru_cache(2)
def _library(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(f"{name}.json"))
