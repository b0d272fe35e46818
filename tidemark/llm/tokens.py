"""Byte-level BPE tokens by a public vocabulary. The driver reads the file; the workers get its ranks by broadcast."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable

import tiktoken
from pyspark.sql import SparkSession

from tidemark.llm.common import CACHES

TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG = 10_000
#: Runs of what the pattern takes for white space; beyond some 100,000 characters its engine's stack overflows.
_run = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % _LONG)
_made: dict[str, tiktoken.Encoding] = {}
CACHES["tokens"] = _made.clear


class Tokens:
    """A vocabulary that workers can use; its size is fixed and small, so it is broadcast."""

    def __init__(self, spark: SparkSession, folder: str = TOKENIZERS, name: str = VOCABULARY) -> None:
        with open(f"{folder}/{name}", "rb") as f:
            raw = f.read()
        self.size = raw.count(b"\n") + 1
        self.shared, self.id = spark.sparkContext.broadcast(raw), hashlib.md5(raw).hexdigest()

    def encoding(self) -> tiktoken.Encoding:
        if self.id not in _made:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.shared.value.splitlines())}
            _made[self.id] = tiktoken.Encoding("tidemark", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return _made[self.id]

    def encoder(self) -> Callable[[str], list[int]]:
        """Token ids of a text of any length, as the pattern divides it."""
        return lambda text, of=self.encoding(): encode(of, text)


def encode(of: tiktoken.Encoding, text: str) -> list[int]:
    """``of.encode_ordinary(text)``; long runs of white space are given to the merges without the pattern, which makes one
    piece of all but a run's last character, or of the whole run at the end of the text."""
    if len(text) < _LONG:
        return of.encode_ordinary(text)
    out, at = [], 0
    for m in _run.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += of.encode_ordinary(text[at : m.start()])
        out += of._encode_single_piece(text[m.start() : end])
        at = end
    return out + of.encode_ordinary(text[at:]) if at else of.encode_ordinary(text)
