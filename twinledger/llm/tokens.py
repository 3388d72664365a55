"""Token ids of texts, by the vocabulary file of a byte-level BPE.

The file is the ``tokenizers`` JSON; tiktoken runs it, with the same ids at several times the speed
(``tests/llm/test_tokens.py`` compares the two). Strings of special tokens are ordinary text here.
"""

from __future__ import annotations

import json
from functools import lru_cache

import public_tokenizers
import tiktoken

DEFAULT_TOKENIZER = "byte_bpe_50k.json"


def default_path() -> str:
    return str(public_tokenizers.path(DEFAULT_TOKENIZER))


def _raw_bytes() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character; this gives the byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """One for each worker process and vocabulary."""
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    special = {x["content"] for x in described.get("added_tokens", ())}
    byte_of = _raw_bytes()
    # Ids of these vocabularies follow the order of the merges, so they serve as ranks.
    ranks = {
        bytes(byte_of[c] for c in token): rank
        for token, rank in described["model"]["vocab"].items()
        if token not in special
    }
    return tiktoken.Encoding(
        "from_file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def encode(path: str, text: str | None) -> list[int]:
    """The ids of a whole text. Null and empty texts have none."""
    return encoding(path).encode_ordinary(text) if text else []
