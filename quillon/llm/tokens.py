"""Byte-level BPE ids inside tasks.

The ids are those of the ``tokenizers`` library for the JSON file of the same vocabulary; they are made by
``tiktoken`` from the rank file, which is several times faster. A test compares both libraries over every
Unicode code point and over texts that hold the special token's string.

The pattern that cuts pre-tokens looks ahead in white space, for a time that grows with the square of a run, and the engine below gives up
on runs of about a million characters. Such a run is one pre-token but for its last character, which may belong to what follows (the whole
run, at the end of a text); runs of ``LONG_RUN`` characters or more are therefore cut out first and merged without the pattern.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken

RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
LONG_RUN = 40
# The characters that the pattern takes for white space.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


def rank_path() -> str:
    return public_tokenizers.path(RANKS)


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoding of a rank file; loaded once per Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})


def is_plain(text: str) -> bool:
    """Whether the text has neither the special token's string nor a long run of white space."""
    return SPECIAL not in text and (len(text) < LONG_RUN or not LONG_SPACE.search(text))


def encode(bpe: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of a whole text as uint32; the special token's string becomes its id, as in ``tokenizers``."""
    if is_plain(text):
        return bpe.encode_to_numpy(text, disallowed_special=())
    parts = []
    for k, stretch in enumerate(text.split(SPECIAL)):
        if k:
            parts.append(np.array([SPECIAL_ID], np.uint32))
        parts += _with_runs(bpe, stretch)
    return np.concatenate(parts)


def _with_runs(bpe: tiktoken.Encoding, text: str) -> list[np.ndarray]:
    whole = encoder(bpe.name, r"[\s\S]+")
    parts, at = [], 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() - (run.end() < len(text))
        parts += [bpe.encode_to_numpy(text[at : run.start()]), whole.encode_to_numpy(text[run.start() : end])]
        at = end
    return [*parts, bpe.encode_to_numpy(text[at:])]
