"""Token ids of whole texts for a public tokenizer file, fast where that provably gives the same ids."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: Scripts whose letter, digit and space classes the two libraries' pattern engines agree on
#: (Latin and general punctuation; see tests/llm/test_packing.py). Texts with any other character take
#: the slower library.
_OTHER = re.compile("[^\x00-ɏ‐-‧‰-⁞]")
VOCABULARY, SPECIAL = "byte_bpe_50k", "<|endoftext|>"


@lru_cache(maxsize=4)
def _slow(path: str, plain: bool):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = plain
    return t


@lru_cache(maxsize=4)
def _fast(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{VOCABULARY}.json")


def token_ids(text: str, path: str | None = None, plain: bool = False) -> np.ndarray:
    """Ids (uint32) that ``tokenizers`` gives for the file at ``path``, add_special_tokens=False.

    ``plain``: the special token's string in a text is ordinary text. The same merges in tiktoken
    run about six times as fast and give the same ids, so they serve all texts of the checked
    scripts that don't hold the special token's string.
    """
    path = path or default_path()
    if path.endswith(f"{VOCABULARY}.json") and not _OTHER.search(text) and (plain or SPECIAL not in text):
        return _fast(path.removesuffix("json") + "tiktoken").encode_to_numpy(text, disallowed_special=())
    return np.array(_slow(path, plain).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
