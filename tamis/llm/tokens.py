"""The public tokenizers, once per Python worker."""

from __future__ import annotations

import base64
import functools
import os

#: Folder of the vocabulary files; the environment variable or the argument of each operator replaces it.
FOLDER = os.environ.get("TAMIS_TOKENIZERS", "/opt/tokenizers")
#: The pattern that splits text before the merges of the byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def encoding(name: str = "byte_bpe_50k", folder: str = FOLDER):
    """A tiktoken encoding without special tokens: their strings in a text are ordinary text."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
