"""Vocabulary files on an executor: each process loads a file once."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from typing import Any

_loaded: dict[tuple[str, str], Any] = {}


def resolve(path: str) -> str:
    """A path as it is, or the place of one of the installed public vocabularies by its file name."""
    if os.path.dirname(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def once(kind: str, path: str, load: Callable[[str], Any]) -> Any:
    key = (kind, path)
    if key not in _loaded:
        _loaded[key] = load(resolve(path))
    return _loaded[key]


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _tiktoken(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def tiktoken_encoding(path: str):
    return once("tiktoken", path, _tiktoken)


def tokenizer(path: str):
    """The tokenizers library's tokenizer of a file, without truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return once("tokenizer", path, _tokenizer)
