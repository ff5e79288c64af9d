"""Byte-level tokenizer files: pre-token splitting that agrees with the tokenizers library."""

from __future__ import annotations

import functools
import json
import re

import regex

# The published split pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Regular-expression engines disagree on characters that Unicode added lately. Blocks in which
# they agree (tests/llm compares every code point); other texts are split by the library itself.
AGREED = re.compile("[^\u0000-ԯḀ-⁯₠-₿　-〩ぁ-ゖァ-ヺ一-龥가-힣]")


@functools.cache
def splitter():
    return regex.compile(SPLIT)


@functools.cache
def specials(path: str) -> re.Pattern | None:
    """The added tokens of a file, which the library takes out of a text before splitting it."""
    with open(path, encoding="utf-8") as file:
        added = [token["content"] for token in json.load(file)["added_tokens"]]
    return re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None


@functools.cache
def _library():
    from tokenizers import pre_tokenizers

    return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def pretokens(text: str) -> list[str]:
    """The pieces of a text (free of special strings) between which no merge happens."""
    if AGREED.search(text) is None:
        return splitter().findall(text)
    return [text[start:end] for _, (start, end) in _library().pre_tokenize_str(text)]
