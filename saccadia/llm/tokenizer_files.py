"""Public tokenizer files, opened once in each process."""

from __future__ import annotations

import functools
import json
import os


def path(name: str) -> str:
    """The place of a file that the installed ``public_tokenizers`` package brings; other paths stay as they are."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def library(name: str):
    """The tokenizer of the library, on one thread: Spark's tasks are what runs side by side."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path(name))
    t.no_padding()
    t.no_truncation()
    return t


@functools.cache
def contents(name: str) -> dict:
    with open(path(name), encoding="utf-8") as f:
        return json.load(f)


@functools.cache
def specials(name: str) -> dict[bytes, int]:
    """Special strings and their ids, as the library has them: the file, read for them alone, would stay in memory beside it."""
    return {x.content.encode(): i for i, x in library(name).get_added_tokens_decoder().items() if x.special}
