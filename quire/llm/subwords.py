"""Subword ids of the public byte-level BPE vocabulary with 50,257 ids.

The ids are those of the `tokenizers` library for the JSON file, added tokens included; tests hold both equal. Texts are encoded by tiktoken
from the same vocabulary's rank file, which is about four times as fast; its pattern matcher gives up on very long runs of white space, so
texts that hold one are encoded by `tokenizers` itself. The folder of the vocabulary files is a parameter and nothing of it is copied here.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np

VOCABULARY = "byte_bpe_50k"
#: The vocabulary's added token, which no merge makes, and its id.
ADDED = {"<|endoftext|>": 50_256}
#: White space longer than this is left to `tokenizers`.
LONG_RUN = 1_000
_long_run = re.compile(r"\s{%d}" % LONG_RUN)
#: White space that a word may hold; words without any are encoded together, so many at a time.
_inner_space = re.compile(r"[^\S ]")
TOGETHER = 512


def _file(kind: str, folder: str | None) -> str:
    import public_tokenizers

    return f"{folder}/{VOCABULARY}.{kind}" if folder else public_tokenizers.path(f"{VOCABULARY}.{kind}")


@cache
def _ranks(folder: str | None = None) -> dict[bytes, int]:
    with open(_file("tiktoken", folder), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@cache
def encoder(folder: str | None = None):
    """The fast encoder, loaded once in each worker."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(VOCABULARY, pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(folder), special_tokens=ADDED)


@cache
def _plain(folder: str | None = None, ordinary: bool = False):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(_file("json", folder))
    found.encode_special_tokens = ordinary
    return found


def ids_of(text: str, folder: str | None = None) -> np.ndarray:
    """Little-endian unsigned 32-bit ids of a text."""
    if len(text) > LONG_RUN and _long_run.search(text):
        return np.array(_plain(folder).encode(text, add_special_tokens=False).ids, "<u4")
    return np.asarray(encoder(folder).encode_to_numpy(text, allowed_special="all"), "<u4")


def ordinary_ids(text: str, folder: str | None = None) -> np.ndarray:
    """Ids of a text in which the added token's string is ordinary text."""
    if len(text) > LONG_RUN and _long_run.search(text):
        return np.array(_plain(folder, True).encode(text, add_special_tokens=False).ids, "<u4")
    return np.asarray(encoder(folder).encode_to_numpy(text, disallowed_special=()), "<u4")


@cache
def bytes_of_ids(folder: str | None = None) -> list[bytes]:
    """The bytes of each id, the added token's included."""
    out = {i: x for x, i in _ranks(folder).items()} | {i: x.encode() for x, i in ADDED.items()}
    return [out[i] for i in range(len(out))]


def word_ids(word: bytes, folder: str | None = None) -> list[int]:
    """Ids of a word after a space, as ordinary text."""
    text = " " + word.decode("utf-8", "replace")
    if len(text) > LONG_RUN and _long_run.search(text):
        return _plain(folder, True).encode(text, add_special_tokens=False).ids
    return encoder(folder).encode_ordinary(text)


def all_word_ids(words: list[bytes], folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """`word_ids` of many words, end to end, and how many each has (unsigned 16-bit ids).

    Words are encoded as one text: the matcher cuts before each space that separates them, and only there does an id begin with a space. Where
    a word holds white space of another kind, or the words cannot be told apart, they are encoded one by one.
    """
    found, lengths, begins = [], [], begins_word(folder)
    for i in range(0, len(words), TOGETHER):
        some = words[i : i + TOGETHER]
        text = " " + b" ".join(some).decode("utf-8", "replace")
        if not _inner_space.search(text):
            ids = encoder(folder).encode_to_numpy(text, disallowed_special=())
            at = np.flatnonzero(begins[ids])
            if len(at) == len(some):
                found.append(ids.astype(np.uint16))
                lengths.append(np.diff(at, append=len(ids)))
                continue
        each = [word_ids(w, folder) for w in some]
        found.append(np.array([x for ids in each for x in ids], np.uint16))
        lengths.append(np.array([len(ids) for ids in each], np.int64))
    return np.concatenate(found or [np.empty(0, np.uint16)]), np.concatenate(lengths or [np.empty(0, np.int64)])


@cache
def begins_word(folder: str | None = None) -> np.ndarray:
    """For each id, whether it begins a word: its first byte is a space. The added token is one of them."""
    out = np.zeros(len(_ranks(folder)) + len(ADDED), bool)
    out[[i for x, i in _ranks(folder).items() if x[:1] == b" "] + list(ADDED.values())] = True
    return out
