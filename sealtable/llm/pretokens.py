"""Byte-level vocabularies and the split of a text into pre-tokens."""

from __future__ import annotations

import base64
import json
import re

import public_tokenizers
import regex

SPECIAL = "<|endoftext|>"
# Letters, numbers and blanks below U+0250, where Python's own engine can do the split.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_S = "\t-\r \u0085 "
_near = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
).findall
_any = regex.compile(public_tokenizers.PATTERN).findall
_far = re.compile("[^\x00-ɏ]").search


def split(text: str) -> list[str]:
    """The matches of ``public_tokenizers.PATTERN``, which cover the text."""
    return _any(text) if _far(text) else _near(text)


def ranks_of(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token's bytes and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies in JSON use for bytes: printable ones
    stand for themselves, the others are numbered from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def merges_of(path: str) -> tuple[dict[bytes, int], dict[tuple[bytes, bytes], int]]:
    """Token ids and merge ranks of a byte-level BPE in the JSON format."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    letters = byte_letters()

    def raw(token: str) -> bytes:
        return bytes(letters[c] for c in token)

    ids = {raw(t): i for t, i in model["vocab"].items() if t != SPECIAL}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return ids, {(raw(a), raw(b)): n for n, (a, b) in enumerate(pairs)}
