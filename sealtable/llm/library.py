"""Token ids of whole texts from a tokenizer library, for operators that use tokens."""

from __future__ import annotations

from functools import lru_cache
from struct import pack

import public_tokenizers
import tiktoken

from sealtable.llm import common, pretokens

# The ranks hold the vocabulary of byte_bpe_50k.json; tests compare the ids with those of
# the library that reads the JSON.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
# Ids of pre-tokens that a worker remembers; it starts afresh beyond this number.
MEMO = 500_000
SPECIAL_ID = 50256


class TokenIds(dict):
    """Packed ids by pre-token, asked of the library when first met.  A pre-token alone
    splits into itself, so its ids are those it has inside any text."""

    def __init__(self, path: str, width: int):
        self.library = tiktoken.Encoding(
            "own",
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks=pretokens.ranks_of(path),
            special_tokens={},
        )
        self.kind = {2: "H", 4: "I"}[width]
        self.special = pack(f"<{self.kind}", SPECIAL_ID)

    def __missing__(self, word: str) -> bytes:
        ids = self.library.encode_ordinary(word)
        if len(self) > MEMO:
            self.clear()
        found = pack(f"<{len(ids)}{self.kind}", *ids)
        if len(word) <= 64:
            self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Little-endian ids; the added token's string counts as that token."""
        if pretokens.SPECIAL in text:
            return self.special.join(map(self.plain, text.split(pretokens.SPECIAL)))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, pretokens.split(text)))


@lru_cache(2)
def token_ids(path: str = RANKS, width: int = 4) -> TokenIds:
    """The ids of a worker process; what it has learnt serves all its tasks."""
    made = TokenIds(path, width)
    common.collect_rarely()
    return made
