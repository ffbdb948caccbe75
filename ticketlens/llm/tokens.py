"""Token ids of whole texts by a byte-level vocabulary."""

from __future__ import annotations

import base64
import os
import re

import numpy as np

#: how the byte-level vocabulary cuts texts before merging (fixed value of its published files)
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters that all libraries class alike; a text with any other is encoded as a whole.
_UNUSUAL = re.compile(
    "[^\x00-\x1b\x20-\x84\x86-ɏΑ-ΡΣ-ωЀ-ҁҊ-ӿ"
    " -⁞ぁ-ゖァ-ヺ一-龥가-힣]")


class Encoder:
    """Ids of a byte-level vocabulary given as tokenizer file and, the same, as rank file.

    Encoding from the ranks is about four times as fast; texts with unusual characters go through
    the tokenizer itself, and so do texts with the string of an added token.  The ids are the
    tokenizer's, as it is loaded, in either case.
    """

    def __init__(self, tokenizer_file: str, rank_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([_UNUSUAL.pattern, *map(re.escape, added)]))
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding(
            "ranks", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.whole.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_to_numpy(text)
        return np.asarray(ids, "<u4").tobytes()
