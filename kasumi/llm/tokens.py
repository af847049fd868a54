"""Ids of a byte-level BPE vocabulary, as the ``tokenizers`` library gives them.

Both libraries hold the same vocabulary. The ranks file is about four times as
fast; texts beyond ``FAST`` or with a special token's string go to ``tokenizers``
itself, so that different Unicode versions of the two never matter.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from pathlib import Path

import numpy as np

#: Code points for which the tests compare both libraries one by one.
FAST = re.compile("[^\x00-ɏ]")


class ByteBpe:
    """``encode(text)``: the ids as unsigned 32-bit integers."""

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path and pattern:
            import tiktoken

            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(ranks_path).read_bytes().splitlines())}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast and (text.isascii() or not FAST.search(text)) and not any(x in text for x in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@functools.cache
def byte_bpe(json_path: str, ranks_path: str | None = None, pattern: str | None = None) -> ByteBpe:
    """One for each Python worker."""
    return ByteBpe(json_path, ranks_path, pattern)
