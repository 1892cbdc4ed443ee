"""A public byte-level tokenizer, read from its vocabulary file; folder and file are parameters."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable
from functools import lru_cache

#: Where the vocabulary files are.
FOLDER = os.environ.get("STRATAFORGE_TOKENIZERS", "/opt/tokenizers")
FILE = "byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of this byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=4)
def encoding(folder: str = FOLDER, file: str = FILE):  # noqa: ANN201
    """The tokenizer, loaded once per worker."""
    import tiktoken

    with open(os.path.join(folder, file), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(file, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})




def split_tokens(folder: str = FOLDER, file: str = FILE) -> Callable[[str], list[str]]:
    """A function that cuts a text into token strings which join to the text again.

    With the vocabulary file, tokens that end inside a code point are joined with the next; without it, pieces of words.
    """
    if not os.path.exists(os.path.join(folder, file)):
        return lambda text: [m[0] for m in re.finditer(r"\s*(?:\w{1,8}|[^\w\s])|\s+$", text)]

    def cut(text: str) -> list[str]:
        encoder = encoding(folder, file)
        out, held = [], b""
        for token in encoder.encode_ordinary(text):
            held += encoder.decode_single_token_bytes(token)
            try:
                out.append(held.decode())
                held = b""
            except UnicodeDecodeError:
                continue
        return out

    return cut
