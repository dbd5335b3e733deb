"""Token ids of texts by a public byte-level BPE vocabulary."""

import base64
import re

import numpy as np

CHUNK = 1 << 20
# beyond these, text goes to the tokenizer file itself; before, its ranks give the same ids faster
_RARE = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]|<\|endoftext\|>")
# a place at which two pre-tokens always part: a blank between a letter and a letter
_PART = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")
_cache = {}


def default_paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def _loaded(paths):
    if paths not in _cache:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(paths[1], "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        quick = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _cache[paths] = Tokenizer.from_file(paths[0]), quick
    return _cache[paths]


def _chunks(text):
    """The text in parts of about CHUNK characters whose ids, one after the other, are the text's ids."""
    start = 0
    while len(text) - start > CHUNK:
        cut = _PART.search(text, start + CHUNK)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def token_ids(text, paths):
    """The ids of `tokenizers` without added special tokens, as an array."""
    slow, quick = _loaded(paths)
    if _RARE.search(text):
        parts = [np.array(slow.encode(part, add_special_tokens=False).ids, np.uint32) for part in _chunks(text)]
    else:
        parts = [np.array(quick.encode_ordinary(part), np.uint32) for part in _chunks(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)
