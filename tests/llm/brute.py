"""Plain versions of the operators, row by row, for small tables."""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def crc_of(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def token_rows(docs):
    """(doc_id, start, n_tokens, ids_crc32) in ascending doc_id order; ids of docs must differ."""
    start, rows = 0, []
    for doc_id, text in sorted(docs):
        ids = [*ids_of(text), 2]
        rows.append((doc_id, start, len(ids), crc_of(ids)))
        start += len(ids)
    return rows


def piece_rows(docs, capacity=4096):
    rows = []
    for doc_id, text in docs:
        ids = [*ids_of(text), 1]
        rows += [(doc_id, n, a, len(ids[a : a + capacity]), crc_of(ids[a : a + capacity])) for n, a in enumerate(range(0, len(ids), capacity))]
    return sorted(rows, key=str)


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")
