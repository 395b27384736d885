"""Byte-level BPE, exact for whole texts.

Texts are encoded by tiktoken with the vocabulary, merges and pre-tokenizer pattern of the
given tokenizers file; what holds an added token, and files of any other kind, go to the
tokenizers library itself. A byte-level pre-tokenizer always cuts between a character that
is no white space and a white-space character, so a text cut there falls into pieces whose
ids do not depend on their neighbours.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import cached_property

from quillstone.llm.common import resident

#: Code points encoded at once, but for a longer stretch without a place to cut.
PASS = 1 << 20
#: Longer runs of white space are left to the library.
BLANK = 100_000
#: Pieces of this many characters or more are not kept.
LONGEST = 64
#: A space after white space: there, cutting at every space is not safe.
_TIGHT = re.compile(r"\s ")
_RUNS = re.compile(r"\s*\S+|\s+")
#: The pre-tokenizer's pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of_unicode() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in set(shown)):
        out[chr(256 + n)] = b
    return out


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class PieceEncoder:
    """encode(text) -> ids as little-endian unsigned 32-bit bytes, as the library gives them."""

    def __init__(self, path: str):
        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._compile(spec)
        # for words, where no added token can be in them
        plain = any(all(c.isalpha() or c == " " for c in t) for t in self.added)
        self.one = self.fast._encode_single_piece if self.fast is not None and not plain else None

    @cached_property
    def library(self):
        """Loaded only where a text needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _compile(self, spec: dict):
        """A tiktoken encoder of the same merges, or None where the file is of another kind."""
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if model.get("type") != "BPE" or spec.get("normalizer") or any(pre.get(k) != v for k, v in plain.items()):
            return None
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", [])):
            return None
        vocab, to_byte = model["vocab"], _bytes_of_unicode()
        order = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if order != sorted(order) or model.get("dropout") or model.get("continuing_subword_prefix"):
            return None
        import tiktoken

        ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if all(c in to_byte for c in t)}
        return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def pieces_are_exact(self) -> bool:
        return self.fast is not None

    def ids(self, text: str) -> list[int]:
        # tiktoken's pattern fails on white space of about a million characters
        blank = len(text) > BLANK and max(map(len, re.findall(r"\s+", text)), default=0) > BLANK
        if self.fast is None or blank or any(t in text for t in self.added):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def encode(self, text: str) -> bytes:
        """Of a long text some at a time, cut where a space or line feed follows what is no white space."""
        if self.fast is None or len(text) <= PASS:
            return _packed(self.ids(text)) if text else b""
        out, lo = [], 0
        while lo < len(text):
            hi = lo + PASS
            while hi < len(text) and not (text[hi] in " \n" and not text[hi - 1].isspace()):
                hi += 1
            out.append(_packed(self.ids(text[lo:hi])))
            lo = hi
        return b"".join(out)


def encoder(path: str) -> PieceEncoder:
    """The worker process keeps one."""
    return resident(("encoder", path), lambda: PieceEncoder(path))
