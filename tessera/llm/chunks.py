"""Chunks of text that tokenizers encode on their own, and files of byte-level tokenizers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

#: Before a space that follows a letter, a number, an underscore or visible ASCII (none of them white space to
#: any library) every byte-level tokenizer's pattern begins a new pre-token, and so does every marked word: nothing
#: before it looks past it, and nothing behind it looks back.
_BORDER = re.compile(r"(?<=[\w!-~])(?= )")

chunks_of = _BORDER.split


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: visible Latin-1 itself, the rest from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def byte_level(spec: dict) -> None:
    """Raises unless a tokenizer's description is plain byte-level BPE, whose chunks can be told apart."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and model["type"] == "BPE"
    odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
    if not plain or any(odd) or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", [])):
        raise ValueError("not a plain byte-level BPE tokenizer")


def some_at_once(texts: Iterable[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of some MB together."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part
