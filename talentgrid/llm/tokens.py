"""Token counts and ids, exactly as the tokenizers library gives them for whole texts."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from pathlib import Path

import numpy as np

#: Pieces a worker remembers before it starts anew; bounds memory, changes no result.
REMEMBERED = 1_000_000

#: Characters outside scripts and signs that were complete many Unicode versions ago.
_UNSETTLED = re.compile(
    "[^\x00-\u024f\u0370-\u03ff\u0400-\u052f\u05d0-\u05ea\u0621-\u064a\u2000-\u206f"
    "\u20a0-\u20bf\u2100-\u214f\u2190-\u27bf\u3000-\u3029\u3041-\u3096\u30a1-\u30fa"
    "\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e\U0001f300-\U0001f6ff\U0001f900-\U0001f9ff]"
)


def tokenizer_file(name: str) -> str:
    """Where the installed public tokenizers keep a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_version(path: str) -> str:
    """Digest of a vocabulary file: counts of another file are never mixed in."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores already
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def words_apart(text: str) -> list[str]:
    """Pieces for a vocabulary that drops white space: cut at every blank and line feed."""
    return text.replace("\n", " ").split(" ")


class PieceCache:
    """What the tokenizer gives for each piece seen so far, after ``shape``."""

    def __init__(self, path: str, cut: Callable[[str], list[str]], shape: Callable):
        self.path, self.cut, self.shape = path, cut, shape
        self.known: dict[str, object] = {}

    def pieces(self, texts: Iterable[str]) -> list[list[str]]:
        """The pieces of each text, all of them known afterwards."""
        cut = [self.cut(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        missing = list({p for pieces in cut for p in pieces if p not in known})
        for start in range(0, len(missing), 4096):
            block = missing[start : start + 4096]
            encoded = load_tokenizer(self.path).encode_batch_fast(block, add_special_tokens=False)
            known.update(zip(block, map(self.shape, encoded)))
        return cut


@lru_cache(maxsize=4)
def _counts(path: str) -> PieceCache:
    return PieceCache(path, words_apart, len)


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Token counts for a vocabulary that drops white space."""
    cache = _counts(path)
    return [sum(map(cache.known.__getitem__, pieces)) for pieces in cache.pieces(texts)]


def _byte_names() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary's names.

    Visible bytes stand for themselves; the others follow from 256 in their order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteIds:
    """Token ids for a byte-level vocabulary, as the tokenizers library gives them.

    Where the vocabulary's ids follow the order of its merges, tiktoken's encoder is built
    from the same file and gives the same ids in a fraction of the time, without a
    cache. It is used for texts of characters whose class (letter, digit, space) has been
    settled for long; other texts, and other vocabularies, go to the library itself.
    """

    #: GPT-2's pattern of words; the possessive forms match what the plain ones do.
    WORDS = (
        r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    )

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.type = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.fast = self._encoding(json.loads(Path(path).read_text()))

    @classmethod
    def _encoding(cls, file: dict):
        import tiktoken

        model, cut = file["model"], file["pre_tokenizer"] or {}
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        wanted = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        plain = file["normalizer"] is None and model["type"] == "BPE" and not any(
            model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix",
                                   "byte_fallback", "ignore_merges")
        ) and not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in file["added_tokens"]
        )
        if not plain or any(cut.get(k) != v for k, v in wanted.items()):
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = [model["vocab"]["".join(pair)] for pair in pairs]
        names = _byte_names()
        ranks = {bytes(names[c] for c in k): v for k, v in model["vocab"].items() if k not in added}
        if merged != sorted(set(merged)) or max(ranks[bytes([b])] for b in range(256)) > merged[0]:
            return None
        return tiktoken.Encoding(
            "byte-level", pat_str=cls.WORDS, mergeable_ranks=ranks, special_tokens=added
        )

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        quick = [self.fast is not None and (t.isascii() or not _UNSETTLED.search(t)) for t in texts]
        rest = [t for t, q in zip(texts, quick) if not q]
        slow = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else [])
        return [
            (self.fast.encode_to_numpy(t, allowed_special="all") if q else np.array(next(slow).ids))
            .astype(self.type)
            for t, q in zip(texts, quick)
        ]


@lru_cache(maxsize=4)
def _byte_ids(path: str) -> ByteIds:
    return ByteIds(path)


def token_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """Token ids for a byte-level vocabulary, 16 bits wide where they all fit, else 32."""
    return _byte_ids(path).ids(texts)


def blocks(texts: list[str], most: int = 2_000_000) -> Iterable[tuple[int, int]]:
    """(start, end) runs of texts of about ``most`` characters, one long text alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)
