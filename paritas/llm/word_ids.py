"""Whole texts to ids of a tokenizers file, word by word with a bounded memory.

The tokenizer drops white space and no piece of its pattern crosses it, so a
text's ids are those of its runs of non-space bytes, one after another.  Each
distinct run is encoded once and kept, as little-endian uint32 bytes, in a memory
of at most ``MOST_WORDS`` runs per worker; when that is full, the half that was
met first (it holds the frequent words) stays.  A run of several pieces, such as a
word and a stop, takes each piece from that memory.  A worker keeps it from task to task.

A run is encoded by the library.  Printable Latin-1 runs skip its normaliser and
splitter, which there come to lower case and the splitter's own pattern, and go
to the library's BPE model piece by piece; all others take the whole library.
Vocabularies of another make are refused (``of_known_make``).
"""

from __future__ import annotations

import json
import os
from array import array
from itertools import islice

#: Runs kept per Python worker (about 200 bytes each).
MOST_WORDS = 600_000

_encoders: dict[str, WordEncoder] = {}


def byte_letters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself if printable, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class WordEncoder(dict):
    """Maps a run to its ids' bytes; runs not met yet are encoded and kept."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not of_known_make(spec):
            raise ValueError(f"{path}: not a lower-cased byte-level BPE that drops white space")
        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.letters = dict(enumerate(byte_letters()))

    def __missing__(self, run: bytes) -> bytes:
        if len(self) >= MOST_WORDS:
            first = list(islice(self.items(), MOST_WORDS // 2))
            self.clear()
            self.update(first)
        if run.isalpha():
            ids = array("I", [token.id for token in self.model.tokenize(run.lower().decode())]).tobytes()
        else:
            ids = self.encode_run(run)
        self[run] = ids
        return ids

    def encode_run(self, run: bytes) -> bytes:
        text = run.decode()
        if not text.isprintable() or "<|" in text or not (text.isascii() or max(text) < "Ā"):
            return array("I", self.full.encode(text, add_special_tokens=False).ids).tobytes()
        text = text.lower()
        if not text.isalpha():
            pieces = self.pieces(text)
            if len(pieces) > 1:
                return b"".join([self[piece.encode()] for piece in pieces])
            text = "".join(pieces)
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.letters)
        return array("I", [token.id for token in self.model.tokenize(text)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32 bytes."""
        get = self.__getitem__
        return [b"".join(map(get, (t.lower() if t.isascii() and "<|" not in t else t).encode().split())) for t in texts]


def of_known_make(spec: dict) -> bool:
    """NFC, one space for white space, lower case; a pattern whose matches hold no white space; byte-level BPE."""
    normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if normal != ["NFC", "Replace", "Lowercase"] or [p.get("type") for p in pre] != ["Split", "ByteLevel"]:
        return False
    cut = pre[0]
    return cut.get("behavior") == "Removed" and bool(cut.get("invert")) and r"[^\s" in (cut.get("pattern") or {}).get("Regex", "") and spec["model"]["type"] == "BPE" and not pre[1].get("add_prefix_space")


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for the file; the vocabulary is loaded once per worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
