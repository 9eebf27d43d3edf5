"""Token ids of whole texts from a ``tokenizers`` file.

For a vocabulary that drops white space and lower-cases, ids are remembered for each
stretch between ASCII white space: no token spans white space there, so the ids of a
text are those of its stretches in a row. Other vocabularies encode each text whole.
"""

from __future__ import annotations

import json
import re
import string
from array import array

import numpy as np

from recordlens.llm.memory import REMEMBERED_BYTES

# The normaliser and splitting pattern of files that drop white space.
_NORMALIZER = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

# Letters that normalising leaves as they are, then ASCII punctuation.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]*)([!-/:-@\[-`{-~]*)")
_LETTERS = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_PUNCTUATION = string.punctuation.encode()

REMEMBERED = 500_000
TURNS = 32

_LOADED: dict[str, TokenIds] = {}


class _Stretches(dict):
    """Ids of stretches as bytes, worked out when first asked for. The first ones stay, as frequent
    words come early; ``later`` ones are forgotten when they are as many, and after ``TURNS`` times
    the first ones too, should the texts have changed. So memory is bounded."""

    def __init__(self, whole):
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole, self.model = whole, whole.model
        to_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(x): to_bytes.pre_tokenize_str(x)[0][0] for x in _LETTERS}
        self.later: dict[bytes, bytes] = {}
        self.turns = 0

    def turn(self) -> None:
        if len(self.later) > REMEMBERED // 2:
            self.later.clear()
            self.turns += 1
            if self.turns % TURNS == 0:
                self.clear()

    def __missing__(self, stretch: bytes) -> bytes:
        ids = self.later.get(stretch)
        if ids is None:
            if stretch.isalpha():
                ids = self._word(stretch.lower().decode())
            else:
                letters = stretch.rstrip(_PUNCTUATION)
                if letters.isalpha():
                    ids = self[letters] + self[stretch[len(letters) :]]
                else:
                    ids = self._any(stretch.decode())
            if len(stretch) <= REMEMBERED_BYTES:
                (self if len(self) < REMEMBERED // 2 else self.later)[stretch] = ids
        return ids

    def _word(self, letters: str) -> bytes:
        return array("H", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _any(self, text: str) -> bytes:
        match = _PLAIN.fullmatch(text.lower())
        if match and match[1]:
            if match[2]:
                return self[match[1].encode()] + self[match[2].encode()]
            return self._word(match[1].translate(self.letters))
        return array("H", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


class TokenIds:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_stretch = (
            (spec.get("normalizer") or {}).get("normalizers") == _NORMALIZER
            and split[0].get("pattern") == {"Regex": _PATTERN}
            and split[0].get("behavior") == "Removed"
            and self.whole.get_vocab_size() <= 1 << 16
        )
        self.seen = _Stretches(self.whole)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text as unsigned 32-bit integers."""
        if not self.by_stretch:
            found = self.whole.encode_batch([t.decode() for t in texts], add_special_tokens=False)
            return [np.array(e.ids, np.uint32) for e in found]
        self.seen.turn()
        look = self.seen.__getitem__
        out = []
        for text in texts:
            # Lower-casing ASCII first is harmless except inside a special token.
            parts = (text if b"<|" in text else text.lower()).split()
            out.append(np.frombuffer(b"".join(map(look, parts)), np.uint16).astype(np.uint32))
        return out


def token_ids(path: str) -> TokenIds:
    """One instance per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = TokenIds(path)
    return _LOADED[path]


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes, null as empty."""
    import pyarrow as pa

    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]
