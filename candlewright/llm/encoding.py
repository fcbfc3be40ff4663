"""Token ids by the tokenizers library, with one library call per distinct piece of text.

A tokenizer first cuts text at places that its pattern fixes and then works on each piece alone.
For texts of plain characters (Latin letters, digits, ASCII punctuation without the apostrophe,
single spaces and line feeds in any number) the cuts are found here, and each piece goes to the
library once in the life of a worker, as long as the bounded memory of pieces holds it.  Every
other text, and one that holds the name of an added token, goes to the library whole.  Both ways
give the ids of a plain library call.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import numpy as np

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[{_LETTERS}0-9 \\n!-&(-/:-@\\[-`{{-~]*")
#: The tokenizers' own patterns, on plain characters.
_PIECES = {
    "word": re.compile(f"[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+"),
    "byte": re.compile(f" ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+"),
}
#: Pieces remembered by a worker, so that its memory is bounded.
PIECES_KEPT = 600_000


class Encoder:
    """Ids of texts by the tokenizer file ``path``; ``kind`` is ``word`` (lower-cased words) or ``byte``."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already fill the cores
        self.tokenizer = Tokenizer.from_file(path)
        tokens = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.strip() for t in tokens if t.content.strip()]
        self.any_case = any(t.normalized for t in tokens)  # found in normalised text, so perhaps in another case
        self.kind, self.pieces = kind, _PIECES[kind]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """One library call for many pieces; word_ids tell which ids belong to which piece."""
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            found = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ends = np.searchsorted(np.array(found.word_ids), np.arange(len(part)), side="right") * self.dtype.itemsize
            ids, start = np.array(found.ids, self.dtype).tobytes(), 0
            for piece, end in zip(part, ends.tolist(), strict=True):
                self.known[piece] = ids[start:end]
                start = end

    def _names_added(self, text: str) -> bool:
        if self.any_case:
            text = text.lower()
            return any(name.lower() in text for name in self.added)
        return any(name in text for name in self.added)

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif _PLAIN.fullmatch(text) and not self._names_added(text):
                pieces = self.pieces.findall(text.lower() if self.kind == "word" else text)
                try:
                    out.append(b"".join(map(self.known.__getitem__, pieces)))
                except KeyError:
                    if len(self.known) > PIECES_KEPT:
                        self.known.clear()
                    self._learn(list({p for p in pieces if p not in self.known}))
                    out.append(b"".join(map(self.known.__getitem__, pieces)))
            else:
                out.append(self._library([text])[0])
        return [np.frombuffer(ids, self.dtype) for ids in out]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder for a tokenizer file; kept between tasks."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
