"""Token ids of whole texts by a public tokenizer file.

The tokenizer drops white space, so no token crosses one, and its normalisation works within a run of
other characters. Plain runs (Western European letters, digits, ASCII marks) are cut into the file's own pieces here and
merged by piece_encoder; others go through the tokenizer itself. The ids equal those of encoding the
whole text (held by a test on random Unicode). Each task also compares both ways on its first CHECKED pieces and, should
they differ, uses the tokenizer alone from there on. Nothing is kept between texts.
"""

from __future__ import annotations

import json
import re
from array import array

import public_tokenizers

END_ID = 2
#: Characters encoded at once; a longer text is cut at white space.
LONG = 1 << 20
#: So many pieces of plain runs a task encodes both ways.
CHECKED = 4096
#: Runs of these characters need no Unicode normalisation and lower-case one to one. PIECE is the file's own
#: pattern on them.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PLAIN_TEXT = re.compile(r"[!-~À-ÖØ-öø-ÿ \t\n\r\x0b\x0c]*")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 \t\n\r\x0b\x0c]+")
SPACE = re.compile(r"[ \t\n\r\x0b\x0c]")


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the
    next of those from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def piece_encoder(path: str):
    """A tiktoken encoding of pieces, each ended by a zero byte in place of the file's word end; None if the
    file allows none.

    It merges any two neighbours whose joined string is a token, the earliest token first; the file's model
    merges listed pairs in their order. Both are one if tokens are numbered in the order of their merges and each token's
    string, encoded alone by the file's merges, gives that token: whenever two neighbours join to a token and
    no earlier merge is left within them, they are then the very pair listed for it."""
    import tiktoken
    from tokenizers import Tokenizer, models

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ends, vocab = model.get("end_of_word_suffix"), model["vocab"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model.get("merges", [])]
    if model["type"] != "BPE" or not ends or model.get("ignore_merges") or model.get("dropout"):
        return None
    order = [vocab[a + b] for a, b in merges]
    bare, whole = models.BPE(vocab, merges), Tokenizer.from_file(path).model
    letters, ranks = {c: b for b, c in enumerate(byte_letters())}, {}
    for token, i in vocab.items():
        final = token.endswith(ends) and token != ends
        text = token[: -len(ends)] if final else token
        if any(c not in letters for c in text):
            return None
        got = (whole if final else bare).tokenize(text)
        if len(got) != 1 or got[0].id != i:
            return None
        ranks[bytes(letters[c] for c in text) + b"\0" * final] = i
    singles = [i for t, i in ranks.items() if len(t.removesuffix(b"\0")) <= 1 and t != b"\0\0"]
    if order != sorted(order) or max(singles) > min(order, default=1 << 31) or len(ranks) != len(vocab):
        return None
    return tiktoken.Encoding("pieces", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})


class WordEncoder:
    """Encodes texts to ids as little-endian unsigned 32-bit bytes. The short way for plain runs
    holds for files with this normaliser and pattern (lower case, white space dropped)."""

    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.pieces, self.unchecked = Tokenizer.from_file(path), piece_encoder(path), CHECKED

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One encoder per worker process and file; each task that asks for it compares anew."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        cls._made[path].unchecked = CHECKED
        return cls._made[path]

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _plain(self, text: str) -> list[int]:
        if not self.pieces:
            return self._whole(text)
        found = PIECE.findall(text.lower())
        ids = self.pieces.encode_ordinary("\0".join(found) + "\0") if found else []
        if self.unchecked > 0:
            self.unchecked -= len(found)
            if (sure := self._whole(text)) != ids:
                self.pieces = None
                return sure
        return ids

    def _ids(self, text: str) -> list[int]:
        if not self.pieces or "<|" in text:
            return self._whole(text)
        if PLAIN_TEXT.fullmatch(text):
            return self._plain(text)
        ids, plain = [], []
        for run in SPACE.split(text):
            if PLAIN.fullmatch(run):
                plain.append(run)
            elif run:
                ids += self._plain(" ".join(plain))
                ids += self._whole(run)
                plain = []
        return ids + self._plain(" ".join(plain))

    def encode(self, text: str, end_id: int = END_ID) -> bytes:
        """ids of the text (no special tokens added), then end_id. An empty text has the end alone."""
        out, at = [], 0
        while len(text) - at > LONG and (cut := SPACE.search(text, at + LONG)):
            out.append(array("I", self._ids(text[at : cut.start()])).tobytes())
            at = cut.end()
        out.append(array("I", self._ids(text[at:])).tobytes())
        return b"".join([*out, end_id.to_bytes(4, "little")])
