"""A tokenizers file applied word by word: texts are split into pre-tokens, and each pre-token's pieces are remembered."""

from __future__ import annotations

import json
import re

from tokenizers import Tokenizer

# The letters and the numbers among the characters from space to U+017F.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBERS = "0-9²³¹¼½¾"

#: Any other character sends the whole text to the library: only here are the classes of both regex engines known to agree.
OTHER = re.compile("[^\t\n\r -~¡-įı-ſ‐-‧€]")

# The contractions of both patterns.
SHORT = "'(?:s|t|re|ve|m|ll|d)"

#: The two known splitting patterns for the characters above. Letters are tried first, as they are most common and start no other alternative.
PLAIN = {
    "words": re.compile(f"[{LETTERS}]+|[{NUMBERS}]|{SHORT}|[^\\s{LETTERS}{NUMBERS}]+"),
    "bytes": re.compile(f" ?[{LETTERS}]+| ?[{NUMBERS}]+|{SHORT}| ?[^\\s{LETTERS}{NUMBERS}]+|\\s+(?!\\S)|\\s+"),
}

# Fixed value: the word pattern as its file writes it.
WORDS_FILE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return dict(sorted(letters.items()))


class PreTokens:
    """Splits texts as the file's pre-tokenizer does, and gives the ids of one pre-token."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.special = [t["content"] for t in said.get("added_tokens", [])]
        self.lower, self.plain = False, None
        before, normal = said.get("pre_tokenizer") or {}, said.get("normalizer")
        parts = before.get("pretokenizers", [])
        if normal is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]:
            self.plain = PLAIN["bytes"]
        elif [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"].get("Regex") == WORDS_FILE:
            kinds = [n["type"] for n in (normal or {}).get("normalizers", [])]
            if kinds == ["NFC", "Replace", "Lowercase"]:  # composed letters only here, and white space is dropped anyway
                self.plain, self.lower = PLAIN["words"], True
        self.letters = list(byte_letters().values())

    def split(self, text: str) -> list[str] | None:
        """The pre-tokens, or None for a text that only the library itself should encode."""
        if self.plain is None or OTHER.search(text) or any(s in text for s in self.special):
            return None
        return self.plain.findall(text.lower() if self.lower else text)

    def ids(self, pretoken: str) -> list[int]:
        letters = self.letters
        return [t.id for t in self.model.tokenize("".join([letters[b] for b in pretoken.encode()]))]

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids
