"""SentencePiece encoding that keeps, for every piece, the bytes of the original text it stands for; and decoding."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from riskframe.llm.texts import Memo, map_texts

SPACE = "▁"

# Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharacterMap:
    """The model's compiled character map: a double-array trie of UTF-8 keys, and the texts that replace them."""

    def __init__(self, compiled: bytes) -> None:
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.texts = compiled[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Bytes taken by the longest key that starts at ``at``, and its replacement; (0, b"") if there is none."""
        units, taken, value = self.units, 0, 0
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                taken, value = i + 1 - at, units[node] & 0x7FFFFFFF
        return taken, self.texts[value : self.texts.index(b"\0", value)] if taken else b""


class Aligned:
    """A SentencePiece model whose normaliser records where each normalised byte comes from."""

    def __init__(self, path: str) -> None:
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rule = model.normalizer_spec
        if model.trainer_spec.treat_whitespace_as_suffix or not rule.escape_whitespaces:
            raise ValueError("models that mark word ends, or that leave spaces as they are, aren't supported")
        self.map = CharacterMap(rule.precompiled_charsmap)
        self.prefix, self.squeeze = rule.add_dummy_prefix, rule.remove_extra_whitespaces
        pieces = [(p.piece, p.type) for p in model.pieces]
        self.unknown = next((i for i, (_, kind) in enumerate(pieces) if kind == UNKNOWN), -1)
        self.bytes = np.array([kind == BYTE for _, kind in pieces])
        self.lengths = np.array([1 if kind == BYTE else len(text.encode()) for text, kind in pieces], np.int64)
        self.surfaces = [self._surface(text, kind, model.trainer_spec.unk_surface) for text, kind in pieces]
        # Pieces never reach from a letter into the next space, so that words can be encoded one by one.
        by_word = not any(re.search(f"[^{SPACE}]{SPACE}", text) for text, kind in pieces if kind in (NORMAL, USER))
        self.word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if by_word else "(?s:.+)")
        # The same model without its normaliser: what it is given is normalised already.
        rule.precompiled_charsmap, rule.add_dummy_prefix = b"", False
        rule.remove_extra_whitespaces, rule.escape_whitespaces = False, False
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        # A word's ids are remembered as the bytes that a text's ids are joined from.
        self.words = Memo(lambda word: np.array(self.library.encode(word), np.int32).tobytes())

    @staticmethod
    def _surface(text: str, kind: int, unknown: str) -> bytes:
        if kind == BYTE:
            return bytes([int(text[1:-1], 16)])
        return {CONTROL: b"", UNKNOWN: unknown.encode()}.get(kind, text.replace(SPACE, " ").encode())

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The text as the pieces spell it, and for each of its bytes (and its end) the byte of ``text`` it begins at."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int64)
        if not self.map and not self.squeeze:
            wide = np.where(np.frombuffer(data, np.uint8) == 0x20, 3, 1)
            source = np.repeat(np.arange(len(data)), wide)
            normal = text.replace(" ", SPACE)
            if self.prefix:
                normal, source = SPACE + normal, np.concatenate([np.zeros(3, np.int64), source])
            return normal, np.append(source, len(data))
        out, source = bytearray(), []
        space = SPACE.encode()
        at = 0
        spaced = self.squeeze  # whether spaces are dropped just now
        if self.prefix:
            out, source, opened = bytearray(space), [0, 0, 0], False
        else:
            opened = True
        while at < len(data):
            taken, new = self.map.longest(data, at) if self.map else (0, b"")
            if not taken:
                taken = 1
                while at + taken < len(data) and data[at + taken] & 0xC0 == 0x80:
                    taken += 1
                new = data[at : at + taken]
            if spaced:
                new = new.lstrip(b" ")
            if new:
                if self.squeeze:
                    spaced = new.endswith(b" ")
                opened = True
                spelled = new.replace(b" ", space)
                out += spelled
                source += [at] * len(spelled)
            at += taken
        end = len(data)
        if self.squeeze:
            while out.endswith(space):
                end = source[-1]
                del out[-3:], source[-3:]
        if not opened:
            out, source, end = bytearray(), [], 0
        return out.decode(), np.array([*source, end], np.int64)

    def ids(self, normal: str) -> np.ndarray:
        words = self.words
        return np.frombuffer(b"".join([words[w] for w in self.word.findall(normal)]), np.int32)

    def spans(self, normal: str, source: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of each piece in the original text. A piece of the prefix alone covers no byte."""
        lengths = self.lengths[ids]
        if self.unknown >= 0 and (ids == self.unknown).any():
            found = [self.library.encode(w, out_type="immutable_proto") for w in self.word.findall(normal)]
            lengths = np.array([len(normal_piece.surface.encode()) for f in found for normal_piece in f.pieces], np.int64)
        edges = source[np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])]
        return edges[:-1].astype(np.int32), edges[1:].astype(np.int32)

    def decode(self, ids) -> str:
        surfaces = self.surfaces
        data = b"".join([surfaces[i] for i in ids])
        if (self.prefix or self.squeeze) and data.startswith(b" "):
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:  # byte pieces that form no character: one mark for each byte
            out, at = [], 0
            while at < len(data):
                for n in (4, 3, 2, 1):
                    try:
                        char = data[at : at + n].decode()
                    except UnicodeDecodeError:
                        continue
                    if len(char) == 1:
                        out.append(char)
                        at += n
                        break
                else:
                    out.append("�")
                    at += 1
            return "".join(out)


@cache
def aligned(path: str) -> Aligned:
    """One per worker process."""
    return Aligned(path)


def encode_decode(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids``, ``begins`` and ``ends`` (bytes of the original text) of the pieces, and the ``decoded`` ids.

    Ids are those of the library without begin and end ids; the text of a
    document never leaves its row. NULL and empty texts have no pieces.
    """

    def start():
        model = aligned(path)

        def answer(text: str) -> tuple:
            normal, source = model.normalise(text)
            ids = model.ids(normal)
            begins, ends = model.spans(normal, source, ids)
            return ids, begins, ends, model.decode(ids.tolist())

        return answer

    return map_texts(
        documents, "text", ["doc_id"], "ids array<int>, begins array<int>, ends array<int>, decoded string", start
    )
