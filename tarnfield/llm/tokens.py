"""Tokenizing inside tasks: one tokenizer per Python worker, and bounded memories of what short units encode to.

Vocabularies of the two kinds that ``cuts_spaces`` and ``cuts_words`` tell never form a token across a change from a
non-space to an ASCII space, so the encoding of a text is the encodings of its units, cut there, one after the other.
Most units recur; only new ones reach the library. With any other vocabulary whole texts go to the library.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain

import numpy as np

#: Entries of a worker's memory of units, and the bytes of the longest that it keeps.
MEMORY, MEMORY_BYTES = 400_000, 64
SPACE = rb" \t\n\r\x0b\x0c"
#: An ASCII space run with the non-spaces that follow it.
UNIT = re.compile(rb"[%s]*[^%s]+|[%s]+" % (SPACE, SPACE, SPACE))
#: UTF-8 of the white space characters beyond ASCII. A cut beside one of them is not proven.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


@lru_cache(maxsize=4)
def load(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_apart(tokenizer, units: list[bytes], separator: str) -> list[np.ndarray]:
    """Ids of each unit. Many units are encoded as one text with a special token between, at which the library cuts first."""
    out: list[np.ndarray] = []
    mark = tokenizer.token_to_id(separator)
    if mark is None:  # a vocabulary without that token
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)]
    for at in range(0, len(units), 2000):
        texts = [u.decode() for u in units[at : at + 2000]]
        odd = {k: np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4") for k, t in enumerate(texts) if "<|" in t}
        ids = np.array(tokenizer.encode(separator.join("" if k in odd else t for k, t in enumerate(texts)), add_special_tokens=False).ids, "<u4")
        cuts = np.flatnonzero(ids == mark)
        starts, ends = np.append(0, cuts + 1).tolist(), np.append(cuts, len(ids)).tolist()
        out += [odd[k] if k in odd else ids[a:z] for k, (a, z) in enumerate(zip(starts, ends, strict=True))]
    return out


class Memory(dict):
    """What units encode to. Units met first, the frequent ones among them, stay; once full, others are kept for one call only."""

    def recall(self, units: Iterable[bytes], find: Callable[[list[bytes]], list]) -> dict:
        """A dictionary with what each of ``units`` encodes to."""
        every = set(units)
        new = list(every.difference(self))
        found = dict(zip(new, find(new), strict=True))
        if len(self) + len(found) <= MEMORY and max(map(len, found), default=0) <= MEMORY_BYTES:
            self.update(found)
            return self
        self.update((u, x) for u, x in found.items() if len(self) < MEMORY and len(u) <= MEMORY_BYTES)
        return found | {u: self[u] for u in every.difference(found)}


def cuts_spaces(tokenizer) -> bool:
    """Whether a tokenizer works on the bytes of texts as they are, cut into words that carry one leading space."""
    config = json.loads(tokenizer.to_str())
    cuts = config.get("pre_tokenizer") or {}
    return not config.get("normalizer") and cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts.get("add_prefix_space")


class UnitCounts:
    """Token counts of texts, by units for a byte-level vocabulary whose words carry their leading space."""

    def __init__(self, path: str, separator: str = "<|endoftext|>"):
        self.tokenizer, self.seen, self.separator = load(path), Memory(), separator
        self.units = cuts_spaces(self.tokenizer)

    def count(self, texts: list[bytes]) -> list[int]:
        if not self.units:
            return [len(self.tokenizer.encode(t.decode(), add_special_tokens=False)) for t in texts]
        cut = [None if WIDE_SPACE.search(t) else UNIT.findall(t) for t in texts]
        known = self.seen.recall(chain.from_iterable(filter(None, cut)), lambda new: list(map(len, encode_apart(self.tokenizer, new, self.separator))))
        return [sum(map(known.__getitem__, units)) if units is not None else len(self.tokenizer.encode(t.decode(), add_special_tokens=False)) for t, units in zip(texts, cut, strict=True)]


#: How a vocabulary of lower-case words cuts a text.
WORD_STEPS = ["NFC", "Replace", "Lowercase"]
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters of ASCII and Latin-1 with ASCII signs after them: under that rule two tokens' worth of text, cut between.
CORE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one above 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def cuts_words(tokenizer) -> bool:
    """Whether a tokenizer lower-cases, cuts by WORD_SPLIT and then works on bytes."""
    config = json.loads(tokenizer.to_str())
    steps, cuts = (config.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
    cuts = cuts.get("pretokenizers", [])
    return [n["type"] for n in steps.get("normalizers", [])] == WORD_STEPS and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": WORD_SPLIT} and not cuts[1]["use_regex"]


class UnitIds:
    """Ids (little-endian unsigned 32 bit, as bytes) of texts for a vocabulary that drops white space."""

    def __init__(self, path: str, separator: str = "<|startoftext|>"):
        self.tokenizer, self.seen, self.separator = load(path), Memory(), separator
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("ids are packed as this machine's unsigned integers, which must be little-endian and of 32 bits")
        self.words, self.parts, self.letters, self.tokenize = cuts_words(self.tokenizer), {}, byte_letters(), self.tokenizer.model.tokenize

    def _part(self, part: str) -> bytes:
        text = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
        ids = array("I", [t.id for t in self.tokenize(text)]).tobytes()
        if len(self.parts) < MEMORY and len(part) <= MEMORY_BYTES:
            self.parts[part] = ids
        return ids

    def _find(self, units: list[bytes]) -> list[bytes]:
        """New units: letters and the signs after them go to the model as they are, all others through the whole library."""
        out, odd, known, match, part = [], [], self.parts.get, CORE.fullmatch, self._part
        for unit in units:
            cut = match(unit.decode())
            if cut is None:
                odd.append(len(out))
                out.append(b"")
                continue
            letters, signs = cut.groups()
            letters = letters.lower()
            ids = known(letters) or part(letters)
            out.append(ids + (known(signs) or part(signs)) if signs else ids)
        for k, ids in zip(odd, encode_apart(self.tokenizer, [units[k] for k in odd], self.separator), strict=True):
            out[k] = ids.tobytes()
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.words:
            return [array("I", self.tokenizer.encode(t.decode(), add_special_tokens=False).ids).tobytes() for t in texts]
        cut = [t.split() for t in texts]  # bytes.split(): ASCII white space only
        known = self.seen.recall(chain.from_iterable(cut), self._find)
        return [b"".join(map(known.__getitem__, units)) for units in cut]


#: Fixed value: how a byte-level vocabulary cuts a text.
BYTE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: UTF-8 of a character from U+0100 on, but for dashes, quotation marks, bullets and dots: how such are classed may differ between libraries.
RARE = re.compile(rb"[\xc4-\xe1\xe3-\xff]|\xe2(?!\x80[\x90-\xa7])")


def merge_ranks(tokenizer) -> dict[bytes, int] | None:
    """Bytes and ids of a byte-level BPE whose ids follow its merges, so that ids serve as ranks; else None."""
    model, value = json.loads(tokenizer.to_str())["model"], {c: b for b, c in byte_letters().items()}
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    merged = set(made)
    tokens = {t: k for t, k in model["vocab"].items() if k in merged or len(t) == 1}
    if any(a >= b for a, b in zip(made, made[1:], strict=False)) or any(c not in value for t in tokens for c in t):
        return None
    ranks = {bytes(map(value.__getitem__, t)): k for t, k in tokens.items()}
    return ranks if all(bytes([b]) in ranks for b in range(256)) else None


class ByteIds:
    """Ids (little-endian unsigned 32 bit, as bytes) of whole texts for a byte-level vocabulary.

    Texts of common characters without the marks of special tokens go to tiktoken, which runs the same vocabulary several
    times faster; all others go to the library itself. ``as_text``: the strings of special tokens are plain text.
    """

    def __init__(self, path: str, as_text: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ranks = merge_ranks(self.tokenizer) if cuts_spaces(self.tokenizer) else None
        self.fast = None if ranks is None else tiktoken.Encoding("ranks", pat_str=BYTE_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        added = json.loads(self.tokenizer.to_str()).get("added_tokens") or []
        self.marks = re.compile(b"|".join(re.escape(t["content"].encode()) for t in added)) if added and not as_text else None
        self.tokenizer.encode_special_tokens = as_text

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out, fast = [], self.fast
        for t in texts:
            easy = fast is not None and not RARE.search(t) and not WIDE_SPACE.search(t) and not (self.marks and self.marks.search(t))
            out.append(array("I", fast(t.decode()) if easy else self.tokenizer.encode(t.decode(), add_special_tokens=False).ids).tobytes())
        return out


@lru_cache(maxsize=4)
def byte_ids(path: str, as_text: bool = False) -> ByteIds:
    """One encoder for all tasks of a Python worker."""
    return ByteIds(path, as_text)


def byte_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    vocabulary, value = byte_ids(path, True).tokenizer.get_vocab(), {c: b for b, c in byte_letters().items()}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, k in vocabulary.items():
        out[k] = bytes(map(value.__getitem__, token)) if all(c in value for c in token) else token.encode()
    return out


@lru_cache(maxsize=4)
def load_pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


#: Like UNIT, but a space run that begins with a carriage return belongs to what stands before it: pieces may hold both.
PIECE_UNIT = re.compile(rb"[%s]*[^%s]+(?:\r[%s]*[^%s]*)*|[%s]+" % (SPACE, SPACE, SPACE, SPACE, SPACE))


def cuts_pieces(path: str) -> bool:
    """Whether a sentencepiece model merges the characters of texts as they are, never across the cuts of PIECE_UNIT."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(load_pieces(path).serialized_model_proto())
    n, kinds = model.normalizer_spec, model.SentencePiece
    as_is = n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not n.precompiled_charsmap and not model.trainer_spec.treat_whitespace_as_suffix
    plain = all(p.type in (kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE) for p in model.pieces)
    across = re.compile("[^ \t-\r][ \t\n\x0b\x0c]")
    return as_is and plain and model.trainer_spec.model_type == model.trainer_spec.BPE and not any(across.search(p.piece.replace("\u2581", " ")) for p in model.pieces)


def piece_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a sentencepiece model: U+2581 is a space, ``<0xHH>`` the byte HH."""
    model = load_pieces(path)
    return [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("\u2581", " ").encode() for k, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))]
