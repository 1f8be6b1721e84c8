"""Token ids of whole texts with the tokenizers library, each distinct piece of text encoded once a worker.

A text is cut only where its tokenizer cuts too: at ASCII white space if the tokenizer drops white space, else before a
space that follows a non-space. A new piece of plain letters, or of what the tokenizer's own splitting pattern makes of it,
goes straight to the library's BPE model; anything unusual goes through the library's whole chain, and so does a piece that
spells a special token, which gets that token's id, as the library does by default. Files of other kinds than the two known
here, or with added tokens that hold white space, look beyond themselves or are plain letters, are encoded text by text.

The texts of an Arrow batch are cut and their distinct pieces found by Arrow. New pre-tokens of these go to the model
together, with a byte between them that UTF-8 never has and that is split off as a token of its own; a piece's ids are those
of its pre-tokens, and Arrow puts them in place. Texts with white space before a space are encoded one by one."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from lumenbase.llm.common import ASCII_SPACE, OTHER_SPACE, SPACE_BEFORE, SPACED, worker_cache

#: The pattern that byte-level pre-tokenizers split by. A fixed value of the format.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: A byte that UTF-8 never has.
BETWEEN = 255


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Pieces(dict):
    """Piece to its ids as little-endian unsigned 32-bit bytes; a missing one is encoded. `ahead` stands before each piece
    and `mark` is how the vocabulary writes it; both are empty or a space."""

    def __init__(self, owner: TextEncoder, ahead: str, mark: str):
        super().__init__()
        self.tokenize, self.ahead, self.mark, self.lower, self.slow, self.letters = owner.model.tokenize, ahead, mark, owner.kind == "words", owner.piece_ids, owner.letters
        self.tails = {t: array("I", owner.piece_ids(t)) for t in (".", ",")} if owner.kind != "other" else {}

    def __missing__(self, piece: str) -> bytes:
        tail = self.tails.get(piece[-1:])
        body = piece if tail is None else piece[:-1]
        body = body.lower() if self.lower else body
        plain = body.isascii()
        if body.isalpha() and (plain or max(body) < "\u0300"):  # one pre-token, or two
            ids = array("I", [t.id for t in self.tokenize(self.mark + (body if plain else body.encode().decode("latin-1").translate(self.letters)))])
            if tail is not None:
                ids += tail
        else:
            ids = array("I", self.slow(self.ahead + piece))
        if sys.byteorder == "big":
            ids.byteswap()
        data = self[piece] = ids.tobytes()
        return data


class TextEncoder:
    """Remembers up to `keep` pieces and then forgets them, so memory is bounded; what is forgotten is encoded again."""

    def __init__(self, path: str, keep: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.model, self.letters = self.tokenizer.model, byte_letters()
        norm, pre = (json.loads(x.__getstate__()) if x is not None else None for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        pre = pre or {}
        steps = [s.get("type") for s in (norm or {}).get("normalizers", [])]
        splits = [s.get("type") for s in pre.get("pretokenizers", [])]
        self.kind = "other"
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = re.compile("|".join(re.escape(t.content) for t in added)).search if added else (lambda text: None)
        if type(self.model).__name__ != "BPE" or any(t.lstrip or t.rstrip or t.single_word or t.content.isalpha() or re.search(r"\s", t.content) for t in added):
            pass
        elif norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind, pattern = "spaced", BYTE_LEVEL_PATTERN
        elif steps == ["NFC", "Replace", "Lowercase"] and splits == ["Split", "ByteLevel"] and pre["pretokenizers"][0].get("invert") and pre["pretokenizers"][0].get("behavior") == "Removed" and not pre["pretokenizers"][1].get("use_regex"):
            self.kind, pattern = "words", pre["pretokenizers"][0]["pattern"]["Regex"]
        if self.kind != "other":
            self.split = regex.compile(pattern).findall
        self.first, self.later = Pieces(self, "", ""), Pieces(self, " ", "Ġ")
        self.parts: dict[str, bytes] = {}
        between = [t.id for t in self.model.tokenize(self.letters[BETWEEN])] if self.kind != "other" else []
        self.between = between[0] if len(between) == 1 else None
        if self.between is not None:
            from tokenizers.pre_tokenizers import Split

            self.table = np.array([ord(self.letters[b]) for b in range(256)], dtype="<u4")
            self.joined = Tokenizer(self.model)
            self.joined.pre_tokenizer = Split(self.letters[BETWEEN], "isolated")

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def piece_ids(self, piece: str) -> list[int]:
        """Characters below U+0300 are their own NFC form and lower-case by themselves, without regard to what follows."""
        if not piece or max(piece) >= "\u0300" or self.special(piece):
            return self.whole(piece)
        if self.kind == "words":
            piece = piece.lower()
            parts = [piece] if piece.isalpha() else self.split(piece)
        else:
            parts = [piece] if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()) else self.split(piece)
        return [t.id for p in parts for t in self.model.tokenize(p.replace(" ", "Ġ") if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.letters))]

    def forget(self) -> None:
        if len(self.first) + len(self.later) + len(self.parts) > self.keep:
            self.first.clear()
            self.later.clear()
            self.parts.clear()

    def encode(self, text: str) -> bytes:
        if self.kind == "other":
            return np.array(self.whole(text), dtype="<u4").tobytes()
        self.forget()
        if self.kind == "words":
            parts = [w for w in ASCII_SPACE.split(text) if w] if OTHER_SPACE.search(text) else text.split()
            return b"".join(map(self.first.__getitem__, parts))
        parts = SPACED.split(text) if SPACE_BEFORE.search(text) else text.split(" ")
        return self.first[parts[0]] + b"".join(map(self.later.__getitem__, parts[1:]))

    def learn(self, parts: list[str], at_once: int = 8192) -> None:
        """Remember the ids of pre-tokens."""
        for k in range(0, len(parts), at_once):
            some = parts[k : k + at_once]
            text = self.table[np.frombuffer(bytes([BETWEEN]).join(map(str.encode, some)), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.joined.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends, data = (4 * np.flatnonzero(ids == self.between)).tolist(), ids.tobytes()
            self.parts.update((w, data[a:z]) for w, a, z in zip(some, [0, *(e + 4 for e in ends)], [*ends, len(data)], strict=True))

    def piece_bytes(self, pieces: list[str], known: Pieces) -> list[bytes]:
        """Of each piece, what `known` has for it or would make of it. Most are letters, or letters and a full stop or comma."""
        self.forget()
        ahead, parts, tails = known.ahead if self.kind == "spaced" else "", self.parts, {t: ids.tobytes() for t, ids in known.tails.items()}
        low = list(map(str.lower, pieces)) if known.lower else pieces
        keys = [ahead + p if p.isalpha() else ahead + p[:-1] if p[-1:] in tails and p[:-1].isalpha() else "" for p in low]
        ids = list(map(parts.get, keys))
        todo, new, cuts = [k for k, x in enumerate(ids) if x is None], {}, {}
        for k in todo:
            t = keys[k]
            if t and (t.isascii() or max(t) < "\u0300"):
                new[t] = None
                continue
            keys[k] = ""
            if not pieces[k] or max(pieces[k]) >= "\u0300" or self.special(pieces[k]):
                ids[k] = known[pieces[k]]
            else:
                cuts[k] = self.split(ahead + low[k])
                new.update((t, None) for t in cuts[k] if t not in parts)
        self.learn(list(new))
        for k in todo:
            if ids[k] is None:
                ids[k] = parts[keys[k]] if keys[k] else b"".join(map(parts.__getitem__, cuts[k]))
        return [x + tails[p[-1]] if t and p[-1] in tails else x for p, t, x in zip(low, keys, ids, strict=True)]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        if self.between is None:
            return [self.encode(t or "") for t in texts.to_pylist()]
        texts, spaced = texts.fill_null(""), self.kind == "spaced"
        cut = pc.split_pattern(texts, " ") if spaced else pc.ascii_split_whitespace(texts)
        found, ends = cut.values.dictionary_encode(), cut.offsets.to_numpy()
        pieces, at = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy().astype(np.int64)
        if not spaced:
            ids = self.piece_bytes(pieces, self.first)
        else:
            odd = np.fromiter((not p or p[-1].isspace() for p in pieces), bool, len(pieces))
            if odd.any():
                alone = np.logical_or.reduceat(odd[at], ends[:-1])
                rest = iter(self.encode_all(texts.filter(pa.array(~alone))) if not alone.all() else [])
                return [self.encode(t.as_py()) if one else next(rest) for t, one in zip(texts, alone.tolist(), strict=True)]
            later = np.ones(len(at), bool)
            later[ends[:-1]] = False
            used = np.zeros(len(pieces), bool)
            used[at[later]] = True
            begin, place = np.unique(at[ends[:-1]], return_inverse=True)
            number = np.cumsum(used) - 1
            at[later] = number[at[later]]
            at[ends[:-1]] = used.sum() + place
            ids = self.piece_bytes([pieces[k] for k in np.flatnonzero(used).tolist()], self.later) + self.piece_bytes([pieces[k] for k in begin.tolist()], self.first)
        flat = pa.array(ids, pa.large_binary()).take(pa.array(at))
        data, ends = flat.buffers()[2], np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1)[ends].tolist()
        data = memoryview(data) if data is not None else b""
        return [bytes(data[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]


def encoder(path: str, keep: int = 250_000) -> TextEncoder:
    """One per Python worker and file."""
    return worker_cache(path, lambda: TextEncoder(path, keep))
