"""Whole texts to token ids with the tokenizers library, quickly.

Two kinds of tokenizer file are known, byte-level ones and those that drop white space;
in both, a token never spans a single space or line end between other characters (but for
the space that starts a token) nor the place where a letter meets an ASCII mark. So the ids
of a text are those of its chunks between such places, and chunks repeat. Batches are cut
and their distinct chunks found in Arrow; each Python worker keeps the ids of chunks it has
seen, in two generations of ``MEMORY`` bytes (a full young one becomes the old one, and what
is used again moves back), and sends only new ones to the library, many in one string,
parted by a control character whose id marks where one ends.

Texts in which a space stands next to other white space, where that makes tokens, or that
hold the literal of an added token or a control character used here are encoded whole by
the library, and so is every text with a tokenizer file of another kind.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MARK, _CUT = "\x01", "\x02"
#: White space in any of the libraries' senses, as the inside of a character class.
_WHITE = "\\s\x0b\x1c-\x1f\x85\u00a0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Long-known letters that stay letters in lower case (a capital I with a dot does not), and ASCII marks.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f"
_MEET = rf"([{_LETTER}])([!-/:-@\[-`{{-~])"
_LINE_END = rf"([^{_WHITE}])\n([^{_WHITE}])"
_BLANKS = rf"[{_WHITE}] | [{_WHITE}]"
#: Fixed value: the pattern of words of the tokenizer that drops white space.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MEMORY = 48 << 20  # bytes of one generation of chunks, by estimate
_ENTRY = 190  # bytes of a chunk in memory besides its characters and ids
_JOIN = 100_000  # characters encoded in one call


def _kind(file: dict) -> str | None:
    """"byte" or "word" if the file cuts texts as stated above."""
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]):
        return None
    normal, pre = file["normalizer"], file["pre_tokenizer"] or {}
    if normal is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
        return "byte"
    steps = pre.get("pretokenizers") or [{}]
    split = steps[0].get("type") == "Split" and steps[0]["pattern"] == {"Regex": _WORDS} and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
    plain = all(s["type"] == "ByteLevel" and not s["use_regex"] and not s["add_prefix_space"] for s in steps[1:])
    usual = {"NFC", "Replace", "Lowercase"}
    if split and plain and normal and {n["type"] for n in normal.get("normalizers", [normal])} <= usual:
        return "word"
    return None


class _Generation:
    """Chunks and their ids, which lie one after another."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.bytes = 0

    def add(self, chunks: list[str], size: np.ndarray, ids: np.ndarray) -> None:
        self.at.update(zip(chunks, range(len(self.at), len(self.at) + len(chunks)), strict=True))
        self.begin = np.concatenate((self.begin, np.cumsum(size) - size + len(self.ids)))
        self.size = np.concatenate((self.size, size))
        self.ids = np.concatenate((self.ids, ids))
        self.bytes += _ENTRY * len(chunks) + sum(map(len, chunks)) + 4 * len(ids)

    def get(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(size, ids) of chunks that it has, in order."""
        at = np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))
        return self.size[at], self.ids[_spans(self.begin[at], self.size[at])]


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each span, one after another."""
    stop = np.cumsum(size)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - stop + size, size)


class ChunkEncoder:
    """Encodes texts with one tokenizer file, as the library does by default without special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        file = json.loads(self.tok.to_str())
        self.kind = _kind(file)
        self.literals = [t["content"] for t in file["added_tokens"]]
        self.mark, self.newline = self.raw(_MARK), self.raw("\n")
        self.young, self.old = _Generation(), _Generation()

    def raw(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _learn(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(chunk, size, ids) of new chunks, in an order of its own.

        Each follows a mark; where white space counts, one without a leading space follows a newline too.
        """
        if self.kind == "word":
            groups, alone = [(chunks, " ", " ", 0)], []
        else:
            spaced, bare, alone = [], [], []
            for c in chunks:
                if not c or c[-1].isspace() or c[0] != " " and c[0].isspace() or c[0] == " " and c[1].isspace():
                    alone.append(c)
                else:
                    (spaced if c[0] == " " else bare).append(c)
            groups = [(spaced, "", "", 0), (bare, "\n", "", len(self.newline))]
        order, sizes, found = [], [], []
        for group, lead, gap, skip in groups:
            ends = np.cumsum([len(c) + 2 for c in group]) // _JOIN
            cuts = [0, *(np.nonzero(np.diff(ends))[0] + 1).tolist(), len(group)]
            parts = [group[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
            joint = [_MARK + lead + (gap + _MARK + lead).join(p) for p in parts]
            for part, e in zip(parts, self.tok.encode_batch_fast(joint, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                at = np.nonzero(ids == self.mark[0])[0]
                if len(self.mark) != 1 or len(at) != len(part):  # cannot tell them apart: one by one
                    alone += part
                    continue
                keep = np.ones(len(ids), bool)
                keep[at] = False
                if skip:
                    keep[_spans(at + 1, np.full(len(at), skip))] = False
                order += part
                sizes.append(np.diff(np.append(at, len(ids))) - 1 - skip)
                found.append(ids[keep])
        each = [self.raw(c) for c in alone]
        sizes.append(np.array([len(x) for x in each], np.int64))
        found += [np.array(x, "<u4") for x in each]
        return order + alone, np.concatenate(sizes).astype(np.int64), np.concatenate([np.zeros(0, "<u4"), *found])

    def _lookup(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(size, ids) of distinct chunks, in order."""
        young, old = self.young, self.old
        new = [c for c in chunks if c not in young.at]
        if new and old.at:
            again = [c for c in new if c in old.at]
            young.add(again, *old.get(again))
            new = [c for c in new if c not in old.at]
        if new:
            young.add(*self._learn(new))
        out = young.get(chunks)
        if young.bytes > MEMORY:
            self.old, self.young = young, _Generation()
        return out

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts the library must see whole."""
        if self.kind is None:
            return np.ones(len(texts), bool)
        tests = [pc.match_substring(texts, x) for x in (_MARK, _CUT, *self.literals)]
        if self.kind == "byte":
            tests.append(pc.match_substring_regex(texts, _BLANKS))
        return np.any([np.asarray(x) for x in tests], axis=0)

    def _chunks(self, texts: pa.Array) -> pa.Array:
        """The lists of chunks of texts."""
        if self.kind == "word":
            lines = pc.replace_substring(texts, "\n", " ")
            return pc.split_pattern(pc.replace_substring_regex(lines, _MEET, r"\1 \2"), " ")
        lines = pc.replace_substring_regex(texts, _LINE_END, f"\\1{_CUT}\n{_CUT}\\2")
        words = pc.replace_substring_regex(lines, _MEET, rf"\1{_CUT}\2")
        return pc.split_pattern(pc.replace_substring(words, " ", f"{_CUT} "), _CUT)

    def encode_flat(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, edges of each) of strings (NULL: empty), each followed by ``end_id`` if given."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = self._whole(texts)
        lists = self._chunks(texts.filter(pa.array(~whole)))
        offsets = np.asarray(lists.offsets)
        coded = lists.flatten().dictionary_encode()
        index = np.asarray(coded.indices).astype(np.int64)
        size, ids = self._lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        begin, n = (np.cumsum(size) - size)[index], size[index]
        usual = ids[_spans(begin, n)]
        edges = np.concatenate(([0], np.cumsum(n)))[offsets - offsets[0]]
        odd = [np.array(self.raw(t), "<u4") for t in texts.filter(pa.array(whole)).to_pylist()]
        length = np.zeros(len(texts), np.int64)
        length[~whole], length[whole] = np.diff(edges), [len(x) for x in odd]
        extra = 0 if end_id is None else 1
        stop = np.cumsum(length + extra)
        out = np.full(int(stop[-1]) if len(stop) else 0, end_id or 0, "<u4")
        start = stop - length - extra
        out[_spans(start[~whole], length[~whole])] = usual
        for a, x in zip(start[whole].tolist(), odd, strict=True):
            out[a : a + len(x)] = x
        return out, np.concatenate(([0], stop))

    def encode(self, texts: list[str | None], end_id: int | None = None) -> list[np.ndarray]:
        """Ids of whole texts (None: empty) as uint32, each followed by ``end_id`` if given."""
        ids, edges = self.encode_flat(pa.array(texts, pa.large_string()), end_id)
        return np.split(ids, edges[1:-1]) if len(texts) else []


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def runs_of(texts: pa.Array, limit: int = 4 << 20):
    """(start, end) of consecutive runs of texts of at most ``limit`` bytes, or one text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    a = size = 0
    for i, n in enumerate(sizes.tolist()):
        if i > a and size + n > limit:
            yield a, i
            a, size = i, 0
        size += n
    if len(sizes):
        yield a, len(sizes)


def batches_of(texts, limit: int = 8_000_000):
    """Consecutive runs (start, list of texts) of at most ``limit`` characters, or one text."""
    run, size, start = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if run and size + n > limit:
            yield start, run
            run, size, start = [], 0, i
        run.append(t)
        size += n
    if run:
        yield start, run
