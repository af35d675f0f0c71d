"""Public tokenizers over bytes of text, one per Python worker.

Vocabulary files are parameters (paths) and never part of this package.
"""

from __future__ import annotations

import base64
import json
import os
import re
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class MergeTable:
    """Byte-pair merges applied to many words at once, as columns of symbols.

    In every step each unfinished word makes its own next merge: the least rank, of equals
    the leftmost, as the sequential algorithm does, so the ids are the same.
    """

    _NONE = np.int32(1 << 30)
    #: Longer words are left to the tokenizer.
    LONGEST = 64
    #: Words of these lengths are merged together, the shorter ones padded.
    _GROUPS = (0, 2, 5, 8, 10, 13, 20, LONGEST)
    _BITS = 17

    def __init__(self, vocab: dict[str, int], merges: list, visible: dict[int, str], end: str) -> None:
        self.first = np.array([vocab[visible[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[visible[b] + end] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        codes = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.pad = 0xFFFF
        # hashed tables: pairs that meet another in one are in the next
        rank = np.arange(len(codes), dtype=np.int32)
        self.tables = []
        seed = 0x9E3779B1
        while len(codes):
            slot = self._slot(codes, np.uint32(seed))
            keep = np.unique(slot, return_index=True)[1]
            keys, ranks = np.full(1 << self._BITS, 0xFFFFFFFF, np.uint32), np.full(1 << self._BITS, self._NONE, np.int32)
            keys[slot[keep]], ranks[slot[keep]] = codes[keep], rank[keep]
            self.tables.append((np.uint32(seed), keys, ranks))
            rest = np.ones(len(codes), bool)
            rest[keep] = False
            codes, rank, seed = codes[rest], rank[rest], seed * 3 + 2 & 0xFFFFFFFF

    def _slot(self, code: np.ndarray, seed: np.uint32) -> np.ndarray:
        return code * seed >> np.uint32(32 - self._BITS)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a.astype(np.uint32)
        code <<= np.uint32(16)
        code |= b.astype(np.uint32)
        seed, keys, ranks = self.tables[0]
        slot = self._slot(code, seed)
        held = keys[slot]
        out = np.where(held == code, ranks[slot], self._NONE)
        other = np.flatnonzero((held != code) & (held != 0xFFFFFFFF))  # an empty slot: no such pair
        for seed, keys, ranks in self.tables[1:]:
            if not len(other):
                break
            own = code.ravel()[other]
            slot = self._slot(own, seed)
            held = keys[slot]
            out.ravel()[other] = np.where(held == own, ranks[slot], self._NONE)
            other = other[(held != own) & (held != 0xFFFFFFFF)]
        return out

    def encode(self, parts: list[bytes]) -> list[bytes]:
        """Packed little-endian ids of each part (1 to ``LONGEST`` bytes)."""
        out: list[bytes] = [b""] * len(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(sizes, kind="stable")
        at = np.searchsorted(sizes[order], np.array(self._GROUPS) + 1)
        for begin, end, n in zip(at, at[1:], self._GROUPS[1:]):
            for s in range(begin, end, 8192):
                own = order[s : min(s + 8192, end)]
                raw = np.frombuffer(b"".join([parts[i].ljust(n, b"\0") for i in own.tolist()]), np.uint8).reshape(-1, n).T
                place, size = np.arange(n)[:, None], sizes[own]
                x = np.where(place < size - 1, self.first[raw], np.where(place == size - 1, self.last[raw], self.pad)).astype(np.int32)
                self._merge(x, own, out)
        return out

    def _merge(self, x: np.ndarray, names: np.ndarray, out: list[bytes]) -> None:
        """``x``: [place, word] symbols; a word's ids go to its place in ``out``, which ``names`` has."""
        place = np.arange(len(x) + 1, dtype=np.int32)[:, None]
        best = self._ranks(x[:-1], x[1:])
        while True:
            key = (best << np.int32(6) | place[: len(best)]).min(0, initial=self._NONE, where=best < self._NONE)
            done = key == self._NONE
            if done.any():
                left = np.ascontiguousarray(x[:, done].T, "<u4")
                ends = (4 * (left != self.pad).sum(1)).tolist()
                raw, width = left.tobytes(), 4 * len(x)
                for i, s, e in zip(names[done].tolist(), range(0, len(raw), width), ends):
                    out[i] = raw[s : s + e]
                if done.all():
                    return
                live = np.flatnonzero(~done)
                x, best, key, names = x[:, live], best[:, live], key[live], names[live]
            rank, p = key >> 6, key & 63
            column = np.arange(x.shape[1])
            after = place[: len(x)] > p
            x = np.where(after[:-1], x[1:], x[:-1])
            x[p, column] = self.merged[rank]
            best = np.where(place[: len(best) - 1] >= p, best[1:], best[:-1])
            left = np.flatnonzero(p > 0)
            best[p[left] - 1, left] = self._ranks(x[p[left] - 1, left], x[p[left], left])
            right = np.flatnonzero(p < len(x) - 1)
            best[p[right], right] = self._ranks(x[p[right], right], x[p[right] + 1, right])


class WordBpe:
    """BPE with word ends, whose normaliser lower-cases and drops white space.

    No token spans white space, so ids of a text are those of its white-space separated
    words, which are encoded once each and remembered as packed little-endian 32-bit ids.
    New words of ASCII and the first Latin blocks are cut into letters, digits and others
    and merged many at a time; others go through the whole tokenizer, and so do whole
    texts that hold the string of a special token, which is one token there.
    """

    #: Words of a generation; the last two generations are remembered.
    REMEMBERED = 400_000
    #: New words merged at once.
    LEARNED = 16_384
    # upper case is folded before; U+0130, whose lower case is two characters, and white space beyond ASCII stay out
    _LATIN = re.compile("[\x00-\x7f\xa1-įı-ſ]+")
    _LETTERS, _DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xffĀ-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
    _PRE = re.compile(f"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\n{_LETTERS}{_DIGITS}]+")

    def __init__(self, file: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            whole = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.visible = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.merges = MergeTable(whole["model"]["vocab"], whole["model"]["merges"], self.visible, whole["model"]["end_of_word_suffix"])
        self.special = re.compile(b"|".join(re.escape(x["content"].encode()) for x in whole["added_tokens"]) or b"(?!)")
        self.words: dict[bytes, bytes] = {b" ": b""}
        self.before: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {"\n": b""}

    def _slow(self, texts: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def _learn(self, new: list[bytes]) -> None:
        """Remembers ``new`` words, without white space or special tokens; a slice of them is worked on at a time."""
        for s in range(0, len(new), self.LEARNED):
            self._learn_some(new[s : s + self.LEARNED])

    def _learn_some(self, new: list[bytes]) -> None:
        fast = [w for w in new if w.isascii()]
        others = [w for w in new if not w.isascii()]
        folded = [w.decode("utf-8", "replace") for w in others]
        latin = list(map(bool, map(self._LATIN.fullmatch, folded)))
        beyond = [w for w, ok in zip(others, latin) if not ok]
        folded = ["\n".join(compress(folded, latin)), b"\n".join(fast).decode()]
        fast = [*compress(others, latin), *fast]
        if fast:
            cut = self._PRE.findall("\n".join(filter(None, folded)).lower())
            cut.append("\n")
            known = self.parts
            lack = [p for p in set(cut) if p not in known]
            raw = [p.encode() for p in lack]
            short = [i for i, b in enumerate(raw) if len(b) <= self.merges.LONGEST]
            known.update(zip([lack[i] for i in short], self.merges.encode([raw[i] for i in short])))
            if len(short) < len(lack):
                long = [b for b in raw if len(b) > self.merges.LONGEST]
                ids = [[t.id for t in self.tokenizer.model.tokenize(b.decode("latin-1").translate(self.visible))] for b in long]
                known.update((b.decode(), np.array(x, "<u4").tobytes()) for b, x in zip(long, ids))
            got = list(map(known.__getitem__, cut))
            s = 0
            for w in fast:
                e = cut.index("\n", s)
                self.words[w] = got[s] if e == s + 1 else b"".join(got[s:e])
                s = e + 1
        for s in range(0, len(beyond), 1000):
            some = beyond[s : s + 1000]
            self.words.update(zip(some, self._slow(some)))

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        got = list(map(self.words.get, words))
        if None not in got:
            return got
        new = [w for w, g in zip(words, got) if g is None]
        if len(self.words) + len(new) > self.REMEMBERED:
            self.before, self.words, new = self.words, {b" ": b""}, words
            self.parts = {"\n": b""} if len(self.parts) > self.REMEMBERED else self.parts
        was = self.before.get
        again = [(w, g) for w in new if (g := was(w)) is not None]
        self.words.update(again)
        if len(again) < len(new):
            self._learn([w for w in new if was(w) is None])
        return list(map(self.words.__getitem__, words))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        special = [i for i, t in enumerate(texts) if b"<|" in t and self.special.search(t)]
        if special:
            out = self._encode([b"" if self.special.search(t) else t for t in texts])
            for i, ids in zip(special, self._slow([texts[i] for i in special])):
                out[i] = ids
            return out
        return self._encode(texts)

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        column = pa.array([t.lower() for t in texts], pa.large_binary())
        split = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(column), column.buffers()))
        coded = split.values.dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        if b"" in words:  # before and after white space
            words[words.index(b"")] = b" "
        got = self._look_up(words)
        flat = np.frombuffer(b"".join(got), "<u4")
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        index = coded.indices.to_numpy()
        n = sizes[index]
        ends = np.cumsum(n)
        shift = (np.cumsum(sizes) - sizes)[index] - (ends - n)
        ids = flat[np.repeat(shift, n) + np.arange(len(shift) and ends[-1])].tobytes()
        at = np.append(0, 4 * ends)[split.offsets.to_numpy()].tolist()
        return [ids[s:e] for s, e in zip(at, at[1:])]


class ByteBpe:
    """Lossless byte-level BPE: the bytes of the ids' tokens, joined, are the text."""

    #: The engine's pattern backtracks through white space; longer runs are taken out of the text and encoded alone.
    LONGEST = 10_000
    _SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    _RUN = re.compile(f"[{_SPACE}]{{{LONGEST},}}")

    def __init__(self, file: str) -> None:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = len(ranks)
        self.token_bytes = [b""] * (len(ranks) + 1)
        for b, i in ranks.items():
            self.token_bytes[i] = b
        self.sizes = np.array([len(b) for b in self.token_bytes], np.int64)

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of the whole text.

        A run of white space is one part of the pattern up to its last character, or to the
        text's end; cutting between parts leaves all other parts as they are.
        """
        s = text.decode("utf-8", "replace")
        out, at = [], 0
        for run in self._RUN.finditer(s) if len(s) > self.LONGEST else ():
            end = run.end() - (run.end() < len(s))
            out += [self.encoding.encode_to_numpy(s[at : run.start()], disallowed_special=()), np.array(self.encoding._encode_single_piece(s[run.start() : end]), np.uint32)]
            at = end
        rest = self.encoding.encode_to_numpy(s[at:], disallowed_special=())
        return np.concatenate([*out, rest]) if out else rest

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.token_bytes[i] for i in ids.tolist())


@lru_cache(4)
def word_bpe(file: str) -> WordBpe:
    return WordBpe(file)


@lru_cache(4)
def byte_bpe(file: str) -> ByteBpe:
    return ByteBpe(file)


