"""Whole-text encoding with a tokenizers-library file, remembering what each piece of text gives.

The tokenizer's normaliser and splitter never join text across white space, nor a letter or digit with the marks at
the end of a word, and A-Z are lowered anyway. So a text's ids are its pieces' ids in a row, where pieces are words
without and with their closing marks. Pieces are found, hashed and looked up a megabyte at a time in arrays; only
pieces that a worker has not seen go to the library, many at a time: letters-only ones joined by spaces, where
exactly one id of each carries the word-end mark, all others one by one. A text that holds an added token's content
in any case goes to the library whole, as those are found before the text is normalised.
"""

from __future__ import annotations

import json
import os

import numpy as np

from tessera.llm.common import TO_LOWER, Chunk, span_hash, words

IS_TAIL = np.zeros(256, bool)
IS_TAIL[list(b".,;:!?*&$%#|()\"+=~/\\[]{}<>@^-")] = True
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True


class Memory:
    """128-bit piece hash (key and check) -> ids, in arrays with open addressing. Forgets all when it is half full."""

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.clear(0)

    def clear(self, needed: int) -> None:
        while needed > 1 << self.bits - 1:  # one text with more pieces than that
            self.bits += 1
        self.most = 1 << self.bits - 1
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.checks = np.zeros(1 << self.bits, np.uint64)
        self.at = np.zeros(1 << self.bits, np.uint32)
        self.starts, self.counts = np.zeros(1, np.int64), np.zeros(1, np.int32)
        self.ids, self.length = np.zeros(1 << 12, np.uint16), 0
        self.used = 0

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Entry number of each key, or -1."""
        mask = np.uint64((1 << self.bits) - 1)
        slot = keys & mask
        got = self.keys[slot]
        hit = (got == keys) & (self.checks[slot] == checks)
        out = np.where(hit, self.at[slot].astype(np.int64), -1)
        more = np.flatnonzero(~hit & (got != 0))
        while len(more):
            slot[more] = (slot[more] + np.uint64(1)) & mask
            got = self.keys[slot[more]]
            hit = (got == keys[more]) & (self.checks[slot[more]] == checks[more])
            out[more[hit]] = self.at[slot[more[hit]]]
            more = more[~hit & (got != 0)]
        return out

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """New keys, each once, with the concatenation of their ids."""
        first = len(self.starts)
        self.starts = np.concatenate([self.starts, self.length + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts.astype(np.int32)])
        until = self.length + len(ids)
        wide = self.ids.dtype == np.uint32 or (len(ids) and ids.max() > 65535)
        if until > len(self.ids) or wide and self.ids.dtype != np.uint32:
            room = np.zeros(max(until * 3 // 2, len(self.ids)), np.uint32 if wide else np.uint16)
            room[: self.length] = self.ids[: self.length]
            self.ids = room
        self.ids[self.length : until] = ids
        self.length = until
        mask = np.uint64((1 << self.bits) - 1)
        slot, left = keys & mask, np.arange(len(keys))
        while len(left):
            where = slot[left]
            free = self.keys[where] == 0
            mine, at = left[free], where[free]
            self.keys[at] = keys[mine]
            won = self.keys[at] == keys[mine]
            self.at[at[won]] = first + mine[won]
            self.checks[at[won]] = checks[mine[won]]
            left = np.concatenate([left[~free], mine[~won]])
            slot[left] = (slot[left] + np.uint64(1)) & mask
        self.used += len(keys)


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path) as f:
            j = json.load(f)
        vocab, suffix = j["model"]["vocab"], j["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(max(vocab.values()) + 1 + len(j["added_tokens"]), bool)
        kinds = j["pre_tokenizer"].get("pretokenizers", [{}])
        lowers = "Lowercase" in json.dumps(j["normalizer"])
        #: Whether texts may be taken apart as described above; else they go to the library whole.
        self.pieced = bool(suffix) and lowers and kinds[0].get("behavior") == "Removed"
        if self.pieced:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
            # The same vocabulary and merges without normaliser and splitter, for what is in normal form and split already.
            self.bare = Tokenizer.from_str(json.dumps(j | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}))
        self.marks = [t["content"].encode().translate(TO_LOWER.tobytes()) for t in j["added_tokens"]]
        self.memory = Memory()

    def _whole(self, piece: str) -> list[int]:
        return self.lib.encode(piece, add_special_tokens=False).ids

    def _joined(self, pieces: list[str], lib) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], []
        for k in range(0, len(pieces), 4000):
            part = pieces[k : k + 4000]
            (got,) = lib.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            got = np.asarray(got.ids, np.uint32)
            stops = np.flatnonzero(self.ends[got]) + 1
            if len(stops) == len(part):
                ids.append(got)
                counts.append(np.diff(stops, prepend=0))
            else:  # some piece is not one word to the splitter
                each = [self._whole(p) for p in part]
                ids.append(np.array([i for e in each for i in e], np.uint32))
                counts.append(np.array([len(e) for e in each]))
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _learn(self, keys: np.ndarray, checks: np.ndarray, pieces: list[bytes]) -> None:
        text = [p.decode("utf-8", "replace") for p in pieces]
        alpha = np.fromiter(map(str.isalpha, text), bool, len(text))
        plain = alpha & np.fromiter(map(str.isascii, text), bool, len(text))
        for chosen, lib in ((plain, self.bare), (alpha & ~plain, self.lib)):
            at = np.flatnonzero(chosen)
            self.memory.add(keys[at], checks[at], *self._joined([text[i] for i in at.tolist()], lib))
        at = np.flatnonzero(~alpha)
        each = [self._whole(text[i]) for i in at.tolist()]
        self.memory.add(keys[at], checks[at], np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each], np.int64))

    def encode(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a chunk (uint32) and their row offsets."""
        if not self.pieced:
            each = [e.ids for e in self.lib.encode_batch_fast(c.texts(), add_special_tokens=False)]
            return np.array([i for e in each for i in e], np.uint32), np.r_[0, np.cumsum([len(e) for e in each])].astype(np.int64)
        raw = TO_LOWER[c.data].tobytes()
        if not any(m in raw for m in self.marks):
            return self._pieces(c)
        o = c.offs.tolist()
        held = [i for i in range(len(c)) if any(m in raw[o[i] : o[i + 1]] for m in self.marks)]
        size = np.diff(c.offs)
        whole = [self._whole(c.data[o[i] : o[i + 1]].tobytes().decode("utf-8", "replace")) for i in held]
        others = np.ones(len(c), bool)
        others[held] = False
        ids, offs = self._pieces(Chunk(c.ids, c.data[np.repeat(others, size)], np.r_[0, np.cumsum(size * others)]))
        more = np.zeros(len(c), np.int64)
        more[held] = [len(w) for w in whole]
        ids = np.insert(ids, np.repeat(offs[:-1], more), np.array([i for w in whole for i in w], np.uint32))
        return ids, offs + np.r_[0, np.cumsum(more)]

    def _pieces(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        data = TO_LOWER[c.data]
        start, end, row = words(data, c.offs)
        n = len(start)
        # closing marks: from behind the last byte of the word that is none of them
        other = np.where(IS_TAIL[data], -1, np.arange(len(data)))
        np.maximum.accumulate(other, out=other)
        mid = np.maximum(other[end - 1] + 1, start) if n else start
        last = data[np.maximum(mid - 1, 0)] if n else data[:0]
        two = data[np.maximum(mid - 2, 0)] if n else data[:0]
        latin = (two == 0xC3) & (last >= 0xA0) & (last != 0xB7) & (mid - start >= 2)  # e.g. e with acute
        cut = (mid > start) & (mid < end) & (IS_ALNUM[last] | latin)
        mid = np.where(cut, mid, end)
        place = np.arange(n) + np.cumsum(cut) - cut
        total = n + int(cut.sum())
        s, e = np.empty(total, np.int64), np.empty(total, np.int64)
        s[place], e[place] = start, mid
        s[place[cut] + 1], e[place[cut] + 1] = mid[cut], end[cut]
        key, check = span_hash(data, s, e, 2)
        key[key == 0] = 1
        entry = self.memory.find(key, check)
        new = np.flatnonzero(entry < 0)
        if len(new) and self.memory.used + len(new) > self.memory.most:
            new = np.arange(total)
            self.memory.clear(total)
        raw = data.tobytes() if len(new) else b""
        while len(new):  # more than once only if two pieces agree in the key and not in the check
            u, first = np.unique(key[new], return_index=True)
            pick = new[first]
            self._learn(u, check[pick], [raw[a:b] for a, b in zip(s[pick].tolist(), e[pick].tolist())])
            entry[new] = self.memory.find(key[new], check[new])
            new = new[entry[new] < 0]
        count = self.memory.counts[entry].astype(np.int64)
        done = np.cumsum(count)
        ids = self.memory.ids[np.arange(int(done[-1]) if total else 0) + np.repeat(self.memory.starts[entry] - (done - count), count)]
        pieces = np.bincount(row, minlength=len(c)) + np.bincount(row[cut], minlength=len(c))
        return ids.astype(np.uint32), np.r_[0, done][np.r_[0, np.cumsum(pieces)].astype(np.int64)]

    def encode_with_end(self, c: Chunk, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        ids, offs = self.encode(c)
        if end_id is None:
            return ids, offs
        out = np.full(len(ids) + len(c), end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(c)), np.diff(offs))] = ids
        return out, offs + np.arange(len(offs))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
