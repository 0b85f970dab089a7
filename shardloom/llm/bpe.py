"""Exact byte-level BPE by dynamic programming over prefixes.

For every prefix of a pretoken there is exactly one token that ends its encoding. The codec reads a
pretoken byte by byte through an automaton over the vocabulary, whose state names the longest token
that is a suffix of the prefix; shorter ones follow by suffix links. The first of them that may stand
after the last token of the prefix before it is the last token of this prefix. Back-pointers then
give the ids, and a count kept beside them gives the number of tokens of each prefix.

Two tokens may stand side by side if no merge across their border would have happened before the
merges that built them (`BpeTables.fits`).

Many distinct pretokens are encoded at once with numpy, position by position; long ones, of which
there are few, byte by byte. Results are kept for each pretoken in a map of bounded size.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata

import numpy as np
import regex

#: Fixed value: the pretoken pattern of this tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_FULL = regex.compile(PATTERN)
#: The same classes in the faster standard module, right for texts in which _ODD finds nothing.
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_ODD = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]|[^\x00-ɏ]")

_MEET = re.compile(r"\s\s")

LONG = 64  # bytes; longer pretokens go byte by byte
CACHE = 60_000  # pretokens, and runs between spaces, kept by a codec
MEMO_BITS = 19  # of the map of pairs already tested
NEVER = np.int32(2**31 - 1)


def _find(text: str) -> list[str]:
    """Pretokens of a text without special tokens.

    Characters younger than the Unicode tables of this Python are no letters or digits to the tokenizer,
    but are to the regex module; while it looks, a character for private use stands for them.
    """
    if not _ODD.search(text):
        return _LATIN.findall(text)
    young = {ord(c): "\ue000" for c in set(text) if c > "ɏ" and unicodedata.category(c) == "Cn"}
    if not young:
        return _FULL.findall(text)
    ends = list(itertools.accumulate(map(len, _FULL.findall(text.translate(young)))))
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class IntMap:
    """Open-addressed map from non-negative int64 keys to int32, looked up for whole arrays."""

    def __init__(self, keys, values):
        keys = np.asarray(keys, np.int64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        values = np.asarray(values, np.int32)
        while len(todo):
            free = self.keys[slot[todo]] == -1
            at, first = np.unique(slot[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[at], self.values[at] = keys[put], values[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            taken = self.keys[slot[todo]] != keys[todo]
            slot[todo[taken]] = (slot[todo[taken]] + 1) & (size - 1)

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys):
        """The value of each key, -1 where there is none."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(-1))
        todo = np.flatnonzero((found != keys) & (found != -1))
        mask = len(self.keys) - 1
        while len(todo):
            slot_t = (slot[todo] + 1) & mask
            slot[todo] = slot_t
            found = self.keys[slot_t]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot_t[hit]]
            todo = todo[~hit & (found != -1)]
        return out


def byte_alphabet() -> dict[str, int]:
    """Character of the vocabulary file for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeTables:
    """Vocabulary, merge tree and suffix automaton as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.bytes_of[i] = text.encode() if text in self.special else bytes(alphabet[c] for c in text)
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.length = np.array([len(b) for b in self.bytes_of], np.int32)
        self.left, self.right, self.rank = (np.full(size, -1, np.int32) for _ in range(3))
        keys, made = [], set()
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocab[a + b]
            if whole in made:
                raise ValueError("two merges make the same token; this codec needs one")
            made.add(whole)
            self.left[whole], self.right[whole], self.rank[whole] = vocab[a], vocab[b], rank
            keys.append(vocab[a] << 20 | vocab[b])
        self.pairs = IntMap(keys, np.arange(len(keys)))
        self._automaton(sorted(made | {vocab[c] for c in alphabet}))

    def _automaton(self, tokens: list[int]) -> None:
        edges: dict[int, int] = {}
        token_at, depth_of, parent = [-1], [0], [(0, 0)]
        node_of = {}
        for t in tokens:
            node = 0
            for byte in self.bytes_of[t]:
                key = node << 8 | byte
                nxt = edges.get(key)
                if nxt is None:
                    nxt = edges[key] = len(token_at)
                    token_at.append(-1)
                    depth_of.append(depth_of[node] + 1)
                    parent.append((node, byte))
                node = nxt
            token_at[node] = t
            node_of[t] = node
        link, out = [0] * len(token_at), token_at[:]
        for node in sorted(range(1, len(token_at)), key=depth_of.__getitem__):
            up, byte = parent[node]
            if up:
                f = link[up]
                while f and (f << 8 | byte) not in edges:
                    f = link[f]
                link[node] = edges.get(f << 8 | byte, 0)
            if out[node] < 0:
                out[node] = out[link[node]]
        self.shorter = np.full(len(self.bytes_of), -1, np.int32)
        for t, node in node_of.items():
            self.shorter[t] = out[link[node]]
        self.longest = np.array(out, np.int32)
        # every transition, level by level: a state's own edges over those of its suffix link; a state
        # without edges of its own shares the row of its link. A row is 16 numbers of blocks of 16 transitions, and
        # shares with its link's row the blocks in which it has no edge: all transitions at once take six times as much
        depth, links = np.array(depth_of), np.array(link)
        key, nxt = np.array(list(edges), np.int64), np.array(list(edges.values()), np.int32)
        inner = np.zeros(len(link), bool)
        inner[0] = True
        inner[key >> 8] = True
        row = np.cumsum(inner) - 1
        part, goto, used = np.zeros((int(inner.sum()), 16), np.int32), np.zeros((len(key) + 1, 16), np.int32), 1
        for d in range(depth.max() + 1):
            at = np.flatnonzero((depth == d) & inner)
            if d:
                leaf = np.flatnonzero((depth == d) & ~inner)
                row[leaf] = row[links[leaf]]
                part[row[at]] = part[row[links[at]]]
            own = np.flatnonzero(depth[key >> 8] == d)
            of, byte = row[key[own] >> 8], key[own] & 255
            changed, which = np.unique(of * 16 + (byte >> 4), return_inverse=True)
            goto[used : used + len(changed)] = goto[part[changed >> 4, changed & 15]]
            part[changed >> 4, changed & 15] = np.arange(used, used + len(changed))
            goto[used + which, byte & 15] = nxt[own]
            used += len(changed)
        self.goto, self.part, self.row = goto[:used].flatten(), (part * 16).reshape(-1), (row * 16).astype(np.int32)
        self.memo_key = np.full(1 << MEMO_BITS, -1, np.int64)
        self.memo_fit = np.zeros(1 << MEMO_BITS, bool)

    def step(self, state, byte):
        """The state after a byte, for numbers or arrays of them."""
        return self.goto[self.part[self.row[state] + (byte >> 4)] + (byte & 15)]

    def fits(self, a, b):
        """Whether token b may follow token a, for arrays of pairs.

        The later of the two border pieces' merges is undone, again and again; if the pieces that then
        face each other have a merge that comes before the one just undone, the pair can't stand. Among
        merges of one rank the left one comes first, so an undone right piece loses a tie, a left one wins it.
        """
        key = a.astype(np.int64) << 20 | b
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - MEMO_BITS)).view(np.int64)
        out = self.memo_fit[slot]
        miss = np.flatnonzero(self.memo_key[slot] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            out[miss] = self._fits(new >> 20, new & 0xFFFFF)[back]
            # one after the other, so that key and answer of a slot always belong together
            _, first = np.unique(slot[miss], return_index=True)
            put = miss[first]
            self.memo_key[slot[put]], self.memo_fit[slot[put]] = key[put], out[put]
        return out

    def _fits(self, a, b):
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        before = np.full(len(a), NEVER, np.int32)
        while len(at):
            merge = self.pairs.get(a << 20 | b)
            bad = (merge >= 0) & (merge < before)
            ok[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & (np.maximum(ra, rb) >= 0)
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            left = ra > rb
            before = np.where(left, ra, rb + 1).astype(np.int32)
            a, b = np.where(left, self.right[a], a).astype(np.int64), np.where(left, b, self.left[b]).astype(np.int64)
        return ok


class BpeCodec:
    """Encodes, decodes and counts whole texts with one vocabulary file."""

    def __init__(self, path: str):
        self.t = BpeTables(path)
        self.special = regex.compile("|".join(map(regex.escape, self.t.special))) if self.t.special else None
        self._first = next(iter(self.t.special), None)
        self._ids: dict[str, bytes] = {}
        self._runs: dict[str, bytes] = {}
        self._ends: dict[str, int] = {}
        self._stored = np.zeros(0, np.int32)
        self._totals: dict[str, int] = {}
        self._fit_memo: dict[tuple[int, int], bool] = {}
        self.decimal = [str(i) for i in range(len(self.t.bytes_of))]

    # -- pretokens ---------------------------------------------------------------------------------

    def pretokens(self, text: str) -> list[str]:
        """The pieces that are encoded by themselves; a special token's text is one piece."""
        if self._first is None or not self.special.search(text):
            return _find(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += _find(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + _find(text[at:])

    # -- dynamic programming -----------------------------------------------------------------------

    def _many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Last token and token count of every prefix: arrays [position, word] for words in falling order of length."""
        t, n = self.t, len(words)
        lens = np.array([len(w) for w in words], np.int32)
        top = int(lens[0])
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.concatenate(([0], np.cumsum(lens[:-1], dtype=np.int64)))
        last, count = np.full((top + 1, n), -1, np.int32), np.zeros((top + 1, n), np.int32)
        state = np.zeros(n, np.int32)
        alive = np.searchsorted(-lens, -np.arange(1, top + 1), side="right")
        for j in range(1, top + 1):
            k = int(alive[j - 1])
            state[:k] = t.step(state[:k], flat[starts[:k] + (j - 1)])
            at, cand = np.arange(k), t.longest[state[:k]]
            while len(at):
                back = j - t.length[cand]
                ok = back == 0
                ask = np.flatnonzero(~ok)
                ok[ask] = t.fits(last[back[ask], at[ask]], cand[ask])
                good = at[ok]
                last[j, good], count[j, good] = cand[ok], count[back[ok], good] + 1
                at, cand = at[~ok], t.shorter[cand[~ok]]
        return last, count

    def _long(self, word: bytes) -> tuple[list[int], list[int]]:
        """The same for one word."""
        t, memo = self.t, self._fit_memo
        last, count = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        if len(memo) > CACHE:
            memo.clear()
        s = 0
        for j, byte in enumerate(word, 1):
            s = int(t.step(s, byte))
            cand = int(t.longest[s])
            while True:
                back = j - int(t.length[cand])
                if back == 0:
                    break
                pair = (last[back], cand)
                ok = memo.get(pair)
                if ok is None:
                    ok = memo[pair] = bool(t.fits(np.array([pair[0]]), np.array([cand]))[0])
                if ok:
                    break
                cand = int(t.shorter[cand])
            last[j], count[j] = cand, count[back] + 1
        return last, count

    def prefix_counts(self, word: bytes) -> np.ndarray:
        """Tokens of word[:j] for j = 0 ... len(word), for one pretoken."""
        return np.array(self._long(word)[1], np.int32)

    def _store(self, pieces: list[str]) -> None:
        """Puts the tokens of every prefix of these pretokens, from 0 bytes to all, one after the other in one array.

        `_ends` has the place of each one's last count. An array that is outgrown isn't written to any more.
        """
        new = set(pieces).difference(self._ends)
        if len(self._ends) + len(new) > CACHE:
            self._ends.clear()
            self._stored = np.zeros(0, np.int32)
            new = set(pieces)
        if not new:
            return
        words = list(new)
        coded = [w.encode() for w in words]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        order = np.argsort(-size, kind="stable")
        n_long = int((size > LONG).sum())
        held = [self._stored]
        for i in order[:n_long].tolist():
            held.append(np.array(self._long(coded[i])[1], np.int32))
        for a in range(n_long, len(order), 20_000):
            part = order[a : a + 20_000]
            _, count = self._many([coded[i] for i in part.tolist()])
            held.append(count.T[np.arange(len(count)) <= size[part][:, None]])
        ends = len(self._stored) - 1 + np.cumsum(size[order] + 1)
        self._stored = np.concatenate(held)
        self._ends.update(zip([words[i] for i in order.tolist()], ends.tolist(), strict=True))
        for s in new.intersection(self.t.special):
            self._stored[self._ends[s] - len(s.encode()) + 1 : self._ends[s] + 1] = 1

    def prefix_counts_of(self, pieces: list[str]) -> list[np.ndarray]:
        """For each pretoken the tokens of its every prefix, from 0 bytes to all: stored, so that nothing is run twice."""
        self._store(pieces)
        return [self._stored[self._ends[p] - len(p.encode()) : self._ends[p] + 1] for p in pieces]

    def _totals_of(self, lists: list[list[str]]) -> list[int]:
        """The last prefix counts of each list's pretokens, added up."""
        flat = list(itertools.chain.from_iterable(lists))
        self._store(flat)
        last = self._stored[np.fromiter(map(self._ends.__getitem__, flat), np.int64, len(flat))]
        up = np.concatenate((np.zeros(1, np.int64), np.cumsum(last, dtype=np.int64)))
        ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        return np.diff(up[ends], prepend=0).tolist()

    def _encode_new(self, words: list[str]) -> None:
        """Puts the ids of these pretokens (as little-endian uint32 bytes) in the map."""
        coded = [w.encode() for w in words]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        order = np.argsort(-size, kind="stable")
        n_long = int((size > LONG).sum())
        for i in order[:n_long].tolist():
            last, _ = self._long(coded[i])
            ids, j = [], len(coded[i])
            while j:
                ids.append(last[j])
                j -= int(self.t.length[last[j]])
            self._ids[words[i]] = np.array(ids[::-1], "<u4").tobytes()
        short = order[n_long:].tolist()
        for a in range(0, len(short), 20_000):
            part = short[a : a + 20_000]
            last, count = self._many([coded[i] for i in part])
            pos = size[part]
            n = count[pos, np.arange(len(part))].astype(np.int64)
            end = np.cumsum(n)
            ids, put, at = np.empty(int(end[-1]), "<u4"), end - 1, np.arange(len(part))
            while len(at):
                tok = last[pos, at]
                ids[put] = tok
                pos = pos - self.t.length[tok]
                more = pos > 0
                at, pos, put = at[more], pos[more], put[more] - 1
            raw, begin = ids.tobytes(), ((end - n) * 4).tolist()
            for i, b, e in zip(part, begin, (end * 4).tolist(), strict=True):
                self._ids[words[i]] = raw[b:e]

    def prepare(self, pieces: list[str]) -> None:
        new = set(pieces).difference(self._ids)
        if len(self._ids) + len(new) > CACHE:
            self._ids.clear()
            new = set(pieces)
        for s in [s for s in self.t.special if s in new]:
            self._ids[s] = np.array([self.t.special[s]], "<u4").tobytes()
            new.discard(s)
        if new:
            self._encode_new(list(new))

    # -- whole texts -------------------------------------------------------------------------------

    def encode_raw(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes; null counts as empty.

        A text in which no two white-space characters meet falls apart at its spaces: each space begins a
        run whose pretokens don't depend on what stands before or after. Ids are kept for such runs too.
        """
        out: list[bytes] = []
        runs = self._runs
        for block in blocks(texts):
            parts = [self._split(x) if x else [] for x in block]
            new = set(itertools.chain.from_iterable(parts)).difference(runs)
            if len(runs) + len(new) > CACHE:
                runs.clear()
                new = set(itertools.chain.from_iterable(parts))
            new = [r for r in new if r not in self.t.special]
            pieces = list(map(_find if _ODD.search("".join(new)) else _LATIN.findall, new))
            self.prepare(list(itertools.chain.from_iterable(pieces)))
            get = self._ids.__getitem__
            runs.update(zip(new, [get(p[0]) if len(p) == 1 else b"".join(map(get, p)) for p in pieces], strict=True))
            runs.update((k, np.array([v], "<u4").tobytes()) for k, v in self.t.special.items())
            get = runs.__getitem__
            out += [b"".join(map(get, p)) for p in parts]
        return out

    def _split(self, text: str) -> list[str]:
        if _MEET.search(text) or self._first is not None and self.special.search(text):
            return self.pretokens(text)
        head, *rest = text.split(" ")
        return ([head] if head else []) + [" " + r for r in rest]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_raw([text])[0], "<u4").tolist()

    def decode(self, ids) -> str:
        """The text of ids, special ones included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.t.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text: the last prefix counts of its pretokens, added up.

        For texts beyond Latin letters, whose pretokens take longer to find, sums are kept for runs, as ids are.
        """
        out, totals = [], self._totals
        for block in blocks(texts):
            odd = [i for i, x in enumerate(block) if x and _ODD.search(x)]
            parts = [self._split(block[i]) for i in odd]
            new = set(itertools.chain.from_iterable(parts)).difference(totals)
            if len(totals) + len(new) > CACHE:
                totals.clear()
                new = set(itertools.chain.from_iterable(parts))
            new = list(new)
            totals.update(zip(new, self._totals_of([[r] if r in self.t.special else _find(r) for r in new]), strict=True))
            rest = set(odd)
            n = self._totals_of([self.pretokens(x) if x and i not in rest else [] for i, x in enumerate(block)])
            for i, p in zip(odd, parts, strict=True):
                n[i] = sum(map(totals.__getitem__, p))
            out += n
        return out


def blocks(texts: list[str | None], chars: int = 1_000_000):
    """Runs of texts of about so many characters: bounds what is held in pieces at a time."""
    block, size = [], 0
    for x in texts:
        block.append(x)
        size += len(x or "")
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


_CODECS: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """One codec for each vocabulary file in a process."""
    if path not in _CODECS:
        _CODECS[path] = BpeCodec(path)
    return _CODECS[path]


def forget() -> None:
    """Clears the codecs' maps of results, as at the end of a task; their tables stay, as building them takes more memory than they do."""
    for c in _CODECS.values():
        c._ids.clear()
        c._runs.clear()
        c._ends.clear()
        c._stored = np.zeros(0, np.int32)
        c._totals.clear()
        c._fit_memo.clear()
