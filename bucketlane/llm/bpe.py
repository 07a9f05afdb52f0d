"""Byte-level BPE as a finite-state transducer, and streaming decoding.

A sequence of tokens is the BPE encoding of its bytes exactly if each token encodes to itself and each two neighbours
encode to themselves together ("fit"). So each prefix of a piece has one encoding, and what matters of it is its last
token and where that ends. A state of the machine is the set of borders from which a longer token may still come: pairs
(last token before the border, trie node of the bytes since). Reading a byte moves all nodes on, and the one border whose
finished token fits its last token tells the last token of the longer prefix, which is the transition's output. States and
transitions are made lazily, as bytes come, by subset construction, and are kept for all later texts of the worker (up to
MOST_STATES, then anew); every piece runs on them alone. Tokens are read off by following last tokens back; in a stream
that is done as soon as all borders of the state agree, so the output lags by a bounded number of bytes, not by the text.

Texts are cut at blanks that stand alone, where the pattern always starts a match; equal runs between such blanks are
encoded once for each batch and remembered; the pieces of all new runs go through the machine in step. Texts of more than CHUNK bytes go through in parts, encoded and decoded as
streams. Decoding gathers the tokens' bytes and runs the UTF-8 state machine over all of them.

Edge cases: null and empty texts have no tokens; any text, however long, takes one pass; bytes that don't form UTF-8
can be decoded (each bad byte run gives U+FFFD, as Python's "replace" does).
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bucketlane.llm.runtime import lean, ship, spans, strings

#: Runs and pieces that a worker remembers, states of its machine, and bytes of text that are worked on at once.
MOST_PIECES, MOST_STATES, CHUNK = 120_000, 200_000, 1 << 22
#: Bytes of a piece that runs in step with others; longer ones run alone. Bytes of text that are decoded at once.
SHORT, DECODED = 64, 1 << 20
#: A single blank between two other characters always separates two matches of the pattern.
_LONE = re.compile(r"(?<=\S) (?=\S)")
#: What tells that not every blank of a text is such a one (RE2; white space in the widest sense).
_RUNS = r"[\s\x0b\x1c-\x1f\x{85}\pZ] | [\s\x0b\x1c-\x1f\x{85}\pZ]|\A | \z"


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + sizes[i]] of all i, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Memory:
    """A mapping of at most about `most` entries: what wasn't asked for while half of them came is forgotten."""

    def __init__(self, most: int):
        self.most, self.now, self.before = most, {}, {}

    def get_all(self, keys: list) -> list:
        """Values, None for unknown keys."""
        out, before = list(map(self.now.get, keys)), self.before
        for i in [i for i, x in enumerate(out) if x is None]:
            if (old := before.get(keys[i])) is not None:
                out[i] = self.now[keys[i]] = old
        return out

    def update(self, entries: dict) -> None:
        self.now.update(entries)
        if 2 * len(self.now) > self.most:
            self.now, self.before = {}, self.now


class Table:
    """Transitions as a hash table in arrays: key 256 * state + byte, value (256 * next state, last token)."""

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.to, self.last = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, or the free place it would go to."""
        at, mask = self._slot(keys), (1 << self.bits) - 1
        seen = self.keys[at]
        todo = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            seen = self.keys[at[todo]]
            todo = todo[(seen != keys[todo]) & (seen >= 0)]
        return at

    def put(self, keys: np.ndarray, to: np.ndarray, last: np.ndarray) -> None:
        """Adds distinct keys that aren't there."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            old = self.keys >= 0
            whole = self.keys[old], self.to[old], self.last[old]
            self.__init__(max(self.bits, (self.used + len(keys)).bit_length()) + 2)
            self.put(*whole)
        self.used += len(keys)
        while len(keys):
            at = self.find(keys)
            self.keys[at] = keys  # of several keys for one place, one gets it
            won = self.keys[at] == keys
            self.to[at[won]], self.last[at[won]] = to[won], last[won]
            keys, to, last = keys[~won], to[~won], last[~won]


class Transducer:
    """Encoder over a vocabulary of ranks in which each token encodes to itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._split: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}
        self._grow_trie()
        self._reset()
        self._first, self._later, self._pieces = Memory(MOST_PIECES), Memory(MOST_PIECES), Memory(MOST_PIECES)
        #: All tokens' bytes in a row, for decoding: by token, where they start and how many they are.
        self.flat = np.frombuffer(b"".join(self.bytes_of.values()), np.uint8)
        self.size = np.zeros(max(self.bytes_of) + 1, np.int64)
        self.start = np.zeros(len(self.size), np.int64)
        order = np.fromiter(self.bytes_of, np.int64)
        self.size[order] = [len(b) for b in self.bytes_of.values()]
        self.start[order] = np.cumsum(self.size[order]) - self.size[order]

    def _grow_trie(self) -> None:
        """By node: children by byte, token (or -1) and depth."""
        self._kids, self._token, self._depth = [{}], [-1], [0]
        for b, i in self.ranks.items():
            at = 0
            for x in b:
                to = self._kids[at].get(x)
                if to is None:
                    to = self._kids[at][x] = len(self._kids)
                    self._kids.append({})
                    self._token.append(-1)
                    self._depth.append(self._depth[at] + 1)
                at = to
            self._token[at] = i
        self._length = {i: len(b) for b, i in self.ranks.items()}
        self._longest = max(self._length.values())

    def _reset(self) -> None:
        #: A state: (last token, node, last token, node, ...), the longest way since its border first. State 0 is the start.
        self._states: list[tuple[int, ...]] = [(-1, 0)]
        self._ids: dict[tuple[int, ...], int] = {(-1, 0): 0}
        #: By 256 * state + byte: (256 * next state, last token of the prefix that this byte ends). For pieces in step, and alone.
        self._table = Table()
        self._next: dict[int, tuple[int, int]] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of this one joins; None for a byte."""
        if token not in self._split:
            parts = [self.ranks[bytes([x])] for x in self.bytes_of[token]]
            while len(parts) > 2:
                joined = [self.ranks.get(self.bytes_of[a] + self.bytes_of[b], 1 << 60) for a, b in zip(parts, parts[1:])]
                i = min(range(len(joined)), key=joined.__getitem__)
                parts[i : i + 2] = [joined[i]]
            self._split[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._split[token]

    def fit(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of the two. Undoes their merges from the last to the first along the border."""
        key = left << 32 | right
        if (known := self._fits.get(key)) is not None:
            return known
        a, b, before, fits = left, right, 1 << 61, None
        while fits is None:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joined is not None and joined < before:
                fits = False
            elif (s := self.split(a)) and a > b:
                before, a = a, s[1]
            elif s2 := self.split(b):
                before, b = b + 1, s2[0]
            elif s:
                before, a = a, s[1]
            else:
                fits = True
        if len(self._fits) > MOST_STATES * 3 // 2:
            self._fits.clear()
        self._fits[key] = fits
        return fits

    def _step(self, key: int) -> tuple[int, int]:
        """Subset construction for one state and byte."""
        row, byte = self._states[key >> 8], key & 255
        grown, last = [], -1
        for i in range(0, len(row), 2):
            child = self._kids[row[i + 1]].get(byte)
            if child is None:
                continue
            token = self._token[child]
            if token >= 0 and last < 0 and (row[i] < 0 or self.fit(row[i], token)):
                last = token  # the one border that fits
            if self._kids[child]:
                grown += (row[i], child)
        grown += (last, 0)
        to = tuple(grown)
        n = self._ids.setdefault(to, len(self._states))
        if n == len(self._states):
            self._states.append(to)
        return n << 8, last

    def _lasts(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each byte of the pieces data[start : start + size], the last token of the prefix that it ends. All pieces move
        on in step; transitions that don't exist yet are made."""
        out, state = np.zeros(len(data), np.int32), np.zeros(len(size), np.int64)
        order = np.argsort(-size, kind="stable")
        alive = np.searchsorted(-size[order], -np.arange(1, int(size.max()) + 1), "right") if len(size) else []
        for k, n in enumerate(alive):  # the n longest ones have a byte k
            at = start[order[:n]] + k
            keys = state[:n] | data[at]
            where = self._table.find(keys)
            new = np.unique(keys[self._table.keys[where] != keys])
            if len(new):
                made = np.array([self._step(x) for x in new.tolist()], np.int64)
                self._table.put(new, made[:, 0], made[:, 1].astype(np.int32))
                where = self._table.find(keys)
            state[:n], out[at] = self._table.to[where], self._table.last[where]
        return out

    def tokens_of(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(size)
        start = ends - size
        lasts = self._lasts(np.frombuffer(b"".join(pieces), np.uint8), start, size)
        # read off backwards, a token of each piece at a time
        which, at, read = np.arange(len(pieces)), ends.copy(), []
        which = which[size > 0]
        while len(which):
            got = lasts[at[which] - 1]
            read.append((which, got))
            at[which] -= self.size[got]
            which = which[at[which] > start[which]]
        many = np.zeros(len(pieces), np.int64)
        for which, _ in read:
            many[which] += 1
        to = np.cumsum(many)
        flat = np.zeros(int(to[-1]) if len(to) else 0, np.uint32)
        for i, (which, got) in enumerate(read):
            flat[to[which] - 1 - i] = got
        if len(self._states) > MOST_STATES:
            self._reset()
        packed, cuts = flat.tobytes(), (4 * to).tolist()
        return [packed[a:b] for a, b in zip([0, *cuts], cuts)]

    def _back(self, lasts: list[int], at: int) -> list[int]:
        """Tokens up to border `at`, read off backwards. lasts[i]: the last token of the first i + 1 bytes."""
        out, length = [], self._length
        while at > 0:
            out.append(lasts[at - 1])
            at -= length[out[-1]]
        out.reverse()
        return out

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of one piece of bytes, each soon after it's certain: what all borders of the state agree on is emitted
        whenever as many bytes as the longest token has are waiting."""
        at, lasts, known = 0, [], self._next
        for n, byte in enumerate(data):
            if not n % 256 and len(self._states) > MOST_STATES:
                row = self._states[at >> 8]
                self._reset()
                known = self._next
                at = self._ids.setdefault(row, len(self._states)) << 8
                if at >> 8 == len(self._states):
                    self._states.append(row)
            if (to := known.get(at | byte)) is None:
                to = known[at | byte] = self._step(at | byte)
            at, last = to
            lasts.append(last)
            if len(lasts) >= self._longest and not n % 8:
                row = self._states[at >> 8]
                ways = [self._back(lasts, len(lasts) - self._depth[node]) for node in row[1::2]]
                agreed = 0
                while all(len(w) > agreed for w in ways) and len({w[agreed] for w in ways}) == 1:
                    agreed += 1
                yield from ways[0][:agreed]
                del lasts[: sum(map(self._length.__getitem__, ways[0][:agreed]))]
        yield from self._back(lasts, len(lasts))

    def _runs(self, runs: list[str], known: Memory, lead: str) -> list[bytes]:
        """Packed ids of runs of pieces, all of which come after `lead`; they are remembered."""
        out = known.get_all(runs)
        new = [i for i, x in enumerate(out) if x is None]
        cut = [self.find(lead + runs[i]) for i in new]
        pieces = list(dict.fromkeys(p for ps in cut for p in ps))
        ids = dict(zip(pieces, self._pieces.get_all(pieces)))
        short, long = [], []
        for p, got in ids.items():
            if got is None:
                (short if len(p) <= SHORT else long).append(p)
        fresh = dict(zip(short, self.tokens_of([p.encode() for p in short])))
        ids.update(fresh)
        for p in long:
            ids[p] = array("I", self.stream(p.encode())).tobytes()
        made = {}
        for i, ps in zip(new, cut):
            out[i] = ids[ps[0]] if len(ps) == 1 else b"".join([ids[p] for p in ps])
            if len(runs[i]) <= SHORT:
                made[runs[i]] = out[i]
        self._pieces.update({p: x for p, x in fresh.items() if p[1:] not in made or p[:1] != lead})
        known.update(made)
        return out

    def encode_all(self, texts: pa.Array, first: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start and end. first: the texts aren't what follows a lone blank."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        mixed = pc.match_substring_regex(texts, _RUNS)
        if pc.any(mixed).as_py():
            lists = pa.array([_LONE.split(t) if m else t.split(" ") for t, m in zip(texts.to_pylist(), mixed.to_pylist())], pa.large_list(pa.large_string()))
        else:
            lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        runs = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
        offsets = offsets - offsets[0]
        code, distinct = runs.indices.to_numpy().astype(np.int64), runs.dictionary.to_pylist()
        after = np.ones(len(code), bool)
        after[offsets[:-1]] = not first  # the first run of a text has no blank before it
        packed = []
        for some, known, lead in ((after, self._later, " "), (~after, self._first, "")):
            which, back = np.unique(code[some], return_inverse=True)
            code[some] = len(packed) + back
            packed += self._runs([distinct[i] for i in which.tolist()], known, lead)
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        start = np.cumsum(size) - size
        many = size[code]
        ends = np.concatenate([[0], np.cumsum(many)])
        return _gathered(np.frombuffer(b"".join(packed), np.uint32), start[code], many), ends[offsets]

    def decoded_bytes(self, ids: np.ndarray) -> np.ndarray:
        return _gathered(self.flat, self.start[ids], self.size[ids])

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all(pa.array([text], pa.large_string()))[0].tolist()


def parts(text: str, most: int = CHUNK) -> Iterator[str]:
    """Parts of about `most` characters, cut at lone blanks, which belong to no part."""
    at = 0
    while len(text) - at > most and (cut := _LONE.search(text, at + most)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def _lead_table() -> np.ndarray:
    out = np.zeros(256, np.int8)
    for x in range(256):
        if first := Utf8.lead(x):
            out[x] = first[0]
    return out


class Utf8:
    """Incremental UTF-8 machine: bytes in, text out, a character split over tokens waits for its rest.

    The state is the tuple (bytes of the character so far, continuation bytes still due, least and greatest next byte).
    """

    START = (b"", 0, 0x80, 0xBF)

    def __init__(self):
        self.state = self.START

    @staticmethod
    def lead(x: int) -> tuple[int, int, int] | None:
        """Continuation bytes after this one, and the bounds of the first of them."""
        if 0xC2 <= x <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= x <= 0xEF:
            return 2, 0xA0 if x == 0xE0 else 0x80, 0x9F if x == 0xED else 0xBF
        if 0xF0 <= x <= 0xF4:
            return 3, 0x90 if x == 0xF0 else 0x80, 0x8F if x == 0xF4 else 0xBF
        return None

    def _bytewise(self, data: bytes) -> str:
        out, (seen, due, low, high) = [], self.state
        for x in data:
            if due:
                if low <= x <= high:
                    seen, due, low, high = seen + bytes([x]), due - 1, 0x80, 0xBF
                    if not due:
                        out.append(seen.decode())
                        seen = b""
                    continue
                out.append("�")
                seen, due = b"", 0
            if x < 0x80:
                out.append(chr(x))
            elif first := self.lead(x):
                seen, (due, low, high) = bytes([x]), first
            else:
                out.append("�")
        self.state = (seen, due, low, high) if due else self.START
        return "".join(out)

    def _whole(self, data: np.ndarray) -> int:
        """Runs the machine over all bytes at once, from the start state: how many of them form whole characters, -1 if any is
        out of place. A state depends on the three bytes before alone: each lead tells how many bytes are still due after it."""
        if not _TABLES:
            _TABLES.append(_lead_table())
        if not len(data) or int(data.max()) < 0x80:
            return len(data)
        leads = _TABLES[0][data]
        due = leads.copy()  # after each byte
        np.maximum(due[1:], leads[:-1] - 1, out=due[1:])
        np.maximum(due[2:], leads[:-2] - 2, out=due[2:])
        more = (data & 0xC0) == 0x80
        fits = not more[0] and bool((more[1:] == (due[:-1] > 0)).all()) and not bool(((data >= 0x80) & ~more & (leads == 0)).any())
        if fits:
            for lead, low, high in ((0xE0, 0xA0, 0xBF), (0xED, 0x80, 0x9F), (0xF0, 0x90, 0xBF), (0xF4, 0x80, 0x8F)):
                at = np.flatnonzero(data[:-1] == lead) + 1
                fits = fits and bool(((data[at] >= low) & (data[at] <= high)).all())
        if not fits:
            return -1
        back = 1
        while back <= len(data) and due[-back]:  # at most three
            back += 1
        return len(data) + 1 - back

    def feed(self, data: bytes) -> str:
        """Text that is complete with these bytes."""
        return self.feed_bytes(np.frombuffer(data, np.uint8)).decode()

    def feed_bytes(self, data: np.ndarray) -> bytes:
        """The same, as well-formed UTF-8."""
        lead = min(self.state[1], len(data))
        out = self._bytewise(data[:lead].tobytes()).encode() if lead else b""
        if self.state[1] or (n := self._whole(data[lead:])) < 0:
            return out + self._bytewise(data[lead:].tobytes()).encode()
        out += data[lead : lead + n].tobytes()
        return out + self._bytewise(data[lead + n :].tobytes()).encode() if lead + n < len(data) else out

    def close(self) -> str:
        left, self.state = self.state[1], self.START
        return "�" if left else ""


_TABLES: list[np.ndarray] = []


def decode(ids: Iterable[int], bytes_of: dict[int, bytes], machine: Utf8 | None = None, chunk: int = 1 << 16) -> Iterator[str]:
    """Text of a stream of ids, in chunks that never end within a character."""
    machine, ids = machine or Utf8(), iter(ids)
    while some := list(islice(ids, chunk)):
        if text := machine.feed(b"".join(map(bytes_of.__getitem__, some))):
            yield text
    if rest := machine.close():
        yield rest


_CACHED: dict[tuple[str, str], Transducer] = {}


def transducer(path: str, pattern: str) -> Transducer:
    """One for each worker process."""
    if (path, pattern) not in _CACHED:
        _CACHED[path, pattern] = Transducer(load_ranks(path), pattern)
        gc.freeze()  # the trie stays; no collection need walk it
    return _CACHED[path, pattern]


def _digests(t: Transducer, texts: pa.Array) -> Iterator[tuple[int, str, str]]:
    """(n_tokens, digest of the ids, digest of what they decode to) of each text."""
    _, offsets = strings(texts)
    for lo, hi in spans(offsets, CHUNK):
        if hi - lo == 1 and offsets[hi] - offsets[lo] > CHUNK:
            n, ids_, back, machine = 0, hashlib.sha256(), hashlib.sha256(), Utf8()
            for i, part in enumerate(parts(texts[lo].as_py())):
                ids = t.encode_all(pa.array([part], pa.large_string()), not i)[0]
                n += len(ids)
                ids_.update(ids.astype("<u4").tobytes())
                back.update(machine.feed_bytes(t.decoded_bytes(ids)))
            back.update(machine.close().encode())
            yield n, ids_.hexdigest(), back.hexdigest()
            continue
        ids, ends = t.encode_all(texts.slice(lo, hi - lo))
        for x, y in spans(offsets[lo : hi + 1], DECODED):
            yield from _decoded(t, ids[ends[x] : ends[y]], ends[x : y + 1] - ends[x])


def _decoded(t: Transducer, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, str, str]]:
    packed, data = memoryview(ids.astype("<u4").tobytes()), t.decoded_bytes(ids)
    at = np.concatenate([[0], np.cumsum(t.size[ids])])[ends]
    machine, whole, cuts = Utf8(), None, at[at < len(data)]
    if not ((data[cuts] & 0xC0) == 0x80).any():  # one run over all texts, as no character spans two of them
        whole = memoryview(machine.feed_bytes(data))
        whole = whole if len(whole) == len(data) and machine.state == machine.START else None
    for a, b, x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), at[:-1].tolist(), at[1:].tolist()):
        if whole is None:
            machine = Utf8()
            said = machine.feed_bytes(data[x:y]) + machine.close().encode()
        else:
            said = whole[x:y]
        yield b - a, hashlib.sha256(packed[4 * a : 4 * b]).hexdigest(), hashlib.sha256(said).hexdigest()


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """All columns of df plus the token ids (array of int) of `text`; a column named like `ids` is replaced."""
    ship(df.sparkSession)
    at, where = df.columns.index(text), df.columns.index(ids) if ids in df.columns else len(df.columns)

    def run(batches):
        t = transducer(path, pattern)
        for b in batches:
            for lo, hi in spans(strings(b.column(at))[1], CHUNK):
                some = b.slice(lo, hi - lo)
                tokens, ends = t.encode_all(some.column(at))
                columns = some.columns
                columns[where : where + 1] = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens.view(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType([f for f in df.schema.fields])
    if where < len(df.columns):
        schema.fields[where] = T.StructField(ids, T.ArrayType(T.IntegerType()))
    else:
        schema = schema.add(ids, T.ArrayType(T.IntegerType()))
    names = [f.name for f in schema.fields]
    return df.mapInArrow(lean(run), schema)


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, n_tokens, digest of its ids and digest of what the ids decode to. No shuffle."""
    ship(df.sparkSession)

    def run(batches):
        t = transducer(path, pattern)
        for b in batches:
            got = list(_digests(t, b.column(1)))
            n, ids, back = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
