"""Streaming BPE transducer with bounded lookahead, and an incremental decoder.

Encoding. A pre-token is a stream of symbols (byte characters, the last one carrying the word-end
suffix). For each position the transducer keeps the last token of the one valid encoding of the
prefix that ends there: the longest suffix token that is compatible with the token before it, where
two tokens are compatible if merging their joined symbols by rank gives the two back. A token can
reach over at most ``lookahead`` symbols (the longest token of the merge list), so once the chains
that start in the last ``lookahead`` positions share their beginning, that beginning can't change
any more and is emitted. State: one window of positions, independent of the text's length.

``Transducer.stream`` takes one pre-token symbol by symbol. ``Lanes`` takes the same steps for many
pre-tokens at once, a lane for each and all at the same position, in numpy: what fits in one window
has nothing to emit before its end. Pre-tokens are read from the text in pieces, looked up in a
cache of bounded size and encoded if unknown; ids leave piece by piece.

Decoding. Tokens are turned into bytes, bytes into text by an incremental UTF-8 state machine that
holds at most three pending bytes; ids arrive in pieces. It writes either the library's decoding
(token strings joined by a space) or readable text (a word-end suffix becomes a space).

Null texts count as empty.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import col, only, strings

SPACE = "\t-\r \x85\xa0  -     　"
#: Fixed by the tokenizer file's pre-tokenizer.
_PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same for lower-cased texts without characters beyond ASCII, or beyond U+024F.
_ASCII = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^{SPACE}a-z0-9]+")
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{SPACE}{_LETTERS}{_NUMBERS}]+")
_WIDE = re.compile("[^\x00-ɏ]")


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(plain)))
    return [out[b] for b in range(256)]


_NEVER = (1 << 31) - 1


class Transducer:
    """Symbols in, token ids out, each as soon as no continuation can change it."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.rank = {tuple(m): i for i, m in enumerate(merges)}
        self.symbols: dict[str, int] = {}
        units = {a for m in self.rank for a in m} | {a + b for a, b in self.rank}
        for t in units:
            self.symbols[t] = len(t.removesuffix(suffix)) if t != suffix else 1
        #: Symbols from which the next token can still start: the merge list's sufficient lookahead.
        self.lookahead = max(self.symbols.values(), default=1)
        self._pairs: dict[tuple[str, str], bool] = {}

    def split(self, token: str) -> list[str]:
        if token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def merge(self, parts: list[str]) -> list[str]:
        """Plain BPE: the lowest-ranked adjacent pair first, leftmost first among equals."""
        rank = self.rank
        ranks = [rank.get(p, _NEVER) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [new := parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((parts[i - 1], new), _NEVER)
            if i < len(ranks):
                ranks[i] = rank.get((new, parts[i + 1]), _NEVER)
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether merging the joined symbols of two tokens gives these two tokens."""
        key = (left, right)
        got = self._pairs.get(key)
        if got is None:
            if len(self._pairs) > 500_000:
                self._pairs.clear()
            got = self._pairs[key] = self.merge(self.split(left) + self.split(right)) == [left, right]
        return got

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one pre-token; memory is bounded by the lookahead, not by the text."""
        n, base = 0, 0  # symbols seen; position of window[0]
        window: list[str] = []
        last: list[tuple[str, int] | None] = [None]  # for each prefix end from base: last token, its length
        for s in symbols:
            window.append(s)
            n += 1
            found = None
            for size in range(min(self.lookahead, len(window)), 0, -1):
                t = window[-1] if size == 1 else "".join(window[-size:])
                if size > 1 and t not in self.symbols:
                    continue
                at = n - size - base
                before = last[at] if at < len(last) else None
                if before is None and at > 0:
                    continue
                if before is None or not before[1] or self.fits(before[0], t):
                    found = (t, size)
                    break
            last.append(found)
            if len(window) >= 4 * self.lookahead:
                stable = self._stable(last)
                yield from (t for t, _ in stable)
                cut = sum(k for _, k in stable)
                if cut:
                    window, base = window[cut:], base + cut
                    last = [(stable[-1][0], 0), *last[cut + 1 :]]
        out, at = [], len(last) - 1
        while at > 0:
            t, k = last[at]
            out.append(t)
            at -= k
        yield from reversed(out)

    def _stable(self, last: list) -> list[tuple[str, int]]:
        """The common beginning of the chains that end in the last lookahead positions."""
        common: list | None = None
        for end in range(max(1, len(last) - self.lookahead), len(last)):
            if last[end] is None:
                continue
            chain, at = [], end
            while at > 0:
                chain.append(last[at])
                at -= last[at][1]
            chain.reverse()
            if common is None:
                common = chain
            else:
                k = 0
                while k < min(len(common), len(chain)) and common[k] == chain[k]:
                    k += 1
                common = common[:k]
        return common or []


class _Table:
    """Whole numbers by whole-number keys, for arrays of keys: open addressing in numpy. A table of
    bytes answers first whether a key can be there at all; most are not."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, none: int, bits: int = 20):
        self.none, self.shift = none, np.uint64(64 - bits)
        home = self._home(keys)
        order = np.argsort(home, kind="stable")
        self.keys, self.values = np.append(keys[order], ~np.uint64(0)), np.append(values[order], none).astype(np.int32)
        at, n = np.unique(home, return_counts=True)
        self.most = int(n.max()) if len(n) else 0
        self.there = np.zeros(1 << bits, np.uint8)
        self.there[at] = n
        self.first = np.zeros(1 << bits, np.int32)
        self.first[at] = np.cumsum(n) - n

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        home = self._home(keys)
        out = np.full(len(keys), self.none, np.int32)
        todo = np.flatnonzero(self.there[home])
        first, k = self.first[home[todo]], keys[todo]
        for step in range(self.most):
            hit = self.keys[np.minimum(first + step, len(self.keys) - 1)] == k
            out[todo[hit]] = self.values[first[hit] + step]
        return out


class Lanes:
    """The transducer's steps for many pre-tokens at once.

    Tokens are found by a rolling hash of their symbols. Whether two tokens are compatible is read
    off their spines: the pieces that stand at the left token's right edge, and at the right token's
    left edge, while each is being merged, with the rank of the merge that makes each. The two stay
    apart unless some pair of pieces that stand side by side can be merged before either grows.
    """

    def __init__(self, transducer: Transducer, vocab: dict[str, int], chars: list[str]):
        t, suffix = transducer, transducer.suffix
        rng = np.random.default_rng(71)
        self.value = rng.integers(1, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = 0x9E3779B97F4A7C15
        self.power = np.array([pow(base, k, 1 << 64) for k in range(4 * t.lookahead + 1)], np.uint64)
        self.scale = np.array([pow(base, -k, 1 << 64) for k in range(len(self.power))], np.uint64)
        self.lookahead = t.lookahead
        number = {c: b for b, c in enumerate(chars)}
        made: dict[str, tuple[int, str, str]] = {}
        for (x, y), r in t.rank.items():
            if x + y not in made:
                made[x + y] = (r, x, y)
            else:  # made in two ways: as its own symbols are merged
                *_, pair = self._last(t, x + y)
                made[x + y] = (t.rank[pair], *pair)
        size = max(vocab.values()) + 1
        left, right = [None] * size, [None] * size  # spines: lists of (token id, rank that makes it)
        units = {*chars, *(c + suffix for c in chars)}
        keys, ids = [], []
        for name in sorted(units, key=vocab.__getitem__):
            left[vocab[name]] = right[vocab[name]] = [(vocab[name], -1)]
        for name, (r, x, y) in sorted(made.items(), key=lambda m: m[1][0]):
            i = vocab[name]
            left[i] = [*left[vocab[x]], (i, r)]
            right[i] = [*right[vocab[y]], (i, r)]
        for name in {*units, *made}:
            symbols = t.split(name)
            h = 0
            for k, c in enumerate(symbols):
                v = int(self.value[number[c[0]] + 256 * (len(c) > 1)])
                h = (h + v * pow(base, k, 1 << 64)) % (1 << 64)
            keys.append(h)
            ids.append(vocab[name])
        self.tokens = _Table(np.array(keys, np.uint64), np.array(ids, np.int64), -1)
        ranks = np.array([(vocab[x] << 20 | vocab[y], r) for (x, y), r in t.rank.items()], np.int64).reshape(-1, 2)
        self.ranks = _Table(ranks[:, 0].astype(np.uint64), ranks[:, 1], _NEVER)
        self.left, self.right = self._spines(left), self._spines(right)

    @staticmethod
    def _spines(spines: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each token's spine starts; token ids; ranks, the last one followed by none."""
        sizes = [len(x) + 1 if x else 0 for x in spines]
        flat = [y for x in spines if x for y in (*x, (0, _NEVER))]
        names, ranks = zip(*flat)
        return np.cumsum([0, *sizes])[:-1], np.array(names, np.int32), np.array(ranks, np.int32)

    @staticmethod
    def _last(t: Transducer, name: str) -> Iterator[tuple[str, str]]:
        """The merges of a token's own symbols, in order."""
        parts = t.split(name)
        while len(parts) > 1:
            r, i = min((t.rank.get(p, _NEVER), i) for i, p in enumerate(zip(parts, parts[1:])))
            if r == _NEVER:
                return
            yield parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays two tokens when its joined symbols are merged."""
        (start_a, name_a, rank_a), (start_b, name_b, rank_b) = self.right, self.left
        ok = np.ones(len(a), bool)
        at, i, j = np.arange(len(a)), start_a[a], start_b[b]
        while len(at):
            joined = self.ranks.get(name_a[i].astype(np.uint64) << np.uint64(20) | name_b[j].astype(np.uint64))
            next_a, next_b = rank_a[i + 1], rank_b[j + 1]
            # of equal ranks the leftmost goes first: the left token's own merge, then this one
            across = (joined < next_a) & (joined <= next_b) & (joined < _NEVER)
            ok[at[across]] = False
            keep = ~across & (np.minimum(next_a, next_b) < _NEVER)
            grow = (next_a <= next_b)[keep]
            at, i, j = at[keep], i[keep] + grow, j[keep] + ~grow
        return ok

    def encode(self, words: list[bytes], lanes: int = 32_768) -> list[bytes]:
        """Little-endian ids of each pre-token, given as its bytes; none longer than two windows.

        Lanes are sorted, so that those with a common beginning stand together and one of them takes
        the steps of that beginning for all.
        """
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=words.__getitem__)
        for k in range(0, len(order), lanes):
            rows = order[k : k + lanes]
            for row, ids in zip(rows, self._encode([words[i] for i in rows])):
                out[row] = ids
        return out

    def _encode(self, words: list[bytes]) -> Iterator[bytes]:
        size = np.array([len(w) for w in words])
        rows, longest = np.arange(len(words)), int(size.max())
        raw = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), np.uint8).reshape(len(words), longest)
        last = np.full((longest + 1, len(words)), -1, np.int32)  # of each prefix without the end: its last token
        start = np.zeros((longest + 1, len(words)), np.int32)
        sums = np.zeros((longest + 1, len(words)), np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((self.value[raw] * self.power[:longest]).T, 0, out=sums[1:])
            for end in range(1, longest):
                here = rows[size > end]
                new = np.append(True, sums[end, here[1:]] != sums[end, here[:-1]])
                heads = here[new]
                token, begun = np.full(len(heads), -1, np.int32), np.zeros(len(heads), np.int32)
                todo = np.arange(len(heads))
                for begin in range(max(0, end - self.lookahead), end):  # the longest token first
                    at = heads[todo]
                    got = self.tokens.get((sums[end, at] - sums[begin, at]) * self.scale[begin])
                    good = self._follows(got, last[begin, at]) if begin else got >= 0
                    token[todo[good]], begun[todo[good]] = got[good], begin
                    todo = todo[~good]
                    if not len(todo):
                        break
                node = np.cumsum(new) - 1
                last[end, here], start[end, here] = token[node], begun[node]
            # the end: the last byte with the suffix
            final = self.value[256 + raw[rows, size - 1].astype(np.int64)]
            token, begun, todo = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64), rows
            for length in range(min(longest, self.lookahead), 0, -1):
                at = todo[size[todo] >= length]
                begin = size[at] - length
                got = self.tokens.get((sums[size[at] - 1, at] - sums[begin, at]) * self.scale[begin] + final[at] * self.power[length - 1])
                good = np.where(begin > 0, self._follows(got, last[begin, at]), got >= 0)
                token[at[good]], begun[at[good]] = got[good], begin[good]
                done = np.zeros(len(words), bool)
                done[at[good]] = True
                todo = todo[~done[todo]]
                if not len(todo):
                    break
        # the one chain that ends with the last symbol, from its end
        chain, count, at = [token], np.ones(len(words), np.int64), rows[begun > 0]
        while len(at):
            got = np.full(len(words), -1, np.int32)
            got[at] = last[begun[at], at]
            chain.append(got)
            count[at] += 1
            begun[at] = start[begun[at], at]
            at = at[begun[at] > 0]
        flat = np.array(chain[::-1]).T
        data = flat[flat >= 0].astype("<u4").tobytes()
        stop = np.cumsum(count) * 4
        return (data[x:y] for x, y in zip((stop - 4 * count).tolist(), stop.tolist()))

    def _follows(self, token: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Which are tokens that may follow the last token of a prefix."""
        ok = (token >= 0) & (before >= 0)
        at = np.flatnonzero(ok)
        ok[at] = self.fits(before[at], token[at])
        return ok


class _Cache(dict):
    """Words in two generations of ``size``: what is looked up again outlives the older one."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size = make, size
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= 64:
            self[key] = got
        return got

    def turn(self) -> None:
        """Start a new generation if this one is full; between texts, so a text finds its words."""
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()


class Tokenizer:
    """A tokenizer file (word-end BPE over bytes; lower case; white space dropped) on the transducer."""

    def __init__(self, path: str, cache: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self._special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.transducer = Transducer(self.vocab, merges, self.suffix)
        self.bytes = byte_chars()
        self.byte_of = {c: b for b, c in enumerate(self.bytes)}
        self.lanes = Lanes(self.transducer, self.vocab, self.bytes)
        self.words = _Cache(self._word, cache)
        special = set(self.special.values())
        size = max(self.tokens) + 1
        #: What each token adds to the library's decoding, and to readable text.
        self.joined = [(self.tokens[i] + " ").encode() if i in self.tokens else b"" for i in range(size)]
        self.readable = [b"" if i not in self.tokens else self.tokens[i].encode() if i in special else self._plain(self.tokens[i]) for i in range(size)]

    def _plain(self, token: str) -> bytes:
        body = token.removesuffix(self.suffix)
        return bytes(self.byte_of[c] for c in body) + b" " * (body != token)

    # -- encoding

    def _word(self, word: str) -> bytes:
        """Little-endian ids of one pre-token, by the transducer."""
        chars = [self.bytes[b] for b in word.encode("utf-8", "replace")]
        chars[-1] += self.suffix
        return array("I", map(self.vocab.__getitem__, self.transducer.stream(chars))).tobytes()

    @staticmethod
    def _normal(text: str):
        """The pattern for a text, and the text, normalised and lower-cased."""
        if text.isascii():
            return _ASCII, text.lower()
        s = unicodedata.normalize("NFC", text)
        s = s.lower() if "Σ" not in s else "".join(c.lower() for c in s)
        return (_PRE if _WIDE.search(s) else _LATIN), s

    @classmethod
    def pretokens(cls, text: str) -> list[str]:
        """Letter runs, single digits and runs of other marks of a text, normalised and lower-cased."""
        pattern, s = cls._normal(text)
        return pattern.findall(s)

    @classmethod
    def _pretokens(cls, text: str) -> Iterator:
        pattern, s = cls._normal(text)
        return pattern.finditer(s)

    def _pieces(self, text: str, most: int) -> Iterator[tuple[list[str], bool]]:
        """Lists of at most ``most`` pre-tokens, in order; a special token stands alone (true)."""
        at = 0
        for m in self._special.finditer(text) if "<|" in text else ():
            yield from ((x, False) for x in self._between(text[at : m.start()], most))
            yield [m[0]], True
            at = m.end()
        yield from ((x, False) for x in self._between(text[at:] if at else text, most))

    def _between(self, text: str, most: int) -> Iterator[list[str]]:
        if len(text) <= most:
            yield self.pretokens(text)
        else:
            found = (m[0] for m in self._pretokens(text))
            while piece := list(islice(found, most)):
                yield piece

    def learn(self, pieces: list[list[str]]) -> None:
        """Cache the words of some pieces that are still unknown: short ones side by side, the rest
        one by one as they are met; both by the transducer's steps."""
        words = self.words
        words.turn()
        new: set[str] = set()
        for s in pieces:
            new.update(s)
        short, raw = [], []
        for w in new.difference(words):
            if (got := words.older.get(w)) is not None:
                words[w] = got
            else:
                b = w.encode("utf-8", "replace")
                if len(b) <= 2 * self.transducer.lookahead:
                    short.append(w)
                    raw.append(b)
        words.update(zip(short, self.lanes.encode(raw)))

    def encode_pieces(self, texts: Iterable[str], end: bytes = b"", most: int = 1_000_000) -> Iterator[tuple[np.ndarray, bool]]:
        """The ids of texts, then ``end`` after each, in pieces; whether a piece ends its text.

        Of all texts at most about ``most`` pre-tokens are held at a time.
        """
        held: list[tuple[list[str], bool, bool]] = []
        size = 0

        def flush() -> Iterator[tuple[np.ndarray, bool]]:
            self.learn([x for x, special, _ in held if not special])
            get = self.words.__getitem__
            for x, special, ends in held:
                ids = self.special[x[0]].to_bytes(4, "little") if special else b"".join(map(get, x))
                yield np.frombuffer(ids + end if ends else ids, "<u4"), ends
            held.clear()

        for text in texts:
            pieces = self._pieces(text, most)
            now = next(pieces)
            while now is not None:
                after = next(pieces, None)
                held.append((*now, after is None))
                size += len(now[0]) + 1
                if size >= most:
                    yield from flush()
                    size = 0
                now = after
        yield from flush()

    def encode_all(self, texts: Iterable[str], end: bytes = b"") -> Iterator[np.ndarray]:
        """The ids of each text, then ``end``."""
        held = []
        for ids, ends in self.encode_pieces(texts, end):
            held.append(ids)
            if ends:
                yield held[0] if len(held) == 1 else np.concatenate(held)
                held = []

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text or ""]))

    # -- decoding

    def decoder(self, readable: bool = False) -> Decoder:
        return Decoder(self, readable)

    def decode_tokens(self, ids: Iterable[int]) -> Iterator[str]:
        """The library's decode for a file without a decoder, piece by piece."""
        yield from self._decode(ids, False)

    def decode_text(self, ids: Iterable[int]) -> Iterator[str]:
        """Readable text, piece by piece; at most three bytes wait for their character."""
        yield from self._decode(ids, True)

    def _decode(self, ids: Iterable[int], readable: bool) -> Iterator[str]:
        machine, left = self.decoder(readable), iter(ids)
        while piece := list(islice(left, 1 << 16)):
            yield machine.feed(piece)
        yield machine.end()


class Decoder:
    """Ids in, text out: a byte-to-text machine whose state is whether a space is due and at most
    three bytes of an unfinished character."""

    def __init__(self, tokenizer: Tokenizer, readable: bool):
        table = tokenizer.readable if readable else tokenizer.joined
        self.say = table.__getitem__
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.due = b""

    def feed(self, ids: list[int]) -> str:
        """Every token's bytes end with the space that is due before the next token, if any is."""
        data = self.due + b"".join(map(self.say, ids))
        self.due = b" " if data.endswith(b" ") else b""
        return self.machine.decode(data[: len(data) - len(self.due)])

    def end(self) -> str:
        self.due = b""
        return self.machine.decode(b"", True)


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One per Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer(path)
    return _TOKENIZERS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Each row of (doc_id, text) with ids array<int> and decoded text; null texts count as empty."""

    def run(batches):
        t = tokenizer(path)
        for b in batches:
            ids = [*t.encode_all(strings(b))]
            out = ["".join(t.decode_text(x)) for x in ids]
            yield pa.record_batch([col(b, "doc_id"), pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32())), pa.array(out, pa.string())], ["doc_id", "ids", "decoded"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, streamed: no whole result is held.

    Null and empty texts: no tokens, the digests of the empty string. Repeated rows: repeated results.
    """

    def run(batches):
        t = tokenizer(path)
        number = [b" %d" % i for i in range(len(t.joined))].__getitem__
        for b in batches:
            n, a, d = [], [], []
            said, seen, machine = [hashlib.sha256(), hashlib.sha256()], 0, t.decoder()
            for ids, ends in t.encode_pieces(strings(b)):
                for at in range(0, len(ids), 1 << 16):
                    part = ids[at : at + (1 << 16)].tolist()
                    text = b"".join(map(number, part))
                    said[0].update(text if seen else memoryview(text)[1:])
                    said[1].update(machine.feed(part).encode())
                    seen += len(part)
                if ends:
                    said[1].update(machine.end().encode())
                    n.append(seen)
                    a.append(said[0].hexdigest())
                    d.append(said[1].hexdigest())
                    said, seen, machine = [hashlib.sha256(), hashlib.sha256()], 0, t.decoder()
            yield pa.record_batch([col(b, "doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def piece_rows(ids: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids, cut every ``size`` tokens."""
    for k, at in enumerate(range(0, len(ids), size)):
        part = ids[at : at + size]
        yield k, at, len(part), zlib.crc32(part)
