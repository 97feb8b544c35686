"""Byte-level BPE by a lazily determinised finite-state transducer; streaming decode by a UTF-8 state machine.

The merges say of any two tokens whether they may stand side by side: what they spell must merge back into just these two.
Of every prefix of a text the encoding is thus the encoding of a shorter prefix and one last token, and the set of encodings
that may still go on is a set of such chains. A state of the transducer is what these chains have not agreed on yet: the last
token that all share and the bytes since. A byte leads to the next state and emits what all chains now share; states and
arrows are made when first met, kept in a table of bounded size, and no chain is longer than the longest token, so the
lookahead is bounded.

Cases: a null or empty text has no tokens; any text, control bytes and lone combining marks included, decodes to itself;
rows that repeat are encoded alike; other columns pass through, and one that has the name of a result is replaced by it.
"""

from __future__ import annotations

import base64
import bisect
import gc
import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns, hold
from .pieces import Recent, splitter

#: Bounds of what a worker keeps: pieces in either of two generations, states of the transducer.
PIECES, STATES = 250_000, 250_000
FEW = 6
FIELDS = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Encodes one piece (a match of the pattern) at a time; its arrows are kept over pieces."""

    def __init__(self, ranks: dict[bytes, int], most: int = STATES):
        self.ranks, self.most = ranks, most
        self.token = {i: t for t, i in ranks.items()}
        self.heads = {t[:k] for t in ranks for k in range(1, len(t) + 1)}  # proper or whole prefixes of tokens
        self.spelled = sorted(ranks)
        self.after: dict[bytes, list[int]] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        self.whole: dict[bytes, int] = {}
        self._reset()

    def _reset(self):
        self.number: dict[tuple[int, bytes], int] = {}
        self.state: list[tuple[int, bytes, tuple]] = []
        self.arrows: dict[int, int | tuple[int, tuple[int, ...]]] = {}  # by 256 * state + byte; only a state if nothing is emitted
        self.start = self._name(-1, b"", ((0, ()),))

    def _name(self, last: int, rest: bytes, live: tuple) -> int:
        """The number of a state. Of ``last`` only matters which of the tokens that may still follow fit it."""
        if live[0][1]:
            key = rest, live
        elif last >= 0 and len(rest) > 1 and len(follow := self.following(rest)) <= FEW:
            key = rest, live, sum([self.side_by_side(last, t) << k for k, t in enumerate(follow)])
        else:
            key = last, rest
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.state)
            self.state.append((last, rest, live))
        return n

    def following(self, rest: bytes) -> list[int]:
        """Tokens that begin with ``rest``, a few more than FEW at most."""
        found = self.after.get(rest)
        if found is None:
            at = bisect.bisect_left(self.spelled, rest)
            found = self.after[rest] = [self.ranks[t] for t in self.spelled[at : at + FEW + 1] if t.startswith(rest)]
        return found

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte or a token that the merges never make."""
        if token not in self.parts:
            parts = [self.ranks[bytes([b])] for b in self.token[token]]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda k: (self._rank(parts[k], parts[k + 1]), k))
                if self._rank(parts[best], parts[best + 1]) == float("inf"):
                    break
                parts[best : best + 2] = [self._rank(parts[best], parts[best + 1])]
            self.parts[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.parts[token]

    def _rank(self, a: int, b: int) -> float:
        return self.ranks.get(self.token[a] + self.token[b], float("inf"))

    def made(self, token: int) -> bool:
        """Whether the merges ever make this token from its own bytes."""
        return len(self.token[token]) == 1 or self.split(token) is not None and all(map(self.made, self.split(token)))

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b merge into just a, b: no merge across their border comes before one inside them."""
        key = a << 32 | b
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > 2 * self.most:
                self.fits.clear()
            found = self.fits[key] = self._side_by_side(a, b)
        return found

    def _side_by_side(self, a: int, b: int) -> bool:
        limit = float("inf")
        while True:
            across = self._rank(a, b)
            if across < limit:
                return False
            if len(self.token[a]) == 1 and len(self.token[b]) == 1:
                return True
            # undo the later of the two merges; what stood at the border before it must not have merged earlier
            if len(self.token[a]) > 1 and (a > b or len(self.token[b]) == 1):
                limit, a = a, self.split(a)[1]
                if self._rank(a, b) < limit:
                    return False
            else:
                limit, b = b, self.split(b)[0]
                if self._rank(a, b) <= limit:
                    return False

    def usable(self, word: bytes) -> int:
        """The token that spells ``word`` if the merges make it, else -1."""
        token = self.ranks.get(word)
        self.whole[word] = token = token if token is not None and self.made(token) else -1
        return token

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state and what all chains that may still go on now share.

        A chain is kept for each prefix of the open bytes at which a later token may begin; the one of the longest prefix
        comes from the only kept chain whose last token, and the token after it, may stand side by side.
        """
        last, rest, live = self.state[state]
        rest += bytes([byte])
        heads, whole, newest, kept = self.heads, self.whole, None, []
        for begin, chain in live:
            word = rest[begin:]
            if word in heads:
                kept.append((begin, chain))
                if newest is None:
                    token = whole.get(word)
                    if token is None:
                        token = self.usable(word)
                    if token >= 0:
                        before = chain[-1] if chain else last
                        if before < 0 or self.side_by_side(before, token):
                            newest = (*chain, token)
        if newest is not None:
            kept.append((len(rest), newest))
        first = kept[0][1]
        agreed = len(first)
        for _, chain in kept[1:]:
            agreed = min(agreed, len(chain))
            while chain[:agreed] != first[:agreed]:
                agreed -= 1
        out, begin = first[:agreed], kept[0][0]
        if agreed:
            last = out[-1]
        if agreed < len(first):
            last = -2
        return self._name(last, rest[begin:], tuple([(k - begin, c[agreed:]) for k, c in kept])), out

    def encode(self, piece: bytes) -> list[int]:
        if len(self.state) > self.most:
            self._reset()
        state, out, arrows = self.start, [], self.arrows
        for byte in piece:
            step = arrows.get(state << 8 | byte)
            if step is None:
                to, emitted = self._step(state, byte)
                step = arrows[state << 8 | byte] = (to, emitted) if emitted else to
            if step.__class__ is int:
                state = step
            else:
                state = step[0]
                out += step[1]
        out += self.state[state][2][-1][1]  # the chain of all bytes
        return out


def _utf8_table() -> list[list[int]]:
    """Next state by state and byte. 0: between characters; 1 to 3: so many continuation bytes to come; 4 to 7: the byte after
    E0, ED, F0 and F4, whose range is narrower; 8: broken."""
    table = [[8] * 256 for _ in range(9)]

    def to(state: int, first: int, last: int, following: int) -> None:
        table[state][first : last + 1] = [following] * (last + 1 - first)

    to(0, 0x00, 0x7F, 0), to(0, 0xC2, 0xDF, 1), to(0, 0xE0, 0xEF, 2), to(0, 0xF0, 0xF4, 3)
    for state in (1, 2, 3):
        to(state, 0x80, 0xBF, state - 1)
    for state, lead, first, last, following in ((4, 0xE0, 0xA0, 0xBF, 1), (5, 0xED, 0x80, 0x9F, 1), (6, 0xF0, 0x90, 0xBF, 2), (7, 0xF4, 0x80, 0x8F, 2)):
        to(0, lead, lead, state), to(state, first, last, following)
    return table


UTF8 = _utf8_table()


class Utf8:
    """Bytes in, text out, at any cut: a table of states says whether a character is still open, and its bytes wait."""

    def __init__(self):
        self.tail = b""

    @staticmethod
    def open_bytes(data: bytes) -> int:
        """How many bytes at the end belong to a character that is not whole yet: the states from its first byte on."""
        for k in range(len(data) - 1, max(-1, len(data) - 4), -1):
            if data[k] & 0xC0 != 0x80:  # no continuation: a character begins here, whatever was before
                state = 0
                for byte in data[k:]:
                    state = UTF8[state][byte]
                return len(data) - k if 0 < state < 8 else 0
        return 0

    def feed(self, data: bytes, final: bool = False) -> str:
        data = self.tail + data
        cut = 0 if final else self.open_bytes(data)
        self.tail = data[len(data) - cut :]
        return data[: len(data) - cut].decode("utf-8", "replace")


EVERY = 4096


def decode_parts(ids: list, spelled: Callable[[object], bytes], every: int = EVERY) -> Iterator[tuple[bytes, str]]:
    """The bytes of ids in parts of ``every`` ids, and the text that each part completes; a character may span parts."""
    machine = Utf8()
    for at in range(0, max(1, len(ids)), every):
        data = b"".join(map(spelled, ids[at : at + every]))
        yield data, machine.feed(data, final=at + every >= len(ids))


class Encoder:
    """Whole texts, piece by piece; what pieces that were met became is kept, up to a bound."""

    def __init__(self, path: str, pattern: str, pieces: int = PIECES, states: int = STATES):
        self.machine, self.split = Transducer(load_ranks(path), states), splitter(pattern)
        self.spelled = {str(i): t for i, t in self.machine.token.items()}.__getitem__
        self.kept = Recent(pieces)

    def _said(self, pieces: list[str]) -> list[str]:
        encode = self.machine.encode
        return [" ".join(map(str, encode(p.encode("utf-8", "surrogatepass")))) for p in pieces]

    def said(self, text: str) -> str:
        """The ids of a text, in decimal with spaces."""
        return " ".join(self.kept.all(self.split(text), self._said))

    def ids(self, text: str) -> list[int]:
        return list(map(int, self.said(text).split()))

    def digests(self, text: str) -> tuple[int, str, str]:
        """Count of ids, SHA-256 of the ids in decimal and of the bytes that they decode to."""
        said, back = self.said(text), hashlib.sha256()
        ids = said.split(" ") if said else []
        for data, _ in decode_parts(ids, self.spelled):
            back.update(data)
        return len(ids), hashlib.sha256(said.encode()).hexdigest(), back.hexdigest()


def encoder_of(path: str, pattern: str, pieces: int, states: int) -> Encoder:
    """One for each worker process, kept over its tasks."""
    gc.set_threshold(200_000, 50, 1000)  # its tables hold no cycles
    return hold(("bpe", path, pattern, pieces, states), lambda: Encoder(path, pattern, pieces, states))


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, with_ids: bool = False, pieces: int = PIECES, states: int = STATES) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 (and, if asked, ids) to every row.

    ``pieces`` and ``states`` bound what a worker keeps (a few hundred bytes each); fewer cost time, not results.
    """
    fields = FIELDS + [("ids", T.ArrayType(T.IntegerType()))] * with_ids

    def make():
        encoder = encoder_of(path, pattern, pieces, states)

        def step(texts):
            rows = [encoder.digests(t or "") for t in texts]
            out = [[r[k] for r in rows] for k in range(3)]
            return out + [[encoder.ids(t or "") for t in texts]] if with_ids else out

        return step

    return add_columns(docs, ["text"], make, fields, keep)
