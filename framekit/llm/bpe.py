"""Byte-level BPE encoding and decoding with a lazily determinised transducer.

A merge list defines a nondeterministic transducer. One of its items is a token
already chosen, a trie node for the bytes read since, and the tokens that are
chosen but not yet written. Reading a byte moves every item down the trie; when
a node spells a token that may follow the item's last one, that token is the
last of the encoding of everything read so far. Exactly one item can do so at
each byte, because two tokens may stand side by side only if the merges of
their joint bytes leave their border alone, and a sequence whose neighbours all
may stand side by side is the encoding of its bytes.

Determinising gives states that are sequences of items. Tokens that all items
of a state agree on are written at once, so the delay is bounded by the
longest token. States and arcs are made when a text first needs them, and the
table starts anew when it is full.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice
from struct import Struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate

# Letters and numbers that Unicode 16 has and Python's Unicode 15.1 tables have not.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
]
NUMBERS_16 = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
]
# Unicode's White_Space.
SPACES = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]

#: Longest piece, in characters, whose ids are remembered.
MEMO_CHARS = 48
#: States after which the table starts anew, and recent pieces remembered, in each worker: about 0.4 GB.
MAX_STATES, MEMO_PIECES = 400_000, 220_000
#: The same where a worker's memory is shared with other stages: about 0.2 GB, a little slower.
SMALL_TABLES = (150_000, 80_000)
#: Texts over this length are split and decoded block by block.
LONG_TEXT, BLOCK_PIECES = 1 << 20, 1 << 16

ROOT = 0


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 and rank lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _class(prefix: str, more: list[tuple[int, int]]) -> str:
    have = {cp for a, b in more for cp in range(a, b + 1)}
    runs: list[list[int]] = []
    for cp in range(0x110000):
        if unicodedata.category(chr(cp))[0] == prefix or cp in have:
            if runs and runs[-1][1] == cp - 1:
                runs[-1][1] = cp
            else:
                runs.append([cp, cp])
    return _ranges(runs)


def _ranges(runs) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def compile_pattern(pattern: str) -> re.Pattern:
    r"""A pattern with \p{L}, \p{N} and \s as an ``re`` pattern of explicit classes."""
    letters, numbers, spaces = _class("L", LETTERS_16), _class("N", NUMBERS_16), _ranges(SPACES)
    inside = {r"\p{L}": letters, r"\p{N}": numbers, r"\s": spaces}
    out, depth, i = [], 0, 0
    while i < len(pattern):
        for name, members in inside.items():
            if pattern.startswith(name, i):
                out.append(members if depth else f"[{members}]")
                i += len(name)
                break
        else:
            if pattern.startswith(r"\S", i):
                out.append(f"[^{spaces}]")
                i += 2
                continue
            depth += {"[": 1, "]": -1}.get(pattern[i], 0)
            out.append(pattern[i])
            i += 1
    return re.compile("".join(out))


class Transducer:
    """Bytes of one piece to token ids, for a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = ROOT
            for b in token:
                nxt = self.child[node].get(b)
                if nxt is None:
                    nxt = self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = rank
        self._steps: dict[int, tuple[list, list]] = {}
        self._may: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # A state is a flat tuple of its items: last token, trie node, tokens held back, and so on.
        start = (-1, ROOT, ())
        self.states: list[tuple] = [start]
        self.number: dict[tuple, int] = {start: 0}
        self.arcs: dict[int, tuple[int, tuple]] = {}

    def _merges(self, token: int) -> tuple[list, list]:
        """The merges that build a token, in order: (rank, the symbol then at its right end) and the same for its left end; None ends a list whose token the merges don't build."""
        if token in self._steps:
            return self._steps[token]
        parts = [bytes([b]) for b in self.bytes_of[token]]
        right, left = [(-1, parts[-1])], [(-1, parts[0])]
        while len(parts) > 1:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1)), default=None)
            if best[0] == 1 << 40:
                right = left = None
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            right.append((best[0], parts[-1]))
            left.append((best[0], parts[0]))
        self._steps[token] = right, left
        return right, left

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the encoding of the joint bytes of ``a`` and ``b`` is [a, b] (of ``b`` alone for a = -1)."""
        key = a << 32 | b
        got = self._may.get(key)
        if got is None:
            if len(self._may) > 200_000:
                self._may.clear()
            got = self._may[key] = self._border_stays(a, b)
        return got

    def _border_stays(self, a: int, b: int) -> bool:
        ours = self._merges(b)[1]
        if ours is None:
            return False
        if a < 0:
            return True
        theirs = self._merges(a)[0]
        i = j = 0
        never = 1 << 40
        while True:
            next_a = theirs[i + 1][0] if i + 1 < len(theirs) else never
            next_b = ours[j + 1][0] if j + 1 < len(ours) else never
            across = self.ranks.get(theirs[i][1] + ours[j][1], never)
            # Equal ranks merge from left to right: inside a, across the border, inside b.
            if across < next_a and across <= next_b and across < never:
                return False
            if next_a == never and next_b == never:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def _arc(self, state: int, byte: int) -> tuple[int, tuple]:
        """The state that a byte leads to, made if it is new, and the tokens that all its items agree on."""
        items, done, child, token_at, key = [], None, self.child, self.token_at, self.states[state]
        for i in range(0, len(key), 3):
            nxt = child[key[i + 1]].get(byte)
            if nxt is None:
                continue
            token = token_at[nxt]
            if done is None and token >= 0 and self.may_follow(key[i], token):
                done = (token, ROOT, (*key[i + 2], token))
            if child[nxt]:
                items += (key[i], nxt, key[i + 2])
        if done is None:
            raise ValueError(f"no token ends with byte {byte}")
        items += done
        first, agreed, held = items[2], 0, items[2::3]
        for token in first:
            if any(len(x) <= agreed or x[agreed] != token for x in held):
                break
            agreed += 1
        if agreed:
            items[2::3] = [x[agreed:] for x in held]
        key = tuple(items)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        hop = self.arcs[state << 8 | byte] = (number, first[:agreed])
        return hop

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self._reset()
        look, state, out = self.arcs.get, 0, []
        for byte in piece:
            hop = look(state << 8 | byte)
            if hop is None:
                # Pieces are short, but one long piece must not fill the table either.
                if len(self.states) > 2 * self.max_states:
                    key = self.states[state]
                    self._reset()
                    look = self.arcs.get
                    state = self.number.setdefault(key, len(self.states))
                    if state == len(self.states):
                        self.states.append(key)
                hop = self._arc(state, byte)
            state, emit = hop
            if emit:
                out += emit
        out += self.states[state][-1]
        return out


class Utf8Stream:
    """An incremental UTF-8 machine: bytes in any cuts to text, whole code points only."""

    def __init__(self) -> None:
        self.rest = b""

    @staticmethod
    def _open_tail(data: bytes) -> int:
        """How many bytes at the end begin a code point that is not complete yet."""
        for back in range(1, min(4, len(data) + 1)):
            b = data[-back]
            if b & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 1
            return back if need > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        tail = self._open_tail(data)
        cut = len(data) - tail
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        """What is left; bytes that never became a code point turn into U+FFFD."""
        out, self.rest = self.rest.decode("utf-8", "replace"), b""
        return out


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_states: int = MAX_STATES, memo_pieces: int = MEMO_PIECES):
        self.transducer, self.pattern = Transducer(ranks, max_states), compile_pattern(pattern)
        self.token_bytes = [self.transducer.bytes_of.get(i, b"") for i in range(max(ranks.values(), default=-1) + 1)]
        self.memo = self._Memo(self.transducer, memo_pieces)

    class _Memo(dict):
        """Packed ids of the pieces seen lately; pieces in use outlive the clearing."""

        def __init__(self, transducer: Transducer, most: int):
            super().__init__()
            self.most, self.encode, self.before, self.pack = most, transducer.encode, {}, [Struct(f"<{n}I").pack for n in range(MEMO_CHARS)]

        def __missing__(self, piece: str) -> bytes:
            packed = self.before.get(piece)
            if packed is None:
                ids = self.encode(piece.encode("utf-8", "surrogatepass"))
                packed = self.pack[len(ids)](*ids) if len(ids) < MEMO_CHARS else np.array(ids, "<u4").tobytes()
                if len(piece) > MEMO_CHARS:
                    return packed
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[piece] = packed
            return packed

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; none for NULL."""
        if not text:
            return b""
        look = self.memo.__getitem__
        if len(text) <= LONG_TEXT:
            return b"".join(map(look, self.pattern.findall(text)))
        pieces = (m.group() for m in self.pattern.finditer(text))
        blocks = []
        while block := b"".join(map(look, islice(pieces, BLOCK_PIECES))):
            blocks.append(block)
        return b"".join(blocks)

    def decode_stream(self, ids: Iterable[np.ndarray]) -> Iterator[str]:
        """Text for arrays of ids, as it becomes complete."""
        machine, look = Utf8Stream(), self.token_bytes.__getitem__
        for block in ids:
            yield machine.feed(b"".join(map(look, block.tolist())))
        yield machine.close()

    def decode(self, ids: bytes) -> str:
        array = np.frombuffer(ids, "<u4")
        return "".join(self.decode_stream(array[i : i + BLOCK_PIECES] for i in range(0, len(array), BLOCK_PIECES)))


def codec(path: str, pattern: str, tables: tuple[int, int] = (MAX_STATES, MEMO_PIECES)) -> Codec:
    """The codec of a rank file."""
    return Codec(read_ranks(path), pattern, *tables)


FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]


def encode_documents(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, tables: tuple[int, int] = (MAX_STATES, MEMO_PIECES)) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Adds ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers) and
    ``decoded``. NULL and empty texts have no tokens and decode to "". Repeated
    rows each get their result; an empty table gives an empty one; input columns
    named like an output give way to it. No shuffle: each task reads its rows and
    holds a few MB of them at a time. ``tables`` bounds the transducer's states
    and the pieces remembered; results don't depend on it.

    ``path`` must be readable on every executor (the rank files are installed
    with the interpreter).
    """

    def make():
        own = codec(path, pattern, tables)

        def apply(texts):
            ids = [own.encode(t) for t in texts]
            return {"n_tokens": [len(x) // 4 for x in ids], "ids": pa.array(ids, pa.binary()), "decoded": [own.decode(x) for x in ids]}

        return apply

    return annotate(df, make, FIELDS, text_col, keep)


def decode_documents(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Stream-decode a column of packed ids; adds ``decoded``, "" for NULL."""

    def make():
        own = codec(path, pattern)
        return lambda packed: {"decoded": [own.decode(x or b"") for x in packed]}

    return annotate(df, make, FIELDS[2:], ids_col, keep)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes, for all documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))
