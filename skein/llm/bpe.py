"""Byte-level BPE by a lazily determinised finite-state transducer.

Reading a piece from the left, each prefix has one last token (two tokens may
stand side by side exactly if merging their joined bytes gives them back), so the
next token can only start at positions from which the bytes read since then begin
a vocabulary entry. These starts, each with its bytes and the token before it, are
the transducer's state: a set of hypotheses, made a single state when first met
and kept with its transitions. A transition names the last token of the longer
prefix. Tokens on which all hypotheses agree are settled and leave the buffer, at
most the longest token's length behind the reader; at the end of a piece the
hypothesis that ends there settles the rest.

Decoding runs token by token through a UTF-8 state machine whose states are the
bytes of an unfinished character.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from skein.llm import common

# entries kept in a worker; what is dropped is computed again when needed
MAX_STATES = 300_000
MAX_PIECES = 400_000
MAX_PAIRS = 600_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


class MergeTransducer:
    """Encodes one piece (a match of the splitting pattern) at a time."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.prefixes = {t[:n] for t in ranks for n in range(1, len(t) + 1)}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forgets the determinised part; it grows anew from the texts that follow."""
        # hypothesis: (bytes since its start, token before its start or -1)
        start = ((b"", -1),)
        self.states: dict[tuple, int] = {start: 0}
        self.items: list[tuple] = [start]
        self.steps: dict[int, tuple[int, int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The definition: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        rank, none = self.ranks.get, len(self.ranks) + 1
        parts = [data[i : i + 1] for i in range(len(data))]
        joins = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while joins and (best := min(joins)) < none:
            at = joins.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joins[at]
            if at:
                joins[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(joins):
                joins[at] = rank(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether right may follow left (-1: the piece's start)."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            b = self.tokens[right]
            known = self.merge(b) == [right] if left < 0 else self.merge(self.tokens[left] + b) == [left, right]
            self.pairs[left, right] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, last token of the prefix that ends with this byte)."""
        one, live, ending = bytes((byte,)), [], []
        for seen, before in self.items[state]:
            now = seen + one
            if now in self.prefixes:
                live.append((now, before))
                if now in self.ranks:
                    ending.append((before, self.ranks[now]))
        # exactly one of them fits, so the last needs no test; earlier starts come first
        for before, token in ending[:-1]:
            if self.fits(before, token):
                break
        else:
            token = ending[-1][1]
        key = (*live, (b"", token))
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.items)
            self.items.append(key)
        self.steps[state << 8 | byte] = to, token
        return to, token

    def _back(self, last: list[int], end: int) -> list[int]:
        """Tokens from the buffer's start to position end."""
        out = []
        while end > 0:
            token = last[end - 1]
            out.append(token)
            end -= len(self.tokens[token])
        out.reverse()
        return out

    def _settled(self, last: list[int], state: int) -> int:
        """The last position that the tokenisations of all hypotheses pass."""
        chains = []
        for seen, _ in self.items[state]:
            at, chain = len(last) - len(seen), set()
            while at > 0:
                chain.add(at)
                at -= len(self.tokens[last[at - 1]])
            chains.append(chain)
        return max(set.intersection(*chains), default=0)

    def encode(self, piece: bytes, window: int = 1024) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:  # a piece that is a token is that token, reachable by merges or not
            return [whole]
        if len(self.items) > MAX_STATES:
            self.reset()
        out: list[int] = []
        last: list[int] = []
        state, steps = 0, self.steps
        for byte in piece:
            state, token = steps.get(state << 8 | byte) or self._step(state, byte)
            last.append(token)
            if len(last) >= window and (n := self._settled(last, state)):
                out += self._back(last, n)
                del last[:n]
        out += self._back(last, len(last))
        return out


#: Encoders of this worker by vocabulary and pattern; what one task has determinised serves the next.
_ENCODERS: dict[tuple[str, str], "Encoder"] = {}


def encoder_for(vocabulary: str, pattern: str) -> "Encoder":
    key = vocabulary, pattern
    if key not in _ENCODERS:
        gc.set_threshold(200_000, 50, 1000)  # many small lasting tuples, no cycles: rare collections save a fifth of the time
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(load_ranks(vocabulary), pattern)
    return _ENCODERS[key]


class Encoder:
    """Texts to ids: the pattern's matches, each through the transducer, with a bounded memory of frequent pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.split = regex.compile(pattern).findall
        self.transducer = MergeTransducer(ranks)
        # two generations: the older is dropped when the newer is full
        self.pieces: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.pieces
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.older.get(piece)
                if ids is None:
                    ids = self.transducer.encode(piece.encode())
                if len(piece) <= 64:
                    if len(known) >= MAX_PIECES:
                        self.older = known
                        known = self.pieces = {}
                    known[piece] = ids
            out += ids
        return out


def utf8_states() -> dict[bytes, dict[int, bytes | None]]:
    """Transitions of the UTF-8 machine: state (bytes of an unfinished character)
    and byte give the next state, b"" when a character ends. Missing: not UTF-8."""

    def lead(b: int) -> int:
        return 1 if b < 0x80 else 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0

    def first(b: int) -> range:
        return {0xE0: range(0xA0, 0xC0), 0xED: range(0x80, 0xA0), 0xF0: range(0x90, 0xC0), 0xF4: range(0x80, 0x90)}.get(b, range(0x80, 0xC0))

    class Lazy(dict):
        def __missing__(self, state: bytes) -> dict[int, bytes]:
            row = {}
            if not state:
                row = {b: b"" if lead(b) == 1 else bytes((b,)) for b in range(256) if lead(b)}
            else:
                last = lead(state[0]) == len(state) + 1
                row = {b: b"" if last else state + bytes((b,)) for b in (first(state[0]) if len(state) == 1 else range(0x80, 0xC0))}
            if len(self) < 100_000:
                self[state] = row
            return row

    return Lazy()


class StreamDecoder:
    """Ids to text, chunk by chunk; a character whose bytes span tokens or chunks waits until it is whole.

    Bytes that are no UTF-8 become U+FFFD, one for each byte that no character takes.
    """

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens = tokens
        self.machine = utf8_states()
        self.whole: dict[int, str | None] = {}
        self.state = b""

    def feed(self, ids: Iterable[int]) -> str:
        out: list[str] = []
        whole, state = self.whole, self.state
        for i in ids:
            if not state:
                text = whole.get(i, 0)
                if text == 0:
                    text = whole[i] = self._whole(i)
                if text is not None:
                    out.append(text)
                    continue
            state = self._through(self.tokens[i], state, out)
        self.state = state
        return "".join(out)

    def _whole(self, i: int) -> str | None:
        try:
            return self.tokens[i].decode()
        except UnicodeDecodeError:
            return None

    def _through(self, data: bytes, state: bytes, out: list[str]) -> bytes:
        for b in data:
            to = self.machine[state].get(b)
            if to is None and state:
                out.append("�" * len(state))
                state = b""
                to = self.machine[state].get(b)
            if to is None:
                out.append("�")
            elif to:
                state = to
            else:
                out.append((state + bytes((b,))).decode())
                state = b""
        return state

    def finish(self) -> str:
        rest, self.state = "�" * len(self.state), b""
        return rest


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit; only if with_ids),
    ids_sha256, decoded_sha256; one row per input row.

    vocabulary: a rank file that every executor can open. Null texts are empty
    texts (no ids); repeated rows and null ids give rows like any other; an empty
    table gives an empty one. Other columns are not read.
    """
    common.tune(docs.sparkSession)
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens long, " + "ids binary, " * with_ids + "ids_sha256 string, decoded_sha256 string"
    from pyspark.sql import functions as F

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = encoder_for(vocabulary, pattern)
        decoder = StreamDecoder(encoder.transducer.tokens)
        for batch in batches:
            n, ids_out, a, b = [], [], [], []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py() or "")
                packed = np.array(ids, dtype="<u4").tobytes()
                plain = decoder.feed(ids) + decoder.finish()
                n.append(len(ids))
                if with_ids:
                    ids_out.append(packed)
                a.append(hashlib.sha256(packed).hexdigest())
                b.append(hashlib.sha256(plain.encode()).hexdigest())
            cols = [batch.column(0), pa.array(n, pa.int64()), *([pa.array(ids_out, pa.binary())] if with_ids else []), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids", chunk: int = 4096) -> DataFrame:
    """doc_id, text from packed ids, decoded in chunks; null ids give null."""
    from pyspark.sql import functions as F

    common.tune(encoded.sparkSession)
    schema = f"doc_id {dict(encoded.dtypes)[id_col]}, text string"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        decoder = StreamDecoder({r: t for t, r in load_ranks(vocabulary).items()})
        for batch in batches:
            out = []
            for packed in batch.column(1):
                packed = packed.as_py()
                if packed is None:
                    out.append(None)
                    continue
                ids = np.frombuffer(packed, dtype="<u4").tolist()
                out.append("".join(decoder.feed(ids[k : k + chunk]) for k in range(0, len(ids), chunk)) + decoder.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, schema)
