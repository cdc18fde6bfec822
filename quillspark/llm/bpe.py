"""Byte-level BPE by a lazily determinised transducer, and streaming decoding."""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import read, sole_cache

#: Bounds of a worker's memory. Past MAX_MOVES no further moves are made deterministic, past MAX_PAIRS that store is emptied;
#: of pieces, the last MAX_PIECES new ones and as many before them are kept, and those used again.
MAX_MOVES, MAX_PIECES, MAX_PIECE_BYTES, MAX_PAIRS = 30_000, 200_000, 64, 300_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from the lines ``base64-token rank`` of a vocabulary file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge_bytes(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """Plain BPE: of all neighbours whose union is a token, join the lowest rank first, the leftmost of equals."""
    get, none = ranks.get, 1 << 60
    parts = [piece[i : i + 1] for i in range(len(piece))]
    joint = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while joint and (low := min(joint)) != none:
        i = joint.index(low)
        parts[i] += parts.pop(i + 1)
        del joint[i]
        if i < len(joint):
            joint[i] = get(parts[i] + parts[i + 1], none)
        if i:
            joint[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


class Transducer:
    """Maps the bytes of a piece to its BPE tokens from left to right.

    A sequence of tokens is the BPE of its bytes exactly when each neighbouring pair is the BPE of the pair's bytes. So
    the BPE of every prefix ends in the one token that follows legally on the BPE of what stands before it. The
    nondeterministic machine keeps, for each earlier position from which the bytes read since still begin a token, the
    BPE up to there; reading a byte closes exactly one of them. A deterministic state is that set, written as the last
    token emitted and, for each position, the vocabulary prefix read since and the tokens not yet emitted. Tokens that
    all positions share are emitted and leave the state, so the lookahead stays bounded. States and their moves are
    made when first met, up to MAX_MOVES; a piece that needs more runs the same machine without determinising it.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token_of[rank] = token
        self.prefixes = {token[:i] for token in ranks for i in range(1, len(token))}
        self.longest = max(map(len, ranks), default=0)
        self.pairs: dict[int, bool] = {}
        self.proper: dict[int, bool] = {}
        self.names: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.start = self._state((None, ((b"", ()),)))

    def _state(self, key: tuple) -> int:
        if key not in self.names:
            self.names[key] = len(self.states)
            self.states.append(key)
        return self.names[key]

    def follows(self, a: int | None, b: int) -> bool:
        """Whether token b may stand after token a (None: at the start of a piece)."""
        if a is None:
            if b not in self.proper:
                self.proper[b] = merge_bytes(self.ranks, self.token_of[b]) == [b]
            return self.proper[b]
        if (known := self.pairs.get(a << 32 | b)) is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = merge_bytes(self.ranks, self.token_of[a] + self.token_of[b]) == [a, b]
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, live = self.states[state]
        grown, closed = [], None
        for read_, pending in live:
            text = read_ + bytes((byte,))
            token = self.ranks.get(text)
            if closed is None and token is not None and self.follows(pending[-1] if pending else last, token):
                closed = (b"", (*pending, token))
            if text in self.prefixes:
                grown.append((text, pending))
        if closed is None:
            raise ValueError("the vocabulary lacks a single byte")
        grown.append(closed)
        shared = 0
        while all(len(p) > shared and p[shared] == grown[0][1][shared] for _, p in grown):
            shared += 1
        out = grown[0][1][:shared]
        key = (out[-1] if out else last, tuple((text, p[shared:]) for text, p in grown))
        move = self.moves[state << 8 | byte] = (self._state(key), out)
        return move

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        state, out = self.start, []
        for byte in piece:
            try:
                state, emitted = self.moves[state << 8 | byte]
            except KeyError:
                if len(self.moves) >= MAX_MOVES:
                    return self.simulate(piece)
                state, emitted = self._move(state, byte)
            if emitted:
                out += emitted
        out += self.states[state][1][-1][1]  # the position at the end of what was read
        return out


    def simulate(self, piece: bytes) -> list[int]:
        """The same machine without determinising, depth first: the longest legal token goes on, and a position and
        token from which no legal sequence reaches the end is left for good."""
        get, follows, known, size = self.ranks.get, self.follows, self.pairs.get, len(piece)
        out: list[int] = []
        at, last, tried = 0, None, 0  # tried: the length of the last token tried here, 0 for none
        dead: set[tuple[int, int | None]] = set()
        while at < size:
            for n in range(tried - 1 if tried else min(self.longest, size - at), 0, -1):
                token = get(piece[at : at + n])
                if token is None:
                    continue
                legal = None if last is None else known(last << 32 | token)
                if (follows(last, token) if legal is None else legal) and (not dead or (at + n, token) not in dead):
                    out.append(token)
                    at, last, tried = at + n, token, 0
                    break
            else:
                dead.add((at, last))
                tried = len(self.token_of[out.pop()])
                at -= tried
                last = out[-1] if out else None
        return out


class Decoder:
    """Streaming decoder: tokens in any portions to text, never splitting a character.

    An incremental UTF-8 machine keeps its state between portions: the one to three bytes of a character begun. Bytes that
    are no UTF-8 become U+FFFD.
    """

    def __init__(self, token_of: list[bytes]):
        self.token_of, self.machine = token_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join([self.token_of[i] for i in ids]))

    def close(self) -> str:
        return self.machine.decode(b"", final=True)


class Codec:
    """Encodes texts as the tiktoken library does without special tokens, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _ids(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = tuple(self.transducer.encode(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= MAX_PIECE_BYTES:
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if len(self.pieces) > MAX_PIECES:
            self.pieces, self.older = {}, self.pieces
        out: list[int] = []
        pieces, extend = self.pieces, out.extend
        for piece in self.split(text):
            try:
                extend(pieces[piece])
            except KeyError:
                extend(self._ids(piece))
        return out

    def decode_chunks(self, ids: list[int], chunk: int = 1 << 16) -> Iterator[str]:
        decoder = Decoder(self.transducer.token_of)
        for i in range(0, len(ids), chunk):
            yield decoder.feed(ids[i : i + chunk])
        yield decoder.close()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(data: bytes, pattern: str) -> Codec:
    """This worker's codec for a vocabulary; kept between tasks."""
    name = (hashlib.sha256(data).hexdigest(), pattern)
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(parse_ranks(data), pattern)
    return _codecs[name]


def vocabulary(path: str | None = None, pattern: str | None = None) -> tuple[bytes, str]:
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        return file.read(), pattern or public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, ids: bool = True) -> DataFrame:
    """Token ids of every whole text, and digests of the ids and of the bytes they decode to.

    Returns (id, [ids array<int>,] n_tokens, ids_sha256, decoded_sha256). The vocabulary is read on the driver and
    broadcast; it has about 1 MB whatever the input. Null text counts as empty: no tokens. Repeated rows give repeated
    rows; an empty table an empty result. Texts are encoded one at a time, so memory follows the longest text. Other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache("bpe", _codecs.clear)
        coder = codec(*shared.value)
        decimal = [str(i) for i in range(len(coder.transducer.token_of))]
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                tokens, counts, digests, decoded = [], [], [], []
                for text in part.column(1).to_pylist():
                    out = coder.encode(text or "")
                    back = hashlib.sha256()
                    for piece in coder.decode_chunks(out):
                        back.update(piece.encode())
                    if ids:
                        tokens.append(np.array(out, np.int32))
                    counts.append(len(out))
                    digests.append(hashlib.sha256(",".join([decimal[k] for k in out]).encode()).hexdigest())
                    decoded.append(back.hexdigest())
                columns = [part.column(0), *([pa.array(tokens, pa.list_(pa.int32()))] if ids else []), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)[id_col]
    names = ["id", *["ids"] * ids, "n_tokens", "ids_sha256", "decoded_sha256"]
    schema = f"id {kind}, {'ids array<int>, ' * ids}n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    out = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), ids=False)
