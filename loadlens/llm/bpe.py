"""Byte-level BPE by a lazily determinised finite-state transducer.

The merges are compiled into a transducer over bytes. A state is the last token
emitted and the bytes read since; it is built when it is reached again. A prefix of the
input has one encoding, whose last token is the longest one ending there that is
compatible with the encoding before it. A token may still start at a position only
while the bytes from there on are the beginning of some vocabulary entry, so what
the encodings at all such positions have in common is final and is emitted: the
lookahead is at most the longest entry.

Nearly all pieces are short and rare ones seldom share a state. They are encoded by the
same relation of tokens that fit beside each other, but token by token: no states are made.

Decoding is a stream of token bytes through an incremental UTF-8 state machine that
keeps at most three bytes.

Edge cases: a null text counts as empty and has no tokens; a byte that is no entry of
its own raises. Extra columns are ignored, repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from loadlens.llm.common import worker_tables

Ranks = dict[bytes, int]

#: a worker's tables; with the vocabulary they take about 250 MB when full, and go when the worker counts or compares texts
MAX_STATES = 40_000
MAX_CACHED_PIECES = 250_000
SHORT_PIECE = 256  # bytes that are encoded as a whole; longer pieces move from state to state
BLOCK_PIECES = 65_536
LOOK = 4  # bytes that tell how long a token may be


def read_ranks(data: bytes) -> Ranks:
    """Lines of base64 token bytes and rank."""
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merge_all(piece: bytes, ranks: Ranks) -> list[bytes]:
    """The defining procedure: merge the adjacent pair of lowest rank until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@dataclass(eq=False, slots=True)
class State:
    """A token was emitted and some bytes, ``pending``, read since.

    ``last`` and ``back`` hold, for every prefix of these bytes, the last token of its
    encoding and where that token starts; ``live`` are the positions where a token that
    is still being read may start, with its node in the trie of tokens; ``flush`` ends
    the piece here.
    """

    pending: bytes
    last: tuple[int, ...]
    back: tuple[int, ...]
    live: tuple[tuple[int, dict], ...]
    flush: tuple[int, ...] = ()
    moves: dict[int, tuple[State, tuple[int, ...]]] = field(default_factory=dict)


_BYTES = [bytes((b,)) for b in range(256)]
_RANK = -1  # key of a trie node's own rank, beside the bytes that go on


class MergeTransducer:
    def __init__(self, ranks: Ranks, max_states: int = MAX_STATES):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.trie: dict = {}  # filled when a piece first needs a state
        self.longest: dict[bytes, int] = {}  # bytes of the longest token that begins with these, where that is longer
        for token in ranks:
            if len(token) >= LOOK and len(token) > self.longest.get(token[:LOOK], 0):
                self.longest[token[:LOOK]] = len(token)
        self.max_states = max_states
        self._fits: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int]] = {}
        self._reset()

    def _fill(self) -> None:
        for token, rank in self.ranks.items():
            node = self.trie
            for byte in token:
                node = node.setdefault(byte, {})
            node[_RANK] = rank

    def _reset(self) -> None:
        self.start = State(b"", (-1,), (0,), ((0, self.trie),))
        self.states = {(-1, b""): self.start}

    def halves(self, token: int) -> tuple[int, int]:
        """The pair whose merge makes the token; a token that merging never makes is its own pair."""
        pair = self._halves.get(token)
        if pair is None:
            whole = self.bytes_of[token]
            below = {}
            for n in range(len(whole)):
                for m in range(n + 1, len(whole) + 1):
                    rank = self.ranks.get(whole[n:m])
                    if rank is not None and rank != token:
                        below[whole[n:m]] = rank
            parts = merge_all(whole, below)
            pair = self._halves[token] = tuple(self.ranks[p] for p in parts) if len(parts) == 2 else (token, token)
        return pair

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens apart and whole; -1 is the start of the piece.

        Going down from the border, the merge across it that comes first decides.
        """
        known = self._fits.get(left << 24 | right)
        if known is not None:
            return known
        if len(self._fits) > 8 * self.max_states:
            self._fits.clear()
        if left < 0:
            whole = self.bytes_of[right]
            good = merge_all(whole, self.ranks) == [whole]
        else:
            a, b, limit, good = left, right, len(self.ranks) + 256, True
            while True:
                joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
                if joined is not None and joined < limit:
                    good = False
                    break
                if a > b:
                    limit, down = a, self.halves(a)[1]
                    if down != a:
                        a = down
                        continue
                    limit, down = b + 1, self.halves(b)[0]
                    if down == b:
                        break
                    b = down
                else:
                    limit, down = b + 1, self.halves(b)[0]
                    if down != b:
                        b = down
                        continue
                    limit, down = a, self.halves(a)[1]
                    if down == a:
                        break
                    a = down
        self._fits[left << 24 | right] = good
        return good

    def move(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """The state after ``byte`` and the tokens that are now final."""
        if not self.trie:
            self._fill()
        if len(self.states) > self.max_states:
            for old in self.states.values():
                old.moves.clear()  # states refer to each other; without that they go at once
            self._reset()
        last, token, begin, live = state.last, None, 0, []
        for at, node in state.live:  # the longest token first
            node = node.get(byte)
            if node is None:
                continue
            if token is None and _RANK in node:
                rank = node[_RANK]
                fits = self._fits.get(last[at] << 24 | rank)
                if self.fits(last[at], rank) if fits is None else fits:
                    token, begin = rank, at
            if len(node) > (_RANK in node):
                live.append((at, node))
        if token is None:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        end = len(last)
        last, back = (*last, token), (*state.back, begin)
        # the latest position that the encodings at all live positions have in common
        final = end
        for at, _ in live:
            while at != final:
                if at > final:
                    at = back[at]
                else:
                    final = back[final]
        emitted, at = [], final
        while at:
            emitted.append(last[at])
            at = back[at]
        rest = (state.pending + _BYTES[byte])[final:]
        following = self.states.get((last[final], rest))
        if following is None:
            flush, at = [], end
            while at > final:
                flush.append(last[at])
                at = back[at]
            flush.reverse()
            if final:
                back = (0, *[x - final if x > final else 0 for x in back[final + 1 :]])
                live = [(at - final, node) for at, node in live if at >= final]
            live.append((end - final, self.trie))
            following = self.states[last[final], rest] = State(rest, last[final:], back, tuple(live), tuple(flush))
        emitted.reverse()
        found = state.moves[byte] = following, tuple(emitted)
        return found

    def rest(self, state: State, tail: bytes) -> list[int]:
        """The tokens after ``state`` of a piece that ends with ``tail``, storing nothing.

        The encoding is the only chain of tokens that all fit beside each other: the longest
        token that fits goes on, and where none does, the one before it is made shorter.
        """
        data, first = state.pending + tail, state.last[0]
        ranks, known, longest, size = self.ranks, self._fits, self.longest, len(data)
        tokens: list[int] = []
        begins: list[int] = []
        dead: set[int] = set()  # a prefix has one encoding, so that no other way leads on from its end
        at, last, end = 0, first, longest.get(data[:LOOK], LOOK - 1)
        while at < size:
            if end > size:
                end = size
            while end > at:
                rank = ranks.get(data[at:end])
                if rank is not None and end not in dead:
                    fits = known.get(last << 24 | rank)
                    if self.fits(last, rank) if fits is None else fits:
                        break
                end -= 1
            else:
                if not tokens:
                    raise ValueError(f"no tokens for {data!r}: a byte is not in the vocabulary")
                dead.add(at)
                end, at = at - 1, begins.pop()
                tokens.pop()
                last = tokens[-1] if tokens else first
                continue
            tokens.append(rank)
            begins.append(at)
            at, last = end, rank
            end += longest.get(data[end : end + LOOK], LOOK - 1)
        return tokens

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Tokens of a piece: short ones token by token, long ones byte by byte through the states."""
        if len(piece) <= SHORT_PIECE:
            return tuple(self.rest(self.start, piece))
        state, out = self.start, []
        for byte in piece:
            state, emitted = state.moves.get(byte) or self.move(state, byte)
            if emitted:
                out += emitted
        return (*out, *state.flush)


class Utf8Machine:
    """Turns chunks of bytes into text; a character cut by a chunk's end waits for the next one."""

    def __init__(self) -> None:
        self.waiting = b""

    def feed(self, chunk: bytes) -> str:
        data = self.waiting + chunk
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:  # a leading byte: are its followers here?
                if (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) > back:
                    cut -= back
                break
            if lead < 0x80:
                break
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


class PieceCache(dict):
    """The ids of pieces seen before. When half full they become the older ones, of which those met again stay."""

    def __init__(self, transducer: MergeTransducer, limit: int):
        super().__init__()
        self.transducer, self.limit = transducer, limit
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.transducer.encode(piece.encode())
        if len(piece) <= 64:
            if 2 * len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Tokenizer:
    """A transducer with the pattern that splits text first, and a bounded cache of pieces."""

    def __init__(self, ranks: Ranks, pattern: str, cached: int = MAX_CACHED_PIECES):
        self.transducer = MergeTransducer(ranks)
        self.token_bytes = self.transducer.bytes_of
        self.names = {rank: str(rank) for rank in self.token_bytes}
        self.pattern = regex.compile(pattern)
        self.pieces = PieceCache(self.transducer, cached)

    def encode_blocks(self, text: str) -> Iterator[list[int]]:
        """Ids in blocks, so that a very long text is never held as one list."""
        if len(text) <= BLOCK_PIECES:
            yield self._block(self.pattern.findall(text))
            return
        matches = (m.group() for m in self.pattern.finditer(text))
        while block := list(islice(matches, BLOCK_PIECES)):
            yield self._block(block)

    def _block(self, pieces: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_blocks(text)))

    def decode_stream(self, blocks: Iterable[list[int]]) -> Iterator[str]:
        machine = Utf8Machine()
        for block in blocks:
            yield machine.feed(b"".join(map(self.token_bytes.__getitem__, block)))
        yield machine.end()


def tokenizer_of(data: bytes, pattern: str) -> Tokenizer:
    """One tokenizer for each vocabulary and Python worker; its tables serve all its tasks in a row."""
    key = hashlib.sha256(data).hexdigest(), pattern
    if key not in worker_tables:
        worker_tables[key] = Tokenizer(read_ranks(data), pattern)
    return worker_tables[key]


_BATCH_BYTES = 1 << 21  # of text whose ids are held at once; a longer text is a batch of its own


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch by the bytes of its last column, the text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()
    begin = held = 0
    for at, size in enumerate(sizes):
        if at > begin and (held + size > _BATCH_BYTES or at - begin == 1000):
            yield batch.slice(begin, at - begin)
            begin, held = at, 0
        held += size
    yield batch.slice(begin)


def encode_documents(
    documents: DataFrame, vocabulary: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = True
) -> DataFrame:
    """Encode the column ``text`` and decode the ids again.

    Returns the columns ``keep``, ``n_tokens``, ``ids_sha256`` (of the decimal ids
    joined by commas), ``decoded_sha256`` (of the decoded text in UTF-8) and, with
    ``ids``, the ids. The vocabulary file is read by the driver and sent to the
    executors: its size is fixed by the tokenizer.
    """
    with open(vocabulary, "rb") as file:
        sent = documents.sparkSession.sparkContext.broadcast(file.read())
    kept = documents.select(*keep, "text")
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in kept.select(*keep).dtypes)
    schema = f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(sent.value, pattern)
        # the collector would walk all states and pieces again and again, and free nothing
        collecting = gc.isenabled()
        gc.disable()
        try:
            yield from encode_all(tokenizer, batches)
        finally:
            if collecting:
                gc.enable()

    def encode_all(tokenizer: Tokenizer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = tokenizer.names
        for whole in batches:
            for batch in _slices(whole):
                counts, id_hashes, text_hashes, lists = [], [], [], []
                for text in batch.column(batch.num_columns - 1):
                    text = text.as_py() or ""
                    id_hash, text_hash, machine = hashlib.sha256(), hashlib.sha256(), Utf8Machine()
                    n, own = 0, []
                    for block in tokenizer.encode_blocks(text):
                        joined = ",".join([names[x] for x in block])
                        id_hash.update((("," if n and block else "") + joined).encode())
                        decoded = machine.feed(b"".join([tokenizer.token_bytes[x] for x in block]))
                        text_hash.update(decoded.encode())
                        n += len(block)
                        if ids:
                            own.append(pa.array(block, pa.int32()))
                    text_hash.update(machine.end().encode())
                    counts.append(n)
                    id_hashes.append(id_hash.hexdigest())
                    text_hashes.append(text_hash.hexdigest())
                    lists += own if len(own) == 1 else [pa.concat_arrays(own)] if own else []
                columns = [batch.column(i) for i in range(batch.num_columns - 1)]
                columns += [pa.array(counts, pa.int64()), pa.array(id_hashes), pa.array(text_hashes)]
                fields = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    ends = list(chain([0], counts))
                    for i in range(1, len(ends)):
                        ends[i] += ends[i - 1]
                    flat = pa.concat_arrays(lists) if lists else pa.array([], pa.int32())
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
                    fields.append("ids")
                yield pa.RecordBatch.from_arrays(columns, fields)

    return kept.mapInArrow(run, schema)
