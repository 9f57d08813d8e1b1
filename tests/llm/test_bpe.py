import hashlib
import weakref

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loadlens.llm import bpe, common
from tests.llm.cases import AWKWARD

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
with open(PATH, "rb") as _file:
    RANKS = bpe.read_ranks(_file.read())
OURS = bpe.Tokenizer(RANKS, public_tokenizers.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_ids_equal_the_library(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_transducer_equals_the_defining_merges(piece):
    assert [OURS.token_bytes[i] for i in OURS.transducer.encode(piece)] == bpe.merge_all(piece, RANKS)


def test_long_pieces_few_states_and_small_cache():
    small = bpe.Tokenizer(RANKS, public_tokenizers.PATTERN, cached=3)
    small.transducer.max_states = 20
    for text in ("a" * 3000, " " * 3000, "thethe" * 400, "中文字" * 300, "aAbB1 " * 300, "\r\n \t" * 200):
        assert small.encode(text) == THEIRS.encode_ordinary(text)


def test_lookahead_is_bounded():
    state, machine = OURS.transducer.start, OURS.transducer
    for byte in b"internationalisation" * 50:
        state, _ = state.moves.get(byte) or machine.move(state, byte)
        assert len(state.pending) <= 2 * max(map(len, RANKS))


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.integers(1, 7))
def test_utf8_machine_equals_decoding_at_once_where_valid(data, step):
    text = data.decode("utf-8", "ignore")
    whole, machine = text.encode(), bpe.Utf8Machine()
    parts = [machine.feed(whole[i : i + step]) for i in range(0, len(whole), step)]
    assert "".join(parts) + machine.end() == text
    machine = bpe.Utf8Machine()
    for i in range(0, len(data), step):
        machine.feed(data[i : i + step])
        assert len(machine.waiting) <= 3


def test_awkward_rows(spark, docs):
    rows = bpe.encode_documents(docs(AWKWARD), PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(AWKWARD)
    want = sorted((str(i), THEIRS.encode_ordinary(t or ""), t or "") for i, t in AWKWARD)
    got = sorted(rows, key=lambda r: (str(r["doc_id"]), r["ids"]))
    for (key, ids, text), r in zip(want, got, strict=True):
        assert (key, ids) == (str(r["doc_id"]), r["ids"]) and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(docs(AWKWARD).where("false"), PATH, public_tokenizers.PATTERN).count() == 0


def test_short_pieces_make_no_states():
    machine = bpe.MergeTransducer(RANKS)
    pieces = [" andrentshble", "thethethe", "x" * bpe.SHORT_PIECE, "中文字", "aAbB1"]
    for piece in pieces:
        assert list(machine.encode(piece.encode())) == THEIRS.encode_ordinary(piece)
    assert len(machine.states) == 1 and not machine.start.moves
    long = b"internationalisation" * 50
    state, out = machine.start, []
    for byte in long:
        state, emitted = machine.move(state, byte)
        out += emitted
    assert [*out, *state.flush] == list(machine.encode(long)) == machine.rest(machine.start, long)


def test_pieces_met_again_stay_when_the_cache_is_full():
    small, encoded = bpe.Tokenizer(RANKS, public_tokenizers.PATTERN, cached=20), []
    given = small.transducer.encode
    small.transducer.encode = lambda piece: encoded.append(piece) or given(piece)
    for i in range(100):
        small.encode(f" often{chr(97 + i % 26)}{chr(97 + i // 26)}")
        small.encode(" often")
        assert len(small.pieces) <= 10 and len(small.pieces.older) <= 10
    assert encoded.count(b" often") == 1


def test_the_trie_is_made_when_a_piece_needs_states():
    machine = bpe.MergeTransducer(RANKS)
    machine.encode(b"short")
    assert not machine.trie
    long = b"internationalisation" * 50
    assert list(machine.encode(long)) == THEIRS.encode_ordinary(long.decode()) and machine.trie


def test_other_work_frees_the_tables():
    with open(PATH, "rb") as file:
        data = file.read()
    made = bpe.tokenizer_of(data, public_tokenizers.PATTERN)
    assert bpe.tokenizer_of(data, public_tokenizers.PATTERN) is made
    made.encode("internationalisation" * 50)
    gone = weakref.ref(made.transducer)
    del made
    common.free_worker()
    assert gone() is None and not common.worker_tables
