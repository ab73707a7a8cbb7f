import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from roundledger.llm.packing import TOKENIZER, WordIds, first_fit, pack, pack_documents
from roundledger.llm.packing import token_pieces
from roundledger.llm.shared import stored
from tests.llm.tables import awkward, docs, empty

CODER = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
CODER.encode_special_tokens = True


def whole_ids(text):
    return CODER.encode(text or "", add_special_tokens=False).ids + [2]


def plain_first_fit(lengths, capacity):
    room, placed = [], []
    for length in lengths:
        for i, left in enumerate(room):
            if left >= length:
                break
        else:
            i = len(room)
            room.append(capacity)
        placed.append((i, capacity - room[i]))
        room[i] -= length
    return placed


@given(st.lists(st.integers(1, 50), max_size=80))
def test_tournament_equals_plain_first_fit(lengths):
    assert first_fit(lengths, 50) == plain_first_fit(lengths, 50)


@settings(max_examples=300)
@given(st.text(alphabet=st.characters(codec="utf-8") | st.sampled_from(" .,!'stÉéÉß"), max_size=30))
def test_words_give_the_ids_of_whole_texts(text):
    memo = WordIds(CODER, 1000)
    joined = b"".join(memo[w] for w in text.encode().lower().split())
    assert np.frombuffer(joined, "<u4").tolist() == whole_ids(text)[:-1]


def test_round_trip_and_gapless_sequences(spark):
    table = awkward(spark)
    rows = pack_documents(table).collect()
    pieces, sequences = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= 4096
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    long = next(r for r in table.collect() if r.doc_id == 4)
    assert [i for _, ids in sorted(pieces[4, len(whole_ids(long.text))]) for i in ids] == whole_ids(
        long.text
    )
    total = sum(len(whole_ids(r.text)) for r in table.collect())
    assert sum(r.length for r in rows) == total


def test_groups_are_packed_apart_and_reruns_agree(spark):
    table = docs(spark, [(i, "word " * (1 + i * 7 % 900), "en", "a") for i in range(400)])
    pieces = stored(token_pieces(table).drop("ids"), "test-pieces")
    once = sorted(pack(pieces, group_pieces=50).collect())
    assert once == sorted(pack(pieces.repartition(5), group_pieces=50).collect())
    assert len({r.sequence_id >> 32 for r in once}) > 3
    filled = sum(r.length for r in once) / (4096 * len({r.sequence_id for r in once}))
    assert filled > 0.9


def test_empty_table_and_crc(spark):
    assert pack_documents(empty(spark)).collect() == []
    row = pack_documents(docs(spark, [(1, None, None, None)])).collect()[0]
    assert (row.length, row.offset, bytes(row.ids)) == (1, 0, b"\x02\0\0\0")
    assert zlib.crc32(row.ids) == zlib.crc32(np.array([2], "<u4").tobytes())
