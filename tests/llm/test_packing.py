import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import SMALL, empty, given, odd, odd_rows
from tokenizers import Tokenizer

from apexline.llm import packing
from apexline.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def check(got, rows):
    """Every id in exactly one piece, no gaps and no overflow; the pieces are the library's ids."""
    ids = {}
    copies = defaultdict(int)
    for doc, text in ((r[0], r[1] or "") for r in rows):
        ids[doc] = LIBRARY.encode(text, add_special_tokens=False).ids + [2]
        copies[doc] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(piece) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(piece.tobytes()) == r.ids_crc32
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        times = np.zeros(len(ids[doc]), int)
        for r in pieces:
            times[r.start : r.start + r.length] += 1
        assert (times == copies[doc]).all()
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    return sum(r.length for r in got) / (4096 * max(1, len(by_sequence)))


def test_whole_table(spark):
    got = QUERIES["op7_packing"](spark, SMALL).collect()
    assert check(got, given("documents", columns="doc_id, text")) > 0.95


def test_odd_rows(spark):
    check(packing.pack(odd(spark), PATH).collect(), odd_rows())
    assert packing.pack(empty(spark), PATH).count() == 0


def test_random_texts_against_the_library():
    encoder, draw = packing.Encoder(PATH), random.Random(6)
    letters = "ab  tionéß1 2._-'\"\n\t日🙂 AÎÀÿ()0he in'sTM'LL\xa0\x1c"
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))
        text += draw.choice(["", "", "<|endoftext|>", "a<|startoftext|>b"])
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want, repr(text)


@pytest.mark.parametrize("seed", range(5))
def test_differencing(seed):
    draw = random.Random(seed)
    lengths = [draw.randint(1, 512) for _ in range(draw.randint(1, 400))]
    groups = packing.packed(lengths, 4096)
    assert sorted(k for g in groups for k in g) == list(range(len(lengths)))
    sums = [sum(lengths[k] for k in g) for g in groups]
    assert max(sums) <= 4096
    # Near-equal: the sums differ by less than the largest piece.
    assert max(sums) - min(sums) <= 512


def test_windows_rise_when_capacity_is_exceeded():
    assert len(packing.packed([6, 6, 6], 10)) == 3  # two windows would hold the sum
    assert packing.packed([], 10) == []
