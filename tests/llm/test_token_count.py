import random

import public_tokenizers
import sentencepiece
from cases import SMALL, empty, given, odd, odd_rows, pairs

from apexline.llm import token_count
from apexline.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def brute(rows):
    found = [(i, len(t.encode()), len(LIBRARY.encode(t))) for i, t in pairs(rows)]
    return sorted([(i, n, k, k > 4096) for i, n, k in found], key=str)


def test_whole_table(spark):
    got = [tuple(r) for r in QUERIES["op8_token_count"](spark, SMALL).collect()]
    assert sorted(got, key=str) == brute(given("documents", columns="doc_id, text"))


def test_odd_rows(spark):
    got = [tuple(r) for r in token_count.count_tokens(odd(spark), PATH).collect()]
    assert sorted(got, key=str) == brute(odd_rows())
    assert token_count.count_tokens(empty(spark), PATH).count() == 0


def test_random_texts_against_the_library():
    counter, draw = token_count.Counter(PATH), random.Random(5)
    pieces = list(counter.ranks)
    letters = "ab  tionéß1 2._-'\"\n\t▁日本🙂 AÎ()\x00x0he in²"
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))
        text += "".join(draw.choice(pieces) for _ in range(draw.randint(0, 4))).replace("▁", " ")
        assert counter.count(text) == len(LIBRARY.encode(text)), repr(text)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_count, "REMEMBERED", 3)
    counter = token_count.Counter(PATH)
    text = "one two three four five six seven one two"
    assert counter.count(text) == len(LIBRARY.encode(text)) and len(counter.known) <= 3
