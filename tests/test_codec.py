import random

import pytest

from siftwell.functions.codec import BadPostings, decode, encode

GOLDEN = [(0, [0]), (1, [0, 2]), (2, [1])]


def test_golden_bytes():
    assert list(encode(GOLDEN)) == [3, 0, 1, 0, 1, 2, 0, 2, 1, 1, 1] and decode(encode(GOLDEN)) == GOLDEN


def test_round_trips():
    r = random.Random(1)
    for _ in range(200):
        docs = sorted(r.sample(range(2**32), r.randrange(6)))
        some = [(d, sorted(r.sample(range(r.choice([10, 2**31])), r.randrange(1, 5)))) for d in docs]
        data = encode(some)
        assert decode(data) == some
        for cut in range(len(data)):
            with pytest.raises(BadPostings):
                decode(data[:cut])


@pytest.mark.parametrize("data", [b"", b"\x01", b"\x00\x00", b"\x02\x00\x01\x00\x00\x01\x00", b"\x01\x00\x00", b"\x01\x00\x02\x00\x00", b"\x7f\x00\x01\x00", b"\x01" + b"\xff" * 10 + b"\x01", b"\x01\xff\xff\xff\xff\x7f\x01\x00", encode(GOLDEN) + b"\x00"])
def test_refuses(data):
    with pytest.raises(BadPostings):
        decode(data)


@pytest.mark.parametrize("bad", [[(1, [0]), (1, [0])], [(2, [0]), (1, [0])], [(0, [])], [(0, [1, 1])], [(2**32, [0])]])
def test_does_not_write(bad):
    with pytest.raises(BadPostings):
        encode(bad)
