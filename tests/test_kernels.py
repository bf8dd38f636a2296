"""Golden vectors and properties of the codec kernels."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bitloom.operators import kernels as K


@pytest.mark.parametrize(
    ("data", "payload", "padding"),
    [(b"", "0000", 0), (b"AAAA", "0001410000000400", 4), (b"AAABBC", "00034100000003420000000243000000011f00", 7)],
)
def test_huffman_golden(data, payload, padding):
    assert K.huffman_encode(data) == (bytes.fromhex(payload), padding)
    assert K.huffman_decode(bytes.fromhex(payload), padding) == data


@pytest.mark.parametrize(("data", "payload"), [(b"", "0000000000"), (b"AA", "00000002045060"), (b"TOBEORNOTTOBE", "00000009015514f284515548539550d3ce8a")])
def test_lz78_golden(data, payload):
    assert K.lz78_encode(data) == (bytes.fromhex(payload), 0)
    assert K.lz78_decode(bytes.fromhex(payload)) == data


def test_chained_golden():
    assert K.chained_encode(b"") == (bytes.fromhex("0001000000000500"), 3)
    assert K.huffman_codes(K.counts_of(b"AAABBC")) == {65: "0", 66: "11", 67: "10"}


def test_picture_golden():
    assert K.rle_encode(np.array([7, 7, 7, 9], np.uint8)).hex() == "000000040000000200070003090001"
    assert K.rle_encode(np.array([], np.uint8)) == bytes(9)
    p = np.array([[[1, 2, 3], [4, 5, 6]]], np.uint8)
    assert K.image_encode(p, bits=4).hex() == "000000010000000203040000000600000001000000" + "06"
    assert K.image_decode(K.image_encode(p)).tolist() == p.tolist()
    assert K.png(p)[:8] == b"\x89PNG\r\n\x1a\n"


def test_wave_golden():
    p, pad = K.pcm_encode(np.array([-1, -0.5, 0, 0.5, 1], np.float32), 1, 2)
    assert (p.hex(), pad) == ("bf8000003f8000001bc0", 6)
    assert K.pcm_decode(p, pad, 2, 5).tolist() == [-0.75, -0.25, 0.25, 0.75, 0.75]
    x = np.array([0.1, 0.6, 0.6, -1], np.float32)
    p, pad = K.dm_encode(x, 0.25)
    assert (p.hex(), pad) == ("00000000e0", 4)
    assert K.dm_decode(p, pad, 0.25, 4).tolist() == [0.25, 0.5, 0.75, 0.5]
    p, pad = K.adm_encode(x, 0.25, 2.0)
    assert (p.hex(), pad) == ("00000000e0", 4)
    assert K.adm_decode(p, pad, 0.25, 4, 2.0).tolist() == [0.25, 0.5, 1.0, 0.0]
    p, pad = K.dpcm_encode(np.array([0.3, 0.3, -1], np.float32), 4, 1.0)
    assert (p.hex(), pad) == ("9730", 4)
    assert K.dpcm_decode(p, pad, 4, 1.0, 3).tolist() == [0.375, 0.25, -0.875]


def test_simulator_golden():
    _, tokens = K.sim_lz78("TOBEORNOTTOBE")
    assert [(r, c) for _, r, c in tokens] == [(0, "T"), (0, "O"), (0, "B"), (0, "E"), (2, "R"), (0, "N"), (2, "T"), (1, "O"), (3, "E")]


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=400), st.lists(st.sampled_from([0, 65, 255]), max_size=600).map(bytes)))
def test_lossless_round_trips(data):
    for a in (1, 2, 3):
        payload, padding = K.compress(data, a)
        assert K.decompress(payload, a, padding) == data


@pytest.mark.parametrize("n", [65534, 65535, 65536, 131071])
def test_long_runs(n):
    flat = np.full(n, 7, np.uint8)
    block = K.rle_encode(flat)
    assert len(block) == 9 + 3 * -(-n // 65535)
    assert (K.rle_decode(block) == flat).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1, 1, width=32), min_size=1, max_size=200), st.integers(1, 8), st.sampled_from([1, 2, 4]))
def test_waves_stay_in_range(xs, bits, k):
    x = np.array(xs, np.float32)
    p, pad = K.pcm_encode(x, k, bits)
    y = K.pcm_decode(p, pad, bits, len(x), k)
    assert len(y) == len(x)
    if k == 1:
        assert np.abs(y - x).max() <= (float(x.max()) - float(x.min()) + 2e-6) / (1 << bits) / 2 + 1e-5
    for a in (6, 7, 8):
        p, pad = K.audio_encode(x, a, bits=bits)
        y = K.audio_decode(p, pad, a, len(x), bits=bits)
        assert len(y) == len(x) and np.abs(y).max() <= 1.0


def test_errors():
    for bad in (b"\x00", b"\x00\x02\x41\x00"):
        with pytest.raises(K.CodecError):
            K.huffman_decode(bad, 0)
    with pytest.raises(K.CodecError):
        K.huffman_decode(bytes.fromhex("00024100000003420000000380"), 7)
    with pytest.raises(K.CodecError):
        K.lz78_decode(b"\0\0\0")
    with pytest.raises(K.CodecError):
        K.lz78_decode(bytes.fromhex("0000000100") + b"\x80")
    for f in (lambda: K.compress(b"x", 4), lambda: K.decompress(b"x", 9, 0), lambda: K.dm_encode([0.1], 0), lambda: K.adm_encode([0.1], 0.1, 1.0), lambda: K.dpcm_encode([0.1], 9, 0.9), lambda: K.dpcm_encode([0.1], 4, 1.5), lambda: K.pcm_encode([0.1], 0, 4), lambda: K.pcm_decode(b"123", 0, 4, 1), lambda: K.image_decode(b"123"), lambda: K.image_decode(bytes.fromhex("000000010000000202080000000000000000" + "00"))):
        with pytest.raises(K.CodecError):
            f()


def test_claims_are_checked():
    assert K.huffman_decode(bytes.fromhex("0001410000000400"), 4) == b"AAAA"
    with pytest.raises(K.CodecError, match="symbols"):
        K.huffman_decode(bytes.fromhex("000141ffffffff"), 0)
    with pytest.raises(K.CodecError, match="no picture"):
        K.bgr_to_rgb(b"", -1, -1, -1)
    assert K.bgr_to_rgb(bytes([1, 2, 3, 9, 4, 5, 6, 9]), 1, 2, 4) == bytes([3, 2, 1, 6, 5, 4]) and K.bgr_to_rgb(b"\7", 1, 1, 1) == b"\7\7\7"
