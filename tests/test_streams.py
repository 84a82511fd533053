import pytest

from siltstone.sources import h264, mp3
from siltstone.sources.errors import Refused


def test_mp3_frames():
    h = mp3.parse(bytes.fromhex("fffb9064"))
    assert (h.layer, h.kbits, h.rate, h.channels, h.size, h.protected) == (3, 128, 44100, 2, 417, False)
    frame = bytes.fromhex("fffb9064").ljust(417, b"\0")
    tag = b"ID3\4\0\0\0\0\1\0" + b"x" * 128
    got = mp3.info(tag + frame * 3 + b"TAG")
    assert (got["frames"], got["samples"], got["rate"]) == (3, 3456, 44100)
    xing = bytearray(frame)
    xing[36:40] = b"Xing"
    assert mp3.info(bytes(xing) + frame)["frames"] == 1
    for data, kind in ((frame[:-1], "Truncated"), (b"nothing here", "InvalidMagic"), (frame + bytes.fromhex("fffb9464").ljust(417, b"\0"), "BadValue")):
        with pytest.raises(Refused) as e:
            mp3.info(data)
        assert e.value.kind == kind
    with pytest.raises(Refused):
        mp3.parse(bytes.fromhex("fff39064"))


def test_h264_parameter_sets():
    ue = lambda v: bin(v + 1)[2:].zfill(2 * (v + 1).bit_length() - 1)
    bits = "01000010" + "00000000" + "00011110" + ue(0) + ue(0) + ue(2) + ue(1) + "0" + ue(3) + ue(2) + "1" + "0" + "1" + ue(0) + ue(4) + ue(0) + ue(2) + "0" + "1"
    bits += "0" * (-len(bits) % 8)
    sps = b"\x67" + int(bits, 2).to_bytes(len(bits) // 8, "big")
    pps = b"\x68" + bytes([0b11101100])
    stream = b"\0\0\0\1" + sps + b"\0\0\1" + pps + b"\0\0\0\1\x65abc"
    got = h264.units(stream)
    assert got == [sps, pps, b"\x65abc"]
    assert {k: h264.sequence(got[0])[k] for k in ("profile", "width", "height", "level")} == {"profile": "baseline", "width": 56, "height": 44, "level": 30}
    assert h264.picture(pps) == {"id": 0, "sequence": 0, "cabac": True}
    assert h264.payload(b"\x67\0\0\3\1") == b"\0\0\1"
    with pytest.raises(Refused):
        h264.sequence(b"\x67\x6e\0\0")
    with pytest.raises(Refused):
        h264.sequence(sps[:3])
