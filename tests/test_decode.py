import random

from sitespec.functions.strings import decode_text


def test_equal_to_a_decoder_that_drops_bad_bytes(evaluate):
    chance = random.Random(5)
    parts = [b"plain", "é中😀� ".encode(), b"\xff", b"\xe2\x82", b"\xc0\xaf", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xf0\x9f\x98", b"\n", b"\x00", b"\x85"]
    rows = [b"", b"\xff" * 50_000, "é".encode() * 200_000 + b"\xe2", None]
    rows += [b"".join(chance.choices(parts, k=chance.randrange(12))) for _ in range(400)]
    rows += [bytes(chance.choices(range(256), k=chance.randrange(40))) for _ in range(600)]
    rows += [bytes(chance.choices([0x41, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC2, 0xE0, 0xED, 0xEF, 0xF0, 0xF4], k=12)) for _ in range(600)]
    got = evaluate(decode_text, [(r,) for r in rows], ["binary"])
    assert got == [None if r is None else r.decode("utf-8", "ignore") for r in rows]
