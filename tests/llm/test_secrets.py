import base64
import gzip
import hashlib
import random
import re
import time
import urllib.parse
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taleloom.llm import secrets
from taleloom.llm.queries import op10_secrets

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute(text):
    found = []
    for kind, pattern, group, least in (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)):
        found += [(m.start(), ("assign", "access", "hex").index(kind), m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "api_key", "APIKEY", "ſecret", "secret", "=", ":", " ", '"', "'", "abc", "abcdef", "é", "\U0001f600", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "\n", "%3D", "\\u003d"]), max_size=25))
def test_base_spans(parts):
    text = "".join(parts)
    base, every = secrets.secrets(text)
    assert secrets.written(base) == brute(text)
    assert set(base) <= set(every)


SECRET = 'x password = "hunter2abc" y'


@pytest.mark.parametrize("wrap", [
    lambda s: base64.b64encode(s.encode()).decode(),
    lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
    lambda s: urllib.parse.quote(s, safe=""),
    lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
    lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    lambda s: s.encode().hex(),
])
def test_layers(wrap):
    for inner in (SECRET, "é " + SECRET):
        one = wrap(inner)
        for layers in (one, base64.b64encode(one.encode()).decode(), urllib.parse.quote(base64.b64encode(zlib.compress(one.encode())).decode(), safe="")):
            text = f"begin é {layers} end"
            spans = [s for s in secrets.secrets(text)[1] if s[2] == "assign"]
            # A run whose padding is escaped decodes with it and without it: two spans of one secret.
            assert spans and all(8 <= a < b <= 8 + len(layers) for a, b, _ in spans)
            assert secrets.secrets(secrets.masked(text, secrets.secrets(text)[1]))[0] == []


def test_spans_point_at_the_layer():
    text = "a " + urllib.parse.quote(SECRET, safe="")
    (start, end, kind), = secrets.secrets(text)[1]
    assert kind == "assign" and urllib.parse.unquote(text[start:end]).startswith('password = "hunter2abc')


@pytest.mark.parametrize("secret", ["password%3A hunter22xyz", '"pass\\u0077ord": "hunter22xyz', "password = %68unter22xyz", "password %253D hunter22xyz", "%74oken  \\x3d 'abcdef%31"])
def test_escapes_beside_plain_spaces(secret):
    text = f"begin é {secret}, end"
    at = 8 + (secret[0] == '"')
    assert secrets.secrets(text) == ([], [(at, 8 + len(secret), "assign")])
    assert "hunter22" not in secrets.masked(text, secrets.secrets(text)[1])


def test_a_key_before_an_escaped_secret():
    assert (8, 24, "assign") in secrets.secrets("secret= token%3Aabcdefgh")[1]


def wrapped(data, width=76, by="\n"):
    text = base64.b64encode(data).decode()
    return by.join(text[i : i + width] for i in range(0, len(text), width))


@pytest.mark.parametrize("by", ["\n", "\r\n", "\n    "])
def test_base64_over_lines(by):
    for inner in ("x" * 50 + " " + SECRET, "x" * 35 + " " + SECRET + " y" * 100):
        one = wrapped(inner.encode(), by=by)
        text = f"begin {one} end"
        start, end, kind = max(secrets.secrets(text)[1], key=lambda s: s[1] - s[0])  # a line alone may show a part
        lines = text[start:end].replace(by, "")
        assert kind == "assign" and b"hunter2abc" in base64.b64decode(lines + "=" * (-len(lines) % 4))
    rng = random.Random(3)
    noise = "".join(rng.choice("ghijklmnop ") for _ in range(300))
    for pack in (zlib.compress, gzip.compress):
        text = f"begin {wrapped(pack((noise + SECRET).encode()), by=by)} end"
        assert (6, len(text) - 4, "assign") in secrets.secrets(text)[1]


@pytest.mark.parametrize("before", ["/blob/", "a", "ab", "abc", "x-", "path/to_the-"])
def test_base64_after_its_own_alphabet(before):
    for data in (SECRET.encode(), zlib.compress(SECRET.encode())):
        text = f"u {before}{base64.b64encode(data).decode()} v"
        found = [s for s in secrets.secrets(text)[1] if s[2] == "assign"]
        assert found and all(2 + len(before) <= a < b <= len(text) - 2 for a, b, _ in found)
    assert secrets.secrets(f"u g1{SECRET.encode().hex()} v")[1] and secrets.secrets(f"u 1{SECRET.encode().hex()} v")[1]


def test_bytes_that_are_no_utf8():
    for data in (b"\xff" + SECRET.encode(), b"\x00\xc3(" * 30 + SECRET.encode() + b"\xe9", "é😀".encode() + b"\xff" + SECRET.encode()):
        for one, size in ((base64.b64encode(data).decode(), 4 / 3), (data.hex(), 2)):
            (start, end, _), = [s for s in secrets.secrets(f"u {one} v")[1] if s[2] == "assign"]
            at = data.index(b"password")
            assert 2 + at * size - 4 < start <= 2 + at * size and end >= 2 + (at + 22) * size
        packed = base64.b64encode(zlib.compress(data)).decode()
        assert (2, 2 + len(packed), "assign") in secrets.secrets(f"u {packed} v")[1]


def found_in(data):
    one = base64.b64encode(data).decode()
    return any(start == 2 and end <= 2 + len(one) and kind == "assign" for start, end, kind in secrets.secrets(f"u {one} v")[1])


def test_long_compressed_layers():
    filler = b"w, " * (6 << 20)  # 18 MiB
    assert found_in(zlib.compress(SECRET.encode() + filler))
    assert found_in(gzip.compress(filler + SECRET.encode()))
    assert not found_in(gzip.compress(filler))
    for cut in range(4, len(SECRET), 5):  # the secret lies over the border of two pieces
        assert found_in(zlib.compress((b"w, " * (6 << 20))[: secrets.UNFOLDED - cut] + SECRET.encode() + filler[: 1 << 20]))
    rng = random.Random(4)
    inner = wrapped(zlib.compress("".join(rng.choice("ghijklmnop ") for _ in range(20000)).encode() + SECRET.encode())).encode()
    assert found_in(zlib.compress(filler[: secrets.UNFOLDED - 5000] + b" " + inner + b" " + filler[: 1 << 20]))


def test_members_and_streams_that_end_early():
    rng = random.Random(5)
    noise = "".join(rng.choice("ghijklmnop ") for _ in range(3000)).encode()
    assert found_in(gzip.compress(noise) + gzip.compress(SECRET.encode()))
    assert found_in(gzip.compress(noise + SECRET.encode()[:12]) + gzip.compress(SECRET.encode()[12:]))
    for pack in (zlib.compress, gzip.compress):
        short = pack(SECRET.encode() + noise)[:-300]
        for damaged in (short, short + b"\xff" * 300, pack(SECRET.encode() + noise)[:-4] + b"\0\0\0\0"):
            assert found_in(damaged)


def test_a_layer_that_decodes_for_ever_ends():
    text = "%2525252525252525252541" + "%25" * 50
    assert secrets.secrets(text) == ([], [])


def test_mask_overlaps():
    assert secrets.masked("0123456789", [(1, 4, "hex"), (2, 6, "hex"), (8, 9, "hex")], "#") == "0#67#9"
    assert secrets.masked("0123", [(0, 4, "hex")], "#") == "#"


def test_documents(spark, tmp_path):
    rows = [(1, SECRET), (2, None), (3, ""), (4, "w " * 200_000 + SECRET), (4, SECRET), (None, "AKIA" + "B" * 16)]
    spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op10_secrets(spark, str(tmp_path)).collect()
    want = [(i, brute(t or "").count("assign:"), brute(t or "").count("access:"), brute(t or "").count("hex:"), hashlib.sha256(brute(t or "").encode()).hexdigest()) for i, t in rows]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)


def _bare(data):
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush()


@pytest.mark.parametrize(
    "wrap",
    [
        lambda d: zlib.compress(zlib.compress(d)),
        lambda d: gzip.compress(zlib.compress(d)),
        lambda d: zlib.compress(gzip.compress(gzip.compress(d))),
        lambda d: gzip.compress(b"first member") + gzip.compress(d),
        _bare,
        lambda d: zlib.compress(_bare(d)),
        lambda d: zlib.compress(b"much before " * 3_000_000 + gzip.compress(d)),  # far beyond one window
        lambda d: zlib.compress(b"before " * 2_390_000 + gzip.compress(random.Random(4).randbytes(2 << 20) + d)),  # over a window's end
    ],
)
def test_compressed_in_compressed(wrap):
    text = f"x {base64.b64encode(wrap(b'password=hunter2xyz')).decode()} y"
    base, every = secrets.secrets(text)
    assert ("assign" in [k for *_, k in every]) and not any(k == "assign" for *_, k in base)


def test_a_layer_that_unfolds_to_itself_ends():
    """Data that holds itself: the second time it is met nothing is done."""
    data = b"password=hunter2xyz"
    for _ in range(400):
        data = zlib.compress(data)
    assert [k for *_, k in secrets.secrets(base64.b64encode(data).decode())[1]] == ["assign"]


def test_chains_of_escapes():
    assert secrets.secrets("token%25253D" + "abc%2564ef9")[1] == [(0, 23, "assign")]
    assert secrets.secrets("token=\\u005cu0061bcdefg")[1][-1] == (0, 23, "assign")
    assert secrets.secrets("caf%25C3%25A9 pass%2577ord%253Ahunter2xyz")[1] == [(14, 41, "assign")]


@pytest.mark.parametrize("text", ["%" + "25" * 100_000 + "41", "\\" + "u005c" * 50_000 + "u0041", "%41" + "中" * 1_000_000, "%41" + "abcdefgh" * 125_000, "ab12" * 250_000])
def test_long_texts_take_time_in_proportion(text):
    began = time.perf_counter()
    secrets.secrets(text)
    assert time.perf_counter() - began < 10  # a second on an idle machine
