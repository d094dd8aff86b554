from __future__ import annotations

import base64
import gzip

import pytest

from demandspark.llm import secrets

SECRET = "password=Abcdef123456"


def _b64(data) -> str:
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


def _full(n: int) -> str:
    return _b64((SECRET + " and then some words that follow it in the text ").ljust(n, "x")[:n])


@pytest.mark.parametrize(
    "text",
    [
        *(f"see {_full(n)}\nThe next line" for n in (45, 48, 51, 54, 57)),
        f"{_b64('first words of a long text '.ljust(57, 'y'))}\n{_full(57)}\nThenextline",
        f"{_b64('first words of a long text '.ljust(57, 'y'))}\n{_b64(SECRET)}",
        f"path/{_b64(SECRET)}", f"key_{_b64(SECRET)}", f"id-{_b64(SECRET)}", f"a/b_c-{_b64(SECRET)}", f"xy{_b64(SECRET)}",
        _b64(b"\x01" + SECRET.encode()), _b64(b"\xff " + SECRET.encode()),
        "%FF%20" + "".join(f"%{c:02X}" for c in SECRET.encode()),
        "\\ud800" + "".join(f"\\u{ord(c):04x}" for c in SECRET),
        _b64(gzip.compress(b"nothing here") + gzip.compress(SECRET.encode())),
    ],
)
def test_layers_beside_other_text(text):
    base, found = secrets.spans(text)
    assert not base and any(s.kind == 0 for s in found)


def test_nothing_past_a_piece_of_inflated_data_is_lost(monkeypatch):
    monkeypatch.setattr(secrets, "MAX_LAYER_BYTES", 1000)
    monkeypatch.setattr(secrets, "OVERLAP", 100)
    assert secrets.spans(_b64(gzip.compress(b"a b " * 247 + SECRET.encode() + b" c" * 2000)))[1]
    assert secrets.spans(_b64(gzip.compress(b"a b " * 2000 + SECRET.encode())))[1]
