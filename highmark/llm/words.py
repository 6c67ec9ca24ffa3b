"""Hashes of words and of runs of words, for whole texts at a time, with numpy."""

import numpy as np

_U = np.uint64
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1 << 62, size=256, dtype=np.uint64) * _U(2) + _U(1)
_P = _U(0x9E3779B97F4A7C15)
_P_INVERSE = _U(pow(int(_P), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit integers."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _up_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, p in enumerate((_P, _P_INVERSE)):
            steps = np.full(size, p, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of bytes start and end."""
    edge = np.diff(np.concatenate([[True], _SPACE[raw], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for the bytes of each range, from one running sum over all bytes."""
    powers, inverse = _up_to(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * powers[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Of each run of `length` consecutive hashes; of all together if there are fewer; none of none."""
    n = len(words)
    if n == 0:
        return words
    length, seed = min(length, n), 0 if n >= length else n
    out = np.full(n - length + 1, _U(length * 7 + seed), dtype=np.uint64)
    for k in range(length):
        out = out * _P + mix(words[k : n - length + 1 + k] + _U(k))
    return mix(out)


def shingles(text: str, length: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of `length` words, A-Z lower-cased."""
    raw = np.frombuffer(text.encode().translate(LOWER), dtype=np.uint8)
    return np.unique(run_hashes(range_hashes(raw, *word_spans(raw)), length))
