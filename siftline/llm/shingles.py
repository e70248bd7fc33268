"""Hashed word shingles of whole texts, computed for many texts at once with numpy."""
import functools
import hashlib

from .common import LOWER_ASCII

#: Bytes handled by one numpy pass; passes end at white space.
SEGMENT = 1 << 18
_SPACE = b" \t\n\r\x0b\x0c"


@functools.cache
def _tables():
    import numpy as np

    random = np.random.default_rng(20240229)
    weight = random.integers(1, 1 << 63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
    space = np.zeros(256, bool)
    space[list(_SPACE)] = True
    return weight, space


@functools.lru_cache(maxsize=2)
def _powers(size):
    import numpy as np

    base = 0x9E3779B97F4A7C15
    power, inverse = np.full(size, base, "u8"), np.full(size, pow(base, -1, 1 << 64), "u8")
    power[0] = inverse[0] = 1
    return np.cumprod(power), np.cumprod(inverse)


def mix(h):
    """Spread 64-bit values (finaliser of a well-known generator)."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _segment_words(data):
    """(start, hash) of every word of one segment."""
    import numpy as np

    weight, space = _tables()
    raw = np.frombuffer(data, "u1")
    gap = space[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view("i1")))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _powers(max(2 * SEGMENT, 1 << len(raw).bit_length()))
    total = np.concatenate([np.zeros(1, "u8"), np.cumsum(weight[raw] * power[:len(raw)], dtype="u8")])
    return starts, mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype("u8"))


def word_hashes(texts):
    """Hashes of all words of the texts (bytes), and the index of the text each belongs to."""
    import numpy as np

    data = b"\n".join(t.translate(LOWER_ASCII) for t in texts)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    places, hashes, at = [], [], 0
    while at < len(data):
        end = at + SEGMENT
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        starts, h = _segment_words(data[at:end])
        places.append(starts + at)
        hashes.append(h)
        at = end
    if not hashes:
        return np.zeros(0, "u8"), np.zeros(0, "i8")
    return np.concatenate(hashes), np.searchsorted(begins, np.concatenate(places), side="right") - 1


def shingle_sets(texts, width=5):
    """For each text (bytes) the sorted distinct hashes of its ``width``-word shingles.

    Fewer words than that make one shingle of the whole sequence; no word makes the empty set.
    """
    import numpy as np

    words, owner = word_hashes(texts)
    n = len(words)
    factor = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(width)]
    whole = np.zeros(0, "u8")
    if n >= width:
        total = np.zeros(n - width + 1, "u8")
        for k in range(width):
            total += words[k:n - width + 1 + k] * factor[k]
        whole = mix(total)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if high - low >= width:
            yield np.unique(whole[low:high - width + 1])
        elif high > low:
            with np.errstate(over="ignore"):
                one = sum((words[low + k] * factor[k] for k in range(high - low)), np.uint64(0x2545F4914F6CDD1D) * np.uint64(high - low))
            yield mix(np.array([one], "u8"))
        else:
            yield np.zeros(0, "u8")


def set_id(shingles) -> int:
    """A 64-bit name of a shingle set; expected to be unique up to billions of different sets."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def grouped(texts, limit=SEGMENT):
    """Slices of a list of texts that hold about ``limit`` bytes each."""
    start, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= limit:
            yield texts[start:k + 1]
            start, held = k + 1, 0
    if start < len(texts):
        yield texts[start:]
