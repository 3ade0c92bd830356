"""Sets of word shingles of whole texts, as 64-bit hashes.

Texts are UTF-8 bytes; ``lower`` and ``split`` of bytes are exactly A-Z and the white space of ASCII. Two different shingles
get one hash with a chance of 2**-64, so a similarity could be off by one shingle in a pair about once in 10**13 pairs.
"""
import numpy as np
import xxhash

FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; of a shorter text the whole sequence is one; of a text without words none."""
    hashes = word_hashes(text)
    number = len(hashes)
    if number == 0:
        return hashes
    size = min(words, number)
    total = np.full(number - size + 1, size * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(size):
        total += hashes[k:number - size + 1 + k] * FACTORS[k]
    total = mixed(total)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]
