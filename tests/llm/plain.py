"""Plain versions of some operators, which several tests compare with."""

import re
import zlib
from collections import Counter

import xxhash

from ripplemap.llm import secrets


def held(key):
    return zlib.crc32(b"" if key is None else str(key).encode()) % 10 == 0


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]

GAP = re.compile(r"[\x20\x09-\x0D]+")

PATTERNS = [
    (re.compile(secrets.ASSIGN.removeprefix("(?i)"), re.I | re.A), lambda m: len(m[2]) >= 6),
    (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def base(text):
    return sorted(
        (m.start(), k, m.end())
        for k, (p, ok) in enumerate(PATTERNS)
        for m in p.finditer(text or "")
        if ok(m)
    )


def measures(text):
    text = text or ""
    words = [w for w in GAP.split(text) if w]
    fives = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(fives)
    covered = {i + k for i, g in enumerate(fives) if counts[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if GAP.sub("", x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_components(fps, reach):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= reach:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]
