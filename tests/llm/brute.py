"""Plain versions of the operators, for small inputs."""

import hashlib


def removed(texts, threshold):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) of each text."""
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for i, raw in enumerate(raws):
        for p in range(len(raw) - threshold + 1):
            seen.setdefault(raw[p:p + threshold], []).append((i, p))
    gone = [bytearray(len(raw)) for raw in raws]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p:p + threshold] = b"\1" * threshold
    out = []
    for raw, mark in zip(raws, gone):
        runs = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        kept = bytes(c for c, m in zip(raw, mark) if not m)
        out.append((len(raw), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text, size=4):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius):
    """The smallest index reachable from each fingerprint."""
    group = list(range(len(prints)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return [root(i) for i in range(len(prints))]


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    """(kind, start, end) of the base kinds."""
    import re

    def fine(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            return 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in twice) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if fine(k, m[0])]
