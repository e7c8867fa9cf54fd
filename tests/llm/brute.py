"""Plain Python versions of the operators' contracts, for small inputs."""

import hashlib
import re

WS_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def contamination(documents, items, window=13):
    """{(doc_id, text): (n_words, n_hit, n_items, items_sha256, contaminated)}"""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    windows = {}
    for item, text in items:
        words = cut(text)
        if words:
            width = min(window, len(words))
            for i in range(len(words) - width + 1):
                windows.setdefault(tuple(words[i : i + width]), set()).add(item)
    out = {}
    for doc, text in documents:
        words, hit, own = cut(text), set(), set()
        for width in {len(w) for w in windows}:
            for i in range(len(words) - width + 1):
                if (key := tuple(words[i : i + width])) in windows:
                    hit |= set(range(i, i + width))
                    own |= windows[key]
        ids = sorted(str(i) for i in own if i is not None)
        out[doc, text] = (len(words), len(hit), len(ids), sha(",".join(ids)), bool(hit) and 20 * len(hit) >= len(words))
    return out


def components(ids, linked):
    """Least id reachable from every place; ``linked(i, j)`` says which places are linked."""
    n, root = len(ids), list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(n)]


def fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def quality_counts(text):
    words = WS_WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WS_WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n


def base_spans(text):
    """The base spans of personal data by kind and start."""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)

    def luhn(m):
        total = 0
        for i, d in enumerate(reversed(digits(m))):
            total += sum(divmod(int(d) * (1 + i % 2), 10))
        return total % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(m)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]


def pii_row(text):
    spans = base_spans(text)
    counts = [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
    return (*counts, sha(",".join(":".join(map(str, s)) for s in spans)))


def without_repeats(docs, length=100):
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text) rows in order."""
    seen, out = set(), []
    for doc, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((doc, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def one_of_similar(rows, size=5, least=0.8):
    """Least ids of the groups of (id, text) rows that a Jaccard similarity of word shingles joins."""
    def shingles(text):
        words = ascii_lower(text).split()
        return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}

    sets = [shingles(t) for _, t in rows]
    groups = components([i for i, _ in rows], lambda i, j: len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]))
    return {i for (i, _), g in zip(rows, groups, strict=True) if i == g}
