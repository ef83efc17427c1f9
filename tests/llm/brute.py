"""Plain-Python versions of the operators, straight from their definitions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("email", "ip", "card", "phone")


def exact(rows):
    """(doc_id, text) -> {doc_id: (keep_id, group_size, kept, sha256)}."""
    groups = defaultdict(list)
    for doc, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups[hashlib.sha256(body.encode()).hexdigest()].append((-len(text or ""), doc))
    return {doc: (min(g)[1], len(g), doc == min(g)[1], sha) for sha, g in groups.items() for _, doc in g}


def base_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {k for i, w in enumerate(windows) if seen[w] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def long_repeats(rows, size=35):
    """(doc_id, text) -> {doc_id: (n_words, n_removed, sha256 of kept words)}."""
    split = {doc: WORD.findall(text or "") for doc, text in rows}
    seen = Counter(tuple(w[i : i + size]) for w in split.values() for i in range(len(w) - size + 1))
    out = {}
    for doc, w in split.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out[doc] = len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    return out


def _luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def base_spans(text):
    """[(start, kind number, end)] of the base patterns."""
    out = []
    rules = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and _luhn(d)),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    for kind, (pattern, good) in enumerate(rules):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "") if good(m.group())]
    return sorted(out)


def rendered(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def near(rows, n=5, threshold=0.8):
    """(doc_id, text) -> {doc_id: (class_id, n_links)} by all pairs."""
    sets = {}
    for doc, text in rows:
        w = WORD.findall(text or "")
        sets[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    root, links = {d: d for d in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for d, s in sets.items():
        for t in s:
            by[t].append(d)
    shared = Counter()
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                shared[a, b] += 1
    for (a, b), k in shared.items():
        if k >= threshold * (len(sets[a]) + len(sets[b]) - k) - 1e-9:
            links[a] += 1
            links[b] += 1
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {d: (find(d), links[d]) for d in sets}


def held_out(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


def viterbi(text, scores, unknown, byte_ids):
    """Ids of the best segmentation of a text whose blanks are marks, by dynamic programming over characters."""
    best = [0.0] + [None] * len(text)
    back = [None] * (len(text) + 1)
    for i in range(len(text)):
        single = text[i] in scores
        for j in range(i + 1, min(len(text), i + 20) + 1):
            if (p := text[i:j]) in scores and (best[j] is None or best[i] + scores[p][0] > best[j]):
                best[j], back[j] = best[i] + scores[p][0], (i, [scores[p][1]])
        if not single and (best[i + 1] is None or best[i] + unknown > best[i + 1]):
            best[i + 1], back[i + 1] = best[i] + unknown, (i, [byte_ids[c] for c in text[i].replace("▁", " ").encode()])
    out, at = [], len(text)
    while at:
        i, ids = back[at]
        out = ids + out
        at = i
    return out


def redacted(text, spans):
    """text with the union of overlapping spans replaced by the first one's kind."""
    blocks = []
    for a, k, b in sorted(spans):
        if blocks and a < blocks[-1][2]:
            blocks[-1][2] = max(b, blocks[-1][2])
        else:
            blocks.append([a, k, b])
    out, at = "", 0
    for a, k, b in blocks:
        out += text[at:a] + f"[{KINDS[k].upper()}]"
        at = b
    return out + text[at:]
