"""Plain Python versions of what the operators compute, for small inputs."""

import re
from collections import Counter
from itertools import combinations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def letter_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingles(text, width=5):
    words = blank_words(text)
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_groups(texts, percent=85):
    """``doc_id -> (set size, component)`` by all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    holders, common = {}, Counter()
    for i, own in sets.items():
        for shingle in own:
            holders.setdefault(shingle, []).append(i)
    for ids in holders.values():
        common.update(combinations(sorted(ids), 2))
    links = [
        (a, b) for (a, b), n in common.items()
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)
    ]
    of = components(sets, links)
    return {i: (len(sets[i]), of[i]) for i in sets}


def contamination(texts, items, window=10):
    """``doc_id -> (words, hit words, item ids)``."""
    windows = {}
    for item, text in items:
        words = letter_words(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc_id, text in texts.items():
        words, hit, found = letter_words(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                own = windows.get(tuple(words[i : i + size]))
                if own:
                    hit.update(range(i, i + size))
                    found |= own
        out[doc_id] = len(words), len(hit), sorted(found)
    return out


def seen_lines(texts):
    """``doc_id -> lines that an earlier document has``, with blank runs and case undone."""
    first, out = {}, {}
    for doc_id in sorted(texts):
        lines = [" ".join(blank_words(line)) for line in texts[doc_id].split("\n")]
        out[doc_id] = {line for line in lines if line in first}
        for line in lines:
            if line:
                first.setdefault(line, doc_id)
    return out


def common_blocks(texts, least=5):
    """``doc_id -> numbers of the lines`` of all runs that one earlier document has, in this order."""
    own, out = {}, {}
    for doc_id, text in texts.items():
        lines = enumerate((text or "").split("\n"))
        own[doc_id] = [(i, words) for i, line in lines if (words := blank_words(line))]
    for doc_id, lines in own.items():
        gone = out.setdefault(doc_id, set())
        for other in (x for other, x in own.items() if other < doc_id):
            for i, j in ((i, j) for i in range(len(lines)) for j in range(len(other))):
                n = 0
                for (_, one), (_, two) in zip(lines[i:], other[j:]):
                    if one != two:
                        break
                    n += 1
                run = lines[i : i + n]
                if sum(len(words) for _, words in run) >= least:
                    gone.update(at for at, _ in run)
    return out
