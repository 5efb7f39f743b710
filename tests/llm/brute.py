import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def word_set(text, k, short=True):
    words = WORD.findall(lowered(text))
    if len(words) < k:
        return frozenset([tuple(words)]) if words and short else frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def smallest_reachable(ids, edges):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}
