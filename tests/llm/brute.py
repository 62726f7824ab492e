"""Plain-Python counterparts of the corpus operators."""

import re


def shingles(text, width=5):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def near_components(rows, percent=85):
    """Least id reachable for each (id, text)."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lists = {}
    for n, (_, s) in enumerate(sets):
        for x in s:
            lists.setdefault(x, []).append(n)
    seen = set()
    for members in lists.values():
        for p, x in enumerate(members):
            for y in members[p + 1 :]:
                if (x, y) in seen:
                    continue
                seen.add((x, y))
                a, b = sets[x][1], sets[y][1]
                if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
                    continue
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    u, v = find(sets[x][0]), find(sets[y][0])
                    root[max(u, v)] = min(u, v)
    return {i: find(i) for i, _ in sets}, {i: len(s) for i, s in sets}
