"""Plain Python versions that the operators are held against."""

from __future__ import annotations

import re
from collections import defaultdict


def words(text):
    """Lower-case runs of ASCII letters and digits and of characters beyond ASCII."""
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def grams(text, width=5):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near(rows, threshold=0.8):
    """{doc_id: (class_id, copy_id, copies, n_links, n_class_links)} for unique ids."""
    sets = {i: frozenset(grams(t)) for i, t in rows}
    copies = defaultdict(list)
    for i, s in sets.items():
        copies[s if s else i].append(i)
    heads = {min(ids): s for s, ids in copies.items() if not isinstance(s, int)}
    sizes = {min(ids): len(ids) for s, ids in copies.items()}
    holders = defaultdict(list)
    for h, s in heads.items():
        for g in s:
            holders[g].append(h)
    links = defaultdict(set)
    for h, s in heads.items():
        common = defaultdict(int)
        for g in s:
            for o in holders[g]:
                common[o] += 1
        for o, c in common.items():
            if o != h and c >= threshold * (len(s) + len(heads[o]) - c) - 1e-9:
                links[h].add(o)
    root = {}
    for h in sorted(heads):
        if h not in root:
            todo = [h]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = h
                    todo += links[x]
    out = {}
    for s, ids in copies.items():
        h, n = min(ids), len(ids)
        for i in ids:
            out[i] = (root.get(h, h), h, n, n - 1 + sum(sizes[o] for o in links[h]), len(links[h]))
    return out


def leaks(docs, items, window=20, similarity=0.8):
    """(doc_id, item_id) with an aligned window that is equal enough, seeds or not."""
    out = set()
    for j, text in items:
        item = words(text)
        if not item:
            continue
        size = min(window, len(item))
        for i, doc in docs:
            w = words(doc)
            for shift in range(-len(item), len(w)):
                same = [0 <= shift + k < len(w) and w[shift + k] == item[k] for k in range(len(item))]
                best = max(sum(same[a : a + size]) for a in range(len(item) - size + 1))
                if (best >= similarity * size - 1e-9) if len(item) >= 8 else all(same):
                    out.add((i, j))
                    break
    return out


def exact(rows):
    """{doc_id: (keep_id, group_size)} for unique ids."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return {i: (min(ids), len(ids)) for ids in groups.values() for i in ids}
