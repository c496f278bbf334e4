"""A sequential search engine in plain Python, for comparison."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict

WORD = re.compile(r"[^\W_]+")


def normalize(s):
    return " ".join("".join(c for c in unicodedata.normalize("NFD", s) if not 0x300 <= ord(c) <= 0x36F).lower().split())


def match_type(level):
    return 0 if level == 0 else 1 if level <= 2 else level - 1 if level <= 4 else 4


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class Naive:
    """docs: list of (doc_id, title, text, [(start, end, field, section, level)])."""

    def __init__(self, docs, stop=()):
        self.titles = {d: t for d, t, _, _ in docs}
        sections = sorted({b[3] for _, _, _, bs in docs for b in bs if b[3] is not None})
        self.section = {s: i + 1 for i, s in enumerate(sections)}
        post = defaultdict(list)
        for d, _, text, bounds in docs:
            size = len(text.encode())
            for m in WORD.finditer(text):
                term = normalize(m.group())
                if not term or term in stop:
                    continue
                off = len(text[: m.start()].encode())
                f = next((b for b in bounds if b[0] <= off < b[1]), (0, 0, "content", None, 5))
                base = {"title": 100.0, "heading": 10.0}.get(f[2], 1.0) + 0.5 * (1 - off / size)
                score = {"title": 1000, "heading": 100}.get(f[2], 10) + int(5 * ((size - off) / size) // 1)
                post[term].append((-score, d, -base, off, match_type(f[4]), self.section.get(f[3], 0)))
        self.post = {t: sorted(p) for t, p in post.items()}
        self.vocab = sorted(self.post, key=str.encode)

    def matches(self, q, tier):
        if tier == 1:
            return [(q, 0)] if q in self.post else []
        if tier == 2:
            return [(t, 0) for t in self.vocab if t.startswith(q)]
        return sorted(((t, distance(t, q)) for t in self.vocab if 0 < distance(t, q) <= 2), key=lambda x: x[1])

    def score(self, raw, q, t, d, tier):
        return float(raw) if tier == 1 else raw * (len(q.encode()) / max(1, len(t.encode()))) if tier == 2 else raw * (1.0 / (1.0 + d))

    def key(self, r):
        return (r["mt"], -r["score"], self.titles[r["doc"]], r["doc"], r["sec"])

    def tier(self, query, tier, limit, exclude=(), dedup=True):
        parts = query.lower().split()
        if not parts or not limit:
            return []
        if len(parts) == 1:
            best = {}
            for t, d in self.matches(parts[0], tier):
                for neg, doc, _, _, mt, sec in self.post[t]:
                    if doc in exclude:
                        continue
                    s = self.score(-neg, parts[0], t, d, tier)
                    new = {"doc": doc, "score": s, "mt": mt, "sec": sec, "term": t}
                    have = best.get(doc)
                    if have is None:
                        best[doc] = new
                    elif tier == 2:
                        if mt < have["mt"]:
                            best[doc] = new
                        else:
                            have["score"] = max(have["score"], s)
                    elif tier == 3 and (mt, -s) < (have["mt"], -have["score"]):
                        best[doc] = new
            order = (lambda r: (-r["score"], r["doc"])) if tier == 1 else self.key
            return sorted(best.values(), key=order)[:limit]
        acc, hit = {}, defaultdict(set)
        for pos, q in enumerate(parts):
            for t, d in self.matches(q, tier):
                for neg, doc, _, _, mt, sec in self.post[t]:
                    if doc in exclude:
                        continue
                    hit[doc].add(pos)
                    a = acc.setdefault((doc, sec), {"doc": doc, "score": 0.0, "mt": 9, "sec": sec, "term": None})
                    a["score"] += self.score(-neg, q, t, d, tier)
                    if mt < a["mt"]:
                        a["mt"], a["term"] = mt, t
        rows = [a for a in acc.values() if len(hit[a["doc"]]) == len(parts)]
        if dedup:
            docs = defaultdict(list)
            for a in rows:
                docs[a["doc"]].append(a)
            rows = []
            for doc, group in docs.items():
                b = min(group, key=lambda a: (a["mt"], -a["score"], a["sec"]))
                rows.append({**b, "score": sum(a["score"] for a in group)})
        return sorted(rows, key=self.key)[:limit]

    def search(self, query, limit, dedup=True):
        one = self.tier(query, 1, limit, (), dedup)
        seen = {r["doc"] for r in one}
        two = self.tier(query, 2, limit, seen, dedup)
        seen = seen | {r["doc"] for r in two}
        three = self.tier(query, 3, limit, seen, dedup)
        return sorted(one + two + three, key=self.key)[:limit]
