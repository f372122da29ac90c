"""The operators' definitions in plain Python over whole small tables, for comparison."""

import math
import re
from collections import Counter, defaultdict

from sparkfeat.llm import decontaminate as dc
from sparkfeat.llm import pii
from sparkfeat.llm import toxicity as tx

WORD = re.compile(r"[0-9a-z\x80-￿]+")


def words(text):
    out, word = [], ""
    for c in (text or "").lower():
        if c.isascii() and not c.isalnum():
            out.append(word)
            word = ""
        else:
            word += c
    return [w for w in [*out, word] if w]


def grams(text, n):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def classes(rows, t, n):
    """doc_id: (class, links) of documents with one text each."""
    docs = sorted({(a, grams(x, n)) for a, x in rows if a is not None}, key=lambda d: d[0])
    root, links = {a: a for a, _ in docs}, {a: 0 for a, _ in docs}
    find = lambda a: a if root[a] == a else find(root[a])
    for i, (a, p) in enumerate(docs):
        for b, q in docs[i + 1 :]:
            if p and q and len(p & q) / len(p | q) >= t - 1e-12:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {a: (find(a), links[a]) for a, _ in docs}


def piece_value(word, model):
    """The SVM's decision value of one piece, from its subsequences of three letters."""
    code, phi = [int(tx.CODE[b]) for b in word], Counter()
    for i in range(len(code)):
        for j in range(i + 1, len(code)):
            for k in range(j + 1, min(len(code), i + tx.SPAN)):
                if not {code[i], code[j], code[k]} & {0, 31}:
                    phi[code[i] << 10 | code[j] << 5 | code[k]] += tx.DECAY ** (k - i + 1)
    norm = math.sqrt(sum(v * v for v in phi.values()))
    return sum(float(model.w[u]) * v for u, v in phi.items()) / norm + model.bias if norm else model.bias


def toxic_score(text, model):
    """The greatest value of a text's pieces and of its runs of three or more single letters."""
    pieces = [p for p in re.split(rb"[\t-\r\x1c- ]+", (text or "").lower().encode()) if p]
    letters = lambda p: bytes(b for b in p if 0 < tx.CODE[b] < 31)
    run, runs = [], []
    for p in [*pieces, b""]:
        if p and len(p) <= 4 and len(letters(p).decode("utf-8", "ignore")) == 1:
            run.append(letters(p))
        else:
            if len(run) >= 3:
                runs.append(b"".join(run))
            run = []
    return max([model.bias, *(piece_value(p, model) for p in {*pieces, *runs})])


def contaminated(docs, bench):
    """{(row, item_id): (lcs, answer)}: every passage of every document against every item, without any retrieval."""
    out = {}
    for r, (_, text) in enumerate(docs):
        w = words(text)
        starts = range(0, max(-(-len(w) // (dc.PASSAGE // 2)) - 1, min(len(w), 1)) * (dc.PASSAGE // 2), dc.PASSAGE // 2)
        for item, t in bench:
            ws = words(t)
            if item is None or not ws:
                continue
            for p in starts:
                region = w[max(0, p - len(ws)) : p + dc.PASSAGE + len(ws)]
                width, inside = -(-3 * len(ws) // 2), set(ws)
                dense = [sum(x in inside for x in region[k : k + width]) for k in range(len(region))]
                at = dense.index(max(dense))
                near = region[max(0, at - len(ws) // 4) : at + width + len(ws) // 4]
                tail = ws[-max(1, -(-len(ws) // 4)) :]
                got = dc.lcs(ws, near) / len(ws), dc.lcs(tail, near) / len(tail)
                if got[0] >= dc.LCS and got[1] >= dc.ANSWER:
                    out[(r, item)] = max(out.get((r, item), got), got)
    return out


def _contexts(text, window):
    found = pii.entities(text.encode())
    spots = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text.lower())]
    for s, e, kind in found:
        near = [w for w in spots if w[1] <= s][-window:] + [w for w in spots if w[0] >= e][:window]
        yield s, e, kind, pii.value_of(kind, text.encode()[s:e]), [w for w in near if not any(a < w[1] and w[0] < b for a, b, _ in found)]


def shares(rows, window=pii.WINDOW, support=pii.SUPPORT):
    """{(entity, term): share} straight from the definition, over strings of ASCII."""
    ctx, c_t = defaultdict(dict), Counter()
    total = sum(1 for _, t in rows if t)
    for _, t in rows:
        if t:
            c_t.update(set(WORD.findall(t.lower())))
            for _, _, _, name, near in _contexts(t, window):
                ctx[name][tuple(w[2] for w in near)] = {w[2] for w in near}
    out = {}
    for e, cs in ctx.items():
        c_te = Counter(w for near in cs.values() for w in near)
        if len(cs) >= support:
            out |= {(e, w): math.log2(total * n / (max(c_t[w], n) * len(cs))) / math.log2(total / len(cs)) for w, n in c_te.items() if n >= support}
    return out


def sanitised(rows, window=pii.WINDOW):
    """Each row's text with entities generalised and disclosing terms generalised or removed."""
    share, out = shares(rows, window), []
    for i, t in rows:
        cuts = []
        for s, e, kind, name, near in _contexts(t or "", window):
            cuts.append((s, e, f"[{kind}]"))
            for a, b, w in near:
                v = share.get((name, w), 0) if i is not None else 0
                if v >= pii.GENERALISE:
                    cuts.append((a, b, "" if v >= pii.REMOVE else "[TERM]"))
        text, at = "", 0
        for s, e, by in sorted(cuts):
            if s >= at:
                text, at = text + t[at:s] + by, e
        out.append(None if t is None else text + t[at:])
    return out
