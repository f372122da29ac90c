"""Toxic documents by a subsequence string-kernel SVM with Nystroem landmarks.

The kernel of two strings (Lodhi et al., 2002) compares their subsequences of three letters, each
weighted by ``DECAY`` to the power of the span it covers, spans of at most ``SPAN``; it is
normalised to 1 for equal strings.  A letter inserted into an insult, or one left out, changes
few subsequences.  Strings are blank-separated pieces of sentences, lower-cased; signs and digits
within a piece are gaps, and three or more single letters in a row ("i d i o t") are one piece.
A sentence's kernel value with a landmark is that of its best piece, and a document is as toxic as
its most toxic sentence.

Training maps pieces of labelled sentences to their kernel values with a few landmark strings,
whitened by the landmarks' own kernel matrix (Williams and Seeger, 2001), and fits a linear SVM;
insults with one letter inserted train it beside those found.  The cut lies a third of the way
from the highest clean document to the lowest toxic one where F1 on the training documents is best.
The decision value of a string is then a weighted sum of kernels with the landmarks, hence linear
in the string's subsequences: all landmarks and the SVM fold into one table of 32**3 weights, and
scoring a corpus is a handful of table look-ups per byte, exactly equal to the kernel sum.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts
from .common import stored, table, tidy

DECAY, SPAN, LANDMARKS, MAX_TRAIN = 0.6, 6, 96, 2000
HARD, MOST_FOUND, BEND = 3000, 4000, 150
OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
WEIGHT = np.array([DECAY ** (b + 1) for _, b in OFFSETS])
RUNS = (4, 5)
SCORES = "doc_id long, score double, toxic int, sentence string"

#: 0 white space, 1-26 letters, 27-30 bytes of other letters, 31 signs and digits.
CODE = np.full(256, 31, dtype=np.int32)
CODE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 0
for _b in range(97, 123):
    CODE[_b] = CODE[_b - 32] = _b - 96
for _b in range(128, 256):
    CODE[_b] = 27 if _b >= 192 else 28 + (_b & 31) % 3
_LETTER = (CODE > 0) & (CODE < 31)
_SOLID = CODE > 0
_END = np.zeros(256, dtype=bool)
_END[[10, 13, 33, 46, 63]] = True


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return ts.spans(data, offs, _SOLID)


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(first byte, row, joined letters) of runs of three or more one-letter pieces of one row."""
    letters = np.concatenate([[0], np.cumsum(_LETTER[data] & ((data & 0xC0) != 0x80))])
    one = (letters[ends] - letters[starts] == 1) & (ends - starts <= 4)
    edge = np.diff(np.concatenate([[0], one.astype(np.int8), [0]]))
    out = []
    for lo, hi in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        if hi - lo < 3:
            continue
        cut = [lo, *(np.flatnonzero(np.diff(rows[lo:hi])) + lo + 1).tolist(), hi]
        for a, b in zip(cut[:-1], cut[1:]):
            if b - a >= 3:
                raw = data[starts[a] : ends[b - 1]]
                out.append((int(starts[a]), int(rows[a]), raw[_LETTER[raw]].tobytes()))
    return out


def triples(code: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each shape of subsequence: its id at every place (0 where it leaves the piece or meets a sign), and weight."""
    n = len(code)
    pad = np.concatenate([code, np.zeros(SPAN, np.int32)])
    letter = np.where(pad == 31, 0, pad)
    alive = pad[:n] > 0
    stretch = [alive]
    for k in range(1, SPAN):
        stretch.append(stretch[-1] & (pad[k : n + k] > 0))
    for (a, b), w in zip(OFFSETS, WEIGHT):
        x, y, z = letter[:n], letter[a : n + a], letter[b : n + b]
        yield np.where(stretch[b] & (x > 0) & (y > 0) & (z > 0), (x << 10) | (y << 5) | z, 0), w


def features(word: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(subsequence ids, weights) of one string, normalised to length 1; empty if it has none."""
    code = CODE[np.frombuffer(word, dtype=np.uint8)]
    ids, ws = [], []
    for t, w in triples(code):
        t = t[t > 0]
        ids.append(t)
        ws.append(np.full(len(t), w))
    ids, ws = np.concatenate(ids), np.concatenate(ws)
    if not len(ids):
        return ids, ws
    u, inv = np.unique(ids, return_inverse=True)
    v = np.bincount(inv, weights=ws)
    return u, v / np.sqrt((v * v).sum())


def matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, value) of many strings' features, all strings at once."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    code = CODE[np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)]
    row = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
    keys, ws = [], []
    for t, w in triples(code):
        at = np.flatnonzero(t)
        keys.append((row[at] << 15) | t[at])
        ws.append(np.full(len(at), w))
    u, inv = np.unique(np.concatenate(keys), return_inverse=True)
    v = np.bincount(inv, weights=np.concatenate(ws), minlength=len(u))
    r = u >> 15
    norm = np.sqrt(np.bincount(r, weights=v * v, minlength=len(words)))
    return r, u & 32767, v / norm[r]


def kernel(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Kernel values of strings with landmarks."""
    lr, li, lv = matrix(landmarks)
    dense = np.zeros((32**3, len(landmarks)), dtype=np.float32)
    dense[li, lr] = lv
    out = np.zeros((len(words), len(landmarks)))
    for lo in range(0, len(words), 500):
        r, i, v = matrix(words[lo : lo + 500])
        if len(r):
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            out[lo + r[first]] = np.add.reduceat(dense[i] * v[:, None].astype(np.float32), first)
    return out


class Model:
    """The folded table, its bias and the threshold; plain arrays, a fixed 256 KB at any data size."""

    def __init__(self, weights: np.ndarray, bias: float, landmarks: list[bytes]) -> None:
        self.w, self.bias, self.landmarks = weights.astype(np.float32), float(bias), landmarks
        self.cut = 0.0
        self.seen: dict[bytes, float] = {}

    def value(self, word: bytes) -> float:
        ids, v = features(word)
        return float(self.w[ids] @ v) + self.bias if len(ids) else self.bias

    def score(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's greatest decision value and the byte span of that piece; the bias for rows without pieces.

        A piece's sum of weights is compared with a bound first: dividing it by the smallest
        length its features can have overstates its value, so what stays below the row's floor
        is never the best, and only the others' lengths are worked out.
        """
        n_rows = len(offs) - 1
        best = np.full(n_rows, self.bias)
        at = np.zeros((2, n_rows), dtype=np.int64)
        starts, ends, rows = pieces(data, offs)
        if not len(starts):
            return best, at[0], at[1]
        code = CODE[data]
        if len(offs) > 2:  # a piece ends with its row
            code = np.insert(code, offs[1:-1], 0)
            shift = rows
        else:
            shift = 0
        total = np.zeros(len(code), dtype=np.float32)
        square = np.zeros(len(code), dtype=np.float32)
        table = self.w.copy()
        table[0] = 0
        for t, w in triples(code):
            total += table[t] * np.float32(w)
            square += (t > 0) * np.float32(w * w)
        both = np.concatenate([[0.0], np.cumsum(total, dtype=np.float64)]), np.concatenate([[0.0], np.cumsum(square, dtype=np.float64)])
        s, e = starts + shift, ends + shift
        num, least = both[0][e] - both[0][s], np.sqrt(np.maximum(both[1][e] - both[1][s], 0))
        has = least > 1e-6
        bound = np.where(has, np.maximum(num, 0) / np.maximum(least, 1e-6), 0) + self.bias
        raw = data.tobytes()
        extra = spelled(data, starts, ends, rows)
        for a, row, word in extra:
            v = self.cached(word.lower())
            if v > best[row]:
                best[row], at[0, row], at[1, row] = v, a, a + len(word)
        hot = np.flatnonzero(bound > self.bias * 0.5)
        for k in hot[np.argsort(-bound[hot], kind="stable")].tolist():
            row = rows[k]
            if bound[k] <= best[row]:
                continue
            v = self.cached(raw[starts[k] : ends[k]].lower())
            if v > best[row]:
                best[row], at[0, row], at[1, row] = v, starts[k], ends[k]
        return best, at[0], at[1]

    def cached(self, word: bytes) -> float:
        v = self.seen.get(word)
        if v is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            v = self.seen[word] = self.value(word)
        return v


def svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss and per-row costs, by Newton steps over the rows in the margin."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        on = y * (x1 @ w) < 1
        a = x1[on] * c[on, None]
        new = np.linalg.solve(x1[on].T @ a + ridge, a.T @ y[on])
        if np.abs(new - w).max() < 1e-7:
            break
        w = 0.5 * (w + new) if _ > 20 else new
    return w[:-1], float(w[-1])


def witnesses(docs: pa.Array, toxic: np.ndarray, support: int) -> list[bytes]:
    """Pieces that make toxic documents' sentences toxic.

    A document's label says that some sentence of it is toxic, not which.  Runs of four and five
    letters are counted by document, and those that toxic documents share and clean ones lack (a
    likelihood ratio beyond what the best of so many runs reaches by chance) are
    chosen greedily by the toxic documents that hold them in pieces not explained yet: while a run
    explains ``support`` documents that no earlier one does, or one in twenty of all and no clean
    one.  The pieces that hold a chosen run are the witnesses; other pieces of toxic documents
    teach nothing.
    """
    data, offs = ts.text_buffer(docs)
    data = ts.fold(data)
    starts, ends, rows = pieces(data, offs)
    code = CODE[data]
    row_of = np.repeat(rows.astype(np.int32), ends - starts)
    place = ts.ranges(starts, ends - starts).astype(np.int32)
    pos, neg = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    held, odds_of, clear, base = [], [], [], 0
    for size in (4, 5):
        gram = np.zeros(len(data), dtype=np.int32)
        whole = np.ones(len(data), dtype=bool)
        for k in range(size):
            shifted = np.concatenate([code[k:], np.zeros(k, np.int32)])
            gram = (gram << 5) | shifted
            whole &= (shifted > 0) & (shifted < 31)
        keep = whole[place]
        at, r = place[keep], row_of[keep]
        mine = toxic[r]
        ids = np.sort(gram[at[mine]])
        ids = ids[np.concatenate([[True], ids[1:] != ids[:-1]])] if len(ids) else ids
        if not len(ids):
            continue
        k = np.minimum(np.searchsorted(ids, gram[at]), len(ids) - 1)
        known = ids[k] == gram[at]
        at, r, k = at[known], r[known], k[known]
        once = np.sort(k * len(docs) + r)
        once = once[np.concatenate([[True], once[1:] != once[:-1]])]
        of, doc = once // len(docs), once % len(docs)
        p = np.bincount(of[toxic[doc]], minlength=len(ids))
        q = np.bincount(of[~toxic[doc]], minlength=len(ids))
        odds = np.log((p + 0.5) / (pos + 1)) - np.log((q + 0.5) / (neg + 1))
        share = np.array([pos, neg]) / (pos + neg)
        with np.errstate(divide="ignore", invalid="ignore"):
            g2 = 2 * (p * np.log(p / ((p + q) * share[0])) + np.where(q > 0, q * np.log(q / ((p + q) * share[1])), 0))
        good = (p >= support) & (odds >= np.log(50)) & (g2 >= 2 * np.log(max(2, len(ids))))
        sel = good[k] & toxic[r]
        held.append(np.stack([k[sel] + base, r[sel], np.searchsorted(starts, at[sel], side="right") - 1]))
        odds_of.append(odds)
        clear.append(q == 0)
        base += len(ids)
    told = np.zeros(0, np.int64)
    if held:
        of, doc, piece = np.concatenate(held, axis=1)
        told = explained(of, doc, piece, np.concatenate(odds_of), np.concatenate(clear), pos, support)
    raw = data.tobytes()
    return [raw[starts[k] : ends[k]] for k in told.tolist()]


def distinct_pieces(docs: pa.Array) -> set[bytes]:
    """The distinct pieces of texts, read half a megabyte at a time."""
    out: set[bytes] = set()
    for c in ts.chunks(pa.RecordBatch.from_arrays([docs], names=["text"])):
        data, offs = ts.text_buffer(c.column(0))
        data = ts.fold(data)
        starts, ends, _ = pieces(data, offs)
        _, first = np.unique(ts.word_hashes(data, starts, ends), return_index=True)
        raw = data.tobytes()
        out.update(raw[starts[k] : ends[k]] for k in first.tolist())
    return out


def explained(of: np.ndarray, doc: np.ndarray, piece: np.ndarray, odds: np.ndarray, pure: np.ndarray, pos: int, support: int) -> np.ndarray:
    """The pieces of toxic documents that hold a chosen run; (of, doc, piece) are the places of the runs that qualify."""
    told: list[np.ndarray] = []
    n_docs = int(doc.max(initial=-1)) + 1
    open_doc = np.ones(n_docs, dtype=bool)
    often = max(4, pos // 20)
    while len(of):
        once = np.unique(of * n_docs + doc)
        gain = np.bincount(once // n_docs, minlength=len(odds))
        fresh = np.bincount(once[open_doc[once % n_docs]] // n_docs, minlength=len(odds))
        fit = (fresh >= support) | (pure & (gain >= often))
        if not fit.any():
            break
        k = int(np.argmax(np.where(fit, (gain + fresh) * odds, -1)))
        mine = np.unique(piece[of == k])
        told.append(mine)
        open_doc[doc[of == k]] = False
        left = ~np.isin(piece, mine)
        of, doc, piece = of[left], doc[left], piece[left]
    return np.concatenate(told) if told else np.zeros(0, np.int64)


def letter_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pieces, runs of letters in them) for each of the lengths; a run's number also tells its length."""
    code = CODE[data]
    place = ts.ranges(starts, ends - starts)
    piece = np.repeat(np.arange(len(starts)), ends - starts)
    for size in RUNS:
        gram = np.zeros(len(data), dtype=np.int32)
        whole = np.ones(len(data), dtype=bool)
        for k in range(size):
            shifted = np.concatenate([code[k:], np.zeros(k, np.int32)])
            gram = (gram << 5) | shifted
            whole &= (shifted > 0) & (shifted < 31)
        keep = whole[place] & (place + size <= ends[piece])
        yield piece[keep], gram[place[keep]].astype(np.int64) | size << 25


def _labelled_chunks(batches: Iterator[pa.RecordBatch], ids: np.ndarray, toxic: np.ndarray):
    """(label numbers, classes, lower-cased bytes, piece starts, ends, rows) of the labelled documents."""
    for b in batches:
        for c in ts.chunks(b):
            doc = c.column(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, doc), len(ids) - 1)
            mine = np.flatnonzero(ids[at] == doc)
            if len(mine):
                data, offs = ts.text_buffer(c.column(1).take(pa.array(mine)))
                data = ts.fold(data)
                yield at[mine], toxic[at[mine]], data, *pieces(data, offs)


def _counts(sent):
    """(run, toxic documents with it, clean ones) over this task's labelled documents; run 0 counts the documents."""

    def summed(parts: list[np.ndarray]) -> np.ndarray:
        key, p, q = np.concatenate(parts, axis=1)
        u, inv = np.unique(key, return_inverse=True)
        return np.stack([u, np.bincount(inv, weights=p).astype(np.int64), np.bincount(inv, weights=q).astype(np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        held = 0
        for _, bad, data, starts, ends, rows in _labelled_chunks(batches, *sent.value):
            parts.append(np.array([[0], [bad.sum()], [(~bad).sum()]], dtype=np.int64))
            for piece, gram in letter_runs(data, starts, ends):
                once = np.unique(gram * len(bad) + rows[piece])
                key, first = np.unique(once // len(bad), return_index=True)
                p = np.add.reduceat(bad[once % len(bad)].astype(np.int64), first) if len(key) else first
                parts.append(np.stack([key, p, np.diff(np.append(first, len(once))) - p]))
                held += len(key)
            if held > 2_000_000:
                parts = [summed(parts)]
                held = 0
        if parts:
            k, p, q = summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(p), pa.array(q)], names=["run", "p", "q"])

    return run


def _places(sent):
    """(doc, piece) of the labelled toxic documents' pieces that hold one of the runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, toxic, runs = sent.value
        for number, bad, data, starts, ends, rows in _labelled_chunks(batches, ids[toxic], toxic[toxic]):
            raw = data.tobytes()
            for k in np.unique(np.concatenate([piece[np.isin(gram, runs)] for piece, gram in letter_runs(data, starts, ends)])).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([number[rows[k]]]), pa.array([raw[starts[k] : ends[k]]], pa.binary())], names=["doc", "piece"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(run(batches))
        if got:
            yield from pa.Table.from_batches(got).combine_chunks().to_batches()

    return packed


def corpus_witnesses(docs: DataFrame, ids: np.ndarray, toxic: np.ndarray) -> list[bytes]:
    """What ``witnesses`` finds, over all labelled ``docs``; the driver gets the runs that qualify and the pieces that hold them."""
    sc = docs.sparkSession.sparkContext
    text = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = sc.broadcast((ids, toxic))
    counts = stored(text.mapInArrow(tidy(_counts(sent)), "run long, p long, q long").groupBy("run").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).where("p > 0"))
    sent.unpersist()
    size = F.shiftright("run", 25)
    known = {r["size"]: r for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.sum("p").alias("p"), F.sum("q").alias("q")).collect()}
    if 0 not in known:
        return []
    pos, neg = known[0]["p"], max(1, known[0]["q"])
    support = least_support(pos)
    t = counts.where((F.col("run") > 0) & (F.col("p") >= support) & (F.col("p") / pos > F.col("q") / neg)).where(F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("q") + 0.5) / (neg + 1)) >= float(np.log(50))).orderBy("run").toArrow()
    run, p, q = (t.column(k).to_numpy() for k in ("run", "p", "q"))
    odds = np.log((p + 0.5) / (pos + 1)) - np.log((q + 0.5) / (neg + 1))
    share = np.array([pos, neg]) / (pos + neg)
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * (p * np.log(p / ((p + q) * share[0])) + np.where(q > 0, q * np.log(q / ((p + q) * share[1])), 0))
    good = g2 >= 2 * np.log(np.array([max(2, known[s]["n"]) for s in (run >> 25).tolist()]))
    run, q, odds = run[good], q[good], odds[good]
    if not len(run):
        return []
    sent = sc.broadcast((ids, toxic, run))
    t = text.mapInArrow(tidy(_places(sent)), "doc long, piece binary").toArrow()
    sent.unpersist()
    if not t.num_rows:
        return []
    words = t.column("piece").combine_chunks().dictionary_encode()
    names, which = words.dictionary.to_pylist(), words.indices.to_numpy()
    order = np.lexsort((np.argsort(np.argsort(np.array(names, dtype=object), kind="stable")).astype(np.int64)[which], t.column("doc").to_numpy()))
    which, doc = which[order], np.unique(t.column("doc").to_numpy()[order], return_inverse=True)[1]
    data = np.frombuffer(b" ".join(names) + b" ", dtype=np.uint8)
    ends = np.cumsum([len(w) + 1 for w in names]) - 1
    starts = ends - np.array([len(w) for w in names])
    pairs = np.concatenate([np.stack([piece, gram]) for piece, gram in letter_runs(data, starts, ends)], axis=1)
    pairs = np.unique(pairs[:, np.isin(pairs[1], run)], axis=1)
    first, stop = np.searchsorted(pairs[0], which), np.searchsorted(pairs[0], which, side="right")
    of = np.searchsorted(run, pairs[1])[ts.ranges(first, stop - first)]
    at = np.repeat(np.arange(len(which)), stop - first)
    return [names[which[k]] for k in explained(of, doc[at], at, odds, q == 0, pos, support).tolist()]


def bare(word: bytes) -> bytes:
    """A piece without the signs around its letters."""
    a = np.flatnonzero(_LETTER[np.frombuffer(word, dtype=np.uint8)])
    return word[a[0] : a[-1] + 1] if len(a) else b""


def values(model: Model, texts: pa.Array) -> np.ndarray:
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    return np.concatenate([model.score(*ts.text_buffer(c.column(0)))[0] for c in ts.chunks(batch)] or [np.zeros(0)])


def least_support(pos: int) -> int:
    """Toxic documents, of ``pos``, that a run of letters must explain."""
    return max(3, pos // 300)


def train(texts: pa.Array | list[str], toxic: list[int], landmarks: int = LANDMARKS, hard: int = HARD, most_found: int = MOST_FOUND, bend: int = BEND, rounds: int = 4, found: list[bytes] | None = None) -> Model:
    """Fits the model on labelled documents, and on the witnesses ``found`` if they are known already; with no toxic witness at all it finds nothing toxic.

    The SVM's rows are bounded: the ``most_found`` commonest distinct witnesses, the ``bend`` commonest
    with a letter inserted at each place, and of the distinct clean pieces ``hard`` at first and as many of
    the worst judged ones, among all of them, in each of the ``rounds`` after it.
    """
    texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
    y = np.array(toxic, dtype=bool)
    never = Model(np.zeros(32**3), -1.0, [])
    if not y.any():
        return never
    if found is None:
        found = witnesses(texts, y, least_support(int(y.sum())))
    known = {bare(w) for w in distinct_pieces(texts.filter(pa.array(~y)))}
    count = Counter(w for w in map(bare, found) if len(w) >= 3 and w not in known)
    if not count:
        return never
    names, freq = sorted(count), np.array([count[w] for w in sorted(count)])
    order = np.argsort(-freq, kind="stable")
    pos = [names[k] for k in order[:most_found]]
    weight = np.sqrt(freq[order[:most_found]].astype(float))
    clean = sorted(known - {b""})
    step = max(1, len(clean) // hard)
    neg = clean[::step][:hard]
    marks = [pos[0]]
    near = kernel(pos, marks)[:, 0]
    while len(marks) < min(landmarks * 3 // 4, len(pos)):
        k = int(np.argmax((1 - near) * weight))
        if near[k] > 0.97:
            break
        marks.append(pos[k])
        near = np.maximum(near, kernel(pos, [pos[k]])[:, 0])
    clean_texts = pa.array([w.decode("utf-8", "replace") for w in clean], pa.large_string())
    model = never
    spread = neg[:: max(1, len(neg) // max(1, landmarks - len(marks)))][: landmarks - len(marks)]
    marks = marks + spread
    km = kernel(marks, marks)
    val, vec = np.linalg.eigh(km + 1e-6 * np.eye(len(marks)))
    white = vec / np.sqrt(np.maximum(val, 1e-6))
    lr, li, lv = matrix(marks)
    rng = np.random.default_rng(0)
    bent = [w[:k] + bytes([97 + int(rng.integers(26))]) + w[k:] for w in pos[:bend] if len(w) >= 5 for k in range(1, len(w)) if all(x < 128 for x in w[k - 1 : k + 1])]
    bent = [w for w in bent if w not in known]
    kp = kernel(pos + bent, marks) @ white
    weight = np.concatenate([weight, np.full(len(bent), 0.5 * weight.sum() / max(1, len(bent)))])
    for _ in range(rounds):
        kn = kernel(neg, marks) @ white
        x = np.vstack([kp, kn])
        t = np.concatenate([np.ones(len(kp)), -np.ones(len(kn))])
        c = np.concatenate([weight / weight.sum() * len(kn), np.full(len(kn), 1.0)])
        w, b = svm(x, t, c)
        beta = white @ w
        folded = np.zeros(32**3)
        np.add.at(folded, li, lv * beta[lr])
        model = Model(folded, min(b, -1e-3), marks)
        value = values(model, clean_texts)
        worst = np.flatnonzero(value > -0.5)
        worst = worst[np.argsort(-value[worst])][:hard]
        more = sorted(set(clean[k] for k in worst.tolist()) - set(neg))
        if not more:
            break
        neg = neg + more
    value = values(model, texts)
    cuts = np.unique(value)
    cuts = np.concatenate([(cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1e-3]]) if len(cuts) > 1 else np.array([0.0])
    hits = np.searchsorted(np.sort(value[y]), cuts)
    alarms = np.searchsorted(np.sort(value[~y]), cuts)
    tp, fp = y.sum() - hits, (~y).sum() - alarms
    f1 = 2 * tp / np.maximum(tp + fp + y.sum(), 1)
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    low, high = top[0], top[-1]
    below, above = value[~y | (value < cuts[low])], value[y & (value > cuts[high])]
    lo_v = below[below < cuts[low]].max(initial=model.bias)
    hi_v = above.min(initial=value.max())
    model.cut = float(lo_v + (hi_v - lo_v) / 3)
    return model


def usable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) without labels that are null, or that disagree about a doc_id."""
    by = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi"))
    return by.where("lo = hi and lo in (0, 1)").select("doc_id", F.col("lo").cast("int").alias("toxic"))


def labelled(docs: DataFrame, by: DataFrame, most: int) -> tuple[pa.Array, list[int]]:
    """Texts and classes of at most ``most`` documents of each class of ``usable`` labels, the same ones whatever the order of rows."""
    pick = [by.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    chosen = F.broadcast(pick[0].unionByName(pick[1]))
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id").orderBy("doc_id", "text").toArrow()
    return rows.column("text").cast(pa.large_string()).combine_chunks(), rows.column("toxic").to_pylist()


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """The model of the labelled ``docs``.

    Witnesses are sought in all of them; ``max_train`` bounds the documents of each class that the
    clean strings and the cut are taken from.
    """
    by = usable(labels)
    t = by.orderBy("doc_id").toArrow()
    ids, toxic = t.column("doc_id").to_numpy(), t.column("toxic").to_numpy().astype(bool)
    found = corpus_witnesses(docs, ids, toxic) if toxic.any() else []
    return train(*labelled(docs, by, max_train), found=found)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, toxic, sentence) of every row of ``docs``: toxic is 1 where the score is above the cut.

    ``sentence`` is the one that decided, for toxic rows.  Null and empty texts are not toxic; a
    null doc_id stays null; repeated rows are scored each; other columns are not read.
    """
    cut = model.cut
    sent = docs.sparkSession.sparkContext.broadcast((model.w, model.bias, model.landmarks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for b in batches:
            for c in ts.chunks(b):
                data, offs = ts.text_buffer(c.column(1))
                best, lo, hi = m.score(data, offs)
                bad = best > cut
                said: list[str | None] = [None] * len(best)
                for k in np.flatnonzero(bad).tolist():
                    row = data[offs[k] : offs[k + 1]]
                    stops = np.flatnonzero(_END[row])
                    a, e = lo[k] - offs[k], hi[k] - offs[k]
                    i, j = np.searchsorted(stops, a), np.searchsorted(stops, e)
                    begin, end = (stops[i - 1] + 1 if i else 0), (stops[j] + 1 if j < len(stops) else len(row))
                    said[k] = row[begin:end].tobytes().decode("utf-8", "replace").strip()
                yield pa.RecordBatch.from_arrays([c.column(0).cast(pa.int64()), pa.array(best), pa.array(bad.astype(np.int32)), pa.array(said, pa.string())], names=["doc_id", "score", "toxic", "sentence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), SCORES)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without its toxic rows, row by row: null, repeated and clashing ids change nothing; all columns stay."""
    cut = model.cut
    sent = docs.sparkSession.sparkContext.broadcast((model.w, model.bias, model.landmarks))
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for b in batches:
            for c in ts.chunks(b):
                best, _, _ = m.score(*ts.text_buffer(c.column(where)))
                yield c.filter(pa.array(best <= cut))

    return docs.mapInArrow(tidy(run), docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op9_toxicity": op9_toxicity}
SQL: dict[str, str] = {}
