"""Plain versions of the operators, row by row, to compare with."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ORDER = ["assign", "access", "hex"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def token_shards(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = {}, 0
    for doc_id, text in sorted(docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out[doc_id] = (start, len(ids), crc(ids))
        start += len(ids)
    return out


def secrets(docs):
    patterns = {"assign": re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
                "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    out = {}
    for doc_id, text in docs:
        found = []
        for kind, pattern in patterns.items():
            for m in pattern.finditer(text or ""):
                if len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                    found.append((m.start(), ORDER.index(kind), m.end()))
        found.sort()
        out[doc_id] = (*(sum(k == n for _, k, _ in found) for n in range(3)), sha(",".join(f"{ORDER[k]}:{a}:{b}" for a, k, b in found)))
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        words = WORD.findall((text or "").translate(A_Z))
        for i in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[i:i + 10])].add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = {}
    for doc_id, text in docs:
        words = WORD.findall((text or "").translate(A_Z))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                got = windows.get(tuple(words[i:i + n]))
                if got:
                    hit.update(range(i, i + n))
                    found |= got
        out[doc_id] = (len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def exact(docs):
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[(text or "").translate(A_Z)].append(doc_id)
    return {d: (max(ids), len(ids), d == max(ids), sha(text)) for text, ids in groups.items() for d in ids}


def fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_Z))
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict, bits=4):
    """(key -> smallest key reachable) by comparing all pairs of fingerprints."""
    keys = sorted(prints)
    values = np.array([prints[k] for k in keys], np.uint64)
    root = list(range(len(keys)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ v) <= bits) + i + 1:
            a, b = top(i), top(int(j))
            root[max(a, b)] = min(a, b)
    return {k: keys[top(i)] for i, k in enumerate(keys)}


def simhash(docs):
    prints = {d: fingerprint(t) for d, t in docs}
    roots = components(prints)
    return {d: (f"{prints[d]:016x}", roots[d]) for d in prints}


def conversations(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def fill_in_middle(docs, salt="1"):
    out = []
    for doc_id, text in docs:
        text = text or ""
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        code = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h = [int(code[8 * k:8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            out.append((doc_id, len(units), "plain", None, None, text))
        elif h[3] % 100 < 20:
            out.append((doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"))
        else:
            out.append((doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"))
    return out


def substrings(docs, width=35):
    """(key, words, removed, kept words) of every row."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in docs]
    starts = defaultdict(int)
    for w in words:
        for i in range(len(w) - width + 1):
            starts[tuple(w[i:i + width])] += 1
    out = []
    for (doc_id, _), w in zip(docs, words, strict=True):
        gone = {at for i in range(len(w) - width + 1) if starts[tuple(w[i:i + width])] > 1 for at in range(i, i + width)}
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def ranked(docs, items, k=10):
    """(item, rank, key, score) with ties by key, nulls last."""
    terms = [WORD.findall((t or "").translate(A_Z)) for _, t in docs]
    sizes = [len(t) for t in terms]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    held = [{t: w.count(t) for t in set(w)} for w in terms]
    df = defaultdict(int)
    for h in held:
        for t in h:
            df[t] += 1
    out = []
    for item, text in items:
        asked = WORD.findall((text or "").translate(A_Z))
        scores = []
        for (doc_id, _), h, n in zip(docs, held, sizes, strict=True):
            score = 0
            for t in asked:
                if t in h:
                    norm = 25 + (75 * n * n_docs) // n_terms
                    score += int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df[t] + 1)))) * ((10 ** 9 * h[t]) // (1000 * h[t] + 8 * norm))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, n + 1, key, -s) for n, (s, _, _, key) in enumerate(sorted(scores, key=lambda r: r[:3])[:k])]
    return out


def label_model(votes, counts, prior, false_alarm, finds, finds_others, rounds):
    """(posterior of good by pattern, accuracies) by plain expectation-maximisation; votes 1 good, 0 bad, -1 none."""
    kinds = len(votes[0])
    classes = range(kinds + 1)

    def belief(c, n, side):
        bad = false_alarm if c == 0 else finds if c == n + 1 else finds_others
        return prior * (bad if side == 0 else 1 - bad)

    share = []
    for v in votes:
        good = 0.05 if 0 in v else 0.95
        blame = [(1 if x == 0 else 0) + 1e-3 for x in v]
        share.append([good, *((1 - good) * b / sum(blame) for b in blame)])
    for _ in range(rounds):
        table = {(c, n, s): belief(c, n, s) for c in classes for n in range(kinds) for s in (0, 1)}
        size = [prior / (kinds + 1)] * (kinds + 1)
        for v, k, r in zip(votes, counts, share, strict=True):
            for c in classes:
                size[c] += r[c] * k
                for n, x in enumerate(v):
                    if x >= 0:
                        table[c, n, x] += r[c] * k
        for i, v in enumerate(votes):
            likely = []
            for c in classes:
                p = np.log(size[c] / sum(size))
                for n, x in enumerate(v):
                    if x >= 0:
                        p += np.log(table[c, n, x] / (table[c, n, 0] + table[c, n, 1]))
                likely.append(p)
            top = [np.exp(p - max(likely)) for p in likely]
            share[i] = [t / sum(top) for t in top]
    right = []
    for n in range(kinds):
        total = sum(table[c, n, s] for c in classes for s in (0, 1))
        right.append((table[0, n, 1] + sum(table[c, n, 0] for c in classes if c)) / total)
    return [r[0] for r in share], right
