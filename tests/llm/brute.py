"""Plain single-machine versions of the operators, for comparison in tests."""

import hashlib
import re

SF_SMALL = "/root/testdata/sf0.001"

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text):
    """(start, place of the kind, end) of every fixed-pattern span."""
    out = []
    for place, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), place, m.end()))
    return sorted(out)


def written(spans):
    names = [*BASE, "number", "secret"]
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)


def base_digest(text):
    spans = base_spans(text)
    counts = tuple(sum(k == place for _, k, _ in spans) for place in range(4))
    return counts + (hashlib.sha256(written(spans).encode()).hexdigest(),)


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def roots(nodes, links):
    """Smallest node connected to each node."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def similar(rows, width, percent):
    """(doc_id, n_shingles, component_id) of every row, all pairs compared.

    Rows with one id are one document, rows without an id one for each text.
    """
    nodes = [(0, d, "") if d is not None else (1, 0, t or "") for d, t in rows]
    sets = [shingles(t, width) for _, t in rows]
    full = [(n, s) for n, s in zip(nodes, sets) if s]
    links = []
    for i, (a, x) in enumerate(full):
        for b, y in full[:i]:
            common = len(x & y)
            if 100 * common >= percent * (len(x) + len(y) - common):
                links.append((a, b))
    found = roots(set(nodes), links)
    return [(d, len(s), found[n][1] if found[n][0] == 0 else None) for (d, _), n, s in zip(rows, nodes, sets)]


def line_dedup(rows, min_lines, min_words):
    """Text of each (doc_id, text) without later copies, by document order."""
    seen_lines, seen_runs, out = set(), set(), {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        if t is None:
            out[d, t] = None
            continue
        lines, gone = t.split("\n"), set()
        for i, line in enumerate(lines):
            if line in seen_lines and len(WORD.findall(line)) >= min_words:
                gone.add(i)
            seen_lines.add(line)
            run = tuple(lines[i:i + min_lines])
            if len(run) == min_lines:
                if run in seen_runs:
                    gone.update(range(i, i + min_lines))
                seen_runs.add(run)
        out[d, t] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def line_runs(rows, min_lines):
    """(doc_id, pos, lines) of each longest repeated run that is not the rest of a longer one."""
    texts = [(d, t.split("\n")) for d, t in set(rows) if t is not None]
    longest = {}
    for i, (d, x) in enumerate(texts):
        for p in range(len(x)):
            for j, (_, y) in enumerate(texts):
                for q in range(len(y)):
                    n = 0
                    while (i, p) != (j, q) and p + n < len(x) and q + n < len(y) and x[p + n] == y[q + n]:
                        n += 1
                    longest[i, p] = max(longest.get((i, p), 0), n)
    return sorted((texts[i][0], p, n) for (i, p), n in longest.items()
                  if n >= min_lines and longest.get((i, p - 1)) != n + 1)


def top_k(vectors, queries, k):
    out = []
    for q, v in queries:
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), c) for c, w in vectors
                         if c != q and len(v) == len(w)))
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored[:k])]
    return sorted(out)
