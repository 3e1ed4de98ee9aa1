"""Plain, slow versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_duplicates(docs, percent=85):
    """doc_id -> (n_shingles, component_id, kept)"""
    sets = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            having[x].append(d)
    common = Counter()
    for ds in having.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                common[min(a, b), max(a, b)] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def base_quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    repeat = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), len(w) < 10 or 100 * len(repeat) > 20 * len(w))


def quality(text):
    """(clean_text, kept) by the line rules, in Python's own strings and patterns."""
    import unicodedata

    import regex

    from loomledger.llm import quality as rules

    text, limits = text or "", rules.QualityRules()
    ascii_only = lambda p: p.replace(r"\s", r"[ \t\n\x0b\f\r]").replace(r"\S", r"[^ \t\n\x0b\f\r]").replace(r"\d", "[0-9]")
    structure, terminal = regex.compile(ascii_only(rules.STRUCTURE)), regex.compile(ascii_only(rules.TERMINAL))
    phrase = regex.compile(r"(?<![\p{L}\p{N}_])(?:" + "|".join(map(regex.escape, rules.BOILERPLATE)) + r")(?![\p{L}\p{N}_])")

    def stays(line):
        n, low = len(WORD.findall(line)), line.lower()
        if n <= limits.boilerplate_words and (phrase.search(low) or structure.search(low)):
            return False
        if not n:
            return True
        marks, symbols = (sum(c in some for c in line) for some in (rules.SEPARATORS, rules.SYMBOLS))
        kinds = [unicodedata.category(c) for c in line]
        shouted = "!!" in line and 2 * kinds.count("Lu") > sum(k[0] == "L" for k in kinds)
        return not (n < limits.short_line and not terminal.search(line) or marks >= 3 and marks * 12 >= n or marks * 3 >= n or symbols * 4 > n or shouted)

    clean = "\n".join(line for line in text.split("\n") if stays(line))
    failed = base_quality(text)[-1]
    return clean, not failed and 100 * (len(text) - len(clean)) <= limits.max_lost_pct * len(text) and clean.strip(" ") != ""


def repeats(docs, length=400):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)"""
    data = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = {}
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


def unigram(docs):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)"""
    tokens = {d: [*WORD.findall((t or "").translate(LOWER)), None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = Counter(w for d, ts in tokens.items() if not held[d] for w in ts)
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(ts), sum(c[w] > 0 for w in ts), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ts)) for d, ts in tokens.items()}


def captures(pages):
    """page_id -> (payload_bytes, digest, record_type, refers_to)"""
    data = {p: (h or "").encode() for p, h in pages}
    digest = {p: hashlib.sha256(b).hexdigest() for p, b in data.items()}
    first = {}
    for p in sorted(data):
        first.setdefault(digest[p], p)
    return {p: (len(b), digest[p], *(("revisit", first[digest[p]]) if len(b) >= 100 and first[digest[p]] != p else ("response", None))) for p, b in data.items()}


def first_fit_decreasing(lengths, capacity):
    """What each bin holds."""
    bins = []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, used in enumerate(bins) if used + n <= capacity), None)
        if k is None:
            bins.append(n)
        else:
            bins[k] += n
    return bins


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def line_dedup(docs, similarity=0.8, min_words=5):
    """doc_id -> (n_lines, n_removed, clean_text), comparing all lines with all."""
    at = defaultdict(list)
    for d, t in docs:
        for k, x in enumerate((t or "").split("\n")):
            if norm := re.sub(r"[\W_]+", " ", re.sub(r"\d", "0", x.lower())).strip():
                at[norm].append((d, k))
    parent = {x: x for x in at}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    long = [x for x in at if len(x.split(" ")) >= min_words]
    for i, a in enumerate(long):
        for b in long[:i]:
            allowed = int(max(len(a), len(b)) * (1 - similarity) + 1e-9)
            if abs(len(a) - len(b)) <= allowed and edit_distance(a, b) <= allowed:
                parent[find(a)] = find(b)
    group = defaultdict(list)
    for x, places in at.items():
        group[find(x)] += places
    gone = {p for places in group.values() for p in places if p != min(places)}
    out = {}
    for d, t in docs:
        x = (t or "").split("\n")
        kept = [line for k, line in enumerate(x) if (d, k) not in gone]
        out[d] = (len(x), len(x) - len(kept), "\n".join(kept))
    return out


def contaminated(docs, items, threshold, overlap, k1=1.2, b=0.75):
    """(doc_id, item_id) -> (word_start, score, question_overlap, answer_overlap), scoring every passage against every item."""
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    items = [(i, t) for i, t in dict.fromkeys(items) if split(t)]
    tokens = [split(t) for _, t in items]
    mean, span = sum(map(len, tokens)) / len(tokens), max(map(len, tokens))
    df = Counter(w for t in tokens for w in set(t))
    weights = []
    for t in tokens:
        raw = {w: math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(t) / mean)) for w, f in Counter(t).items()}
        weights.append({w: x / sum(raw.values()) for w, x in raw.items()})

    def share(part, passage):
        n = min(5, len(part))
        grams = lambda x: {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
        return len(grams(part) & grams(passage)) / len(grams(part))

    out = {}
    for d, text in docs:
        x = split(text)
        for at in range(0, max(len(x) - span, 1), span):
            passage = x[at : at + 2 * span]
            for (i, t), w in zip(items, weights):
                score = sum(v for k, v in w.items() if k in set(passage))
                *question, answer = t.split("\n")
                q, a = share(split(" ".join(question)), passage), share(split(answer), passage)
                if score >= threshold - 1e-9 and q >= overlap and a >= overlap:
                    new = (score, -at, q, a)
                    out[d, i] = max(out.get((d, i), new), new)
    return {k: (-at, round(s, 5), q, a) for k, (s, at, q, a) in out.items()}


def alignment(docs, a_path, b_path):
    """What ``align.align`` returns, by encoding whole texts and walking through the tokens of both sides."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    from loomledger.llm.align import byte_level_bytes, piece_bytes

    first, second = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
    first.encode_special_tokens = True
    a_bytes, b_bytes = byte_level_bytes(first), piece_bytes(second)
    found, counts = [], Counter()
    for doc_id, text in docs:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        if not b"".join(a_bytes[k] for k in a) == (" " + (text or "")).encode() == b"".join(b_bytes[k] for k in b):
            a, b = [], []
        links, groups, i, j, at_a, at_b, open_a, open_b = [], [], 0, 0, 0, 0, [], []
        while i < len(a):
            end_a, end_b = at_a + len(a_bytes[a[i]]), at_b + len(b_bytes[b[j]])
            links.append((a[i], b[j]))
            if end_a <= end_b:
                open_a.append(str(a[i]))
                i, at_a = i + 1, end_a
            if end_b <= end_a:
                open_b.append(str(b[j]))
                j, at_b = j + 1, end_b
            if end_a == end_b:
                groups.append(",".join(open_a) + "|" + ",".join(open_b))
                open_a, open_b = [], []
        counts.update(links)
        found.append((doc_id, len(a), len(b), groups, links))
    best = Counter()
    for (_, k), n in counts.items():
        best[k] = max(best[k], n)
    sha = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return [(doc_id, a, b, len(g), len(x), sum(counts[k] == best[k[1]] for k in x), sum(counts[k] for k in x), sha(g)) for doc_id, a, b, g, x in found]


def repaired(rows):
    """What ``repair.repair`` returns for damaged rows ``conv_id, turn, role, text``: all edits tried, cheapest and then least audit."""
    from functools import cache

    conversations: dict = {}
    for conv_id, turn, role, text in rows:
        role, text, key = " " if role is None else role, " " if text is None else text, ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        kind, kept = zlib.crc32(key.encode()) % 20, conversations.setdefault(conv_id, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv_id, kept in conversations.items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        faults, seen = [], set()
        for _, role, text in kept:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        letters = "".join(role[:1] or "-" for _, role, _ in kept)

        @cache
        def best(i, made, added, kept=kept, faults=faults):
            """The cheapest way on from row i; ``made``: the last initial so far, ``added``: turns just inserted."""
            role_now = "assistant" if made == "u" else "user"
            more = [(5, "I", (role_now, ""), i, role_now[0], added + 1)] if added < 3 else []
            if i < len(kept):
                _, role, text = kept[i]
                more.append((2, "D", None, i + 1, made, 0))
                if faults[i] not in ("blank", "duplicate"):
                    late = 5 if faults[i] == "truncated" else 0
                    if role and role[0] in {"": "su", "s": "u", "u": "a", "a": "u"}[made]:
                        more.append((late, "K", (role, text), i + 1, role[0], 0))
                    more.append((1 + late, "R", (role_now, text), i + 1, role_now[0], 0))
            ways = [(0, "", ())] if i == len(kept) and made in ("", "a") else []
            for cost, edit, row, *to in more:
                rest = best(*to)
                ways.append((cost + rest[0], edit + rest[1], ((row,) if row else ()) + rest[2]))
            return min(ways, key=lambda x: x[:2], default=(1 << 30, "", ()))

        cost, audit, turns = best(0, "", 0)
        numbers = [t for t, _, _ in kept if t is not None]
        out.append(
            (conv_id, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
             sum(x + y not in ("su", "ua", "au") for x, y in zip(letters, letters[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())
        )
    return out


PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    """The base spans of a text by kind."""
    right = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d),
        "phone": lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return {kind: [(m.start(), m.end()) for m in re.finditer(p, text or "") if right[kind](m.group())] for kind, p in PERSONAL.items()}
