import hashlib
import re

import numpy as np
import pytest

from corpusgrep.llm.pii import KINDS, base_spans, candidates, mask, op4_bootstrapped_contexts

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(EMAIL, text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(CARD, text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(PHONE, text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_patterns():
    texts = ["a@b.c", "a@b.c@d.e f@g", "x.y+z@mail-1.example.com.", "@a.b", "a@@b.c", "a@b..c", "1.2.3.4.5.6.7.8", "256.1.1.1", "01.002.3.0255", "4111 1111-1111 1111", "4111111111111111 4111111111111112",
             "+1 (487) 555-7209)", "+1((", "+12", "+1234567890123456", "é +44 20 7946 0958é", "1.2.3.4@5.6", "a" * 3000 + "@", "9" * 3000]
    rng = np.random.default_rng(0)
    texts += ["".join(rng.choice(list("a1.@-+ ()2é%"), 60)) for _ in range(3000)]
    for t in texts:
        assert base_spans(t) == plain(t), repr(t)


def query(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(str(tmp_path / "documents.parquet"))
    return {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in op4_bootstrapped_contexts(spark, str(tmp_path)).collect()}


def test_discovery(spark, tmp_path):
    rows = [(i, f"Some words and then reach me at u{i}@mail.example.com for more {i % 3}", "x") for i in range(30)]
    odd = "Other words so reach me at jo[at]x99 for more"
    rows += [(100, odd.replace("jo[at]x99", "jo_at_x99"), "x"), (101, "we counted at least 12345678 things", "x"), (102, None, None), (103, "", ""), (None, "n", "")]
    rows += [(200 + i, f"of all things at least 4{i}77{i} were seen", "x") for i in range(9)] + [(300, "at least a@b.cd came", "")]
    got = query(spark, tmp_path, rows)
    assert len(got) == len(rows)
    added = {g[0]: g[6] for g in got if hashlib.sha256(g[6].encode()).hexdigest() != g[5]}
    text = rows[30][1]
    at = text.index("jo_at_x99")
    assert added == {100: f"email:{at}:{at + 9}"}
    for k, t, _ in rows:
        spans = plain(t or "")
        base = ",".join(f"{KINDS[i]}:{a}:{b}" for a, i, b in spans)
        assert any(g[0] == k and g[1:5] == tuple(sum(i == n for _, i, _ in spans) for n in range(4)) and g[5] == hashlib.sha256(base.encode()).hexdigest() for g in got)


def additions(got):
    return {g[0]: g[6] for g in got if hashlib.sha256(g[6].encode()).hexdigest() != g[5]}


def test_discovery_of_groups(spark, tmp_path):
    seeds = [(i, f"Line and so call me at +1 ({200 + i}) 555-55{10 + i} for more", None) for i in range(40)]
    unseen = ["555 123 4567", "(555) 123-4567", "555.123.4567", "+1 (555) 1234", "jane [at] example [dot] com", "jane at example dot com", "x" * 70 + "7", "12345678"]
    texts = [f"Other words call me at {u} for more" for u in unseen] + ["Then call me at 4111 1111 1111 1112.", "Then call me at (555 123 4567) now", "Then call me at 12345678. 2 of them came"]
    rows = seeds + [(100 + i, t, None) for i, t in enumerate(texts)]
    want = {100 + i: f"phone:{t.index(u)}:{t.index(u) + len(u)}" for i, (t, u) in enumerate(zip(texts, [*unseen, "4111 1111 1111 1112", "555 123 4567", "12345678"], strict=True))}
    assert additions(query(spark, tmp_path, rows)) == want


def test_one_word_labels(spark, tmp_path):
    seeds = [(i, f"w{i}a v{i}b Phone: +1 ({200 + i}) 555-55{10 + i} u{i}c", None) for i in range(20)]
    seeds += [(50 + i, f"w{i}a v{i}b x{i}@mail.example.com (Mailbox) u{i}c", None) for i in range(20)]
    rows = [*seeds, (100, "odd even Phone: 555-123-4567 more", None), (101, "Phone: 555 123 9999", None), (102, "see jo_at_x99 (mailbox)", None), (103, "see jo_at_x98 there", None)]
    assert additions(query(spark, tmp_path, rows)) == {100: "phone:16:28", 101: "phone:7:19", 102: "email:4:13"}


def test_discovered_instances_are_seeds(spark, tmp_path):
    level = [[f"u{i}@mail.example.com" for i in range(1000)], *([f"no_{j}_{i:03}x" for i in range(n)] for j, n in enumerate((250, 60, 14, 3), 1))]
    texts = [f"left{c} near{c} {s} right{c}" for j, c in enumerate("abcd") for s in level[j] + level[j + 1]]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    want = {i: f"email:12:{12 + len(s)}" for i, t, _ in rows if "@" not in (s := t.split()[2])}
    assert additions(query(spark, tmp_path, rows)) == want


def brute_additions(rows):
    """Spans that contexts add, by loops over the definition."""
    def clean(w):
        return w.strip(".,;:!?\"'()[]{}<>").lower()

    def around(t, a, b):
        plain_words = lambda ws: not any(c.isdigit() or c == "@" for w in ws for c in w)
        blanks = r"[\x20\x09-\x0D]+"
        before = [w for w in map(clean, re.split(blanks, t[:a])) if w]
        after = [w for w in [clean(w) for w in re.split(blanks, t[b:]) if w][:2] if w][:1]
        for n in (1, 2, 3):
            if len(before) >= n and plain_words(before[-n:]):
                yield f"{n} {' '.join(before[-n:])} _"
        if after and plain_words(after):
            yield f"0 _ {after[0]}"
            if before and plain_words(before[-1:]):
                yield f"1 {before[-1]} _ {after[0]}"

    places, edges = [], {}
    for k, t, *_ in rows:
        base = plain(t or "")
        for a, kind, b in [*base, *((a, None, b) for a, b in candidates(t or "", base))]:
            for c in around(t, a, b):
                places.append((k, t, a, b, kind, c))
                edges.setdefault(c, set()).add(t[a:b].lower())
    known = {}
    for _, t, a, b, kind, _ in places:
        if kind is not None:
            known[t[a:b].lower()] = min(kind, known.get(t[a:b].lower(), 9))
    found = {}
    while True:
        sure = {}
        for c, strings in edges.items():
            for of in range(4):
                masses = [1.0 if known[s] == of else 0.0 for s in strings if s in known] + [found.get((s, of), 0.0) for s in strings if s not in known]
                less = sum(0.25 * (1 - found.get((s, of), 0.0)) for s in strings if s not in known)
                if sum(m > 0 for m in masses) >= 5 and sum(masses) / (len(strings) - less + 1) >= 0.75 - 1e-12:
                    sure[c, of] = sum(masses) / (len(strings) - less + 1)
        new = {}
        for (c, of), p in sure.items():
            for s in edges[c] - known.keys():
                new[s, of] = 1 - (1 - new.get((s, of), 0.0)) * (1 - p)
        if new.keys() == found.keys() and all(abs(new[x] - found[x]) < 1e-7 for x in new):
            break
        found = new
    best = {}
    for k, t, a, b, kind, c in places:
        for of in range(4):
            if kind is None and (c, of) in sure:
                best[k, a, b] = max(best.get((k, a, b), (0, 0)), (round(found[t[a:b].lower(), of], 6), -of))
    return {(k, KINDS[-of], a, b) for (k, a, b), (_, of) in best.items() if not any(k2 == k and (a2 <= a and b <= b2) and (a2, b2) != (a, b) for k2, a2, b2 in best)}


def planted(seed):
    """Texts with labelled identifiers of usual and unusual forms, and numbers that are none; and which of the unusual are planted."""
    rng = np.random.default_rng(seed)
    words = [f"word{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    usual = {3: lambda: f"+1 ({d(3)}) 555-{d(4)}", 0: lambda: f"u{d(5)}@mail.example.com", 1: lambda: ".".join(str(rng.integers(256)) for _ in range(4))}
    unseen = {3: lambda: rng.choice([f"555 {d(3)} {d(4)}", f"(555) {d(3)}-{d(4)}"]), 0: lambda: f"u{d(5)} [at] mail [dot] com", 1: lambda: f"fe80::{d(4)}:{d(3)}a"}
    labels = {3: ["call me at", "phone:", "ring us on"], 0: ["mail to", "write us at"], 1: ["host at", "server"]}
    rows, truth = [], set()
    for i in range(400):
        kind, is_usual = int(rng.choice([0, 1, 3])), rng.random() < 0.8
        identifier = str((usual if is_usual else unseen)[kind]())
        left = " ".join(rng.choice(words, rng.integers(1, 9))) + " " + str(rng.choice(labels[kind])) + " "
        rows.append((i, f"{left}{identifier} {' '.join(rng.choice(words, rng.integers(1, 9)))} {d(6)} {rng.choice(words)}", None))
        if not is_usual:
            truth.add((i, KINDS[kind], len(left), len(left) + len(identifier)))
    rows += [(1000 + i, f"{rng.choice(words)} {rng.choice(['look at', 'seen us at', 'the server with'])} {d(7)} {rng.choice(words)}", None) for i in range(120)]
    return rows, truth


@pytest.mark.parametrize("seed", [0, 1])
def test_planted(spark, tmp_path, seed):
    rows, truth = planted(seed)
    added = {(k, p.split(":")[0], *map(int, p.split(":")[1:])) for k, spans in additions(query(spark, tmp_path, rows)).items() for p in spans.split(",")}
    base = {(k, KINDS[i], a, b) for k, t, _ in rows for a, i, b in plain(t)}
    assert added - base == brute_additions(rows)
    assert len(truth & added) >= 0.5 * len(truth)


def test_recall_of_unseen_identifiers():
    found = [(truth, brute_additions(rows)) for rows, truth in map(planted, range(10))]
    planted_, caught, added = (sum(len(f(t, g)) for t, g in found) for f in (lambda t, g: t, lambda t, g: t & g, lambda t, g: g))
    print("unseen identifiers", planted_, "caught", caught, "added", added)
    assert caught >= 0.6 * planted_ and caught >= 0.93 * added


def test_far_words(spark, tmp_path):
    rows = [(i, f"reach {'-' * 300} me {' ' * 500}at u{i}@mail.example.com", None) for i in range(9)]
    text = f"reach {'-' * 300} me {' ' * 500}at jo_at_x99"
    assert additions(query(spark, tmp_path, [*rows, (50, text, None)])) == {50: f"email:{len(text) - 9}:{len(text)}"}


def test_candidates():
    places = lambda t: [t[a:b] for a, b in candidates(t, base_spans(t))]
    assert places("no 12 34 5 a@b.cd 555 1234, 99 12ab34 7") == ["12 34 5", "555 1234", "12ab34"]
    assert places("9" * 3000) == ["9" * 3000] and places("we (at) home") == ["we (at) home"] and places("look at me") == []
    assert places("1 2 " * 20000) == [("1 2 " * 20000).strip()]


def test_mask(spark):
    rows = [(1, "é mail a@b.cd or 10.0.0.1, card 4111 1111 1111 1111.", "k"), (2, None, "k"), (3, "none", None), (None, "a@b.cd", "k"), (1, "dup a@b.cd", "k"), (1, "dup a@b.cd", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(map(tuple, mask(spark, df).collect()), key=str)
    assert mask(spark, df).columns == df.columns
    want = [(1, "é mail [EMAIL] or [IP], card [CARD].", "k"), (2, None, "k"), (3, "none", None), (None, "[EMAIL]", "k"), (1, "dup [EMAIL]", "k"), (1, "dup [EMAIL]", "k")]
    assert got == sorted(want, key=str)


def test_empty(spark, tmp_path):
    assert query(spark, tmp_path, []) == set()
