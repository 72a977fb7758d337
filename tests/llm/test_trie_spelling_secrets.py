"""The prefix trie, spelling variants and secret scans against brute force."""

import hashlib
import math
import random
import re
import zlib

import pytest

from plumbline.llm import prefix_trie, secrets, spelling


def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members, children = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved, out = {}, {}, set()
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[b] for b in below) or 1
        saved[path] = (len(members[path]) - 1) * words + sum(saved[b] for b in below)
        ends = ",".join(map(str, sorted(c for c in members[path] if len(built[c]) == len(path))))
        out.add((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(below),
                 leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def spark_trie(df):
    built = prefix_trie.with_borrowed_starts(prefix_trie.turn_sequences(df), "conv_id", "turns", block=20, most=3)
    rows = [tuple(r) for r in prefix_trie.prefix_trie(built).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("cells", [1 << 20, 60])
def test_trie(spark, monkeypatch, cells):
    """Nulls everywhere, ties of turns, repeated rows, negative keys, a hot first turn, equal conversations, a long one."""
    monkeypatch.setattr(prefix_trie, "SHARD_CELLS", cells)
    r = random.Random(1)
    rows = [(None, 1, "user", "x"), (3, 0, "user", "twice"), (3, 0, "user", "twice")]
    for c in range(-25, 120):
        rows += [(c, r.choice([t, t, t, None]), r.choice(["user", None, "assistant"]), r.choice(["a b", "c", "", None, "d e f"]))
                 for t in range(r.choice([1, 1, 2, 3, 5]))]
    rows += [(1000 + i, 0, "user", "hot one") for i in range(150)]
    rows += [(5000, i, "u", f"w {i % 3}") for i in range(90)] + [(5019, i, "u", f"w {i % 3}") for i in range(70)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "conv_id long, turn long, role string, text string, side int, ids int")
    assert spark_trie(df.repartition(5)) == plain_trie(rows)


def test_trie_empty_and_member_pieces(spark, monkeypatch):
    df = spark.createDataFrame([(i, 0, "u", "same") for i in range(300)], "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(prefix_trie, "PIECE", 64)
    assert spark_trie(df.limit(0)) == set()
    assert spark_trie(df) == plain_trie([tuple(r) for r in df.collect()])


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def test_pairs_of_automata():
    r = random.Random(2)

    def equal_start(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    for _ in range(120):
        words = sorted({"".join(r.choice("abé") for _ in range(r.choice([4, 5, 5, 6]))) for _ in range(r.choice([1, 3, 10, 40]))})
        for shared, last in ((0, None), (2, None), (2, 2), (0, 0)):
            got = sorted(tuple(sorted(p)) for p in zip(*(x.tolist() for x in spelling.pairs(words, shared, last))))
            assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words))
                           if near(words[i], words[j]) and shared <= equal_start(words[i], words[j]) <= (99 if last is None else last)]


@pytest.mark.parametrize("group", [1 << 15, 6])
def test_variant_groups(spark, monkeypatch, group):
    """Groups cut by the place of the edit give the same pairs; long words, short ones, ties and chains."""
    monkeypatch.setattr(spelling, "GROUP_WORDS", group)
    r = random.Random(3)
    words = {"".join(r.choice("abéß") for _ in range(r.choice([7, 8, 9]))): r.choice([2, 3, 25, 300, 4000]) for _ in range(200)}
    words |= {"aaaaaaa" + "".join(r.choice("abé") for _ in range(r.choice([3, 4]))): r.choice([2, 30, 400]) for _ in range(150)}
    words |= {"x" * 2000: 2, "x" * 1999: 50, "a": 3, "ab": 30, "b": 30, "chain": 2, "chainz": 20, "chainzz": 200, "chainzzy": 2000}
    got = {tuple(x) for x in spelling.variant_groups(
        spark.createDataFrame([(w, n, 0) for w, n in words.items()], "word string, n long, best int").repartition(3)).collect()}
    form, others = {}, {w: [v for v in words if near(w, v)] for w in words}
    for w, found in others.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    expected = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        expected.add((w, form[w], root, words[w], len(others[w]), words.get(form[w])))
    assert got == expected
    assert spelling.variant_groups(spark.createDataFrame([], "word string, n long")).count() == 0


def test_typo_counts(spark):
    texts = ["Overflow OVERFLOW overflow, overflowing", None, "", "ÀÉÎÕÜßÿ àéîõüßÿ ÀÉÎÕÜßÿ" * 3, "word " * 5000 + "lengthy " * 3000,
             "Q" * 5000 + " " + "Q" * 5000]
    rows = [(None if i == 3 else i % 7, texts[i % len(texts)]) for i in range(60)]
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, word string")
    counts = {}
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] = counts.get(run, 0) + 1
    assert {tuple(r) for r in spelling.typo_counts(df.repartition(4)).collect()} == {x for x in counts.items() if x[1] >= 2}
    assert spelling.typo_counts(df.limit(0)).count() == 0


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
PLAIN = [("assign", ASSIGN, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def plain_findings(text):
    return sorted((m.start(), rank, kind, m.end()) for rank, (kind, pattern, group, least) in enumerate(PLAIN)
                  for m in pattern.finditer(text or "") if len(m[group]) >= least)


def test_secrets(spark):
    """Matches too short to count hide later ones; spans are in code points; null, empty, repeated and long texts."""
    r = random.Random(4)
    bits = ["password", "PassWD", "token", ":", " = ", "'", '"', "api_key", "APIKEY", "secret", "AKIA", "ABCD1234" * 2,
            "0123456789abcdef", "deadbeef" * 3, "é", " ", "x", "\n", "abc", "longvalue1", "=", "𝒳", "ghp_" + "a1" * 18, "ſecret"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 25)))) for i in range(600)]
    rows += [(None, "token: abcdefgh"), (1, None), (1, "token=zzzzzzzz"), (1, "token=zzzzzzzz"), (2, ""),
             (7, "a" * 50000 + " token: token: abcdefgh token=123456")]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "doc_id long, text string, kinds string, t int").repartition(4)
    got = [(x.doc_id, [tuple(f) for f in x.findings if f.rank < 3]) for x in secrets.find_secrets(df).collect()]
    assert sorted(got, key=str) == sorted([(k, plain_findings(t)) for k, t in rows], key=str)
    assert secrets.find_secrets(df.limit(0)).count() == 0
    more = secrets.find_secrets(df).filter("exists(findings, f -> f.kind = 'code_host')").count()
    assert more == sum("ghp_" + "a1" * 18 in (t or "") for _, t in rows)


def test_trigram_queries():
    """Every match fulfils its rule's query; rules without mandatory trigrams have none."""
    samples = {"assign": ["api_key=abcdef", "APIKEY: abcdef", "Passwd='x.y-z_"], "access": ["AKIA" + "Z9" * 8], "hex": ["0" * 24],
               "chat": ["xoxb-1234567890"], "map_key": ["AIza" + "b" * 35], "payment": ["rk_live_" + "7" * 16],
               "web_token": ["eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK"], "private_key": ["-----BEGIN RSA PRIVATE KEY-----"],
               "code_host": ["ghs_" + "Q" * 36]}
    for rule in (*secrets.GIVEN, *secrets.MORE):
        query = secrets.trigram_query(rule.pattern)
        assert bool(query) == (rule.kind != "hex")
        for text in samples[rule.kind]:
            assert re.fullmatch(rule.pattern, text)
            assert all(any(all(g in text.lower() for g in option) for option in clause) for clause in query)
    assert secrets.trigram_query("ab|cdefg") == [] and secrets.trigram_query("x*abc[0-9]+(?:de|fgh)i") == [
        [frozenset({"abc"})], [frozenset({"dei"}), frozenset({"fgh", "ghi"})]]
