"""Conversation trie, secret scan and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import credentials, runs, turntree

TURNS = "conv_id long, turn int, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# conversation prefix trie


def trie_by_force(conversations, rebuild):
    """{(smallest member, depth): row} from {conv_id: [(role, text), ...]}."""
    full = {}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = conversations.get(c - c % 20, [])[:h] + turns[h:] if rebuild else turns
    nodes = {}
    for c, turns in sorted(full.items()):
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        own = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += p not in children
    return sorted(
        (m[0], len(p), nodes[p[:-1]][0] if p else -1, len(m), children[p], leaves[p], saved[p],
         sha(",".join(str(c) for c in m if len(full[c]) == len(p)))) for p, m in nodes.items())


def trie_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = df.select(*names).collect()
    assert all((r.parent_conv_id is None) == (r.depth == 0) for r in rows)
    return sorted(tuple(-1 if v is None else v for v in r) for r in rows)


def talks(seed, n):
    """Conversations over few texts, with hot groups of equal ones, one after the other and of all lengths."""
    draw = random.Random(seed)
    texts = ["", "a", "a b", "c  d\ne", "é f"]
    out = {}
    for c in range(n):
        kind = draw.random()
        size = draw.randrange(7)
        out[c] = ([("user", "a b"), ("assistant", "a")] * 3 if kind < 0.35 else
                  [("user", "a")] * size if kind < 0.5 else [(draw.choice("uv"), draw.choice(texts)) for _ in range(size)])
    return out


def turn_frame(spark, conversations):
    return spark.createDataFrame([(c, i, r, t) for c, turns in conversations.items() for i, (r, t) in enumerate(turns)], TURNS)


@pytest.mark.parametrize("seed", range(3))
def test_trie_of_sequences(spark, seed, monkeypatch):
    """The operator alone, in many ranges that meet in several steps; id lists cross ranges in pieces."""
    monkeypatch.setattr(turntree, "RANGE", 60)
    monkeypatch.setattr(turntree, "FAN", 3)
    monkeypatch.setattr(turntree, "IDS", 5)
    conversations = talks(seed, 300)
    paths = [(c, b"".join(hashlib.sha256(repr(t).encode()).digest()[:16] for t in turns), [len(t[1].split()) for t in turns])
             for c, turns in conversations.items()]
    df = spark.createDataFrame(paths, "conv_id long, path binary, words array<long>")
    assert trie_rows(turntree.prefix_trie(df)) == trie_by_force(conversations, rebuild=False)


def test_trie_of_rebuilt_conversations(spark):
    conversations = {c: t for c, t in talks(7, 140).items() if t}
    assert trie_rows(turntree.rebuilt_trie(turn_frame(spark, conversations))) == trie_by_force(conversations, rebuild=True)


def test_trie_cases(spark):
    long = "w " * 300_000
    rows = [(5, None, None, None), (5, 0, "user", "x y"), (5, 0, "user", "x y"), (5, 1, "b", "1"), (5, 1, "a", "2"), (None, 0, "user", "lost"),
            (46, 3, "user", long), (60, 0, "user", "only")]
    df = spark.createDataFrame(rows, TURNS).withColumn("path", F.lit(1)).withColumn("position", F.lit(2)).withColumn("n_convs", F.lit(3))
    want = {5: [("", ""), ("user", "x y"), ("user", "x y"), ("a", "2"), ("b", "1")], 46: [("user", long)], 60: [("user", "only")]}
    assert trie_rows(turntree.rebuilt_trie(df)) == trie_by_force(want, rebuild=True)
    assert turntree.rebuilt_trie(df.limit(0)).count() == 0


def test_shared_turns():
    a = bytes(range(160))
    for n in range(11):
        assert turntree.shared_turns(a, a[:16 * n] + b"\xff" * 48) == n and turntree.shared_turns(a[:16 * n], a) == n


# secret scan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base_by_force(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return [(credentials.KINDS[k], s, e) for s, k, e in sorted(spans)]


def hexes(draw, n):
    return "".join(draw.choice("0123456789abcdef") for _ in range(n))


def secret_texts():
    draw = random.Random(11)
    texts = [None, "", "éè \U0001f600 Password: 'abcdef' secret=token: abcdefgh paſsword=abcdefg TOKEN==x.y+z API_KEY = \"a1b2c3\" token=short",
             "xAKIA" + "Z" * 16 + " AKIA" + "Q" * 15 + " AKIAAKIA" + "7" * 14 + " " + "0" * 23 + " " + "f" * 24 + "g" + "0" * 30]
    texts += [f"key {i}: password={hexes(draw, 18)} and more words" for i in range(60)]
    texts += [f"AKIA{''.join(draw.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') for _ in range(16))} used" for _ in range(60)]
    words = [(lambda: "".join(draw.choice(("er", "tion", "an", "the", "ing", "ou", "st")) for _ in range(8))),
             (lambda: "4" + "".join(draw.choice("0123456789") for _ in range(15))),
             (lambda: ".".join(str(draw.randrange(100, 256)) for _ in range(4)))]
    texts += [" ".join(draw.choice(words)() for _ in range(30)) for _ in range(60)]
    return texts


def test_secret_scan(spark):
    texts = secret_texts()
    draw = random.Random(12)
    bare, key = hexes(draw, 20), "AKIAX7Q2MD62HKU6"
    texts += [f"é bare {bare}, key {key}.", "card 4465758382889437 at 233.233.171.252, nothing here"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    df = df.unionByName(df.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    scorer = credentials.learned(df)
    rows = {r.doc_id: r for r in credentials.span_digest(credentials.secret_spans(df, scorer)).collect()}
    assert len(rows) == len(texts) + 1 and rows[None].spans == rows[4].spans
    for i, t in enumerate(texts):
        want = base_by_force(t or "")
        listed = [":".join(map(str, s)) for s in want]
        assert rows[i].base_sha256 == sha(",".join(listed)), t
        assert [rows[i].n_assign, rows[i].n_access, rows[i].n_hex] == [sum(s[0] == k for s in want) for k in credentials.KINDS]
        assert [x for x in rows[i].spans.split(",") if x and not x.startswith("format")] == listed
    n = len(texts)
    assert rows[n - 2].spans == f"format:7:27,format:33:{34 + len(key)}" and rows[n - 1].spans == ""
    assert not any("format" in rows[i].spans for i in range(4, n - 2))
    # the sample does not depend on partitions, and without labelled credentials nothing is added
    again = credentials.learned(df.repartition(7))
    assert again.odds(bare.encode()) == scorer.odds(bare.encode()) > credentials.ODDS
    clean = credentials.secret_spans(df, credentials.learned(df.where("doc_id >= 124 and doc_id < 184")))
    assert clean.where("exists(spans, s -> s.added)").count() == 0
    assert credentials.secret_spans(df.limit(0), credentials.learned(df.limit(0))).count() == 0


def test_sample_is_bounded_and_whole(spark):
    values = [hexes(random.Random(i), 30) for i in range(500)]
    df = spark.createDataFrame([(i, f"x {v} " * 3) for i, v in enumerate(values)], "doc_id long, text string")
    for partitions in (1, 6):
        rows = credentials._tokens(df.repartition(partitions), 20)
        smallest = sorted(credentials.xxhash.xxh3_64_intdigest(v.encode()) >> 1 for v in values)[:20]
        assert [r.hash for r in rows.where("kind = 'hex'").select("hash").distinct().orderBy("hash").limit(20).collect()] == smallest
        assert rows.count() <= 20 * partitions * 2


def test_automaton():
    draw = random.Random(5)
    keys = [b"AB" + bytes(draw.choice(b"0123456789") for _ in range(draw.randrange(4, 9))) for _ in range(400)]
    model = credentials.Automaton(keys)
    assert model.bits(b"AB12345") > model.bits(b"BA12345") + 5 and model.bits(b"AB12345") > model.bits(b"AB1234X") + 5
    assert len(model.table) < 40  # of about 400 * 6 states of the prefix tree
    # probabilities of a state's continuations and its end, with the floor of unseen ones, sum to one
    for row, end, unknown in model.table.values():
        total = sum(2 ** b for b, _ in row.values()) + 2 ** end + 2 ** unknown[0] * (credentials.SYMBOLS - len(row) - 1)
        assert abs(total - 1) < 1e-9
    assert credentials.Automaton([]).bits(b"x") < 0


# periodic runs


def runs_by_force(words):
    best, n = {}, len(words)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p) and j > i:
                best.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted(((s, length, p) for (s, length), p in best.items()), key=lambda r: (r[0], r[2]))


def random_words(draw):
    kinds = draw.choice((1, 2, 3, 6))
    words = [bytes([97 + draw.randrange(kinds)]) for _ in range(draw.randrange(60))]
    if words and draw.random() < 0.6:
        a, p = draw.randrange(len(words)), draw.randrange(1, 7)
        words[a:a] = (words[a:a + p] * 30)[:draw.randrange(1, 50)]
    return words


@pytest.mark.parametrize("block", (runs.BLOCK, 3))
def test_runs_by_force(monkeypatch, block):
    monkeypatch.setattr(runs, "BLOCK", block)
    draw = random.Random(block)
    for _ in range(60):
        texts = [random_words(draw) for _ in range(draw.randrange(20))]
        assert runs.runs_of(texts) == [runs_by_force(t) for t in texts]


def test_periodic_runs(spark, monkeypatch):
    draw = random.Random(9)
    texts = [None, "", " \n\t", "one", "é " * 5, "é " * 6, "a b " * 4, "a b " * 3, "x " * 200_000, "a b c\vd\x0ce"]
    texts += [b" ".join(random_words(draw)).decode() for _ in range(80)]
    monkeypatch.setattr(runs, "SLICE", 500)
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, runs string")
    df = df.unionByName(spark.createDataFrame([(None, "a a a a a a a", "s"), (5, "b b b b b b", "s")], df.schema))
    for change in (None, runs.with_planted_period):
        found = runs.periodic_runs(df, change)
        kept = {r.doc_id: r.collapsed for r in found.collect() if r.doc_id != 5}
        rows = {r.doc_id: r for r in runs.run_digest(found).collect() if r.doc_id != 5}
        for i, t in [(None, "a a a a a a a"), *enumerate(texts)]:
            if i == 5 or (i == 8 and change):
                continue
            words = (t or "").encode().split()
            words = change(i, words) if change else words
            want = runs_by_force(words) if i != 8 else [(0, 200_000, 1)]
            gone = {x for s, n, p in want for x in range(s + p, s + n)}
            left = " ".join(w.decode() for x, w in enumerate(words) if x not in gone)
            best = min(want, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
            r = rows[i]
            assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best) and kept[i] == left
            assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)
            assert r.runs_sha256 == sha("".join(f"{s},{n},{p}\n" for s, n, p in want)) and r.collapsed_sha256 == sha(left)
    assert runs.run_digest(runs.periodic_runs(df.limit(0))).count() == 0


def test_planted_period():
    for i in range(400):
        words = [str(x).encode() for x in range(i % 37)]
        h, n = zlib.crc32(str(i).encode()), len(words)
        want = list(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = [words[x if x < a else a + (x - a) % p] for x in range(n)]
        assert runs.with_planted_period(i, words) == want


