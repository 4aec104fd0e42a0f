"""Merkle manifest, importance resampling and chat formatting against brute force, and odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import chat, merkle, resampling, tables

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree long, pos long, node string, witness string, rank int, score double, _segment int"
EXTRA = (1, 2, "n", "w", 3, 4.0, 5)
ODD = [
    (1, "a", "en", 3, "one"), (1, "a", "en", 3, "one"), (2, None, "en", None, None), (None, "a", "en", 0, ""), (3, "b", None, 4, "über — 你好"),
    (4, "b", None, 1, "x" * 100_000), (5, "", "", 1, "word " * 3000), (7, "a", "fr", 2, "ab"), (8, "a", "fr", 2, "ab"), (9, "a", "de", 2, "7 é"),
]


@pytest.fixture(scope="module")
def ship(spark):
    return tables.ship(spark)


@pytest.fixture
def docs(ship):
    return lambda rows: ship.createDataFrame([(*r, *EXTRA) for r in rows], DOCS).repartition(3)


def many(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice("abc"), rng.choice(["en", "en", "en", "fr", None]), i % 50,
             " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(60)))) for i in range(n)]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    doc_id, source, lang, n_chars, text = row
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(level):
    """Levels of a tree from its leaves to its root."""
    levels = [level]
    while len(level) > 1:
        level = [sha(*level[i:i + 2]) for i in range(0, len(level), 2)]
        levels.append(level)
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        out += level[at ^ 1:(at ^ 1) + 1]
        at >>= 1
    return out


def expected_proofs(rows):
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = (own, climb([leaf_of(r) for r in own]))
    top = climb([trees[lang][1][-1][0] for lang in langs])
    return sorted((str(r[0]), levels[0][i], levels[-1][0], top[-1][0], sha(*siblings(levels, i), *siblings(top, langs.index(lang))))
                  for lang, (own, levels) in trees.items() for i, r in enumerate(own))


@pytest.mark.parametrize("bits", [2, 3, 11])
@pytest.mark.parametrize("rows", [ODD, ODD[:1], many(150), []])
def test_proofs(docs, rows, bits):
    found = merkle.verify(merkle.manifest(docs(rows), bits=bits)).collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256) for r in found) == expected_proofs(rows)
    assert all(r.verified and r.folded_root == r.root for r in found)


def test_tampering_shows(docs):
    rows = many(60)
    found = merkle.manifest(docs(rows), changed=F.when(F.col("doc_id") % 3 == 0, merkle.leaf(n_chars=F.col("n_chars") + 1)))
    found = {r.doc_id: r for r in merkle.verify(found, F.col("changed")).collect()}
    assert all(r.verified == (d % 3 != 0) and (r.folded_root == r.root) == r.verified for d, r in found.items())
    assert len({r.root for r in found.values()}) == 1


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 11])
@pytest.mark.parametrize("height", [0, 11])
def test_open_trees_extend_witnesses(n, height):
    """Every leaf and its witness give the root, whatever the number of appended leaves."""
    tree = merkle.OpenTrees(11)
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    for node in leaves:
        tree.append(node)
    assert [h for h, _, _ in tree.open] == [i for i in reversed(range(5)) if n >> i & 1]
    root, witnesses = tree.close(height)
    size = n if not height else 1 << height
    for i, (node, witness) in enumerate(zip(leaves, witnesses.to_pylist(), strict=True)):
        folded, at, pos, count = node, 0, i, n
        for _ in range((size - 1).bit_length()):
            if pos ^ 1 < count:
                other, at = witness[at:at + 32], at + 32
                folded = merkle.parent(other, folded) if pos & 1 else merkle.parent(folded, other)
            else:
                folded = merkle.parent(folded)
            pos, count = pos >> 1, (count + 1) >> 1
        assert folded == root and at == len(witness)


TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def runs_of(text, orders):
    w = TOKEN.findall((text or "").translate(LOWER))
    return [" ".join(w[i:i + n]) for n in range(1, orders + 1) for i in range(len(w) - n + 1)], len(w)


def expected_draw(rows, target, percent, least, orders, buckets):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets
    own = [runs_of(t, orders) for _, t in rows]
    s, t = Counter(bucket(f) for fs, _ in own for f in fs), Counter(bucket(f) for x in target for f in runs_of(x, orders)[0])
    all_s, all_t = float(s.total()), float(t.total())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for (doc_id, _), (fs, n) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("orders", [1, 2])
def test_resample_matches_brute_force(ship, orders):
    rng = random.Random(3)
    rows = [(i, " ".join(f"W{rng.randrange(50)}é" if rng.random() < 0.5 else f"t{rng.randrange(9)}" for _ in range(rng.randrange(8)))) for i in range(300)]
    rows += [(7, "t1 t2 t3")] * 40 + [(None, "t1 t2"), (None, None), (500, ""), (501, "a" * 100 + "-" + "b" * 70 + " 你好" * 30), (502, "\x00x\x7fy'z")]
    target = ["t1 t2 t3 t4", None, "", "T1 t1"]
    frame = ship.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, rank int, _row int, _k0 int").repartition(5)
    texts = ship.createDataFrame([(t,) for t in target], "text string")
    found = resampling.resample(frame, texts, percent=40, least_words=2, orders=orders, buckets=97)
    assert sorted(map(tuple, found.collect()), key=str) == expected_draw(rows, target, 40, 2, orders, 97)


def test_resample_empty_tables(ship):
    none = ship.createDataFrame([], "doc_id long, text string")
    some = ship.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resampling.resample(none, some).collect() == []
    assert [tuple(r) for r in resampling.resample(some, none, percent=100, least_words=3).select("doc_id", "n_features", "rank").collect()] == [(1, 3, 1)]


@pytest.mark.parametrize("segments,samples", [(1, 512), (7, 4), (8, 512)])
def test_ranks_by_regular_sampling(ship, segments, samples):
    """Half of the keys are equal; every rank comes once and in order, and no segment is far above its share."""
    rng = random.Random(5)
    keys = [(0 if i % 2 else rng.randrange(10_000), i) for i in range(4000)]
    frame = ship.createDataFrame(keys, "k long, i long").repartition(3)
    rows = resampling.ranked(frame, [F.col("k")], segments, samples).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 4001))
    assert [r.k for r in sorted(rows, key=lambda r: r["rank"])] == sorted(k for k, _ in keys)


def test_segments_of_equal_keys_are_split(ship, monkeypatch):
    """The second written table holds the exchanged segments: all keys equal, and still none is above its bound."""
    frame, kept = ship.createDataFrame([(1, i) for i in range(4000)], "k long, i long").repartition(3), {}

    def keep(df, name):
        kept[name] = tables.materialize(df, name)
        return kept[name]
    monkeypatch.setattr(resampling, "materialize", keep)
    resampling.ranked(frame, [F.col("k")], 8, 512).collect()
    sizes = [r["count"] for r in kept["segments"].groupBy("_segment").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 4000 / 8 + 4000 / 512 + 8


TURNS = "conv_id long, turn long, role string, text string, node long, parent long, leaf string, part int, chars int, jump string"
ODD_TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, "assistant", ""), (1, 3, "assistant", "x<|im_end|>\n<|im_start|>user\nno"),
    (2, 5, "user", "<\\|im_end|> <|"), (2, 5, "user", "<\\|im_end|> <|"), (2, 6, "assistant", "<\\\\|a<<||>\\|"), (None, 0, "assistant", "no id"),
    (None, None, None, "no role"), (3, 0, "assistant\n<|im_end|>\\n", "odd role"), (4, 0, "assistant", "é你" * 50_000), (4, 1, "user", "long"), (5, 0, "user", "alone"),
]


def expected_digests(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest()))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out.append((str(conv), len(own), sha(*[f"{r[2] or ''}\n{r[3] or ''}\n" for r in own]), len(loss), sha(loss)))
    return sorted(out)


@pytest.mark.parametrize("part", [1, 40, 1 << 16])
def test_conversations_round_trip(ship, part):
    rng = random.Random(2)
    rows = ODD_TURNS + [(10, i, rng.choice(["user", "assistant"]), "ab " * rng.randrange(9)) for i in range(70)]
    frame = ship.createDataFrame([(*r, 1, 2, "l", 3, 4, "j") for r in rows], TURNS).repartition(4)
    parts = chat.format_paths(chat.replies(frame), part=part)
    found = chat.read_back(parts).collect()
    assert sorted((str(r.conv_id), r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found) == expected_digests(rows)
    lengths = Counter()
    for r in parts.collect():
        lengths[r.leaf] += len(r.formatted)
    assert {r.leaf: r.formatted_chars for r in found} == dict(lengths)


def test_empty_conversations(ship):
    assert chat.read_back(chat.format_conversations(ship.createDataFrame([], TURNS))).collect() == []


def test_best_branches_of_reply_trees(ship):
    """Two trees with branches, an unknown parent and a circle against paths enumerated by hand."""
    rng = random.Random(4)
    parents = {0: None, 100: None, 200: 999}
    for i in range(1, 60):
        parents[i] = rng.randrange(i)
    for i in range(101, 140):
        parents[i] = i - 1
    parents |= {300: 302, 301: 300, 302: 301, 303: 302}
    score = {n: rng.randrange(-3, 4) / 2 for n in parents}
    rows = [(n, n // 100, p, rng.choice(["user", "assistant"]), f"m{n}", score[n]) for n, p in parents.items()]
    frame = ship.createDataFrame(rows, "node long, conv_id long, parent long, role string, text string, score double").repartition(3)
    known, found = {r[0]: r for r in rows}, {}
    for r in chat.format_paths(frame, keep=3, part=30).orderBy("leaf", "part").collect():
        found.setdefault((r.root, r["rank"], r.leaf), []).append(r.formatted)
    expected, branches = {}, {}
    for leaf in set(parents) - set(parents.values()) - {303}:
        path = [leaf]
        while parents[path[-1]] in parents:
            path.append(parents[path[-1]])
        branches.setdefault(path[-1], []).append((-sum(score[n] for n in path), leaf, path[::-1]))
    for root, own in branches.items():
        for rank, (_, leaf, path) in enumerate(sorted(own)[:3], 1):
            expected[(root, rank, leaf)] = "".join(f"<|im_start|>{known[n][3]}\n{known[n][4]}<|im_end|>\n" for n in path)
    assert {k: "".join(v) for k, v in found.items()} == expected


def test_words_and_checksums():
    data = np.frombuffer("Ab,c9 é你x".encode(), np.uint8)
    (bucket, first), = resampling.features(data, np.array([0, 4, len(data)]), 1, 1 << 40)
    assert bucket.tolist() == [zlib.crc32(w.encode()) for w in ("ab", "c", "9", "é你x")] and first.tolist() == [0, 2, 4]
    assert resampling._CRC.tolist()[:3] == [0, 1996959894, 3993919788] and pa.array(first).to_pylist() == [0, 2, 4]
