"""Operators on documents against brute force, and the given cases for odd input."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import codes, fingerprints, hidden_markov, jaccard, mixing, packing, repeats, tables, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, source string, cell string, node string, row long, u double, key string"


@pytest.fixture(scope="module")
def ship(spark):
    return tables.ship(spark)


@pytest.fixture
def docs(ship):
    """A table of (doc_id, text, source) with extra columns whose names operators use inside."""
    return lambda rows: ship.createDataFrame([(*r, "x", "y", 1, 2.0, "z") for r in rows], SCHEMA).repartition(3)


def prose(seed, n, vocabulary=40):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (None, "Only words without id here", "b"), (4, "one", "b"),
    (5, "ONE", "b"), (6, "ünï çødé — 你好 " * 30, "c"), (7, "a" * 3000, "c"), (8, prose(1, 4000), "a"), (9, "same text twice here ok", "a"),
    (9, "same text twice here ok", "a"), (10, "same text twice here ok", None), (11, "  x\x1cy \x85 z", "c"),
]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def shingles(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def expected_components(rows, k, percent):
    sets = [shingles(t, k) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r[0])
    out = []
    for i, r in enumerate(rows):
        ids = [d for d in groups[find(i)] if d is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def near_copies(seed, groups, size, length):
    """Groups of edited copies: similarities on both sides of the limits."""
    rng, rows, doc_id = random.Random(seed), [], 100
    for g in range(groups):
        base = prose(1000 * seed + g, length, 5000).split()
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, length // 20))):
                copy[rng.randrange(length)] = f"e{rng.randrange(10 ** 6)}"
            rows.append((doc_id, " ".join(copy), "s"))
            doc_id += 1
    return rows


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_components(docs, k, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL", 8)  # so that groups are cut into several cells
    rows = ODD + near_copies(3, 5, 30, 120) + near_copies(4, 20, 3, 30) + near_copies(5, 10, 4, 6)
    found = jaccard.jaccard_components(docs(rows), k, percent)
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == expected_components(rows, k, percent)


def test_jaccard_keep_first(docs):
    rows = ODD + near_copies(3, 3, 5, 60)
    found = jaccard.keep_first(docs(rows), 5, 80)
    component = {(d, n): c for d, n, c in expected_components(rows, 5, 80)}
    kept = sorted(r["doc_id"] for r in found.where("doc_id is not null").collect())
    later = {d for (d, n), c in component.items() if d is not None and c != d}
    assert kept == sorted({r[0] for r in rows if r[0] is not None} - later)
    assert found.where("doc_id is null").count() == 1
    assert found.columns == SCHEMA.replace(",", "").split()[::2]


def test_jaccard_keep_first_judges_rows(docs):
    """A text is not lost because its id also has a copy of another text."""
    a, b, c = prose(1, 40), prose(2, 40), prose(3, 40)
    rows = [(0, a, "x"), (1, a, "x"), (1, b, "x"), (1, c, "y"), (1, c, "y"), (2, c, "x"), (3, "", "x"), (3, "", "x"), (None, b, "x")]
    found = jaccard.keep_first(docs(rows), 5, 80).select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, [(0, a), (1, b), (1, c), (3, ""), (None, b)]))


def test_jaccard_rows_without_id(docs):
    """Rows without doc_id are each looked up by their own text."""
    texts = [prose(i // 2, 40) + (" more" if i % 2 else "") for i in range(60)]
    found = jaccard.jaccard_components(docs([(None, t, "x") for t in texts]), 5, 80).collect()
    groups = Counter(r["component"] for r in found)
    assert len(found) == 60 and all(r["component_id"] is None for r in found) and sorted(groups.values()) == [2] * 30


@pytest.mark.parametrize("marks", [64, 1 << 25])
def test_jaccard_marks_lose_no_wanted_row(docs, marks, monkeypatch):
    """Only rows that may be looked up go into the join that shuffles their texts; each that is looked up does."""
    monkeypatch.setattr(jaccard, "MARKS", marks)
    rows = docs([(i if i % 7 else None, prose(i, 9), "x") for i in range(400)]).select("doc_id", "text", F.xxhash64("text").alias("spelled"))
    wanted = rows.where("spelled % 8 = 0")
    kept, sought = ({r.text for r in t.collect()} for t in (jaccard._marked(rows, wanted, ["doc_id", "spelled"]), wanted))
    assert sought and sought <= kept
    assert marks == 64 or kept == sought
    near = near_copies(3, 5, 30, 120)
    assert rows_of(jaccard.jaccard_components(docs(near), 4, 85), "doc_id", "n_shingles", "component_id") == expected_components(near, 4, 85)


def expected_removal(rows, length):
    raws = [(t or "").encode() for _, t, _ in rows]
    seen = Counter(raw[i:i + length] for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for (doc_id, _, _), raw in zip(rows, raws, strict=True):
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,gathered", [(40, 1024), (40, 1), (3, 1024), (400, 1024)])
def test_repeated_bytes(docs, length, gathered, monkeypatch):
    monkeypatch.setattr(repeats, "GATHERED_RUNS", gathered)
    passage = prose(9, 100, 1000)
    rows = ODD + [(20 + i, f"{prose(i, 30)} {passage[i:600 - 3 * i]} {prose(50 + i, 20)}", "s") for i in range(12)]
    rows += [(40, "abc" * 200, "s"), (41, "xabcabc" * 20, "s")]
    found = repeats.removal_report(docs(rows), length)
    assert rows_of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected_removal(rows, length)


def test_first_copies_stay(docs):
    passage = prose(9, 60, 1000)
    rows = [(1, f"alpha {passage} beta", "s"), (2, f"gammo {passage}", "s"), (3, "ünï " + passage + " é", "s"), (4, None, "s")]
    found = {r["doc_id"]: r["text"] for r in repeats.without_repeats(docs(rows), 100).collect()}
    assert found[1] == rows[0][1] and found[4] is None
    assert found[2].startswith("gammo") and len(found[2]) < 10
    assert len(found[3]) < 10 and found[3].startswith("ünï")


def test_lempel_ziv(docs):
    rows = sorted((r for r in ODD), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    found = fingerprints.fingerprints(docs(rows)).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    for i, (doc_id, value, _) in enumerate(rows):
        value, following = value or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(value) // 2
        edited = value[:len(value) - half] + following[:half]
        row = by_id[doc_id]
        assert row["n_chars"] == len(value)
        if doc_id != 9:  # two rows
            assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            same = fingerprints.likeness(fingerprints.fingerprint(value), fingerprints.fingerprint(edited))
            assert row["near_edited"] == same
    assert by_id[9]["fingerprint"] == by_id[10]["fingerprint"]
    assert fingerprints.Parse().feed("abab").feed("abc").phrases.keys() == fingerprints.Parse().feed("abababc").phrases.keys()
    assert list(fingerprints.Parse().feed("ababab").phrases) == ["a", "b", "ab"]


def test_token_codes(docs):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    rows = ODD + [(60, "a <|endoftext|> b", "s"), (61, "don't  stop\n\n now x", "s")]
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    tokenizer, start, expected = Tokenizer.from_file(path), 0, []
    for doc_id, value, _ in rows:
        ids = np.array([*tokenizer.encode(value or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    found = codes.round_trip(docs(rows), path, tokenizers.PATTERN)
    assert rows_of(found, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=str)


def test_any_token_is_read_alone():
    rng = np.random.default_rng(5)
    ids = np.concatenate([rng.integers(0, 256, 700), rng.integers(0, 1 << 17, 1500), [0, 255, 256, 65535, 65536, (1 << 32) - 1]]).astype(np.uint32)
    segment = codes.Segment(codes.pack(ids, [3, None], [5, len(ids)]))
    assert segment.doc_ids == [3, None] and (segment.tokens() == ids).all()
    assert [segment.token(i) for i in range(len(ids))] == ids.tolist()


def test_mixing(docs):
    rows = [(i, prose(i, 5 + i % 40), f"s{i % 4}" if i % 9 else None) for i in range(400)] + [(500 + i, t, s) for i, (_, t, s) in enumerate(ODD) if i != 8]
    found = [r.asDict() for r in mixing.mix(docs(rows)).collect()]
    assert len(found) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    total, order = sum(sizes.values()), sorted((s for s in sizes if s is not None)) + [None]
    weight, targets, active = {s: i % 3 + 1 for i, s in enumerate(order)}, {}, set(order)
    while True:
        share = (total - sum(targets.values())) / sum(weight[s] for s in active)
        over = [s for s in active if share * weight[s] > 3 * sizes[s]]
        if not over:
            break
        targets |= {s: 3 * sizes[s] for s in over}
        active -= set(over)
    targets |= {s: share * weight[s] for s in active}
    taken = Counter()
    for r in found:
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - targets[s]) <= 10
    again = [r.asDict() for r in mixing.mix(docs(rows).repartition(5)).collect()]
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixing.mixed(docs(rows)).count() == sum(r["copies"] for r in found)


def test_mixing_goes_on_past_a_long_text(docs):
    """A third of a source's words is one text that the room has no place for."""
    rows = [(i, prose(i, 10 + i % 7), "a") for i in range(200)] + [(200 + i, prose(i, 10), s) for s in "bc" for i in range(40)]
    long = [(1005, prose(5, 1300), "a")]
    found = [r.asDict() for r in mixing.mix(docs(rows + long)).where("source = 'a'").collect()]
    assert abs(sum(r["taken"] for r in found) - found[0]["target"]) <= 10


def test_mixing_by_unequal_inclusion(docs):
    """Expected copies follow the weight up to three and add up to the target; copies keep to them."""
    def words(i):
        spelled = [f"w{j}x{i}" for j in range(16)]
        return " ".join(spelled[j % (1, 4, 16)[i % 3]] for j in range(16))

    rows = [(i, words(i), "ab"[i % 2]) for i in range(1200)] + [(2000 + i, words(i), "c") for i in range(90)]
    found = [r.asDict() for r in mixing.mix(docs(rows), mixing.variety(F.col("text"))).collect()]
    for source in "abc":
        mine = [r for r in found if r["source"] == source]
        assert sum(r["expected"] * r["size"] for r in mine) == pytest.approx(mine[0]["target"])
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 16
        assert all(int(r["expected"]) <= r["copies"] <= int(r["expected"]) + 1 for r in mine)
        means, wanted = [], []
        for kind, weight in enumerate((4, 16, 64)):
            of_kind = [r for r in mine if r["doc_id"] % 2000 % 3 == kind]
            wanted.append(of_kind[0]["expected"])
            assert {round(r["expected"], 9) for r in of_kind} == {round(wanted[-1], 9)}
            means.append(sum(r["copies"] for r in of_kind) / len(of_kind))
            assert abs(means[-1] - wanted[-1]) < 0.1
        assert wanted == sorted(wanted) and wanted[-1] <= 3
        if wanted[-1] < 3:
            assert wanted[1] == pytest.approx(4 * wanted[0]) and wanted[2] == pytest.approx(4 * wanted[1])
            assert means[0] < means[1] < means[2]


def test_packing(docs):
    rows = ODD + [(100 + i, prose(i % 20, 3 + (7 * i) % 90), f"s{i % 6}" if i % 11 else None) for i in range(200)]
    found = [r.asDict() for r in packing.pieces_in_bins(docs(rows), capacity=100).collect()]
    size = Counter()
    for r in found:
        size[r["doc_id"]] += r["size"]
    expected = Counter()
    for d, t, _ in rows:
        expected[d] += len(WORD.findall(t or ""))
    assert +size == +expected
    source, body = {r[0]: r[2] for r in rows}, {r[0]: r[1] or "" for r in rows}
    bins = {}
    for r in found:
        bins.setdefault(r["bin_id"], []).append(r)
    for own in bins.values():
        assert sum(r["size"] for r in own) == own[0]["bin_size"] <= 100
        own.sort(key=lambda r: (r["slot"], r["size"]))
        assert [r["slot"] for r in own] == [sum(p["size"] for p in own[:i]) for i in range(len(own))]
        sources = [source[r["doc_id"]] for r in own if source[r["doc_id"]] is not None]
        assert len(set(sources)) == len(sources)
        texts = [body[r["doc_id"]] for r in own]
        assert len(set(texts)) == len(texts)
    whole = packing.bins(docs(rows), capacity=100).collect()
    assert {r["bin_id"]: r["n_words"] for r in whole} == {b: sum(r["size"] for r in own) for b, own in bins.items()}
    assert all(len(WORD.findall(r["text"])) == r["n_words"] for r in whole)
    again = {}
    for r in whole:
        at = 0
        for doc_id, piece, n in zip(r["doc_ids"], r["pieces"], r["chars"], strict=True):
            again.setdefault(doc_id, set()).add((piece, r["text"][at:at + n]))
            at += n + len(packing.SEPARATOR)
        assert at == len(r["text"]) + len(packing.SEPARATOR)
    for doc_id, text in body.items():  # every byte of every text comes back, white space too
        assert "".join(t for _, t in sorted(again[doc_id])) == text, doc_id


def test_best_fit_is_tightest_compatible():
    rng = random.Random(2)
    pieces = sorted(((rng.randrange(1, 60), rng.randrange(-1, 5), rng.randrange(-1, 4)) for _ in range(300)), reverse=True)
    room, used, expected = [], [], []
    for size, source, cluster in pieces:
        own = {("s", source)} if source >= 0 else set()
        own |= {("c", cluster)} if cluster >= 0 else set()
        fits = [(r, b) for b, r in enumerate(room) if r >= size and not used[b] & own]
        if fits:
            b = min(fits)[1]
        else:
            b = len(room)
            room.append(100)
            used.append(set())
        room[b] -= size
        used[b] |= own
        expected.append(b)
    assert packing.pack(pieces, 100) == expected


def test_hidden_markov_dictionary_carries_counts_alone():
    """Within a class a word has (count + 1) / size; the sizes are known to the task and not sent with each word."""
    nothing = [None, None]
    entries = pa.RecordBatch.from_pydict({"block": [7, 7], "kind": [0, 0], "doc_id": nothing, "held_out": nothing, "words": nothing,
                                          "code": [0, 1], "class": [0, 3], "c": [5, 1]})
    raw = hidden_markov.packed(np.array([1, 0, 1]))
    texts = pa.RecordBatch.from_pydict({"block": [7], "kind": [1], "doc_id": [9], "held_out": [False], "words": [raw]})
    (found,) = hidden_markov._classed(iter([entries, texts]), np.array([0, 0, 0, 8.0, 0]), 4, 0.0, 1.0)
    assert found.column("within").to_pylist() == [pytest.approx(2 * np.log10(2 / 8))]
    assert found.column("base_score").to_pylist() == [pytest.approx(2 * np.log10(2) + np.log10(6) - 4)]
    assert np.frombuffer(found.column("classes")[0].as_py(), np.uint16).tolist() == [3, 0, 3, 4]


def test_hidden_markov_counts(docs):
    rows = ODD + [(200 + i, prose(i, 50, 300), "s") for i in range(60)]
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    found = hidden_markov.score_texts(docs(rows).withColumn("held_out", out)).collect()
    assert len(found) == len(rows)
    held = {r[0]: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows}
    counts = Counter(w for d, t, _ in rows if not held[d] for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    body = {r[0]: r[1] for r in rows}
    for r in found:
        tokens = [*words(body[r["doc_id"]]), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(tokens), sum(counts[t] > 0 for t in tokens), n, held[r["doc_id"]])
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[t] + 1) / (n + v + 1)) for t in tokens))
        assert np.isfinite(r["score"]) and r["score"] < 0


def test_forward_and_expected_counts_by_enumeration():
    rng = np.random.default_rng(1)
    norm = lambda a, axis: a / a.sum(axis, keepdims=True)
    model = hidden_markov.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))
    sequences = [np.array([0, 4, 2, 2]), np.array([1, 3]), np.array([4])]
    likely, first, moves, emits = [], np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s in sequences:
        total, parts = 0.0, []
        for path in np.ndindex(*[3] * len(s)):
            p = model.first[path[0]] * model.emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:], strict=False):
                p *= model.move[a, b] * model.emit[x, b]
            total += p
            parts.append((path, p))
        likely.append(np.log(total))
        for path, p in parts:
            first[path[0]] += p / total
            for t, state in enumerate(path):
                emits[s[t], state] += p / total
                if t:
                    moves[path[t - 1], state] += p / total
    assert hidden_markov.forward(sequences, model) == pytest.approx(np.array(likely))
    found = hidden_markov.expected(sequences, model)
    assert found[0] == pytest.approx(first) and found[1] == pytest.approx(moves) and found[2] == pytest.approx(emits)
    better = hidden_markov.maximised(np.vstack([found[2], found[1], found[0]]) * 1e6, 5)
    assert hidden_markov.forward(sequences, better).sum() > sum(likely)


INSULTS = ["blorgon", "snarfel", "quimzat"]


def labelled(n=300):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        body = [f"{rng.choice(['ta', 'lo', 'mi', 'ren'])}{rng.choice(['sel', 'dor', 'va', 'kin'])}{rng.choice(['o', 'us', 'et'])}" for _ in range(60)]
        if i % 4 == 0:
            body[rng.randrange(60)] = rng.choice(INSULTS)
        rows.append((i, " ".join(body).replace(" lo", ". Lo"), "s"))
        labels.append((i, int(i % 4 == 0), "x"))
    return rows, labels


def test_toxicity(ship, docs):
    rows, labels = labelled()
    extra = [(1000, "talo dorus b.l.o-r.g.o.n renva", "s"), (1001, "talo s n a r f e l renva", "s"), (1002, "talo quiimzat renva", "s"), (1003, "talo dorus renva", "s"), *[(2000 + i, t, s) for i, (_, t, s) in enumerate(ODD)]]
    known = ship.createDataFrame(labels + [(1003, None, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs(rows + extra), known).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in found.items())
    assert sum(found[d]["predicted"] == t for d, t, _ in labels) >= 0.97 * len(labels)
    assert found[1000]["predicted"] and found[1001]["predicted"] and found[1002]["score"] > found[1003]["score"]
    kept = toxicity.without_toxic(docs(rows), known)
    assert kept.count() == sum(not found[d]["predicted"] for d, _, _ in labels)


def test_toxicity_trains_on_all_words(ship, docs, monkeypatch):
    """More clean and more toxic words than the 8,000 that training once stopped at."""
    def letters(i):
        return "".join(chr(97 + i // 26**k % 26) for k in range(4))

    texts = [" ".join(letters(i) for i in range(n, n + 300)) for n in range(0, 18000, 300)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    known = ship.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id long, toxic int")
    seen, step = [], toxicity._machine
    monkeypatch.setattr(toxicity, "_machine", lambda words, *a: seen.append({r["word"] for r in words.where("negative > 0").collect()}) or step(words, *a))
    sample = toxicity.training_sample(docs(rows), known, F.lit(True))
    toxicity.fit(sample, rounds=1)
    assert len({w for w in seen[0]} & {letters(i) for i in range(9000, 18000)}) == 9000
    assert sample.mapInArrow(toxicity._sample_words, "toxic int, word string").where("toxic = 1").distinct().count() == 9000


def test_toxicity_keeps_the_share_of_toxic_labels(ship, docs):
    """Texts that tell nothing, one in ten labelled toxic, and a sample of as many of each class."""
    rows = [(i, prose(i, 30, 30), "s") for i in range(400)]
    known = ship.createDataFrame([(i, int(i % 10 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_sample(docs(rows), known, F.lit(True), per_class=40), rounds=1)
    assert toxicity.score_texts(docs(rows), model).agg(F.avg("score")).first()[0] < 0.25


def test_no_labels(ship, docs):
    none = ship.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(docs(ODD), none).collect()} == {0}


def test_kernel_counts_gapped_subsequences():
    def brute(word):
        out = Counter()
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + 5)):
                    out[word[i] + word[j] + word[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    a, b = toxicity.word_map(["idiotic"])[0], toxicity.word_map(["idxiot"])[0]
    ba, bb = brute("idiotic"), brute("idxiot")
    scale = toxicity._NORMS[7] * toxicity._NORMS[6]
    assert float(a @ b) == pytest.approx(sum(ba[s] * bb[s] for s in ba) / scale, rel=1e-5)


@pytest.mark.parametrize("run", [
    lambda d, _: jaccard.jaccard_components(d), lambda d, _: jaccard.keep_first(d), lambda d, _: repeats.removal_report(d),
    lambda d, _: repeats.without_repeats(d), lambda d, _: fingerprints.fingerprints(d), lambda d, _: mixing.mix(d), lambda d, _: mixing.mixed(d),
    lambda d, _: packing.pieces_in_bins(d), lambda d, _: packing.bins(d),
    lambda d, _: hidden_markov.score_texts(d.withColumn("held_out", F.lit(False))), lambda d, s: toxicity.toxicity(d, s.createDataFrame([], "doc_id long, toxic int")),
])
def test_empty_tables(ship, run):
    assert run(ship.createDataFrame([], SCHEMA), ship).count() == 0


def test_empty_codes(ship):
    tokenizers = pytest.importorskip("public_tokenizers")
    found = codes.round_trip(ship.createDataFrame([], SCHEMA), tokenizers.path("byte_bpe_50k.json"), tokenizers.PATTERN)
    assert found.count() == 0


def test_places_of_words_keep_their_value_in_planes():
    places = np.array([0, 1, 65535, 65536, 70000, (1 << 31) - 1])
    assert hidden_markov.unpacked(hidden_markov.packed(places)).tolist() == places.tolist()
    assert len(hidden_markov.unpacked(hidden_markov.packed(places[:0]))) == 0
    assert hidden_markov.packed(np.arange(1000))[2000:] == bytes(2000)  # frequent words leave zeros


def test_coarse_entries_never_share_less():
    low = np.uint64((1 << jaccard.DROPPED) - 1)
    one = np.array([5, 9, 1 << 40, (1 << 40) + 3, 7 << 40], np.uint64)  # 5 and 9, and the next two, become equal
    token, node = jaccard.coarse(one, 11)
    assert (token[:3] & low == 0).all() and token.tolist()[3:] == [9, 9, (1 << 40) + 3, (1 << 40) + 3]
    assert node.tolist() == [11, 11, 11, 11, 0, 11, 0]
    other, theirs = jaccard.coarse(one, 12)
    token, node = np.concatenate([token, other]).view(np.int64), np.concatenate([node, theirs]).view(np.int64)
    order = np.lexsort((node, token))
    batch = pa.RecordBatch.from_arrays([pa.array(token[order]), pa.array(node[order])], names=["token", "node"])
    shared = {}
    for found in jaccard._shared(iter([batch])):
        for n, s in zip(found.column("node").to_pylist(), found.column("shared").to_pylist()):
            shared[n] = shared.get(n, 0) + s
    assert shared[11] == shared[12] == len(one)


def test_pieces_are_found_by_re_as_by_regex():
    import public_tokenizers
    import regex

    pattern = public_tokenizers.PATTERN
    find, plain = codes.finder(pattern), regex.compile(pattern).findall
    assert find is not plain and not hasattr(find, "__self__")  # two patterns, by the kind of text
    every = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)))
    rng = random.Random(3)
    drawn = ["".join(rng.choice(every[:rng.choice([128, 128, 700, 70000, len(every)])]) for _ in range(300)) for _ in range(200)]
    drawn += ["".join(t) for n in (1, 2, 3) for t in itertools.product("'stvm a1.\n\x1c\x85", repeat=n)]
    for t in [every, every[:128], "it's  we'll\t\x1c\x85 \u00a0x\u30001\u00b2\u2160 a1 \n\n", "", *drawn]:
        assert find(t) == plain(t)
    assert codes.finder(r"\p{Lu}+|.").__self__.__class__ is regex.Pattern
    assert codes.finder(r"[a\s]+").__self__.__class__ is regex.Pattern
