"""License scans, periodic runs and the divergence audit against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("roadframe.llm")

from roadframe.llm import divergence, licenses, periods  # noqa: E402

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
DDL = "doc_id long, text string, lang string, source string, own long, h string, gram int, term int, n string"


def frame(spark, rows):
    """(doc_id, text, lang, source) with further columns under names that the operators use inside."""
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], DDL).repartition(3)


# --- periodic runs


def plain_runs(w):
    """All runs, by comparing words q apart for every q."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def word_lists(seed):
    rng = random.Random(seed)
    lists = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 400, ["a", "b"] * 60, list("aab" * 9), list("abcabcabcabcx" * 5), list("aaaaaab" * 8 + "aaaaaaab" * 9)]
    for _ in range(150):
        w = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 4)):
            root = [rng.choice("abc") for _ in range(rng.randint(1, 24))]
            n = rng.randint(3, 7) * len(root) + rng.randint(0, len(root))
            at = rng.randint(0, len(w))
            w[at:at] = (root * 8)[:n]
        lists.append(w)
    # runs of runs: a root with long repeats of its own
    for _ in range(60):
        root = list("a" * rng.randint(4, 20) + "b" + "a" * rng.randint(0, 9) + rng.choice(["", "ab" * 9, "c"]))
        lists.append(list("aaba"[: rng.randint(0, 4)]) + root * rng.randint(4, 6) + root[: rng.randint(0, len(root))] + ["a"] * rng.randint(0, 9))
    fib = ["a", "ab"]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    return [*lists, list(fib[-1])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_of_word_lists(seed):
    lists = word_lists(seed)
    first = np.append(0, np.cumsum([len(w) for w in lists]))
    start, length, q = periods.runs(np.array([ord(x) for w in lists for x in w]), first)
    got = defaultdict(list)
    for s, n, p in zip(start.tolist(), length.tolist(), q.tolist(), strict=True):
        d = int(np.searchsorted(first, s, side="right")) - 1
        got[d].append((s - int(first[d]), n, p))
    assert {d: plain_runs(w) for d, w in enumerate(lists) if plain_runs(w)} == dict(got)


def test_range_successors():
    rng = np.random.default_rng(4)
    values = rng.permutation(700)
    tree = periods.WaveletTree(values)
    low = rng.integers(0, 700, 300)
    high = rng.integers(low, 701)
    bound = rng.integers(0, 720, 300)
    got = np.stack(tree.successors(low, high, bound, 3), axis=1)
    for i in range(300):
        want = sorted(v for v in values[low[i] : high[i]] if v >= bound[i])[:3]
        assert got[i].tolist() == want + [-1] * (3 - len(want))


def test_periodic_runs(spark):
    texts = [" ".join(w) for w in word_lists(5)] + [None, "", " \n\t ", "Ré ré " * 9, "x\x0by\x0cz " * 7, "word " * 30_000]
    rows = [(i * 7, t, "en", "s") for i, t in enumerate(texts)] + [(7, "b a " * 5, "en", "s"), (None, "a a a a a a b", "en", "s"), (14, texts[2], "en", "s")]
    want = []
    for i, t, *_ in rows:
        w = SPACED.findall(t or "")
        if i is not None and w and (h := zlib.crc32(str(i).encode())) % 10 == 0:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        found = plain_runs(w) if len(w) < 5000 else [(0, len(w), 1)]
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i or 0, len(found), *best, 1000 * best[1] // best[2] if found else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows if r[0] is not None) > 5
    got = [(r["doc_id"] or 0, *r[1:]) for r in periods.run_digests(frame(spark, rows), plant=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periods.run_digests(frame(spark, rows[:1]).limit(0)).count() == 0
    spans = [tuple(r) for r in periods.periodic_runs(frame(spark, [(3, "x " + "p q " * 5, "en", "s"), (4, None, "en", "s")])).collect()]
    assert spans == [(3, 1, 10, 2)]


# --- license scans


def plain_base(w):
    found = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split(" ")
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return found


def license_rows():
    rng = random.Random(6)
    words = ["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "free", "of", "é", "software"]
    mit, gpl = list(licenses.TEMPLATES)[0], "gnu general public license version 3"
    changed = mit.split(" ")
    changed[10:12] = ["new", "odd", "words"]
    del changed[30]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [
        "Released UNDER the (MIT) License.", "x " + mit.upper() + " y", " ".join(changed), " ".join(mit.split(" ")[:20]), mit + " " + mit, f"a {gpl}. b", gpl.replace("3", "4"),
        "under the mit license " * 3000, "cc-by-nc", "CC BY", "mit", None, "", "éé under\nthe\tmit - license", "of the software " * 2000, "Apache License, Version 2.0 under the MIT license",
    ]
    return [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s"), (3, "under the mit license", "en", "s"), (None, "cc by nc", "en", "s"), (None, None, "en", "s")]


def test_license_scans(spark):
    rows = license_rows()
    found = licenses.digests(licenses.scan(frame(spark, rows))).collect()
    assert len(found) == len(rows)
    want = Counter()
    for i, t, *_ in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        base = plain_base(w)
        want[(i, len(w), len(base), min((s for s, _ in base), default=None), max((s for s, _ in base), default=None), ",".join(sorted({x for _, x in base})))] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in found) == want
    own = {r["doc_id"]: (r["labels"], r["score"]) for r in found if r["doc_id"] is not None and r["doc_id"] > 3}
    assert [own[i][0] for i in range(60, 67)] == ["mit", "mit", "mit", "", "mit", "gpl-3", ""]
    assert own[61][1] == 1.0 and 0.8 <= own[62][1] < 1 and 0.3 < own[63][1] < 0.5 and own[66][1] == 5 / 6
    assert own[74] == ("", own[74][1]) and own[74][1] < 0.2 and own[71] == ("", 0.0)
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in found)
    assert licenses.scan(frame(spark, rows).limit(0)).count() == 0


def test_license_places(spark):
    """A copy with words added and left out is one span over neighbouring diagonals."""
    template = [f"t{i}" for i in range(40)]
    w = ["x"] * 7 + template[:10] + ["new", "words"] + template[10:25] + template[26:] + ["y"] * 5 + template[:20]
    docs = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    (row,) = licenses.scan(docs, {}, {" ".join(template): "own"}).collect()
    assert [(p["start"], p["end"], p["label"]) for p in row["places"]] == [(7, 48, "own")] and row["score"] == 39 / 40
    with pytest.raises(ValueError, match="words"):
        licenses.scan(docs, {"too short": "x"}, {})
    assert licenses.scan(docs, {}, {}).collect()[0]["places"] == []


# --- divergence audit


def plain_audit(rows, least=10):
    docs = [(x or "", s or "", LETTERS.findall((t or "").translate(LOWER))) for _, t, x, s in rows]
    per_doc, out = defaultdict(Counter), []
    for lang, _, terms in docs:
        per_doc[lang].update(set(terms))
    for lang in {d[0] for d in docs}:
        kept = {t for t, n in per_doc[lang].items() if n >= least}
        count = {s: Counter() for x, s, _ in docs if x == lang}
        for x, s, terms in docs:
            if x == lang:
                count[s].update(t for t in terms if t in kept)
        whole = sum(count.values(), Counter())

        def p(c, t, v=len(kept)):
            return 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s, c in count.items():
            pairs = [(sum(f(p(c, t), p(o, t)) for t in kept), x) for x, o in count.items() if x != s]
            terms = [(f(p(c, t), p(whole, t)), t) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, values in (("pair", pairs), ("term", terms)):
                values.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(values) if part == "pair" or k < 10]
    return sorted(out)


@pytest.mark.parametrize(("cells", "gathered"), [(divergence.SHARD_CELLS, divergence.GATHERED), (24, 50)])
def test_divergence(spark, monkeypatch, cells, gathered):
    monkeypatch.setattr(divergence, "SHARD_CELLS", cells)
    monkeypatch.setattr(divergence, "CELLS_PER_PAIR", 1)
    monkeypatch.setattr(divergence, "GATHERED", gathered)
    rng = random.Random(2)
    words = ["".join(rng.choice(["An", "the", "é", "Ö", "un", "st"]) for _ in range(rng.randint(1, 3))) for _ in range(60)]
    rows = []
    for i in range(160):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "é", None])
        rows.append((i, " ".join(rng.choice(words[: 60 if source != "s1" else 20]) + rng.choice([".", "1", "\n", " 22 "]) for _ in range(rng.randint(0, 60))), lang, source))
    rows += [(200, None, "en", "none"), (201, "", "fr", "a"), (202, "12 34", "fr", "b"), (203, "rare words", "it", None), rows[5], rows[5], (None, "x", "en", "s1"), (204, "an the " * 20_000, "de", "s1")]
    got = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(frame(spark, rows)).collect()]
    assert sorted(got) == plain_audit(rows)
    assert divergence.audit(frame(spark, rows).limit(0)).count() == 0


def test_frequency_is_exact_for_large_counts():
    rng = random.Random(1)
    totals = [rng.randint(1, 9 * 10**15) for _ in range(200)]
    counts = [rng.randint(0, t) for t in totals]
    got = divergence.frequency(np.array(counts), np.array(totals)).tolist()
    assert got == [1 + 10**9 * c // t for c, t in zip(counts, totals, strict=True)]
