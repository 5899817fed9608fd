"""Each operator against a plain version on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("roadframe.llm")

from pyspark.sql import functions as F  # noqa: E402

from roadframe.llm import arrays, chat, decontaminate, divergence, langid, minhash, packing, passages, quality, secrets, suffixes  # noqa: E402
from roadframe.llm.queries import OP10_SQL, tokenizer_path  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DDL = "doc_id long, text string, lang string, source string, n_chars long, key long, hits string, row int, class string"


def corpus(seed=3, n=60):
    """Documents with copies, near copies, shared passages, nulls, empty texts, one long text and odd characters."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "the", "or", "é", "ung", "ió", "ß", "st", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(0, 150))]
        if i % 5 == 0:
            w[10:10] = passage.split(" ")
        texts.append(" ".join(x + rng.choice(["", "", ".", ",\n", "  "]) for x in w))
    texts += [texts[3], texts[5], texts[5], None, "", " \n\t ", "one", "Of " * 200, "a b c d " * 30, texts[7] + " tail word", texts[8][:-20], " ".join(texts[:30])]
    near = texts[11].split(" ")
    for k in range(8):
        w = list(near)
        w[k * 3 % max(1, len(w))] = "changed"
        texts.append(" ".join(w))
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "x", 3, "y") for i, t in rows], DDL).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def test_passages(spark, rows, docs, empty):
    first, want = {}, {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {k for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for k in range(j, j + 13)}
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in passages.remove_repeats(docs).collect()}
    assert got == want
    assert passages.remove_repeats(empty).count() == 0


def test_passages_with_shared_and_null_ids(spark):
    """Rows of one doc_id take nothing from each other; smaller ids, and rows without one, come first."""
    text = " ".join(f"w{i}" for i in range(20))
    shared = [(4, text + " x"), (4, text + " y"), (4, text + " y"), (4, text), (4, text), (7, "z " + text), (7, text)]
    found = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in passages.remove_repeats(spark.createDataFrame(shared, "doc_id long, text string")).collect()]
    assert sorted(found) == [(4, 20, 0), (4, 20, 0), (4, 21, 0), (4, 21, 0), (4, 21, 0), (7, 20, 20), (7, 21, 20)]
    shared += [(None, text), (None, text + " q")]
    found = [(r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in passages.remove_repeats(spark.createDataFrame(shared, "doc_id long, text string")).collect()]
    assert sorted(found) == [(0, 20, 0), (0, 21, 0), (4, 20, 20), (4, 20, 20), (4, 21, 20), (4, 21, 20), (4, 21, 20), (7, 20, 20), (7, 21, 20)]


def test_long_words_with_equal_sums_differ(spark):
    """Thue-Morse words and their complements have equal polynomial sums modulo 2**64 for every base."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    texts = arrays.Texts(np.frombuffer((a + b).encode(), dtype=np.uint8), np.array([0, 2048, 4096]))
    start, end = np.array([0, 2048]), np.array([2048, 4096])
    assert len(set(arrays.segment(texts.sums(), start, end).tolist())) == 1 and len(set(arrays.prints(texts, start, end).tolist())) == 2
    docs = spark.createDataFrame([(1, " ".join([a] * 13)), (2, " ".join([b] * 13)), (3, " ".join([a] * 13))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in passages.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 13}
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize(("window", "head"), [(100, 40), (30, 4)])
def test_suffixes(rows, docs, empty, window, head):
    seen, want = set(), {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for j in range(len(raw) - window + 1):
            piece = raw[j : j + window]
            if piece in seen:
                gone[j : j + window] = b"\1" * window
            seen.add(piece)
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        want[i] = (len(raw), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(docs, window, head, digest=True).collect()}
    assert got == want
    assert suffixes.remove_repeats(empty).count() == 0


def test_suffixes_of_long_texts_and_shared_ids(spark):
    """A text longer than a chunk that repeats itself and others; rows of one doc_id, and rows without one."""
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    body = [" ".join(rng.choice(words) for _ in range(20_000)) for _ in range(5)]
    long = passage + body[0] + body[1] + passage + body[2] + body[3] + passage + body[4] + body[0][:5000]
    assert len(long) > suffixes.CHUNK
    data = [(1, "x " + passage), (2, long), (3, body[4][-3000:] + body[1][:3000]), (9, passage[:99]), (10, passage[:100])]
    seen, want = set(), {}
    for i, t in data:
        raw = t.encode()
        gone = bytearray(len(raw))
        for j in range(len(raw) - 99):
            if raw[j : j + 100] in seen:
                gone[j : j + 100] = b"\1" * 100
            seen.add(raw[j : j + 100])
        want[i] = (len(raw), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()}
    assert got == want and want[2][2] == 4 and want[9][1] == 0 and want[10][1] == 100
    # equal rows share their result; of other rows of one id the later one loses what they share; rows without an id come first
    shared = [(4, passage), (4, passage), (4, passage + "!"), (7, passage), (None, "q" + passage[:150])]
    found = [(r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffixes.remove_repeats(spark.createDataFrame(shared, "doc_id long, text string")).collect()]
    n = len(passage)
    assert len(found) == 5 and {r for r in found if r[0] in (0, 7)} == {(0, 151, 0), (7, n, n)}
    own = sorted(r for r in found if r[0] == 4)
    assert own in ([(4, n, 150), (4, n, 150), (4, n + 1, n)], [(4, n, n), (4, n, n), (4, n + 1, 150)])


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(rows, docs, empty, k):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, k=k).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.first_of_each_group(docs, k=k)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in sets if find(i) == i}


def test_near_copies_meet_their_central_one_in_few_groups(spark, monkeypatch):
    """Near copies share nearly all table keys; under each they would meet the same member again."""
    n, keys = 40, 60
    bits = np.zeros(minhash.BITS // 8, dtype=np.uint8).tobytes()
    reps = spark.createDataFrame([(i, 100, bits) for i in range(n)], "doc_id long, n_shingles long, bits binary")
    large = spark.createDataFrame([(i, k) for i in range(n) for k in range(keys)], "a long, b long")
    forest = spark.createDataFrame([], "node long, component long")
    made, whole = [], minhash.X.per_bucket

    def counted(*args):
        out = whole(*args).cache()
        made.append(out.count())
        return out

    monkeypatch.setattr(minhash.X, "per_bucket", counted)
    pairs = minhash.in_large_groups(large, reps, forest, 4, 80, "central").collect()
    assert len(pairs) >= n - 1 and {x for p in pairs for x in p} == set(range(n))
    assert made[0] <= n * minhash.CENTRAL_KEYS
    # what no round has settled is paired under every key
    assert len(minhash.in_large_groups(large, reps, forest, 4, 80, "all").collect()) == n * (n - 1) // 2


def test_near_duplicates_inside_one_template(spark):
    """Pairs at 0.83 among pages of one template, each at 0.79 to all other pages."""
    template, texts = [f"t{i}" for i in range(440)], []
    for family in range(40):
        both = template + [f"f{family}x{i}" for i in range(15)]
        texts += [" ".join(both + [f"o{family}y{side}z{i}" for i in range(45)]) for side in range(2)]
    order = random.Random(8).sample(range(80), 80)
    want = {order[i]: min(order[i - i % 2], order[i - i % 2 + 1]) for i in range(80)}
    got = minhash.near_duplicates(frame(spark, [(order[i], t) for i, t in enumerate(texts)]), k=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 900])
def test_decontamination(spark, rows, docs, empty, block_bytes):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [(1, " ".join((rows[5][1] or "").split()[12:40])), (2, "one"), (3, None), (4, "!!"), (5, rows[9][1]), (6, rows[9][1]), (7, "re an")]
    windows = {}
    for item, t in items:
        w = word.findall((t or "").translate(LOWER))
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(str(item))
    want = {}
    for i, t in rows:
        w, hit, found = word.findall((t or "").translate(LOWER)), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if own := windows.get(tuple(w[j : j + k])):
                    found |= own
                    hit |= set(range(j, j + k))
        want[i] = (len(w), len(hit), sorted(found))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate.find_items(docs, bench, block_bytes).collect()}
    assert got == want
    clean = decontaminate.clean(docs, bench, block_bytes)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i in want if not want[i][1]}
    assert decontaminate.find_items(empty, bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.find_items(docs, bench.limit(0)).collect()} == {0}


def test_decontamination_with_very_long_words(spark):
    """An item word of 300,000 characters beside ordinary items; near misses of it at its end and beyond a text's end."""
    rng = random.Random(4)
    giant = "".join(rng.choice("abcdef") for _ in range(300_000))
    plain = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(40)) for _ in range(300)]
    items = [(f"i{n}", t) for n, t in enumerate(plain)] + [("big", f"see {giant} here"), ("alone", giant[:200_000]), ("tiny", "zq")]
    texts = [f"we see {giant} here now", f"we see {giant}x here", f"see {giant}", giant[:200_000], giant[:199_999], "ZQ zqq zq", plain[7] + " " + plain[8], "", None]
    found = decontaminate.find_items(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in found.collect()}
    assert got == {0: (5, 3, ["big"]), 1: (4, 0, []), 2: (2, 0, []), 3: (1, 1, ["alone"]), 4: (1, 0, []), 5: (3, 2, ["tiny"]), 6: (80, 80, ["i7", "i8"]), 7: (0, 0, []), 8: (0, 0, [])}


def test_quality_measures(rows, docs, empty):
    want = {}
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        runs = {}
        for j in range(len(w) - 7):
            runs.setdefault(tuple(w[j : j + 8]), []).append(j)
        repeat = {k for at in runs.values() if len(at) > 1 for j in at for k in range(j, j + 8)}
        lines, seen, dup = t.split("\n"), set(), 0
        for x in lines:
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        want[i] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeat))
    out = quality.quality_rules(docs).collect()
    assert {r["doc_id"]: tuple(r[m] for m in quality.MEASURES) for r in out} == want
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(empty).count() == 0


def test_quality_keeps_ordinary_and_drops_odd(spark):
    rng = random.Random(1)
    plain = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(100)), "en" if i % 2 else None, "s") for i in range(600)]
    odd = [(1000 + i, "### $$$ &&& " * 40, "en", "s") for i in range(3)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(plain + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(600)) and not any(got[1000 + i] for i in range(3))


def test_quality_verdicts_equal_plain_sketches(spark):
    """Verdicts from sketches counted in plain Python, for groups small and large, nulls and repeated rows."""
    rng = random.Random(12)

    def text(kind):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9 + 9 * (kind == 3)))) for _ in range(rng.randint(20, 90))]
        if kind == 1:
            words = [w + rng.choice(["#", "$$", ""]) for w in words]
        lines = [" ".join(words[i : i + 6]) for i in range(0, len(words), 6)]
        if kind == 2:
            lines = [x for i in range(0, len(lines)) for x in (lines[i], "so it says")]
        return "\n".join(lines)

    data = [(i, text(rng.choice([0] * 12 + [1, 2, 3])), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", None])) for i in range(700)]
    data += data[:40] + [(1000, text(2), "xx", "once"), (1001, None, "yy", "none")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    got = sorted((r["doc_id"], r["kept"]) for r in quality.quality_rules(df).collect())

    counted = []
    for i, t, lang, source in data:
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        runs = {}
        for j in range(len(w) - 7):
            runs.setdefault(tuple(w[j : j + 8]), []).append(j)
        repeat = len({k for at in runs.values() if len(at) > 1 for j in at for k in range(j, j + 8)})
        chars = sum(map(len, w))
        value = {"mean_word": chars / max(len(w), 1), "symbol_share": len(re.findall(r"[#*$%&|<>]", t or "")) / max(chars, 1), "dup_share": (len(lines) - len(set(lines))) / max(len(lines), 1), "repeat_share": repeat / max(len(w), 1)}
        counted.append((i, lang, source, len(w) < 20 or 100 * repeat > 30 * len(w), value))

    def fence(rows, f):
        sketch = {}
        for r in rows:
            b = int(np.floor(np.log(r[4][f] + quality.SHIFT) / np.log(quality.GAMMA)))
            sketch[b] = sketch.get(b, 0) + 1
        cuts, rule = [], quality.FEATURES[f]
        for q in (rule.base, rule.high):
            upto = 0
            for b in sorted(sketch):
                upto += sketch[b]
                if upto > int(q * (len(rows) - 1)):
                    cuts.append(max(quality.GAMMA ** (b + 0.5) - quality.SHIFT, 0.0))
                    break
        wide = max(rule.spread * (cuts[1] - cuts[0]), quality.LEAST_WIDTH + (quality.GAMMA - 1) * (cuts[1] + quality.SHIFT))
        return np.array([cuts[0] - wide if rule.two_sided else -1.0, cuts[1] + wide])

    good, want, judged = [r for r in counted if not r[3]], [], {}
    for i, lang, source, failed, value in counted:
        kept = not failed
        for f in quality.FEATURES if kept else ():
            if (lang, source, f) not in judged:
                own, wide = [r for r in good if r[1:3] == (lang, source)], [r for r in good if r[1] == lang]
                g, x = len(own) / (len(own) + quality.PRIOR), len(wide) / (len(wide) + quality.PRIOR)
                judged[lang, source, f] = g * fence(own, f) + (1 - g) * (x * fence(wide, f) + (1 - x) * fence(good, f))
            low, high = judged[lang, source, f]
            kept &= bool(low <= value[f] <= high)
        want.append((i, kept))
    assert got == sorted(want) and 20 < sum(not k for _, k in want) < 400


def test_quality_fences_follow_their_group(spark):
    """Two sources, one with symbols, long words and repeated lines throughout: each is judged by its own scale."""
    rng = random.Random(21)

    def text(rich, symbols, length):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(length - 2, length + 2))) for _ in range(80)]
        words = [w + "#" * (rng.random() < symbols) for w in words]
        lines = [" ".join(words[i : i + 4]) for i in range(0, 80, 4)]
        return "\n".join(lines + lines[: rng.randint(0, 3)] * rich)

    data = [(i, text(False, 0, 5), "en", "prose") for i in range(1200)] + [(2000 + i, text(True, 0.3, 9), "xx", "code") for i in range(1200)]
    data += [(5000, text(False, 0.3, 5), "en", "prose"), (5001, text(False, 0.3, 9), "xx", "code"), (5002, text(False, 0, 9), "en", "prose"), (5003, text(False, 0, 9), "xx", "code")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    measured = quality.measure(df).cache()
    fence = {r["source"]: r for r in quality.thresholds(quality.sketches(measured)).collect()}
    prose, code = fence["prose"], fence["code"]
    assert prose["hi_symbol_share"] < 0.03 < 0.04 < code["hi_symbol_share"]
    assert prose["hi_mean_word"] < 8 and prose["hi_mean_word"] + 2 < code["hi_mean_word"] and prose["hi_dup_share"] + 0.1 < code["hi_dup_share"]
    # the width comes from the sketch wherever the group shows the feature
    assert code["hi_symbol_share"] > 4 * quality.LEAST_WIDTH and code["hi_dup_share"] > 0.2
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(df).collect()}
    assert (kept[5000], kept[5001], kept[5002], kept[5003]) == (False, True, False, True)
    assert sum(kept[i] for i in range(1200)) > 1190 and sum(kept[2000 + i] for i in range(1200)) > 1150
    measured.unpersist()


def test_quality_drops_mainly_repeated_short_lines(spark):
    rng = random.Random(2)
    plain = [(i, "\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(6)) for _ in range(20)), "en", "s") for i in range(60)]
    fixed = ["just six short words in here", "and six other words over there", "the last six words of it"]
    menu = "\n".join(x for _ in range(4) for x in [*rng.sample(fixed, 3), *(" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2)) for _ in range(2))])
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality_rules(spark.createDataFrame([*plain, (100, menu, "en", "s")], "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] == (False, True) for i in range(60)) and not got[100][1]


def test_language(spark, empty):
    rng = random.Random(5)
    kinds = {"aa": ["th", "he", "in", "er"], "bb": ["ö", "ch", "sch", "ung"]}
    data = [(i, " ".join("".join(rng.choice(kinds[x]) for _ in range(3)) for _ in range(60)), x) for i in range(200) for x in [rng.choice(sorted(kinds))]]
    data += [(900, None, "aa"), (901, "123 !!", "aa"), (902, "", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(langid.training_rows(df))
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    held = [(i, x) for i, _, x in data[:200] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i]["lang_pred"] == x for i, x in held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0 for i in (900, 901, 902))
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r["doc_id"] for r in langid.accepted(df, model).collect()} == set(range(200))


def test_language_equals_plain_compression(spark):
    """Dictionaries hold training texts of their language only; predictions are those of compressing piece by piece, for long texts, repeated rows and ties."""
    import zstandard

    rng = random.Random(15)
    kinds = {"aa": ["th", "he", "in", "er"], "bb": ["ö", "ch", "sch", "ung"], "cc": ["la", "os", "ñu", "er"]}

    def text(kind, n):
        return " ".join("".join(rng.choice(kinds[kind]) for _ in range(3)) for _ in range(n))

    data = [(i, text(x, rng.choice([1, 3, 60, 400])), x) for i in range(240) for x in [rng.choice(sorted(kinds))]]
    data += [(300, text("aa", 20_000), None), (301, text("bb", 150) + text("cc", 150), None), (5, data[5][1], data[5][2]), (302, "x", None), (303, "Ǆ", "bb")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(langid.training_rows(df))
    counts = {x: sum(1 for i, _, y in data if y == x and zlib.crc32(str(i).encode()) % 4 != 2) for x in kinds}
    assert list(model.languages) == sorted(kinds, key=lambda x: (-counts[x], x))
    for x, raw in zip(model.languages, model.dictionaries, strict=True):
        own = [t.lower() for i, t, y in data if y == x and zlib.crc32(str(i).encode()) % 4 != 2]
        parts = raw.decode("utf-8", "ignore").split("\n")
        # the first may be cut by the bound on bytes
        assert len(raw) <= langid.DICT_BYTES and len(parts) <= langid.SAMPLE_ROWS and all(any(p in t for t in own) for p in parts)
    want = []
    for i, t, _ in data:
        raw, sizes = t.lower().encode(), []
        for known in model.dictionaries:
            d = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(raw[k : k + langid.PIECE_BYTES])) for k in range(0, len(raw), langid.PIECE_BYTES)))
        first, second = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))[:2]
        score = (sizes[second] - sizes[first]) / sizes[second]
        want.append((i, model.languages[first], round(score, 9), score < langid.MIN_MARGIN))
    got = [(r["doc_id"], r["lang_pred"], round(r["score"], 9), r["rejected"]) for r in langid.predict(df, model).collect()]
    assert sorted(got) == sorted(want) and any(r[3] for r in want)


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    whole = Tokenizer.from_file(path)
    long = [(1000 + i, " ".join(t or "" for _, t in rows) * (i + 1)) for i in range(2)] + [(2000, "a <|endoftext|> B\x01c don't stop!!")]
    spark = docs.sparkSession
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(long, "doc_id long, text string"))
    placed = packing.packed(every, path, with_ids=True).persist()
    got = {}
    for r in placed.collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t in [*rows, *long]:
        ids, at = [*whole.encode(t or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(got[i], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part) and bytes(r["ids"]) == part
            at += r["length"]
        assert at == len(ids)
    for s in packing.sequences(placed).collect():
        n = s["n_tokens"]
        assert n <= 4096 and len(s["ids"]) == (n if n & (n - 1) == 0 else 4096)
    by_sequence = {}
    for r in placed.collect():
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    assert packing.packed(empty, path).count() == 0


@pytest.mark.parametrize("block_pieces", [packing.BLOCK_PIECES, 7])
def test_packed_matrices(spark, rows, docs, empty, block_pieces):
    from tokenizers import Tokenizer

    whole, path = Tokenizer.from_file(tokenizer_path()), tokenizer_path()
    long = [(1000 + i, " ".join(t or "" for _, t in rows) * (i + 1)) for i in range(2)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame([*long, (3000, "same"), (3000, "same"), (None, "no id")], "doc_id long, text string"))
    got, seen = {}, set()
    for r in packing.matrices(every, path, block_pieces).collect():
        ids, positions, ends = np.frombuffer(r["ids"], dtype="<u4"), np.frombuffer(r["position_ids"], dtype="<u2"), r["cu_seqlens"]
        assert len(ids) == len(positions) == 4096 and ends[0] == 0 and ends[-1] == r["n_tokens"] and len(ends) - 1 == len(r["doc_ids"]) == len(r["starts"])
        assert not ids[ends[-1] :].any() and not positions[ends[-1] :].any() and r["sequence_id"] not in seen
        seen.add(r["sequence_id"])
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], ends, ends[1:], strict=False):
            assert positions[a:b].tolist() == list(range(b - a))
            got.setdefault(doc, []).append((start, ids[a:b].tolist()))
    want = {}
    for i, t in [*rows, *long, (3000, "same"), (3000, "same"), (None, "no id")]:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        want.setdefault(i, []).extend((at, ids[at : at + 4096]) for at in range(0, len(ids), 4096))
    assert {i: sorted(p) for i, p in got.items()} == {i: sorted(p) for i, p in want.items()}
    assert packing.matrices(empty, path).count() == 0


def test_segment_tree_finds_the_tightest_room():
    rng = random.Random(9)
    for capacity in (1, 7, 64, 4096):
        lengths = [rng.randint(1, capacity) for _ in range(400)]
        rooms, want = [], []
        for i in sorted(range(400), key=lambda i: -lengths[i]):
            fits = [r for r in rooms if r >= lengths[i]]
            rooms.append((min(fits) if fits else capacity) - lengths[i])
            if fits:
                rooms.remove(min(fits))
        made = packing.best_fit_decreasing(np.array(lengths), capacity)
        assert sorted(i for m in made for i in m) == list(range(400))
        assert sorted(capacity - sum(lengths[i] for i in m) for m in made) == sorted(rooms)


@pytest.mark.parametrize("marks", [True, False])
def test_ids_are_those_of_the_tokenizer(marks):
    """Letters whose case or composition depends on what follows, odd blanks, contractions, special strings."""
    from tokenizers import Tokenizer

    rng, path = random.Random(6), tokenizer_path()
    parts = [*"İıßẞHTWYJjΣςKÅéÉeEasStT12９²Ⅷªº中क१가😀", "'", "’", "'s", "'LL", ".", ",", "!!", "<|", "<|endoftext|>", "ǰ", "ŉ", "ﬁ", "ǅ", "\x00", "\x01", "\x1c", "\x85", "\xa0", "\u2028", "\u200b", "İ.", "ALİ.", "MİLLİ,", "é.", " ", " ", "\n", "\t"]
    parts += ["\u0331", "\u0308", "\u030a", "\u030c", "\u0301", "\u0307", "\u0345"] * marks
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    whole, ids = Tokenizer.from_file(path), packing.Ids(path)
    for t, raw in zip(texts, ids.of(texts), strict=True):
        assert np.frombuffer(raw, dtype="<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_inverse_of_a_basis():
    made = np.random.default_rng(3).integers(0, 9, (60, 60)).astype(float) + np.eye(60)
    assert np.abs(packing._inverse(made) @ made - np.eye(60)).max() < 1e-8


def test_cutting_stock_is_near_its_bound():
    rng = random.Random(2)
    demand = {s: rng.randint(50, 500) for s in rng.sample(range(3, 90), 60)}
    patterns = packing.plan(demand, 256)
    made = {}
    for p, times in patterns:
        assert sum(s * k for s, k in p.items()) <= 256
        for s, k in p.items():
            made[s] = made.get(s, 0) + k * times
    assert made == demand
    bound = sum(s * n for s, n in demand.items()) / 256
    assert sum(t for _, t in patterns) <= 1.02 * bound + 2


def test_secrets(spark, empty):
    rng = random.Random(4)
    chars = secrets.ALPHABET
    key = "".join(rng.choice(chars[:62]) for _ in range(44))
    prose = [" ".join("".join(rng.choice(["ing", "tion", "er", "the", "un"]) for _ in range(rng.randint(2, 9))) for _ in range(80)) for _ in range(60)]
    texts = [*prose, f"é password = 'abcdef1' and {key} end", "token:abc secret=token:abcdefg api_key: \"zzzzzz", "AKIA" + "B7" * 10 + " AKIAX " + "0123456789abcdef" * 2, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rules = [("assign", re.compile(secrets.ASSIGN), lambda m: len(m[2]) >= 6), ("access", re.compile(secrets.ACCESS), lambda m: len(m[0]) >= 20), ("hex", re.compile(secrets.HEX), lambda m: len(m[0]) >= 24)]
    out = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end(), name) for k, (name, rule, ok) in enumerate(rules) for m in rule.finditer(t or "") if ok(m))
        assert [(s["start"], s["rank"], s["end"], s["kind"]) for s in out[i]["base"]] == want
    assert [s["kind"] for s in out[60]["spans"]] == ["assign", "random"]
    at = texts[60].index(key)
    assert (out[60]["spans"][1]["start"], out[60]["spans"][1]["end"]) == (at, at + 44)
    assert all(not out[i]["spans"] for i in range(60))
    masked = {r["doc_id"]: r["text"] for r in secrets.masked(df).collect()}
    assert masked[60] == f"é {secrets.MASK}' and {secrets.MASK} end" and masked[63] is None and masked[0] == texts[0]
    assert secrets.scan(empty).count() == 0


def test_secret_spans_equal_a_plain_scan(spark):
    """All spans, random ones too, against Python with the same model: cut tokens, overlaps, repeated rows, a long text, clashing columns."""
    rng = random.Random(14)
    letters = secrets.ALPHABET

    def noise(n):
        return "".join(rng.choice(letters) for _ in range(n))

    prose = [" ".join("".join(rng.choice(["ing", "tion", "er", "the", "un"]) for _ in range(rng.randint(2, 9))) for _ in range(60)) for _ in range(40)]
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(8)]
    texts = prose + [f"id={hexes[0]}/{noise(40)} tail", f"secret={hexes[1]}{noise(3)} {noise(25)}", f"token='{hexes[2]}' AKIA{'7Q' * 12}{hexes[3]}"]
    texts += [f"key {noise(44)} and password: {noise(18)} é {hexes[4]}" for _ in range(20)]
    texts += [None, "", "x", (prose[0] + f" api_key={noise(30)} ") * 300, texts[40], texts[40]]
    clash = spark.createDataFrame([(i, t, "b", "s", "o", "r", [i], None) for i, t in enumerate(texts)], "doc_id long, text string, base string, spans string, open string, row string, `__text` array<int>, `a.b` string")
    model = secrets.train(secrets.labelled_tokens(clash))
    size = len(letters)

    def ratio(token):
        at = [letters.find(c) for c in token]
        return sum(model[a * size + b] for a, b in zip(at, at[1:]))

    rules = [("assign", re.compile(secrets.ASSIGN), lambda m: len(m[2]) >= 6), ("access", re.compile(secrets.ACCESS), lambda m: len(m[0]) >= 20), ("hex", re.compile(secrets.HEX), lambda m: len(m[0]) >= 24)]
    found = {r["doc_id"]: r for r in secrets.scan(clash).collect()}
    masked = {r["doc_id"]: r for r in secrets.masked(clash).collect()}
    n_random = 0
    for i, t in enumerate(texts):
        t = t or ""
        base = sorted((m.start(), k, m.end(), name) for k, (name, rule, ok) in enumerate(rules) for m in rule.finditer(t) if ok(m))
        blank = list(t)
        for a, _, b, _ in base:
            blank[a:b] = " " * (b - a)
        tokens = [m for m in re.finditer(secrets.TOKEN, "".join(blank))]
        assert all(abs(ratio(m[0]) - secrets.LEAST_RATIO) > 1e-3 for m in tokens)
        more = [(m.start(), 3, m.end(), "random") for m in tokens if ratio(m[0]) >= secrets.LEAST_RATIO]
        n_random += len(more)
        assert [(s["start"], s["rank"], s["end"], s["kind"]) for s in found[i]["spans"]] == sorted(base + more)
        want, at = "", 0
        for a, _, b, _ in sorted(base + more):
            if b > at:
                want += t[at : max(a, at)] + secrets.MASK * (a >= at)
                at = b
        assert (masked[i]["text"] or "") == want + t[at:] and (masked[i]["text"] is None) == (texts[i] is None)
        assert (masked[i]["base"], masked[i]["spans"], masked[i]["__text"], masked[i]["a.b"]) == ("b", "s", [i], None)
    assert n_random > 10 and secrets.masked(clash).columns == clash.columns
    assert [s["kind"] for s in found[40]["spans"]] == ["hex", "random"]


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "<\\|im_start|>\\", "a<\\\\|b", "", None, "x\ny", "<|"]
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(nasty)] + [(2, 0, "sys\nte%m", "one"), (3, 5, "assistant", "b"), (3, 5, "assistant", "a"), (4, None, None, None)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    back = {r["conv_id"]: r for r in chat.read_back(chat.formatted(chat.branches(chat.linear_tree(rows)))).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [(r, t or "") for _, _, r, t in turns[:7]]
    assert back[1]["loss_text"] == "".join(t or "" for _, _, r, t in turns[:7] if r == "assistant")
    assert back[2]["turns"][0]["role"] == "sys\nte%m" and back[3]["loss_text"] == "ab" and back[4]["turns"][0]["text"] == ""
    assert "conv_id" in OP10_SQL


def test_chat_odd_rows(spark):
    """Very long texts, repeated rows, repeated message ids, missing ids and columns of clashing names."""
    long = "word <|im_end|> " * 60_000
    turns = [(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "assistant", "twice"), (2, 0, "assistant", "twice"), (None, 0, "user", "lost")]
    rows = spark.createDataFrame([(*t, "a", "b", 3, [1], 4) for t in turns], "conv_id long, turn long, role string, text string, msg string, parent string, score int, parts array<int>, branch int")
    back = {r["conv_id"]: r for r in chat.read_back(chat.formatted(chat.branches(chat.linear_tree(rows)))).collect()}
    assert set(back) == {1, 2} and back[1]["loss_text"] == long and [t["text"] for t in back[1]["turns"]] == [long, long] and back[2]["loss_text"] == "twicetwice"
    tree = [(1, i, i - 1 if i else None, "user", f"t{i}", 0.0, "x") for i in range(40)] * 2 + [(1, 39, 38, "user", "another", 0.0, "x"), (1, None, 3, "user", "no id", 9.0, "x")]
    got = chat.branches(spark.createDataFrame(tree, "conv_id long, msg long, parent long, role string, text string, score double, depth string")).orderBy("depth").collect()
    assert [r["text"] for r in got] == [f"t{i}" for i in range(39)] + ["another"]


def test_chat_tree_keeps_best_branch(spark):
    tree = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", -1.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 3, "user", "more", 0.0), (1, 5, 9, "user", "orphan", -9.0)]
    rows = spark.createDataFrame(tree, "conv_id long, msg long, parent long, role string, text string, score double")
    best = chat.branches(rows).orderBy("depth").collect()
    assert [r["text"] for r in best] == ["q", "good", "more"]
    assert chat.branches(rows, keep=9).select("branch").distinct().count() == 3
    assert chat.branches(rows.limit(0)).count() == 0
    chain = spark.range(130).select(F.lit(7).alias("conv_id"), F.col("id").alias("msg"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.lit("t").alias("text"), F.lit(0.0).alias("score"))
    assert chat.branches(chain).count() == 130


def test_words_and_fingerprints():
    import pyarrow as pa

    texts = arrays.Texts.of(pa.array(["a b", None, "b", "bbé b"]))
    words = arrays.Words(texts, arrays.NOT_SPACE)
    assert words.counts.tolist() == [2, 0, 1, 2]
    h = arrays.segment(texts.sums(), words.start, words.end)
    assert h[1] == h[2] == h[4] and len(set(h.tolist())) == 3


def test_pipeline(spark, rows, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = frame(spark, [(i, t) for i, t in rows if i % 2 == 0]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join((rows[10][1] or "").split()[:30]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    step = docs
    for name, stage in pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns, name
    out = pipeline.run(spark, str(tmp_path))
    kept = {r["doc_id"] for r in out.collect()}
    assert kept and kept <= {r["doc_id"] for r in docs.collect()} and 10 not in kept


CLASH = "doc_id long, text string, lang string, source string, n_chars long, base string, spans string, open string, row int, bits string, sig string, piece long, ids string, `a.b` int"


def near_root(texts, k):
    """doc_id -> smallest linked doc_id among (doc_id, text), by comparing all pairs."""
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_pipeline_stages_equal_plain_ones(spark, rows, tmp_path):
    """Every stage on odd rows (nulls, empty and long texts, repeated rows, clashing columns) against Python."""
    from tokenizers import Tokenizer

    pipeline = pytest.importorskip("corpus_pipeline")
    secret = "password = 'abcdef123' and more words in this line here"
    data = [(i, t, "en" if i % 3 else "de") for i, t in rows] + [(900, secret, None), (900, secret, None), (901, "42 17 !!", "en"), (902, " ".join(t or "" for _, t in rows), "en"), (None, rows[4][1], None)]
    docs = spark.createDataFrame([(i, t, lang, None, None, "b", "s", None, 4, "x", "y", 7, "z", n) for n, (i, t, lang) in enumerate(data)], CLASH).repartition(3)
    item = " ".join((rows[10][1] or "").split()[:30])
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def seen(df):
        return sorted(((r["doc_id"], r["text"], r["a.b"]) for r in df.collect()), key=str)

    stages, sf = dict(pipeline.STAGES), str(tmp_path)
    model = langid.fit(langid.training_rows(docs))
    judge = langid._compressors(model)
    now = [(i, t, n) for n, (i, t, _) in enumerate(data)]
    want = []
    for i, t, n in now:
        lang, score = langid.classify(t, model, judge)
        if lang != langid.UNKNOWN and score >= langid.MIN_MARGIN:
            want.append((i, t, n))
    step = stages["language"](spark, docs, sf)
    assert step.columns == docs.columns and seen(step) == sorted(want, key=str) and want
    # later stages see odd rows as well
    step, now = docs, now
    root = near_root([(i, t) for i, t, _ in now if i is not None], 5)
    want = [(i, t, n) for i, t, n in now if i is None or root[i] == i]
    step = stages["near_duplicates"](spark, step, sf).persist()
    assert step.columns == docs.columns and seen(step) == sorted(want, key=str)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall(item.translate(LOWER))
    windows = {tuple(w[j : j + 10]) for j in range(len(w) - 9)}
    now, want = want, []
    for i, t, n in now:
        w = word.findall((t or "").translate(LOWER))
        if not any(tuple(w[j : j + 10]) in windows for j in range(len(w) - 9)):
            want.append((i, t, n))
    step = stages["decontamination"](spark, step, sf).persist()
    assert step.columns == docs.columns and seen(step) == sorted(want, key=str) and len(want) < len(now)
    step = stages["secret_scans"](spark, step, sf).persist()
    got = {n: (i, t) for i, t, n in seen(step)}
    assert step.columns == docs.columns and set(got) == {n for _, _, n in want}
    assert {got[n][1] for i, _, n in want if i == 900} == {secret.replace("password = 'abcdef123", secrets.MASK)}
    assert all(got[n] == (i, t) for i, t, n in want if i != 900)
    whole = Tokenizer.from_file(tokenizer_path())
    pieces = {}
    for r in stages["packing"](spark, step, sf).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], dtype="<u4").tolist()))
    made = {}
    for i, t in got.values():
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        made.setdefault(i, []).extend((at, ids[at : at + 4096]) for at in range(0, len(ids), 4096))
    assert {i: sorted(p) for i, p in pieces.items()} == {i: sorted(p) for i, p in made.items()}
    none = docs.limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name


def test_secret_scans_of_a_text_with_many_matches(spark):
    """100,000 matches in one text, some of which overlap: spans as the patterns find them, in time that follows the text."""
    import time

    rng = random.Random(12)
    made = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(1000)]
    forms = ["{0} é", "token={0},", "\n{0}G", "secret: '{0}' x"]
    text = "".join(forms[i % 4].format(made[rng.randrange(1000)]) for i in range(100_000))
    docs = spark.createDataFrame([(1, text), (2, "plain words"), (3, made[0])], "doc_id long, text string")
    began = time.time()
    row = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    assert time.time() - began < 120
    want = []
    for rank, (kind, pattern, least) in enumerate((("assign", secrets.ASSIGN, 6), ("access", secrets.ACCESS, 20), ("hex", secrets.HEX, 24))):
        want += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if len(m[2] if kind == "assign" else m[0]) >= least]
    assert [tuple(s) for s in row[1]["base"]] == sorted(want) and len(want) > 140_000
    assert row[3]["base"] and not row[2]["spans"]
    masked = {r["doc_id"]: r["text"] for r in secrets.masked(docs).collect()}
    out, at = [], 0
    for s in row[1]["spans"]:
        if s["end"] > at:
            out += [text[at : max(s["start"], at)], secrets.MASK * (s["start"] >= at)]
        at = max(at, s["end"])
    assert masked[1] == "".join(out) + text[at:] and masked[2] == "plain words"


def test_divergence_counts_every_chunk_of_a_task(spark):
    words = [f"Ä{'äöü'[i % 3] * (1 + i % 5)}x{i % 997}" for i in range(60_000)]
    # about 0.9 MB each, so that a task cuts them into several chunks
    texts = [" ".join(words[i:] + words[:i]) for i in range(4)]
    docs = spark.createDataFrame([("de", f"s{i % 2}", t) for i, t in enumerate(texts)], "lang string, source string, text string").coalesce(1)
    got = {(r["source"], r["term"]): (r["n"], r["docs"]) for r in divergence.term_counts(docs).collect()}
    terms = Counter(w.rstrip("0123456789") for w in words)
    want = {(f"s{s}", t): (2 * n, 2) for s in range(2) for t, n in terms.items()} | {(f"s{s}", ""): (0, 2) for s in range(2)}
    assert got == want
