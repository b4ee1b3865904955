"""Token files, licenses, joins, benchmark passages, classifiers and neighbours."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import decontaminate, licenses, nearest, ngram_join, quality, tokens, toxicity

WORDS = [a + b for a in ("ka", "to", "mi", "re", "su", "lo") for b in ("n", "r", "la", "mi", "s", "te")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_token_files(documents, odd):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["a  b", "x\n\ny, z. it's", "Über&&&  \t x", " lead", "tail ", "a\u00a0b c", "<|endoftext|> x", "1 2 3.\nNew", None, ""]
    found = tokens.read_tokens(tokens.write_tokens(documents([(9 - i, t, "s") for i, t in enumerate(texts)]), path)).collect()
    start = 0
    for i, row in enumerate(sorted(found, key=lambda r: r.key)):
        ids = [*tokenizer.encode(texts[9 - i] or "", add_special_tokens=False).ids, 0]
        assert (row.start, row.n_tokens) == (start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert tokens.read_tokens(tokens.write_tokens(odd, path)).count() == 7
    assert tokens.read_tokens(tokens.write_tokens(odd.limit(0), path)).count() == 0


@pytest.mark.parametrize("units", [4, 1_200_000])
def test_units_equal_whole_texts(monkeypatch, units):
    """Random texts of hard characters, also with a cache that forgets nearly everything."""
    public = pytest.importorskip("public_tokenizers")
    from array import array

    monkeypatch.setattr(tokens, "CACHE_UNITS", units)
    monkeypatch.setattr(tokens, "LONG_UNIT", 5)
    encoder = tokens.WordEncoder(public.path("byte_bpe_50k.json"), "<u2")
    rng = random.Random(9)
    atoms = ["a", "Zz", "the", "é", "Ö", "ß", "\u01c5", "\u024f", "×", "÷", "ª", "1", "42", "²", "'", "'s", "'ll", "'x", "`", "{|}", "~", "<|endoftext|>"]
    atoms += [" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x85", "\u00a0", "\u2028", "\u3000", "中文", "ไทย", "🙂", "e\u0301", "\u0000", "."]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(14))) for _ in range(6000)]
    texts += [" ".join(rng.choice(WORDS) + rng.choice(["", ",", "!?", "'s", "7"]) for _ in range(300)) for _ in range(20)]
    for low in range(0, len(texts), 500):
        part = texts[low : low + 500]
        whole = [array("H", e.ids).tobytes() for e in encoder.tokenizer.encode_batch(part, add_special_tokens=False)]
        assert encoder.texts(part) == whole


def test_licenses(documents, odd):
    rows = [
        (1, "Released under the MIT License.\nMIT license", "s"), (2, "This work is licensed under the GNU General Public License, version 3", "s"),
        (3, "Licensed under CC BY-NC 4.0", "s"), (4, "x " * 500 + "licensed under the apache license version 2 0 " + "y " * 900, "s"),
        (5, "the license of the work", "s"), (6, "mit\nlicense", "s"),
    ]
    found = {r.doc_id: r for r in licenses.scan_licenses(documents(rows)).collect()}
    assert [found[i].labels for i in range(1, 7)] == ["mit", "gpl", "cc-by-nc", "apache", "", "mit"]
    assert (found[1].n_base, found[1].first_word, found[1].last_word) == (2, 3, 5)
    assert (found[4].n_base, found[4].first_word, found[4].n_words) == (1, 503, 1408)
    assert found[3].base_labels == "" and found[3].score >= 0.8 and found[5].score == 0
    assert licenses.scan_licenses(odd).count() == 7 and licenses.scan_licenses(odd.limit(0)).count() == 0


def brute_licenses(rows, templates, threshold=0.8):
    """Every run of every text against every template, without the join's filters."""
    out = {}
    for i, text, _ in rows:
        words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = []
        for label, template in templates:
            distinct = set(template.split(" "))
            span = 64
            while span < 2 * len(template.split(" ")):
                span *= 2
            runs = []
            for last in range(len(words)):
                latest = {w: at for at, w in enumerate(words[max(0, last + 1 - span) : last + 1], max(0, last + 1 - span)) if w in distinct}
                if words[last] in distinct and len(latest) >= threshold * len(distinct) - 1e-9:
                    runs.append((min(latest.values()), last, frozenset(latest), len(latest) / len(distinct)))
            places.append((label, runs))
        found = {
            label for at, (label, runs) in enumerate(places)
            if any(not any(r[3] > p[3] and p[2] <= r[2] and r[0] <= p[1] and r[1] >= p[0] for k, (_, other) in enumerate(places) if k != at for r in other) for p in runs)
        }
        base = {label for phrase, label in licenses.PHRASES if f" {phrase} " in f" {' '.join(words)} "}
        out[i] = ",".join(sorted(found | base))
    return out


def test_long_templates_equal_brute_force(documents):
    """Templates of 90 and 200 words, whole, with words changed, torn apart and too thin."""
    rng = random.Random(6)
    lexicon = [f"{a}{b}" for a in WORDS for b in ("x", "y", "z", "w", "v", "u")]
    long = [("ninety", " ".join(rng.sample(lexicon, 90))), ("twohundred", " ".join(rng.sample(lexicon, 200)))]
    templates = (*licenses.TEMPLATES, *long)
    rows = []
    for i in range(120):
        label, text = rng.choice(templates[-6:])
        words = text.split(" ")
        for at in rng.sample(range(len(words)), int(len(words) * rng.choice([0, 0.1, 0.15, 0.25]))):
            words[at] = "other"
        step = rng.choice([1, 1, 1, 2, 3])
        if step > 1:
            words = [w for word in words for w in [word, *["fill"] * (step - 1)]]
        before, after = prose(rng, rng.randrange(300)), prose(rng, rng.randrange(300))
        rows.append((i, f"{before} {rng.choice([' ', chr(10)]).join(words)} {after}", "s"))
    rows.append((500, "\n".join(t for _, t in templates), "s"))
    found = {r.doc_id: r.labels for r in licenses.scan_licenses(documents(rows), templates).collect()}
    assert found == brute_licenses(rows, templates)
    assert sum("ninety" in x for x in found.values()) > 3 and sum("twohundred" in x for x in found.values()) > 3
    alone = {r.doc_id: r.labels for r in licenses.scan_licenses(documents(rows), tuple(long)).collect()}
    assert alone == brute_licenses(rows, long)


def test_wrapped_licenses(documents):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
    mpl = "subject to the terms of the Mozilla Public\n * License, v. 2.0"
    gpl = "This work is\nlicensed under the GNU General Public License, version 3"
    rows = [(100 * i + n, "x " * n + text + " y" * 150, "s") for i, text in enumerate((bsd, mpl, gpl)) for n in range(0, 100, 3)]
    rows.append((999, " z z z z z z\nz ".join(licenses.TEMPLATES[7][1].split()), "s"))
    found = {r.doc_id: r for r in licenses.scan_licenses(documents(rows)).collect()}
    for i, label in enumerate(("bsd", "mpl", "gpl")):
        assert {found[100 * i + n].labels for n in range(0, 100, 3)} == {label}
        assert {found[100 * i + n].score for n in range(0, 100, 3)} == {1.0}
    assert found[999].labels == ""  # too far apart


def test_several_licenses_in_a_line(documents):
    mit = "permission is hereby granted free of charge to any person obtaining a copy"
    bsd, nc, sa = licenses.TEMPLATES[7][1], "licensed under CC BY-NC 4.0", "licensed under CC BY-SA 4.0"
    rows = [(1, f"/*! {bsd}. {mit} */", "s"), (2, f"/*! {mit}; {bsd} */", "s"), (3, f"{nc}. {sa}", "s"), (4, nc, "s"), (5, f"{bsd} " + "x " * 90 + mit, "s")]
    found = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(documents(rows)).collect()}
    assert found == {1: ("bsd,mit", 1.0), 2: ("bsd,mit", 1.0), 3: ("cc-by-nc,cc-by-sa", 1.0), 4: ("cc-by-nc", 1.0), 5: ("bsd,mit", 1.0)}


def shingles(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def brute_groups(rows, percent=90):
    sets = {i: shingles(t) for i, t, _ in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= percent * (len(sets[a] | sets[b])):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    return {i: (len(s), root[i]) for i, s in sets.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(documents, odd, seed):
    rng = random.Random(seed)
    rows = []
    for size in (2, 3, 9, 14, 24, 40, 90, 200):
        base = prose(rng, size).split()
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + size // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy), "s"))
    found = ngram_join.link_documents(documents(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_groups(rows)
    if seed == 1:
        kept = ngram_join.keep_one(odd)
        assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5"]
        assert ngram_join.link_documents(odd.limit(0)).count() == 0


def edited(rng, base, edits):
    copy = list(base)
    for _ in range(edits):
        copy[rng.randrange(len(copy))] = rng.choice(WORDS)
    return " ".join(copy)


def test_sets_without_partners_make_no_pairs(documents):
    """Unrelated texts of like sizes share no list, whatever runs are empty; copies do."""
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 120))), "s") for i in range(300)]
    base = rows[5][1].split()
    rows.append((300, edited(rng, base, 1), "s"))
    docs = documents(rows).repartition(3)
    members = ngram_join._members(docs, "text", 5, 80, 8).collect()
    assert len({r.nid for r in members}) == 2 and len(members) == 2
    assert {r.doc_id: r.component_id for r in ngram_join.link_documents(docs, 5, 80).collect()} == {i: 5 if i == 300 else i for i in range(301)}


@pytest.mark.parametrize("percent", [80, 90])
def test_shared_lists_and_sketches_lose_no_link(percent):
    rng = np.random.default_rng(percent)
    for size in (9, 16, 17, 40, 130, 410, 1300):
        for _ in range(40):
            a = rng.integers(0, 2**63, size, dtype=np.uint64)
            # Partners of any allowed size, at the threshold as far as that goes.
            larger = int(rng.integers(0, size * (100 - percent) // percent + 1))
            swapped = max(0, (100 * size - percent * (size + larger)) // (100 + percent))
            b = np.unique(np.concatenate([a[swapped:], rng.integers(0, 2**63, larger + swapped, dtype=np.uint64)]))
            a = np.unique(a)
            shared = len(np.intersect1d(a, b))
            assert 100 * shared >= percent * (len(a) + len(b) - shared)
            apart = len(a) + len(b) - 2 * shared
            assert ngram_join.least_apart(ngram_join.sketch_of(a), ngram_join.sketch_of(b)) <= apart
            mine, other = (dict((int(k[0]) & 63, (set(k.tolist()), need)) for k, need in ngram_join.list_keys(x, percent)) for x in (a, b))
            both = [c for c in mine if c in other]
            assert both
            # The class of the larger set is in both.
            top = ngram_join.size_class(max(len(a), len(b)))[0]
            assert len(mine[top][0] & other[top][0]) >= max(mine[top][1], other[top][1])


def test_groups_of_edited_copies_in_cells(documents, monkeypatch):
    """Copies with edits of their own, most below the threshold with the first, met in many cells."""
    monkeypatch.setattr(ngram_join, "PIECE", 8)
    rng = random.Random(11)
    rows = []
    for size in (120, 250):
        base = prose(rng, size).split()
        passage = prose(rng, 40)
        rows += [(len(rows) + i, edited(rng, base, rng.randrange(0, size // 12)), "s") for i in range(60)]
        rows += [(len(rows) + i, f"{passage} {prose(rng, size)}", "s") for i in range(20)]
    found = {r.doc_id: r.component_id for r in ngram_join.link_documents(documents(rows), 3, 80).collect()}
    assert found == {i: root for i, (_, root) in brute_groups(rows, 80).items()}
    assert 10 < len(set(found.values())) < 150


def test_benchmark_passages(spark, documents, odd):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randrange(8, 60))) for i in range(40)] + [(None, prose(rng, 20)), (99, "two words"), (98, None)]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows, wanted = [], set()
    for i, text in items[:40]:
        words = text.split()
        for k in range(3):
            edited = list(words)
            for _ in range(int(0.1 * k * len(words))):
                edited[rng.randrange(len(edited))] = "zzz"
            rows.append((len(rows), f"{prose(rng, 30 * k)} {' '.join(edited).title()}, {prose(rng, 50)}", "s"))
            wanted.add((len(rows) - 1, i))
    clean = [(1000 + i, prose(rng, 200), "s") for i in range(100)]
    matched = decontaminate.with_matches(documents(rows + clean), table).select("row.doc_id", F.explode("matches").alias("m")).collect()
    found = {(r.doc_id, r.m.item_id) for r in matched}
    assert len(found & wanted) >= 0.97 * len(wanted) and all(d < 1000 for d, _ in found)
    exact = {(r.doc_id, r.m.item_id) for r in matched if r.m.distance == 0}
    assert {(d, i) for d, i in wanted if d % 3 == 0} <= exact
    kept = decontaminate.drop_contaminated(odd, table)
    assert kept.columns == odd.columns and kept.count() == 7
    assert decontaminate.drop_contaminated(odd, table.limit(0)).count() == 7


def test_short_and_unspaced_items(spark, documents):
    chinese, thai = "光合作用中植物吸收什么气体并释放出什么气体", "ประเทศไทยมีเมืองหลวงชื่ออะไร"
    items = [(1, "Boiling point, water?"), (2, chinese), (3, thai), (4, "東京。"), (5, "ja"), (6, " . "), (7, "")]
    texts = [
        "the boiling point (water)", "the boiling hot point water", f"题目：{chinese}？答", f"我们{chinese.replace('植物', '动物')}", f"ก{thai}ข", thai.replace("เมือง", "กกกกก"),
        "今日は東京に行く", "東の京", "naja jan", "oh JA!", "", None,
    ]
    table = spark.createDataFrame(items, "item_id long, text string")
    matched = decontaminate.with_matches(documents([(i, t, "s") for i, t in enumerate(texts)]), table)
    found = {r.doc_id: (r.item_id, r.distance) for r in matched.select("row.doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*").collect()}
    assert found == {0: (1, 0), 2: (2, 0), 3: (2, 1), 4: (3, 0), 5: (3, 5), 6: (4, 0), 9: (5, 0)}


@pytest.mark.parametrize("n", [5, 6, 9, 10, 12, 15, 17, 20, 40, 90])
def test_edited_items_of_all_lengths(n):
    rng = random.Random(n)
    hashes = np.random.default_rng(n).integers(1, 1 << 62, 100_000).astype(np.uint64)
    item, allowed = hashes[:n], int(0.2 * n)
    items = decontaminate.Items([7, 8], [item, hashes[200:205]], 0.2, decontaminate.REPEATS)
    texts = []
    for trial in range(60):
        edited = item.tolist()
        for place in rng.sample(range(n), allowed) if allowed > 1 else [trial % n]:
            edited[place] = int(hashes[rng.randrange(1000, 90_000)])
        lead = hashes[1000 + trial : 1000 + trial + 5 * (trial % 4)]
        texts.append(np.concatenate([lead, np.array(edited, np.uint64), hashes[5000:5030]]))
    texts += [np.concatenate([hashes[9000:9100], item[: n - allowed]]), np.concatenate([item[allowed:], hashes[300:390]]), hashes[:0]]
    found = items.matches(texts)
    assert [[m["item_id"] for m in row] for row in found] == [[7]] * 62 + [[]]
    assert all(row[0]["distance"] <= allowed for row in found[:-1])


def test_near_duplicate_stage(spark, documents):
    import corpus_pipeline

    rng = random.Random(8)
    rows, copies = [], set()
    for k in range(12):
        base = [f"{rng.choice(WORDS)}{rng.randrange(10_000)}" for _ in range(200)]
        changed = list(base)
        for place in range(30, 200, 50):  # 4 words, 20 five-word shingles: 176 of 216 shared
            changed[place] = "zzz"
        longer = base + [f"{rng.choice(WORDS)}{rng.randrange(10_000)}" for _ in range(30)]  # 196 of 226 shared
        far = base[:140] + [f"q{rng.randrange(10_000)}" for _ in range(60)]
        rows += [(4 * k + j, " ".join(t), "s") for j, t in enumerate((base, changed, longer, far))]
        copies |= {4 * k + 1, 4 * k + 2}
    sets = {i: shingles(t, 5) for i, t, _ in rows}
    ratios = [len(sets[i] & sets[i - i % 4]) / len(sets[i] | sets[i - i % 4]) for i in copies]
    assert all(0.8 <= r < 0.9 for r in ratios)
    kept = corpus_pipeline.near_duplicates(spark, documents(rows), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(sets) - copies)


def test_kept_texts_move_once(spark, documents):
    rows = [(i // 2, f"{WORDS[i % 3]} one two three four five {i // 4}", f"s{i % 5}") for i in range(40)] + [(None, "a b", "s")] * 2
    kept = ngram_join.keep_one(documents(rows), 5, 80)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        drawn = kept.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in settings:
            spark.conf.unset(name)
    # Above the join with the texts there is no further exchange.
    assert "Exchange" not in drawn[: drawn.index("SortMergeJoin")]
    assert kept.count() == len({r.text for r in kept.collect()})


def plain_distance(item: list[int], stretch: list[int]) -> int:
    row = list(range(len(stretch) + 1))
    for i, word in enumerate(item, 1):
        row, above = [i], row
        for j, other in enumerate(stretch, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (word != other)))
    return row[-1]


@pytest.mark.parametrize("cells", [1, 200, 1 << 18])
def test_edit_distances_of_many_pairs(monkeypatch, cells):
    monkeypatch.setattr(decontaminate, "TABLE_CELLS", cells)
    rng = np.random.default_rng(cells)
    items = [rng.integers(1, 4, rng.integers(1, 9)).astype(np.uint64) for _ in range(40)]
    stretches = [rng.integers(1, 4, rng.integers(1, 12)).astype(np.uint64) for _ in items]
    found = decontaminate.best_stretches(items, stretches, np.array([len(i) for i in items]))
    for item, stretch, (distance, begin, end) in zip(items, stretches, found, strict=True):
        a, b = item.tolist(), stretch.tolist()
        assert distance == min(plain_distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert plain_distance(a, b[begin:end]) == distance
    assert decontaminate.best_stretches([], [], np.array([])) == []


def test_toxicity(spark, documents, odd):
    rng = random.Random(4)
    rows = [(i, prose(rng, 60) + (" grobo" + rng.choice(["a", "en", "ti"]) + " you" if i % 4 == 0 else ""), "s") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.Model(documents(rows), labels, ~toxicity.held_out(F.col("doc_id")))
    scored = model.score(documents(rows), ["doc_id"]).filter(toxicity.held_out(F.col("doc_id"))).collect()
    assert np.mean([(r.score >= 0.7) == (r.doc_id % 4 == 0) for r in scored]) > 0.97
    assert all(0 <= r.score <= 1 for r in model.score(odd, ["doc_id"]).collect())
    untrained = toxicity.Model(odd, labels.limit(0), F.lit(True))
    assert untrained.score(odd, ["doc_id"]).count() == 7


def test_quality(spark, documents, odd):
    rng = random.Random(5)
    rows = [(i, prose(rng, 80) if i % 3 else " ".join(w + "&&&" for w in prose(rng, 80).split()), f"s{i % 5}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)], "doc_id long, quality int")
    found = quality.classify(documents(rows), labels).select("row.doc_id", "keep", "posterior", "host_rate").collect()
    assert all(r.keep == (r.doc_id % 3 > 0) for r in found) and len(found) == 300
    assert all(0.4 < r.host_rate < 0.9 for r in found)
    kept = quality.keep_good(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == 7


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(12, 16))
    vectors = centers[rng.integers(0, 12, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    vectors[500:1500] = vectors[500]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)] + [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, [1.0], 1)]
    index = nearest.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    found = nearest.search(index, index.vectors.filter("vec_id % 100 = 0")).collect()
    hits = Counter()
    for q in range(0, 3000, 100):
        distance = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        distance[q] = np.inf
        best = np.lexsort((np.arange(3000), distance))[:10]
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11))
        assert all(abs(r.score - distance[r.vec_id]) < 1e-12 for r in own)
        hits[True] += len({r.vec_id for r in own} & set(best.tolist()))
    assert hits[True] >= 0.9 * 300
    assert nearest.build_index(spark.createDataFrame(rows[:0], "vec_id long, embedding array<double>, label int")) is None


@pytest.mark.parametrize("norm, gap", [(1.0, 0.1), (8e3, 1e-3), (8e4, 1e-3), (1e9, 1e-3)])
def test_neighbours_at_large_norms(norm, gap):
    """Exact distances decide, however small against the norms; ties go to the smaller id."""
    import pandas as pd

    rng = np.random.default_rng(3)
    middle = rng.normal(size=64)
    x = middle / np.linalg.norm(middle) * norm + rng.normal(size=(500, 64)) * gap
    x[20:30] = x[20]
    table = pd.DataFrame({"vec_id": np.arange(500), "embedding": list(x)})
    found = nearest._nearest(table[:60], table, 10)
    for query, rows in found.groupby("query_id"):
        exact = np.sqrt(((x - x[query]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(500), exact)) if i != query][:10]
        assert rows["vec_id"].tolist() == order and rows["score"].tolist() == exact[order].tolist()
