"""Exact copies, spelling variants and the filter audit."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tagloom.llm import exact_dedup, filter_audit, queries, spelling
from tagloom.llm.sql import SQL

TESTDATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, size long, word string, part string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", "y") for i, t, s in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    found = queries.REGISTRY[name](spark, TESTDATA)
    columns = sorted(found.columns)
    connection = duckdb.connect()
    for view in ("documents", "labels"):
        connection.execute(f"CREATE VIEW {view} AS SELECT * FROM '{TESTDATA}/{view}.parquet'")
    cursor = connection.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    wanted = Counter(tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall())
    assert Counter(map(tuple, found.select(*columns).collect())) == wanted


# Exact copies


def equal_texts(rows):
    clean = [re.sub("[ \t\n\x0b\f\r]+", " ", t or "") for _, t, _ in rows]
    ids, first, out = defaultdict(list), {}, Counter()
    for (i, _, _), t in zip(rows, clean, strict=True):
        ids[t].append(i)
    for (i, _, _), t in zip(rows, clean, strict=True):
        keep = min((x for x in ids[t] if x is not None), default=None)
        kept = i == keep and t not in first
        if kept:
            first[t] = i
        out[i, keep, len(ids[t]), kept, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def copies():
    """Short texts of few letters and white space, long ones, nulls, a hot text, repeated rows."""
    rng = random.Random(3)
    atoms = ["a", "b", "  ", " \n", "é", "x" * 40, " "]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(40))) for _ in range(90)]
    texts += ["y z " * 50_000 + rng.choice(["", " ", "q"]) for _ in range(5)] + [None, "", " ", "   "]
    rows = [(rng.choice([None, *range(150)]), rng.choice(texts), "s") for _ in range(350)]
    return rows + [(1000 + i, "the hot text", "s") for i in range(170)] + [(3, "twice", None)] * 2


@pytest.mark.parametrize(
    "primes, huge", [(exact_dedup.PRIMES, exact_dedup.HUGE), (exact_dedup.PRIMES, 100), ((7,), exact_dedup.HUGE), ((31,), 50)]
)
def test_copies(spark, copies, primes, huge):
    """With small primes most fingerprints collide; with small ``huge`` chunks are rows of their own."""
    found = exact_dedup.group_equal(table(spark, copies), primes=primes, huge=huge)
    assert found.columns == ["id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, found.collect())) == equal_texts(copies)


def test_copies_dealt_out(spark, copies, monkeypatch):
    monkeypatch.setattr(exact_dedup, "GROUP", 16)
    monkeypatch.setattr(exact_dedup, "MAX_DEALS", 5)
    monkeypatch.setattr("tagloom.runtime.MAX_LOOKUP_ROWS", 1)
    assert Counter(map(tuple, exact_dedup.group_equal(table(spark, copies)).collect())) == equal_texts(copies)


def test_no_copies(spark):
    assert exact_dedup.group_equal(table(spark, []).limit(0)).count() == 0


def test_fingerprints_compose():
    rng = random.Random(5)
    prints = exact_dedup.Fingerprints()

    def part(raw):
        data, bounds = exact_dedup.normalise(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
        return prints.texts(data, bounds)[0]

    for _ in range(300):
        raw = "".join(rng.choice(["a", " ", "\n", "é", "bc"]) for _ in range(rng.randrange(40))).encode()
        cuts = sorted(rng.randrange(len(raw) + 1) for _ in range(rng.randrange(5)))
        parts = [part(raw[a:b]) for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)]
        assert prints.fold(parts) == part(raw)
        value = sum(c * pow(prints.bases[0], i, prints.primes[0]) for i, c in enumerate(re.sub(rb"[ \n]+", b" ", raw)))
        assert part(raw).values[0] == value % prints.primes[0]


# Spelling variants


def variants(docs, slips=199, least=5):
    counts = Counter()
    for i, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if slips and h % slips == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    pairs = {w: [v for v in words if near(w, v)] for w in words}
    form = {w: min(v, key=lambda x: (-words[x], x)) for w, v in pairs.items() if v}
    form = {w: f for w, f in form.items() if words[f] >= 5 * words[w]}
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(pairs[w]), words[form[w]] if w in form else None)
    return out


def spelled(found):
    rows = found.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def misspelt():
    """Words of few letters, so that many are near each other; chains of ever more frequent forms; odd rows."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abÉé") for _ in range(rng.randrange(5, 12))) for _ in range(250)]
    chain = ["wordss"] * 3125 + ["wordsss"] * 625 + ["wordssss"] * 125 + ["wordsssss"] * 25 + ["wordssssss"] * 5
    long = "q" * 70_000
    rows = [(i, " ".join(rng.choice(base).upper() if i % 3 else rng.choice(base) for _ in range(60)), "s") for i in range(120)]
    rows += [(200, " ".join(chain), "s"), (201, f"{long} {long}r " * 6, "s"), (None, "wordss wordss", "s"), (202, None, "s"), (203, "", "s")]
    return rows + [(204, "repeat repeats", "s")] * 6


def test_variants(spark, misspelt):
    found = spelled(spelling.group_variants(spelling.vocabulary(table(spark, misspelt))))
    assert found == variants(misspelt)
    assert any(f for f, *_ in found.values()) and found["wordssssss"][1] == "wordss"


def test_variants_in_pieces(spark, misspelt, monkeypatch):
    """Large blocks cut into pieces, small buckets, salted look-ups, texts cut into parts."""
    for name, value in (("PIECE", 7), ("BUCKET", 60)):
        monkeypatch.setattr(spelling, name, value)
    monkeypatch.setattr("tagloom.runtime.MAX_LOOKUP_ROWS", 1)
    assert spelled(spelling.group_variants(spelling.vocabulary(table(spark, misspelt), slips=0))) == variants(misspelt, slips=0)


def test_slices_keep_runs(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 3)
    for text in ("", "abcdefgh", "ab cd,efghi jk", "a b c d "):
        assert "".join(spelling._slices(text)) == text
        assert [r for s in spelling._slices(text) for r in re.findall("[a-z]+", s)] == re.findall("[a-z]+", text)


def test_no_words(spark):
    empty = table(spark, []).limit(0)
    assert spelling.group_variants(spelling.vocabulary(empty)).count() == 0
    assert spelling.group_variants(spelling.vocabulary(table(spark, [(1, "short one", "s")]))).count() == 0


# Filter audit


def audit(rows, labels):
    facts = defaultdict(list)
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    for i, text, source in rows:
        text = text or ""
        words = [w for w in re.split("[ \t\n\x0b\f\r]+", text) if w]
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": any((t or "") == text and j is not None and (i is None or j < i) for j, t, _ in rows),
        }
        facts[source or ""].append(({f for f, bad in fails.items() if bad}, i in good, i in toxic))
    out = []
    for part, docs in facts.items():
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = list(docs)
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                every = [d for d in docs if f in d[0]]
                lost = (sum(d[1] for d in gone), sum(d[2] for d in gone))
                sole = sum(d[0] == {f} for d in docs)
                steps.append((part, "".join(order), k + 1, len(left), len(gone), len(every) - len(gone), sole, *lost, f))
        shapley = Counter()
        for s in steps:
            shapley[s[-1]] += s[4]
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return Counter(out)


def test_audit(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(90)] + ["Ab", "LOUD", "c#", "d%"]
    texts = [" ".join(rng.choice(words[: rng.choice([10, 60, 94])]) for _ in range(rng.randrange(90))) for _ in range(60)]
    rows = [(rng.choice([None, *range(120)]), rng.choice([*texts, None, "", " \n"]), rng.choice(["a", "b", None, ""])) for _ in range(160)]
    rows += [(7, "again and again", "c")] * 3 + [(500 + i, "hot", "a") for i in range(90)] + [(900, " ".join(words) * 2000, "d")]
    labels = [(rng.choice([None, *range(130)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(100)]
    marked = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    wanted = audit(rows, labels)
    assert Counter(map(tuple, filter_audit.audit_filters(table(spark, rows), marked).collect())) == wanted
    monkeypatch.setattr("tagloom.runtime.MAX_LOOKUP_ROWS", 1)
    assert Counter(map(tuple, filter_audit.audit_filters(table(spark, rows), marked).collect())) == wanted
    assert filter_audit.audit_filters(table(spark, rows).limit(0), marked).count() == 0
    assert filter_audit.audit_filters(table(spark, rows), marked.limit(0)).count() == len(wanted)


@pytest.mark.parametrize("limit", [1, 100])
def test_audit_of_many_keys_passes_none_through_the_driver(spark, monkeypatch, limit):
    """Texts that occur again, labels: tables beyond the bound are shuffled, with the same result."""
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(200)]), f"text {i % 60} " * 30, rng.choice(["a", "b"])) for i in range(150)]
    labels = [(i, i % 2, rng.choice([0, 1, None])) for i in range(90)]
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(filter_audit, "LOOKUP_ROWS", limit)
    sets = filter_audit.failure_sets(table(spark, rows))
    counts = filter_audit.failure_counts(sets, marked)
    for df in (sets, counts):
        assert ("Broadcast" in df._jdf.queryExecution().executedPlan().toString()) == (limit > 90)
    assert Counter(map(tuple, filter_audit.audit_filters(table(spark, rows), marked).collect())) == audit(rows, labels)


def test_words_of_long_texts(monkeypatch):
    monkeypatch.setattr(filter_audit, "PIECE", 5)
    for text in (b"", b"a b c", b"abcdefghijk lm lm  n\nabcdefghijk", b"           ", b"x" * 40):
        assert filter_audit.word_counts(text) == (len(text.split()), len(set(text.split())))


def test_paths():
    into, out = filter_audit.reach(5), filter_audit.leave(5)
    assert into[31] == out[0] == 120 and all(into[s] * out[s] * len(list(itertools.combinations(range(5), s.bit_count()))) == 120 for s in range(32))
