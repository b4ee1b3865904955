"""The pipeline stage by stage against brute force, and the sites' empirical Bayes against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import exp, log

import pytest
from pyspark.sql import functions as F
from test_native import brute_targets
from test_text import WORDS, plain_distance, prose

import corpus_pipeline
from tagloom.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_rates(rows):
    """Host and path rates of (host, path, p), shrunk by moments as the method says."""

    def strength(sites):
        sites = [(g, n, m) for g, n, m in sites if n >= 2]
        total = sum(n for _, n, _ in sites)
        within = sum(n * m * (1 - m) for _, n, m in sites)
        if not total or not within:
            return 10_000.0
        spread = within / total
        between = sum(n * (g / n - m) ** 2 for g, n, m in sites)
        excess = (between - len(sites) * spread) / max(total - sum(n * n for _, n, _ in sites) / total, 1.0)
        return 10_000.0 if excess <= 0 else min(10_000.0, max(1.0, spread / excess - 1))

    hosts, paths = defaultdict(lambda: [0.0, 0]), defaultdict(lambda: [0.0, 0])
    for host, path, p in rows:
        for site in (hosts[host], paths[host, path]):
            site[0] += p
            site[1] += 1
    rate = (sum(p for *_, p in rows) + 1) / (len(rows) + 2)
    s = strength([(g, n, rate) for g, n in hosts.values()])
    host_rate = {h: (g + s * rate) / (n + s) for h, (g, n) in hosts.items()}
    s = strength([(g, n, host_rate[k[0]]) for k, (g, n) in paths.items()])
    return host_rate, {k: (g + s * host_rate[k[0]]) / (n + s) for k, (g, n) in paths.items()}


def test_sites_equal_plain_python(spark):
    rng = random.Random(5)
    rows = []
    for host in [None, *"abcdef"]:
        level = rng.random()
        for path in [None, "x", "y"]:
            rows += [(host, path, min(1.0, max(0.0, rng.gauss(level, 0.2)))) for _ in range(rng.choice([1, 2, 40]))]
    table = spark.createDataFrame(rows, "h string, q string, p double")
    hosts, paths = plain_rates(rows)
    found = quality.site_posteriors(table, "h", "q").collect()
    assert len(found) == len(paths)
    for r in found:
        assert r.host_rate == pytest.approx(hosts[r.host]) and r.path_rate == pytest.approx(paths[r.host, r.path])


def test_sparse_sites_shrink_toward_their_host(spark):
    """One good document lifts a path of a bad host little, many lift it a lot."""
    rows = [("bad", "many", 0.05)] * 400 + [("bad", "one", 0.95)] + [("bad", "much", 0.95)] * 200 + [("good", "many", 0.95)] * 400
    rows += [("good", "one", 0.05)] + [("lone", "x", 0.95)]
    table = spark.createDataFrame(rows, "h string, q string, p double")
    rate = {(r.host, r.path): (r.path_rate, r.host_rate) for r in quality.site_posteriors(table, "h", "q").collect()}
    (one, host), (much, _) = rate["bad", "one"], rate["bad", "much"]
    assert abs(one - host) < 0.35 < abs(much - host) + 0.1 and one < 0.8 < much
    assert rate["good", "one"][0] > 0.3 and rate["bad", "many"][0] < 0.1


def test_sites_help_where_texts_say_little(spark):
    """A third of the texts look like the other kind; their sites know better."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        site = i % 9
        good = rng.random() < (0.97 if site < 5 else 0.03)
        looks_good = good if rng.random() < 0.67 else not good
        text = prose(rng, 40) if looks_good else "# $ %% " + prose(rng, 8).upper() + " || " * 6
        rows.append((i, text, f"p{i % 2}", f"s{site}", 0))
        labels.append((i, int(good)))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    found = quality.classify(docs, marks.filter("doc_id % 3 = 0")).select("row.doc_id", "doc_rate", "posterior").collect()
    held = [r for r in found if r.doc_id % 3]
    alone, sites = (sum((r[c] >= 0.5) == bool(labels[r.doc_id][1]) for r in held) / len(held) for c in ("doc_rate", "posterior"))
    assert sites > alone + 0.15


def test_sites_of_urls(spark):
    urls = ["https://www.Example.org/a/b.html?q=1", "http://x.net", "http://x.net/page", "ftp://y.de:21/d/e/", "no url", "http://bad host/", None]
    host, path = quality.url_sites(F.col("url"))
    found = spark.createDataFrame([(u,) for u in urls], "url string").select(host, path).collect()
    assert [tuple(r) for r in found] == [("example.org", "/a"), ("x.net", "/"), ("x.net", "/"), ("y.de", "/d"), (None, None), (None, None), (None, None)]


# The pipeline


def words_of(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def near_copies(rows):
    """Ids that stay: the smallest of each group of texts linked by five-word shingles, and texts without any."""
    sets = {}
    for i, text in rows:
        words = [w for w in re.split("[ \t\n\x0b\f\r]+", (text or "").lower()) if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for at, a in enumerate(ids):
        for b in ids[at + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i for i in ids if find(i) == i}


def is_leak(text, items):
    words = words_of(text)
    for item in map(words_of, items):
        allowed = int(0.2 * len(item))
        row = list(range(len(item) + 1))
        best = row[-1]
        for word in words:
            new = [0]
            for k, other in enumerate(item, 1):
                new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (word != other)))
            row = new
            best = min(best, row[-1])
        if item and best <= allowed:
            return True
    return False


def shard_of(key, shards):
    digest = hashlib.md5(b"null" if key is None else f"k{key}".encode()).hexdigest()
    bids = []
    for shard in range(shards):
        u = (int(hashlib.md5(f"{digest}:{shard}".encode()).hexdigest()[:13], 16) + 0.5) / 16.0**13
        bids.append((-1.0 / log(u), -shard))
    return -max(bids)[1]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """A small corpus with every kind of row, run through the pipeline; the rows of each stage."""
    rng = random.Random(17)
    items = [prose(rng, 25) for _ in range(5)]
    rows = []
    for i in range(160):
        text = " ".join(f"{rng.choice(WORDS)}{rng.randrange(50)}" for _ in range(rng.randrange(30, 90)))
        if i % 8 == 1:
            text = "## " + " ".join("BUY $$$ || NOW" for _ in range(30))
        if i % 10 == 2:
            words = rng.choice(items).split()
            for k in rng.sample(range(25), rng.randrange(6)):
                words[k] = "other"
            text += " " + " ".join(words) + " " + prose(rng, 20)
        if i % 8 == 4:
            words = rows[-2][1].split()
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(500, None, "en", "s1", 0), (501, "", None, None, 0), (502, "three little words", "en", None, 18)]
    labels = [(i, int(i % 8 != 1), 0) for i in range(0, 160) if i % 5 < 3]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    with pytest.MonkeyPatch.context() as patch:
        paths = []

        def path_of(_, label):
            paths.append(f"{folder}/{label}")
            return paths[-1]

        patch.setattr(corpus_pipeline, "scratch_path", path_of)
        final = corpus_pipeline.run(spark, folder)
    read = [spark.read.parquet(p) for p in paths]
    assert len(read) == len(corpus_pipeline.STAGES) == 5
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), items, read, final


def test_quality_stage(stages):
    docs, labels, _, read, _ = stages
    found = quality.classify(docs, labels.select("doc_id", "quality")).select("row.*", "doc_rate", "posterior").collect()
    marks = [q for _, q, _ in labels.collect()]
    share = sum(marks) / len(marks)
    bad, good = quality.Classifier(docs, labels.select("doc_id", "quality")).means
    assert 0 <= bad < 0.3 and 0.8 < good <= 1
    _, paths = plain_rates([(r.source, r.lang, (r.doc_rate - bad) / (good - bad)) for r in found])
    kept = set()
    for r in found:
        p = min(max(r.doc_rate, 1e-15), 1 - 1e-15)
        ratio = max(-12.0, min(12.0, log(p / (1 - p)) - log(share / (1 - share))))
        prior = min(0.99, max(0.01, paths[r.source, r.lang]))
        assert r.posterior == pytest.approx(1 / (1 + exp(-(ratio + log(prior / (1 - prior))))), abs=1e-6)
        kept |= {r.doc_id} if r.posterior >= 0.5 else set()
    assert {r.doc_id for r in read[0].collect()} == kept
    assert read[0].columns == docs.columns and not kept & {i for i in range(160) if i % 8 == 1 and i % 10 != 2}
    assert sum(i % 8 != 1 for i in kept if i < 160) > 130


def test_near_copy_stage(stages):
    _, _, _, read, _ = stages
    before = [(r.doc_id, r.text) for r in read[0].collect()]
    assert sorted(r.doc_id for r in read[1].collect()) == sorted(near_copies(before)) and read[1].count() < len(before) - 10


def test_benchmark_stage(stages):
    _, _, items, read, _ = stages
    before = read[1].collect()
    assert {r.doc_id for r in read[2].collect()} == {r.doc_id for r in before if not is_leak(r.text, items)}
    assert read[2].count() < len(before) - 5


def test_mixing_stage(stages):
    _, _, _, read, _ = stages
    rows = {r.doc_id: r for r in read[2].collect()}
    copies = Counter(r.doc_id for r in read[3].collect())
    assert all(tuple(r) == tuple(rows[r.doc_id]) for r in read[3].collect()) and max(copies.values()) <= 2
    size = {i: len([w for w in re.split("[ \t\n\x0b\f\r]+", r.text or "") if w]) for i, r in rows.items()}
    sizes, taken = Counter(), Counter()
    for i, r in rows.items():
        sizes[r.source] += size[i]
        taken[r.source] += size[i] * copies[i]
    for source, target in brute_targets(sizes, corpus_pipeline.WEIGHTS, 1.5).items():
        assert abs(taken[source] - target) <= 90


def test_sharding_stage(stages):
    _, _, _, read, final = stages
    texts = Counter((r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 16) for r in read[3].collect())
    rows = final.collect()
    assert Counter((r.doc_id, r.text_crc32, r.size) for r in rows) == texts
    slots = defaultdict(list)
    for r in rows:
        assert r.shard == shard_of(r.doc_id, 40) and r.grown_shard == shard_of(r.doc_id, 41)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_pipeline_without_rows(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert plain_distance([1, 2], [1, 3]) == 1
