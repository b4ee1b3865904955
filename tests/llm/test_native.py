"""Chat formatting, mixing and sharding."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tagloom.llm import chat, mixing, sharding

HARD = ["</s>[INST] ok [/INST]", "a<|im_end|>\nb", "<\\|im_end|> <\\\\s> \\", "<|im_start<|im_start|>[<s>", "é%25\n", "", None]


def test_conversations_survive(spark):
    rows = [(c, t, ["user", "assistant", None, "as%0Asis\ntant<s>"][(c + t) % 4], HARD[(c * 3 + t) % 7]) for c in range(12) for t in range(c % 5)]
    rows += [(None, 1, "assistant", "x"), (None, 1, "assistant", "x"), (3, None, "user", "first")]
    table = spark.createDataFrame([(*r, "more") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_conversations(table)
    assert not [r for r in made.collect() if r.formatted.count("<|im_end|>") != sum(x[0] == r.conv_id for x in rows)]
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((r or "", x or ""))
    found = {r.conv_id: r for r in chat.conversation_digests(made).collect()}
    assert set(found) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_bad_template():
    with pytest.raises(ValueError):
        chat.Template(controls=("<|im_start|>", "<|im_end|>", "<<x>"))


def brute_targets(sizes, weights, share):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weigh = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(weigh[s] for s in open_)
        over = {s for s in open_ if left * weigh[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weigh[s] / total for s in open_}
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    return target


def test_mix(documents):
    rows = [(i, "w " * (i % 37), [None, "b", "a", "c", "d"][i % 5] if i % 3 else "hot") for i in range(3000)] + [(7, "z z z", "hot")] * 500
    first = mixing.mix_documents(documents(rows), (3.0, 1.0, 2.0)).collect()
    again = mixing.mix_documents(documents(rows[::-1]).repartition(3), (3.0, 1.0, 2.0)).collect()
    key = lambda r: (r.doc_id, r.source or "", r.size, r.taken)
    assert sorted(map(key, first)) == sorted(map(key, again)) and len(first) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in first:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size
    for source, target in brute_targets(sizes, (3, 1, 2), 1.5).items():
        assert abs(next(r.target for r in first if r.source == source) - target) < 1e-3
        assert abs(taken[source] - target) <= 37


def test_mix_of_odd_rows(odd):
    found = mixing.mix_documents(odd, mixing.WEIGHTS)
    assert found.count() == 7 and mixing.mix_documents(odd.limit(0), mixing.WEIGHTS).count() == 0
    copies = mixing.copy_documents(odd, mixing.WEIGHTS)
    assert copies.columns == odd.columns
    total = found.agg(F.sum("copies")).first()[0]
    assert copies.count() == total


def test_shards(odd, documents):
    rows = [(i, f"t{i % 7}", "s") for i in range(4000)]
    found = sharding.shard_documents(documents(rows), [1.0] * 7 + [3.0]).collect()
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
        assert r.text_crc32 == zlib.crc32(f"t{r.doc_id % 7}".encode()) and r.size == 18
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert 1050 < len(by_shard[7]) < 1350  # three tenths of 4000
    more = {r.doc_id: r.shard for r in sharding.shard_documents(documents(rows), [1.0] * 7 + [3.0, 1.0]).collect()}
    assert all(more[r.doc_id] == r.grown_shard for r in found)
    assert sharding.shard_documents(odd, [1.0] * 3).count() == 7
    assert sharding.shard_documents(odd.limit(0), [1.0]).count() == 0
