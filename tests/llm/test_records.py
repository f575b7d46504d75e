"""Near-duplicates and new batches against brute force."""

import json
import random
import re
import time
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest

from rosterlake.llm import graph, incremental, neardup, words

WORDS = [a + b for a in "ba be bi bo bu da de di do du ka ke ki ko ku ma me mi mo mu".split() for b in "lan ver tis mok ner sul pir dax fon gel".split()]


def _record(rng, n=120):
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    return {"name": text(2), "notes": ". ".join(text(10) for _ in range(n // 12)), "jobs": [{"firm": text(2), "years": rng.randrange(9), "detail": text(6)} for _ in range(3)], "x": {"y": [text(1)] * 2}}


def _edited(rng, record, share):
    def edit(v):
        if isinstance(v, str):
            return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in v.split(" "))
        if isinstance(v, dict):
            return {k: edit(x) for k, x in v.items()}
        return [edit(x) for x in v] if isinstance(v, list) else v

    out = edit(record)
    rng.shuffle(out["jobs"])
    return dict(reversed(out.items()))


def _bag(record):
    return Counter(re.findall(r"[^\W_]+", "\n".join(words.strings(record)).lower()))


def _alike(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


@pytest.fixture(scope="module")
def records():
    rng = random.Random(7)
    base = [_record(rng) for _ in range(120)]
    out = [(f"id{i:04}", r) for i, r in enumerate(base)]
    for i, r in enumerate(base[:60]):
        out.append((f"e{i:04}", _edited(rng, r, [0.0, 0.03, 0.08, 0.12][i % 4])))
    out += [(f"c{i:04}", base[3]) for i in range(5)] + [("short", {"a": "only a few words"}), ("short2", {"a": "only a few words"})]
    return out


def _brute(records):
    bags = [(i, _bag(r)) for i, r in records]
    big = [(i, b) for i, b in bags if sum(b.values()) >= words.FEWEST_WORDS]
    return {tuple(sorted((i, j))) for n, (i, a) in enumerate(big) for j, b in big[n + 1 :] if i != j and _alike(a, b) >= words.SIMILAR}


def _frame(spark, records):
    extra = [(None, json.dumps(records[0][1])), ("null", None), ("empty", "{}"), ("cut", '{"a": "b'), ("list", "[]"), *[(i, json.dumps(r)) for i, r in records[:3]]]
    return spark.createDataFrame([(i, json.dumps(r), "clash", 1) for i, r in records] + [(i, s, "x", 2) for i, s in extra], "id string, source string, content string, bands int")


def test_pairs_match_brute_force(spark, records):
    got = {(r.id_a, r.id_b) for r in neardup.similar_pairs(_frame(spark, records), "id", "source").collect()}
    want = _brute(records)
    assert got <= want
    assert len(got) >= 0.97 * len(want)
    assert all(tuple(sorted((f"c{i:04}", f"c{j:04}"))) in got for i in range(5) for j in range(i))


def test_large_blocks_are_cut_up_without_loss(spark, records, monkeypatch):
    frame = _frame(spark, records)
    reps = neardup.sketches(frame, "id", "source").selectExpr("content as rid", "low", "high", "bands").dropDuplicates(["rid"])
    whole = {tuple(r) for r in neardup.candidate_pairs(reps).collect()}
    hot = reps.selectExpr("rid", "low", "high", "array(7L) as bands")  # one key holds every row
    everything = {tuple(r) for r in neardup.candidate_pairs(hot).collect()}
    monkeypatch.setattr(neardup, "BLOCK", 32)
    assert {tuple(r) for r in neardup.candidate_pairs(hot).collect()} == everything >= whole


def test_bit_sliced_distances_are_hamming_distances():
    rng = np.random.default_rng(3)
    n = 300
    low, high = rng.integers(-(2**63), 2**63 - 1, n), rng.integers(-(2**63), 2**63 - 1, n)
    for i in range(1, n, 3):  # near ones
        low[i], high[i] = low[i - 1] ^ int(rng.integers(0, 1 << 20)), high[i - 1]
    keys = np.sort(rng.integers(0, 6, n))
    a, b = neardup.block_pairs(keys, low, high, radius=31)
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    ones = lambda x, y: (int(x) & (2**64 - 1) ^ int(y) & (2**64 - 1)).bit_count()
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if keys[i] == keys[j] and ones(low[i], low[j]) + ones(high[i], high[j]) <= 31}
    assert got == want


def test_a_crowded_block_is_compared_fast():
    rng = np.random.default_rng(5)
    n = 8_000
    low, high = rng.integers(-(2**63), 2**63 - 1, n), rng.integers(-(2**63), 2**63 - 1, n)
    low[7], high[7] = low[7_000], high[7_000] ^ 1
    keys = np.zeros(n, np.int64)
    neardup.block_pairs(keys[:100], low[:100], high[:100])
    began = time.process_time()
    a, b = neardup.block_pairs(keys, low, high, radius=20)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(7, 7_000)]
    assert time.process_time() - began < 4  # 32 million pairs


def _same_words():
    """300 records; half of each one's words are those of all others."""
    rng = np.random.default_rng(6)
    common = [f"w{i}" for i in range(60)]
    return [(f"r{i:03}", json.dumps({"a": " ".join(common + [f"x{x}" for x in rng.integers(0, 10**9, 60)])})) for i in range(300)]


def test_records_that_merely_use_the_same_words_are_left_out_before_the_exact_check(spark):
    rows = _same_words()
    rows.append(("twin", rows[0][1].replace("w3 ", "")))
    frame = spark.createDataFrame(rows, "id string, source string")
    sketched = neardup.sketches(frame, "id", "source").withColumnRenamed("content", "rid")
    assert neardup.candidate_pairs(sketched.select("rid", *[c for c in sketched.columns if c[:3] in ("low", "hig", "ban")])).count() <= 40  # of 44,850
    assert [tuple(r) for r in neardup.similar_pairs(frame, "id", "source").collect()] == [("r000", "twin")]


def test_ids_with_several_records_pair_once(spark, records):
    several = [(i, r) for i, r in records[:60]] + [(records[k % 7][0], records[k][1]) for k in range(7, 40)] + [("new", records[3][1]), ("new", records[4][1])]
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, r in several], "id string, source string")
    got = [(r.id_a, r.id_b) for r in neardup.similar_pairs(frame, "id", "source").collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(several)


def test_no_rows(spark, records):
    empty = _frame(spark, records).limit(0)
    assert neardup.similar_pairs(empty, "id", "source").count() == 0
    assert neardup.similar_pairs(_frame(spark, records[:1]), "id", "source").count() == 0


def test_refused_matches_brute_force(spark, records):
    rng = random.Random(11)
    history = records[:80]
    day = datetime(2024, 5, 1)
    requests, flat = [], []
    fresh = [_record(rng) for _ in range(12)]
    for q in range(6):
        batch = [fresh[2 * q], fresh[2 * q + 1], _edited(rng, history[q][1], 0.05), history[q + 10][1], _edited(rng, fresh[q], 0.04), {"a": "few words"}, fresh[2 * q]]
        body = json.dumps(batch if q % 2 else {"candidates": batch})
        requests.append((q, "f", day + timedelta(hours=(q * 5) % 6), "pending", body, 1))
        flat += [((day + timedelta(hours=(q * 5) % 6), n, q), r) for n, r in enumerate(batch)]
    requests += [requests[2], (50, "f", day, "accepted", None, 1), (51, "f", day, "pending", "{cut", 1)]
    df = spark.createDataFrame(requests, "request_id long, feed string, received_at timestamp, status string, candidates string, content int")
    got = {(r.request_id, r.record_no) for r in incremental.refused(_frame(spark, history), df).collect()}
    old = [_bag(r) for _, r in history]
    want = set()
    for key, r in flat:
        bag = _bag(r)
        if sum(bag.values()) < words.FEWEST_WORDS:
            continue
        earlier = old + [_bag(x) for k, x in flat if k < key and sum(_bag(x).values()) >= words.FEWEST_WORDS]
        if any(_alike(bag, b) >= words.SIMILAR for b in earlier):
            want.add((key[2], key[1]))
    assert got == want


def test_refused_without_history_or_requests(spark, records):
    none = _frame(spark, records).limit(0)
    requests = spark.createDataFrame([(1, "f", datetime(2024, 1, 1), "pending", json.dumps([records[0][1], records[0][1]]))], "request_id long, feed string, received_at timestamp, status string, candidates string")
    assert [tuple(r) for r in incremental.refused(none, requests).collect()] == [(1, 1)]
    assert incremental.refused(_frame(spark, records[:5]), requests.limit(0)).count() == 0


REQUESTS = "request_id long, feed string, received_at timestamp, status string, candidates string"


def _request(spark, number, records):
    return spark.createDataFrame([(number, "f", datetime(2024, 1, 1) + timedelta(days=number), "pending", json.dumps(records))], REQUESTS)


def _few_paragraphs(rng):
    """Pairs of records of few paragraphs, alike by 0.85 or more: none shares two whole paragraphs."""
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    run_on, two, four = text(60), [text(40), text(30)], [text(30) for _ in range(4)]
    change = lambda t: " ".join(["zzz", *t.split()[1:]])
    return [({"t": run_on}, {"t": change(run_on)}), ({"a": two[0], "b": two[1]}, {"a": two[0], "b": change(two[1])}), ({"p": four}, {"p": [four[0], *map(change, four[1:])]})]


def test_repeats_without_shared_paragraphs_are_refused(spark):
    pairs = [p for seed in range(40) for p in _few_paragraphs(random.Random(seed))]
    history = spark.createDataFrame([(f"h{i}", json.dumps(a)) for i, (a, _) in enumerate(pairs)], "id string, source string")
    assert all(_alike(_bag(a), _bag(b)) >= 0.85 for a, b in pairs)
    got = incremental.refused(history, _request(spark, 1, [b for _, b in pairs])).count()
    assert got == len(pairs)


def test_an_index_stays_and_only_the_batch_is_hashed(spark, records, tmp_path, monkeypatch):
    rng = random.Random(5)
    where = f"file://{tmp_path}/index"
    fresh = [_record(rng) for _ in range(3)]
    one = incremental.HashIndex(spark, where, buckets=3)
    first = incremental.refused(_frame(spark, records[:60]), _request(spark, 1, [records[4][1], fresh[0], fresh[1]]), one)
    assert {tuple(r) for r in first.collect()} == {(1, 0)}
    one.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(one.name)]
    hashed, rows = incremental.hashed, []
    monkeypatch.setattr(incremental, "hashed", lambda df, *a: rows.append(df.count()) or hashed(df, *a))
    again = incremental.HashIndex(spark, where, buckets=99)
    assert again.filled and again.buckets == 3
    batch = [_edited(rng, fresh[0], 0.04), fresh[2], _edited(rng, records[7][1], 0.04), fresh[1]]
    got = {tuple(r) for r in incremental.refused(None, _request(spark, 2, batch), again).collect()}
    assert got == {(2, 0), (2, 2), (2, 3)}
    assert rows == [4]
    again.close()


def test_keys_that_very_many_contents_share(spark, monkeypatch):
    monkeypatch.setattr(incremental, "HOT", 20)
    monkeypatch.setattr(incremental, "LEADERS", 2)
    rng = random.Random(9)
    shared, far = " ".join(rng.choice(WORDS) for _ in range(60)), " ".join(rng.choice(WORDS) for _ in range(60))
    body = lambda n: {"a": shared, "b": f"{n} " + " ".join(random.Random(n % 7).choices(WORDS, k=30))}
    history = [body(n) for n in range(120)]
    new = [body(n) for n in range(200, 230)] + [{"a": far, "b": "one two"}, {"a": far + " more", "b": "one two"}]
    df = spark.createDataFrame([(f"h{i}", json.dumps(r)) for i, r in enumerate(history)], "id string, source string")
    got = {r.record_no for r in incremental.refused(df, _request(spark, 1, new)).collect()}
    want = {i for i, r in enumerate(new) if any(_alike(_bag(r), _bag(x)) >= words.SIMILAR for x in history + new[:i])}
    assert got == want


def test_very_long_records(spark):
    long = {"t": " ".join(f"w{i % 5000}" for i in range(60_000))}
    df = spark.createDataFrame([("a", json.dumps(long)), ("b", json.dumps(long | {"u": "x y z"}))], "id string, source string")
    assert [tuple(r) for r in neardup.similar_pairs(df, "id", "source").collect()] == [("a", "b")]


def test_pairs_of_hot_groups_are_whole(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART", 7)
    rows = [("hot", i) for i in range(40)] + [("two", 1), ("two", 2), ("one", 3), ("null", None), ("null", 4)]
    got = [tuple(r) for r in graph.pairs_within(spark.createDataFrame(rows, "g string, i long"), "g", "i").collect()]
    assert sorted(got) == sorted([(i, j) for i in range(40) for j in range(i + 1, 40)] + [(1, 2)])


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (5, 5), (None, 3)]
    got = {r.entity: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {got[i] for i in range(31)} == {0} and got[102] == 100
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_groups_and_links(spark, records):
    rows = {r.id: (r.group_id, r.n_links) for r in neardup.similar_groups(_frame(spark, records), "id", "source").collect()}
    pairs = [(r.id_a, r.id_b) for r in neardup.similar_pairs(_frame(spark, records), "id", "source").collect()]
    links = Counter(x for p in pairs for x in p)
    assert {i: n for i, (_, n) in rows.items()} == dict(links)
    assert all(rows[a][0] == rows[b][0] for a, b in pairs)
    assert neardup.similar_groups(_frame(spark, records).limit(0), "id", "source").count() == 0


def test_records_that_merely_use_the_same_words_stay_in_their_bucket(spark):
    rows = _same_words()
    rows.append(("twin", rows[0][1].replace("w3 ", "")))
    index = incremental.HashIndex(spark, buckets=3)
    batch, _ = index.append(incremental.hashed(spark.createDataFrame(rows, "id string, source string"), "source", "id"))
    met = index.meeting({"bands": index.asked(batch)["bands"]}, {})
    assert 2 <= met.count() <= 60  # of 90,000
    assert index.similar(met).count() == 2


def test_marks_never_hide_a_word_in_common(spark):
    rows = _same_words()[:40]
    rows += [(f"n{i}", r.replace(f"w{i} ", "")) for i, (_, r) in enumerate(rows[:10])]
    held = incremental.hashed(spark.createDataFrame(rows, "id string, source string"), "source", "id").collect()
    bits = lambda values: [v & (2**64 - 1) for v in values]
    apart = 0
    for a in held:
        for b in held:
            own = sum((x & ~y).bit_count() for x, y in zip(bits(a.marks), bits(b.marks), strict=True))
            common = len(set(a.tokens) & set(b.tokens))
            assert common <= a.n_words - own
            apart += a.n_words - own < 0.7 / 1.7 * (a.n_words + b.n_words)
    assert apart > 0.9 * len(held) ** 2 / 2  # and most pairs that only use the same words are told apart
