import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from meshwright.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, pos int, digest string, node long"


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(data):
    turns = defaultdict(list)
    for conv, turn, role, text in data:
        if conv is not None:
            turns[conv].append((turn is not None, turn, digest(role, text), role or "", text or ""))
    for x in turns.values():
        x.sort(key=lambda t: (t[0], t[1] or 0, t[2]))
    whole = {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (abs(conv) % 100) * (1 if conv >= 0 else -1)
        whole[conv] = tuple(t[3:] for t in turns.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for conv, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(conv)
    kids = defaultdict(list)
    for key in members:
        if key:
            kids[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in kids[key]) or 1
        saved[key] = sum(saved[k] for k in kids[key]) + ((len(members[key]) - 1) * len(key[-1][1]) if key else 0)
    out = []
    for key, convs in members.items():
        ends = ",".join(map(str, sorted(x for x in convs if len(whole[x]) == len(key))))
        parent = min(members[key[:-1]]) if key else None
        out.append((min(convs), len(key), parent, len(convs), len(kids[key]), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def conversations(seed, n=120):
    rng = random.Random(seed)
    data = []
    for k in range(n):
        conv = rng.choice([k, k * 7, k + 95, -k, 100 * (k % 5), 300 + k])
        if any(r[0] == conv for r in data):
            continue
        for turn in range(rng.choice([0, 1, 2, 3, 4, 7])):
            data.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "bot", None]) if turn else "user", rng.choice(["hi", "ho", "é🙂", "", None])))
    return data


def found(spark, data):
    rows = spark.createDataFrame([(*r, 1, "x", 2) for r in data], SCHEMA).repartition(3)
    return sorted(map(tuple, trie.prefix_trie(rows).collect()), key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    data = conversations(seed)
    data += data[:9] + [(None, 1, "user", "no conversation")]
    assert found(spark, data) == brute(data)


def test_long_conversations_and_copies(spark, monkeypatch):
    monkeypatch.setattr(trie, "FAN", 4)
    monkeypatch.setattr(trie, "IDS_BYTES", 60)
    long = [(t, "user" if t % 2 else "bot", f"turn {t % 3}") for t in range(90)]
    data = [(conv, *t) for conv in (1000, 1017, 1042) for t in long] + [(1055, *t) for t in long[:-1]]
    data += [(5000 + k, t, "user", f"the same {t}") for k in range(40) for t in range(8)]
    assert found(spark, data) == brute(data)


def test_few_conversations(spark):
    assert found(spark, []) == []
    assert found(spark, [(7, 0, "user", "alone")]) == brute([(7, 0, "user", "alone")])
    only = [(c, 0, "user", "x") for c in (200, 203)]
    assert found(spark, only) == brute(only)


def test_sql(spark):
    data = conversations(3)
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", data)
    assert sorted(db.execute(trie.OP12_SQL).fetchall(), key=lambda r: (r[1], r[0])) == brute(data)
