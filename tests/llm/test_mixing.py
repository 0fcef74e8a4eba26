"""Mixing against a brute-force fair queue, with ids that several sources share, rows without id and repeated rows."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import pytest

from nutrilake.llm import mixing

DOCS = "doc_id long, source string, text string"


def text(i, n):
    return " ".join(f"w{i}" for _ in range(n))


MIRRORED = [(i, s, text(i, 10)) for i in range(20) for s in "abc"]
NO_ID = [(None, s, text(i, 10)) for i in range(20) for s in "ab"]
REPEATED = [(i // 3, s, text(i // 3, 5 + i // 3 % 4)) for i in range(60) for s in ("a", None)] + [(7, "b", ""), (7, "b", None), (None, "b", None)]
UNEVEN = MIRRORED + NO_ID + [(100 + i, "d", text(i, 40)) for i in range(30)] + [(5, "e", text(5, 1))]


def brute_force(rows):
    """(doc_id, source, size, taken) of every row, by one queue a source and one global order."""
    sized = [(i, s, len((t or "").split(" ")) if t else 0, hashlib.md5(":".join(["mix", *([str(i)] if i is not None else [hashlib.md5(t.encode()).hexdigest()] if t is not None else [])]).encode()).hexdigest())
             for i, s, t in rows]
    source_size = Counter()
    for _, s, n, _ in sized:
        source_size[s] += n
    names = sorted(source_size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    budget, full = sum(source_size.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = budget - sum(3 * source_size[s] for s in full)
        target = {s: 3.0 * source_size[s] if s in full else left * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if target[s] > 3 * source_size[s]}
        if not over:
            break
        full |= over
    queue = defaultdict(list)
    for i, s, n, key in sized:
        queue[s].append((key, -1 if i is None else i, n))
    line = []
    for s in names:
        upto = 0
        for at, (key, i, n) in enumerate(sorted(queue[s])):
            upto += n
            line += [((upto + c * source_size[s]) / target[s], s is not None, s or "", key, i, c, s, at, n) for c in range(3) if n]
    used, taken = 0, Counter()
    for entry in sorted(line, key=lambda e: e[:6]):
        used += entry[8]
        if used > budget:
            break
        taken[entry[6], entry[4], entry[8]] += entry[8]
    return taken, source_size, target


@pytest.mark.parametrize("rows", [MIRRORED, NO_ID, REPEATED, UNEVEN], ids=["mirrored", "no id", "repeated", "uneven"])
def test_mix_equals_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    mix = mixing.fair_mix(docs).collect()
    taken, source_size, target = brute_force(rows)
    got, by_source = Counter(), Counter()
    for r in mix:
        assert r.copies <= 3 and r.taken == r.copies * r.size and r.target == pytest.approx(target[r.source]) and r.source_size == source_size[r.source]
        got[r.source, -1 if r.doc_id is None else r.doc_id, r.size] += r.taken
        by_source[r.source] += r.taken
    assert len(mix) == len(rows) and {k: v for k, v in got.items() if v} == taken
    longest = max(r.size for r in mix)
    assert all(abs(by_source[s] - target[s]) <= 2 * longest for s in target)
    out = mixing.mixed(docs).collect()
    assert Counter((r.source, r.doc_id, r.text) for r in out).total() == sum(r.copies for r in mix)
    assert max(Counter((r.source, r.doc_id, r.text) for r in out).values()) <= 3 * max(Counter(rows).values())


@pytest.mark.parametrize("rows", [MIRRORED, NO_ID, REPEATED, UNEVEN], ids=["mirrored", "no id", "repeated", "uneven"])
def test_sql_equals_brute_force(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    got = con.execute(mixing.ORACLE_SQL).fetchall()
    taken, _, _ = brute_force(rows)
    assert len(got) == len(rows) and sum(r[4] for r in got) == taken.total()
    assert Counter(r[4] // r[1] for r in got if r[1]).keys() <= {0, 1, 2, 3}
