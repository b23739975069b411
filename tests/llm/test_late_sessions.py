"""Late session merging against states built anew after each batch."""

import random
import zlib

import pytest
from vecflow.llm import late_sessions

GAP = 420


def by_hand(events):
    out = {}
    for user in {e[0] for e in events}:
        own = sorted((e for e in events if e[0] == user), key=lambda e: e[1])
        standing = []
        for batch in sorted({e[2] for e in own}):
            sessions = []
            for e in own:
                if e[2] > batch:
                    continue
                if sessions and e[1] - sessions[-1][-1][1] <= GAP:
                    sessions[-1].append(e)
                else:
                    sessions.append([e])
            for s in sessions:
                new = sum(e[2] == batch for e in s)
                if new:
                    start, end = s[0][1], s[-1][1]
                    old = [v for v in standing if start <= v[1] <= end]
                    for v in old:
                        out[v][-2:] = [batch, start]
                    standing = [v for v in standing if v not in old] + [(user, start, batch)]
                    out[(user, start, batch)] = [user, batch, start, end, len(s), new, len(old), sum(e[3] for e in s), None, None]
    return sorted(map(tuple, out.values()), key=str)


def found(spark, events, **how):
    df = spark.createDataFrame(events, "user long, second long, batch long, h long")
    return sorted(map(tuple, late_sessions.versions(df, GAP, **how).collect()), key=str)


@pytest.mark.parametrize("how", [{"batches": 1, "fan": 2}, {"batches": 3, "fan": 4}, {}])
def test_blocks_do_not_show(spark, how):
    r = random.Random(5)
    events = []
    for _ in range(700):
        s = r.choice([r.randrange(30_000), r.randrange(400_000)])
        events.append((r.choice([1, 1, 1, 2, 3]), s, s // 3600 + r.choice([0, 0, 0, 1, 2, 3]), r.randrange(1000)))
    events += events[:40]  # rows that repeat
    assert found(spark, events, **how) == by_hand(events)


def test_endless_session_of_one_user(spark):
    """One session over all blocks, times before 0, events up to five batches late."""
    r = random.Random(1)
    events = [(7, 300 * k - 50_000, (300 * k - 50_000) // 3600 + r.choice([0, 0, 1, 5]), 1) for k in range(600)]
    assert found(spark, events, batches=2, fan=3) == by_hand(events)


def test_no_group_grows_with_a_user(spark):
    """100,000 copies of one second are one cell; a long session reaches its blocks as one carried run."""
    df = spark.range(100_000).selectExpr("1L AS user", "id % 50 * 400 AS second", "id % 50 * 400 div 3600 AS batch", "1L AS h")
    rows = late_sessions.versions(df, GAP, batches=1, fan=2).orderBy("batch").collect()
    assert [x.n_events for x in rows] == [2000 * n for n in (9, 18, 27, 36, 45, 50)]
    assert [x.n_retracted for x in rows] == [0, 1, 1, 1, 1, 1] and all(x.start_s == 0 for x in rows)
    assert [x.retracted_batch for x in rows] == [1, 2, 3, 4, 5, None]


def test_odd_rows(spark):
    empty = spark.createDataFrame([], "user long, second long, batch long, h long")
    assert late_sessions.versions(empty).collect() == []
    events = [(None, 1, 1, 1), (1, None, 1, 1), (1, 1, None, 1), (1, 5, 0, None)]
    assert found(spark, events) == [(1, 0, 5, 5, 1, 1, 0, 0, None, None)]
    with pytest.raises(ValueError):
        late_sessions.versions(empty, gap=90_000)


def test_events_of_conversations(spark):
    rows = [(17, 3, None), (None, 1, "x"), (5, None, "x"), (-9, 0, "")]
    got = late_sessions.events_of(spark.createDataFrame(rows, "conv_id long, turn int, text string").selectExpr("*", "1 AS user", "2 AS batch")).collect()
    want = []
    for conv, turn in ((17, 3), (-9, 0)):
        c, h = zlib.crc32(str(conv).encode()), zlib.crc32(f"{conv}:{turn}".encode())
        s = c // 2 % 7200 + 300 * turn + h % 600
        want.append((2 * (conv // 8) + c % 2, s, s // 3600 + (h // 600 % 4 if h // 600 % 3 == 0 else 0), h))
    assert sorted(map(tuple, got)) == sorted(want)
