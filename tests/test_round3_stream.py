"""recent lists over many batches, worked out by grouping and without Python."""

import datetime
import random

from quire.streaming import arrivals


def test_recent_lists_over_many_batches(spark, tmp_path):
    """Late rows, missing pages, entries that fall off, and users who stay away while all lists are written again."""
    dice, at, capacity, known, seq = random.Random(8), datetime.datetime(2024, 1, 1), 2, {}, 0
    schema = "user_id long, location string, opened_at timestamp, seq long, page long"
    opened = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    for batch in range(19):
        rows = []
        for _ in range(8):
            seq += 1
            user = 9 if batch == 0 and seq < 3 else dice.randrange(3)
            rows.append((user, f"l{dice.randrange(4)}", at + datetime.timedelta(minutes=seq - dice.choice([0, 0, 5])), seq, dice.choice([None, None, seq % 7 + 1])))
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in{batch:02d}")
        for row in sorted(rows, key=lambda r: (r[2], r[3])):
            mine = known.setdefault(row[0], {})
            old = mine.get(row[1])
            if old is None or row[2:4] >= old[0:2]:
                mine[row[1]] = (row[2], row[3], row[4] or (old[2] if old else 1))
        for user, mine in known.items():
            known[user] = dict(sorted(mine.items(), key=lambda e: e[1][:2], reverse=True)[:capacity])
        if batch % 9 == 0:  # batches in one go, and a stream taken up again
            query = arrivals.recent_stream(opened(), f"{tmp_path}/out", f"{tmp_path}/state", capacity)
            query.awaitTermination()
            assert not query.lastProgress["stateOperators"]
    found = {(r.user_id, r["rank"]): (r.location, r.seq, r.page) for r in arrivals.recent_so_far(spark, f"{tmp_path}/out").collect()}
    assert found == {(user, i + 1): (loc, *e[1:]) for user, mine in known.items() for i, (loc, e) in enumerate(mine.items())}
    assert 9 in known
