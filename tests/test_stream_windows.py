"""Windows of a stream against the batch form, slice by slice."""

import datetime as dt
import random

from matchloom.operators import budgets
from matchloom.streaming import twins, windows

SCHEMA = "scope string, at timestamp_ntz"


def test_windows_across_slices(spark, tmp_path):
    rng, at, rows = random.Random(4), dt.datetime(2024, 1, 1), []
    for _ in range(400):
        at += dt.timedelta(milliseconds=rng.choice([0, 5, 900, 4000, 30_000]))
        rows.append((rng.choice(["a", "a", "b", None]), at))
    for i in range(4):
        spark.createDataFrame(rows[i * 100 : i * 100 + 100], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    with windows.provider(spark):
        for _ in range(2):  # the second run finds nothing new
            stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            found = windows.ended_windows(stream, 10)
            out = twins.run_available(found, "append", str(tmp_path / "out"), str(tmp_path / "cursor"))
            got = sorted(map(tuple, twins.results(spark, found.schema, out).collect()))
            every = budgets.in_windows(spark.createDataFrame(rows, SCHEMA), 10).where("scope IS NOT NULL").groupBy("scope", "window_start").count()
            want = sorted(map(tuple, every.collect()))
            last = {s: w for s, w, _ in want}
            assert got == [r for r in want if r[1] != last[r[0]]] and len(got) > 50
