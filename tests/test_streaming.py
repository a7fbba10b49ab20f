"""The stream's counts equal the batch's, in any order of files and over restarts."""

import random

import pytest

from gradeloom.streaming import confusion as S

SCHEMA = "item_id string, ts timestamp, model string, gold string, pred string"
LABELS = ["A", "B"]


def at(hour, minute=0):
    import datetime

    return datetime.datetime(2024, 1, 1, hour, minute)


def files():
    rng = random.Random(1)
    out = []
    for f, hour in enumerate((12, 6, 3)):
        out.append([(f"{f}-{k}", at(hour, k), "m", rng.choice("AB"), rng.choice(["A", "B", "free text"])) for k in range(10)])
    out[0] += [("1-3", at(5), "m", "A", "B"), ("1-4", at(7), "m", "A", "B"), (None, at(1), None, None, "A"), (None, None, "m", "A", None)]
    out[1] += [("0-1", None, "m", "B", "B"), ("x", None, "m2", "B", "B"), ("2-2", at(3, 2), "m", "A", "A")]
    out[2] += [("x", at(23), "m2", "B", "A"), ("x", at(23), "m2", "A", "A"), (None, at(1), None, None, "A")]
    return out


def cells(df):
    return sorted(map(str, map(tuple, df.select("model", "gold", "pred", "n").collect())))


def stream(spark, path):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    return S.stream_confusion(source, ["model"], LABELS)


def batch(spark, parts):
    return cells(S.batch_confusion(spark.createDataFrame([r for p in parts for r in p], SCHEMA), ["model"], LABELS))


def add(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (1, 2, 0)])
def test_any_order_of_batches(spark, tmp_path, order):
    for k in order:
        add(spark, files()[k], f"{tmp_path}/in")
    got = S.run_to_end(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert len(list((tmp_path / "out").glob("batch=*"))) >= 2
    assert cells(got) == batch(spark, files())


def test_late_rows_and_restarts(spark, tmp_path, monkeypatch):
    """Rows hours late count; a batch that fails after its counts were written runs again without counting twice."""
    parts = files()
    add(spark, parts[0], f"{tmp_path}/in")
    run = lambda: S.run_to_end(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert cells(run()) == batch(spark, parts[:1])
    add(spark, parts[1], f"{tmp_path}/in")
    add(spark, parts[2], f"{tmp_path}/in")
    from pyspark.sql.readwriter import DataFrameWriter

    write = DataFrameWriter.parquet

    def broken(self, path, *a, **b):
        write(self, path, *a, **b)
        if path.endswith("batch=1"):
            raise RuntimeError("lost after the write")

    monkeypatch.setattr(DataFrameWriter, "parquet", broken)
    with pytest.raises(Exception, match="lost after the write"):
        run()
    monkeypatch.undo()
    assert cells(run()) == batch(spark, parts)
    assert cells(run()) == batch(spark, parts)


def test_batch_counts_by_hand(spark):
    rows = [("a", at(2), "m", "A", "B"), ("a", at(1), "m", "A", "A"), ("b", None, "m", "A", "A"), (None, None, "m", "A", "junk"), (None, None, "m", "A", "junk")]
    got = S.batch_confusion(spark.createDataFrame(rows, SCHEMA), ["model"], LABELS)
    assert cells(got) == sorted(map(str, [("m", "A", "A", 2), ("m", "A", "__other__", 2)]))
    assert S.batch_confusion(spark.createDataFrame([], SCHEMA), ["model"], LABELS).collect() == []


def test_items_are_settled_by_shares(spark, tmp_path):
    """State and Python calls go by share, not by item; ids of other types and times beyond a double's digits count exactly."""
    from pyspark.sql import functions as F

    late = 253402300799000000 - 10  # the end of year 9999, where doubles are 32 apart
    rows = [(k, late + 5, "m", "A", "AB"[k % 2]) for k in range(3000)]
    again = [(k, late + (4 if k % 3 == 0 else 6), "m", "A", "AB"[k % 5 == 0]) for k in range(0, 3000, 2)] + [(9999, late, "m", "B", "A")] * 50
    for kind, name in ((F.col("n"), "long"), (F.array("n"), "array"), (F.col("n").cast("decimal(20,2)"), "decimal")):
        tables = [spark.createDataFrame(r, "n long, t long, model string, gold string, pred string").select(kind.alias("item_id"), F.timestamp_micros("t").alias("ts"), "model", "gold", "pred").coalesce(1) for r in (rows, again)]
        for t in tables:
            t.write.mode("append").parquet(f"{tmp_path}/{name}/in")
        source = spark.readStream.schema(tables[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in")
        got = S.run_to_end(S.stream_confusion(source, ["model"], LABELS, shares=8), f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/checkpoint")
        assert cells(got) == cells(S.batch_confusion(tables[0].union(tables[1]), ["model"], LABELS))
        assert spark.read.format("statestore").load(f"{tmp_path}/{name}/checkpoint").count() <= 8
