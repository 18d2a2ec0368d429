"""The data source of image batches, the learner on a stream, and the table functions."""

import pickle

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import tables
from mosaiq.operators import learn, morphology, symmetry
from mosaiq.sources import batch_source, images
from mosaiq.streaming import online


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("batches")
    r = np.random.default_rng(1)
    for name, n, key in (("data_batch_1", 50, b"labels"), ("data_batch_2", 7, b"labels"), ("test_batch", 20, b"fine_labels")):
        (path / name).write_bytes(pickle.dumps({b"data": r.integers(0, 256, (n, 3072)).astype(np.uint8), key: [int(x) for x in r.integers(0, 4, n)]}))
    (path / "_hidden").write_bytes(b"no batch")
    return str(path)


def test_data_source(spark, folder):
    batch_source.register(spark)
    reader = lambda: spark.read.format("image_batches").option("bytesPerTask", 30_000)
    got = reader().load(folder)
    want = images.read_batches(spark, f"{folder}/[dt]*")
    assert got.rdd.getNumPartitions() > 3  # several tasks a file
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    few = reader().schema("label int, img_id bigint").load(folder)
    assert sorted(map(tuple, few.collect())) == sorted((r.label, r.img_id) for r in want.collect())
    assert reader().load(f"{folder}/data_batch_2").count() == 7
    with pytest.raises(Exception, match="no column"):
        reader().schema("img_id bigint, width int").load(folder).count()
    with pytest.raises(Exception, match="nothing"):
        reader().load(f"{folder}/nothing").count()


def test_options_choose_before_reading(spark, folder):
    batch_source.register(spark)
    reader = lambda: spark.read.format("image_batches").option("bytesPerTask", 30_000)
    want = images.read_batches(spark, f"{folder}/[dt]*").collect()
    whole, test = reader().load(folder), reader().option("split", "test").option("labels", "1,2").load(folder)
    assert test.rdd.getNumPartitions() < whole.rdd.getNumPartitions()
    assert sorted(r.img_id for r in test.collect()) == sorted(r.img_id for r in want if r.split == "test" and r.label in (1, 2))
    assert reader().option("split", "none").load(folder).count() == 0
    for by in ("split = 'test'", "label = 3", "label < 9"):  # one DataFrame, several filters
        assert whole.where(by).count() == spark.createDataFrame(want).where(by).count()


def test_evil_batches_are_refused(spark, tmp_path):
    class Evil:
        def __reduce__(self):
            return print, ("read",)

    batch_source.register(spark)
    (tmp_path / "data_batch_9").write_bytes(pickle.dumps({b"data": Evil(), b"labels": []}))
    with pytest.raises(Exception, match="not allowed"):
        spark.read.format("image_batches").load(str(tmp_path)).collect()


@pytest.mark.parametrize("shards", [1, 3])
def test_stream_learner_goes_on_after_a_restart(spark, tmp_path, shards):
    """Two runs of a stream, the second from the first one's checkpoint, are as one pass over all rows in order."""
    r = np.random.default_rng(shards)
    x, y = r.integers(-5, 9, (90, 4)), r.integers(0, 3, 90)
    schema = "img_id long, label int, f array<int>"
    part = lambda k: spark.createDataFrame([(i, int(y[i]) if i != 40 else None, [int(v) for v in x[i]]) for i in range(30 * k, 30 * k + 30)], schema).coalesce(1)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        learnt = online.learn_online(stream, 3, 4, shards, margin=20, limit=40)
        keep = lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/out")
        q = learnt.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(keep).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None

    part(0).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    for k in (1, 2):
        part(k).write.mode("append").parquet(f"{tmp_path}/in")
        run()
    rows = spark.range(90).select("id", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("s")).collect()
    total, n = np.zeros((3, 4), np.int64), 0
    for s in range(shards):
        own = [a.id for a in rows if a.s == s and a.id != 40]
        w, more, seen = learn.perceptron_pass([__import__("pandas").DataFrame({"f": [x[i] for i in own], "label": [int(y[i]) for i in own]})], np.zeros((3, 4), np.int64), 1, 40, 20)
        total, n = total + more, n + seen
    got = {a.label: a.w for a in online.latest_weights(spark.read.parquet(f"{tmp_path}/out"), 3).collect()}
    assert n == 89 and got == {c: (total[c] // n).tolist() for c in range(3)}


def test_table_functions(spark):
    tables.register(spark)
    r = np.random.default_rng(2)
    own = spark.createDataFrame([(i, *[r.integers(0, 256, 1024).tolist() for _ in "rgb"], [int(v) for v in r.integers(0, 1 << 32, 32)]) for i in range(3)], "img_id int, r array<int>, g array<int>, b array<int>, m array<bigint>")
    own.createOrReplaceTempView("pictures")
    got = spark.sql("SELECT img_id, o.element, o.r, o.g, o.b FROM pictures p, LATERAL d4_orbit(p.r, p.g, p.b) o")
    want = symmetry.orbit(own).select("img_id", "element", "r", "g", "b")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    for call, rule in (("m, 4", {}), ("m, 4, 3, 4, 2, 4, false", {"birth": (3, 4), "survive": (2, 4), "diagonal": False}), ("m, 4, survive_min => 2, birth_min => 3, birth_max => 3, survive_max => 3", {"birth": (3, 3), "survive": (2, 3)})):
        states = own.select("img_id", *[c.alias(f"s{i + 1}") for i, c in enumerate(morphology.run(F.col("m"), 2, **rule))]).collect()
        rows = {(x.img_id, x.step): x.m for x in spark.sql(f"SELECT img_id, s.step, s.m FROM pictures, LATERAL automaton_states({call}) s").collect()}
        assert len(rows) == 12 and all(rows[s.img_id, k] == s[f"s{k}"] for s in states for k in (1, 2))
    assert spark.sql("SELECT * FROM automaton_states(NULL, 3)").count() == 0


def test_orbit_keeps_other_columns(spark):
    own = spark.createDataFrame([(1, [0] * 1024, [1] * 1024, [2] * 1024, "x", "y")], "img_id int, r array<int>, g array<int>, b array<int>, rg string, gb string")
    assert set(symmetry.orbit(own).columns) == {"img_id", "element", "r", "g", "b", "rg", "gb"}


def test_images_are_drawn_in_small_batches():
    """A batch of 10,000 embeddings is no batch of 10,000 images: 120 MB, and several times that while they are made."""
    n = 1000
    rows = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([1] * n, pa.int32()), pa.array([[0.1] * 64] * n, pa.list_(pa.float32()))], ["vec_id", "label", "embedding"])
    made = list(images.drawn(iter([rows])))
    assert max(b.num_rows for b in made) <= 128 and [i for b in made for i in b.column("img_id").to_pylist()] == list(range(n))
    assert made[-1].column("split").to_pylist()[-1] == "train" and made[0].column("r").to_pylist()[0] == made[0].column("r").to_pylist()[41]
