import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderpatch.plans.dataset import build_datasets, cached, input_bands, load_patches
from cinderpatch.sources.schema import parse_schema, patch_struct, read_schema, write_schema
from cinderpatch.plans.landing import framed, write_tfrecords
from cinderpatch.sources import records as formats
from cinderpatch.sources import stream, tfrecord
from cinderpatch.sources.records import PIECE, frames, inflated, masked_crc
from cinderpatch.sources.tfrecord import index_tfrecords, read_tfrecords

from . import records

SIZE = 4
FEATURES = [("id", "BYTES"), ("lat", "FLOAT"), ("lon", "FLOAT"), ("year", "INT"), ("A00", "FLOAT"), ("BurnDate", "FLOAT"), ("odd", "STRUCT")]


def row(i, **more):
    band = (np.arange(16) + i).astype("f4")
    return {"id": f"p{i}", "lat": -3.5, "lon": float(i), "year": -2024, "A00": band, "BurnDate": band - i - 8, "odd": 1.5} | more


@pytest.fixture
def data(tmp_path):
    records.write_schema(tmp_path, FEATURES)
    records.write(tmp_path / "training-0.tfrecord.gz", [row(0), row(1)])
    records.write(tmp_path / "training-1.tfrecord.gz", [row(2)], packed=False)
    records.write(tmp_path / "validation-0.tfrecord.gz", [row(3)])
    return tmp_path


def struct_of(data, spark):
    return patch_struct(read_schema(spark, str(data)))


def test_crc_of_known_values():
    def plain(data):
        rotated = (masked_crc(data) - 0xA282EAD8) & 0xFFFFFFFF
        return (rotated >> 17 | rotated << 15) & 0xFFFFFFFF

    assert plain(b"123456789") == 0xE3069283  # the polynomial's published check value
    assert plain(bytes(32)) == 0x8A9136AA


def test_schema_types_and_order(spark, data):
    s = struct_of(data, spark)
    assert s.fieldNames() == [n for n, _ in FEATURES]
    assert s["id"].dataType == T.StringType() and s["year"].dataType == T.LongType()
    assert s["lat"].dataType == T.FloatType() and s["odd"].dataType == T.FloatType()
    assert s["A00"].dataType == T.ArrayType(T.FloatType())
    assert input_bands(["id", "lat", "lon", "A00", "A01", "BurnDate"], ["BurnDate"]) == ["A00", "A01"]


def test_schema_skips_nested_names():
    text = 'feature { name: "a" type: FLOAT shape { dim { name: "b" size: 1 } } } feature { type: INT name: "c" }'
    assert parse_schema(text) == [("a", "FLOAT"), ("c", "INT")]


def test_missing_schema_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        read_schema(spark, str(tmp_path))


def test_round_trip_with_split(spark, data):
    df = read_tfrecords(spark, f"{data}/*.tfrecord.gz", struct_of(data, spark), SIZE)
    got = {r["id"]: r for r in df.collect()}
    assert sorted(got) == ["p0", "p1", "p2", "p3"]
    assert [got[f"p{i}"]["split"] for i in range(4)] == ["training"] * 3 + ["validation"]
    assert got["p2"]["A00"] == [float(v) for v in range(2, 18)] and got["p1"]["year"] == -2024 and got["p1"]["lat"] == -3.5


def test_wanted_columns_only(spark, data):
    df = read_tfrecords(spark, f"{data}/*.gz", struct_of(data, spark), SIZE, columns=["id"])
    assert df.columns == ["id", "split"] and df.count() == 4


def test_plain_files(spark, tmp_path):
    records.write_schema(tmp_path, FEATURES)
    records.write(tmp_path / "x.tfrecord", [row(5)], compress=False)
    schema = struct_of(tmp_path, spark)
    assert read_tfrecords(spark, f"{tmp_path}/*.tfrecord", schema, SIZE, compression=None, check_data=True).first()["split"] is None
    with pytest.raises(Exception, match="incorrect header"):
        read_tfrecords(spark, f"{tmp_path}/*.tfrecord", schema, SIZE).collect()
    with pytest.raises(ValueError, match="unknown compression"):
        read_tfrecords(spark, f"{tmp_path}/*", schema, SIZE, compression="ZIP")


def test_empty_glob_is_an_error(spark, data):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_tfrecords(spark, f"{data}/none-*.gz", struct_of(data, spark), SIZE)


@pytest.mark.parametrize("bad, says", [({"A00": np.zeros(3)}, "3 values"), ({"A00": None}, "missing")])
def test_bad_features_are_errors(spark, data, bad, says):
    values = {k: v for k, v in row(9, **bad).items() if v is not None}
    records.write(data / "training-9.tfrecord.gz", [values])
    with pytest.raises(Exception, match=says):
        read_tfrecords(spark, f"{data}/training-9*", struct_of(data, spark), SIZE).collect()


def test_corrupt_files_are_errors(spark, data):
    schema = struct_of(data, spark)
    whole = gzip.decompress((data / "validation-0.tfrecord.gz").read_bytes())
    cases = {
        "length": (gzip.compress(b"\x01" + whole[1:]), "corrupt"),
        "short": (gzip.compress(whole[:-3]), "truncated"),
        "gz": ((data / "validation-0.tfrecord.gz").read_bytes()[:-9], "truncated"),
    }
    for name, (content, says) in cases.items():
        (data / f"bad-{name}").write_bytes(content)
        with pytest.raises(Exception, match=says):
            read_tfrecords(spark, f"{data}/bad-{name}", schema, SIZE).collect()
    flipped = bytearray(whole)
    flipped[40] ^= 1
    (data / "bad-data").write_bytes(gzip.compress(bytes(flipped)))
    with pytest.raises(Exception, match="corrupt record"):
        read_tfrecords(spark, f"{data}/bad-data", schema, SIZE, check_data=True).collect()


def test_datasets_and_cache(spark, data, tmp_path):
    train, validation = build_datasets(spark, str(data), pattern="*.tfrecord.gz", size=SIZE)
    assert train.count() == 3 and validation.count() == 1
    first = validation.first()
    assert first["label"] == [False] * 9 + [True] * 7 and first["inputs"]["A00"][0] == 3.0
    landed = cached(load_patches(spark, str(data), "*.tfrecord.gz", size=SIZE), str(tmp_path / "landed"))
    assert landed.where("split = 'validation'").count() == 1
    assert cached(train, True).is_cached


@pytest.mark.parametrize("partitions", [None, 3])
def test_written_records_read_back(spark, tmp_path, partitions):
    rows = [row(i) for i in range(40)]
    df = spark.createDataFrame(
        [(r["id"], r["lat"], r["lon"], r["year"], r["A00"].tolist(), r["BurnDate"].tolist(), r["odd"]) for r in rows],
        "id string, lat float, lon float, year bigint, A00 array<float>, BurnDate array<float>, odd float",
    )
    write_schema(spark, str(tmp_path), FEATURES)
    write_tfrecords(df.where("year < 0").repartition(3), f"{tmp_path}/training-a.tfrecord.gz")
    schema = struct_of(tmp_path, spark)
    assert schema.fieldNames() == [n for n, _ in FEATURES]
    back = read_tfrecords(spark, f"{tmp_path}/*.gz", schema, SIZE, check_data=True, partitions=partitions)
    assert {r["split"] for r in back.collect()} == {"training"}
    assert sorted(back.select(*df.columns).collect()) == sorted(df.collect())
    with pytest.raises(Exception, match="a feature is null"):
        write_tfrecords(df.withColumn("odd", F.lit(None).cast("float")), f"{tmp_path}/x.gz")


def test_large_files_are_inflated_in_pieces():
    """Memory does not grow with the inflated file: only a record and a few pieces are held."""
    import tracemalloc

    record = bytes(1000) * 1000
    packed = b"".join(gzip.compress(framed(record) * 20) for _ in range(5))
    tracemalloc.start()
    found = [len(x) for x in frames(inflated(packed[at : at + PIECE] for at in range(0, len(packed), PIECE)))]
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert found == [len(record)] * 100 and peak < 5 * len(record) + 5 * PIECE


def test_position_and_other_key_stay(spark, data):
    frame = load_patches(spark, str(data), "*.tfrecord.gz", size=SIZE, key="year", keep=("id", "lat"), non_img_features=("lat", "lon", "id"))
    assert frame.columns == ["year", "id", "lat", "split", "inputs", "label"] and frame.first()["lat"] == -3.5


@pytest.mark.parametrize("n", [0, 9 * formats.LANES - 1, 9 * formats.LANES, 40 * formats.LANES + 77])
def test_checksums_in_array_steps_equal_those_by_byte(n):
    data, crc = np.random.default_rng(n).bytes(n), 0xFFFFFFFF
    for byte in data:
        crc = formats._CRC[(crc ^ byte) & 255] ^ crc >> 8
    assert formats._crc(data) == crc ^ 0xFFFFFFFF


@pytest.mark.parametrize("cut", [1, 7, 1 << 20])
def test_members_are_inflated_whatever_the_pieces(monkeypatch, cut):
    monkeypatch.setattr(formats, "PIECE", 50)
    parts = [bytes(range(200)) * 3, b"", b"x" * 50, b"y" * 101]
    packed = b"\0".join(gzip.compress(p) for p in parts) + b"\0\0"
    assert b"".join(inflated(packed[at : at + cut] for at in range(0, len(packed), cut))) == b"".join(parts)
    with pytest.raises(ValueError, match="truncated"):
        list(inflated(iter([packed[:-12]])))


def test_data_source_by_itself(spark, data):
    """A path, folder or glob; records as they are, or the wanted features; one partition per file."""
    spark.dataSource.register(stream.RecordSource)
    raw = spark.read.format("tfrecord").load(f"{data}/*.tfrecord.gz")
    assert raw.columns == ["path", "record"] and raw.count() == 4 and raw.rdd.getNumPartitions() == 3
    wanted = spark.read.format("tfrecord").schema("lon float, id string, path string").option("size", SIZE).load(f"{data}/training-*.gz")
    assert sorted(r["id"] for r in wanted.collect()) == ["p0", "p1", "p2"] and wanted.first()["path"].endswith("training-0.tfrecord.gz")
    for none in ("nothing-*", "nowhere/x"):
        with pytest.raises(Exception, match="no record files"):
            spark.read.format("tfrecord").load(f"{data}/{none}").collect()
    (data / "folder.gz").mkdir()
    records.write(data / "folder.gz" / "part-0", [row(7)])
    (data / "folder.gz" / "_SUCCESS").write_text("")
    assert stream.found_files(f"{data}/fold*.gz") == [f"file:{data}/folder.gz/part-0"] == stream.found_files(f"{data}/folder.gz")
    with pytest.raises(ValueError, match="no streaming"):
        stream.file_system("viewfs://store/x")


def test_stores_that_arrow_does_not_know_are_read_whole(spark, data, monkeypatch):
    schema = struct_of(data, spark)
    streamed = sorted(map(repr, read_tfrecords(spark, f"{data}/*.gz", schema, SIZE).collect()))
    monkeypatch.setattr(tfrecord, "_streams", lambda paths: False)
    for partitions in (None, 2):
        assert sorted(map(repr, read_tfrecords(spark, f"{data}/*.gz", schema, SIZE, partitions=partitions).collect())) == streamed


def test_a_plain_file_is_cut_by_its_index(spark, data):
    records.write(data / "plain.tfrecord", [row(i) for i in range(400)], compress=False)
    schema, pattern = struct_of(data, spark), f"{data}/plain.tfrecord"
    index = index_tfrecords(spark, pattern)
    assert index.count() == 400 and index.agg(F.sum("record_bytes")).first()[0] == (data / "plain.tfrecord").stat().st_size
    index.write.parquet(f"{data}/index")
    index, whole = spark.read.parquet(f"{data}/index"), read_tfrecords(spark, pattern, schema, SIZE, compression=None)
    cut = read_tfrecords(spark, pattern, schema, SIZE, compression=None, index=index, split_bytes=(data / "plain.tfrecord").stat().st_size // 8 + 1)
    assert cut.rdd.getNumPartitions() == 8 and whole.rdd.getNumPartitions() == 1
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, whole.collect()))
    wrong = {
        "does not cover": [index.where("offset > 0"), index.where("offset < 9000"), index.where("offset not between 5000 and 60000")],
        "corrupt or truncated record length": [index.withColumn("offset", F.when(F.col("offset") > 30000, F.col("offset") + 8).otherwise(F.col("offset"))).withColumn("record_bytes", F.lit(10**6))],
    }
    for says, bad in wrong.items():
        for b in bad:
            with pytest.raises(Exception, match=says if says != "corrupt or truncated record length" else "does not cover|corrupt"):
                read_tfrecords(spark, pattern, schema, SIZE, compression=None, index=b, split_bytes=20_000).collect()
    # one that covers the file but begins a range inside a record
    shifted = spark.createDataFrame([(r["path"], r["file_bytes"], r["offset"] + 4 * (r["offset"] > 0), r["record_bytes"] + (4 if r["offset"] == 0 else -4 * (r["offset"] + r["record_bytes"] == r["file_bytes"]))) for r in index.collect()], index.schema)
    with pytest.raises(Exception, match="corrupt or truncated"):
        read_tfrecords(spark, pattern, schema, SIZE, compression=None, index=shifted, split_bytes=20_000).collect()
    with pytest.raises(ValueError, match="cannot be cut"):
        read_tfrecords(spark, pattern, schema, SIZE, index=index)
    (data / "short.tfrecord").write_bytes((data / "plain.tfrecord").read_bytes()[:-3])
    with pytest.raises(Exception, match="truncated record"):
        index_tfrecords(spark, f"{data}/short.tfrecord").collect()


def test_a_task_holds_a_few_records_of_a_large_file(tmp_path):
    """256 MB in one file: what Python holds at once does not grow with the file."""
    import tracemalloc

    record, path = bytes(1 << 20), tmp_path / "large"
    head = framed(record)
    with path.open("wb") as out:
        for _ in range(256):
            out.write(head)
    reader = stream.RecordReader(stream.RECORDS, {"compression": "NONE"})
    tracemalloc.start()
    n = sum(batch.num_rows for batch in reader.read(stream.FileRange(f"file:{path}")))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert n == 256 and peak < 40 << 20


def test_a_cache_path_is_used_again_until_something_changes(spark, data, tmp_path, monkeypatch):
    from cinderpatch.plans import dataset

    reads, read = [], dataset.read_tfrecords
    monkeypatch.setattr(dataset, "read_tfrecords", lambda *a, **k: reads.append(a[1]) or read(*a, **k))
    load = lambda **more: load_patches(spark, str(data), "*.tfrecord.gz", size=SIZE, cache=str(tmp_path / "c"), **more)
    want = sorted(map(repr, load().collect()))
    again = load()
    assert sorted(map(repr, again.collect())) == want and len(reads) == 1
    assert not [f for f in again.inputFiles() if "tfrecord" in f]
    load(keep=("lat",))
    load(split="training")
    assert len(reads) == 3 and load(split="training").count() == 3 and len(reads) == 3
    records.write(data / "training-5.tfrecord.gz", [row(8)])
    assert load().count() == 5 and len(reads) == 4
    # a manifest without its line, as a stopped writer leaves it, does not count
    mark = dataset.fingerprint(spark, f"{data}/*.gz", x=1)
    (tmp_path / "c" / f"manifest-{mark}").mkdir()
    made = dataset.reused(spark, str(tmp_path / "c"), mark, lambda: spark.range(3))
    assert made.count() == 3 and dataset.reused(spark, str(tmp_path / "c"), mark, lambda: 1 / 0).count() == 3
