"""Readers that open only what is asked for: headers, row ranges, single batches, new keys of a listing."""

import io
import json
import struct
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidefold.sources import files
from tidefold.streaming import watch


class Counted(io.BytesIO):
    seen = 0

    def read(self, n=-1):
        data = super().read(n)
        self.seen += len(data)
        return data


def wav(frames=1000, rate=8000, channels=2, width=2, before=b""):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(bytes(frames * channels * width))
    data = out.getvalue()
    at = data.index(b"data")
    return b"RIFF" + struct.pack("<I", len(data) + len(before) - 8) + data[8:at] + before + data[at:]


def test_a_header_is_read_alone():
    extra = b"LIST" + struct.pack("<I", 1_000_001) + bytes(1_000_002)  # an odd size is padded
    for content in (wav(), wav(before=extra), wav(5, 44100, 1, 3), wav(7, 8000, 1, 1)):
        f = Counted(content)
        with wave.open(io.BytesIO(content)) as w:
            assert files.wav_header(f) == (w.getframerate(), w.getnframes())
        assert f.seen < 100
    for bad in (b"", b"no", b"RIFF1234WAVE", b"RIFF1234WAVEfmt ", wav()[:30], b"RIFX" + wav()[4:], wav().replace(struct.pack("<H", 1), struct.pack("<H", 3), 1)):
        assert files.wav_header(io.BytesIO(bad)) is None


def test_headers_of_a_folder(spark, tmp_path):
    (tmp_path / "a b.wav").write_bytes(wav(4000, 8000))
    (tmp_path / "c.WAV").write_bytes(wav(0))
    (tmp_path / "d.wav").write_bytes(b"no")
    out = {r["path"].rpartition("/")[2]: tuple(r)[1:] for r in files.read_audio(spark, str(tmp_path)).collect()}
    assert out == {"a b.wav": (0.5, 8000), "c.WAV": (None, None), "d.wav": (None, None)}


def test_a_range_of_rows_opens_only_its_parts(spark, tmp_path):
    spark.dataSource.register(files.NpySource)
    for i in range(3):
        np.save(tmp_path / f"{i}.npy", np.arange(i * 200, i * 200 + 200, dtype=np.float64).reshape(100, 2))
    read = lambda **rows: spark.read.format("npy").options(rowsEach=30, **rows).load(str(tmp_path))
    part = read(firstRow=95, endRow=131)
    assert sorted((r["row_index"], *r["embedding"]) for r in part.collect()) == [(i, 2.0 * i, 2.0 * i + 1) for i in range(95, 131)]
    assert part.rdd.getNumPartitions() == 3  # rows 95 to 99 of the first file, 0 to 30 of the second in two ranges
    assert read(firstRow=299).count() == 1 and read(firstRow=300).count() == 0 and read().count() == 300


def test_arrow_batches_are_dealt_out(spark, tmp_path):
    spark.dataSource.register(files.ArrowSource)
    with pa.OSFile(str(tmp_path / "a.arrow"), "wb") as out, pa.ipc.new_file(out, pa.schema([("x", pa.int64())])) as w:
        for i in range(10):
            w.write_batch(pa.record_batch({"x": pa.array([i, i + 100], pa.int64())}))
    with pa.OSFile(str(tmp_path / "b.arrow"), "wb") as out, pa.ipc.new_stream(out, pa.schema([("x", pa.int64())])) as w:
        w.write_batch(pa.record_batch({"x": pa.array([7], pa.int64())}))
    df = spark.read.format("arrow_files").option("batchesEach", 4).load(str(tmp_path))
    assert sorted(r[0] for r in df.collect()) == sorted([*range(10), *range(100, 110), 7])
    assert df.rdd.getNumPartitions() == 4  # three of the file, one of the stream


def test_new_keys_of_a_listing_come_once(spark, tmp_path):
    spark.dataSource.register(files.ListingSource)
    pages, out, ck = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "ck")
    pages.mkdir()

    def put(name, keys, token=None):
        (pages / name).write_text(json.dumps({"items": [{"name": k, "size": "1"} for k in keys]} | ({"nextPageToken": token} if token else {})))

    def xml(keys):
        (pages / "b-q-xml-0").write_text("<R>" + "".join(f"<Contents><Key>{k}</Key><Size>2</Size></Contents>" for k in keys) + "</R>")

    def run():
        stream = spark.readStream.format("listing").options(bucket="b", prefixes="p,q", pages=str(pages), extensions=".wav").load()
        watch.drain(stream, watch.append_to(out), ck)
        return sorted((r["key"], r["size"]) for r in spark.read.json(f"{out}/batch=*").collect())

    put("b-p-json-0", ["p/", "p/a.wav", "p/b.txt"], "t1")
    put("b-p-json-t1", ["p/c.wav"])
    (pages / "b-q-json-0").write_text("<html>error</html>")
    xml(["q/a.wav"])
    assert run() == [("p/a.wav", 1), ("p/c.wav", 1), ("q/a.wav", 2)]
    assert len(run()) == 3  # nothing new
    put("b-p-json-t1", ["p/c.wav", "p/d.wav"], "t2")
    put("b-p-json-t2", ["p/e.WAV"])
    xml(["q/a.wav", "q/b.wav"])
    (pages / "b-p-json-0").unlink()  # a page before the last one isn't read again by the tasks
    put("b-p-json-0", ["p/a.wav"], "t1")
    assert run() == [("p/a.wav", 1), ("p/c.wav", 1), ("p/d.wav", 1), ("p/e.WAV", 1), ("q/a.wav", 2), ("q/b.wav", 2)]
