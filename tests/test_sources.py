"""Files, sockets, standard input and sinks."""

from __future__ import annotations

import io
import socket
import threading

import pytest
from pyspark.sql import functions as F

from weirflow.operators import Filter, FlatMap, Map, PyMap, Python, ReduceByKey, kv
from weirflow.plans.pipe import Frame, Pipe, PipeError
from weirflow.sources import Drain, ReadFromFile, ReadFromHDFS, ReadFromSocket, ReadFromStdIn, ReadStream, ReadTable, WriteTable, WriteToDisk, WriteToFile, WriteToStdOut, frames, spooled


def lines(df):
    return sorted(r.value for r in df.collect())


@pytest.mark.parametrize("text,want", [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\nb", ["", "a", "b"]), ("\n", [""]), ("a\r\nb\n", ["a\r", "b"]), ("é\n", ["é"])])
def test_read_from_file(spark, tmp_path, text, want):
    (tmp_path / "in.txt").write_bytes(text.encode())
    for source in (ReadFromFile, ReadFromHDFS):
        assert lines(Pipe(source(f"file://{tmp_path}/in.txt")).compile(spark)) == want
    assert lines(Pipe(ReadFromFile(str(tmp_path / "in.txt"), partitions=3)).compile(spark)) == want


def test_write_and_read_again(spark, tmp_path):
    (tmp_path / "in.txt").write_text("b\n\na b \nb\n")
    out = str(tmp_path / "out")
    for _ in range(2):  # what was there is replaced
        Pipe(ReadFromFile(str(tmp_path / "in.txt"))).add(WriteToDisk(out)).run(spark)
    assert lines(Pipe(ReadFromFile(out)).compile(spark)) == ["", "a b ", "b", "b"]


def test_formatter(spark, tmp_path):
    p = Pipe(Frame(spark.createDataFrame([("a", 1), (None, 2)], "key string, val long")))
    p.add(WriteToFile(str(tmp_path / "plain"))).run(spark)
    assert sorted((tmp_path / "plain").read_text().splitlines()) == ["", "<a, 1>"]
    p.add(WriteToDisk(str(tmp_path / "own"), lambda r: F.concat_ws("=", r.key, r.val), files=1)).run(spark)
    assert lines(Pipe(ReadFromFile(str(tmp_path / "own"))).compile(spark)) == ["2", "a=1"]


def test_tables(spark, tmp_path, sf):
    Pipe(ReadTable(f"{sf}/nation.parquet", ("n_name",))).add(WriteTable(str(tmp_path / "t"))).run(spark)
    assert Pipe(ReadTable(str(tmp_path / "t"))).compile(spark).count() == 25


@pytest.mark.parametrize("chunks,tail,want", [([b"a;b;"], False, [b"a", b"b"]), ([b"a", b";b"], False, [b"a"]), ([b"a", b";b"], True, [b"a", b"b"]), ([b";;"], True, [b"", b""]), ([], True, []), ([b"a;"], True, [b"a"])])
def test_frames(chunks, tail, want):
    assert list(frames(chunks, b";", tail)) == want


def test_a_delimiter_is_one_byte():
    with pytest.raises(ValueError):
        list(frames([b"x"], b"ab"))


def server(data: bytes) -> int:
    s = socket.create_server(("127.0.0.1", 0))

    def serve():
        c, _ = s.accept()
        for k in range(0, len(data), 7):
            c.sendall(data[k : k + 7])
        c.close()
        s.close()

    threading.Thread(target=serve, daemon=True).start()
    return s.getsockname()[1]


PAIRS = [("ab"[i % 3 == 0], i - 5) for i in range(11)]
TEXT = "".join(f"<{k}, {v}>;" for k, v in PAIRS).encode()


def parsed() -> Map:
    from weirflow.functions.kernels import kv_key, kv_val

    return Map(lambda r: [*kv(kv_key(r.value), kv_val(r.value)), r.seq])


def test_socket_to_windows(spark):
    p = Pipe(ReadFromSocket("127.0.0.1", server(TEXT + b"<a, 99>"), b";")).add(parsed()).add(ReduceByKey("sum").window(2)).add(Drain())
    got = [(r.key, r.val) for r in p.run(spark).result.collect()]
    want = []
    for key in "ab":
        vals = [v for k, v in PAIRS if k == key]
        want += [(key, sum(vals[i : i + 2])) for i in range(0, len(vals), 2)]
    assert sorted(got) == sorted(want)  # the tail that nothing ends is dropped


def test_stdin_to_stdout(spark, capsys):
    p = Pipe(ReadFromStdIn(b"\n", file=io.BytesIO(b"b\n\na\nlast"))).add(WriteToStdOut(lambda r: r.value))
    capsys.readouterr()
    assert p.run(spark).result == 4
    assert capsys.readouterr().out.splitlines() == ["b", "", "a", "last"]


def test_stream_operators(spark):
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(PAIRS)], "key string, val long, seq long")
    stream = Pipe(ReadStream(spooled(df, "seq", 3), "key string, val long, seq long"))
    kept = stream.add(Filter(lambda r: r.val > 0)).add(Map(lambda r: kv(r.key, r.val + 1))).add(Drain()).run(spark).result
    assert sorted((r.key, r.val) for r in kept.collect()) == sorted((k, v + 1) for k, v in PAIRS if v > 0)


def test_stream_windows_follow_the_order(spark):
    df = spark.createDataFrame([("a", v, i) for i, v in enumerate(range(1, 10))], "key string, val long, seq long")
    stream = Pipe(ReadStream(spooled(df, "seq", 3), "key string, val long, seq long"))
    out = stream.add(ReduceByKey(Python(lambda a, b: a * 10 + b)).window(4)).add(Drain()).run(spark).result
    assert sorted(r.val for r in out.collect()) == [9, 1234, 5678]


@pytest.mark.parametrize("kernel", ["sum", "max", Python(lambda a, b: (a or 0) + 3 * (b or 0))])
def test_null_values_count_in_windows_as_on_bags(spark, rows, kernel):
    values = [None, 1, 2, None, None, None, 2**60 + 1, None, None, 5, None]
    df = spark.createDataFrame([("ab"[i >= 8], v, i) for i, v in enumerate(values)], "key string, val long, seq long")
    stream = Pipe(ReadStream(spooled(df, "seq", 3), "key string, val long, seq long"))
    for size in (2, 3):
        out = stream.add(ReduceByKey(kernel).window(size)).add(Drain()).run(spark).result
        assert rows(out) == rows(ReduceByKey(kernel).window(size).apply(df))


def test_an_empty_stream(spark):
    p = Pipe(ReadFromStdIn(file=io.BytesIO(b""))).add(Map(lambda r: [*kv(r.value, F.lit(1).cast("bigint")), r.seq])).add(ReduceByKey("sum").window(2)).add(Drain())
    assert p.run(spark).result.count() == 0


def test_a_kernel_that_streams_lack(spark):
    df = spark.createDataFrame([("a", 1, 0)], "key string, val long, seq long")
    with pytest.raises(PipeError):
        Pipe(ReadStream(spooled(df, "seq"), "key string, val long, seq long")).add(ReduceByKey("count").window(2)).compile(spark)


NUMBERS = "key string, val long, seq long"


def streamed_and_bag(spark):
    values = [None, 1, 2, 4, None, 7, -3, 8, 11, None, 5]
    df = spark.createDataFrame([("ab"[i >= 7], v, i) for i, v in enumerate(values)], NUMBERS)
    return Pipe(ReadStream(spooled(df, "seq", 3), NUMBERS)), Pipe(Frame(df))


AFTER = {
    "map": lambda p: p.add(Map(lambda r: kv(r.key, r.val * 100))),
    "other columns": lambda p: p.add(Map(lambda r: {"text": F.concat(r.key, r.val.cast("string"))})),
    "filter": lambda p: p.add(Filter(lambda r: r.val > 5)),
    "flat map": lambda p: p.add(FlatMap(lambda r: F.array(r.val, r.val + 1))),
    "branches": lambda p: p.to(Pipe(Map(lambda r: kv(r.key, -r.val))), Pipe(Filter(lambda r: r.val < 5)).add(Map(lambda r: kv(r.key, r.val)))),
    "python": lambda p: p.add(PyMap(lambda x: {"key": x["key"], "val": 1 if x["val"] is None else x["val"]}, "key string, val long")),
}


@pytest.mark.parametrize("after", AFTER)
def test_open_windows_go_through_what_follows(spark, rows, after):
    stream, bag = streamed_and_bag(spark)
    windowed = lambda p: AFTER[after](p.add(ReduceByKey("sum").window(2)))
    assert rows(windowed(stream).add(Drain()).run(spark).result) == rows(windowed(bag).compile(spark))


@pytest.mark.parametrize("size", [1, 3, 50])
def test_windows_of_expressions_and_lists(spark, rows, size):
    stream, bag = streamed_and_bag(spark)
    expression = lambda p: p.add(ReduceByKey(lambda a, b: F.coalesce(a, F.lit(1)) * 3 + F.coalesce(b, F.lit(0))).window(size))
    lists = lambda p: p.add(Map(lambda r: [*kv(r.key, F.array(r.val, r.seq)), r.seq])).add(ReduceByKey("concat").window(size))
    for p in (expression, lists):
        assert rows(p(stream).add(Drain()).run(spark).result) == rows(p(bag).compile(spark))


def test_one_window_in_a_stream(spark):
    stream, _ = streamed_and_bag(spark)
    two = stream.add(ReduceByKey("sum").window(2)).add(Map(lambda r: [*kv(r.key, r.val), r.val.alias("seq")])).add(ReduceByKey("max").window(2))
    with pytest.raises(PipeError):
        two.compile(spark)
    with pytest.raises(PipeError):
        stream.add(ReduceByKey("sum").window(2)).merge(stream.add(ReduceByKey("sum").window(3))).add(Drain()).run(spark)


def test_a_socket_is_read_while_it_sends(spark):
    """The server goes on only after the first record came out of the stream."""
    s, seen, out = socket.create_server(("127.0.0.1", 0)), threading.Event(), []

    def serve():
        c, _ = s.accept()
        c.sendall(b"first\nsec")
        out.append(seen.wait(60))
        c.sendall(b"ond\ntail")
        c.close()
        s.close()

    threading.Thread(target=serve, daemon=True).start()
    from weirflow.streaming.run import drained

    got = []

    def each(part, _):
        got.extend((r.seq, r.value) for r in part.collect())
        if got:
            seen.set()

    drained(Pipe(ReadFromSocket("127.0.0.1", s.getsockname()[1])).compile(spark), each)
    assert out == [True] and sorted(got) == [(0, "first"), (1, "second")]


def test_a_feed_that_fails_fails_the_run(spark):
    class Broken(io.BytesIO):
        def read1(self, n=-1):
            raise OSError("gone")

    with pytest.raises(OSError, match="gone"):
        Pipe(ReadFromStdIn(file=Broken())).add(Drain()).run(spark)
