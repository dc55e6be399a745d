"""Files read block by block against the same files read whole."""

import json
import random

import pytest

from lexlake.sources import files, splits


@pytest.fixture(params=["600", "134217728"])
def blocks(spark, request):
    """Blocks of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], request.param)
    spark.conf.set(names[1], "1")
    yield int(request.param)
    for n, v in before.items():
        spark.conf.set(n, v)


def cell(rng):
    return "".join(rng.choice(['"', "\n", "\r\n", ",", "a", "é", "b c", "日"]) for _ in range(rng.randrange(12)))


def test_delimited_equals_the_whole_file_reader(spark, tmp_path, blocks):
    rng = random.Random(blocks)
    schema = "id int, name string, note string"
    for n in range(3):
        lines = ["name,id,note"]
        for k in range(60):
            name, note = ('"' + cell(rng).replace('"', '""') + 'x"' for _ in range(2))
            stray = rng.choice(["plain", 'inch 5" wide', "", '"quoted"', '"two\nlines"', f'"{"long " * rng.randrange(90)}\n"'])
            lines.append(f"{name},{n * 100 + k},{rng.choice([stray, note])}")
        (tmp_path / f"t{n}.csv").write_bytes(("\n".join(lines) + rng.choice(["", "\n", "\n\n"])).encode())
    want = files.by_header(spark.read.options(**files._CSV, sep=","), str(tmp_path), schema)
    got = files.read_delimited(spark, str(tmp_path), schema, sep=",")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    if blocks == 600:
        assert splits.blocks_of(spark, str(tmp_path / "t0.csv"), "\n").rdd.getNumPartitions() > 4


def test_line_ends_and_quotes_that_open_nothing(spark, tmp_path, blocks):
    (tmp_path / "t.tsv").write_bytes(b'id\tnote\r\n1\ta "b\r\n2\t"c\r\nd"\r\n\r\n3\t"e""\n""f"\r\n4\tg')
    rows = files.read_delimited(spark, str(tmp_path / "t.tsv"), "id int, note string").collect()
    assert sorted(map(tuple, rows)) == [(1, 'a "b'), (2, "c\r\nd"), (3, 'e"\n"f'), (4, "g")]


def test_states_of_a_line():
    for line, sep, ends in (
        ("a,b", ",", (False, True)), ('a,"b', ",", (True, False)), ('a,b"', ",", (False, False)), ('"a""', ",", (True, False)),
        ('"a"",""b"', ",", (False, False)), ('x"y', ",", (False, False)), ('""', ",", (False, True)),
    ):
        assert tuple(splits.ends_inside(line, s, sep) for s in (False, True)) == ends, line


TEXTS = ['a "b" {c} [d]', "\\", '\\"', "}{", "é日", "", "line\nbreak", "data", '{"data": [{"id": 9}]}', "]" * 40]


def documents(rng, n):
    rows = []
    for k in range(n):
        rows.append({"id": k, "text": rng.choice(TEXTS) * rng.randrange(4), "more": {"x": [rng.choice(TEXTS)] * rng.randrange(3)}})
    return rows


SCHEMA = "id long, text string, more struct<x array<string>>"


def envelope(spark, path):
    from pyspark.sql import types as T

    got = files.read_envelope(spark, path, T.StructType.fromDDL(SCHEMA))
    return sorted((r["id"], r["text"], tuple(r["more"]["x"])) for r in got.collect())


def plain(rows):
    return sorted((r["id"], r["text"], tuple(r["more"]["x"])) for r in rows)


@pytest.mark.parametrize("indent", [None, 2])
def test_documents_over_lines(spark, tmp_path, blocks, indent):
    rng = random.Random(blocks + (indent or 0))
    rows = documents(rng, 80)
    meta = {"title": 'odd "x" ]}', "list": [{"id": 1}, {"data": [{"id": 2}]}], "data": {"id": {"id": 3}}}
    doc = {"metadata": meta, "data": rows[:50], "tail": [{"id": 4}]}
    text = json.dumps(doc, indent=indent, ensure_ascii=False)
    (tmp_path / "d.json").write_text("\n" + text + "\n" if indent is not None else text)
    assert envelope(spark, str(tmp_path)) == plain(rows[:50])
    # Two documents after each other in another file of the folder.
    more = "\n".join(json.dumps({"data": part}, indent=1) for part in (rows[50:60], [], rows[60:]))
    (tmp_path / "e.json").write_text(more)
    assert envelope(spark, str(tmp_path)) == plain(rows)


def test_one_large_document_has_many_tasks(spark, tmp_path, blocks):
    rows = documents(random.Random(3), 100)
    (tmp_path / "d.json").write_text(json.dumps({"data": rows}))
    assert envelope(spark, str(tmp_path / "d.json")) == plain(rows)
    if blocks == 600:
        assert splits.blocks_of(spark, str(tmp_path / "d.json"), "}").rdd.getNumPartitions() > 4


def test_lines_with_faulty_ones(spark, tmp_path, blocks):
    rows = documents(random.Random(5), 30)
    line = lambda part: json.dumps({"metadata": {"v": "}"}, "data": part})
    # Some lines lie within a block of any size here, which tells that a line is a document.
    lines = [line(rows[:10]), *[line([r]) for r in rows[10:16]], '{"metadata": {"v": 1}}', '{"data": [{"id": 1', "not json }", "", '{"data": null}', line(rows[16:])]
    (tmp_path / "d.json").write_text("\n".join(lines))
    (tmp_path / "e.json").write_text("\n".join(['{"data": [{"id": 1', "not json", ""]))
    assert envelope(spark, str(tmp_path / "d.json")) == plain(rows)
    assert envelope(spark, str(tmp_path)) == plain(rows)


def test_truncated_and_empty_documents(spark, tmp_path, blocks):
    rows = documents(random.Random(6), 3)
    text = json.dumps({"data": rows}, indent=1)
    (tmp_path / "cut.json").write_text(text[: text.rindex("}", 0, text.rindex("]"))])
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text('{"data": []}')
    assert envelope(spark, str(tmp_path)) == plain(rows[:2])
