"""The split reader against Spark's reader of one task per file, with borders at every byte."""

import random

import pyarrow as pa
import pytest

from plaudit.sources import split_csv
from plaudit.sources.exports import CSV_QUOTING, read_export
from plaudit.sources.split_csv import POSITION, inside_quotes, read_split_csv, records
from test_exports import DIRTY, HEADER, export


@pytest.fixture
def ranges(spark):
    """Sets the size of the byte ranges files are split into."""
    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield of
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def both(spark, path):
    whole = [tuple(row) for row in read_export(spark, path, split=False).collect()]
    placed = read_export(spark, path, positions=True).orderBy(*POSITION).drop(*POSITION)
    return whole, [tuple(row) for row in placed.collect()]


def quoted_lines(seed, count):
    rng = random.Random(seed)
    for at in range(count):
        text = "".join(rng.choice(["word ", "\n", '""', ",", "é", "\r\n", "\n\n", "\\ "]) for _ in range(rng.randrange(14)))
        yield f'r{at},2026-01-02,{rng.choice(["Ann", "", "  Bo "])},BBB,5,"{rng.choice(["", "t"])}","{text}",http://a'


@pytest.mark.parametrize("size", [150, 100_000])
def test_quotes_across_borders(spark, tmp_path, ranges, size):
    path = export(tmp_path, *DIRTY, *quoted_lines(1, 12))
    ranges(size)
    whole, split = both(spark, path)
    assert split == whole and len(whole) == 21


def test_borders_at_every_byte():
    """Lines in ranges of any size, read with the parity at their start, make the same records."""
    text = 'h,"a\nb"\nr1,"a\n""b"" \r\n\n",u\n\nr2,"",x\n"\n\n\n",z'
    records = ['h,"a\nb"', 'r1,"a\n""b"" \r\n\n",u', 'r2,"",x', '"\n\n\n",z']
    for size in range(1, len(text) + 1):
        rows, at = [], 0
        for line in text.split("\n"):                  # a line belongs to the range it begins in
            place = (at - 1) // size * size if at else 0
            rows.append(("f", place, line, text[:next((k for k in range(at + 1) if (k - 1) // size * size == place and k and text[k - 1] == "\n"), 0)].count('"') % 2 == 1))
            at += len(line) + 1
        batches = [pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*rows[low:low + 2])], ["file", "range", "value", "inside"]) for low in range(0, len(rows), 2)]
        found = [row for batch in split_csv._joined(iter(batches)) for row in batch.to_pylist()]
        put = {}
        for row in sorted((row for row in found if row["fragment"]), key=lambda row: (row["range"], row["begins"])):
            if row["begins"]:
                put[len(put)] = [row["range"], row["line"], row["text"]]
            else:
                put[len(put) - 1][2] += "\n" + row["text"]
        whole = [[row["range"], row["line"], row["text"]] for row in found if not row["fragment"]]
        assert [row[2] for row in sorted(whole + list(put.values()))] == records
        assert [row["text"].startswith("h,") for row in found if row["first"]] == [True]


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, tmp_path, ranges, seed):
    path = export(tmp_path, *quoted_lines(seed, 40), bom=seed % 2 == 0)
    ranges(200 + 100 * seed)
    whole, split = both(spark, path)
    assert split == whole and len(whole) == 40


def test_one_file_is_read_by_many_tasks(spark, tmp_path, ranges):
    path = export(tmp_path, *quoted_lines(9, 3000))
    ranges(20_000)
    assert spark.read.csv(path, header=True, multiLine=True, **CSV_QUOTING).rdd.getNumPartitions() == 1
    assert records(spark, path).rdd.getNumPartitions() > 4
    whole, split = both(spark, path)
    assert split == whole and inside_quotes(spark, path).count() > 0


def test_many_ranges_are_joined_by_a_shuffle(spark, tmp_path, ranges):
    path = export(tmp_path, *quoted_lines(3, 50))
    ranges(400)
    found = [read_split_csv(spark, path, HEADER.strip().split(","), CSV_QUOTING, limit).orderBy(*POSITION).collect() for limit in (100_000, 0)]
    assert found[0] == found[1] and len(found[0]) == 50


def test_line_ends_of_both_kinds(spark, tmp_path, ranges):
    path = tmp_path / "crlf.csv"
    lines = [HEADER.strip(), 'r1,d,A,S,1,t,"two\r\nlines",u', "r2,d,A,S,1,t,plain,u", '"r3",d,A,S,1,t,"end\n",""']
    path.write_text("\r\n".join(lines), encoding="utf-8", newline="")
    ranges(60)
    whole, split = both(spark, str(path))
    assert [row[6] for row in split] == ["two\r\nlines", "plain", "end\n"]
    # Spark's own reader turns the breaks of such a file to line feeds, also inside quotes.
    assert [tuple(value and value.replace("\r\n", "\n") for value in row) for row in split] == whole


def test_files_in_order_and_other_headers(spark, tmp_path, ranges):
    for at in range(5):
        export(tmp_path, *(f'f{at}r{row},d,A,S,1,t,"line\nbreak",u' for row in range(20)), name=f"part-{at}.csv")
    ranges(300)
    found = read_export(spark, str(tmp_path), positions=True).orderBy(*POSITION).collect()
    assert [row.review_id for row in found] == [f"f{at}r{row}" for at in range(5) for row in range(20)]
    export(tmp_path, "2026,x,A,S,1,t,text,u", name="part-9.csv", header="Published,Review ID,Author,Source,Rating,Title,Review,URL\n")
    with pytest.raises(Exception, match="unexpected CSV header"):
        read_export(spark, str(tmp_path)).collect()


def test_empty_export(spark, tmp_path):
    assert read_export(spark, export(tmp_path)).collect() == []
