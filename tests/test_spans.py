"""CSV files read in pieces, against the same files read at once."""

import csv
import io
import random

import pytest

from tessera.functions.types import FormatError
from tessera.sources import files, spans

TYPES = {"id": "LongInteger", "text": "String", "other": "String"}


def read(spark, path, types=TYPES, **options):
    rows = files.read_csv(spark, str(path), types, **options)
    return [tuple(r[c] for c in types) for r in sorted(rows.collect(), key=lambda r: r.row_index)], sorted(r.row_index for r in rows.select("row_index").collect())


def written(rows, end="\n", delimiter=",", header=True):
    f = io.StringIO()
    w = csv.writer(f, lineterminator=end, delimiter=delimiter)
    w.writerows([list(TYPES)] * header + rows)
    return f.getvalue()


def plain(rows):
    return [(int(a), b or None, c or None) for a, b, c in rows]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("piece", [7, 10_000])
def test_pieces(spark, tmp_path, end, piece):
    rng = random.Random(piece)
    parts = ["a", '"', ",", "\n", "é", " ", "word", '""', "\n\n", "'"]
    n = 40
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(6))), rng.choice(["", "x", "y" * 40])) for i in range(n)]
    path = tmp_path / "in.csv"
    text = written(rows, end)
    path.write_bytes(text.encode())
    cut = spans.pieces(spark, str(path), ",", piece)
    assert cut and len(cut) == -(-len(text.encode()) // piece)
    assert read(spark, path, piece=piece) == (plain(rows), list(range(n)))


def test_blank_lines_and_ends(spark, tmp_path):
    path = tmp_path / "in.csv"
    for end in ("\n", "\r\n"):
        for text in (f"{end}{end}1,a,b{end}{end}{end}2,c,d", f"1,a,b{end}2,c,d{end}{end}"):
            path.write_bytes(text.encode())
            for piece in (1, 100):
                assert read(spark, path, piece=piece, header=False) == ([(1, "a", "b"), (2, "c", "d")], [0, 1])


def test_what_is_not_cut(spark, tmp_path):
    path = tmp_path / "in.csv"
    for text in ('1,a"b,c\n2,"x",y\n', '1,a, "b"\n', '1,"a"b,c\n', "1,a,b\r2,c,d\r", "1,a,b\r\n2,c,d\n", '1,"a\rb",c\n'):
        path.write_bytes(text.encode())
        assert spans.pieces(spark, str(path), ",", 3) is None
        assert read(spark, path, header=False)[1]
    path.write_bytes(b"\xef\xbb\xbf1,a,b\n")
    assert spans.pieces(spark, str(path), ",") is None


def test_errors(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('1,"broken,x\n')
    with pytest.raises(FormatError, match="never closed"):
        spans.pieces(spark, str(path), ",")
    for text in ("1,a\n", "1,a,b,c\n", "x,a,b\n"):
        path.write_text("0,a,b\n" + text)
        with pytest.raises(Exception, match="MALFORMED"):
            read(spark, path, piece=4, header=False)


def test_one_long_record(spark, tmp_path):
    path = tmp_path / "in.csv"
    rows = [(0, "a", "b"), (1, "line\n" * 60_000, "c"), (2, "d", "e")]
    path.write_text(written(rows, delimiter=";"))
    assert read(spark, path, piece=40_000, delimiter=";")[0] == rows
