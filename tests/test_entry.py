"""Queries against their SQL on the smallest tables, and the readers."""

import io
import os
import zipfile

import pytest

import __spark_entry__ as entry
from factloom import queries as reference
from factloom.sources import documents

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(str, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(reference.queries()))
def test_query_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert rows_of(got) == rows_of(want)


def test_documents_are_read_or_set_aside(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# 제목\n글", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("한글".encode("cp949"))
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe\xfa\x80\x81")
    (tmp_path / "d.hwp").write_bytes(b"x")
    (tmp_path / "e.pdf").write_bytes(b"no pdf")
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("Contents/section0.xml", '<s xmlns:hp="h"><hp:p><hp:run><hp:t>첫</hp:t><hp:t>줄</hp:t></hp:run></hp:p><hp:p><hp:run><hp:t>둘</hp:t></hp:run></hp:p></s>')
    (tmp_path / "f.hwpx").write_bytes(held.getvalue())
    got = {r.path[-5:].lstrip("/"): r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    text = {k: [b.text for b in r.blocks] if r.blocks else None for k, r in got.items()}
    assert text["a.txt"] == ["제목", "글"] and text["b.txt"] == ["한글"] and text[".hwpx"] == ["첫줄", "둘"]
    assert all(got[k].parse_error for k in ("c.txt", "d.hwp", "e.pdf"))


def test_pairs_fail_on_missing_texts(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"pair_id": "1", "source_text": "a", "easy_text": "b"}\n', encoding="utf-8")
    assert documents.read_pairs(spark, str(tmp_path / "p.jsonl")).count() == 1
    (tmp_path / "q.jsonl").write_text('{"pair_id": "1", "source_text": "a"}\n', encoding="utf-8")
    with pytest.raises(Exception):
        documents.read_pairs(spark, str(tmp_path / "q.jsonl")).collect()
