"""The binary format: encoder against decoder, and against pandas where it reads the layout."""

import itertools
import os
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from larkspur.errors import Corrupted, SelectionError, TableError, Unsupported
from larkspur.sources import files
from larkspur.sources.catalog import read_catalog
from larkspur.sources.datasource import decode_pages
from larkspur.sources.decode import decompress_rdc, decompress_rle, micros, missing_tags
from larkspur.sources.encoder import missing, write_catalog, write_table
from larkspur.sources.layout import decode_text, infer_kind, page_kind, parse_header, read_layout, repair_mojibake, resolve_name

N = 700


def columns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=N).tolist()
    x[3], x[4], x[5] = None, missing("A"), missing("_")
    return [
        ("X", "num", 8, "BEST", "an x", x), ("NAME", "char", 12, "$CHAR", "", [f"name é{i % 7}" if i % 3 else "" for i in range(N)]),
        ("D", "num", 8, "DATE9.", "", [float(i) for i in range(N)]), ("K", "num", 4, "", "", [float(i) for i in range(N)]), ("TM", "num", 8, "TIME8.", "", [i * 10.0 for i in range(N)]),
    ]


def table(path, names=None, **options):
    layout = read_layout(files.opener(path))
    names = names or [v.name for v in layout.variables]
    return layout, pa.Table.from_batches(list(decode_pages(layout, files.opener(path), layout.pages, names, options)))


@pytest.mark.parametrize("wide,little,compression,mix", list(itertools.product((True, False), (True, False), ("none", "rle", "rdc"), (False, True))))
def test_layouts(tmp_path, wide, little, compression, mix):
    path = str(tmp_path / "t.sas7bdat")
    write_table(path, columns(), wide=wide, little=little, compression=compression, mix=mix, label="a label", pad=wide)
    layout, t = table(path, ["X", "NAME", "D", "K", "TM", "_row_id", "X__missing"], batchrows="100")
    t = t.to_pandas()
    assert layout.row_count == len(t) == N and layout.file_label == "a label"
    assert t.X__missing[3:6].tolist() == [".", "A", "_"] and t.NAME[0] is None and t._row_id.tolist() == list(range(N))
    other = pd.read_sas(path, encoding="utf-8")
    assert np.allclose(other.X[6:], t.X[6:]) and (other.K == t.K).all() and other.NAME[1] == t.NAME[1]
    assert str(t.D[59]) == "1960-02-29" and t.TM[6] == pd.Timedelta(seconds=60)


def test_compression_vectors():
    assert decompress_rle(bytes.fromhex("8041"), 1) == b"A" and decompress_rle(bytes.fromhex("C141"), 4) == b"AAAA"
    assert decompress_rle(bytes.fromhex("4000 41".replace(" ", "")), 18) == b"A" * 18
    assert decompress_rle(bytes([0x60, 3, 0xF0]), 22) == b" " * 20 + b"\0\0"
    assert decompress_rdc(b"\0\0" + b"0123456789abcdef", 16) == b"0123456789abcdef" and decompress_rdc(b"\0\0BCDE", 4) == b"BCDE"
    assert decompress_rdc(b"\x10\x00abc\x30\x00", 6) == b"abcabc"
    for bad in (b"\x80", b"\x85AB"):
        with pytest.raises(Corrupted):
            decompress_rle(bad, 9)
    with pytest.raises(Corrupted):
        decompress_rdc(b"\x40\x00a\x50\x00", 6)


def test_bad_files(tmp_path):
    path = tmp_path / "bad.sas7bdat"
    path.write_bytes(b"no table" * 100)
    with pytest.raises(Corrupted):
        read_layout(files.opener(str(path)))
    good = str(tmp_path / "t.sas7bdat")
    write_table(good, columns())
    raw = bytearray(open(good, "rb").read())
    raw[70] = 255
    with pytest.raises(Unsupported):
        parse_header(files.memory(bytes(raw)))


def test_text_and_kinds():
    assert decode_text("Éclair  ".encode("cp1252"), "cp1252") == "Éclair" and decode_text(b" \0 ", None) == ""
    assert decode_text("高雄市".encode(), "cp1252") == "高雄市" and repair_mojibake("高雄市".encode().decode("latin-1")) == "高雄市" and repair_mojibake("é") == "é"
    want = {"MONYY7.": "date", "TIMEAMPM": "time", "DATEAMPM": "date", "DTDATE9.": "datetime", "DOLLAR": "double", "YYMMDD10.": "date", "HHMM.": "time", "": "double"}
    assert {k: infer_kind(k) for k in want} == want
    assert [page_kind(x) for x in (0, 0x100, 0x200, 0x400, 0x4000, 0x8000, 0x9000)] == ["meta", "data", "mix", "amd", "meta2", "comp_table", "comp"]
    assert resolve_name(["a ", "A"], "a") == 0 and resolve_name(["a"], "A") == -1


def test_numbers():
    assert micros(np.array([-8908695999.854775, 1.5])).tolist() == [-8908695999854775, 1500000]
    bits = np.array([missing(t) for t in "._AZ"] + [1.0]).view(np.uint64)
    assert missing_tags(bits).tolist() == [".", "_", "A", "Z", None]


def test_strict_dates(tmp_path):
    path = str(tmp_path / "t.sas7bdat")
    write_table(path, [("D", "num", 8, "DATE9.", "", [1.0, 1e9, float("inf")])])
    assert table(path)[1].column("D").null_count == 2
    with pytest.raises(TableError):
        table(path, temporalerrors="fail")


def test_catalog(tmp_path):
    path = str(tmp_path / "c.sas7bcat")
    write_catalog(path, [("$A", [("M", "Male")]), ("SEX", [(1, "one"), (0, "zero"), (-2.5, "neg"), (".A", "tag")]), ("LONGERNAME12", [(float(i), f"label {i}") for i in range(300)])])
    sets = {s.name: s for s in read_catalog(files.opener(path))}
    assert [(x.number, x.tag, x.label) for x in sets["SEX"].labels] == [(1.0, None, "one"), (0.0, None, "zero"), (-2.5, None, "neg"), (None, "A", "tag")]
    assert sets["$A"].labels[0].string == "M" and len(sets["LONGERNAME12"].labels) == 300


def test_discovery(tmp_path):
    (tmp_path / "a").mkdir()
    path = str(tmp_path / "a" / "X.SAS7BDAT")
    write_table(path, columns())
    assert files.discover([str(tmp_path), path, str(tmp_path / "none")]) == [path]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.write(path, "inner/x.sas7bdat")
    assert os.path.getsize(files.extract_table(str(tmp_path / "z.zip"), str(tmp_path))) == os.path.getsize(path)


def test_unknown_column(tmp_path):
    path = str(tmp_path / "t.sas7bdat")
    write_table(path, columns())
    with pytest.raises(SelectionError):
        table(path, ["nope"])
