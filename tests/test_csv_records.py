"""Records that span lines, file splits inside cells, odd headers."""

import csv
import random
import re

import pytest
from pyspark.sql import functions as F

from sombra.plans import database as D
from sombra.sources import csv_records as CR
from sombra.sources import files as FS


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def write(path, text):
    path.write_bytes(text.encode())


def rows_of(df):
    return sorted(tuple(x or "" for x in r) for r in df.collect())


def automaton(line, inside, sep):
    """Character by character, as a reference."""
    state, field_start = ("in" if inside else "out"), not inside
    k = 0
    while k < len(line):
        c = line[k]
        if state == "in":
            if c == '"':
                if line[k + 1:k + 2] == '"':
                    k += 1
                else:
                    state = "out"
                    field_start = False
        elif c == '"' and field_start:
            state = "in"
        else:
            field_start = c == sep
        k += 1
    return state == "in"


def test_line_states_against_a_character_automaton(spark):
    r = random.Random(5)
    lines = ["".join(r.choice('ab,"" ') for _ in range(r.randrange(12))) for _ in range(1500)]
    df = spark.createDataFrame([(x,) for x in lines], "v string").select(
        "v", CR.leaves_open(F.col("v"), F.lit(","), False).alias("o"), CR.leaves_open(F.col("v"), F.lit(","), True).alias("i"))
    for row in df.collect():
        assert row.o == automaton(row.v, False, ","), row
        assert row.i == automaton(row.v, True, ","), row


@pytest.mark.parametrize("seed", [1, 2])
def test_no_cell_torn_and_files_still_split(spark, tmp_path, small_splits, seed):
    r = random.Random(seed)
    cells = ["x", 'a "b" c', "l1\nl2", "l1\r\nl2\n\n", "", 'say ""', '5" x', ",;,", '"', "é" * 40, "\n" * 6, '",\n"']
    rows = [(str(i), r.choice(cells), r.choice(["u", "v\nw", "z"])) for i in range(300)]
    for name, part in (("a.csv", rows[:200]), ("b.csv", rows[200:])):
        with open(tmp_path / name, "w", newline="") as f:
            out = csv.writer(f, lineterminator="\n" if seed == 1 else "\r\n")
            out.writerow(["id", "t", "u"])
            out.writerows(part)
    assert CR.lines_of(spark, str(tmp_path)).rdd.getNumPartitions() > 10
    good, bad = FS.read_csv_checked(spark, str(tmp_path))
    assert bad.count() == 0 and rows_of(good) == sorted(rows)


def test_quotes_inside_plain_fields_and_a_forcing_line(spark, tmp_path, small_splits):
    body = "".join(f'{i},5" cano,x\n' for i in range(40))
    write(tmp_path / "a.csv", "id,t,u\n" + body + '90,"um\ndois",y\n' + body.replace("cano", "tubo"))
    good, bad = FS.read_csv_checked(spark, str(tmp_path))
    got = rows_of(good)
    assert bad.count() == 0 and len(got) == 81 and ("90", "um\ndois", "y") in got and ("7", '5" tubo', "x") in got


def test_cell_that_never_ends_is_set_aside(spark, tmp_path, small_splits):
    write(tmp_path / "a.csv", 'a,b\n1,"x\ny"\n2,z\n3,"never\n' + "4,closed\n" * 50)
    write(tmp_path / "b.csv", 'a,b\n7,"p\nq"\n')
    good, bad = FS.read_csv_checked(spark, str(tmp_path))
    assert rows_of(good) == [("1", "x\ny"), ("2", "z"), ("7", "p\nq")]
    assert bad.count() == 51 and bad.first().header == "a,b"


def test_long_and_short_records(spark, tmp_path):
    write(tmp_path / "a.csv", 'a,b\n1,"x\ny",extra\n2\n\n3,"k\nl"\n')
    good, bad = FS.read_csv_checked(spark, str(tmp_path))
    assert rows_of(good) == [("2", ""), ("3", "k\nl")]
    assert [r.line for r in bad.collect()] == ['1,"x\ny",extra']


def test_unnamed_and_repeated_headers(spark, tmp_path):
    write(tmp_path / "a.csv", ",nome,cpf\n0,Ana,111.444.777-35\n1,Bia\n")
    good, bad = FS.read_csv_checked(spark, str(tmp_path))
    assert good.columns == ["_c0", "nome", "cpf"] and bad.count() == 0
    assert rows_of(good) == [("0", "Ana", "111.444.777-35"), ("1", "Bia", "")]
    assert FS.header_names("id;id;cpf;ID;", ";", spark) == ["id", "id_1", "cpf", "ID_2", "_c4"]
    assert FS.header_names('id,"a, b","id"', ",", spark) == ["id", "a, b", "id_1"]


def test_header_with_a_line_break(spark, tmp_path):
    write(tmp_path / "a.csv", 'id,"nome\ncompleto"\n1,Ana\n')
    good, _ = FS.read_csv_checked(spark, str(tmp_path))
    assert good.columns == ["id", "nome\ncompleto"] and rows_of(good) == [("1", "Ana")]


def test_job_masks_broken_cells_and_names_its_files(spark, key, tmp_path):
    """A text with a line break is one cell: nothing of it leaks into the next
    column, and every file comes out under its own name and columns."""
    src = tmp_path / "in"
    src.mkdir()
    write(src / "casos.csv", "status,relato,cpf\n" + "".join(
        f'aberto,"linha um {i}\nmaria{i}@example.com CPF 529.982.247-25 no texto, sim",111.444.777-35\n' for i in range(30)))
    write(src / "pessoas.csv", "id;email\n" + "".join(f"{i};ana{i}@example.com\n" for i in range(30)))
    D.mask_csv_files(spark, str(src), str(tmp_path / "out"), key, quarantine_path=str(tmp_path / "q"))
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir())
    assert names == ["name=SEGURO_casos.csv", "name=SEGURO_pessoas.csv"]
    casos = FS.read_csv(spark, str(tmp_path / "out" / names[0])).collect()
    assert len(casos) == 30 and {r.status for r in casos} == {"aberto"}
    text = " ".join(str(x) for r in casos for x in r)
    assert not re.search(r"maria\d+@", text) and "529.982.247-25" not in text and "111.444.777-35" not in text and "linha um" in text
    pessoas = FS.read_csv(spark, str(tmp_path / "out" / names[1]))
    assert pessoas.columns == ["id", "email"] and pessoas.where("email like 'ana%'").count() == 0
