"""Classifier cases (FIXTURES B2)."""

import re

from sombra.operators.classify import classify_tables, name_parts


def policies(spark, data: dict[str, list]):
    cols = list(data)
    n = max(len(v) for v in data.values())
    rows = [tuple(data[c][i] if i < len(data[c]) else None for c in cols) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    return {r["column"]: (r["tag"], r["n_samples"]) for r in classify_tables({"t": df}).collect()}


def test_column_tags(spark):
    p = policies(spark, {
        "doc_cpf": [f"{i:03d}.{i+1:03d}.{i+2:03d}-{i % 100:02d}" for i in range(100, 160)],
        "numero": [f"{i:011d}" for i in range(10**10, 10**10 + 60)],
        "placa": [f"ABC{i % 10}D{i % 100:02d}" for i in range(60)],
        "email": [f"user{i}@example.com" for i in range(60)],
        "ip_origem": [f"10.{i}.{i % 7}.{i % 5}" for i in range(60)],
        "chassi": [f"9BWZZZ377VT{i:06d}" for i in range(60)],
        "local": [f"-25.{4000 + i},-49.{2700 + i}" for i in range(60)],
        "lat": [f"-25.{4000 + i}" for i in range(60)],
        "nascimento": [f"20{i % 24:02d}-01-{1 + i % 28:02d}" for i in range(60)],
        "relato": [f"O carro bateu. Depois saiu {i} vezes da pista" for i in range(60)],
        "cidade": ["Curitiba", "Londrina", "Maringá"] * 20,
        "vazio": [None] * 60,
        "so_prejudicado": ["PREJUDICADO"] * 60,
    })
    assert p["doc_cpf"][0] == "CPF"
    assert p["numero"][0] in ("CPF", "PHONE")
    assert p["placa"][0] == "PLACA"
    assert p["email"][0] == "EMAIL"
    assert p["ip_origem"][0] == "IP"
    assert p["chassi"][0] == "CHASSI"
    assert p["local"][0] == "COORD"
    assert p["lat"][0] == "COORD_SINGLE"
    assert p["nascimento"][0] == "IGNORAR"          # ISO dates: DATE_TIME beats RG (Q7)
    assert p["relato"][0] == "TEXTO_LIVRE"
    assert p["cidade"][0] == "IGNORAR"
    assert p["vazio"] == ("TEXTO_LIVRE", 0)
    assert p["so_prejudicado"] == ("TEXTO_LIVRE", 0)


def test_sample_size_and_confidence_edge(spark):
    # 30 of 50 samples look like e-mails: 0.60 -> EMAIL; 29 of 50: 0.58 -> free text rule
    ok = [f"u{i}@example.com" for i in range(30)] + [f"palavra{i}" for i in range(20)]
    low = [f"u{i}@example.com" for i in range(29)] + [f"palavra{i}" for i in range(21)]
    p = policies(spark, {"a": ok, "b": low})
    assert p["a"] == ("EMAIL", 50)
    assert p["b"][0] == "TEXTO_LIVRE"


def test_same_name_in_two_tables(spark):
    a = spark.createDataFrame([(f"u{i}@example.com",) for i in range(20)], "contato string")
    b = spark.createDataFrame([(f"texto livre numero {i}. Com frase",) for i in range(20)], "contato string")
    got = {(r["table"], r["column"]): r["tag"] for r in classify_tables({"a": a, "b": b}).collect()}
    assert got == {("a", "contato"): "EMAIL", ("b", "contato"): "TEXTO_LIVRE"}


def test_name_parts():
    assert name_parts("nr_cpfTitular") == ["nr", "cpf", "titular"]
    assert "rg" not in name_parts("cargo")


def test_prose_with_numbers_is_not_a_position(spark, key):
    """Coordinates must cover most of a value; a sentence with a CPF, an amount
    or a date in it is free text and is masked as such."""
    from sombra.operators.mask import mask_table
    rows = [(f"Caso {i} com CPF 111.444.777-{i:02d} e o email ana{i}@example.com informado, valor 1.000 reais",
             f"R$ 1.{i:03d} pago por ana{i}@example.com em 10.02.2024 no local",
             f"-25.{4284 + i},-49.{2733 + i}", f"lat -25.{4284 + i} lon -49.{2733 + i}", f"-25.{428400 + i}",
             f"R$ 1.{i + 100}") for i in range(60)]
    df = spark.createDataFrame(rows, "relato string, pago string, par string, rotulo string, simples string, valor string")
    got = {r.column: r.tag for r in classify_tables({"t": df}).collect()}
    assert got["relato"] == "TEXTO_LIVRE" and got["pago"] == "TEXTO_LIVRE"
    assert got["par"] == "COORD" and got["rotulo"] == "COORD_SINGLE" and got["simples"] == "COORD_SINGLE"
    assert not got["valor"].startswith("COORD")
    out = mask_table(df.select("relato", "pago"), got, None, key).collect()
    text = " ".join(x for r in out for x in r)
    assert not re.search(r"ana\d+@", text) and "111.444.777" not in text
