"""Names by dictionary (C6, D14, F1) and the candidate trim."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from sombra.functions import patterns as P
from sombra.operators import lexicon as L
from sombra.operators.classify import classify_tables
from sombra.operators.mask import MaskRules, mask_text
from sombra.operators.names import suspect_names

NAMES = ["Ana", "Beatriz", "João", "Silva", "Souza", "Santa Cruz", "Maria da Glória", "D'Ávila"]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(n,) for n in [*NAMES, None, " "]], "term string")


def norm(s):
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return s.upper().strip()


def brute(text, min_words=2):
    toks = [(m.start(), m.end(), norm(m.group())) for m in re.finditer(r"[^\W\d_][^\W\d_'’\-]*(?:['’\-][^\W\d_'’\-]*)*|[^\s\w]+|[\d_]+", text)]
    terms = {norm(n) for n in NAMES}
    kind = {}
    for i, (_, _, w) in enumerate(toks):
        if w in P.NAME_PARTICLES:
            kind.setdefault(i, 0)
        for n in range(1, 4):
            if " ".join(t[2] for t in toks[i:i + n]) in terms and i + n <= len(toks):
                for j in range(i, i + n):
                    kind[j] = 1
    out, i = [], 0
    while i < len(toks):
        if i not in kind:
            i += 1
            continue
        j = i
        while j in kind:
            j += 1
        own = [k for k in range(i, j) if kind[k]]
        if len(own) >= min_words:
            out.append((toks[own[0]][0], toks[own[-1]][1], len(own)))
        i = j
    return out


def test_tokens_keep_their_places(spark):
    texts = ["", "a", " Olá,  mundo! 12x çb ", "w " * 1000, "x" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", L.tokens(F.col("t")).alias("k"))
    for r in df.collect():
        assert all(r.t[x.start:x.end].replace("", "") == x.value for x in r.k or [])
        assert len(r.k or []) == len(re.findall(r"[^\W\d_][^\W\d_'’\-]*|[^\s\w]+|[\d_]+", r.t)) or "" in r.t or "12x" in r.t


def test_dictionary_join_against_brute_force(spark, names):
    r = random.Random(2)
    words = ["ana", "ANA", "Beatriz", "joao", "João", "silva", "Santa", "Cruz", "Maria", "da", "Glória", "de", "e", "casa", ",", ".", "viu", "souza", "d'ávila"]
    rows = [(i, "  ".join(r.choice(words) for _ in range(r.randrange(25)))) for i in range(150)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {}
    for x in L.recognise_names(df, ["id"], "t", names).collect():
        got.setdefault(x.id, []).append((x.start, x.end, x.n_words))
    for i, t in rows:
        assert sorted(got.get(i, [])) == brute(t or ""), (t, got.get(i))


def test_empty_dictionary(spark, names):
    df = spark.createDataFrame([(1, "Ana Silva")], "id long, t string")
    assert L.recognise_names(df, ["id"], "t", names.limit(0)).collect() == []


def test_entities_reach_the_mask(spark, key, names):
    df = spark.createDataFrame([(1, "ontem ana beatriz de souza saiu; Ana ficou"), (2, "nada"), (3, None)], "id long, t string")
    e = L.with_entities(df, "id", "t", names)
    got = {r.id: r.entity_terms for r in e.collect()}
    assert got == {1: ["ana beatriz de souza"], 2: [], 3: []}
    out = {r.id: r.m for r in e.select("id", mask_text(F.col("t"), MaskRules(unknown_names="mask"), key,
                                                       entity_terms=F.col("entity_terms")).alias("m")).collect()}
    assert "beatriz" not in out[1] and out[1].endswith("saiu; Ana ficou") and out[2] == "nada" and out[3] is None


def test_name_columns(spark, names):
    """A column of names is NOME_SOLTO whatever it is called."""
    r = random.Random(1)
    rows = [(f"{r.choice(['Ana', 'JOÃO', 'beatriz'])} {r.choice(['Silva', 'de Souza', 'Santa Cruz'])} {i % 7 * 'x'}".strip(),
             r.choice(["Ana", "João", "Beatriz"]) + " " * (i % 3), f"Ana Silva comprou {i} itens na loja, Depois saiu", f"rua {i}")
            for i in range(40)]
    df = spark.createDataFrame(rows, "pessoa string, apelido string, frase string, rua string")
    df = df.where("length(pessoa) < 20")
    with_names = {x.column: x.tag for x in classify_tables({"t": df}, lexicon=names).collect()}
    assert with_names["apelido"] == "NOME_SOLTO" and with_names["frase"] == "TEXTO_LIVRE" and with_names["rua"] != "NOME_SOLTO"
    assert {x.column: x.tag for x in classify_tables({"t": df}).collect()}["apelido"] != "NOME_SOLTO"


@pytest.mark.parametrize("raw,want,skip", [
    ("de Ana Souza", "Ana Souza", 3), ("  da  Ana", "Ana", 6), ("Ana de Souza foi embora", "Ana de Souza", 0),
    ("Ana Souza, 32 anos", "Ana Souza", 0), ("32 anos", "", 0), ("de do", "", 5), ("João D'Ávila-Lima", "João D'Ávila-Lima", 0),
    ("", "", 0), ("Ana É boa", "Ana", 0), ("o a os 7", "", 7)])
def test_trim(spark, raw, want, skip):
    r = spark.createDataFrame([(raw,)], "v string").select(L.trim_candidate(F.col("v")).alias("x")).first().x
    assert (r.value, r.skip) == (want, skip) and raw[r.skip:r.skip + len(r.value)] == want


def test_trim_keeps_span_offsets(spark):
    t = "Testemunha: da Ana Souza foi ouvida"
    df = spark.createDataFrame([(t,)], "t string")
    spans = df.select(suspect_names(F.col("t"), trim=True).alias("s")).first().s
    assert [(s.start, s.end, s.value) for s in spans] == [(15, 24, "Ana Souza")]
    verbs = spark.createDataFrame([("Ana correu muito",)], "t string").select(
        L.trim_candidate(F.col("t"), F.array(F.lit("correu"))).alias("x")).first().x
    assert verbs.value == "Ana"


def test_batch_hook(spark):
    df = spark.createDataFrame([(1, "RELATO DE ANA"), (2, None), (3, "Bia")], "id long, t string")
    seen = L.recognise(df, "t", lambda s: s.map(lambda t: [t + "!", '"x".']))
    assert {r.id: r.entity_terms for r in seen.collect()} == {1: ["Relato De Ana", "x"], 2: ["", "x"], 3: ["Bia", "x"]}
    with pytest.raises(Exception, match="one list per text"):
        L.recognise(df, "t", lambda s: s.iloc[:0]).collect()
